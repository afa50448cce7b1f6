"""License scans by sentence rules.

A text is cut into pieces at line ends and after ``. ! ? ;`` before a blank, each normalised (lower case,
marks and comment leaders dropped, blanks collapsed). Pieces in a row that make up a known licence
sentence are joined, the longest first, never over an empty line: so hard-wrapped licences read
as on one line, and ``v. 2.0`` is whole. So are pieces after the fixed head of a sentence with a varying part. Every other piece is a sentence. A sentence is looked up among known licence
sentences and becomes its identifier; unknown sentences give none, but ``gap`` or more of them
in a row part what lies before from what follows. The rules, in order, are then matched against
each part's identifiers: the first rule that fits at a place names the licence and takes its
identifiers. Identifiers that no rule takes are reported as they are. That all rights are reserved says nothing
where the same text grants a licence: by several sentences or a licence's title, not only a notice that names one.

Defined results: null and empty texts have no sentences and no licences; very long texts are read whole; of rules that
fit at one place the first listed counts, of known sentences the longest; repeated rows repeat;
a licence found twice in a text is named once, at its first place; an empty table gives no
rows; a null doc_id stays null; other columns are not read.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from strataloom.llm.common import map_texts, texts

#: Known sentences of public licences and notices, as published.
SENTENCES = {
    "ApacheNotice": ["Licensed under the Apache License, Version 2.0", "This work is licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")", "Released under the Apache License, Version 2.0"],
    "ApacheCompliance": ["you may not use this file except in compliance with the License"],
    "ApacheObtain": ["You may obtain a copy of the License at"],
    "ApacheAsIs": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"],
    "ApacheSee": ["See the License for the specific language governing permissions and limitations under the License"],
    "MitNotice": ["Released under the MIT License", "Licensed under the MIT License", "This work is licensed under the MIT License", "This project is licensed under the MIT License", "The MIT License", "MIT License"],
    "MitGrant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "MitInclude": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "AsIsSoftware": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"],
    "NoLiability": ["IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"],
    "Gpl3Notice": ["This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3", "Released under the GNU General Public License, version 3"],
    "Gpl2Notice": ["This work is licensed under the GNU General Public License, version 2", "Licensed under the GNU General Public License, version 2", "Released under the GNU General Public License, version 2"],
    "GplFree": ["This program is free software"],
    "Gpl3Free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "Gpl2Free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version"],
    "Gpl3Plus": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "GplHope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"],
    "GplNoWarranty": ["without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"],
    "GplSee": ["See the GNU General Public License for more details"],
    "Gpl1Plus": ["either version 1, or (at your option) any later version"],
    "GplTerms": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "LgplFree": ["This library is free software"],
    "LgplTerms": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation"],
    "Lgpl2Plus": ["either version 2 of the License, or (at your option) any later version"],
    "Lgpl21Plus": ["either version 2.1 of the License, or (at your option) any later version"],
    "Lgpl3Plus": ["either version 3 of the License, or (at your option) any later version"],
    "LgplHope": ["This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"],
    "LgplSee": ["See the GNU Lesser General Public License for more details", "See the GNU Library General Public License for more details"],
    "Lgpl3Notice": ["Licensed under the GNU Lesser General Public License, version 3", "This work is licensed under the GNU Lesser General Public License, version 3"],
    "Lgpl21Notice": ["Licensed under the GNU Lesser General Public License, version 2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1"],
    "Gpl1Title": ["GNU GENERAL PUBLIC LICENSE Version 1, February 1989"],
    "Gpl2Title": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "Gpl3Title": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "Lgpl2Title": ["GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "Lgpl21Title": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "Lgpl3Title": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "Gfdl12Title": ["GNU Free Documentation License Version 1.2, November 2002"],
    "Gfdl13Title": ["GNU Free Documentation License Version 1.3, 3 November 2008"],
    "ApacheTitle": ["Apache License Version 2.0, January 2004"],
    "Mpl11Title": ["MOZILLA PUBLIC LICENSE Version 1.1"],
    "Mpl2Title": ["Mozilla Public License Version 2.0"],
    "Mpl11Subject": ["The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\")"],
    "Cc0Title": ["CC0 1.0 Universal"],
    "ArtisticTitle": ["The \"Artistic License\"", "The Artistic License"],
    "BsdRedistribute": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "BsdSource": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "BsdBinary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "BsdEndorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "Bsd3Notice": ["Licensed under the BSD 3-Clause License", "Released under the BSD 3-Clause License"],
    "Bsd2Notice": ["Licensed under the BSD 2-Clause License", "Released under the BSD 2-Clause License"],
    "IscGrant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "MplForm": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "CcByNc4": ["Licensed under CC BY-NC 4.0", "This work is licensed under CC BY-NC 4.0"],
    "CcBy4": ["Licensed under CC BY 4.0", "This work is licensed under CC BY 4.0"],
    "CcBySa4": ["Licensed under CC BY-SA 4.0", "This work is licensed under CC BY-SA 4.0"],
    "Cc0": ["Licensed under CC0 1.0", "Released under CC0 1.0"],
    "PublicDomain": ["This is free and unencumbered software released into the public domain"],
    "AllRights": ["All rights reserved"],
}
#: Sentences with a varying part, tried on normalised text.
PATTERNS = (
    ("SpdxTag", re.compile(r"spdx license identifier (.+)")),
    ("Copyright", re.compile(r"copyright\b.*\d{4}.*|copyright c .*")),
    ("BsdEndorse", re.compile(r"neither the names? of .+ may be used to endorse or promote products derived from this software without specific prior written permission")),
    ("BsdAsIs", re.compile(r"this software is provided by .+ as is and any express or implied warranties .+ are disclaimed")),
)
#: The fixed heads of those that may go on over several lines, and over how many.
HEADS = ("neither the name", "this software is provided by")
MOST_LINES = 24
#: Ordered rules: a licence and the identifiers that name it, one after the other; the more specific come first.
LICENCES = (
    ("MIT", ("MitNotice", "MitGrant", "MitInclude", "AsIsSoftware", "NoLiability")),
    ("MIT", ("MitGrant", "MitInclude", "AsIsSoftware", "NoLiability")),
    ("MIT", ("MitGrant", "MitInclude", "AsIsSoftware")),
    ("Apache-2.0", ("ApacheNotice", "ApacheCompliance", "ApacheObtain", "ApacheAsIs", "ApacheSee")),
    ("GPL-3.0-or-later", ("Gpl3Free", "GplHope", "GplNoWarranty", "GplSee")),
    ("GPL-2.0-or-later", ("Gpl2Free", "GplHope", "GplNoWarranty", "GplSee")),
    ("GPL-3.0-or-later", ("Gpl3Free",)),
    ("GPL-2.0-or-later", ("Gpl2Free",)),
    ("GPL-3.0-or-later", ("GplFree", "Gpl3Plus", "GplHope", "GplNoWarranty", "GplSee")),
    ("GPL-3.0-or-later", ("GplFree", "GplTerms", "Lgpl3Plus", "GplHope", "GplNoWarranty", "GplSee")),
    ("GPL-3.0-or-later", ("GplFree", "GplTerms", "Lgpl3Plus")),
    ("GPL-2.0-or-later", ("GplFree", "GplTerms", "Lgpl2Plus", "GplHope", "GplNoWarranty", "GplSee")),
    ("GPL-2.0-or-later", ("GplFree", "GplTerms", "Lgpl2Plus")),
    ("GPL-1.0-or-later", ("GplFree", "GplTerms", "Gpl1Plus", "GplHope", "GplNoWarranty", "GplSee")),
    ("LGPL-3.0-or-later", ("LgplFree", "LgplTerms", "Lgpl3Plus", "LgplHope", "GplNoWarranty", "LgplSee")),
    ("LGPL-2.1-or-later", ("LgplFree", "LgplTerms", "Lgpl21Plus", "LgplHope", "GplNoWarranty", "LgplSee")),
    ("LGPL-2.0-or-later", ("LgplFree", "LgplTerms", "Lgpl2Plus", "LgplHope", "GplNoWarranty", "LgplSee")),
    ("LGPL-3.0-or-later", ("LgplFree", "LgplTerms", "Lgpl3Plus")),
    ("LGPL-2.1-or-later", ("LgplFree", "LgplTerms", "Lgpl21Plus")),
    ("LGPL-2.0-or-later", ("LgplFree", "LgplTerms", "Lgpl2Plus")),
    ("BSD-3-Clause", ("BsdRedistribute", "BsdSource", "BsdBinary", "BsdEndorse", "BsdAsIs")),
    ("BSD-3-Clause", ("BsdRedistribute", "BsdSource", "BsdBinary", "BsdEndorse")),
    ("BSD-2-Clause", ("BsdRedistribute", "BsdSource", "BsdBinary", "BsdAsIs")),
    ("BSD-2-Clause", ("BsdRedistribute", "BsdSource", "BsdBinary")),
    ("MPL-1.1", ("Mpl11Subject", "ApacheCompliance", "ApacheObtain")),
    ("MPL-1.1", ("Mpl11Subject",)),
    ("GPL-3.0", ("Gpl3Title",)),
    ("GPL-2.0", ("Gpl2Title",)),
    ("GPL-1.0", ("Gpl1Title",)),
    ("LGPL-3.0", ("Lgpl3Title",)),
    ("LGPL-2.1", ("Lgpl21Title",)),
    ("LGPL-2.0", ("Lgpl2Title",)),
    ("GFDL-1.3", ("Gfdl13Title",)),
    ("GFDL-1.2", ("Gfdl12Title",)),
    ("Apache-2.0", ("ApacheTitle",)),
    ("MPL-1.1", ("Mpl11Title",)),
    ("MPL-2.0", ("Mpl2Title",)),
    ("CC0-1.0", ("Cc0Title",)),
    ("Artistic", ("ArtisticTitle",)),
    ("LGPL-3.0-only", ("Lgpl3Notice",)),
    ("LGPL-2.1-only", ("Lgpl21Notice",)),
    ("ISC", ("IscGrant",)),
    ("MPL-2.0", ("MplForm",)),
    ("Unlicense", ("PublicDomain",)),
    ("MIT", ("MitNotice",)),
    ("Apache-2.0", ("ApacheNotice",)),
    ("GPL-3.0-only", ("Gpl3Notice",)),
    ("GPL-2.0-only", ("Gpl2Notice",)),
    ("BSD-3-Clause", ("Bsd3Notice",)),
    ("BSD-2-Clause", ("Bsd2Notice",)),
    ("CC-BY-NC-4.0", ("CcByNc4",)),
    ("CC-BY-SA-4.0", ("CcBySa4",)),
    ("CC-BY-4.0", ("CcBy4",)),
    ("CC0-1.0", ("Cc0",)),
    ("Proprietary", ("Copyright", "AllRights")),
    ("Proprietary", ("AllRights",)),
)
_MARKS = str.maketrans({c: " " for c in ",\"'()[]{}<>*#%/|:-_`\t\r\x0b\x0c;!?"})


def pieces(text: str) -> list[str]:
    """Normalised pieces of a text between line ends and final marks."""
    for mark in ".!?;":
        text = text.replace(mark + " ", mark + "\n")
    return [" ".join(line.split()).rstrip(" .") for line in text.lower().translate(_MARKS).split("\n")]


KNOWN = {" ".join(pieces(s)): name for name, forms in SENTENCES.items() for s in forms}
#: all that a known sentence can begin with and still go on
BEGUN = frozenset(s[:k] for s in KNOWN for k, c in enumerate(s) if c == " ")


def sentences(text: str) -> list[str]:
    """Normalised sentences of a text: its pieces, those of a known sentence joined."""
    found = pieces(text)
    if BEGUN.isdisjoint(found) and not any(p.startswith(HEADS) for p in found):
        return found
    out, at = [], 0
    while at < len(found):
        whole, best, end = found[at], found[at], at + 1
        last = end
        varying = whole.startswith(HEADS)
        while (whole in BEGUN or varying and last < at + MOST_LINES) and last < len(found) and found[last]:
            whole = f"{whole} {found[last]}"
            last += 1
            if whole in KNOWN or varying and identify(whole):
                best, end = whole, last
        out.append(best)
        at = end
    return out


def identify(sentence: str) -> str | None:
    if (name := KNOWN.get(sentence)) is not None:
        return name
    if sentence[:9] == "copyright" or sentence[:4] == "spdx" or sentence.startswith(HEADS):
        for name, pattern in PATTERNS:
            if found := pattern.fullmatch(sentence):
                return f"{name}:{found[1]}" if name == "SpdxTag" else name
    return None


def scan(text: str, gap: int = 3) -> tuple[int, list[str], list[str], list[str]]:
    """Of a text: the number of sentences, all identifiers in order, the licences, and the identifiers no rule took."""
    count, parts, since = 0, [], gap
    for sentence in sentences(text):
        if not sentence:
            continue
        count += 1
        name = identify(sentence)
        if name is None:
            since += 1
            continue
        if since >= gap:
            parts.append([])
        parts[-1].append(name)
        since = 0
    licences, left, granted = [], [], False
    for names in parts:
        at = 0
        while at < len(names):
            licence, size = names[at].partition(":")[2], 1
            if not licence:
                licence, size = next(((name, len(rule)) for name, rule in LICENCES if tuple(names[at : at + len(rule)]) == rule), ("", 1))
            granted |= bool(licence) and licence != "Proprietary" and (size > 1 or names[at].endswith("Title"))
            (licences if licence else left).append(licence or names[at])
            at += size
    if granted:
        licences = [name for name in licences if name != "Proprietary"]
    return count, [n for names in parts for n in names], [*dict.fromkeys(licences)], left


def find(docs: DataFrame, gap: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_sentences, sentence_ids, licences, unmatched)``; the last three comma-joined."""
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> dict:
        found = [scan(t, gap) for t in texts(batch.column(1))]
        out = {"doc_id": batch.column(0), "n_sentences": pa.array([f[0] for f in found], pa.int64())}
        return out | {name: pa.array([",".join(f[k]) for f in found], pa.string()) for k, name in enumerate(("sentence_ids", "licences", "unmatched"), 1)}

    return map_texts(docs, [id_col, text_col], text_col, f"doc_id {kind}, n_sentences bigint, sentence_ids string, licences string, unmatched string", work)
