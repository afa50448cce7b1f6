import base64
import hashlib
import itertools
import math
import os
import random
import re
import struct
import textwrap
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from strataloom.llm import automaton, bpe, decontaminate, langid, licenses, minhash, pseudolikelihood, secrets, simhash, simhash_similar, tokenpack, urlfilter
from tests.llm import cases

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return cases.docs(spark).cache()


def text_of(row) -> str:
    return row[1] or ""


def test_decontaminate_exact_substituted_and_clean(spark, docs):
    item = cases.prose(500, 30)
    words = item.split()
    changed = [w if k % 8 else "zzz" for k, w in enumerate(words)]
    rows = [(1, "x y " + item + " z"), (2, " ".join(["q"] * 50 + changed)), (3, cases.prose(501, 300)), (4, None), (5, " ".join(words[:8])), (1, "x y " + item + " z"), (6, " ".join(words[5:20]))]
    bench = spark.createDataFrame([(11, item), (7, item), (8, None), (9, ""), (10, "one two three four five six"), (13, "see"), (14, "two words")], "item_id bigint, text string")
    both = spark.createDataFrame([*rows, (12, "see one two three four five six now"), (15, "Two  words."), (16, "two words more")], "doc_id bigint, text string")
    found = decontaminate.overlaps(both, bench).collect()
    assert sorted((r.doc_id, r.item_id, r.n_items) for r in found) == [(1, 7, 2), (1, 7, 2), (2, 7, 2), (6, 7, 2), (12, 10, 1), (15, 14, 1)]
    whole = next(r for r in found if r.doc_id == 1)
    assert (whole.n_matches, whole.n_words, whole.doc_start, whole.item_start, whole.item_words) == (30, 30, 2, 0, 30)
    for at_once in (1, 2, 9):  # several blocks and passes give the same
        small = decontaminate.overlaps(both, bench, block_bytes=64, at_once=at_once)
        assert sorted(map(tuple, small.collect())) == sorted(map(tuple, found))
        assert sorted(r.doc_id for r in decontaminate.clean(both, bench, block_bytes=64, at_once=at_once).collect()) == [3, 4, 5, 16]
    assert decontaminate.overlaps(docs, bench.limit(0)).count() == 0
    assert decontaminate.overlaps(cases.empty(spark), bench).count() == 0
    assert decontaminate.clean(docs, bench).columns == docs.columns


def test_masks_find_a_fifth_of_substitutions_anywhere():
    for n in range(5, 22):
        masks = decontaminate.masks_for(n)
        kept = [{start + k for k, c in enumerate(m) if c == "1"} for m in masks for start in range(n - len(m) + 1)]
        for changed in itertools.combinations(range(n), n // 5 if n < 17 else 3 if n < 20 else 4):
            assert any(k.isdisjoint(changed) for k in kept), (n, changed)


def brute_overlaps(texts, items):
    expected = {}
    for d, text in enumerate(texts):
        w = decontaminate.words(text)
        for k, item in items:
            v = decontaminate.words(item)
            if len(v) < 5:
                if v and v == w:
                    expected[d, k] = len(v)
                continue
            most = 0
            for shift in range(-len(v), len(w)):
                same = [w[shift + j] == v[j] for j in range(len(v)) if 0 <= shift + j < len(w)]
                spans = [(y - x, -y, sum(same[x:y])) for x in range(len(same)) for y in range(x + 1, len(same) + 1) if 5 * sum(same[x:y]) >= 4 * (y - x)]
                most = max(most, max(spans, default=(0, 0, 0))[2])
            if most >= min(13, -(-4 * len(v) // 5)):
                expected[d, k] = most
    return expected


def test_decontaminate_against_brute_force():
    draw = random.Random(5)
    items = [(n, cases.prose(600 + n, n)) for n in range(1, 41)]
    texts = []
    for n, item in items:
        words = item.split()
        texts += [item, cases.prose(700 + n, 25) + " " + item + " " + cases.prose(800 + n, 9)]
        for share in (0.1, 0.2, 0.25):
            own = words[:]
            for k in draw.sample(range(n), round(share * n)):
                own[k] = "zzz"
            start = draw.randrange(n // 3 + 1)
            texts.append(cases.prose(900 + n, 12) + " " + " ".join(own[start:]))
    texts += [cases.prose(1000, 100), ""]
    expected = brute_overlaps(texts, items)
    index = decontaminate.Index([(k, t, 1) for k, t in items])
    got = index.find([decontaminate.words(t) for t in texts])
    assert len(expected) > 100 and {d: n for d, (n, _) in got.items()} == Counter(d for d, _ in expected)
    for d, (_, (item, matches, *_)) in got.items():
        assert matches == max(m for (e, _), m in expected.items() if e == d) and expected[d, index.names[item]] == matches


def test_a_seed_of_many_items_is_one_row_a_document(spark):
    opening = cases.prose(1, 20)
    bench = spark.createDataFrame([(k, f"{opening} {cases.prose(100 + k, 10)}") for k in range(1500)], "item_id bigint, text string")
    docs = spark.createDataFrame([(k, f"{cases.prose(5000 + k, 9)} {opening}") for k in range(50)], "doc_id bigint, text string")
    got = decontaminate.overlaps(docs, bench).collect()
    assert len(got) == 50 and all((r.n_items, r.item_id, r.n_matches) == (1500, 0, 20) for r in got)


def test_bpe_equals_library(spark, docs):
    tiktoken = pytest.importorskip("tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    got = bpe.digests(docs, RANKS).collect()
    expected = []
    for r in cases.rows():
        ids = library.encode_ordinary(text_of(r))
        expected.append((r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text_of(r).encode()).hexdigest(), 0))
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)
    assert bpe.digests(cases.empty(spark), RANKS).count() == 0
    back = bpe.decode(bpe.encode(docs.select("doc_id", "text"), RANKS), RANKS)
    assert sorted((r.text for r in back.collect())) == sorted(text_of(r) for r in cases.rows())


def test_transducer_small_tables_change_nothing():
    ranks = bpe.read_ranks(RANKS)
    small, large = bpe.Transducer(ranks, 5), bpe.Transducer(ranks)
    for seed in range(300):
        word = cases.prose(seed, 1).encode()
        assert small.encode(word) == large.encode(word) == ([ranks[word]] if word in ranks else large.merge(word))


def test_utf8_stream_equals_replace():
    draw = np.random.default_rng(1)
    for _ in range(3000):
        data = bytes(draw.choice([0xE2, 0x82, 0xAC, 0x41, 0xF0, 0x9F, 0x98, 0x80, 0xC3, 0xED, 0xA0, 0xFF], draw.integers(0, 10)).tolist())
        cut = int(draw.integers(0, len(data) + 1))
        stream = bpe.Utf8Stream()
        assert stream.feed(data[:cut]) + stream.feed(data[cut:], last=True) == data.decode("utf-8", "replace")


def test_language_id(spark, docs):
    model = langid.fit(docs)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert got[15].lang_pred == "und" and got[14].lang_pred == "und" and got[14].rejected and got[14].score == 0
    assert all(0 <= r.score <= 1 for r in got.values())
    assert got[3].held_out == (zlib.crc32(b"3") % 5 == 0)
    assert langid.predict(cases.empty(spark), model).count() == 0
    none = langid.fit(cases.empty(spark))
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.keep_known(docs, model).columns == docs.columns


def test_language_id_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.predict(docs, langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right, total, rejected = got.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*"), F.count_if("rejected")).first()
    assert right / total > 0.97 and rejected == 0


def test_language_id_rejects_other_languages_and_noise(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    draw = random.Random(3)
    letters = lambda n: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    strange = [
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
        letters(2000),
        " ".join(letters(draw.randint(2, 9)) for _ in range(300)),
        base64.b64encode(draw.randbytes(1500)).decode(),
        "".join(chr(draw.randrange(0x4E00, 0x9FA0)) for _ in range(500)),
    ]
    assert model.predict(strange)[2].all()
    known = [r.text for r in docs.where("length(text) > 2000").select("text").limit(60).collect()]
    for size in (5, 20, 80, 320, 2000):
        assert model.predict([t[:size] for t in known])[2].sum() <= 2
    assert not model.predict(["The house.", "It was there and then they went out of the house and into the other one."])[2].any()


OWN_PROSE = {
    "en": ["All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood.", "Everyone has the right to life, liberty and security of person.", "No one shall be held in slavery or servitude; slavery and the slave trade shall be prohibited in all their forms.", "It was the best of times, it was the worst of times, it was the age of wisdom, it was the age of foolishness.", "Call me Ishmael. Some years ago, never mind how long precisely, having little or no money in my purse, I thought I would sail about a little.", "Happy families are all alike; every unhappy family is unhappy in its own way.", "The committee will meet on Thursday to discuss the new budget and the repairs to the school roof."],
    "de": ["Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geist der Brüderlichkeit begegnen.", "Jeder hat das Recht auf Leben, Freiheit und Sicherheit der Person.", "Niemand darf in Sklaverei oder Leibeigenschaft gehalten werden; Sklaverei und Sklavenhandel sind in allen ihren Formen verboten.", "Als Gregor Samsa eines Morgens aus unruhigen Träumen erwachte, fand er sich in seinem Bett zu einem ungeheueren Ungeziefer verwandelt.", "Der Ausschuss trifft sich am Donnerstag, um über den neuen Haushalt und die Reparatur des Schuldachs zu sprechen."],
    "fr": ["Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité.", "Tout individu a droit à la vie, à la liberté et à la sûreté de sa personne.", "Longtemps, je me suis couché de bonne heure. Parfois, à peine ma bougie éteinte, mes yeux se fermaient si vite que je n'avais pas le temps de me dire: je m'endors.", "Le comité se réunira jeudi pour discuter du nouveau budget et des réparations du toit de l'école.", "Faites revenir les oignons jusqu'à ce qu'ils soient dorés, puis ajoutez les tomates et laissez mijoter vingt minutes."],
    "es": ["Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros.", "Todo individuo tiene derecho a la vida, a la libertad y a la seguridad de su persona.", "Nadie estará sometido a esclavitud ni a servidumbre; la esclavitud y la trata de esclavos están prohibidas en todas sus formas.", "En un lugar de la Mancha, de cuyo nombre no quiero acordarme, no ha mucho tiempo que vivía un hidalgo de los de lanza en astillero, adarga antigua, rocín flaco y galgo corredor.", "El comité se reunirá el jueves para hablar del nuevo presupuesto y de las reparaciones del tejado de la escuela."],
}
FOREIGN_PROSE = [
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
    "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek.",
    "Všichni lidé rodí se svobodní a sobě rovní co do důstojnosti a práv. Jsou nadáni rozumem a svědomím a mají spolu jednat v duchu bratrství.",
    "Semua orang dilahirkan merdeka dan mempunyai martabat dan hak-hak yang sama. Mereka dikaruniai akal dan hati nurani dan hendaknya bergaul satu sama lain dalam semangat persaudaraan.",
    "Watu wote wamezaliwa huru, hadhi na haki zao ni sawa. Wote wamejaliwa akili na dhamiri, hivyo yapasa watendeane kindugu.",
    "Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền lợi.",
    "Все люди рождаются свободными и равными в своем достоинстве и правах.",
    "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα.",
]


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_language_id_outside_the_corpus(spark, sf):
    """Public prose is told apart and kept, that of unrelated languages rejected, whatever the size of the table fitted on."""
    model = langid.fit(spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet"))
    rows = [(name, text) for name, some in OWN_PROSE.items() for text in some]
    names, _, rejected = model.predict([text for _, text in rows])
    assert sum(name == mine for name, (mine, _) in zip(names, rows, strict=True)) >= 0.9 * len(rows)
    assert rejected.sum() <= 0.1 * len(rows)
    assert model.predict(FOREIGN_PROSE)[2].sum() >= 0.8 * len(FOREIGN_PROSE)


def plain_grams(text, size):
    """Hashed n-gram counts of one text by plain whole numbers."""
    codes = [0, *(ord(c) if c.isalpha() else 0 for c in text.lower()), 0]
    out = {}
    for i in range(len(codes)):
        h = codes[i] * 0x9E3779B1 % 2**32
        for n in (1, 2, 3):
            if n > 1:
                if i + n > len(codes):
                    break
                h = (h ^ codes[i + n - 1]) * (0x85EBCA6B if n == 2 else 0xC2B2AE35) % 2**32
            middle = codes[i + 1] if n == 3 else codes[i] or (n == 2 and codes[i + 1])
            if middle:
                at = (h ^ (h >> 15)) % size
                out[at] = out.get(at, 0) + 1
    return out


def test_language_id_against_plain_nearest_centroid(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(docs)
    size, centroids = len(model.weights), [{k: float(v) for k, v in enumerate(c) if v} for c in model.centroids]
    assert all(abs(sum(v * v for v in c.values()) - 1) < 1e-4 for c in centroids)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    for r in docs.select("doc_id", "text").collect():
        grams = plain_grams(r.text or "", size)
        mine = got[r.doc_id]
        if not grams:
            assert (mine.lang_pred, mine.score, mine.rejected) == ("und", 0, True)
            continue
        vector = {k: math.log(1 + n) * float(model.weights[k]) for k, n in grams.items()}
        length = math.sqrt(sum(v * v for v in vector.values()))
        cosines = [sum(v * c.get(k, 0) for k, v in vector.items()) / length for c in centroids]
        best = max(cosines)
        assert abs(mine.score - best) < 1e-4
        assert mine.lang_pred in {model.languages[o] for o, c in zip(model.owner, cosines, strict=True) if c > best - 1e-4}
        bound = model.bounds[min(sum(grams.values()).bit_length(), langid.LEVELS) - 1]
        assert mine.rejected == (best < bound) or abs(best - bound) < 1e-4


def test_url_rules_and_terms(spark):
    urls = ["http://www.example.com/en/1", "http://a.EXAMPLE.com/en/", "https://x.net/es/q?z", "http://x.com/", "http://x.com", None, "no scheme", "http://casino-win.org/a", "http://free-bets.org", "http://freebets.org", "http://free.org/free", "http://exampleXcom/en/"]
    pages = spark.createDataFrame([(k, u, 1) for k, u in enumerate(urls)], "page_id bigint, url string, host int")
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge(pages).collect()}
    assert got[0] == ("www.example.com/en/", "allow") and got[1] == ("example.com/en/", "block") and got[2] == ("net/es/", "block")
    assert got[3] == ("com/", "allow") and got[4] == (None, "allow") and got[5] == (None, "allow") and got[6] == (None, "allow")
    assert got[7] == (None, "block") and got[8] == (None, "block") and got[9] == (None, "allow") and got[10] == (None, "allow") and got[11] == (None, "allow")
    assert urlfilter.judge(pages.limit(0)).count() == 0


def test_url_terms_against_brute_force(spark):
    draw = random.Random(8)
    terms, marks = [*urlfilter.STRICT, *urlfilter.SOFT], ["-", ".", "/", "_", "x", "7", "?q=", "&"]
    urls = ["http://site.org/" + "".join(draw.choice(marks) + (draw.choice(terms) if draw.random() < 0.5 else cases.prose(draw.randrange(999), 1)) for _ in range(draw.randint(0, 6))) for _ in range(400)]
    urls += ["http://site.org/" + "a/" * 200_000 + "casino", urls[3], "http://site.org/Free-FREE-free", "http://site.org/free-click"]
    rows = {r.page_id: r for r in urlfilter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")).collect()}
    for k, url in enumerate(urls):
        found = {t for t in terms if re.search(rf"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])", url.lower())}
        strict, weights = found & set(urlfilter.STRICT), [urlfilter.SOFT[t] for t in found & set(urlfilter.SOFT)]
        assert (rows[k].n_strict, rows[k].n_soft, rows[k].soft_weight) == (len(strict), len(weights), sum(weights)), url[:200]
        if rows[k].rule is None:
            assert rows[k].verdict == ("block" if strict or len(weights) > 1 and sum(weights) >= 3 else "allow")
    assert rows[402].n_soft == 1 and rows[403].verdict == "allow" and rows[400].verdict == "block"
    assert urlfilter.read_vocabulary(["# head", "Casino", "free\t1", "bet\t2 # often", ""]) == (("casino",), {"free": 1, "bet": 2})
    assert not set(urlfilter.STRICT) & set(urlfilter.SOFT)


def brute_secrets(text: str) -> list[tuple[int, int, str]]:
    fold = "".join
    any_case = lambda w: fold(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    words = "|".join([any_case("password"), any_case("passwd"), any_case("secret"), any_case("token"), any_case("api") + "_?" + any_case("key")])
    rules = [("assign", f"""({words})["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6), ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24)]
    found = [(m.start(), k, m.end(), kind) for k, (kind, rx, good) in enumerate(rules) for m in re.finditer(rx, text) if good(m)]
    return [(s, e, kind) for s, _, e, kind in sorted(found)]


def test_secrets_against_regex(spark, docs):
    draw = np.random.default_rng(5)
    parts = ["password", "PASSWD", "secret", "token", "api_key", "apikey", "=", ":", " ", '"', "'", "abc", "0123456789abcdef", "AKIA", "ABCDEFGH12", "é", "\n", "x", "deadbeef"]
    for _ in range(4000):
        text = "".join(draw.choice(parts, draw.integers(1, 14)))
        assert [s for s in secrets.find(text.encode()) if s[2] in secrets.BASE] == brute_secrets(text), text
    got = secrets.digests(docs).collect()
    assert sorted((r.n_assign for r in got)) == [0] * (len(got) - 1) + [1]
    assert secrets.digests(cases.empty(spark)).count() == 0
    clean = {(r.doc_id, r.text, r.n_chars) for r in secrets.redact(docs).collect()}
    assert (20, "<assign> x", 10) in clean and len(clean) == len({(r[0], r[1], r[4]) for r in cases.rows()})
    assert secrets.scan(docs).where(F.size("found") > 0).count() == 1


def test_automaton_matches_re():
    rules = [("a(b|cd)*e?", False), ("[x-z]{2,3}", True), ("k+m", False)]
    for rx, fold in rules:
        scanner = automaton.Scanner([(rx, fold)])
        for text in ("abcdbe xyz", "aXYZxyza", "kkkm km", "ae", "acdacd"):
            expected = [(m.start(), m.end()) for m in re.finditer(rx, text, re.I if fold else 0) if m.end() > m.start()]
            assert [(s, e) for _, s, e in scanner.scan(text.encode())] == expected


def brute_components(prints: np.ndarray, near) -> np.ndarray:
    label = np.arange(len(prints))
    for k in range(len(prints)):
        joined = np.unique(label[near(k)])
        label[np.isin(label, joined)] = joined[0]
    return label


def test_simhash_definition_and_components(spark, docs):
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(docs, tile_rows=4).collect()}
    rows = cases.rows()
    prints = np.array([simhash.fingerprint(text_of(r).encode()) for r in rows], np.uint64)
    label = brute_components(prints, lambda k: np.nonzero(np.bitwise_count(prints[k] ^ prints) <= 2)[0])
    for k, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[k] and rows[j][0] is not None]
        assert got[r[0], f"{int(prints[k]):016x}"] == min(ids)
    assert simhash.near_duplicates(cases.empty(spark)).count() == 0
    assert simhash.fingerprint(b"  ") == 0


def test_simhash_tiles_lose_no_link(spark):
    draw = np.random.default_rng(2)
    base = draw.integers(0, 1 << 62, 40, dtype=np.uint64)
    chained = [base]
    for _ in range(6):
        bit = np.uint64(1) << draw.integers(0, 64, 40).astype(np.uint64)
        chained.append(chained[-1] ^ bit)
    prints = np.unique(np.concatenate(chained))
    df = spark.createDataFrame([(k, int(p)) for k, p in enumerate(prints.view(np.int64))], "doc_id bigint, fp bigint")
    for tile_rows in (4, 4096):
        got = {r.fp: r.component_id for r in simhash.components(df, 2, tile_rows).collect()}
        label = brute_components(prints, lambda k: np.nonzero(np.bitwise_count(prints[k] ^ prints) <= 2)[0])
        assert [got[int(p)] for p in prints.view(np.int64)] == label.tolist()


def test_similar_texts_keep_one(spark, docs):
    kept = simhash_similar.keep_one(docs, tile_rows=4)
    assert kept.columns == docs.columns
    rows = cases.rows()
    sets = [set(zip(*(w[k:] for k in range(5)), strict=False)) if len(w := text_of(r).encode().lower().split()) > 5 else {tuple(w)} for r in rows]
    near = lambda k: np.array([j for j, s in enumerate(sets) if 5 * len(s & sets[k]) >= 4 * len(s | sets[k])])
    label = brute_components(np.zeros(len(sets)), near)
    least = {g: min((rows[j][0] is not None, rows[j][0] or 0) for j in np.flatnonzero(label == g)) for g in set(label)}
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in kept.collect()) == sorted(least.values())
    assert simhash_similar.keep_one(cases.empty(spark)).count() == 0


def test_token_files_round_trip(spark, docs, tmp_path):
    for bits in (1, 5, 16, 17, 31, 32):
        ids = np.random.default_rng(bits).integers(0, 1 << bits, 1000).astype(np.uint32)
        assert (tokenpack.unpack(tokenpack.pack(ids, bits), bits, 1000) == ids).all()
    writer = tokenpack.Writer(17, 64)
    parts = [np.arange(k, dtype=np.uint32) for k in (0, 5, 200, 1, 64)]
    for k, p in enumerate(parts):
        writer.add(k, p)
    writer.close(f"{tmp_path}/x.tok")
    reader = tokenpack.Reader(f"{tmp_path}/x.tok")
    assert all((reader.document(k) == p).all() for k, p in enumerate(parts))
    assert (reader.read(70, 100) == np.concatenate(parts)[70:170]).all()
    assert tokenpack.pack_and_read(cases.empty(spark), JSON, 2).count() == 0


def test_token_files_equal_library(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(JSON)
    more = spark.createDataFrame([(90, "a <|endoftext|> b"), (91, " lead  double\n nl ")], "doc_id bigint, text string")
    got = tokenpack.pack_and_read(docs.select("doc_id", "text").unionByName(more), JSON, 2, files=3).collect()
    rows = sorted([(r[0], r[1]) for r in cases.rows()] + [(90, "a <|endoftext|> b"), (91, " lead  double\n nl ")], key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, expected = 0, []
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        expected.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected


def test_pieces_equal_library_on_odd_blanks():
    own = tokenpack._Tokenizer(JSON, remembered=300)
    draw = random.Random(1)
    parts = ["a", "b", "Zé", "日本", " ", "  ", "\n", "\n\n", "\t", "\r", "'s", "'ll", "12", ".", "!?", "\u00a0", "\x1c", "<|endoftext|>", "x", "  \n", "\u2003", "hello", "world"]
    for _ in range(60):
        texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 12))) for _ in range(draw.randint(0, 60))]
        for text, ids in zip(texts, own.encode(pa.array(texts, pa.string())), strict=True):
            assert ids.tolist() == own.whole.encode(text, add_special_tokens=False).ids, text


def test_rows_of_one_id_keep_one_order_over_files(spark):
    texts = [cases.prose(k, 5) for k in range(400)]
    docs = spark.createDataFrame([(7, t) for t in texts], "doc_id bigint, text string")
    order = [r.text for r in docs.orderBy(F.xxhash64("text"), "text").collect()]
    own = tokenpack._Tokenizer(JSON)
    expected = [zlib.crc32(np.append(ids, 2).astype("<u4")) for ids in own.encode(pa.array(order))]
    got = sorted(tokenpack.pack_and_read(docs, JSON, 2, files=4).collect(), key=lambda r: r.start)
    assert [r.ids_crc32 for r in got] == expected


def test_minhash(spark, docs):
    got = minhash.edited(docs).collect()
    rows = sorted(cases.rows(), key=lambda r: (r[0] is not None, r[0] or 0, text_of(r)))
    shingles = lambda t: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set()
    expected, prints = {}, {}
    for k, r in enumerate(rows):
        text, nxt = text_of(r), text_of(rows[(k + 1) % len(rows)])
        cut = len(text) // 4
        changed = text[: len(text) - cut] + nxt[:cut]
        expected.setdefault((r[0], len(text), hashlib.sha256(changed.encode()).hexdigest()), []).append((text, changed, nxt))
    assert sorted(expected, key=repr) == sorted({(g.doc_id, g.n_chars, g.edited_sha256) for g in got}, key=repr)
    for g in got:
        text, changed, nxt = expected[g.doc_id, g.n_chars, g.edited_sha256][0]
        for value, other in ((g.near_edited, changed), (g.near_next, nxt)):
            a, b = shingles(text), shingles(other)
            true = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(value - true) < 0.25
        assert prints.setdefault(text, g.fingerprint) == g.fingerprint
    assert minhash.edited(cases.empty(spark)).count() == 0
    one = minhash.edited(spark.createDataFrame([(5, "a b c d e f g h")], "doc_id bigint, text string")).first()
    assert one.near_next == 1.0


def plain_minhash(text: str) -> str:
    """One-permutation MinHash step by step: least hash of each bin, empty bins filled by their own probing, low bits."""
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    long = lambda h, seed: xxhash.xxh64_intdigest(struct.pack("<q", signed(h)), seed)
    words = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.split("[ \t\n\x0b\x0c\r]+", text.lower()) if w]
    if not words:
        return ""
    shingles = [words[k : k + 5] for k in range(len(words) - 4)] if len(words) >= 5 else [words]
    bins: dict[int, int] = {}
    if len(words) < 5:
        raise ValueError("short texts hash an array, which is not rebuilt here")
    for shingle in shingles:
        h = 42
        for w in shingle:
            h = long(w, h)
        h = signed(h)
        bins[(h >> 57) + 64] = min(h, bins.get((h >> 57) + 64, h))
    out = []
    for k in range(128):
        start, step = (k * 2654435 + 40503) % 128, (k * 69069 + 1) % 64 * 2 + 1
        place = k if k in bins else next(b for t in range(128) if (b := (start + step * t) % 128) in bins)
        out.append(f"{bins[place] & 255:02x}")
    return "".join(out)


def test_minhash_against_a_plain_sketch(spark, docs):
    got = {r.doc_id: r.fingerprint for r in minhash.fingerprints(docs.where("doc_id is not null")).collect()}
    checked = 0
    for r in cases.rows():
        if r[0] is not None and r[0] != 40 and len(text_of(r).split()) >= 5:
            assert got[r[0]] == plain_minhash(text_of(r)), r[0]
            checked += 1
    assert checked > 12


def test_minhash_is_native(spark, docs):
    plan = minhash.edited(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_licences(spark, docs):
    text = "Some words here.\nLicensed under the Apache License, Version 2.0.\nOther.\nThis is it. Released under the MIT License. SPDX-License-Identifier: ISC\nAll rights reserved."
    assert licenses.scan(text)[2] == ["Apache-2.0", "MIT", "isc", "Proprietary"]
    assert licenses.scan("The license of life.")[1:] == ([], [], [])
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    assert licenses.scan(mit)[3] == ["MitGrant", "MitInclude"]
    assert licenses.find(docs).where("licences <> ''").count() == 0
    assert licenses.find(cases.empty(spark)).count() == 0


def test_licences_hard_wrapped():
    wrapped = {}
    for name, rule in licenses.LICENCES:
        if len(rule) > 1 or name in ("ISC", "MPL-2.0") or rule[0] in ("Gpl3Free", "Gpl2Free"):
            text = ". ".join(licenses.SENTENCES[part][0] for part in dict.fromkeys(rule) if part in licenses.SENTENCES) + "."
            wrapped.setdefault(name, text)
    assert len(wrapped) >= 9
    for name, text in wrapped.items():
        for leader in ("", " * ", "# ", "// ", "% "):
            for width in (50, 72, 80):
                lines = textwrap.fill(text, width, initial_indent=leader, subsequent_indent=leader)
                assert licenses.scan(lines)[2:] == ([name], []), (name, leader, width)
        assert licenses.scan(text)[2:] == ([name], []), name
    gpl = """    This program is free software; you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation; either version 2 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""
    assert licenses.scan(gpl)[2:] == (["GPL-2.0-or-later"], [])
    assert licenses.scan(gpl.replace("software;", "software:").replace("Foundation;", "Foundation,").replace("version 2", "version 3"))[2:] == (["GPL-3.0-or-later"], [])
    mpl = "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy of the MPL was not distributed with this\n// file, You can obtain one at https://mozilla.org/MPL/2.0/."
    assert licenses.scan(mpl)[2:] == (["MPL-2.0"], [])
    assert licenses.scan("Permission is hereby granted, free of charge, to any person obtaining a copy\n\nof this software")[1] == []


def test_licences_against_brute_force():
    """Known sentences laid among others, at any width and with any leader: found where they were laid, and by the first rule that fits."""
    draw = random.Random(12)
    forms = [(name, s) for name, sentences in licenses.SENTENCES.items() for s in sentences if len(s.split()) > 4]
    # the sentences of these rules are one known sentence together, which wins
    rules = [(licence, ids) for licence, ids in licenses.LICENCES if all(i in licenses.SENTENCES for i in ids) and ids[0] != "GplFree"]
    for _ in range(150):
        laid, names = [], []
        for _ in range(draw.randint(1, 4)):
            if draw.random() < 0.5:
                group = [(i, draw.choice(licenses.SENTENCES[i])) for i in draw.choice(rules)[1]]
            else:
                group = [draw.choice(forms)]
            laid += [s.rstrip(":") for _, s in group]
            names.append([i for i, _ in group])
            laid += [cases.prose(draw.randrange(10**6), 9) for _ in range(4)]  # parts what is before from what follows
        leader = draw.choice(("", "# ", " * ", "// "))
        text = "\n".join(textwrap.fill(s + ".", draw.choice((40, 66, 100)), initial_indent=leader, subsequent_indent=leader, break_long_words=False, break_on_hyphens=False) for s in laid)
        expected, left = [], []
        for group in names:
            while group:
                licence, size = next(((n, len(ids)) for n, ids in licenses.LICENCES if tuple(group[: len(ids)]) == ids), (None, 1))
                (expected if licence else left).append(licence or group[0])
                group = group[size:]
        got = licenses.scan(text)
        assert got[1] == [i for group in names for i in group], text
        assert [n for n in got[2] if n != "Proprietary"] == [n for n in dict.fromkeys(expected) if n != "Proprietary"] and got[3] == left


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no licence texts on this machine")
def test_published_licences():
    named = {"Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0", "GFDL-1.3": "GFDL-1.3"}
    for file, licence in named.items():
        with open(f"/usr/share/common-licenses/{file}") as text:
            found = licenses.scan(text.read())[2]
        assert found[0] == licence and "Proprietary" not in found, (file, found)


def lm_words(text):
    alone = regex.compile(r"[^\p{L}\p{N}\p{M}\s]|[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")
    return alone.sub(lambda m: f" {m[0]} ", text).split()


def test_words_are_counted_and_numbered(spark, docs):
    texts = [text_of(r) for r in cases.rows()] + ["Un été, deux_mots! 日本語。\u00a0x", "don't 3.14"]
    different, at, sizes = pseudolikelihood.words(pa.array(texts))
    plain = [lm_words(t) for t in texts]
    assert different.take(pa.array(at)).to_pylist() == [w for ws in plain for w in ws] and sizes.tolist() == [*map(len, plain)]
    assert len(set(pseudolikelihood.hashes(different).tolist())) == len(different)
    assert pseudolikelihood.hashes(different[3:9]).tolist() == pseudolikelihood.hashes(different).tolist()[3:9]
    counted = pseudolikelihood.count_words(docs)
    counts = Counter(w for r in cases.rows() for w in lm_words(text_of(r)))
    assert {r.word: r.n for r in counted.collect()} == counts
    known = pseudolikelihood.vocabulary(counted, 64, 16)
    best = sorted((w for w in counts if len(w.encode()) <= 64), key=lambda w: (-counts[w], w.encode()))[:48]
    place = {w: k for k, w in enumerate(best)}
    number = lambda w: place.get(w, 48 + int(pseudolikelihood.hashes(pa.array([w]))[0]) % 16)
    assert known.known.to_pylist() == best
    assert known.counts.tolist() == [sum(n for w, n in counts.items() if number(w) == k) for k in range(64)]
    assert known.encode(pa.array(texts))[0].tolist() == [number(w) for ws in plain for w in ws]


def test_pseudolikelihood_scores(spark, docs):
    known, network = pseudolikelihood.fit(docs, rounds=3, size=64, hashed=16)
    context = np.array([[3, 64 * 0 + 5, 7, network.border]] * 64)
    assert np.allclose(np.exp(network.log_probability(context, np.arange(64))).sum(), 1, atol=1e-5)
    got = pseudolikelihood.score(docs, known, network).collect()
    assert len(got) == len(cases.rows())
    for r in got:
        assert (r.pll_mean is None) == (r.n_tokens == 0) and r.pll <= 0
    rows, by_id = {r[0]: text_of(r) for r in cases.rows()}, {r.doc_id: r for r in got}
    for doc_id in (0, 7, 17, 18):  # one token at a time, by the definition of the network
        ids = known.encode(pa.array([rows[doc_id]]))[0].tolist()
        around = [network.border] * 2 + ids + [network.border] * 2
        embed, w1, w2, w3 = (w.astype(float) for w in network.weights)
        total = 0.0
        for k, token in enumerate(ids[:3000]):
            h = np.tanh(np.concatenate([embed[around[k + j]] for j in (0, 1, 3, 4)]) @ w1[:-1] + w1[-1])
            kind, place = divmod(token, w3.shape[2])
            outer, inner = h @ w2[:-1] + w2[-1], h @ w3[kind][:-1] + w3[kind][-1]
            total += outer[kind] - np.log(np.exp(outer).sum()) + inner[place] - np.log(np.exp(inner).sum())
        if len(ids) <= 3000:
            assert by_id[doc_id].n_tokens == len(ids) and abs(by_id[doc_id].pll - total) < 0.01
    assert pseudolikelihood.fit_and_score(cases.empty(spark)).count() == 0


def test_training_is_the_same_on_any_partitions_and_in_one_process(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    args = {"rounds": 3, "slice_tokens": 20_000, "size": 256, "hashed": 64}
    found = [pseudolikelihood.fit(docs.repartition(k), **args) for k in (1, 4, 32)]
    for _, network in found[1:]:
        assert all((a == b).all() for a, b in zip(network.weights, found[0][1].weights, strict=True))
    # the same schedule without Spark's grouping, partitions and sums
    known, network = found[0]
    slices = round(int(known.counts.sum()) / args["slice_tokens"])
    assert slices > 3
    parts = pseudolikelihood.chunks(docs, known).withColumn("s", F.pmod(F.xxhash64("key", F.lit("slice")), F.lit(slices))).withColumn("r", F.pmod(F.xxhash64("key", F.lit("round")), F.lit(3)))
    groups = {}
    for p in sorted(parts.collect(), key=lambda p: (p.key, bytes(p.ids))):
        groups.setdefault((p.r, p.s), []).append((np.frombuffer(p.ids, "<u2"), p.n))
    plain = pseudolikelihood.Network.begin(known.counts)
    for r in range(3):
        total, units = 0, 0
        for s in range(slices):
            if (r, s) in groups:
                context, token, n = pseudolikelihood._windows_of([i for i, _ in groups[r, s]], [n for _, n in groups[r, s]], plain.border)
                own = plain.filled(plain.flat())
                own.fit(context, token, n, 0.02 / (1 + r / 2))
                weight = -(-int(n.sum()) // 1024)
                total, units = total + np.rint(own.flat().astype(float) * 2**24).astype(int) * weight, units + weight
        plain = plain.filled(total / (units * 2**24))
    ids, sizes = known.encode(pa.array([r.text for r in docs.collect()]))
    both = [n.log_probability(*pseudolikelihood.windows(ids, sizes, n.border)) for n in (plain, network)]  # another process may sum floats in another order
    assert abs(both[0] - both[1]).mean() < 1e-3 and abs(both[0].mean() - both[1].mean()) < 1e-4


def test_network_learns_from_both_sides(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null")
    known, network = pseudolikelihood.fit(docs.where("doc_id % 5 <> 0"))
    held = [r.text for r in docs.where("doc_id % 5 = 0").select("text").collect()]
    ids, sizes = known.encode(pa.array(held))
    context, token = pseudolikelihood.windows(ids, sizes, network.border)
    alone = pseudolikelihood.Network.begin(known.counts).log_probability(context, token).mean()
    trained = network.log_probability(context, token).mean()
    blind = network.log_probability(np.full_like(context, network.border), token).mean()
    mixed = np.random.default_rng(1).permutation(token)
    assert trained > alone + 0.3 and trained > blind and trained > network.log_probability(context, mixed).mean() + 0.5, (alone, trained, blind)


def test_gradient_is_right():
    network = pseudolikelihood.Network.begin(np.array([5, 3, 2, 1, 1, 1]), classes=3, width=4, hidden=5)
    network = pseudolikelihood.Network([w.astype(np.float64) for w in network.weights])
    context, token = pseudolikelihood.windows(np.array([0, 3, 2, 5, 1, 0, 0, 4]), np.array([5, 3]), network.border)
    n = np.arange(1.0, 9.0)
    loss = lambda: -(network.log_probability(context, token) * n).sum() / n.sum()
    for w, g in zip(network.weights, network.gradient(context, token, n), strict=True):
        for at in (np.unravel_index(np.abs(g).argmax(), g.shape), np.unravel_index(np.abs(g).argmin(), g.shape)):
            before = w[at]
            w[at] = before + 1e-5
            up = loss()
            w[at] = before - 1e-5
            down = loss()
            w[at] = before
            assert abs((up - down) / 2e-5 - g[at]) < 1e-6
