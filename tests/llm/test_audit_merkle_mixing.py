import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from strataloom.llm import audit, merkle, mixing
from strataloom.llm.order import placed
from tests.llm import cases

LABEL = "doc_id bigint, quality int, toxic int"
LABELS = [(0, 1, 0), (1, 1, 1), (1, 0, None), (3, None, 1), (4, 1, 1), (12, 1, 0), (999, 1, 1), (None, 1, 1), (17, 0, 1)]


def rows() -> list[tuple]:
    loud = "BUY NOW " * 120
    more = [(50, loud, "en", "src0", 9), (51, "a " * 300, None, "src1", 9), (52, None, "fr", None, None), (53, "a|b", "", "", 3), (54, loud, None, "src0", 9), (50, "x y z", "de", "src9", 1)]
    return cases.rows() + more


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), cases.DOC).select("*", *(F.lit(1).alias(c) for c in (*cases.CLASH, "range", "salt", "value", "before", "total", "tree", "idx", "size", "target"))).repartition(5).cache()


def found_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def failing(row, smallest) -> str:
    text, w = row[1] or "", found_words(row[1])
    out = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 3 * len(text)) + "D" * bool(re.search("[#$%&*|]", text))
    return out + "E" * (row[0] is not None and text in smallest and row[0] > smallest[text])


def plain_audit(table, labels) -> set[tuple]:
    smallest = {}
    for r in table:
        if r[0] is not None:
            smallest[r[1] or ""] = min(r[0], smallest.get(r[1] or "", r[0]))
    good, toxic = ({x[0] for x in labels if x[k] == 1 and x[0] is not None} for k in (1, 2))
    parts = defaultdict(list)
    for r in table:
        parts[r[2] or ""].append((r[0], failing(r, smallest)))
    out = set()
    for part, members in parts.items():
        steps, shapley = [], Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = members
            for step, f in enumerate(order, 1):
                gone = [m for m in left if f in m[1]]
                left = [m for m in left if f not in m[1]]
                redundant = sum(f in m[1] for m in members) - len(gone)
                shapley[f] += len(gone)
                steps.append((f, part, order, step, len(left), len(gone), redundant, sum(m[1] == f for m in members), sum(m[0] in good for m in gone), sum(m[0] in toxic for m in gone)))
        out |= {(*s[1:], shapley[s[0]]) for s in steps}
    return out


def test_audit_against_sequential_filters(spark, docs):
    labels = spark.createDataFrame(LABELS, LABEL).withColumn("id", F.lit(3))
    got = [tuple(r) for r in audit.filter_audit(docs, labels).collect()]
    assert len(got) == len(set(got)) == 600 * len({r[2] or "" for r in rows()})
    assert set(got) == plain_audit(rows(), LABELS)
    assert any(g[5] for g in got) and any(g[6] for g in got) and any(g[7] for g in got) and any(g[8] for g in got)
    assert {tuple(r) for r in audit.filter_audit(docs, labels.limit(0)).collect()} == plain_audit(rows(), [])


def test_audit_of_an_empty_table_and_of_other_filters(spark, docs):
    labels = spark.createDataFrame(LABELS, LABEL)
    assert audit.filter_audit(cases.empty(spark), labels).count() == 0
    two = audit.audit(spark.createDataFrame([("p", 0, 5, 2, 0), ("p", 3, 4, 1, 1), ("p", 2, 1, 0, 0)], "part string, mask int, n bigint, good bigint, toxic bigint"), "XY")
    assert sorted(map(tuple, two.collect())) == [("p", "XY", 1, 6, 4, 0, 0, 1, 1, 4), ("p", "XY", 2, 5, 1, 4, 1, 0, 0, 6), ("p", "YX", 1, 5, 5, 0, 1, 1, 1, 6), ("p", "YX", 2, 5, 0, 4, 0, 0, 0, 4)]


def h(parts) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, lower=False) -> str:
    text = r[1] and (re.sub("[A-Z]+", lambda m: m[0].lower(), r[1]) if lower else r[1])
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text))


def tree(nodes: list[str]) -> tuple[str, list[list[tuple[int, list[str]]]]]:
    """The root of ``nodes`` and, for each, its place and siblings level by level."""
    ways, owner = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[k : k + 8] for k in range(0, len(nodes), 8)]
        for way, at in zip(ways, owner, strict=True):
            run, place = runs[at // 8], at % 8
            way.append((place, run[:place] + run[place + 1 :]))
        owner, nodes = [at // 8 for at in owner], [h(r) for r in runs]
    return nodes[0], ways


def plain_manifest(table) -> list[tuple]:
    groups = defaultdict(list)
    for r in table:
        groups[b"" if r[2] is None else b"=" + r[2].encode()].append(r)
    langs = sorted(groups)
    members = {g: sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in langs}
    lower = {g: tree([leaf(r) for r in members[g]]) for g in langs}
    root, upper = tree([lower[g][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for r, way in zip(members[g], lower[g][1], strict=True):
            way = way + upper[k]
            own = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0)
            for place, others in way:
                own = h([*others[:place], own, *others[place:]])
            out.append((r[0], leaf(r), lower[g][0], root, h(s for _, others in way for s in others), own, own == root))
    return sorted(out, key=repr)


def test_manifest_against_lists(spark, docs):
    got = sorted((tuple(r) for r in merkle.verified(docs).collect()), key=repr)
    assert got == plain_manifest(rows())
    assert {r[-1] for r in got} == {True, False}
    assert merkle.verified(cases.empty(spark)).count() == 0


@pytest.mark.parametrize("n", [1, 8, 9, 65, 520])
def test_manifest_of_any_width(spark, n):
    table = [(3 * k % n + n * (k % 2 == 5), f"T{k}" if k % 7 else "low", "x" if k % 5 else None, None, k) for k in range(n)]
    table += [(k, "A", f"l{k}", "s", 1) for k in range(n % 71)]
    got = sorted((tuple(r) for r in merkle.verified(spark.createDataFrame(table, cases.DOC).repartition(7)).collect()), key=repr)
    assert got == plain_manifest(table)


def plain_targets(sizes: dict, weights: dict) -> dict:
    total, fixed = sum(sizes.values()), {}
    while True:
        open_ones = [s for s in sizes if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: Fraction(left * weights[s], sum(weights[x] for x in open_ones)) for s in open_ones}
        above = [s for s in open_ones if share[s] > 3 * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: Fraction(3 * sizes[s]) for s in above}


def sources_of(table):
    names = sorted({r[3] for r in table if r[3] is not None}) + [None] * any(r[3] is None for r in table)
    sizes = {s: sum(len(found_words(r[1])) for r in table if r[3] == s) for s in names}
    return plain_targets(sizes, {s: 1 + k % 3 for k, s in enumerate(names)}), sizes


def check_mix(got, table):
    want, sizes = sources_of(table)
    by_id = {}
    for r in table:
        by_id.setdefault((r[0], len(found_words(r[1]))), set()).add(r[3])
    taken = Counter()
    for doc_id, size, source_size, target, words in got:
        source = next(s for s in by_id[doc_id, size] if sizes[s] == source_size and math.isclose(want[s], target, rel_tol=1e-12))
        rate = want[source] / sizes[source] if sizes[source] else 0
        assert size == 0 and words == 0 or words % size == 0 and words // size in (math.floor(rate), math.ceil(rate)) and words <= 3 * size
        taken[source] += words
    for s in want:
        assert abs(taken[s] - want[s]) <= max(len(found_words(r[1])) for r in table if r[3] == s)


def test_mix_against_fractions(spark, docs):
    df = mixing.mix(docs)
    got = sorted((tuple(r) for r in df.collect()), key=repr)
    assert len(got) == len(rows()) and df.columns == ["doc_id", "size", "source_size", "target", "taken"]
    check_mix(got, rows())
    for parts in (1, 7):  # reruns agree, however the rows are dealt
        assert got == sorted((tuple(r) for r in mixing.mix(docs.repartition(parts)).collect()), key=repr)
    assert mixing.mix(cases.empty(spark)).count() == 0


def test_mix_reaches_targets_below_and_above_the_ceiling(spark):
    table = [(k, "w " * (1 + k * k % 97), "en", ("big", "big", "big", "big", "mid", "tiny0", "tiny1", "tiny2")[k % 8] if k % 40 > 8 else "big", 1) for k in range(3000)]
    got = [tuple(r) for r in mixing.mix(spark.createDataFrame(table, cases.DOC)).collect()]
    check_mix(got, table)
    want, sizes = sources_of(table)
    assert any(want[s] == 3 * sizes[s] for s in want) and any(want[s] < sizes[s] for s in want)
    blank = [(k, " ", "en", f"s{k % 2}", 1) for k in range(4)]
    assert {tuple(r)[1:] for r in mixing.mix(spark.createDataFrame(blank, cases.DOC)).collect()} == {(0, 0, 0.0, 0)}


def test_mixed_rows_are_what_the_plan_says(spark, docs):
    plan = Counter()
    for r in mixing.shares(docs).collect():
        plan[r.doc_id, r.size] += r.copies
    got = mixing.mixed(docs)
    assert got.columns == docs.columns
    assert Counter((r.doc_id, len(found_words(r.text))) for r in got.collect()) == +plan


def test_places_and_sums_of_one_hot_group(spark):
    values = [("hot", k % 3, k) for k in range(4000)] + [(f"g{k}", k, 1) for k in range(50)]
    df = placed(spark.createDataFrame(values, "g string, o int, v bigint").repartition(6), "g", [F.col("o")], F.col("v"))
    got = defaultdict(list)
    for r in df.collect():
        got[r.g].append((r.o, r.before, r.v, r.total))
    for group, found in got.items():
        found.sort()
        own = [v for v in values if v[0] == group]
        assert sorted((o, v) for o, _, v, _ in found) == sorted(v[1:] for v in own)
        upto = 0
        for _, before, v, total in sorted(found, key=lambda x: (x[1], x[2])):
            assert before == upto and total == sum(x[2] for x in own)
            upto += v
