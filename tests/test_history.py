"""Paths of a commit history against walks over plain dictionaries."""

import random
from collections import Counter, defaultdict

import pytest

from strataloom.operators import history as hi


def plain_path(node, up):
    while node is not None:
        yield node
        node = up.get(node)


@pytest.fixture(scope="module")
def forest(spark):
    """Branching trees, a long chain, a hub of 80 children, second parents, repeats, unknown parents and nulls."""
    draw = random.Random(5)
    links = [(k, draw.randrange(0, k)) for k in range(1, 120)]
    links += [(k, k - 1) for k in range(201, 290)] + [(k, 300) for k in range(301, 381)]
    up = dict(links)
    commits = [*range(120), *range(200, 290), *range(300, 381), 500, 501]
    extra = [(k, up[k] + 1) for k in (50, 60, 250) if up[k] + 1 != k]  # a second, later parent
    rows = links + extra + links[:9] + [(501, 9999), (None, 3), (7, None), (9998, 5)]
    changes = [(n, f"f{draw.randrange(25)}", draw.randrange(20), draw.randrange(5)) for n in commits for _ in range(draw.randrange(5))]
    changes += changes[:10] + [(9997, "f1", 5, 5)]
    node = spark.createDataFrame([(c,) for c in commits + commits[:5] + [None]], "node bigint")
    toured = hi.tour(node, spark.createDataFrame(rows, "node bigint, parent bigint"))
    return commits, up, toured, changes, spark.createDataFrame(changes, "node bigint, term string, added bigint, removed bigint")


def test_tour_numbers_descendants_in_a_row(forest):
    commits, up, toured, _, _ = forest
    rows = {r.node: r for r in toured.collect()}
    assert sorted(rows) == sorted(set(commits))
    paths = {n: list(plain_path(n, up)) for n in commits}
    sizes = Counter(a for p in paths.values() for a in p)
    for n, r in rows.items():
        assert (r.root, r.depth, r.parent) == (paths[n][-1], len(paths[n]) - 1, up.get(n))
        assert r.leave - r.enter + 1 == sizes[n]
        assert all(rows[a].enter <= r.enter <= r.leave <= rows[a].leave for a in paths[n])
    assert len({(r.root, r.enter) for r in rows.values()}) == len(rows)


def test_growth_along_paths(forest):
    commits, up, toured, changes, table = forest
    each = defaultdict(Counter)
    for n, term, added, removed in changes:
        each[n].update({term: 0, ("+", term): added, ("-", term): removed})
    terms = {n: {t for t in c if isinstance(t, str)} for n, c in each.items()}
    grown = {r.node: tuple(r)[3:] for r in hi.path_growth(toured, table).collect()}
    history = {(r.node, r.term): (r.nth, r.size) for r in hi.term_history(toured, table).collect()}
    assert sorted(grown) == sorted(set(commits))
    for n in commits:
        path = list(plain_path(n, up))
        added = sum(v for a in path for k, v in each[a].items() if k[0] == "+")
        removed = sum(v for a in path for k, v in each[a].items() if k[0] == "-")
        assert grown[n] == (sum(len(terms.get(a, ())) for a in path), len(set().union(*(terms.get(a, set()) for a in path))), added, added - removed)
        for t in terms.get(n, ()):
            assert history[n, t] == (sum(t in terms.get(a, ()) for a in path), sum(each[a]["+", t] - each[a]["-", t] for a in path))
    assert len(history) == sum(len(terms.get(n, ())) for n in commits)


def test_empty_histories_and_cycles(spark):
    none, links = spark.createDataFrame([], "node bigint"), spark.createDataFrame([], "node bigint, parent bigint")
    toured = hi.tour(none, links)
    assert toured.count() == 0
    changes = spark.createDataFrame([], "node bigint, term string, added bigint, removed bigint")
    assert hi.path_growth(toured, changes).count() == 0 and hi.term_history(toured, changes).count() == 0
    with pytest.raises(RuntimeError):
        hi.tour(spark.createDataFrame([(1,), (2,)], "node bigint"), spark.createDataFrame([(1, 2), (2, 1)], "node bigint, parent bigint"))
