"""Every registered query with SQL gives what DuckDB gives, over the smallest tables."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in os.listdir(SF):
        path = f"{SF}/{name}"
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(value):
    if value is None or isinstance(value, bool | int | str):
        return value
    if isinstance(value, list | tuple):
        return tuple(map(plain, value))
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5) + 0.0
    return round(float(value), 5) if type(value).__name__ == "Decimal" else str(value)


def close(x, y) -> bool:
    return x == y or isinstance(x, int | float) and isinstance(y, int | float) and abs(x - y) <= 1e-5 * max(1, abs(x))


def names():
    import __spark_entry__

    return sorted(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", names())
def test_query(spark, con, name):
    import __spark_entry__

    df = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = con.execute(__spark_entry__.oracle_sql()[name])
    found = [d[0] for d in cursor.description]
    assert sorted(found) == columns
    want = sorted((tuple(plain(r[found.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert len(got) == len(want)
    assert all(close(x, y) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True))


def test_other_queries_run(spark):
    import __spark_entry__
    from strataloom import catalog

    found = {name: catalog.REGISTRY[name][0](spark, SF).count() for name in sorted(set(catalog.load()) - set(__spark_entry__.oracle_sql()))}
    assert {name for name, n in found.items() if not n} <= {"graph_whiskers", "bag_of_whiskers"}  # the few projects of the smallest tables are one core


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 4
