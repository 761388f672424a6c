"""Every query with SQL gives DuckDB's rows at the smallest size; a stream gives a table's."""

from pathlib import Path

import pytest

from sparkvane.plans.queries import ORACLE_SQL, QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v + 0.0 if isinstance(v, float) else v


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, con, name):
    got = QUERIES[name](spark, str(DATA))
    want = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    order = sorted(names)
    a = sorted(repr(tuple(plain(r[c]) for c in order)) for r in got.collect())
    b = sorted(repr(tuple(plain(r[names.index(c)]) for c in order)) for r in want.fetchall())
    assert a == b


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(ORACLE_SQL) <= set(__spark_entry__.queries())


def test_stream_equals_table(spark):
    from sparkvane.streaming import triage

    stream = triage.run_to_memory(triage.alert_rates(triage.decided(triage.read_events(spark, str(DATA)))), "triage")
    want = triage.alert_rates(triage.decided(spark.read.parquet(str(DATA / "events.parquet"))))
    assert sorted(stream.collect()) == sorted(want.collect())
