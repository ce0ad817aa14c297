"""Every registered query that has SQL gives the SQL's rows, over a small scale factor."""

import glob
import math
import os

import duckdb
import pytest

from headwater.plans import catalog, q_dimensions
from headwater.plans.common import rounded

QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.8g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    want = duck.execute(ORACLE[name])
    at = [[d[0] for d in want.description].index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_doubles_are_rounded_as_by_the_sql(spark, duck):
    values = [2.0309375, 8.0534375, -32.9871875, 4.0140625, 0.1, 1e-7, 123456789.1234565, 1e17 / 3, 1e305, float("inf"), float("nan"), None]
    got = [r.x for r in rounded(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, x double")).orderBy("i").collect()]
    want = [duck.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchone()[0] for v in values]
    assert [repr(x) for x in got] == [repr(x) for x in want]


def test_columns_of_literals_keep_their_value(spark):
    d = spark.createDataFrame([(0.0,), (2.0,), (None,)], "x double")
    assert [str(r.x) for r in q_dimensions.literal(d, ["x"]).collect()] == ["0.0", "2.0", "None"]
    with pytest.raises(Exception, match="isn't as in the SQL: 0.04"):
        q_dimensions.literal(spark.createDataFrame([(0.04,)], "x double"), ["x"]).collect()


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())


def test_two_events_of_an_instant_stay_apart(spark, tmp_path):
    c = duckdb.connect()
    c.execute(f"COPY (SELECT * FROM (VALUES (1::BIGINT, TIMESTAMP '2024-01-01 00:00:00.000001', 'view', 1.5::DOUBLE), (2, TIMESTAMP '2024-01-01 00:00:00.000001', 'view', 2.5), (1003, TIMESTAMP '2024-01-01 00:00:00.000001', 'view', 1.5)) AS t(event_id, ts, event_type, value)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    rows = QUERIES["a10_a12_features"](spark, str(tmp_path)).collect()
    assert sorted(r.value for r in rows) == [1.5, 1.5, 2.5] and {r.ts.microsecond for r in rows} == {1}
