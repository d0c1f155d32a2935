"""Every registered query with SQL against DuckDB on the smallest tables, and the stream against the batch."""

import duckdb
import pytest

from tessera import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def value(x):
    return round(x, 6) + 0.0 if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, oracle, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(value(x) for x in r) for r in df.select(*columns).collect()), key=repr)
    if sql := plans.ORACLE_SQL.get(name):
        result = oracle.execute(sql)
        names = [d[0] for d in result.description]
        assert columns == sorted(names)
        order = sorted(range(len(names)), key=names.__getitem__)
        assert rows == sorted((tuple(value(r[k]) for k in order) for r in result.fetchall()), key=repr)


def test_late_batches_equal_one(spark, tmp_path):
    from tessera.streaming.learner import merged, streamed_mastery

    events = spark.read.parquet(f"{SF}/events.parquet")
    events.orderBy("ts", "event_id").coalesce(1).write.option("maxRecordsPerFile", 300).parquet(f"{tmp_path}/events.parquet")
    whole = {tuple(r) for r in streamed_mastery(spark, f"{SF}/events.parquet").collect()}
    parts = {tuple(r) for r in streamed_mastery(spark, f"file://{tmp_path}/events.parquet", 1).collect()}
    assert {r[:2] + r[3:] for r in parts} == {r[:2] + r[3:] for r in whole}
    assert merged(events.limit(5), events, "event_id").count() == events.count()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1 and set(e.oracle_sql()) <= set(e.queries())
