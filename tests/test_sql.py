"""SQL that reads is run, all else is refused before it does anything."""

import pytest

from tessera import sql


@pytest.fixture(scope="module")
def tables(spark):
    return {"resources": spark.createDataFrame([(1, "a", 3.0), (2, "b", None), (3, "a", 5.0)], "id int, course string, n double"), "notes": spark.createDataFrame([(1, "x")], "id int, note string")}


@pytest.mark.parametrize(("statement", "expected"), [
    ("SELECT course, sum(n) AS n FROM resources GROUP BY course ORDER BY course", [("a", 8.0), ("b", None)]),
    ("WITH some AS (SELECT * FROM resources WHERE n > :least) SELECT id FROM some WHERE course = :course", [(3,)]),
    ("SELECT id FROM resources WHERE id IN (SELECT id FROM notes) AND EXISTS (SELECT 1 FROM notes)", [(1,)]),
    ("SELECT r.id, n.note FROM Resources r LEFT JOIN notes n USING (id) ORDER BY 1 LIMIT 1", [(1, "x")]),
    ("SELECT id, row_number() OVER (ORDER BY n DESC NULLS LAST) AS k FROM resources ORDER BY k LIMIT 1", [(3, 1)]),
    ("SELECT count(*) FROM range(4)", [(4,)]),
    ("SELECT 1 UNION ALL SELECT 2", [(1,), (2,)]),
])
def test_reads(spark, tables, statement, expected):
    assert [tuple(x) for x in sql.run(spark, statement, tables, least=4.0, course="a").collect()] == expected
    assert not spark.catalog.tableExists("resources")


@pytest.mark.parametrize("statement", [
    "INSERT INTO resources VALUES (4, 'c', 1.0)", "CREATE TABLE t AS SELECT * FROM resources", "DROP VIEW resources", "CREATE TEMP VIEW v AS SELECT 1", "WITH x AS (SELECT 1 AS id) INSERT INTO notes SELECT id, 'y' FROM x", "SET spark.sql.ansi.enabled = false",
    "INSERT OVERWRITE DIRECTORY '/tmp/out' USING parquet SELECT * FROM resources", "SELECT * FROM parquet.`/etc`", "SELECT * FROM other", "SELECT id FROM resources WHERE id IN (SELECT id FROM other)", "SELECT java_method('java.lang.System', 'getenv', 'HOME')",
    "SELECT id FROM resources WHERE reflect('java.lang.System', 'getProperty', 'user.home') = 'x'", "CACHE TABLE resources", "EXPLAIN SELECT 1", "FROM resources INSERT INTO notes SELECT id, course", "SHOW TABLES", "DESCRIBE resources", "MERGE INTO notes USING resources ON notes.id = resources.id WHEN MATCHED THEN DELETE",
    "DELETE FROM resources", "UPDATE resources SET n = 1",
])
def test_writes_and_strangers_are_refused(spark, tables, statement):
    with pytest.raises(sql.RefusedError):
        sql.run(spark, statement, tables)
    assert not spark.catalog.tableExists("resources") and not spark.catalog.tableExists("v")


def test_parameters_are_values(spark, tables):
    assert sql.run(spark, "SELECT id FROM resources WHERE course = :course", tables, course="a' OR '1' = '1").collect() == []
    tables["notes"].createOrReplaceTempView("notes")
    with pytest.raises(sql.RefusedError, match="in use"):
        sql.run(spark, "SELECT 1", tables)
    spark.catalog.dropTempView("notes")
