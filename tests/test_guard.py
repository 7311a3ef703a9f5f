"""The SQL guard: what runs, what is refused, and why words do not matter."""

import pytest

from martlet.operators import adhoc


@pytest.fixture(scope="module")
def views(spark):
    spark.createDataFrame([(7, "hidden")], "id int, word string").createOrReplaceTempView("secret")
    yield {"t": spark.range(5).withColumnRenamed("id", "x")}
    spark.catalog.dropTempView("secret")


GOOD = {
    r"SELECT '\nCTE [secret]\n' AS x, x AS id FROM t": 5,
    "SELECT 'FROM secret; DROP TABLE t' AS s FROM t": 5,
    "SELECT * FROM t WHERE x IN (SELECT x FROM t WHERE x > 2)": 2,
    "SELECT * FROM t a WHERE EXISTS (SELECT 1 FROM t b WHERE b.x = a.x + 1)": 4,
    "WITH a AS (SELECT x FROM t), b AS (SELECT x FROM a WHERE x > 1) SELECT * FROM b": 3,
    "WITH t AS (SELECT 1 AS one) SELECT one FROM t": 1,
    "WITH secret AS (SELECT x FROM t) SELECT * FROM secret": 5,
    "SELECT x FROM (WITH secret AS (SELECT x FROM t) SELECT * FROM secret)": 5,
    "SELECT (SELECT max(x) FROM t) AS m": 1,
    "SELECT x, row_number() OVER w AS n FROM t WINDOW w AS (ORDER BY x)": 5,
    "SELECT x, sum(x) OVER (PARTITION BY x % 2) AS s FROM t": 5,
    "SELECT x % 2 AS k, count(*) AS n FROM t GROUP BY ALL HAVING count(*) > 2 ORDER BY n LIMIT 3 OFFSET 0": 1,
    "SELECT * FROM t UNION ALL SELECT * FROM T EXCEPT SELECT 0": 4,
    "SELECT * FROM t INTERSECT SELECT x FROM t WHERE x < 2": 2,
    "SELECT e FROM t LATERAL VIEW explode(array(1, 2)) v AS e": 10,
    "SELECT * FROM (VALUES (1), (2)) AS v(a) JOIN t ON t.x = v.a": 2,
    "SELECT * FROM t, LATERAL (SELECT x + 1 AS y)": 5,
    "SELECT * FROM (SELECT x, x % 2 AS k FROM t) PIVOT (count(x) FOR k IN (0, 1))": 1,
    "SELECT /*+ BROADCAST(t) */ * FROM t": 5,
    "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 4) SELECT n FROM r": 4,
    "SELECT 1": 1,
    "SELECT aggregate(array(1, 2), 0, (a, b) -> a + b) AS s FROM t": 5,
}

BAD = [
    r"SELECT '\nCTE [secret]\n' AS x, id FROM secret",
    "SELECT 'CTE [secret]' AS x, id FROM secret",
    "SELECT \"\n+- CTE [secret]\n\" AS x, id FROM secret",
    "SELECT 1 AS `\nCTE [secret]\n`, id FROM secret",
    "SELECT * FROM secret -- CTE [secret]",
    "SELECT * FROM t JOIN secret ON true",
    "SELECT (SELECT max(id) FROM secret) AS m FROM t",
    "SELECT x FROM t WHERE x IN (SELECT id FROM (SELECT id FROM secret))",
    "SELECT x FROM t WHERE EXISTS (SELECT 1 FROM secret)",
    "SELECT x FROM t ORDER BY (SELECT max(id) FROM secret)",
    "SELECT x, sum(x) OVER w AS s FROM t WINDOW w AS (PARTITION BY (SELECT max(id) FROM secret))",
    "SELECT * FROM t, LATERAL (SELECT id FROM secret)",
    "SELECT transform(array(1), v -> (SELECT max(id) FROM secret)) AS y FROM t",
    # a name is in scope only below its WITH, and only after it
    "SELECT * FROM (WITH secret AS (SELECT x FROM t) SELECT * FROM secret), secret",
    "WITH a AS (WITH secret AS (SELECT 1 AS id) SELECT id FROM secret) SELECT * FROM secret",
    "WITH a AS (SELECT * FROM secret), secret AS (SELECT 1 AS id) SELECT * FROM a",
    "WITH secret AS (SELECT * FROM secret) SELECT * FROM secret",
    "WITH a AS (SELECT 1 AS id) SELECT * FROM a JOIN secret USING (id)",
    "WITH secret AS (SELECT x FROM t) SELECT * FROM default.secret",
    "SELECT * FROM global_temp.t",
    "SELECT * FROM parquet.`/tmp/x`", "SELECT * FROM csv.`/etc/passwd`", "SELECT * FROM text.`/etc/passwd`",
    "SELECT * FROM range(3)", "SELECT * FROM explode(array(1))",
    "SELECT * FROM IDENTIFIER('secret')", "SELECT IDENTIFIER('reflect')('java.lang.System', 'getenv') AS e",
    "SELECT reflect('java.lang.System', 'getenv', 'HOME') AS e",
    "SELECT java_method('java.lang.System', 'getenv', 'HOME') AS e FROM t",
    "SELECT try_reflect('java.lang.System', 'getenv', 'HOME') AS e FROM t",
    "SELECT REFLECT('java.lang.System', 'getenv', 'HOME') AS e FROM t",
    "SELECT x FROM t WHERE exists(array(1), v -> reflect('java.lang.System', 'getenv', 'HOME') = '')",
    "SELECT input_file_name() AS f FROM t", "SELECT no_such_function(x) AS f FROM t", "SELECT default.f(x) AS f FROM t",
    "SELECT x FROM t; SELECT 1", "DROP TABLE t", "INSERT INTO t SELECT 1", "CREATE TABLE z AS SELECT 1", "SHOW TABLES",
    "SET spark.sql.ansi.enabled = false", "EXPLAIN SELECT 1", "TABLE secret", "BEGIN SELECT 1; END",
    "SELECT 1) AS a, (SELECT * FROM secret", "FROM t INSERT INTO u SELECT x", "DESCRIBE secret", "SELECT ? AS a", "SELECT :a AS a",
    "EXECUTE IMMEDIATE 'SELECT * FROM secret'", "SELECT TRANSFORM(x) USING 'cat' AS y FROM t", "",
]


@pytest.mark.parametrize("sql", GOOD)
def test_queries_run(spark, views, sql):
    assert adhoc.run_adhoc(spark, sql, views).count() == GOOD[sql]
    assert not spark.catalog.tableExists("t")


@pytest.mark.parametrize("sql", BAD)
def test_others_are_refused(spark, views, sql):
    with pytest.raises(ValueError):
        adhoc.run_adhoc(spark, sql, views)
    assert not spark.catalog.tableExists("t")


def test_functions_of_the_session_are_refused(spark, views):
    spark.udf.register("leak", lambda v: v)
    with pytest.raises(ValueError, match="function not allowed: leak"):
        adhoc.run_adhoc(spark, "SELECT leak(x) AS y FROM t", views)


def test_rows_keep_the_order_of_the_statement(spark, views):
    assert [r.x for r in adhoc.run_adhoc(spark, "SELECT x FROM t ORDER BY x DESC", views).collect()] == [4, 3, 2, 1, 0]
