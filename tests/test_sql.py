"""The guard, parameters, recipes and structure comparison."""

from __future__ import annotations

import pytest

from metaloom.sql.guard import GuardError, check, clamp, execute, fetch, preflight, within_bytes
from metaloom.sql.recipes import Parameter, query_number, recipes, render, run_recipe
from metaloom.sql.scan import mask_literals, statements
from metaloom.sql.structure import alias_pairs, diff, signature

GOOD = [
    "SELECT 1", "  -- note\n select a, replace(b, 'x', 'y') from t;", "WITH x AS (SELECT 1) SELECT * FROM x UNION ALL SELECT 2", "VALUES (1)", "EXPLAIN SELECT 1", "(SELECT 1)", "SELECT 'drop table t; delete from t' AS s",
    'SELECT "update" FROM t', "SELECT t.set, date_add(d, 1) FROM t", "TABLE t", "SELECT a AS load FROM t",
]
BAD = [
    "", ";", "SELECT 1; SELECT 2", "DROP TABLE t", "INSERT INTO t VALUES (1)", "WITH x AS (DELETE FROM t RETURNING *) SELECT * FROM x", "EXPLAIN DELETE FROM t", "EXPLAIN ANALYZE SELECT 1", "SELECT * INTO y FROM t", "SELECT * FROM parquet.`/etc/x`",
    "SELECT * FROM `s3://b/x`", "SELECT reflect('a', 'b')", "SELECT * FROM read_csv('x')", "SELECT (1", "SET a = 1", "CREATE TABLE t AS SELECT 1", "CALL f()", "SELECT 1 UNION (INSERT INTO t SELECT 1)",
]


@pytest.mark.parametrize("sql", GOOD)
def test_reads_pass(sql):
    assert check(sql)


@pytest.mark.parametrize("sql", BAD)
def test_all_else_is_refused(sql):
    with pytest.raises(GuardError):
        check(sql)


def test_parameters_pages_and_limits(spark):
    assert execute(spark, "SELECT :a + 1 AS x, :s AS s", {"a": 2, "s": "it's"}).first().asDict() == {"x": 3, "s": "it's"}
    with pytest.raises(GuardError):
        execute(spark, "SELECT :a", {"a": [1]})
    p = fetch(spark.range(10), row_limit=3)
    assert p.rows == [[0], [1], [2]] and p.truncated and p.columns == ["id"]
    assert not fetch(spark.range(3), row_limit=3).truncated and fetch(spark.range(9), byte_limit=25).truncated
    assert within_bytes(spark.range(10), ["id"], 25).count() == 3
    assert (clamp(None, 5, 9), clamp(0, 5, 9), clamp(99, 5, 9)) == (5, 1, 9)
    spark.range(1).createOrReplaceTempView("there_is")
    assert dict(preflight(spark, "there_is"))["relation"] == "ok" and dict(preflight(spark, "there_is_not"))["relation"] == "missing"


def test_placeholders():
    ps = {"col": Parameter("identifier"), "n": Parameter("number", default=3), "b": Parameter("boolean"), "r": Parameter("raw")}
    assert render("SELECT __COL__ FROM t WHERE a = '__name__' AND b = __name__ AND n > __n__ AND __b__", {"col": "a.b", "name": "O'x", "b": "TRUE"}, ps) == "SELECT a.b FROM t WHERE a = 'O''x' AND b = 'O''x' AND n > 3 AND true"
    for bad in ({"col": "a; drop"}, {"col": "a", "n": "1 or 1"}, {"col": "a", "b": "x"}, {"col": "a", "r": "x'y"}, {}):
        with pytest.raises(GuardError):
            render("SELECT __col__, __n__, __b__, __r__", {"b": "true", "r": "x", **bad}, ps)
    with pytest.raises(GuardError):
        render("SELECT {{ x }}", {})


def test_recipes_run_in_order(spark):
    files = spark.createDataFrame([("analyses/recipes/churn/query__10.sql", "SELECT 10 AS x", None), ("recipes/churn/query_2.sql", "bad", "SELECT 2 AS x"), ("recipes/churn/zzz.sql", "SELECT __n__ AS x", None), ("other/q_1.sql", "SELECT 1", None)], "path string, raw_sql string, compiled_sql string")
    rows = [(r.query_name, r.sql) for r in recipes(files).where("recipe = 'churn'").collect()]
    got = run_recipe(spark, rows, {"n": 7}, {"n": Parameter("number")})
    assert [(n, d.first().x) for n, d, _ in got] == [("query_2", 2), ("query__10", 10), ("zzz", 7)]
    failed = run_recipe(spark, [("a_1", "SELECT nope"), ("a_2", "SELECT 1")], {})
    assert len(failed) == 1 and failed[0][1] is None and failed[0][2]
    assert len(run_recipe(spark, [("a_1", "SELECT nope"), ("a_2", "SELECT 1")], {}, stop=False)) == 2
    assert query_number("q__12") == 12 and query_number("q") == 2**31 - 1


def test_structure():
    a = "SELECT x AS k, count(*) FROM t LEFT JOIN u ON t.i = u.i WHERE x > 1 AND y = 'a, b' GROUP BY x"
    b = "select x as k from t join v on t.i = v.i where x > 1"
    s = signature(a)
    assert s["tables"] == ["t", "u"] and s["joins"] == ["left"] and s["group_by"] == ["x"] and "x > 1" in s["filters"] and len(s["filters"]) == 2
    d = diff(a, b)
    assert d["tables"] == {"only_first": ["u"], "only_second": ["v"], "both": ["t"]} and d["filters"]["both"] == ["x > 1"]
    assert alias_pairs("select t.a as b, c as D, f(e) as g from t as z") == [("a", "b"), ("c", "d")]
    assert mask_literals("select 'a''b', 12 -- c\n from t") == "select ? , ? from t" and statements("a;;'b;c';") == ["a", "'b;c'"]


def test_search_recipes(spark):
    from metaloom.sql.recipes import recipes, search_recipes

    files = [("a/recipes/refund_rate/share__1.sql", "select 1", None), ("a/recipes/refund_rate/trend__2.sql", "select stock", None), ("a/recipes/stock/level.sql", "select stock_level from t", None), ("a/other.sql", "refund", None), (None, "x", None)]
    found = recipes(spark.createDataFrame(files, "path string, raw_sql string, compiled_sql string"))
    assert [(r.recipe, r.queries) for r in search_recipes(found, "Refund rate by week").orderBy("rank").collect()] == [("refund_rate", 2)]
    assert [r.recipe for r in search_recipes(found, "stock").orderBy("rank").collect()] == ["stock", "refund_rate"]
    assert search_recipes(found, "?").count() == 0 and search_recipes(found.limit(0), "stock").count() == 0


def test_queries_are_listed_without_a_session():
    """The entry point must be readable before any session exists."""
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 150 and not set(s) - set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
