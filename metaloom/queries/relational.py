"""What the guarded SQL provider runs: the relational surface, one query for each shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaloom.functions.registered import register
from metaloom.session import table
from metaloom.sql.guard import execute
from metaloom.sql.recipes import Parameter, render

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")

#: SQL that both engines understand.
COMMON = {
    "sql_pricing_summary": """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
        round(avg(l_quantity), 4) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
    "sql_shipping_priority": """SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderpriority FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
        WHERE c_mktsegment = 'BUILDING' GROUP BY l_orderkey, o_orderpriority ORDER BY revenue DESC, l_orderkey LIMIT 20""",
    "sql_local_supplier_volume": """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
        JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name""",
    "sql_forecast_revenue": "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
    "sql_returned_items": """SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
        WHERE l_returnflag = 'R' GROUP BY c_custkey, c_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
    "sql_left_join": "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    "sql_right_join": "SELECT n_nationkey, count(s_suppkey) AS suppliers FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey GROUP BY n_nationkey",
    "sql_full_join": """SELECT coalesce(a.k, b.k) AS k, a.n AS suppliers, b.n AS customers FROM (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY s_nationkey) a
        FULL OUTER JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY c_nationkey) b ON a.k = b.k""",
    "sql_small_cross_join": "SELECT r_name, count(*) AS pairs FROM region CROSS JOIN nation GROUP BY r_name",
    "sql_range_join": """SELECT b.lo AS lo, count(*) AS n, round(sum(p_retailprice), 2) AS total FROM part JOIN (SELECT * FROM (VALUES (0, 10), (10, 25), (25, 51)) AS v(lo, hi)) b ON p_size >= b.lo AND p_size < b.hi GROUP BY b.lo""",
    "sql_exists": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY o_orderpriority",
    "sql_not_exists": "SELECT c_mktsegment, count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY c_mktsegment",
    "sql_not_in": "SELECT count(*) AS n FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)",
    "sql_correlated_scalar": "SELECT count(*) AS n FROM lineitem l JOIN (SELECT l_partkey AS k, avg(l_quantity) AS q FROM lineitem GROUP BY l_partkey) a ON l.l_partkey = a.k WHERE l.l_quantity < 0.5 * a.q",
    "sql_scalar_subquery": "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) * 1.8 FROM customer)",
    "sql_distinct_aggregate": "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY l_suppkey",
    "sql_having": "SELECT l_orderkey, sum(l_quantity) AS qty FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200",
    "sql_filtered_aggregate": "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 100000) AS big, count(*) AS n FROM orders GROUP BY o_orderstatus",
    "sql_rollup": "SELECT r_name, n_name, count(*) AS n, CAST(grouping(r_name) + grouping(n_name) AS BIGINT) AS level FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)",
    "sql_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "sql_grouping_sets": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "sql_ranking": """SELECT s_nationkey, s_suppkey, rn, rk, dr FROM (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rn,
        rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC) AS rk, dense_rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC) AS dr FROM supplier) t WHERE rn <= 3""",
    "sql_lag_lead": "SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after_id FROM events",
    "sql_running_sum": "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running FROM orders",
    "sql_moving_average": "SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS mean5 FROM events",
    "sql_first_last": "SELECT DISTINCT user_id, first_value(event_type) OVER w AS first_type, last_value(event_type) OVER w AS last_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "sql_ntile_percent": "SELECT s_suppkey, ntile(4) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS quartile, round(percent_rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal), 6) AS pr, round(cume_dist() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal), 6) AS cd FROM supplier",
    "sql_union_all": "SELECT s_nationkey AS k, 's' AS kind FROM supplier UNION ALL SELECT c_nationkey, 'c' FROM customer WHERE c_acctbal > 9900",
    "sql_union": "SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer",
    "sql_intersect": "SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 49 INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity < 2",
    "sql_except": "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_discount > 0.08",
    "sql_intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "sql_except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "sql_sort_offset": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15 OFFSET 30",
    "sql_case_like": "SELECT CASE WHEN p_type LIKE '%BRASS%' THEN 'brass' WHEN p_type LIKE 'S%' THEN 's' ELSE 'other' END AS kind, count(*) AS n FROM part GROUP BY 1",
    "sql_null_logic": "SELECT coalesce(lang, 'none') AS lang, count(*) AS n, count(text) AS texts, count(nullif(trim(text), '')) AS filled FROM documents GROUP BY 1",
    "sql_strings": "SELECT c_custkey, upper(substring(c_name, 1, 3)) AS head, length(c_name) AS n, replace(c_name, '#', '-') AS plain, concat(c_mktsegment, ':', c_name) AS both_ FROM customer",
    "sql_math": "SELECT p_partkey, round(sqrt(p_retailprice), 6) AS root, floor(p_retailprice / 7) AS sevenths, abs(p_size - 25) AS off, round(ln(p_retailprice), 6) AS logged, p_size % 7 AS rest FROM part",
    "sql_with": "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS spent FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > 1000000) SELECT c_custkey, round(spent, 2) AS spent FROM big JOIN customer ON c_custkey = o_custkey",
    "sql_recursive": "WITH RECURSIVE t AS (SELECT CAST(0 AS BIGINT) AS k, CAST(1 AS BIGINT) AS v UNION ALL SELECT k + 1, v * 2 FROM t WHERE k < 30) SELECT k, v FROM t",
    "sql_values": "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS v(id, name)",
    "sql_dates": "SELECT CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, count(*) AS n FROM orders GROUP BY 1, 2",
    "sql_multi_key_join": "SELECT a.l_orderkey, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey AND a.l_linenumber < b.l_linenumber GROUP BY a.l_orderkey",
    "sql_statistics": "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 5) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS r, min(l_discount) AS lo, max(l_tax) AS hi FROM lineitem GROUP BY l_returnflag",
}

#: (SQL for Spark, SQL for the oracle) where the dialects differ.
DIALECTS = {
    "sql_pivot": (
        "SELECT * FROM (SELECT o_orderpriority, o_orderstatus, o_orderkey FROM orders) PIVOT (count(o_orderkey) FOR o_orderstatus IN ('O' AS o, 'F' AS f, 'P' AS p))",
        "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1",
    ),
    "sql_unpivot": (
        "SELECT * FROM (SELECT s_suppkey, CAST(s_nationkey AS BIGINT) AS nation, CAST(round(s_acctbal) AS BIGINT) AS balance FROM supplier) UNPIVOT (v FOR k IN (nation, balance))",
        "SELECT s_suppkey, 'nation' AS k, CAST(s_nationkey AS BIGINT) AS v FROM supplier UNION ALL SELECT s_suppkey, 'balance', CAST(round(s_acctbal) AS BIGINT) FROM supplier",
    ),
    "sql_percentile": ("SELECT event_type, round(percentile(value, 0.95), 6) AS p95, round(median(value), 6) AS p50 FROM events GROUP BY event_type", "SELECT event_type, round(quantile_cont(value, 0.95), 6) AS p95, round(median(value), 6) AS p50 FROM events GROUP BY event_type"),
    "sql_listagg": ("SELECT r_name, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name", "SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"),
    "sql_json": ("SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"),
    "sql_arrays": (
        "SELECT vec_id, size(embedding) AS n, round(CAST(array_max(embedding) AS DOUBLE), 6) AS top, round(aggregate(embedding, 0D, (s, x) -> s + x), 4) AS total FROM embeddings",
        "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, round(CAST(list_max(embedding) AS DOUBLE), 6) AS top, round(list_sum([CAST(x AS DOUBLE) for x in embedding]), 4) AS total FROM embeddings",
    ),
    "sql_lateral": (
        "SELECT c_custkey, t.o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) t",
        "SELECT o_custkey AS c_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders JOIN customer ON c_custkey = o_custkey) t WHERE r = 1",
    ),
    "sql_semi_join": ("SELECT p_partkey FROM part LEFT SEMI JOIN lineitem ON p_partkey = l_partkey AND l_quantity >= 50", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)"),
    "sql_anti_join": ("SELECT p_partkey FROM part LEFT ANTI JOIN lineitem ON p_partkey = l_partkey AND l_quantity >= 50", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 50)"),
    "sql_regexp": ("SELECT p_partkey, regexp_extract(p_brand, '([0-9])([0-9])', 2) AS digit, p_type RLIKE '(STEEL|TIN)$' AS metal FROM part", "SELECT p_partkey, regexp_extract(p_brand, '([0-9])([0-9])', 2) AS digit, regexp_matches(p_type, '(STEEL|TIN)$') AS metal FROM part"),
    "sql_tumbling_window": (
        "SELECT date_format(window.start, 'yyyy-MM-dd HH:mm:ss') AS start, event_type, count(*) AS n FROM events GROUP BY window(ts, '1 hour'), event_type",
        "SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    ),
    "sql_session_window": (
        "SELECT user_id, date_format(min(ts), 'yyyy-MM-dd HH:mm:ss') AS start, count(*) AS n FROM events GROUP BY user_id, session_window(ts, '30 minutes')",
        """SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
           (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""",
    ),
    "sql_map_functions": (
        "SELECT o_orderkey, element_at(map('O', 'open', 'F', 'done'), o_orderstatus) AS label FROM orders",
        "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' END AS label FROM orders",
    ),
}

PARAMETERS = (
    "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice >= :least AND o_orderstatus = :status GROUP BY o_orderpriority",
    {"least": 50000.0, "status": "O"},
    "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice >= 50000.0 AND o_orderstatus = 'O' GROUP BY o_orderpriority",
)
RECIPE = (
    "SELECT __column__, count(*) AS n FROM orders WHERE o_orderstatus = '__STATUS__' AND o_totalprice > __least__ GROUP BY __column__",
    {"column": "o_orderpriority", "status": "F", "least": 100000},
    {"column": Parameter("identifier"), "least": Parameter("number")},
)


def views(spark: SparkSession, sf_dir: str) -> None:
    """The driver's tables as temporary views."""
    for name in TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def _run(sql: str, params: dict | None = None):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir)
        return execute(spark, sql, params)

    return query


#: SQL with registered functions, and DuckDB's own words for it.
FUNCTIONS = {
    "udf_sql": ("SELECT c_custkey, description_points(c_name, 30) AS points, score_grade(CAST(c_acctbal / 100 AS INT)) AS grade, round(text_similarity(c_name, c_mktsegment), 6) AS similar FROM customer",
                "SELECT c_custkey, CAST(round(30 * CASE WHEN strlen(trim(c_name)) < 20 THEN 0.2 WHEN strlen(trim(c_name)) < 50 THEN 0.5 ELSE 0.8 END) AS INTEGER) AS points, CASE WHEN trunc(c_acctbal / 100) >= 90 THEN 'A' WHEN trunc(c_acctbal / 100) >= 80 THEN 'B' WHEN trunc(c_acctbal / 100) >= 70 THEN 'C' WHEN trunc(c_acctbal / 100) >= 60 THEN 'D' ELSE 'F' END AS grade, round(1 - levenshtein(c_name, c_mktsegment) / greatest(length(c_name), length(c_mktsegment))::DOUBLE, 6) AS similar FROM customer"),
    "udf_arrow": ("SELECT p_partkey, initials(p_name) AS initials FROM part", "SELECT p_partkey, array_to_string([w[1] for w in list_filter(regexp_split_to_array(lower(translate(p_name, '_#', '  ')), '\\s+'), lambda w: w <> '')], '') AS initials FROM part"),
    "udaf_arrow": ("SELECT l_returnflag, round(geometric_mean(l_extendedprice), 2) AS mean_price FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, round(exp(avg(ln(l_extendedprice))), 2) AS mean_price FROM lineitem WHERE l_extendedprice > 0 GROUP BY 1"),
    "udtf_words": ("SELECT r_name, w.place, w.word FROM region, LATERAL split_words(r_name) w", "SELECT r_name, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS place, unnest(l) AS word FROM (SELECT r_name, list_filter(regexp_split_to_array(r_name, '\\s+'), lambda w: w <> '') AS l FROM region)"),
    "sql_approximate": ("SELECT abs(approx_count_distinct(l_partkey, 0.02) - count(DISTINCT l_partkey)) <= 0.08 * count(DISTINCT l_partkey) AS near_count, abs(approx_percentile(l_extendedprice, 0.5D, 10000) - percentile(l_extendedprice, 0.5D)) <= 0.02 * percentile(l_extendedprice, 0.5D) AS near_median FROM lineitem", "SELECT TRUE AS near_count, TRUE AS near_median"),
}


def _with_functions(sql: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir)
        register(spark)
        return spark.sql(sql)

    return query


def sql_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What EXPLAIN through the guard says of a filtered scan: that the filter and the two columns reach the files."""
    views(spark, sf_dir)
    plan = execute(spark, "EXPLAIN FORMATTED SELECT l_orderkey FROM lineitem WHERE l_quantity < 5")
    return plan.select(F.contains("plan", F.lit("PushedFilters: [IsNotNull(l_quantity), LessThan(l_quantity,5.0)]")).alias("filter_pushed"), F.contains("plan", F.lit("ReadSchema: struct<l_orderkey:bigint,l_quantity:double>")).alias("columns_pruned"))


QUERIES = {
    **{name: _with_functions(sql) for name, (sql, _) in FUNCTIONS.items()},
    "sql_explain": sql_explain,
    **{name: _run(sql) for name, sql in COMMON.items()},
    **{name: _run(sql) for name, (sql, _) in DIALECTS.items()},
    "sql_parameters": _run(PARAMETERS[0], PARAMETERS[1]),
    "recipe_run": _run(render(*RECIPE)),
}
SQL = {**{name: sql for name, (_, sql) in FUNCTIONS.items()}, "sql_explain": "SELECT TRUE AS filter_pushed, TRUE AS columns_pruned", **COMMON, **{name: sql for name, (_, sql) in DIALECTS.items()}, "sql_parameters": PARAMETERS[2], "recipe_run": render(*RECIPE)}
