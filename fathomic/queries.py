"""Queries over the driver's tables, each with SQL that says the same.

``sql_query`` texts run through this library's SQL front door; where the oracle's dialect
differs, its text is given beside it.
"""

from __future__ import annotations

import datetime
import json
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fathomic.durable import shared_folder
from fathomic.frame import Frame
from fathomic.functions import scalar as fx
from fathomic.operators import dedup, picking, quality, reshape, rolling, sketches, vectors
from fathomic.operators.order import INDEX, numbered, with_row_index
from fathomic.plans import rewrites
from fathomic.session import Session
from fathomic.sources import lakes, partitioning, sinks, sqlite_table
from fathomic.streaming import changes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_query(name: str, text: str, oracle: str | None = None) -> None:
    used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        session = Session(spark)
        return session.sql(text, {t: f"{sf_dir}/{t}.parquet" for t in used}).df

    QUERIES[name] = run
    ORACLES[name] = oracle or text


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return keep


# The flagship: a filtered, grouped report.


@query(
    "pricing_summary",
    """SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS sum_qty,
       round(sum(l_extendedprice), 2) AS sum_base, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
       FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY 1, 2""",
)
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .filter(F.col("l_shipdate") <= F.expr("TIMESTAMP_NTZ '1998-09-02 00:00:00'"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(F.sum(F.col("l_quantity").cast("long")).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))
    )


# Shapes of the analytics benchmark, over the driver's tables.

sql_query("shape_01_count", "SELECT count(*) AS c FROM events")
sql_query("shape_02_count_where", "SELECT count(*) AS c FROM events WHERE event_type <> 'click'")
sql_query("shape_03_sum_count_avg", "SELECT CAST(sum(l_linenumber) AS BIGINT) AS s, count(*) AS c, round(avg(l_quantity), 6) AS a FROM lineitem")
sql_query("shape_04_avg", "SELECT round(avg(user_id), 6) AS a FROM events")
sql_query("shape_05_count_distinct_int", "SELECT count(DISTINCT user_id) AS u FROM events")
sql_query("shape_06_count_distinct_text", "SELECT count(DISTINCT event_type) AS u FROM events")
sql_query("shape_07_min_max", "SELECT CAST(CAST(min(o_orderdate) AS DATE) AS STRING) AS lo, CAST(CAST(max(o_orderdate) AS DATE) AS STRING) AS hi FROM orders")
sql_query("shape_08_group_count", "SELECT event_type, count(*) AS c FROM events WHERE value <> 0 GROUP BY event_type ORDER BY c DESC")
sql_query("shape_09_group_distinct_top", "SELECT l_suppkey, count(DISTINCT l_partkey) AS u FROM lineitem GROUP BY l_suppkey ORDER BY u DESC, l_suppkey LIMIT 10")
sql_query("shape_10_group_many", "SELECT c_nationkey, CAST(sum(c_custkey) AS BIGINT) AS s, count(*) AS c, round(avg(c_acctbal), 4) AS a, count(DISTINCT c_mktsegment) AS d FROM customer GROUP BY c_nationkey ORDER BY c DESC, c_nationkey LIMIT 10")
sql_query("shape_11_text_group_distinct", "SELECT p_brand, count(DISTINCT p_size) AS u FROM part WHERE p_brand <> '' GROUP BY p_brand ORDER BY u DESC, p_brand LIMIT 10")
sql_query("shape_12_two_keys_distinct", "SELECT p_size, p_brand, count(DISTINCT p_type) AS u FROM part WHERE p_brand <> '' GROUP BY p_size, p_brand ORDER BY u DESC, p_size, p_brand LIMIT 10")
sql_query("shape_13_text_top", "SELECT p_type, count(*) AS c FROM part WHERE p_type <> '' GROUP BY p_type ORDER BY c DESC, p_type LIMIT 10")
sql_query("shape_14_text_distinct_top", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS u FROM orders WHERE o_orderpriority <> '' GROUP BY o_orderpriority ORDER BY u DESC, o_orderpriority LIMIT 10")
sql_query("shape_15_mixed_keys_top", "SELECT o_orderstatus, o_orderpriority, count(*) AS c FROM orders WHERE o_orderpriority <> '' GROUP BY o_orderstatus, o_orderpriority ORDER BY c DESC, o_orderstatus, o_orderpriority LIMIT 10")
sql_query("shape_16_key_top", "SELECT user_id, count(*) AS c FROM events GROUP BY user_id ORDER BY c DESC, user_id LIMIT 10")
sql_query("shape_17_key_text_top", "SELECT user_id, event_type, count(*) AS c FROM events GROUP BY user_id, event_type ORDER BY c DESC, user_id, event_type LIMIT 10")
sql_query("shape_18_key_text_limit", "SELECT user_id, event_type, count(*) AS c FROM events GROUP BY user_id, event_type ORDER BY user_id, event_type LIMIT 10")
sql_query("shape_19_extract_minute", "SELECT user_id, CAST(extract(minute FROM ts) AS BIGINT) AS m, event_type, count(*) AS c FROM events GROUP BY user_id, m, event_type ORDER BY c DESC, user_id, m, event_type LIMIT 10")
sql_query("shape_20_point", "SELECT user_id FROM events WHERE user_id = 7")
sql_query("shape_21_like_count", "SELECT count(*) AS c FROM pages WHERE url LIKE '%example.org%'")
sql_query("shape_22_like_group_min", "SELECT lang, min(source) AS s, count(*) AS c FROM documents WHERE text LIKE '%License%' AND lang <> '' GROUP BY lang ORDER BY c DESC, lang LIMIT 10")
sql_query("shape_23_like_not_like", "SELECT source, min(doc_id) AS lo, min(lang) AS l, count(*) AS c, count(DISTINCT lang) AS d FROM documents WHERE text LIKE '%the%' AND text NOT LIKE '%ver%' AND source <> '' GROUP BY source ORDER BY c DESC, source LIMIT 10")
sql_query("shape_24_star_sort_limit", "SELECT page_id, url FROM pages WHERE url LIKE '%blog%' ORDER BY page_id LIMIT 10")
sql_query("shape_25_sort_other", "SELECT event_type FROM events WHERE event_type <> '' ORDER BY ts, event_id LIMIT 10")
sql_query("shape_26_sort_self", "SELECT p_name FROM part WHERE p_name <> '' ORDER BY p_name LIMIT 10")
sql_query("shape_27_sort_two", "SELECT event_type, event_id FROM events WHERE event_type <> '' ORDER BY ts, event_type, event_id LIMIT 10")
sql_query("shape_28_avg_length_having", "SELECT source, round(avg(length(text)), 4) AS l, count(*) AS c FROM documents WHERE text <> '' GROUP BY source HAVING count(*) > 5 ORDER BY l DESC, source LIMIT 25")
sql_query("shape_29_regex_domain", r"SELECT regexp_replace(url, '^https?://(?:www\.)?([^/]+)/.*$', '\1') AS k, round(avg(length(url)), 4) AS l, count(*) AS c, min(url) AS lo FROM pages WHERE url <> '' GROUP BY k HAVING count(*) > 2 ORDER BY l DESC, k LIMIT 25")
_OFFSETS = ", ".join(f"CAST(sum(l_linenumber + {k}) AS BIGINT) AS s{k}" for k in range(90))
sql_query("shape_30_many_sums", f"SELECT {_OFFSETS} FROM lineitem")
sql_query("shape_31_two_keys_agg", "SELECT l_returnflag, l_suppkey, count(*) AS c, CAST(sum(l_linenumber) AS BIGINT) AS s, round(avg(l_quantity), 4) AS a FROM lineitem WHERE l_returnflag <> '' GROUP BY l_returnflag, l_suppkey ORDER BY c DESC, l_returnflag, l_suppkey LIMIT 10")
sql_query("shape_32_wide_keys_filtered", "SELECT l_orderkey, l_partkey, count(*) AS c, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem WHERE l_returnflag <> '' GROUP BY l_orderkey, l_partkey ORDER BY c DESC, l_orderkey, l_partkey LIMIT 10")
sql_query("shape_33_wide_keys", "SELECT l_orderkey, l_suppkey, count(*) AS c, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY l_orderkey, l_suppkey ORDER BY c DESC, l_orderkey, l_suppkey LIMIT 10")
sql_query("shape_34_text_key", "SELECT url, count(*) AS c FROM pages GROUP BY url ORDER BY c DESC, url LIMIT 10")
sql_query("shape_35_constant_key", "SELECT 1 AS one, url, count(*) AS c FROM pages GROUP BY 1, url ORDER BY c DESC, url LIMIT 10")
sql_query("shape_36_dependent_keys", "SELECT user_id, user_id - 1 AS u1, user_id - 2 AS u2, user_id - 3 AS u3, count(*) AS c FROM events GROUP BY user_id, user_id - 1, user_id - 2, user_id - 3 ORDER BY c DESC, user_id LIMIT 10")
_WHERE = "o_custkey > 10 AND o_orderdate >= DATE '1995-01-01' AND o_orderdate <= DATE '1996-12-31'"
sql_query("shape_37_date_filter_views", f"SELECT o_orderpriority, count(*) AS c FROM orders WHERE {_WHERE} AND o_orderstatus <> 'P' GROUP BY o_orderpriority ORDER BY c DESC, o_orderpriority LIMIT 10")
sql_query("shape_38_date_filter_title", f"SELECT o_orderstatus, count(*) AS c FROM orders WHERE {_WHERE} AND o_orderpriority <> '' GROUP BY o_orderstatus ORDER BY c DESC, o_orderstatus LIMIT 10")
sql_query("shape_39_offset", f"SELECT o_custkey, count(*) AS c FROM orders WHERE {_WHERE} GROUP BY o_custkey ORDER BY c DESC, o_custkey LIMIT 10 OFFSET 20")
sql_query("shape_40_case_key", f"SELECT o_orderstatus, CASE WHEN (o_orderstatus = 'O' AND o_custkey < 500) THEN o_orderpriority ELSE '' END AS src, o_orderpriority AS dst, count(*) AS c FROM orders WHERE {_WHERE} GROUP BY o_orderstatus, src, dst ORDER BY c DESC, o_orderstatus, src, dst LIMIT 10 OFFSET 2")
sql_query("shape_41_in_date_key", f"SELECT o_orderpriority, CAST(CAST(o_orderdate AS DATE) AS STRING) AS d, count(*) AS c FROM orders WHERE {_WHERE} AND o_orderstatus IN ('O', 'F') GROUP BY o_orderpriority, o_orderdate ORDER BY c DESC, o_orderpriority, d LIMIT 10 OFFSET 10")
sql_query("shape_42_two_ints_offset", "SELECT p_size, CAST(length(p_type) AS BIGINT) AS w, count(*) AS c FROM part WHERE p_size > 1 GROUP BY p_size, w ORDER BY c DESC, p_size, w LIMIT 10 OFFSET 10")
sql_query("shape_43_date_trunc", "SELECT CAST(date_trunc('minute', ts) AS STRING) AS m, count(*) AS c FROM events WHERE event_type <> 'click' GROUP BY date_trunc('minute', ts) ORDER BY m LIMIT 10 OFFSET 5")

# Predicates and projections.

sql_query("filter_compare_between_in", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey BETWEEN 100 AND 300 AND o_orderstatus IN ('O', 'P') AND NOT (o_orderkey = 3)")
sql_query("row_value_in", "SELECT n_nationkey, n_name FROM nation WHERE (n_regionkey, n_nationkey) IN ((0, 0), (1, 1), (2, 8), (3, 6))")
sql_query("like_escape", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%!_%' ESCAPE '!' OR p_type LIKE '_t%'")
sql_query("is_distinct_from", "SELECT a.n_nationkey AS k, a.n_name IS NOT DISTINCT FROM b.n_name AS same FROM nation AS a LEFT JOIN nation AS b ON a.n_nationkey = b.n_nationkey + 1")
sql_query("boolean_tests", "SELECT o_orderkey, (o_custkey > 500) IS TRUE AS t, (o_custkey > 500) IS NOT FALSE AS nf, o_orderstatus IS NULL AS missing FROM orders")
sql_query("regexp_like", "SELECT doc_id, regexp_like(text, '[0-9]{4}') AS digits FROM documents", "SELECT doc_id, regexp_matches(text, '[0-9]{4}') AS digits FROM documents")
sql_query("case_nested", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 1000 THEN 'low' ELSE 'high' END AS band, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS seg FROM customer")
sql_query("sort_nulls", "SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer ORDER BY k ASC NULLS FIRST, c_custkey DESC LIMIT 50")
sql_query("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7 OFFSET 11")
sql_query("int_division", "SELECT o_orderkey, o_custkey / 7 AS q, (o_custkey + 3) / (2 + 1) AS r FROM orders", "SELECT o_orderkey, o_custkey // 7 AS q, (o_custkey + 3) // (2 + 1) AS r FROM orders")
sql_query("text_functions", "SELECT p_partkey, lower(p_name) AS lo, upper(p_name) AS hi, trim(concat('  ', p_brand, ' ')) AS t, substr(p_name, 2, 3) AS mid, left(p_name, 4) AS l, right(p_name, 3) AS r, replace(p_name, 'a', 'o') AS rep, CAST(length(p_name) AS BIGINT) AS n FROM part")
sql_query("text_tests", "SELECT p_partkey, starts_with(p_name, 'a') AS s, contains(p_name, 'e') AS c, ends_with(p_name, 'n') AS e FROM part")
sql_query("byte_and_char_length", "SELECT doc_id, CAST(byte_length(text) AS BIGINT) AS b, CAST(length(text) AS BIGINT) AS n FROM documents", "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS b, CAST(length(text) AS BIGINT) AS n FROM documents")
sql_query("numeric_functions", "SELECT c_custkey, abs(c_acctbal) AS a, CAST(floor(c_acctbal) AS DOUBLE) AS f, CAST(ceil(c_acctbal) AS DOUBLE) AS c, CAST(round(c_acctbal) AS DOUBLE) AS r, -c_custkey AS neg FROM customer")
sql_query(
    "date_functions",
    "SELECT o_orderkey, CAST(date_add_days(CAST(o_orderdate AS DATE), 3) AS STRING) AS plus3, CAST(date_sub_days(CAST(o_orderdate AS DATE), INTERVAL '1' DAY) AS STRING) AS minus1, CAST(date_year(o_orderdate) AS BIGINT) AS y, CAST(date_month(o_orderdate) AS BIGINT) AS m, CAST(date_day(o_orderdate) AS BIGINT) AS d, date_diff_days(CAST(o_orderdate AS DATE), DATE '1995-01-01') AS since FROM orders",
    "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + 3 AS STRING) AS plus3, CAST(CAST(o_orderdate AS DATE) - 1 AS STRING) AS minus1, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS since FROM orders",
)
sql_query(
    "timestamp_functions",
    "SELECT event_id, CAST(timestamp_hour(ts) AS BIGINT) AS h, CAST(timestamp_minute(ts) AS BIGINT) AS mi, timestamp_diff_seconds(CAST(ts AS TIMESTAMP), TIMESTAMP '2024-01-01 00:00:00') AS s FROM events",
    "SELECT event_id, hour(ts) AS h, minute(ts) AS mi, CAST(trunc((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1000000.0) AS BIGINT) AS s FROM events",
)
sql_query("try_cast", "SELECT doc_id, try_cast(substr(source, 4, 2) AS int64) AS k, try_cast(lang AS int64) AS none FROM documents", "SELECT doc_id, try_cast(substr(source, 4, 2) AS BIGINT) AS k, try_cast(lang AS BIGINT) AS none FROM documents")
sql_query("decimal_arithmetic", "SELECT o_orderkey, CAST(CAST(o_totalprice AS decimal128(12,2)) * 2 AS DOUBLE) AS twice FROM orders", "SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(12,2)) * 2 AS DOUBLE) AS twice FROM orders")
sql_query("binary_literals", "SELECT n_nationkey, CAST(byte_length(X'00ff10') AS BIGINT) AS n, CAST(BINARY 'ok' AS STRING) AS word FROM nation", "SELECT n_nationkey, CAST(3 AS BIGINT) AS n, 'ok' AS word FROM nation")
sql_query("list_literal", "SELECT DISTINCT l_returnflag, ARRAY[1, 2, 3] AS l FROM lineitem ORDER BY l_returnflag", "SELECT DISTINCT l_returnflag, [1, 2, 3] AS l FROM lineitem")

# Joins.

sql_query("join_inner_two_keys", "SELECT a.l_orderkey, a.l_linenumber, b.l_quantity AS q FROM lineitem AS a INNER JOIN lineitem AS b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber")
sql_query("join_left_outer", "SELECT c.c_custkey, o.o_orderkey FROM customer AS c LEFT JOIN orders AS o ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'P'")
sql_query("join_right_outer", "SELECT o.o_orderkey, c.c_custkey FROM orders AS o RIGHT JOIN customer AS c ON c.c_custkey = o.o_custkey")
sql_query("join_full_outer", "SELECT s.s_suppkey, n.n_nationkey FROM supplier AS s FULL OUTER JOIN nation AS n ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 5000")
sql_query("join_cross", "SELECT r.r_name, n.n_name FROM region AS r CROSS JOIN nation AS n")
sql_query("join_expression", "SELECT r.r_regionkey, n.n_nationkey FROM region AS r INNER JOIN nation AS n ON r.r_regionkey + n.n_regionkey >= 5")
sql_query("join_or", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation AS a INNER JOIN nation AS b ON a.n_regionkey = b.n_nationkey OR a.n_nationkey = b.n_nationkey")
sql_query("join_aggregate_top", "SELECT n.n_name, count(*) AS c, CAST(sum(o.o_custkey) AS BIGINT) AS s FROM orders AS o INNER JOIN customer AS c ON o.o_custkey = c.c_custkey INNER JOIN nation AS n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name ORDER BY c DESC, n.n_name LIMIT 5")
sql_query("join_distinct", "SELECT DISTINCT c.c_mktsegment, o.o_orderstatus FROM customer AS c INNER JOIN orders AS o ON c.c_custkey = o.o_custkey")


@query("join_semi", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Session(spark)
    c, o = s.frame(table(spark, sf_dir, "customer")), s.frame(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")))
    return c.join(o, "c_custkey", "semi").select("c_custkey", "c_name").df


@query("join_anti", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Session(spark)
    c, o = s.frame(table(spark, sf_dir, "customer")), s.frame(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")))
    return c.join(o, "c_custkey", "anti").select("c_custkey", "c_name").df


# Subqueries.

sql_query("sub_in", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)")
sql_query("sub_in_limited", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5)")
sql_query("sub_not_in", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
sql_query("sub_not_in_null", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT nullif(o_custkey, 5) FROM orders)")
sql_query("sub_row_in", "SELECT n_nationkey FROM nation WHERE (n_regionkey, n_nationkey) IN (SELECT r_regionkey, r_regionkey * 2 FROM region)")
sql_query("sub_exists", "SELECT n_name FROM nation WHERE EXISTS (SELECT * FROM region WHERE r_name = 'ASIA' LIMIT 1)")
sql_query("sub_correlated_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT o_orderkey FROM orders WHERE o_custkey = outer.c_custkey AND o_orderstatus = 'P')", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT o_orderkey FROM orders WHERE o_custkey = customer.c_custkey AND o_orderstatus = 'P')")
sql_query("sub_correlated_not_exists", "SELECT s_suppkey FROM supplier WHERE NOT EXISTS (SELECT c_custkey FROM customer WHERE c_nationkey = outer.s_nationkey AND c_acctbal >= outer.s_acctbal)", "SELECT s_suppkey FROM supplier WHERE NOT EXISTS (SELECT c_custkey FROM customer WHERE c_nationkey = supplier.s_nationkey AND c_acctbal >= supplier.s_acctbal)")
sql_query("sub_correlated_in", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey = outer.o_orderkey AND l_quantity > 45)", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey = orders.o_orderkey AND l_quantity > 45)")
sql_query("sub_join_inside", "SELECT n_name FROM nation WHERE n_nationkey IN (SELECT c.c_nationkey FROM customer AS c INNER JOIN orders AS o ON c.c_custkey = o.o_custkey WHERE o.o_orderstatus = 'P' AND c.c_acctbal > 8000)")
sql_query("sub_group_having_inside", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) >= 15)")
sql_query("sub_nested_in", "SELECT r_name FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000))")
sql_query("sub_all", "SELECT s_suppkey FROM supplier WHERE s_acctbal > ALL (SELECT c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal < 5000)")
sql_query("sub_any", "SELECT n_nationkey FROM nation WHERE n_nationkey = ANY (SELECT r_regionkey FROM region)")
sql_query("sub_all_correlated", "SELECT s_suppkey FROM supplier WHERE s_acctbal >= ALL (SELECT c_acctbal FROM customer WHERE c_nationkey = outer.s_nationkey)", "SELECT s_suppkey FROM supplier WHERE s_acctbal >= ALL (SELECT c_acctbal FROM customer WHERE c_nationkey = supplier.s_nationkey)")
sql_query("sub_in_having", "SELECT o_orderstatus, count(*) AS c FROM orders GROUP BY o_orderstatus HAVING count(*) > ALL (SELECT n_nationkey FROM nation) AND o_orderstatus IN (SELECT l_linestatus FROM lineitem)")
sql_query("sub_in_projection", "SELECT n_nationkey, n_nationkey IN (SELECT r_regionkey FROM region) AS hit, CASE WHEN n_nationkey IN (SELECT s_nationkey FROM supplier) THEN 'supplier' ELSE 'none' END AS kind FROM nation")

# Aggregates and sets.

sql_query("having_alias", "SELECT o_custkey, count(*) AS c FROM orders GROUP BY o_custkey HAVING c >= 18")
sql_query("having_hidden", "SELECT o_custkey, count(*) AS c FROM orders GROUP BY o_custkey HAVING max(o_orderkey) > 14000 AND min(o_orderkey) < 200")
sql_query("distinct_over_groups", "SELECT DISTINCT count(*) AS c FROM orders GROUP BY o_custkey")
sql_query("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier")
sql_query("union_all", "SELECT n_name AS x FROM nation UNION ALL SELECT r_name AS x FROM region")
sql_query("intersect", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey AS k FROM supplier")
sql_query("except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey AS k FROM orders ORDER BY k")
sql_query("intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey AS k FROM supplier")
sql_query("except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey AS k FROM supplier")
sql_query("values", "VALUES (1, 'a'), (2, 'b'), (3, NULL)", "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) t(col1, col2)")
sql_query("generate_series", "SELECT value, value * 2 AS twice FROM generate_series(1, 10, 3) WHERE value > 1", "SELECT generate_series AS value, generate_series * 2 AS twice FROM generate_series(1, 10, 3) WHERE generate_series > 1")
sql_query("range_function", "SELECT value FROM range(2, 6) ORDER BY value DESC LIMIT 3", "SELECT range AS value FROM range(2, 6) ORDER BY value DESC LIMIT 3")

# Windows.

_OVER = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"
sql_query("window_ranks", f"SELECT event_id, CAST(row_number() {_OVER} AS BIGINT) AS rn, CAST(rank() OVER (PARTITION BY user_id ORDER BY event_type) AS BIGINT) AS rk, CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY event_type DESC) AS BIGINT) AS dr FROM events")
sql_query("window_lag_lead", f"SELECT event_id, lag(event_id, 1) {_OVER} AS before, lead(event_id, 2) {_OVER} AS after FROM events")
sql_query("window_ntile", f"SELECT event_id, CAST(ntile(4) {_OVER} AS BIGINT) AS nt, round(percent_rank() {_OVER}, 9) AS pr, round(cume_dist() {_OVER}, 9) AS cd FROM events")
sql_query("window_distinct", "SELECT DISTINCT o_orderstatus, CAST(dense_rank() OVER (ORDER BY o_orderstatus) AS BIGINT) AS r FROM orders")


@query("top_per_group", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn <= 3")
def top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return picking.top_per_group(table(spark, sf_dir, "events"), ["user_id"], 3, [F.col("value").desc(), F.col("event_id")]).select("user_id", "event_id")


@query("rolling_by_key", "SELECT event_id, CASE WHEN count(user_id) OVER w >= 2 THEN CAST(sum(event_id) OVER w AS BIGINT) END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def rolling_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    return rolling.rolling(df, "event_id", "sum", 3, 2, by=["user_id"], order=["ts", "event_id"], name="s").select("event_id", "s")


@query("rolling_centered", "SELECT o_orderkey, CASE WHEN count(o_custkey) OVER w >= 3 THEN max(o_custkey) OVER w END AS m FROM orders WINDOW w AS (ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def rolling_centered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.rolling(table(spark, sf_dir, "orders"), "o_custkey", "max", 5, 3, center=True, order=["o_orderkey"], name="m").select("o_orderkey", "m")


@query("ffill_limit", "SELECT event_id, last_value(k IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS k FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN user_id END AS k FROM events)")
def ffill_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, F.col("user_id")).alias("k"))
    return rolling.ffill(df, "k", 2, order=["event_id"])


@query("ffill_all", "SELECT event_id, last_value(k IGNORE NULLS) OVER (ORDER BY event_id) AS k FROM (SELECT event_id, CASE WHEN event_id % 1000 = 7 THEN user_id END AS k FROM events)")
def ffill_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 1000 == 7, F.col("user_id")).alias("k"))
    return rolling.ffill(df, "k", order=["event_id"])


@query("row_numbers", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS row_number FROM orders")
def row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], "row_number", 1)


# Duplicates, picking, reshaping.


@query("drop_duplicates_first", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def drop_duplicates_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return dedup.drop_duplicates(df, ["user_id", "event_type"], "first", ["event_id"])


@query("drop_duplicates_last", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def drop_duplicates_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.drop_duplicates(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], "last", ["event_id"])


@query("drop_duplicates_none", "SELECT l_partkey, l_suppkey, min(l_orderkey) AS l_orderkey FROM lineitem GROUP BY 1, 2 HAVING count(*) = 1")
def drop_duplicates_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey")
    return dedup.drop_duplicates(df, ["l_partkey", "l_suppkey"], False, ["l_orderkey"])


@query("duplicated_mask", "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) > 1 AS duplicated FROM events")
def duplicated_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.duplicated(table(spark, sf_dir, "events"), ["user_id", "event_type"], "first", ["event_id"]).select("event_id", "duplicated")


@query("distinct_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Session(spark).frame(table(spark, sf_dir, "orders")).select("o_orderstatus", "o_orderpriority").distinct().df


@query("tail", "SELECT o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 6)")
def tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return picking.tail(table(spark, sf_dir, "orders").select("o_orderkey"), 6, ["o_orderkey"])


@query("nlargest_first", "SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 20")
def nlargest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return picking.n_extreme(table(spark, sf_dir, "part").select("p_partkey", "p_size"), 20, ["p_size"], True, "first", ["p_partkey"])


@query("nsmallest_all", "SELECT p_partkey, p_size FROM (SELECT *, rank() OVER (ORDER BY p_size) AS r FROM part) WHERE r <= 20")
def nsmallest_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return picking.n_extreme(table(spark, sf_dir, "part").select("p_partkey", "p_size"), 20, ["p_size"], False, "all")


@query("sample_fraction")
def sample_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return picking.sample(table(spark, sf_dir, "orders").select("o_orderkey"), fraction=0.1, seed=7, key=["o_orderkey"])


@query("sample_weighted")
def sample_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return picking.sample(table(spark, sf_dir, "part").select("p_partkey", "p_size"), n=50, seed=7, weights="p_size", key=["p_partkey"])


@query("melt", "SELECT p_partkey, 'p_size' AS variable, CAST(p_size AS VARCHAR) AS value FROM part UNION ALL SELECT p_partkey, 'p_brand', p_brand FROM part")
def melt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.melt(table(spark, sf_dir, "part"), ["p_partkey"], ["p_size", "p_brand"])


@query("explode", "SELECT vec_id, count(*) AS n, count(*) FILTER (x > 0) AS up FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) GROUP BY vec_id")
def explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reshape.explode(table(spark, sf_dir, "embeddings"), ["embedding"], keep_empty=False)
    return out.groupBy("vec_id").agg(F.count("*").alias("n"), F.count_if(F.col("embedding") > 0).alias("up"))


@query("pivot", "SELECT n_regionkey, max(n_name) FILTER (r = 1) AS a, max(n_name) FILTER (r = 2) AS b FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r FROM nation) GROUP BY n_regionkey")
def pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = table(spark, sf_dir, "nation").withColumn("r", F.row_number().over(W.partitionBy("n_regionkey").orderBy("n_nationkey")))
    named = numbered.filter("r <= 2").withColumn("r", F.when(F.col("r") == 1, "a").otherwise("b"))
    return reshape.pivot(named.select("n_regionkey", "r", "n_name"), ["n_regionkey"], "r", "n_name", ["a", "b"])


@query(
    "pivot_table_margins",
    """SELECT coalesce(l_returnflag, 'All') AS l_returnflag, CAST(sum(l_linenumber) FILTER (l_linestatus = 'F') AS BIGINT) AS "F",
       CAST(sum(l_linenumber) FILTER (l_linestatus = 'O') AS BIGINT) AS "O", CAST(sum(l_linenumber) AS BIGINT) AS "All"
       FROM lineitem GROUP BY ROLLUP (l_returnflag)""",
)
def pivot_table_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.pivot_table(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_linestatus", "l_linenumber", "sum", margins=True, names=["F", "O"])


@query("value_counts", 'SELECT c_mktsegment, count(*) AS "rows" FROM customer GROUP BY 1')
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Session(spark).frame(table(spark, sf_dir, "customer")).value_counts("c_mktsegment").df


@query("nunique", "SELECT count(DISTINCT c_nationkey) AS c_nationkey, count(DISTINCT c_mktsegment) AS c_mktsegment FROM customer")
def nunique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Session(spark).frame(table(spark, sf_dir, "customer")).nunique("c_nationkey", "c_mktsegment").df


@query("mask_replace_fill", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_mktsegment = 'BUILDING' THEN 'B' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def mask_replace_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Session(spark).frame(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"))
    return f.mask(F.col("c_acctbal") < 0, 0.0, "c_acctbal").replace("BUILDING", "B", "c_mktsegment").fillna("none").df


@query("dropna_thresh", "SELECT event_id FROM (SELECT event_id, nullif(user_id, 3) AS a, nullif(event_type, 'click') AS b FROM events) WHERE a IS NOT NULL OR b IS NOT NULL")
def dropna_thresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_id", F.nullif("user_id", F.lit(3)).alias("a"), F.nullif("event_type", F.lit("click")).alias("b"))
    return Session(spark).frame(df).dropna(thresh=2).select("event_id").df


@query("isna", "SELECT nullif(n_regionkey, 2) IS NULL AS k FROM nation")
def isna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Session(spark).frame(table(spark, sf_dir, "nation").select(F.nullif("n_regionkey", F.lit(2)).alias("k"))).isna().df


@query("url_domain", r"SELECT page_id, regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#]*@)?(?:[Ww][Ww][Ww]\.)?([^/?#:]*)', 1) AS domain FROM pages")
def url_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", fx.url_domain("url").alias("domain"))


@query("fused_sums", "SELECT l_returnflag, " + ", ".join(f"CAST(sum(l_linenumber + {k}) AS BIGINT) AS l_linenumber_plus_{k}" for k in range(10)) + " FROM lineitem GROUP BY 1")
def fused_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrites.sums_with_offsets(table(spark, sf_dir, "lineitem"), "l_linenumber", range(10), by=["l_returnflag"])


@query("dependent_group_keys", "SELECT user_id, user_id - 1 AS u1, user_id - 2 AS u2, count(*) AS c FROM events GROUP BY 1, 2, 3")
def dependent_group_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrites.group_with_offsets(table(spark, sf_dir, "events"), "user_id", {"u1": -1, "u2": -2}, [F.count("*").alias("c")])


@query("late_materialised_top", "SELECT page_id, url FROM pages ORDER BY url, page_id LIMIT 10")
def late_materialised_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrites.late_top(table(spark, sf_dir, "pages").select("page_id", "url"), ["url", "page_id"], 10, "page_id")


# Quality, vectors, generated tables, change streams.


@query("profile_counts", "SELECT 'n_name' AS \"column\", count(*) AS \"rows\", count(*) - count(n_name) AS nulls, min(n_name) AS \"min\", max(n_name) AS \"max\" FROM nation")
def profile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.profile(table(spark, sf_dir, "nation").select("n_name")).select("column", "rows", "nulls", "min", "max")


@query("data_quality", "SELECT 'not_null(o_custkey)' AS rule, count(*) FILTER (o_custkey IS NULL) AS violations, count(*) FILTER (o_custkey IS NULL) = 0 AS holds FROM orders UNION ALL SELECT 'unique(o_orderkey)', count(o_orderkey) - count(DISTINCT o_orderkey), count(o_orderkey) = count(DISTINCT o_orderkey) FROM orders")
def data_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.check(table(spark, sf_dir, "orders"), not_null=["o_custkey"], unique=["o_orderkey"])


@query("nearest_vector", "SELECT vec_id, round(list_sum([(CAST(x AS DOUBLE) - 0.1) * (CAST(x AS DOUBLE) - 0.1) FOR x IN embedding]), 5) AS distance FROM embeddings ORDER BY list_sum([(CAST(x AS DOUBLE) - 0.1) * (CAST(x AS DOUBLE) - 0.1) FOR x IN embedding]), vec_id LIMIT 5")
def nearest_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings")
    width = len(df.select("embedding").first()[0])
    return vectors.nearest(df, "embedding", [0.1] * width, "vec_id", 5).select("vec_id", F.round("distance", 5).alias("distance"))


@query("double_i64", "SELECT o_orderkey, o_custkey * 2 AS twice FROM orders")
def double_i64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", fx.double_i64("o_custkey").alias("twice"))


@query("calendar", "SELECT CAST(d AS VARCHAR) AS date, year(d) AS year, month(d) AS month, day(d) AS day FROM (SELECT CAST(unnest(generate_series(DATE '2024-02-25', DATE '2024-03-05', INTERVAL 1 DAY)) AS DATE) AS d)")
def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Session(spark).calendar("2024-02-25", "2024-03-05").df
    return out.select(F.col("date").cast("string").alias("date"), *[F.col(c).cast("long").alias(c) for c in ("year", "month", "day")])


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changes of users: every seventh removes its user."""
    op = F.when(F.col("event_id") % 7 == 0, "delete").otherwise("upsert")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), op.alias("op"), F.col("event_id").alias("sequence"), "event_type")


@query("change_state", "SELECT user_id AS key, max(event_id) AS sequence FROM events GROUP BY 1 HAVING max(event_id) % 7 <> 0")
def change_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.state(_changes(spark, sf_dir)).select("key", "sequence")


@query("change_replay", "SELECT count(*) AS n FROM events")
def change_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _changes(spark, sf_dir).withColumn("offset", F.col("sequence"))
    return changes.replay_dedup(rows.union(rows)).agg(F.count("*").alias("n"))


@query("change_late", "SELECT count(*) FILTER (late) AS late, count(*) AS records FROM (SELECT user_id * 100 < max(user_id * 100) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 50 AS late FROM events)")
def change_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") * 100).alias("t"))
    return changes.late_count(df, "t", ["event_id"], 50).select("late", "records")


@query(
    "change_hybrid",
    """WITH d AS (SELECT user_id AS key, max(event_id) AS e FROM events GROUP BY 1), last AS (SELECT key, e, e % 7 = 0 AS gone FROM d)
       SELECT coalesce(c_custkey, key) AS key, coalesce(e, -1) AS sequence FROM customer FULL JOIN last ON c_custkey = key WHERE NOT coalesce(gone, false)""",
)
def change_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.lit(-1).cast("long").alias("sequence"))
    delta = _changes(spark, sf_dir).select("key", "op", "sequence")
    return changes.hybrid(base, delta)


@query("change_group_count", "SELECT event_type, count(*) AS \"rows\" FROM (SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1 HAVING max(event_id) % 7 <> 0) GROUP BY 1")
def change_group_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.state(_changes(spark, sf_dir)).groupBy("event_type").agg(F.count("*").alias("rows"))


# Scenarios.


@query("scenario_nested_json", "SELECT event_type, count(*) AS c, count(json_extract_string(props, '$.k')) AS k FROM events GROUP BY 1")
def scenario_nested_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").alias("k"))
    return df.groupBy("event_type").agg(F.count("*").alias("c"), F.count("k").alias("k"))


_DIRTY = "CASE WHEN event_id % 9 = 0 THEN 'bad' ELSE CAST(user_id AS STRING) END"


@query("scenario_clean_cast_filter", f"SELECT event_id, TRY_CAST({_DIRTY} AS BIGINT) AS n FROM events WHERE TRY_CAST({_DIRTY} AS BIGINT) > 10")
def scenario_clean_cast_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_id", F.expr(_DIRTY).alias("raw"))
    return df.select("event_id", fx.try_cast("raw", "string", "bigint").alias("n")).filter("n > 10")


@query("scenario_malformed_timestamps", "SELECT count(*) AS n, count(TRY_CAST(CASE WHEN event_id % 7 = 0 THEN 'not a time' ELSE CAST(ts AS VARCHAR) END AS TIMESTAMP)) AS valid FROM events")
def scenario_malformed_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 7 == 0, "not a time").otherwise(F.col("ts").cast("string"))
    return table(spark, sf_dir, "events").select(raw.try_cast("timestamp").alias("t")).agg(F.count("*").alias("n"), F.count("t").alias("valid"))


@query("scenario_null_heavy", "SELECT event_type, count(v) AS seen, CAST(sum(v) AS BIGINT) AS total FROM (SELECT event_type, CASE WHEN event_id % 4 <> 0 THEN user_id END AS v FROM events) GROUP BY 1")
def scenario_null_heavy(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_type", F.when(F.col("event_id") % 4 != 0, F.col("user_id")).alias("v"))
    return df.groupBy("event_type").agg(F.count("v").alias("seen"), F.sum("v").alias("total"))


@query("scenario_skewed_join", "SELECT n_name, count(*) AS c FROM (SELECT CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_suppkey % 25 END AS k FROM lineitem) JOIN nation ON k = n_nationkey GROUP BY 1")
def scenario_skewed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of all rows has one key: rows are counted by key before they meet the other side."""
    key = F.when(F.col("l_orderkey") % 3 == 0, 0).otherwise(F.col("l_suppkey") % 25)
    counted = table(spark, sf_dir, "lineitem").groupBy(key.alias("k")).agg(F.count("*").alias("n"))
    return counted.join(table(spark, sf_dir, "nation"), F.col("k") == F.col("n_nationkey")).groupBy("n_name").agg(F.sum("n").alias("c"))


@query(
    "scenario_multi_stage",
    """SELECT n_name, o_orderstatus, count(*) AS c, CAST(sum(q) AS BIGINT) AS q FROM (SELECT l_orderkey, sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY 1) l
       JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE q > 100 GROUP BY 1, 2""",
)
def scenario_multi_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_order = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("q")).filter("q > 100")
    orders = per_order.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    named = orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return named.groupBy("n_name", "o_orderstatus").agg(F.count("*").alias("c"), F.sum("q").alias("q"))


@query("scenario_many_files", "SELECT count(*) AS c, CAST(sum(k) AS BIGINT) AS s FROM (SELECT o_orderkey AS k FROM orders UNION ALL SELECT c_custkey FROM customer)")
def scenario_many_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).unionByName(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")))
    return both.agg(F.count("*").alias("c"), F.sum("k").alias("s"))


@query("scenario_small_change", "SELECT c_custkey AS key, CASE WHEN c_custkey % 100 = 1 THEN 1.0 ELSE c_acctbal END AS balance FROM customer WHERE c_custkey % 100 <> 2")
def scenario_small_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"))
    picked = base.filter((F.col("key") % 100).isin(1, 2))
    delta = picked.select("key", F.when(F.col("key") % 100 == 1, "upsert").otherwise("delete").alias("op"), F.lit(1.0).alias("balance"), F.col("key").alias("sequence"))
    return changes.hybrid(base, delta)


@query("approx_distinct_sketches")
def approx_distinct_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = sketches.build(table(spark, sf_dir, "events"), "user_id", ["event_type"])
    return sketches.estimate(sketches.merge(parts))


# Types of the contract, without casts around them.

sql_query(
    "int_division_scopes",
    "SELECT t.a / 2 AS half, CASE WHEN t.a > 700 THEN 7 ELSE 9 END / 2 AS fixed, (t.a + c.c_nationkey) / 2 AS both FROM (SELECT o_custkey AS a FROM orders) AS t INNER JOIN customer AS c ON t.a = c.c_custkey",
    "SELECT t.a // 2 AS half, CAST(CASE WHEN t.a > 700 THEN 7 ELSE 9 END // 2 AS BIGINT) AS fixed, (t.a + c.c_nationkey) // 2 AS both FROM (SELECT o_custkey AS a FROM orders) AS t INNER JOIN customer AS c ON t.a = c.c_custkey",
)
sql_query("float_floor_ceil", "SELECT c_custkey, floor(c_acctbal) AS f, ceil(c_acctbal) AS c, floor(c_acctbal / 7e0) + 0.5e0 AS g FROM customer")
sql_query(
    "decimal_exact",
    "SELECT o_orderkey, CAST(o_totalprice AS decimal128(12,2)) * CAST(0.05 AS decimal128(4,2)) AS product, CAST(o_totalprice AS decimal128(12,2)) + CAST(0.125 AS decimal128(6,3)) AS total, CAST(o_totalprice AS decimal128(12,2)) / CAST(4 AS decimal128(3,0)) AS quotient FROM orders",
    "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(12,2)) * CAST(0.05 AS DECIMAL(4,2)) AS product, CAST(o_totalprice AS DECIMAL(12,2)) + CAST(0.125 AS DECIMAL(6,3)) AS total, CAST(CAST(o_totalprice AS DECIMAL(12,2)) * 0.25 AS DECIMAL(38,6)) AS quotient FROM orders",
)
sql_query(
    "strict_try_cast",
    "SELECT c_custkey, TRY_CAST(c_acctbal AS int64) AS whole, TRY_CAST(c_mktsegment AS boolean) AS flag, TRY_CAST(CASE WHEN c_nationkey > 9 THEN 'true' ELSE 'FALSE' END AS boolean) AS big, TRY_CAST(c_name AS int64) AS n FROM customer",
    "SELECT c_custkey, CASE WHEN c_acctbal % 1 = 0 THEN CAST(c_acctbal AS BIGINT) END AS whole, CAST(NULL AS BOOLEAN) AS flag, c_nationkey > 9 AS big, CAST(NULL AS BIGINT) AS n FROM customer",
)
sql_query(
    "encoded_text",
    "SELECT n_nationkey, CAST(from_base64('YWJj') AS STRING) AS b, CAST(unhex('6f6b') AS STRING) AS h, regexp_replace(n_name, '^([A-Z])', '$\\1') AS d FROM nation",
    "SELECT n_nationkey, 'abc' AS b, 'ok' AS h, regexp_replace(n_name, '^([A-Z])', '$\\1') AS d FROM nation",
)
sql_query("from_list", "SELECT n.n_name, r.r_name FROM nation AS n, region AS r WHERE n.n_regionkey = r.r_regionkey")
sql_query(
    "sub_outer_of_second_table",
    "SELECT c.c_custkey FROM customer AS c INNER JOIN nation AS n ON c.c_nationkey = n.n_nationkey WHERE EXISTS (SELECT r_regionkey FROM region WHERE r_regionkey = outer.n_regionkey AND r_name = 'ASIA')",
    "SELECT c.c_custkey FROM customer AS c INNER JOIN nation AS n ON c.c_nationkey = n.n_nationkey WHERE EXISTS (SELECT r_regionkey FROM region WHERE r_regionkey = n.n_regionkey AND r_name = 'ASIA')",
)
sql_query("sub_row_not_in", "SELECT n_nationkey FROM nation WHERE (n_regionkey, n_nationkey) NOT IN (SELECT r_regionkey, r_regionkey * 2 FROM region)")
sql_query("sub_not_in_projection", "SELECT n_nationkey, n_nationkey NOT IN (SELECT nullif(r_regionkey, 2) FROM region) AS other FROM nation")
sql_query("sub_exists_in_having", "SELECT o_orderstatus, count(*) AS c FROM orders GROUP BY o_orderstatus HAVING EXISTS (SELECT r_name FROM region WHERE r_name = 'ASIA') AND NOT EXISTS (SELECT r_name FROM region WHERE r_name = 'NOWHERE')")
sql_query("join_or_large", "SELECT c.c_custkey, s.s_suppkey FROM customer AS c INNER JOIN supplier AS s ON c.c_custkey = s.s_suppkey OR c.c_nationkey = s.s_suppkey")
sql_query("lists_distinct", "SELECT DISTINCT ARRAY[n_regionkey, n_regionkey + 1] AS l FROM nation", "SELECT DISTINCT [n_regionkey, n_regionkey + 1] AS l FROM nation")
sql_query("lists_union_sorted", "SELECT ARRAY[n_regionkey, 1] AS l FROM nation UNION SELECT ARRAY[r_regionkey, 2] AS l FROM region ORDER BY l DESC LIMIT 7", "SELECT [n_regionkey, 1] AS l FROM nation UNION SELECT [r_regionkey, 2] AS l FROM region ORDER BY l DESC LIMIT 7")
sql_query(
    "structs_distinct",
    "SELECT count(*) AS n FROM (SELECT STRUCT(n_regionkey AS a, n_regionkey * 2 AS b) AS s FROM nation UNION SELECT STRUCT(r_regionkey AS a, 4 AS b) AS s FROM region) AS t",
    "SELECT count(*) AS n FROM (SELECT {'a': n_regionkey, 'b': n_regionkey * 2} AS s FROM nation UNION SELECT {'a': r_regionkey, 'b': 4} AS s FROM region) AS t",
)
sql_query(
    "timestamp_parts",
    "SELECT event_id, CAST(timestamp_year(ts) AS BIGINT) AS y, CAST(timestamp_month(ts) AS BIGINT) AS m, CAST(timestamp_day(ts) AS BIGINT) AS d, CAST(timestamp_second(ts) AS BIGINT) AS s, CAST(timestamp_sub_seconds(timestamp_add_seconds(ts, 90), 30) AS STRING) AS later FROM events",
    "SELECT event_id, year(ts) AS y, month(ts) AS m, day(ts) AS d, CAST(second(ts) AS BIGINT) AS s, CAST(ts + INTERVAL 60 SECOND AS VARCHAR) AS later FROM events",
)
sql_query(
    "statistics_by_key",
    "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS v, round(corr(l_quantity, l_extendedprice), 6) AS r, round(percentile(l_quantity, 0.5e0), 6) AS mid FROM lineitem GROUP BY l_returnflag",
    "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS v, round(corr(l_quantity, l_extendedprice), 6) AS r, round(quantile_cont(l_quantity, 0.5), 6) AS mid FROM lineitem GROUP BY l_returnflag",
)


# Source order without a key, ties and the other rolling functions.


@query("row_index_of_source", "SELECT row_number() OVER () - 1 AS i, o_orderkey FROM orders")
def row_index_of_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_row_index(table(spark, sf_dir, "orders").select("o_orderkey")).select(F.col(INDEX).alias("i"), "o_orderkey")


_ROLLED = {"mean": "round(avg(event_id) OVER w, 6)", "count": "count(event_id) OVER w", "min": "min(event_id) OVER w", "max": "max(event_id) OVER w"}
for _fn, _sql in _ROLLED.items():

    @query(f"rolling_{_fn}", f"SELECT event_id, CASE WHEN count(event_id) OVER w >= 2 THEN {_sql} END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)")
    def _rolled(spark: SparkSession, sf_dir: str, fn: str = _fn) -> DataFrame:
        out = rolling.rolling(table(spark, sf_dir, "events"), "event_id", fn, 4, 2, by=["user_id"], order=["ts", "event_id"], name="s").select("event_id", "s")
        return out.withColumn("s", F.round("s", 6)) if fn == "mean" else out


@query("rolling_of_source", "SELECT o_orderkey, CASE WHEN count(o_custkey) OVER w >= 2 THEN CAST(sum(o_custkey) OVER w AS BIGINT) END AS s FROM (SELECT *, row_number() OVER () AS i FROM orders) WINDOW w AS (ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def rolling_of_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.rolling(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "sum", 3, 2, name="s").select("o_orderkey", "s")


@query("ffill_of_source", "SELECT o_orderkey, last_value(k IGNORE NULLS) OVER (ORDER BY i) AS k FROM (SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN o_custkey END AS k, row_number() OVER () AS i FROM orders)")
def ffill_of_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.ffill(table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 3 == 0, F.col("o_custkey")).alias("k")), "k")


@query("nlargest_last", "SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey DESC LIMIT 20")
def nlargest_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return picking.n_extreme(table(spark, sf_dir, "part").select("p_partkey", "p_size"), 20, ["p_size"], True, "last", ["p_partkey"])


@query("sample_bounds", "SELECT true AS drawn_once, true AS near_a_tenth, 50 AS weighted, true AS repeats")
def sample_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What samples promise: each key once, about the share, exactly the count, repeats with replacement."""
    orders, part = table(spark, sf_dir, "orders").select("o_orderkey"), table(spark, sf_dir, "part").select("p_partkey", "p_size")
    share = picking.sample(orders, fraction=0.1, seed=7, key=["o_orderkey"]).agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("d")).crossJoin(orders.agg(F.count("*").alias("all")))
    weighted = picking.sample(part, n=50, seed=7, weights="p_size", key=["p_partkey"]).agg(F.count("*").alias("w"))
    again = picking.sample(part, n=5000, seed=7, weights="p_size", replace=True, key=["p_partkey"]).agg(F.count("*").alias("r"))
    one = share.crossJoin(weighted).crossJoin(again)
    return one.select((F.col("n") == F.col("d")).alias("drawn_once"), (F.abs(F.col("n") / F.col("all") - 0.1) < 0.05).alias("near_a_tenth"), F.least("w", F.lit(50)).cast("int").alias("weighted"), (F.col("r") == 5000).alias("repeats"))


@query("sketch_bounds", "SELECT true AS near")
def sketch_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = sketches.beside_exact(table(spark, sf_dir, "lineitem"), "l_orderkey")
    return both.select((F.abs(F.col("approx_distinct") / F.col("distinct") - 1) < 0.1).alias("near"))


@query("text_embedding", "SELECT doc_id, CAST(length(text) AS DOUBLE) AS points, CAST(length(regexp_replace(text, '[^aeiouAEIOU]', '', 'g')) AS DOUBLE) AS vowels FROM documents")
def text_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vectors.embed_text(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "e")
    return out.select("doc_id", F.col("e")[0].alias("points"), F.col("e")[2].alias("vowels"))


@query("embedding_stats", "SELECT event_type, count(*) AS n, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1")
def embedding_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Session(spark).frame(table(spark, sf_dir, "events")).group_by("event_type").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).df


@query("change_kinds", "SELECT CASE event_type WHEN 'click' THEN 'update' WHEN 'view' THEN 'insert' WHEN 'purchase' THEN 'delete' WHEN 'signup' THEN 'schema_change' ELSE 'unknown' END AS kind, count(*) AS n FROM events GROUP BY 1")
def change_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.create_map(*[F.lit(x) for x in ("click", "UPSERT", "view", "insert ", "purchase", "retract", "signup", "schema")])
    df = table(spark, sf_dir, "events").select(F.coalesce(F.element_at(words, F.col("event_type")), F.lit("?")).alias("op"))
    return df.groupBy(changes.event_kind().alias("kind")).agg(F.count("*").alias("n"))


# Sinks and formats: what is written comes back.


def _round_trip(fmt: str) -> None:
    columns = "n_nationkey, n_name, n_regionkey"

    @query(f"round_trip_{fmt}", f"SELECT {columns} FROM nation")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        session = Session(spark)
        path = f"{shared_folder(spark)}/round-trip-{uuid.uuid4().hex}.{fmt}"
        df = table(spark, sf_dir, "nation").select(*columns.split(", "))
        sinks.write(df, path)
        back = session.read(path).df
        return back.select(*[F.col(c).cast(df.schema[c].dataType).alias(c) for c in df.columns])


for _fmt in ("csv", "jsonl", "parquet", "orc", "arrow"):
    _round_trip(_fmt)


# Frames: the forms that SQL has no word for.


def _frame(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> Frame:
    return Session(spark).frame(table(spark, sf_dir, name).select(*columns))


@query("frame_rename_drop_cast", "SELECT CAST(n_nationkey AS DOUBLE) AS key, CAST(n_regionkey AS VARCHAR) AS region FROM nation")
def frame_rename_drop_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _frame(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey")
    return df.rename({"n_nationkey": "key", "n_regionkey": "region"}).drop("n_name").astype({"key": "float64", "region": "utf8"}).df


@query("frame_text_replace", "SELECT n_nationkey, regexp_replace(replace(n_name, 'A', '$'), '^(.)', '<\\1>') AS n_name FROM nation")
def frame_text_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _frame(spark, sf_dir, "nation", "n_nationkey", "n_name")
    return df.str_replace("n_name", "A", "$").str_replace("n_name", r"^(.)", r"<\1>", regex=True).df


@query("frame_arithmetic", "SELECT o_orderkey, o_custkey // 7 AS q, o_custkey + 5 AS s, o_custkey * 3 AS p, o_totalprice / 8.0 AS f FROM orders")
def frame_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _frame(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    df = df.arithmetic("o_custkey", "/", 7, "q").arithmetic("o_custkey", "+", 5, "s").arithmetic("o_custkey", "*", 3, "p").arithmetic("o_totalprice", "/", 8.0, "f")
    return df.drop("o_custkey", "o_totalprice").df.withColumn("q", F.col("q").cast("bigint"))


@query("frame_map_pipe", "SELECT upper(lower(n_name)) AS n_name, upper(CAST(n_regionkey AS VARCHAR)) AS n_regionkey FROM nation WHERE n_regionkey > 1")
def frame_map_pipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _frame(spark, sf_dir, "nation", "n_name", "n_regionkey").pipe(lambda x, least: x.filter(F.col("n_regionkey") > least), 1)
    return df.map("n_name", F.lower).applymap(lambda c: F.upper(c.cast("string"))).df


@query("frame_head", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7 OFFSET 3")
def frame_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frame(spark, sf_dir, "orders", "o_orderkey").sort("o_orderkey").head(7, 3).df


@query("frame_index", "SELECT row_number() OVER (ORDER BY n_name DESC) - 1 AS place, n_name, n_nationkey FROM nation")
def frame_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _frame(spark, sf_dir, "nation", "n_nationkey", "n_name").set_index("n_name")
    return df.sort("n_name", ascending=False).reset_index("place").df


@query("frame_merge", "SELECT n_nationkey, n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey > 2")
def frame_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = _frame(spark, sf_dir, "region", "r_regionkey", "r_name").filter("r_regionkey > 2").rename({"r_regionkey": "n_regionkey"})
    return _frame(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey").merge(right, "n_regionkey", "left").drop("n_regionkey").df


@query("from_rows", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'a', DATE '2024-01-02'), (2, NULL, NULL)) t(id, name, d)")
def from_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, "a", datetime.date(2024, 1, 2)), (2, None, None)]
    return Session(spark).from_rows(rows, "id:int64,name:utf8,d:date32").df


@query("quality_rules", "SELECT count(*) FILTER (c_acctbal < 0 OR c_acctbal > 9000) AS violations FROM customer UNION ALL SELECT count(*) FILTER (c_mktsegment NOT IN ('BUILDING', 'MACHINERY')) FROM customer")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.check(table(spark, sf_dir, "customer"), between={"c_acctbal": (0, 9000)}, one_of={"c_mktsegment": ["BUILDING", "MACHINERY"]}).select("violations")


# Sources and sinks: tables written and read again by each of them.

_NATION = "SELECT n_nationkey, n_name, n_regionkey FROM nation"


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")


@query("source_parts", _NATION)
def source_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    place, df = _fresh(spark, "parts"), _nation(spark, sf_dir)
    for k in range(3):
        df.filter(F.col("n_nationkey") % 3 == k).write.parquet(f"{place}/{k}")
    return Session(spark).read_parts([f"{place}/{k}" for k in range(3)]).df


@query("source_partitioned", _NATION)
def source_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    place, df = _fresh(spark, "partitioned"), _nation(spark, sf_dir)
    partitioning.write_partitioned(df.withColumnRenamed("n_regionkey", "r"), place, {"n_regionkey": ("r", "identity", None)})
    back = Session(spark).read_partitioned(place, ["n_regionkey"]).df
    return back.select("n_nationkey", "n_name", F.col("n_regionkey").cast(df.schema["n_regionkey"].dataType).alias("n_regionkey"))


@query("source_delta", _NATION + " WHERE n_nationkey % 3 <> 1")
def source_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    place, df = _fresh(spark, "delta"), _nation(spark, sf_dir)
    for k in range(3):
        df.filter(F.col("n_nationkey") % 3 == k).write.parquet(f"{place}/p{k}")
    for v, actions in enumerate([[{"add": {"path": "p0"}}, {"add": {"path": "p1"}}], [{"remove": {"path": "p1"}}, {"add": {"path": "p2"}}]]):
        partitioning.write_object(spark, f"{place}/_delta_log/{v:020d}.json", "\n".join(map(json.dumps, actions)).encode())
    return Session(spark).read_delta(place).df


@query("source_iceberg", _NATION + " WHERE n_nationkey % 3 = 0")
def source_iceberg(spark: SparkSession, sf_dir: str) -> DataFrame:
    place, df = _fresh(spark, "iceberg"), _nation(spark, sf_dir)
    for k in range(2):
        df.filter(F.col("n_nationkey") % 3 == k).write.parquet(f"{place}/p{k}")
    snapshots = [{"snapshot-id": k, "timestamp-ms": k, "manifest-list": f"m{k}.json"} for k in (1, 2)]
    for name, body in (("m1.json", [{"file_path": "p0"}]), ("m2.json", [{"file_path": "p0"}, {"file_path": "p1"}]), ("v1.metadata.json", {"current-snapshot-id": 2, "snapshots": snapshots})):
        partitioning.write_object(spark, f"{place}/metadata/{name}", json.dumps(body).encode())
    return Session(spark).read_iceberg(place, as_of_ms=1).df


@query("source_manifest_table", _NATION + " WHERE n_regionkey <> 2 AND n_nationkey % 5 <> 1")
def source_manifest_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two commits overlaid, less deleted keys."""
    df = _nation(spark, sf_dir)
    one, two = (lakes.ManifestTable(spark, _fresh(spark, "manifest")) for _ in range(2))
    one.append(df.filter("n_regionkey < 2"))
    two.append(df.filter("n_regionkey > 2"), expected=0)
    return lakes.subtract_deleted(lakes.overlay(one.read(), two.read()), df.filter("n_nationkey % 5 = 1"), ["n_nationkey"])


@query("source_prepared", "SELECT n_name, length(n_name) AS chars FROM nation")
def source_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    session, place = Session(spark), _fresh(spark, "prepared")
    sinks.write(_nation(spark, sf_dir), f"{place}.csv")
    for _ in range(2):
        out = session.prepare(f"{place}.csv", place, derived=True)
    return out.df.select("n_name", F.col("__len_n_name").cast("bigint").alias("chars"))


@query("source_sqlite", _NATION)
def source_sqlite(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{tempfile.mkdtemp(prefix='fathomic-sqlite-')}/t.db"
    df = _nation(spark, sf_dir)
    sqlite_table.write(df, path, "nation")
    back = Session(spark).read_sqlite(path, "nation").df
    return back.select(*[F.col(c).cast(df.schema[c].dataType).alias(c) for c in df.columns])


@query("sink_fanout", _NATION + " UNION ALL " + _NATION)
def sink_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    place, df = _fresh(spark, "fanout"), _nation(spark, sf_dir)
    session = Session(spark)
    for _ in range(2):
        sinks.fanout(df, {f"{place}.parquet": None, f"{place}.orc": None}, overwrite=True)
    return session.read(f"{place}.parquet").df.unionByName(session.read(f"{place}.orc").df)


@query("sink_native", _NATION)
def sink_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_fresh(spark, 'native')}.parquet"
    sinks.write_native(_nation(spark, sf_dir), path)
    return spark.read.parquet(path)


@query("layout_files", 'SELECT CAST(4 AS BIGINT) AS files, count(*) AS "rows" FROM orders')
def layout_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = _fresh(spark, "layout")
    table(spark, sf_dir, "orders").select("o_orderkey").repartition(4).write.parquet(place)
    return partitioning.layout_health(spark.read.parquet(place)).select("files", "rows")


@query("stream_state", "SELECT user_id AS key, max(event_id) AS sequence FROM events GROUP BY 1 HAVING arg_max(event_type, event_id) <> 'purchase'")
def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change stream maintained by Structured Streaming, in several micro-batches, and read back."""
    place = _fresh(spark, "stream")
    df = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.when(F.col("event_type") == "purchase", "delete").otherwise("upsert").alias("op"), F.col("event_id").alias("sequence"))
    for k in range(3):
        df.filter(F.col("sequence") % 3 == k).coalesce(1).write.mode("append").parquet(f"{place}/in")
        changes.maintain_state(spark.readStream.schema(df.schema).parquet(f"{place}/in"), f"{place}/state", f"{place}/point", compact_every=2)
    return changes.read_state(spark, f"{place}/state").select("key", "sequence")


def entry(spark: SparkSession) -> DataFrame:
    return pricing_summary(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
