"""Projection, filters, subqueries, joins, aggregates, windows, ranking, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.operators import aggregates, joins, ranking, setops
from freshet.workload.base import Registry, load

R = Registry()

# Reports in the shape of well-known decision-support queries
R.sql(
    "tpch_q1",
    """SELECT l_returnflag, l_linestatus, round(SUM(l_quantity), 2) AS sum_qty, round(SUM(l_extendedprice), 2) AS sum_base_price, round(SUM(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
    round(SUM(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(AVG(l_quantity), 4) AS avg_qty, round(AVG(l_extendedprice), 4) AS avg_price, round(AVG(l_discount), 6) AS avg_disc, COUNT(*) AS count_order
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
)
R.sql(
    "tpch_q3",
    """SELECT o_orderkey, round(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15 00:00:00' AND l_shipdate > TIMESTAMP '1998-03-15 00:00:00' GROUP BY o_orderkey, o_orderdate ORDER BY revenue DESC, o_orderkey LIMIT 10""",
)
R.sql(
    "tpch_q4",
    """SELECT o_orderpriority, COUNT(*) AS order_count FROM orders WHERE o_orderdate >= TIMESTAMP '1997-07-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-10-01 00:00:00'
    AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY o_orderpriority""",
)
R.sql(
    "tpch_q5",
    """SELECT n_name, round(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name""",
)
R.sql("tpch_q6", "SELECT round(SUM(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1998-01-01 00:00:00' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
R.sql(
    "tpch_q7",
    """SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, year(l_shipdate) AS l_year, round(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey
    JOIN customer ON c_custkey = o_custkey JOIN nation n1 ON s_nationkey = n1.n_nationkey JOIN nation n2 ON c_nationkey = n2.n_nationkey
    WHERE n1.n_name IN ('NATION_1', 'NATION_2') AND n2.n_name IN ('NATION_1', 'NATION_2') AND n1.n_name <> n2.n_name GROUP BY n1.n_name, n2.n_name, year(l_shipdate)""",
)
R.sql(
    "tpch_q8",
    """SELECT year(o_orderdate) AS o_year, round(SUM(CASE WHEN n_name = 'NATION_3' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / SUM(l_extendedprice * (1 - l_discount)), 6) AS share FROM part JOIN lineitem ON p_partkey = l_partkey
    JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN nation ON s_nationkey = n_nationkey WHERE p_type = 'ECONOMY' GROUP BY year(o_orderdate)""",
)
R.sql(
    "tpch_q10",
    """SELECT c_custkey, c_name, round(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, c_acctbal, n_name FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
    WHERE l_returnflag = 'R' AND o_orderdate >= TIMESTAMP '1997-10-01 00:00:00' AND o_orderdate < TIMESTAMP '1998-01-01 00:00:00' GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
)
R.sql("tpch_q13", "SELECT c_count, COUNT(*) AS custdist FROM (SELECT c_custkey, COUNT(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority <> '1-URGENT' GROUP BY c_custkey) AS t GROUP BY c_count")
R.sql("tpch_q14", "SELECT round(100.0 * SUM(CASE WHEN p_type LIKE 'ECON%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / SUM(l_extendedprice * (1 - l_discount)), 6) AS promo FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP '1997-09-01 00:00:00' AND l_shipdate < TIMESTAMP '1997-10-01 00:00:00'")
R.sql("tpch_q17", "SELECT round(SUM(l_extendedprice) / 7.0, 2) AS avg_yearly FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand = 'Brand#2' AND l_quantity < (SELECT 0.5 * AVG(l2.l_quantity) FROM lineitem l2 WHERE l2.l_partkey = p_partkey)")
R.sql(
    "tpch_q18",
    "SELECT c_name, o_orderkey, o_totalprice, round(SUM(l_quantity), 2) AS qty FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING SUM(l_quantity) > 250) GROUP BY c_name, o_orderkey, o_totalprice",
)
R.sql("tpch_q19", "SELECT round(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey WHERE (p_brand = 'Brand#1' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 15) OR (p_brand = 'Brand#2' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 30)")
R.sql("tpch_q22", "SELECT c_nationkey, COUNT(*) AS numcust, round(SUM(c_acctbal), 2) AS totacctbal FROM customer WHERE c_acctbal > (SELECT AVG(c_acctbal) FROM customer WHERE c_acctbal > 0) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY c_nationkey")

# Projection and filters
R.sql("project_expressions", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, l_quantity > 25 AS bulk FROM lineitem")
R.sql("filter_predicates", "SELECT p_partkey, p_name FROM part WHERE p_size BETWEEN 10 AND 20 AND p_name LIKE '%widget' AND NOT p_brand = 'Brand#1'")
R.sql("filter_between_symmetric", "SELECT p_partkey FROM part WHERE p_size BETWEEN SYMMETRIC 20 AND 10", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20")
R.sql("values_constant", "SELECT k, v FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS t(k, v)")
R.sql("select_exclude", "SELECT * EXCLUDE (p_retailprice, p_type) FROM part")
R.sql("select_replace", "SELECT * REPLACE (p_size + 1 AS p_size) FROM part")
R.sql("lateral_alias", "SELECT p_partkey, p_size * 2 AS doubled, doubled + 1 AS more FROM part")
R.sql("distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey")
R.sql("qualify", "SELECT o_custkey, o_orderkey FROM orders QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1")
R.sql("subquery_scalar", "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice > (SELECT AVG(p_retailprice) FROM part)")
R.sql("subquery_scalar_correlated", "SELECT p_partkey, (SELECT COUNT(*) FROM lineitem WHERE l_partkey = p_partkey) AS sold FROM part")
R.sql("subquery_in", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
R.sql("subquery_not_in", "SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
R.sql("subquery_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
R.sql("subquery_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
R.sql("lateral_subquery", "SELECT n_nationkey, t.most FROM nation, LATERAL (SELECT MAX(c_acctbal) AS most FROM customer WHERE c_nationkey = n_nationkey) AS t")
R.sql("cross_apply", "SELECT r_regionkey, t.n FROM region CROSS APPLY (SELECT COUNT(*) AS n FROM nation WHERE n_regionkey = r_regionkey) AS t", "SELECT r_regionkey, t.n FROM region, LATERAL (SELECT COUNT(*) AS n FROM nation WHERE n_regionkey = r_regionkey) AS t")
R.sql("with_cte", "WITH big AS (SELECT o_custkey, SUM(o_totalprice) AS total FROM orders GROUP BY o_custkey), top AS (SELECT o_custkey FROM big WHERE total > 2000000) SELECT c_custkey, c_name FROM customer JOIN top ON c_custkey = o_custkey")
R.sql("pivot", "SELECT * FROM (SELECT o_orderstatus, o_orderpriority, o_orderkey FROM orders) PIVOT (COUNT(o_orderkey) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))", "SELECT o_orderpriority, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS f, COUNT(*) FILTER (WHERE o_orderstatus = 'O') AS o, COUNT(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY o_orderpriority")
R.sql("unpivot", "SELECT p_partkey, name, v FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM part) UNPIVOT (v FOR name IN (p_size, p_retailprice))", "SELECT p_partkey, 'p_size' AS name, CAST(p_size AS DOUBLE) AS v FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")
R.sql("unnest", "SELECT vec_id, e FROM (SELECT vec_id, explode(slice(embedding, 1, 4)) AS e FROM embeddings)", "SELECT vec_id, unnest(embedding[1:4]) AS e FROM embeddings")
R.sql("unnest_ordinality", "SELECT vec_id, pos + 1 AS i, e FROM (SELECT vec_id, posexplode(slice(embedding, 1, 4)) AS (pos, e) FROM embeddings)", "SELECT vec_id, CAST(unnest(range(1, 5)) AS INTEGER) AS i, unnest(embedding[1:4]) AS e FROM embeddings")
R.sql("unnest_map", "SELECT p_partkey, k, v FROM (SELECT p_partkey, explode(MAP['size', p_size, 'twice', p_size * 2]) AS (k, v) FROM part)", "SELECT p_partkey, 'size' AS k, p_size AS v FROM part UNION ALL SELECT p_partkey, 'twice', p_size * 2 FROM part")
R.sql("array_subquery", "SELECT n_nationkey, cardinality(a) AS n FROM (SELECT n_nationkey, (SELECT collect_list(c_custkey) FROM customer WHERE c_nationkey = n_nationkey) AS a FROM nation)", "SELECT n_nationkey, (SELECT COUNT(*) FROM customer WHERE c_nationkey = n_nationkey) AS n FROM nation")
R.sql("array_of_subquery", "SELECT cardinality(ARRAY(SELECT n_name FROM nation)) AS n", "SELECT COUNT(*)::INTEGER AS n FROM nation")
R.sql("map_of_subquery", "SELECT cardinality(MAP(SELECT n_regionkey, n_name FROM nation)) AS n", "SELECT COUNT(DISTINCT n_regionkey)::INTEGER AS n FROM nation")

# Joins
R.sql("join_inner", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
R.sql("join_left", "SELECT c_custkey, COUNT(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
R.sql("join_right", "SELECT n_name, s_suppkey FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey")
R.sql("join_full", "SELECT d.doc_id AS doc, l.doc_id AS labelled, l.quality FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id")
R.sql("join_semi", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
R.sql("join_anti", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)")
R.sql("join_cross", "SELECT a.r_name AS r1, b.r_name AS r2 FROM region a CROSS JOIN region b")
R.sql("join_theta", "SELECT a.n_name AS n1, b.n_name AS n2 FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
R.sql("join_using", "SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id)")
R.sql("join_natural", "SELECT doc_id, lang, quality FROM documents NATURAL JOIN labels")
R.sql("join_interval", "SELECT a.event_id AS e1, b.event_id AS e2 FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts BETWEEN a.ts AND a.ts + INTERVAL '30' MINUTE")
R.sql(
    "join_asof",
    "SELECT p.event_id, s.event_id AS before FROM (SELECT * FROM events WHERE event_type = 'purchase') p LEFT ASOF JOIN (SELECT * FROM events WHERE event_type = 'signup') s MATCH_CONDITION (p.ts >= s.ts) ON p.user_id = s.user_id",
    "SELECT p.event_id, s.event_id AS before FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') s ON p.user_id = s.user_id AND p.ts >= s.ts",
)


@R.query("join_asof_bucketed", R.oracles["join_asof"])
def join_asof_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    (e,) = load(spark, sf_dir, "events")
    found = joins.asof_join(e.where("event_type = 'purchase'"), e.where("event_type = 'signup'"), ["user_id"], "ts", "ts", bucket_seconds=86_400)
    return found.select("event_id", F.col("right_event_id").alias("before"))


@R.query("join_range", "SELECT p_partkey, b.lo FROM part JOIN (SELECT CAST(unnest(range(0, 50, 5)) AS INTEGER) AS lo) b ON b.lo <= p_size AND p_size < b.lo + 7")
def join_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    (part,) = load(spark, sf_dir, "part")
    bands = spark.range(0, 50, 5).select(F.col("id").cast("int").alias("lo"), (F.col("id") + 7).cast("int").alias("hi"))
    return joins.range_join(part, bands, "p_size", "lo", "hi", 7).select("p_partkey", "lo")


@R.query("join_star", "SELECT l_orderkey, l_linenumber, p_name, s_name, o_orderdate FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey")
def join_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact, part, supplier, orders = load(spark, sf_dir, "lineitem", "part", "supplier", "orders")
    sides = [(part.withColumnRenamed("p_partkey", "l_partkey"), ["l_partkey"]), (supplier.withColumnRenamed("s_suppkey", "l_suppkey"), ["l_suppkey"]), (orders.withColumnRenamed("o_orderkey", "l_orderkey"), ["l_orderkey"])]
    return joins.star_join(fact, *sides).select("l_orderkey", "l_linenumber", "p_name", "s_name", "o_orderdate")


@R.query("join_null_safe", "SELECT a.doc_id AS d, b.n FROM (SELECT doc_id, CASE WHEN lang = 'en' THEN NULL ELSE lang END AS k FROM documents) a JOIN (SELECT CASE WHEN lang = 'en' THEN NULL ELSE lang END AS k, COUNT(*) AS n FROM documents GROUP BY 1) b ON a.k IS NOT DISTINCT FROM b.k")
def join_null_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    (d,) = load(spark, sf_dir, "documents")
    a = d.select("doc_id", F.when(F.col("lang") != "en", F.col("lang")).alias("k"))
    b = a.groupBy(F.col("k").alias("k2")).agg(F.count("*").alias("n"))
    return joins.null_safe_join(a, b, [("k", "k2")]).select(F.col("doc_id").alias("d"), "n")


@R.query("join_salted", "SELECT l_orderkey, l_linenumber, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
def join_salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, s = load(spark, sf_dir, "lineitem", "supplier")
    return joins.salted_join(l, s.withColumnRenamed("s_suppkey", "l_suppkey"), ["l_suppkey"], 4).select("l_orderkey", "l_linenumber", "s_name")


# Aggregates
_GROUP = "FROM lineitem GROUP BY l_returnflag, l_linestatus"
_AGGREGATES = {
    "count_star": ("COUNT(*)", ""), "count": ("COUNT(l_tax)", ""), "countif": ("COUNTIF(l_quantity > 10)", "COUNT(*) FILTER (WHERE l_quantity > 10)"), "sum": ("round(SUM(l_quantity), 2)", ""),
    "avg": ("round(AVG(l_quantity), 6)", ""), "min": ("MIN(l_shipdate)", ""), "max": ("MAX(l_extendedprice)", ""), "arg_max": ("ARG_MAX(l_orderkey, l_extendedprice * 1000000 + l_orderkey)", ""),
    "arg_min": ("ARG_MIN(l_orderkey, l_extendedprice * 1000000 + l_orderkey)", ""), "bit_and": ("BIT_AND(l_suppkey)", ""), "bit_or": ("BIT_OR(l_suppkey)", ""), "bit_xor": ("BIT_XOR(l_orderkey)", ""),
    "every": ("EVERY(l_quantity > 0)", "bool_and(l_quantity > 0)"), "some": ("SOME(l_quantity > 49)", "bool_or(l_quantity > 49)"), "logical_and": ("LOGICAL_AND(l_tax < 1)", "bool_and(l_tax < 1)"), "logical_or": ("LOGICAL_OR(l_tax > 1)", "bool_or(l_tax > 1)"),
    "bool_and": ("BOOL_AND(l_tax < 1)", ""), "bool_or": ("BOOL_OR(l_tax > 1)", ""), "stddev": ("round(STDDEV(l_quantity), 6)", ""), "stddev_samp": ("round(STDDEV_SAMP(l_quantity), 6)", ""), "stddev_pop": ("round(STDDEV_POP(l_quantity), 6)", ""),
    "variance": ("round(VARIANCE(l_quantity), 6)", ""), "var_samp": ("round(VAR_SAMP(l_quantity), 6)", ""), "var_pop": ("round(VAR_POP(l_quantity), 6)", ""), "covar_pop": ("round(COVAR_POP(l_quantity, l_discount), 6)", ""), "covar_samp": ("round(COVAR_SAMP(l_quantity, l_discount), 6)", ""),
    "regr_count": ("REGR_COUNT(l_quantity, l_discount)", "CAST(REGR_COUNT(l_quantity, l_discount) AS BIGINT)"), "regr_sxx": ("round(REGR_SXX(l_quantity, l_discount), 4)", ""), "regr_syy": ("round(REGR_SYY(l_quantity, l_discount), 2)", ""),
    "count_distinct": ("COUNT(DISTINCT l_partkey)", ""), "sum_distinct": ("round(SUM(DISTINCT l_quantity), 2)", ""), "filter": ("COUNT(*) FILTER (WHERE l_discount > 0.05)", ""), "array_agg": ("cardinality(ARRAY_AGG(l_partkey))", "CAST(len(array_agg(l_partkey)) AS INTEGER)"),
    "array_agg_distinct": ("sort_array(ARRAY_AGG(DISTINCT l_linenumber))", "list_sort(array_agg(DISTINCT l_linenumber))"), "array_agg_nulls": ("cardinality(ARRAY_AGG_NULLS(CASE WHEN l_linenumber > 3 THEN l_linenumber END))", "CAST(len(array_agg(CASE WHEN l_linenumber > 3 THEN l_linenumber END)) AS INTEGER)"),
}
for _name, (_ours, _duck) in _AGGREGATES.items():
    R.sql(f"agg_{_name}", f"SELECT l_returnflag, l_linestatus, {_ours} AS v {_GROUP}", f"SELECT l_returnflag, l_linestatus, {_duck or _ours} AS v {_GROUP}")
R.sql("agg_mode", f"SELECT l_returnflag, l_linestatus, mode(l_linenumber, true) AS v {_GROUP}", "SELECT l_returnflag, l_linestatus, MIN(l_linenumber) AS v FROM (SELECT l_returnflag, l_linestatus, l_linenumber FROM (SELECT *, RANK() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY n DESC) AS r FROM (SELECT l_returnflag, l_linestatus, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY ALL)) WHERE r = 1) GROUP BY ALL")
R.sql("agg_global_empty", "SELECT COUNT(*) AS n, SUM(l_quantity) AS s FROM lineitem WHERE l_quantity < 0")
R.sql("agg_having", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 15")
R.sql("agg_group_by_all", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY ALL")
R.sql("distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
R.sql("grouping_sets", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n, GROUPING_ID(o_orderstatus, o_orderpriority) AS g FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())")
R.sql("rollup", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n, GROUPING(o_orderstatus, o_orderpriority) AS g FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n, GROUPING_ID(o_orderstatus, o_orderpriority) AS g FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
R.sql("cube", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
R.sql("grouping_distinct", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY DISTINCT ROLLUP (o_orderstatus, o_orderpriority), ROLLUP (o_orderstatus)", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
R.sql("grouping", "SELECT o_orderstatus, GROUPING(o_orderstatus) AS g, COUNT(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus)", "SELECT o_orderstatus, CAST(GROUPING(o_orderstatus) AS TINYINT) AS g, COUNT(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus)")


R.sql("agg_avg_of_integers", "SELECT l_returnflag, AVG(l_linenumber - 5) AS v, SUM(l_linenumber - 5) / COUNT(*) AS w, AVG(l_linenumber * 1.0D) > 0 AS p FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, CAST(trunc(AVG(l_linenumber - 5)) AS INTEGER) AS v, CAST(trunc(AVG(l_linenumber - 5)) AS BIGINT) AS w, AVG(l_linenumber) > 0 AS p FROM lineitem GROUP BY l_returnflag")


@R.query("agg_avg_integer", "SELECT l_returnflag, CAST(trunc(SUM(l_linenumber) / COUNT(l_linenumber)) AS INTEGER) AS v FROM lineitem GROUP BY l_returnflag")
def agg_avg_integer(spark: SparkSession, sf_dir: str) -> DataFrame:
    (l,) = load(spark, sf_dir, "lineitem")
    return l.groupBy("l_returnflag").agg(aggregates.avg_as(l, "l_linenumber").alias("v"))


@R.query("agg_within_distinct", "SELECT l_returnflag, round(SUM(p), 2) AS total FROM (SELECT DISTINCT l_returnflag, l_orderkey, o_totalprice AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY l_returnflag")
def agg_within_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, o = load(spark, sf_dir, "lineitem", "orders")
    both = l.select("l_returnflag", "l_orderkey").join(o.select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice"), "l_orderkey")
    return aggregates.within_distinct(both, ["l_returnflag"], ["l_orderkey"], "o_totalprice", "sum", "total").withColumn("total", F.round("total", 2))


@R.query("agg_fold", "SELECT l_returnflag, CAST(SUM(l_linenumber * l_linenumber) AS BIGINT) AS v FROM lineitem GROUP BY l_returnflag")
def agg_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    (l,) = load(spark, sf_dir, "lineitem")
    return aggregates.fold(l, ["l_returnflag"], ["l_orderkey"], ["l_linenumber"], F.lit(0).cast("long"), lambda s, r: s + (r["l_linenumber"] * r["l_linenumber"]).cast("long"), name="v")


@R.query("agg_map", "SELECT n_regionkey, COUNT(DISTINCT n_nationkey % 3)::INTEGER AS n FROM nation GROUP BY n_regionkey")
def agg_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    (n,) = load(spark, sf_dir, "nation")
    made = aggregates.map_agg(n.withColumn("k", F.col("n_nationkey") % 3), ["n_regionkey"], "k", "n_name")
    return made.select("n_regionkey", F.size("m").alias("n"))


@R.query("agg_bit_xor_binary", "SELECT o_orderstatus, lower(printf('%08x', bit_xor(o_orderkey)::INTEGER)) AS v FROM orders GROUP BY o_orderstatus")
def agg_bit_xor_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    (o,) = load(spark, sf_dir, "orders")
    rows = o.select("o_orderstatus", F.unhex(F.lpad(F.hex("o_orderkey"), 8, "0")).alias("b"))
    return aggregates.bit_binary(rows, ["o_orderstatus"], "b", "xor").select("o_orderstatus", F.lower(F.hex("bits")).alias("v"))


# Windows
_W = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
_WINDOWS = {
    "row_number": f"ROW_NUMBER() OVER ({_W})", "rank": "RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus)", "dense_rank": "DENSE_RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus)",
    "lag": f"LAG(o_orderkey, 1, -1) OVER ({_W})", "lead": f"LEAD(o_orderkey, 2, -1) OVER ({_W})", "first_value": f"FIRST_VALUE(o_orderkey) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    "last_value": f"LAST_VALUE(o_orderkey) OVER ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)", "sum_rows": f"round(SUM(o_totalprice) OVER ({_W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2)",
    "count_range": "COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL '30' DAY PRECEDING AND CURRENT ROW)", "max_range": "MAX(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    "avg": "round(AVG(o_totalprice) OVER (PARTITION BY o_custkey), 1)", "min": "MIN(o_totalprice) OVER (PARTITION BY o_orderpriority)",
}
for _name, _text in _WINDOWS.items():
    _cast = "CAST({} AS INTEGER)" if _name in ("row_number", "rank", "dense_rank") else "{}"
    R.sql(f"win_{_name}", f"SELECT o_orderkey, {_text} AS v FROM orders", f"SELECT o_orderkey, {_cast.format(_text)} AS v FROM orders")
R.sql("win_ignore_nulls", f"SELECT o_orderkey, LAST_VALUE(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) IGNORE NULLS OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM orders", f"SELECT o_orderkey, LAST_VALUE(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM orders")
R.sql("win_named", f"SELECT o_orderkey, SUM(o_orderkey) OVER w AS v FROM orders WINDOW w AS ({_W} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)", f"SELECT o_orderkey, CAST(SUM(o_orderkey) OVER w AS BIGINT) AS v FROM orders WINDOW w AS ({_W} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)")

# Order, limits and ranking
R.sql("order_limit", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 25")
R.sql("order_offset", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 20")
R.sql("order_fetch", "SELECT c_custkey FROM customer ORDER BY c_custkey FETCH FIRST 7 ROWS ONLY", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 7")
_TOPK = {"row_number": "ROW_NUMBER", "rank": "RANK", "dense_rank": "DENSE_RANK"}
for _name, _call in _TOPK.items():
    _order = "o_orderdate DESC, o_orderkey" if _name == "row_number" else "o_orderstatus"
    R.sql(f"topk_{_name}", f"SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, {_call}() OVER (PARTITION BY o_custkey ORDER BY {_order}) AS rn FROM orders) AS t WHERE rn <= 2")


@R.query("topk_api", "SELECT o_custkey, o_orderkey FROM orders QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def topk_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    (o,) = load(spark, sf_dir, "orders")
    return ranking.topk(o, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select("o_custkey", "o_orderkey")


@R.query("neighborhood", "(SELECT o_orderkey FROM orders WHERE o_orderkey < 100 ORDER BY o_orderkey DESC LIMIT 5) UNION ALL (SELECT o_orderkey FROM orders WHERE o_orderkey >= 100 ORDER BY o_orderkey LIMIT 4)")
def neighborhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    (o,) = load(spark, sf_dir, "orders")
    return ranking.neighborhood(o.select("o_orderkey"), [F.col("o_orderkey")], F.col("o_orderkey") >= 100, 5, 3)


@R.query("upsert_latest", "SELECT user_id, arg_max(event_id, ts) AS event_id FROM events GROUP BY user_id")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    (e,) = load(spark, sf_dir, "events")
    return ranking.latest_by_key(e.select("user_id", "event_id", "ts"), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id")


R.sql("sorted_collection", "SELECT n_regionkey, array_join(sort_array(collect_list(n_name)), ',') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")

# Sets
_A, _B = "SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 45", "SELECT l_partkey AS k FROM lineitem WHERE l_discount > 0.08"
for _name, _op in {"union_all": "UNION ALL", "union": "UNION", "except": "EXCEPT", "except_all": "EXCEPT ALL", "intersect": "INTERSECT", "intersect_all": "INTERSECT ALL"}.items():
    R.sql(f"set_{_name}", f"{_A} {_op} {_B}")
R.sql("set_minus", f"{_A} MINUS {_B}", f"{_A} EXCEPT {_B}")


@R.query("set_api", f"({_A} INTERSECT {_B}) UNION ALL ({_A} EXCEPT {_B})")
def set_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    (l,) = load(spark, sf_dir, "lineitem")
    a, b = l.where("l_quantity > 45").select(F.col("l_partkey").alias("k")), l.where("l_discount > 0.08").select(F.col("l_partkey").alias("other"))
    return setops.union_all(setops.intersect(a, b), setops.except_(a, b))
