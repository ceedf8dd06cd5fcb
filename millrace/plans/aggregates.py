"""Aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators import relational as R
from millrace.registry import query
from millrace.sources.tables import table, tables


@query("dup_key_count", "SELECT count(*) AS n FROM (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)")
def dup_key_count(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("text").count().where(F.col("count") > 1).agg(F.count("*").alias("n"))


@query("lag_max_coalesce", "SELECT coalesce(max(date_diff('second', ts, TIMESTAMP '2024-02-01')), 0)::BIGINT AS lag_s, coalesce(max(CASE WHEN event_type = 'none' THEN 1 END), 0)::BIGINT AS none FROM events")
def lag_max_coalesce(spark: SparkSession, sf: str) -> DataFrame:
    lag = F.expr("timestampdiff(SECOND, date_trunc('SECOND', ts), timestamp_ntz '2024-02-01')")
    return table(spark, sf, "events").agg(
        F.coalesce(F.max(lag), F.lit(0)).cast("long").alias("lag_s"),
        F.coalesce(F.max(F.when(F.col("event_type") == "none", 1)), F.lit(0)).cast("long").alias("none"),
    )


@query("distinct_on_first", "SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1")
def distinct_on_first(spark: SparkSession, sf: str) -> DataFrame:
    return R.first_per(table(spark, sf, "orders"), ["o_custkey"], F.col("o_orderdate"), F.col("o_orderkey")).select("o_custkey", "o_orderkey", "o_orderdate")


@query("consecutive_group_lists", "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_nationkey) AS nations FROM nation GROUP BY 1")
def consecutive_group_lists(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").groupBy("n_regionkey").agg(R.joined_text("n_name", "|", F.col("n_nationkey")).alias("nations"))


@query("listagg_names", "SELECT string_agg(r_name, ', ' ORDER BY r_name) AS names FROM region")
def listagg_names(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "region").createOrReplaceTempView("millrace_region")
    return spark.sql("SELECT listagg(r_name, ', ') WITHIN GROUP (ORDER BY r_name) AS names FROM millrace_region")


@query(
    "wide_sum_percent",
    """SELECT flag, n, round(CASE WHEN total = 0 THEN 0 ELSE 100.0 * n / total END, 4)::DOUBLE AS percent
    FROM (SELECT *, (sum(n) OVER ())::BIGINT AS total FROM (SELECT l_returnflag AS flag, count(*) AS n FROM lineitem GROUP BY 1))""",
)
def wide_sum_percent(spark: SparkSession, sf: str) -> DataFrame:
    """Counters in columns turned into rows, each with its share of the sum."""
    wide = table(spark, sf, "lineitem").groupBy().pivot("l_returnflag", ["A", "N", "R"]).count()
    rows = wide.unpivot([], ["A", "N", "R"], "flag", "n").withColumn("total", F.sum("n").over(Window.partitionBy()))
    return rows.select("flag", "n", F.round(F.when(F.col("total") == 0, 0.0).otherwise(100.0 * F.col("n") / F.col("total")), 4).alias("percent"))


@query(
    "canonical_argmax",
    "SELECT o_custkey, coalesce(max(CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderkey END), arg_max(o_orderkey, o_orderdate::VARCHAR || lpad(o_orderkey::VARCHAR, 12, '0'))) AS canonical FROM orders GROUP BY 1",
)
def canonical_argmax(spark: SparkSession, sf: str) -> DataFrame:
    """The marked row wins if there is one, else that of the latest date."""
    marked = F.max(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderkey")))
    latest = F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey"))
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.coalesce(marked, latest).alias("canonical"))


@query(
    "count_in_period",
    "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 12 HOUR PRECEDING AND CURRENT ROW) AS n FROM events",
)
def count_in_period(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return e.select("event_id", F.expr("count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN INTERVAL 12 HOURS PRECEDING AND CURRENT ROW)").alias("n"))


@query("distinct_values", "SELECT DISTINCT event_type, user_id % 5 AS bucket FROM events")
def distinct_values(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_type", (F.col("user_id") % 5).alias("bucket")).distinct()


@query("array_dup_check", "SELECT o_custkey, len(a) <> len(list_distinct(a)) AS repeated FROM (SELECT o_custkey, list(o_orderpriority) AS a FROM orders GROUP BY 1)")
def array_dup_check(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy("o_custkey").agg((F.count("o_orderpriority") != F.count_distinct("o_orderpriority")).alias("repeated"))


@query("collect_by_key", "SELECT p_brand, string_agg(p_partkey::VARCHAR, ' ' ORDER BY p_partkey) AS parts FROM part GROUP BY 1")
def collect_by_key(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").groupBy("p_brand").agg(R.joined_text("p_partkey", " ", F.col("p_partkey")).alias("parts"))


@query("any_true", "SELECT l_orderkey, bool_or(l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1")
def any_true(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("returned"))


@query(
    "mn_child_list",
    "SELECT p_partkey, coalesce((SELECT string_agg(s_name, ', ' ORDER BY s_name) FROM (SELECT DISTINCT s_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_partkey = p_partkey AND l_quantity > 45)), '') AS suppliers FROM part",
)
def mn_child_list(spark: SparkSession, sf: str) -> DataFrame:
    l, p, s = tables(spark, sf, "lineitem part supplier")
    names = l.where("l_quantity > 45").join(s, F.col("s_suppkey") == F.col("l_suppkey")).select("l_partkey", "s_name").distinct()
    lists = names.groupBy("l_partkey").agg(R.joined_text("s_name", ", ", F.col("s_name")).alias("names"))
    return p.join(lists, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", F.coalesce("names", F.lit("")).alias("suppliers"))


@query("remaining_count_check", "SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus <> 'F') AS n, count(*) FILTER (WHERE o_orderstatus <> 'F') > 0 AS allowed FROM orders GROUP BY 1")
def remaining_count_check(spark: SparkSession, sf: str) -> DataFrame:
    """What would be left of each group after the removals."""
    left = F.count_if(F.coalesce(F.col("o_orderstatus") != "F", F.lit(False))).alias("n")
    return table(spark, sf, "orders").groupBy("o_custkey").agg(left).select("o_custkey", "n", (F.col("n") > 0).alias("allowed"))


@query("csv_list", "SELECT string_agg(p_size::VARCHAR, ',' ORDER BY p_size DESC) AS sizes FROM (SELECT DISTINCT p_size FROM part WHERE p_size >= 10)")
def csv_list(spark: SparkSession, sf: str) -> DataFrame:
    sizes = table(spark, sf, "part").where("p_size >= 10").select("p_size").distinct()
    return sizes.agg(R.joined_text("p_size", ",", -F.col("p_size")).alias("sizes"))


@query("pending_by_type", "SELECT * FROM (SELECT 'order' AS kind, count(*) AS n FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'supplier', count(*) FROM supplier WHERE s_acctbal < 0 UNION ALL SELECT 'part', count(*) FROM part WHERE p_size < 0 UNION ALL SELECT 'event', count(*) FROM events WHERE event_type = 'error') WHERE n > 0")
def pending_by_type(spark: SparkSession, sf: str) -> DataFrame:
    """Waiting rows of several kinds; kinds without any are left."""
    parts = {"order": ("orders", "o_orderstatus = 'P'"), "customer": ("customer", "c_acctbal < 0"), "supplier": ("supplier", "s_acctbal < 0"), "part": ("part", "p_size < 0"), "event": ("events", "event_type = 'error'")}
    rows = [table(spark, sf, t).where(c).select(F.lit(k).alias("kind")) for k, (t, c) in parts.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.groupBy("kind").agg(F.count("*").alias("n"))
