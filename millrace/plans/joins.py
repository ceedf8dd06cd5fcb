"""Joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import relational as R
from millrace.registry import query
from millrace.sources.tables import table, tables


@query("join_inner_ranked", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_inner_ranked(spark: SparkSession, sf: str) -> DataFrame:
    n, r = tables(spark, sf, "nation region")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@query(
    "patch_affected_arrays",
    """SELECT p_partkey, string_agg(s_name, ',' ORDER BY s_suppkey DESC) AS names, string_agg(s_suppkey::VARCHAR, ',' ORDER BY s_suppkey DESC) AS keys
    FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE p_size < 10 GROUP BY 1""",
)
def patch_affected_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """Two parallel lists per row over a bridge, newest first; rows without partners vanish."""
    l, p, s = tables(spark, sf, "lineitem part supplier")
    bridge = l.select("l_partkey", "l_suppkey").distinct()
    rows = p.where("p_size < 10").join(bridge, F.col("p_partkey") == F.col("l_partkey")).join(s, F.col("s_suppkey") == F.col("l_suppkey"))
    down = -F.col("s_suppkey")
    return rows.groupBy("p_partkey").agg(R.joined_text("s_name", ",", down).alias("names"), R.joined_text("s_suppkey", ",", down).alias("keys"))


@query(
    "patch_filtered_vs_exists",
    """SELECT p_partkey, (SELECT count(DISTINCT l_suppkey) FROM lineitem WHERE l_partkey = p_partkey) AS suppliers FROM part
    WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_suppkey = 7)""",
)
def patch_filtered_vs_exists(spark: SparkSession, sf: str) -> DataFrame:
    """Rows with some partner 7, each still counted over all its partners."""
    l, p = tables(spark, sf, "lineitem part")
    counts = l.groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("suppliers"))
    wanted = p.join(l.where("l_suppkey = 7"), F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey")
    return wanted.join(counts, F.col("p_partkey") == F.col("l_partkey")).select("p_partkey", "suppliers")


@query(
    "changelog_emails_filter_agg",
    """SELECT c_custkey, n_name, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) FILTER (WHERE o_orderstatus = 'P'), '') AS open_orders
    FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN orders ON o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2000-01-01' GROUP BY 1, 2""",
)
def changelog_emails_filter_agg(spark: SparkSession, sf: str) -> DataFrame:
    """A filtered list aggregate: empty, not missing, where nothing fits."""
    c, n, o = tables(spark, sf, "customer nation orders")
    recent = o.where(F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz"))
    rows = c.join(n, F.col("n_nationkey") == F.col("c_nationkey")).join(recent, F.col("o_custkey") == F.col("c_custkey"), "left")
    held = F.filter(F.array_sort(F.collect_list(F.when(F.col("o_orderstatus") == "P", F.col("o_orderkey")))), lambda x: x.isNotNull())
    return rows.groupBy("c_custkey", "n_name").agg(F.array_join(held.cast("array<string>"), ",").alias("open_orders"))


@query(
    "alias_existence_or",
    "SELECT p_partkey FROM part WHERE p_partkey = 11 OR p_partkey IN (SELECT l_suppkey FROM lineitem WHERE l_partkey = 11) OR p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_suppkey = 11)",
)
def alias_existence_or(spark: SparkSession, sf: str) -> DataFrame:
    """A key itself or its aliases in either direction."""
    l, p = tables(spark, sf, "lineitem part")
    one = spark.range(11, 12).select(F.col("id").alias("k"))
    there = l.where("l_partkey = 11").select(F.col("l_suppkey").alias("k"))
    back = l.where("l_suppkey = 11").select(F.col("l_partkey").alias("k"))
    return p.join(one.union(there).union(back).distinct(), F.col("p_partkey") == F.col("k"), "left_semi").select("p_partkey")


@query(
    "version_series_expand",
    "SELECT o_orderkey, unnest(range(0, (o_orderkey % 3) + 1)) AS minor FROM orders UNION ALL SELECT * FROM (VALUES (-1::BIGINT, 0::BIGINT), (-2, 0))",
)
def version_series_expand(spark: SparkSession, sf: str) -> DataFrame:
    """A number series per row, and constant rows appended."""
    o = table(spark, sf, "orders")
    last = F.col("o_orderkey") % 3
    rows = o.where(last >= 0).select("o_orderkey", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("minor"))
    return rows.union(spark.createDataFrame([(-1, 0), (-2, 0)], "o_orderkey long, minor long"))


@query(
    "eager_join_inner_left",
    "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON r_regionkey = nullif(n_regionkey, 2)",
)
def eager_join_inner_left(spark: SparkSession, sf: str) -> DataFrame:
    """Inner over a required key, left over one that may be missing."""
    c, n, r = tables(spark, sf, "customer nation region")
    return (
        c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(r, F.col("r_regionkey") == F.nullif("n_regionkey", F.lit(2)), "left")
        .select("c_custkey", "n_name", "r_name")
    )


@query(
    "prefetch_children",
    "SELECT r_name, coalesce(string_agg(n_name, ',' ORDER BY n_name), '') AS nations FROM region LEFT JOIN (SELECT * FROM nation WHERE n_nationkey > 4) ON n_regionkey = r_regionkey GROUP BY 1",
)
def prefetch_children(spark: SparkSession, sf: str) -> DataFrame:
    n, r = tables(spark, sf, "nation region")
    kids = n.where("n_nationkey > 4").groupBy("n_regionkey").agg(R.joined_text("n_name", ",", F.col("n_name")).alias("nations"))
    return r.join(kids, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("r_name", F.coalesce("nations", F.lit("")).alias("nations"))


@query(
    "queue_left_join_label",
    """SELECT event_id, CASE event_type WHEN 'click' THEN 'URL' WHEN 'view' THEN 'XKey' ELSE event_type END AS mode, name FROM events
    LEFT JOIN (VALUES (1, 'one'), (2, 'two')) c(id, name) ON c.id = events.user_id % 4""",
)
def queue_left_join_label(spark: SparkSession, sf: str) -> DataFrame:
    consumers = spark.createDataFrame([(1, "one"), (2, "two")], "id long, name string")
    mode = F.when(F.col("event_type") == "click", "URL").when(F.col("event_type") == "view", "XKey").otherwise(F.col("event_type"))
    e = table(spark, sf, "events")
    return e.join(F.broadcast(consumers), F.col("id") == F.col("user_id") % 4, "left").select("event_id", mode.alias("mode"), "name")


@query(
    "semi_anti_orphans",
    """SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_orderdate >= TIMESTAMP '2001-01-01') AS has FROM customer""",
)
def semi_anti_orphans(spark: SparkSession, sf: str) -> DataFrame:
    c, o = tables(spark, sf, "customer orders")
    late = o.where((F.col("o_orderstatus") == "P") & (F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz")))
    on = F.col("o_custkey") == F.col("c_custkey")
    with_ = c.join(late, on, "left_semi").select("c_custkey", F.lit(True).alias("has"))
    without = c.join(late, on, "left_anti").select("c_custkey", F.lit(False).alias("has"))
    return with_.union(without)


@query(
    "update_from_counts",
    "SELECT n_nationkey, coalesce(k, 100 + n_nationkey) AS pagecount FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS k FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) ON s_nationkey = n_nationkey",
)
def update_from_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts written back; a key without rows keeps the old count."""
    n, s = tables(spark, sf, "nation supplier")
    counts = s.where("s_acctbal > 5000").groupBy("s_nationkey").agg(F.count("*").alias("k"))
    return n.join(counts, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("n_nationkey", F.coalesce("k", (100 + F.col("n_nationkey")).cast("long")).alias("pagecount"))


@query("join_decimal_key", "SELECT p_partkey, v AS version FROM part JOIN (VALUES (1.5::DECIMAL(3,1), 'a'), (2.0, 'b'), (9.6, 'c')) x(k, v) ON (p_size / 5.0)::DECIMAL(3,1) = k")
def join_decimal_key(spark: SparkSession, sf: str) -> DataFrame:
    """Both sides of a decimal key in one type."""
    versions = spark.createDataFrame([("1.5", "a"), ("2.0", "b"), ("9.6", "c")], "k string, v string").withColumn("k", F.col("k").cast("decimal(3,1)"))
    p = table(spark, sf, "part").withColumn("d", (F.col("p_size") / 5.0).cast("decimal(3,1)"))
    return p.join(F.broadcast(versions), F.col("d") == F.col("k")).select("p_partkey", F.col("v").alias("version"))


@query("join_limited_subquery", "SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal < 0 ORDER BY c_acctbal, c_custkey LIMIT 1) JOIN orders ON o_custkey = c_custkey")
def join_limited_subquery(spark: SparkSession, sf: str) -> DataFrame:
    c, o = tables(spark, sf, "customer orders")
    one = c.where("c_acctbal < 0").orderBy("c_acctbal", "c_custkey").limit(1)
    return o.join(F.broadcast(one), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "o_orderkey")


@query("join_cross", "SELECT r_name, n_nationkey FROM region, nation WHERE n_nationkey < 3")
def join_cross(spark: SparkSession, sf: str) -> DataFrame:
    n, r = tables(spark, sf, "nation region")
    return r.crossJoin(F.broadcast(n.where("n_nationkey < 3"))).select("r_name", "n_nationkey")


@query(
    "cdc_join_sites",
    "SELECT user_id, site, max(ts) AS changed FROM events JOIN (VALUES ('purchase', 1), ('signup', 2), ('signup', 3)) s(kind, site) ON kind = event_type GROUP BY 1, 2",
)
def cdc_join_sites(spark: SparkSession, sf: str) -> DataFrame:
    """A change goes to each site that wants its kind; repeats collapse to the last."""
    sites = spark.createDataFrame([("purchase", 1), ("signup", 2), ("signup", 3)], "kind string, site int")
    e = table(spark, sf, "events")
    return e.join(F.broadcast(sites), F.col("kind") == F.col("event_type")).groupBy("user_id", "site").agg(F.max("ts").alias("changed"))


@query("dict_lookup_join", "SELECT p_partkey, coalesce(t, p_type) AS name FROM part LEFT JOIN (VALUES ('SMALL', 'klein'), ('LARGE', 'gross')) d(k, t) ON k = p_type")
def dict_lookup_join(spark: SparkSession, sf: str) -> DataFrame:
    names = spark.createDataFrame([("SMALL", "klein"), ("LARGE", "gross")], "k string, t string")
    return table(spark, sf, "part").join(F.broadcast(names), F.col("k") == F.col("p_type"), "left").select("p_partkey", F.coalesce("t", "p_type").alias("name"))


@query("view_union_join", "SELECT s_name AS name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT c_name, 'primary' FROM customer")
def view_union_join(spark: SparkSession, sf: str) -> DataFrame:
    s, n, c = tables(spark, sf, "supplier nation customer")
    joined = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("name"), "n_name")
    return joined.unionByName(c.select(F.col("c_name").alias("name"), F.lit("primary").alias("n_name")))


@query("insert_select_join", "SELECT n_nationkey, 'w' || w AS product FROM nation JOIN (VALUES ('NATION_1', 10), ('NATION_3', 20), ('NOWHERE', 30)) x(nm, w) ON nm = n_name")
def insert_select_join(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame([("NATION_1", 10), ("NATION_3", 20), ("NOWHERE", 30)], "nm string, w int")
    return table(spark, sf, "nation").join(rows, F.col("nm") == F.col("n_name")).select("n_nationkey", F.concat(F.lit("w"), "w").alias("product"))


@query("scalar_lookup", "SELECT p_partkey, (SELECT r_regionkey FROM region WHERE r_name = 'ASIA') AS region FROM part WHERE p_size > (SELECT avg(p_size) FROM part)")
def scalar_lookup(spark: SparkSession, sf: str) -> DataFrame:
    p, r = tables(spark, sf, "part region")
    mean = p.agg(F.avg("p_size").alias("mean"))
    asia = r.where("r_name = 'ASIA'").select(F.col("r_regionkey").alias("region"))
    return p.crossJoin(F.broadcast(mean)).where("p_size > mean").crossJoin(F.broadcast(asia)).select("p_partkey", "region")


@query(
    "nested_group_translated",
    """SELECT p_type AS grp, coalesce(t, p_brand) AS name, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS parts FROM part
    LEFT JOIN (VALUES ('Brand#1', 'eins'), ('Brand#2', 'zwei')) d(k, t) ON k = p_brand WHERE p_size > 45 GROUP BY 1, 2""",
)
def nested_group_translated(spark: SparkSession, sf: str) -> DataFrame:
    names = spark.createDataFrame([("Brand#1", "eins"), ("Brand#2", "zwei")], "k string, t string")
    p = table(spark, sf, "part").where("p_size > 45").join(F.broadcast(names), F.col("k") == F.col("p_brand"), "left")
    return p.groupBy(F.col("p_type").alias("grp"), F.coalesce("t", "p_brand").alias("name")).agg(R.joined_text("p_partkey", ",", F.col("p_partkey")).alias("parts"))


@query("left_join_size_default", "SELECT doc_id, coalesce(length(text), 0)::BIGINT AS size FROM labels LEFT JOIN (SELECT * FROM documents WHERE doc_id % 2 = 0) USING (doc_id)")
def left_join_size_default(spark: SparkSession, sf: str) -> DataFrame:
    """0 where there is no file to a row."""
    d, l = tables(spark, sf, "documents labels")
    sizes = d.where("doc_id % 2 = 0").select("doc_id", F.length("text").cast("long").alias("n"))
    return l.join(sizes, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("size"))


@query(
    "allow_list_violations",
    """SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey IN (SELECT tag FROM (VALUES (1, 3), (1, 29), (4, 1), (7, 5)) a(tag, org))
    AND NOT EXISTS (SELECT 1 FROM (VALUES (1, 3), (1, 29), (4, 1), (7, 5)) a(tag, org) WHERE tag = s_nationkey AND org = s_suppkey)""",
)
def allow_list_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Tags with an allow list, used by one who is not on it; without a list all may."""
    allow = F.broadcast(spark.createDataFrame([(1, 3), (1, 29), (4, 1), (7, 5)], "tag int, org long"))
    listed = table(spark, sf, "supplier").join(allow, F.col("tag") == F.col("s_nationkey"), "left_semi")
    return listed.join(allow, (F.col("tag") == F.col("s_nationkey")) & (F.col("org") == F.col("s_suppkey")), "left_anti").select("s_suppkey", "s_nationkey")
