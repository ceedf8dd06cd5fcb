"""Projections and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import relational as R
from millrace.registry import query
from millrace.sources.tables import table, tables


def _day(s: str):
    return F.lit(s).cast("timestamp_ntz")


@query("filter_conjunction", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def filter_conjunction(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").where(R.all_of([F.col("o_orderstatus") == "F", F.col("o_orderpriority") == "1-URGENT"])).select("o_orderkey", "o_custkey")


@query("filter_range", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-02-01' AND o_totalprice BETWEEN 1000 AND 200000")
def filter_range(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.where((F.col("o_orderdate") >= _day("1997-01-01")) & (F.col("o_orderdate") < _day("1997-02-01")) & F.col("o_totalprice").between(1000, 200000)).select("o_orderkey", "o_orderdate")


@query("filter_exclude", "SELECT p_partkey, p_type FROM part WHERE NOT (p_type = 'ECONOMY' OR p_size > 10)")
def filter_exclude(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").where(~R.any_of([F.col("p_type") == "ECONOMY", F.col("p_size") > 10])).select("p_partkey", "p_type")


@query("filter_nullness", "SELECT count(*) AS n, count(*) FILTER (WHERE nullif(o_orderstatus, 'P') IS NULL) AS missing, count(*) FILTER (WHERE nullif(o_orderstatus, 'P') IS NOT NULL) AS present FROM orders")
def filter_nullness(spark: SparkSession, sf: str) -> DataFrame:
    s = F.nullif("o_orderstatus", F.lit("P"))
    return table(spark, sf, "orders").agg(F.count("*").alias("n"), F.count(F.when(s.isNull(), 1)).alias("missing"), F.count(F.when(s.isNotNull(), 1)).alias("present"))


@query("filter_in_array", "SELECT c_custkey FROM customer WHERE list_contains(['BUILDING', 'FURNITURE'], c_mktsegment) AND NOT list_contains([1, 2, 3], c_nationkey)")
def filter_in_array(spark: SparkSession, sf: str) -> DataFrame:
    segments, nations = F.array(F.lit("BUILDING"), F.lit("FURNITURE")), F.array(F.lit(1), F.lit(2), F.lit(3))
    return table(spark, sf, "customer").where(F.array_contains(segments, F.col("c_mktsegment")) & ~F.array_contains(nations, F.col("c_nationkey"))).select("c_custkey")


@query("filter_flag_or", "SELECT s_suppkey FROM supplier WHERE (false OR NOT (s_acctbal < 0))")
def filter_flag_or(spark: SparkSession, sf: str) -> DataFrame:
    include_negative = False
    return table(spark, sf, "supplier").where(F.lit(include_negative) | ~(F.col("s_acctbal") < 0)).select("s_suppkey")


@query("filter_via_path", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey = c_nationkey AND r_name = 'ASIA')")
def filter_via_path(spark: SparkSession, sf: str) -> DataFrame:
    c, n, r = tables(spark, sf, "customer nation region")
    asian = n.join(r.where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    return c.join(asian, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select("c_custkey")


@query("owner_semi", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def owner_semi(spark: SparkSession, sf: str) -> DataFrame:
    o, c = tables(spark, sf, "orders customer")
    return o.join(c.where("c_acctbal < 0"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("exists_probe", "SELECT EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 490000) AS large, EXISTS (SELECT 1 FROM orders WHERE o_totalprice < 0) AS negative")
def exists_probe(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    probe = lambda cond, name: o.where(cond).limit(1).agg((F.count("*") > 0).alias(name))
    return probe("o_totalprice > 490000", "large").crossJoin(probe("o_totalprice < 0", "negative"))


@query("filter_regex", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^(red|blue) [a-m]')")
def filter_regex(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").where(F.col("p_name").rlike("^(red|blue) [a-m]")).select("p_partkey", "p_name")


@query("prune_columns", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 48 AND l_returnflag = 'R'")
def prune_columns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").where("l_quantity > 48 AND l_returnflag = 'R'").select("l_orderkey", "l_linenumber")


@query("derived_columns", "SELECT o_orderkey, upper(left(o_orderpriority, 1)) || '-' || o_orderstatus AS label, year(o_orderdate)::INT AS y, o_totalprice > 300000 AS large FROM orders")
def derived_columns(spark: SparkSession, sf: str) -> DataFrame:
    label = F.concat_ws("-", F.upper(F.left("o_orderpriority", F.lit(1))), "o_orderstatus")
    return table(spark, sf, "orders").select("o_orderkey", label.alias("label"), F.year("o_orderdate").alias("y"), (F.col("o_totalprice") > 300000).alias("large"))


@query("label_three_way", "SELECT CASE WHEN p_size > 40 THEN 'current' WHEN p_size > 45 THEN 'devel' WHEN p_size > 20 THEN 'supported' ELSE 'archived' END AS label, count(*) AS n FROM part GROUP BY 1")
def label_three_way(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    label = F.when(size > 40, "current").when(size > 45, "devel").when(size > 20, "supported").otherwise("archived")
    return table(spark, sf, "part").groupBy(label.alias("label")).agg(F.count("*").alias("n"))


@query("lookup_switch", "SELECT c_custkey, CASE WHEN contains(c_name, '#') THEN lower(c_name) ELSE c_mktsegment END AS login FROM customer")
def lookup_switch(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", F.when(F.contains("c_name", F.lit("#")), F.lower("c_name")).otherwise(F.col("c_mktsegment")).alias("login"))


@query(
    "owner_state_listing",
    """SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'pending' ELSE 'in progress' END AS state, count(*) AS n,
    string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS keys FROM orders GROUP BY 1, 2""",
)
def owner_state_listing(spark: SparkSession, sf: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "O", "pending").otherwise("in progress")
    o = table(spark, sf, "orders").withColumn("state", state)
    return o.groupBy("o_custkey", "state").agg(F.count("*").alias("n"), R.joined_text("o_orderkey", ",", F.col("o_orderkey")).alias("keys"))


@query("point_lookup_visible", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 42 AND o_orderstatus <> 'X'")
def point_lookup_visible(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").where("o_orderkey = 42 AND o_orderstatus <> 'X'").select("o_orderkey", "o_totalprice")


@query("released_only", "SELECT p_partkey, p_size FROM part WHERE p_size > 0 AND p_type <> 'PROMO'")
def released_only(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").where("p_size > 0 AND p_type <> 'PROMO'").select("p_partkey", "p_size")


@query("slug_lookup", "SELECT p_partkey, replace(p_name, ' ', '-') AS slug FROM part WHERE replace(p_name, ' ', '-') = 'red-widget' OR p_partkey::VARCHAR = '7'")
def slug_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """A row by its slug, or by an old numeric id."""
    slug = F.replace("p_name", F.lit(" "), F.lit("-"))
    return table(spark, sf, "part").withColumn("slug", slug).where((F.col("slug") == "red-widget") | (F.col("p_partkey").cast("string") == "7")).select("p_partkey", "slug")


@query("icontains_or_search", "SELECT c_custkey FROM customer WHERE c_name ILIKE '%00012%' OR lower(c_mktsegment) = lower('Building') AND c_acctbal > 9000")
def icontains_or_search(spark: SparkSession, sf: str) -> DataFrame:
    cond = R.contains_ci("c_name", "00012") | ((F.lower("c_mktsegment") == "building") & (F.col("c_acctbal") > 9000))
    return table(spark, sf, "customer").where(cond).select("c_custkey")


@query("composed_predicate", "SELECT c_custkey FROM customer WHERE lower(c_name) LIKE '%#00000042%'")
def composed_predicate(spark: SparkSession, sf: str) -> DataFrame:
    makers = {"s": lambda v: R.contains_ci("c_name", v), "n": lambda v: F.col("c_nationkey") == int(v)}
    return table(spark, sf, "customer").where(R.composed({"s": "#00000042"}, makers)).select("c_custkey")


@query("map_keys_missing", "SELECT event_id FROM events WHERE NOT (json_exists(props, '$.k') AND json_exists(props, '$.posted')) AND user_id = 7")
def map_keys_missing(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose map lacks one of the wanted keys."""
    m = F.from_json("props", "map<string,string>")
    keys = F.array(F.lit("k"), F.lit("posted"))
    return table(spark, sf, "events").where(~F.forall(keys, lambda k: F.map_contains_key(m, k)) & (F.col("user_id") == 7)).select("event_id")


@query("dynamic_column_filter", "SELECT c_custkey FROM customer WHERE c_nationkey IN (1, 2, 3, 4, 5) AND c_mktsegment = 'MACHINERY'")
def dynamic_column_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Boolean columns named by the request, from a list of known ones."""
    c = table(spark, sf, "customer").withColumns({"region_west": F.col("c_nationkey").between(1, 5), "provides_tools": F.col("c_mktsegment") == "MACHINERY"})
    return c.where(R.flag_columns(c, {"region": "west", "provides": "tools"}, {"region": ["west"], "provides": ["tools"]})).select("c_custkey")


@query(
    "distinct_from_changes",
    "SELECT c_custkey FROM customer JOIN (SELECT c_custkey AS k, nullif(c_nationkey, 3) AS nk, CASE WHEN c_custkey % 10 = 0 THEN 'NEW' ELSE c_mktsegment END AS seg FROM customer) ON k = c_custkey WHERE (c_nationkey, c_mktsegment) IS DISTINCT FROM (nk, seg)",
)
def distinct_from_changes(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    other = c.select(F.col("c_custkey").alias("k"), F.nullif("c_nationkey", F.lit(3)).alias("nk"), F.when(F.col("c_custkey") % 10 == 0, "NEW").otherwise(F.col("c_mktsegment")).alias("seg"))
    same = F.struct(F.col("c_nationkey").alias("a"), F.col("c_mktsegment").alias("b")).eqNullSafe(F.struct(F.col("nk").alias("a"), F.col("seg").alias("b")))
    return c.join(other, F.col("c_custkey") == F.col("k")).where(~same).select("c_custkey")


@query(
    "regex_exclude_antijoin",
    "SELECT page_id FROM pages WHERE NOT (regexp_matches(url, '/(es|fr)/') OR regexp_matches(url, '[?]') OR starts_with(url, 'https://www.'))",
)
def regex_exclude_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    """Pages that no excluding pattern and no blocked prefix fits."""
    pages = table(spark, sf, "pages")
    rules = spark.createDataFrame([("re", "/(es|fr)/"), ("re", "[?]"), ("prefix", "https://www.")], "kind string, rule string")
    fits = ((F.col("kind") == "re") & F.regexp_like("url", F.col("rule"))) | ((F.col("kind") == "prefix") & F.startswith("url", F.col("rule")))
    return pages.select("page_id", "url").join(F.broadcast(rules), fits, "left_anti").select("page_id")
