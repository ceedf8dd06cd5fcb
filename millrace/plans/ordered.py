"""Sequences, limits, pages and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import versions as V
from millrace.operators import relational as R
from millrace.operators import sequences as Q
from millrace.operators.numbering import numbered
from millrace.registry import query
from millrace.sources.tables import table, tables


@query(
    "feature_locf",
    """SELECT event_id, user_id, lower(left(coalesce(last_value(CASE WHEN event_type IN ('signup', 'error') THEN event_type END IGNORE NULLS)
    OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 'No'), 3)) AS carried FROM events""",
)
def feature_locf(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("state", F.when(F.col("event_type").isin("signup", "error"), F.col("event_type")))
    return Q.carried_forward(e, "user_id", ["ts", "event_id"], "state").select("event_id", "user_id", "carried")


@query(
    "feature_walk",
    """WITH RECURSIVE s AS (SELECT user_id, event_type, CASE o % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'Obsolete' ELSE 'Partial' END AS state, row_number() OVER (PARTITION BY user_id ORDER BY o) AS n
    FROM (SELECT user_id, event_type, min(event_id) AS o FROM events GROUP BY 1, 2)),
    d AS (SELECT * FROM (VALUES (1, 'view'), (2, 'click'), (3, 'signup'), (4, 'purchase')) v(p, version)),
    r AS (SELECT DISTINCT user_id, 0 AS p, 1::BIGINT AS n, 'No' AS cur FROM s
    UNION ALL SELECT r.user_id, d.p, CASE WHEN s.n IS NULL THEN r.n ELSE r.n + 1 END, coalesce(s.state, r.cur) FROM r JOIN d ON d.p = r.p + 1 LEFT JOIN s ON s.user_id = r.user_id AND s.n = r.n AND s.event_type = d.version)
    SELECT user_id, version, lower(left(cur, 3)) AS carried FROM r JOIN d USING (p)""",
)
def feature_walk(spark: SparkSession, sf: str) -> DataFrame:
    """Each user names the kinds of event in the order of their first ones; 'error' is not displayed and stops the walk."""
    named = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("o"))
    state = F.when(F.col("o") % 3 == 0, "Yes").when(F.col("o") % 3 == 1, "Obsolete").otherwise("Partial")
    return Q.walked(named.withColumn("state", state), "user_id", "o", "event_type", "state", ["view", "click", "signup", "purchase"])


@query(
    "priority_decay",
    """SELECT o_orderkey, url, prio FROM (SELECT o_orderkey, unnest(CASE WHEN y = 2000 THEN ['docs/' || y, 'docs/current'] ELSE ['docs/' || y] END) AS url,
    unnest(CASE WHEN y = 2000 THEN [p, 1.0] ELSE [p] END)::DOUBLE AS prio FROM (SELECT o_orderkey, year(o_orderdate) AS y,
    CASE WHEN o_orderstatus = 'P' THEN 0.1 ELSE round(greatest(0.8 - 0.1 * dense_rank() OVER (ORDER BY year(o_orderdate) DESC), 0.1), 1) END AS p FROM orders))""",
)
def priority_decay(spark: SparkSession, sf: str) -> DataFrame:
    """Each older version counts a tenth less; test versions are pinned to 0.1, and the
    current one is listed a second time at 1.0. Versions are few, so they are ranked apart
    from the pages."""
    o = table(spark, sf, "orders").withColumn("y", F.year("o_orderdate"))
    years = o.select("y").distinct().withColumn("r", F.row_number().over(Window.orderBy(F.desc("y"))))
    p = F.when(F.col("o_orderstatus") == "P", 0.1).otherwise(Q.decayed_priority(F.col("r")))
    own = F.struct(F.concat(F.lit("docs/"), "y").alias("url"), p.alias("prio"))
    current = F.struct(F.lit("docs/current").alias("url"), F.lit(1.0).alias("prio"))
    rows = F.explode(F.when(F.col("y") == 2000, F.array(own, current)).otherwise(F.array(own)))
    return o.join(F.broadcast(years), "y").select("o_orderkey", rows.alias("s")).select("o_orderkey", "s.url", "s.prio")


@query("age_score", "SELECT o_orderkey, round(0.5 - least(date_diff('day', o_orderdate, TIMESTAMP '2000-01-01') / 365.0, 4.0) / 10, 6)::DOUBLE AS score FROM orders")
def age_score(spark: SparkSession, sf: str) -> DataFrame:
    now = F.lit("2000-01-01").cast("date")
    return table(spark, sf, "orders").select("o_orderkey", F.round(Q.age_score(F.col("o_orderdate").cast("date"), now), 6).alias("score"))


@query(
    "prev_next_gappy",
    "SELECT o_orderkey, lag(o_orderkey) OVER w AS next, lead(o_orderkey) OVER w AS previous FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)",
)
def prev_next_gappy(spark: SparkSession, sf: str) -> DataFrame:
    """The list runs downwards, so the next version is the row before."""
    out = Q.neighbours(table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], "o_orderkey")
    return out.select("o_orderkey", F.col("previous").alias("next"), F.col("next").alias("previous"))


@query(
    "staggered_schedule",
    "SELECT event_id, min(ts) OVER (PARTITION BY event_type) + to_minutes(30 * row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id)) AS sendat FROM events",
)
def staggered_schedule(spark: SparkSession, sf: str) -> DataFrame:
    return Q.staggered(table(spark, sf, "events"), "event_type", "ts", "event_id").select("event_id", "sendat")


@query("position_number", "SELECT o_orderkey, (row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) + 40)::INT AS position FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20)")
def position_number(spark: SparkSession, sf: str) -> DataFrame:
    best = table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)
    return best.select("o_orderkey", (F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey")) + 40).alias("position"))


@query("parity_layout", "SELECT n_name, ((row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1) % 2)::INT AS col FROM nation")
def parity_layout(spark: SparkSession, sf: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_name"))
    return table(spark, sf, "nation").select("n_name", ((place - 1) % 2).alias("col"))


@query(
    "home_union_dependent_limit",
    """WITH a AS (SELECT event_id, ts FROM events WHERE event_type = 'signup' AND ts < TIMESTAMP '2024-01-01 06:00:00'),
    b AS (SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) AS r FROM events WHERE event_type <> 'error')
    SELECT event_id, ts FROM a UNION SELECT event_id, ts FROM b WHERE r <= 30 - (SELECT count(*) FROM a)""",
)
def home_union_dependent_limit(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "ts", "event_type")
    early = e.where((F.col("event_type") == "signup") & (F.col("ts") < F.lit("2024-01-01 06:00:00").cast("timestamp_ntz")))
    return R.fill_up(early.drop("event_type"), e.where("event_type <> 'error'").drop("event_type"), 30, F.col("ts"), F.col("event_id"))


@query(
    "keyset_page",
    """WITH p AS (SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders WHERE o_orderdate <= TIMESTAMP '2000-06-01')
    SELECT o_orderkey, o_orderdate, (SELECT max(o_orderdate) FROM p WHERE r = 10) AS next FROM p WHERE r <= 10""",
)
def keyset_page(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    start = F.lit("2000-06-01").cast("timestamp_ntz")
    return R.keyset_page(o.where(F.col("o_orderdate") <= start), "o_orderdate", "o_orderkey", 10)


@query("offset_page", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 1000 AND r > 40 AND r <= 60")
def offset_page(spark: SparkSession, sf: str) -> DataFrame:
    return R.page_of(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 40, 20, F.desc("o_totalprice"), F.col("o_orderkey")).select("o_orderkey")


@query("exact_or_newest", "SELECT o_orderkey FROM orders ORDER BY (o_orderpriority = '3-MEDIUM') DESC, o_orderdate DESC, o_orderkey LIMIT 1")
def exact_or_newest(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").orderBy((F.col("o_orderpriority") == "3-MEDIUM").desc(), F.desc("o_orderdate"), "o_orderkey").limit(1).select("o_orderkey")


@query(
    "natural_version_sort",
    """SELECT version, row_number() OVER (ORDER BY key DESC, version)::INT AS place FROM (SELECT version,
    CASE WHEN regexp_matches(version, '^v[0-9]+\\.[0-9]+$') THEN (CASE WHEN split_part(version[2:], '.', 1)::INT >= 10 THEN 'a' ELSE '' END) || split_part(version[2:], '.', 1) || lpad(split_part(version[2:], '.', 2), 2, '0')
    WHEN regexp_matches(version, '^v[0-9]+$') THEN 'a' || version[2:] || '0' ELSE version END AS key
    FROM (SELECT DISTINCT CASE WHEN p_size % 7 = 0 THEN 'v' || p_size ELSE 'v' || (p_size % 14) || '.' || p_size END AS version FROM part))""",
)
def natural_version_sort(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    name = F.when(size % 7 == 0, F.concat(F.lit("v"), size)).otherwise(F.concat(F.lit("v"), size % 14, F.lit("."), size))
    v = table(spark, sf, "part").select(name.alias("version")).distinct()
    return numbered(v, "place", F.desc(V.sort_key(F.col("version"))), F.asc("version")).withColumn("place", F.col("place").cast("int"))


@query("ci_sort", "SELECT doc_id, row_number() OVER (ORDER BY lower(text), doc_id) AS place FROM documents")
def ci_sort(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.lower("text").alias("low"))
    return numbered(docs, "place", F.asc("low"), F.asc("doc_id")).select("doc_id", "place")


@query("random_sample_sorted")
def random_sample_sorted(spark: SparkSession, sf: str) -> DataFrame:
    """Five random rows of the whole table, with a stated seed, then sorted."""
    return table(spark, sf, "supplier").orderBy(F.rand(7)).limit(5).orderBy("s_nationkey", "s_suppkey").select("s_suppkey", "s_nationkey")


@query("topk_tiebreak", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 7")
def topk_tiebreak(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(7).select("o_orderkey", "o_orderdate")


@query("topk_made_total", "SELECT c_custkey, c_nationkey FROM customer ORDER BY c_nationkey DESC, c_custkey LIMIT 10")
def topk_made_total(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").orderBy(F.desc("c_nationkey"), "c_custkey").limit(10).select("c_custkey", "c_nationkey")


@query("capped_made_ordered", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 100")
def capped_made_ordered(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").orderBy("c_custkey").limit(100).select("c_custkey")


@query("mixed_direction_sort", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderstatus, nullif(o_orderpriority, '5-LOW') DESC NULLS FIRST, o_orderkey)::INT AS place FROM orders")
def mixed_direction_sort(spark: SparkSession, sf: str) -> DataFrame:
    """Null places are spelled out."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("prio"))
    return numbered(o, "place", F.asc("o_orderstatus"), F.desc_nulls_first("prio"), F.asc("o_orderkey")).select("o_orderkey", F.col("place").cast("int").alias("place"))


@query("slice_after", "SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY r) AS keys FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r BETWEEN 3 AND 5 GROUP BY 1")
def slice_after(spark: SparkSession, sf: str) -> DataFrame:
    """Elements three to five of each list; only five of each are kept before they are put together."""
    first = R.top_per(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], 5, F.col("o_orderkey"))
    lists = first.groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("a"))
    return lists.where(F.size("a") >= 3).select("o_custkey", F.array_join(F.slice("a", 3, 3).cast("array<string>"), ",").alias("keys"))


@query("first_by_default_order", "SELECT s_suppkey FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 1")
def first_by_default_order(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(1).select("s_suppkey")


@query("latest_n_per_owner", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders WHERE o_orderkey <> 42) WHERE r <= 10")
def latest_n_per_owner(spark: SparkSession, sf: str) -> DataFrame:
    others = table(spark, sf, "orders").where("o_orderkey <> 42")
    return R.top_per(others, ["o_custkey"], 10, F.desc("o_orderdate"), F.col("o_orderkey")).select("o_custkey", "o_orderkey")


@query("recent_window_desc", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 1 DAY AND event_type = 'purchase' ORDER BY ts DESC, event_id LIMIT 40")
def recent_window_desc(spark: SparkSession, sf: str) -> DataFrame:
    since = F.lit("2024-01-29").cast("timestamp_ntz")
    return table(spark, sf, "events").where((F.col("ts") >= since) & (F.col("event_type") == "purchase")).orderBy(F.desc("ts"), "event_id").limit(40).select("event_id", "ts")


@query("set_added_removed", "SELECT CASE WHEN b IS NULL THEN 'removed' ELSE 'added' END AS change, coalesce(a, b) AS name FROM (SELECT n_name AS a FROM nation WHERE n_nationkey < 15) FULL JOIN (SELECT n_name AS b FROM nation WHERE n_nationkey > 4) ON a = b WHERE a IS NULL OR b IS NULL")
def set_added_removed(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    old, new = n.where("n_nationkey < 15").select("n_name"), n.where("n_nationkey > 4").select("n_name")
    gone = old.exceptAll(new).select(F.lit("removed").alias("change"), F.col("n_name").alias("name"))
    return gone.union(new.exceptAll(old).select(F.lit("added").alias("change"), F.col("n_name").alias("name")))


@query("static_union", "SELECT 'list/' AS url, 0.8::DOUBLE AS prio UNION ALL SELECT 'sponsors/', 0.5 UNION ALL SELECT 'region/' || r_regionkey, 0.3 FROM region")
def static_union(spark: SparkSession, sf: str) -> DataFrame:
    fixed = spark.createDataFrame([("list/", 0.8), ("sponsors/", 0.5)], "url string, prio double")
    return fixed.union(table(spark, sf, "region").select(F.concat(F.lit("region/"), "r_regionkey"), F.lit(0.3)))


@query("email_view_union_all", "SELECT 'customer' AS kind, c_custkey AS id, lower(c_name) AS login FROM customer UNION ALL SELECT 'supplier', s_suppkey, lower(s_name) FROM supplier WHERE s_acctbal > 0")
def email_view_union_all(spark: SparkSession, sf: str) -> DataFrame:
    c, s = tables(spark, sf, "customer supplier")
    one = c.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.lower("c_name").alias("login"))
    return one.unionByName(s.where("s_acctbal > 0").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.lower("s_name").alias("login")))


@query(
    "sitemap_union",
    """SELECT 'orders/' || o_orderkey AS url, round(0.5 - least(date_diff('day', o_orderdate, TIMESTAMP '2001-08-01') / 365.0, 4.0) / 10, 4)::DOUBLE AS prio, o_orderdate AS lastmod FROM orders
    UNION ALL SELECT 'parts/' || p_partkey, NULL, NULL FROM part WHERE p_size = 1 UNION ALL SELECT 'regions', 0.9, NULL""",
)
def sitemap_union(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of several providers; priority and date may be missing."""
    o, p = tables(spark, sf, "orders part")
    now = F.lit("2001-08-01").cast("date")
    score = F.round(Q.age_score(F.col("o_orderdate").cast("date"), now), 4)
    orders = o.select(F.concat(F.lit("orders/"), "o_orderkey").alias("url"), score.alias("prio"), F.col("o_orderdate").alias("lastmod"))
    parts = p.where("p_size = 1").select(F.concat(F.lit("parts/"), "p_partkey").alias("url"))
    fixed = spark.createDataFrame([("regions", 0.9)], "url string, prio double")
    return orders.unionByName(parts, allowMissingColumns=True).unionByName(fixed, allowMissingColumns=True)
