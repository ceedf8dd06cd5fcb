"""Merges, upserts, retention and rewrites."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import merge as M
from millrace.operators.snapshot_store import SnapshotStore
from millrace.registry import query
from millrace.sources.shared import shared_dir
from millrace.sources.tables import table, tables

_SPLIT = """WITH o AS (SELECT doc_id, source AS title, n_chars AS size FROM documents WHERE doc_id % 10 <> 0),
n AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'moved' ELSE source END AS title, nullif(n_chars, CASE WHEN doc_id % 13 = 0 THEN n_chars END) AS size FROM documents WHERE doc_id % 10 <> 1)
"""


def _two(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf, "documents")
    old = d.where("doc_id % 10 <> 0").select("doc_id", F.col("source").alias("title"), F.col("n_chars").alias("size"))
    title = F.when(F.col("doc_id") % 7 == 0, "moved").otherwise(F.col("source"))
    size = F.when(F.col("doc_id") % 13 != 0, F.col("n_chars"))
    return old, d.where("doc_id % 10 <> 1").select("doc_id", title.alias("title"), size.alias("size"))


@query("doc_merge_changes", _SPLIT + "SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, CASE WHEN n.doc_id IS NULL THEN 'D' WHEN o.doc_id IS NULL THEN 'I' ELSE 'U' END AS change FROM o FULL JOIN n ON o.doc_id = n.doc_id WHERE n.doc_id IS NULL OR o.doc_id IS NULL OR o.title <> n.title OR o.size <> n.size")
def doc_merge_changes(spark: SparkSession, sf: str) -> DataFrame:
    """A change to null is not seen, as ``<>`` does not see it."""
    old, new = _two(spark, sf)
    return M.merge(old, new, ["doc_id"], ["title", "size"])[0]


@query("doc_merge_snapshot", _SPLIT + "SELECT n.doc_id, CASE WHEN o.doc_id IS NULL OR o.title <> n.title OR o.size <> n.size THEN n.title ELSE o.title END AS title, CASE WHEN o.doc_id IS NULL OR o.title <> n.title OR o.size <> n.size THEN n.size ELSE o.size END AS size FROM n LEFT JOIN o ON o.doc_id = n.doc_id")
def doc_merge_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _two(spark, sf)
    return M.merge(old, new, ["doc_id"], ["title", "size"])[1]


def _store(spark: SparkSession, old: DataFrame) -> SnapshotStore:
    at = f"{shared_dir(spark)}/snapshot-{uuid.uuid4().hex}"
    store = SnapshotStore(spark, at, ("doc_id",), ("title", "size"), buckets=16)
    store.create(old)
    return store


@query("doc_store_changes", _SPLIT + "SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, CASE WHEN n.doc_id IS NULL THEN 'D' WHEN o.doc_id IS NULL THEN 'I' ELSE 'U' END AS change FROM o FULL JOIN n ON o.doc_id = n.doc_id WHERE n.doc_id IS NULL OR o.doc_id IS NULL OR o.title <> n.title OR o.size <> n.size")
def doc_store_changes(spark: SparkSession, sf: str) -> DataFrame:
    """The merge of a stored snapshot; parts that do not change are neither joined nor written."""
    old, new = _two(spark, sf)
    return _store(spark, old).merge(new)


@query("doc_store_snapshot", _SPLIT + "SELECT n.doc_id, CASE WHEN o.doc_id IS NULL OR o.title <> n.title OR o.size <> n.size THEN n.title ELSE o.title END AS title, CASE WHEN o.doc_id IS NULL OR o.title <> n.title OR o.size <> n.size THEN n.size ELSE o.size END AS size FROM n LEFT JOIN o ON o.doc_id = n.doc_id")
def doc_store_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _two(spark, sf)
    store = _store(spark, old)
    store.merge(new)
    return store.read()


@query("upsert_counter", "SELECT user_id, count(*) + CASE WHEN user_id < 50 THEN 5 ELSE 0 END AS logincount, max(ts) AS lastlogin FROM events GROUP BY user_id")
def upsert_counter(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    old = e.where("user_id < 50").groupBy("user_id").agg(F.lit(5).cast("long").alias("logincount"), F.min("ts").alias("lastlogin"))
    return M.upsert_count(old, e.withColumn("lastlogin", F.col("ts")), ["user_id"], "logincount", "lastlogin")


@query("upsert_greatest", "SELECT user_id, greatest(max(ts), TIMESTAMP '2024-01-28') AS changedat FROM events GROUP BY user_id")
def upsert_greatest(spark: SparkSession, sf: str) -> DataFrame:
    """Only ever moves on, so it can be repeated."""
    e = table(spark, sf, "events")
    old = e.select("user_id").distinct().withColumn("changedat", F.lit("2024-01-28").cast("timestamp_ntz"))
    return old.unionByName(e.select("user_id", F.col("ts").alias("changedat"))).groupBy("user_id").agg(F.max("changedat").alias("changedat"))


@query("upsert_excluded", "SELECT coalesce(c_custkey, k) AS c_custkey, coalesce(seg, c_mktsegment) AS c_mktsegment, coalesce(bal, c_acctbal) AS c_acctbal FROM customer FULL JOIN (SELECT c_custkey + 100 AS k, CASE WHEN c_custkey % 2 = 0 THEN 'NEW' END AS seg, 1.5::DOUBLE AS bal FROM customer WHERE c_custkey > 1200) ON k = c_custkey")
def upsert_excluded(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    new = c.where("c_custkey > 1200").select((F.col("c_custkey") + 100).alias("c_custkey"), F.when(F.col("c_custkey") % 2 == 0, "NEW").alias("c_mktsegment"), F.lit(1.5).alias("c_acctbal"))
    return M.upsert_latest(c, new, ["c_custkey"], ["c_mktsegment", "c_acctbal"])


@query("list_sync", "SELECT n_name AS name, CASE WHEN n_nationkey >= 20 THEN 'I' WHEN n_nationkey < 5 THEN 'D' ELSE 'U' END AS change FROM nation WHERE n_nationkey >= 20 OR n_nationkey < 5 OR n_regionkey = 2")
def list_sync(spark: SparkSession, sf: str) -> DataFrame:
    """Lists that came, went or changed; a dry run writes nothing and is this table."""
    n = table(spark, sf, "nation")
    old = n.where("n_nationkey < 20").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("grp"))
    new = n.where("n_nationkey >= 5").select(F.col("n_name").alias("name"), F.when((F.col("n_regionkey") == 2) & (F.col("n_nationkey") < 20), 9).otherwise(F.col("n_regionkey")).alias("grp"))
    return M.merge(old, new, ["name"], ["grp"])[0]


@query("ttl_expire", "SELECT event_id FROM events WHERE NOT (ts < TIMESTAMP '2024-01-31' - INTERVAL 72 HOUR AND event_type = 'signup') AND NOT (ts < TIMESTAMP '2024-01-31' - INTERVAL 24 HOUR AND event_type = 'view')")
def ttl_expire(spark: SparkSession, sf: str) -> DataFrame:
    now = F.lit("2024-01-31").cast("timestamp_ntz")
    rows = M.unexpired(table(spark, sf, "events"), "ts", now, "72 HOURS", F.col("event_type") == "signup")
    return M.unexpired(rows, "ts", now, "24 HOURS", F.col("event_type") == "view").select("event_id")


@query("reparent_keys", "SELECT o_orderkey, CASE WHEN o_custkey = 5 THEN 6 WHEN o_custkey = 7 THEN 6 ELSE o_custkey END AS o_custkey FROM orders")
def reparent_keys(spark: SparkSession, sf: str) -> DataFrame:
    mapping = spark.createDataFrame([(5, 6), (7, 6)], "old long, new long")
    return M.reparent(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", mapping)


@query("scrub_rows", "SELECT c_custkey, 'user' || c_custkey || '@example.com' AS email, left('x' || c_name, 12) AS name, 0.0::DOUBLE AS balance FROM customer")
def scrub_rows(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.select("c_custkey", F.concat(F.lit("user"), "c_custkey", F.lit("@example.com")).alias("email"), F.left(F.concat(F.lit("x"), "c_name"), F.lit(12)).alias("name"), F.lit(0.0).alias("balance"))


@query("single_current", "SELECT s_suppkey, s_suppkey = (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000 ORDER BY s_suppkey DESC LIMIT 1) AS current FROM supplier")
def single_current(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_acctbal") > 5000).alias("current"))
    return M.single_current(s, "current", F.desc("s_suppkey"))


@query("load_count_check", "SELECT count(*) AS loaded, true AS complete FROM documents")
def load_count_check(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    parsed = d.select("doc_id").distinct().agg(F.count("*").alias("parsed"))
    return d.agg(F.count("*").alias("loaded")).crossJoin(parsed).select("loaded", (F.col("loaded") == F.col("parsed")).alias("complete"))


@query("insert_if_absent", "SELECT url, 'old' AS title FROM pages WHERE page_id < 100 UNION ALL SELECT url, 'new' FROM pages WHERE page_id >= 100")
def insert_if_absent(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    old = p.where("page_id < 100").select("url", F.lit("old").alias("title"))
    return M.add_missing(old, p.where("page_id >= 50").select("url", F.lit("new").alias("title")), ["url"])


@query("backfill_case", "SELECT event_id, CASE WHEN event_type = 'signup' THEN 2 WHEN event_type = 'error' THEN 0 ELSE 1 END AS modstate, CASE WHEN user_id % 2 = 0 THEN '{\"feed\":true}' ELSE '{}' END AS posted FROM events")
def backfill_case(spark: SparkSession, sf: str) -> DataFrame:
    state = F.when(F.col("event_type") == "signup", 2).when(F.col("event_type") == "error", 0).otherwise(1)
    posted = F.when(F.col("user_id") % 2 == 0, F.create_map(F.lit("feed"), F.lit(True))).otherwise(F.create_map().cast("map<string,boolean>"))
    return table(spark, sf, "events").select("event_id", state.alias("modstate"), F.to_json(posted).alias("posted"))


@query("predicate_delete", "SELECT p_partkey FROM part WHERE p_type IS DISTINCT FROM 'PROMO'")
def predicate_delete(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").where(~F.col("p_type").eqNullSafe(F.lit("PROMO"))).select("p_partkey")


@query("swap_primary", "SELECT c_custkey, CASE WHEN c_custkey % 50 = 3 THEN 'alt' || c_custkey ELSE c_name END AS main, CASE WHEN c_custkey % 50 = 3 THEN c_name ELSE 'alt' || c_custkey END AS other FROM customer")
def swap_primary(spark: SparkSession, sf: str) -> DataFrame:
    """Two values change places for the chosen rows."""
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("main"), F.concat(F.lit("alt"), "c_custkey").alias("other"))
    swap = F.col("c_custkey") % 50 == 3
    return c.select("c_custkey", F.when(swap, F.col("other")).otherwise(F.col("main")).alias("main"), F.when(swap, F.col("main")).otherwise(F.col("other")).alias("other"))


@query("vote_counts", "SELECT event_type AS question, json_extract_string(props, '$.k')::INT % 8 + 1 AS answer, count(*) AS votes FROM events GROUP BY 1, 2")
def vote_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Votes counted from the log, in place of a counter that is read and written."""
    answer = F.get_json_object("props", "$.k").cast("int") % 8 + 1
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("question"), answer.alias("answer")).agg(F.count("*").alias("votes"))


@query("pin_reconcile", "SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'a' WHEN user_id % 3 = 1 THEN 'a,b' ELSE '' END AS to_set, CASE WHEN user_id % 2 = 0 THEN 'c' ELSE '' END AS to_drop FROM events")
def pin_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """Wanted against actual pins of each provider."""
    u = F.col("user_id")
    pair = lambda *kv: F.create_map(*[F.lit(x) for x in kv])
    want = F.when(u % 3 == 2, pair("b", "1")).otherwise(pair("a", "1", "b", "1"))
    have = F.when(u % 3 == 1, pair("z", "1")).otherwise(pair("b", "1"))
    have = F.map_concat(F.map_filter(have, lambda k, v: k != "z"), F.map_filter(pair("c", "9"), lambda k, v: u % 2 == 0))
    to_set, to_drop = M.reconcile(want, have)
    return table(spark, sf, "events").select("event_id", F.array_join(to_set, ",").alias("to_set"), F.array_join(to_drop, ",").alias("to_drop"))


@query("bulk_flag", "SELECT p_partkey, p_size < 5 OR p_brand = 'Brand#1' AS public FROM part")
def bulk_flag(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    chosen = p.where("p_brand = 'Brand#1'").select("p_partkey", F.lit(True).alias("flagged"))
    return p.join(chosen, "p_partkey", "left").select("p_partkey", ((F.col("p_size") < 5) | F.coalesce("flagged", F.lit(False))).alias("public"))


@query("token_confirm", "SELECT c_custkey, CASE WHEN c_custkey = 77 THEN NULL ELSE md5(c_name) END AS token, c_custkey = 77 AS confirmed FROM customer")
def token_confirm(spark: SparkSession, sf: str) -> DataFrame:
    import hashlib

    given = hashlib.md5(b"Customer#000000077").hexdigest()
    c = table(spark, sf, "customer").select("c_custkey", F.md5("c_name").alias("token"))
    hit = F.col("token") == given
    return c.select("c_custkey", F.when(~hit, F.col("token")).alias("token"), hit.alias("confirmed"))


@query("derived_sort_key", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 0 ELSE 100000 * 2020 + 1000 + p_size END::BIGINT AS cvenumber FROM part")
def derived_sort_key(spark: SparkSession, sf: str) -> DataFrame:
    from millrace.functions.security import cve_number

    cve = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.concat(F.lit("2020-"), (1000 + F.col("p_size")).cast("string")))
    return table(spark, sf, "part").select("p_partkey", F.coalesce(cve_number(cve), F.lit(0).cast("long")).alias("cvenumber"))


@query("hash_skip_write", "SELECT p_partkey FROM part WHERE p_size % 4 = 0")
def hash_skip_write(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose content differs from what is published, by content hash."""
    p = table(spark, sf, "part")
    published = p.select("p_partkey", F.sha2(F.when(F.col("p_size") % 4 == 0, "stale").otherwise(F.col("p_name")), 256).alias("was"))
    return p.join(published, "p_partkey").where(F.sha2("p_name", 256) != F.col("was")).select("p_partkey")


@query("two_level_sync", "SELECT r_name AS grp, count(n_nationkey) AS lists FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND n_nationkey % 2 = 0 GROUP BY 1 HAVING count(n_nationkey) > 2")
def two_level_sync(spark: SparkSession, sf: str) -> DataFrame:
    """Groups go when too few lists are left in them."""
    r, n = tables(spark, sf, "region nation")
    counts = n.where("n_nationkey % 2 = 0").groupBy("n_regionkey").agg(F.count("*").alias("lists"))
    return r.join(counts, F.col("n_regionkey") == F.col("r_regionkey")).where("lists > 2").select(F.col("r_name").alias("grp"), "lists")
