"""Queues, change capture, limits, locks, moderation and monitors over the event log."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import queues as Q
from millrace.registry import query
from millrace.sources.tables import table, tables

CONSUMERS = "(VALUES (1, 'north'), (2, 'south'), (3, 'east')) c(consumerid, consumer)"


def consumers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, "north"), (2, "south"), (3, "east")], "consumerid int, consumer string")


@query("purge_fanout", f"SELECT event_id, consumerid, '^/' || event_type || '/' AS expr FROM events, {CONSUMERS}")
def purge_fanout(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", F.concat(F.lit("^/"), "event_type", F.lit("/")).alias("expr"))
    return Q.fan_out(e, consumers(spark)).select("event_id", "consumerid", "expr")


@query("purge_keys_explode", "SELECT event_id, unnest(CASE WHEN event_type = 'purchase' THEN ['/' || event_id, '/feed/', '/archive/'] ELSE ['/' || event_id] END) AS url FROM events")
def purge_keys_explode(spark: SparkSession, sf: str) -> DataFrame:
    own = F.concat(F.lit("/"), "event_id")
    urls = F.when(F.col("event_type") == "purchase", F.array(own, F.lit("/feed/"), F.lit("/archive/"))).otherwise(F.array(own))
    return table(spark, sf, "events").select("event_id", F.explode(urls).alias("url"))


_CDC = """WITH ch AS (SELECT user_id, ts FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events) WHERE was IS NOT NULL AND was <> event_type),
lg AS (SELECT DISTINCT user_id, json_extract_string(props, '$.k')::INT % 4 AS site FROM events WHERE event_type = 'signup'),
q AS (SELECT user_id, site, max(ts) AS changedat FROM ch JOIN lg USING (user_id) GROUP BY 1, 2)
"""


def _captured(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    logins = e.where("event_type = 'signup'").select("user_id", (F.get_json_object("props", "$.k").cast("int") % 4).alias("site")).distinct()
    return Q.capture(Q.changes(e, "user_id", ["ts", "event_id"], ["event_type"]), logins, "user_id", "ts")


@query("cdc_changelog", _CDC + "SELECT * FROM q")
def cdc_changelog(spark: SparkSession, sf: str) -> DataFrame:
    return _captured(spark, sf)


@query("cdc_compare_delete", _CDC + "SELECT * FROM q WHERE NOT (site = 1 AND user_id % 3 <> 0)")
def cdc_compare_delete(spark: SparkSession, sf: str) -> DataFrame:
    """Site 1 was served, but every third user has changed since it was read."""
    q = _captured(spark, sf)
    read = F.when(F.col("user_id") % 3 == 0, F.col("changedat") - F.expr("INTERVAL 1 SECOND")).otherwise(F.col("changedat"))
    return Q.acknowledged(q, q.where("site = 1").withColumn("changedat", read), ["user_id", "site"], "changedat")


@query("rate_limit_window", "SELECT event_id, (SELECT count(*) FROM events b WHERE b.user_id = a.user_id AND b.ts BETWEEN a.ts - INTERVAL 24 HOUR AND a.ts) > 3 AS limited FROM events a")
def rate_limit_window(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return e.select("event_id", (Q.in_window(e, "user_id", "t", "24 HOURS") > 3).alias("limited"))


_STEPS = """WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, event_id, n, true AS ok, [ts] AS acc FROM e WHERE n = 1
UNION ALL SELECT user_id, event_id, n, ok, CASE WHEN ok THEN list_append(acc, ts) ELSE acc END FROM (
SELECT e.user_id, e.event_id, e.n, {ok} AS ok, r.acc, e.ts FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
SELECT event_id, ok FROM r"""


@query("rate_limit_exact", _STEPS.format(ok="len(list_filter(r.acc, lambda t: t >= e.ts - INTERVAL 24 HOUR)) <= 2"))
def rate_limit_exact(spark: SparkSession, sf: str) -> DataFrame:
    return Q.with_feedback(table(spark, sf, "events"), "user_id", "ts", "event_id", Q.limiter(2, timedelta(hours=24))).select("event_id", "ok")


@query("vote_lock_exact", _STEPS.format(ok="r.acc[-1] + INTERVAL 12 HOUR < e.ts"))
def vote_lock_exact(spark: SparkSession, sf: str) -> DataFrame:
    return Q.with_feedback(table(spark, sf, "events"), "user_id", "ts", "event_id", Q.lock(timedelta(hours=12))).select("event_id", "ok")


@query(
    "moderation_fold",
    """WITH RECURSIVE e AS (SELECT user_id % 60 AS obj, user_id AS who, user_id % 60 < 30 AS two, event_type AS t, row_number() OVER (PARTITION BY user_id % 60 ORDER BY ts, event_id) AS n FROM events),
    r AS (SELECT obj, 0::BIGINT AS n, 0 AS st, NULL::BIGINT AS fm FROM (SELECT DISTINCT obj FROM e)
    UNION ALL SELECT e.obj, e.n,
    CASE WHEN t = 'signup' AND st = 0 THEN 1 WHEN t IN ('view', 'purchase') AND st = 1 AND (NOT two OR (fm IS NOT NULL AND fm <> who)) THEN 2 WHEN t = 'error' AND st IN (1, 2) AND e.n % 7 = 0 THEN 3 WHEN t = 'click' AND st IN (1, 2) THEN 0 ELSE st END,
    CASE WHEN t IN ('view', 'purchase') AND st = 1 AND two AND fm IS NULL THEN who WHEN t IN ('view', 'purchase') AND st = 1 AND NOT two THEN NULL WHEN (t = 'click' OR (t = 'error' AND e.n % 7 = 0)) AND st IN (1, 2) THEN NULL ELSE fm END
    FROM r JOIN e ON e.obj = r.obj AND e.n = r.n + 1)
    SELECT obj, st::INT AS modstate, fm AS first FROM (SELECT *, row_number() OVER (PARTITION BY obj ORDER BY n DESC) AS k FROM r) WHERE k = 1""",
)
def moderation_fold(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql.window import Window

    e = table(spark, sf, "events").withColumn("obj", F.col("user_id") % 60)
    n = F.row_number().over(Window.partitionBy("obj").orderBy("ts", "event_id"))
    t = F.col("event_type")
    action = F.when(t == "signup", "submit").when(t.isin("view", "purchase"), "approve").when(t == "click", "return").when((t == "error") & (F.col("n") % 7 == 0), "reject").otherwise("none")
    acts = e.withColumn("n", n).select("obj", "n", action.alias("action"), F.col("user_id").alias("who"), (F.col("obj") < 30).alias("two"))
    return Q.moderated(acts, "obj", ["n"])


@query(
    "change_notices",
    """SELECT event_id, CASE WHEN was IS NULL THEN 'new' WHEN NOT ok AND was THEN 'unapproved' WHEN NOT ok THEN NULL WHEN NOT was THEN 'approved' WHEN value <> v THEN 'modified' END AS notice
    FROM (SELECT *, event_type <> 'error' AS ok, lag(event_type <> 'error') OVER w AS was, lag(value) OVER w AS v FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""",
)
def change_notices(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql.window import Window

    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ok = F.col("event_type") != "error"
    e = table(spark, sf, "events").withColumns({"ok": ok, "was": F.lag(ok).over(own), "v": F.lag("value").over(own)})
    return e.select("event_id", Q.change_kind(F.col("was"), F.col("ok"), F.col("value") == F.col("v")).alias("notice"))


@query(
    "lag_status",
    """SELECT event_type, CASE WHEN lag > 900 THEN 'CRITICAL' WHEN lag > 300 THEN 'WARNING' ELSE 'OK' END AS level FROM (SELECT event_type,
    max(epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 1000000 AS lag FROM events WHERE ts > TIMESTAMP '2024-01-30 23:40:00' GROUP BY 1)""",
)
def lag_status(spark: SparkSession, sf: str) -> DataFrame:
    now, since = (F.lit(t).cast("timestamp_ntz") for t in ("2024-01-31 00:00:00", "2024-01-30 23:40:00"))
    lag = F.expr("timestampdiff(MICROSECOND, ts, timestamp_ntz '2024-01-31 00:00:00')") / 1000000
    e = table(spark, sf, "events").where((F.col("ts") > since) & (F.col("ts") <= now))
    return e.groupBy("event_type").agg(F.max(lag).alias("lag")).select("event_type", Q.lag_level(F.col("lag")).alias("level"))


@query("due_items", "SELECT event_id FROM events WHERE ts + INTERVAL 2 DAY <= TIMESTAMP '2024-01-15' AND event_type = 'signup'")
def due_items(spark: SparkSession, sf: str) -> DataFrame:
    due = F.col("ts") + F.expr("INTERVAL 2 DAYS") <= F.lit("2024-01-15").cast("timestamp_ntz")
    return table(spark, sf, "events").where(due & (F.col("event_type") == "signup")).select("event_id")


@query("post_candidates", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY AND user_id % 2 = 1 ORDER BY ts, event_id LIMIT 200")
def post_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Recent items that some provider has not got yet, oldest first."""
    posted = F.when(F.col("user_id") % 2 == 0, F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("1"))).otherwise(F.create_map(F.lit("a"), F.lit("1")))
    lacking = ~F.forall(F.array(F.lit("a"), F.lit("b")), lambda k: F.map_contains_key(posted, k))
    recent = F.col("ts") >= F.lit("2024-01-24").cast("timestamp_ntz")
    return table(spark, sf, "events").where(recent & lacking).orderBy("ts", "event_id").limit(200).select("event_id")


@query("cooloff_filter", "SELECT user_id, min(ts) + INTERVAL 36 HOUR <= TIMESTAMP '2024-01-03' AS ready FROM events GROUP BY 1")
def cooloff_filter(spark: SparkSession, sf: str) -> DataFrame:
    ready = F.min("ts") + F.expr("INTERVAL 36 HOURS") <= F.lit("2024-01-03").cast("timestamp_ntz")
    return table(spark, sf, "events").groupBy("user_id").agg(ready.alias("ready"))


@query("changed_since", "SELECT user_id, max(ts) AS lastmodified FROM events GROUP BY 1 HAVING max(ts) > TIMESTAMP '2024-01-30 12:00:00'")
def changed_since(spark: SparkSession, sf: str) -> DataFrame:
    last = table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("lastmodified"))
    return last.where(F.col("lastmodified") > F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"))


@query(
    "purge_keys_from_change",
    f"""WITH ch AS (SELECT * FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events) WHERE was IS NOT NULL AND was <> event_type)
    SELECT event_id, consumerid, url FROM (SELECT event_id, unnest(['/u/' || user_id, '/t/' || event_type]) AS url FROM ch), {CONSUMERS}""",
)
def purge_keys_from_change(spark: SparkSession, sf: str) -> DataFrame:
    changed = Q.changes(table(spark, sf, "events"), "user_id", ["ts", "event_id"], ["event_type"])
    urls = changed.select("event_id", F.explode(F.array(F.concat(F.lit("/u/"), "user_id"), F.concat(F.lit("/t/"), "event_type"))).alias("url"))
    return Q.fan_out(urls, consumers(spark)).select("event_id", "consumerid", "url")


_FILES = ("templates/a.html", "templates/base/b.html", "media/css/main.css", "media/img/x.png", "data/features.yaml", "other/readme")
_ROUTED = """CASE WHEN starts_with(path, 'templates/') THEN 'key:tpl_' || md5(path[11:]) WHEN starts_with(path, 'media/') AND ends_with(path, '.css') THEN 'url:^/' || path || '$,url:^/dyncss/'
WHEN starts_with(path, 'media/') THEN 'url:^/' || path || '$' WHEN starts_with(path, 'data/') THEN 'key:data_features' END"""


def routed(path):
    """What a changed file makes stale; null if nothing."""
    whole = F.concat(F.lit("url:^/"), path, F.lit("$"))
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return (
        F.when(F.startswith(path, F.lit("templates/")), F.concat(F.lit("key:tpl_"), F.md5(F.substring(path, 11, 1 << 30))))
        .when(F.startswith(path, F.lit("media/")) & F.endswith(path, F.lit(".css")), F.concat(whole, F.lit(",url:^/dyncss/")))
        .when(F.startswith(path, F.lit("media/")), whole)
        .when(F.startswith(path, F.lit("data/")), F.concat(F.lit("key:data_"), name))
    )


@query("path_routing", f"SELECT path, {_ROUTED} AS stale FROM (VALUES {', '.join(f'({p!r})' for p in _FILES)}) f(path)")
def path_routing(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(p,) for p in _FILES], "path string").withColumn("stale", routed(F.col("path")))


@query("line_routing", f"SELECT n, path, {_ROUTED} AS stale FROM (SELECT event_id AS n, CASE event_type WHEN 'view' THEN 'templates/' WHEN 'click' THEN 'media/' ELSE 'x/' END || user_id || '.css' AS path FROM events)")
def line_routing(spark: SparkSession, sf: str) -> DataFrame:
    head = F.when(F.col("event_type") == "view", "templates/").when(F.col("event_type") == "click", "media/").otherwise("x/")
    lines = table(spark, sf, "events").select(F.col("event_id").alias("n"), F.concat(head, "user_id", F.lit(".css")).alias("path"))
    return lines.withColumn("stale", routed(F.col("path")))


@query("indexed_params_explode", f"SELECT consumerid, i, item FROM (SELECT unnest([0, 1, 2]) AS i, unnest(['p:^/a', 'x:key', 'p:^/b']) AS item), {CONSUMERS}")
def indexed_params_explode(spark: SparkSession, sf: str) -> DataFrame:
    """Numbered parameters p0, x1, p2 of one request, each sent to all consumers."""
    request = spark.createDataFrame([({"n": "3", "p0": "^/a", "x1": "key", "p2": "^/b"},)], "params map<string,string>")
    i = F.explode(F.sequence(F.lit(0), F.col("params").getItem("n").cast("int") - 1)).alias("i")
    item = F.when(F.map_contains_key("params", F.concat(F.lit("p"), "i")), F.concat(F.lit("p:"), F.try_element_at("params", F.concat(F.lit("p"), "i"))))
    item = item.otherwise(F.concat(F.lit("x:"), F.try_element_at("params", F.concat(F.lit("x"), "i"))))
    return Q.fan_out(request.select("params", i).select("i", item.alias("item")), consumers(spark)).select("consumerid", "i", "item")


@query("push_batches_100", "SELECT c_nationkey, batch, count(*) AS n, min(c_custkey) AS first FROM (SELECT *, ((row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) // 100)::INT AS batch FROM customer) GROUP BY 1, 2")
def push_batches_100(spark: SparkSession, sf: str) -> DataFrame:
    rows = Q.batches(table(spark, sf, "customer"), "c_nationkey", "c_custkey", 100)
    return rows.groupBy("c_nationkey", "batch").agg(F.count("*").alias("n"), F.min("c_custkey").alias("first"))


@query("mail_rows_explode", "SELECT event_id, unnest(CASE WHEN user_id % 3 = 0 THEN ['u' || user_id, 'cc'] ELSE ['u' || user_id] END) AS receiver FROM events")
def mail_rows_explode(spark: SparkSession, sf: str) -> DataFrame:
    to, cc = F.concat(F.lit("u"), "user_id"), F.when(F.col("user_id") % 3 == 0, "cc")
    receivers = F.filter(F.array(to, cc), lambda x: x.isNotNull())
    return table(spark, sf, "events").select("event_id", F.explode(receivers).alias("receiver"))


@query("unnest_array", "SELECT unnest([3, 1, 2]) AS x, r_name FROM region")
def unnest_array(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "region").select(F.explode(F.array(F.lit(3), F.lit(1), F.lit(2))).alias("x"), "r_name")


@query("table_function_page", "SELECT o_orderkey, r::INT AS n FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders WHERE o_orderstatus = 'F') WHERE r > 20 AND r <= 40")
def table_function_page(spark: SparkSession, sf: str) -> DataFrame:
    """A table function with page parameters is a Python function that returns a DataFrame."""
    from pyspark.sql.window import Window

    def page(status: str, offset: int, size: int) -> DataFrame:
        best = table(spark, sf, "orders").where(F.col("o_orderstatus") == status).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(offset + size)
        return best.withColumn("n", F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey"))).where(F.col("n") > offset)

    return page("F", 20, 20).select("o_orderkey", "n")


@query("one_or_two_rows", "SELECT n_nationkey, unnest(CASE WHEN n_regionkey = 1 THEN ['own', 'current'] ELSE ['own'] END) AS kind FROM nation")
def one_or_two_rows(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.when(F.col("n_regionkey") == 1, F.array(F.lit("own"), F.lit("current"))).otherwise(F.array(F.lit("own")))
    return table(spark, sf, "nation").select("n_nationkey", F.explode(kinds).alias("kind"))


@query("dependency_list", "SELECT p_partkey, unnest(list_filter(string_split(CASE WHEN p_size % 2 = 0 THEN '' ELSE p_type || ',' || p_brand END, ','), lambda x: x <> '')) AS dependency FROM part")
def dependency_list(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.col("p_size") % 2 == 0, "").otherwise(F.concat_ws(",", "p_type", "p_brand"))
    return table(spark, sf, "part").select("p_partkey", F.explode(F.filter(F.split(text, ","), lambda x: x != "")).alias("dependency"))


@query("values_relation", "SELECT id, name FROM (VALUES (1, 'one'), (2, 'two'), (3, 'three')) v(id, name) WHERE id > 1")
def values_relation(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql("SELECT id, name FROM VALUES (1, 'one'), (2, 'two'), (3, 'three') AS v(id, name) WHERE id > 1")


@query("constants_union", "SELECT r_regionkey AS k, r_name AS name FROM region UNION ALL SELECT 100, 'fixed'")
def constants_union(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")).union(spark.createDataFrame([(100, "fixed")], "k int, name string"))


@query("versions_json", """SELECT r_regionkey, '{"count":' || count(*) || ',"name":"' || r_name || '","nations":["' || string_agg(n_name, '","' ORDER BY n_name) || '"]}' AS doc FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name""")
def versions_json(spark: SparkSession, sf: str) -> DataFrame:
    """A JSON document per group, keys in alphabetical order."""
    n, r = tables(spark, sf, "nation region")
    g = r.join(n, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_regionkey", "r_name").agg(F.count("*").alias("count"), F.array_sort(F.collect_list("n_name")).alias("nations"))
    return g.select("r_regionkey", F.to_json(F.struct("count", F.col("r_name").alias("name"), "nations")).alias("doc"))


@query("catalog_nested", "SELECT p_brand, string_agg(p_partkey || ':' || coalesce(nullif(CASE WHEN p_size < 25 THEN '' ELSE p_type END, ''), '-'), ',' ORDER BY p_partkey) AS items FROM part GROUP BY 1")
def catalog_nested(spark: SparkSession, sf: str) -> DataFrame:
    """A nested list per group in which empty texts count as missing."""
    kind = F.nullif(F.when(F.col("p_size") < 25, "").otherwise(F.col("p_type")), F.lit(""))
    rows = table(spark, sf, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", kind.alias("kind")))).alias("a"))
    return rows.select("p_brand", F.array_join(F.transform("a", lambda x: F.concat_ws(":", x.p_partkey, F.coalesce(x.kind, F.lit("-")))), ",").alias("items"))


@query("sitemap_public_internal", "SELECT page_id, url, page_id % 4 = 0 AS internal, CASE WHEN page_id % 3 = 0 THEN NULL ELSE round(0.1 * (page_id % 10), 1)::DOUBLE END AS priority FROM pages WHERE page_id % 4 <> 0 OR page_id > 100")
def sitemap_public_internal(spark: SparkSession, sf: str) -> DataFrame:
    """The public entries, and of the internal ones those behind a limit."""
    prio = F.when(F.col("page_id") % 3 != 0, F.round(0.1 * (F.col("page_id") % 10), 1))
    p = table(spark, sf, "pages").select("page_id", "url", (F.col("page_id") % 4 == 0).alias("internal"), prio.alias("priority"))
    return p.where(~F.col("internal")).union(p.where(F.col("internal") & (F.col("page_id") > 100)))


@query("feed_latest10", "SELECT event_id, ts, event_type || ' #' || event_id AS title FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id LIMIT 10")
def feed_latest10(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").where("event_type = 'purchase'").orderBy(F.desc("ts"), "event_id").limit(10)
    return e.select("event_id", "ts", F.concat("event_type", F.lit(" #"), "event_id").alias("title"))
