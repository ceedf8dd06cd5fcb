"""File formats, read from texts that the test tables hold or are put into."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import texts
from millrace.registry import query
from millrace.sources import files
from millrace.sources.tables import table


def _escaped(c):
    for plain, mark in (("&", "&amp;"), ("<", "&lt;")):
        c = F.replace(c, F.lit(plain), F.lit(mark))
    return c


@query("read_rss_xml", "SELECT page_id, 'page' || page_id || ' <' || (page_id % 7) || ' & more>' AS title, url FROM pages WHERE page_id % 3 <> 0")
def read_rss_xml(spark: SparkSession, sf: str) -> DataFrame:
    """Feed items parsed from XML; those of known URLs are left."""
    p = table(spark, sf, "pages")
    title = F.concat(F.lit("page"), "page_id", F.lit(" <"), F.col("page_id") % 7, F.lit(" & more>"))
    xml = F.concat(F.lit("<item><title>"), _escaped(title), F.lit("</title><link>"), _escaped(F.col("url")), F.lit("</link></item>"))
    items = p.select("page_id", F.from_xml(xml, "title string, link string").alias("i")).select("page_id", F.col("i.title").alias("title"), F.col("i.link").alias("url"))
    known = p.where("page_id % 3 = 0").select("url")
    return items.join(known, "url", "left_anti").select("page_id", "title", "url")


@query("read_sitemap_xml", "SELECT page_id, url, CASE WHEN page_id % 2 = 0 THEN round(page_id % 10 / 10.0, 1) ELSE 0 END::DOUBLE AS priority, CASE WHEN page_id % 4 = 0 THEN DATE '2024-01-01' + (page_id % 28)::INT END AS lastmod FROM pages")
def read_sitemap_xml(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    prio = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("<priority>"), F.round(F.col("page_id") % 10 / 10, 1), F.lit("</priority>"))).otherwise("")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 28).cast("int"))
    mod = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("<lastmod>"), day, F.lit("</lastmod>"))).otherwise("")
    xml = F.concat(F.lit("<url><loc>"), _escaped(F.col("url")), F.lit("</loc>"), prio, mod, F.lit("</url>"))
    got = p.select("page_id", F.from_xml(xml, "loc string, priority double, lastmod date").alias("u"))
    return got.select("page_id", F.col("u.loc").alias("url"), F.coalesce("u.priority", F.lit(0.0)).alias("priority"), F.col("u.lastmod").alias("lastmod"))


@query(
    "robots_rules",
    """SELECT user_id, event_id, '/' || event_id AS prefix FROM (SELECT *, last_value(CASE WHEN event_type IN ('signup', 'error') THEN event_type END IGNORE NULLS)
    OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS agent FROM events) WHERE event_type = 'view' AND agent = 'signup'""",
)
def robots_rules(spark: SparkSession, sf: str) -> DataFrame:
    """One robots file per user: agent lines and disallow lines in order."""
    agent = F.when(F.col("event_type") == "signup", "User-agent: *").when(F.col("event_type") == "error", "User-agent: other")
    line = F.coalesce(agent, F.when(F.col("event_type") == "view", F.concat(F.lit("Disallow: /"), "event_id")).otherwise("Disallow: "))
    lines = table(spark, sf, "events").select(F.col("user_id").alias("file"), F.col("event_id").alias("n"), line.alias("line"))
    return files.rules_of(lines, "mybot").select(F.col("file").alias("user_id"), F.col("n").alias("event_id"), "prefix")


@query(
    "yum_repo_group",
    "SELECT lower(p_type) || '-' || (p_size % 5) AS platform, string_agg(arch || ':' || p_size, ',' ORDER BY arch, p_size) AS arches FROM (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN 'x86' ELSE 'arm' END AS arch FROM part) GROUP BY 1",
)
def yum_repo_group(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    arch = F.when(F.col("p_partkey") % 2 == 0, "x86").otherwise("arm")
    names = p.select(F.concat_ws("-", F.lower("p_type"), F.col("p_size") % 5, arch).alias("name"), F.col("p_size").alias("versions"))
    out = files.repository_platforms(names)
    return out.select("platform", F.array_join(F.transform("arches", lambda a: F.concat_ws(":", a.arch, a.versions)), ",").alias("arches"))


@query("yaml_flatten", "SELECT r_name AS grp, n_name AS feature, unnest(['9.6', '10']) AS version, unnest(['Yes', 'Obsolete']) AS state FROM nation JOIN region ON r_regionkey = n_regionkey")
def yaml_flatten(spark: SparkSession, sf: str) -> DataFrame:
    """A nested document of groups, features and version maps, as rows."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    versions = F.create_map(F.lit("9.6"), F.lit("Yes"), F.lit("10"), F.lit("Obsolete"))
    nested = r.join(n, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.collect_list(F.struct(F.col("n_name").alias("name"), versions.alias("versions"))).alias("features"))
    docs = nested.select(F.to_json(F.struct(F.col("r_name").alias("grp"), "features")).alias("doc"))
    read = docs.select(F.from_json("doc", "grp string, features array<struct<name: string, versions: map<string,string>>>").alias("d"))
    rows = read.select(F.col("d.grp").alias("grp"), F.explode("d.features").alias("f"))
    return rows.select("grp", F.col("f.name").alias("feature"), F.explode("f.versions").alias("version", "state"))


@query("json_from_js", "SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events")
def json_from_js(spark: SparkSession, sf: str) -> DataFrame:
    script = F.concat(F.lit("/* generated */ var repo = "), "props", F.lit("; start();"))
    return table(spark, sf, "events").select("event_id", files.json_in_script(script, "repo", "k int").alias("j")).select("event_id", "j.k")


@query("title_by_pattern_and_parser", "SELECT page_id, true AS same FROM pages")
def title_by_pattern_and_parser(spark: SparkSession, sf: str) -> DataFrame:
    """The pattern and the parser read the same titles, white space and references apart."""
    from millrace.operators.crawl import parsed_page

    p = table(spark, sf, "pages").select("page_id", texts.page_title(F.col("html")).alias("t"), parsed_page("html")["title"].alias("u"))
    plain = lambda c: F.regexp_replace(c, r"\s+", "")
    return p.select("page_id", (plain(texts.without_references(F.col("t"))) == plain(F.col("u"))).alias("same"))
