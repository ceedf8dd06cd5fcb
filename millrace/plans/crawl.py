"""Pages: titles, texts, links, incremental and breadth-first crawls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import texts
from millrace.operators import crawl as C
from millrace.registry import query
from millrace.sources.tables import table, tables


@query("page_title_extract", r"SELECT page_id, regexp_extract(html, '<title>([^<]+)</title>', 1) AS title FROM pages")
def page_title_extract(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", texts.page_title(F.col("html")).alias("title"))


@query("page_paths", r"SELECT page_id, regexp_replace(url, '^[a-z]+://[^/?#]*', '') AS path FROM pages")
def page_paths(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", texts.url_path(F.col("url")).alias("path"))


@query("page_links", """SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages""")
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.explode(C.hrefs(F.col("html"))).alias("href"))


@query("page_text")
def page_text(spark: SparkSession, sf: str) -> DataFrame:
    parsed = table(spark, sf, "pages").select("page_id", C.parsed_page("html").alias("p"))
    return parsed.select("page_id", "p.title", "p.text", F.size("p.links").alias("n_links"))


@query("resolve_links", r"""SELECT page_id, href, regexp_replace(href, '[?#].*$', '') AS path FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages) WHERE starts_with(href, '/') AND regexp_replace(href, '[?#].*$', '') <> ''""")
def resolve_links(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    links = p.select("page_id", "url", F.explode(C.hrefs(F.col("html"))).alias("href"))
    out = links.select("page_id", "href", C.resolved_link("href", texts.url_path(F.col("url")), C.host_of(F.col("url"))).alias("path"))
    return out.where("path IS NOT NULL")


@query("crawl_incremental", "SELECT page_id, lastmod FROM (SELECT page_id, TIMESTAMP '2024-01-01' + to_days((page_id % 30)::INT) AS lastmod, CASE WHEN page_id % 7 <> 0 THEN TIMESTAMP '2024-01-15' END AS scanned FROM pages) WHERE scanned IS NULL OR lastmod >= scanned")
def crawl_incremental(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    sitemap = p.select("page_id", "url", (start + F.make_dt_interval(days=(F.col("page_id") % 30).cast("int"))).alias("lastmod"))
    scanned = p.where("page_id % 7 <> 0").select("page_id", F.lit("2024-01-15").cast("timestamp_ntz").alias("lastscanned"))
    return C.to_fetch(sitemap, scanned, key="page_id").select("page_id", "lastmod")


@query(
    "crawl_frontier",
    """WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey::VARCHAR AS src, l_partkey::VARCHAR AS dst FROM lineitem),
    r(url, depth) AS (SELECT '7', 0 UNION SELECT dst, depth + 1 FROM r JOIN e ON src = url WHERE depth < 12)
    SELECT url, min(depth)::INT AS depth FROM r GROUP BY 1""",
)
def crawl_frontier(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem")
    links = l.select(F.col("l_suppkey").cast("string").alias("src"), F.col("l_partkey").cast("string").alias("dst"))
    return C.frontier(links, ["7"])


@query("path_prefixes", r"SELECT page_id, unnest(list_transform(range(1, len(s) + 1), lambda i: array_to_string(s[1:i], '/'))) AS prefix FROM (SELECT page_id, list_filter(string_split(regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '[?#].*$', ''), '/'), lambda x: x <> '') AS s FROM pages)")
def path_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    """The steps down to a page's folder."""
    path = F.regexp_replace(texts.url_path(F.col("url")), r"[?#].*$", "")
    p = table(spark, sf, "pages").select("page_id", F.filter(F.split(path, "/"), lambda x: x != "").alias("s"))
    steps = F.transform(F.sequence(F.lit(1), F.size("s")), lambda i: F.array_join(F.slice("s", 1, i), "/"))
    return p.where(F.size("s") > 0).select("page_id", F.explode(steps).alias("prefix"))


@query("delete_branch", "SELECT url, CASE WHEN page_id % 5 = 1 THEN 'new' ELSE 'old' END AS title FROM pages WHERE page_id % 5 <> 0")
def delete_branch(spark: SparkSession, sf: str) -> DataFrame:
    """A crawl that finds some pages gone and some changed."""
    p = table(spark, sf, "pages")
    fetched = p.where("page_id % 5 < 2").select("page_id", "url", F.when(F.col("page_id") % 5 == 0, 404).otherwise(200).alias("code"), F.lit("new").alias("title"))
    return C.scan_results(p.select("page_id", "url", F.lit("old").alias("title")), fetched, key="page_id")


@query("worker_errors", "SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 'ZeroDivisionError: division by zero' END AS error FROM pages")
def worker_errors(spark: SparkSession, sf: str) -> DataFrame:
    def work(i: int) -> float:
        if i % 9 == 0:
            raise ZeroDivisionError("division by zero")
        return 1 / (i % 9)
    return C.worker(table(spark, sf, "pages").select("page_id"), "page_id", work).select("page_id", "error")
