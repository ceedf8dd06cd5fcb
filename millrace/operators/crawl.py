"""Crawling: titles, text and links of pages, link resolution, incremental re-crawl, frontier."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources.shared import shared_dir


def markup_events(source: str) -> list[tuple[str, str, list]]:
    """("open" | "close" | "text", tag or text, attributes) in the order of the source."""
    events: list[tuple[str, str, list]] = []
    reader = HTMLParser()
    reader.handle_starttag = lambda tag, attrs: events.append(("open", tag, attrs))
    reader.handle_endtag = lambda tag: events.append(("close", tag, []))
    reader.handle_data = lambda data: events.append(("text", data.strip(), []))
    reader.feed(source)
    reader.close()
    return events


def read_page(source: str) -> tuple[str, str, list[str]]:
    """(title, text, link targets). Each text belongs to the tag that was opened last before
    it, closed or not: what follows ``</script>`` stays unread until a tag opens, and what
    follows a title joins it. Texts of one character are dropped."""
    events = markup_events(source)
    links = [v for kind, tag, attrs in events if (kind, tag) == ("open", "a") for name, v in attrs if name == "href" and v is not None]
    owner, inside, title, lines = "", False, [], []
    for kind, value, _ in events:
        if kind == "open":
            owner, inside = value, inside or value == "body"
        elif kind == "close":
            inside = inside and value != "body"
        elif len(value) > 1 and owner == "title":
            title.append(value)
        elif len(value) > 1 and inside and owner != "script":
            lines.append(value + "\n")
    return "".join(title), "".join(lines), links


_PARSED = T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType()), T.StructField("links", T.ArrayType(T.StringType()))])


@F.pandas_udf(_PARSED)
def parsed_page(pages: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_page(s or "") for s in pages], columns=["title", "text", "links"])


def resolve(link: str, page: str, host: str) -> str | None:
    """A link as a path on the page's host, without query and fragment; None for other
    hosts, other schemes and bare fragments."""
    try:
        scheme, netloc, path, _, _ = urlsplit(link.strip())
    except ValueError:
        return None
    if scheme in ("http", "https"):
        if netloc != host:
            return None
    elif scheme:
        return None
    if path == "":
        return None
    return path if path.startswith("/") else urljoin(page, urlunsplit(("", "", path, "", "")))


@F.udf(T.StringType(), useArrow=True)
def resolved_link(link: str | None, page: str | None, host: str | None) -> str | None:
    return None if link is None or page is None else resolve(link, page, host or "")


def host_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)


def hrefs(html: Column) -> Column:
    """Link targets by pattern, in SQL functions."""
    return F.regexp_extract_all(html, F.lit(r'<a\s+href="([^"]*)"'), 1)


def to_fetch(sitemap: DataFrame, scanned: DataFrame, key: str = "url") -> DataFrame:
    """Pages never scanned, and those modified since their last scan, each once. sitemap has the
    key and lastmod, scanned has the key and lastscanned, of which the newest counts. Where
    several pages share a url, another ``key`` tells them apart."""
    known = scanned.groupBy(F.col(key).alias("__key")).agg(F.max("lastscanned").alias("lastscanned"))
    fresh = F.col("lastscanned").isNull() | (F.col("lastmod") >= F.col("lastscanned"))
    return sitemap.join(known, F.col(key) == F.col("__key"), "left").where(fresh).drop("__key")


def blocked(url: Column, prefixes: list[str], patterns: list[str]) -> Column:
    """Disallowed by prefix, by pattern, or for a step upwards. An empty prefix blocks nothing."""
    out = F.contains(url, F.lit(".."))
    for p in prefixes:
        if p:
            out = out | F.startswith(url, F.lit(p))
    for p in patterns:
        out = out | F.rlike(url, F.lit(p))
    return out


def frontier(links: DataFrame, start: list[str], blocked_by: Column | None = None) -> DataFrame:
    """(url, depth) of all that can be reached from ``start`` over links (src, dst), breadth
    first. A url counts as visited with or without a closing slash. Each round joins only
    the newest urls, and its result is written out, so the plan does not grow; rounds end
    when nothing new is found."""
    spark = links.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    key = lambda c: F.regexp_replace(c, "(?<=.)/$", "")
    edges = links.select("src", "dst").distinct()
    seen = spark.createDataFrame([(u, 0) for u in start], "url string, depth int").withColumn("key", key("url"))
    newest = seen
    depth = 0
    while not newest.isEmpty():
        depth += 1
        step = newest.join(edges, newest.url == edges.src).select(F.col("dst").alias("url"), F.lit(depth).alias("depth"))
        if blocked_by is not None:
            step = step.where(~blocked_by)
        step = step.withColumn("key", key("url")).groupBy("key").agg(F.min("url").alias("url"), F.min("depth").alias("depth"))
        newest = step.join(seen.select("key"), "key", "left_anti").select("url", "depth", "key").checkpoint()
        seen = seen.union(newest)
    return seen.select("url", "depth")


def scan_results(pages: DataFrame, fetched: DataFrame, key: str = "url") -> DataFrame:
    """The page table after a crawl: fetched rows (url, code, title) replace or add to pages
    (url, title); a code other than 200 removes the page. Where several pages share a url,
    both tables need another ``key`` that tells them apart; it must not repeat in either."""
    f = fetched.select(F.col(key).alias("__key"), F.col("url").alias("__url"), "code", F.col("title").alias("__title"))
    both = pages.join(f, F.col(key) == F.col("__key"), "full")
    keep = F.col("code").isNull() | (F.col("code") == 200)
    return both.where(keep).select(F.coalesce("__url", "url").alias("url"), F.coalesce("__title", "title").alias("title"))


def worker(pages: DataFrame, column: str, work) -> DataFrame:
    """Runs ``work`` on each value; a failure becomes an error text and the row goes on."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            results, errors = [], []
            for v in b[column]:
                try:
                    results.append(str(work(v)))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  (reported in the row)
                    results.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield b.assign(result=results, error=errors)
    schema = T.StructType([*pages.schema.fields, T.StructField("result", T.StringType()), T.StructField("error", T.StringType())])
    return pages.mapInPandas(run, schema)
