"""URL filters: longest-rule matching, and link-graph propagation for what no rule decides.

Trust starts at hosts with allowed pages and follows links; distrust starts at hosts with
blocked pages and follows links backwards. Both are personalised PageRanks over host edges.
PageRank shares a mass out, so it falls with the number of linkers; what decides is the
share of a host's incoming rank that stems from such seeds, out of the rank that it has
when every host is a seed. That share is between 0 and 1 on a graph of any size.
"""

from __future__ import annotations

import string
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.scratch import Scratch

#: The rules of the registered query, with their verdicts.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)

DAMPING, THRESHOLD = 0.85, 0.5
#: Rounds end when no host receives more than this part of what one host starts with. As a
#: round passes on DAMPING of what moved, about log(TOLERANCE / hosts) / log(DAMPING) rounds
#: do at most. So many rounds are planned as one job.
TOLERANCE, ROUNDS = 1e-3, 5

#: Tables of so many hosts are broadcast; larger ones are joined by a shuffle, whose skewed
#: partitions adaptive execution splits.
BROADCAST_HOSTS = 100_000

_LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands after the first ``://`` up to / ? # or the end, A-Z lower-cased, and
    from there up to ? # or the end; both empty for a null url or one without ``://``."""
    pattern = r"^[\s\S]*?://([^/?#]*)([^?#]*)"
    part = lambda n: F.coalesce(F.regexp_extract(url.cast("string"), pattern, n), F.lit(""))
    return _ascii_lower(part(1)), part(2)


def _with_hosts(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    small = hosts.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    return pages.join(F.broadcast(hosts) if small else hosts, "host", "left")


def _rules_by_host(hosts: DataFrame, rules: Iterable[tuple[str, str]]) -> DataFrame:
    """(host, rules): for each host the rules of the host itself and of what it is under."""
    table = hosts.sparkSession.createDataFrame(
        [(h, "/" + p, f"{h}/{p}", v) for r, v in rules for h, _, p in [r.partition("/")]],
        "suffix string, start string, rule string, verdict string",
    )
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return (
        hosts.select("host", F.explode(suffixes).alias("suffix"))
        .join(table, "suffix")
        .groupBy("host")
        .agg(F.collect_list(F.struct(F.length("rule").alias("size"), "rule", "start", "verdict")).alias("rules"))
    )


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts. pages has host and html."""
    return (
        pages.where("host <> ''")
        .select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.col("html").cast("string"), F.lit(_LINK), 1)).alias("dst"))
        .select("src", _ascii_lower(F.col("dst")).alias("dst"))
        .where("src <> dst")
        .groupBy("src", "dst")
        .agg(F.count("*").alias("n"))
    )


def propagate(seeds: DataFrame, edges: DataFrame, scratch: Scratch, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust, from_trust, from_distrust) from seeds (host, trust, distrust)
    and edges (src, dst, n).

    ``trust`` and ``distrust`` are personalised PageRanks, along links and against them: a
    seed starts with (1 - damping) of its value, and every host passes ``damping`` of its
    rank on in proportion to its links; what a host without onward links would pass on is
    lost. ``from_trust`` is the part of the rank coming in over links that stems from trust
    seeds, out of what comes in when all hosts are seeds of 1; ``from_distrust`` likewise.
    Rounds add what still moves, until at every host that is at most ``tolerance`` of what
    one host starts with.
    """
    nodes = seeds.select("host").union(edges.select("src")).union(edges.select("dst")).distinct()
    given = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    start = nodes.join(seeds, "host", "left").select(
        "host", F.explode(F.array(F.struct(F.lit(True).alias("forth"), given("trust").alias("s")), F.struct(F.lit(False).alias("forth"), given("distrust").alias("s")))).alias("k")
    )
    columns = ("came", "came_all", "moves", "moves_all")
    nothing = F.lit(0.0)
    start = scratch.save(start.select("host", "k.forth", nothing.alias("came"), nothing.alias("came_all"), ((1 - damping) * F.col("k.s")).alias("moves"), F.lit(1 - damping).alias("moves_all")))
    both = edges.select(F.lit(True).alias("forth"), F.col("src").alias("host"), F.col("dst").alias("to"), "n").union(
        edges.select(F.lit(False).alias("forth"), F.col("dst").alias("host"), F.col("src").alias("to"), "n")
    )
    out = both.groupBy("forth", "host").agg(F.sum("n").alias("all"))
    links = scratch.save(both.join(out, ["forth", "host"]).select("forth", "host", "to", (damping * F.col("n") / F.col("all")).alias("p")))
    now = start
    if not links.isEmpty():
        while True:
            for _ in range(ROUNDS):
                sent = now.where("moves_all > 0").join(links, ["forth", "host"]).select("forth", F.col("to").alias("host"), (F.col("moves") * F.col("p")).alias("x"), (F.col("moves_all") * F.col("p")).alias("y"))
                held = now.select("forth", "host", "came", "came_all", nothing.alias("moves"), nothing.alias("moves_all"))
                both = held.union(sent.select("forth", "host", "x", "y", "x", "y"))
                now = both.groupBy("forth", "host").agg(*[F.sum(c).alias(c) for c in columns])
            now = scratch.save(now)
            if now.agg(F.max("moves_all")).first()[0] <= tolerance * (1 - damping):
                break
    own = start.select("host", "forth", F.col("moves").alias("own"))
    joined = own.join(now.select("host", "forth", "came", "came_all"), ["host", "forth"])
    part = lambda forth, c: F.max(F.when(F.col("forth") == forth, c))
    rank, share = F.col("own") + F.col("came"), F.coalesce(F.try_divide("came", "came_all"), nothing)
    return joined.groupBy("host").agg(
        part(True, rank).alias("trust"), part(False, rank).alias("distrust"), part(True, share).alias("from_trust"), part(False, share).alias("from_distrust")
    )


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str]] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for each row of ``pages``.

    A rule ``host/path`` fits its host and all subdomains if the path starts with the
    rule's; the longest fitting rule decides. Otherwise the host does: its seeds are the
    shares of its pages that rules allow and block, and for the share that no rule decides
    the parts of its incoming PageRank that stem from such seeds count (see ``propagate``).
    The page is blocked if distrust exceeds trust by more than ``threshold`` in this.
    ``trust`` and ``distrust`` are the PageRanks. Pages without a host are allowed. Repeated
    rows are judged alike; null html has no links; extra columns are ignored. A host with a
    large share of all pages is split by partial aggregation and skew-join handling.
    """
    scratch = Scratch(pages.sparkSession, "url-filter")
    host, path = host_and_path(F.col("url"))
    plain = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    own = scratch.save(_rules_by_host(plain.select("host").distinct(), list(rules)))
    best = F.array_max(F.filter("rules", lambda r: F.startswith(F.col("path"), r.start)))
    ruled = scratch.save(
        _with_hosts(plain.drop("html"), own).select("page_id", "host", "path", best.rule.alias("rule"), best.verdict.alias("by_rule"))
    )
    share = lambda v: F.avg(F.when(F.col("by_rule") == v, 1.0).otherwise(0.0))
    seeds = ruled.where("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    seeds, edges = scratch.save(seeds), scratch.save(host_edges(plain))
    ranks = propagate(seeds, edges, scratch).join(seeds.withColumnsRenamed({"trust": "allowed", "distrust": "blocked"}), "host", "left")
    allowed, blocked = (F.coalesce(c, F.lit(0.0)) for c in ("allowed", "blocked"))
    leaning = blocked - allowed + (1 - allowed - blocked) * (F.col("from_distrust") - F.col("from_trust"))
    scores = scratch.save(ranks.select("host", "trust", "distrust", leaning.alias("leaning")))
    trust, distrust = (F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust"))
    by_host = F.when(F.col("leaning") > threshold, "block").otherwise("allow")
    return _with_hosts(ruled, scores).select(
        "page_id", "host", "path", "rule", F.coalesce("by_rule", by_host).alias("verdict"), trust.alias("trust"), distrust.alias("distrust")
    )


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
