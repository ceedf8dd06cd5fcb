"""Paths through links of folders, followed for all paths at once.

Every link starts with a pointer, its target. A round rewrites each open pointer by the
pointer of the first link on its way, which by then has itself moved on; so pointers double
their reach, and a chain of n links takes about log2(n) rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.sources.shared import saved

#: A path that grows beyond this goes round in a loop.
LONGEST = 4096


def joined(folder: Column, name: Column) -> Column:
    """``name`` inside ``folder``; a name that begins with / starts at the top."""
    path = F.when(F.startswith(name, F.lit("/")) | (folder == ""), name).otherwise(F.concat(folder, F.lit("/"), name))
    return F.trim(path, F.lit("/"))


def _prefixes(path: Column) -> Column:
    """The path's steps from the first folder to itself."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def _rewritten(open_: DataFrame, links: DataFrame) -> DataFrame:
    """(k, way, met, met_state, onto) of the open ways (k, way): the first link on each, its
    state, and the way by that link's pointer; all null where no link is met."""
    steps = open_.select("k", "way", F.explode(_prefixes(F.col("way"))).alias("link"))
    hits = steps.join(links.select("link", "pointer", "state"), "link")
    first = hits.groupBy("k").agg(F.min_by(F.struct("link", "pointer", "state"), F.length("link")).alias("m"))
    rest = F.expr("substring(way, length(m.link) + 1)")
    onto = F.when(F.col("m.pointer") == "", F.trim(rest, F.lit("/"))).otherwise(F.concat("m.pointer", rest))
    return open_.join(first, "k", "left").select("k", "way", F.col("m.link").alias("met"), F.col("m.state").alias("met_state"), onto.alias("onto"))


def link_targets(nodes: DataFrame) -> tuple[DataFrame, int]:
    """((link, pointer, state), rounds) of the links among ``nodes`` (parent, name, kind, target).

    ``state`` is ``free`` where no link is left on the way to the pointer, or ``loop``. Rounds
    end when nothing is open, or when no pointer got free for as many rounds as a chain of all
    links, and the steps of the longest pointer, could take: what is open then runs into a loop.
    """
    links = nodes.where("kind = 'l'").select(joined(F.col("parent"), F.col("name")).alias("link"), joined(F.col("parent"), F.col("target")).alias("pointer"))
    state = saved(links.groupBy("link").agg(F.min("pointer").alias("pointer")).withColumn("state", F.lit("open")), "links")
    n, steps = state.agg(F.count("*"), F.max(F.size(F.split("pointer", "/")))).first()
    rounds = idle = 0
    left = n
    while left and idle <= n.bit_length() + (steps or 0):
        open_ = state.where("state = 'open'").select(F.col("link").alias("k"), F.col("pointer").alias("way"))
        turned = _rewritten(open_, state).withColumnRenamed("k", "link")
        around = F.col("met_state").eqNullSafe("loop") | (F.col("onto") == F.col("link")) | F.startswith("onto", F.concat("link", F.lit("/"))) | (F.length("onto") > LONGEST)
        now = F.when(F.col("met").isNull(), "free").when(around, "loop").otherwise("open")
        pointer = F.when(F.col("met").isNull() | around, F.col("way")).otherwise(F.col("onto"))
        moved = turned.select("link", pointer.alias("pointer"), now.alias("state"))
        state = saved(state.where("state <> 'open'").select("link", "pointer", "state").union(moved), "links")
        rounds += 1
        before, left = left, state.where("state = 'open'").count()
        idle = 0 if left < before else idle + 1
    return state.withColumn("state", F.when(F.col("state") == "open", "loop").otherwise(F.col("state"))), rounds


def resolved(paths: DataFrame, path: str, nodes: DataFrame) -> DataFrame:
    """``paths`` with ``canonical`` and ``found``: where the path leads once each link on it is
    followed, and ``folder``, ``file``, ``missing`` or ``loop``; canonical is null for the last two.

    ``nodes`` are (parent, name, kind, target): kind d, l or f, parent a canonical folder, ''
    being the top; a link's target is relative to its folder, or to the top if it begins
    with /. A path through a file is missing, as in a file system. The empty path is the top;
    a null one is missing. A link or file that is given twice counts once.
    """
    links, _ = link_targets(nodes)
    links = saved(links, "links")
    way = F.trim(F.col(path), F.lit("/"))
    todo = saved(paths.select(way.alias("path")).where("path IS NOT NULL AND path <> ''").distinct().withColumn("way", F.col("path")), "paths")
    ended = None
    while True:
        turned = _rewritten(todo.withColumnRenamed("path", "k"), links).withColumnRenamed("k", "path")
        bad = F.col("met_state").eqNullSafe("loop") | (F.length("onto") > LONGEST)
        over = saved(turned.select("path", F.when(F.col("met").isNull(), F.col("way")).when(bad, F.lit(None)).otherwise(F.col("onto")).alias("way"), (F.col("met").isNull() | bad).alias("over"), bad.alias("loop")), "paths")
        done = over.where("over").select("path", "way", F.coalesce("loop", F.lit(False)).alias("loop"))
        ended = done if ended is None else ended.union(done)
        todo = over.where("NOT over").select("path", "way")
        if todo.isEmpty():
            break
    kinds = nodes.where("kind <> 'l'").groupBy(joined(F.col("parent"), F.col("name")).alias("way")).agg(F.min("kind").alias("kind"))
    placed = ended.join(kinds, "way", "left")
    found = F.when(F.col("loop"), "loop").when(F.col("kind") == "d", "folder").when(F.col("kind") == "f", "file").otherwise("missing")
    placed = placed.select(F.col("path").alias("__path"), F.when(F.col("kind").isNotNull(), F.col("way")).alias("canonical"), found.alias("found"))
    # the top itself is a folder that no node names
    out = paths.join(placed, way == F.col("__path"), "left")
    top = way == ""
    return out.select(*paths.columns, F.when(top, "").otherwise(F.col("canonical")).alias("canonical"), F.when(top, "folder").otherwise(F.coalesce("found", F.lit("missing"))).alias("found"))
