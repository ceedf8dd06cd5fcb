"""Approximate nearest neighbours by inner product: a hierarchical k-means tree searched
best bin first, visiting as many leaves as a calibration against brute force asks for.

The tree is refined in Spark until its leaves hold a bounded number of vectors at any size
of the table; a query then pays for the leaves it visits, not for a share of all vectors.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.scratch import Scratch

#: Bounds of what reaches the driver: vectors that one node is fitted on, and queries whose
#: exact neighbours calibrate the visits. Every vector is indexed.
SAMPLE_ROWS, CALIBRATION_QUERIES = 16_384, 200
#: A leaf of more vectors is split again, as long as the tree has fewer than MAX_LEAVES,
#: which bounds the tree that every task holds; beyond, leaves grow with the table.
BRANCH, LEAF_ROWS, MAX_LEAVES = 8, 512, 1 << 16
#: Sampled vectors that a leaf-to-be is fitted on.
LEAF_SAMPLE = 32
#: Vectors of neighbouring leaves, and queries, that meet in one group.
SHARD_ROWS, CELL_QUERIES = 4096, 2048
#: The part of its leaves that a query visits first; of the others it is only told what beats
#: the k-th score so far.
FIRST_PART = 1 / 8
#: Classes of equal vectors are broadcast up to so many rows.
BROADCAST_ROWS = 100_000


@dataclass
class Tree:
    """Children follow their parents; children[i] is empty for a leaf. Centres have one more
    component than the vectors, which makes largest inner product smallest distance."""

    centres: np.ndarray
    children: list[list[int]]
    bound: float

    def leaves(self) -> list[int]:
        """Depth first, so that neighbouring leaves stand together."""
        out, stack = [], [0]
        while stack:
            node = stack.pop()
            if self.children[node]:
                stack += reversed(self.children[node])
            else:
                out.append(node)
        return out

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.maximum(self.bound**2 - (x * x).sum(axis=1), 0)
        return np.hstack([x, np.sqrt(rest)[:, None]])

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: down the tree to the nearest child."""
        x, out = self.lift(x), np.zeros(len(x), dtype=np.int64)
        stack = [(0, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            kids = self.children[node]
            if not kids:
                out[rows] = node
                continue
            own = _distances(x[rows], self.centres[kids]).argmin(axis=1)
            stack += [(kids[c], rows[own == c]) for c in np.unique(own).tolist()]
        return out

    def best_bins(self, query: np.ndarray) -> Iterator[int]:
        """All leaves, the most promising first; a node is looked into when it is the best
        one left in the queue."""
        flat = np.append(query, 0.0)
        heap = [(0.0, 0)]
        while heap:
            _, node = heapq.heappop(heap)
            kids = self.children[node]
            if not kids:
                yield node
                continue
            for d, kid in zip(_distances(flat[None, :], self.centres[kids])[0].tolist(), kids, strict=True):
                heapq.heappush(heap, (d, kid))

    def visits(self, query: np.ndarray, leaves: int, filled: dict[int, int], enough: int) -> list[int]:
        """At least ``leaves`` filled leaves, more while they hold fewer than ``enough`` vectors."""
        order, held = [], 0
        for leaf in self.best_bins(query):
            if filled.get(leaf):
                order.append(leaf)
                held += filled[leaf]
                if len(order) >= leaves and held >= enough:
                    break
        return order

    def graft(self, leaf: int, part: Tree) -> None:
        """Puts another tree in the place of a leaf."""
        base = len(self.children) - 1
        self.centres = np.vstack([self.centres, part.centres[1:]])
        self.children[leaf] = [base + c for c in part.children[0]]
        self.children += [[base + c for c in kids] for kids in part.children[1:]]


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (centres * centres).sum(axis=1)[None, :] - 2 * (x @ centres.T)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = _distances(x, centres).argmin(axis=1)
        for c in range(k):
            members = x[own == c]
            centres[c] = members.mean(axis=0) if len(members) else x[rng.integers(len(x))]
    return centres, _distances(x, centres).argmin(axis=1)


def fit_tree(sample: np.ndarray, bound: float, leaf_sample: int, branch: int = BRANCH) -> Tree:
    """Splits the sample into ``branch`` clusters again and again, down to ``leaf_sample``."""
    rng = np.random.default_rng(9)
    tree = Tree(np.zeros((1, sample.shape[1] + 1)), [[]], bound)
    x = tree.lift(sample)
    centres, queue = [x.mean(axis=0)], [(0, np.arange(len(x)))]
    while queue:
        node, rows = queue.pop(0)
        if len(rows) <= leaf_sample or len(np.unique(x[rows], axis=0)) < branch:
            continue
        split, own = _kmeans(x[rows], branch, rng)
        for c in range(branch):
            if (own == c).any():
                tree.children[node].append(len(centres))
                tree.children.append([])
                queue.append((len(centres), rows[own == c]))
                centres.append(split[c])
    tree.centres = np.array(centres)
    return tree


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): vectors with an id, finite, without nulls and not zero, as doubles; rows
    that share a vec_id count as one, with the smallest of their vectors."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != F.lit(float("inf"))))
    return (
        vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
        .where(finite & F.exists(v, lambda e: e != 0))
        .groupBy(F.col("vec_id").cast("long").alias("vec_id"))
        .agg(F.min(v).alias("v"))
    )


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Row-wise inner products, added from the first component on."""
    out = np.zeros(len(q))
    for d in range(q.shape[1]):
        out += q[:, d] * c[:, d]
    return out


def _first_of_each(i: np.ndarray, ids: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each i: highest score first, ties to the smaller id."""
    order = np.lexsort((ids, -s, i))
    i = i[order]
    return order[np.arange(len(i)) - np.searchsorted(i, i) < k]


def _nearest(q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, candidate index, score) of each query's k best candidates."""
    scores = q @ x.T
    if scores.shape[1] > k:
        least = np.partition(scores, -k, axis=1)[:, -k][:, None]
        i, j = np.nonzero(scores >= least - 1e-9 * np.maximum(np.abs(least), 1e-30))
    else:
        i, j = (a.ravel() for a in np.indices(scores.shape))
    s = _exact(q[i], x[j])
    keep = _first_of_each(i, ids[j], s, k)
    return i[keep], j[keep], s[keep]


def _just_under(x: np.ndarray) -> np.ndarray:
    """So much less that no order of summing the products matters."""
    finite = np.where(np.isfinite(x), x, 0.0)
    return x - 1e-9 * np.maximum(np.abs(finite), 1e-30)


def _above(q: np.ndarray, who: np.ndarray, ids: np.ndarray, x: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, candidate id, score) of what may still be among the best of the queries
    ``who``. ``best`` has each query's best scores so far, in any order, and is updated."""
    scores = q[who] @ x.T
    i, j = np.nonzero(scores >= _just_under(best[who].min(axis=1))[:, None])
    out = who[i], ids[j], scores[i, j]
    rows = np.unique(i)
    both = np.concatenate([best[who[rows]], scores[rows]], axis=1)
    best[who[rows]] = np.partition(both, both.shape[1] - best.shape[1], axis=1)[:, -best.shape[1] :]
    return out


def _best(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _placed(ready: DataFrame, tree: Tree, scratch: Scratch) -> DataFrame:
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = tree.assign(_matrix(b.column("v")))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(leaf)], names=["vec_id", "v", "leaf"])

    return scratch.save(ready.mapInArrow(place, "vec_id long, v array<double>, leaf long"))


def index(ready: DataFrame, scratch: Scratch) -> tuple[Tree, DataFrame, dict[int, int]]:
    """(tree, vectors with their leaf, vectors in each leaf). The top is fitted on a sample
    on the driver; leaves that turn out too large are split by subtrees that Spark fits,
    each on a sample of its own leaf, until all are small or cannot be split."""
    rows, bound = ready.agg(F.count("*"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e)))).first()
    leaf_rows = max(LEAF_ROWS, -(-2 * rows // MAX_LEAVES))
    sample = np.array(ready.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).toPandas()["v"].tolist())
    tree = fit_tree(sample, bound, leaf_sample=max(2 * BRANCH, leaf_rows * len(sample) // rows))
    tried: set[int] = set()
    # vectors whose leaf stays, with how many each leaf has; only those of split leaves are placed again
    settled: DataFrame | None = None
    counted: dict[int, int] = {}
    placed = _placed(ready, tree, scratch)
    while True:
        filled = {r.leaf: r["count"] for r in placed.groupBy("leaf").count().collect()}
        large = {leaf: n for leaf, n in filled.items() if n > leaf_rows and leaf not in tried}
        if rows <= len(sample) or not large or len(filled) + len(counted) >= MAX_LEAVES:
            return tree, placed if settled is None else settled.union(placed), counted | filled
        share = {leaf: min(1.0, min(SAMPLE_ROWS, LEAF_SAMPLE * -(-n // leaf_rows)) / n) for leaf, n in large.items()}

        def chosen(batches: Iterator[pa.RecordBatch], share: dict[int, float] = share) -> Iterator[pa.RecordBatch]:
            for b in batches:
                of = np.array([share.get(x, 0.0) for x in b.column("leaf").to_pylist()])
                yield b.filter(pa.array(b.column("u").to_numpy() < of))

        def split(group: pd.DataFrame) -> pd.DataFrame:
            part = fit_tree(np.stack(group["v"]), bound, leaf_sample=LEAF_SAMPLE)
            parent = np.zeros(len(part.children), np.int64)
            for node, kids in enumerate(part.children):
                parent[kids] = node
            return pd.DataFrame({"leaf": group["leaf"].iloc[0], "node": np.arange(len(parent)), "parent": parent, "centre": list(part.centres)})

        draw = (F.pmod(F.xxhash64("vec_id", F.lit(len(tried))), F.lit(1 << 30)) / float(1 << 30)).alias("u")
        some = placed.select("leaf", "v", draw).mapInArrow(chosen, "leaf long, v array<double>, u double")
        parts = some.groupBy("leaf").applyInPandas(split, "leaf long, node long, parent long, centre array<double>").toPandas()
        grafted = []
        for leaf, nodes in parts.groupby("leaf"):
            nodes = nodes.sort_values("node")
            children: list[list[int]] = [[] for _ in range(len(nodes))]
            for node, parent in zip(nodes["node"].tolist()[1:], nodes["parent"].tolist()[1:], strict=True):
                children[parent].append(node)
            if children[0]:
                tree.graft(int(leaf), Tree(np.array(nodes["centre"].tolist()), children, bound))
                grafted.append(int(leaf))
        tried |= large.keys()
        # at most MAX_LEAVES rows
        split_leaves = F.broadcast(ready.sparkSession.createDataFrame([(leaf,) for leaf in grafted], "leaf long"))
        staying = placed.join(split_leaves, "leaf", "left_anti").select("vec_id", "v", "leaf")
        settled = staying if settled is None else settled.union(staying)
        counted |= {leaf: n for leaf, n in filled.items() if leaf not in set(grafted)}
        placed = _placed(placed.join(split_leaves, "leaf", "left_semi").select("vec_id", "v"), tree, scratch)


def _calibrated(tree: Tree, placed: DataFrame, queries: DataFrame, filled: dict[int, int], k: int, recall: float) -> int:
    """The fewest leaves at which the sampled queries' exact neighbours, found by brute
    force over all vectors, are met at the wanted recall."""
    some = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CALIBRATION_QUERIES).toPandas()
    q_ids, q = some["vec_id"].to_numpy(), np.array(some["v"].tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]
        for b in batches:
            ids, leaf = b.column("vec_id").to_numpy(), b.column("leaf").to_numpy()
            if len(ids):
                i, j, s = _nearest(q, ids, _matrix(b.column("v")), k + 1)
                best = [np.concatenate(p) for p in zip(best, (i, ids[j], s, leaf[j]), strict=True)]
                keep = _first_of_each(best[0], best[1], best[2], k + 1)
                best = [a[keep] for a in best]
        i, ids, s, leaf = best
        other = q_ids[i] != ids
        yield pa.RecordBatch.from_arrays([pa.array(x[other]) for x in (q_ids[i], ids, s, leaf)], names=["query_id", "vec_id", "score", "leaf"])

    truth = _best(placed.mapInArrow(run, "query_id long, vec_id long, score double, leaf long"), k).toPandas()
    needed = []
    for i, own in truth.groupby("query_id")["leaf"]:
        missing, at = Counter(own), 0
        for leaf in tree.best_bins(q[np.flatnonzero(q_ids == i)[0]]):
            if not missing:
                break
            if filled.get(leaf):
                at += 1
                needed += [at] * missing.pop(leaf, 0)
    needed.sort()
    return needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)] if needed else 1


def _shards(tree: Tree, filled: dict[int, int]) -> dict[int, tuple[int, int]]:
    """First and last shard of each filled leaf: leaves follow one another in shards of
    about SHARD_ROWS vectors, and a leaf of more is spread over several."""
    out, at = {}, 0
    for leaf in tree.leaves():
        n = filled.get(leaf, 0)
        if n:
            out[leaf] = (at // SHARD_ROWS, (at // SHARD_ROWS) + (n - 1) // SHARD_ROWS)
            at += n
    return out


def _search(tree: Tree, placed: DataFrame, queries: DataFrame, filled: dict[int, int], leaves: int, k: int, scratch: Scratch) -> DataFrame:
    """(query_id, vec_id, score, rank): the k best of the leaves that each query visits."""
    some = max(1, int(leaves * FIRST_PART))
    first = scratch.save(_best(_visited(tree, placed, queries.withColumn("floor", F.lit(float("-inf"))), filled, leaves, (0, some), k, scratch), k))
    floors = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
    asking = queries.join(floors, "vec_id", "left").select("vec_id", "v", F.coalesce("least", F.lit(float("-inf"))).alias("floor"))
    rest = _visited(tree, placed, asking, filled, leaves, (some, None), k, scratch)
    return _best(first.drop("rank").union(rest), k)


def _visited(
    tree: Tree, placed: DataFrame, queries: DataFrame, filled: dict[int, int], leaves: int, part: tuple[int, int | None], k: int, scratch: Scratch
) -> DataFrame:
    """(query_id, vec_id, score): of each shard the k best in a part of the leaves that each
    query visits, without those under the query's floor."""
    shards = _shards(tree, filled)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, to, seen = [], [], []
            for i, q in enumerate(_matrix(b.column("v"))):
                own: dict[int, list[int]] = {}
                for leaf in tree.visits(q, leaves, filled, k)[part[0] : part[1]]:
                    for s in range(shards[leaf][0], shards[leaf][1] + 1):
                        own.setdefault(s, []).append(leaf)
                at += [i] * len(own)
                to += own.keys()
                seen += own.values()
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).take(rows) for c in ("vec_id", "v", "floor")), pa.array(to, pa.int64()), pa.array(seen, pa.list_(pa.int64()))], names=["query_id", "q", "floor", "shard", "leaves"]
            )

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("vec_id").to_numpy()
            first, last = (np.array([shards[x][n] for x in b.column("leaf").to_pylist()], np.int64) for n in (0, 1))
            spread = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(first + spread % (last - first + 1))], names=["vec_id", "v", "leaf", "shard"])

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(left) and len(right):
            q, visited = np.stack(right["q"]), pd.Series(right["leaves"].tolist()).explode()
            asking = {leaf: own.index.to_numpy() for leaf, own in visited.groupby(visited.astype("int64"))}
            best = np.repeat(right["floor"].to_numpy()[:, None], k, axis=1)
            for leaf, own in left.groupby("leaf"):
                if leaf in asking:
                    who = asking[leaf]
                    found.append(_above(q, who, own["vec_id"].to_numpy(), np.stack(own["v"]), best))
            floor = _just_under(best.min(axis=1))
        i, ids, s = (np.concatenate(p) for p in zip(*found, strict=True))
        if len(i):
            keep = np.flatnonzero(s >= floor[i])
            i, ids = i[keep], ids[keep]
            x = left.set_index("vec_id")["v"]
            s = _exact(q[i], np.stack(x.loc[ids]))
            keep = _first_of_each(i, ids, s, k)
            i, ids, s = i[keep], ids[keep], s[keep]
        return pd.DataFrame({"query_id": right["query_id"].to_numpy()[i], "vec_id": ids, "score": s})

    asked = scratch.save(queries.select("vec_id", "v", "floor").mapInArrow(ask, "query_id long, q array<double>, floor double, shard long, leaves array<long>"))
    # as many rows as there are shards that are asked: Spark sends them to the vectors while they are few
    cells = scratch.save(asked.groupBy("shard").agg(F.ceil(F.count("*") / CELL_QUERIES).alias("cells")))
    held = placed.mapInArrow(deal, "vec_id long, v array<double>, leaf long, shard long").join(cells, "shard")
    held = held.select("vec_id", "v", "leaf", "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)).alias("cell"))
    asking = asked.join(cells, "shard").withColumn("cell", F.pmod(F.monotonically_increasing_id(), F.col("cells"))).drop("cells")
    keys = ["shard", "cell"]
    return held.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, recall: float = 0.95) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, by inner product.

    ``is_query`` is a condition on vec_id. Equal vectors form a class that is indexed and
    searched once; of a class the k + 1 smallest ids can be among k neighbours, so a vector
    that a third of all rows hold costs no more than another, and no result is lost. The
    tree's top is fitted on at most SAMPLE_ROWS vectors and refined until a leaf holds at
    most LEAF_ROWS classes (see ``index``). Queries widen their leaf visits to the count
    that CALIBRATION_QUERIES of them needed for ``recall``, and on until k + 1 classes are
    met. Scores are double precision products of the original vectors; ties go to the
    smaller vec_id. Null, zero and non-finite vectors neither ask nor answer, nor do
    vectors of another length than the most common one (the smaller length, if two are
    equally common); an empty table gives an empty result; extra columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    all_vectors = scratch.save(usable(vectors))
    out = "query_id long, rank int, vec_id long, score double"
    length = all_vectors.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if length is None:
        return spark.createDataFrame([], out)
    alike = Window.partitionBy("v").orderBy("vec_id")
    numbered = all_vectors.where(F.size("v") == length.dim).withColumn("nth", F.row_number().over(alike))
    first_ids = scratch.save(numbered.where(F.col("nth") <= k + 1).withColumn("vec_class", F.first("vec_id").over(alike)))
    classes = first_ids.where("nth = 1").select("vec_id", "v")
    copies = first_ids.where("vec_id <> vec_class").select("vec_class", F.col("vec_id").alias("copy"))
    asking = all_vectors.where(F.size("v") == length.dim).where(is_query)
    by_class = scratch.save(
        asking.join(first_ids.where("nth = 1").select(F.col("vec_id").alias("vec_class"), F.col("v").alias("own")), F.col("v") == F.col("own")).select("vec_id", "vec_class")
    )
    queries = classes.join(by_class.select(F.col("vec_class").alias("vec_id")).distinct(), "vec_id", "left_semi")
    if by_class.isEmpty():
        return spark.createDataFrame([], out)
    tree, placed, filled = index(classes, scratch)
    leaves = _calibrated(tree, placed, queries, filled, k, recall)
    found = _search(tree, placed, queries, filled, leaves, k + 1, scratch).select("query_id", F.col("vec_id").alias("vec_class"), "score")

    small = copies.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    more = found.join(F.broadcast(copies) if small else copies, "vec_class").select("query_id", F.col("copy").alias("vec_id"), "score")
    listed = _best(found.select("query_id", F.col("vec_class").alias("vec_id"), "score").union(more), k + 1)
    lists = listed.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("near"))
    own = by_class.join(lists, F.col("vec_class") == F.col("query_id")).select(
        F.col("vec_id").alias("query"), F.slice(F.filter("near", lambda n: n.vec_id != F.col("vec_id")), 1, k).alias("near")
    )
    return own.select(F.col("query").alias("query_id"), F.posexplode("near").alias("at", "n")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("n.vec_id").alias("vec_id"), F.col("n.score").alias("score")
    )


def op9_ann(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
