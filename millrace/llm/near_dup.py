"""MinHash near-duplicates with a circulant signature.

One permutation scrambles the shingle universe, a second is applied to every circular
shift of it; the shifts give all signature coordinates. Bands of coordinates propose
pairs, and each proposed pair is decided on the full shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm import textvec
from millrace.llm.components import connected_components
from millrace.llm.scratch import Scratch

BANDS, ROWS = 32, 4
COORDS = BANDS * ROWS
_U = np.uint64
_U32 = np.uint32

#: Rows of a shingle block while a signature is computed: with COORDS columns it stays in cache.
_BLOCK = 256


def _second_permutation(x: np.ndarray, tmp: np.ndarray) -> None:
    """A bijection of 32-bit words, in place."""
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        np.right_shift(x, _U32(shift), out=tmp)
        np.bitwise_xor(x, tmp, out=x)
        np.multiply(x, _U32(factor), out=x)
    np.right_shift(x, _U32(16), out=tmp)
    np.bitwise_xor(x, tmp, out=x)


def signature(shingles: np.ndarray) -> np.ndarray:
    """COORDS minima: coordinate k is the least image of the scrambled set shifted by k."""
    first = ((shingles * _U(0x9E3779B97F4A7C15)) >> _U(32)).astype(_U32)
    shifts = np.arange(COORDS, dtype=_U32)
    out = np.full(COORDS, 0xFFFFFFFF, dtype=_U32)
    for at in range(0, len(first), _BLOCK):
        x = first[at : at + _BLOCK, None] + shifts[None, :]
        _second_permutation(x, np.empty_like(x))
        np.minimum(out, x.min(axis=0), out=out)
    return out


def _bands(sigs: np.ndarray) -> np.ndarray:
    """Per row one 64-bit key for each band."""
    halves = np.ascontiguousarray(sigs).view(np.uint64).reshape(len(sigs), BANDS, ROWS // 2)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * _U(0xA24BAED4963EE407)
    for part in range(ROWS // 2):
        key = textvec.mix(key + halves[:, :, part])
    return key.view(np.int64)


def _per_row(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    for first, words, offsets in textvec.word_hashes(batch.column("text")):
        yield first, textvec.shingle_hashes(words, offsets, k)


def _list_column(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def sketch(docs: DataFrame, k: int = 5) -> DataFrame:
    """(doc_id, n, fp_a, fp_b, bands): size and fingerprint of each full shingle set, and
    its band keys (none for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, sets in _per_row(batch, k):
                n = np.array([len(s) for s in sets], dtype=np.int64)
                a = np.array([(s * _U(0x9FB21C651E98DF25)).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
                b = np.array([textvec.mix(s).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
                full = n > 0
                sigs = np.array([signature(s) for s in sets if len(s)], dtype=_U32).reshape(-1, COORDS)
                bands = _bands(sigs).ravel() if len(sigs) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, len(sets)),
                        pa.array(n),
                        pa.array(textvec.mix(a).view(np.int64)),
                        pa.array(textvec.mix(b ^ a).view(np.int64)),
                        _list_column(bands, full * BANDS),
                    ],
                    names=["doc_id", "n", "fp_a", "fp_b", "bands"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n long, fp_a long, fp_b long, bands array<long>"
    )


def shingle_sets(docs: DataFrame, k: int = 5) -> DataFrame:
    """(doc_id, shingles): the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, sets in _per_row(batch, k):
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, len(sets)),
                        _list_column(np.concatenate(sets), np.array([len(s) for s in sets])),
                    ],
                    names=["doc_id", "shingles"],
                )

    return docs.mapInArrow(run, "doc_id long, shingles array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb) whose full sets reach the similarity."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    union = F.col("na") + F.col("nb") - shared
    return pairs.join(left, "a").join(right, "b").where(100 * shared >= percent * union).select("a", "b")


def _pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Distinct ordered pairs; sets whose sizes alone rule the similarity out are left."""
    return (
        rows.where(F.col("x") != F.col("y"))
        .where(100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny"))
        .select(
            F.least("x", "y").alias("a"),
            F.greatest("x", "y").alias("b"),
            F.when(F.col("x") < F.col("y"), F.col("nx")).otherwise(F.col("ny")).alias("na"),
            F.when(F.col("x") < F.col("y"), F.col("ny")).otherwise(F.col("nx")).alias("nb"),
        )
        .distinct()
    )


def _step_of(size: Column) -> Column:
    """Sizes in steps of a tenth; what may be similar lies within a few steps."""
    return F.floor(F.log(size.cast("double")) / math.log(1.1)).cast("int")


def _kinds_that_reach(several: DataFrame, percent: int) -> DataFrame:
    """(s, nx, fx, ny, fy): which kinds of members behind a shingle can be similar, a kind being
    a set's size n and how much of it is left, f, from the shingle on.

    With no more than the lesser f in common, sizes n and m must satisfy
    (100 + percent) * f >= percent * (n + m); so a kind reaches an interval of sizes, which
    may be empty. Kinds meet by shingle and step of size, however many members they have.
    """
    least = F.ceil(F.col("n") * percent / 100)
    most = F.floor((100 + percent) * F.col("f") / percent - F.col("n"))
    kinds = several.select("s", "n", "f").distinct().withColumn("lo", least).withColumn("hi", most).where("lo <= hi")
    x = kinds.select("s", *[F.col(c).alias(c + "x") for c in ("n", "f", "lo", "hi")], F.explode(F.sequence(_step_of(F.col("lo")), _step_of(F.col("hi")))).alias("step"))
    y = kinds.select("s", *[F.col(c).alias(c + "y") for c in ("n", "f", "lo", "hi")], _step_of(F.col("n")).alias("step"))
    both = F.col("ny").between(F.col("lox"), F.col("hix")) & F.col("nx").between(F.col("loy"), F.col("hiy"))
    return x.join(y, ["s", "step"]).where(both).select("s", "nx", "fx", "ny", "fy")


def _sharing_rare_shingles(rest: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (x, y, nx, ny) of ``rest`` (rep, n, part) in different parts that may still reach
    the similarity; none that does is missing.

    Each set is ordered from its rarest shingle on. Similar sets must share one among the
    first n - ceil(percent% of n) + 1, and at their first common shingle enough of either
    set must be left. What many texts have in common comes last and proposes nothing.
    Behind a shingle first kinds of members are paired, then parts that hold such kinds,
    and only then their members.
    """
    held = rest.join(sets.withColumnRenamed("doc_id", "rep"), "rep").select("rep", "n", "part", F.explode("shingles").alias("s"))
    # written out, as is what follows, so that both sides of a join are shuffled for it and skew can be split
    often = scratch.save(held.groupBy("s").agg(F.count("*").alias("df")).where("df > 1"))
    shared = held.join(often, "s")
    own = Window.partitionBy("rep")
    rare_first = own.orderBy("df", "s")
    # what is in no other set comes before all that is shared
    placed = shared.withColumn("f", F.count("*").over(own) - F.row_number().over(rare_first) + 1)
    prefix = placed.where(F.col("n") - F.col("f") < F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    prefix = scratch.save(prefix.select("s", "rep", "n", "part", "f"))
    split = prefix.groupBy("s").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a <> b").select("s")
    several = scratch.save(prefix.select("s", "part", "n", "f").distinct().join(split, "s", "left_semi"))
    reach = scratch.save(_kinds_that_reach(several, percent))
    if reach.isEmpty():
        return rest.limit(0).select(F.col("rep").alias("x"), F.col("rep").alias("y"), F.col("n").alias("nx"), F.col("n").alias("ny"))
    p = several.select("s", F.col("part").alias("px"), F.col("n").alias("nx"), F.col("f").alias("fx"))
    q = several.select("s", F.col("part").alias("py"), F.col("n").alias("ny"), F.col("f").alias("fy"))
    one = scratch.save(p.join(reach, ["s", "nx", "fx"]))
    met = scratch.save(one.join(q, ["s", "ny", "fy"]).where("px < py"))
    x = prefix.select("s", *[F.col(c).alias(d) for c, d in (("rep", "x"), ("n", "nx"), ("part", "px"), ("f", "fx"))])
    y = prefix.select("s", *[F.col(c).alias(d) for c, d in (("rep", "y"), ("n", "ny"), ("part", "py"), ("f", "fy"))])
    half = scratch.save(met.join(x, ["s", "px", "nx", "fx"]))
    return half.join(y, ["s", "py", "ny", "fy"]).select("x", "y", "nx", "ny")


def _joined_parts(parts: DataFrame, more: DataFrame, scratch: Scratch) -> DataFrame:
    """``parts`` (node, component) after further links: only the components that these touch
    are nodes now."""
    a = parts.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    b = parts.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    ends = more.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    up = scratch.save(connected_components(ends, scratch))
    above = up.select(F.col("node").alias("component"), F.col("component").alias("top"))
    moved = parts.join(above, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    return moved.union(up.join(parts.select("node"), "node", "left_anti"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``.

    Texts with one shingle set form a class, represented by its smallest doc_id. Bands
    propose pairs of representatives; in each bucket the member with most collisions is
    compared first, which joins nearly all of a family to it; members that are still
    apart are then paired by rare shingles they share. Every comparison uses the full sets.

    Empty or null texts have no shingles and stay alone. Rows with a null doc_id take the
    class of their set if it has an id, else a null component, and are not kept. Rows
    sharing a doc_id share its component. Extra columns are ignored; an empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dup")
    base = scratch.save(sketch(docs, k))
    key = ["fp_a", "fp_b", "n"]
    classes = base.where("n > 0 AND doc_id IS NOT NULL").groupBy(*key).agg(F.min("doc_id").alias("rep"))
    classes = scratch.save(classes)
    reps = base.where("n > 0").select("doc_id", "n", "bands").join(classes.select("rep"), F.col("doc_id") == F.col("rep"), "left_semi")
    rows = reps.select(F.col("doc_id").alias("rep"), "n", F.explode("bands").alias("key"))
    buckets = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = scratch.save(rows.join(buckets, "key").dropDuplicates(["key", "rep"]))

    degree = members.groupBy("rep").agg(F.sum(F.col("size") - 1).alias("degree"))
    pivots = (
        members.join(degree, "rep")
        .groupBy("key")
        .agg(F.max(F.struct("degree", (-F.col("rep")).alias("minus"), "n")).alias("top"))
        .select("key", (-F.col("top.minus")).alias("y"), F.col("top.n").alias("ny"))
    )
    first = scratch.save(_pairs(members.join(pivots, "key").withColumnsRenamed({"rep": "x", "n": "nx"}), percent))
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = scratch.save(shingle_sets(plain.join(wanted, "doc_id", "left_semi"), k))
    links = scratch.save(_confirmed(first, sets, percent))
    parts = scratch.save(connected_components(links, scratch))

    placed = members.join(parts.withColumnRenamed("node", "rep"), "rep", "left").withColumn("part", F.coalesce("component", "rep"))
    apart = placed.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("key")
    rest = scratch.save(placed.join(apart, "key", "left_semi").select("rep", "n", "part").distinct())
    if not rest.isEmpty():
        second = _pairs(_sharing_rare_shingles(rest, sets, percent, scratch), percent)
        more = scratch.save(_confirmed(second, sets, percent))
        if not more.isEmpty():
            parts = scratch.save(_joined_parts(parts, more, scratch))
    scratch.drop(members, first, sets, rest)

    placed = classes.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select(*key, F.coalesce("component", "rep").alias("component"))
    out = base.drop("bands").join(placed, key, "left")
    component = F.coalesce("component", "doc_id")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"),
    )


def op2_near_dup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
