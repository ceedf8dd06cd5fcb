"""Packing token sequences: first-fit decreasing over a tournament tree of bin capacities.

Documents are tokenized once, cut into whole sequences and a remainder, and the pieces
are dealt at random into groups of bounded size; each group is packed on its own.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import bpe
from millrace.llm.scratch import Scratch

#: Pieces that are packed together. More of them leave less padding; the time of a group
#: grows as n log n.
GROUP_PIECES = 4096

#: Bytes of text that are encoded at once; a longer text is a run of its own.
RUN_BYTES = 8 << 20


class Encoder:
    """Token ids of whole texts. Each distinct word of a run of texts is merged once; nothing
    is kept from one run to the next, so memory follows the run, not the words met so far."""

    def __init__(self, path: str, end_id: int = 0):
        self.vocabulary = bpe.vocabulary(path)
        self.end_id = end_id

    def rows(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids of a run of rows, row offsets into them), each row closed by end_id."""
        for i, _, _, words, at in bpe.runs(texts, RUN_BYTES):
            ids, ends = self.vocabulary.encode_words(words.dictionary)
            which = np.asarray(words.indices).astype(np.int64)
            flat, filled = bpe.gathered(ids.astype(np.uint32), ends[:-1][which], np.diff(ends)[which])
            row_ids = filled[at]
            yield i, np.insert(flat, row_ids[1:], np.uint32(self.end_id)), row_ids + np.arange(len(row_ids))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for all tasks that a Python worker runs."""
    return Encoder(path)


def token_pieces(docs: DataFrame, tokenizer: str, size: int) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, deal): whole sequences and a
    remainder of each document; deal is a random number that is drawn once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = encoder(tokenizer)
        rng = np.random.default_rng([TaskContext.get().partitionId(), 8])
        for batch in batches:
            for first, ids, offsets in own.rows(batch.column("text")):
                total = np.diff(offsets)
                n = -(-total // size)
                row = np.repeat(np.arange(len(total)), n)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * size
                length = np.minimum(total[row] - start, size)
                at = offsets[:-1][row] + start
                little = ids.astype("<u4", copy=False)
                crc = [zlib.crc32(little[a : a + m]) for a, m in zip(at.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(first + row)),
                        pa.array(start),
                        pa.array(length),
                        pa.array(crc, pa.int64()),
                        pa.array(total[row]),
                        pa.array(rng.integers(0, 1 << 62, len(row))),
                    ],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "deal"],
                )

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, deal long")


def first_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length: longest first, each into the first bin with room.

    The bins' free room is the bottom row of a tournament tree whose inner nodes hold the
    larger of two children, so the first bin with room is found by one walk down.
    """
    n = len(lengths)
    leaves = 1 << max(n - 1, 0).bit_length()
    room = [size] * (2 * leaves)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    for k in np.argsort(-lengths, kind="stable").tolist():
        need, at = int(lengths[k]), 1
        while at < leaves:
            at *= 2
            if room[at] < need:
                at += 1
        bins[k], offsets[k] = at - leaves, size - room[at]
        room[at] -= need
        while at > 1:
            at //= 2
            best = max(room[2 * at], room[2 * at + 1])
            if room[at] == best:
                break
            room[at] = best
    return bins, offsets


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): one row per piece.

    A document is its token ids and then id 0, so an empty or null text is the one id 0.
    It is cut at every ``size`` ids. The pieces are dealt at random into groups of about
    ``group_pieces``, which are packed independently, so no group grows with the input;
    repeated rows and equal lengths are pieces like any other, a null doc_id stays null.
    Extra columns are ignored and an empty table gives no pieces.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.save(token_pieces(docs, tokenizer, size))
    groups = max(1, -(-pieces.count() // group_pieces))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "start", "deal"])
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(), size)
        return group.assign(sequence_id=group["part"] * (1 << 32) + bins, offset=offsets).drop(columns=["part", "deal"])

    return (
        pieces.withColumn("part", F.pmod("deal", F.lit(groups)))
        .groupBy("part")
        .applyInPandas(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    )


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), bpe.default_path())
