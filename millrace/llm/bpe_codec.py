"""BPE encoding through a transducer of the corpus's frequent words, and decoding.

Spark counts the words of all texts; the most frequent are compiled with their ids into a
minimal acyclic transducer, which every task maps into memory. Words outside it are merged.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, transducer
from millrace.llm.scratch import Scratch
from millrace.sources.shared import shared_dir

#: Words that the transducer holds at most, and their bytes; all others are merged exactly.
LEXICON_WORDS = 1 << 15
LEXICON_BYTES = 32
#: Counts are compared by eighths of a power of two when the most frequent words are chosen.
_STEPS = 8


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word binary, n): how often each stretch between two cuts of the texts occurs, for
    stretches of at most LEXICON_BYTES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, words, _ in bpe.runs(batch.column("text")):
                n = np.bincount(np.asarray(words.indices), minlength=len(words.dictionary))
                short = pc.less_equal(pc.binary_length(words.dictionary), LEXICON_BYTES)
                table = pa.RecordBatch.from_arrays([words.dictionary.cast(pa.binary()), pa.array(n.astype(np.int64))], names=["word", "n"])
                yield table.filter(short)

    return _plain(docs).select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, most: int) -> list[bytes]:
    """Up to ``most`` words, none of them rarer than one left out. Only a histogram of at
    most 64 * _STEPS bins and these words reach the driver."""
    scratch = Scratch(docs.sparkSession, "bpe")
    counted = scratch.save(word_counts(docs).withColumn("bin", F.floor(F.log2("n") * _STEPS).cast("int")).where("n > 1"))
    total, floor = 0, None
    for row in sorted(counted.groupBy("bin").count().collect(), reverse=True):
        total += row["count"]
        if total > most:
            break
        floor = row["bin"]
    words = [] if floor is None else [bytes(r["word"]) for r in counted.where(F.col("bin") >= floor).select("word").collect()]
    scratch.drop(counted)
    return words


def _published(spark: SparkSession, data: bytes) -> str:
    """The name under which every executor, later ones too, gets ``data`` as a file of its own."""
    name = f"lexicon-{uuid.uuid4().hex}.npy"
    path = f"{shared_dir(spark)}/{name}"
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = there.getFileSystem(spark._jsc.hadoopConfiguration()).create(there)
    out.write(data)
    out.close()
    spark.sparkContext.addFile(path)
    return name


class Codec:
    """Ids of texts: a word's from the transducer, or merged."""

    def __init__(self, vocabulary: str, lexicon: str | None):
        self.vocabulary = bpe.vocabulary(vocabulary)
        self.lexicon = transducer.Lexicon.mapped(SparkFiles.get(lexicon)) if lexicon else None

    def words(self, dictionary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of distinct words."""
        if self.lexicon is None:
            return self.vocabulary.encode_words(dictionary)
        known, ids, ends = self.lexicon.ids(*bpe.bytes_of(dictionary))
        rest = np.flatnonzero(~known)
        more, more_ends = self.vocabulary.encode_words(dictionary.take(pa.array(rest)).cast(pa.binary()))
        size = np.empty(len(known), np.int64)
        start = np.empty(len(known), np.int64)
        size[known], size[rest] = np.diff(ends), np.diff(more_ends)
        start[known], start[rest] = ends[:-1], more_ends[:-1] + len(ids)
        return bpe.gathered(np.r_[ids, more], start, size)

    def rows(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids of a run of rows, row offsets into them)."""
        for i, _, _, words, at in bpe.runs(texts):
            ids, ends = self.words(words.dictionary)
            which = np.asarray(words.indices).astype(np.int64)
            flat, filled = bpe.gathered(ids, ends[:-1][which], np.diff(ends)[which])
            yield i, flat, filled[at]


@functools.lru_cache(maxsize=1)
def _codec(vocabulary: str, lexicon: str | None) -> Codec:
    return Codec(vocabulary, lexicon)


def compile_lexicon(docs: DataFrame, vocabulary: str, most: int = LEXICON_WORDS) -> str | None:
    """Counts, compiles and publishes the lexicon of ``docs``; None if no word comes twice."""
    words = sorted(frequent_words(docs, most))
    if not words:
        return None
    ids, ends = bpe.vocabulary(vocabulary).encode_words(pa.array(words, pa.binary()))
    pairs = [(w, tuple(ids[a:b].tolist())) for w, a, b in zip(words, ends[:-1], ends[1:], strict=True)]
    return _published(docs.sparkSession, transducer.as_file(transducer.compiled(pairs)))


def encode(docs: DataFrame, vocabulary: str, most: int = LEXICON_WORDS) -> DataFrame:
    """(doc_id, ids): the token ids of each whole text, those that the tokenizers library
    gives for the vocabulary file without adding special tokens.

    A null or empty text has no ids; a null doc_id stays null; repeated rows are encoded
    each; a special token's own text is that token, as in the library. Texts of any length
    are cut only between words. Extra columns are ignored; an empty table gives no rows.
    """
    lexicon = compile_lexicon(docs, vocabulary, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary, lexicon)
        for batch in batches:
            for first, ids, offsets in codec.rows(batch.column("text")):
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(lists)), lists], names=["doc_id", "ids"])

    return _plain(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): special tokens stay, ids without a token and null ids
    give nothing, bytes that are no UTF-8 become replacement characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bpe.vocabulary(vocabulary)
        for batch in batches:
            texts = [words.decode(np.array([x for x in ids or () if x is not None], np.int64)) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<long>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trips(docs: DataFrame, vocabulary: str, most: int = LEXICON_WORDS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of what ``encode`` gives and of
    what ``decode`` makes of it, without sending either through Spark."""
    lexicon = compile_lexicon(docs, vocabulary, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary, lexicon)
        for batch in batches:
            for first, ids, offsets in codec.rows(batch.column("text")):
                decoded, ends = codec.vocabulary.decode_bytes(ids)
                little, spans = ids.astype("<u4"), list(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
                of_ids = [hashlib.sha256(little[a:b]).hexdigest() for a, b in spans]
                of_text = [hashlib.sha256(decoded[ends[a] : ends[b]].tobytes().decode("utf-8", "replace").encode()).hexdigest() for a, b in spans]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(spans)), pa.array(np.diff(offsets)), pa.array(of_ids), pa.array(of_text)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _plain(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op13_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(spark.read.parquet(f"{sf_dir}/documents.parquet"), bpe.default_path())
