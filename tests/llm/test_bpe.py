"""BPE words, transducer and codec against the tokenizers library and brute force."""

import hashlib
import os
import random

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import bpe, bpe_codec, transducer

ODD = [
    "", " ", "a", "  a", "a  b", "don't we'll I'VE 'S's 've", "x\n\n  y\t z\r\n", "é, ×, ÷. ñandú's", "<|endoftext|> a<|endoftext|><|endoftext|> b<|end",
    "aaaaaaaaaa " * 5 + "a" * 1001, "你好，世界" * 300, "１２３ ٣٤ ² x²", " a  b  c　d", "àb é, x", "😀😀 🇫🇷 👨‍👩‍👧", "abc" * 2000, "a.b,c;d:e!f?g",
    "...\n\n\n...  \n x", "\x00\x01 \x7f \x85 a\x85b ​", "word .  . ,\n,", "l'été d'où 12's 3't", "\n a", "a \nb", "a\n", "tab\t\tx  ", "ßẞ ſt ŉ ǅ ʰ ʼ", "٠١ กำ क्",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(bpe.default_path())


def encoded(texts, codec):
    out = []
    for _, ids, offsets in codec.rows(pa.array(texts, pa.string())):
        out += [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return out


def test_ids_are_the_librarys(library):
    rng = random.Random(5)
    letters = [*"aetn sE'.,!\n\t  0７é×ñ你😀ß ́-<|>", "<|endoftext|>", "the ", "'re", "tion"]
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    got = encoded(texts, bpe_codec.Codec(bpe.default_path(), None))
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_decoding_is_the_librarys(library):
    words = bpe.vocabulary(bpe.default_path())
    rng = random.Random(6)
    for _ in range(300):
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 30))]
        assert words.decode(np.array(ids, np.int64)) == library.decode(ids, skip_special_tokens=False)
    assert words.decode(np.array([-1, 60000], np.int64)) == ""


def test_words_merge_together_as_alone(monkeypatch):
    monkeypatch.setattr(bpe, "SHORT", 1000)
    words = bpe.vocabulary(bpe.default_path())
    rng = random.Random(7)
    given = [bytes(rng.choice(b"aeinst\xc3\xa9") for _ in range(rng.randint(1, 300))) for _ in range(200)] + [b"a" * n for n in range(1, 40)]
    ids, ends = words.merge(pa.array(given, pa.binary()))
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [words.merged_alone(w) for w in given]


def lexicon(pairs):
    return transducer.Lexicon(transducer.compiled(pairs))


def found(lex, words):
    known, ids, ends = lex.ids(*bpe.bytes_of(pa.array(words, pa.binary())))
    rows = iter([tuple(ids[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True)])
    return {w: next(rows) for w, k in zip(words, known, strict=True) if k}


def test_transducer_holds_its_words_and_no_others():
    rng = random.Random(1)
    words = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 7))) for _ in range(900)}
    pairs = {w: tuple(rng.randint(0, 3) for _ in range(rng.randint(1, 4))) for w in words}
    probe = [*words, b"", b"zz", b"abcabcabcabc", *{bytes(rng.choice(b"abc") for _ in range(6)) for _ in range(500)} - words]
    assert found(lexicon(list(pairs.items())), probe) == pairs
    assert found(lexicon([]), [b"a", b""]) == {}


def test_transducer_is_minimal():
    """As many states as there are different rests of words and ids behind a prefix."""
    rng = random.Random(2)
    words = {bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 6))) + rng.choice([b"ing", b"ed", b""]) for _ in range(60)}
    pairs = {w: (rng.randint(0, 1), 7) for w in words}
    rests = set()
    for p in {w[:k] for w in pairs for k in range(len(w) + 1)}:
        behind = {w[len(p) :]: ids for w, ids in pairs.items() if w.startswith(p)}
        n = len(os.path.commonprefix(list(behind.values()))) if p else 0
        rests.add(frozenset((w, ids[n:]) for w, ids in behind.items()))
    lex = lexicon(list(pairs.items()))
    assert len(lex.final) == len(rests)


def test_frequent_words_are_the_most_frequent(spark):
    docs = spark.createDataFrame([(i, "one two two six six six six six six six six six" if i % 2 else "one") for i in range(40)], "doc_id long, text string")
    assert bpe_codec.frequent_words(docs, 2) == [b" six"]  # the others are equally frequent
    assert set(bpe_codec.frequent_words(docs, 3)) == {b" six", b"one", b" two"}
    assert bpe_codec.frequent_words(docs, 0) == []


def test_codec_query_equals_the_library(spark, library):
    """All odd texts, a null text, a null id, repeats, an extra column."""
    texts = [*ODD, *ODD, None, "the the the then"]
    rows = [(i if i % 5 else None, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_codec.round_trips(docs, bpe.default_path(), most=20).collect())
    want = []
    for key, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert text == (t or "")
        want.append((key or 0, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want)
    lists = {tuple(r.ids) for r in bpe_codec.encode(docs, bpe.default_path()).collect()}
    assert lists == {tuple(library.encode(t or "", add_special_tokens=False).ids) for t in texts}
    back = bpe_codec.decode(bpe_codec.encode(docs, bpe.default_path()), bpe.default_path())
    assert sorted(r.text for r in back.collect()) == sorted(t or "" for t in texts)


def test_codec_on_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe_codec.round_trips(none, bpe.default_path()).count() == 0


def test_registered_codec(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = bpe_codec.op13_bpe_codec(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
