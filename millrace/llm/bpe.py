"""Byte-level BPE in whole Arrow batches: cutting texts where the pre-tokenizer always
starts anew, exact merging of many words at once, and decoding.

The vocabulary file has no normalizer, splits by the published byte-level pattern

    '(?:[sdmt]|ll|ve|re)| ?L+| ?N+| ?[^ space L N]+| space+(?! nonspace)| space+

and names its special tokens; all this is read from the file, not assumed of its words.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from millrace.llm import textvec

#: Bytes of text that are handled at once; a longer text is a run of its own.
RUN_BYTES = 4 << 20
#: Words of up to so many bytes are merged together, longer ones one by one.
SHORT = 64
_NONE = np.int64(1) << 62


def _inside(x: np.ndarray, first: int, last: int) -> np.ndarray:
    """Whether bytes lie in a range; an unsigned difference wraps around below it."""
    return x - np.uint8(first) <= np.uint8(last - first)


def letters(raw: np.ndarray) -> np.ndarray:
    """Bytes that end a letter for certain: A-Z, a-z, and U+00C0-U+00FF without the two signs
    of multiplication and division."""
    out = _inside(raw | np.uint8(32), ord("a"), ord("z"))
    tail = np.zeros(len(raw), bool)
    tail[1:] = (raw[:-1] == 0xC3) & _inside(raw[1:], 0x80, 0xBF) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
    return out | tail


def cuts(raw: np.ndarray) -> np.ndarray:
    """A flag per byte: a match of the pattern always starts there, whatever stands before.

    What the pattern looks at behind a match must not be cut off either, so white space is
    cut only at its front, or behind a single line feed. That leaves a line feed behind what
    is no white space, a space or a line feed between two such, and a stop behind a letter. Both sides are told from their bytes: printable ASCII, or a
    two-byte character from U+00C0 on, which is never white space.
    """
    n = len(raw)
    out = np.zeros(n, bool)
    if n < 2:
        return out
    prints = _inside(raw, 0x21, 0x7E)
    solid_before = prints.copy()
    solid_before[1:] |= _inside(raw[1:], 0x80, 0xBF) & _inside(raw[:-1], 0xC3, 0xDF)
    solid_here = prints | _inside(raw, 0xC3, 0xDF)
    line = raw == 0x0A
    space = raw == 0x20
    stop = (raw == 0x2C) | (raw == 0x2E) | (raw == 0x21) | (raw == 0x3F) | _inside(raw, 0x3A, 0x3B)
    out[1:] = (solid_before[:-1] & line[1:]) | (letters(raw)[:-1] & stop[1:])
    between = solid_before[:-2] & solid_here[2:]
    out[1:-1] |= between & space[1:-1]
    out[2:] |= between & line[1:-1]
    return out


def runs(texts: pa.Array, size: int = RUN_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.DictionaryArray, np.ndarray]]:
    """(first row, bytes, row offsets into them, words as a dictionary, first word of each row
    and their number) of runs of rows; a run's words, put together, are its bytes."""
    raw_all, offsets = textvec.flat(texts)
    for i, j in textvec.pieces(offsets, size):
        raw, own = raw_all[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        begins = np.zeros(len(raw) + 1, bool)
        begins[:-1] = cuts(raw)
        begins[own] = True
        begins[-1] = True
        at = np.flatnonzero(begins)
        if len(raw) == 0:
            at = np.zeros(1, np.int64)
        wide = len(raw) >= 1 << 31
        kind = pa.LargeBinaryArray if wide else pa.BinaryArray
        words = kind.from_buffers(*([pa.large_binary()] if wide else [pa.binary()]), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64 if wide else np.int32)), pa.py_buffer(raw)])
        yield i, raw, own, words.dictionary_encode(), np.searchsorted(at, own)


def bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a binary array without nulls."""
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    wide = pa.types.is_large_binary(words.type)
    _, places, data = words.buffers()
    if data is None or not len(words):
        return np.zeros(0, np.uint8), np.zeros(len(words) + 1, np.int64)
    o = np.frombuffer(places, np.int64 if wide else np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[o[0] : o[-1]], o - o[0]


def gathered(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of the stretches of ``pool`` put one behind another."""
    filled = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=filled[1:])
    return pool[np.repeat(start - filled[:-1], size) + np.arange(filled[-1])], filled


class Vocabulary:
    """The merges, byte values and special tokens of one vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        tokenizer = Tokenizer.from_file(path)
        self.model = tokenizer.model
        spec = json.loads(tokenizer.to_str())
        model, vocab = spec["model"], spec["model"]["vocab"]
        if model["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": spec["pre_tokenizer"].get("trim_offsets"), "use_regex": True}:
            raise ValueError("not a plain byte-level vocabulary")
        self.split = ByteLevel(add_prefix_space=False, use_regex=True)
        # the printable stand-ins of bytes: printable Latin-1 for itself, the rest from U+0100 on
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(plain)]
        self.sign = {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}
        self.shown = {b: c for c, b in self.sign.items()}
        self.byte_id = np.array([vocab[self.shown[b]] for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        if len(np.unique(made)) < len(made):
            raise ValueError("a token that two merges make")
        key = (left << 32) | right
        order = np.argsort(key)
        self.key, self.rank, self.made = key[order], order.astype(np.int64), made[order]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("special tokens that take in what is around them")
        longest = sorted(self.special, key=len, reverse=True)
        self.special_at = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        self.special_bytes = [t.encode() for t in longest]
        # what each id stands for; a token with a character that is no sign is its own text
        tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.n = max(tokens) + 1
        value = [bytes(map(self.sign.__getitem__, t)) if all(c in self.sign for c in t) else t.encode() for t in (tokens.get(i, "") for i in range(self.n))]
        self.size = np.array([len(v) for v in value], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.pool = np.frombuffer(b"".join(value), np.uint8)

    # -- encoding

    def _merges(self, ids: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Places in the merge table of adjacent ids, -1 for no merge."""
        key = (ids << 32) | other
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, at, -1)

    def _merged_together(self, ids: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, word of each) after all merges, of n words in order. In a round every word
        does its best merge at all places, leftmost first where they overlap; what a merge
        makes only enters later merges, so this is the order of one merge at a time."""
        done_ids, done_word = [], []
        at = np.full(len(ids), -1, np.int64)
        fresh = np.arange(len(ids))  # places whose pair with the next is to be looked up
        while len(ids):
            last = np.r_[word[1:] != word[:-1], True]
            paired = fresh[~last[fresh]]
            at[fresh] = -1
            at[paired] = self._merges(ids[paired], ids[paired + 1])
            rank = np.where(at >= 0, self.rank[at], _NONE)
            begin = np.flatnonzero(np.r_[True, last[:-1]])
            best = np.repeat(np.minimum.reduceat(rank, begin), np.diff(np.r_[begin, len(ids)]))
            over = best == _NONE
            if over.any():
                done_ids.append(ids[over])
                done_word.append(word[over])
                ids, word, at, rank, best = (x[~over] for x in (ids, word, at, rank, best))
                if not len(ids):
                    break
            hit = rank == best
            # in a chain of adjacent hits, as for a pair of equal tokens, every second one counts
            place = np.arange(len(hit))
            start = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], place, 0))
            hit &= (place - start) % 2 == 0
            ids = np.where(hit, self.made[at], ids)
            keep = np.r_[True, ~hit[:-1]]
            new = np.cumsum(keep)[hit] - 1
            fresh = np.r_[new, new[new > 0] - 1]
            ids, word, at = ids[keep], word[keep], at[keep]
        ids, word = np.concatenate(done_ids or [ids]), np.concatenate(done_word or [word])
        order = np.argsort(word, kind="stable")
        return ids[order], word[order]

    def merged_alone(self, value: bytes) -> list[int]:
        """Ids of one word of any length, by the library's own merges."""
        return [t.id for t in self.model.tokenize("".join(map(self.shown.__getitem__, value)))]

    def merge(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of words that the pattern would not split."""
        raw, o = bytes_of(words)
        size = np.diff(o)
        long = np.flatnonzero(size > SHORT)
        short = np.repeat(size <= SHORT, size)
        ids, word = self._merged_together(self.byte_id[raw[short]], np.repeat(np.arange(len(size)), size)[short], len(size))
        n = np.bincount(word, minlength=len(size)).astype(np.int64)
        if len(long):
            alone = {int(w): np.array(self.merged_alone(raw[o[w] : o[w + 1]].tobytes()), np.int64) for w in long}
            n[long] = [len(alone[int(w)]) for w in long]
            start = np.cumsum(n) - n
            out = np.empty(int(n.sum()), np.int64)
            fill = np.repeat(size <= SHORT, n)
            out[fill] = ids
            for w, x in alone.items():
                out[start[w] : start[w] + len(x)] = x
            ids = out
        return ids, np.r_[0, np.cumsum(n)]

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of each stretch between two cuts: letters alone, behind at most one
        space, are one word; others go through the pattern first."""
        raw, o = bytes_of(words)
        size = np.diff(o)
        if not len(raw):
            return np.zeros(0, np.int64), np.zeros(len(size) + 1, np.int64)
        fine = letters(raw)
        fine[:-1] |= (raw[:-1] == 0xC3) & fine[1:] & (raw[1:] >= 0x80)
        fine[o[:-1][size > 1]] |= raw[o[:-1][size > 1]] == 0x20
        counts = np.r_[0, np.cumsum(fine)]
        simple = counts[o[1:]] - counts[o[:-1]] == size
        odd = np.flatnonzero(~simple)
        if not len(odd):
            return self.merge(words)
        # the odd ones are split into words, those without a place of their own keep a special id
        parts: list[bytes] = []
        owner: list[int] = []
        fixed: dict[int, int] = {}
        for w, value in zip(odd.tolist(), words.take(pa.array(odd)).to_pylist(), strict=True):
            for k, text in enumerate(self._around_special(value)):
                if k % 2:
                    fixed[len(parts)] = self.special[text]
                    parts.append(b"")
                    owner.append(w)
                    continue
                for token, _ in self.split.pre_tokenize_str(text) if text else ():
                    parts.append(bytes(map(self.sign.__getitem__, token)))
                    owner.append(w)
        plain = np.flatnonzero(simple)
        all_words = pa.concat_arrays([words.take(pa.array(plain)).cast(pa.binary()), pa.array(parts, pa.binary())])
        ids, ends = self.merge(all_words)
        place = np.r_[plain, np.array(owner, np.int64)]
        n = np.diff(ends)
        if fixed:
            at = np.array(list(fixed)) + len(plain)
            ids = np.insert(ids, ends[at], list(fixed.values()))
            n[at] = 1
            ends = np.r_[0, np.cumsum(n)]
        order = np.argsort(place, kind="stable")
        ids, _ = gathered(ids, ends[:-1][order], n[order])
        total = np.bincount(place, weights=n, minlength=len(size)).astype(np.int64)
        return ids, np.r_[0, np.cumsum(total)]

    def _around_special(self, value: bytes) -> list[str]:
        text = value.decode()
        return self.special_at.split(text) if self.special_at and any(s in value for s in self.special_bytes) else [text]

    # -- decoding

    def decode_bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets by id); ids without a token have none."""
        ids = np.asarray(ids, np.int64)
        known = (ids >= 0) & (ids < self.n)
        safe = np.where(known, ids, 0)
        return gathered(self.pool, self.start[safe], np.where(known, self.size[safe], 0))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        return self.decode_bytes(ids)[0].tobytes().decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One for all tasks that a Python worker runs."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Vocabulary(path)


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
