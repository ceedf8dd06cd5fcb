"""A rule-driven suffix stemmer for English words, the same for texts (columns) and queries.

A step tries its rules in order; the first whose suffix fits and whose rest is long enough,
with a vowel where one is asked for, replaces the suffix. The steps follow one another.
"""

from __future__ import annotations

from functools import partial
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

VOWELS = "aeiouy"


class Rule(NamedTuple):
    suffix: str
    instead: str
    least: int  # characters in front of the suffix
    vowel: bool = False  # whether one of them must be a vowel


def _rules(least: int, vowel: bool, *pairs: str) -> tuple[Rule, ...]:
    return tuple(Rule(*p.partition(">")[::2], least, vowel) for p in pairs)


#: A rule that keeps a suffix shields it from the shorter ones behind it.
STEPS: tuple[tuple[Rule, ...], ...] = (
    _rules(1, False, "sses>ss", "ss>ss", "us>us", "is>is") + _rules(2, False, "ies>y") + _rules(2, True, "s>"),
    _rules(2, False, "eed>ee", "ied>y") + _rules(0, False, "eed>eed") + _rules(2, True, "ingly>", "edly>", "ing>", "ed>"),
    # what a verb's ending leaves: a lost e, or a doubled consonant
    _rules(2, True, "at>ate", "iz>ize", "bl>ble") + tuple(Rule(2 * c, c, 2, True) for c in "bdfgmnprt"),
    _rules(3, True, "ization>ize", "ational>ate", "fulness>ful", "iveness>ive", "ousness>ous", "ation>ate", "ator>ate", "iness>y", "ness>", "ement>", "ment>", "able>", "ible>"),
    _rules(3, True, "ically>ic", "ally>al", "ily>y", "ly>"),
    _rules(3, True, "e>") + _rules(2, True, "y>i"),
)


def stem(word: str) -> str:
    for step in STEPS:
        for r in step:
            rest = word[: len(word) - len(r.suffix)]
            if word.endswith(r.suffix) and len(rest) >= r.least and not (r.vowel and not set(rest) & set(VOWELS)):
                word = rest + r.instead
                break
    return word


def always_in(stemmed: str) -> str:
    """What every word of this stem holds: the stem without a last i or y, which may stand
    for the other. What the steps add besides is an e that the last one takes."""
    return stemmed[:-1] if stemmed.endswith(("i", "y")) else stemmed


def _step(rules: tuple[Rule, ...], word: Column) -> Column:
    out = None
    for r in rules:
        rest = F.left(word, F.length(word) - len(r.suffix))
        fits = F.endswith(word, F.lit(r.suffix)) & (F.length(word) >= len(r.suffix) + r.least)
        if r.vowel:
            fits &= F.length(F.translate(rest, VOWELS, "")) < F.length(rest)
        new = F.concat(rest, F.lit(r.instead))
        out = F.when(fits, new) if out is None else out.when(fits, new)
    return out.otherwise(word)


def stems(words: Column) -> Column:
    """The stems of an array of words; a pass over the array for each step."""
    for rules in STEPS:
        words = F.transform(words, partial(_step, rules))
    return words
