"""Word stemmers applied to token arrays in Arrow batches.

The stem of a word depends on the word alone, so a batch is reduced to its
distinct words, those are stemmed once, and the arrays are rebuilt: no join and
no shuffle, and the hot words of a corpus cost nothing extra.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col

# Suffix rules of the stemmer published by M. F. Porter (1980),
# as (suffix, replacement), longest match first within a step.
STEP_2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"),
          ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
          ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
          ("iviti", "ive"), ("biliti", "ble"))
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate",
          "iti", "ous", "ive", "ize")

# The published definitions as patterns: a consonant is not a, e, i, o, u, and
# y after a consonant is a vowel; the measure is the number of VC turns.
_C = "(?:[^aeiouy]|^y|(?<=[aeiou])y)"
_V = "(?:[aeiou]|(?<=[^aeiou])y)"
_VOWEL = re.compile(_V)
_TURNS = re.compile(f"{_V}+{_C}+")
_CVC_END = re.compile(f"{_C}{_V}[^aeiouywx]$")
_DOUBLE_END = re.compile(r"([^aeiouylsz])\1$")


def _measure(stem: str) -> int:
    return len(_TURNS.findall(stem))


def _replace_longest(word: str, rules) -> str:
    for suffix, new in sorted(rules, key=lambda r: -len(r[0])):
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            return stem + new if _measure(stem) > 0 else word
    return word


def porter(word: str) -> str:
    """The 1980 algorithm; words of one or two letters stay."""
    if len(word) <= 2:
        return word
    for suffix, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):      # 1a
        if word.endswith(suffix):
            word = word[: len(word) - len(suffix)] + new
            break
    if word.endswith("eed"):                                                         # 1b
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        stem = word[:-2] if word.endswith("ed") else word[:-3] if word.endswith("ing") else None
        if stem is not None and _VOWEL.search(stem):
            if stem.endswith(("at", "bl", "iz")):
                word = stem + "e"
            elif _DOUBLE_END.search(stem):
                word = stem[:-1]
            elif _measure(stem) == 1 and _CVC_END.search(stem):
                word = stem + "e"
            else:
                word = stem
    if word.endswith("y") and _VOWEL.search(word[:-1]):                              # 1c
        word = word[:-1] + "i"
    word = _replace_longest(_replace_longest(word, STEP_2), STEP_3)                  # 2, 3
    for suffix in sorted(STEP_4, key=len, reverse=True):                             # 4
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                word = stem
            break
    if word.endswith("e"):                                                           # 5a
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _CVC_END.search(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word[:-1]) > 1:                              # 5b
        word = word[:-1]
    return word


# Registry of word stemmers; ``register_stemmer`` adds a caller's own.
_STEMMERS = {"porter": porter}
_NAMES = ["porter", "lancaster", "snowball"]


def register_stemmer(name: str, fn) -> None:
    """Make ``fn(word) -> stem`` available under ``name``."""
    _STEMMERS[name] = fn
    if name not in _NAMES:
        _NAMES.append(name)


def resolve_stemmer(name: str = "porter") -> str:
    """Full stemmer name from any prefix, first match in listed order."""
    for full in _NAMES:
        if full.startswith(name.lower()):
            if full not in _STEMMERS:
                raise NotImplementedError(f"stemmer {full} has no implementation here; register_stemmer can add one")
            return full
    raise ValueError(f"unknown stemmer: {name!r}")


def stem_tokens(tokens, stemmer: str = "porter") -> Column:
    """Stem every token of an ``array<string>``."""
    fn = _STEMMERS[resolve_stemmer(stemmer)]

    def stem(batch: pa.Array) -> pa.Array:
        words = batch.flatten().dictionary_encode()
        stems = pa.array([None if w is None else fn(w) for w in words.dictionary.to_pylist()], pa.string())
        # Offsets of the flattened form: lengths per row, nulls as empty.
        lengths = pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False)
        offsets = pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32())
        return pa.ListArray.from_arrays(offsets, stems.take(words.indices), mask=batch.is_null())

    return F.arrow_udf(stem, "array<string>")(_col(tokens))
