"""Scores of a pair of token lists or texts, as Columns."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, edit_text


def shared_words(a, b) -> Column:
    """Tokens found in the other list, both ways, over all tokens; repeats count."""
    a, b = _col(a), _col(b)
    # One sorted list with a marker in front of every word both sides have:
    # a token counts when it equals the last marker.  n log n, no nested scan.
    marks = F.transform(F.array_intersect(a, b), lambda w: F.struct(w.alias("w"), F.lit(0).alias("k")))
    words = F.transform(F.concat(a, b), lambda w: F.struct(w.alias("w"), F.lit(1).alias("k")))
    start = F.struct(F.lit(None).cast("string").alias("w"), F.lit(0).alias("n"))
    hits = F.aggregate(F.array_sort(F.concat(marks, words)), start, lambda s, x: F.struct(
        F.when(x["k"] == 0, x["w"]).otherwise(s["w"]).alias("w"),
        (s["n"] + F.when((x["k"] == 1) & (x["w"] == s["w"]), 1).otherwise(0)).alias("n")), lambda s: s["n"])
    return F.coalesce(F.try_divide(hits, F.size(a) + F.size(b)), F.lit(0.0))


def ochiai(a, b) -> Column:
    a, b = _col(a), _col(b)
    return F.try_divide(F.size(F.array_intersect(a, b)), F.sqrt(F.size(a)) * F.sqrt(F.size(b)))


def jaccard(a, b) -> Column:
    a, b = _col(a), _col(b)
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def overlap(a, b) -> Column:
    a, b = _col(a), _col(b)
    smaller = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.try_divide(F.size(F.array_intersect(a, b)), smaller)


def unique_words(a, b) -> Column:
    """Words on one side only, sorted."""
    a, b = _col(a), _col(b)
    return F.array_sort(F.concat(F.array_except(a, b), F.array_except(b, a)))


def hamming(a, b) -> Column:
    """Positions that differ; the longer text's extra characters all count."""
    def letters(c):
        return F.when(F.length(c) > 0, F.split(c, "")).otherwise(F.array().cast("array<string>"))

    same = F.zip_with(letters(_col(a)), letters(_col(b)), lambda x, y: x.eqNullSafe(y))
    return F.size(F.filter(same, lambda s: ~s))


# Letters of the pairs that are worked on together, which bounds memory whatever a batch holds.
LETTERS = 1 << 21
# Table cells that are filled together: a row of the tables of several pairs.
CELLS = 1 << 15


def _in_slices(score: Callable[[pd.Series, pd.Series], np.ndarray], x: pd.Series, y: pd.Series) -> np.ndarray:
    """``score`` of consecutive pairs of about ``LETTERS`` letters at a time; a longer pair is alone."""
    ends = np.cumsum(x.str.len().to_numpy(np.int64) + y.str.len().to_numpy(np.int64))
    out, at = [], 0
    while at < len(x):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + LETTERS, "right")))
        out.append(score(x.iloc[at:to], y.iloc[at:to]))
        at = to
    return np.concatenate(out) if out else np.empty(0)


def _letters(texts: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts in a row, where each text starts, and its length."""
    size = texts.str.len().to_numpy(np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    return codes, np.cumsum(size) - size, size


def _spread(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ``size`` items of each pair: the pair of every item, and its place there."""
    pair = np.repeat(np.arange(len(size)), size)
    return pair, np.arange(len(pair)) - (np.cumsum(size) - size)[pair]


def _equal_run(a: np.ndarray, start_a: np.ndarray, b: np.ndarray, start_b: np.ndarray, size: np.ndarray, step: int) -> np.ndarray:
    """How many letters of each pair are equal before the first other one, up to ``size``, going on by ``step``."""
    pair, at = _spread(size)
    other = np.flatnonzero(a[start_a[pair] + step * at] != b[start_b[pair] + step * at])
    pairs, first = np.unique(pair[other], return_index=True)
    run = size.copy()
    run[pairs] = at[other[first]]
    return run


def _distance_tables(a: np.ndarray, size_a: np.ndarray, b: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Distances of pairs of padded rows, a row of all their tables at a time.

    A transposition is needed only where the letters of one of the two texts
    stand side by side: with others between them in both, replacing both letters
    costs no more.  So the two rows before are enough, and for each column the row
    before its letter's last one.  Rows hold distances less their column: then
    insertions are a running minimum, and so is the last column that holds a
    row's letter, since that value never grows.
    """
    n, m = a.shape[1], b.shape[1]
    kind = np.int16 if n + m < 4000 else np.int32
    far = kind(np.iinfo(kind).max // 3)                          # more than any distance, and twice that fits
    row = np.zeros((len(a), m + 1), kind)                        # of no letters: the distance is the column
    earlier = before = other_before = None
    swapped = np.full((len(a), m + 1), far, kind)                # the table before the last row with the column's letter, less that row
    out = np.zeros(len(a), np.int64)
    for i in range(1, n + 1):
        earlier, before = before, row
        other = (b != a[:, i - 1, None]).astype(kind)
        row = before + kind(1)
        np.minimum(row[:, 1:], before[:, :-1] + (other - kind(1)), out=row[:, 1:])
        if m > 1:
            other *= far
            # The row's letter stands in the column before, the column's letter further up.
            np.minimum(row[:, 2:], swapped[:, 2:] + (other[:, :-1] + kind(i)), out=row[:, 2:])
            if earlier is not None:
                # The column's letter stands in the row before, the row's letter further left.
                left = np.minimum.accumulate(earlier[:, :-2] + (other[:, :-1] - kind(1)), axis=1)
                np.minimum(row[:, 2:], left + other_before[:, 1:], out=row[:, 2:])
            np.minimum(swapped[:, 2:], before[:, :-2] + (other[:, 1:] - kind(2 + i)), out=swapped[:, 2:])
        np.minimum.accumulate(row, axis=1, out=row)
        other_before = other
        done = np.flatnonzero(size_a == i)
        if len(done):
            out[done] = row[done, size_b[done]].astype(np.int64) + size_b[done]
    return out


def _transposition_distances(x: pd.Series, y: pd.Series) -> np.ndarray:
    """Distances of all pairs: equal ends cut off, pairs of like size compared together."""
    a, start_a, size_a = _letters(x)
    b, start_b, size_b = _letters(y)
    head = _equal_run(a, start_a, b, start_b, np.minimum(size_a, size_b), 1)
    tail = _equal_run(a, start_a + size_a - 1, b, start_b + size_b - 1, np.minimum(size_a, size_b) - head, -1)
    start_a, size_a, start_b, size_b = start_a + head, size_a - head - tail, start_b + head, size_b - head - tail
    out = size_a + size_b
    left = np.flatnonzero((size_a > 0) & (size_b > 0))
    # Columns within an eighth of each other, then like numbers of rows.
    left = left[np.lexsort((size_a[left], np.log2(size_b[left]) * 6 // 1))]
    while len(left):
        # Letters of a row of the first k pairs, padded to the largest among them.
        letters = (np.maximum.accumulate(size_b[left]) + 1) * np.arange(1, len(left) + 1)
        now, left = np.split(left, [max(1, int(np.searchsorted(letters, CELLS, "right")))])
        padded = []
        for codes, start, size, filler in ((a, start_a[now], size_a[now], -1), (b, start_b[now], size_b[now], -2)):
            rows = np.full((len(now), size.max()), filler, np.int32)
            pair, at = _spread(size)
            rows[pair, at] = codes[start[pair] + at]
            padded += [rows, size]
        out[now] = _distance_tables(*padded)
    return out


def _jaro_winklers(x: pd.Series, y: pd.Series, boost_above: float = 0.7) -> np.ndarray:
    """Published formula; the common-prefix boost applies above 0.7 only.

    A letter matches the first free equal one within the window, so every letter of a pair is a matter of its own: the
    places of all letters of all pairs are sorted, and the first, second, ... occurrences are matched together.
    """
    a, start_a, size_a = _letters(x)
    b, start_b, size_b = _letters(y)
    pair_a, at_a = _spread(size_a)
    pair_b, at_b = _spread(size_b)
    window = np.maximum(np.maximum(size_a, size_b) // 2 - 1, 0)
    order = np.argsort(pair_b << 21 | b, kind="stable")
    keys, first, count = np.unique((pair_b << 21 | b)[order], return_index=True, return_counts=True)
    length = max(int(size_b.max(initial=0)), int(size_a.max(initial=0))) + 1
    places = np.repeat(np.arange(len(keys)), count) * length + at_b[order]
    cursor, end = first.copy(), first + count
    # Letters of ``a`` that ``b`` has too, by how often the letter stood before them.
    mine = pair_a << 21 | a
    order_a = np.argsort(mine, kind="stable")
    _, begin, times = np.unique(mine[order_a], return_index=True, return_counts=True)
    rank = np.arange(len(mine)) - np.repeat(begin, times)
    group = np.searchsorted(keys, mine[order_a])
    known = np.append(keys, -1)[group] == mine[order_a]
    rank, group, letter = rank[known], group[known], order_a[known]
    by_rank = np.argsort(rank, kind="stable")
    matched_a, matched_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for turn in np.split(by_rank, np.cumsum(np.bincount(rank))[:-1]) if len(rank) else ():
        g, i = group[turn], letter[turn]
        reach = window[pair_a[i]]
        at = np.maximum(cursor[g], np.searchsorted(places, g * length + np.maximum(at_a[i] - reach, 0)))
        near = at < end[g]
        near[near] = places[at[near]] - g[near] * length <= at_a[i[near]] + reach[near]
        cursor[g] = at + near
        matched_a.append(i[near])
        matched_b.append(order[at[near]])
    taken_a, taken_b = np.sort(np.concatenate(matched_a)), np.sort(np.concatenate(matched_b))
    m = np.bincount(pair_a[taken_a], minlength=len(x))
    half = np.bincount(pair_a[taken_a], a[taken_a] != b[taken_b], minlength=len(x)).astype(np.int64) // 2
    some = np.maximum(m, 1)
    score = np.where(m > 0, (m / np.maximum(size_a, 1) + m / np.maximum(size_b, 1) + (m - half) / some) / 3, 0.0)
    prefix = _equal_run(a, start_a, b, start_b, np.minimum(np.minimum(size_a, size_b), 4), 1)
    score = np.where(score > boost_above, score + prefix * 0.1 * (1 - score), score)
    return np.where((size_a == 0) & (size_b == 0), 1.0, score)


def transposition_distance(a, b) -> Column:
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(_in_slices(_transposition_distances, x.fillna(""), y.fillna("")), dtype="int32")

    return F.pandas_udf(score, "int")(_col(a), _col(b))


def jaro_winkler(a, b) -> Column:
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(_in_slices(_jaro_winklers, x.fillna(""), y.fillna("")), dtype="float64")

    return F.pandas_udf(score, "double")(_col(a), _col(b))


def edit_ready(c) -> Column:
    """Text stripped for edit distances; a missing one reads "empty string"."""
    return F.coalesce(edit_text(c), F.lit("empty string"))


# Scores by name: token scores take token lists, text scores take stripped text.
TOKEN_SCORES: dict[str, Callable[..., Column]] = {
    "shared_words": shared_words, "ochiai": ochiai, "jaccard": jaccard, "overlap": overlap}
TEXT_SCORES: dict[str, Callable[..., Column]] = {
    "damerau_levenshtein": transposition_distance, "jaro_winkler": jaro_winkler, "hamming": hamming}


def pair_score(name: str, a, b) -> Column:
    """A named score of a pair, for callers that choose it at run time."""
    if name in TOKEN_SCORES:
        return TOKEN_SCORES[name](a, b)
    if name in TEXT_SCORES:
        return TEXT_SCORES[name](edit_ready(a), edit_ready(b))
    raise ValueError(f"unknown pair score {name}")
