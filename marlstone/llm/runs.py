"""Periodic runs of words: dyadic blocks looked for in neighbouring windows by range successor over the suffix array."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from marlstone.llm.common import free_name

MIN_LENGTH = 12
# Words handled together; a longer text is handled alone.
PART_WORDS = 1 << 18

PERIODIC = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("runs", T.ArrayType(T.StructType([
        T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("period", T.LongType())]))),
    T.StructField("collapsed", T.StringType())])
_PERIODIC_ARROW = pa.struct([
    ("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
    ("collapsed", pa.string())])


class _Suffixes:
    """Suffix array of several texts of word codes by doubling, with the class of every 2**k words kept per level.

    ``levels[k][i]`` is the place in the suffix array where the group of suffixes starts that share 2**k
    words with suffix i: equal for two suffixes when, and only when, both have these words within one
    text.  Only groups of several suffixes are sorted again.  ``blocks`` has, for each level from 1 on, the
    suffixes that start at a multiple of 2**k of their text and share that many words with another one,
    with the ends of their group.
    """

    def __init__(self, codes: np.ndarray, starts: np.ndarray):
        n = len(codes)
        lengths = np.diff(np.append(starts, n))
        first = np.repeat(starts, lengths)
        self.ends = np.repeat(starts + lengths, lengths)
        key = first * (int(codes.max()) + 1 if n else 1) + codes
        array = np.argsort(key, kind="stable")
        rank = np.full(n + 1, -1, np.int32)                 # one more: no suffix is equal to the end
        act, pos, key = np.arange(n), array, key[array]
        self.array, self.levels, self.blocks, self.repeated, k = array, [], [], np.zeros(0, np.int64), 0
        while True:
            new = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
            at = np.flatnonzero(new)
            sizes = np.diff(np.append(at, len(key)))
            rank = rank.copy()
            rank[pos] = np.repeat(act[at], sizes)
            self.levels.append(rank)
            several = np.repeat(sizes > 1, sizes)
            size = np.repeat(sizes, sizes)[several]
            act, pos = act[several], pos[several]
            if k == 1:
                self.repeated = act
            if k:
                block = (pos - first[pos]) % (1 << k) == 0
                low = rank[pos[block]].astype(np.int64)
                self.blocks.append((k, pos[block], low, low + size[block]))
            if not len(act):
                break
            after = pos + (1 << k)
            key = rank[pos].astype(np.int64) * (n + 2) + np.where(after < self.ends[pos], rank[np.minimum(after, n)] + 1, 0)
            order = np.argsort(key, kind="stable")
            pos, key = pos[order], key[order]
            array[act] = pos
            k += 1

    def common_after(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words from i and from j > i on that are the same."""
        got = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            rank = self.levels[k]
            got += (rank[i + got] == rank[j + got]) << k
        return got

    def common_before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words before i and before j > i that are the same."""
        got = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            rank, a, b = self.levels[k], i - got - (1 << k), j - got - (1 << k)
            got += ((a >= 0) & (rank[np.maximum(a, 0)] == rank[np.maximum(b, 0)])) << k
        return got


class _Wavelet:
    """Wavelet tree over numbers below 2**bits, one bit after the other; all queries take arrays."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.zeros = bits, []
        for bit in range(bits - 1, -1, -1):
            one = (values >> bit) & 1 == 1
            self.zeros.append(np.append(0, np.cumsum(~one)).astype(np.int32))
            values = np.concatenate((values[~one], values[one]))

    def below(self, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many of the numbers at low..high-1 are less than x."""
        got = np.zeros(len(low), np.int64)
        for zeros, bit in zip(self.zeros, range(self.bits - 1, -1, -1), strict=True):
            up, a, b = (x >> bit) & 1 == 1, zeros[low], zeros[high]
            got += np.where(up, b - a, 0)
            low, high = np.where(up, zeros[-1] + low - a, a), np.where(up, zeros[-1] + high - b, b)
        return got

    def at_rank(self, low: np.ndarray, high: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The number of that rank, from 0, among those at low..high-1."""
        got = np.zeros(len(low), np.int64)
        for zeros, bit in zip(self.zeros, range(self.bits - 1, -1, -1), strict=True):
            a, b = zeros[low], zeros[high]
            up = rank >= b - a
            rank = np.where(up, rank - (b - a), rank)
            got += up.astype(np.int64) << bit
            low, high = np.where(up, zeros[-1] + low - a, a), np.where(up, zeros[-1] + high - b, b)
        return got


def _short_periods(codes: np.ndarray, first: np.ndarray, min_length: int) -> list[np.ndarray]:
    """(start, length, period) for periods 1 to 3, whose blocks are single words: stretches of words equal to the one before."""
    found = []
    for q in (1, 2, 3):
        same = np.zeros(max(len(codes) - q, 0) + 2, np.int8)
        if len(codes) > q:
            same[1:-1] = (codes[q:] == codes[:-q]) & (first[q:] == first[:-q])
        edges = np.diff(same)
        start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        length = end - start + q
        wanted = (end - start >= q) & (length >= min_length)
        found.append(np.stack((start[wanted], length[wanted], np.full(wanted.sum(), q))))
    return found


def _candidates(suffixes: _Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """(place, period): every run of period 4 and more has one of them with its period and a place in its first period.

    A period q with 2b <= q < 4b, b = 2**k, has a block of b words at a multiple of b within the first period
    of a run, which occurs again q words later.  The two windows of b starts that hold q are asked for the
    block's occurrences: the first, the second and their number by range successor.  Three or more stand in
    progression d, the block's own period.  Let the block and the progression lie in the stretches [l1, r1)
    and [l2, r2) of period d.  In one stretch, q would be a multiple of d.  In two, the run's period moves the
    left end of the one to that of the other, or the right end, or the stretches touch: then every member
    counts.
    """
    places, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if not len(suffixes.repeated):
        return places[0], periods[0]
    n = len(suffixes.array)
    tree = _Wavelet(suffixes.array[suffixes.repeated], n.bit_length())

    def found(place, other):
        places.append(place)
        periods.append(other - place)

    for k, pos, low, high in suffixes.blocks:
        b = 1 << k
        size, low = high - low, np.searchsorted(suffixes.repeated, low)
        for window in (2 * b, 3 * b):
            inside = pos + window < suffixes.ends[pos]
            p, a = pos[inside], low[inside]
            z = a + size[inside]
            before = tree.below(a, z, p + window)
            number = tree.below(a, z, np.minimum(p + window + b, suffixes.ends[p])) - before
            some = number > 0
            p, a, z, before, number = p[some], a[some], z[some], before[some], number[some]
            if not len(p):
                continue
            first = tree.at_rank(a, z, before)
            two = number > 1
            second = tree.at_rank(a[two], z[two], before[two] + 1)
            few = number < 3
            found(p[few], first[few])
            found(p[two][number[two] == 2], second[number[two] == 2])
            many = number[two] > 2
            if not many.any():
                continue
            p, x, m = p[two][many], first[two][many], number[two][many]
            d = second[many] - x
            r1 = p + d + suffixes.common_after(p, p + d)
            other = r1 < x + b
            p, x, m, d, r1 = p[other], x[other], m[other], d[other], r1[other]
            l1 = p - suffixes.common_before(p, p + d)
            l2 = x - suffixes.common_before(x, x + d)
            r2 = x + d + suffixes.common_after(x, x + d)
            found(p, p + l2 - l1)
            found(p, p + r2 - r1)
            touch = l2 <= r1
            member = np.arange(m[touch].sum()) - np.repeat(np.cumsum(m[touch]) - m[touch], m[touch])
            found(np.repeat(p[touch], m[touch]), np.repeat(x[touch], m[touch]) + member * np.repeat(d[touch], m[touch]))
    return np.concatenate(places), np.concatenate(periods)


def runs_of(codes: np.ndarray, starts: np.ndarray, min_length: int = MIN_LENGTH) -> np.ndarray:
    """Rows (start, length, period) of all runs in texts of word codes that begin at ``starts``, by start and period."""
    n = len(codes)
    first = np.repeat(starts, np.diff(np.append(starts, n)))
    suffixes = _Suffixes(codes, starts)
    place, period = _candidates(suffixes)
    valid = (period > 0) & (place + period < n)
    place, period = place[valid], period[valid]
    place, period = np.unique(np.stack((place, period)), axis=1) if len(place) else (place, period)
    after = suffixes.common_after(place, place + period)
    before = suffixes.common_before(place, place + period)
    wanted = (after + before >= period) & (after + before + period >= min_length)
    longer = np.stack((place - before, after + before + period, period))[:, wanted]
    rows = np.concatenate([*_short_periods(codes, first, min_length), longer], axis=1).astype(np.int64)
    # A multiple of the smallest period has the same stretch.
    rows = rows[:, np.lexsort((rows[2], rows[1], rows[0]))]
    smallest = np.append(True, np.any(rows[:2, 1:] != rows[:2, :-1], axis=0)) if rows.shape[1] else np.zeros(0, bool)
    rows = rows[:, smallest]
    return rows[:, np.lexsort((rows[2], rows[0]))].T


def _scan(texts: list[bytes | None], min_length: int) -> list[dict]:
    words = [text.split() if text else [] for text in texts]            # white space of bytes: blank and 9 to 13
    sizes = np.array([len(w) for w in words], np.int64)
    of = defaultdict(count().__next__)
    codes = np.fromiter((of[w] for ws in words for w in ws), np.int64, int(sizes.sum()))
    ends = np.cumsum(sizes)
    runs = runs_of(codes, (ends - sizes)[sizes > 0], min_length)
    edges = np.searchsorted(runs[:, 0], np.append(ends - sizes, len(codes)))
    out = []
    for k, own in enumerate(words):
        rows = runs[edges[k]:edges[k + 1]] - (ends[k] - sizes[k], 0, 0)
        kept = own
        if len(rows):
            change = np.zeros(len(own) + 1, np.int64)
            np.add.at(change, rows[:, 0] + rows[:, 2], 1)
            np.add.at(change, rows[:, 0] + rows[:, 1], -1)
            kept = [own[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
        out.append({"n_words": len(own), "runs": [{"start": s, "length": n, "period": q} for s, n, q in rows.tolist()],
                    "collapsed": b" ".join(kept).decode()})
    return out


def find_runs(docs: DataFrame, text_col: str = "text", min_length: int = MIN_LENGTH, part_words: int = PART_WORDS) -> DataFrame:
    """``docs`` with a last column ``periodic`` (see ``PERIODIC``): number of words, periodic runs, text without the repeats.

    Words are what blanks and the characters 9 to 13 separate.  A run is a stretch of consecutive words with
    smallest period q, at least ``min_length`` and two periods long, that no neighbouring word extends;
    ``runs`` has all of them by start and period, ``collapsed`` the words that no run contains after its
    first q words, joined by one blank.  The column is named ``periodic_`` and so on where ``docs`` has one of
    that name.

    No shuffle.  Texts are taken about ``part_words`` words at a time, longer ones whole; memory is some
    hundred bytes for each word of a part and level of doubling.  Null and empty texts have no words, no
    runs and an empty collapsed text; repeated rows have equal results; an empty table has no rows.
    """
    name = free_name(docs, "periodic")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary())
            size = np.array(pc.fill_null(pc.binary_length(texts), 0), np.int64)
            # About six bytes a word.
            part = np.cumsum(size) // (6 * part_words)
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
            for a, z in zip(cuts, cuts[1:], strict=False):
                if z > a:
                    found = pa.array(_scan(texts.slice(a, z - a).to_pylist(), min_length), _PERIODIC_ARROW)
                    yield pa.RecordBatch.from_arrays([*batch.slice(a, z - a).columns, found], names=[*batch.schema.names, name])

    return docs.mapInArrow(scan, T.StructType([*docs.schema, T.StructField(name, PERIODIC)]))
