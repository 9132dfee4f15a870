"""MinHash near-duplicates: circulant signatures, banding, and exact Jaccard similarity on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import free_name, quoted, text_hash
from marlstone.llm.components import connected_components
from marlstone.session import write_cut

SHINGLE = 5
THRESHOLD_PERCENT = 75
COORDINATES = 64
ROWS = 4
FIRST_PIVOTS = 16
# Counters of shingle frequencies that go to the driver and all tasks, whatever the input: collisions blur the order, not the result.
COUNTERS = 1 << 18
# Words of 64 bits in the parity bitmap of a set.
PARITY = tuple(f"b{i}" for i in range(8))

# Odd multipliers (fixed values): two for each of the two permutations of the 32-bit numbers, one for word positions.
_SIGMA = (np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))
_PI = (np.uint32(0x7FEB352D), np.uint32(0x846CA68B))
_STEP = 0x9E3779B97F4A7C15
_PARITY = np.uint64(0xD6E8FEB86659FD93)


def shingle_set(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; the whole sequence if it is shorter than one."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    of = xxhash.xxh3_64_intdigest
    hashes = np.array([of(w) for w in words], np.uint64)
    n = min(size, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out += hashes[k:k + len(out)] * np.uint64(pow(_STEP, k + 1, 1 << 64))
        out ^= out >> np.uint64(29)
    return np.unique(out)


def _permute(x: np.ndarray, by: tuple[np.uint32, np.uint32]) -> np.ndarray:
    """A permutation of the 32-bit numbers: every step can be undone."""
    x = x ^ (x >> np.uint32(16))
    x = x * by[0]
    x ^= x >> np.uint32(15)
    x *= by[1]
    x ^= x >> np.uint32(16)
    return x


def signature(shingles: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """Circulant MinHash: the set goes through one permutation, and coordinate k is the least value of a second one shifted by k."""
    spread = _permute((shingles ^ (shingles >> np.uint64(32))).astype(np.uint32), _SIGMA)
    out = np.full(coordinates, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(spread), 8192):          # stays in the processor's cache
        part = spread[at:at + 8192]
        for k in range(coordinates):
            out[k] = min(out[k], _permute(part + np.uint32(k + 1), _PI).min())
    return out


def band_columns(coordinates: int = COORDINATES, rows: int = ROWS) -> np.ndarray:
    """Coordinates of each band: two different ways to deal all of them out, so that a pair has twice the chances."""
    straight = np.arange(coordinates).reshape(-1, rows)
    return np.concatenate([straight, np.arange(coordinates).reshape(rows, -1).T])


def parity(shingles: np.ndarray) -> np.ndarray:
    """A bitmap of the set, one bit for each cell that holds an odd number of its members.

    Every bit in which two bitmaps differ needs a member that only one of the sets has, so the number of
    such bits is never above the size of the symmetric difference.
    """
    cells = len(PARITY) * 64
    at = ((shingles ^ (shingles >> np.uint64(32))) * _PARITY >> np.uint64(64 - cells.bit_length() + 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=cells).astype(np.uint8) & 1).view(np.int64)


def _sketch(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(doc, th, n, key, bands): size and 128-bit digest of the shingle set, and the keys of its bands."""
    columns = band_columns()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, key, bands = [], [], []
            for text in batch.column(2).to_pylist():
                found = shingle_set(text, size)
                n.append(len(found))
                key.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                if len(found):
                    s = signature(found)[columns]
                    bands.append([xxhash.xxh3_64_intdigest(row.tobytes(), seed=i) - (1 << 63) for i, row in enumerate(s)])
                else:
                    bands.append([])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                                             names=["doc", "th", "n", "key", "bands"])

    rows = docs.select(quoted(id_col).cast("long").alias("doc"), text_hash(quoted(text_col)).alias("th"), quoted(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(sketch, "doc long, th long, n long, key binary, bands array<long>")


def _overlap(a: Column, b: Column) -> Column:
    """Size of the intersection of two sets kept as sorted 64-bit numbers in bytes."""
    @F.pandas_udf("long")
    def common(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([len(np.intersect1d(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), assume_unique=True)) for p, q in zip(x, y, strict=True)],
                         dtype="int64")

    return common(a, b)


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sets are as similar as asked, counted on the full sets."""
    a = sets.select(F.col("s").alias("u"), F.col("n").alias("nu"), F.col("hashes").alias("hu"))
    b = sets.select(F.col("s").alias("v"), F.col("n").alias("nv"), F.col("hashes").alias("hv"))
    sizes = sets.select("s", "n")
    # Sizes alone rule many pairs out before any set is moved.
    sized = (pairs.join(sizes.select(F.col("s").alias("u"), F.col("n").alias("nu")), "u").join(sizes.select(F.col("s").alias("v"), F.col("n").alias("nv")), "v")
             .where(100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv")).select("u", "v"))
    both = sized.join(a, "u").join(b, "v").withColumn("common", _overlap(F.col("hu"), F.col("hv")))
    return both.where(100 * F.col("common") >= percent * (F.col("nu") + F.col("nv") - F.col("common"))).select("u", "v")


def _star(members: DataFrame) -> DataFrame:
    """Every member of a bucket with its smallest one."""
    least = members.groupBy("band").agg(F.min("s").alias("v"))
    return members.join(least, "band").where(F.col("s") != F.col("v")).select(F.col("s").alias("u"), "v").distinct()


def _placed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members with their component, if any, else themselves."""
    return members.join(roots, members["s"] == roots["node"], "left").select(*members.columns, F.coalesce("component", "s").alias("root"))


def _prefix_buckets(members: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(band, s, n, at, parity): the buckets of several components dealt anew, by the rarest shingles of their members.

    Of two sets as similar as asked, the rarest n - ceil(n * percent / 100) + 1 shingles of each share
    one, in whatever order all sets have in common.  Here that is the order of the frequency among these
    members, so texts that share a common passage only, as frequent as it may be, come apart.  ``n`` is the
    size of the set and ``at`` the place of the shingle in its order; the words of the set's parity bitmap
    are columns of their own.
    """
    parted = _placed(members, roots).groupBy("band").agg(F.min("root").alias("a"), F.max("root").alias("b")).where(F.col("a") != F.col("b")).select("band")
    parted_sets = write_cut(sets.join(members.join(parted, "band", "left_semi").select("s").distinct(), "s", "left_semi").select("s", "hashes"), "open-sets")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                hashes = np.frombuffer(b"".join(batch.column(1).slice(at, 1024).to_pylist()), np.uint64)
                total += np.bincount((hashes % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["cell", "n"])

    frequency = np.zeros(COUNTERS, np.int64)
    for r in parted_sets.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toLocalIterator():
        frequency[r["cell"]] = r["n"]
    shared = sets.sparkSession.sparkContext.broadcast(frequency)

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                columns = [[np.empty(0, np.int64)] for _ in range(4 + len(PARITY))]
                for s, hashes in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    h = np.frombuffer(hashes, np.uint64)
                    first = np.lexsort((h, shared.value[(h % np.uint64(COUNTERS)).astype(np.int64)]))[:len(h) + (-len(h) * percent) // 100 + 1]
                    per_set = [np.full(len(first), x) for x in (s, len(h), *parity(h))]
                    for column, values in zip(columns, (h[first].view(np.int64), np.arange(len(first)), *per_set), strict=True):
                        column.append(values)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=["band", "at", "s", "n", *PARITY])

    keyed = write_cut(parted_sets.mapInArrow(rarest, ", ".join(f"{c} long" for c in ("band", "at", "s", "n", *PARITY))), "rarest-shingles")
    several = keyed.groupBy("band").agg(F.min("s").alias("a"), F.max("s").alias("b")).where(F.col("a") != F.col("b")).select("band")
    return keyed.join(several, "band", "left_semi")


def _across(members: DataFrame, roots: DataFrame, done: DataFrame, pivots: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pivots and pairs still to be tried: in buckets of several components, pivots outside the largest one with all members of other
    components, where size and place allow for enough in common if this is the first shingle they share, and the parity bitmaps for a
    symmetric difference that is small enough; and the members of the buckets that have more such members than pivots.  In the others
    every member outside the largest component has been a pivot, so no two members are left that are neither tried nor connected."""
    placed = _placed(members, roots)
    parts = placed.groupBy("band", "root").agg(F.count(F.lit(1)).alias("size"))
    largest = parts.groupBy("band").agg(F.max(F.struct("size", "root")).alias("top"), F.count(F.lit(1)).alias("parts")).where(F.col("parts") > 1)
    open_rows = write_cut(placed.join(largest.select("band", F.col("top.root").alias("top")), "band"), "open-buckets")
    rest = open_rows.where(F.col("root") != F.col("top")).join(done, ["band", "s"], "left_anti")
    order = Window.partitionBy("band").orderBy(F.xxhash64("s"), "s")
    ranked = write_cut(rest.withColumn("k", F.row_number().over(order)).where(F.col("k") <= pivots + 1), "pivots")
    chosen = (ranked.where(F.col("k") <= pivots)
                       .select("band", F.col("s").alias("p"), F.col("root").alias("p_root"), *[F.col(c).alias(f"p_{c}") for c in ("n", "at", *PARITY)]))
    enough = (100 + percent) * F.least(F.col("n") - F.col("at"), F.col("p_n") - F.col("p_at")) >= percent * (F.col("n") + F.col("p_n"))
    apart = reduce(add, [F.bit_count(F.col(c).bitwiseXOR(F.col(f"p_{c}"))) for c in PARITY])
    near = (100 + percent) * apart <= (100 - percent) * (F.col("n") + F.col("p_n"))
    pairs = (open_rows.join(chosen, "band").where((F.col("root") != F.col("p_root")) & enough & near)
             .select(F.greatest("s", "p").alias("u"), F.least("s", "p").alias("v")).distinct())
    unfinished = ranked.where(F.col("k") > pivots).select("band")
    return chosen, pairs, write_cut(open_rows.join(unfinished, "band", "left_semi").select(members.columns), "unfinished-buckets")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """One row per document: doc, th (text hash), n_shingles, component (smallest id reachable by links).

    Words are split at ASCII white space, A-Z in lower case.  Documents with equal shingle sets are one
    class, so copies are never paired.  Classes that agree in a band of four of 64 coordinates share a
    bucket.  First every member of a bucket is compared with its smallest one.  The members of buckets
    that still hold several components are dealt anew by their rarest shingles, of which two similar sets
    always share one.  There, members outside a bucket's largest component, in rounds of 16 times as
    many each, are compared with all members of other components until none is left: no two similar
    members of a bucket that are not yet connected stay untried, while connected ones are never paired.
    Size, place and a parity bitmap rule pairs out by bounds that no similar pair breaks.
    Every link is confirmed on the full sets.  A pair at the threshold shares no bucket with probability
    of about 9e-5.

    A document with fewer words than a shingle has its whole sequence as one; without words or text the
    set is empty and has no links.  Rows that share an id are compared one by one and each has its own
    component; rows with a null id link too, their component is the smallest id there is, or null.
    An empty table has no rows.
    """
    rows = write_cut(_sketch(docs, id_col, text_col, size), "sketches")
    known = rows.where(F.col("n") > 0)
    classes = write_cut(known.groupBy("key").agg(F.min("doc").alias("least"), F.min(F.struct("doc", "th")).alias("one"), F.first("bands").alias("bands"), F.first("n").alias("n"))
                        .withColumn("s", F.monotonically_increasing_id()), "set-classes")
    buckets = classes.select("s", F.explode("bands").alias("band"))
    shared = buckets.groupBy("band").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > 1).select("band")
    members = write_cut(buckets.join(shared, "band").distinct(), "buckets")
    wanted = classes.join(members.select("s").distinct(), "s", "left_semi").select("s", "n", "one.doc", "one.th")
    sets = write_cut(_sets(docs, wanted, id_col, text_col, size), "sets")
    roots = connected_components(_linked(_star(members), sets, percent))
    members = write_cut(_prefix_buckets(members, roots, sets, percent), "prefix-buckets")
    done, pivots = members.select("band", "s").limit(0), FIRST_PIVOTS
    while not members.isEmpty():
        chosen, pairs, members = _across(members, roots, done, pivots, percent)
        found = write_cut(_linked(pairs, sets, percent), "pivot-links")
        if not found.isEmpty():
            roots = connected_components(roots.select(F.col("node").alias("u"), F.col("component").alias("v")).unionAll(found))
        done = write_cut(done.unionAll(chosen.select("band", F.col("p").alias("s"))), "pivots-done")
        pivots *= 16
    named = classes.alias("c").join(roots.alias("r"), F.col("c.s") == F.col("r.node"), "left").select("c.key", "c.least", F.coalesce("r.component", "c.s").alias("root"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component"))
    by_key = named.join(smallest, "root").select("key", "component")
    return rows.alias("d").join(by_key.alias("k"), F.col("d.key") == F.col("k.key"), "left").select(
        "d.doc", "d.th", F.col("d.n").alias("n_shingles"), F.coalesce("k.component", "d.doc").alias("component"))


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(s, n, hashes) of the wanted classes, from the text of one document each."""
    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                hashes = [shingle_set(t, size).tobytes() for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(hashes, pa.binary())], names=["s", "n", "hashes"])

    d = docs.select(quoted(id_col).cast("long").alias("doc"), text_hash(quoted(text_col)).alias("th"), quoted(text_col).cast("binary").alias("text"))
    w = wanted.alias("w")
    joined = d.alias("d").join(w, F.col("d.doc").eqNullSafe(F.col("w.doc")) & (F.col("d.th") == F.col("w.th"))).select("w.s", "w.n", "d.text")
    # Rows alike in id and text all match; one of them is enough.
    return joined.mapInArrow(shingles, "s long, n long, hashes binary").groupBy("s").agg(F.first("n").alias("n"), F.first("hashes").alias("hashes"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents whose component has a smaller id.

    Of rows alike in id and text all stay or go; a row with a null id always stays, as nothing tells it
    from another one.
    """
    found = near_duplicates(docs, id_col, text_col, **options)
    doc, th = free_name(docs, "gone"), free_name(docs, "gone_text")
    gone = found.where(F.col("doc") != F.col("component")).select(F.col("doc").alias(doc), F.col("th").alias(th)).distinct()
    return docs.join(gone, (quoted(id_col) == F.col(doc)) & (text_hash(quoted(text_col)) == F.col(th)), "left_anti")
