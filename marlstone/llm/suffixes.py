"""Repeated passages: suffixes at content-chosen anchors, range-partitioned, sorted and compared with their neighbours."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import quoted
from marlstone.session import write_cut

LENGTH = 400
GRAM = 32
# Texts are walked in stretches, so that a very long one takes no more memory than this.
STRETCH = 4 << 20
BUCKET_BYTES = 16 << 20
HOT_SHARE = 200
SALTS = 32
# Bits of the filters that go to all tasks, whatever the input: they pass too much when full, never too little.
FILTER_BITS = 1 << 27

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``GRAM`` bytes from each position on, by doubling."""
    x = data.astype(np.uint64)
    for k in (1, 2, 4):
        x = (x[:-k] << np.uint64(8 * k)) | x[k:]
    for k in (8, 16):
        x = (x ^ (x >> np.uint64(29))) * _MIX[0]
        x = (x[:-k] * _MIX[1]) ^ x[k:]
    x = (x ^ (x >> np.uint64(32))) * _MIX[0]
    return x ^ (x >> np.uint64(29))


def _remixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers: anchors have the least of many hashes, whose upper bits alone fill a small part of a filter."""
    x = (x ^ (x >> np.uint64(32))) * _MIX[1]
    x = (x ^ (x >> np.uint64(29))) * _MIX[0]
    return x ^ (x >> np.uint64(32))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, from running minima forwards and backwards in blocks."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


def anchors(text: bytes, length: int = LENGTH) -> Iterator[tuple[int, int, int, int]]:
    """(hash, position, first, last): each string of ``length`` bytes starting at first .. last has that anchor.

    The anchor is the place of the least gram hash in the string, the leftmost if several are least.  It
    depends on the string alone: equal strings have anchors at equal offsets.  The hash given is that of
    the gram mixed once more, so that its bits are spread evenly.
    """
    starts = len(text) - length + 1
    for at in range(0, starts, STRETCH):
        here = min(STRETCH, starts - at)
        hashes = _gram_hashes(np.frombuffer(text, np.uint8, here + length - 1, at))
        # Hash above, place below: the least is the leftmost of the least hashes.
        keyed = (hashes & ~np.uint64((1 << 24) - 1)) | np.arange(len(hashes), dtype=np.uint64)
        place = (_sliding_min(keyed, length - GRAM + 1)[:here] & np.uint64((1 << 24) - 1)).astype(np.int64)
        edges = np.flatnonzero(np.diff(place)) + 1
        first = np.concatenate(([0], edges))
        last = np.concatenate((edges - 1, [here - 1]))
        mixed = _remixed(hashes[place[first]]).view(np.int64)
        for g, f, e, p in zip(mixed.tolist(), first.tolist(), last.tolist(), place[first].tolist(), strict=True):
            yield g, at + p, at + f, at + e


def _bit(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64) >> np.uint64(64 - FILTER_BITS.bit_length() + 1)


def _filter_of(df: DataFrame, column: str) -> Broadcast:
    """A bitmap of ``FILTER_BITS`` bits over a long column, at most 16 MB at the driver and in a task."""
    bit = F.shiftrightunsigned(F.col(column), 64 - FILTER_BITS.bit_length() + 1)
    rows = df.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    bits = np.zeros(FILTER_BITS // 8 + 4096, np.uint8)
    for r in rows:
        # Bucket numbers count from 1 for the positions 1 .. 32768, so bit 0 of bucket k stands for k * 32768 - 32767.
        # Bucket 0 holds position 0 alone, which passes without a bit.
        if r["bucket"] == 0:
            continue
        at = (r["bucket"] - 1) * 4096
        bits[at:at + len(r["bits"])] |= np.frombuffer(bytes(r["bits"]), np.uint8)
    return df.sparkSession.sparkContext.broadcast(bits.tobytes())


def _may_have(bits: bytes, values: np.ndarray) -> np.ndarray:
    # Position x is bit (x - 1) % 32768 of bucket 1 + (x - 1) // 32768; position 0 is the first bit of bucket 0 and always passes.
    x = _bit(values).astype(np.int64)
    place = np.maximum(x - 1, 0)
    return (x == 0) | ((np.frombuffer(bits, np.uint8)[place >> 3] >> (place & 7).astype(np.uint8)) & 1).astype(bool)


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    text = F.coalesce(quoted(text_col), F.lit("")).cast("binary")
    return docs.select(text.alias("text"))


def _first_long(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


def _grams(docs: DataFrame, text_col: str, length: int) -> DataFrame:
    """Gram hashes of anchors that occur at two places or more, copies of a whole text being one place."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram, where = [], []
            for text in batch.column(0).to_pylist():
                if len(text) >= length:
                    h = hashlib.md5(text).digest()
                    for g, p, _, _ in anchors(text, length):
                        gram.append(g)
                        where.append(_first_long(h) ^ p * 0x9E3779B97F4A7C1 & (1 << 62) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(gram, pa.int64()), pa.array(where, pa.int64())], names=["gram", "place"])

    found = _texts(docs, text_col).mapInArrow(find, "gram long, place long").groupBy("gram").agg(F.min("place").alias("a"), F.max("place").alias("b"))
    return found.where(F.col("a") != F.col("b")).select("gram")


def _contexts(docs: DataFrame, text_col: str, length: int, grams: Broadcast, with_bytes: bool) -> DataFrame:
    """(k, h, p, gram, a, seg): for anchors that may occur elsewhere, all bytes of the strings it is the anchor of.

    ``k`` is the 128-bit digest of the bytes and of the anchor's offset ``a`` in them.
    """
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for text in batch.column(0).to_pylist():
                if len(text) < length:
                    continue
                found = list(anchors(text, length))
                passed = _may_have(grams.value, np.array([f[0] for f in found], np.int64))
                h = hashlib.md5(text).digest()
                for keep, (gram, p, first, last) in zip(passed.tolist(), found, strict=True):
                    if keep:
                        seg = text[first:last + length]
                        k = xxhash.xxh3_128_digest(seg, seed=p - first)
                        rows.append((k, h, p, gram, p - first, seg) if with_bytes else (k, h, p))
                        held += len(seg)
                if held > 8 << 20:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)

    names = ["k", "h", "p", "gram", "a", "seg"] if with_bytes else ["k", "h", "p"]
    types = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary()][:len(names)]

    def batch_of(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    schema = "k binary, h binary, p long" + (", gram long, a int, seg binary" if with_bytes else "")
    return _texts(docs, text_col).mapInArrow(find, schema)


# ---- sorting ---------------------------------------------------------------

def _tokens(strings: list[bytes], width: int) -> np.ndarray:
    """Rows of big-endian 8-byte tokens, padded with zeros."""
    width = -(-width // 8) * 8
    return np.frombuffer(b"".join(s[:width].ljust(width, b"\0") for s in strings), ">u8").reshape(len(strings), -1).astype(np.uint64)


def multikey_quicksort(tokens: np.ndarray) -> np.ndarray:
    """Order of the rows: each step splits a run of rows by one token into less, equal and greater, and the equal go on to the next token."""
    order = np.arange(len(tokens))
    stack = [(0, len(order), 0)]
    while stack:
        start, end, depth = stack.pop()
        if end - start < 2 or depth == tokens.shape[1]:
            continue
        run = order[start:end]
        if end - start <= 16:
            order[start:end] = sorted(run.tolist(), key=lambda i: tokens[i, depth:].tolist())
            continue
        token = tokens[run, depth]
        pivot = np.partition(token, len(token) // 2)[len(token) // 2]
        less, equal, greater = run[token < pivot], run[token == pivot], run[token > pivot]
        order[start:end] = np.concatenate((less, equal, greater))
        a, b = start + len(less), start + len(less) + len(equal)
        stack += [(start, a, depth), (a, b, depth + 1), (b, end, depth)]
    return order


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n                                  # a[:low] is common, a[:high] is not
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def group_covers(before: list[bytes], ahead: list[bytes], length: int) -> list[tuple[int, int]]:
    """For each of the suffixes of one gram, in suffix order: bytes covered to the left of the anchor and from it on, (0, 0) if none are.

    Partners that share l bytes to the left and r from the anchor on, l + r >= ``length``, cover [-l, r); all
    covers have the anchor in them, so the longest l and r of any partners tell everything.  Suffixes are
    joined into groups by what they share from the anchor on, most first.  When two groups meet at r, those
    of the smaller one are put among those of the larger one in the order of what is before the anchor:
    only neighbours there can have a longer l than was known at a longer r.
    """
    n = len(before)
    found = [(0, 0)] * n

    def match(i: int, j: int, right: int) -> None:
        if right + min(len(before[i]), len(before[j])) >= length:
            left = common_prefix(before[i], before[j])
            if left + right >= length:
                for k in (i, j):
                    found[k] = (max(found[k][0], left), max(found[k][1], right))

    shared = [common_prefix(x, y) for x, y in zip(ahead, ahead[1:], strict=False)]
    order = sorted(range(n), key=before.__getitem__)
    rank = [0] * n
    for k, i in enumerate(order):
        rank[i] = k
    members = [[rank[i]] for i in range(n)]
    group = list(range(n))

    def root(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    for k in sorted(range(n - 1), key=shared.__getitem__, reverse=True):
        small, large = sorted((root(k), root(k + 1)), key=lambda i: len(members[i]))
        into = members[large]
        for x in members[small]:
            at = bisect_left(into, x)
            if at:
                match(order[x], order[into[at - 1]], shared[k])
            if at < len(into):
                match(order[x], order[into[at]], shared[k])
            into.insert(at, x)
        group[small], members[small] = large, []
    return found


_FOUND = pa.schema([("kind", pa.int32()), ("c", pa.int64()), ("gram", pa.int64()), ("bucket", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("a", pa.int32()), ("seg", pa.binary())])
_FOUND_DDL = "kind int, c long, gram long, bucket int, start int, end int, a int, seg binary"


def _found(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), 20_000):
        columns = zip(*rows[at:at + 20_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FOUND, strict=True)], schema=_FOUND)


def _sorted_buckets(classes: DataFrame, large: DataFrame, length: int, buckets: int) -> DataFrame:
    """Partners inside each bucket of the suffix order, and what is needed to go beyond it.

    kind 0: class c has the bytes start .. end around its anchor elsewhere; kind 1: class c of the bucket's
    first or last gram shares at most ``start`` bytes with what precedes the bucket and ``end`` with what
    follows; kind 2 and 3: first and last class of a bucket.
    """
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for at in range(0, b.num_rows, 4096) for r in b.slice(at, 4096).to_pylist()]
        if not rows:
            return
        suffix = _tokens([r["seg"][r["a"]:] for r in rows], length)
        # Padded tokens do not tell a suffix from the same one with zero bytes after it; the shorter one stands first.
        size = np.array([[len(r["seg"]) - r["a"]] for r in rows], np.uint64)
        left = _tokens([r["seg"][:r["a"]][::-1] for r in rows], length)
        rows = [rows[i] for i in multikey_quicksort(np.hstack((suffix, size, left))).tolist()]
        bucket, out = TaskContext.get().partitionId(), []
        edges = [0, *(i for i in range(1, len(rows)) if rows[i]["gram"] != rows[i - 1]["gram"]), len(rows)]
        for first, last in zip(edges, edges[1:], strict=False):
            own = rows[first:last]
            ahead = [r["seg"][r["a"]:] for r in own]
            covers = group_covers([r["seg"][:r["a"]][::-1] for r in own], ahead, length)
            out += [(0, r["c"], None, None, -l, e, None, None) for r, (l, e) in zip(own, covers, strict=True) if e and not r["several"]]
            if first == 0 or last == len(rows):
                # The first class itself is bounded by its neighbour in the bucket before, whatever it is.
                down = [common_prefix(x, ahead[0]) if first == 0 else 0 for x in ahead]
                up = [common_prefix(x, ahead[-1]) if last == len(rows) else 0 for x in ahead]
                out += [(1, r["c"], r["gram"], bucket, d, u, r["a"], None) for r, d, u in zip(own, down, up, strict=True) if not r["several"]]
        out += [(kind, r["c"], r["gram"], bucket, None, None, r["a"], r["seg"]) for kind, r in ((2, rows[0]), (3, rows[-1]))]
        yield from _found(out)

    # Classes of a gram that fits a bucket have one key, that of the gram, which stands where their suffixes do: no splitter comes between them.
    anchor, wide = F.col("a") + 1, F.col("wide").isNotNull()
    left = F.reverse(F.hex(F.substring("seg", F.greatest(anchor - 16, F.lit(1)), F.least(F.col("a"), F.lit(16)))))
    keyed = (classes.join(large.withColumn("wide", F.lit(True)), "gram", "left")
             .withColumn("suffix", F.substring("seg", anchor, F.when(wide, length).otherwise(min(GRAM, length))))
             .withColumn("left", F.when(wide, left)).withColumn("tie", F.when(wide, F.col("c"))))
    dealt = keyed.repartitionByRange(buckets, "suffix", "left", "tie").select("c", "gram", "a", "seg", "several")
    return dealt.mapInArrow(compare, _FOUND_DDL)


def _left_neighbours(classes: DataFrame, buckets: int) -> DataFrame:
    """The same rows by what is before the anchor: kind 4: class c shares start bytes before and end bytes from the anchor on with a neighbour."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, before, out = TaskContext.get().partitionId(), None, []
        for row in (r for b in batches for at in range(0, b.num_rows, 1024) for r in b.slice(at, 1024).to_pylist()):
            if before is None:
                out.append((2, row["c"], row["gram"], bucket, None, None, row["a"], row["seg"]))
            elif row["gram"] == before["gram"]:
                left, right = _match((before["a"], before["seg"]), (row["a"], row["seg"]))
                out += [(4, r["c"], None, None, left, right, None, None) for r in (before, row)]
            before = row
            if len(out) >= 20_000:
                yield from _found(out)
                out = []
        if before is not None:
            out.append((3, before["c"], before["gram"], bucket, None, None, before["a"], before["seg"]))
        yield from _found(out)

    keyed = classes.withColumn("left", F.reverse(F.hex(F.substring("seg", F.lit(1), F.col("a")))))
    dealt = keyed.repartitionByRange(buckets, "gram", "left", "c").sortWithinPartitions("gram", "left", "c").select("c", "gram", "a", "seg")
    return dealt.mapInArrow(compare, _FOUND_DDL)


def _match(a: tuple[int, bytes], b: tuple[int, bytes]) -> tuple[int, int]:
    """Bytes in common to the left of the anchors and from the anchors on."""
    (i, x), (j, y) = a, b
    return common_prefix(x[:i][::-1], y[:j][::-1]), common_prefix(x[i:], y[j:])


def _across(found: DataFrame) -> DataFrame:
    """The last class of each bucket and the first of the next that has any: (bucket, next, c1, c2, gram, start, end); gram if it is the same."""
    ends = found.where(F.col("kind").isin(2, 3)).select("kind", "c", "gram", "bucket", "a", "seg")
    numbers = ends.where("kind = 2").select("bucket", F.lead("bucket").over(Window.orderBy("bucket")).alias("next"))     # a row per bucket
    last, first = ends.where("kind = 3").alias("l"), ends.where("kind = 2").alias("f")
    pairs = (last.join(numbers.alias("n"), F.col("l.bucket") == F.col("n.bucket")).join(first, F.col("n.next") == F.col("f.bucket"))
             .select(F.col("l.bucket").alias("bucket"), "n.next", F.col("l.c").alias("c1"), F.col("f.c").alias("c2"),
                     F.when(F.col("l.gram") == F.col("f.gram"), F.col("l.gram")).alias("gram"),
                     F.col("l.a").alias("a1"), F.col("l.seg").alias("s1"), F.col("f.a").alias("a2"), F.col("f.seg").alias("s2")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = [_match((r["a1"], r["s1"]), (r["a2"], r["s2"])) for r in batch.select(["a1", "s1", "a2", "s2"]).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *(pa.array([s[k] for s in shared], pa.int32()) for k in (0, 1))],
                                             names=["bucket", "next", "c1", "c2", "gram", "start", "end"])

    return pairs.mapInArrow(compare, "bucket int, next int, c1 long, c2 long, gram long, start int, end int")


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("c1", "start", "end").unionAll(edges.select("c2", "start", "end")).toDF("c", "left", "right")


def _covers(classes: DataFrame, large: DataFrame, length: int, buckets: int) -> DataFrame:
    """(c, start, end) of bytes around the anchors of classes that other classes have too.

    A gram within one bucket of the suffix order is settled there.  Only those of ``large`` may lie across
    buckets; their classes are dealt anew in the order of what is before the anchor, where neighbours share most of that.
    A class is settled when no partner elsewhere can share more to either side than one that was found; for
    the others the lengths still possible are tried by digests of the strings.
    """
    found = write_cut(_sorted_buckets(classes, large, length, buckets), "suffix-order")
    edges = write_cut(_across(found), "suffix-edges")
    inside = found.where("kind = 0").select("c", (-F.col("start")).alias("left"), F.col("end").alias("right"))
    wide = edges.where("gram IS NOT NULL").select("gram").distinct()
    again = write_cut(_left_neighbours(classes.join(wide, "gram", "left_semi"), buckets), "left-order")
    beside = write_cut(again.where("kind = 4").select("c", F.col("start").alias("left"), F.col("end").alias("right"))
                       .unionAll(_both(_across(again).where("gram IS NOT NULL"))), "left-neighbours")
    enough = F.col("left") + F.col("right") >= length
    known = write_cut(inside.unionAll(_both(edges).where(enough)).unionAll(beside.where(enough)).groupBy("c").agg(F.max("left").alias("left"), F.max("right").alias("right")), "covers")

    # What a partner outside the bucket can share at most: right from the anchor on, left before it.
    bound = found.where("kind = 1").join(wide, "gram", "left_semi").select("c", "gram", "bucket", F.col("start").alias("down"), F.col("end").alias("up"))
    bound = (bound.join(edges.select(F.col("next").alias("bucket"), F.col("end").alias("before")), "bucket", "left")
             .join(edges.select("bucket", F.col("end").alias("after")), "bucket", "left")
             .select("c", "gram", F.greatest(F.least("down", F.coalesce("before", F.lit(0))), F.least("up", F.coalesce("after", F.lit(0)))).alias("most_right")))
    most_left = beside.groupBy("c").agg(F.max("left").alias("most_left"))
    state = bound.join(most_left, "c").join(known, "c", "left").select(
        "gram", (length - F.col("most_right")).alias("low"), "most_left", F.coalesce("left", F.lit(-1)).alias("left"), F.coalesce("right", F.lit(-1)).alias("right"))
    possible = [F.struct(F.greatest(F.col("low"), F.col("left") + 1, F.lit(0)).alias("low"), F.col("most_left").alias("high")),
                F.struct(F.greatest(F.col("low"), F.lit(0)).alias("low"), F.least(length - 1 - F.col("right"), F.col("most_left")).alias("high"))]
    open_at = (state.select("gram", F.inline(F.array(*possible))).where("low <= high").distinct()
               .select("gram", F.explode(F.sequence("low", "high")).alias("d")).groupBy("gram").agg(F.collect_set("d").alias("offsets")))
    return known.select("c", (-F.col("left")).alias("start"), F.col("right").alias("end")).unionAll(_open_strings(classes, write_cut(open_at, "open"), length))


def _open_strings(classes: DataFrame, open_at: DataFrame, length: int) -> DataFrame:
    """(c, start, end) of strings that another class of the gram has too, by 128-bit digests, at the offsets open for the gram."""
    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["x", "c", "d"], [pa.binary(), pa.int64(), pa.int32()]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for r in batch.slice(at, 256).to_pylist():
                    a, seg = r["a"], r["seg"]
                    out += [(xxhash.xxh3_128_digest(seg[a - d:a - d + length]), r["c"], d) for d in r["offsets"] if a - (len(seg) - length) <= d <= a]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    tried = write_cut(classes.join(open_at, "gram").select("c", "a", "seg", "offsets").mapInArrow(strings, "x binary, c long, d int"), "open-strings")
    shared = tried.groupBy("x", "d").agg(F.min("c").alias("low"), F.max("c").alias("high")).where(F.col("low") != F.col("high")).select("x", "d")
    return tried.join(shared, ["x", "d"], "left_semi").select("c", (-F.col("d")).alias("start"), (length - F.col("d")).alias("end"))


def repeated_spans(docs: DataFrame, text_col: str = "text", length: int = LENGTH, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(h, copies, spans): for each distinct text with repeated bytes its MD5, how often it occurs, and runs of repeated bytes.

    ``spans`` is an array of (start, end) byte offsets, sorted; all of a text that occurs more than once
    is repeated, and it may have no spans.
    """
    several = (docs.select(F.coalesce(quoted(text_col), F.lit("")).alias("t")).where(F.octet_length("t") >= length)
               .groupBy(F.unhex(F.md5("t")).alias("h")).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    grams = _filter_of(write_cut(_grams(docs, text_col, length), "grams"), "gram")
    place = F.struct("h", "p")
    classes = write_cut(_contexts(docs, text_col, length, grams, True).groupBy("k").agg(
        F.first("gram").alias("gram"), F.first("a").alias("a"), F.first("seg").alias("seg"), (F.min(place) != F.max(place)).alias("several"))
        .withColumn("c", F.monotonically_increasing_id()), "contexts")
    sizes = write_cut(classes.groupBy("gram").agg(F.sum(F.octet_length("seg")).alias("bytes")), "gram-bytes")
    total = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first()["n"]
    large = write_cut(sizes.where(F.col("bytes") > bucket_bytes).select("gram"), "large-grams")        # fewer than there are buckets
    covers = (_covers(classes, large, length, max(2, -(-total // bucket_bytes)))
              .unionAll(classes.where("several").select("c", -F.col("a"), F.octet_length("seg") - F.col("a")))
              .groupBy("c").agg(F.min("start").alias("start"), F.max("end").alias("end")))
    places = _contexts(docs, text_col, length, grams, False).distinct()
    known = covers.join(classes.select("c", "k"), "c").select("k", "start", "end")
    spans = (places.join(known, "k").select("h", F.struct((F.col("p") + F.col("start")).alias("start"), (F.col("p") + F.col("end")).alias("end")).alias("v"))
             .groupBy("h").agg(F.array_sort(F.collect_set("v")).alias("spans")))
    return several.join(spans, "h", "full").select("h", F.coalesce("copies", F.lit(1)).alias("copies"), "spans")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, **options) -> DataFrame:
    """One row per document: doc, n_bytes, spans (removed runs of bytes), kept (the bytes that stay).

    A byte goes if a string of ``length`` bytes over it also starts anywhere else, in the same document or
    another; overlaps count, and all is judged on the input.  Such strings are found at anchors: each
    has one, the least hash of its 32-byte grams, so suffixes at anchors stand for all suffixes.
    Anchors whose gram occurs once are left out.  Sampled splitters range-partition the suffixes by
    their bytes, ties by what is before them; each bucket sorts by multikey quicksort on 8-byte tokens,
    finds the partners of each suffix in it and compares across the bucket's ends.  Suffixes of one gram stay in
    one bucket unless they alone have more bytes than a bucket should; these are sorted by what is before them
    too, and what both orders leave open is settled by digests.  Equal contexts are one class throughout, so copies make no large groups.

    A null text is empty; a text shorter than ``length`` stays; rows that share an id are documents of
    their own, and two copies of a text remove each other; an empty table has no rows.
    """
    found = write_cut(repeated_spans(docs, text_col, length, **options), "repeats")
    bits = _filter_of(found.select(F.conv(F.substring(F.hex("h"), 1, 16), 16, -10).cast("long").alias("x")), "x")

    @F.pandas_udf("boolean")
    def may_repeat(h: pd.Series) -> pd.Series:
        return pd.Series(_may_have(bits.value, np.array([_first_long(v) for v in h], np.int64)))

    text = F.coalesce(quoted(text_col), F.lit("")).cast("binary")
    rows = docs.select(quoted(id_col).alias("doc"), text.alias("text"), F.unhex(F.md5(text)).alias("h")).withColumn("maybe", may_repeat("h"))
    no_spans = F.array().cast("array<struct<start:bigint,end:bigint>>")
    clean = rows.where(~F.col("maybe")).select("doc", F.octet_length("text").cast("long").alias("n_bytes"), no_spans.alias("spans"), F.col("text").alias("kept"))
    # Texts that are over 1 in HOT_SHARE of all rows, fewer than HOT_SHARE, are spread over several tasks.
    total = rows.select(F.count(F.lit(1)).alias("n")).first()["n"]
    hot = [bytes(r["h"]) for r in found.where(F.col("copies") * HOT_SHARE > total).select("h").collect()]
    is_hot = F.col("h").isin([F.lit(h) for h in hot]) if hot else F.lit(False)
    salt = F.when(is_hot, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    salted = found.withColumn("salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    hit = (rows.where("maybe").withColumn("salt", salt).join(salted, ["h", "salt"], "left")
           .select("doc", "text", F.coalesce(F.col("copies") > 1, F.lit(False)).alias("whole"), F.coalesce("spans", no_spans).alias("spans")))
    doc_type = hit.schema["doc"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                size, gone, kept = [], [], []
                for text, whole, spans in zip(*(part.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                    runs = [(0, len(text))] if whole else merged([(s["start"], s["end"]) for s in spans])
                    size.append(len(text))
                    gone.append([{"start": a, "end": b} for a, b in runs])
                    ends = [0, *(x for run in runs for x in run), len(text)]
                    kept.append(b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                                                  pa.array(kept, pa.binary())], names=["doc", "n_bytes", "spans", "kept"])

    return clean.unionByName(hit.mapInArrow(cut, f"doc {doc_type}, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary"))
