"""Sequence packing: repeat counts of length combinations by non-negative least squares."""

from __future__ import annotations

import array
import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.common import quoted
from marlstone.session import write_cut

SEQUENCE = 1024
END_ID = 0
DEPTH = 3
# Pieces of one length that are numbered by one task at most.
CELL_ROWS = 10_000
CACHE_CHUNKS = 300_000
# Chunks with their ids that packing keeps, some 180 bytes each, in every Python worker.
KEPT_CHUNKS = 1_000_000
CACHED_CHARS = 100

_PIECES = pa.schema([("doc", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int32())), ("length", pa.int32()),
                     ("crc", pa.int64()), ("doc_tokens", pa.int64())])


# ---- token ids -------------------------------------------------------------

_OPEN_SPACE = re.compile(r"^ | $| \s|\s ")
_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def byte_characters() -> dict[str, int]:
    """The published byte-level alphabet: printable Latin-1 stands for itself, the rest for 256 and up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Chunks(dict):
    """Ids of chunks that follow a space, found when first asked for; none that is empty or has white space at an end is kept."""

    def __init__(self, encode: Callable[[str], list[int]]):
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        ids = array.array("I", self.encode(" " + chunk)).tobytes()
        if chunk and len(chunk) <= CACHED_CHARS and chunk == chunk.strip():
            self[chunk] = ids
        return ids


class ByteBpe:
    """Ids of a byte-level BPE file, with the chunks between spaces kept.

    A space between two other characters starts a new piece in this pre-tokeniser, so the chunks there
    have their ids alone.  Chunks not seen yet go through a faster encoder with the file's own merges;
    it is used only if both give the same ids on a few texts when the file is loaded.
    """

    PROBE = "It's 12 o'clock,  isn't it?\n\n\tÄé ñ日本語 😀<|endoftext|> x=3; don't stop"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        self.encode: Callable[[str], list[int]] = lambda t: self.slow.encode(t, add_special_tokens=False).ids
        fast = self._fast(path)
        if fast and fast(self.PROBE) == self.encode(self.PROBE):
            self.encode = fast
        self.kept = _Chunks(self.encode)
        tokens = self.slow.get_vocab()
        self.lengths = np.zeros(max(tokens.values()) + 1, np.int64)
        for token, i in tokens.items():
            self.lengths[i] = len(token)                    # one character a byte in the byte-level alphabet

    @staticmethod
    def _fast(path: str) -> Callable[[str], list[int]] | None:
        try:
            import tiktoken
        except ModuleNotFoundError:
            return None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec.get("added_tokens", ())}
        to_byte = byte_characters()
        ranks = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        # The published pattern of this pre-tokeniser (fixed value).
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
        return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, text: str | None) -> bytes:
        """Ids as unsigned 32-bit integers of this machine."""
        if not text:
            return b""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The same for several texts: chunks not seen yet are encoded together, joined by spaces, and cut by their bytes."""
        kept, found = self.kept, []
        if len(kept) > KEPT_CHUNKS:
            kept.clear()
        new: set[str] = set()
        for text in texts:
            own = (text or "").split(" ")
            ids = list(map(kept.get, own))
            missing = [k for k, i in enumerate(ids) if i is None or k == 0]
            # A space beside white space or an end of the text leaves a chunk there that is never kept.
            if [k for k in missing if not own[k] or own[k] != own[k].strip()] and _OPEN_SPACE.search(text or ""):
                own = _SAFE_SPACE.split(text)
                ids = list(map(kept.get, own))
                missing = [k for k, i in enumerate(ids) if i is None or k == 0]
            new.update(own[k] for k in missing[1:])
            found.append((own, ids, missing))
        # A space is sure to start a piece between two other characters; long chunks are not kept.
        chunks = [c for c in new if c and len(c) <= CACHED_CHARS and c == c.strip()]
        if chunks:
            ids = np.array(self.encode(" " + " ".join(chunks)), np.uint32)
            cut = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(c.encode()) + 1 for c in chunks]), "right").tolist()
            data = ids.tobytes()
            kept.update((c, data[4 * a:4 * b]) for c, a, b in zip(chunks, [0, *cut], cut, strict=False))
        out = []
        for own, ids, missing in found:
            for k in missing[1:]:
                ids[k] = kept[own[k]]
            ids[0] = array.array("I", self.encode(own[0])).tobytes()
            out.append(b"".join(ids))
        return out


_loaded: dict[str, ByteBpe] = {}


def byte_bpe(path: str) -> ByteBpe:
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, size: int, end_id: int) -> DataFrame:
    """(doc, start, ids, length, crc, doc_tokens): full windows of ``size`` ids, and what is left of each document.

    ``crc`` is the CRC-32 of the ids as little-endian unsigned 32-bit integers.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = byte_bpe(tokenizer_path), array.array("I", [end_id]).tobytes()
        for batch in batches:
            # Few texts at a time: the ids take more room than the texts.
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows, raw = [], []
                for d, ids in zip(part.column(0).to_pylist(), encode.encode_all(part.column(1).to_pylist()), strict=True):
                    ids += end
                    raw.append(ids)
                    for a in range(0, len(ids), 4 * size):
                        piece = ids[a:a + 4 * size]
                        rows.append((d, a // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4))
                doc, start, length, crc, tokens = zip(*rows, strict=True)
                offsets = np.concatenate(([0], np.cumsum(length, dtype=np.int64))).astype(np.int32)
                values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), values, pa.array(length, pa.int32()),
                                                  pa.array(crc, pa.int64()), pa.array(tokens, pa.int64())], schema=_PIECES)

    return docs.select(quoted(id_col).cast("long").alias("doc"), quoted(text_col).alias("text")).mapInArrow(
        cut, "doc long, start long, ids array<int>, length int, crc long, doc_tokens long")


# ---- the plan: how often which combination of lengths ----------------------

def combinations(size: int, depth: int = DEPTH) -> np.ndarray:
    """All sorted combinations of up to ``depth`` (three at most) lengths that fill ``size`` exactly, padded with zeros."""
    rows = [(size, 0, 0)]
    if depth > 1:
        rows += [(size - a, a, 0) for a in range(1, size // 2 + 1)]
    if depth > 2:
        rows += [(size - a - b, b, a) for a in range(1, size // 3 + 1) for b in range(a, (size - a) // 2 + 1)]
    return np.array(rows, np.int32)


def nnls(rows: np.ndarray, wanted: np.ndarray, rounds: int = 1500) -> np.ndarray:
    """Repeat counts x >= 0 with the least squares of A x - wanted, where A counts the lengths in each row.

    Accelerated projected gradient with restarts; A is only ever applied through the row indexes, so
    memory is that of the combinations.
    """
    size = len(wanted)

    def forward(x: np.ndarray) -> np.ndarray:
        out = np.zeros(size)
        for c in range(rows.shape[1]):
            out += np.bincount(rows[:, c], weights=x, minlength=size)
        out[0] = 0.0
        return out

    def backward(r: np.ndarray) -> np.ndarray:
        return sum(r[rows[:, c]] for c in range(rows.shape[1]))

    scale = max(1.0, wanted.max())
    b = wanted / scale
    b[0] = 0.0
    v = np.ones(len(rows))
    for _ in range(30):                       # largest eigenvalue of A'A by powers
        v = backward(forward(v))
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(y - backward(forward(y) - b) / top, 0.0)
        if np.dot(y - new, new - x) > 0:      # the momentum points uphill: start it again
            t, y = 1.0, x
            continue
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        moved = np.abs(new - x).max()
        x, t = new, t_new
        if moved < 1e-9:
            break
    return x * scale


def packing_plan(histogram: np.ndarray, size: int, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Combinations, their whole repeat counts, and how many pieces of each length they leave over.

    ``histogram[l]`` pieces have length l < ``size``.  Repeat counts are rounded to the nearest and then
    lowered where a length would run out, so no sequence has a hole.
    """
    rows = combinations(size, depth)
    rows = rows[rows[:, 0] < size]
    rows = rows[np.all((rows == 0) | (histogram[rows] > 0), axis=1)]
    if not len(rows):
        return rows, np.zeros(0, np.int64), histogram.copy()
    x = nnls(rows, histogram.astype(float))
    counts = np.rint(x).astype(np.int64)
    left = histogram.astype(np.int64).copy()
    for i in np.argsort(-x, kind="stable"):
        if x[i] < 0.25:
            break
        lengths, need = np.unique(rows[i][rows[i] > 0], return_counts=True)
        counts[i] = min(max(counts[i], 1), int((left[lengths] // need).min()))
        left[lengths] -= counts[i] * need
    counts[x < 0.25] = 0
    used = counts > 0
    return rows[used], counts[used], left


def _slots(rows: np.ndarray, counts: np.ndarray, size: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, offset): places for the pieces of each length in order of rank.

    A combination that repeats n times from sequence s gives every one of its members n consecutive ranks.
    """
    out, next_rank, sequence = [], np.zeros(size, np.int64), 0
    for row, n in zip(rows, counts, strict=True):
        offset = 0
        for length in row[row > 0]:
            out.append((int(length), int(next_rank[length]), int(n), sequence, offset))
            next_rank[length] += n
            offset += int(length)
        sequence += int(n)
    return out


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE,
         end_id: int = END_ID, cell_rows: int = CELL_ROWS) -> DataFrame:
    """One row per piece: doc, start, length, ids, crc (of the ids), doc_tokens, sequence_id, offset.

    Each document is its ids and ``end_id``.  Full windows are sequences by themselves.  What is left of
    the documents, all shorter than ``size``, is counted by length; non-negative least squares choose how
    often each combination of up to three lengths filling the window is repeated.  Pieces these counts
    do not use are laid end to end, long ones first, and cut at the window: only the last sequence of
    all has padding.  The plan grows with ``size`` alone, never with the documents.

    Pieces of one length are numbered in cells of about ``cell_rows`` with running offsets, so a frequent
    length is no single group.  A null or empty text is the end id alone; rows with one id are packed
    one by one, a null id like any other; an empty table has no rows.
    """
    pieces = write_cut(token_pieces(docs, tokenizer_path, id_col, text_col, size, end_id)
                       .withColumn("row", F.monotonically_increasing_id()), "pieces")
    histogram = np.zeros(size, np.int64)
    for r in pieces.where(F.col("length") < size).groupBy("length").count().collect():      # at most size - 1 rows
        histogram[r["length"]] = r["count"]
    rows, counts, left = packing_plan(histogram, size)
    slots = _slots(rows, counts, size)
    packed = int(counts.sum())
    # Pieces left over: those with the highest ranks of each length, laid end to end.
    laid, at = [], packed * size
    for length in range(size - 1, 0, -1):
        if left[length]:
            laid.append((length, int(histogram[length] - left[length]), int(left[length]), at))
            at += length * int(left[length])
    first_full = -(-at // size)
    cells = {length: -(-int(n) // cell_rows) for length, n in enumerate(histogram) if n > cell_rows}

    short = pieces.where(F.col("length") < size)
    spread = F.create_map(*[F.lit(v) for kv in cells.items() for v in kv])[F.col("length")] if cells else F.lit(None).cast("int")
    short = short.withColumn("cell", F.when(spread.isNotNull(), F.pmod(F.xxhash64("row"), spread)).otherwise(F.lit(0)))
    starts = (short.groupBy("length", "cell").count()
              .select("length", "cell", (F.sum("count").over(Window.partitionBy("length").orderBy("cell")) - F.col("count")).alias("before")))
    ranked = (short.withColumn("in_cell", F.row_number().over(Window.partitionBy("length", "cell").orderBy("row")) - 1)
              .join(starts, ["length", "cell"]).withColumn("rank", F.col("before") + F.col("in_cell")))
    # A piece stands whole in its place, or is cut where the sequence ends.
    place = _places(docs.sparkSession, slots, laid, size)
    here = ranked.withColumn("place", place("length", "rank"))
    whole = F.col("place.room") >= F.col("length")
    first = F.slice("ids", F.lit(1), F.col("place.room"))
    rest = F.slice("ids", F.col("place.room") + 1, F.greatest(F.col("length") - F.col("place.room"), F.lit(0)))

    def part(start, length, ids, crc, sequence, offset):
        return F.struct(start.alias("start"), length.alias("length"), ids.alias("ids"), crc.alias("crc"), sequence.alias("sequence_id"), offset.alias("offset"))

    parts = F.when(whole, F.array(part(F.col("start"), F.col("length"), F.col("ids"), F.col("crc"), F.col("place.sequence"), F.col("place.offset")))).otherwise(
        F.array(part(F.col("start"), F.col("place.room"), first, _crc(first), F.col("place.sequence"), F.col("place.offset")),
                part(F.col("start") + F.col("place.room"), F.col("length") - F.col("place.room"), rest, _crc(rest), F.col("place.sequence") + 1, F.lit(0))))
    names = ["doc", "start", "length", "ids", "crc", "doc_tokens", "sequence_id", "offset"]
    return here.select("doc", "doc_tokens", F.inline(parts)).select(names).unionByName(
        pieces.where(F.col("length") == size).select(
            "doc", "start", "length", "ids", "crc", "doc_tokens", (F.lit(first_full) + F.col("row")).alias("sequence_id"), F.lit(0).alias("offset")))


def _crc(ids: Column) -> Column:
    """CRC-32 of little-endian 32-bit integers; only pieces that are cut need it here."""
    digits = F.transform(ids, lambda i: F.lpad(F.hex(i), 8, "0"))
    swapped = F.transform(digits, lambda h: F.concat(h.substr(7, 2), h.substr(5, 2), h.substr(3, 2), h.substr(1, 2)))
    return F.crc32(F.unhex(F.array_join(swapped, "")))


def _places(spark: SparkSession, slots: list, laid: list, size: int) -> Callable[..., Column]:
    """(sequence, offset, room there) by length and rank; the plan goes along, as large as the combinations used at most."""
    plan = spark.sparkContext.broadcast((slots, laid))

    @F.pandas_udf("sequence long, offset int, room int")
    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        slots, laid = plan.value
        over = {length: rest for length, *rest in laid}
        length, rank = lengths.to_numpy(np.int64), ranks.to_numpy(np.int64)
        sequence, offset, room = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64), length.copy()
        table = np.array(slots or [(0, 0, 0, 0, 0)], np.int64)
        for one in np.unique(length):
            rows = np.flatnonzero(length == one)
            own = table[table[:, 0] == one]
            first_over, _, at = over.get(int(one), (np.iinfo(np.int64).max, 0, 0))
            laid_out = rank[rows] >= first_over
            inside = rows[~laid_out]
            if len(inside):
                k = np.searchsorted(own[:, 1], rank[inside], "right") - 1
                sequence[inside] = own[k, 3] + rank[inside] - own[k, 1]
                offset[inside] = own[k, 4]
            outside = rows[laid_out]
            place_of = at + (rank[outside] - first_over) * one
            sequence[outside], offset[outside] = place_of // size, place_of % size
            room[outside] = np.minimum(one, size - place_of % size)
        return pd.DataFrame({"sequence": sequence, "offset": offset.astype(np.int32), "room": room.astype(np.int32)})

    return place
