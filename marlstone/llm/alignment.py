"""Cross-tokenizer alignment: each distinct text is tokenised and aligned once, pair counts are weighted by its copies."""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import quoted
from marlstone.llm.packing import CACHE_CHUNKS, CACHED_CHARS, byte_bpe, byte_characters
from marlstone.session import write_cut

# Text of one part: what is tokenised, stored and looked up together.
PART_BYTES = 4 << 20
# Texts whose new chunks are tokenised together.
TEXTS = 256
# Pairs of one group that are listed one by one; larger groups are counted by distinct ids.
LISTED = 4096
# Copies of one text are spread when they are more than this share of all rows, so there are no more such texts.
HOT_SHARE = 200
SALTS = 32

_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_OPEN_SPACE = re.compile(r"^ | $| \s|\s ")

_TEXTS = pa.list_(pa.struct([("digest", pa.string()), ("weight", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                             ("n_links", pa.int64()), ("groups_sha256", pa.string())]))
_PARTS = pa.schema([("part", pa.int64()), ("keys", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("sizes", pa.binary()),
                    ("places", pa.binary()), ("times", pa.binary()), ("texts", _TEXTS)])
_PARTS_DDL = ("part long, keys array<long>, counts array<long>, sizes binary, places binary, times binary, texts array<struct<digest:string,weight:bigint,"
              "n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups_sha256:string>>")
_MEASURES = pa.schema([("digest", pa.string()), ("weight", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                       ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())])
_MEASURES_DDL = "digest string, weight long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Aligned(NamedTuple):
    """Measures of every row, and the id pairs (a, b, count, best) they are counted by."""

    measures: DataFrame
    pairs: DataFrame


class _Aligner:
    """Groups of the chunks between single spaces, found when a chunk is first met.

    Both tokenisers start a token at a space between two other characters: the byte-level one by its
    pre-tokeniser, the other because no piece has a space after another character (checked; if one had,
    texts would not be cut).  So no group crosses such a space, and a chunk has the same groups everywhere.
    New chunks are tokenised and aligned together, joined by spaces.
    """

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.encode_a = byte_bpe(path_a).encode
        with open(path_a, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        to_byte = byte_characters()
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            if all(c in to_byte for c in token):
                self.bytes_a[i] = bytes(map(to_byte.get, token))
        model = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.encode_b = model.encode
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.length_a, self.length_b = (np.array(list(map(len, tokens)), np.int64) for tokens in (self.bytes_a, self.bytes_b))
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        ids = [str(i) for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        self.written = {mark: np.array([mark + i for i in ids], object) for mark in ";,|"}
        self.written_length = np.array([len(i) + 1 for i in ids], np.int64)
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.numbers, self.strings = array("q"), []         # n_a, n_b, n_groups, n_links; all -1 where the bytes differ
        self.ends, self.keys, self.times = array("q", [0]), array("q"), array("q")

    def places(self, texts: list[str]) -> list[np.ndarray]:
        """Places of each text's chunks in the store."""
        if self.cuts:
            chunks = [_SAFE_SPACE.split(t) if _OPEN_SPACE.search(t) else t.split(" ") for t in texts]
        else:
            chunks = [[t] for t in texts]
        new = {c for own in chunks for c in own if c not in self.index}
        # Only between two other characters is a space sure to start a token.
        plain = [c for c in new if not (c[0].isspace() or c[-1].isspace() or "▁" in c)]
        own = {c: self._add([c]) for c in new.difference(plain)}
        own.update(zip(plain, count(len(self.strings)), strict=False))
        self._add(plain)
        found = [np.fromiter((self.index[c] if c in self.index else own[c] for c in cs), np.int64, len(cs)) for cs in chunks]
        self.index.update((c, i) for c, i in own.items() if len(c) <= CACHED_CHARS)
        return found

    def _add(self, chunks: list[str]) -> int:
        """Appends the chunks to the store; the place of the first one."""
        at = len(self.strings)
        if not chunks:
            return at
        joined = " ".join(chunks)
        wanted = (" " + joined).encode()
        a, b = np.array(self.encode_a(" " + joined), np.int64), np.array(self.encode_b(joined), np.int64)
        same = all(b"".join([tokens[i] for i in ids.tolist()]) == wanted for ids, tokens in ((a, self.bytes_a), (b, self.bytes_b)))
        if not same and len(chunks) == 1:
            self.numbers.extend((-1, -1, -1, -1))
            self.strings.append("")
            self.ends.append(len(self.keys))
            return at
        if same:
            end_a, end_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
            cut_a, cut_b = np.isin(end_a, end_b, assume_unique=True), np.isin(end_b, end_a, assume_unique=True)
            group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
            of_a, of_b = np.bincount(group_a), np.bincount(group_b)
        if not same or (len(chunks) > 1 and (of_a * of_b).max() > LISTED):
            for c in chunks:
                self._add([c])
            return at

        chunk_end = np.cumsum([len(c.encode()) + 1 for c in chunks])
        upto = [np.searchsorted(ends, chunk_end, "right") for ends in (end_a, end_b, end_a[cut_a])]
        links = np.append(0, np.cumsum(of_a * of_b))[upto[2]]
        self.numbers.frombytes(np.diff(np.stack([*upto, links]), prepend=0, axis=1).T.astype(np.int64).tobytes())
        # Tokens as they are written, those of A before those of B in each group.
        first_a, first_b = np.append(True, cut_a[:-1]), np.append(True, cut_b[:-1])
        place_a = np.arange(len(a)) + (np.cumsum(of_b) - of_b)[group_a]
        place_b = np.arange(len(b)) + np.cumsum(of_a)[group_b]
        tokens, lengths = np.empty(len(a) + len(b), object), np.empty(len(a) + len(b), np.int64)
        tokens[place_a] = np.where(first_a, self.written[";"][a], self.written[","][a])
        tokens[place_b] = np.where(first_b, self.written["|"][b], self.written[","][b])
        lengths[place_a], lengths[place_b] = self.written_length[a], self.written_length[b]
        string = "".join(tokens.tolist())
        edge = np.append(0, np.cumsum(lengths))[np.append(0, upto[0] + upto[1])].tolist()
        self.strings.extend(string[x + 1:y] for x, y in zip(edge, edge[1:], strict=False))
        start = len(self.keys)
        if (of_a * of_b).max() > LISTED:
            for x, y in zip(np.split(a, np.flatnonzero(first_a)[1:]), np.split(b, np.flatnonzero(first_b)[1:]), strict=True):
                self._pairs(x, y)
            self.ends.append(len(self.keys))
            return at
        n = of_b[group_a]
        other = np.repeat((np.cumsum(of_b) - of_b)[group_a] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        self.keys.frombytes((np.repeat(a, n) << 16 | b[other]).tobytes())
        self.times.frombytes(np.ones(len(other), np.int64).tobytes())
        self.ends.frombytes((start + links).astype(np.int64).tobytes())
        return at

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> None:
        """The pairs of one group by distinct ids."""
        xs, of_x = np.unique(a, return_counts=True)
        ys, of_y = np.unique(b, return_counts=True)
        self.keys.frombytes((xs[:, None] << 16 | ys).astype(np.int64).tobytes())
        self.times.frombytes(np.outer(of_x, of_y).astype(np.int64).tobytes())


_loaded: dict[tuple[str, str], _Aligner] = {}


def _aligner(path_a: str, path_b: str) -> _Aligner:
    if (path_a, path_b) not in _loaded:
        _loaded[path_a, path_b] = _Aligner(path_a, path_b)
    return _loaded[path_a, path_b]


def _part(rows: list[tuple[str, int, str]], aligner: _Aligner, part: int) -> pa.RecordBatch:
    """One row for all texts of a part: measures, and their pairs as places in the part's own list of distinct pairs."""
    import zstandard

    chunks = [own for k in range(0, len(rows), TEXTS) for own in aligner.places([text for _, _, text in rows[k:k + TEXTS]])]
    sizes = np.array([len(c) for c in chunks], np.int64)
    flat = np.concatenate(chunks)
    of_text = np.repeat(np.arange(len(rows)), sizes)
    numbers = np.array(aligner.numbers, np.int64).reshape(-1, 4)[flat]
    good = np.ones(len(rows), bool)
    good[of_text[numbers[:, 0] < 0]] = False
    sums = np.add.reduceat(numbers, np.cumsum(sizes) - sizes, axis=0) * good[:, None]
    texts = []
    for (digest, weight, _), own, ok, s in zip(rows, chunks, good.tolist(), sums.tolist(), strict=True):
        groups = hashlib.sha256(";".join([aligner.strings[i] for i in own.tolist()]).encode()).hexdigest() if ok else ""
        texts.append({"digest": digest, "weight": weight, "n_a": s[0], "n_b": s[1], "n_groups": s[2], "n_links": s[3], "groups_sha256": groups})

    flat, of_text = flat[good[of_text]], of_text[good[of_text]]
    ends = np.array(aligner.ends, np.int64)
    first, n = ends[flat], ends[flat + 1] - ends[flat]
    at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    own = np.repeat(of_text, n) << 32 | np.array(aligner.keys, np.int64)[at]
    order = np.argsort(own)
    own, times = own[order], np.array(aligner.times, np.int64)[at][order]
    new = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
    own, times = own[new], np.add.reduceat(times, new) if len(new) else times
    text = own >> 32
    keys, places = np.unique(own & 0xFFFFFFFF, return_inverse=True)
    weights = np.array([w for _, w, _ in rows], np.int64)
    counts = np.zeros(len(keys), np.int64)
    np.add.at(counts, places, weights[text])
    # Steps of the sorted places are small numbers.
    steps = np.diff(places, prepend=0)
    steps[np.flatnonzero(np.diff(text, prepend=-1))] = places[np.flatnonzero(np.diff(text, prepend=-1))]
    pack = zstandard.ZstdCompressor(level=1).compress
    per_text = np.bincount(text, minlength=len(rows)).astype(np.int64)
    return pa.RecordBatch.from_arrays([
        pa.array([part], pa.int64()), pa.array([keys], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())),
        pa.array([pack(per_text.tobytes())], pa.binary()), pa.array([pack(_planes(steps))], pa.binary()), pa.array([pack(_planes(times))], pa.binary()),
        pa.array([texts], _TEXTS)], schema=_PARTS)


def _planes(numbers: np.ndarray) -> bytes:
    """All lowest bytes of the 64-bit numbers, then all second ones and so on: the upper ones are mostly 0."""
    return np.ascontiguousarray(numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").reshape(-1)


def _answered(part: pa.Table, replies: pa.Table) -> pa.Table:
    """Measures of the part's texts, given the count and rank of each of its distinct pairs."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    at = replies["place"].to_numpy()
    counts, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    counts[at], best[at] = replies["count"].to_numpy(), replies["best"].to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.frombuffer(unpack(part["sizes"][0].as_py()), np.int64)
    steps, times = (_from_planes(unpack(part[c][0].as_py())) for c in ("places", "times"))
    # Steps start again with each text.
    total, first = np.cumsum(steps), np.cumsum(sizes) - sizes
    before = np.where(first > 0, np.append(0, total)[first], 0)
    places = total - np.repeat(before, sizes)
    text = np.repeat(np.arange(len(sizes)), sizes)
    n_best, count_sum = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    np.add.at(n_best, text, times * best[places])
    np.add.at(count_sum, text, times * counts[places])
    rows = part["texts"][0].as_py()
    columns = {f.name: [r[f.name] for r in rows] for f in _MEASURES if f.name not in ("n_best", "count_sum")} | {"n_best": n_best, "count_sum": count_sum}
    return pa.table([pa.array(columns[f.name], f.type) for f in _MEASURES], schema=_MEASURES)


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES) -> Aligned:
    """Measures of each row: doc, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; and the pairs corpus-wide.

    Tokeniser A (a byte-level BPE file) reads a blank and the text, B (a sentencepiece model that adds the
    blank) the text, both without special tokens.  Byte offsets where tokens of both end cut them into groups;
    every A token of a group is linked with every B token of it.  The count of an id pair is the number of
    rows that have it linked, ``best`` pairs have the highest count of their A id.  ``n_best`` and
    ``count_sum`` are over the links of a row, ``groups_sha256`` is that of ``a1,a2|b1;a3|b2,b3``.

    Rows are grouped by their whole text; each distinct text is tokenised and aligned once, in parts of about
    ``part_bytes``.  A part brings the pairs it has, each once, with the number of rows they stand for, and
    gets the corpus-wide counts of these pairs back; what is shuffled are the distinct pairs of parts, not of
    texts.  Measures return to the rows by SHA-256 of the text, with the copies of texts that are over 1 in
    ``HOT_SHARE`` of all rows spread.

    Null and empty texts, and those whose joined token bytes differ from blank and text, have no tokens:
    zeros and an empty ``groups_sha256``.  A row with null id is measured and counted like any other, as is
    each of several with one id.  Other columns of ``docs`` are not used; no rows, no rows.
    """
    rows = docs.select(quoted(id_col).alias("doc"), quoted(text_col).alias("text"))
    # The whole text is the key of the shuffle; copies are counted before it.
    distinct = rows.where("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("weight")).select(F.sha2("text", 256).alias("digest"), "weight", "text")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, held, size, part = _aligner(path_a, path_b), [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for digest, weight, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append((digest, weight, text))
                size += len(text)
                if size >= part_bytes:
                    yield _part(held, aligner, part)
                    held, size, part = [], 0, part + 1
                    if len(aligner.strings) > CACHE_CHUNKS:
                        aligner.clear()
        if held:
            yield _part(held, aligner, part)

    parts = write_cut(distinct.mapInArrow(align, _PARTS_DDL), "aligned")
    counts = write_cut(parts.select(F.inline(F.arrays_zip("keys", "counts"))).groupBy(F.col("keys").alias("key"))
                       .agg(F.sum("counts").alias("count")).withColumn("a", F.shiftright("key", 16)), "pair-counts")
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    ranked = counts.join(most, "a").select("key", "a", "count", (F.col("count") == F.col("most")).alias("best"))
    replies = parts.select("part", F.posexplode("keys").alias("place", "key")).join(ranked, "key").select(
        F.col("part").alias("asked_by"), "place", "count", "best")
    measured = write_cut(parts.select("part", "sizes", "places", "times", "texts").groupBy("part").cogroup(replies.groupBy("asked_by"))
                         .applyInArrow(_answered, _MEASURES_DDL), "aligned-texts")

    total = rows.count()
    hot = [r["digest"] for r in measured.where(F.col("weight") * HOT_SHARE > total).select("digest").collect()]     # fewer than HOT_SHARE
    salt = F.when(F.col("digest").isin(hot), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    salts = F.when(F.col("digest").isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    asked = rows.select("doc", F.sha2("text", 256).alias("digest")).withColumn("salt", salt)
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    measures = (asked.join(measured.withColumn("salt", F.explode(salts)), ["digest", "salt"], "left")
                .select("doc", *zero, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256")))
    return Aligned(measures, ranked.select(F.col("a").cast("int").alias("a"), F.col("key").bitwiseAND(0xFFFF).cast("int").alias("b"), "count", "best"))
