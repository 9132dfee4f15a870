"""Benchmark decontamination: one Aho-Corasick automaton scans every text once."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import free_name, quoted
from marlstone.session import write_cut

WINDOW = 10
# Item texts of one automaton; more of them take several automata, one after the other.
SHARD_BYTES = 16 << 20

# Upper case to lower case, every other ASCII character but digits to a space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
# The words of a text in its own letter case.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

LEAK = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(T.IntegerType())),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))])
_LEAK_ARROW = pa.struct([
    ("n_words", pa.int64()), ("hits", pa.list_(pa.int32())), ("items", pa.list_(pa.string())),
    ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


@functools.lru_cache(maxsize=1)
def _automaton(items: tuple[tuple[str | None, bytes], ...], window: int) -> ahocorasick.Automaton:
    """Every window of every item as a pattern; its value has the words in it and the items it is from."""
    found: dict[str, tuple[int, set[str]]] = {}
    for item, text in items:
        words = words_of(text)
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            pattern = (b" " + b" ".join(words[i:i + size]) + b" ").decode()
            found.setdefault(pattern, (size, set()))[1].update(() if item is None else (item,))
    automaton = ahocorasick.Automaton()
    for pattern, value in found.items():
        automaton.add_word(pattern, value)
    if found:
        automaton.make_automaton()
    return automaton


def _scan(text: bytes | None, automaton: ahocorasick.Automaton) -> tuple[int, set[int], set[str]]:
    """Number of words, indexes of the hit ones, items found."""
    words = words_of(text)
    hits: set[int] = set()
    items: set[str] = set()
    if words and len(automaton):
        scanned = (b" " + b" ".join(words) + b" ").decode()
        matches = list(automaton.iter(scanned))
        if matches:
            # Word k ends at the space with index k + 1.
            word_before = {m.start(): k - 1 for k, m in enumerate(re.finditer(" ", scanned))}
            for at, (size, of) in matches:
                last = word_before[at]
                hits.update(range(last - size + 1, last + 1))
                items |= of
    return len(words), hits, items


def _spans(text: bytes, hits: list[int]) -> list[dict]:
    """Maximal runs of hit words as offsets of characters of the original text."""
    if not hits:
        return []
    places = [m.span() for m in _WORD.finditer(text.decode())]
    spans = []
    for k, i in enumerate(hits):
        if k and hits[k - 1] == i - 1:
            spans[-1]["end"] = places[i][1]
        else:
            spans.append({"start": places[i][0], "end": places[i][1]})
    return spans


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` with a last column ``leak`` (see ``LEAK``): hit words, items and spans in the original text.

    Words are runs of digits, a-z (A-Z lower-cased) and characters beyond ASCII.  A window is ``window``
    consecutive words of an item, or the whole item if it has fewer; each document word inside any
    occurrence is hit.  ``spans`` are character offsets of runs of hit words.  The column is named
    ``leak_`` and so on where ``docs`` has one of that name.

    No shuffle: an automaton over at most about ``shard_bytes`` of item texts goes to the tasks; a larger
    benchmark is cut into such shards by the hash of the item, and the documents pass one after the
    other.  Null or empty texts and empty items have no words and no hits; an empty benchmark hits
    nothing; items with a null id hit words but are not listed; equal ids are listed once.
    """
    spark = docs.sparkSession
    items = benchmark.select(quoted(item_col).cast("string").alias("item"), quoted(item_text_col).cast("binary").alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    shards = max(1, -(-total // shard_bytes))
    name = free_name(docs, "leak")
    for k in range(shards):
        part = items if shards == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(shards)) == k)
        shared = spark.sparkContext.broadcast(tuple((r["item"], bytes(r["text"] or b"")) for r in part.collect()))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, first=not k) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(shared.value, window)
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary()).to_pylist()
                before = [None] * len(texts) if first else batch.column(batch.num_columns - 1).to_pylist()
                out = []
                for text, old in zip(texts, before, strict=True):
                    n, hits, of = _scan(text, automaton)
                    if old:
                        hits, of = hits.union(old["hits"]), of.union(old["items"])
                    found = sorted(hits)
                    out.append({"n_words": n, "hits": found, "items": sorted(of), "spans": _spans(text, found)})
                columns = batch.columns[:len(batch.columns) - (not first)]
                names = batch.schema.names[:len(columns)] + [name]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(out, _LEAK_ARROW)], names=names)

        docs = docs.mapInArrow(scan, T.StructType([*[f for f in docs.schema if f.name != name], T.StructField(name, LEAK)]))
        if k % 4 == 3:
            docs = write_cut(docs, "leaks")
    return docs


def drop_leaks(docs: DataFrame, benchmark: DataFrame, max_hit_share: float = 0.0, **options) -> DataFrame:
    """``docs`` without the documents of whose words more than ``max_hit_share`` are hit."""
    found = find_leaks(docs, benchmark, **options)
    leak = quoted(found.columns[-1])
    return found.where(F.size(leak["hits"]) <= F.lit(max_hit_share) * leak["n_words"]).drop(leak)

