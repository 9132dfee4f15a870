"""Token look-ups that leave the tokens in their row.

A token-wise join sends every token, and what it found, over the network.  Here
a table of up to ``HELD`` bytes goes whole to all workers, and the rows are not
sent at all.  For a larger one rows are dealt into blocks of about ``BLOCK``
tokens, file by file, and a block gets each entry it needs once, however often
its word stands there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import write_cut

BLOCK = 1 << 20       # tokens of a block, on average
PIECE = 1 << 12       # tokens whose vectors are summed at a time
HELD = 1 << 26        # bytes of a table that every worker keeps whole
SLICE = 1 << 20       # tokens looked up at a time in a held table
SHARES = 1 << 20      # steps in which the rows of a file are dealt to its blocks

# From the table's rows (w, v) to what turns a batch of rows into a batch of results.
Make = Callable[[pa.Table], Callable[[pa.RecordBatch], pa.RecordBatch]]


def _bytes(c: Column, kind: T.DataType) -> Column:
    """The bytes of a value, about as Arrow has them."""
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + _bytes(x, kind.elementType)), F.lit(0)) + 4
    if isinstance(kind, T.StringType):
        return F.coalesce(F.octet_length(c), F.lit(0)).cast("long") + 4
    return F.lit(4 if isinstance(kind, (T.FloatType, T.IntegerType)) else 8).cast("long")


def held(table: DataFrame) -> tuple[Broadcast | None, DataFrame]:
    """The rows of a table for every worker, or None if they have more than ``HELD`` bytes; and the table, written once."""
    written = write_cut(table, "held")
    size = written.agg(F.sum(sum(_bytes(F.col(f.name), f.dataType) for f in written.schema)).alias("n")).first()["n"] or 0
    return (table.sparkSession.sparkContext.broadcast(written.toArrow().combine_chunks()) if size <= HELD else None), written


def apart(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """The rows whose keys no other row has, and the others if there are any.  Null keys are equal here."""
    twice = write_cut(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*[F.col(k).alias(f"_again{i}") for i, k in enumerate(keys)]), "repeated-keys")
    if twice.isEmpty():
        return df, None
    same = [F.col(k).eqNullSafe(F.col(f"_again{i}")) for i, k in enumerate(keys)]
    return df.join(twice, same, "left_anti"), df.join(twice, same, "left_semi")


def in_blocks(rows: DataFrame, keys: list[str], tokens: str, table: DataFrame, make: Make, schema: T.StructType, size: int | None = None) -> DataFrame:
    """What ``make`` makes of the rows of ``table`` (w, v) for the tokens of a block, on each batch of written ``rows`` there.

    ``_file`` names the file of a row.  A block of ``size`` tokens has files that
    follow one another, or a share of the rows of a large one, so what a task that
    reads them wants is mostly the same words.  A task holds its block's part of
    the table and one batch of rows.
    The rows come as columns _k0, _k1, ... for ``keys`` and _t for the tokens.
    """
    size = size or BLOCK
    each = rows.groupBy("_file").agg(F.sum(F.greatest(F.size(tokens), F.lit(0)).cast("long")).alias("n")).collect()
    starts, total = [], 0
    for r in sorted(each, key=lambda r: r["_file"]):
        starts.append((r["_file"], total, r["n"] or 0))
        total += r["n"] or 0
    blocks = total // size + 1
    # Written, so that Spark knows how small it is.
    files = write_cut(rows.sparkSession.createDataFrame(starts, "_file string, _start long, _n long").coalesce(1), "files")
    share = F.pmod(F.xxhash64(*keys, tokens), F.lit(SHARES)) / F.lit(SHARES)
    dealt = rows.join(files, "_file").select(
        F.floor((F.col("_start") + share * F.col("_n")) / size).cast("int").alias("_block"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(tokens).alias("_t"))
    wanted = dealt.select("_block", F.explode_outer("_t").alias("_w")).filter("_w IS NOT NULL").distinct()
    found = wanted.join(table.select(F.col("w").alias("_w"), F.col("v").alias("_v")), "_w").select("_block", "_w", "_v")
    both = found.withColumn("_row", F.lit(False)).unionByName(dealt.withColumn("_row", F.lit(True)), allowMissingColumns=True)
    placed = both.repartitionById(blocks, F.col("_block")).sortWithinPartitions("_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, apply = [], None
        for batch in batches:
            entries = batch.num_rows - (pc.sum(batch["_row"]).as_py() or 0)
            if entries:
                parts.append(batch.slice(0, entries).select(["_w", "_v"]).rename_columns(["w", "v"]))
            if entries < batch.num_rows:
                if apply is None:
                    empty = pa.schema([("w", batch.schema.field("_w").type), ("v", batch.schema.field("_v").type)])
                    apply, parts = make(pa.Table.from_batches(parts, None if parts else empty)), []
                yield apply(batch.slice(entries))

    return placed.mapInArrow(run, schema)


def _written(df: DataFrame) -> DataFrame:
    return write_cut(df, "tokens").select("*", F.col("_metadata.file_name").alias("_file"))


def flat(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """The items of all lists in a row, and how many each list has."""
    return lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def slices(lists: pa.Array) -> Iterator[pa.Array]:
    """Lists in a row of about ``SLICE`` tokens together; one longer than that is alone."""
    whole = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // SLICE
    bounds = [0, *(np.flatnonzero(np.diff(whole)) + 1).tolist(), len(lists)]
    for a, b in zip(bounds, bounds[1:]):
        yield lists.slice(a, b - a)


def _column(table: pa.Table, name: str) -> pa.Array:
    chunks = table[name].chunks
    return pa.concat_arrays(chunks) if chunks else pa.array([], table[name].type)


def places(tokens: pa.Array, words: pa.Array) -> np.ndarray:
    """The place of each token among the words, or -1."""
    return pc.fill_null(pc.index_in(tokens, value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _taker(known: pa.Table, keep: bool, missing: object) -> Callable[[pa.Array], tuple[pa.Array, np.ndarray, np.ndarray, pa.Array]]:
    """From token lists to the values of all tokens in a row, how many each token has, how many tokens each list has, and
    where the values of a list begin and end."""
    words, lists = _column(known, "w"), _column(known, "v")
    entries, sizes = flat(lists)
    begin, sizes = np.append(np.cumsum(sizes) - sizes, 0), np.append(sizes, 0)

    def take(tokens: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, pa.Array]:
        items, length = flat(tokens)
        place = places(items, words)
        there = place >= 0
        count = np.where(there, sizes[place], int(keep))
        others = pa.array([missing], entries.type) if missing is not None else items if keep else entries.slice(0, 0)
        first = np.where(there, begin[place], len(entries) + (0 if missing is not None else np.arange(len(items))))
        end = np.cumsum(count)
        taken = pa.concat_arrays([entries, others]).take(pa.array(np.repeat(first - (end - count), count) + np.arange(count.sum())))
        row_end = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(length)])]
        return taken, count, length, pa.array(row_end, pa.int32())

    return take


def values_of(table: DataFrame, word: str, value: Column) -> DataFrame:
    """(w, v): all values of a word, the smallest first."""
    values = F.array_sort(F.collect_list(F.struct(value.alias("v")))).getField("v")
    return table.filter(F.col(word).isNotNull()).groupBy(F.col(word).alias("w")).agg(values.alias("v"))


def look_up(df: DataFrame, keys: list[str], tokens: str, table: DataFrame, word: str, value: Column, name: str,
            keep: bool = False, missing: object = None, empty: bool = False) -> DataFrame:
    """(keys, ``name``): the ``value`` of each token by the rows of ``table`` with that ``word``, in the tokens' order.

    A token without a row is left out; with ``keep`` it stands as ``missing``, or
    as itself.  One with several rows gives all their values, the smallest first.
    Rows that share their keys give one row, position by position; keys without
    any value give none.  With ``empty`` a row with an empty list gives one too.
    """
    df = df.select(*keys, F.col(tokens).alias("_tokens"))
    known, found = held(values_of(table, word, value))
    if known is None:
        return _look_up_in_blocks(df, keys, found, name, keep, missing, empty)
    once, again = apart(df, keys)
    schema = T.StructType([*df.select(keys).schema, T.StructField(name, found.schema["v"].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take = _taker(known.value, keep, missing)
        for batch in batches:
            at = 0
            for lists in slices(batch["_tokens"]):
                taken, _, length, offsets = take(lists)
                some = np.diff(offsets) > 0
                if empty:
                    some |= (length == 0) & lists.is_valid().to_numpy(zero_copy_only=False)
                columns = [*[batch[k].slice(at, len(lists)) for k in keys], pa.ListArray.from_arrays(offsets, taken)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names).filter(pa.array(some))
                at += len(lists)

    out = once.mapInArrow(run, schema)
    return out if again is None else out.unionByName(_look_up_in_blocks(again, keys, found, name, keep, missing, empty))


def looked_up(tokens: Column, known: Broadcast, kind: T.DataType, keep: bool = False, missing: object = None) -> Column:
    """The values of each token of a list by a table that every worker holds; a null list has none."""
    @F.arrow_udf(kind)
    def values(lists: pa.Array) -> pa.Array:
        take, out = _taker(known.value, keep, missing), []
        for part in slices(lists):
            taken, _, _, offsets = take(part)
            out.append(pa.ListArray.from_arrays(offsets, taken, mask=part.is_null()))
        return pa.concat_arrays(out)

    return values(tokens)


def _look_up_in_blocks(df: DataFrame, keys: list[str], found: DataFrame, name: str, keep: bool, missing: object, empty: bool) -> DataFrame:
    kind = found.schema["v"].dataType
    # Filtered as they are read: a filter on a computed array computes it once more.
    written = _written(df)
    rows = written.filter("size(_tokens) > 0")
    position = F.lit(None).cast("array<int>")
    if not rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").isEmpty():
        lists = rows.groupBy(*keys).agg(F.collect_list("_tokens").alias("_l"))
        position = F.when(F.size("_l") > 1, F.flatten(F.transform("_l", lambda t: F.sequence(F.lit(0), F.size(t) - 1))))
        rows = _written(lists.select(*keys, F.flatten("_l").alias("_tokens"), position.alias("_position")))
        position = F.col("_position")
    rows = rows.withColumn("_position", position)
    carried = [*keys, "_position"]
    schema = T.StructType([*rows.select(carried).schema, T.StructField("_v", kind)])

    def make(known: pa.Table) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        take = _taker(known, keep, missing)

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            taken, count, length, offsets = take(batch["_t"])
            at = batch[f"_k{len(keys)}"]
            if at.null_count < len(at):
                position = np.zeros(len(count), np.int32)
                position[np.repeat(at.is_valid().to_numpy(zero_copy_only=False), length)] = at.flatten().to_numpy()
                at = pa.ListArray.from_arrays(offsets, pa.array(np.repeat(position, count)), mask=at.is_null())
            columns = [*[batch[f"_k{i}"] for i in range(len(keys))], at, pa.ListArray.from_arrays(offsets, taken)]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        return apply

    out = in_blocks(rows, carried, "_tokens", found, make, schema).filter("size(_v) > 0")
    together = F.array_sort(F.arrays_zip("_position", "_v")).getField("_v")
    out = out.select(*keys, F.when(F.col("_position").isNull(), F.col("_v")).otherwise(together).alias(name))
    return out.unionByName(written.filter("size(_tokens) <= 0").select(*keys, F.array().cast(kind).alias(name))) if empty else out


def vector_sums(df: DataFrame, key: str, tokens: str, vectors: DataFrame, size: int) -> DataFrame:
    """(key, _m, _s): the number of words with a vector in each row of ``df``, and the sums of their vectors.

    ``vectors`` has word and vec; a word with several counts for each of them.
    A component that is null everywhere has no sum.
    """
    rows = df.select(key, F.col(tokens).alias("_tokens"))
    number = "float" if vectors.schema["vec"].dataType == T.ArrayType(T.FloatType()) else "double"
    table = vectors.select(F.col("word").alias("w"), F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.get("vec", i).cast(number)).alias("v"))
    schema = T.StructType([rows.schema[key], T.StructField("_m", T.LongType()), T.StructField("_s", T.ArrayType(T.DoubleType()))])

    def make(known: pa.Table) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        words, entries = _column(known, "w"), _column(known, "v").flatten()
        matrices = [pc.fill_null(entries, 0.0).to_numpy(zero_copy_only=False).reshape(-1, size)]
        if entries.null_count:
            matrices.append(entries.is_valid().to_numpy(zero_copy_only=False).reshape(-1, size))
        different, times = pc.unique(words), np.ones(len(words))
        if len(different) < len(words):
            spot = places(words, different)
            times = np.bincount(spot, minlength=len(different))
            each, matrices = matrices, [np.zeros((len(different), size)) for _ in matrices]
            for to, part in zip(matrices, each):
                np.add.at(to, spot, part)

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            items, length = flat(batch["_t"])
            place = places(items, different)
            row = np.repeat(np.arange(batch.num_rows), length)[place >= 0]
            place = place[place >= 0]
            n = np.bincount(row, times[place], batch.num_rows)
            sums = [np.zeros((batch.num_rows, size)) for _ in matrices]
            for at in range(0, len(place), PIECE):
                mine = row[at:at + PIECE]
                first = np.flatnonzero(np.diff(mine, prepend=-1))
                for to, part in zip(sums, matrices):
                    to[mine[first]] += np.add.reduceat(part[place[at:at + PIECE]].astype(float), first, axis=0)
            some = np.flatnonzero(n)
            mask = (sums[1][some] == 0).ravel() if len(sums) > 1 else None
            offsets = pa.array(np.arange(len(some) + 1) * size, pa.int32())
            return pa.RecordBatch.from_arrays([batch["_k0"].take(pa.array(some)), pa.array(n[some].astype(np.int64)),
                                               pa.ListArray.from_arrays(offsets, pa.array(sums[0][some].ravel(), mask=mask))], names=schema.names)

        return apply

    known, table = held(table)
    if known is None:
        return in_blocks(_written(rows).filter("size(_tokens) > 0"), [key], "_tokens", table, make, schema, 32 * BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(make(known.value), batches)

    return rows.select(F.col(key).alias("_k0"), F.col("_tokens").alias("_t")).mapInArrow(run, schema)
