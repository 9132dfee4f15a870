"""Embedding near-duplicates: an exact metric range join over cells around pivots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import quoted
from marlstone.llm.components import connected_components
from marlstone.session import write_cut

MIN_COSINE = 0.93
# One pivot for about so many distinct vectors of a label, and so many pivots of all labels at most.
CELL_ROWS = 8192
MAX_PIVOTS = 4096
# Rows whose distances to all pivots a task holds at a time.
ASSIGN_ROWS = 1024
# Rows of a cell that one task compares with the cell's other such blocks.
BLOCK_ROWS = 8192
# Room for rounding in a bound that only decides where a vector is sent.
SLACK = 1e-6


def _scaled(x: np.ndarray) -> np.ndarray:
    """Every row times the power of two that brings its largest component below one, so that no square over- or underflows as a whole."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def _unit(vectors: pa.ListArray) -> np.ndarray:
    width = len(vectors.flatten()) // max(len(vectors), 1)
    x = _scaled(vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), width).astype(np.float64))
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _reached(x: np.ndarray, centres: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, home) of the own cell of every row and of those a partner within ``reach`` may live in.

    With d(x, p) the distance to the own, nearest pivot p, a partner y of x that lives with q has
    d(y, q) <= d(y, p) <= d(x, p) + reach, hence d(x, q) <= d(x, p) + 2 reach.  Being nearer to q than to p,
    y lies beyond the plane halfway between them, which x is (d(x, q)^2 - d(x, p)^2) / 2 d(p, q) away from.
    """
    found = []
    for at in range(0, len(x), ASSIGN_ROWS):
        part = x[at:at + ASSIGN_ROWS]
        square = np.maximum(2 - 2 * part @ centres.T, 0)
        nearest = square.argmin(axis=1)
        least = square[np.arange(len(part)), nearest][:, None]
        between = np.sqrt(np.maximum(2 - 2 * centres[nearest] @ centres.T, 0))
        near = (np.sqrt(square) <= np.sqrt(least) + 2 * reach + SLACK) & (square - least <= 2 * between * reach + SLACK)
        near[np.arange(len(part)), nearest] = True
        row, cell = np.nonzero(near)
        found.append((row + at, cell, nearest[row] == cell))
    return tuple(np.concatenate(column) for column in zip(*found, strict=True))


def distinct_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, c, weight) of every row with its class of equal vectors, (id) of the rows that link with nothing, and (rep, label, v, weight) of the classes.

    Vectors of one label and equal components are one class named after its smallest id.
    """
    v = quoted(vector_col)
    usable = (quoted(label_col).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
              & F.exists(v, lambda x: x != 0))
    rows = vectors.select(quoted(id_col).alias("id"), F.when(usable, F.struct(quoted(label_col).alias("label"), F.transform(v, lambda x: x + F.lit(0.0)).alias("v"))).alias("k"))
    classes = write_cut(rows.where(F.col("k").isNotNull()).groupBy("k").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight"))
                        .select(F.monotonically_increasing_id().alias("c"), "rep", F.col("k.label").alias("label"), F.col("k.v").alias("v"), F.size("k.v").alias("width"), "weight"),
                        "vector-classes")
    usable_rows = rows.where(F.col("k").isNotNull()).alias("r")
    member = usable_rows.join(classes.alias("c"), (F.col("r.k.label") == F.col("c.label")) & (F.col("r.k.v") == F.col("c.v"))).select("r.id", "c.c", "c.weight")
    return member, rows.where(F.col("k").isNull()).select("id"), classes


def choose_pivots(classes: DataFrame, cell_rows: int, max_pivots: int) -> dict[tuple, np.ndarray]:
    """Unit pivots of each (label, width): a sample by hash, ``max_pivots`` or about that in all, at least one where there are rows."""
    counts = classes.groupBy("label", "width").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("first"))
    total = classes.count()
    share = min(1.0, 1.0 / cell_rows, max_pivots / max(total, 1))
    sample = classes.where(F.pmod(F.xxhash64("c"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # Labels are as bounded as the pivots: beyond that many, the first rows of the largest labels only are pivots of their own.
    firsts = classes.join(counts.orderBy(F.col("n").desc()).limit(max_pivots).select(F.col("first").alias("c")), "c", "left_semi")
    found: dict[tuple, list] = {}
    for r in sample.unionByName(firsts).select("label", "width", "v").limit(4 * max_pivots).collect():
        found.setdefault((r["label"], r["width"]), []).append(r["v"])
    return {k: _unit(pa.array(v, pa.list_(pa.float64()))) for k, v in found.items()}


def _assign(classes: DataFrame, pivots: dict, reach: float) -> DataFrame:
    """(label, width, cell, home, c, v, weight): every vector in its own cell, and copied to the cells its partners may live in."""
    shared = classes.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, width = (np.array(batch.column(i).to_pylist()) for i in (0, 1))
            for one in {(a, b) for a, b in zip(label.tolist(), width.tolist(), strict=True)}:
                rows = np.flatnonzero((label == one[0]) & (width == one[1]))
                part = batch.take(pa.array(rows))
                centres = shared.value.get(one)
                if centres is None:
                    where, cell, home = np.arange(len(rows)), np.zeros(len(rows), np.int32), np.ones(len(rows), bool)
                else:
                    where, cell, home = _reached(_unit(part.column(3)), centres, reach)
                part = part.take(pa.array(where))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell, pa.int32()), pa.array(home)],
                                                 names=["label", "width", "c", "v", "weight", "cell", "home"])

    rows = classes.select(F.col("label").cast("long"), "width", "c", "v", "weight")
    element = classes.schema["v"].dataType.simpleString()
    return rows.mapInArrow(assign, f"label long, width int, c long, v {element}, weight long, cell int, home boolean")


def _compare(pdf: pd.DataFrame, min_cosine: float) -> pd.DataFrame:
    """Links of the block's home vectors to the block they meet, by the sum of weights; and a spanning forest of these links."""
    home, other = (pdf[pdf["side"] == s] for s in (0, 1))
    empty = pd.DataFrame({"c": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64"), "u": pd.Series(dtype="int64"), "v": pd.Series(dtype="int64")})
    if not len(home) or not len(other):
        return empty
    a, b = (_scaled(np.array(p["v"].tolist(), np.float64)) for p in (home, other))
    na, nb = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
    ca, cb, weight = home["c"].to_numpy(), other["c"].to_numpy(), other["weight"].to_numpy()
    root = {int(c): int(c) for c in (*ca, *cb)}

    def top(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    n, edges = np.zeros(len(a), np.int64), []
    step = max(1, 4_000_000 // len(b))
    for at in range(0, len(a), step):
        near = (a[at:at + step] @ b.T) / (na[at:at + step, None] * nb[None, :]) >= min_cosine
        near &= ca[at:at + step, None] != cb[None, :]
        n[at:at + step] = near @ weight
        for i, j in zip(*np.nonzero(near), strict=True):
            u, v = top(int(ca[at + i])), top(int(cb[j]))
            if u != v:
                root[max(u, v)] = min(u, v)
                edges.append((int(ca[at + i]), int(cb[j])))
    links = pd.DataFrame({"c": ca, "n": n})
    forest = pd.DataFrame(edges, columns=["u", "v"]) if edges else empty[["u", "v"]]
    return pd.concat([links[links["n"] > 0], forest]).astype({k: "Int64" for k in ("c", "n", "u", "v")})[["c", "n", "u", "v"]]


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", min_cosine: float = MIN_COSINE,
                 cell_rows: int = CELL_ROWS, max_pivots: int = MAX_PIVOTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per vector: id, n_links (other vectors of its label with that cosine or more), component (smallest id reachable).

    Exact.  On the unit sphere a cosine is a distance, so each vector lives in the cell of its nearest pivot
    and is copied where the triangle inequality and the planes between pivots let a partner live; every cell is compared by itself, its
    own vectors with all in it.  A cell is cut into blocks of about ``block_rows``, which meet pair by pair
    in tasks of their own, so no cell is held whole.  Equal vectors are compared once and counted with
    their number.  Each comparison hands on counts and a spanning forest, never its pairs.

    Vectors that are null, empty, zero or hold null or non-finite components, and those with a null label,
    have no links and are their own component.  Vectors of different widths are not compared.  Rows with
    one id count as several vectors; a null id stays null and keeps its links.  An empty table has no rows.
    Labels are integers.
    """
    member, alone, classes = distinct_vectors(vectors, id_col, vector_col, label_col)
    reach = float(np.sqrt(max(0.0, 2 - 2 * min_cosine)))
    placed = write_cut(_assign(classes, choose_pivots(classes, cell_rows, max_pivots), reach), "cells")
    sizes = placed.groupBy("label", "width", "cell").agg(F.count(F.lit(1)).alias("size"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("size") / block_rows)).cast("int")
    cells = placed.join(sizes, ["label", "width", "cell"]).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    # Block a of the cell's own vectors meets every block b of all its vectors.
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    meet = (cells.where("home").select("label", "width", "cell", "c", "v", "weight", F.col("block").alias("a"), F.explode(every).alias("b"), F.lit(0).alias("side"))
            .unionByName(cells.select("label", "width", "cell", "c", "v", "weight", F.explode(every).alias("a"), F.col("block").alias("b"), F.lit(1).alias("side"))))
    found = write_cut(meet.groupBy("label", "width", "cell", "a", "b").applyInPandas(lambda pdf: _compare(pdf, min_cosine), "c long, n long, u long, v long"), "links")
    links = found.where(F.col("c").isNotNull()).groupBy("c").agg(F.sum("n").alias("n"))
    roots = connected_components(found.where(F.col("u").isNotNull()).select("u", "v"))
    named = roots.join(classes.select(F.col("c").alias("node"), "rep"), "node")
    smallest = named.groupBy("component").agg(F.min("rep").alias("smallest"))
    named = named.join(smallest, "component").select(F.col("node").alias("c"), "smallest")
    known = (classes.select("c", "rep").join(links, "c", "left").join(named, "c", "left")
             .select("c", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("smallest", "rep").alias("smallest")))
    # Rows that link with nothing stay out of the join, where they would all share the null key.
    linked = member.alias("m").join(known.alias("k"), F.col("m.c") == F.col("k.c")).select(
        "m.id", (F.col("k.n") + F.col("m.weight") - 1).alias("n_links"), F.col("k.smallest").alias("component"))
    return linked.unionAll(alone.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component")))
