"""A keyed table that grows by batches: parts, merged by size, and a snapshot per version."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_COMMIT = "version long, run string, batch long"
_SNAPSHOT = "part string, n_rows long"

# Folds rows of several parts into one; the flag says whether they go back to the first batch.
Fold = Callable[[DataFrame, bool], DataFrame]


def stored(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """A table that may not have been written yet."""
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def base_version(log: DataFrame | None, run: str, batch_id: int) -> tuple[int | None, bool]:
    """The version that a batch builds on, and whether the batch is already in it."""
    base = last = again = None
    if log is not None:
        mine, batch = F.col("run") == run, F.col("batch")
        base, last, again = log.agg(F.max("version"), F.max(F.when(mine & (batch < batch_id), batch)), F.max(F.when(mine & (batch == batch_id), batch))).first()
    if again is None and batch_id > 0 and last != batch_id - 1:
        raise RuntimeError(f"batch {batch_id} of run {run} needs batch {batch_id - 1}, the last one recorded is {last}")
    return base, again is not None


def add_batch(tables: str, name: str, run: str, batch_id: int, rows: Callable[[int], DataFrame], fold: Fold) -> None:
    """Add a batch's rows to the table ``name``, once.

    A batch writes a part of its own; ``rows`` gets its version.  The newest
    parts are merged as long as the one before is at most twice as large, so
    there are about log2 of the rows of parts and a row is written again about
    as often, whatever the number of batches.  ``name/version=N`` lists the
    parts of version N and ``commits`` records it when it is whole: a batch that
    is recorded is not added again, a version that is not recorded is written
    over.  A run whose previous batch is not recorded, or a recorded version
    that is gone, is an error.  Older versions, and parts no version lists any
    more, may be expired.
    """
    batch = rows(0)
    spark = batch.sparkSession
    base, known = base_version(stored(spark, f"{tables}/commits", _COMMIT), run, batch_id)
    if known:
        return
    parts = [] if base is None else [(r["part"], r["n_rows"]) for r in spark.read.schema(_SNAPSHOT).parquet(f"{tables}/{name}/version={base}").orderBy("part").collect()]
    version = 0 if base is None else base + 1

    def write(df: DataFrame, kind: str, n: int) -> tuple[str, int]:
        # Names sort by the newest version inside.
        part = f"{n:019d}-{kind}"
        df.write.mode("overwrite").parquet(f"{tables}/{name}-parts/{part}")
        return part, spark.read.parquet(f"{tables}/{name}-parts/{part}").count()

    parts.append(write(rows(version), "batch", version))
    first, size = len(parts) - 1, parts[-1][1]
    while first and parts[first - 1][1] <= 2 * size:
        first -= 1
        size += parts[first][1]
    if first < len(parts) - 1:
        merged = fold(_read(spark, tables, name, [p for p, _ in parts[first:]]), first == 0)
        parts[first:] = [write(merged, "merged", version)]
    spark.createDataFrame(parts, _SNAPSHOT).coalesce(1).write.mode("overwrite").parquet(f"{tables}/{name}/version={version}")
    spark.createDataFrame([(version, run, batch_id)], _COMMIT).coalesce(1).write.mode("append").parquet(f"{tables}/commits")


def _read(spark: SparkSession, tables: str, name: str, parts: list[str]) -> DataFrame:
    return spark.read.parquet(*[f"{tables}/{name}-parts/{p}" for p in parts])


def newest(spark: SparkSession, tables: str, name: str, fold: Fold) -> DataFrame:
    """The table as of the newest recorded version."""
    version = spark.read.schema(_COMMIT).parquet(f"{tables}/commits").agg(F.max("version")).first()[0]
    parts = [r["part"] for r in spark.read.schema(_SNAPSHOT).parquet(f"{tables}/{name}/version={version}").collect()]
    return fold(_read(spark, tables, name, parts), True)
