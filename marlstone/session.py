"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings every job here relies on.  AQE re-plans skewed joins and coalesces
# small shuffle partitions; the broadcast limit is Spark's own size check, so
# the library never forces a broadcast.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Keyed state of endless streams stays off the heap.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def get_session(app: str = "marlstone", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's settings; ``conf`` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it.

    A session without the setting gets a folder below its warehouse, which the
    executors share too.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, one per call."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# Removes the shuffle files of a query as soon as it has ended.
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, a query's shuffle files go when it ends, not when the driver happens to collect its garbage.

    Spark makes them again should a later query ask for the same ones.
    """
    before = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(_FREED) if before is None else spark.conf.set(_FREED, before)


def write_cut(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of ``df`` by writing it once to the shared folder.

    Used where a result is read many times or where a later step must see the
    same rows after an executor is lost.
    """
    path = new_folder(df.sparkSession, name)
    with freed_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def single_row(df: DataFrame, *names: str):
    """A one-row aggregate as a struct-valued scalar subquery.

    The value is computed once and handed to every task, so a global minimum,
    total or a per-class threshold map needs neither a join nor a collect.
    """
    return df.select(F.struct(*[F.col(n) for n in (names or df.columns)]).alias("v")).scalar()
