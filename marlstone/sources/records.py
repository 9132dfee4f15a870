"""JSON and CSV records: reading, shaping, writing.

Readers and writers take batch or streaming DataFrames alike where Spark does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The fields of a message record and what stands for a missing one.
MESSAGE_SCHEMA = (
    "id BIGINT, text STRING, lang STRING, retweet_count INT, ts TIMESTAMP, "
    "entities STRUCT<hashtags: ARRAY<STRUCT<text: STRING>>>, "
    "user STRUCT<lang: STRING, name: STRING, screen_name: STRING, location: STRING, followers_count: INT, "
    "favourites_count: INT, friends_count: INT>, place STRUCT<country: STRING>, "
    "coordinates STRUCT<coordinates: ARRAY<DOUBLE>>, retweeted_status STRUCT<retweet_count: INT>")
MISSING_TEXT = "Data Error"
MISSING_PLACE = "Not available"
MISSING_FIELD = "NA"

# The columns of the movie table.
MOVIE_COLUMNS = ("title", "main_cast", "director", "genres", "lang", "plot", "imdbURL")


# -- JSON -------------------------------------------------------------------------

def read_topic(spark: SparkSession, servers: str, topic: str, streaming: bool = True, **options: str) -> DataFrame:
    """Records of a Kafka topic as a ``value`` string column (needs the connector)."""
    reader = (spark.readStream if streaming else spark.read).format("kafka")
    rows = reader.options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, **options}).load()
    return rows.select(F.col("value").cast("string").alias("value"))


def publish(df: DataFrame) -> DataFrame:
    """Whole rows as one JSON string column ``value``, as a topic sink takes them."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def parse(df: DataFrame, schema: str | T.StructType = MESSAGE_SCHEMA, value: str = "value") -> DataFrame:
    """Typed columns from a JSON ``value``; the schema is declared, never inferred."""
    return df.select(F.from_json(F.col(value), schema).alias("r")).select("r.*")


def read_json_documents(spark: SparkSession, path: str, schema: str | T.StructType = MESSAGE_SCHEMA) -> DataFrame:
    """Files that hold one JSON object or an array of them."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def archive(df: DataFrame, path: str) -> None:
    """Raw ``value`` records appended as JSON lines."""
    df.select("value").write.mode("append").text(path)


# -- message extraction ------------------------------------------------------------

def _or(c: Column, default) -> Column:
    return F.coalesce(c, F.lit(default))


def extract_message(df: DataFrame, *keep: str) -> DataFrame:
    """Nested message to thirteen flat columns with the agreed defaults."""
    point = F.col("coordinates.coordinates")

    def part(i: int) -> Column:
        value = F.coalesce(F.get(point, i).cast("string"), F.lit(MISSING_PLACE))
        return F.when(F.col("coordinates").isNotNull(), value)

    return df.select(
        *keep, _or(F.col("text"), MISSING_TEXT).alias("text"),
        _or(F.get("entities.hashtags", 0)["text"], MISSING_TEXT).alias("movie"),
        _or(F.col("user.lang"), MISSING_TEXT).alias("language"), F.col("place.country").alias("country"),
        _or(F.col("user.name"), MISSING_TEXT).alias("user_nm"), _or(F.col("user.screen_name"), MISSING_TEXT).alias("screen_nm"),
        part(1).alias("coordinates_lat"), part(0).alias("coordinates_long"), F.col("user.location").alias("location"),
        _or(F.col("retweeted_status.retweet_count"), 0).alias("retweets_count"),
        *[_or(F.col(f"user.{c}"), 0).alias(c) for c in ("followers_count", "favourites_count", "friends_count")])


def extract_message_file(df: DataFrame, *keep: str) -> DataFrame:
    """File form: trimmed one-line text, the record's own language and counts, raw coordinates."""
    return df.select(
        *keep, F.trim(F.replace("text", F.lit("\n"), F.lit(" "))).alias("text"), F.col("lang"),
        F.col("place.country").alias("country"), F.col("user.name").alias("user_nm"),
        F.col("coordinates.coordinates").alias("coordinates"), F.col("retweet_count"))


def track_filter(df: DataFrame, tracked: DataFrame, language: str = "en") -> DataFrame:
    """Records in the language that carry any tracked hash tag (``name`` column).

    The tracked names are a list someone keeps by hand: one scalar array, looked
    up in the row's own projection, so no record is shuffled.
    """
    wanted = tracked.agg(F.collect_set(F.lower(F.regexp_replace("name", "^#", ""))).alias("names")).scalar()
    tags = F.transform("entities.hashtags.text", F.lower)
    return df.filter((F.col("lang") == language) & F.arrays_overlap(tags, wanted))


def track_query(names: Sequence[str]) -> str:
    """Tracked names as one OR query string."""
    return " OR ".join(names)


# -- movie records -------------------------------------------------------------------

def normalise_movie(df: DataFrame, cast_size: int = 5) -> DataFrame:
    """Seven text columns: first director, first cast names, lists as JSON, gaps as NA."""
    def listed(c: str) -> Column:
        return F.when(F.size(c) > 0, F.to_json(F.col(c)))

    names = F.transform(F.slice("cast", 1, cast_size), lambda p: p["name"])
    return df.select(
        _or(F.col("title"), MISSING_FIELD).alias("title"),
        _or(F.when(F.size("cast") > 0, F.to_json(names)), MISSING_FIELD).alias("main_cast"),
        _or(F.get("director", 0), MISSING_FIELD).alias("director"),
        *[_or(listed(c), MISSING_FIELD).alias(c) for c in ("genres", "lang", "plot")],
        _or(F.col("url"), MISSING_FIELD).alias("imdbURL"))


def save_movie_table(df: DataFrame, name: str) -> None:
    """Overwrite the CSV-backed movie table: comma, double quote, backslash escape."""
    df.select(*MOVIE_COLUMNS).write.mode("overwrite").format("csv").options(sep=",", quote='"', escape="\\").saveAsTable(name)


# -- CSV -------------------------------------------------------------------------------

def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None, fill: str | None = "") -> DataFrame:
    """CSV with a header; text gaps become ``fill``.  Without a schema types are inferred."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    df = reader.option("inferSchema", True).csv(path) if schema is None else reader.schema(schema).csv(path)
    return df if fill is None else df.na.fill(fill)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def cached_features(spark: SparkSession, path: str, build) -> DataFrame:
    """Read a parquet result when it is complete, else build and write it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
