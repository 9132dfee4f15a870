"""Line dedup: lines spread over many sites are boilerplate; all but their first occurrence go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import free_name, quoted, text_hash
from marlstone.session import write_cut

MIN_SITES = 5
# A sketch of 2^9 buckets has a standard error of 4.6 %; beyond three of them it decides by itself.
LG_K = 9
MARGIN = 0.15


def line_key(line: Column) -> Column:
    """128 bits of a line without regard to case and to the amount of white space."""
    plain = F.lower(F.trim(F.regexp_replace(line, r"\s+", " ")))
    return F.struct(F.xxhash64(plain).alias("a"), F.xxhash64(plain, F.lit(1)).alias("b"))


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str, min_chars: int | None) -> DataFrame:
    """One row (doc, th, site, pos, key) for each line that counts."""
    rows = docs.select(quoted(id_col).alias("doc"), text_hash(quoted(text_col)).alias("th"), quoted(site_col).alias("site"),
                       F.posexplode_outer(F.split(quoted(text_col), "\n", -1)).alias("pos", "line"))
    counts = F.col("line").rlike(r"\S") if min_chars is None else F.length(F.trim("line")) >= min_chars
    return rows.where(counts).select("doc", "th", "site", "pos", line_key(F.col("line")).alias("key"))


def boilerplate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
                      min_sites: int = MIN_SITES, min_chars: int | None = None, lg_k: int = LG_K, margin: float = MARGIN) -> DataFrame:
    """Lines found on at least ``min_sites`` distinct sites: (key, n_sites, exact, first).

    A HyperLogLog sketch of the sites of each line key is merged by the aggregation.  Estimates further
    than ``margin`` from the threshold decide; the lines nearer to it get exact distinct counts.  ``first``
    is the smallest (document, text hash, position) that has the line.  Null sites are no sites; blank
    lines are none, or, where ``min_chars`` is given, lines of fewer characters; an empty table has no
    such lines.
    """
    lines = _lines(docs, id_col, text_col, site_col, min_chars)
    spread = lines.groupBy("key").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg(F.when(F.col("site").isNotNull(), F.xxhash64("site")), F.lit(lg_k))).alias("estimate"),
        F.min(F.struct("doc", "th", "pos")).alias("first"))
    wide = write_cut(spread.where(F.col("estimate") >= min_sites * (1 - margin)), "line-spread")
    near = wide.where(F.col("estimate") <= min_sites * (1 + margin))
    counted = (lines.where(F.col("site").isNotNull()).join(near.select("key"), "key", "left_semi")
               .groupBy("key", "site").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count("one").alias("n")))
    return (wide.join(counted, "key", "left")
            .where(F.coalesce("n", "estimate") >= min_sites)
            .where((F.col("estimate") > min_sites * (1 + margin)) | F.col("n").isNotNull())
            .select("key", F.coalesce("n", "estimate").alias("n_sites"), F.col("n").isNotNull().alias("exact"), "first"))


def _without(text: Column, gone: Column) -> Column:
    """The lines of a text but those at the sorted positions ``gone``: joined slices between them, in linear time."""
    parts = F.array(F.struct(F.split(text, "\n", -1).alias("lines"), F.concat(
        F.array(F.lit(-1)), gone, F.array(F.size(F.split(text, "\n", -1)))).alias("cuts")))
    # The lambda's argument holds the split text, so that no slice splits it again.
    return F.element_at(F.transform(parts, lambda p: F.array_join(F.flatten(F.transform(
        F.sequence(F.lit(1), F.size(p["cuts"]) - 1),
        lambda j: F.slice(p["lines"], p["cuts"][j - 1] + 2, p["cuts"][j] - p["cuts"][j - 1] - 1))), "\n")), 1)


def mark_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
                     min_sites: int = MIN_SITES, min_chars: int | None = None) -> DataFrame:
    """``docs`` with a last column ``removed``: (clean_text, positions of removed lines).

    Every occurrence of a boilerplate line but the first in the corpus is removed, so nothing is lost
    from the corpus as a whole.  Null texts stay null and have no lines; an empty text is one empty line
    and stays.  Rows equal in id and text count as one occurrence, so both keep a first line; rows with
    one id and different texts are told apart.  The column is named ``removed_`` and so on where needed.
    """
    found = write_cut(boilerplate_lines(docs, id_col, text_col, site_col, min_sites, min_chars), "boilerplate")
    hits = (_lines(docs, id_col, text_col, site_col, min_chars).join(found.select("key", "first"), "key")
            .where(~F.col("first").eqNullSafe(F.struct("doc", "th", "pos")))
            .groupBy("doc", "th").agg(F.array_sort(F.collect_set("pos")).alias("gone")))
    d, h, name = docs.alias("d"), hits.alias("h"), free_name(docs, "removed")
    text = F.col("d.`" + text_col.replace("`", "``") + "`")
    joined = d.join(h, F.col("d.`" + id_col.replace("`", "``") + "`").eqNullSafe(F.col("h.doc")) & (text_hash(text) == F.col("h.th")), "left")
    return joined.select("d.*", F.struct(
        F.when(F.col("h.gone").isNull(), text).otherwise(_without(text, F.col("h.gone"))).alias("clean_text"),
        F.coalesce("h.gone", F.array().cast("array<int>")).alias("positions")).alias(name))


def drop_boilerplate(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with cleaned texts; a document that had nothing else than removed lines goes."""
    marked = mark_boilerplate(docs, text_col=text_col, **options)
    removed = quoted(marked.columns[-1])
    kept = marked.where((F.size(removed["positions"]) == 0) | (F.trim(removed["clean_text"]) != ""))
    return kept.withColumn(text_col, removed["clean_text"]).drop(removed)
