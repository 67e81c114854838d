"""Row selection and keyed updates: even sampling, catalog joins, edits, cell merges, quality gates, cache look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflux.operators.graph import cut_lineage


def with_ordinal(rows: DataFrame, order: list[str], name: str = "ordinal", bucket_rows: int = 100_000) -> DataFrame:
    """Global position from 0 by columns that order rows fully (rows equal in all of them are interchangeable).

    Rows are range-partitioned over all the columns, bucket_rows or so a range however many equal values the first one
    has, sorted and numbered inside a range; a range starts after the counts of those before it. The numbered rows are
    written before they are counted, so both agree. No task sees all rows.
    """
    ranges = max(1, -(-rows.count() // bucket_rows))
    place = F.monotonically_increasing_id()  # the range in the upper bits, the row's number in it in the lower 33
    ranged = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_place", place)
    ranged = cut_lineage(ranged.withColumn("_range", F.shiftright("_place", 33)).withColumn("_inside", F.col("_place").bitwiseAND((1 << 33) - 1)).drop("_place"))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))  # one row a range
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return ranged.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_inside")).drop("_range", "_inside", "_start")


def even_ordinals(spark: SparkSession, total: int, limit: int | None) -> DataFrame:
    """Ordinals of `limit` rows spread evenly over `total`, first and last included (half to even); all if no limit."""
    if limit is None or limit >= total:
        return spark.range(total).select(F.col("id").alias("ordinal"))
    if limit <= 1:
        return spark.range(max(limit, 0)).select(F.col("id").alias("ordinal"))
    place = F.bround(F.col("id") * F.lit(float(total - 1)) / F.lit(float(limit - 1)))
    return spark.range(limit).select(place.cast("long").alias("ordinal")).distinct()


def mapped(rows: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    return rows.join(catalog, key)


def unmapped(rows: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    return rows.join(catalog, key, "left_anti")


def apply_edits(rows: DataFrame, edits: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows whose key has an edit take all its columns (nulls too); edits of unknown keys are ignored. One edit a key."""
    e = edits.select(F.col(key), F.lit(True).alias("_edited"), *(F.col(c).alias(f"_new_{c}") for c in columns))
    out = rows.join(e, key, "left")
    for c in columns:
        out = out.withColumn(c, F.when(F.col("_edited"), F.col(f"_new_{c}")).otherwise(F.col(c)))
    return out.drop("_edited", *(f"_new_{c}" for c in columns))


def weighted_score(score: Column, weight: Column) -> Column:
    """Aggregate: score weighted by text length, 0 for no text."""
    return F.coalesce(F.sum(score * weight) / F.nullif(F.sum(weight), F.lit(0)), F.lit(0.0))


def merge_cells(initial: DataFrame, refined: DataFrame, key: list[str], margin: float = 0.12) -> DataFrame:
    """Full outer join of (key, score, value): the refined value wins where its score is over the initial's + margin,
    or where there is no initial one."""
    a, b = initial.select(*key, F.col("score").alias("s0"), F.col("value").alias("v0")), refined.select(*key, F.col("score").alias("s1"), F.col("value").alias("v1"))
    wins = F.col("s0").isNull() | (F.col("s1") > F.col("s0") + margin)
    wins = F.coalesce(wins & F.col("s1").isNotNull(), F.lit(False))
    return a.join(b, key, "full_outer").select(*key, F.when(wins, F.col("v1")).otherwise(F.col("v0")).alias("value"), F.when(wins, F.col("s1")).otherwise(F.col("s0")).alias("score"), wins.alias("refined"))


def quality(score: Column, length: Column, words: Column, documents: Column, strange: Column) -> Column:
    """Aggregate: a page's length-weighted score with bonuses for words, documents and length, less strange text."""
    share = F.coalesce(F.sum(strange) / F.nullif(F.sum(length), F.lit(0)), F.lit(0.0))
    return weighted_score(score, length) + F.least(F.lit(0.14), 0.004 * F.sum(words) + 0.04 * F.sum(documents)) + F.least(F.lit(0.08), F.sum(length) / 700) - F.least(F.lit(0.20), share)


def accept(before: Column, after: Column, coverage_before: Column, coverage_after: Column) -> Column:
    """A refinement is kept if coverage does not fall and quality rises by a hundredth."""
    return (coverage_after + 0.001 >= coverage_before) & (after >= before + 0.01)


def cache_key(version: str, mode: str, content: Column) -> Column:
    return F.sha2(F.concat(F.lit(version.encode()), F.lit(b"\0"), F.lit(mode.encode()), F.lit(b"\0"), content), 256)


def split_cached(images: DataFrame, cache: DataFrame, version: str, mode: str) -> tuple[DataFrame, DataFrame]:
    """Hits (with the cached columns) and misses of images (with content) by key."""
    keyed = images.withColumn("key", cache_key(version, mode, F.col("content")))
    return keyed.join(cache, "key"), keyed.join(cache.select("key"), "key", "left_anti")
