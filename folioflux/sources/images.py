"""Image files under center folders, uploads, truth tables, and the cache of recognised lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflux.functions.schemas import BOX
from folioflux.functions.text import safe_stem
from folioflux.operators.evaluate import FIELDS
from folioflux.operators.select import cache_key, even_ordinals, with_ordinal

EXTENSIONS = ("jpg", "jpeg", "png", "webp", "tif", "tiff")
LARGEST_UPLOAD = 15 << 20
#: Fixed first bytes of the formats taken; of webp, what follows the container's size too
MAGIC = {"jpg": ["FFD8FF"], "jpeg": ["FFD8FF"], "png": ["89504E470D0A1A0A"], "webp": ["52494646"], "tif": ["49492A00", "4D4D002A"], "tiff": ["49492A00", "4D4D002A"]}
WEBP = "57454250"
CACHE_VERSION = "lines-1"


def files(spark: SparkSession, folder: str, content: bool = True) -> DataFrame:
    """path, relative, extension, length (and content) of the image files below a folder."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    rows = rows.withColumn("extension", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))).where(F.col("extension").isin(*EXTENSIONS))
    base = F.lit(folder.rstrip("/").split("://")[-1].removeprefix("file:"))
    start = F.instr(F.col("path"), base) + F.length(base) + 1
    rows = rows.withColumn("relative", F.substring(F.col("path"), start, F.length("path")))
    return rows.select("path", "relative", "extension", "length", *(["content"] if content else []))


def discover(spark: SparkSession, folder: str, centers: DataFrame, content: bool = True) -> DataFrame:
    """Images of configured centers with their ordinal by lower-case path; a center's folder may be nested (a/b)."""
    rows = files(spark, folder, content)
    parts = F.split("relative", "/")
    # every leading part of the folder may be a slug; an equi-join finds it
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    found = rows.withColumn("slug", F.explode(F.when(F.size(parts) > 1, prefixes).otherwise(F.array().cast("array<string>"))))
    found = found.join(centers.select("slug", F.col("name").alias("center_name")), "slug")
    key = [F.sha2("content", 256)] if content else [F.sha2("path", 256)]
    found = found.withColumnRenamed("slug", "center_slug").withColumn("image_id", key[0])
    places = with_ordinal(found.select("path", F.lower("path").alias("_low")), ["_low", "path"]).drop("_low")
    return found.join(places, "path")


def unmapped(spark: SparkSession, folder: str, centers: DataFrame) -> DataFrame:
    """path of images under no configured center."""
    rows = files(spark, folder, content=False)
    return rows.join(discover(spark, folder, centers, content=False).select("path"), "path", "left_anti").select("path", "relative")


def sample_evenly(images: DataFrame, limit: int | None) -> DataFrame:
    """`limit` images spread over the ordinals, first and last among them."""
    if limit is None:
        return images
    return images.join(even_ordinals(images.sparkSession, images.count(), limit), "ordinal", "left_semi")


def check_uploads(rows: DataFrame) -> DataFrame:
    """Rows name, content with `error` (null: fine) and `stored` (NNN_stem.ext by order of name)."""
    ext = F.lower(F.regexp_extract("name", r"\.([^./]+)$", 1))
    head = F.hex(F.substring("content", 1, 8))
    known = F.lit(False)
    for e, marks in MAGIC.items():
        for m in marks:
            known = known | ((ext == e) & F.startswith(head, F.lit(m)))
    known = known & ((ext != "webp") | (F.hex(F.substring("content", 9, 4)) == WEBP))
    error = F.when(~ext.isin(*EXTENSIONS), "extensión").when(F.length("content") == 0, "vacío").when(F.length("content") > LARGEST_UPLOAD, "tamaño").when(~known, "formato")
    stem = safe_stem(F.regexp_replace("name", r"\.[^./]+$", ""))
    number = F.row_number().over(Window.orderBy("name"))
    return rows.withColumn("error", error).withColumn("stored", F.format_string("%03d_%s.%s", number, stem, ext))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Truth rows of `;` CSVs: stem, row_no (order in the file), trimmed fields.

    Files that are not UTF-8 give no rows here; encoding_errors names them.
    """
    raw = spark.read.csv(path, sep=";", header=True, encoding="UTF-8")
    raw = raw.toDF(*(c.lstrip("﻿").strip() for c in raw.columns))
    missing = [f for f in FIELDS if f not in raw.columns]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)}")
    rows = raw.withColumn("stem", F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]+$", 1)).withColumn("_at", F.monotonically_increasing_id())
    rows = rows.join(encoding_errors(spark, path).select("stem"), "stem", "left_anti")
    order = Window.partitionBy("stem").orderBy("_at")
    return rows.select("stem", F.row_number().over(order).cast("long").alias("row_no"), *(F.coalesce(F.trim(F.col(f)), F.lit("")).alias(f) for f in FIELDS))


def encoding_errors(spark: SparkSession, path: str) -> DataFrame:
    """stem, row_no (null), error of the truth files that are not UTF-8, in the form of evaluate.truth_errors."""
    rows = spark.read.format("binaryFile").load(path).where(~F.is_valid_utf8(F.col("content").cast("string")))
    return rows.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("stem"), F.lit(None).cast("long").alias("row_no"), F.lit("codificación").alias("error"))


def pair_cases(images: DataFrame, truth: DataFrame, only: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(stem, path) of images with truth, and (stem, error) of stems that lack one side or have several images."""
    stems = images.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("stem"), "path").groupBy("stem").agg(F.min("path").alias("path"), F.count("*").alias("n"))
    both = stems.join(truth.select("stem").distinct().withColumn("truth", F.lit(True)), "stem", "full_outer")
    if only is not None:
        wanted = images.sparkSession.createDataFrame([(o.casefold(),) for o in only], "key string").distinct()
        both = both.withColumn("key", F.lower("stem")).join(wanted, "key", "right").withColumn("stem", F.coalesce("stem", "key"))
    error = F.when(F.col("path").isNull() & F.col("truth").isNull(), "no encontrado").when(F.col("path").isNull(), "sin imagen").when(F.col("truth").isNull(), "sin datos esperados").when(F.col("n") > 1, "imagen duplicada")
    both = both.withColumn("error", error)
    return both.where("error is null").select("stem", "path"), both.where("error is not null").select("stem", "error")


# ---------------------------------------------------------------- cache of recognised lines

CACHED = f"key string, version string, mode string, lines array<struct<line_no:int,text:string,score:double,box:{BOX},image_width:int,image_height:int>>, audit string"


def read_cache(spark: SparkSession, path: str, mode: str, version: str = CACHE_VERSION) -> DataFrame:
    """Entries of this version and mode; a missing table is an empty one, corrupt files are misses."""
    from folioflux.sources.catalogs import _exists

    if not _exists(spark, path):
        return spark.createDataFrame([], CACHED)
    rows = spark.read.option("ignoreCorruptFiles", "true").schema(CACHED).parquet(path)
    return rows.where((F.col("version") == version) & (F.col("mode") == mode)).dropDuplicates(["key"])


def cached_lines(images: DataFrame, cache: DataFrame, mode: str, version: str = CACHE_VERSION) -> tuple[DataFrame, DataFrame]:
    """Lines of images that the cache holds, and the images it lacks."""
    keyed = images.withColumn("key", cache_key(version, mode, F.col("content")))
    hits = keyed.select("image_id", "key").join(cache.select("key", "lines"), "key").select("image_id", F.explode("lines").alias("l")).select("image_id", "l.*")
    return hits, keyed.join(cache.select("key"), "key", "left_anti")


def store_lines(lines: DataFrame, images: DataFrame, path: str, mode: str, version: str = CACHE_VERSION) -> None:
    """Append new lines (with audit) to the cache table; the committer makes a task's files appear at once. Images are
    those that were read: one without lines has an entry too, so it is not read again."""
    body = F.struct("line_no", "text", "score", "box", "image_width", "image_height")
    rows = lines.groupBy("image_id").agg(F.array_sort(F.collect_list(body)).alias("lines"), F.max("audit").alias("audit"))
    keyed = images.select("image_id", cache_key(version, mode, F.col("content")).alias("key"))
    made = keyed.join(rows, "image_id", "left").withColumn("lines", F.coalesce("lines", F.array().cast(rows.schema["lines"].dataType)))
    made.select("key", F.lit(version).alias("version"), F.lit(mode).alias("mode"), "lines", "audit").write.mode("append").parquet(path)
