"""Catalog CSVs (UTF-8, byte order mark allowed): centers, specialties, places, name lexicons.

Catalogs are checked to be small before they come to the driver; a file's order is the order of its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflux.functions.text import normalize_kernel
from folioflux.operators.matching import Alias, ordered
from folioflux.operators.names import Lexicons

#: Rows of a catalog that come to the driver and travel with the page parser; larger ones go to alias_index.match_catalog
MOST_ROWS = 200_000


def _read(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    rows = spark.read.csv(path, header=True, multiLine=True, encoding="UTF-8")
    rows = rows.toDF(*(c.lstrip("﻿").strip() for c in rows.columns))
    missing = [c for c in columns if c not in rows.columns]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)}")
    return rows.select(*(F.coalesce(F.trim(F.col(c)), F.lit("")).alias(c) for c in columns)).withColumn("rank", F.monotonically_increasing_id())


def _few(rows: DataFrame, path: str) -> list:
    held = rows.orderBy("rank").limit(MOST_ROWS + 1).collect()
    if len(held) > MOST_ROWS:
        raise ValueError(f"{path}: more than {MOST_ROWS} rows")
    return held


def read_centers(spark: SparkSession, path: str) -> DataFrame:
    """slug, name, rank; blank fields, repeated folders and an empty file are errors."""
    rows = _read(spark, path, ["carpeta", "centro"])
    held = _few(rows, path)
    if not held:
        raise ValueError(f"{path}: empty catalog")
    if any(not r["carpeta"] or not r["centro"] for r in held):
        raise ValueError(f"{path}: blank folder or center")
    slugs = [r["carpeta"] for r in held]
    again = sorted({s for s in slugs if slugs.count(s) > 1})
    if again:
        raise ValueError(f"{path}: repeated folder {', '.join(again)}")
    return rows.select(F.col("carpeta").alias("slug"), F.col("centro").alias("name"), "rank")


def one_center(spark: SparkSession, slug: str, name: str) -> DataFrame:
    return spark.createDataFrame([(slug, name, 0)], "slug string, name string, rank long")


def read_specialties(spark: SparkSession, path: str) -> list[Alias]:
    rows = _few(_read(spark, path, ["alias", "especialidad", "area"]), path)
    return ordered([Alias(a, r["especialidad"], r["area"]) for r in rows if (a := normalize_kernel(r["alias"])) and r["especialidad"]])


def read_places(spark: SparkSession, path: str | None) -> list[Alias]:
    """No path or no file: no places."""
    if not path or not _exists(spark, path):
        return []
    rows = _few(_read(spark, path, ["alias", "lugar"]), path)
    return ordered([Alias(a, r["lugar"]) for r in rows if (a := normalize_kernel(r["alias"])) and r["lugar"]])


def _terms(spark: SparkSession, path: str) -> dict[str, float]:
    """Weights clamped to 0..1, 1 where there is none; of a repeated term the last row counts."""
    rows = _few(_read(spark, path, ["termino", "peso"]), path)
    out = {t: max(0.0, min(1.0, float(r["peso"] or 1.0))) for r in rows if (t := normalize_kernel(r["termino"]))}
    if not out:
        raise ValueError(f"{path}: empty catalog")
    return out


def read_lexicons(spark: SparkSession, given: str, surnames: str) -> Lexicons:
    return Lexicons(_terms(spark, given), _terms(spark, surnames))


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
