"""A stream of recognised pages: the stateless stages run as pages arrive; people are resolved by batch over what the
stream has appended, as later records may change earlier people."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflux.functions.schemas import LINES
from folioflux.plans.pages import Catalogs, parse_pages

PAGE = f"image_id string, path string, center_name string, lines array<struct<{', '.join(c.replace(' ', ':', 1) for c in LINES.removeprefix('image_id string, ').split(', '))}>>"


def read_pages(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Pages as JSON lines, one page a line, as files arrive in a folder."""
    return spark.readStream.schema(PAGE).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def parse_batch(pages: DataFrame, catalogs: Catalogs) -> DataFrame:
    """Records of a batch of pages."""
    lines = pages.select("image_id", F.explode("lines").alias("l")).select("image_id", "l.*")
    return parse_pages(lines, catalogs, pages.select("image_id", "path", "center_name"))


def write_records(pages: DataFrame, catalogs: Catalogs, folder: str, checkpoint: str):
    """Start a query that appends each batch's records; a batch that is run again replaces its own folder."""

    def batch(rows: DataFrame, number: int) -> None:
        parse_batch(rows, catalogs).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
