"""The folder that driver and executors share, and small tables kept in it."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT = "spark.checkpoint.dir"
#: Rows of a few numbers (about 32 bytes) that are broadcast at most; larger tables are joined by shuffle.
BROADCAST_ROWS = 500_000
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_UNITS = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one is made only where the session names none and runs on one machine."""
    held = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
    named = spark.conf.get(CHECKPOINT, None) or spark.sparkContext.getConf().get(CHECKPOINT) or held
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError(f"{CHECKPOINT} must name a folder that driver and executors share")
        named = "file://" + os.path.join(tempfile.gettempdir(), "folioflux-shared")
        spark.conf.set(CHECKPOINT, named)
    return named.rstrip("/")


#: Folders made inside each open `scratch` block
_scopes: list[list[str]] = []


def new_folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/folioflux/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables and files that operators of this subpackage write inside the block are removed after it.

    Results are lazy and read these tables, so they are written or collected inside the block.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting while the block runs; what it was before after it."""
    held = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if held is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, held)


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: it cuts the lineage and survives a lost executor.

    The write's shuffle files go as soon as it is done: nothing reads them again.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    with setting(spark, _CLEAN_UP, "true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept(rows: DataFrame, make, schema: str, name: str) -> DataFrame:
    """rows.mapInArrow(make, schema), written to the shared folder by the Python workers themselves and read back.

    Like `written`, for packed rows: they do not pass the JVM's Parquet writer, and each batch is a row group of its own.
    Without its native library Hadoop starts a process (chmod) for every local file it makes, and while that starts it
    counts as a second executor JVM of the same size; files made here start none. A task's file gets its place when the
    job is done, by the name that the task returned, so tasks that failed or ran twice leave no rows. A folder that
    pyarrow has no file system for is written by Spark.
    """
    import pyarrow as pa

    spark = rows.sparkSession
    folder = new_folder(spark, name)
    try:
        files, base = filesystem(folder)
    except (pa.ArrowException, OSError):
        return written(rows.mapInArrow(make, schema), name)
    files.create_dir(f"{base}/_tasks", recursive=True)

    def put(batches):
        import pyarrow.parquet as pq

        own, out, path = filesystem(folder)[0], None, f"{base}/_tasks/{uuid.uuid4().hex}.parquet"
        for batch in make(batches):
            if out is None:
                ranked = [f.name for f in batch.schema if pa.types.is_integer(f.type)]
                out = pq.ParquetWriter(path, batch.schema, filesystem=own, compression="none", use_dictionary=False, write_statistics=ranked)
            out.write_table(pa.Table.from_batches([batch]))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path]})

    with setting(spark, _CLEAN_UP, "true"):
        made = [r["path"] for r in rows.mapInArrow(put, "path string").collect()]
    for path in made:
        files.move(path, f"{base}/{path.rsplit('/', 1)[1]}")
    return spark.read.schema(schema).parquet(folder)


def bounded(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most `most` rows, else df itself; for written tables of a few numbers a row."""
    return F.broadcast(df) if df.count() <= most else df


def filesystem(uri: str):
    """pyarrow filesystem and path of a shared folder's address."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def small_arrow_batches(spark: SparkSession, most: int = 2 << 20):
    """Arrow batches of about 2 MB at most, as texts and packed rows may be long; a smaller setting stays.

    The setting holds from the call on, as plans that are returned run later; as a context it ends with the block.
    """
    held = spark.conf.get(_ARROW_BYTES).strip().lower()
    digits = held.rstrip("bkmg")
    size = int(digits) * _UNITS[held[len(digits) :]]
    small = size if 0 < size <= most else most
    spark.conf.set(_ARROW_BYTES, str(small))

    @contextlib.contextmanager
    def block():
        try:
            yield
        finally:
            if size > 0:
                spark.conf.set(_ARROW_BYTES, str(size))
            else:  # no bound was set; Spark takes none as a value
                spark.conf.unset(_ARROW_BYTES)

    return block()
