"""Token ids as length-delimited binary records with masked checksums and a separate offset index.

A shard `shard-NNNNN.rec` is a run of frames: u64 payload length, u32 masked CRC-32 of those 8 bytes, payload,
u32 masked CRC-32 of the payload (all little-endian). A payload is i64 id, u32 number of ids, u8 flags (bit 0: the
id is null, bit 1: zstd), u8 bytes an id (2 or 4), then the ids. `shard-NNNNN.idx` holds i64 id, u64 frame offset,
u64 frame length for each record, so that any record can be read alone.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflux.llm.kernels import arrow_rows
from folioflux.llm.shared import filesystem, new_folder, small_arrow_batches
from folioflux.llm.tokenizing import piece_encoder

_HEAD = "<qIBB"
_INDEX = "<qQQ"
_MASK = 0xA282EAD8
MANIFEST = "shard int, path string, records long, ids long"


def masked(data: bytes) -> int:
    """CRC-32 rotated right by 15 bits plus a constant, so that a checksum of checksums stays sound."""
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + _MASK) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray, squeeze=None) -> bytes:
    width = 2 if not len(ids) or ids.max() < 65536 else 4
    raw = ids.astype(f"<u{width}").tobytes()
    small = squeeze(raw) if squeeze and len(raw) >= 64 else raw
    flags = (doc_id is None) + 2 * (small is not raw)
    payload = struct.pack(_HEAD, doc_id or 0, len(ids), flags, width) + small
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def unframe(data: bytes, at: int = 0) -> tuple[int | None, np.ndarray, int]:
    """Id, token ids and the next frame's offset; ValueError where a checksum or a length is wrong."""
    if len(data) < at + 12:
        raise ValueError(f"record at {at}: cut off")
    size, check = data[at : at + 8], struct.unpack_from("<I", data, at + 8)[0]
    if masked(size) != check:
        raise ValueError(f"record at {at}: wrong checksum of its length")
    n = struct.unpack("<Q", size)[0]
    payload = data[at + 12 : at + 12 + n]
    if len(data) < at + 16 + n or masked(payload) != struct.unpack_from("<I", data, at + 12 + n)[0]:
        raise ValueError(f"record at {at}: wrong checksum of its payload")
    doc_id, count, flags, width = struct.unpack_from(_HEAD, payload)
    body = payload[struct.calcsize(_HEAD) :]
    if flags & 2:
        import zstandard

        body = zstandard.ZstdDecompressor().decompress(body, max_output_size=count * width)
    return (None if flags & 1 else doc_id), np.frombuffer(body, f"<u{width}", count).astype("<u4"), at + 16 + n


def write_records(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = 0, shard_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text (null: empty), append end_id, and write records in ascending id order; returns the manifest.

    Ranges of ids, and of text hashes inside an id that very many rows share, come from Spark's range partitioning, as
    many as shards of shard_bytes of text need; one shuffle brings each range together, and each task streams its sorted
    rows into a shard: a text at a time is in memory. A shard gets its final name by a rename, so retried and
    speculative tasks leave whole files. Rows with equal ids are ordered by a hash of their text; null ids come first;
    an empty table gives an empty manifest; other columns are not read.
    """
    spark = docs.sparkSession
    small_arrow_batches(spark)
    folder = folder or new_folder(spark, "records")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    keyed = rows.withColumn("h", F.xxhash64("text"))
    ranged = keyed.repartitionByRange(max(1, -(-size // shard_bytes)), "id", "h").sortWithinPartitions("id", "h").select("id", "text")

    def write(batches):
        import zstandard
        from pyspark import TaskContext

        squeeze = zstandard.ZstdCompressor(level=1).compress
        encoder = piece_encoder(tokenizer_path)
        files, base = filesystem(folder)
        files.create_dir(base, recursive=True)
        end = np.array([end_id], np.uint32)
        shard, temp = TaskContext.get().partitionId(), f"{base}/_{uuid.uuid4().hex}"
        out, index, records, ids, offset = None, bytearray(), 0, 0, 0
        for part in (p for batch in batches for p in arrow_rows(batch)):
            for doc, raw in zip(part.column(0).to_pylist(), encoder.ids_of(part.column(1).to_pylist())):
                out = out or files.open_output_stream(f"{temp}.rec", buffer_size=1 << 20)
                values = np.append(raw, end)
                record = frame(doc, values, squeeze)
                out.write(record)
                index += struct.pack(_INDEX, doc or 0, offset, len(record))
                offset += len(record)
                records += 1
                ids += len(values)
        if out is None:
            return
        out.close()
        with files.open_output_stream(f"{temp}.idx") as f:
            f.write(bytes(index))
        names = [f"{base}/shard-{shard:05d}.{x}" for x in ("idx", "rec")]
        for a, b in zip((f"{temp}.idx", f"{temp}.rec"), names):
            files.move(a, b)
        yield pa.RecordBatch.from_pylist([{"shard": shard, "path": names[1], "records": records, "ids": ids}], pa.schema([("shard", pa.int32()), ("path", pa.string()), ("records", pa.int64()), ("ids", pa.int64())]))

    manifest = ranged.mapInArrow(write, MANIFEST)
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_at(path: str, number: int) -> tuple[int | None, np.ndarray]:
    """The record of that number in a shard, through its index."""
    files, base = filesystem(path)
    with files.open_input_file(base.removesuffix(".rec") + ".idx") as f:
        f.seek(number * struct.calcsize(_INDEX))
        _, offset, size = struct.unpack(_INDEX, f.read(struct.calcsize(_INDEX)))
    with files.open_input_file(base) as f:
        f.seek(offset)
        return unframe(f.read(size))[:2]


def read_records(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Rows id, start (ids of all records before it), n_tokens, ids_crc32 and ids as they stand in the files.

    Only the manifest's shard lengths (one row a shard) come to the driver; files are read a block at a time.
    """
    held = sorted(manifest.collect(), key=lambda r: r["shard"])
    starts, total = [], 0
    for r in held:
        starts.append((r["shard"], r["path"], total))
        total += r["ids"]
    if not held:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
    shards = spark.createDataFrame(starts, "shard int, path string, start long").repartition(len(starts), "shard")

    def read(batches):
        for batch in batches:
            for path, start in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                files, base = filesystem(path)
                with files.open_input_file(base.removesuffix(".rec") + ".idx") as f:
                    index = np.frombuffer(f.read(), np.dtype([("id", "<i8"), ("at", "<u8"), ("n", "<u8")]))
                ends = [int(x) for x in index["at"] + index["n"]]
                with files.open_input_file(base) as f:
                    k = 0
                    while k < len(ends):
                        first = int(index["at"][k])
                        stop = max(k + 1, bisect_right(ends, first + (4 << 20)))
                        block, rows = f.read(ends[stop - 1] - first), []
                        for at in index["at"][k:stop]:
                            doc, ids, _ = unframe(block, int(at) - first)
                            raw = ids.tobytes()
                            rows.append((doc, start, len(ids), zlib.crc32(raw), raw))
                            start += len(ids)
                        k = stop
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return shards.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
