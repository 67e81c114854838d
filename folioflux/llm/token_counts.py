"""Token counts: batch encoding in an Arrow function that returns lengths only."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflux.llm.shared import small_arrow_batches
from folioflux.llm.tokenizing import piece_encoder


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512, batch_bytes: int = 1 << 20, piece_chars: int = 1 << 15, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit (more than `limit` tokens).

    tokenizer_path is a .json of the tokenizers library or a .model of sentencepiece. Where the file's pattern is the
    byte-level one, texts are cut at safe boundaries into pieces of about piece_chars; other files get whole texts. The
    pieces of several texts are encoded in batches of about batch_bytes (each distinct pre-token once a worker), and
    only lengths leave the function; memory is bounded by a batch, the worker's table and the longest stretch without a
    safe boundary (other files: the longest text). Null and empty texts count 0; repeated rows and ids give a row each;
    an empty table gives none; other columns are not read. Special strings in texts are treated as the library's
    default does; no special tokens are added.
    """
    small_arrow_batches(docs.sparkSession)

    def lengths(batches):
        encoder = piece_encoder(tokenizer_path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts, owners, queue, size = [0] * len(texts), [], [], 0

            def flush():
                for i, ids in zip(owners, encoder.ids_of(queue)):
                    counts[i] += len(ids)
                owners.clear()
                queue.clear()

            for i, text in enumerate(texts):
                for piece in encoder.pieces(text, piece_chars):
                    owners.append(i)
                    queue.append(piece)
                    size += len(piece)
                    if size >= batch_bytes:
                        flush()
                        size = 0
            flush()
            bytes_ = pa.array([len(t.encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), bytes_, pa.array(counts, pa.int64()), pa.array([c > limit for c in counts])], ["id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lengths, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
