"""A training corpus from raw documents: language ID, near-duplicates, decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns
of documents. run() writes every stage's rows to the shared folder and reads them back for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflux.llm.containment import without_contained
from folioflux.llm.language_id import FIELDS, free_names, languages_of_documents
from folioflux.llm.lsh_forest import decisions, text_digest
from folioflux.llm.shared import bounded, written
from folioflux.llm.transducer import encode_decode

#: So many ids and text digests of dropped rows are broadcast at most (about 100 MB); beyond it, the join is shuffled.
BROADCAST_IDS = 1_000_000


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; the declared language and the source are evidence."""
    found = languages_of_documents(docs)
    rejected = free_names(FIELDS, docs.columns)[FIELDS.index("rejected")]
    return found.where(~F.col(rejected)).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest id that is not null, then the smallest text digest.

    Rows that share an id are judged each by its own text; of rows that repeat an id and a text one stays. Rows without
    words are nobody's duplicates and stay. Only ids and digests are compared; texts are not shuffled, but for rows that
    repeat an id and a text.
    """
    found = written(decisions(docs), "decisions")
    key, digest = free_names(("dropped_id", "dropped_digest"), docs.columns)
    pairs = lambda rows: bounded(written(rows.select(F.col("doc_id").alias(key), F.col("digest").alias(digest)), "keys"), BROADCAST_IDS)
    same = docs["doc_id"].eqNullSafe(F.col(key)) & (text_digest("text") == F.col(digest))
    dropped = pairs(found.where(~F.col("chosen")).select("doc_id", "digest").distinct())
    repeated = pairs(found.where("chosen and n_shingles > 0").groupBy("doc_id", "digest").agg(F.count("*").alias("n")).where("n > 1"))
    kept = docs.join(dropped, same, "left_anti")
    once = kept.join(repeated, same, "left_semi").withColumn(digest, text_digest("text")).dropDuplicates(["doc_id", digest])
    return kept.join(repeated, same, "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_contained(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of each document."""
    return encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_stage), ("near_dedup", near_duplicate_stage), ("decontamination", decontamination_stage), ("bpe", bpe_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
