import random

import pytest
from pyspark.sql import functions as F

from folioflux.operators.select import with_ordinal


@pytest.mark.parametrize("first", ["one", "few", "text", "null"])
def test_positions_are_those_of_a_full_sort(spark, first):
    rng = random.Random(6)
    value = {"one": lambda i: 7, "few": lambda i: i % 3, "text": lambda i: rng.choice(["", "a", "ab", "é", "same long beginning x", "same long beginning y"]), "null": lambda i: None}[first]
    rows = [(value(i), i) for i in range(2000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, f"v {'string' if first == 'text' else 'int'}, k int").repartition(5)
    out = with_ordinal(df, ["v", "k"], "n", bucket_rows=100)
    got = sorted((r.n, r.v, r.k) for r in out.collect()) if first != "null" else sorted((r.n, r.k) for r in out.collect())
    want = sorted(rows, key=lambda r: ((r[0] or "").encode() if first == "text" else r[0] or 0, r[1]))
    assert got == [(n, *(r if first != "null" else r[1:])) for n, r in enumerate(want)]
    assert with_ordinal(df.limit(0), ["v", "k"]).count() == 0


def test_no_range_is_large_for_a_column_with_one_value(spark):
    """Ranges are cut by all columns: none holds more than a few times its share."""
    df = spark.range(20_000, numPartitions=4).select(F.lit(1).alias("v"), F.col("id").alias("k"))
    parts = df.repartitionByRange(20, "v", "k").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) == 20 and max(r["count"] for r in parts) < 3000
    assert with_ordinal(df, ["v", "k"], "n", bucket_rows=1000).where("n <> k").count() == 0
