import math
import random

import pytest

from folioflux.llm import top_k as T

SCHEMA = "vec_id long, embedding array<float>, rank int"


def brute(rows, k):
    import numpy as np

    whole = {}
    for i, v in rows:
        if i is not None and v is not None and None not in v and all(map(math.isfinite, v)):
            whole[i] = [math.floor(1024 * float(np.float32(x))) for x in v]
    out = set()
    for q in whole:
        if q % 100 == 0:
            s = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))
            out |= {(q, r + 1, i, -x) for r, (x, i) in enumerate(s[:k])}
    return out


@pytest.mark.parametrize("blocks", [(3, 40), (1024, 4096)])
def test_against_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(T, "QUERY_ROWS", blocks[0])
    monkeypatch.setattr(T, "ROWS", blocks[1])
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 30) for _ in range(8)]) for i in range(700)]
    rows += [(i, [0.5] * 8) for i in range(700, 900)]  # ties
    rows += [(1000, None), (1100, [1.0] * 7 + [None]), (1200, [1.0] * 7 + [float("nan")]), (1300, [float("inf")] * 8), (None, [1.0] * 8), (1400, [0.0] * 8), (1500, [1.0, 2.0]), (1501, [3.0, 1.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).repartition(5)
    got = {tuple(r) for r in T.top_k(df, df.where("vec_id % 100 = 0")).collect()}
    assert got == brute(rows, 10)


def test_few_and_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert T.top_k(empty, empty).count() == 0
    df = spark.createDataFrame([(0, [1.0], 1), (3, [2.0], 1), (2, [2.0], 1)], SCHEMA)
    assert sorted(map(tuple, T.top_k(df, df.where("vec_id = 0")).collect())) == [(0, 1, 2, 2048 * 1024), (0, 2, 3, 2048 * 1024)]
