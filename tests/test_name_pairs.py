import random

import pytest
from pyspark.sql import functions as F

from folioflux.functions.similarity import ratio
from folioflux.operators.name_pairs import needed, similar_candidates

GIVEN = ["maria", "jose", "luis", "carmen", "ana", "pedro", "juana", "miguel", "rosa", "elena"]
SURNAMES = ["perez", "gonzalez", "rodriguez", "garcia", "hernandez", "martinez", "lopez", "diaz", "rojas", "salas"]


def names(rng, n):
    """Names of which about half are another one with a letter more, less or changed."""
    out: list[str] = []
    while len(out) < n:
        t = rng.choice(out) if out and rng.random() < 0.5 else f"{rng.choice(GIVEN)} {rng.choice(GIVEN)} {rng.choice(SURNAMES)} {rng.choice(SURNAMES)}"
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(t))
            t = t[:k] + rng.choice(["", rng.choice("aeiouz")]) + t[k + rng.randrange(2) :]
        t = " ".join(t.split())
        out += [t] if t not in out else []
    return out


@pytest.mark.parametrize("least,cell", [(0.92, 1000), (0.92, 3), (0.8, 5), (1.0, 5)])
def test_no_similar_names_are_lost(spark, least, cell):
    rng = random.Random(2)
    rows = [(k % 2, t, k) for k, t in enumerate(names(rng, 250) + ["", "a", "ab", "aa", "aaa" * 20, "aaa" * 20 + "b"])]
    df = spark.createDataFrame(rows + [(None, "maria perez", 999), (None, "maria perex", 998)], "block int, t string, k int")
    found = [(r.t_a, r.t_b) for r in similar_candidates(df, ["block"], "t", least, F.col("k_a") < F.col("k_b"), cell).collect()]
    assert len(found) == len(set(found))
    want = {(t, u) for b, t, k in rows for c, u, m in rows if b == c and k < m and t != u and ratio(t, u) >= least}
    assert want <= set(found)
    if least == 0.92:
        assert want and len(found) < 250 * 125 / 2 / 8


def test_needed_pairs_are_a_lower_bound():
    rng = random.Random(3)
    held = names(rng, 150)
    for a in held:
        for b in held:
            if ratio(a, b) >= 0.92:
                left = [b[k : k + 2] for k in range(len(b) - 1)]
                shared = sum(1 for p in (a[k : k + 2] for k in range(len(a) - 1)) if p in left and not left.remove(p))
                assert shared >= needed(len(a), 0.92)
