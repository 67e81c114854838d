"""Every query on the driver's smallest tables against its SQL."""

import random
from difflib import SequenceMatcher

import duckdb
import pytest

from folioflux.plans.table_queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    return round(x, 6) if isinstance(x, float) else x


@pytest.fixture(scope="module")
def duck():
    made = duckdb.connect()
    for t in TABLES:
        made.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return made


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    assert len(set(df.columns)) == len(df.columns)
    if name in ORACLES:
        found = duck.execute(ORACLES[name])
        names = [x[0] for x in found.description]
        assert sorted(names) == columns
        assert got == sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in found.fetchall())


def test_alignment_reads_whole_texts(spark, tmp_path):
    """Turns that share their first 60 characters and differ after them are neither equal nor correct."""
    opening = "the same opening of more than sixty characters stands here, "
    turns = [(1, 0, "user", opening + "aaaa bbbb cccc dddd"), (1, 1, "assistant", opening + "wwww xxxx yyyy zzzz"), (2, 0, "user", opening + "end"), (2, 1, "assistant", opening + "end")]
    assert len(opening) == 60
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    aligned = {r.stem: r.similarity for r in QUERIES["e_align"](spark, str(tmp_path)).collect()}
    assert aligned["2"] > aligned["1"]
    names = next(r for r in QUERIES["e_report"](spark, str(tmp_path)).collect() if r.field == "nombre_completo")
    assert (names.total, names.correctos) == (2, 1)


def test_similar_pairs_against_brute_force(spark, tmp_path):
    rng = random.Random(5)
    words = "almond azure blush coral cream forest ghost honey ivory khaki lemon maroon".split()
    rows = []
    for i in range(240):
        name = " ".join(rng.sample(words, 3)) if i % 3 == 0 else rows[-1][1]
        at = rng.randrange(len(name))
        name = name[:at] + rng.choice(["", "z", "zz"]) + name[at:] if i % 3 == 2 else name
        rows.append((i, name if i % 40 else "short", "brand%d" % (i // 3 % 2), "type", i // 3 % 5, 900.0))
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    want = set()
    for a in rows:
        for b in rows:
            if a[0] < b[0] and (a[2], a[4]) == (b[2], b[4]) and min(len(a[1]), len(b[1])) >= 8 and SequenceMatcher(None, a[1], b[1]).ratio() >= 0.92:
                want.add((a[0], b[0], a[2], a[4]))
    found = QUERIES["d_similar_pairs"](spark, str(tmp_path)).collect()
    assert {(r.a, r.b, r.center, r.age) for r in found} == want and len(found) == len(want)
    assert 20 < sum(not r.reason.startswith("nombre 100%") for r in found)


def test_possible_pairs_against_their_rule(spark):
    """People with documents, missing ages, sexes, origins and misread names: the joins give what the rule for one pair does."""
    from folioflux.operators import names as N
    from folioflux.operators import resolve as R

    rng = random.Random(7)
    lexicons = N.Lexicons({"maria": 1.0, "juan": 1.0, "luisa": 0.9}, {"perez": 1.0, "gonzalez": 1.0, "rodriguez": 0.9})
    names = ["María Pérez", "Maria Perez", "Maria Perezz", "Moria Perez", "luisa gonzalez", "Luisa Gonzales", "Juan Rodriguez Gil", "Iuan Rodriguez Gil", "Ana G", None, ""]
    fields = ["patient_id", "first", "center", "full_name", "document_id", "age", "age_unit", "sex", "origin"]
    rows = []
    for i in range(160):
        age = rng.choice([8, 8, 9, None])
        rows.append((f"P{i}", i, rng.choice(["A", "A", "B"]), rng.choice(names), rng.choice(["", "", None, "V-123456", "123.456", "77"]), age, "años" if age else "", rng.choice(["F", "M", ""]), rng.choice(["Petare", "PETARE", "Caribe", "", None])))
    rng.shuffle(rows)
    people = spark.createDataFrame(rows, "patient_id string, first long, center string, full_name string, document_id string, age int, age_unit string, sex string, origin string")
    plain = sorted((dict(zip(fields, r)) | {"document_id": r[4] or ""} for r in rows if r[3] is not None), key=lambda r: r["first"])
    for known in (None, lexicons):
        splitter = N.Splitter(known) if known else None
        want = [(a["patient_id"], b["patient_id"], w) for i, a in enumerate(plain) for b in plain[i + 1 :] if (w := R.pair_reason(a, b, splitter))]
        found = R.possible_pairs(people, known, keep=("age",)).collect()
        assert sorted((r.patient_id, r.other_id, r.reason) for r in found) == sorted(want)
        age = {r[0]: r[5] for r in rows}
        assert all((r.age_a, r.age_b) == (age[r.patient_id], age[r.other_id]) for r in found)
        assert len({r.reason for r in found}) >= 5


def test_pairs_of_one_name_need_no_python(spark, tmp_path):
    """3,000 people of one name in one block: 4.5 million pairs, one name compared; Python sees names, not pairs."""
    spark.range(3000).selectExpr("id as p_partkey", "'almond azure' as p_name", "'b' as p_brand", "'t' as p_type", "1 as p_size", "1.0D as p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    for name in ("d_possible_pairs", "d_similar_pairs"):
        pairs = QUERIES[name](spark, str(tmp_path))
        assert "MapInPandas" not in pairs._jdf.queryExecution().optimizedPlan().toString()
        assert pairs.selectExpr("count(*)", "count_if(a < b)").first()[:] == (4_498_500, 4_498_500)
