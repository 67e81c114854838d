import random
import re
from itertools import permutations

from pyspark.sql import functions as F

from folioflux.llm import filter_audit as A

DOCS, LABELS = "doc_id long, text string, source string, word string, key string, part int", "doc_id long, quality int, toxic int, good string"


def brute(docs, labels):
    """The rows of audit by going through every order, row by row."""
    good, toxic = ({d for d, *v in labels if d is not None and v[at] == 1} for at in (0, 1))
    first: dict = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    fails, parts = [], {}
    for d, t, s in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tests = len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), any(c in "#$%&*|" for c in t), d is not None and d > first[t]
        fails.append({x for x, failed in zip("ABCDE", tests) if failed})
        parts.setdefault(s or "", []).append(len(fails) - 1)
    out = {}
    for part, rows in parts.items():
        total = dict.fromkeys("ABCDE", 0)
        own = {}
        for p in permutations("ABCDE"):
            left = rows
            for k, x in enumerate(p):
                gone = [i for i in left if x in fails[i]]
                redundant = sum(x in fails[i] for i in rows) - len(gone)
                left = [i for i in left if x not in fails[i]]
                total[x] += len(gone)
                own["".join(p), k + 1] = [len(left), len(gone), redundant, sum(fails[i] == {x} for i in rows), sum(docs[i][0] in good for i in gone), sum(docs[i][0] in toxic for i in gone)]
        out |= {(part, o, k): (*v, total[o[k - 1]]) for (o, k), v in own.items()}
    return out


def got(spark, docs, labels, cols=()):
    rows = A.audit(spark.createDataFrame([(*d, "w", "k", 1) for d in docs], DOCS).repartition(3), spark.createDataFrame([(*x, "g") for x in labels], LABELS)).collect()
    out = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(out) == len(rows)
    return out


def test_every_order_against_brute_force(spark):
    rng = random.Random(4)
    words = ["a", "B", "cc", "été", "D#", "e\x0bf", " ", "ÀB", "x" * 30, "$"]
    texts = [None, "", "  \t\n", "# " * 60, "A" * 80, "word " * 49, "word " * 50, " ".join(f"w{k}" for k in range(50)), "é" * 95 + "AAAAA", "é" * 94 + "AAAAAA"]
    texts += [" ".join(f"{rng.choice(words[:k])}{rng.randrange(m)}" for _ in range(rng.choice([10, 49, 50, 51, 80, 120]))) for k in (2, 3, 4, 5, 10) for m in (3, 20, 40, 60, 90)]
    texts += [" ".join(["w"] * (n - d) + [f"v{k}" for k in range(d)]) for n, d in ((100, 63), (100, 64), (100, 65), (60, 38), (60, 39))]
    docs = [(i, t, rng.choice([None, "", "s1", "s2"])) for i, t in enumerate(texts * 2)]
    docs += [docs[3], docs[3], docs[60], (None, texts[8], "s1"), (None, texts[8], "s1"), (None, "only without id", "s3"), (None, "only without id", "s3"), (5, "another text of one id", "s1"), (70, texts[12], "s2")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(60)] + [(2, 1, 0), (2, 0, 1), (None, 1, 1), (999, 1, 1)]
    assert got(spark, docs, labels) == brute(docs, labels)
    assert got(spark, docs, []) == brute(docs, [])
    assert got(spark, [], labels) == {}


def test_a_hot_text_and_a_very_long_one(spark):
    long = " ".join(f"w{k % 7000}" for k in range(200_000))
    docs = [(i, "same words of one text " * 12, "hot") for i in range(3000)] + [(9000 + i, long, "long") for i in range(2)] + [(9500, "x" * 1_000_000, None)]
    labels = [(i, i % 2, 1 - i % 2) for i in range(0, 9600, 5)]
    assert got(spark, docs, labels) == brute(docs, labels)


def test_texts_are_the_only_shuffle_of_word_counts(spark):
    rows = spark.range(400, numPartitions=2).select(F.lit("r").alias("row"), F.lit("one two two three").alias("text")).union(spark.createDataFrame([("e", " "), ("f", "")], "row string, text string"))
    counts = A.word_counts(rows, partition_bytes=500)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and ", 14), REPARTITION_BY_NUM" in plan  # 6801 bytes by 500
    assert sorted(map(tuple, counts.collect())) == [("e", 1, 0, 0), ("f", 1, 0, 0), ("r", 400, 1600, 3)]
