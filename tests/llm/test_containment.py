import random
import re

from folioflux.llm.containment import find_contained, without_contained


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def data():
    rng = random.Random(2)
    word = lambda: "w%d" % rng.randrange(4000)
    items = [" ".join(word() for _ in range(rng.choice((2, 5, 9, 20, 38, 60, 130)))) for _ in range(60)] + [None, "", " \t", "One two"]
    docs = []
    for k in range(300):
        w = [word() for _ in range(rng.choice((3, 30, 400, 9000 if k % 50 == 0 else 90)))]
        if k % 2:
            own = rng.choice(items[:60]).split()
            if k % 3 == 0:
                own[rng.randrange(len(own))] = "changed"
            if k % 7 == 0:
                own = own[: int(len(own) * 0.8)]
            at = rng.randrange(len(w) + 1)
            w = w[:at] + own + w[at:]
        docs.append(" ".join(w))
    return docs + [None, "", "one TWO", "one two three"], items


def test_against_brute_force(spark):
    docs, items = data()
    d = spark.createDataFrame([(i, t, "k", 2) for i, t in enumerate(docs)], "doc_id long, text string, item_id string, n_item int").repartition(4)
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_matched, r.n_item) for r in find_contained(d, b).collect()}
    sets = [shingles(t) for t in items]
    want = {}
    for i, t in enumerate(docs):
        own = shingles(t)
        for j, s in enumerate(sets):
            if s and 100 * len(s & own) >= 75 * len(s):
                want[i, j] = (len(s & own), len(s))
    assert got == want and len(want) > 80
    kept = {r.doc_id for r in without_contained(d, b).collect()}
    assert kept == set(range(len(docs))) - {i for i, _ in want}
    assert without_contained(d, b).columns == d.columns


def test_blocks_and_empty_tables(spark, monkeypatch):
    from folioflux.llm import containment

    monkeypatch.setattr(containment, "BLOCK_BYTES", 4000)
    docs, items = data()
    d = spark.createDataFrame(list(enumerate(docs[:100])), "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    many = {tuple(r) for r in find_contained(d, b).collect()}
    monkeypatch.setattr(containment, "BLOCK_BYTES", 1 << 20)
    assert many == {tuple(r) for r in find_contained(d, b).collect()}
    assert find_contained(d.limit(0), b).count() == 0 and find_contained(d, b.limit(0)).count() == 0
    assert without_contained(d, b.limit(0)).count() == 100
