import random
import re
import time

import numpy as np

from folioflux.llm import lsh_forest
from folioflux.llm.components import components
from folioflux.llm.lsh_forest import near_duplicates


def brute(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            x, y = sets[i], sets[j]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                up[root(i)] = root(j)
    out = {}
    for i, (d, _) in enumerate(rows):
        comp = d if not sets[i] else min(rows[k][0] for k in range(len(rows)) if root(k) == root(i))
        out[d] = (len(sets[i]), comp, comp == d)
    return out


def corpus(n_groups, size, seed):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(3000)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for g in range(n_groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(30, 120))]
        if g % 3 == 0:
            base += passage
        for _ in range(rng.randrange(1, size)):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
            if rng.random() < 0.3:
                base = w  # chains
    return texts


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lsh_forest, "BLOCK", 16)
    texts = corpus(40, 12, 3) + [None, "", "  \n", "one two", "One  TWO", "one two three", "a b c d e", "a b c d e", "x " * 5000, "x " * 6000, "漢 字 é è ê", "漢 字 é è ê"]
    random.Random(1).shuffle(texts)
    rows = [(10 * i + 3, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(d, t, 1.0, "z") for d, t in rows], "doc_id long, text string, n_shingles double, node string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect()}
    assert got == brute(rows)


def test_one_large_group(spark):
    rng = random.Random(9)
    base = ["w%d" % rng.randrange(10**6) for _ in range(100)]
    rows = []
    for i in range(600):
        w = list(base)
        w[rng.randrange(100)] = "v%d" % i
        rows.append((i, " ".join(w)))
    rows += [(600 + i, " ".join("u%d" % rng.randrange(10**6) for _ in range(50))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(df).collect()}
    assert got == {i: 0 if i < 600 else i for i in range(800)}


def test_empty_repeated_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None), (1, "q r s t u v")]
    got = sorted((str(r.doc_id), r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, schema)).collect())
    assert got == [("1", 1, True)] * 3 + [("2", 2, True), ("None", 1, False)]


def test_null_ids_link_their_class_to_near_copies(spark):
    base = ["w%d" % i for i in range(60)]
    near = lambda k: " ".join(["v%d" % k if i == k else w for i, w in enumerate(base)])
    other = ["u%d" % i for i in range(60)]
    close = lambda k: " ".join(["x%d" % k if i == k else w for i, w in enumerate(other)])
    rows = [(5, near(0)), (None, near(0)), (2, near(0)), (1, near(59)), (None, close(0)), (None, close(0)), (8, close(59)), (9, "alone a b c d e f")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    found = sorted(((str(r.doc_id), r.component_id, r.kept) for r in got), key=str)
    assert found == [("1", 1, True), ("2", 1, False), ("5", 1, False), ("8", 8, True), ("9", 9, True), ("None", 1, False), ("None", 8, False), ("None", 8, False)]


def test_prefixes_of_sorted_rows():
    rng = np.random.default_rng(4)
    run = np.sort(rng.integers(0, 4, 60))
    sig = rng.integers(0, 2, (60, lsh_forest.WIDTH), dtype=np.uint8)
    sig[10] = sig[11]
    order = np.lexsort([*sig.T[::-1], run])
    run, sig = run[order], sig[order]
    got = lsh_forest.prefixes(run, sig, 5)

    def common(i, j):
        if not 0 <= j < 60 or run[i] != run[j]:
            return 0
        equal = sig[i] == sig[j]
        return lsh_forest.WIDTH if equal.all() else int(equal.argmin())

    assert got.tolist() == [[common(i, i + off) for off in (*range(-5, 0), *range(1, 6))] for i in range(60)]


def test_components_against_union_find(spark):
    rng = random.Random(8)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 5000 - i) for i in range(1, 60)] + [(7, 7)]
    up = {x: x for p in pairs for x in p}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[max(root(a), root(b))] = min(root(a), root(b))
    want = {x: root(x) for a, b in pairs if a != b for x in (a, b)}
    got = {r.node: r.comp for r in components(spark.createDataFrame([(min(p), max(p)) for p in pairs], "a long, b long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_region_far_over_a_block(spark, monkeypatch):
    """Texts that share half their words meet in crowded regions; what the forest misses is found block by block."""
    monkeypatch.setattr(lsh_forest, "BLOCK", 8)
    rng = random.Random(21)
    shared = ["s%d" % i for i in range(70)]
    rows = []
    for g in range(60):
        own = ["g%d_%d" % (g, i) for i in range(35)]
        for k in range(rng.randrange(1, 5)):
            words = shared + own
            for _ in range(k % 3):
                words[rng.randrange(len(words))] = "c%d_%d" % (g, k)
            rows.append((7 * len(rows), " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_large_components_do_not_meet_in_one_task(spark, monkeypatch):
    texts = corpus(12, 6, 9) + ["the very same text in forty rows"] * 40 + [None, "", "alone here", "also all alone here"]
    df = spark.createDataFrame([(None if i % 17 == 3 else i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    rows = lambda: sorted(map(tuple, lsh_forest.decisions(df).collect()), key=str)
    want = rows()
    real = lsh_forest._with_firsts
    monkeypatch.setattr(lsh_forest, "_with_firsts", lambda *a: real(*a, most=4))
    assert rows() == want
    assert len(want) == len(texts)


def test_many_texts_under_one_id_and_clashing_columns(spark):
    """Texts are found by id and digest: an id that all rows share costs what ids of their own cost."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefghijklmnop") + str(rng.randrange(300)) for _ in range(30)) for _ in range(3000)]
    texts += [t + " more" for t in texts[:500]] + texts[:200]
    took = {}
    for name, ids in (("own", range(len(texts))), ("one", [7] * len(texts)), ("none", [None] * len(texts))):
        rows = [(i, t, "x", 1, "y", True) for i, t in zip(ids, texts)]
        df = spark.createDataFrame(rows, "doc_id long, text string, node string, comp int, digest string, chosen boolean").repartition(4)
        began = time.perf_counter()
        got = lsh_forest.decisions(df).collect()
        took[name] = time.perf_counter() - began
        chosen = {r.digest for r in got if r.chosen}
        assert len(got) == len(texts) and len(chosen) == 3000
        assert {r.component_id for r in got} == ({None} if name == "none" else {7} if name == "one" else set(range(3000)))
    assert max(took["one"], took["none"]) < 3 * took["own"] + 5
