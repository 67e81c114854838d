import math
import random
import re
import shutil
import zlib
from collections import Counter

import numpy as np
import pytest

from folioflux.llm import shared, suffix_tree
from folioflux.llm.shared import kept


def brute(rows):
    toks = {d: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for d, t in rows}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows}
    c = Counter(w for d, ws in toks.items() if not held[d] for w in ws)
    n, v = sum(c.values()), len(c)
    return {d: (held[d], len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for d, ws in toks.items()}


def corpus(n):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        w, text = "a", []
        for _ in range(rng.randrange(5, 80)):
            w = {"a": "b", "b": rng.choice("cd"), "c": "a", "d": rng.choice(["a", "R%d" % rng.randrange(500)])}.get(w, "a")
            text.append(w)
        rows.append((i, " ".join(text)))
    return rows


@pytest.mark.parametrize("block", [500, 8 << 20])
def test_base_and_tree(spark, monkeypatch, block):
    monkeypatch.setattr(suffix_tree, "BLOCK_BYTES", block)
    rows = corpus(400) + [(400, None), (401, ""), (402, " A b\n"), (410, "x " * 3000), (419, "new words only")]
    df = spark.createDataFrame([(d, t, True) for d, t in rows], "doc_id long, text string, held boolean").repartition(4)
    got = {r.doc_id: r for r in suffix_tree.score(df).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    for d, (held, n, known, total, base) in want.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert r.score <= 0
    out = [r for r in got.values() if r.held_out and r.doc_id < 400]
    assert sum(r.score for r in out) > 0.6 * sum(r.base_score for r in out)  # held-out gain


def test_tree_is_a_distribution():
    import numpy as np

    root = np.array([0.4, 0.1, 0.3, 0.2])
    rng = np.random.default_rng(1)
    h = np.repeat(np.arange(4), 4)
    n = rng.integers(1, 500, 16)
    tree = suffix_tree.Tree(root, [(h, np.tile(np.arange(4), 4), n)])
    assert len(tree.states) == 4
    for x in range(4):
        p = root * 10 ** tree.gains(np.full(4, x), np.arange(4))
        assert math.isclose(p.sum(), 1)


def test_empty_and_untrained(spark):
    schema = "doc_id long, text string"
    assert suffix_tree.score(spark.createDataFrame([], schema)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = suffix_tree.score(spark.createDataFrame([(held, "a b")], schema)).collect()[0]
    assert (r.n_tokens, r.n_known, r.train_tokens, r.score) == (3, 0, 0, r.base_score)
    rows = [(None, "a b c"), (1, "a b"), (1, "a b")]
    assert suffix_tree.score(spark.createDataFrame(rows, schema)).count() == 3


def sequential(rows):
    """Scores by suffix_tree.Tree over all words as symbols, in one process."""
    import numpy as np

    toks = {d: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for d, t in rows}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows}
    c = Counter(w for d, ws in toks.items() if not held[d] for w in ws)
    number = {w: i for i, w in enumerate({w: 0 for ws in toks.values() for w in ws})}
    assert len(number) < 1 << suffix_tree.BITS
    root = np.array([c[w] + 0.1 for w in number]) / (sum(c.values()) + 0.1 * (len(c) + 1))
    end, bits, depth = number[None], suffix_tree.BITS, suffix_tree.DEPTH
    histories = {}
    for d, ws in toks.items():
        ids = [end] * depth + [number[w] for w in ws]
        histories[d] = np.array([[sum(ids[i - k] << bits * (k - 1) for k in range(1, depth + 1)), ids[i]] for i in range(depth, len(ids))])
    levels = []
    for k in range(1, depth + 1):
        grams = Counter((h & ((1 << bits * k) - 1), x) for d, hs in histories.items() if not held[d] for h, x in hs.tolist())
        totals = Counter()
        for (h, _), m in grams.items():
            totals[h] += m
        levels.append(tuple(np.array(x) for x in zip(*((h, x, m) for (h, x), m in grams.items() if totals[h] >= 2))))
    tree = suffix_tree.Tree(root, levels)
    return tree, {d: float((np.log10(root[hs[:, 1]]) + tree.gains(hs[:, 0], hs[:, 1])).sum()) for d, hs in histories.items()}


@pytest.mark.parametrize("block", [700, 8 << 20])
def test_every_word_and_context_counts(spark, monkeypatch, block):
    """Words and contexts far below any share of the corpus are symbols and states, as in the tree in one process."""
    monkeypatch.setattr(suffix_tree, "BLOCK_BYTES", block)
    rng = random.Random(6)
    rare = ["once w%d u%d r%d s%d t%d" % ((i,) * 5) for i in range(20)]
    rows = [(i, t + " tail %s" % rng.choice("ab")) for i, t in enumerate(t for _, t in corpus(120))]
    rows += [(1000 + i, rng.choice(rare)) for i in range(100)] + [(2000, None)]
    tree, want = sequential(rows)
    got = {r.doc_id: r for r in suffix_tree.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert len(tree.states) > 100 and set(got) == set(want)
    for d, x in want.items():
        assert math.isclose(got[d].score, x, rel_tol=1e-9), d


def test_keys_and_messages():
    """Keys that differ in their lowest bits alone keep their order; a message opens to what it was, in the bytes it needs."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 50, dtype=np.uint64) & ~np.uint64(4095)
    for keys in (base[rng.integers(0, 50, 2000)] | rng.integers(0, 4096, 2000, dtype=np.uint64), np.array([2**64 - 1, 0, 2**64 - 1], np.uint64), np.zeros(0, np.uint64)):
        want, places = np.unique(keys, return_inverse=True)
        got, at = suffix_tree.distinct(keys)
        assert np.array_equal(got, want) and np.array_equal(at, places)
    for kind, values in (("<i8", [-128, 127]), ("<i8", [-129]), ("<i8", [2**31]), ("<i8", [-(2**63), 2**63 - 1]), ("<u4", [0, 255, 2**32 - 1]), ("<u8", [2**64 - 1, 0]), ("<u8", [7]), ("<i8", [])):
        assert suffix_tree._opened(suffix_tree._squeezed(np.array(values, kind)), kind).tolist() == values
    assert len(suffix_tree._squeezed(rng.integers(0, 100, 1000).astype("<i8"))) < 1000


def test_rounds_get_what_they_need():
    """Each kind is asked once, after what it needs; no round but the last test reads the deepest grams' answers again."""
    done = []
    for kinds, needs in suffix_tree.ROUNDS:
        assert set(needs) <= set(done) and not set(kinds) & set(done)
        done += kinds
    deepest = suffix_tree.GRAMS[suffix_tree.DEPTH]
    assert [kinds for kinds, needs in suffix_tree.ROUNDS if deepest in needs] == [[suffix_tree.TESTS[suffix_tree.DEPTH]]]


def test_tables_start_no_processes(spark, monkeypatch, tmp_path):
    """Workers write the messages: Hadoop, which starts a process for each local file it makes, leaves none of its checksum files."""
    monkeypatch.setattr(shared, "shared_folder", lambda spark: f"file://{tmp_path}")
    got = suffix_tree.score(spark.createDataFrame(corpus(50), "doc_id long, text string").repartition(3)).collect()
    assert len(got) == 50
    files = [p.name for p in tmp_path.rglob("*") if p.is_file()]
    assert files and all(f.endswith(".parquet") and not f.startswith((".", "part-")) for f in files)


def test_only_whole_tasks_are_kept(spark, monkeypatch, tmp_path):
    """Rows of a task that failed or ran twice are not read; folders unknown to pyarrow go to Spark; no rows make an empty table."""

    def make(batches):
        yield from batches

    rows = spark.range(100, numPartitions=5)
    monkeypatch.setattr(shared, "shared_folder", lambda spark: f"file://{tmp_path}")
    table = kept(rows, make, "id long", "some")
    folder = next((tmp_path / "folioflux").iterdir())
    shutil.copy(next(folder.glob("*.parquet")), folder / "_tasks" / "of-a-failed-task.parquet")
    assert len(list(folder.glob("*.parquet"))) == 5
    assert sorted(r.id for r in spark.read.schema("id long").parquet(str(folder)).collect()) == sorted(r.id for r in table.collect()) == list(range(100))
    assert kept(rows.where("id < 0"), make, "id long", "none").collect() == []
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.shared.link./at", f"file://{tmp_path}")
    monkeypatch.setattr(shared, "shared_folder", lambda spark: "viewfs://shared/at")
    assert sorted(r.id for r in kept(rows, make, "id long", "other").collect()) == list(range(100))
