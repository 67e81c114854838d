"""The pipeline on a small fixture against brute force, stage by stage."""

import hashlib
import importlib
import random
import sys

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.test_containment import shingles
from tests.llm.test_language_id import text
from tests.llm.test_near_duplicates import brute


@pytest.fixture(scope="module")
def pipeline():
    root = __file__.rsplit("/tests/", 1)[0]
    if root not in sys.path:
        sys.path.insert(0, root)
    return importlib.import_module("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    rows, items = [], [text(rng, "aa", n) for n in (12, 30, 60)]
    for i in range(240):
        lang = rng.choice(["aa", "bb", "cc"])
        words = text(rng, lang, rng.randrange(30, 90)).split()
        if i % 6 == 0:
            at = rng.randrange(len(words))
            words[at:at] = rng.choice(items).split()
        rows.append((" ".join(words), lang))
        for _ in range(rng.choice((0, 0, 0, 1, 5))):
            copy = list(words)
            copy[rng.randrange(len(copy))] = "changed"
            rows.append((" ".join(copy), lang))
    rows += [(None, "aa"), ("", "bb"), ("1234 5678 -- 99", "cc"), (rows[0][0], rows[0][1]), ("tion the", "aa")]
    rng.shuffle(rows)
    path = str(tmp_path_factory.mktemp("tables"))
    docs = [(3 * i + 1, t, lang, "src%d" % (i % 5), len(t or "")) for i, (t, lang) in enumerate(rows)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, {d[0]: d[1] for d in docs}, items


def test_against_brute_force(spark, pipeline, folder):
    path, texts, items = folder
    kept = {d: t for d, t in texts.items() if t and any(c.isalpha() for c in t)}
    assert len(texts) - len(kept) == 3
    kept = {d: kept[d] for d, (_, _, first) in brute(list(kept.items())).items() if first}
    sets = [shingles(t) for t in items]
    kept = {d: t for d, t in kept.items() if not any(100 * len(s & shingles(t)) >= 75 * len(s) for s in sets)}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for d, t in kept.items():
        ids = library.encode(t, add_special_tokens=False).ids
        want[d] = (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pipeline.run(spark, path).collect()}
    assert got == want and 100 < len(want) < len(texts) - 60


def test_stages_return_the_columns_of_documents(spark, pipeline, folder):
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "bpe"]
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).schema == docs.schema
        assert stage(spark, docs.limit(0), path).count() == 0


def test_rows_that_share_an_id_are_dropped_by_their_text(spark, pipeline):
    base = ["w%d" % i for i in range(60)]
    copy, clean = " ".join([*base[:-1], "changed"]), " ".join("u%d" % i for i in range(60))
    rows = [(1, " ".join(base)), (7, copy), (7, clean), (None, copy)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = pipeline.near_duplicate_stage(spark, docs, "").collect()
    assert {tuple(r) for r in got} == {rows[0], rows[2]}
