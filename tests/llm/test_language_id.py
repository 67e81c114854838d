import random

from collections import Counter
from math import log2

from folioflux.llm.language_id import BUCKETS, identify, languages_of_documents, page_evidence, train, training_hashes

WORDS = {"aa": ["tion", "the", "ing", "ent"], "bb": ["eau", "éré", "oux", "que"], "cc": ["sch", "ung", "ß", "ein"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(WORDS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def corpus(n=300, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        rows.append((i, text(rng, lang, rng.randrange(3, 60)), lang, "h%d.example.%s" % (i % 7, lang)))
    return rows


def test_held_out_accuracy_and_rejects(spark):
    train_df = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string")
    test = [(d + 1000, t, lang, s) for d, t, lang, s in corpus(200, 2)]
    odd = [(1, None, "aa", None), (2, "", None, "x"), (3, "12 34 -- !!", "aa", "h.example.aa"), (4, "tion the", None, None), (5, "éré QUE ÉRÉ", "zz", "")]
    df = spark.createDataFrame(test + odd, "doc_id long, text string, declared string, host string").repartition(3)
    got = {r.doc_id: r for r in identify(df, train(train_df)).collect()}
    assert len(got) == len(test) + len(odd)
    assert all(got[d].lang_id == lang and not got[d].rejected for d, _, lang, _ in test)
    assert [got[i].rejected for i in (1, 2, 3, 4, 5)] == [True, True, True, False, False]
    assert (got[4].lang_id, got[5].lang_id, got[1].lang_id) == ("aa", "bb", "und")


def test_host_prior_decides_where_text_is_mute(spark):
    rows = corpus() + [(5000 + i, "q x", None, "h1.example.bb") for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = languages_of_documents(df).where("doc_id >= 5000").collect()
    assert all(r.text_lang is not None for r in got)
    assert languages_of_documents(df).columns[:4] == df.columns
    assert languages_of_documents(df.limit(0)).count() == 0


def test_page_evidence(spark):
    rows = [(1, "http://A.b.de/x", '<!DOCTYPE html><HTML class="x" lang="DE-at"><script>var t="</p>";</script><p>ein&amp;sch<!-- no --></p>'), (2, None, None)]
    got = page_evidence(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()
    assert (got[0].host, got[0].declared, got[0].text.split()) == ("a.b.de", "de", ["ein", "sch"])
    assert (got[1].host, got[1].declared, got[1].text.strip()) == ("", None, "")


def test_clashing_columns(spark):
    rows = [(*r, "keep", 1.5, True) for r in corpus(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, lang_id string, _prior double, rejected boolean")
    out = languages_of_documents(df)
    assert out.columns == df.columns + ["lang_id_", "posterior", "text_lang", "rejected_"]
    assert {tuple(r)[4:7] for r in out.collect()} == {("keep", 1.5, True)}


def test_every_labelled_language_has_a_model(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rng, rows = random.Random(3), []
    for k in range(70):
        syllables = [letters[k % 26] + letters[(k // 26 + 3 * j + k) % 26] + letters[(5 * j + 2 * k) % 26] for j in range(3)]
        for i in range(3 if k == 69 else 4):
            words = " ".join("".join(rng.choice(syllables) for _ in range(3)) for _ in range(20))
            rows.append((10 * k + i, words, "l%02d" % k, "h"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = train(df)
    assert model.langs == ["l%02d" % k for k in range(70)]
    got = languages_of_documents(df.where("lang = 'l69' or doc_id % 10 = 0")).where("lang = 'l69'").collect()
    assert [(r.lang_id, r.rejected) for r in got] == [("l69", False)] * 3


def test_copies_lose_no_language_and_no_training_text(spark):
    few = spark.range(20_000, numPartitions=4).selectExpr("'one text that repeats for ever' as text", "'es' as lang")
    many = spark.range(500, numPartitions=2).selectExpr("concat('the english number ', id) as text", "'en' as lang")
    assert train(few.union(many)).langs == ["en", "es"]
    rows = spark.range(20_000, numPartitions=5).selectExpr("'es' as lang", "xxhash64(id % 1000) as h").union(spark.range(30).selectExpr("'en'", "id % 7"))
    got = training_hashes(rows, 500).collect()
    every = {r.h for r in rows.where("lang = 'es'").distinct().collect()}
    assert len(got) == len(set(got)) == 507
    assert sorted(r.h for r in got if r.lang == "es") == sorted(every)[:500]
    assert sorted(r.h for r in got if r.lang == "en") == list(range(7))
    assert train(few.limit(0)).langs == [] and train(few.selectExpr("null as text", "lang")).langs == []


def buckets(text):
    """Buckets of a text's folded byte trigrams, one by one."""
    b = []
    for before, x in zip(b"\0" + text.encode(), text.encode()):
        fold = x | 0x20 if 65 <= x <= 90 or before == 0xC3 and 0x80 <= x <= 0x9E and x != 0x97 else x if x >= 128 or 97 <= x <= 122 else 0x20
        b.append(fold)
    three = [b[k : k + 3] for k in range(len(b) - 2)]
    return [((x << 16 | y << 8 | z) * 2654435761 % 2**32) >> 18 for x, y, z in three if (x, y) != (32, 32) and (y, z) != (32, 32)]


def posterior_by_hand(rows, labelled):
    """lang_id, posterior, text_lang, rejected of (text, declared, host) rows, from the definitions in the docstrings."""
    langs = sorted({lang for _, lang in labelled})
    n = {x: Counter(b for t, lang in set(labelled) if lang == x for b in buckets(t)) for x in langs}
    total = {x: sum(n[x].values()) + 0.05 * BUCKETS for x in langs}
    log = lambda x, b: log2(0.9 * (n[x][b] + 0.05) / total[x] + 0.1 / BUCKETS)
    mean = [{x: sum(log(x, b) for b in buckets(t or "")) / len(buckets(t or "")) for x in langs} if buckets(t or "") else None for t, _, _ in rows]
    said = [max(langs, key=lambda x: (m[x], -langs.index(x))) if m and max(m.values()) > -log2(BUCKETS) else None for m in mean]
    claims = {a: {b: sum(s == a and (d or "").lower() == b for s, (_, d, _) in zip(said, rows)) + 0.5 + 5 * (a == b) for b in langs} for a in langs}
    levels = lambda h: ((h or ""), ".".join((h or "").split(".")[-2:]), (h or "").split(".")[-1])

    def prior(host):
        ps = {x: 1 / len(langs) for x in langs}
        of = levels(host)
        for same in (lambda h: True, lambda h: levels(h)[2] == of[2], lambda h: levels(h)[1] == of[1], lambda h: levels(h)[0] == of[0]):
            own = Counter(s for s, (_, _, h) in zip(said, rows) if s and same(h))
            ps = {x: (own[x] + 20 * ps[x]) / (sum(own.values()) + 20) for x in langs}
        return ps

    out = []
    for (t, d, h), m, s in zip(rows, mean, said):
        k = len(buckets(t or ""))
        has = any(x and levels(y[2])[0] == levels(h)[0] for x, y in zip(said, rows))
        score = {x: (m[x] * min(k, 40) if m else 0) + (log2(claims[x][d.lower()] / sum(claims[x].values())) if d and d.lower() in langs else 0) + (log2(prior(h)[x]) if has else 0) for x in langs}
        odds = {x: 2 ** (v - max(score.values())) for x, v in score.items()}
        best = max(langs, key=lambda x: (odds[x], -langs.index(x)))
        top = odds[best] / sum(odds.values())
        bad = not m or max(m.values()) <= -log2(BUCKETS) or top < 0.5
        out.append(("und" if bad else best, top, (max(langs, key=lambda x: (m[x], -langs.index(x))) if m else None), bad))
    return out


def test_posterior_against_brute_force(spark):
    rng = random.Random(7)
    labelled = [(t, lang) for _, t, lang, _ in corpus(40, 5)]
    labelled += labelled[:9] + [("tion the ÉRÉ eau", "cc")]
    rows = [(t, rng.choice([None, "aa", "BB", "cc", "zz"]), rng.choice([None, "", "x.aa", "www.x.aa", "y.bb", "localhost"])) for _, t, _, _ in corpus(40, 6)]
    rows += [(rng.choice(["q x", "12 34", "the eau", "sch", "ein que", "éré ÉRÉ", "", None, "---"]), rng.choice([None, "aa", "bb"]), rng.choice(["x.aa", "new.aa", "y.bb"])) for _ in range(40)]
    rows += [rows[0], rows[0], ("the tion ing " * 30_000, "bb", "y.bb"), ("é" * 200_000, None, "y.bb")]
    model = train(spark.createDataFrame(labelled, "text string, lang string"))
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k long, text string, declared string, host string").repartition(3)
    got = [(r.lang_id, r.posterior, r.text_lang, r.rejected) for r in identify(df, model).orderBy("k").collect()]
    want = posterior_by_hand(rows, labelled)
    for g, w, r in zip(got, want, rows):
        assert (g[0], g[2], g[3]) == (w[0], w[2], w[3]) and abs(g[1] - w[1]) < 1e-4, (g, w, r[1:])


def test_a_tie_goes_to_the_first_language(spark):
    labelled = spark.createDataFrame([("same words here", "b"), ("same words here", "a")], "text string, lang string")
    rows = spark.createDataFrame([("same words here", None, None)], "text string, declared string, host string")
    got = identify(rows, train(labelled)).first()
    assert (got.lang_id, got.text_lang, got.rejected) == ("a", "a", False)  # and so does the prior of its host
