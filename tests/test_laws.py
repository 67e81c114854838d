"""Laws that hold for any input."""

import random
import statistics

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioflux.functions import extract as X
from folioflux.functions import text as T
from folioflux.functions.similarity import ratio, ratio_from
from folioflux.operators import evaluate as E
from folioflux.operators import layout as L
from folioflux.operators import matching as M
from folioflux.operators import resolve as R
from folioflux.operators.select import even_ordinals
from folioflux.plans.pages import by_gap, by_running_median

LATIN = st.text(st.sampled_from("aB éÑüß1-.,|_•\t'"), max_size=30)


@given(st.text(max_size=40))
def test_normal_form_is_idempotent(t):
    once = T.normalize_kernel(t)
    assert T.normalize_kernel(once) == once and T.clean_display_kernel(T.clean_display_kernel(t)) == T.clean_display_kernel(t)


def test_columns_and_kernels_agree(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("aBzéÑüßøŠ 12-.,|_•–'\tç") for _ in range(rng.randrange(20))) for _ in range(400)]
    texts += ["V-12.345.678 12345678901", "E 4O", "c1I", "29/02/2024", "10:30 a.m.", "lista uno", "12ene", "123456789012"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    c = F.col("t")
    for r in rows.select("t", T.normalize(c).alias("n"), T.clean_display(c).alias("d"), T.is_metadata(c).alias("m"), T.table_documents(c).alias("x"), T.ocr_number(c).alias("o")).collect():
        assert r.n == T.normalize_kernel(r.t) and r.d == T.clean_display_kernel(r.t), r.t
        assert r.m == X.is_metadata(r.t) and list(r.x) == X.documents_in(r.t), r.t
        assert r.o == X.cell_number(r.t), r.t


def test_strong_scores_agree(spark):
    rng = random.Random(3)
    words = ["catia", "la", "mar", "mi", "guaira", "cati", "a", "lamar"]
    pairs = [(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 5))), " ".join(rng.choice(words) for _ in range(rng.randrange(1, 4)))) for _ in range(400)]
    rows = spark.createDataFrame(pairs, "t string, a string")
    for r in rows.select("t", "a", M.strong_column(F.col("t"), F.col("a")).alias("s")).collect():
        assert r.s == M.strong_score(r.t, r.a), (r.t, r.a)


@settings(max_examples=60)
@given(st.integers(0, 6), st.integers(0, 6), st.randoms(use_true_random=False))
def test_alignment_keeps_order_and_is_best(n, m, rng):
    scores = np.array([[rng.choice([0.0, 0.2, 0.5, 0.9, 1.0]) for _ in range(m)] for _ in range(n)]).reshape(n, m)
    pairs = E.align(scores)
    rows, columns = [i for i, _ in pairs if i is not None], [j for _, j in pairs if j is not None]
    assert rows == list(range(n)) and columns == list(range(m))
    worth = lambda ps: sum(E.GAP if None in p else scores[p] for p in ps)
    assert all(scores[p] >= E.LEAST for p in pairs if None not in p)

    def best(i, j):
        if i == n or j == m:
            return E.GAP * (n - i + m - j)
        options = [best(i + 1, j) + E.GAP, best(i, j + 1) + E.GAP]
        return max(options + ([best(i + 1, j + 1) + scores[i, j]] if scores[i, j] >= E.LEAST else []))

    assert abs(worth(pairs) - best(0, 0)) < 1e-9


@given(st.lists(st.integers(0, 60), max_size=20))
def test_clusters_part_their_input(values):
    values = sorted(values)
    for rule in (by_gap, by_running_median):
        found = rule(values, lambda v: v, 4)
        assert sorted(v for c in found for v in c) == values
    found = by_gap(values, lambda v: v, 4)
    assert all(b[0] - a[-1] > 4 for a, b in zip(found, found[1:]))


def by_all_medians(values, tolerance, first):
    """Each value to the first (or only to the last) cluster whose median is near, medians taken anew each time."""
    out: list[list] = []
    for v in values:
        home = next((c for c in (out if first else out[-1:]) if abs(v - statistics.median(c)) <= tolerance), None)
        out, home = (out, home) if home is not None else ([*out, []], None)
        (home if home is not None else out[-1]).append(v)
    return out


@given(st.lists(st.integers(0, 200), max_size=40), st.sampled_from([0, 1, 4, 25]))
def test_running_medians_are_first_fits_of_sorted_values(values, tolerance):
    values = sorted(values)
    found = by_running_median(values, lambda v: v, tolerance)
    assert found == by_all_medians(values, tolerance, False) == by_all_medians(values, tolerance, True)


def test_the_fold_on_columns_gives_the_same_clusters(spark):
    rng = random.Random(8)
    groups = {k: [rng.choice([None, rng.randrange(60) / 2]) for _ in range(rng.randrange(30))] for k in range(30)}
    rows = [(k, v, 0) for k, vs in groups.items() for v in vs]
    got: dict = {}
    for r in L.median_clusters(spark.createDataFrame(rows, "k int, v double, n int").repartition(3), ["k"], "v", 2.5).collect():
        got.setdefault(r.k, []).append((r.cluster, r.n, r.low, r.high))
    want = {k: [(i, len(c), c[0], c[-1]) for i, c in enumerate(by_running_median(sorted(v for v in vs if v is not None), lambda v: v, 2.5))] for k, vs in groups.items()}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_even_samples_hold_both_ends(spark):
    for n, limit in ((2, 2), (9, 2), (100, 7), (101, 100)):
        got = sorted(r.ordinal for r in even_ordinals(spark, n, limit).collect())
        assert got[0] == 0 and got[-1] == n - 1 and len(got) <= limit


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["Ana Gil", "Ána  GIL", "Luis Paz"]), st.sampled_from([None, 1, 2]), st.sampled_from(["", "111111", "V-111111", "222222"]), st.floats(0, 1)), max_size=14))
def test_every_record_has_one_person(rows):
    from folioflux.functions.schemas import record

    records = [(k, record(full_name=n, center="H", age=a, age_unit="años", document_id=d, confidence=c, source_image=f"{k}.jpg")) for k, (n, a, d, c) in enumerate(rows)]
    people = R.resolve(records)
    assert sorted(o for _, own in people for o in own) == list(range(len(rows)))
    firsts = [own[0] for _, own in people]
    assert firsts == sorted(firsts) and all(p["occurrences"] == len(own) and p["source_images"] == [f"{o}.jpg" for o in own] for p, own in people)


@given(LATIN)
def test_spans_stay_inside(t):
    for found in [f for f in (X.list_document(t), X.list_age(t, []), X.list_sex(t, 0), *X.misread_ages(t)) if f]:
        assert 0 <= found.span[0] < found.span[1] <= len(t)
    assert len(X.without_ages(t)) == len(t)


@settings(max_examples=300, deadline=None)
@given(st.text("abcdé ", max_size=12), st.text("abcdé ", max_size=12), st.sampled_from([0.0, 0.5, 0.78, 0.8, 0.92, 1.0]))
def test_a_bounded_ratio_is_the_ratio_from_its_bound_on(a, b, least):
    whole, bounded = ratio(a, b), ratio_from(a, b, least)
    assert bounded == whole if whole >= least else bounded in (0.0, whole)
