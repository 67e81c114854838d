import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from folioflux.llm import kernels as K
from folioflux.llm.transducer import Lexicon, compile_lexicon

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("aB cé\t\n漢.\x1c"), max_size=40)), max_size=12), st.integers(1, 30))
def test_words_are_hashed_alike_whatever_the_chunk(texts, chunk):
    column = pa.array(texts, pa.string())
    hashes, ptr = K.word_hashes(column, chunk=chunk)
    named = {}
    for i, t in enumerate(texts):
        own = words(t)
        assert len(own) == ptr[i + 1] - ptr[i]
        for w, h in zip(own, hashes[ptr[i] : ptr[i + 1]].tolist()):
            assert named.setdefault(w, h) == h
    assert len(set(named.values())) == len(named)
    whole, same = K.word_hashes(column)
    assert (whole == hashes).all() and (same == ptr).all()


def test_shingles_depend_on_words_and_order():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(12))) for _ in range(300)]
    values, ptr = K.distinct_by_text(*K.shingles(*K.word_hashes(pa.array(texts))))
    named = {}
    for i, t in enumerate(texts):
        w = words(t)
        want = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        own = set(values[ptr[i] : ptr[i + 1]].tolist())
        assert len(own) == len(want)
        named.setdefault(frozenset(want), own)
        assert named[frozenset(want)] == own
    assert len({frozenset(v) for v in named.values()}) == len(named)


def test_slices_and_long_texts():
    column = pa.array(["a b", None, "x " * 50_000, "c"])
    hashes, ptr = K.word_hashes(column.slice(1, 3), chunk=1000)
    assert ptr.tolist() == [0, 0, 50_000, 50_001] and len(set(hashes[:50_000].tolist())) == 1
    batch = pa.RecordBatch.from_arrays([pa.array(range(4)), column], ["doc_id", "text"])
    assert [b.num_rows for b in K.arrow_rows(batch, 10)] == [2, 1, 1]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.text(st.sampled_from("abé漢"), min_size=1, max_size=6), st.lists(st.integers(0, 2**32 - 1), max_size=4), max_size=40), st.text(st.sampled_from("abé漢"), max_size=7))
def test_lexicon_holds_exactly_its_words(entries, other):
    lexicon = Lexicon(compile_lexicon(entries))
    assert {w: lexicon.get(w) for w in entries} == entries
    assert lexicon.get(other) == entries.get(other)
    assert np.all(np.diff(np.array(lexicon.starts)) >= 0)
