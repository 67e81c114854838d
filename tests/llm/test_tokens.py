import hashlib
import random
import zlib

import numpy as np
import pytest
import public_tokenizers as P
from tokenizers import Tokenizer

from folioflux.llm import token_records as R
from folioflux.llm import transducer as T
from folioflux.llm.token_counts import count_tokens
from folioflux.llm.tokenizing import safe_pieces

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
ODD = [None, "", " ", "a", "The quick  brown fox\n\njumps 12345 over don't they'll", "été ÀÉÎ straße İstanbul Σίσυφος ΣΑΣ", "漢字かな 한국어   x y \x1c z \x85 w",
       "a<|endoftext|>b <|startoftext|> c", "x" * 3000, "lorem ipsum dolor " * 4000, "emoji 😀😀 ﬁ ½ ² é", "tabs\t\tand\r\nlines \x0b\x0c", "a<|endoftext|>b", "A" * 150 + "'s", "ǅ ǆ ª º 'RE 'Ll"]
SCHEMA = "doc_id long, text string, n_tokens int, id string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, -1, "x") for i, t in enumerate(texts)], SCHEMA).repartition(3)


def corpus():
    rng = random.Random(5)
    parts = ["the", "tion", " ", " ", " ", "\n", "é", "ß", "Σ", "12", "'s", "'", "--", "漢", " ", "̇", "X", "İ", "  "]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(300)]


def test_counts_match_library(spark):
    texts = ODD + corpus()
    lib = Tokenizer.from_file(BYTE)
    got = {r.doc_id: r for r in count_tokens(frame(spark, texts), BYTE, piece_chars=500, batch_bytes=2000).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 512), t


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model", "other"])
def test_counts_and_records_of_other_files(spark, name, tmp_path):
    import json

    import sentencepiece

    texts = ODD + corpus()
    path = P.path(name) if name != "other" else str(tmp_path / "digits.json")
    if name == "other":  # the same vocabulary behind another pattern
        held = json.load(open(BYTE, encoding="utf-8"))
        held["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "Digits", "individual_digits": True}, held["pre_tokenizer"]]}
        json.dump(held, open(path, "w", encoding="utf-8"))
    if name.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        want = [model.encode(t or "") for t in texts]
    else:
        lib = Tokenizer.from_file(path)
        lib.no_truncation(), lib.no_padding()
        want = [lib.encode(t or "", add_special_tokens=False).ids for t in texts]
    got = count_tokens(frame(spark, texts), path, piece_chars=500, batch_bytes=2000).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(x) for i, x in enumerate(want)}
    rows = R.read_records(spark, R.write_records(frame(spark, texts), path, end_id=1)).collect()
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in rows} == {i: [*x, 1] for i, x in enumerate(want)}


def test_counts_of_empty_and_repeated_rows(spark):
    assert count_tokens(frame(spark, []), BYTE).count() == 0
    rows = spark.createDataFrame([(3, "b c"), (3, "b c"), (3, None), (None, "b")], "id long, text string").withColumnRenamed("id", "n_tokens")
    got = count_tokens(rows, BYTE, id_col="n_tokens").toDF("id", "n_bytes", "n", "over").collect()
    assert sorted((r.id or 0, r.n_bytes, r.n) for r in got) == [(0, 1, 1), (3, 0, 0), (3, 3, 2), (3, 3, 2)]


def test_equal_hashes_are_told_apart(monkeypatch):
    from folioflux.llm import tokenizing

    monkeypatch.setattr(tokenizing, "mix", lambda h: h % np.uint64(4))
    lib, encoder = Tokenizer.from_file(BYTE), tokenizing.PieceEncoder(BYTE)
    for text in ("one two three four five", "six seven eight nine", "one two"):
        assert encoder.ids_of([text])[0].tolist() == lib.encode(text, add_special_tokens=False).ids


def test_safe_pieces_keep_text():
    text = "word " * 5000 + "x" * 9000 + " tail end"
    assert "".join(safe_pieces(text, 100)) == text


def test_records_round_trip(spark):
    texts = ODD + corpus()
    lib = Tokenizer.from_file(BYTE)
    manifest = R.write_records(frame(spark, texts), BYTE, shard_bytes=20_000)
    rows = R.read_records(spark, manifest).orderBy("doc_id").collect()
    assert [r.doc_id for r in rows] == list(range(len(texts)))
    assert manifest.count() > 2
    start = 0
    for r, t in zip(rows, texts):
        raw = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(raw) // 4, zlib.crc32(raw)), t
        start += r.n_tokens
    shard = manifest.orderBy("shard").collect()[1]
    before = sum(r.records for r in manifest.collect() if r.shard < shard.shard)
    doc, ids = R.read_at(shard.path, 2)
    assert doc == before + 2 and ids.tobytes() == rows[doc].ids


def test_records_empty_repeated_and_null_ids(spark):
    assert R.read_records(spark, R.write_records(frame(spark, []), BYTE)).count() == 0
    rows = spark.createDataFrame([(None, "a"), (3, "b"), (3, "b"), (1, None)], "doc_id long, text string")
    got = R.read_records(spark, R.write_records(rows, BYTE)).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(None, 0, 2), (1, 2, 1), (3, 3, 2), (3, 5, 2)]


def test_checksums_find_damage():
    data = R.frame(7, np.arange(100, dtype=np.uint32))
    assert R.unframe(data)[0] == 7
    for k in range(len(data)):
        with pytest.raises(ValueError):
            R.unframe(data[:k] + bytes([data[k] ^ 4]) + data[k + 1 :])


def test_bpe_matches_library(spark):
    texts = ODD + corpus()
    lib = Tokenizer.from_file(WORD)
    lib.no_truncation(), lib.no_padding()
    got = {r.doc_id: r for r in T.encode_decode(frame(spark, texts), WORD, keep_ids=True, most=50).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        r = got[i]
        assert (r.ids, r.decoded) == (ids, text), t
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(text))
    assert T.encode_decode(frame(spark, []), WORD).count() == 0


def test_automaton_is_minimal_and_exact():
    words = {a + b: [i, j] for i, a in enumerate(("", "x", "xy", "né")) for j, b in enumerate(("tion", "tions", "ed", "ing"))}
    lex = T.Lexicon(T.compile_lexicon(words))
    assert {w: lex.get(w) for w in words} == words
    assert all(lex.get(w) is None for w in ("", "x", "tio", "tionsx", "zed"))
    assert lex.words == len(words)
    trie = {w.encode()[:k] for w in words for k in range(len(w.encode()) + 1)}
    assert lex.states < len(trie) / 2
    assert T.Lexicon(T.compile_lexicon({})).get("a") is None


def test_long_and_short_merges_agree():
    m = T.word_bpe(WORD)
    rng = random.Random(1)
    for _ in range(300):
        s = [rng.choice("thesanion") for _ in range(rng.randrange(1, 40))]
        assert m._merge_long(list(s)) == m._merge_short(list(s))


def test_piece_encoder_matches_library():
    from folioflux.llm.tokenizing import PieceEncoder

    lib = Tokenizer.from_file(BYTE)
    rng = random.Random(11)
    parts = ["don", "'", "'s", "'re", "'ve", "'ll", "'m", "'d", "'t", "''", " ", "  ", "\n", "\t", "a", "é", "É", "ß", "×", "÷", "ª", "²", "½", "12", "3", "-", "…", "’", "—", "sat", "really", "ll", "l", "r", " '", "¡", "ñandú", "ǅ", "ɏ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(4000)] + ["'", "'s", "s'", " ", "\n", " \n ", "a'", "'r", "'rx", "'re"]
    encoder = PieceEncoder(BYTE, most=2000)
    encoder.PART = 3000
    for k in range(0, len(texts), 500):
        for t, ids in zip(texts[k : k + 500], encoder.ids_of(texts[k : k + 500])):
            assert ids.tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)
    long = "word don't stop " * 2000
    assert encoder.ids_of([long])[0].tolist() == lib.encode(long, add_special_tokens=False).ids


def test_a_worker_holds_a_bounded_table_of_pretokens():
    """Half a million distinct pre-tokens: the library gets a few thousand a call, the table stays below 100 MB, ids hold."""
    from folioflux.llm.tokenizing import PieceEncoder

    encoder, calls = PieceEncoder(BYTE), []
    lib = encoder.library

    class Watched:
        encode_batch = encode_batch_fast = lambda self, texts, **how: calls.append(len(texts)) or lib.encode_batch_fast(texts, **how)

    encoder.library = Watched()
    texts = [" ".join(f"7{k:07d}" for k in range(a, a + 50_000)) for a in range(0, 500_000, 50_000)]
    held = 0
    for text in texts:
        ids = encoder.ids_of([text])[0]
        held = max(held, sum(x.nbytes for x in vars(encoder.table).values() if isinstance(x, np.ndarray)))
    assert max(calls) <= 2048 and held < 100e6
    assert ids.tolist() == lib.encode(texts[-1], add_special_tokens=False).ids


def test_every_latin_character_has_the_librarys_ids():
    """Each code point to U+024F alone, beside a letter and beside a comma; words of languages that use rare letters."""
    lib, model = Tokenizer.from_file(WORD), T.WordBpe(WORD)
    texts = [f"{a}{chr(c)}{b}" for c in range(0x250) for a in ("", "a", ",") for b in ("", "a", ",", "Z")]
    texts += ["Ɔkwan", "Ɓera", "Ɗan Ɓauna", ",Ɛ", "ƐƆ Ŋutɔ ƲƗ", "Ⱥȿ", "İSTANBUL", "ŒUVRE ß ẞ", "Ǆ ǅ Ǉ"]
    for t in texts:
        ids = [i for w in model.words(t) for i in ([w] if isinstance(w, int) else model.merge(w))]
        assert ids == lib.encode(t, add_special_tokens=False).ids, t


def test_other_files_go_to_the_library_or_are_refused(tmp_path):
    import json

    with open(WORD, encoding="utf-8") as f:
        spec = json.load(f)
    spec["normalizer"] = None
    cased = tmp_path / "cased.json"
    cased.write_text(json.dumps(spec))
    lib, model = Tokenizer.from_file(str(cased)), T.WordBpe(str(cased))
    assert not model.fast and T.WordBpe(WORD).fast
    for t in ("Some  Words, and 12", "ÀB", "a<|endoftext|>B", "é\n"):
        assert [i for w in model.words(t) for i in ([w] if isinstance(w, int) else model.merge(w))] == lib.encode(t, add_special_tokens=False).ids, t
    for key, value in (("unk_token", "?"), ("dropout", 0.5), ("byte_fallback", True)):
        bad = tmp_path / f"{key}.json"
        bad.write_text(json.dumps({**spec, "model": {**spec["model"], key: value}}))
        with pytest.raises(ValueError):
            T.WordBpe(str(bad))
    with pytest.raises(ValueError):
        T.WordBpe(BYTE)
