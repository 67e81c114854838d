"""Worker-side tokenizers of the library, loaded once per Python worker, and their piece cache."""

from __future__ import annotations

import json
import os
import re

import numpy as np

from folioflux.llm.kernels import BYTE_WEIGHTS, mix, power_tables

_loaded: dict[str, object] = {}
_encoders: dict[str, object] = {}


def tokenizer(path: str):
    """The library's tokenizer of a file, without truncation or padding, single-threaded."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        made.no_truncation()
        made.no_padding()
        _loaded[path] = made
    return _loaded[path]


#: Characters whose letter, number and space classes are the same in every Unicode version in use.
UNSAFE = re.compile("[^\t-\r -~¡-ɏ–—‘’“”…]")
LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBER = "0-9²³¹¼-¾"
SPACE = "\t-\r "
_SAFE_CUT = re.compile("[A-Za-z] (?=[A-Za-z])")


class Generations(dict):
    """A bounded memo: when it is full it becomes the older generation, and what is used again comes back from there."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.older = limit, {}

    def recall(self, keys) -> list:
        """Bring the keys that the older generation holds back into this one; the keys that neither holds."""
        missing = []
        for k in keys:
            v = self.older.get(k)
            if v is None:
                missing.append(k)
            else:
                self[k] = v
        return missing

    def turn(self) -> None:
        if len(self) > self.limit:
            self.older = dict(self)
            self.clear()


_SPACE, _LETTER, _NUMBER, _OTHER = 1, 2, 3, 4


def _byte_classes() -> np.ndarray:
    """Class of each byte of UTF-8 up to U+024F and general punctuation; of a lead byte, its usual one."""
    out = np.full(256, _OTHER, np.uint8)
    out[[*range(9, 14), 32]] = _SPACE
    out[[*range(65, 91), *range(97, 123), *range(0xC3, 0xCA)]] = _LETTER
    out[48:58] = _NUMBER
    return out


_CLASS = _byte_classes()
_C2 = np.full(256, _OTHER, np.uint8)  # second bytes after C2
_C2[[0xAA, 0xB5, 0xBA]] = _LETTER
_C2[[0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = _NUMBER
_ONE, _TWO = np.frombuffer(b"stmd", np.uint8), [(b[0], b[1]) for b in (b"re", b"ve", b"ll")]


def piece_starts(data: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where the byte-level pre-tokens of safe texts begin; firsts: where the texts do (none of them empty).

    The rule of the pattern, on runs of one class: a blank right before a run goes with it; other white space before
    a run stays apart from its last character; a lone apostrophe takes s, t, m, d, re, ve or ll after it.
    """
    kind, n = _CLASS[data], len(data)
    leads = np.flatnonzero((data >= 0xC2) & (data <= 0xC9))
    after = data[leads + 1]
    own = np.where(data[leads] == 0xC2, _C2[after], np.where((data[leads] == 0xC3) & ((after == 0x97) | (after == 0xB7)), _OTHER, _LETTER)).astype(np.uint8)
    kind[leads], kind[leads + 1] = own, own
    begins = np.zeros(n + 1, bool)
    begins[1:-1] = kind[1:] != kind[:-1]
    begins[firsts], begins[n] = True, True
    mark = begins.copy()
    text_end = np.zeros(n + 1, bool)
    text_end[firsts], text_end[n] = True, True
    runs = np.flatnonzero(begins)
    a, b = runs[:-1], runs[1:]
    white = (kind[a] == _SPACE) & ~text_end[b]
    a, b = a[white], b[white]
    blank = data[b - 1] == 32
    mark[b[blank]] = False
    mark[b[blank | (b - a >= 2)] - 1] = True
    lone = np.flatnonzero((data == 39) & mark[:n])
    lone = lone[(lone + 1 < n)]
    lone = lone[begins[lone + 1] & ~text_end[lone + 1] & (kind[np.minimum(lone + 1, n - 1)] == _LETTER)]
    one = np.isin(data[lone + 1], _ONE)
    two = np.zeros(len(lone), bool)
    third = data[np.minimum(lone + 2, n - 1)]
    inside = (lone + 2 < n) & ~begins[np.minimum(lone + 2, n)]
    for x, y in _TWO:
        two |= (data[lone + 1] == x) & (third == y) & inside
    for hit, size in ((lone[one], 2), (lone[two], 3)):
        mark[hit + 1] = False
        mark[hit + size] = True
    mark[n] = False
    return np.flatnonzero(mark)


class PieceTable:
    """Ids of pre-tokens by 64-bit hash: open addressing on arrays, a few dozen bytes a pre-token."""

    def __init__(self, most: int):
        self.most = most
        self.clear(1 << 16)

    def clear(self, slots: int) -> None:
        self.keys, self.where = np.zeros(slots, np.uint64), np.full(slots, -1, np.int32)
        self.ends, self.ids, self.n, self.used = np.zeros(slots, np.int64), np.zeros(4 * slots, np.uint32), 0, 0
        self.text_ends, self.text, self.text_used = np.zeros(slots, np.int64), np.zeros(8 * slots, np.uint8), 0

    def find(self, h: np.ndarray) -> np.ndarray:
        mask = np.uint64(len(self.keys) - 1)
        at = h & mask
        key = self.keys[at]
        out = np.where(key == h, self.where[at], -1)
        rest = np.flatnonzero((key != h) & (key != 0))
        while len(rest):
            at[rest] = (at[rest] + np.uint64(1)) & mask
            key = self.keys[at[rest]]
            hit = key == h[rest]
            out[rest[hit]] = self.where[at[rest[hit]]]
            rest = rest[~hit & (key != 0)]
        return out

    def _place(self, h: np.ndarray, numbers: np.ndarray) -> None:
        mask = np.uint64(len(self.keys) - 1)
        at, rest = h & mask, np.arange(len(h))
        while len(rest):
            here = at[rest]
            free = self.keys[here] == 0
            self.keys[here[free]] = h[rest[free]]
            own = self.keys[here] == h[rest]
            self.where[here[own]] = numbers[rest[own]]
            rest = rest[~own]
            at[rest] = (at[rest] + np.uint64(1)) & mask

    def add(self, h: np.ndarray, counts: np.ndarray, ids: np.ndarray, pieces: list[bytes]) -> None:
        """New distinct hashes with the ids of each, one after another, and the bytes they stand for."""
        while 2 * (self.n + len(h)) > len(self.keys):
            old, numbers = self.keys[self.where >= 0], self.where[self.where >= 0]
            slots = 2 * len(self.keys)
            self.keys, self.where = np.zeros(slots, np.uint64), np.full(slots, -1, np.int32)
            self.ends = np.concatenate([self.ends[: self.n], np.zeros(slots - self.n, np.int64)])
            self.text_ends = np.concatenate([self.text_ends[: self.n], np.zeros(slots - self.n, np.int64)])
            self._place(old, numbers)
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(2 * (self.used + len(ids)), np.uint32)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.ends[self.n : self.n + len(h)] = self.used + np.cumsum(counts)
        text = np.frombuffer(b"".join(pieces), np.uint8)
        if self.text_used + len(text) > len(self.text):
            self.text = np.concatenate([self.text[: self.text_used], np.zeros(2 * (self.text_used + len(text)), np.uint8)])
        self.text[self.text_used : self.text_used + len(text)] = text
        self.text_ends[self.n : self.n + len(h)] = self.text_used + np.cumsum([len(p) for p in pieces])
        self._place(h, np.arange(self.n, self.n + len(h), dtype=np.int32))
        self.n += len(h)
        self.used += len(ids)
        self.text_used += len(text)

    @staticmethod
    def _runs(values: np.ndarray, ends: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        stops = ends[numbers]
        starts = np.where(numbers > 0, ends[numbers - 1], 0)
        counts = stops - starts
        first = np.cumsum(counts) - counts
        return values[np.arange(int(counts.sum())) + np.repeat(starts - first, counts)], counts

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pre-tokens with these numbers, and how many each has."""
        return self._runs(self.ids, self.ends, numbers)

    def stands_for(self, numbers: np.ndarray, data: np.ndarray) -> bool:
        """Whether data is just the pre-tokens with these numbers, byte for byte."""
        return np.array_equal(self._runs(self.text, self.text_ends, numbers)[0], data)


def in_batches(texts: list[str], most: int):
    """Runs of texts of about `most` characters together."""
    run, size = [], 0
    for text in texts:
        if run and size + len(text) > most:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run


class LibraryEncoder:
    """Any file of the tokenizers library: whole texts, in batches."""

    PART = 1 << 18

    def __init__(self, path: str):
        self.library = tokenizer(path)

    def pieces(self, text: str, most: int) -> list[str]:
        return [text]

    def ids_of(self, texts: list[str]) -> list[np.ndarray]:
        """All ids of each text as unsigned 32-bit integers."""
        found = (e for run in in_batches(texts, self.PART) for e in self.library.encode_batch_fast(run, add_special_tokens=False))
        return [np.array(e.ids, np.uint32) for e in found]


class SentenceEncoder(LibraryEncoder):
    """A .model file of the sentencepiece library, without begin and end."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)

    def ids_of(self, texts: list[str]) -> list[np.ndarray]:
        found = (ids for run in in_batches(texts, self.PART) for ids in self.library.encode(run, num_threads=1))
        return [np.array(ids, np.uint32) for ids in found]


def byte_level(path: str) -> bool:
    """Whether a file has what PieceEncoder relies on: the byte-level pattern alone before plain BPE over an alphabet of
    bytes, and added tokens that no safe cut can touch."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    model, before = held["model"], held.get("pre_tokenizer") or {}
    usual = model.get("type") == "BPE" and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
    pattern = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
    cut = any(" " in t["content"] or t.get("rstrip") for t in held.get("added_tokens") or [])
    alphabet = usual and pattern and len({x for x in model["vocab"] if len(x) == 1}) >= 256
    return bool(alphabet and not held.get("normalizer") and not cut)


class PieceEncoder:
    """Byte-level BPE by the library, each distinct pre-token encoded once per worker (until the table is full).

    Texts are cut into pre-tokens and these are hashed by passes of numpy; what the table lacks goes to the library.
    A pre-token alone is one pre-token again, so its ids do not depend on its neighbours. Pre-tokens are found by hash
    and then compared byte for byte; where two share a hash, their texts go to the library. So do texts with characters
    outside UNSAFE's complement, or with an added token's string, whole and in batches.
    """

    #: Characters in one pass of numpy, pre-tokens in one call of the library (whose result is about 1 kB each)
    PART, CALL = 1 << 18, 2048

    def __init__(self, path: str, most: int = 400_000):
        self.library, self.whole = tokenizer(path), LibraryEncoder(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.table = PieceTable(most)
        symbols = self.library.get_vocab(with_added_tokens=False)
        self.width = np.zeros(max(symbols.values()) + 1, np.int64)  # a vocabulary entry has a character a byte
        self.width[list(symbols.values())] = [len(t) for t in symbols]

    def pieces(self, text: str, most: int) -> list[str]:
        return safe_pieces(text, most)

    def _learn(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces one after another, and how many each has; pieces of a blank and letters are encoded in runs,
        as the library splits such a run at each blank."""
        plain, rest = [], []
        for k, p in enumerate(pieces):
            (plain if p[:1] == b" " and p[1:].decode().isalpha() else rest).append(k)
        found: list = [None] * len(pieces)
        for own in (rest[k : k + self.CALL] for k in range(0, len(rest), self.CALL)):
            for k, e in zip(own, self.library.encode_batch_fast([pieces[k].decode() for k in own], add_special_tokens=False)):
                found[k] = e.ids
        counts = np.array([0 if f is None else len(f) for f in found], np.int64)
        out: list[np.ndarray] = []
        runs = [plain[k : k + 128] for k in range(0, len(plain), 128)]
        for run, e in zip(runs, self.library.encode_batch_fast([b"".join(pieces[k] for k in r).decode() for r in runs], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            ends = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum([len(pieces[k]) for k in run])) + 1
            counts[run] = np.diff(ends, prepend=0)
            out.append(ids)
        # the runs' ids stand together; bring all into the order of pieces
        flat = np.concatenate([*out, np.array([i for k in rest for i in found[k]], np.uint32)]) if pieces else np.zeros(0, np.uint32)
        order = np.array(plain + rest, np.int64)
        starts = np.empty(len(pieces), np.int64)
        starts[order] = np.cumsum(counts[order]) - counts[order]
        first = np.cumsum(counts) - counts
        return flat[np.arange(len(flat)) + np.repeat(starts - first, counts)], counts

    def _safe(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of safe, non-empty texts."""
        raw = [t.encode() for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        at = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        starts = piece_starts(data, at[:-1])
        ends = np.append(starts[1:], len(data))
        power, inverse = power_tables(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_WEIGHTS[data] * power[:-1], out=total[1:])
        h = mix((total[ends] - total[starts]) * inverse[starts]) | np.uint64(1)
        if self.table.n > self.table.most:
            self.table.clear(1 << 16)
        numbers = self.table.find(h)
        gaps = np.flatnonzero(numbers < 0)
        if len(gaps):
            new, first = np.unique(h[gaps], return_index=True)
            where = gaps[first]
            pieces = [data[a:b].tobytes() for a, b in zip(starts[where].tolist(), ends[where].tolist())]
            ids, counts = self._learn(pieces)
            self.table.add(new, counts, ids, pieces)
            numbers[gaps] = self.table.find(h[gaps])
        if not self.table.stands_for(numbers, data):
            return self.whole.ids_of(texts)
        ids, counts = self.table.gather(numbers)
        bounds = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(starts, at)]
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]

    def ids_of(self, texts: list[str]) -> list[np.ndarray]:
        """All ids of each text as unsigned 32-bit integers."""
        out: list = [np.zeros(0, np.uint32)] * len(texts)
        parts: list[tuple[int, str]] = []
        rare: list[int] = []
        for i, text in enumerate(texts):
            if UNSAFE.search(text) or any(a in text for a in self.added):
                rare.append(i)
            elif text:
                parts += [(i, p) for p in safe_pieces(text, self.PART)]
        for i, ids in zip(rare, self.whole.ids_of([texts[i] for i in rare])):
            out[i] = ids
        k = 0
        while k < len(parts):
            size, stop = 0, k
            while stop < len(parts) and (stop == k or size + len(parts[stop][1]) <= self.PART):
                size += len(parts[stop][1])
                stop += 1
            for (i, _), ids in zip(parts[k:stop], self._safe([p for _, p in parts[k:stop]])):
                out[i] = np.concatenate([out[i], ids]) if len(out[i]) else ids
            k = stop
        return out


def piece_encoder(path: str):
    """Encoder of a tokenizer file, once per worker: sentencepiece for .model, the fast path where the file allows it,
    else the tokenizers library."""
    if path not in _encoders:
        _encoders[path] = SentenceEncoder(path) if path.endswith(".model") else PieceEncoder(path) if byte_level(path) else LibraryEncoder(path)
    return _encoders[path]


def safe_pieces(text: str, most: int) -> list[str]:
    """A text cut where no pre-token crosses: between a letter and a blank that stands before a letter."""
    if len(text) <= most:
        return [text]
    out, at = [], 0
    while len(text) - at > most:
        m = None
        for m in _SAFE_CUT.finditer(text, max(at, at + most - 2048), at + most):
            pass
        m = m or _SAFE_CUT.search(text, at + most)
        if m is None:
            break
        out.append(text[at : m.start() + 1])
        at = m.start() + 1
    return [*out, text[at:]]
