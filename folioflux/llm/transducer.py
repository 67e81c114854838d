"""BPE with a minimal acyclic transducer as lexicon: frequent words carry their ids, unseen words are merged exactly."""

from __future__ import annotations

import heapq
import json
import mmap
import re
import struct
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflux.llm.shared import filesystem, new_folder, small_arrow_batches
from folioflux.llm.tokenizing import LETTER, NUMBER, SPACE, UNSAFE, Generations, tokenizer

_MAGIC = b"MADT0001"
#: Fixed: the normalizer and the pattern that the fast path stands for
_NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters that only the library classifies: those outside the safe range, before or after they are lower-cased
_SAFE = [c for c in map(chr, range(0x2100)) if not UNSAFE.search(c + c.lower())]
_RARE = re.compile(f"[^{''.join(map(re.escape, _SAFE))}]")
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^{SPACE}{LETTER}{NUMBER}]+")


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        out[b] = chr(b) if b in plain else chr(extra)
        extra += b not in plain
    return out


# ---------------------------------------------------------------- the automaton


def compile_lexicon(entries: dict[str, list[int]]) -> bytes:
    """Minimal acyclic automaton of the words' UTF-8 bytes; outputs summed along a path number the words.

    Words are added in sorted order and each finished suffix is replaced by an equal state registered before, so
    suffixes are shared. An arc holds its byte, its target and the number of accepted words that sort before it.
    """
    words = sorted((w.encode(), ids) for w, ids in entries.items())
    register: dict[tuple, int] = {}
    states: list[tuple] = []  # (final, ((byte, state), ...))

    def settle(node) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    path: list[list] = [[False, []]]
    last = b""
    for word, _ in words:
        common = 0
        while common < min(len(last), len(word)) and last[common] == word[common]:
            common += 1
        while len(path) - 1 > common:
            done = path.pop()
            path[-1][1].append((last[len(path) - 1], settle(done)))
        for _ in word[common:]:
            path.append([False, []])
        path[-1][0] = True
        last = word
    while len(path) > 1:
        done = path.pop()
        path[-1][1].append((last[len(path) - 1], settle(done)))
    root = settle(path[0])
    below = np.zeros(len(states), np.int64)  # accepted words from each state; targets settle before sources
    first, labels, targets, outs = [0], bytearray(), [], []
    for k, (final, arcs) in enumerate(states):
        n = int(final)
        for b, to in arcs:
            labels.append(b)
            targets.append(to)
            outs.append(n)
            n += int(below[to])
        below[k] = n
        first.append(len(labels))
    ids = [x for _, own in words for x in own]
    starts = np.cumsum([0, *(len(own) for _, own in words)])
    parts = [np.array(first, "<u4").tobytes(), np.array([s[0] for s in states], "u1").tobytes(), bytes(labels), np.array(targets, "<u4").tobytes(), np.array(outs, "<u4").tobytes(), starts.astype("<u4").tobytes(), np.array(ids, "<u4").tobytes()]
    return _MAGIC + struct.pack("<5Q", len(states), len(labels), len(words), len(ids), root) + b"".join(parts)


class Lexicon:
    """A compiled automaton over any buffer: a memory-mapped file, or bytes."""

    def __init__(self, buffer):
        view = memoryview(buffer)
        if bytes(view[:8]) != _MAGIC:
            raise ValueError("not a lexicon")
        n_states, n_arcs, self.words, n_ids, self.root = struct.unpack_from("<5Q", view, 8)
        at = 48

        def take(kind: str, n: int):
            nonlocal at
            size = struct.calcsize(kind) * n
            part = view[at : at + size].cast(kind)
            at += size
            return part

        self.first, self.final, self.labels = take("I", n_states + 1), take("B", n_states), take("B", n_arcs)
        self.targets, self.outs, self.starts, self.ids = take("I", n_arcs), take("I", n_arcs), take("I", self.words + 1), take("I", n_ids)
        self.states, self.arcs = n_states, n_arcs

    def get(self, word: str) -> list[int] | None:
        state, number = self.root, 0
        for b in word.encode("utf-8", "surrogateescape"):
            lo, hi = self.first[state], self.first[state + 1]
            while lo < hi:
                mid = (lo + hi) // 2
                if self.labels[mid] < b:
                    lo = mid + 1
                else:
                    hi = mid
            if lo == self.first[state + 1] or self.labels[lo] != b:
                return None
            number += self.outs[lo]
            state = self.targets[lo]
        return self.ids[self.starts[number] : self.starts[number + 1]].tolist() if self.final[state] else None


_lexicons: dict[str, Lexicon] = {}


def lexicon(path: str) -> Lexicon:
    """The lexicon of a file in the shared folder, memory-mapped where the folder is mounted."""
    if path not in _lexicons:
        from pyarrow import fs

        files, local = filesystem(path)
        if isinstance(files, fs.LocalFileSystem):
            with open(local, "rb") as f:
                buffer = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        else:
            with files.open_input_file(local) as f:
                buffer = f.read()
        _lexicons.clear()
        _lexicons[path] = Lexicon(buffer)
    return _lexicons[path]


# ---------------------------------------------------------------- exact merging


def _known(spec: dict) -> bool:
    """Whether the fast path may cut a file's texts into words; a file that WordBpe can't stand for raises."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    steps = before.get("pretokenizers", [before])
    last = steps[-1]
    other = [x for x in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(x)]
    by_bytes = last.get("type") == "ByteLevel" and not last.get("add_prefix_space", True)
    marked = [t["content"] for t in spec.get("added_tokens") or [] if t.get("single_word") or t.get("lstrip") or t.get("rstrip") or t.get("normalized")]
    if model.get("type") != "BPE" or other or not by_bytes or spec.get("decoder") or marked:
        raise ValueError(f"not a plain word-level BPE over bytes: {other or marked or [model.get('type'), last.get('type'), spec.get('decoder')]}")
    first = steps[0] if len(steps) == 2 else {}
    usual = (first.get("type"), first.get("pattern"), first.get("behavior"), first.get("invert")) == ("Split", {"Regex": _PATTERN}, "Removed", True)
    return bool(usual and not last.get("use_regex", True) and spec.get("normalizer") == _NORMAL)


class WordBpe:
    """A word-level BPE tokenizer file: its words, its merges, its decoding.

    Words come from the library's normalizer and pre-tokenizer, or from one expression where the file has the pattern
    that it stands for and the text no character that the library alone classifies.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.fast = _known(spec)
        model = spec["model"]
        self.vocab = model["vocab"]
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.rank = {p: k for k, p in enumerate(pairs)}
        self.suffix = model.get("end_of_word_suffix") or ""
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        self.symbols = byte_symbols()
        self.path = path
        self._added = re.compile("|".join(re.escape(a) for a in sorted(self.added, key=len, reverse=True))) if self.added else None

    def words(self, text: str) -> list[str | int]:
        """The words of a text in order; an added token's string gives its id."""
        if self._added and self._added.search(text):
            out: list[str | int] = []
            at = 0
            for m in self._added.finditer(text):
                out += self._plain(text[at : m.start()])
                out.append(self.added[m.group()])
                at = m.end()
            return out + self._plain(text[at:])
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if self.fast and not _RARE.search(text):
            return _WORDS.findall(text.lower())
        library = tokenizer(self.path)
        back = {s: b for b, s in enumerate(self.symbols)}
        pieces = library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(text) if library.normalizer else text)
        return [bytes(back[c] for c in p).decode("utf-8", "surrogateescape") for p, _ in pieces]

    def merge(self, word: str) -> list[int]:
        """Ids of a word by its merges in rank order."""
        s = [self.symbols[b] for b in word.encode("utf-8", "surrogateescape")]
        if not s:
            return []
        s[-1] += self.suffix
        s = self._merge_long(s) if len(s) > 64 else self._merge_short(s)
        return [self.vocab[x] for x in s]

    def _merge_short(self, s: list[str]) -> list[str]:
        get, none = self.rank.get, len(self.rank)
        ranks = [get(p, none) for p in zip(s, s[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            k = ranks.index(best)
            s[k] += s.pop(k + 1)
            del ranks[k]
            if k < len(ranks):
                ranks[k] = get((s[k], s[k + 1]), none)
            if k:
                ranks[k - 1] = get((s[k - 1], s[k]), none)
        return s

    def _merge_long(self, s: list[str]) -> list[str]:
        """The same order (lowest rank, then leftmost) from a heap over a linked list."""
        n = len(s)
        left, right, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        heap = [(self.rank[p], k, *p) for k, p in enumerate(zip(s, s[1:])) if p in self.rank]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            to = right[k]
            if not alive[k] or to >= n or s[k] != a or s[to] != b:
                continue
            s[k], alive[to], right[k] = a + b, False, right[to]
            if right[k] < n:
                left[right[k]] = k
            for x in (left[k], k):
                if x >= 0 and right[x] < n and (p := (s[x], s[right[x]])) in self.rank:
                    heapq.heappush(heap, (self.rank[p], x, *p))
        return [x for x, live in zip(s, alive) if live]

    def decode(self, ids) -> str:
        """Token strings joined by one blank, added tokens kept."""
        return " ".join(self.token[i] for i in ids)


_models: dict[str, WordBpe] = {}


def word_bpe(path: str) -> WordBpe:
    if path not in _models:
        _models[path] = WordBpe(path)
    return _models[path]


# ---------------------------------------------------------------- on a cluster


def frequent_words(docs: DataFrame, tokenizer_path: str, most: int = 65_536, least_share: float = 4e-6, text_col: str = "text") -> DataFrame:
    """The `most` most frequent words. Every word of every text is counted where it is read; a task passes on the
    words that make least_share of its own words at least, so what is shuffled is at most 1 / least_share rows a
    task, and every word with that share of the whole passes in some task."""
    def count(batches):
        model, seen = word_bpe(tokenizer_path), Counter()
        total = dropped = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                own = [w for w in model.words(text) if isinstance(w, str)] if text else []
                seen.update(own)
                total += len(own)
            if len(seen) > 1 << 19:  # lossy counting: below the threshold even with all that was dropped before
                dropped = max(dropped, int(total * least_share / 2))
                seen = Counter({w: c for w, c in seen.items() if c > dropped})
        kept = [(w, c) for w, c in seen.items() if c + dropped >= total * least_share]
        for k in range(0, len(kept), 10_000):
            part = kept[k : k + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([w.encode("utf-8", "surrogateescape") for w, _ in part], pa.binary()), pa.array([c for _, c in part], pa.int64())], ["word", "n"])

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "word binary, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most)


def build_lexicon(docs: DataFrame, tokenizer_path: str, most: int = 65_536, text_col: str = "text") -> str:
    """Compile the frequent words (`most` at most come to the driver) into a file of the shared folder; its path."""
    model = word_bpe(tokenizer_path)
    rows = frequent_words(docs, tokenizer_path, most, text_col=text_col).collect()
    words = [bytes(r["word"]).decode("utf-8", "surrogateescape") for r in rows]
    data = compile_lexicon({w: model.merge(w) for w in words if not any(0xD800 <= ord(c) <= 0xDFFF for c in w)})
    path = new_folder(docs.sparkSession, "lexicon")
    files, base = filesystem(path)
    files.create_dir(base, recursive=True)
    with files.open_output_stream(f"{base}/words.madt") as f:
        f.write(data)
    return f"{path}/words.madt"


_memos: dict[str, Generations] = {}


def memo_of(path: str) -> Generations:
    """This worker's memo of words for a lexicon; tasks that follow one another share it."""
    if path not in _memos:
        _memos.clear()
        _memos[path] = Generations(1 << 18)
    return _memos[path]


ENCODED = "id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_decode(docs: DataFrame, tokenizer_path: str, keep_ids: bool = False, most: int = 65_536, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256, decoded_sha256, and ids (array) and decoded text on request.

    Words are looked up in the memory-mapped lexicon once per worker, then in its bounded memo; words the lexicon
    lacks are merged exactly. Null and empty texts have no tokens and the digests of empty strings. Repeated rows give
    a row each; an empty table gives none; other columns are not read. A text is held whole, a batch is not.
    """
    import hashlib

    spark = docs.sparkSession
    small_arrow_batches(spark)
    path = build_lexicon(docs, tokenizer_path, most, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = ENCODED.format(kind=kind) + (", ids array<int>, decoded string" if keep_ids else "")

    def encode(batches):
        model, words = word_bpe(tokenizer_path), lexicon(path)
        memo = memo_of(path)

        def known(word):
            ids = [word] if isinstance(word, int) else words.get(word)
            if ids is None:
                ids = model.merge(word)
            return " ".join(map(str, ids)), model.decode(ids)

        for batch in batches:
            out: list[tuple] = []
            memo.turn()
            for text in batch.column(1).to_pylist():
                own = model.words(text) if text else []
                found = list(map(memo.get, own))
                if None in found:
                    for w in memo.recall({w for w, f in zip(own, found) if f is None}):
                        memo[w] = known(w)
                    found = list(map(memo.__getitem__, own))
                ids, decoded = " ".join([f[0] for f in found]), " ".join([f[1] for f in found])
                row = (ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                out.append(row + (([int(x) for x in ids.split()], decoded) if keep_ids else ()))
            columns = list(zip(*out)) if out else [[] for _ in range(3 + 2 * keep_ids)]
            types = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
            names = ["n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], ["id", *names[: len(columns)]])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(encode, schema).withColumnRenamed("id", id_col)
