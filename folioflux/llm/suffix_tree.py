"""LM scoring with a probabilistic suffix tree over words.

Symbols are all words of the training texts and the end. Contexts of up to DEPTH symbols that occur LEAST times in
training are candidates; one is retained if its next-symbol distribution diverges from that of its suffix by more than
a likelihood-ratio (BIC) test allows, and then its suffixes are states too. A state's distribution is smoothed towards
its suffix's (Witten-Bell), the root's is the smoothed unigram. A token is scored in the longest suffix of its history
that is a state.

The tree is never in one place. Blocks of texts ask and tasks that own a range of 64-bit keys answer, in rounds: counts
of words; of pairs; of grams of each greater depth if their context is a candidate; each candidate's sums for the test;
and which contexts are suffixes of retained ones. A block sends its distinct keys, packed, and gets the corpus values of
just these back, so nothing that grows with the corpus is broadcast or collected, and words and states grow with the
corpus. Of the blocks that hold a gram in training the first owns it and adds its term to its context's sums.
"""

from __future__ import annotations

import contextlib
import ctypes
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflux.llm.kernels import mix, text_buffers, word_hashes
from folioflux.llm.shared import kept, small_arrow_batches

#: Occurrences in training that make a context a candidate
LEAST, DEPTH = 2, 3
BITS = 10
BLOCK_BYTES = 7 << 20
END_HASH = np.uint64(0x454E44)
#: The context of two or more ends, where a text begins; the largest key
START = np.uint64(2**64 - 1)
#: Kinds of questions: counts of grams of each depth (0: words), tests of contexts of each depth, suffixes of states
GRAMS, TESTS, SUFFIXES = [[a + d for d in range(DEPTH + 1)] for a in (0, 100, 200)]
#: What is asked together, and the answers of earlier rounds that it needs: a test needs the grams up to its depth, the
#: suffixes all tests and the grams whose counts are contexts'. The first test goes with the second grams; later ones
#: go alone, as both their messages would be on disk at once.
ROUNDS = [
    ([GRAMS[0]], []),
    ([GRAMS[1]], []),
    ([TESTS[1], GRAMS[2]], GRAMS[:2]),
    *(([GRAMS[d]], GRAMS[:d]) for d in range(3, DEPTH + 1)),
    *(([TESTS[d]], GRAMS[: d + 1]) for d in range(2, DEPTH + 1)),
    (SUFFIXES[1:DEPTH], [*GRAMS[:DEPTH], *TESTS[1:]]),
]
#: The test's terms are summed as integers, this many to 1, so that sums do not depend on the blocks.
UNIT = 1 << 12
_BLOCK = [("block", pa.int64()), ("round", pa.int32()), ("part", pa.int32()), ("blob", pa.binary()), ("counts", pa.binary()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64()))]
BLOCK = "block long, round int, part int, blob binary, counts binary, ids array<long>, held array<boolean>, sizes array<long>"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(zip(*rows), _BLOCK)], [n for n, _ in _BLOCK])


def block_row(number: int, rows: list[tuple[bytes, int | None, bool]]) -> pa.RecordBatch:
    """A block of texts (text, id, held out): its distinct words' keys, where each token's stands among them, and the
    texts' ids, flags and numbers of tokens. Words are hashed once; the rounds read their places."""
    words, ptr = tokens([r[0] for r in rows])
    keys, at = distinct(words)
    return _rows([(number, -1, -1, _squeezed(np.diff(keys, prepend=np.uint64(0))), _squeezed(at.astype("<u4")), [r[1] for r in rows], [r[2] for r in rows], np.diff(ptr).tolist())])


def pack(batches):
    """Blocks of about BLOCK_BYTES of text."""
    from pyspark import TaskContext

    number, held, size = TaskContext.get().partitionId() << 32, [], 0
    for batch in batches:
        data, at = text_buffers(batch.column(1))
        for i, (doc, flag) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
            text = data[at[i] : at[i + 1]].tobytes()
            if held and size + len(text) > BLOCK_BYTES:
                number += 1
                yield block_row(number, held)
                held, size = [], 0
            held.append((text, doc, bool(flag)))
            size += len(text)
    if held:
        yield block_row(number + 1, held)
    give_back()


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of texts, each text's end included, and their offsets."""
    words, ptr = word_hashes(pa.array(texts, pa.large_binary()))
    n = len(ptr) - 1
    out = np.full(len(words) + n, END_HASH, np.uint64)
    out[np.arange(len(words)) + np.repeat(np.arange(n), np.diff(ptr))] = words
    return out, ptr + np.arange(n + 1)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and where each key stands among them.

    One plain sort: each key's low bits give way to its place. Where that leaves the keys out of order, as two differ in
    these bits alone, a stable sort of their places follows.
    """
    if not len(keys):
        return keys, np.zeros(0, np.int32)
    low = np.uint64((1 << len(keys).bit_length()) - 1)
    order = keys & ~low
    order |= np.arange(len(keys), dtype=np.uint64)
    order.sort()
    order &= low
    order = order.view(np.int64)
    own = keys[order]
    if (own[1:] < own[:-1]).any():
        order = np.argsort(keys, kind="stable")
        own = keys[order]
    new = np.ones(len(own), bool)
    new[1:] = own[1:] != own[:-1]
    found = own[new]
    del own
    ranks = np.cumsum(new, dtype=np.int32)
    ranks -= 1
    at = np.empty(len(ranks), np.int32)
    at[order] = ranks
    return found, at


def give_back() -> None:
    """Freed memory goes back to the system (glibc keeps it else): a worker that waits holds none of its last block's."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


@lru_cache(maxsize=1)
def _zstd() -> tuple:
    """One compressor and one decompressor a process: messages are many, and each of these sets up tables."""
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _squeezed(values: np.ndarray) -> bytes:
    """The values in as few bytes each as they need, those of one significance together, compressed; the width first."""
    low, high = (int(values.min()), int(values.max())) if values.size else (0, 0)
    width = next((w for w in (1, 2, 4) if -(1 << 8 * w - 1) <= low and high < 1 << 8 * w - 1), values.itemsize)
    flat = np.ascontiguousarray(values).reshape(-1)
    flat = flat.astype(f"<i{width}") if width < values.itemsize else flat
    planes = flat.view(np.uint8).reshape(-1, width).T
    return bytes([width]) + _zstd()[0].compress(planes.tobytes())


def _opened(blob: bytes, kind: str) -> np.ndarray:
    width, wide = blob[0], np.dtype(kind).itemsize
    planes = np.frombuffer(_zstd()[1].decompress(memoryview(blob)[1:]), np.uint8)
    flat = np.ascontiguousarray(planes.reshape(width, -1).T).reshape(-1)
    return flat.view(f"<i{width}").astype(kind) if width < wide else flat.view(kind)


def _spread(block: int, kind: int, keys: np.ndarray, counts: np.ndarray, parts: int) -> list[tuple]:
    """Sorted keys and their values (a row, or several) cut at the bounds of `parts` equal ranges; keys as differences."""
    own = (keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
    cuts = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(own)]])
    return [(block, kind, int(own[a]), _squeezed(np.diff(keys[a:b], prepend=np.uint64(0))), _squeezed(counts[..., a:b]), None, None, None) for a, b in zip(cuts[:-1], cuts[1:]) if b > a]


def _groups(batches, *names: str):
    """Rows that share the named columns, as lists, of sorted rows."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and any(held[0][c] != row[c] for c in names):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def answer(batches):
    """For each part, kind and block the corpus values of the block's keys; of words the part's totals too (block null).

    A count comes doubled, plus 1 for the first block that adds to it; a test as the number of kinds of next symbols,
    negative where it fails.
    """
    for rows in _groups(batches, "part", "round"):
        kind, each = rows[0]["round"], [np.cumsum(_opened(r["blob"], "<u8"), dtype=np.uint64) for r in rows]
        keys, where = distinct(np.concatenate(each))
        where = np.split(where, np.cumsum([len(e) for e in each])[:-1])
        if kind in TESTS[1:]:
            gain, kinds = np.zeros((2, len(keys)), np.int64)
            for r, at in zip(rows, where):
                own = _opened(r["counts"], "<i8").reshape(2, -1)  # a row's keys are distinct
                gain[at] += own[0]
                kinds[at] += own[1]
            total = kinds * np.where(gain > 0, 1, -1)
            values = [total[at] for at in where]
        else:
            own = [_opened(r["counts"], "<u4") for r in rows]
            total, first = np.zeros(len(keys), np.int64), np.full(len(keys), -1)
            for k in range(len(rows) - 1, -1, -1):
                total[where[k]] += own[k]
                first[where[k][own[k] > 0]] = k
            values = [2 * total[at] + (first[at] == k) for k, at in enumerate(where)]
        for k in range(0, len(rows), 16):
            yield _rows([(r["block"], kind, r["part"], None, _squeezed(x.astype("<i8")), None, None, None) for r, x in zip(rows[k : k + 16], values[k : k + 16])])
        if kind == GRAMS[0]:
            yield _rows([(None, kind, rows[0]["part"], None, None, None, None, [int(total.sum()), int((total > 0).sum())])])


def _narrow(values: np.ndarray) -> np.ndarray:
    return values.astype(np.int32) if values.max(initial=0) < 1 << 31 else values


class Block:
    """The tokens of a block's texts, and what the rounds answered so far say of them."""

    def __init__(self, rows: list[dict], done=(), n: int = 0, v: int = 0, last: bool = False):
        """rows: the texts and then the answers to the kinds `done`, by kind and part; n, v: training tokens and words of
        the corpus. Of the grams `done` has all up to a depth, of the tests all or none. last: no grams are asked for after."""
        self.text, said = rows[0], {k: [] for k in done}
        for r in rows[1:]:
            said[r["round"]].append(r.pop("counts"))
        keys, at = np.cumsum(_opened(self.text["blob"], "<u8"), dtype=np.uint64), _opened(self.text["counts"], "<u4").astype(np.int32)
        sizes = np.array(self.text["sizes"], np.int64)
        self.words, self.ptr = keys[at], np.concatenate([[0], np.cumsum(sizes)])
        self.train = np.repeat(~np.array(self.text["held"], bool), sizes)
        self.n, self.v = n, v
        opened = lambda k: np.concatenate([np.zeros(0, "<i8"), *(_opened(x, "<i8") for x in said.pop(k))])
        self.keys, self.at, self.grams = [keys], [at], self.words
        self.counts, self.totals, self.first, self.kinds, self.states, self.failed = [], [None], [], [None], [None], [None]
        for d in (d for d in range(DEPTH + 1) if GRAMS[d] in done):
            self.level(d)
            value = np.append(opened(GRAMS[d]), 0)  # the last for tokens whose gram is not asked for, at -1
            self.counts.append(_narrow(value >> 1)[self.at[d]])
            self.first.append((value & 1).astype(bool))
            ends = self.counts[0][self.ptr[1:] - 1].max()
            self.totals.append(self.before(self.counts[d], ends))
            if d == 0:
                self.base = (self.counts[0] + 0.1) / (n + 0.1 * (v + 1))
        if last:
            del self.words, self.grams
        for d in (d for d in range(1, DEPTH + 1) if TESTS[d] in done):
            kinds = self.of_contexts(d, self.totals[d] >= LEAST, opened(TESTS[d]))
            self.kinds.append(_narrow(np.abs(kinds)))
            self.states.append(kinds > 0)
            self.failed.append(kinds < 0)
        for d in (d for d in range(1, DEPTH) if SUFFIXES[d] in done):
            self.states[d] |= self.of_contexts(d, self.failed[d], opened(SUFFIXES[d])) > 1

    def before(self, values: np.ndarray, start) -> np.ndarray:
        """The value of the token before each; `start` where a text begins."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.ptr[:-1]] = start
        return out

    def level(self, d: int) -> np.ndarray:
        """The tokens whose grams of depth d (with the d tokens before) are asked for: a gram with an unseen suffix is
        unseen too. Keeps the distinct keys of these grams and where each token's stands among them (else -1)."""
        if d == 0:
            return np.ones(len(self.words), bool)
        context = self.before(self.grams, END_HASH if d == 1 else START)
        self.grams = mix(context * np.uint64(0xD6E8FEB86659FD93) ^ self.words * np.uint64(0x9E3779B97F4A7C15) + np.uint64(d))
        mask = np.ones(len(self.words), bool) if d == 1 else (self.totals[d] >= LEAST) & (self.counts[d - 1] > 0)
        keys, own = distinct(self.grams[mask])
        self.keys.append(keys)
        at = np.full(len(self.words), -1, np.int32)
        at[mask] = own
        self.at.append(at)
        return mask

    def contexts(self, d: int, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys of the masked tokens' contexts of depth d, and where each masked token's stands: a context is the
        gram of the token before, so its place is known."""
        above = self.keys[d - 1]
        at = self.before(self.at[d - 1], self.at[0][-1] if d == 1 else len(above))[mask]  # the last token is an end
        held = np.zeros(len(above) + 1, bool)
        held[at] = True
        return np.append(above, START)[held], (np.cumsum(held) - 1)[at]

    def of_contexts(self, d: int, mask: np.ndarray, found: np.ndarray) -> np.ndarray:
        """The answers to the masked tokens' contexts, 0 elsewhere."""
        out = np.zeros(len(self.train), np.int64)
        if len(found):
            out[mask] = found[self.contexts(d, mask)[1]]
        return out

    def question(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys to ask, and what this block adds to each."""
        if kind in GRAMS:
            mask = self.level(kind) & self.train
            return self.keys[kind], np.bincount(self.at[kind][mask], minlength=len(self.keys[kind])).astype("<u4")
        if kind in TESTS:
            d = TESTS.index(kind)
            mask = self.totals[d] >= LEAST
            keys, where = self.contexts(d, mask)
            own = np.flatnonzero((self.train & self.first[d][self.at[d]])[mask])
            tokens_ = np.flatnonzero(mask)[own]
            one = np.full(len(self.keys[d]), -1)
            one[self.at[d][tokens_]] = np.arange(len(own))
            one = one[one >= 0]  # one place of each gram that this block owns
            at, first = where[own[one]], tokens_[one]
            count, total = self.counts[d][first].astype(float), self.totals[d][first].astype(float)
            above = self.base[first] if d == 1 else self.counts[d - 1][first] / self.totals[d - 1][first]
            out = np.zeros((2, len(keys)), "<i8")
            np.add.at(out[0], at, np.rint(UNIT * (2 * count * np.log(count / total / above) - np.log(total))).astype(np.int64))
            out[1] = np.bincount(at, minlength=len(keys))
            return keys, out
        d = SUFFIXES.index(kind)
        below = np.logical_or.reduce(self.states[d + 1 :])
        keys, where = self.contexts(d, self.failed[d])
        return keys, (np.bincount(where[below[self.failed[d]]], minlength=len(keys)) > 0).astype("<u4")

    def scores(self) -> pa.RecordBatch:
        p = self.base
        for d in range(1, DEPTH + 1):
            kinds = self.kinds[d]
            p = np.where(self.states[d], (self.counts[d] + kinds * p) / np.maximum(self.totals[d] + kinds, 1), p)
        sums = [np.add.reduceat(x, self.ptr[:-1]) for x in (np.log10(self.base), np.log10(p), (self.counts[0] > 0).astype(np.int64))]
        sizes = np.diff(self.ptr)
        return pa.RecordBatch.from_arrays(
            [pa.array(self.text["ids"], pa.int64()), pa.array(self.text["held"], pa.bool_()), pa.array(sizes), pa.array(sums[2]), pa.array(np.full(len(sizes), self.n, np.int64)), pa.array(sums[0]), pa.array(sums[1])],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )


def ask(kinds: list[int], done: list[int], parts: int, n: int = 0, v: int = 0):
    def questions(batches):
        for rows in _groups(batches, "block"):
            block = Block(rows, done, n, v, not set(kinds) & set(GRAMS))
            for kind in kinds:
                found = _spread(rows[0]["block"], kind, *block.question(kind), parts)
                if found:
                    yield _rows(found)
            del block, rows, found
            give_back()

    return questions


class Tree:
    """The same tree in one process, for up to 1 << BITS symbols: the form that tests hold the rounds against.

    States are sorted by key (depth above the history's bits), with log10 ratios to the root and back-off weights.
    """

    def __init__(self, root: np.ndarray, counted: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        """root: probability of each symbol; counted: for depth 1.. the arrays history, next symbol, count."""
        wide = len(root)
        keep: set[int] = set()
        tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        plain = [{0: root}]
        for d, (history, nxt, n) in enumerate(counted, 1):
            order = np.lexsort((nxt, history))
            history, nxt, n = history[order], nxt[order], n[order].astype(float)
            bounds = np.flatnonzero(np.concatenate([[True], history[1:] != history[:-1]])) if len(history) else np.zeros(0, int)
            here: dict[int, np.ndarray] = {}
            for a, b in zip(bounds, [*bounds[1:], len(history)]):
                h = int(history[a])
                above = plain[d - 1].get(h & ((1 << BITS * (d - 1)) - 1))
                if above is None:
                    continue
                total = n[a:b].sum()
                own = np.zeros(wide)
                own[nxt[a:b]] = n[a:b] / total
                here[h] = own
                tables[d << 60 | h] = (nxt[a:b], n[a:b])
                gain = 2 * (n[a:b] * np.log(own[nxt[a:b]] / np.maximum(above[nxt[a:b]], 1e-300))).sum()
                if gain > (b - a) * np.log(total):
                    keep.update(e << 60 | h & ((1 << BITS * e) - 1) for e in range(1, d + 1))
            plain.append(here)
        self.states = np.array(sorted(keep), np.int64)
        place = {s: i for i, s in enumerate(self.states.tolist())}
        smooth: list[np.ndarray] = []
        pairs, values, self.up, self.weight = [], [], np.full(len(place) + 1, -1), np.zeros(len(place) + 1)
        for s, i in place.items():  # shallow states come first
            d = s >> 60
            parent = place.get((d - 1) << 60 | s & ((1 << BITS * (d - 1)) - 1), -1) if d > 1 else -1
            above = root if parent < 0 else smooth[parent]
            nxt, n = tables[s]
            total, kinds = n.sum(), len(n)
            own = above * (kinds / (total + kinds))
            own[nxt] += n / (total + kinds)
            smooth.append(own)
            self.up[i], self.weight[i] = parent, np.log10(kinds / (total + kinds))
            pairs.append(i << BITS | nxt.astype(np.int64))
            values.append(np.log10(own[nxt] / root[nxt]))
        self.pairs = np.concatenate(pairs) if pairs else np.zeros(0, np.int64)
        self.values = np.concatenate(values) if values else np.zeros(0)

    def gains(self, histories: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """log10 of each token's symbol probability in its longest suffix state over that of the root."""
        out = np.zeros(len(symbols))
        if not len(self.states):
            return out
        state = np.full(len(symbols), -1)
        for d in range(DEPTH, 0, -1):
            open_ = np.flatnonzero(state < 0)
            key = d << 60 | histories[open_] & ((1 << BITS * d) - 1)
            at = np.minimum(np.searchsorted(self.states, key), len(self.states) - 1)
            state[open_] = np.where(self.states[at] == key, at, -1)
        live = np.flatnonzero(state >= 0)
        while len(live):
            key = state[live] << BITS | symbols[live]
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            hit = self.pairs[at] == key
            out[live[hit]] += self.values[at[hit]]
            live = live[~hit]
            out[live] += self.weight[state[live]]
            state[live] = self.up[state[live]]
            live = live[state[live] >= 0]
        return out


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows whose crc32(id as text) mod 10 is 0 are held out of training. Null and empty texts are their end alone. Rows
    with a null id train; repeated rows train and are scored once each; if nothing trains, all counts are 0 and the
    score is the base. An empty table gives none; other columns are not read.
    """
    spark = docs.sparkSession
    small_arrow_batches(spark)
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 10 == 0, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), held.alias("held"))
    blocks = kept(rows, pack, BLOCK, "blocks")
    size = blocks.agg(F.count("*").alias("n")).first()["n"]
    if not size:
        return spark.createDataFrame([], SCORES)
    parts = max(4, size // 2)  # a part holds as many keys as two blocks
    by_block = lambda answers: blocks.unionByName(answers).repartition("block").sortWithinPartitions("block", "round", "part")

    def answered(asked: DataFrame) -> DataFrame:
        dealt = asked.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "round", "block")
        return kept(dealt, answer, BLOCK, "answers")

    (first, _), (second, _), *later = ROUNDS
    words = answered(blocks.mapInArrow(ask(first, [], parts), BLOCK))
    n, v = words.where("block is null").agg(F.sum(F.col("sizes")[0]), F.sum(F.col("sizes")[1])).first()
    # words and pairs are asked of texts alone
    known = words.where("block is not null").unionByName(answered(blocks.mapInArrow(ask(second, [], parts), BLOCK)))
    for kinds, needs in later:
        own = by_block(known.where(F.col("round").isin(needs)))
        known = known.unionByName(answered(own.mapInArrow(ask(kinds, needs, parts, n, v), BLOCK)))
    done = [kind for kinds, _ in ROUNDS for kind in kinds]

    def scores(batches):
        for rows in _groups(batches, "block"):
            yield Block(rows, done, n, v, last=True).scores()
            give_back()

    return by_block(known).mapInArrow(scores, SCORES).withColumnRenamed("doc_id", id_col)
