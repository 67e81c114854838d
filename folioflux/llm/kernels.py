"""Array kernels on Arrow text: word hashes and word shingles of whole texts.

Words are hashed from prefix sums of a positional polynomial over bytes, so a batch costs a few passes
of numpy and no Python loop over words. Texts are cut into chunks at separators, so memory is bounded by
the chunk (or by the longest single word), not by the longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK = 1 << 20
_SPACES = [0x20, *range(0x09, 0x0E)]
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: True where a byte belongs to a word `[^\x20\x09-\x0D]+`
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[_SPACES] = False
_rng = np.random.default_rng(20240229)
BYTE_WEIGHTS = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]
SHINGLE = 5
_SLOT = _rng.integers(1, 2**63, 64, dtype=np.uint64) | U64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, CHUNK + 4096), b, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    if where is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(where, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data, at


def _hash_chunk(data: np.ndarray, firsts: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and starts in one chunk; firsts: where texts begin (they end a word)."""
    low = LOWER[data]
    inside = in_word[low]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before[firsts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[firsts[firsts > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    power, inverse = power_tables(len(low) + 1)
    total = np.zeros(len(low) + 1, dtype=np.uint64)
    np.cumsum(BYTE_WEIGHTS[low] * power[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts]), starts


def word_hashes(column, in_word: np.ndarray = NOT_SPACE, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all lower-cased (A-Z) words of a batch of texts, and the offsets of each text's words."""
    data, at = text_buffers(column)
    n = len(at) - 1
    found, counts = [], np.zeros(n, np.int64)
    row, pos = 0, int(at[0])
    while row < n:
        stop = int(np.searchsorted(at, pos + chunk, "right")) - 1
        if stop > row and pos == at[row]:  # whole texts
            lo, hi = int(at[row]), int(at[stop])
            if hi > lo:
                firsts = at[row:stop] - lo
                hashes, starts = _hash_chunk(data[lo:hi], np.unique(firsts[firsts < hi - lo]), in_word)
                found.append(hashes)
                counts[row:stop] += np.diff(np.searchsorted(starts, at[row : stop + 1] - lo))
            row, pos = stop, int(at[stop])
            continue
        hi = end = int(at[row + 1])  # part of one long text: cut at a separator
        if end - pos > chunk:
            reach = chunk
            while True:
                piece = data[pos : min(end, pos + reach)]
                gaps = np.flatnonzero(~in_word[LOWER[piece]])
                if len(gaps) or pos + reach >= end:
                    break
                reach *= 2
            hi = pos + int(gaps[-1]) + 1 if len(gaps) else end
        if hi > pos:
            hashes, _ = _hash_chunk(data[pos:hi], np.zeros(1, np.int64), in_word)
            found.append(hashes)
            counts[row] += len(hashes)
        pos = hi
        if pos >= end:
            row += 1
    ptr = np.zeros(n + 1, np.int64)
    np.cumsum(counts, out=ptr[1:])
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), ptr


def shingles(words: np.ndarray, ptr: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all `size`-word shingles by text, in order; a text of fewer words has its whole sequence as one."""
    n, counts = len(ptr) - 1, np.diff(ptr)
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    made = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    out = np.zeros(n + 1, np.int64)
    np.cumsum(made, out=out[1:])
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    all_at = np.zeros(len(words), np.uint64)
    for k in range(size):
        all_at += padded[k : k + len(words)] * _SLOT[k]
    short = np.flatnonzero((counts > 0) & (counts < size))
    for i in short:
        own = words[ptr[i] : ptr[i + 1]]
        all_at[ptr[i]] = (own * _SLOT[size : size + len(own)]).sum(dtype=np.uint64) + U64(len(own))
    inside = np.arange(len(words)) - np.repeat(ptr[:-1], counts) < np.repeat(made, counts)
    return mix(all_at[inside]), out


def distinct_by_text(values: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text."""
    n = len(ptr) - 1
    owner = np.repeat(np.arange(n), np.diff(ptr))
    order = np.lexsort((values, owner)) if len(values) < 4096 else _sort_by_owner(values, ptr)
    v, o = values[order], owner
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    out = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(o[keep], minlength=n), out=out[1:])
    return v[keep], out


def _sort_by_owner(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    order = np.empty(len(values), np.int64)
    for a, b in zip(ptr[:-1], ptr[1:]):
        order[a:b] = a + np.argsort(values[a:b])
    return order


def arrow_rows(batch: pa.RecordBatch, rows_bytes: int = 1 << 20, column: str = "text"):
    """Slices of a batch whose texts are about rows_bytes at most (one long text may be more)."""
    _, at = text_buffers(batch.column(batch.schema.get_field_index(column)))
    row, n = 0, batch.num_rows
    while row < n:
        stop = max(row + 1, int(np.searchsorted(at, at[row] + rows_bytes, "right")) - 1)
        yield batch.slice(row, min(stop, n) - row)
        row = stop
