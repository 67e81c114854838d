"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Test items are partitioned by the size of their shingle sets, in classes (2^(c-1), 2^c]. A long document is read in
windows of two class sizes, one class size apart, so that for each class an item of that class meets windows of its
own size and the Jaccard similarity of item and window stays high whatever the document's length. One minhash value
in common makes a candidate; the item's containment in the whole document's set is then counted exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from folioflux.llm.kernels import arrow_rows, distinct_by_text, shingles, word_hashes
from folioflux.llm.shared import small_arrow_batches, written

#: At 64 values a window that holds a quarter of an item is missed once in 50 to 1000, one that holds 75 % in 10^5.
HASHES = 64
BLOCK_BYTES = 32 << 20
_odd = np.random.default_rng(11).integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def item_sets(batches):
    """item_id and its sorted shingle set; items without words give nothing."""
    for batch in batches:
        for part in arrow_rows(batch):
            values, ptr = distinct_by_text(*shingles(*word_hashes(part.column(1))))
            full = np.flatnonzero(np.diff(ptr))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(full)), pa.array([values[ptr[i] : ptr[i + 1]].tobytes() for i in full], pa.binary())], ["item_id", "set"])


class ItemIndex:
    """Minhash values of a bounded block of items, by size class and hash, with a 16-bit table before each search."""

    def __init__(self, items: list[tuple[object, bytes]]):
        self.ids = [i for i, _ in items]
        self.sets = [np.frombuffer(s, np.uint64) for _, s in items]
        self.classes: dict[int, tuple[np.ndarray, list, list]] = {}
        sizes = np.array([len(s) for s in self.sets])
        for c in sorted({int(x - 1).bit_length() for x in sizes.tolist()}):
            members = np.flatnonzero((sizes <= 1 << c) & (sizes > (1 << c) // 2))
            sigs = np.stack([(self.sets[m].astype(np.uint32)[:, None] * _odd).min(0) for m in members])
            gates, lists = [], []
            for k in range(HASHES):
                order = np.argsort(sigs[:, k], kind="stable")
                gate = np.zeros(1 << 16, bool)
                gate[sigs[:, k] & 0xFFFF] = True
                gates.append(gate)
                lists.append((sigs[order, k], members[order]))
            self.classes[c] = (members, gates, lists)

    def candidates(self, values: np.ndarray, ptr: np.ndarray) -> set[tuple[int, int]]:
        """Pairs (text, item) with a minhash value in common in some window."""
        found: set[tuple[int, int]] = set()
        counts = np.diff(ptr)
        full = np.flatnonzero(counts)
        if not len(full) or not self.classes:
            return found
        low = values.astype(np.uint32)
        least = min(self.classes)
        plans = []
        for c in range(least, max(self.classes) + 1):
            n = (counts[full] + (1 << c) - 1) >> c
            first = np.zeros(len(n) + 1, np.int64)
            np.cumsum(n, out=first[1:])
            plans.append((c, n, first))
        _, n0, first0 = plans[0]
        inside = np.arange(first0[-1]) - np.repeat(first0[:-1], n0)
        starts = np.repeat(ptr[:-1][full], n0) + (inside << least)
        halves = []
        for (_, n, first), (_, m, above) in zip(plans, plans[1:]):
            own = np.arange(above[-1]) - np.repeat(above[:-1], m)
            left = np.repeat(first[:-1], m) + 2 * own
            last = np.repeat(first[1:], m) - 1
            halves.append((left, np.minimum(left + 1, last)))
        nexts = {c: np.minimum(np.arange(first[-1]) + 1, np.repeat(first[1:], n) - 1) for c, n, first in plans if c in self.classes}
        owner = {c: np.repeat(full, n) for c, n, _ in plans if c in self.classes}
        work = np.empty_like(low)
        for k in range(HASHES):
            np.multiply(low, _odd[k], out=work)
            seg = np.minimum.reduceat(work, starts)
            for at, (c, _, _) in enumerate(plans):
                if at:
                    left, right = halves[at - 1]
                    seg = np.minimum(seg[left], seg[right])
                if c not in self.classes:
                    continue
                _, gates, lists = self.classes[c]
                window = np.minimum(seg, seg[nexts[c]])
                for w in np.flatnonzero(gates[k][window & 0xFFFF]):
                    sig, members = lists[k]
                    a, b = np.searchsorted(sig, window[w]), np.searchsorted(sig, window[w], "right")
                    found.update((int(owner[c][w]), int(m)) for m in members[a:b])
        return found

    def contained(self, texts, least_percent: int) -> list[tuple[int, int, int, int]]:
        """(text, item, shingles of the item in the text, shingles of the item), verified on whole sets."""
        values, ptr = shingles(*word_hashes(texts))
        out, own = [], (-1, None)
        for t, item in sorted(self.candidates(values, ptr)):
            if own[0] != t:
                own = (t, np.unique(values[ptr[t] : ptr[t + 1]]))
            want = self.sets[item]
            at = np.minimum(np.searchsorted(own[1], want), len(own[1]) - 1)
            both = int((own[1][at] == want).sum())
            if 100 * both >= least_percent * len(want):
                out.append((t, item, both, len(want)))
        return out


def _blocks(items: DataFrame, id_col: str, text_col: str) -> list:
    """Broadcast indexes of the items: as many as needed for each to stay near BLOCK_BYTES of shingles."""
    sets = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text"))
    sets = written(sets.mapInArrow(item_sets, f"item_id {items.schema[id_col].dataType.simpleString()}, set binary"), "items")
    size = sets.agg(F.sum(F.length("set")).alias("b")).first()["b"] or 0
    n = max(1, -(-size // BLOCK_BYTES))
    for k in range(n):
        rows = sets.where(F.pmod(F.xxhash64("item_id", "set"), F.lit(n)) == k).collect()
        if rows:
            yield items.sparkSession.sparkContext.broadcast(ItemIndex([(r["item_id"], bytes(r["set"])) for r in rows]))


def find_contained(docs: DataFrame, items: DataFrame, least_percent: int = 75, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document row and item with at least least_percent of the item's distinct 5-word shingles in the
    document: doc_id, item_id, n_matched, n_item, containment.

    Items come in blocks of bounded size, each held by every task for one pass over the documents, so neither side is
    shuffled. Texts of fewer than five words have their whole sequence as one shingle. Null and empty texts and items
    match nothing; repeated rows match each; an empty table on either side gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    small_arrow_batches(spark)
    kinds = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, n_matched long, n_item long, containment double"
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("text"))
    out = spark.createDataFrame([], schema)
    for shared in _blocks(items, item_id, item_text):

        def search(batches, shared=shared):
            index = shared.value
            for batch in batches:
                for part in arrow_rows(batch):
                    hits = index.contained(part.column(1), least_percent)
                    docs_ = part.column(0).take(pa.array([h[0] for h in hits], pa.int64()))
                    ids = pa.array([index.ids[h[1]] for h in hits], out_type)
                    yield pa.RecordBatch.from_arrays([docs_, ids, pa.array([h[2] for h in hits], pa.int64()), pa.array([h[3] for h in hits], pa.int64()), pa.array([h[2] / h[3] for h in hits], pa.float64())], ["doc_id", "item_id", "n_matched", "n_item", "containment"])

        out_type = to_arrow_type(items.schema[item_id].dataType)
        out = out.unionByName(texts.mapInArrow(search, schema))
    return out


def without_contained(docs: DataFrame, items: DataFrame, least_percent: int = 75, doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs that hold no item, all columns as they are; rows are filtered where they are read."""
    small_arrow_batches(docs.sparkSession)
    at = docs.columns.index(doc_text)
    for shared in _blocks(items, item_id, item_text):

        def keep(batches, shared=shared):
            for batch in batches:
                for part in arrow_rows(batch, column=doc_text):
                    mask = np.ones(part.num_rows, bool)
                    mask[[h[0] for h in shared.value.contained(part.column(at), least_percent)]] = False
                    yield part.filter(pa.array(mask))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
