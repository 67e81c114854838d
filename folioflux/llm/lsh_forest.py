"""Near-duplicate documents by an LSH forest: sorted signature orders, longest common prefixes, adaptive depth.

1. Every whole text becomes its set of 5-word shingles; texts with equal sets form a class with one node.
2. A node's signature is TREES x DEPTH minhash values. Tree t orders all nodes by the signature read from its own
   values on; nodes that agree on its first LEAST_DEPTH values form a region. Nodes alone in their region drop out.
3. The orders are range-partitioned and sorted, so a region of any size is spread over tasks. The common prefixes of
   adjacent rows give those of any two rows (their running minimum). Each row takes the rows of its region with the
   longest common prefixes, REACH of them and all ties among the 2 x REACH nearest: in a crowded region these share a
   deep prefix, in a sparse one just LEAST_DEPTH values. Of these candidates a node proposes, over all trees, the
   best-agreeing one and the smallest that agrees very well (so that a large group hangs together by few nodes).
4. Proposals are confirmed on full sets and contracted to components.
5. In regions that still hold several components, the largest one is held against the rest, and the rest against
   itself, block by block: rows of different components whose signatures agree are confirmed on full sets, each pair
   in the first tree where it meets. Only links that join components leave the task. So nothing that step 3 passed
   over is lost, no list of pairs is made, and a region costs (rows outside its largest component) x (rows).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflux.llm.components import components
from folioflux.llm.kernels import arrow_rows, distinct_by_text, mix, shingles, word_hashes
from folioflux.llm.shared import BROADCAST_ROWS, bounded, small_arrow_batches, written

TREES, DEPTH, LEAST_DEPTH = 20, 6, 3
WIDTH = TREES * DEPTH
#: Signature values that must agree for a confirmation: at similarity 0.75 the mean is 90 of 120, 3.8 deviations above.
AGREE = 72
#: Values that agree where a similarity of 0.75 is hardly in doubt
SURE = 96
#: Rows with the longest common prefixes that a row looks at in each tree
REACH = 8
BLOCK = 512
_odd = np.random.default_rng(7).integers(0, 2**31, WIDTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SIGNED = [("doc_id", pa.int64()), ("digest", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("keys", pa.list_(pa.int64())), ("sig", pa.binary())]
SIGNED = "doc_id long, digest long, n_shingles long, node long, keys array<long>, sig binary"


def _sets(text_column) -> tuple[np.ndarray, np.ndarray, list[int | None]]:
    """Sorted distinct shingles of each text, their offsets, and a 63-bit digest of each set (None: empty)."""
    values, ptr = distinct_by_text(*shingles(*word_hashes(text_column)))
    nodes = [int.from_bytes(hashlib.blake2b(values[a:b].tobytes(), digest_size=8).digest()) >> 1 if b > a else None for a, b in zip(ptr[:-1], ptr[1:])]
    return values, ptr, nodes


def minhashes(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """WIDTH smallest values of each non-empty set under multiplications modulo 2^32; rows of empty sets are 0."""
    counts = np.diff(ptr)
    full = np.flatnonzero(counts)
    out = np.zeros((len(counts), WIDTH), np.uint32)
    if len(full):
        low, starts = values.astype(np.uint32), ptr[:-1][full]
        work = np.empty_like(low)
        for k in range(WIDTH):
            np.multiply(low, _odd[k], out=work)
            out[full, k] = np.minimum.reduceat(work, starts)
    return out


def sign(batches):
    for batch in batches:
        for part in arrow_rows(batch):
            values, ptr, nodes = _sets(part.column(1))
            sigs = minhashes(values, ptr)
            heads = sigs.reshape(-1, TREES, DEPTH)[:, :, :LEAST_DEPTH].astype(np.uint64)
            key = np.arange(TREES, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
            for d in range(LEAST_DEPTH):
                key = mix(key ^ heads[:, :, d] * np.uint64(0xD6E8FEB86659FD93))
            has = [n is not None for n in nodes]
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(nodes) + 1) * TREES, pa.int32()), pa.array(key.astype(np.int64).ravel()), mask=pa.array([not x for x in has]))
            small = (sigs & 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(np.diff(ptr)), pa.array(nodes, pa.int64()), keys, pa.array([small[i].tobytes() if x else None for i, x in enumerate(has)], pa.binary())], [n for n, _ in _SIGNED])


def _whole(batches, name: str):
    """Batches cut so that each holds all rows of its last key (column `name`), for input sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
        same = bool(held) and held[-1].column(batch.schema.get_field_index(name))[-1].as_py() == key[0]
        if held and not same:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        last = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks().to_batches()[0]
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    if name == "sig":
        return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, WIDTH)
    if name == "keys":
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, TREES)
    return column.to_numpy(zero_copy_only=False)


PAIRS = "a long, b long"


def _pairs(a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(a, np.int64)), pa.array(np.asarray(b, np.int64))], ["a", "b"])


def prefixes(run: np.ndarray, sig: np.ndarray, reach: int) -> np.ndarray:
    """Common prefix lengths of each sorted row with those `reach` before and after it (rows x 2 reach; 0: no such row
    or another region): the running minimum of the lengths of adjacent rows."""
    n = len(run)
    equal = sig[1:] == sig[:-1]
    adjacent = np.where(equal.all(1), WIDTH, equal.argmin(1)) * (run[1:] == run[:-1])
    out = np.zeros((n, 2 * reach), np.int16)
    least = adjacent
    for off in range(1, min(reach, n - 1) + 1):
        if off > 1:
            least = np.minimum(least[:-1], adjacent[off - 1 :])
        out[off:, reach - off] = least
        out[: n - off, reach + off - 1] = least
    return out


PROPOSED = "node long, sure long, best long, agree long"
_FAR = np.iinfo(np.int64).max


def propose(batches):
    """For each sorted row its best-agreeing candidate and the smallest that is SURE; rows with neither give nothing.

    Candidates are the rows with the longest common prefixes: at least REACH of the nearest 2 x REACH, all ties too.
    """
    tail = None
    for batch in batches:
        if not batch.num_rows:
            continue
        run, sig, node = (_column(batch, c) for c in ("run", "sig", "node"))
        if tail is not None:
            run, sig, node = (np.concatenate(x) for x in zip(tail, (run, sig, node)))
        tail = tuple(x[-REACH:] for x in (run, sig, node))
        length = prefixes(run, sig, REACH)
        depth = np.maximum(np.sort(length, axis=1)[:, REACH], LEAST_DEPTH)  # of each row's region, as deep as it is crowded
        best, agreed, sure = (np.full(len(run), x, np.int64) for x in (_FAR, 0, _FAR))
        for k in range(2 * REACH):
            off = k - REACH if k < REACH else k - REACH + 1
            at = np.flatnonzero(length[:, k] >= depth)
            agree = (sig[at] == sig[at + off]).sum(1)
            at, agree = at[agree >= AGREE], agree[agree >= AGREE]
            other = node[at + off]
            better = (agree > agreed[at]) | (agree == agreed[at]) & (other < best[at])
            best[at[better]], agreed[at[better]] = other[better], agree[better]
            high = at[agree >= SURE]
            sure[high] = np.minimum(sure[high], other[agree >= SURE])
        found = np.flatnonzero(agreed)
        yield pa.RecordBatch.from_arrays([pa.array(node[found]), pa.array(sure[found], mask=sure[found] == _FAR), pa.array(best[found]), pa.array(agreed[found])], ["node", "sure", "best", "agree"])


def _apart(col: dict[str, np.ndarray], a: int, b: int):
    """For each row of a slot the rows of another component that agree with it, in the first tree where the two share a
    region. A slot holds two blocks (sides) to be held against each other, or one: then rows of its largest component
    are only held against the others."""
    node, sig, comp, side, keys = (col[c][a:b] for c in ("node", "sig", "comp", "side", "keys"))
    tree, two = col["tree"][a], bool((side != side[0]).any())
    if two:
        last = side == 1
    else:
        kinds, which, counts = np.unique(comp, return_inverse=True, return_counts=True)
        if len(kinds) == 1:
            return
        last = which == counts.argmax()
    order = np.argsort(last, kind="stable")
    node, sig, comp, keys = node[order], sig[order], comp[order], keys[order]
    pivots = int((~last).sum())
    for i in range(pivots):
        start = pivots if two else i + 1
        rest = start + np.flatnonzero(comp[start:] != comp[i])
        rest = rest[(sig[rest] == sig[i]).sum(1) >= AGREE]
        rest = rest[(keys[rest] == keys[i]).argmax(1) == tree]
        if len(rest):
            yield order[i], order[rest]


def _slots(batches):
    for batch in _whole(batches, "run"):
        col = {c: _column(batch, c) for c in ("run", "tree", "side", "node", "comp", "sig", "keys")}
        cuts = np.flatnonzero(col["run"][1:] != col["run"][:-1]) + 1
        yield batch, col, list(zip([0, *cuts], [*cuts, len(col["run"])]))


def still_open(batches):
    """The rows of a slot that agree with a row of another component."""
    for batch, col, slots in _slots(batches):
        keep = np.zeros(batch.num_rows, bool)
        for a, b in slots:
            for x, near in _apart(col, a, b):
                keep[a + x] = True
                keep[a + near] = True
        yield batch.filter(pa.array(keep))


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """100 * intersection >= 75 * union, of sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < 75 * len(y):
        return False
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= 75 * (len(x) + len(y) - both)


def across(batches):
    """Components (a, b) of a slot that a confirmed link joins."""
    for batch, col, slots in _slots(batches):
        sets = batch.column(batch.schema.get_field_index("set"))
        for a, b in slots:
            up: dict[int, int] = {}

            def root(c):
                while c in up:
                    c = up[c]
                return c

            held: dict[int, np.ndarray] = {}

            def own(i, held=held, a=a):
                if i not in held:
                    held[i] = np.frombuffer(sets[int(a + i)].as_py(), np.uint64)
                return held[i]

            for x, near in _apart(col, a, b):
                for y in near.tolist():
                    p, q = int(col["comp"][a + x]), int(col["comp"][a + y])
                    if root(p) != root(q) and linked(own(int(x)), own(y)):
                        up[max(root(p), root(q))] = min(root(p), root(q))
                        yield _pairs([min(p, q)], [max(p, q)])


def sets_of_texts(batches):
    """node and its set for rows doc_id, text, node whose text has that node's set."""
    for batch in batches:
        for part in arrow_rows(batch):
            values, ptr, nodes = _sets(part.column(1))
            keep = [i for i, (n, want) in enumerate(zip(nodes, part.column(2).to_pylist())) if n is not None and n == want]
            yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in keep], pa.int64()), pa.array([values[ptr[i] : ptr[i + 1]].tobytes() for i in keep], pa.binary())], ["node", "set"])


def full_sets(texts: DataFrame, firsts: DataFrame) -> DataFrame:
    """node, set (sorted little-endian u64 shingles) for the nodes of `firsts` (node, doc_id, digest), from texts (doc_id,
    text, digest).

    A node's text is found by its id, null ones too, and its digest, so an id that many texts share gives each once. A
    bounded count of nodes is broadcast; beyond it the join is shuffled.
    """
    wanted = bounded(firsts.select("node", F.col("doc_id").alias("wanted_id"), F.col("digest").alias("wanted_digest")))
    same = (F.col("digest") == F.col("wanted_digest")) & F.col("doc_id").eqNullSafe(F.col("wanted_id"))
    found = texts.join(wanted, same).select("doc_id", "text", "node")
    # rows that repeat an id and a text give their set once
    return found.mapInArrow(sets_of_texts, "node long, set binary").dropDuplicates(["node"])


def confirm(batches):
    """Pairs whose full sets are linked."""
    for batch in batches:
        rows = [(a, b) for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns)) if linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))]
        yield _pairs(*zip(*rows)) if rows else _pairs([], [])


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    b = pairs.join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
    return b.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a").select("a", "b", "sa", "sb").mapInArrow(confirm, PAIRS)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest doc_id linked, itself included), kept.

    Texts with equal shingle sets are one class, so copies of any number cost one row each. Null and empty texts and
    texts without words have no shingles and are linked with nothing. Rows that repeat an id get a row each; with
    equal texts they are one class. Rows with a null id count in links but never as smallest; a component of null ids
    only has a null component_id and keeps nothing. An empty table gives none; other columns are not read.
    """
    return decisions(docs, id_col, text_col).drop("digest", "chosen").withColumnRenamed("doc_id", id_col)


def text_digest(text_col: str):
    """What tells rows apart that share an id."""
    return F.xxhash64(F.col(text_col))


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of near_duplicates with doc_id as the id's name, the digest of each row's text, and chosen: whether the
    row is the one that stays of its component (the smallest id, not null if there is one; then the smallest digest).
    Rows that repeat an id and a text are chosen alike. Rows without shingles are always chosen."""
    spark = docs.sparkSession
    with small_arrow_batches(spark):
        return _decisions(docs, id_col, text_col)


def _regions(nodes: DataFrame) -> DataFrame:
    """run (a tree's region), tree, node, sig read from the tree on, keys: of nodes that share the region with another."""
    keyed = nodes.select("node", "sig", "keys", F.posexplode("keys").alias("tree", "run"))
    shared = written(keyed.groupBy("run").agg(F.count("*").alias("n")).where("n > 1").select("run"), "shared-runs")
    few = bounded(shared)
    if few is shared:  # keys alone meet a large table; signatures follow for the rows that stay
        keyed = keyed.select("node", "tree", "run").join(shared, "run").join(nodes.select("node", "sig", "keys"), "node")
    else:
        keyed = keyed.join(few, "run")
    rotated = F.expr(f"concat(substring(sig, tree * {DEPTH} + 1), substring(sig, 1, tree * {DEPTH}))")
    return written(keyed.select("run", "tree", "node", rotated.alias("sig"), "keys"), "regions")


def _mixed(regions: DataFrame, comp: DataFrame) -> DataFrame:
    """Rows of regions that hold several components, dealt to slots: of its largest component and of the rest, a region
    has blocks of about BLOCK rows; each block of the rest meets each block of either."""
    own = regions.join(bounded(comp), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    parts = own.groupBy("run", "comp").agg(F.count("*").alias("n"))
    held = parts.groupBy("run").agg(F.max(F.struct("n", "comp")).alias("most"), F.sum("n").alias("n")).where("most.n < n")
    held = written(held.select("run", F.col("most.comp").alias("largest"), F.col("most.n").alias("inside"), (F.col("n") - F.col("most.n")).alias("outside")), "mixed-runs")
    rows = own.join(bounded(held), "run")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    rows = rows.withColumn("m", blocks("inside")).withColumn("r", blocks("outside")).withColumn("rest", F.col("comp") != F.col("largest"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("rest"), F.col("r")).otherwise(F.col("m"))).cast("int"))
    one = (F.col("inside") + F.col("outside")) <= BLOCK
    slot = lambda kind, i, j, side: F.struct(F.xxhash64("run", F.lit(kind), i, j).alias("run"), side.cast("int").alias("side"))
    count = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    to_largest = F.transform(count("m"), lambda j: slot(1, F.col("own"), j, F.lit(0)))
    to_rest = F.transform(count("r"), lambda j: slot(2, F.least("own", j), F.greatest("own", j), (F.col("own") > j)))
    slots = F.when(one, F.array(slot(0, F.lit(0), F.lit(0), F.lit(0)))).when(F.col("rest"), F.concat(to_largest, to_rest)).otherwise(F.transform(count("r"), lambda i: slot(1, i, F.col("own"), F.lit(1))))
    rows = rows.withColumn("slot", F.explode(slots))
    return rows.select(F.col("slot.run").alias("run"), "tree", F.col("slot.side").alias("side"), "node", "comp", "sig", "keys").repartition("run").sortWithinPartitions("run")


def _decisions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), text_digest(text_col).alias("digest"))
    signed = written(texts.mapInArrow(sign, SIGNED), "signed")
    # a class has one set, so its keys and signatures are equal; its doc_id is null only where all its ids are
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("least")
    nodes = signed.where("node is not null").groupBy("node").agg(least, F.min("keys").alias("keys"), F.min("sig").alias("sig"))
    nodes = written(nodes.select("node", "least.doc_id", "least.digest", "keys", "sig"), "nodes")
    regions = _regions(nodes)

    def sets_of(wanted: DataFrame) -> DataFrame:
        firsts = written(nodes.select("node", "doc_id", "digest").join(wanted, "node"), "firsts")
        return written(full_sets(texts, firsts), "sets")

    orders = regions.select("run", "sig", "node").repartitionByRange("run", "sig").sortWithinPartitions("run", "sig")
    found = orders.mapInArrow(propose, PROPOSED).groupBy("node").agg(F.min("sure").alias("sure"), F.max(F.struct("agree", (-F.col("best")).alias("best"))).alias("m"))
    ends = found.select("node", F.explode(F.array("sure", -F.col("m.best"))).alias("other")).where("other is not null")
    pairs = written(ends.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct(), "proposed")
    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    comp = components(confirmed(pairs, sets))

    rest = _mixed(regions, comp)
    left = written(rest.mapInArrow(still_open, rest.schema), "open")
    if not left.isEmpty():
        sets = sets_of(left.select("node").distinct())
        met = left.join(sets, "node").repartition("run").sortWithinPartitions("run")
        more = components(met.mapInArrow(across, PAIRS)).toDF("old", "new")
        if not more.isEmpty():
            comp = _relabelled(comp, more)

    ends = signed.select("doc_id", "digest", "n_shingles", "node").join(bounded(comp), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    alone = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    firsts = ends.where("node is not null").groupBy("comp").agg(F.min(alone).alias("first"), F.count("*").alias("n")).where("n > 1")
    out = _with_firsts(ends, written(firsts, "firsts"), signed.count()).withColumn("first", F.coalesce("first", alone))
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    chosen = F.col("node").isNull() | F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest"))
    return out.select("doc_id", "digest", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"), chosen.alias("chosen"))


def _with_firsts(ends: DataFrame, firsts: DataFrame, total: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """ends with the column first (null: the row is alone) of their component, from firsts (comp, first, n rows).

    Up to `most` components of several rows are broadcast. Beyond it those of more than a `most`-th of all rows are,
    which are fewer than that, and only rows of the smaller ones are shuffled; so no component fills a task.
    """
    if firsts.count() <= most:
        return ends.join(F.broadcast(firsts.drop("n")), "comp", "left")
    large = F.col("n") > max(1, total // most)
    hot, cold = F.broadcast(firsts.where(large).drop("n")), firsts.where(~large).drop("n")
    named = ends.where("comp is not null")
    rest = named.join(hot.select("comp"), "comp", "left_anti").join(cold, "comp", "left")
    none = ends.where("comp is null").withColumn("first", F.lit(None).cast(firsts.schema["first"].dataType))
    return named.join(hot, "comp").unionByName(rest).unionByName(none)


def _relabelled(comp: DataFrame, more: DataFrame) -> DataFrame:
    """node, comp with the components `old` of more become `new`; nodes that stood alone are old components too."""
    moved = comp.join(bounded(more), F.col("comp") == F.col("old"), "left").select("node", F.coalesce("new", "comp").alias("comp"))
    alone = more.join(comp.select("comp"), F.col("old") == F.col("comp"), "left_anti").select(F.col("old").alias("node"), F.col("new").alias("comp"))
    return written(moved.unionByName(alone), "components")
