"""Exact top-k by integer inner product: distributed histogram selection.

Every query is scored against every row, block against block. Global histograms of the scores, refined round by round
inside the bin that holds the kth value, give each query's kth score exactly; then scores above it are kept, and ties
at it are taken by the smaller id. Scores are made anew in each round. Blocks of queries are broadcast up to a checked
size and rows stay where they are read: histogram counts, summed by task, and the few kept rows are shuffled. Beyond that
size blocks of both sides meet in a shuffle, each as often as the other side has blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflux.llm.shared import small_arrow_batches, written

QUERY_ROWS, ROWS = 1024, 4096
BINS = 1024
#: Histograms of blocks of queries that a task holds: 8 MB each
HELD = 8
#: Blocks of queries that are broadcast, in bytes
BROADCAST_BYTES = 64 << 20
_MATRIX = [("block", pa.int64()), ("ids", pa.binary()), ("dim", pa.int32()), ("values", pa.binary())]
MATRIX = "block long, ids binary, dim int, values binary"
HIST = "block long, at int, bin long, n long"
STATE = "block long, low binary, width binary, need binary"
_NONE = np.iinfo(np.int64).min


def _integers(vectors) -> list[tuple[int, np.ndarray]]:
    """(row, floor(1024 x)) of the vectors that are whole: not null, no null or non-finite component."""
    out = []
    for i, v in enumerate(vectors):
        if v is None or None in v:
            continue
        x = np.floor(1024 * np.array(v, np.float64))
        if np.isfinite(x).all():
            out.append((i, x))
    return out


def blocks_of(batches, rows: int):
    """Blocks of at most `rows` vectors of one dimension as a matrix of doubles (integers)."""
    from pyspark import TaskContext

    number, held = TaskContext.get().partitionId() << 32, {}

    def block(dim):
        nonlocal number
        ids, values = zip(*held.pop(dim))
        number += 1
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, (_, t) in zip((number, np.array(ids, "<i8").tobytes(), dim, np.concatenate(values).tobytes()), _MATRIX)], [n for n, _ in _MATRIX])

    for batch in batches:
        ids = batch.column(0).to_pylist()
        for i, x in _integers(batch.column(1).to_pylist()):
            if ids[i] is None:
                continue
            own = held.setdefault(len(x), [])
            own.append((ids[i], x))
            if len(own) >= rows:
                yield block(len(x))
    for dim in list(held):
        yield block(dim)


def _scores(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, candidate ids, exact int64 scores; a query's own row gets the smallest int64."""
    q, c = np.frombuffer(row["q_values"]).reshape(-1, row["dim"]), np.frombuffer(row["c_values"]).reshape(-1, row["dim"])
    top = (np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(1, row["dim"]))
    s = (q @ c.T).astype(np.int64) if top < 2**53 else q.astype(np.int64) @ c.astype(np.int64).T
    ids, others = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["c_ids"], "<i8")
    s[ids[:, None] == others[None, :]] = _NONE
    return ids, others, s


def _bins(block: int, counts: np.ndarray) -> pa.RecordBatch:
    at, bins = np.nonzero(counts)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), block, np.int64)), pa.array(at, pa.int32()), pa.array(bins, pa.int64()), pa.array(counts[at, bins])], ["block", "at", "bin", "n"])


def histograms(batches):
    """Counts of scores by query (block, place in it) and bin of the query's present range; those of the last HELD blocks
    of queries are summed before they leave the task."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for row in batch.to_pylist():
            _, _, s = _scores(row)
            low, width = (np.frombuffer(row[c], "<i8") for c in ("low", "width"))
            counts = held.pop(row["block"], None)
            if counts is None:
                counts = np.zeros((len(low), BINS), np.int64)
                if len(held) >= HELD:
                    first = next(iter(held))
                    yield _bins(first, held.pop(first))
            held[row["block"]] = counts
            for i in np.flatnonzero(width > 0):
                x = s[i][s[i] != _NONE]
                at = (x - low[i]) // width[i]
                counts[i] += np.bincount(at[(at >= 0) & (at < BINS)], minlength=BINS)
    for block, counts in held.items():
        yield _bins(block, counts)


def narrow(batches):
    """The next range of each query of a block: the bin of its kth score. Rows: the block's state, then its bins."""
    held: list[dict] = []

    def state():
        low, width, need = (np.frombuffer(held[0][c], "<i8").copy() for c in ("low", "width", "need"))
        at = np.array([r["at"] for r in held[1:]], np.int64)
        bins, n = (np.array([r[c] for r in held[1:]], np.int64) for c in ("bin", "n"))
        for i in np.flatnonzero(width > 0):
            own = at == i
            b, c = bins[own], n[own]
            order = np.argsort(-b)
            total = np.cumsum(c[order])
            k = int(np.searchsorted(total, need[i]))
            if k == len(total):  # fewer scores than asked for: all are kept
                low[i], width[i] = _NONE + 1, 0
                continue
            need[i] -= total[k - 1] if k else 0
            low[i] += b[order[k]] * width[i]
            width[i] //= BINS  # widths are powers of BINS: the new bins fill the old one exactly
        return pa.RecordBatch.from_arrays([pa.array([held[0]["block"]], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (low, width, need))], ["block", "low", "width", "need"])

    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0]["block"] != row["block"]:
                yield state()
                held = []
            held.append(row)
    if held:
        yield state()


KEPT = "query_id long, vec_id long, score long"


def keep(k: int):
    def kept(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, others, s = _scores(row)
                low = np.frombuffer(row["low"], "<i8")
                out = []
                for i in range(len(ids)):
                    above = np.flatnonzero(s[i] > low[i])
                    ties = np.flatnonzero((s[i] == low[i]) & (s[i] != _NONE))
                    ties = ties[np.argsort(others[ties], kind="stable")[:k]]  # a block needs no more for the global k
                    at = np.concatenate([above, ties])
                    out.append((np.full(len(at), ids[i]), others[at], s[i][at]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["query_id", "vec_id", "score"])

    return kept


def _width(span: np.ndarray) -> np.ndarray:
    """The smallest power of BINS of which BINS bins cover the span."""
    out = np.ones(len(span), np.int64)
    for _ in range(6):
        out = np.where(out < -(-span // BINS), out * BINS, out)
    return out


def first_state(k: int, reach: float):
    """Ranges wide enough for any score: |q| times the longest row's length."""

    def state(batches):
        for batch in batches:
            for row in batch.to_pylist():
                q = np.frombuffer(row["values"]).reshape(-1, row["dim"])
                most = np.ceil(np.sqrt((q * q).sum(1)) * reach).astype(np.int64) + 1
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int64()), *(pa.array([x.astype("<i8").tobytes()], pa.binary()) for x in (-most, _width(2 * most + 1), np.full(len(most), k)))], ["block", "low", "width", "need"])

    return state


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query's k highest integer inner products with other rows: query_id, rank (from 1), vec_id, score.

    Components become floor(1024 x); ties go to the smaller id; fewer than k others give all of them. Vectors that are
    null, or hold a null or non-finite component, and rows with a null id take no part; vectors of different lengths
    never meet; an empty table gives no rows; rows that repeat an id are separate candidates, but never of a query
    with that id. Scores are exact where |score| and all partial sums are below 2^63.
    """
    spark = vectors.sparkSession
    small_arrow_batches(spark)
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = written(pick(vectors).mapInArrow(lambda b: blocks_of(b, ROWS), MATRIX), "rows")
    wanted = pick(queries)
    asked = written(wanted.repartition(max(1, -(-wanted.count() // QUERY_ROWS))).mapInArrow(lambda b: blocks_of(b, QUERY_ROWS), MATRIX), "queries")
    c_slots = rows.count()
    q_slots, q_bytes = asked.agg(F.count("*"), F.sum(F.length("values") + F.length("ids"))).first()
    if not q_slots or not c_slots:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    def lengths(batches):
        for batch in batches:
            for row in batch.to_pylist():
                x = np.frombuffer(row["values"]).reshape(-1, row["dim"])
                yield pa.RecordBatch.from_arrays([pa.array([float(np.sqrt((x * x).sum(1)).max(initial=0))])], ["length"])

    reach = rows.mapInArrow(lengths, "length double").agg(F.max("length")).first()[0]
    state = written(asked.mapInArrow(first_state(k, reach), STATE), "state")
    slot = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    c_side = rows.select(slot(c_slots).alias("c_slot"), F.explode(F.sequence(F.lit(0), F.lit(q_slots - 1))).alias("q_slot"), F.col("ids").alias("c_ids"), F.col("values").alias("c_values"), F.col("dim"))

    def pairs(state):
        if q_bytes <= BROADCAST_BYTES:
            q_side = asked.join(F.broadcast(state), "block").select("block", F.col("ids").alias("q_ids"), F.col("values").alias("q_values"), "dim", "low", "width")
            c_rows = rows.select(F.col("ids").alias("c_ids"), F.col("values").alias("c_values"), "dim")
            return c_rows.join(F.broadcast(q_side), "dim").select("block", "dim", "q_ids", "q_values", "c_ids", "c_values", "low", "width")
        q_side = asked.join(state, "block").select("block", slot(q_slots).alias("q_slot"), F.explode(F.sequence(F.lit(0), F.lit(c_slots - 1))).alias("c_slot"), F.col("ids").alias("q_ids"), F.col("values").alias("q_values"), "dim", "low", "width")
        return c_side.join(q_side, ["q_slot", "c_slot", "dim"]).select("block", "dim", "q_ids", "q_values", "c_ids", "c_values", "low", "width")

    width = int(_width(np.array([2 * int(reach * reach + 2) + 1]))[0])
    while width:
        bins = pairs(state).mapInArrow(histograms, HIST).groupBy("block", "at", "bin").agg(F.sum("n").alias("n"))
        heads = state.select("block", F.lit(-1).alias("at"), F.lit(-1).cast("long").alias("bin"), F.lit(0).cast("long").alias("n"), "low", "width", "need")
        empty = F.lit(None).cast("binary")
        both = heads.unionByName(bins.select("block", "at", "bin", "n", empty.alias("low"), empty.alias("width"), empty.alias("need")))
        state = written(both.repartition("block").sortWithinPartitions("block", "at").mapInArrow(narrow, STATE), "state")
        width //= BINS
    found = pairs(state).mapInArrow(keep(k), KEPT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
