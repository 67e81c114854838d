"""Filter interaction audit: what each of five document filters removes in every order of applying them.

A relational pipeline: words are exploded, counted by (row, word) and then by row for totals and distinct words; these
are outer-joined to the flags that need no words and to the labels; one aggregation by part then fills 32 conditional
counts, one for each set of filters that a row fails. Every order, step, loss and Shapley sum follows from these counts,
so the rows are not gone through once an order.

A row is known by a digest of its id and text. Texts are shuffled once, by that digest: both word counts are then made
where they lie, and no copy, source or frequent word makes a hot group. For the search of copies only digests of texts
travel, counted before they are sent.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflux.llm.shared import written

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
#: Fixed thresholds: words at least, per cent of distinct words at least, per cent of capitals at most
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
#: Fixed characters that fail a text
MARKS = r"[#$%&*|]"
#: What parts words: \x20 and \x09-\x0D, each named, which Java looks up in one table
GAPS = r"[\x09\x0A\x0B\x0C\x0D\x20]+"
#: Bytes of text to a partition when words are counted; a partition's distinct (row, word) take about ten times that
PARTITION_BYTES = 16 << 20
KINDS = ("kept", "good", "toxic")


def word_counts(texts: DataFrame, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """row, its times (how often it stands in texts), n_words of all of them and n_distinct (columns row, text).

    The texts are the only thing shuffled. A blank, which is no word, is added to each text and counts it.
    """
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    placed = texts.repartition(max(1, -(-size // partition_bytes)), "row")
    words = placed.select("row", F.explode(F.concat(F.split("text", GAPS), F.array(F.lit(" ")))).alias("word")).where("word <> ''")
    by_word = words.groupBy("row", "word").agg(F.count("*").alias("n"))
    blank = F.col("word") == " "
    return by_word.groupBy("row").agg(
        F.sum(F.when(blank, F.col("n"))).alias("times"),
        F.sum(F.when(~blank, F.col("n")).otherwise(0)).alias("n_words"),
        F.count(F.when(~blank, 1)).alias("n_distinct"),
    )


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with good and toxic of their id; an id labelled more than once has what any of its labels says.

    Rows without id get none and are spread by key instead of meeting in one task.
    """
    truth = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("quality") == 1).alias("g"), F.max(F.col("toxic") == 1).alias("t")).where("id is not null")
    spread = F.when(F.col("id").isNull(), F.pmod(F.hash("key"), F.lit(1 << 20))).otherwise(-1)
    met = rows.withColumn("spread", spread).join(truth.withColumn("spread", F.lit(-1)), ["id", "spread"], "left")
    return met.withColumn("good", F.coalesce("g", F.lit(False))).withColumn("is_toxic", F.coalesce("t", F.lit(False))).drop("g", "t")


def failures(docs: DataFrame, labels: DataFrame, part_col: str) -> DataFrame:
    """Counts of rows by part, labels, the set of A-D that they fail (`failed`), and whether they fail E: n_first, n_copies.

    Columns part, good, is_toxic, failed, n_first (rows that pass E), n_copies (rows that fail it).
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    whose = F.coalesce(F.concat(F.lit("id "), F.col("doc_id").cast("string")), F.lit("none"))
    row = F.unhex(F.md5(F.concat(whose, F.lit(":"), text))).alias("row")
    flags = docs.select(
        F.col("doc_id").alias("id"),
        F.coalesce(F.col(part_col), F.lit("")).alias("part"),
        row,
        F.unhex(F.md5(text)).alias("key"),
        (100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > MOST_CAPITALS * F.length(text).cast("long")).alias("c"),
        text.rlike(MARKS).alias("d"),
    )
    few = (F.col("n_words") < LEAST_WORDS * F.col("times")).alias("a")
    alike = (100 * F.col("n_distinct") * F.col("times") < LEAST_DISTINCT * F.col("n_words")).alias("b")
    found = flags.join(word_counts(docs.select(row, text.alias("text"))), "row", "left").select("id", "part", "key", few, alike, "c", "d")
    failed = sum((F.when(F.col(c), 1 << k).otherwise(0) for k, c in enumerate("abcd")), F.lit(0))
    by_id = labelled(found.withColumn("failed", failed), labels).groupBy("id", "spread", "key", "part", "good", "is_toxic", "failed").agg(F.count("*").alias("n"))
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("least")
    groups = by_id.groupBy("key", "part", "good", "is_toxic", "failed").agg(F.sum("n").alias("n"), least, F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("n_without_id"))
    groups = written(groups, "audit")
    firsts = groups.groupBy("key").agg(F.min("least.id").alias("first_id"))
    first = F.col("n_without_id") + F.when(F.col("least.id") == F.col("first_id"), F.col("least.n")).otherwise(0)
    return groups.join(firsts, "key").select("part", "good", "is_toxic", "failed", first.alias("n_first"), (F.col("n") - first).alias("n_copies"))


def conditional_counts(rows: DataFrame) -> DataFrame:
    """part, and for all rows, good ones and toxic ones an array of the 32 counts of rows that fail just each set."""
    half = SETS // 2
    which = {"kept": F.lit(True), "good": F.col("good"), "toxic": F.col("is_toxic")}

    def count(kind: str, k: int) -> Column:
        n = F.col("n_first" if k < half else "n_copies")
        return F.coalesce(F.sum(F.when(which[kind] & (F.col("failed") == k % half), n)), F.lit(0)).alias(f"{kind}_{k}")

    made = rows.groupBy("part").agg(*(count(kind, k) for kind in KINDS for k in range(SETS)))
    return made.select("part", *(F.array(*(F.col(f"{kind}_{k}") for k in range(SETS))).alias(kind) for kind in KINDS))


def _survivors(kind: str) -> Column:
    """To each set of filters, how many rows fail none of it."""
    held = F.sequence(F.lit(0), F.lit(SETS - 1))
    passes = lambda s: F.aggregate(held, F.lit(0).cast("long"), lambda x, k: x + F.when(s.bitwiseAND(k) == 0, F.get(kind, k)).otherwise(0))
    return F.transform(held, passes).alias(kind)


def _shapley() -> Column:
    """To each filter, its removed rows summed over all orders: a set that stands before it does so in |set|! (4 - |set|)!."""
    last = len(FILTERS) - 1

    def of(bit: int) -> Column:
        sets = [s for s in range(SETS) if not s & bit]
        return sum((factorial(s.bit_count()) * factorial(last - s.bit_count()) * (F.get("kept", F.lit(s)) - F.get("kept", F.lit(s | bit))) for s in sets), F.lit(0).cast("long"))

    return F.array(*(of(1 << k) for k in range(len(FILTERS))))


def audit(docs: DataFrame, labels: DataFrame, part_col: str = "source") -> DataFrame:
    """One row per part, order of the five filters and step: part, filter_order, step, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley.

    Part is the value of part_col, null as the empty string. A: under 50 words; B: under 65 per cent of them distinct;
    C: over 5 per cent of the code points A-Z; D: holds a mark; E: identical to the text of a smaller id. Null texts are
    empty. Rows without id fail E never and make no other row fail it; rows that repeat an id and a text are alike. Ids
    that labels repeats have what any of its rows says, nulls say nothing. An empty table gives no rows; other columns
    are not read.
    """
    counts = conditional_counts(failures(docs, labels, part_col))
    sets = counts.select("part", *map(_survivors, KINDS)).withColumn("shapley_of", _shapley())
    orders = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    rows = sets.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    place = lambda letter: F.instr(F.col("filter_order"), letter)
    before = sum((F.when(place(x) < F.col("step"), 1 << k).otherwise(0) for k, x in enumerate(FILTERS)), F.lit(0))
    number = sum((F.when(place(x) == F.col("step"), k).otherwise(0) for k, x in enumerate(FILTERS)), F.lit(0))
    rows = rows.withColumn("before", before).withColumn("number", number).withColumn("bit", F.expr("shiftleft(1, number)"))
    passing = lambda kind, s: F.get(kind, s)
    after = F.col("before").bitwiseOR(F.col("bit"))
    lost = lambda kind: passing(kind, F.col("before")) - passing(kind, after)
    fails = passing("kept", F.lit(0)) - passing("kept", F.col("bit"))
    everything = F.lit(SETS - 1)
    return rows.select(
        "part",
        "filter_order",
        "step",
        passing("kept", after).alias("kept"),
        lost("kept").alias("removed"),
        (fails - lost("kept")).alias("redundant"),
        (passing("kept", everything - F.col("bit")) - passing("kept", everything)).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        F.get("shapley_of", F.col("number")).alias("shapley"),
    )
