"""Similar names within blocks, by a prefix-filtered set-similarity join that loses no pair.

Two names at a similarity of T share S (1.5 T - 1) - 1 pairs of neighbouring letters or more (S letters of both; see
alias_index). Each name's pairs are ordered from rare to frequent; names that share so many must have one in common
among the first few of each, so names meet only over these few rare pairs, in an equi-join. Pairs that are frequent in a
block are dealt into a square of cells, so none fills a task. Lengths and common letters are then counted in the JVM, and
what is left can be compared.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflux.operators.alias_index import pairs
from folioflux.operators.graph import cut_lineage

#: Names of one block that meet over one pair of letters in a task, on either side
CELL = 1000


def needed(length: int, least: float) -> int:
    """Pairs that a name shares at least with any name so similar."""
    both = length * (1 + least / (2 - least))
    return max(1, math.ceil(both * (1.5 * least - 1) - 1 - 1e-9))


def ranks(names: DataFrame, text: str) -> dict[tuple[str, int], int]:
    """Number of each pair of letters (and which of its kind in a name), rare ones first.

    A pair is two of a normal form's 37 characters, so there are 1369 kinds and as many again for each repeat.
    """

    @F.pandas_udf("array<string>")
    def listed(texts: pd.Series) -> pd.Series:
        return pd.Series([[f"{p}{k}" for p, k in pairs(t or "")] for t in texts])

    rows = names.select(F.explode(listed(F.col(text))).alias("pair")).groupBy("pair").count().collect()
    return {(r["pair"][:2], int(r["pair"][2:])): k for k, r in enumerate(sorted(rows, key=lambda r: (r["count"], r["pair"])))}


def with_prefix(names: DataFrame, text: str, least: float) -> DataFrame:
    """names with `prefix` (numbers of a name's rarest pairs, as many as a similar name must meet) and `letters`."""
    number = names.sparkSession.sparkContext.broadcast(ranks(names, text))

    @F.pandas_udf("array<int>")
    def prefix(texts: pd.Series) -> pd.Series:
        held, out = number.value, []
        for t in texts:
            own = sorted(held[p] for p in pairs(t or ""))
            out.append(own[: max(0, len(own) - needed(len(t or ""), least) + 1)])
        return pd.Series(out)

    @F.pandas_udf("array<string>")
    def letters(texts: pd.Series) -> pd.Series:
        return pd.Series([[f"{c}{t[:k].count(c)}" for k, c in enumerate(t)] for t in texts.fillna("")])

    return names.withColumn("prefix", prefix(F.col(text))).withColumn("letters", letters(F.col(text)))


def similar_candidates(names: DataFrame, block: list[str], text: str, least: float, meets: Column, cell: int = CELL) -> DataFrame:
    """Rows of names twice, their columns as <name>_a and <name>_b, for all pairs of one block whose texts differ and may
    be as similar as `least` (0.75 to 1), and for which `meets` holds; each once. Null blocks meet nothing.
    """
    names = cut_lineage(with_prefix(names, text, least))
    at = names.withColumn("pair", F.explode("prefix"))
    crowded = at.groupBy(*block, "pair").agg(F.count("*").alias("n")).where(F.col("n") > cell)
    cells = F.ceil(F.coalesce("n", F.lit(1)) / cell).cast("int")
    at = at.join(crowded, [*block, "pair"], "left").withColumn("cells", cells).withColumn("own", F.pmod(F.xxhash64(text), F.col("cells")).cast("int")).drop("n")
    every = F.explode(F.sequence(F.lit(0), F.col("cells") - 1))
    a = at.select(*(F.col(c).alias(f"{c}_a") for c in names.columns), "pair", F.col("own").alias("row"), every.alias("column"))
    b = at.select(*(F.col(c).alias(f"{c}_b") for c in names.columns), "pair", every.alias("row"), F.col("own").alias("column"))
    on = [*(a[f"{c}_a"] == b[f"{c}_b"] for c in block), a["pair"] == b["pair"], a["row"] == b["row"], a["column"] == b["column"]]
    size = F.length(f"{text}_a") + F.length(f"{text}_b")
    first = F.array_min(F.array_intersect("prefix_a", "prefix_b")) == a["pair"]  # a pair of names is given at one place
    common = F.size(F.array_intersect("letters_a", "letters_b"))
    long_enough = 2 * F.least(F.length(f"{text}_a"), F.length(f"{text}_b")) >= least * size - 1e-9
    met = a.join(b, on).where((F.col(f"{text}_a") != F.col(f"{text}_b")) & meets & long_enough & first & (2 * common >= least * size - 1e-9))
    return met.select(*(f"{c}_{s}" for s in "ab" for c in names.columns if c not in ("prefix", "letters")))
