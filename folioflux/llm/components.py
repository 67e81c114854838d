"""Connected components of a table of links, by contraction; nothing but one count a round reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflux.llm.shared import bounded, written


def components(links: DataFrame) -> DataFrame:
    """node, comp (smallest node reachable) for every node that stands in a link (a, b).

    In each round every node points to its smallest neighbour (a partial aggregate, so a node with very many neighbours
    costs no more than others) and on to where that one points; links are then taken between the nodes pointed to, and
    those inside one vanish. What is left shrinks by more than half a round. The rounds' pointers are kept as tables and
    followed in turn at the end. A table of pointers within the bound is broadcast.
    """
    left = written(links.select("a", "b").where("a <> b").distinct(), "links")
    steps: list[DataFrame] = []
    while not left.isEmpty():
        near = left.select("a", "b").union(left.select("b", "a")).groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to"))
        on = near.select(F.col("node").alias("via"), F.col("to").alias("next"))
        to = written(near.join(on, near["to"] == F.col("via"), "left").select("node", F.coalesce("next", "to").alias("to")), "pointers")
        steps.append(bounded(to))
        at = lambda end: steps[-1].select(F.col("node").alias(end), F.col("to").alias(f"to_{end}"))
        met = left.join(at("a"), "a").join(at("b"), "b").where("to_a <> to_b")
        left = written(met.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "links")
    if not steps:
        return left.toDF("node", "comp")
    out = steps[0].toDF("node", "comp")
    for step in steps[1:]:
        out = out.join(step, out["comp"] == step["node"], "left").select(out["node"], F.coalesce("to", "comp").alias("comp"))
    return written(out, "components") if len(steps) > 1 else out
