"""Straight lines through points by Hough votes, as grouped aggregations: images of any size and number, no pixel loop.

Each point votes, for each of a number of angles, for the distance of the line through it at that angle. Votes are
integers (sines in units of 1/65536), so every engine counts the same. A bin is a line if it has enough votes and none of
the eight bins around it is stronger; each bin sends its votes to its neighbours, so this is one more aggregation and no
self-join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Units to a pixel in which sines and distances are counted
UNIT = 1 << 16


def directions(angles: int) -> list[tuple[int, int]]:
    """(cosine, sine) in UNIT of `angles` directions evenly spread over half a turn: the normals of lines."""
    return [(round(math.cos(math.pi * k / angles) * UNIT), round(math.sin(math.pi * k / angles) * UNIT)) for k in range(angles)]


def hough_votes(points: DataFrame, group: list[str], x: str, y: str, angles: int = 180, width: int = 1) -> DataFrame:
    """group, angle, distance (bins of `width` pixels), votes: the points of each group by the lines that they may lie on.

    x and y are whole numbers; points that are null in either vote for nothing, repeated points vote again. Votes are
    counted before they are shuffled.
    """
    table = F.array(*(F.struct(F.lit(k).alias("angle"), F.lit(c).cast("long").alias("c"), F.lit(s).cast("long").alias("s")) for k, (c, s) in enumerate(directions(angles))))
    at = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*group, F.col(x).cast("long").alias("_x"), F.col(y).cast("long").alias("_y"), F.explode(table).alias("_d"))
    across = F.col("_x") * F.col("_d.c") + F.col("_y") * F.col("_d.s")
    whole = F.lit(width * UNIT)
    bin_ = (across - F.pmod(across, whole)) / whole
    return at.groupBy(*group, F.col("_d.angle").alias("angle"), bin_.cast("long").alias("distance")).agg(F.count("*").alias("votes"))


def hough_lines(votes: DataFrame, group: list[str], least: Column | int, angles: int = 180) -> DataFrame:
    """The bins of `votes` with `least` votes or more that no neighbour exceeds (angle and distance one apart; of equal
    ones the smallest angle, then distance, stays). Angles wrap around: the last one is next to the first at the negated
    distance.
    """
    strength = F.struct("votes", (-F.col("angle")).alias("a"), (-F.col("distance")).alias("d"))
    own = votes.withColumn("_own", strength)
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    near = own.withColumn("_s", F.explode(steps)).withColumn("_to", F.col("angle") + F.col("_s.i"))
    around = (F.col("_to") < 0) | (F.col("_to") >= angles)
    to = F.col("distance") + F.col("_s.j")
    # past half a turn a line's normal points the other way: bins [d, d + 1) become (-d - 1, -d]
    near = near.select(*group, F.pmod("_to", F.lit(angles)).cast("int").alias("angle"), F.when(around, -to - 1).otherwise(to).alias("distance"), "_own", (F.col("_s.i") == 0).__and__(F.col("_s.j") == 0).alias("_self"))
    best = near.groupBy(*group, "angle", "distance").agg(F.max("_own").alias("_best"), F.max(F.when(F.col("_self"), F.col("_own"))).alias("_own"))
    found = best.where(F.col("_own").isNotNull() & (F.col("_own") == F.col("_best")))
    return found.select(*group, "angle", "distance", F.col("_own.votes").alias("votes")).where(F.col("votes") >= least)


def skew(lines: DataFrame, group: list[str], angles: int = 180, most: float = 15.0) -> DataFrame:
    """group, skew (degrees): the median lean of a group's lines from level, of those that lean `most` degrees or less."""
    lean = F.col("angle") * (180.0 / angles) - 90.0  # a level line's normal stands upright
    return lines.withColumn("_lean", lean).where(F.abs("_lean") <= most).groupBy(*group).agg(F.median("_lean").alias("skew"))
