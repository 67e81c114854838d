"""Spatial and order operators: grid cells, row bands, headings as of a line, column intervals, clusters, features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows that a task of grouped features holds
TASK_ROWS = 500_000


def dealt(rows: DataFrame, group: str) -> DataFrame:
    """rows by group in as many partitions as their number asks for, which are not put together again: a task's sorts hold
    some TASK_ROWS rows at any size. Aggregations and joins by the group need no further shuffle."""
    return rows.repartition(max(1, -(-rows.count() // TASK_ROWS)), group)


def boundary_at(boundaries: Column, position: Column) -> Column:
    """Coordinates of (slope, intercept) boundaries at a position."""
    return F.transform(boundaries, lambda b: b["slope"] * position + b["intercept"])


def cell_of_point(bounds: Column, value: Column) -> Column:
    """Index of the interval [b(i), b(i+1)) that holds a value; null outside. The last bound closes the last interval."""
    at = F.size(F.filter(bounds, lambda b: b <= value)) - 1
    return F.when((at >= 0) & (at < F.size(bounds) - 1), at)


def cell_of_span(bounds: Column, low: Column, high: Column) -> Column:
    """Index of the interval that a span overlaps most (the first of equals); null if it overlaps none."""
    n = F.size(bounds) - 1
    overlaps = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.least(high, F.get(bounds, i + 1)) - F.greatest(low, F.get(bounds, i)))
    best = F.array_max(overlaps)
    return F.when((n > 0) & (best > 0), F.array_position(overlaps, best).cast("int") - 1)


def row_bands(anchors: DataFrame, page: str, y: str, order: str) -> DataFrame:
    """Each anchor's band lower < y <= upper, cut halfway to its neighbours; the outer bands are open."""
    w = Window.partitionBy(page).orderBy(y, order)
    return anchors.withColumn("lower", (F.lag(y).over(w) + F.col(y)) / 2).withColumn("upper", (F.lead(y).over(w) + F.col(y)) / 2)


def assign_to_bands(lines: DataFrame, bands: DataFrame, page: str, y: str) -> DataFrame:
    """Lines with the band they fall in: an equi-join on the page with the interval as residual condition."""
    inside = (bands["lower"].isNull() | (lines[y] > bands["lower"])) & (bands["upper"].isNull() | (lines[y] <= bands["upper"]))
    return lines.join(bands, (lines[page] == bands[page]) & inside, "inner").drop(bands[page])


def last_heading(rows: DataFrame, page: str, order: list[str], heading: Column, name: str = "heading") -> DataFrame:
    """Each row with the latest heading at or before it: one sort a page, no range join."""
    w = Window.partitionBy(page).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(heading, ignorenulls=True).over(w))


def column_of(rows: DataFrame, columns: DataFrame, page: str, x: str) -> DataFrame:
    """Rows with the column of their own page whose [start, end) holds x: an equi-join on the page, the interval a
    residual condition. columns: page, start, end, ...; a null page or x meets none. The columns are few and go to the rows
    (a broadcast), so that a page of very many rows is no single task's work."""
    inside = (F.col(x) >= F.col("start")) & (F.col(x) < F.col("end"))
    return rows.join(F.broadcast(columns), page).where(inside)


def gap_clusters(rows: DataFrame, page: str, order: list[str], value: str, tolerance: Column, name: str = "cluster") -> DataFrame:
    """Number of each row's cluster: a new one starts where the gap to the row before exceeds the tolerance."""
    w = Window.partitionBy(page).orderBy(*order)
    gap = F.col(value) - F.lag(value).over(w)
    return rows.withColumn("_starts", F.coalesce((gap > tolerance).cast("int"), F.lit(0))).withColumn(name, F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_starts")


def median_clusters(rows: DataFrame, group: list[str], value: str, tolerance: float) -> DataFrame:
    """group, cluster (from 0), n, low, high of the values of each group, ascending: a new cluster starts where a value is
    off the last cluster's median by more than the tolerance (as plans.pages.by_running_median does on a page).

    A fold over the group's sorted values; its state are the clusters' starts, as a cluster is a stretch of values and its
    median stands in the middle. Null values are left out; groups are a page's values.
    """
    sorted_ = rows.where(F.col(value).isNotNull()).groupBy(*group).agg(F.array_sort(F.collect_list(F.col(value).cast("double"))).alias("v"))
    later = F.when(F.size("v") > 1, F.sequence(F.lit(1), F.size("v") - 1)).otherwise(F.array().cast("array<int>"))

    def fold(starts, k):
        last = F.element_at(starts, -1)
        middle = lambda shift: F.get("v", F.floor((last + k - shift) / 2).cast("int"))
        return F.when(F.get("v", k) - (middle(1) + middle(0)) / 2 > tolerance, F.array_append(starts, k)).otherwise(starts)

    cut = sorted_.withColumn("starts", F.aggregate(later, F.array(F.lit(0)), fold))
    at = cut.select(*group, "v", "starts", F.posexplode("starts").alias("cluster", "start"))
    n = F.coalesce(F.get("starts", F.col("cluster") + 1), F.size("v")) - F.col("start")
    return at.select(*group, "cluster", n.alias("n"), F.get("v", "start").alias("low"), F.get("v", F.col("start") + n - 1).alias("high"))


def alignment_ratio(value: str, median: str, tolerance: float) -> Column:
    """Aggregate: share of values within the tolerance of the group's median."""
    return F.avg((F.abs(F.col(value) - F.col(median)) <= tolerance).cast("double"))


def consecutive_ratio(rows: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """Per group, the share of steps that are exactly +1."""
    w = Window.partitionBy(group).orderBy(*order)
    steps = rows.withColumn("_step", F.col(value) - F.lag(value).over(w)).where("_step is not null")
    return steps.groupBy(group).agg(F.avg((F.col("_step") == 1).cast("double")).alias("ratio"), F.count("*").alias("steps"))


def regular_gaps(rows: DataFrame, group: str, value: str, slack: float = 0.35, floor: float = 4.0, least: int = 4) -> DataFrame:
    """Per group with `least` distinct values, the share of gaps near one or two times the median gap (near: the slack
    of that gap, `floor` at least; half as much again at two times)."""
    distinct = rows.select(group, value).distinct()
    w = Window.partitionBy(group).orderBy(value)
    gaps = distinct.withColumn("_gap", F.col(value) - F.lag(value).over(w))
    typical = gaps.groupBy(group).agg(F.median("_gap").alias("_typical"), F.count("*").alias("n")).where(F.col("n") >= least)
    near = lambda k, wide: F.abs(F.col("_gap") - k * F.col("_typical")) <= wide * F.greatest(F.lit(floor), slack * F.col("_typical"))
    return gaps.where("_gap is not null").join(typical, group).groupBy(group).agg(F.avg((near(1, 1.0) | near(2, 1.5)).cast("double")).alias("ratio"))


def theil_sen(points: DataFrame, group: str, order: str, x: str, y: str) -> DataFrame:
    """Per group, the median of pairwise slopes and of the residual intercepts. Groups are a page's few points."""
    a, b = points.select(group, F.col(order).alias("o1"), F.col(x).alias("x1"), F.col(y).alias("y1")), points.select(group, F.col(order).alias("o2"), F.col(x).alias("x2"), F.col(y).alias("y2"))
    slopes = a.join(b, group).where("o1 < o2 and x1 <> x2").groupBy(group).agg(F.median((F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1"))).alias("slope"))
    return points.join(slopes, group).groupBy(group).agg(F.first("slope").alias("slope"), F.median(F.col(y) - F.col("slope") * F.col(x)).alias("intercept"))


def expired_sections(rows: DataFrame, section: list[str], order: list[str], value: str, factor: float, floor: Column) -> DataFrame:
    """Rows with `expired`: true from the first gap over max(factor x the section's median gap, floor) on."""
    w = Window.partitionBy(*section).orderBy(*order)
    gaps = rows.withColumn("_gap", F.col(value) - F.lag(value).over(w))
    typical = gaps.groupBy(*section).agg(F.median("_gap").alias("_typical"))
    broken = F.coalesce(F.col("_gap") > F.greatest(F.lit(factor) * F.col("_typical"), floor), F.lit(False))
    return gaps.join(typical, section).withColumn("expired", F.max(broken).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_gap", "_typical")


def table_score(f: dict[str, Column]) -> Column:
    """Points of a page's features for being a table; six make one."""
    points = [(f["grid"] >= 0.65, 2), (f["names"] >= 5, 2), (f["aligned"] >= 0.75, 2), (f["regular"] >= 0.65, 2), (f["index"] >= 4, 2), (f["sexes"], 1), (f["documents"] >= 3, 1), (f["auxiliary"], 1)]
    out = F.lit(0)
    for condition, n in points:
        out = out + F.when(condition, n).otherwise(0)
    return out
