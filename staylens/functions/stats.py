"""Aggregates that several metrics share. Quantiles interpolate linearly over doubles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .timeaxis import col


def quantile(x: str | Column, q: float) -> Column:
    return F.percentile(col(x).cast("double"), F.lit(q))


def quantiles(x: str | Column, points: list[float]) -> list[Column]:
    """One pass for all points: p1, p5, p25 and so on."""
    at = F.percentile(col(x).cast("double"), F.array(*[F.lit(p) for p in points]))
    return [at[i].alias(f"p{round(p * 100)}") for i, p in enumerate(points)]


def rate(part: str | Column, whole: str | Column) -> Column:
    """Null where the denominator is 0."""
    return F.try_divide(col(part).cast("double"), col(whole).cast("double"))


def r6(x: str | Column) -> Column:
    """Rounded to six places, so that two engines' sums agree."""
    return F.round(col(x).cast("double"), 6)


def count_if(x: Column) -> Column:
    return F.count_if(F.coalesce(x, F.lit(False)))


def n_rows() -> Column:
    return F.count(F.lit(1))


#: Groups of more distinct values than this are cut into ranges, so many of them at most.
FEW, RANGES = 50_000, 256


def grouped_quantiles(df: DataFrame, by: list[str], x: str, points: list[float], weight: str | None = None, few: int = FEW, ranges: int = RANGES) -> DataFrame:
    """Exact quantiles of x by group, interpolated as by quantile(), as p1, p5 and so on, with n_values, how many there are.

    Equal values are counted first (a row stands for `weight` of them, if given). Groups of more than `few` distinct values
    are cut into ranges of about as many distinct values each, at quantiles that a bounded sketch finds; counts of the
    ranges tell where the ranks lie, and only ranges that hold one are ordered. So no task holds a group's values,
    however many they are, how they are spread, or how often one is repeated.

    Null values are left out, and a group of none of them has no row; a null in the key is a group of its own; NaN is the
    greatest value. Without a group there is always one row, of nulls and 0 where there are no values.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    same = lambda a, b, more=(): [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys] + [F.col(f"{a}.{c}") == F.col(f"{b}.{c}") for c in more]
    meet = lambda left, right, on: left.join(right, reduce(lambda a, b: a & b, on)) if on else left.crossJoin(right)
    told = df.filter(F.col(x).isNotNull()).select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(x).cast("double").alias("_v"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("_w"))
    counts = told.groupBy(*keys, "_v").agg(F.sum("_w").alias("_c"))
    at = F.percentile_approx("_v", F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), F.lit(4 * ranges))
    cuts = counts.groupBy(*keys).agg(F.when(n_rows() > few, at).alias("_cuts"))
    joined = meet(counts.alias("a"), cuts.alias("b"), same("a", "b")).select("a.*", "b._cuts")  # without a group the cuts are one row
    ranged = joined.withColumn("_range", F.lit(0))
    for k in reversed(range((ranges - 1).bit_length())):  # how many cuts are less, by halving; beyond the last cut there is null
        ranged = ranged.withColumn("_range", F.col("_range") + F.when(F.get("_cuts", F.col("_range") + (2**k - 1)) < F.col("_v"), 2**k).otherwise(0))
    ranged = ranged.drop("_cuts")
    whole = Window.partitionBy(*keys)  # a row a range
    sizes = ranged.groupBy(*keys, "_range").agg(F.sum("_c").alias("_in"))
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_in").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_n", F.sum("_in").over(whole))
    spots = [F.lit(q) * (F.col("_n") - 1) for q in points]
    within = lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_in"))
    wanted = sizes.filter(reduce(lambda a, b: a | b, [within(edge(s)) for s in spots for edge in (F.floor, F.ceil)]))
    inside = meet(ranged.alias("a"), wanted.alias("b"), same("a", "b", ["_range"])).select("a.*", "b._before", "b._n")
    placed = inside.withColumn("_to", F.col("_before") + F.sum("_c").over(Window.partitionBy(*keys, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
    value = lambda rank: F.max(F.when((rank < F.col("_to")) & (rank >= F.col("_to") - F.col("_c")), F.col("_v")))
    ends = [c for i, s in enumerate(spots) for c in (value(F.floor(s)).alias(f"_l{i}"), value(F.ceil(s)).alias(f"_h{i}"))]
    found = placed.groupBy(*keys).agg(F.coalesce(F.max("_n"), F.lit(0)).alias("n_values"), *ends)
    share = lambda q: F.lit(q) * (F.col("n_values") - 1) - F.floor(F.lit(q) * (F.col("n_values") - 1))
    return found.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], "n_values", *[(F.col(f"_l{i}") + F.when(F.col(f"_l{i}") == F.col(f"_h{i}"), 0.0).otherwise(share(q) * (F.col(f"_h{i}") - F.col(f"_l{i}")))).alias(f"p{round(q * 100)}") for i, q in enumerate(points)])


def overall_quantiles(df: DataFrame, x: str, points: list[float], few: int = FEW, ranges: int = RANGES) -> DataFrame:
    """One row with the quantiles of a column over all rows, as grouped_quantiles() gives them."""
    return grouped_quantiles(df, [], x, points, few=few, ranges=ranges).drop("n_values")
