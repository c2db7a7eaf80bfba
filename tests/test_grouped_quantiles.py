"""Quantiles by group, picked from counted values over ranges, against the exact percentile."""

import random

import pytest
from pyspark.sql import functions as F

from staylens.functions import stats
from staylens.operators import catalog, derived

POINTS = [0.0, 0.05, 0.25, 0.5, 0.99, 1.0]


def _want(df, x="x"):
    got = df.groupBy("g").agg(F.count(x).alias("n"), F.percentile(x, F.array(*map(F.lit, POINTS))).alias("q")).filter("n > 0").collect()
    return {r.g: (r.n, list(r.q)) for r in got}


def _got(df, **more):
    return {r[0]: (r[1], list(r[2:])) for r in stats.grouped_quantiles(df, ["g"], "x", POINTS, **more).collect()}


@pytest.mark.parametrize("few", [1, 20, 50_000])
def test_groups_of_every_shape(spark, few):
    """A hot group, a far outlier, one value repeated, ties, nulls as values and as key, and a group without values."""
    rng = random.Random(3)
    rows = [("hot", rng.gauss(0, 1)) for _ in range(3000)] + [("hot", 1e12)] + [("same", 7.0)] * 400 + [("ties", float(rng.randrange(5))) for _ in range(333)]
    rows += [(None, 1.0), (None, 4.0), ("one", -2.5), ("null", None), ("ties", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    want, got = _want(df), _got(df, few=few, ranges=8)
    assert set(got) == set(want) == {"hot", "same", "ties", None, "one"}
    for g in want:
        assert got[g][0] == want[g][0] and got[g][1] == pytest.approx(want[g][1], abs=1e-9)


def test_weights_are_repeats(spark):
    rows = [("a", float(x), x % 4) for x in range(50)] + [("b", 1.0, 3)]
    df = spark.createDataFrame(rows, "g string, x double, w int")
    longer = df.withColumn("k", F.explode(F.expr("sequence(1, greatest(w, 1))"))).filter("w > 0")
    assert _got(df.filter("w > 0"), weight="w", few=5, ranges=4) == {g: (n, pytest.approx(q)) for g, (n, q) in _want(longer).items()}


def test_no_rows(spark):
    none = spark.createDataFrame([], "g string, x double")
    assert stats.grouped_quantiles(none, ["g"], "x", [0.5]).count() == 0
    assert tuple(stats.grouped_quantiles(none, [], "x", [0.5]).first()) == (0, None)


def test_no_range_of_a_hot_group_holds_it_all(spark):
    """Ranges cut by quantiles stay even where equal-width bins would have one: the plan orders within (group, range)."""
    df = spark.range(40_000).select(F.lit("g").alias("g"), F.when(F.col("id") == 0, 1e15).otherwise(F.col("id").cast("double")).alias("x"))
    assert _got(df, few=100, ranges=64) == {g: (n, pytest.approx(q)) for g, (n, q) in _want(df).items()}


def test_robust_levels_count_once(spark):
    """Median 3, distances 2 1 0 1 97, MAD 1; a group of four prices has no levels, and a MAD of 0 gives no distance."""
    rows = [(1, p) for p in (1.0, 2.0, 3.0, 4.0, 100.0)] + [(2, p) for p in (1.0, 2.0, 3.0, 4.0)] + [(3, 5.0)] * 5 + [(1, None), (None, 3.0)]
    levels, near = catalog.robust_levels(spark.createDataFrame(rows, "hotel_id int, price_per_night double"))
    assert sorted(map(tuple, levels.select("hotel_id", "group_obs", "median_price", "price_mad").collect())) == [(1, 5, 3.0, 1.0), (3, 5, 5.0, 0.0)]
    z = near.join(levels.select("hotel_id", "price_mad"), "hotel_id").withColumn("z", catalog.distance_in_mads(F.col("distance")))
    assert sorted((r.hotel_id, r.price, r.z and round(r.z, 4)) for r in z.filter("z >= 5 or hotel_id = 3").collect()) == [(1, 100.0, 65.4256), (3, 5.0, None)]


def test_option_summary_of_nothing(spark):
    detail = spark.createDataFrame([], "abs_diff double, rel_diff double, same_x boolean")
    got = derived.option_summary(detail, ["x"]).first()
    assert (got.n_options, got.n_equal_price, got.median_abs_diff, got.median_rel_diff, got.same_x_rate) == (0, 0, None, None, None)
    got = derived.option_summary(spark.createDataFrame([(0.0, 0.0, True), (2.0, None, False), (4.0, 0.5, None)], "abs_diff double, rel_diff double, same_x boolean"), ["x"]).first()
    assert (got.n_options, got.n_equal_price, got.median_abs_diff, got.median_rel_diff, got.same_x_rate) == (3, 1, 2.0, 0.25, 0.5)
