"""Forward folds, grids, ablation and importance over rows whose answers are known."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from staylens.operators import models
from staylens.plans import registry

registry.load()
DAY = dt.date(2026, 3, 1)
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(5)
    made = []
    for i in range(600):
        x, z, noise = r.gauss(0, 3), r.gauss(0, 1), r.gauss(0, 1)
        made.append((i, DAY + dt.timedelta(i % 30), x, z, noise, 4.0 * x + z + r.gauss(0, 0.1)))
    return spark.createDataFrame(made, "id long, day date, x double, z double, noise double, y double").repartition(3).persist()


def test_no_label_of_a_fold_trains_for_it(spark):
    days = spark.createDataFrame([(DAY + dt.timedelta(n),) for n in range(30)] + [(None,)], "day date")
    folds = models.forward_folds(days, "day", 3, horizon=4)
    assert len(folds) == 2
    for train, valid in folds:
        train, valid = ({r.day for r in x.collect()} for x in (train, valid))
        first = min(valid)
        assert train == {DAY + dt.timedelta(n) for n in range(30) if DAY + dt.timedelta(n + 4) < first}
        assert not train & valid and None not in train | valid
    with pytest.raises(ValueError, match="no row has a day"):
        models.forward_folds(days.filter("day is null"), "day", 3, 1)


def test_search_has_a_row_for_each_point_and_fold(rows):
    found = models.forward_search(rows, "day", ["x", "z"], "y", {"linear": {"regParam": [0.0, 1000.0]}, "random_forest": {"numTrees": [2, 3], "maxDepth": [2]}}, folds=4, horizon=2)
    told = [tuple(r) for r in found.collect()]
    assert len(told) == 4 * 3 and {(r[0], r[2]) for r in told} == {(m, k) for m in ("linear", "random_forest") for k in (1, 2, 3)}
    assert all(r[3] > 0 and r[4] > 0 for r in told)
    exact = [r[5] for r in told if r[1] == '{"regParam": 0.0}']
    assert all(e < 0.2 for e in exact)
    best = models.choice(found).orderBy("rank").first()
    assert (best.model, best.params, best.rank) == ("linear", '{"regParam": 0.0}', 1)


def test_a_fold_without_rows_is_told(rows):
    with pytest.raises(ValueError, match="fold 1 of 3: 0 rows train"):
        models.forward_search(rows, "day", ["x"], "y", {"linear": {"regParam": [0.0]}}, horizon=14)


def test_shuffle_is_a_permutation(spark, rows):
    got = models.shuffled(rows, ["id"], ["x", "noise"]).select("id", "x", "noise", "_other").collect()
    assert len(got) == 600 and sorted(r.x for r in got) == sorted(r._other.x for r in got)
    pairs = {(r.x, r.noise) for r in got}
    assert all((r._other.x, r._other.noise) in pairs for r in got)
    assert sum(r.x == r._other.x for r in got) < 20
    again = {r.id: r._other for r in models.shuffled(rows.repartition(7), ["id"], ["x", "noise"]).collect()}
    assert again == {r.id: r._other for r in got}
    assert models.shuffled(rows.filter("id < 0"), ["id"], ["x"]).collect() == []


def test_noise_has_no_importance(rows):
    fitted = models.fit(rows.filter("id % 3 > 0"), ["x", "z", "noise"], "y", "linear")
    told = {r.input: r for r in models.importance(fitted, rows.filter("id % 3 = 0"), ["id"], ["x", "z", "noise"], "y").collect()}
    assert set(told) == {"x", "z", "noise"} and all(r.rmse < 0.2 for r in told.values())
    assert abs(told["noise"].importance) < 0.01 < told["z"].importance < told["x"].importance
    # shuffling x leaves an error of about sqrt(2) times what it explains
    assert math.isclose(told["x"].shuffled_rmse, math.sqrt(2) * 4 * 3, rel_tol=0.2)


def test_ablation_tells_the_group_that_matters(rows):
    told = {r.without: (r.n_inputs, r.rmse) for r in models.ablation(rows.filter("id % 3 > 0"), rows.filter("id % 3 = 0"), {"main": ["x"], "side": ["z"], "noise": ["noise"]}, "y", "linear").collect()}
    assert {k: v[0] for k, v in told.items()} == {"all": 3, "main": 2, "side": 2, "noise": 2}
    assert told["main"][1] > 8 > 1.5 > told["side"][1] > 0.7 > told["noise"][1]
    with pytest.raises(ValueError, match="no input is left"):
        models.ablation(rows, rows, {"all of them": ["x"]}, "y")


def test_missing_inputs_are_left_out(spark, rows):
    holed = rows.withColumn("z", F.when(F.col("id") % 5 > 0, F.col("z")))
    fitted = models.fit(holed, ["x", "z"], "y", "linear")
    assert len(models.importance(fitted, holed, ["id"], ["x", "z"], "y").collect()) == 2


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_queries_without_sql_run(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
