"""Forecast models: fitting, forward folds with a grid of parameters, ablation by groups of inputs, permutation importance."""

from __future__ import annotations

import json

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import n_rows


def estimator(kind: str, label: str, seed: int = 7):
    """linear, random_forest or boosted_trees over the column features."""
    kinds = {
        "linear": lambda: LinearRegression(labelCol=label, featuresCol="features", solver="normal"),
        "random_forest": lambda: RandomForestRegressor(labelCol=label, featuresCol="features", numTrees=20, maxDepth=6, seed=seed),
        "boosted_trees": lambda: GBTRegressor(labelCol=label, featuresCol="features", maxIter=10, maxDepth=4, seed=seed),
    }
    return kinds[kind]()


def fit(train: DataFrame, inputs: list[str], label: str, model: str = "random_forest", seed: int = 7):
    """A fitted Spark ML pipeline; rows without a label or with a missing input are left out."""
    return Pipeline(stages=[_assembler(inputs), estimator(model, label, seed)]).fit(train.filter(F.col(label).isNotNull()))


def _assembler(inputs: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="skip")


def rmse(label: str, said: str = "prediction") -> Column:
    return F.sqrt(F.avg((F.col(said) - F.col(label)) ** 2))


def fold_cuts(df: DataFrame, day: str, folds: int) -> list[float]:
    """The day numbers (since 1970) after which the next fold begins: quantiles of the distinct days; none for an empty table."""
    at = F.percentile(F.unix_date(day), F.array(*[F.lit((i + 1) / folds) for i in range(folds - 1)]))
    return df.select(day).distinct().agg(at.alias("q")).first()["q"] or []


def forward_folds(df: DataFrame, day: str, folds: int, horizon: int) -> list[tuple[DataFrame, DataFrame]]:
    """(train, valid) for each fold but the first: a fold's days are held out, and all earlier days train.

    Rows whose label lies `horizon` days on train only if that day is before the fold, so the last `horizon` days before it
    are left out. A null day is in no fold. A fold without a row on either side is an error that tells its days.
    """
    cuts, n = fold_cuts(df, day, folds), F.unix_date(day)
    out = []
    for k, cut in enumerate(cuts):
        valid = df.filter((n > cut) & (n <= cuts[k + 1])) if k + 1 < len(cuts) else df.filter(n > cut)
        out.append((df.filter(n <= cut - horizon), valid))
    if not out:
        raise ValueError("no row has a day, so there are no folds")
    return out


def forward_search(df: DataFrame, day: str, inputs: list[str], label: str, grids: dict[str, dict[str, list]], folds: int = 3, horizon: int = 1, seed: int = 7) -> DataFrame:
    """A row for each model, point of its grid and fold: model, params (JSON), fold, n_train, n_valid, rmse.

    grids: for each kind of model the values of each parameter. Rows without a label or with a missing input are left out.
    All points of a grid are fitted to one assembled table of a fold.
    """
    known = _assembler(inputs).transform(df.filter(F.col(label).isNotNull()))
    known = known.select(day, label, "features")
    rows = []
    for fold, (train, valid) in enumerate(forward_folds(known, day, folds, horizon), 1):
        train, valid = train.persist(), valid.persist()
        n_train, n_valid = train.count(), valid.count()
        if not n_train or not n_valid:
            raise ValueError(f"fold {fold} of {folds}: {n_train} rows train and {n_valid} are held out; take fewer folds or a horizon below {horizon} days")
        for kind, grid in grids.items():
            model = estimator(kind, label, seed)
            points = ParamGridBuilder()
            for name, values in grid.items():
                points = points.addGrid(model.getParam(name), values)
            points = points.build()
            for i, fitted in model.fitMultiple(train, points):
                params = json.dumps({p.name: v for p, v in sorted(points[i].items(), key=lambda x: x[0].name)}, sort_keys=True)
                rows.append((kind, params, fold, n_train, n_valid, fitted.transform(valid).agg(rmse(label)).first()[0]))
        train.unpersist()
        valid.unpersist()
    return df.sparkSession.createDataFrame(rows, "model string, params string, fold int, n_train long, n_valid long, rmse double")


def choice(found: DataFrame) -> DataFrame:
    """The points of forward_search() by their mean error over the folds, the least first: model, params, mean_rmse, rank. Ties by model and params."""
    means = found.groupBy("model", "params").agg(F.avg("rmse").alias("mean_rmse"))
    return means.withColumn("rank", F.row_number().over(Window.orderBy("mean_rmse", "model", "params")))  # a row for each point of the grid


def ablation(train: DataFrame, test: DataFrame, groups: dict[str, list[str]], label: str, model: str = "random_forest") -> DataFrame:
    """RMSE with all inputs (without: all) and without each group of them: without, n_inputs, rmse. A group that holds all inputs leaves none and is an error."""
    every = [x for g in groups.values() for x in g]
    rows = []
    complete = lambda df: df.filter(F.col(label).isNotNull()).dropna(subset=every)
    known, held = complete(train).persist(), complete(test).persist()
    for name, without in {"all": [], **groups}.items():
        inputs = [x for x in every if x not in without]
        if not inputs:
            raise ValueError(f"without {name} no input is left")
        rows.append((name, len(inputs), fit(known, inputs, label, model).transform(held).agg(rmse(label)).first()[0]))
    known.unpersist()
    held.unpersist()
    return train.sparkSession.createDataFrame(rows, "without string, n_inputs int, rmse double")


def ranked_by_hash(df: DataFrame, key: list[str], seed: int, name: str, buckets: int = 1 << 12) -> DataFrame:
    """Adds the rank from 0 of each row in an order that the seed chooses, without one task for all rows.

    Hashes are dealt out by their highest bits; a bucket's rows are ranked apart and offset by the rows of lower buckets.
    Rows that share the key are told apart by no one, so the key should be unique.
    """
    h = F.xxhash64(F.lit(seed), *key)
    cut = df.withColumn("_h", h).withColumn("_bucket", F.shiftrightunsigned("_h", 64 - buckets.bit_length() + 1))
    sizes = cut.groupBy("_bucket").agg(n_rows().alias("_n"))
    before = sizes.select("_bucket", F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row a bucket
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy("_h", *key))
    return cut.withColumn("_k", within).join(before, "_bucket").withColumn(name, F.col("_before") + F.col("_k") - 1).drop("_h", "_bucket", "_k", "_before")


def shuffled(df: DataFrame, key: list[str], columns: list[str], seed: int = 7) -> DataFrame:
    """Adds _other, a struct of the columns of another row: a permutation of the rows, chosen by the seed and the key.

    Two orders of the rows are ranked, and the row of one rank takes the values of the same rank in the other order, so
    each row's values are given exactly once. An equi-join on the rank; neither side is gathered.
    """
    give = ranked_by_hash(df, key, seed + 1, "_rank").select("_rank", F.struct(*columns).alias("_other"))
    return ranked_by_hash(df, key, seed, "_rank").join(give, "_rank").drop("_rank")


def importance(fitted, test: DataFrame, key: list[str], inputs: list[str], label: str, seed: int = 7) -> DataFrame:
    """How much the error grows when one input is shuffled over the rows: input, rmse, shuffled_rmse, importance. One pass for all inputs.

    fitted: a pipeline of fit(). Rows without a label or with a missing input are left out; no rows give nulls.
    """
    rows = shuffled(test.filter(F.col(label).isNotNull()).dropna(subset=inputs), key, inputs, seed)
    each = rows.withColumn("_input", F.explode(F.array(*map(F.lit, ["", *inputs]))))
    changed = [F.when(F.col("_input") == x, F.col(f"_other.{x}")).otherwise(F.col(x)).alias(x) for x in inputs]
    said = fitted.transform(each.select("_input", label, *changed))
    errors = said.groupBy("_input").agg(rmse(label).alias("e"))
    whole = errors.filter("_input = ''").select(F.col("e").alias("rmse"))
    return errors.filter("_input <> ''").crossJoin(F.broadcast(whole)).select(F.col("_input").alias("input"), "rmse", F.col("e").alias("shuffled_rmse"), (F.col("e") - F.col("rmse")).alias("importance"))
