"""Comparable products: candidates from evidence, the approved one of each series, and matching later options to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import named, normal_area, token_similarity

SERIES = ["hotel_id", "checkin_date"]
# The weights of a match, and the least score of an alias.
WEIGHTS = {"name": 0.65, "occupancy": 0.15, "area": 0.10, "rate": 0.10}
ALIAS_SCORE = 0.80
CANDIDATE = [*SERIES, "room_key", "rate_key"]


def evidence(observations: DataFrame) -> DataFrame:
    """Priced observations with a key, of items in reference scope."""
    return observations.filter(F.col("include_reference") & ~F.col("is_sold_out") & F.col("price_per_night").isNotNull() & F.col("room_key").isNotNull())


def candidates(found: DataFrame) -> DataFrame:
    """Each (series, room, rate): observations, runs, items, and the share of the series' items that have it.

    found is evidence with item_id, run_id, crawl_date, max_occupancy. Both aggregates go by keys that start with the series.
    """
    eligible = found.groupBy(*SERIES).agg(F.countDistinct("item_id").alias("eligible_items"))
    per = found.groupBy(*CANDIDATE).agg(F.max("max_occupancy").alias("max_occupancy"), F.count(F.lit(1)).alias("observation_count"), F.countDistinct("run_id").alias("distinct_run_count"), F.countDistinct("item_id").alias("distinct_item_count"), F.min("crawl_date").alias("first_seen"), F.max("crawl_date").alias("last_seen"))
    coverage = F.least(F.lit(1.0), F.col("distinct_item_count") / F.col("eligible_items"))
    return per.join(eligible, SERIES).withColumn("item_coverage", F.round(coverage, 6))


def best(cands: DataFrame) -> DataFrame:
    """The first candidate of each series: once in an item, coverage, runs, for two people, observations, keys."""
    once = F.col("observation_count") == F.col("distinct_item_count")
    small = F.coalesce(F.col("max_occupancy") <= 2, F.lit(False))
    w = Window.partitionBy(*SERIES).orderBy(F.desc(once), F.desc("item_coverage"), F.desc("distinct_run_count"), F.desc(small), F.desc("observation_count"), "room_key", "rate_key")
    return cands.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def approve(chosen: DataFrame, least_runs: int = 3, least_coverage: float = 0.8) -> DataFrame:
    """Adds status and confidence: approved with runs and coverage enough and once in an item; else proposed. What is not unique counts six tenths."""
    once = F.col("observation_count") == F.col("distinct_item_count")
    enough = (F.col("distinct_run_count") >= least_runs) & (F.col("item_coverage") >= least_coverage) & once
    return chosen.withColumn("status", F.when(enough, "approved").otherwise("proposed")).withColumn("confidence", F.round(F.col("item_coverage") * F.when(once, 1.0).otherwise(0.6), 6))


def build(found: DataFrame, **thresholds: float) -> DataFrame:
    return approve(best(candidates(found)), **thresholds)


def many_approved(references: DataFrame) -> DataFrame:
    """Series with more than one approved reference."""
    return references.filter("status = 'approved'").groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n_approved")).filter("n_approved > 1")


def match_score(room: str = "", ref: str = "ref_") -> Column:
    """Struct of match (exact, alias, not_reference) and score of an option against a reference in columns with the prefix."""
    a, b = (lambda c: F.col(room + c)), (lambda c: F.col(ref + c))
    same_rate = F.coalesce(a("rate_key") == b("rate_key"), F.lit(False))
    exact = same_rate & F.coalesce(a("room_key") == b("room_key"), F.lit(False))
    score = WEIGHTS["name"] * token_similarity(a("room_name"), b("room_name")) + WEIGHTS["occupancy"] * a("max_occupancy").eqNullSafe(b("max_occupancy")).cast("double") + WEIGHTS["area"] * normal_area(a("room_area")).eqNullSafe(normal_area(b("room_area"))).cast("double") + WEIGHTS["rate"] * same_rate.cast("double")
    told = lambda s: F.struct(F.when(same_rate & (s >= ALIAS_SCORE - 1e-12), "alias").otherwise("not_reference").alias("match"), F.round(s, 4).alias("score"))
    return F.when(exact, F.struct(F.lit("exact").alias("match"), F.lit(1.0).alias("score"))).otherwise(named(score, told))


def best_match(scored: DataFrame, item: list[str]) -> DataFrame:
    """For each item its best exact or alias match; a tie on the top score is ambiguous, none is unavailable. scored: match, score, option_index."""
    good = F.col("match").isin("exact", "alias")
    top = scored.withColumn("_s", F.when(good, F.col("score"))).withColumn("_top", F.max("_s").over(Window.partitionBy(*item)))
    at_top = F.col("_s") == F.col("_top")
    per = top.groupBy(*item).agg(F.count_if(at_top).alias("n_top"), F.max("_top").alias("score"), F.max_by("match", F.when(at_top, F.lit(1)).otherwise(0)).alias("match"), F.max(F.when(at_top, F.col("option_index"))).alias("option_index"))
    status = F.when(F.col("n_top") == 0, "unavailable").when(F.col("n_top") > 1, "ambiguous").otherwise(F.col("match"))
    return per.select(*item, status.alias("match_status"), F.coalesce("score", F.lit(0.0)).alias("score"), F.when(F.col("n_top") == 1, F.col("option_index")).alias("option_index"))


def apply_approval(observations: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Observations with is_reference, and for each item exact or unavailable."""
    approved = references.filter("status = 'approved'").select(*CANDIDATE, F.lit(True).alias("is_reference"))
    marked = observations.join(approved, CANDIDATE, "left").withColumn("is_reference", F.coalesce("is_reference", F.lit(False)))
    items = marked.groupBy("item_id").agg(F.when(F.max("is_reference"), "exact").otherwise("unavailable").alias("reference_status"))
    return marked, items


def recalibrate(old: DataFrame, found: DataFrame, **thresholds: float) -> DataFrame:
    """References built anew from all evidence, over the old ones as retired history; old ones of series without evidence are dropped."""
    new = build(found, **thresholds)
    kept = old.join(new.select(*SERIES), SERIES, "left_semi").withColumn("status", F.lit("retired"))
    return new.unionByName(kept, allowMissingColumns=True)


def refresh(old: DataFrame, found: DataFrame, of_run: Column, **thresholds: float) -> DataFrame:
    """References after a run: series that it touched and that have none approved are built anew, the others stay. of_run: which evidence is the run's."""
    approved = old.filter("status = 'approved'").select(*SERIES)
    touched = found.filter(of_run).select(*SERIES).distinct().join(approved, SERIES, "left_anti")
    return old.join(touched, SERIES, "left_anti").unionByName(build(found.join(touched, SERIES, "left_semi"), **thresholds), allowMissingColumns=True)


def causal_assignment(found: DataFrame, least_runs: int = 3, least_coverage: float = 0.8) -> DataFrame:
    """The first day on which a series' candidate qualifies on evidence up to that day, and that candidate.

    Counts run over days within a candidate and within its series; no later row is looked at. found: evidence with crawl_date.
    """
    first = found.groupBy(*CANDIDATE, "item_id").agg(F.min("crawl_date").alias("day"), F.count(F.lit(1)).alias("n"), F.min("run_id").alias("run_id"))
    fresh = Window.partitionBy(*CANDIDATE, "run_id").orderBy("day", "item_id")
    upto = Window.partitionBy(*CANDIDATE).orderBy("day").rangeBetween(Window.unboundedPreceding, 0)
    new_run = first.withColumn("_new", (F.row_number().over(fresh) == 1).cast("int"))
    daily = new_run.groupBy(*CANDIDATE, "day").agg(F.count(F.lit(1)).alias("items"), F.sum("n").alias("obs"), F.sum("_new").alias("runs"))
    running = daily.select(*CANDIDATE, "day", *[F.sum(c).over(upto).alias(c) for c in ("items", "obs", "runs")])
    series_items = found.groupBy(*SERIES, "item_id").agg(F.min("crawl_date").alias("day")).groupBy(*SERIES, "day").agg(F.count(F.lit(1)).alias("n"))
    eligible = series_items.withColumn("eligible", F.sum("n").over(Window.partitionBy(*SERIES).orderBy("day").rangeBetween(Window.unboundedPreceding, 0))).select(*SERIES, "day", "eligible")
    rated = running.join(eligible, [*SERIES, "day"]).withColumn("coverage", F.least(F.lit(1.0), F.col("items") / F.col("eligible")))
    ready = rated.filter((F.col("runs") >= least_runs) & (F.col("coverage") >= least_coverage) & (F.col("obs") == F.col("items")))
    w = Window.partitionBy(*SERIES).orderBy("day", F.desc("coverage"), F.desc("runs"), "room_key", "rate_key")
    return ready.withColumn("_k", F.row_number().over(w)).filter("_k = 1").select(*SERIES, "room_key", "rate_key", F.col("day").alias("approved_on"), "runs", "items", F.round("coverage", 6).alias("coverage"))


def item_matches(observations: DataFrame, assigned: DataFrame) -> DataFrame:
    """Each item's match to the reference of its series, only from the day on which that was approved. assigned has the reference's columns with ref_ before them."""
    rows = observations.join(assigned, SERIES).filter(F.col("crawl_date") >= F.col("approved_on")).withColumn("_m", match_score())
    return best_match(rows.select("*", "_m.match", "_m.score"), ["item_id", *SERIES])
