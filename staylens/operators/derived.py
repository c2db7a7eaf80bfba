"""Derived metrics: rates, turnover, continuity, operational flags, collisions, duplicates, calendar, schedule, findings."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import count_if, grouped_quantiles, n_rows, quantile, r6, rate
from ..functions.text import hotel_slug
from ..functions.timeaxis import MINUTE_BUCKETS, UNKNOWN, minute_bucket
from ..sources.bindings import STATUSES
from ..sources.files import written



def count_faults(counts: DataFrame) -> DataFrame:
    """Rows whose n_items is not the sum of the five statuses."""
    return counts.filter(F.col("n_items") != sum((F.coalesce(F.col(f"n_{s}"), F.lit(0)) for s in STATUSES), F.lit(0)))


def status_rates(counts: DataFrame) -> DataFrame:
    return counts.select("*", *[r6(rate(f"n_{s}", "n_items")).alias(f"rate_{s}") for s in STATUSES])


def status_presence(counts: DataFrame) -> DataFrame:
    """How often each status occurs, those that don't too."""
    total = counts.agg(*[F.coalesce(F.sum(f"n_{s}"), F.lit(0)).alias(s) for s in STATUSES])
    return total.unpivot([], STATUSES, "status", "n_items").withColumn("present", F.col("n_items") > 0)


def pivoted_status(items: DataFrame, *by: str) -> DataFrame:
    out = items.groupBy(*by).pivot("status", STATUSES).agg(n_rows()).fillna(0, STATUSES)
    out = out.select(*by, *[F.col(s).alias(f"n_{s}") for s in STATUSES])
    return out.withColumn("n_items", sum((F.col(f"n_{s}") for s in STATUSES), F.lit(0)))


#: What items are told apart by in the tables of availability.
AVAILABILITY = {"overall": [], "by_city": ["city"], "by_hotel": ["hotel_id", "city"], "by_checkin_month": ["checkin_month"], "by_lead_time_bucket": ["lead_time_bucket"], "by_crawl_date_hotel": ["crawl_date", "hotel_id"]}


def availability(items: DataFrame, by: list[str]) -> DataFrame:
    """Items by status, with rates, by what is asked. items: of resolved hotels. Nulls are a group of their own; a rate over
    nothing is null; no items give no rows, but one of zeros where nothing tells them apart."""
    counted = items.groupBy(*by).agg(*[count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUSES], n_rows().alias("n_items"))
    return status_rates(counted)


def availability_reconciled(overall: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Totals of resolved items beside those of the catalogue, a row for each status and all, and whether they agree."""
    names = [*(f"n_{s}" for s in STATUSES), "n_items"]
    long = lambda df: df.select(*[F.col(c).cast("long") for c in names]).unpivot([], names, "figure", "n")
    return counts_agree(long(overall), long(catalogue), "figure")


def calendar_coverage(items: DataFrame, flags: DataFrame, names: list[str]) -> DataFrame:
    """Items, distinct nights and distinct (night, city) cells by the flags of their night. items: checkin_date, city; flags:
    as calendar_flags() gives them. A night without flags, or an item without a city, has none set."""
    night = flags.select(F.col("day").alias("checkin_date"), "city", *names)
    cells = items.groupBy("checkin_date", "city").agg(n_rows().alias("_n")).join(night, ["checkin_date", "city"], "left").fillna(False, names)
    return cells.groupBy(*names).agg(F.sum("_n").alias("n_items"), F.countDistinct("checkin_date").alias("n_distinct_checkin_dates"), n_rows().alias("n_checkin_date_city_cells"))


def anchored_coverage(items: DataFrame, *by: str, day: str = "crawl_date") -> DataFrame:
    """Items, distinct days, and the list of days."""
    return items.groupBy(*by).agg(n_rows().alias("n_items"), F.countDistinct(day).alias("n_anchor_dates"), F.array_join(F.array_sort(F.collect_set(F.col(day).cast("string"))), ",").alias("anchor_dates"))


def null_taxonomy(missing: DataFrame, rules: DataFrame) -> DataFrame:
    """Class and key role of each (source, field) by the rules; a rule that names the source goes before one that names none. rules: field, source_code (or null), null_class, key_role."""
    general = rules.filter("source_code is null").select("field", F.col("null_class").alias("_class"), F.col("key_role").alias("_role"))
    own = rules.filter("source_code is not null")
    out = missing.join(F.broadcast(own), ["source_code", "field"], "left").join(F.broadcast(general), "field", "left")
    return out.withColumn("null_class", F.coalesce("null_class", "_class")).withColumn("key_role", F.coalesce("key_role", "_role")).drop("_class", "_role")


def unknown_fields(missing: DataFrame, rules: DataFrame) -> DataFrame:
    """Fields that only one of the two has."""
    a, b = missing.select("field").distinct(), rules.select("field").distinct()
    return a.join(b, "field", "left_anti").withColumn("missing_from", F.lit("rules")).unionByName(b.join(a, "field", "left_anti").withColumn("missing_from", F.lit("data")))


def class_summary(classed: DataFrame, classes: list[str]) -> DataFrame:
    """NULL cells by class; all classes are listed."""
    every = classed.sparkSession.createDataFrame([(c,) for c in classes], "null_class string")
    got = classed.groupBy("null_class").agg(F.sum("n_null").alias("n_null"), F.sum("n_total").alias("n_total"))
    return every.join(got, "null_class", "left").fillna(0, ["n_null", "n_total"])


def required_nulls(missing: DataFrame, required: list[str], exempt: dict[str, list[str]]) -> DataFrame:
    """NULLs of required fields, without the sources that a field exempts."""
    free = reduce(lambda a, b: a | b, [(F.col("field") == f) & F.col("source_code").isin(s) for f, s in exempt.items()], F.lit(False))
    rows = missing.filter(F.col("field").isin(required))
    return rows.groupBy("field").agg(F.sum(F.when(~free, F.col("n_null")).otherwise(0)).alias("n_null"), F.sum(F.when(~free, F.col("n_total")).otherwise(0)).alias("n_total"), F.coalesce(F.array_join(F.array_sort(F.collect_set(F.when(free, F.col("source_code")))), ","), F.lit("")).alias("exempt_sources"))


# --- turnover of series


def turnover_joint(facts: DataFrame) -> DataFrame:
    return facts.groupBy("n_observed_days", "max_gap_days").agg(n_rows().alias("n_series"))


def readiness_by_horizon(facts: DataFrame, horizons: tuple[int, ...] = (1, 3, 7, 14)) -> DataFrame:
    """Series and pairs for each horizon; labels are null until they are built."""
    wide = facts.agg(n_rows().alias("n_series"), *[F.count_if(F.col(f"n_pairs_h{k}") > 0).alias(f"s{k}") for k in horizons], *[F.coalesce(F.sum(f"n_pairs_h{k}"), F.lit(0)).alias(f"p{k}") for k in horizons])
    each = F.array(*[F.struct(F.lit(k).alias("horizon_days"), F.col(f"s{k}").alias("n_series_ready"), F.col(f"p{k}").alias("n_pairs")) for k in horizons])
    return wide.select("n_series", F.explode(each).alias("x")).select("x.horizon_days", "n_series", "x.n_series_ready", "x.n_pairs", F.lit(None).cast("long").alias("n_labels"))


def turnover_by_days(facts: DataFrame) -> DataFrame:
    out = facts.groupBy("n_observed_days").agg(n_rows().alias("n_series"), F.sum("n_reappearance_events").alias("n_reappearances"), r6(F.avg("span_days")).alias("mean_span_days"), r6(F.avg(F.col("n_observed_days") / F.col("span_days"))).alias("mean_observed_fraction"))
    return out.withColumn("reappearance_rate", r6(rate("n_reappearances", "n_series")))


def share_of(df: DataFrame, label: str | Column, name: str) -> DataFrame:
    """Rows by a label and their share of all; the total is taken over the labels, not the rows."""
    counts = df.groupBy((F.col(label) if isinstance(label, str) else label).alias(name)).agg(n_rows().alias("n"))
    return counts.withColumn("share", r6(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))))


# --- protocol and operations

OUTCOMES = ["success", "partial", "sold_out", "not_bookable", "error", "missing"]


def continuity(rows: DataFrame, *by: str) -> DataFrame:
    """Scheduled items by outcome."""
    out = rows.groupBy(*by).pivot("outcome", OUTCOMES).agg(n_rows()).fillna(0, OUTCOMES)
    return out.select(*by, *[F.col(o).alias(f"n_{o}") for o in OUTCOMES]).withColumn("n_scheduled", sum((F.col(f"n_{o}") for o in OUTCOMES), F.lit(0)))


def outcome_rates(counts: DataFrame) -> DataFrame:
    """Success, available-but-not (sold out, not bookable, partial) and failure (error, missing); they sum to 1."""
    n = lambda *names: sum((F.col(f"n_{x}") for x in names), F.lit(0))
    return counts.select("*", r6(rate(n("success"), "n_scheduled")).alias("success_rate"), r6(rate(n("sold_out", "not_bookable", "partial"), "n_scheduled")).alias("unavailable_rate"), r6(rate(n("error", "missing"), "n_scheduled")).alias("failure_rate"))


def operational_flags(daily: DataFrame, measures: list[str], least_days: int = 3, z: float = 2.0) -> DataFrame:
    """Each source's days with the z-score of each measure against all its days (sample deviation; none below least_days or without spread)."""
    w = Window.partitionBy("source_code")
    out = daily
    for m in measures:
        sd = F.stddev_samp(m).over(w)
        out = out.withColumn(f"z_{m}", F.when((F.count(m).over(w) >= least_days) & (sd > 0), r6((F.col(m) - F.avg(m).over(w)) / sd)))
    return out.withColumn("flagged", reduce(lambda a, b: a | b, [F.coalesce(F.abs(F.col(f"z_{m}")) >= z, F.lit(False)) for m in measures]))


def expected_schedule(plan: DataFrame, members: DataFrame, first: Column, last: Column) -> DataFrame:
    """What should have been collected: plan rows by the members of the cohort on that day, in the window of days. members: hotel_id, effective_from, effective_until.

    The version of a day is looked up among the versions, a row each; plan and members then meet by version.
    """
    held = (F.col("crawl_date") >= F.col("effective_from")) & (F.col("effective_until").isNull() | (F.col("crawl_date") < F.col("effective_until")))
    days = plan.filter((F.col("crawl_date") >= first) & (F.col("crawl_date") <= last))
    versions = members.select("effective_from", "effective_until").distinct()
    dated = days.join(F.broadcast(versions), held).drop("effective_until")
    return dated.join(members.select("hotel_id", "effective_from"), "effective_from").select(F.col("owner_source").alias("source_code"), "crawl_date", "checkin_date", "hotel_id")


SCHEDULE_KEY = ["source_code", "crawl_date", "checkin_date", "hotel_id"]


def classify_schedule(expected: DataFrame, actual: DataFrame, runs: DataFrame) -> DataFrame:
    """Outcome of each expected item: its status, or missing for want of a run or of the item in a run that was. Two actual
    items of one key are an error."""
    have = runs.select("source_code", "crawl_date", F.lit(True).alias("_ran")).distinct()
    twice = F.raise_error(F.concat_ws(" ", F.lit("two actual items of"), *[F.col(c).cast("string") for c in SCHEDULE_KEY])).cast("string")
    got = actual.groupBy(*SCHEDULE_KEY).agg(F.min("status").alias("_first"), n_rows().alias("_n")).select(*SCHEDULE_KEY, F.when(F.col("_n") > 1, twice).otherwise(F.col("_first")).alias("_status"))
    rows = expected.join(got, SCHEDULE_KEY, "left").join(have, ["source_code", "crawl_date"], "left")
    why = F.when(F.col("_status").isNull(), F.when(F.col("_ran").isNull(), "missing_source_run").otherwise("missing_item_in_existing_run"))
    return rows.select(*SCHEDULE_KEY, F.coalesce("_status", F.lit("missing")).alias("outcome"), why.alias("missing_reason"))


#: How many ways items without a slug are dealt.
SPREAD = 1000


def effective_hotel(items: DataFrame, members: DataFrame, slugs: DataFrame, first: str = "hotel") -> DataFrame:
    """Adds effective_hotel_id and its city: the item's own, else that of its link's slug if a member on the day, else none. slugs: slug, hotel_id, city.

    Only items without a hotel meet the slugs; of these, the ones without a slug are dealt out by a hash of the item. In a
    join by slug of all items, those with no slug to look up would meet in one task.
    """
    own = items.filter("hotel_id is not null").join(slugs.select("hotel_id", F.col("city").alias("effective_city")), "hotel_id", "left").select("*", F.col("hotel_id").alias("effective_hotel_id"), F.lit("own").alias("identity"))
    held = slugs.filter("not contains(slug, '/')").join(members.select("hotel_id", "effective_from", "effective_until"), "hotel_id").select(F.col("slug").alias("_slug"), F.col("hotel_id").alias("effective_hotel_id"), F.col("city").alias("effective_city"), "effective_from", "effective_until")
    none = F.concat(F.lit("/"), F.pmod(F.xxhash64("item_id"), F.lit(SPREAD)).cast("string"))  # a slug has no slash
    told = items.filter("hotel_id is null").withColumn("_slug", F.coalesce(hotel_slug("link", first), none))
    then = (F.col("crawl_date") >= F.col("effective_from")) & (F.col("effective_until").isNull() | (F.col("crawl_date") < F.col("effective_until")))
    linked = told.alias("t").join(held.alias("h"), (F.col("t._slug") == F.col("h._slug")) & then, "left").drop("_slug", "effective_from", "effective_until")
    how = F.when(F.col("effective_hotel_id").isNotNull(), "link").otherwise("unattributed")
    return own.unionByName(linked.withColumn("identity", how))


# --- collisions of two sources


def status_matrix(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("status_a", "status_b").agg(n_rows().alias("n_pairs"))


def concordance(pairs: DataFrame) -> DataFrame:
    both = (F.col("status_a") == "success") & (F.col("status_b") == "success")
    out = pairs.agg(n_rows().alias("n_pairs"), count_if(F.col("status_a") == F.col("status_b")).alias("n_same"), count_if(both).alias("n_both_success"))
    return out.withColumn("same_rate", r6(rate("n_same", "n_pairs")))


def by_minutes(rows: DataFrame, minutes: Column, more: dict[str, Column] | None = None) -> DataFrame:
    """Rows by how far apart in time they are; all buckets are listed."""
    every = rows.sparkSession.createDataFrame([(b, i + 1) for i, b in enumerate(MINUTE_BUCKETS)], "minute_bucket string, bucket_order int")
    got = rows.groupBy(minute_bucket(minutes).alias("minute_bucket")).agg(n_rows().alias("n"), *[c.alias(n) for n, c in (more or {}).items()])
    return every.join(got, "minute_bucket", "left").fillna(0, ["n", *(more or {})])


def apart(a: str, b: str) -> Column:
    return F.abs(F.expr(f"timestampdiff(SECOND, {a}, {b})")) / 60


def unique_options(options: DataFrame, key: list[str]) -> DataFrame:
    """Options whose key stands once in its item; what stands more often can't be paired."""
    return options.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*key))).filter("_n = 1").drop("_n")


def paired_options(pairs: DataFrame, options: DataFrame, option_key: list[str], fields: list[str]) -> DataFrame:
    """Options that both items of a pair have, with their price differences and, for each field, whether they agree (null agrees with null)."""
    once = unique_options(options, ["item_id", *option_key])
    side = lambda s: once.select(F.col("item_id").alias(f"item_id_{s}"), *option_key, *[F.col(c).alias(f"{c}_{s}") for c in ("price", *fields)])
    both = pairs.join(side("a"), "item_id_a").join(side("b"), ["item_id_b", *option_key])
    diff = F.abs(F.col("price_a") - F.col("price_b"))
    return both.select("*", diff.alias("abs_diff"), F.try_divide(diff * 2, F.col("price_a") + F.col("price_b")).alias("rel_diff"), *[F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b")).alias(f"same_{c}") for c in fields])


def option_coverage(pairs: DataFrame, options: DataFrame, option_key: list[str]) -> DataFrame:
    """For each pair of items the distinct options of either, those shared, and how many keys are ambiguous."""
    per = options.groupBy("item_id", *option_key).agg(n_rows().alias("_n"))
    rows = pairs.select("item_id_a", "item_id_b", F.explode(F.array(*[F.struct(F.col(f"item_id_{s}").alias("item_id"), F.lit(s).alias("side")) for s in "ab"])).alias("x")).select("item_id_a", "item_id_b", "x.*")
    keys = rows.join(per, "item_id").groupBy("item_id_a", "item_id_b", *option_key).agg(count_if(F.col("side") == "a").alias("_a"), count_if(F.col("side") == "b").alias("_b"), F.max("_n").alias("_n"))
    out = keys.groupBy("item_id_a", "item_id_b").agg(F.sum("_a").alias("n_options_a"), F.sum("_b").alias("n_options_b"), F.count_if((F.col("_a") > 0) & (F.col("_b") > 0)).alias("n_shared"), n_rows().alias("n_union"), F.count_if(F.col("_n") > 1).alias("n_ambiguous"))
    return out.withColumn("jaccard", r6(rate("n_shared", "n_union")))


def option_summary(detail: DataFrame, fields: list[str]) -> DataFrame:
    """One row over all paired options; no options give counts of 0 and nulls. Medians are picked from counted values."""
    told = detail.agg(n_rows().alias("n_options"), F.count_if(F.col("abs_diff") == 0).alias("n_equal_price"), r6(F.avg("abs_diff")).alias("mean_abs_diff"), r6(F.max("abs_diff")).alias("max_abs_diff"), *[r6(F.avg(F.col(f"same_{c}").cast("double"))).alias(f"same_{c}_rate") for c in fields])
    both = detail.select(F.col("abs_diff").cast("double"), F.col("rel_diff").cast("double")).unpivot([], ["abs_diff", "rel_diff"], "of", "x")
    at = lambda c: r6(F.max(F.when(F.col("of") == c, F.col("p50")))).alias(f"median_{c}")
    return told.crossJoin(grouped_quantiles(both, ["of"], "x", [0.5]).agg(at("abs_diff"), at("rel_diff")))


# --- duplicates


def duplicate_summary(groups: DataFrame) -> DataFrame:
    """Duplicate groups and their extra rows by source and city, with (all) rows for either and both."""
    out = groups.cube("source_code", "city").agg(n_rows().alias("n_groups"), F.sum(F.col("n_rows") - 1).alias("n_extra"), F.max("n_rows").alias("largest_group"), F.grouping("source_code").alias("_s"), F.grouping("city").alias("_c"))
    return out.select(F.when(F.col("_s") == 1, "(all)").otherwise(F.col("source_code")).alias("source_code"), F.when(F.col("_c") == 1, "(all)").otherwise(F.col("city")).alias("city"), "n_groups", "n_extra", "largest_group")


def duplicate_scopes(groups: DataFrame, totals: DataFrame) -> DataFrame:
    """Duplicate groups by scope (RAW, MAIN), source and city, with (all) rows for either and both, and their rates.

    groups: the groups of more than one row, with source_code, city, is_main, n_rows, min_price, max_price. totals: a row
    for each source and city with n_observations_raw and n_observations_main; one without duplicates is listed with 0.
    A group has one price where its least and largest are equal, without a price neither more nor less than one; a rate
    over nothing is null. No totals give no rows but an all-over row of each scope.
    """
    cells = None
    for scope in ("RAW", "MAIN"):
        got = (groups if scope == "RAW" else groups.filter("is_main")).groupBy("source_code", "city").agg(n_rows().alias("_groups"), F.sum(F.col("n_rows") - 1).alias("_extra"), count_if(F.col("min_price") == F.col("max_price")).alias("_same"), F.max("n_rows").alias("_largest"))
        part = totals.select("source_code", "city", F.lit(scope).alias("scope"), F.col(f"n_observations_{scope.lower()}").alias("n_observations")).join(got, ["source_code", "city"], "left").fillna(0, ["_groups", "_extra", "_same", "_largest"])
        empty = totals.sparkSession.createDataFrame([(scope,)], "scope string")
        told = [F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("n_observations", "n_observations"), ("_groups", "n_duplicate_groups"), ("_extra", "n_extra"), ("_same", "n_same_price_groups"))]
        by = part.groupingSets([["source_code", "city"], ["source_code"], ["city"]], "source_code", "city").agg(*told, F.coalesce(F.max("_largest"), F.lit(0)).alias("largest_group"), F.grouping("source_code").alias("_s"), F.grouping("city").alias("_c"))
        all_over = part.agg(*told, F.coalesce(F.max("_largest"), F.lit(0)).alias("largest_group")).select(F.lit(None).cast("string").alias("source_code"), F.lit(None).cast("string").alias("city"), "*", F.lit(1).cast("byte").alias("_s"), F.lit(1).cast("byte").alias("_c"))
        rows = by.unionByName(all_over).crossJoin(empty)
        cells = rows if cells is None else cells.unionByName(rows)
    out = cells.withColumn("n_groups", F.col("n_observations") - F.col("n_extra")).withColumn("n_divergent_groups", F.col("n_duplicate_groups") - F.col("n_same_price_groups"))
    named = lambda flag, c: F.when(F.col(flag) == 1, "(all)").otherwise(F.col(c)).alias(c)
    return out.select("scope", named("_s", "source_code"), named("_c", "city"), "n_observations", "n_groups", "n_duplicate_groups", "n_extra", "n_same_price_groups", "n_divergent_groups", "largest_group", r6(rate("n_duplicate_groups", "n_groups")).alias("duplicate_rate"), r6(rate("n_divergent_groups", "n_duplicate_groups")).alias("divergent_share"))


def duplicates_reconciled(summary: DataFrame, counted: DataFrame) -> DataFrame:
    """The all-over RAW row of duplicate_scopes() beside a count made apart, a row for each figure, and whether they agree.

    counted: one row of n_duplicate_groups, n_extra_observations, n_total_groups.
    """
    of = {"n_duplicate_groups": "n_duplicate_groups", "n_extra": "n_extra_observations", "n_groups": "n_total_groups"}
    a = summary.filter("scope = 'RAW' and source_code = '(all)' and city = '(all)'").select(*[F.col(c).cast("long") for c in of]).unpivot([], list(of), "figure", "n")
    b = counted.select(*[F.col(x).cast("long").alias(c) for c, x in of.items()]).unpivot([], list(of), "figure", "n")
    return counts_agree(a, b, "figure")


def spread_quantiles(groups: DataFrame, points: tuple[float, ...] = (0.25, 0.5, 0.75, 0.95, 0.99)) -> DataFrame:
    """Quantiles of the price spread in duplicate groups, by source and for all."""
    spread = groups.filter("min_price is not null").withColumn("abs_spread", F.col("max_price") - F.col("min_price")).withColumn("rel_spread", F.try_divide(2 * (F.col("max_price") - F.col("min_price")), F.col("max_price") + F.col("min_price")))
    at = F.array(*[F.lit(p) for p in points])
    out = spread.rollup("source_code").agg(n_rows().alias("n_groups"), F.percentile("abs_spread", at).alias("_a"), F.percentile("rel_spread", at).alias("_r"), F.grouping("source_code").alias("_g"))
    return out.select(F.when(F.col("_g") == 1, "(all)").otherwise(F.col("source_code")).alias("source_code"), "n_groups", *[r6(F.col("_a")[i]).alias(f"abs_p{round(p * 100)}") for i, p in enumerate(points)], *[r6(F.col("_r")[i]).alias(f"rel_p{round(p * 100)}") for i, p in enumerate(points)])


def audit_selection(groups: DataFrame, criteria: dict[str, Column], one_per: str, key: list[str], most: int = 8) -> DataFrame:
    """For each criterion and source the first groups by it, one for each `one_per`, with all reasons for a group joined."""
    parts = []
    for name, value in criteria.items():
        ranked = groups.withColumn("_v", value)
        first = ranked.withColumn("_k", F.row_number().over(Window.partitionBy("source_code", one_per).orderBy(F.desc_nulls_last("_v"), *key))).filter("_k = 1")
        top = first.withColumn("_k", F.row_number().over(Window.partitionBy("source_code").orderBy(F.desc_nulls_last("_v"), *key))).filter(F.col("_k") <= most)
        parts.append(top.select("source_code", one_per, *key, F.lit(name).alias("reason")))
    return reduce(lambda a, b: a.unionByName(b), parts).groupBy("source_code", one_per, *key).agg(F.array_join(F.array_sort(F.collect_list("reason")), "+").alias("reasons"))


def audit_rows(chosen: DataFrame, observations: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """All rows of the chosen groups, ranked within their group, with the group's size for a check of completeness."""
    rows = observations.join(chosen.select(*key, "reasons"), key)
    w = Window.partitionBy(*key)
    return rows.withColumn("rank_in_group", F.row_number().over(w.orderBy(*order))).withColumn("group_rows", F.count(F.lit(1)).over(w))


def near_concentration(pairs: DataFrame) -> DataFrame:
    """Pairs by sources, day and hotel, with the share of their day."""
    per = pairs.groupBy("source_a", "source_b", "crawl_date", "hotel_id").agg(n_rows().alias("n_pairs"))
    return per.withColumn("day_share", r6(F.col("n_pairs") / F.sum("n_pairs").over(Window.partitionBy("source_a", "source_b", "crawl_date"))))


# --- calendar

FLAGS = {"is_public_holiday": "public_holiday", "is_festival_period": "festival", "is_major_event": "major_event"}


def calendar_flags(days: DataFrame, cities: DataFrame, holidays: DataFrame) -> DataFrame:
    """One row for each (day, city): flags of its events, national ones reaching every city, and how many are confirmed or provisional."""
    cells = days.select("day").distinct().crossJoin(F.broadcast(cities.select("city").distinct()))
    h = holidays.select(F.col("holiday_date").alias("day"), "event_type", "scope", F.col("city").alias("_city"), "is_tet", "status")
    hit = (F.col("c.day") == F.col("h.day")) & ((F.col("h.scope") == "national") | (F.col("h._city") == F.col("c.city")))
    rows = cells.alias("c").join(F.broadcast(h.alias("h")), hit, "left")
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return rows.groupBy("c.day", "c.city").agg(*[some(F.col("event_type") == v).alias(k) for k, v in FLAGS.items()], some(F.col("is_tet")).alias("is_tet"), count_if(F.col("h.status") == "confirmed").alias("n_confirmed"), count_if(F.col("h.status") == "provisional").alias("n_provisional"))


def anchor_dates(items: DataFrame, flags: DataFrame, day: str = "checkin_date") -> DataFrame:
    """One row for each night that items are for: weekday, items, days and sources they were seen on, extremes of their lead
    time, and whether any city has a flag that day. items: day, crawl_date, source_code, lead_time. flags: as
    calendar_flags() gives them. Nights without flags have none set; items without a night make a row of null."""
    names = [c for c in flags.columns if c.startswith("is_")]
    told = items.groupBy(day).agg(n_rows().alias("n_items"), F.countDistinct("crawl_date").alias("n_crawl_dates"), F.countDistinct("source_code").alias("n_sources"), F.min("lead_time").alias("min_lead_time"), F.max("lead_time").alias("max_lead_time"))
    any_city = flags.groupBy(F.col("day").alias(day)).agg(*[F.bool_or(c).alias(f"{c}_any_city") for c in names])
    out = told.join(any_city, day, "left").fillna(False, [f"{c}_any_city" for c in names])
    return out.withColumn("weekday_number", F.weekday(day) + 1).withColumn("weekday", F.date_format(day, "EEEE")).withColumn("is_weekend_fri_sat", F.weekday(day).isin(4, 5))


def in_role(flags: DataFrame, role: str) -> DataFrame:
    """Flag columns named for the role of the day, so that a row can carry those of its night and of the day it was seen."""
    return flags.select(F.col("day").alias(f"{role}_date"), "city", *[F.col(c).alias(f"{role}_{c}") for c in flags.columns if c not in ("day", "city")])


# --- summaries and findings


def variant_summary(rows: DataFrame, variant: str, price: str) -> DataFrame:
    """Rows, median and mean of each variant of a price; a variant without a price has no median. Equal prices are counted and
    the counts written once to the shared folder, so that the rows are made once; the median is picked from them."""
    counted = written(rows.groupBy(variant, F.col(price).cast("double").alias(price)).agg(n_rows().alias("_rows")), "variants")
    some = F.when(F.col(price).isNotNull(), F.col("_rows"))
    told = counted.groupBy(variant).agg(F.sum("_rows").alias("n_series_days"), r6(F.try_divide(F.sum(F.col(price) * F.col("_rows")), F.sum(some))).alias("mean_price"))
    return told.join(grouped_quantiles(counted, [variant], price, [0.5], "_rows").select(variant, r6("p50").alias("median_price")), variant, "left")


def findings(parts: dict[str, tuple[str, str, DataFrame, str, DataFrame]]) -> DataFrame:
    """One row for each check, also where nothing was found: severity, grain, count, denominator, rate and a few keys. parts: name to (severity, grain, violations, key, population)."""
    rows = []
    for name, (severity, grain, bad, key, whole) in parts.items():  # the keys are a sample of five
        hit = bad.select(F.col(key).cast("string").alias("k"))
        few = hit.orderBy("k").limit(5).agg(F.array_join(F.array_sort(F.collect_list("k")), ",").alias("sample_keys"))
        counted = hit.agg(n_rows().alias("n_found")).crossJoin(few).crossJoin(whole.agg(n_rows().alias("denominator")))
        rows.append(counted.select(F.lit(name).alias("check_name"), F.lit(severity).alias("severity"), F.lit(grain).alias("grain"), "n_found", "denominator", r6(rate("n_found", "denominator")).alias("rate"), "sample_keys"))
    return reduce(lambda a, b: a.unionByName(b), rows)


@dataclass(frozen=True)
class Check:
    """A check of the data: where it was made, how many it found of how many, which rows, what may cause it, what to do.

    counted: one row of n_found and denominator, which may be made apart from violations, the rows whose keys are sampled.
    """

    name: str
    severity: str
    scope: str
    grain: str
    counted: DataFrame
    violations: DataFrame | None
    key: str
    cause: str
    action: str


def _finding(name: Column, severity: Column, scope: Column, grain: Column, found: DataFrame, cause: Column, action: Column) -> DataFrame:
    n, of = F.coalesce(F.col("n_found"), F.lit(0)).cast("long"), F.col("denominator").cast("long")
    return found.select(name.alias("check_name"), F.when(n > 0, severity).otherwise("info").alias("severity"), scope.alias("scope"), grain.alias("grain"), n.alias("n_found"), of.alias("denominator"), r6(rate(n, of)).alias("rate"), F.when(n > 0, F.col("sample_keys")).otherwise("").alias("sample_keys"), cause.alias("likely_cause"), action.alias("recommended_action"))


def finding_rows(checks: list[Check], most: int = 5) -> DataFrame:
    """One row for each check, also where nothing was found, when it is told as info. The keys are a sample of the first few
    as text; a null key is not among them; nothing counted is 0, and a rate over nothing is null."""
    rows = []
    for c in checks:
        found = c.counted.withColumn("sample_keys", F.lit(""))
        if c.violations is not None:
            few = c.violations.select(F.col(c.key).cast("string").alias("k")).filter("k is not null").orderBy("k").limit(most)
            found = c.counted.crossJoin(few.agg(F.array_join(F.array_sort(F.collect_list("k")), ",").alias("sample_keys")))
        rows.append(_finding(*map(F.lit, (c.name, c.severity, c.scope, c.grain)), found, F.lit(c.cause), F.lit(c.action)))
    return reduce(lambda a, b: a.unionByName(b), rows)


def null_findings(stats: DataFrame, classes: DataFrame, violations: DataFrame, required: dict[str, str], descriptive: list[str], most: int = 5) -> DataFrame:
    """Findings about nulls: a row for each required field, whatever was found, and one for each class of nulls that are none.

    stats: as required_nulls() gives them; a required field without a row is told with 0 of 0. classes: as class_summary()
    gives them. violations: field, key, the rows where a required field is null, of which the first keys are sampled.
    required: field to the role it has in a key, or none.
    """
    every = stats.sparkSession.createDataFrame(list(required.items()), "field string, role string")
    k = F.row_number().over(Window.partitionBy("field").orderBy(F.col("key").cast("string")))
    few = violations.filter("key is not null").withColumn("_k", k).filter(F.col("_k") <= most).groupBy("field").agg(F.array_join(F.array_sort(F.collect_list(F.col("key").cast("string"))), ",").alias("sample_keys"))
    told = every.join(stats, "field", "left").join(few, "field", "left").select("field", "role", F.coalesce("n_null", F.lit(0)).alias("n_found"), F.coalesce("n_total", F.lit(0)).alias("denominator"), F.coalesce("exempt_sources", F.lit("")).alias("exempt"), F.coalesce("sample_keys", F.lit("")).alias("sample_keys"))
    cause = F.concat(F.when(F.col("role") == "none", "a required field is null").otherwise(F.concat(F.lit("a part of the "), "role", F.lit(" is null, which splits or merges keys"))), F.when(F.col("exempt") == "", "").otherwise(F.concat(F.lit("; exempt: "), "exempt")))
    own = _finding(F.concat(F.lit("required_null_"), "field"), F.lit("medium"), F.lit("MAIN"), F.lit("observation"), told, cause, F.lit("look up the pages of the sampled keys; fill nothing in"))
    rest = classes.filter(F.col("null_class").isin(descriptive)).select("null_class", F.col("n_null").alias("n_found"), F.col("n_total").alias("denominator"), F.lit("").alias("sample_keys"))
    return own.unionByName(_finding(F.concat("null_class", F.lit("_null_cells")), F.lit("info"), F.lit("MAIN"), F.lit("cell"), rest, F.lit("the class tells what may be missing"), F.lit("none")))


def against_history(now: DataFrame, history: DataFrame, key: str, value: str, tolerance: float = 0.5) -> DataFrame:
    """A metric in percent against an older table of it, with the difference in points and whether that is within tolerance."""
    out = now.join(F.broadcast(history.select(key, F.col(value).alias("historical"))), key, "full_outer")
    return out.select(key, r6(value).alias(value), "historical", r6(F.col(value) - F.col("historical")).alias("delta"), (F.abs(F.col(value) - F.col("historical")) <= tolerance).alias("within_tolerance"))


def counts_agree(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Two tables of counts side by side, and whether they agree. Columns: key, n."""
    out = a.select(key, F.col("n").alias("n_a")).join(b.select(key, F.col("n").alias("n_b")), key, "full_outer")
    return out.withColumn("ok", F.col("n_a").eqNullSafe(F.col("n_b")))


def unknown_last(city: str = "city") -> Column:
    return F.coalesce(F.col(city), F.lit(UNKNOWN))
