"""Merging sources: winners by field group, ownership of planned items, cohorts as of a day, rejects, and gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stacked(parts: dict[tuple[str, int], DataFrame]) -> DataFrame:
    """Sources over one another, each row with its source_code and source_priority; columns go by name."""
    tagged = [df.withColumn("source_code", F.lit(code)).withColumn("source_priority", F.lit(priority)) for (code, priority), df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b), tagged)


def _winner(fields: list[str], stamp: str) -> Column:
    filled = sum((F.col(f).isNotNull().cast("int") for f in fields), F.lit(0))
    order = F.struct(F.col(stamp).isNotNull().alias("a"), F.col(stamp).alias("b"), filled.alias("c"), (-F.col("source_priority")).alias("d"))
    return F.max_by(F.struct(*fields, stamp, "source_code"), order)


def merge_hotels(rows: DataFrame, key: str, groups: dict[str, tuple[str, list[str]]], created: str) -> DataFrame:
    """One row for each key. Each field group (name: timestamp and fields) comes whole from its own winner: a timestamp before none, the
    latest, the most fields filled, the lower priority number. The creation time is the earliest of all."""
    best = rows.groupBy(key).agg(*[_winner(fields, stamp).alias(f"_{g}") for g, (stamp, fields) in groups.items()], F.min(created).alias(created), F.array_join(F.array_sort(F.collect_set("source_code")), ",").alias("source_codes"))
    told = [F.col(f"_{g}.{f}").alias(f) for g, (stamp, fields) in groups.items() for f in [*fields, stamp]]
    return best.select(key, created, "source_codes", *told, *[F.col(f"_{g}.source_code").alias(f"{g}_source") for g in groups])


def upserted(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """New values over old ones, column by column; null and empty new values leave the old."""
    a, b = old.alias("a"), new.alias("b")
    both = a.join(b, key, "full_outer")
    fresh = lambda f: F.nullif(F.col(f"b.{f}"), F.lit("")) if dict(new.dtypes)[f] == "string" else F.col(f"b.{f}")
    return both.select(key, *[F.coalesce(fresh(f), F.col(f"a.{f}")).alias(f) for f in fields])


def latest_attempt(rows: DataFrame, item: str, attempt: str) -> DataFrame:
    """The rows of each item's latest attempt, whole, which makes a rewrite harmless."""
    w = Window.partitionBy(item)
    return rows.withColumn("_last", F.max(attempt).over(w)).filter(F.col(attempt).eqNullSafe(F.col("_last"))).drop("_last")


# --- plans and cohorts


def plan_violations(plan: DataFrame, sources: list[str], slots: list[str]) -> DataFrame:
    """How often each rule on plan rows is broken; all rules are listed."""
    rules = {
        "unknown_source": ~F.coalesce(F.col("owner_source").isin(sources), F.lit(False)),
        "unknown_slot": ~F.coalesce(F.col("schedule_slot").isin(slots), F.lit(False)),
        "slot_length": F.length("schedule_slot") > 16,
        "checkin_before_crawl": F.coalesce(F.col("checkin_date") < F.col("crawl_date"), F.lit(True)),
    }
    wide = plan.agg(*[F.count_if(F.coalesce(c, F.lit(True))).alias(n) for n, c in rules.items()])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("n_violations")) for n in rules])).alias("x")).select("x.*")


def plan_conflicts(plan: DataFrame) -> DataFrame:
    """(day, night) with more than one owner."""
    return plan.groupBy("crawl_date", "checkin_date").agg(F.countDistinct("owner_source").alias("n_owners"), F.array_join(F.array_sort(F.collect_set("owner_source")), ",").alias("owners")).filter("n_owners > 1")


def cohort_ranges(versions: DataFrame) -> DataFrame:
    """Members of each version with the days for which it holds. versions: label, effective_from, hotel_id, city."""
    days = versions.select("label", "effective_from").distinct()
    until = F.lead("effective_from").over(Window.orderBy("effective_from"))  # a row for each version
    return versions.join(F.broadcast(days.withColumn("effective_until", until)), ["label", "effective_from"])


def in_cohort(items: DataFrame, versions: DataFrame, day: str = "crawl_date") -> DataFrame:
    """Adds hotel_in_cohort: whether the hotel is a member in the version of that day, never of a later one."""
    members = cohort_ranges(versions).select(F.col("hotel_id").alias("_hotel"), "effective_from", "effective_until")
    holds = (F.col("hotel_id") == F.col("_hotel")) & (F.col(day) >= F.col("effective_from")) & (F.col("effective_until").isNull() | (F.col(day) < F.col("effective_until")))
    matched = items.join(members, holds, "left")
    return matched.withColumn("hotel_in_cohort", F.col("_hotel").isNotNull()).drop("_hotel", "effective_from", "effective_until")


def cohort_sizes(versions: DataFrame) -> DataFrame:
    """Size of each version and its change to the one before; the first has none."""
    sizes = versions.groupBy("label", "effective_from").agg(F.countDistinct("hotel_id").alias("n_hotels"))
    before = F.lag("n_hotels").over(Window.orderBy("effective_from"))  # a row for each version
    return sizes.withColumn("change", F.col("n_hotels") - before)


def cohort_faults(versions: DataFrame) -> DataFrame:
    """Hotels with two cities over the versions, and days that two versions begin on."""
    cities = versions.groupBy("hotel_id").agg(F.countDistinct("city").alias("n")).filter("n > 1").select(F.lit("two_cities").alias("fault"), F.col("hotel_id").cast("string").alias("subject"))
    days = versions.select("label", "effective_from").distinct().groupBy("effective_from").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit("same_day").alias("fault"), F.col("effective_from").cast("string").alias("subject"))
    return cities.unionByName(days)


# --- ownership


def owned_runs(runs: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds planned: whether the source plans anything on the run's day."""
    days = plan.select(F.col("owner_source").alias("source_code"), "crawl_date").distinct().withColumn("planned", F.lit(True))
    return runs.join(days, ["source_code", "crawl_date"], "left").withColumn("planned", F.coalesce("planned", F.lit(False)))


def resolve_ownership(items: DataFrame, plan: DataFrame) -> DataFrame:
    """ownership_status, exclusion_reason and flags of each item, in fixed precedence.

    items: source_code, crawl_date, checkin_date, status, hotel_id, hotel_in_cohort, run_planned. The plan is looked up by day and night
    alone; its owner is compared after. A day and night of two owners is an error; repeated plan rows are one.
    """
    two = F.raise_error(F.concat_ws(" ", F.lit("two owners of"), F.col("crawl_date").cast("string"), F.col("checkin_date").cast("string"))).cast("string")
    owners = plan.groupBy("crawl_date", "checkin_date").agg(F.min("owner_source").alias("owner_source"), F.max("owner_source").alias("_other"))
    rows = items.join(owners.select("crawl_date", "checkin_date", F.when(F.col("owner_source") != F.col("_other"), two).otherwise(F.col("owner_source")).alias("owner_source")), ["crawl_date", "checkin_date"], "left")
    days = plan.select(F.col("owner_source").alias("source_code"), "crawl_date").distinct().withColumn("_plans_day", F.lit(True))
    nights = plan.select(F.col("owner_source").alias("source_code"), "checkin_date").distinct().withColumn("_plans_night", F.lit(True))
    window = plan.groupBy(F.col("owner_source").alias("source_code")).agg(F.min("crawl_date").alias("_first"), F.max("crawl_date").alias("_last"))
    rows = rows.join(days, ["source_code", "crawl_date"], "left").join(nights, ["source_code", "checkin_date"], "left").join(F.broadcast(window), "source_code", "left")
    day_reason = F.when(F.col("_first").isNull(), "run_not_in_plan").when(F.col("crawl_date") < F.col("_first"), "before_first_day").when(F.col("crawl_date") > F.col("_last"), "after_last_day").otherwise("day_not_in_plan")
    off_plan = F.when(F.col("_plans_day").isNull(), day_reason).when(F.col("_plans_night").isNotNull(), "night_planned_on_other_day").otherwise("night_never_planned")
    foreign = F.col("owner_source") != F.col("source_code")
    outside = F.col("hotel_id").isNotNull() & ~F.col("hotel_in_cohort")
    status = F.when(F.col("owner_source").isNull(), "unassigned").when(foreign, "non_owner_duplicate").when(outside, "protocol_deviation").when(F.col("status") == "success", "owner_success").otherwise("owner_failure")
    reason = F.when(F.col("owner_source").isNull(), off_plan).when(foreign, "non_owner_duplicate").when(outside, "hotel_outside_cohort").when(F.col("status") != "success", F.concat(F.lit("owner_failure_status_"), F.col("status")))
    rows = rows.withColumn("ownership_status", status).withColumn("exclusion_reason", reason)
    own = F.col("ownership_status")
    run = F.col("run_planned")
    rows = rows.withColumn("include_raw", F.lit(True)).withColumn("include_main", own.isin("owner_success", "owner_failure") & run).withColumn("include_reference", (own == "owner_success") & run)
    return rows.drop("_plans_day", "_plans_night", "_first", "_last")


# --- rejects and gates


def split_rejects(rows: DataFrame, table: str, pk: str, faults: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows without a fault, and the others with the first fault as reason and the raw row as JSON."""
    reason = F.coalesce(*[F.when(c, F.lit(n)) for n, c in faults.items()])
    told = rows.withColumn("_reason", reason)
    bad = told.filter("_reason is not null")
    return told.filter("_reason is null").drop("_reason"), bad.select("source_code", F.lit(table).alias("table_name"), F.col(pk).cast("string").alias("source_pk"), F.col("_reason").alias("reason"), F.to_json(F.struct(*rows.columns)).alias("raw"))


def cascade(rows: DataFrame, table: str, pk: str, parent: str, rejected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose parent was not rejected, and rejects for the others. rejected: source_code, source_pk (as text)."""
    gone = rejected.select("source_code", F.col("source_pk").alias("_parent")).distinct()
    held = rows.withColumn("_parent", F.col(parent).cast("string"))
    lost = held.join(gone, ["source_code", "_parent"], "left_semi")
    return held.join(gone, ["source_code", "_parent"], "left_anti").drop("_parent"), lost.select("source_code", F.lit(table).alias("table_name"), F.col(pk).cast("string").alias("source_pk"), F.lit("parent_rejected").alias("reason"), F.to_json(F.struct(*rows.columns)).alias("raw"))


def reconcile(source: DataFrame, imported: DataFrame, rejects: DataFrame) -> DataFrame:
    """Source rows against imported and rejected ones, for each source and table. source, imported: source_code, table_name."""
    n = F.lit(1).cast("long")
    zero = F.lit(0).cast("long")
    parts = [df.select("source_code", "table_name", *[x.alias(c) for c, x in zip(("s", "i", "e", "p"), kinds, strict=True)]) for df, kinds in ((source, (n, zero, zero, zero)), (imported, (zero, n, zero, zero)), (rejects.filter("reason <> 'parent_rejected'"), (zero, zero, n, zero)), (rejects.filter("reason = 'parent_rejected'"), (zero, zero, zero, n)))]
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    out = rows.groupBy("source_code", "table_name").agg(F.sum("s").alias("n_source"), F.sum("i").alias("n_imported"), F.sum("e").alias("n_row_error"), F.sum("p").alias("n_parent_rejected"))
    return out.withColumn("ok", F.col("n_source") == F.col("n_imported") + F.col("n_row_error") + F.col("n_parent_rejected"))


def reconcile_hotels(source: DataFrame, rejected: DataFrame, merged: DataFrame, key: str) -> DataFrame:
    """One row: hotel rows of all sources, rejected and accepted ones, distinct merged keys, rows that repeat a key, and
    whether the merged table has each accepted key once. Keys may be null in none of them; empty tables reconcile."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    accepted = source.join(rejected.select(key).distinct(), key, "left_anti").agg(F.countDistinct(key).alias("_keys"))
    wide = n(source, "n_source").crossJoin(n(rejected, "n_rejected")).crossJoin(merged.agg(F.count(F.lit(1)).alias("_rows"), F.countDistinct(key).alias("n_distinct"))).crossJoin(accepted)
    out = wide.withColumn("n_accepted", F.col("n_source") - F.col("n_rejected")).withColumn("n_duplicate_keys", F.col("n_accepted") - F.col("n_distinct"))
    return out.select("n_source", "n_rejected", "n_accepted", "n_distinct", "n_duplicate_keys", ((F.col("_rows") == F.col("n_distinct")) & (F.col("_keys") == F.col("n_distinct"))).alias("ok"))


def checks(parts: dict[str, DataFrame]) -> DataFrame:
    """A check table: the number of rows of each violation frame, and whether it is none."""
    counted = [df.agg(F.count(F.lit(1)).alias("n_violations")).select(F.lit(name).alias("check_name"), "n_violations") for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b), counted).withColumn("ok", F.col("n_violations") == 0)


def gate(check_table: DataFrame) -> DataFrame:
    """One row: passed only if every check is ok."""
    return check_table.agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("passed"), F.count(F.lit(1)).alias("n_checks"), F.count_if(~F.col("ok")).alias("n_failed"))


def timestamp_audit(source: DataFrame, merged: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys whose timestamps differ between source and merged rows; null equals null."""
    both = source.select(key, *[F.col(c).alias(f"s_{c}") for c in columns]).join(merged.select(key, *columns), key)
    differs = reduce(lambda a, b: a | b, [~F.col(f"s_{c}").eqNullSafe(F.col(c)) for c in columns])
    return both.filter(differs).select(key)


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return child.filter(F.col(key).isNotNull()).join(parent.select(key), key, "left_anti")


def repeated(df: DataFrame, *key: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def readiness(versions: DataFrame, **counts: DataFrame) -> DataFrame:
    """Dataset versions that passed and have rows in each of the tables given."""
    out = versions
    for name, df in counts.items():
        out = out.join(df.groupBy("dataset_version").agg(F.count(F.lit(1)).alias(name)), "dataset_version", "left").fillna(0, [name])
    ok = reduce(lambda a, b: a & b, [F.col(n) > 0 for n in counts], F.col("status") == "pass")
    return out.withColumn("ready", ok)


def run_counters(items: DataFrame) -> DataFrame:
    """A run's counters from its items: all, those that ended, by status, and whether it is complete."""
    ended = F.col("status").isin("success", "partial", "sold_out", "not_bookable", "error")
    statuses = ["success", "partial", "sold_out", "not_bookable", "error"]
    out = items.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_total"), F.count_if(ended).alias("n_processed"), *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in statuses])
    return out.withColumn("complete", F.col("n_total") == F.col("n_processed"))
