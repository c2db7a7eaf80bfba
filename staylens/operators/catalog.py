"""The metric catalogue: each metric has a declared scope and set of columns, enforced when it is run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import timeaxis as ta
from ..functions.stats import count_if, grouped_quantiles, overall_quantiles, quantile, r6, rate
from ..sources.bindings import CITIES, STATUSES, Warehouse

Metric = Callable[[Warehouse], DataFrame]


@dataclass(frozen=True)
class Entry:
    fn: Metric
    scope: str
    columns: tuple[str, ...]


CATALOG: dict[str, Entry] = {}


class ContractError(ValueError):
    """A metric returned other columns than it declares."""


def metric(scope: str, columns: str) -> Callable[[Metric], Metric]:
    def put(fn: Metric) -> Metric:
        if fn.__name__ in CATALOG:
            raise KeyError(f"metric {fn.__name__} is registered twice")
        CATALOG[fn.__name__] = Entry(fn, scope, tuple(columns.split()))
        return fn

    return put


def run_metric(name: str, warehouse: Warehouse) -> DataFrame:
    """The metric's table, or ContractError; the plan is looked at, nothing is run."""
    entry = CATALOG[name]
    out = entry.fn(warehouse)
    if set(out.columns) != set(entry.columns):
        raise ContractError(f"{name}: columns {sorted(out.columns)}, declared {sorted(entry.columns)}")
    return out


FLAGS = {"RAW": "include_raw", "MAIN": "include_main", "REFERENCE": "include_reference"}
STATUS_COUNTS = "n_success n_sold_out n_not_bookable n_partial n_error n_items"
POINTS = [0.01, 0.05, 0.25, 0.50, 0.75, 0.95, 0.99]
PRICE_STATS = "n_obs min_price max_price mean_price p1 p5 p25 p50 p75 p95 p99"


def scope(df: DataFrame, name: str) -> DataFrame:
    return df.filter(F.col(FLAGS[name]))


def observed(w: Warehouse, name: str | None = "MAIN", extra: tuple[str, ...] = ()) -> DataFrame:
    """Observations of the items in scope, with what the items tell besides."""
    items = scope(w.items, name) if name else w.items
    have = set(w.observations.columns)
    told = [c for c in ("source_code", "status", "selector_version", "include_main", *extra) if c in items.columns and c not in have]
    return w.observations.join(items.select("item_id", *told), "item_id")


def priced(w: Warehouse, name: str = "MAIN") -> DataFrame:
    """Available observations with a price."""
    return observed(w, name).filter(~F.col("is_sold_out") & F.col("price_per_night").isNotNull())


def with_city(df: DataFrame, w: Warehouse) -> DataFrame:
    """Adds the hotel's city; a hotel without one is (unknown)."""
    if "city" in df.columns:
        return df.withColumn("city", F.coalesce("city", F.lit(ta.UNKNOWN)))
    return df.join(w.hotels.select("hotel_id", "city"), "hotel_id", "left").withColumn("city", F.coalesce("city", F.lit(ta.UNKNOWN)))


def status_counts(items: DataFrame, *by: str | Column) -> DataFrame:
    """Items by status, and all; no item has any other status."""
    return items.groupBy(*by).agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUSES], F.count(F.lit(1)).alias("n_items"))


def price_stats(df: DataFrame, *by: str | Column, more: list[Column] | None = None) -> DataFrame:
    """Count, extremes, mean and quantiles of the price; without a group no task holds all prices. Null prices are left out."""
    p = F.col("price_per_night")
    if not by and not more:
        told = df.agg(F.count(p).alias("n_obs"), r6(F.min(p)).alias("min_price"), r6(F.max(p)).alias("max_price"), r6(F.avg(p.cast("double"))).alias("mean_price"))
        points = overall_quantiles(df, "price_per_night", POINTS)
        return told.crossJoin(points).select(*told.columns, *[r6(c).alias(c) for c in points.columns])
    out = df.groupBy(*by).agg(F.count(p).alias("n_obs"), r6(F.min(p)).alias("min_price"), r6(F.max(p)).alias("max_price"), r6(F.avg(p.cast("double"))).alias("mean_price"), F.percentile(p.cast("double"), F.array(*[F.lit(x) for x in POINTS])).alias("_q"), *(more or []))
    return out.select("*", *[r6(F.col("_q")[i]).alias(f"p{round(x * 100)}") for i, x in enumerate(POINTS)]).drop("_q")


# --- preflight and identity


@metric("RAW", "hotels crawl_runs crawl_run_items price_observations curated_observation_keys")
def preflight_core_counts(w):
    tables = {"hotels": w.hotels, "crawl_runs": w.runs, "crawl_run_items": w.items, "price_observations": w.observations, "curated_observation_keys": w.observations.filter("room_key is not null")}
    rows = None
    for name, df in tables.items():
        one = df.select(F.lit(name).alias("t"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.agg(*[F.count_if(F.col("t") == n).alias(n) for n in tables])


@metric("RAW", "non_terminal_runs non_terminal_items")
def preflight_non_terminal_runs_items(w):
    runs = w.runs.agg(count_if(~F.col("status").isin("completed", "failed")).alias("non_terminal_runs"))
    return runs.crossJoin(w.items.agg(count_if(~F.col("status").isin(STATUSES)).alias("non_terminal_items")))


@metric("RAW", "n_rejections n_unwaived")
def preflight_rejections(w):
    return w.rejections.agg(F.count(F.lit(1)).alias("n_rejections"), F.count_if(~F.col("waived")).alias("n_unwaived"))


@metric("RAW", "source_code source_priority dump_name")
def preflight_import_sources(w):
    return w.sources.join(w.items.select("source_code").distinct(), "source_code", "left_semi").select("source_code", "source_priority", "dump_name")


@metric("RAW", "source_code ownership_status exclusion_reason n_items")
def ownership_by_source_status_reason(w):
    return w.items.groupBy("source_code", "ownership_status", "exclusion_reason").agg(F.count(F.lit(1)).alias("n_items"))


@metric("RAW", "source_code vn_crawl_date runs items observations")
def run_item_observation_by_source_crawl_date(w):
    return w.observations.groupBy("source_code", F.col("crawl_date").alias("vn_crawl_date")).agg(F.countDistinct("run_id").alias("runs"), F.countDistinct("item_id").alias("items"), F.count(F.lit(1)).alias("observations"))


@metric("RAW", "source_code n_items_raw n_items_main n_observations_raw n_observations_main n_priced_observations_raw n_priced_observations_main")
def raw_vs_main_by_source(w):
    per_item = w.observations.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("is_sold_out") & F.col("price_per_night").isNotNull()).alias("priced"))
    rows = w.items.join(per_item, "item_id", "left").fillna(0, ["n", "priced"])
    pair = lambda name, x: [F.sum(F.when(F.col(f"include_{s}"), x).otherwise(0)).alias(f"n_{name}_{s}") for s in ("raw", "main")]
    return rows.groupBy("source_code").agg(*pair("items", F.lit(1)), *pair("observations", F.col("n")), *pair("priced_observations", F.col("priced")))


# --- availability by status


@metric("MAIN", STATUS_COUNTS)
def item_status_counts_overall_main(w):
    return status_counts(scope(w.items, "MAIN"))


@metric("MAIN", f"city {STATUS_COUNTS}")
def item_status_counts_by_city_main(w):
    return status_counts(with_city(scope(w.items, "MAIN"), w), "city")


@metric("MAIN", f"hotel_id city {STATUS_COUNTS}")
def item_status_counts_by_hotel_main(w):
    return status_counts(with_city(scope(w.items, "MAIN"), w), "hotel_id", "city")


def month(x: str) -> Column:
    return F.date_format(x, "yyyy-MM")


@metric("MAIN", f"checkin_month {STATUS_COUNTS}")
def item_status_counts_by_checkin_month_main(w):
    return status_counts(scope(w.items, "MAIN"), month("checkin_date").alias("checkin_month"))


@metric("MAIN", f"lead_time_bucket {STATUS_COUNTS}")
def item_status_counts_by_lead_time_bucket_main(w):
    return status_counts(scope(w.items, "MAIN"), ta.item_bucket("lead_time").alias("lead_time_bucket"))


@metric("MAIN", f"crawl_date hotel_id {STATUS_COUNTS}")
def item_status_counts_by_crawl_date_hotel_main(w):
    return status_counts(scope(w.items, "MAIN"), "crawl_date", "hotel_id")


@metric("RAW", f"source_code vn_crawl_date {STATUS_COUNTS}")
def run_day_status_counts_raw(w):
    return status_counts(scope(w.items, "RAW"), "source_code", F.col("crawl_date").alias("vn_crawl_date"))


@metric("RAW", "source_code vn_crawl_date status last_error_code n_items")
def run_day_error_code_counts_raw(w):
    return scope(w.items, "RAW").filter("status <> 'success'").groupBy("source_code", F.col("crawl_date").alias("vn_crawl_date"), "status", F.col("error_code").alias("last_error_code")).agg(F.count(F.lit(1)).alias("n_items"))


# --- history


@metric("MAIN", "city history_days_bucket n_series sum_span_days")
def history_length_by_hotel_checkin_main(w):
    per = observed(w).groupBy("hotel_id", "room_key").agg(F.countDistinct("crawl_date").alias("days"), (F.date_diff(F.max("crawl_date"), F.min("crawl_date")) + 1).alias("span"))
    label = F.when(F.col("days") == 1, "1").when(F.col("days") <= 3, "2-3").when(F.col("days") <= 7, "4-7").when(F.col("days") <= 14, "8-14").when(F.col("days") <= 30, "15-30").otherwise("31+")
    return with_city(per, w).groupBy("city", label.alias("history_days_bucket")).agg(F.count(F.lit(1)).alias("n_series"), F.sum("span").alias("sum_span_days"))


# --- prices


@metric("MAIN", PRICE_STATS)
def price_distribution_overall_main(w):
    return price_stats(priced(w))


@metric("RAW", PRICE_STATS)
def price_distribution_overall_raw(w):
    return price_stats(priced(w, "RAW"))


@metric("MAIN", f"city {PRICE_STATS}")
def price_distribution_by_city_main(w):
    return price_stats(with_city(priced(w), w), "city")


@metric("MAIN", f"lead_time_bucket {PRICE_STATS}")
def price_distribution_by_lead_time_bucket_main(w):
    return price_stats(priced(w), ta.bucket("lead_time").alias("lead_time_bucket"))


def weekday_parts(day: str) -> list[Column]:
    """Number (Monday is 0), name, and whether it is a Friday or Saturday."""
    return [F.weekday(day).alias("weekday_number"), F.date_format(day, "EEEE").alias("weekday"), F.dayofweek(day).isin(6, 7).alias("is_weekend_fri_sat")]


@metric("MAIN", f"weekday_number weekday is_weekend_fri_sat {PRICE_STATS} n_distinct_checkin_dates")
def price_distribution_by_weekday_main(w):
    return price_stats(priced(w), *weekday_parts("checkin_date"), more=[F.countDistinct("checkin_date").alias("n_distinct_checkin_dates")])


@metric("MAIN", "city n_obs min_price max_price mean_price p5 p25 p50 p75 p95")
def price_box_stats_by_city_main(w):
    return price_stats(with_city(priced(w), w), "city").drop("p1", "p99")


@metric("MAIN", "hotel_id n_obs min_price max_price mean_price p50 std_price coefficient_of_variation")
def price_hotel_dispersion_main(w):
    p = F.col("price_per_night").cast("double")
    out = priced(w).groupBy("hotel_id").agg(F.count(p).alias("n_obs"), r6(F.min(p)).alias("min_price"), r6(F.max(p)).alias("max_price"), F.avg(p).alias("mean"), r6(quantile(p, 0.5)).alias("p50"), F.stddev_samp(p).alias("std")).filter("n_obs >= 5")
    return out.select("hotel_id", "n_obs", "min_price", "max_price", r6("mean").alias("mean_price"), "p50", r6("std").alias("std_price"), r6(rate("std", "mean")).alias("coefficient_of_variation"))


@metric("MAIN", "hotel_id checkin_date vn_observation_date n_options min_price median_price")
def price_sensitivity_by_series_main(w):
    return priced(w).groupBy("hotel_id", "checkin_date", F.col("crawl_date").alias("vn_observation_date")).agg(F.count(F.lit(1)).alias("n_options"), r6(F.min("price_per_night")).alias("min_price"), r6(quantile("price_per_night", 0.5)).alias("median_price"))


@metric("MAIN", "bin_index bin_lo bin_hi n_obs")
def price_histogram_linear_main(w, bins: int = 80):
    """Equal bins between the least and largest price; the last one is closed, and no width at all counts as 1."""
    p = priced(w).select(F.col("price_per_night").cast("double").alias("p"))
    ends = p.agg(F.min("p").alias("lo"), F.max("p").alias("hi")).select("lo", F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(1.0).alias("width"))
    at = F.least(F.floor((F.col("p") - F.col("lo")) / F.col("width")), F.lit(bins - 1)).cast("int")
    rows = p.crossJoin(F.broadcast(ends)).groupBy(at.alias("bin_index"), "lo", "width").agg(F.count(F.lit(1)).alias("n_obs"))
    return rows.select("bin_index", r6(F.col("lo") + F.col("bin_index") * F.col("width")).alias("bin_lo"), r6(F.col("lo") + (F.col("bin_index") + 1) * F.col("width")).alias("bin_hi"), "n_obs")


@metric("MAIN", "bin_index log10_lo log10_hi price_lo price_hi n_obs")
def price_histogram_log10_main(w, per_decade: int = 20):
    p = priced(w).filter("price_per_night > 0")
    rows = p.groupBy(F.floor(F.log10(F.col("price_per_night").cast("double")) * per_decade).cast("int").alias("bin_index")).agg(F.count(F.lit(1)).alias("n_obs"))
    lo, hi = F.col("bin_index") / per_decade, (F.col("bin_index") + 1) / per_decade
    return rows.select("bin_index", r6(lo).alias("log10_lo"), r6(hi).alias("log10_hi"), F.round(F.pow(F.lit(10.0), lo), 4).alias("price_lo"), F.round(F.pow(F.lit(10.0), hi), 4).alias("price_hi"), "n_obs")


def robust_levels(df: DataFrame, by: str = "hotel_id", price: str = "price_per_night", least: int = 5) -> tuple[DataFrame, DataFrame]:
    """Median and median absolute deviation (MAD) of groups of `least` prices or more, and their distinct prices with how often they occur.

    Prices are counted once, and both quantiles are picked from the counts, so a hot group is never in one task. Null prices
    are left out, and so are rows without a group.
    """
    counted = df.filter(F.col(price).isNotNull() & F.col(by).isNotNull()).groupBy(by, F.col(price).cast("double").alias("price")).agg(F.count(F.lit(1)).alias("n"))
    medians = grouped_quantiles(counted, [by], "price", [0.5], "n").filter(F.col("n_values") >= least).select(by, F.col("n_values").alias("group_obs"), F.col("p50").alias("median_price"))
    near = counted.join(medians, by).withColumn("distance", F.abs(F.col("price") - F.col("median_price")))
    mad = grouped_quantiles(near, [by], "distance", [0.5], "n").select(by, F.col("p50").alias("price_mad"))
    return medians.join(mad, by), near


def distance_in_mads(distance: Column) -> Column:
    """Scaled median absolute deviations; a MAD of 0 gives none."""
    return F.when(F.col("price_mad") > 0, distance / (1.4826 * F.col("price_mad")))


@metric("MAIN", "hotel_id city n_obs hotel_median_price price_mad n_outliers max_robust_z")
def price_outlier_summary_by_hotel_main(w, z: float = 5.0):
    levels, near = robust_levels(priced(w))
    out = near.select("hotel_id", "distance", "n").join(levels, "hotel_id").withColumn("robust_z", distance_in_mads(F.col("distance")))
    out = out.groupBy("hotel_id", F.col("group_obs").alias("n_obs"), r6("median_price").alias("hotel_median_price"), r6("price_mad").alias("price_mad")).agg(F.coalesce(F.sum(F.when(F.col("robust_z") >= z, F.col("n"))), F.lit(0)).alias("n_outliers"), r6(F.max("robust_z")).alias("max_robust_z"))
    return with_city(out, w)


@metric("MAIN", "record_id hotel_id checkin_date vn_observation_date price_per_night hotel_median_price price_mad price_robust_z")
def price_outlier_sample_main(w, z: float = 5.0, most: int = 200):
    """The feature is a top list: the largest distances, ties by record."""
    rows = priced(w)
    told = rows.join(robust_levels(rows)[0], "hotel_id").withColumn("robust_z", distance_in_mads(F.abs(F.col("price_per_night").cast("double") - F.col("median_price"))))
    out = told.filter(F.col("robust_z") >= z).withColumn("z", r6("robust_z")).orderBy(F.desc("z"), "record_id").limit(most)
    return out.select("record_id", "hotel_id", "checkin_date", F.col("crawl_date").alias("vn_observation_date"), r6("price_per_night").alias("price_per_night"), r6("median_price").alias("hotel_median_price"), r6("price_mad").alias("price_mad"), F.col("z").alias("price_robust_z"))


# --- coverage


@metric("MAIN", "lead_time_bucket n_observations")
def lead_time_bucket_distribution_main(w):
    """All buckets, those without observations too."""
    got = observed(w).groupBy(ta.bucket("lead_time").alias("lead_time_bucket")).agg(F.count(F.lit(1)).alias("n"))
    return ta.bucket_table(w.spark).join(got, "lead_time_bucket", "left").select("lead_time_bucket", F.coalesce("n", F.lit(0)).alias("n_observations"))


@metric("MAIN", "city source_code lead_time_bucket n_observations")
def lead_time_bucket_distribution_by_city_source_main(w):
    return with_city(observed(w), w).groupBy("city", "source_code", ta.bucket("lead_time").alias("lead_time_bucket")).agg(F.count(F.lit(1)).alias("n_observations"))


@metric("MAIN", "weekday_number weekday is_weekend_fri_sat n_observations n_distinct_checkin_dates")
def checkin_weekday_distribution_main(w):
    return observed(w).groupBy(*weekday_parts("checkin_date")).agg(F.count(F.lit(1)).alias("n_observations"), F.countDistinct("checkin_date").alias("n_distinct_checkin_dates"))


@metric("MAIN", "checkin_month n_observations n_distinct_checkin_dates")
def checkin_month_distribution_main(w):
    return observed(w).groupBy(month("checkin_date").alias("checkin_month")).agg(F.count(F.lit(1)).alias("n_observations"), F.countDistinct("checkin_date").alias("n_distinct_checkin_dates"))


@metric("MAIN", "checkin_date city n_observations")
def observation_counts_by_checkin_date_city_main(w):
    return with_city(observed(w), w).groupBy("checkin_date", "city").agg(F.count(F.lit(1)).alias("n_observations"))


@metric("MAIN", "observed_date_min observed_date_max checkin_date_min checkin_date_max")
def observation_date_ranges_main(w):
    return observed(w).agg(F.min("crawl_date").alias("observed_date_min"), F.max("crawl_date").alias("observed_date_max"), F.min("checkin_date").alias("checkin_date_min"), F.max("checkin_date").alias("checkin_date_max"))


@metric("RAW", "source_code vn_crawl_date n_active_hotels")
def active_hotel_by_crawl_date_source(w):
    return owned(w.items).groupBy("source_code", F.col("crawl_date").alias("vn_crawl_date")).agg(F.countDistinct("hotel_id").alias("n_active_hotels"))


def owned(items: DataFrame) -> DataFrame:
    """Items whose source answers for them."""
    return items.filter(F.col("ownership_status").startswith("owner_"))


@metric("RAW", "source_code vn_crawl_date city n_active_hotels")
def active_hotel_by_crawl_date_source_city(w):
    return with_city(owned(w.items).filter("hotel_id is not null"), w).groupBy("source_code", F.col("crawl_date").alias("vn_crawl_date"), "city").agg(F.countDistinct("hotel_id").alias("n_active_hotels"))


@metric("RAW", "source_code vn_crawl_date n_checkin_dates_tracked")
def checkin_dates_tracked_by_crawl_date_source(w):
    return owned(w.items).groupBy("source_code", F.col("crawl_date").alias("vn_crawl_date")).agg(F.countDistinct("checkin_date").alias("n_checkin_dates_tracked"))


@metric("MAIN", "vn_crawl_date lead_time_bucket n_items")
def crawl_date_lead_time_bucket_heatmap(w):
    return scope(w.items, "MAIN").groupBy(F.col("crawl_date").alias("vn_crawl_date"), ta.item_bucket("lead_time").alias("lead_time_bucket")).agg(F.count(F.lit(1)).alias("n_items"))


def _identity(items: DataFrame) -> DataFrame:
    link = F.when(F.col("hotel_id").isNull(), F.col("link"))
    return items.select("item_id", "source_code", "crawl_date", "checkin_date", "hotel_id", link.alias("source_hotel_link"), F.sha2(link, 256).alias("source_link_hash"), F.col("status").alias("item_status"), "ownership_status", F.col("finished_at").alias("item_finished_at"))


@metric("RAW", "item_id source_code crawl_date checkin_date hotel_id source_hotel_link source_link_hash item_status ownership_status item_finished_at")
def item_identity_actual_raw(w):
    return _identity(scope(w.items, "RAW"))


@metric("RAW", "item_id source_code crawl_date checkin_date hotel_id source_hotel_link source_link_hash item_status ownership_status item_finished_at outcome")
def protocol_continuity_actual(w):
    return _identity(owned(w.items)).withColumn("outcome", F.when(F.col("ownership_status") == "owner_success", "success").otherwise(F.regexp_replace("ownership_status", "^owner_failure_", "")))


# --- quality


@metric("RAW", "n_violations n_total")
def quality_price_total_per_night_inconsistent(w):
    known = observed(w, "RAW").filter("price_total is not null and price_per_night is not null")
    return known.agg(count_if(F.abs(F.col("price_total") - F.col("price_per_night")) > 1e-9).alias("n_violations"), F.count(F.lit(1)).alias("n_total"))


@metric("RAW", "n_violations n_total")
def quality_price_non_positive(w):
    return observed(w, "RAW").filter(~F.col("is_sold_out")).agg(count_if(F.col("price_per_night").isNull() | (F.col("price_per_night") <= 0)).alias("n_violations"), F.count(F.lit(1)).alias("n_total"))


@metric("RAW", "n_violations")
def quality_checkout_not_after_checkin(w):
    return scope(w.items, "RAW").agg(count_if(F.date_diff("checkout_date", "checkin_date") != 1).alias("n_violations"))


@metric("RAW", "n_violations n_total")
def quality_success_item_without_observation(w):
    done = scope(w.items, "RAW").filter("status = 'success'")
    have = w.observations.select("item_id", F.lit(True).alias("has")).distinct()
    return done.join(have, "item_id", "left").agg(count_if(F.col("has").isNull()).alias("n_violations"), F.count(F.lit(1)).alias("n_total"))


@metric("RAW", "n_nonsoldout_missing_canonical n_soldout_with_room_key n_total")
def quality_canonical_key_anomalies(w):
    return observed(w, "RAW").agg(count_if(~F.col("is_sold_out") & F.col("room_key").isNull()).alias("n_nonsoldout_missing_canonical"), count_if(F.col("is_sold_out") & F.col("room_key").isNotNull()).alias("n_soldout_with_room_key"), F.count(F.lit(1)).alias("n_total"))


@metric("RAW", "n_violations n_total")
def quality_city_outside_scope(w):
    return w.hotels.agg(count_if(F.col("city").isNull() | ~F.col("city").isin(CITIES)).alias("n_violations"), F.count(F.lit(1)).alias("n_total"))


@metric("RAW", "n_mismatch n_total")
def quality_lead_time_mismatch(w):
    return observed(w, "RAW").agg(count_if(~F.col("lead_time").eqNullSafe(ta.lead_time("checkin_date", "observed_at"))).alias("n_mismatch"), F.count(F.lit(1)).alias("n_total"))


DUPLICATE_KEY = ("item_id", "room_key", "rate_key")


@metric("RAW", "n_duplicate_groups n_extra_observations n_total_groups")
def quality_duplicate_daily_series(w):
    groups = observed(w, "RAW").filter(~F.col("is_sold_out")).groupBy(*DUPLICATE_KEY).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.count_if(F.col("n") > 1).alias("n_duplicate_groups"), F.coalesce(F.sum(F.greatest(F.col("n") - 1, F.lit(0))), F.lit(0)).alias("n_extra_observations"), F.count(F.lit(1)).alias("n_total_groups"))


@metric("RAW", "source_code city item_id room_key rate_key n_rows min_price max_price")
def duplicate_series_groups(w):
    return with_city(observed(w, "RAW"), w).filter(~F.col("is_sold_out")).groupBy("source_code", "city", *DUPLICATE_KEY).agg(F.count(F.lit(1)).alias("n_rows"), r6(F.min("price_per_night")).alias("min_price"), r6(F.max("price_per_night")).alias("max_price")).filter("n_rows > 1")


@metric("RAW", "source_code city n_observations_raw n_observations_main")
def duplicate_series_observation_totals(w):
    rows = with_city(observed(w, "RAW"), w).filter(~F.col("is_sold_out"))
    return rows.groupBy("source_code", "city").agg(F.count(F.lit(1)).alias("n_observations_raw"), F.count_if("include_main").alias("n_observations_main"))


@metric("RAW", "n_mismatch n_total")
def quality_parent_mismatch(w):
    """Observations whose hotel or night is not the item's; null equals null."""
    item = scope(w.items, "RAW").select("item_id", F.col("hotel_id").alias("item_hotel"), F.col("checkin_date").alias("item_checkin"))
    return w.observations.join(item, "item_id").agg(count_if(~F.col("hotel_id").eqNullSafe(F.col("item_hotel")) | ~F.col("checkin_date").eqNullSafe(F.col("item_checkin"))).alias("n_mismatch"), F.count(F.lit(1)).alias("n_total"))


@metric("RAW", "n_violations n_total")
def quality_sold_out_sentinel_consistency(w):
    """A sold-out item has exactly one sentinel."""
    marks = w.observations.filter("is_sold_out").groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return scope(w.items, "RAW").filter("status = 'sold_out'").join(marks, "item_id", "left").agg(count_if(F.coalesce("n", F.lit(0)) != 1).alias("n_violations"), F.count(F.lit(1)).alias("n_total"))


# --- missingness

#: Audited fields and their group.
FIELD_GROUPS = {
    "price_original": "price", "discount_percent": "price", "taxes_fees": "price", "price_includes_tax": "price", "price_total": "price", "price_per_night": "price",
    "room_name": "room", "max_occupancy": "room", "bed_config": "room", "room_area": "room", "room_key": "room",
    "rate_key": "rate", "breakfast_included": "rate", "free_cancellation": "rate", "cancellation_policy": "rate", "rooms_left": "rate",
}


def missingness(df: DataFrame, *by: str | Column) -> DataFrame:
    """One wide aggregate, then a row for each field."""
    wide = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_total"), *[F.count_if(F.col(f).isNull()).alias(f"_{f}") for f in FIELD_GROUPS])
    keys = [c for c in wide.columns if c != "n_total" and c[1:] not in FIELD_GROUPS]
    rows = wide.select(*keys, "n_total", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(g).alias("field_group"), F.col(f"_{f}").alias("n_null")) for f, g in FIELD_GROUPS.items()])).alias("x"))
    return rows.select(*keys, "x.field", "x.field_group", "x.n_null", "n_total").withColumn("null_rate", r6(rate("n_null", "n_total")))


def _available(w: Warehouse) -> DataFrame:
    return observed(w).filter(~F.col("is_sold_out"))


_MISSING = "field field_group n_null n_total null_rate"


@metric("MAIN", f"source_code {_MISSING}")
def missingness_available_observations(w):
    return missingness(_available(w), "source_code")


@metric("MAIN", f"selector_version {_MISSING}")
def missingness_by_selector_version(w):
    return missingness(_available(w), "selector_version")


@metric("MAIN", f"vn_crawl_date {_MISSING}")
def missingness_by_crawl_date(w):
    return missingness(_available(w), F.col("crawl_date").alias("vn_crawl_date"))


@metric("MAIN", f"city {_MISSING}")
def missingness_by_city(w):
    return missingness(with_city(_available(w), w), "city")


@metric("MAIN", "item_status is_sold_out field field_group missing_kind null_class n_null n_total null_rate")
def missingness_by_item_status_sold_out(w):
    rows = missingness(observed(w), F.col("status").alias("item_status"), "is_sold_out")
    return rows.withColumn("missing_kind", F.when(F.col("is_sold_out"), "structural").otherwise("class_dependent")).withColumn("null_class", F.when(F.col("is_sold_out"), "not_applicable").when(F.col("field").isin("price_per_night", "room_key"), "required").otherwise("optional"))


@metric("RAW", "source_code vn_crawl_date save_artifacts missing_kind n_items n_html_present n_html_missing html_coverage_rate n_screenshot_present n_screenshot_missing screenshot_coverage_rate")
def artifact_completeness_by_source_crawl_date(w):
    n = F.count(F.lit(1))
    rows = scope(w.items, "RAW").groupBy("source_code", F.col("crawl_date").alias("vn_crawl_date"), F.col("screenshot_requested").alias("save_artifacts")).agg(n.alias("n_items"), F.count("page_path").alias("n_html_present"), F.count("screenshot_path").alias("n_screenshot_present"))
    return rows.select(
        "source_code", "vn_crawl_date", "save_artifacts", F.when(F.col("save_artifacts"), "unexpected").otherwise("by_configuration").alias("missing_kind"), "n_items", "n_html_present", (F.col("n_items") - F.col("n_html_present")).alias("n_html_missing"), r6(rate("n_html_present", "n_items")).alias("html_coverage_rate"),
        "n_screenshot_present", (F.col("n_items") - F.col("n_screenshot_present")).alias("n_screenshot_missing"), r6(rate("n_screenshot_present", "n_items")).alias("screenshot_coverage_rate"),
    )


# --- series and runs

HORIZONS = (1, 3, 7, 14)


def series_facts(days: DataFrame, key: list[str], day: str = "crawl_date") -> DataFrame:
    """Observed days of each series: how many, span, gaps, reappearances after a gap, and pairs exactly K days apart.

    One partitioning and sort serve the gap and all horizons.
    """
    each = days.select(*key, F.col(day).alias("_day")).distinct().withColumn("_n", F.unix_date("_day").cast("long"))
    w = Window.partitionBy(*key).orderBy("_n")
    gap = F.col("_n") - F.lag("_n").over(w)
    ahead = [F.count(F.lit(1)).over(w.rangeBetween(k, k)).alias(f"_h{k}") for k in HORIZONS]
    rows = each.select(*key, "_day", gap.alias("_gap"), *ahead)
    return rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_observed_days"), F.min("_day").alias("first_observed"), F.max("_day").alias("last_observed"), (F.date_diff(F.max("_day"), F.min("_day")) + 1).alias("span_days"), F.max("_gap").alias("max_gap_days"), r6(quantile("_gap", 0.5)).alias("median_gap_days"), count_if(F.col("_gap") > 1).alias("n_reappearance_events"), *[F.sum(f"_h{k}").alias(f"n_pairs_h{k}") for k in HORIZONS],
    )


FACTS = "n_observed_days first_observed last_observed span_days max_gap_days median_gap_days n_reappearance_events n_pairs_h1 n_pairs_h3 n_pairs_h7 n_pairs_h14"


@metric("MAIN", f"hotel_id room_key {FACTS}")
def canonical_series_facts_main(w):
    return series_facts(observed(w).filter(~F.col("is_sold_out")), ["hotel_id", "room_key"])


@metric("RAW", "source_code run_id vn_crawl_date started_at_vn finished_at_vn duration_minutes n_items n_observations n_checkin_slots items_per_hour observations_per_hour crosses_next_crawl_day is_protocol_run")
def run_duration_and_throughput(w):
    items = w.items.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_items"), F.countDistinct("checkin_date").alias("n_checkin_slots"))
    seen = w.observations.join(w.items.select("item_id", "run_id"), "item_id").groupBy("run_id").agg(F.count(F.lit(1)).alias("n_observations"))
    minutes = r6(F.expr("timestampdiff(SECOND, started_at, finished_at)") / 60)
    rows = w.runs.join(items, "run_id", "left").join(seen, "run_id", "left").fillna(0, ["n_items", "n_observations", "n_checkin_slots"]).withColumn("duration_minutes", minutes)
    return rows.select(
        "source_code", "run_id", F.col("crawl_date").alias("vn_crawl_date"), ta.local_text("started_at").alias("started_at_vn"), ta.local_text("finished_at").alias("finished_at_vn"), "duration_minutes", "n_items", "n_observations", "n_checkin_slots",
        r6(rate(F.col("n_items") * 60, "duration_minutes")).alias("items_per_hour"), r6(rate(F.col("n_observations") * 60, "duration_minutes")).alias("observations_per_hour"), (ta.local_date("finished_at") > F.col("crawl_date")).alias("crosses_next_crawl_day"), (F.col("trigger") == "scheduled").alias("is_protocol_run"),
    )


def collision_pairs(items: DataFrame, key: list[str], most: int = 1000) -> DataFrame:
    """Pairs of items of two sources with the same key, the source of the first before that of the second.

    Keys of one source go before any pairing, told by counts that are summed before they are shuffled. A key of more than
    `most` items is cut into slices of about so many by a hash of the item, and each two slices meet in a task of their
    own, to which an item goes once for each slice of the other side: no task pairs more than most x most items. Items
    with a null in the key have no pairs; repeated items pair each; an empty table gives none.
    """
    known = items.dropna(subset=key)
    sizes = known.groupBy(*key).agg(F.min("source_code").alias("_lo"), F.max("source_code").alias("_hi"), F.ceil(F.count(F.lit(1)) / most).cast("int").alias("_cuts")).filter("_lo < _hi").drop("_lo", "_hi")
    both = known.join(sizes, key).withColumn("_own", F.pmod(F.xxhash64("item_id"), F.col("_cuts")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_cuts") - 1)))
    told = (("source_code", "source"), ("item_id", "item_id"), ("status", "status"), ("ownership_status", "ownership_status"), ("finished_at", "observed_finish"))
    side = lambda s, mine, theirs: both.select(*key, F.col("_own").alias(mine), F.col("_other").alias(theirs), *[F.col(c).alias(f"{n}_{s}") for c, n in told])
    return side("a", "_cut_a", "_cut_b").join(side("b", "_cut_b", "_cut_a"), [*key, "_cut_a", "_cut_b"]).filter("source_a < source_b").drop("_cut_a", "_cut_b")


@metric("RAW", "source_a source_b item_id_a item_id_b vn_crawl_date hotel_id checkin_date status_a status_b ownership_status_a ownership_status_b observed_finish_a observed_finish_b")
def collision_item_pairs(w):
    return collision_pairs(scope(w.items, "RAW"), ["crawl_date", "hotel_id", "checkin_date"]).withColumnRenamed("crawl_date", "vn_crawl_date")
