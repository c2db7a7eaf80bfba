"""Signals on prices that look wrong. They tell; only the review log decides what is left out."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.running import running_median
from ..functions.stats import quantile

#: Fixed thresholds of the signals.
CONFIG = {"low_high": 10_000, "low_notable": 50_000, "context_ratio": 5.0, "context_rooms": 2, "temporal_ratio": 5.0, "temporal_items": 5, "temporal_dates": 3, "wide_pairs": 5, "wide_coverage": 0.7, "wide_factor": 2.0, "wide_dispersion": 0.15, "wide_offsets": 3}


def in_scope(observations: DataFrame) -> DataFrame:
    """Available observations with a positive price, of successful items."""
    return observations.filter((F.col("item_status") == "success") & ~F.col("is_sold_out") & (F.col("price_per_night") > 0))


def low_price(obs: DataFrame, high: float = CONFIG["low_high"], notable: float = CONFIG["low_notable"]) -> DataFrame:
    p = F.col("price_per_night")
    return obs.filter(p < notable).withColumn("severity", F.when(p < high, "high").otherwise("notable"))


def representatives(obs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The median price of each (item, room), with what belongs to the item."""
    return obs.filter("room_key is not null").groupBy("item_id", "room_key", *(keep or [])).agg(quantile("price_per_night", 0.5).alias("rep_price"))


def context_high(obs: DataFrame, ratio: float = CONFIG["context_ratio"], least_rooms: int = CONFIG["context_rooms"]) -> DataFrame:
    """Observations at `ratio` times or more the median of the item's other rooms, of which there are enough. An item's rooms are few, so they are gathered."""
    reps = representatives(obs)
    rooms = reps.groupBy("item_id").agg(F.collect_list(F.struct("room_key", "rep_price")).alias("rooms"))
    one = rooms.select("item_id", F.explode("rooms").alias("me"), "rooms")
    others = F.array_sort(F.transform(F.filter("rooms", lambda r: r["room_key"] != F.col("me.room_key")), lambda r: r["rep_price"]))
    n = F.size("others")
    median = F.when(n % 2 == 1, F.get("others", ((n - 1) / 2).cast("int"))).otherwise((F.get("others", (n / 2 - 1).cast("int")) + F.get("others", (n / 2).cast("int"))) / 2)
    context = one.select("item_id", F.col("me.room_key").alias("room_key"), others.alias("others")).filter(n >= least_rooms).select("item_id", "room_key", n.alias("context_room_count"), median.alias("context_median"))
    return obs.join(context, ["item_id", "room_key"]).filter(F.col("price_per_night") >= ratio * F.col("context_median"))


def temporal_shift(reps: DataFrame, key: list[str], order: list[str], date: str, ratio: float = CONFIG["temporal_ratio"], least_items: int = CONFIG["temporal_items"], least_dates: int = CONFIG["temporal_dates"]) -> DataFrame:
    """Representatives at `ratio` times or more the median of the strictly earlier ones of their series, of which there are enough items and dates.

    The running count of dates adds one where a date first stands, so no set is kept for each row; running_median() splits
    long series. order should tell the rows of a series apart; an empty table stays empty.
    """
    before = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    fresh = (F.row_number().over(Window.partitionBy(*key, date).orderBy(*order)) == 1).cast("int")
    rows = reps.withColumn("_new", fresh).withColumn("prior_items", F.count(F.lit(1)).over(before)).withColumn("prior_dates", F.coalesce(F.sum("_new").over(before), F.lit(0))).drop("_new")
    rows = running_median(rows, key, order, "rep_price", "prior_median", inclusive=False)
    return rows.filter((F.col("prior_items") >= least_items) & (F.col("prior_dates") >= least_dates) & (F.col("rep_price") >= ratio * F.col("prior_median")))


def hotel_wide_shift(reps: DataFrame, series: list[str], order: list[str], offsets: int = CONFIG["wide_offsets"], pairs: int = CONFIG["wide_pairs"], coverage: float = CONFIG["wide_coverage"], factor: float = CONFIG["wide_factor"], dispersion: float = CONFIG["wide_dispersion"]) -> DataFrame:
    """Items whose rooms all rose together against one of the few items before: for each the nearest baseline that passes, and how many others were looked at."""
    items = reps.groupBy("item_id", *series, *order).agg(F.count(F.lit(1)).alias("n_rooms"))
    numbered = items.withColumn("seq", F.row_number().over(Window.partitionBy(*series).orderBy(*order, "item_id"))).select(*series, "item_id", "seq", "n_rooms")
    rooms = reps.select("item_id", "room_key", "rep_price").join(numbered, "item_id")
    now = rooms.select(*series, "room_key", "item_id", "seq", "n_rooms", "rep_price").withColumn("offset", F.explode(F.sequence(F.lit(1), F.lit(offsets)))).withColumn("base_seq", F.col("seq") - F.col("offset"))
    base = rooms.select(*series, "room_key", F.col("seq").alias("base_seq"), F.col("item_id").alias("baseline_item_id"), F.col("n_rooms").alias("base_rooms"), F.col("rep_price").alias("base_price"))
    paired = now.join(base, [*series, "room_key", "base_seq"]).filter("base_price > 0").withColumn("ratio", F.col("rep_price") / F.col("base_price"))
    facts = paired.groupBy(*series, "item_id", "offset", "baseline_item_id", "n_rooms", "base_rooms").agg(F.count(F.lit(1)).alias("n_pairs"), quantile("ratio", 0.5).alias("median_factor"), (F.stddev_samp("ratio") / F.avg("ratio")).alias("spread"))
    facts = facts.filter(F.col("n_pairs") >= pairs).withColumn("coverage", F.col("n_pairs") / (F.col("n_rooms") + F.col("base_rooms") - F.col("n_pairs")))
    passes = (F.col("coverage") >= coverage) & (F.col("median_factor") >= factor) & (F.col("spread") <= dispersion)
    told = facts.withColumn("_ok", F.coalesce(passes, F.lit(False))).groupBy(*series, "item_id").agg(F.min_by(F.struct("offset", "baseline_item_id", "n_pairs", "coverage", "median_factor", "spread"), F.when(F.col("_ok"), F.col("offset"))).alias("first"), F.count_if("_ok").alias("n_ok"), (F.count(F.lit(1)) - 1).alias("n_other_baselines"))
    return told.filter("n_ok > 0").select(*series, "item_id", "first.*", "n_other_baselines")


def reconcile_signals(stored: DataFrame, found: DataFrame, scanned: DataFrame, key: list[str]) -> DataFrame:
    """Stored signals after a run of the method: found ones stand as found, stored ones within the scanned records that were not found go, those outside stay."""
    stale = stored.join(scanned.select("record_id").distinct(), "record_id", "left_semi").join(found.select(*key), key, "left_anti").select(*key)
    old = stored.join(stale, key, "left_anti").join(found.select(*key), key, "left_anti")
    return old.select(*found.columns).unionByName(found)


def preview_members(obs: DataFrame, hotel: object = None, room_key: str | None = None, price: float | None = None, low: float | None = None, high: float | None = None, checkin: object = None) -> DataFrame:
    """Observations that a review would take in; each condition that is given narrows them."""
    out = obs
    for name, value in (("hotel_id", hotel), ("room_key", room_key), ("price_per_night", price), ("checkin_date", checkin)):
        if value is not None:
            out = out.filter(F.col(name) == F.lit(value))
    if low is not None:
        out = out.filter(F.col("price_per_night") >= low)
    if high is not None:
        out = out.filter(F.col("price_per_night") <= high)
    return out


def config_hash(config: dict | None = None) -> str:
    """sha256 of the thresholds as JSON, to be kept beside the signals they gave."""
    return hashlib.sha256(json.dumps(config or CONFIG, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
