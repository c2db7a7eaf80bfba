"""Monitors and audits of runs: gates, streaks, cascades, retries, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import count_if, n_rows, r6, rate
from ..functions.timeaxis import local_time

RANKS = ["ok", "warn", "fail"]


def gate_rows(wide: DataFrame, key: list[str], gates: dict[str, tuple[Column, Column]]) -> DataFrame:
    """A row for each gate of each run: warn or fail where its conditions hold, else ok. gates: name to (warn, fail)."""
    level = lambda w, f: F.when(F.coalesce(f, F.lit(False)), "fail").when(F.coalesce(w, F.lit(False)), "warn").otherwise("ok")
    rows = F.array(*[F.struct(F.lit(n).alias("gate"), level(w, f).alias("result")) for n, (w, f) in gates.items()])
    return wide.select(*key, F.explode(rows).alias("g")).select(*key, "g.gate", "g.result")


def overall(gates: DataFrame, key: list[str]) -> DataFrame:
    """The worst result of each run."""
    rank = F.array_position(F.array(*[F.lit(r) for r in RANKS]), F.col("result"))
    return gates.groupBy(*key).agg(F.element_at(F.array(*[F.lit(r) for r in RANKS]), F.max(rank).cast("int")).alias("overall"), F.count_if(F.col("result") != "ok").alias("n_not_ok"))


def run_monitor(runs: DataFrame, items: DataFrame, observations: DataFrame, reviews: DataFrame, registry: DataFrame, now: Column, floor: float = 50_000, ceiling: float = 50_000_000) -> DataFrame:
    """Nine gates of each run, a row each.

    runs: run_id, source_code, crawl_date, status, started_at, n_declared, n_processed. items: item_id, run_id, hotel_id,
    status, link (as requested, may be null), checkin_date, checkout_date, n_parsed, n_saved, n_duplicate. observations:
    item_id, is_sold_out, price_per_night, room_key, is_anomaly. reviews: source_code, n_review (links that wait for
    one). registry: source_code, registry_ok. Coverage is held against the source's last completed run before. A run
    without items has none of each; a source without reviews or registry is not to blame; an empty table gives no rows.
    """
    day = lambda key, c: F.contains("link", F.concat(F.lit(f"{key}="), F.date_format(c, "yyyy-MM-dd")))
    got = F.col("status").isin("success", "partial")
    per_item = items.groupBy("run_id").agg(
        n_rows().alias("n_items"), F.countDistinct("hotel_id").alias("n_hotels"), count_if(F.col("status") == "error").alias("n_error"), count_if(F.col("status").isin("queued", "running")).alias("n_unfinished"),
        count_if(got & (F.col("n_parsed") != F.col("n_saved") + F.col("n_duplicate"))).alias("n_unreconciled"), count_if(got & ~(day("checkin", "checkin_date") & day("checkout", "checkout_date"))).alias("n_url_wrong"), count_if(F.col("checkout_date") != F.date_add("checkin_date", 1)).alias("n_nights_wrong"),
    )
    free = ~F.col("is_sold_out")
    per_obs = observations.join(items.select("item_id", "run_id"), "item_id").groupBy("run_id").agg(
        count_if(free & F.col("price_per_night").isNull()).alias("n_no_price"), count_if(free & F.col("room_key").isNull()).alias("n_no_room"), count_if(F.col("is_anomaly")).alias("n_anomaly"), count_if(free & ((F.col("price_per_night") < floor) | (F.col("price_per_night") > ceiling))).alias("n_extreme")
    )
    counts = [c for c in (*per_item.columns, *per_obs.columns) if c.startswith("n_")]
    wide = runs.join(per_item, "run_id", "left").join(per_obs, "run_id", "left").fillna(0, counts)
    before = Window.partitionBy("source_code").orderBy("crawl_date", "run_id").rowsBetween(Window.unboundedPreceding, -1)
    wide = wide.withColumn("_before", F.last(F.when(F.col("status") == "completed", F.col("n_hotels")), ignorenulls=True).over(before))
    wide = wide.join(reviews.select("source_code", "n_review"), "source_code", "left").join(registry.select("source_code", "registry_ok"), "source_code", "left")
    no = F.lit(False)
    return gate_rows(wide, ["run_id"], {
        "run_completed": (F.col("status") != "completed", F.col("status").isin("queued", "running") & (F.col("started_at") < now - F.expr("INTERVAL 24 HOURS"))),
        "item_accounting": ((F.col("n_items") != F.col("n_declared")) | (F.col("n_processed") != F.col("n_declared")) | (F.col("n_unfinished") > 0), no),
        "hotel_coverage": (F.col("n_hotels") != F.col("_before"), no),
        "option_reconciliation": (no, F.col("n_unreconciled") > 0),
        "url_date_invariant": (no, (F.col("n_url_wrong") > 0) | (F.col("n_nights_wrong") > 0)),
        "error_taxonomy": (F.col("n_error") > 0, F.col("n_review") > 0),
        "missingness": (F.col("n_no_room") > 0, F.col("n_no_price") > 0),
        "price_sanity": (F.col("n_anomaly") > 0, F.col("n_extreme") > 0),
        "anomaly_registry_integrity": (~F.col("registry_ok"), no),
    })


def indexed_price_stats(obs: DataFrame, by: str) -> DataFrame:
    """n, p5 and p95 by index in sorted order (not interpolated) and the interpolated median: the monitor's own rule.

    Equal prices are counted first, so what is ordered within a group is its distinct prices, not its rows.
    """
    counts = obs.groupBy(by, "price_per_night").agg(n_rows().alias("_c"))
    upto = Window.partitionBy(by).orderBy("price_per_night").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("_to", F.sum("_c").over(upto)).withColumn("_n", F.sum("_c").over(Window.partitionBy(by)))
    at = lambda k: F.max(F.when((F.col("_to") - F.col("_c") <= k) & (k < F.col("_to")), F.col("price_per_night")))
    lo, hi = F.greatest(F.lit(0), F.floor(F.col("_n") * 0.05) - 1), F.least(F.col("_n") - 1, F.floor(F.col("_n") * 0.95))
    mid = (at(F.floor((F.col("_n") - 1) / 2)) + at(F.floor(F.col("_n") / 2))) / 2
    return ranked.groupBy(by).agg(F.max("_n").alias("n"), r6(at(lo)).alias("p5"), r6(mid).alias("median"), r6(at(hi)).alias("p95"))


def dead_link_split(items: DataFrame, evidence: str) -> DataFrame:
    """Dead links with evidence whose verdict is confirmed, and legacy ones without evidence. Those with another verdict are neither."""
    told = F.when(F.get_json_object(evidence, "$.verdict") == "confirmed", "confirmed").when(F.col(evidence).isNull(), "legacy")
    return items.withColumn("evidence", told).filter("evidence is not null").groupBy("evidence").agg(n_rows().alias("n_items"), F.countDistinct("link").alias("n_links"))


def sampling_audit(runs: DataFrame, items: DataFrame, observations: DataFrame, references: DataFrame, by: str = "source_code", least_days: int = 6, least_ready: float = 0.8) -> DataFrame:
    """Nine gates and three warnings over the runs of each source: by, check_name, kind, value and passed.

    runs: run_id, by, started_at (may be null), file_sha256 (may be null), checkin_dates (text of the set), scraper_version.
    items: item_id, run_id, status, error_code, link (may be null), checkin_date, checkout_date, n_candidates, n_rejected,
    n_parsed, n_saved, n_duplicate. observations: item_id, hotel_id, checkin_date, is_sold_out, room_key. references:
    hotel_id, checkin_date, status, distinct_run_count, coverage, observation_count, distinct_item_count. A warning has
    passed where it has nothing to tell. A source without runs has no rows.
    """
    local = local_time("started_at")
    minute = F.hour(local) * 60 + F.minute(local)
    on_time = F.coalesce(minute.between(21 * 60 + 30, 22 * 60 + 30), F.lit(False))
    per_run = runs.groupBy(by).agg(
        F.countDistinct(F.to_date(local)).alias("n_days"), F.countDistinct(F.coalesce("file_sha256", F.lit(""))).alias("n_files"), count_if(F.col("file_sha256").isNull()).alias("n_no_file"), F.countDistinct(F.coalesce("checkin_dates", F.lit(""))).alias("n_date_sets"),
        count_if(~on_time).alias("n_off_schedule"), F.countDistinct("scraper_version").alias("n_versions"),
    )
    of = items.join(runs.select("run_id", by), "run_id")
    day = lambda key, c: F.contains("link", F.concat(F.lit(f"{key}="), F.date_format(c, "yyyy-MM-dd")))
    incomplete = (F.col("n_rejected") > 0) | (F.col("n_candidates") != F.col("n_parsed")) | (F.col("n_parsed") != F.col("n_saved") + F.col("n_duplicate"))
    per_item = of.groupBy(by).agg(
        count_if(F.col("status") == "error").alias("n_errors"), count_if(F.col("error_code").isin("captcha", "blocked")).alias("n_blocked"), count_if(F.col("status").isin("success", "partial") & incomplete).alias("n_incomplete"),
        count_if(F.col("link").isNotNull() & ~(day("checkin", "checkin_date") & day("checkout", "checkout_date"))).alias("n_url_wrong"), count_if(F.col("link").isNull()).alias("n_no_url"),
    )
    approved = references.filter("status = 'approved'")
    sound = (F.col("distinct_run_count") >= 3) & (F.col("coverage") >= 0.8) & (F.col("observation_count") == F.col("distinct_item_count")) & F.col("checkin_date").isNotNull()
    refs = approved.agg(n_rows().alias("n_approved"), count_if(sound).alias("n_sound"))
    seen = observations.filter("not is_sold_out and room_key is not null").join(of.filter("status = 'success'").select("item_id", by), "item_id").select(by, "hotel_id", "checkin_date").distinct()
    have = approved.select("hotel_id", "checkin_date", F.lit(True).alias("_ready")).distinct()
    ready = seen.join(have, ["hotel_id", "checkin_date"], "left").groupBy(by).agg(n_rows().alias("n_series"), F.count("_ready").alias("n_ready"))
    wide = per_run.join(per_item, by, "left").join(ready, by, "left").fillna(0).crossJoin(refs)
    ratio = F.coalesce(F.try_divide("n_ready", "n_series"), F.lit(0.0))
    checks = {
        "six_distinct_real_days": ("gate", F.col("n_days"), F.col("n_days") >= least_days),
        "same_protocol_file": ("gate", F.col("n_files"), (F.col("n_files") == 1) & (F.col("n_no_file") == 0)),
        "same_checkin_dates": ("gate", F.col("n_date_sets"), F.col("n_date_sets") == 1),
        "parser_complete": ("gate", F.col("n_incomplete"), F.col("n_incomplete") == 0),
        "requested_url_dates": ("gate", F.col("n_url_wrong"), F.col("n_url_wrong") == 0),
        "no_technical_errors": ("gate", F.col("n_errors"), F.col("n_errors") == 0),
        "no_block_or_captcha": ("gate", F.col("n_blocked"), F.col("n_blocked") == 0),
        "approved_references_valid": ("gate", F.col("n_approved") - F.col("n_sound"), (F.col("n_approved") > 0) & (F.col("n_approved") == F.col("n_sound"))),
        "reference_ready_ratio": ("gate", F.round(ratio, 4), (F.col("n_series") > 0) & (ratio >= least_ready)),
        "off_schedule": ("warning", F.col("n_off_schedule"), F.col("n_off_schedule") == 0),
        "mixed_scraper_versions": ("warning", F.col("n_versions"), F.col("n_versions") <= 1),
        "requested_url_legacy_missing": ("warning", F.col("n_no_url"), F.col("n_no_url") == 0),
    }
    rows = F.array(*[F.struct(F.lit(n).alias("check_name"), F.lit(kind).alias("kind"), v.cast("double").alias("value"), ok.alias("passed")) for n, (kind, v, ok) in checks.items()])
    return wide.select(by, F.explode(rows).alias("c")).select(by, "c.*")


def progress(items: DataFrame) -> DataFrame:
    """Percent of each run's items that ended, and the latest of them."""
    ended = F.col("status").isin("success", "partial", "sold_out", "not_bookable", "error")
    out = items.groupBy("run_id").agg(n_rows().alias("n_items"), F.count_if(ended).alias("n_done"), F.max_by("item_id", F.struct("finished_at", "item_id")).alias("latest_item"))
    return out.withColumn("percent", r6(100 * rate("n_done", "n_items")))


def streaks(days: DataFrame, key: list[str], day: str, dead: str, review_at: int = 3) -> DataFrame:
    """Runs of consecutive dead days; a living day or a gap ends one. One row for each, with whether it needs review. days: one row a key and day."""
    number = F.row_number().over(Window.partitionBy(*key).orderBy(day))
    dead_days = days.filter(F.col(dead)).withColumn("_island", F.date_sub(F.col(day), number))
    out = dead_days.groupBy(*key, "_island").agg(F.min(day).alias("streak_start"), n_rows().alias("streak_days"))
    return out.drop("_island").withColumn("needs_review", F.col("streak_days") >= review_at)


def cascade_closed(items: DataFrame, by: list[str], state: Column) -> DataFrame:
    """Items that are still queued take the confirmed state of another item of the same run and link."""
    confirmed = F.max(F.when(state, F.col("status"))).over(Window.partitionBy(*by))
    return items.withColumn("status_after", F.when((F.col("status") == "queued") & confirmed.isNotNull(), confirmed).otherwise(F.col("status")))


def retry_set(items: DataFrame, new_run: str) -> DataFrame:
    """What a retry run would collect: failed items under new keys that name what they retry."""
    failed = items.filter(F.col("status").isin("error", "partial"))
    return failed.select(F.concat_ws("|", F.lit(new_run), "run_id").alias("run_id"), F.col("run_id").alias("retry_of_run_id"), F.col("item_id").alias("retry_of_item_id"), "hotel_id", "checkin_date", F.lit("queued").alias("status"))


def filtered_page(items: DataFrame, condition: Column, order: list[Column], offset: int, limit: int, market: str | None = None) -> DataFrame:
    """A page of a filtered list (the feature is a page), with the total of the list and, if a market column is named, the
    sorted markets of all items. An empty page has no rows and so no total."""
    kept = items.filter(condition)
    page = kept.orderBy(*order).offset(offset).limit(limit)
    if market is None:
        return page
    totals = kept.agg(n_rows().alias("n_total"))
    markets = items.agg(F.array_join(F.array_sort(F.collect_set(market)), ",").alias("markets"))
    return page.crossJoin(F.broadcast(totals)).crossJoin(F.broadcast(markets))
