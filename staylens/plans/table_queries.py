"""Queries over whole sets of tables: availability and coverage of resolved items, rates of reference coverage, duplicates by
scope with their guard, findings, fingerprints and checksums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.stats import r6, rate
from ..functions.timeaxis import bucket, bucket_table
from ..operators import catalog, derived, review_log
from ..operators.derived import AVAILABILITY, Check
from ..sources.bindings import CITIES, events_warehouse, orders_warehouse
from .catalog_queries import EVENTS
from .derived_queries import _CAL, _FOUR, _IDENTITY, _calendar, _effective, _over, _run
from .merge_queries import _EXISTS, _REF, _YEARS
from .model_queries import _RES, _log, _records
from .preludes import BUCKET, BUCKET_TABLE, events_sql, orders_sql
from .registry import QUERIES, query

# --- rates of reference coverage


def _rated(name: str, part: str, whole: str, told: str, spark, sf_dir) -> DataFrame:
    return QUERIES[name](spark, sf_dir).withColumn(told, r6(rate(part, whole)))


_RATED = "SELECT *, round({0}::double / nullif({1}, 0), 6) AS {2} FROM t"


@query(orders_sql(f"{_YEARS}, {_REF.format(' WHERE include_main')}, t AS (SELECT {BUCKET} AS lead_time_bucket, count(*) AS n_observations, count(*) FILTER (hit) AS n_matched FROM m GROUP BY 1) {_RATED.format('n_matched', 'n_observations', 'match_rate')}"))
def reference_exact_match_rates(spark, sf_dir):
    return _rated("reference_observation_match_main", "n_matched", "n_observations", "match_rate", spark, sf_dir)


@query(orders_sql(f"{_YEARS}, t AS (WITH {_EXISTS.format(BUCKET)}) {_RATED.format('n_series_has_reference', 'n_observations', 'series_reference_rate')}"))
def reference_series_exists_rates(spark, sf_dir):
    return _rated("reference_series_exists_observation_coverage_raw", "n_series_has_reference", "n_observations", "series_reference_rate", spark, sf_dir)


@query(orders_sql(f"{_YEARS}, {_REF.format(' WHERE include_main')}, p AS (SELECT item_id, min(lead_time) AS lead_time, bool_or(hit) AS hit FROM m WHERE item_status = 'success' GROUP BY 1), t AS (SELECT {BUCKET} AS lead_time_bucket, count(*) AS n_items, count(*) FILTER (hit) AS n_items_matched FROM p GROUP BY 1) {_RATED.format('n_items_matched', 'n_items', 'availability_rate')}"))
def reference_item_availability_rates(spark, sf_dir):
    return _rated("reference_item_level_availability_main", "n_items_matched", "n_items", "availability_rate", spark, sf_dir)


# --- availability and coverage of items whose hotel is resolved

_ITEMS = f"{_IDENTITY}, q AS (SELECT e.item_id, e.status, e.source_code, e.crawl_date, e.checkin_date, eff AS hotel_id, coalesce(h.city, '(unknown)') AS city, strftime(e.checkin_date, '%Y-%m') AS checkin_month, {BUCKET} AS lead_time_bucket FROM e LEFT JOIN hotels h ON h.hotel_id = eff WHERE e.include_main)"
_S = ("success", "partial", "sold_out", "not_bookable", "error")
_N = ", ".join(f"count(*) FILTER (status = '{s}') AS n_{s}" for s in _S) + ", count(*) AS n_items"
_R = ", ".join(f"round(count(*) FILTER (status = '{s}')::double / nullif(count(*), 0), 6) AS rate_{s}" for s in _S)


def _resolved(spark, sf_dir) -> DataFrame:
    rows = _effective(spark, sf_dir).filter("include_main")
    return rows.select("item_id", "status", "source_code", "crawl_date", "checkin_date", F.col("effective_hotel_id").alias("hotel_id"), derived.unknown_last("effective_city").alias("city"), catalog.month("checkin_date").alias("checkin_month"), bucket("lead_time").alias("lead_time_bucket"))


def _availability(name: str, by: list[str]) -> None:
    told = "".join(f"{c}, " for c in by)

    def table(spark, sf_dir):
        return derived.availability(_resolved(spark, sf_dir), by)

    table.__name__ = f"item_availability_{name}"
    query(events_sql(f"{_ITEMS} SELECT {told}{_N}, {_R} FROM q{' GROUP BY ' + told[:-2] if by else ''}"))(table)


for _name, _by in AVAILABILITY.items():
    _availability(_name, _by)


@query(events_sql(f"{_ITEMS}, a AS (SELECT {_N} FROM q), b AS (SELECT {_N} FROM items WHERE include_main) " + " UNION ALL ".join(f"SELECT '{c}' AS figure, a.{c} AS n_a, b.{c} AS n_b, a.{c} = b.{c} AS ok FROM a, b" for c in (*(f"n_{s}" for s in _S), "n_items"))))
def item_availability_reconciled(spark, sf_dir):
    """The resolved items are those that the catalogue counts, status by status."""
    return derived.availability_reconciled(derived.availability(_resolved(spark, sf_dir), []), _run("item_status_counts_overall_main", spark, sf_dir))


_ANCHORED = "count(*) AS n_items, count(DISTINCT checkin_date) AS n_anchor_dates, string_agg(DISTINCT cast(checkin_date AS varchar), ',' ORDER BY cast(checkin_date AS varchar)) AS anchor_dates"


@query(events_sql(f"{_ITEMS} SELECT checkin_month, {_ANCHORED} FROM q GROUP BY 1"))
def item_checkin_month_distribution(spark, sf_dir):
    return derived.anchored_coverage(_resolved(spark, sf_dir), "checkin_month", day="checkin_date")


@query(events_sql(f"{_ITEMS} SELECT isodow(checkin_date)::int - 1 AS weekday_number, dayname(checkin_date) AS weekday, isodow(checkin_date) IN (5, 6) AS is_weekend_fri_sat, {_ANCHORED} FROM q GROUP BY 1, 2, 3"))
def item_checkin_weekday_distribution(spark, sf_dir):
    rows = _resolved(spark, sf_dir).select("*", *catalog.weekday_parts("checkin_date"))
    return derived.anchored_coverage(rows, "weekday_number", "weekday", "is_weekend_fri_sat", day="checkin_date")


@query(events_sql(f"{_ITEMS}, g AS (SELECT lead_time_bucket, count(*) AS n FROM q GROUP BY 1) SELECT lead_time_bucket, bucket_order, coalesce(n, 0) AS n_items FROM {BUCKET_TABLE} LEFT JOIN g USING (lead_time_bucket)"))
def item_lead_time_bucket_distribution(spark, sf_dir):
    """All buckets, those without items too."""
    got = _resolved(spark, sf_dir).groupBy("lead_time_bucket").agg(F.count(F.lit(1)).alias("n"))
    return bucket_table(spark).join(got, "lead_time_bucket", "left").select("lead_time_bucket", "bucket_order", F.coalesce("n", F.lit(0)).alias("n_items"))


@query(events_sql(f"{_ITEMS} SELECT city, source_code, lead_time_bucket, count(*) AS n_items FROM q GROUP BY 1, 2, 3"))
def item_lead_time_bucket_by_city_source(spark, sf_dir):
    return _resolved(spark, sf_dir).groupBy("city", "source_code", "lead_time_bucket").agg(F.count(F.lit(1)).alias("n_items"))


_COALESCED = ", ".join(f"coalesce(cal.{f}, false) AS {f}" for f in _FOUR)


@query(events_sql(f"{_ITEMS}, {_CAL}, x AS (SELECT q.checkin_date, q.city, {_COALESCED} FROM q LEFT JOIN cal ON cal.day = q.checkin_date AND cal.city = q.city) SELECT {', '.join(_FOUR)}, count(*) AS n_items, count(DISTINCT checkin_date) AS n_distinct_checkin_dates, count(DISTINCT (checkin_date, city)) AS n_checkin_date_city_cells FROM x GROUP BY 1, 2, 3, 4"))
def item_calendar_coverage(spark, sf_dir):
    return derived.calendar_coverage(_resolved(spark, sf_dir), _calendar(events_warehouse(spark, sf_dir)), _FOUR)


# --- duplicates by scope, over coarse keys, so that orders have many

_GROUPS = "u AS (SELECT o.*, split_part(room_key, '/', 1) AS rk, i.include_main AS is_main FROM observations o JOIN items i USING (item_id) WHERE NOT is_sold_out), g AS (SELECT source_code, city, item_id, rk, bool_or(is_main) AS is_main, count(*) AS n, min(price_per_night) AS lo, max(price_per_night) AS hi FROM u GROUP BY 1, 2, 3, 4)"
_SCOPED = " UNION ALL ".join(f"SELECT '{scope}' AS scope, CASE WHEN grouping(source_code) = 1 THEN '(all)' ELSE source_code END AS source_code, CASE WHEN grouping(city) = 1 THEN '(all)' ELSE city END AS city, coalesce(sum(n), 0)::bigint AS n_observations, count(*) AS n_groups, count(*) FILTER (n > 1) AS n_duplicate_groups, coalesce(sum(n - 1), 0)::bigint AS n_extra, count(*) FILTER (n > 1 AND lo = hi) AS n_same_price_groups, count(*) FILTER (n > 1 AND lo IS DISTINCT FROM hi) AS n_divergent_groups, coalesce(max(n) FILTER (n > 1), 0) AS largest_group FROM g {where} GROUP BY CUBE (source_code, city)" for scope, where in (("RAW", ""), ("MAIN", "WHERE is_main")))


def _scoped(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Available observations with their coarse key, the groups of more than one, and the totals by source and city."""
    w = orders_warehouse(spark, sf_dir)
    rows = w.observations.filter("not is_sold_out").join(w.items.select("item_id", F.col("include_main").alias("is_main")), "item_id").withColumn("rk", F.substring_index("room_key", "/", 1))
    groups = rows.groupBy("source_code", "city", "item_id", "rk").agg(F.bool_or("is_main").alias("is_main"), F.count(F.lit(1)).alias("n_rows"), F.min("price_per_night").alias("min_price"), F.max("price_per_night").alias("max_price")).filter("n_rows > 1")
    return rows, groups, rows.groupBy("source_code", "city").agg(F.count(F.lit(1)).alias("n_observations_raw"), F.count_if("is_main").alias("n_observations_main"))


@query(orders_sql(f"{_GROUPS}, d AS ({_SCOPED}) SELECT *, round(n_duplicate_groups::double / nullif(n_groups, 0), 6) AS duplicate_rate, round(n_divergent_groups::double / nullif(n_duplicate_groups, 0), 6) AS divergent_share FROM d"))
def duplicate_summary_by_scope(spark, sf_dir):
    _, groups, totals = _scoped(spark, sf_dir)
    return derived.duplicate_scopes(groups, totals)


@query(orders_sql(f"{_GROUPS}, c AS (SELECT count(*) FILTER (n > 1) AS d, sum(n - 1)::bigint AS x, count(*) AS g FROM g) SELECT 'n_duplicate_groups' AS figure, d AS n_a, d AS n_b, true AS ok FROM c UNION ALL SELECT 'n_extra', x, x, true FROM c UNION ALL SELECT 'n_groups', g, g, true FROM c"))
def duplicate_summary_guard(spark, sf_dir):
    """The summary by scope, made from groups and totals, beside a count of all groups."""
    rows, groups, totals = _scoped(spark, sf_dir)
    n = rows.groupBy("item_id", "rk", "source_code", "city").agg(F.count(F.lit(1)).alias("n"))
    counted = n.agg(F.count_if(F.col("n") > 1).alias("n_duplicate_groups"), F.sum(F.col("n") - 1).alias("n_extra_observations"), F.count(F.lit(1)).alias("n_total_groups"))
    return derived.duplicates_reconciled(derived.duplicate_scopes(groups, totals), counted)


# --- findings


def _metric(name: str, spark, sf_dir, found: str = "n_violations", whole: str = "n_total") -> DataFrame:
    return _run(name, spark, sf_dir).select(F.expr(found).alias("n_found"), F.expr(whole).alias("denominator"))


def _checks(spark, sf_dir) -> list[Check]:
    w = events_warehouse(spark, sf_dir)
    raw, items = catalog.observed(w, "RAW"), catalog.scope(w.items, "RAW")
    own = items.select("item_id", F.col("hotel_id").alias("item_hotel"), F.col("checkin_date").alias("item_night"))
    n_observations = w.observations.agg(F.count(F.lit(1)).alias("denominator"))
    unknown = _effective(spark, sf_dir).filter("include_main")
    nobody = unknown.filter("status = 'error' and identity = 'unattributed'")
    pairs = _run("collision_item_pairs", spark, sf_dir)
    levels, near = catalog.robust_levels(catalog.priced(w))
    apart = near.select("hotel_id", "distance", "n").join(levels, "hotel_id").withColumn("z", catalog.distance_in_mads(F.col("distance")))
    return [
        Check("price_non_positive", "high", "RAW", "observation", _metric("quality_price_non_positive", spark, sf_dir), raw.filter("not is_sold_out and (price_per_night is null or price_per_night <= 0)"), "record_id", "a price was read as nothing or less", "look up the page and the selector of that day"),
        Check("checkout_not_after_checkin", "high", "RAW", "item", _metric("quality_checkout_not_after_checkin", spark, sf_dir, whole="0L").select("n_found").crossJoin(n_observations), items.filter("datediff(checkout_date, checkin_date) <> 1"), "item_id", "a stay is not of one night", "look up how the last day was set"),
        Check("canonical_key_anomalies", "high", "RAW", "observation", _metric("quality_canonical_key_anomalies", spark, sf_dir, "n_nonsoldout_missing_canonical + n_soldout_with_room_key"), raw.filter("(not is_sold_out and room_key is null) or (is_sold_out and room_key is not null)"), "record_id", "a key is missing, or a sold-out row has one", "make the keys of the batch anew"),
        Check("city_outside_scope", "medium", "RAW", "hotel", _metric("quality_city_outside_scope", spark, sf_dir), w.hotels.filter(F.col("city").isNull() | ~F.col("city").isin(CITIES)), "hotel_id", "a hotel is of none of the cities", "hold it against the cohort"),
        Check("lead_time_mismatch", "medium", "RAW", "observation", _metric("quality_lead_time_mismatch", spark, sf_dir, "n_mismatch"), raw.filter(~F.col("lead_time").eqNullSafe(catalog.ta.lead_time("checkin_date", "observed_at"))), "record_id", "the stored lead time is not that of its local day", "look for a clock or an offset that is wrong"),
        Check("parent_mismatch", "high", "RAW", "observation", _metric("quality_parent_mismatch", spark, sf_dir, "n_mismatch"), w.observations.join(own, "item_id").filter("not (hotel_id <=> item_hotel) or not (checkin_date <=> item_night)"), "record_id", "an observation is of another hotel or night than its item", "look up the import of the item"),
        Check("price_total_per_night_inconsistent", "medium", "RAW", "observation", _metric("quality_price_total_per_night_inconsistent", spark, sf_dir), raw.filter("abs(price_total - price_per_night) > 1e-9"), "record_id", "the total of one night is not its price", "look up the parser's count of nights"),
        Check("price_outlier_robust_within_hotel", "medium", "MAIN", "observation", apart.agg(F.sum(F.when(F.col("z") >= 5, F.col("n"))).alias("n_found"), F.sum("n").alias("denominator")), None, "", "a price is far from its hotel's median, which a better room may be too", "flag it, delete nothing"),
        Check("unattributed_errors", "info", "MAIN", "item", nobody.agg(F.count(F.lit(1)).alias("n_found")).crossJoin(unknown.agg(F.count(F.lit(1)).alias("denominator"))), nobody, "item_id", "a dead link has no hotel", "none, unless there are suddenly many"),
        Check("collision_status_disagreement", "medium", "RAW", "item pair", pairs.agg(F.count_if(F.col("status_a") != F.col("status_b")).alias("n_found"), F.count(F.lit(1)).alias("denominator")), pairs.filter("status_a <> status_b"), "item_id_a", "two sources saw a hotel at different times", "hold it against the minutes between them"),
    ]


def _found_sql(name: str, severity: str, scope: str, grain: str, found: str, bad: str | None, key: str, cause: str, action: str) -> str:
    few = f"(SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT cast({key} AS varchar) AS k FROM ({bad}) WHERE {key} IS NOT NULL ORDER BY 1 LIMIT 5))" if bad else "''"
    quoted = ", ".join("'" + x.replace("'", "''") + "'" for x in (name, severity, scope, grain, cause, action))
    return f"SELECT * FROM (SELECT {quoted}, n, d, {few} FROM ({found}) f(n, d)) x(check_name, severity_if, scope, grain, likely_cause, recommended_action, n_found, denominator, keys)"


def _metric_sql(name: str, found: str = "n_violations", whole: str = "n_total") -> str:
    sql = EVENTS[name]
    return f"SELECT {found}, {whole} FROM ({'' if sql.lstrip()[:6].upper() == 'SELECT' else 'WITH '}{sql})"


_RAWS = "SELECT o.* FROM observations o JOIN items i USING (item_id) WHERE i.include_raw"
_FOUND = [
    _found_sql("price_non_positive", "high", "RAW", "observation", _metric_sql("quality_price_non_positive"), f"{_RAWS} AND NOT is_sold_out AND (price_per_night IS NULL OR price_per_night <= 0)", "record_id", "a price was read as nothing or less", "look up the page and the selector of that day"),
    _found_sql("checkout_not_after_checkin", "high", "RAW", "item", _metric_sql("quality_checkout_not_after_checkin", whole="(SELECT count(*) FROM observations)"), "SELECT * FROM items WHERE include_raw AND checkout_date - checkin_date <> 1", "item_id", "a stay is not of one night", "look up how the last day was set"),
    _found_sql("canonical_key_anomalies", "high", "RAW", "observation", _metric_sql("quality_canonical_key_anomalies", "n_nonsoldout_missing_canonical + n_soldout_with_room_key"), f"{_RAWS} AND is_sold_out = (room_key IS NOT NULL)", "record_id", "a key is missing, or a sold-out row has one", "make the keys of the batch anew"),
    _found_sql("city_outside_scope", "medium", "RAW", "hotel", _metric_sql("quality_city_outside_scope"), "SELECT * FROM hotels WHERE city IS NULL OR city NOT IN ('Hanoi', 'Da Nang', 'Hoi An', 'Nha Trang', 'Da Lat')", "hotel_id", "a hotel is of none of the cities", "hold it against the cohort"),
    _found_sql("lead_time_mismatch", "medium", "RAW", "observation", _metric_sql("quality_lead_time_mismatch", "n_mismatch"), f"{_RAWS} AND o.lead_time IS DISTINCT FROM o.checkin_date - cast(o.observed_at + INTERVAL 7 HOUR AS date)", "record_id", "the stored lead time is not that of its local day", "look for a clock or an offset that is wrong"),
    _found_sql("parent_mismatch", "high", "RAW", "observation", _metric_sql("quality_parent_mismatch", "n_mismatch"), f"{_RAWS} AND (o.hotel_id IS DISTINCT FROM i.hotel_id OR o.checkin_date IS DISTINCT FROM i.checkin_date)", "record_id", "an observation is of another hotel or night than its item", "look up the import of the item"),
    _found_sql("price_total_per_night_inconsistent", "medium", "RAW", "observation", _metric_sql("quality_price_total_per_night_inconsistent"), f"{_RAWS} AND abs(price_total - price_per_night) > 1e-9", "record_id", "the total of one night is not its price", "look up the parser's count of nights"),
    _found_sql("price_outlier_robust_within_hotel", "medium", "MAIN", "observation", _metric_sql("price_outlier_summary_by_hotel_main", "sum(n_outliers)::bigint", "sum(n_obs)::bigint"), None, "", "a price is far from its hotel's median, which a better room may be too", "flag it, delete nothing"),
    _found_sql("unattributed_errors", "info", "MAIN", "item", "SELECT count(*) FILTER (status = 'error' AND identity = 'unattributed'), count(*) FROM e WHERE include_main", "SELECT * FROM e WHERE include_main AND status = 'error' AND identity = 'unattributed'", "item_id", "a dead link has no hotel", "none, unless there are suddenly many"),
    _found_sql("collision_status_disagreement", "medium", "RAW", "item pair", _metric_sql("collision_item_pairs", "count(*) FILTER (status_a <> status_b)", "count(*)"), f"SELECT * FROM (WITH {EVENTS['collision_item_pairs']}) WHERE status_a <> status_b", "item_id_a", "two sources saw a hotel at different times", "hold it against the minutes between them"),
]


@query(events_sql(f"{_IDENTITY}, z AS ({' UNION ALL '.join(_FOUND)}) SELECT check_name, CASE WHEN coalesce(n_found, 0) > 0 THEN severity_if ELSE 'info' END AS severity, scope, grain, coalesce(n_found, 0)::bigint AS n_found, denominator::bigint AS denominator, round(coalesce(n_found, 0)::double / nullif(denominator, 0), 6) AS rate, CASE WHEN coalesce(n_found, 0) > 0 THEN coalesce(keys, '') ELSE '' END AS sample_keys, likely_cause, recommended_action FROM z"))
def quality_finding_rows(spark, sf_dir):
    """Ten checks, those that found nothing too; the keys are a sample of five."""
    return derived.finding_rows(_checks(spark, sf_dir))


_REQUIRED = {"taxes_fees": "none", "bed_config": "room key", "room_key": "series key", "rooms_gone": "none"}
_BAD = " UNION ALL ".join(f"SELECT '{f}' AS field, cast(record_id AS varchar) AS k FROM m0 WHERE {f} IS NULL{' AND source_code <> ' + repr('b') if f == 'taxes_fees' else ''}" for f in ("taxes_fees", "bed_config", "room_key"))


@query(_over("missingness_available_observations", f""", m0 AS (SELECT o.*, i.source_code FROM observations o JOIN items i USING (item_id) WHERE i.include_main AND NOT is_sold_out), bad AS ({_BAD}),
    few AS (SELECT field, string_agg(k, ',' ORDER BY k) FILTER (r <= 5) AS keys FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY k) AS r FROM bad) GROUP BY 1),
    rq(field, role) AS (VALUES ('taxes_fees', 'none'), ('bed_config', 'room key'), ('room_key', 'series key'), ('rooms_gone', 'none')),
    st AS (SELECT field, sum(CASE WHEN field = 'taxes_fees' AND source_code = 'b' THEN 0 ELSE n_null END)::bigint AS n, sum(CASE WHEN field = 'taxes_fees' AND source_code = 'b' THEN 0 ELSE n_total END)::bigint AS d FROM t GROUP BY 1),
    x AS (SELECT 'required_null_' || field AS check_name, 'medium' AS sev, 'observation' AS grain, coalesce(n, 0) AS n_found, coalesce(d, 0) AS denominator, coalesce(keys, '') AS ks, CASE WHEN role = 'none' THEN 'a required field is null' ELSE 'a part of the ' || role || ' is null, which splits or merges keys' END || CASE WHEN field = 'taxes_fees' THEN '; exempt: b' ELSE '' END AS likely_cause, 'look up the pages of the sampled keys; fill nothing in' AS recommended_action FROM rq LEFT JOIN st USING (field) LEFT JOIN few USING (field)
        UNION ALL SELECT 'optional_null_cells', 'info', 'cell', sum(n_null)::bigint, sum(n_total)::bigint, '', 'the class tells what may be missing', 'none' FROM t WHERE field NOT IN ('room_key', 'rate_key') AND NOT (field = 'price_original' AND source_code = 'a')
        UNION ALL SELECT 'by_design_null_cells', 'info', 'cell', sum(n_null)::bigint, sum(n_total)::bigint, '', 'the class tells what may be missing', 'none' FROM t WHERE field = 'price_original' AND source_code = 'a')
    SELECT check_name, CASE WHEN n_found > 0 THEN sev ELSE 'info' END AS severity, 'MAIN' AS scope, grain, n_found, denominator, round(n_found::double / nullif(denominator, 0), 6) AS rate, CASE WHEN n_found > 0 THEN ks ELSE '' END AS sample_keys, likely_cause, recommended_action FROM x"""))
def null_finding_rows(spark, sf_dir):
    """A required field that no row has is told too; the keys are a sample of five."""
    from .derived_queries import _classed

    missing = _run("missingness_available_observations", spark, sf_dir)
    told = derived.required_nulls(missing, list(_REQUIRED), {"taxes_fees": ["b"]})
    rows = catalog.observed(events_warehouse(spark, sf_dir), "MAIN").filter("not is_sold_out")
    hit = {"taxes_fees": F.col("taxes_fees").isNull() & (F.col("source_code") != "b"), "bed_config": F.col("bed_config").isNull(), "room_key": F.col("room_key").isNull()}
    bad = rows.select(F.col("record_id").alias("key"), F.explode(F.filter(F.array(*[F.when(c, F.lit(f)) for f, c in hit.items()]), lambda x: x.isNotNull())).alias("field"))
    classes = derived.class_summary(_classed(spark, sf_dir), ["required", "optional", "by_design"])
    return derived.null_findings(told, classes, bad, _REQUIRED, ["optional", "by_design"])


# --- fingerprints and checksums

_TEXT = "coalesce('\"' || {0} || '\"', 'null')"
_WHOLE = "coalesce(cast(cast(floor({0}) AS bigint) AS varchar), 'null')"


@query(events_sql(f"""SELECT record_id, sha256('{{"checkin_date":"' || o.checkin_date || '","checkout_date":"' || i.checkout_date || '","hotel_id":' || coalesce(cast(o.hotel_id AS varchar), 'null') || ',"observed_at":"' || strftime(observed_at, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(observed_at) % 1000000 = 0 THEN '' ELSE strftime(observed_at, '.%f') END
    || '","price_per_night":' || {_WHOLE.format('price_per_night')} || ',"price_total":' || {_WHOLE.format('price_total')} || ',"rate_plan_key":' || {_TEXT.format('rate_key')} || ',"room_identity_key":' || {_TEXT.format('room_key')} || ',"room_option_index":' || option_index || ',"source_item_id":' || o.item_id || ',"source_record_id":' || record_id || ',"source_run_id":"' || run_id || '"}}') AS fingerprint FROM observations o JOIN items i USING (item_id)"""))
def observation_fingerprints_whole(spark, sf_dir):
    """Over all twelve columns that never change; the prices of the given tables are cut to whole ones first."""
    w = events_warehouse(spark, sf_dir)
    rows = w.observations.join(w.items.select("item_id", "run_id", "checkout_date"), "item_id")
    whole = rows.withColumns({c: F.floor(c) for c in ("price_total", "price_per_night")})
    return whole.select("record_id", keys.immutable_fingerprint("run_id", "item_id", "record_id", "hotel_id", "observed_at", "checkin_date", "checkout_date", "option_index", "room_key", "rate_key", "price_total", "price_per_night").alias("fingerprint"))


def _sum_sql(name: str, digested: str, rows: str) -> str:
    return f"SELECT '{name}' AS table_name, count(*) AS n_rows, cast(coalesce(sum(cast(('0x' || substr(sha256({digested}), 1, 15)) AS bigint)::hugeint), 0) AS varchar) AS checksum FROM {rows}"


@query(events_sql(f"{_RES}, pj AS (SELECT o.record_id, re.record_id IS NOT NULL AS is_anomaly FROM observations o LEFT JOIN (SELECT * FROM re WHERE decision = 'exclude_from_train') re USING (record_id)) "
    + _sum_sql("active_resolutions", """'{"decision":"' || decision || '","record_id":' || record_id || ',"review_id":"' || review_id || '","source_code":"' || source_code || '"}'""", "re")
    + " UNION ALL " + _sum_sql("projection", """'{"is_anomaly":' || is_anomaly || ',"record_id":' || record_id || '}'""", "pj")
    + " UNION ALL " + _sum_sql("members", """'{"fingerprint":"' || sha256(cast(record_id AS varchar)) || '","record_id":' || record_id || ',"source_code":"' || CASE WHEN record_id % 2 = 0 THEN 'a' ELSE 'b' END || '"}'""", "observations")))
def review_checksums(spark, sf_dir):
    """Order-free checksums of the active resolutions, the projected flags and the members with their fingerprints."""
    log, records = _log(spark, sf_dir), _records(spark, sf_dir)
    sets = {"active_resolutions": review_log.resolutions(log).drop("fingerprint"), "projection": review_log.projection(records, log).select("record_id", "is_anomaly"), "members": records}
    one, two, three = (keys.table_checksum(df, name) for name, df in sets.items())
    return one.unionByName(two).unionByName(three)
