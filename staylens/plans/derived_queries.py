"""Queries over derived metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import quantile, r6
from ..functions.timeaxis import local_time
from ..operators import catalog, derived, merge
from ..sources.bindings import events_warehouse, orders_warehouse
from .catalog_queries import EVENTS, ORDERS, facts_sql
from .merge_queries import _PLAN, _plan, _versions
from .preludes import BUCKET, events_sql, orders_sql
from .registry import query

_S = ("success", "partial", "sold_out", "not_bookable", "error")


def _run(name: str, spark, sf_dir) -> DataFrame:
    return catalog.run_metric(name, (events_warehouse if name in EVENTS else orders_warehouse)(spark, sf_dir))


def _over(name: str, body: str) -> str:
    """SQL over the table of a catalogue metric, as t."""
    sql = EVENTS.get(name) or ORDERS[name]
    return (events_sql if name in EVENTS else orders_sql)(f"{_split(sql)} {body}")


def _split(sql: str) -> str:
    """The metric's own tables, then its SELECT as t."""
    depth, at = 0, 0
    for i, c in enumerate(sql):
        depth += (c == "(") - (c == ")")
        if depth == 0 and sql[i:].lstrip().upper().startswith("SELECT") and (i == 0 or sql[i - 1] in " )\n"):
            at = i
            break
    head = sql[:at].rstrip()
    return f"{head}{',' if head and not head.endswith(',') else ''} t AS ({sql[at:]})"


@query(_over("item_status_counts_by_city_main", "SELECT *, " + ", ".join(f"round(n_{s}::double / nullif(n_items, 0), 6) AS rate_{s}" for s in _S) + " FROM t"))
def status_rates_by_city(spark, sf_dir):
    return derived.status_rates(_run("item_status_counts_by_city_main", spark, sf_dir))


@query(_over("item_status_counts_by_city_main", " UNION ALL ".join(f"SELECT '{s}' AS status, sum(n_{s})::bigint AS n_items, sum(n_{s}) > 0 AS present FROM t" for s in _S)))
def status_presence(spark, sf_dir):
    return derived.status_presence(_run("item_status_counts_by_city_main", spark, sf_dir))


@query(_over("item_status_counts_by_city_main", "SELECT count(*) FILTER (n_items <> n_success + n_partial + n_sold_out + n_not_bookable + n_error) AS n_faults FROM t"))
def status_count_faults(spark, sf_dir):
    return derived.count_faults(_run("item_status_counts_by_city_main", spark, sf_dir)).agg(F.count(F.lit(1)).alias("n_faults"))


@query(events_sql("SELECT source_code, crawl_date, " + ", ".join(f"count(*) FILTER (status = '{s}') AS n_{s}" for s in _S) + ", count(*) AS n_items FROM items GROUP BY 1, 2"))
def pivoted_status_by_day(spark, sf_dir):
    return derived.pivoted_status(events_warehouse(spark, sf_dir).items, "source_code", "crawl_date")


@query(events_sql(f"SELECT source_code, {BUCKET} AS lead_time_bucket, count(*) AS n_items, count(DISTINCT crawl_date) AS n_anchor_dates, string_agg(DISTINCT cast(crawl_date AS varchar), ',' ORDER BY cast(crawl_date AS varchar)) AS anchor_dates FROM items GROUP BY 1, 2"))
def anchored_coverage(spark, sf_dir):
    from ..functions.timeaxis import bucket

    return derived.anchored_coverage(events_warehouse(spark, sf_dir).items.withColumn("lead_time_bucket", bucket("lead_time")), "source_code", "lead_time_bucket")


_RULES = [("price_original", None, "optional", "none"), ("price_original", "a", "by_design", "none"), ("room_key", None, "required", "key"), ("rate_key", None, "required", "key"), *((f, None, "optional", "none") for f in catalog.FIELD_GROUPS if f not in ("price_original", "room_key", "rate_key"))]
_CLASS = "CASE WHEN field IN ('room_key', 'rate_key') THEN 'required' WHEN field = 'price_original' AND source_code = 'a' THEN 'by_design' ELSE 'optional' END"


def _classed(spark, sf_dir) -> DataFrame:
    rules = spark.createDataFrame(_RULES, "field string, source_code string, null_class string, key_role string")
    return derived.null_taxonomy(_run("missingness_available_observations", spark, sf_dir), rules)


@query(_over("missingness_available_observations", f"SELECT source_code, field, n_null, n_total, {_CLASS} AS null_class, CASE WHEN field IN ('room_key', 'rate_key') THEN 'key' ELSE 'none' END AS key_role FROM t"))
def null_taxonomy(spark, sf_dir):
    return _classed(spark, sf_dir).select("source_code", "field", "n_null", "n_total", "null_class", "key_role")


@query(_over("missingness_available_observations", f"SELECT null_class, sum(n_null)::bigint AS n_null, sum(n_total)::bigint AS n_total FROM (SELECT *, {_CLASS} AS null_class FROM t) GROUP BY 1"))
def null_class_summary(spark, sf_dir):
    return derived.class_summary(_classed(spark, sf_dir), ["required", "optional", "by_design"])


@query(_over("missingness_available_observations", "SELECT 'rules' AS missing_from, 'rooms_left' AS field UNION ALL SELECT 'data', 'unheard_of'"))
def null_taxonomy_coverage(spark, sf_dir):
    """With a rule taken away and one put in."""
    rules = [r for r in _RULES if r[0] != "rooms_left"] + [("unheard_of", None, "optional", "none")]
    return derived.unknown_fields(_run("missingness_available_observations", spark, sf_dir), spark.createDataFrame(rules, "field string, source_code string, null_class string, key_role string"))


@query(_over("missingness_available_observations", "SELECT field, sum(CASE WHEN field = 'taxes_fees' AND source_code = 'b' THEN 0 ELSE n_null END)::bigint AS n_null, sum(CASE WHEN field = 'taxes_fees' AND source_code = 'b' THEN 0 ELSE n_total END)::bigint AS n_total, CASE WHEN field = 'taxes_fees' THEN 'b' ELSE '' END AS exempt_sources FROM t WHERE field IN ('taxes_fees', 'bed_config', 'room_key') GROUP BY 1"))
def required_field_nulls(spark, sf_dir):
    return derived.required_nulls(_run("missingness_available_observations", spark, sf_dir), ["taxes_fees", "bed_config", "room_key"], {"taxes_fees": ["b"]})


@query(_over("missingness_available_observations", "SELECT field_group, field, sum(n_null)::bigint AS n_null, sum(n_total)::bigint AS n_total, round(sum(n_null)::double / sum(n_total), 6) AS null_rate FROM t GROUP BY 1, 2"))
def missingness_overall(spark, sf_dir):
    out = _run("missingness_available_observations", spark, sf_dir).groupBy("field_group", "field").agg(F.sum("n_null").alias("n_null"), F.sum("n_total").alias("n_total"))
    return out.withColumn("null_rate", r6(F.try_divide(F.col("n_null").cast("double"), F.col("n_total"))))


# --- turnover

_FACTS = "canonical_series_facts_main"


@query(_over(_FACTS, "SELECT n_observed_days, max_gap_days, count(*) AS n_series FROM t GROUP BY 1, 2"))
def turnover_joint_distribution(spark, sf_dir):
    return derived.turnover_joint(_run(_FACTS, spark, sf_dir))


@query(_over(_FACTS, "SELECT hotel_id, room_key, max_gap_days FROM t ORDER BY max_gap_days DESC NULLS LAST, hotel_id, room_key LIMIT 20"))
def turnover_top_gaps(spark, sf_dir):
    """The feature is a top list."""
    return _run(_FACTS, spark, sf_dir).orderBy(F.desc_nulls_last("max_gap_days"), "hotel_id", "room_key").limit(20).select("hotel_id", "room_key", "max_gap_days")


@query(_over(_FACTS, " UNION ALL ".join(f"SELECT {k} AS horizon_days, count(*) AS n_series, count(*) FILTER (n_pairs_h{k} > 0) AS n_series_ready, sum(n_pairs_h{k})::bigint AS n_pairs, NULL::bigint AS n_labels FROM t" for k in (1, 3, 7, 14))))
def readiness_by_horizon(spark, sf_dir):
    return derived.readiness_by_horizon(_run(_FACTS, spark, sf_dir))


@query(_over(_FACTS, "SELECT n_observed_days, count(*) AS n_series, sum(n_reappearance_events)::bigint AS n_reappearances, round(avg(span_days), 6) AS mean_span_days, round(avg(n_observed_days / span_days), 6) AS mean_observed_fraction, round(sum(n_reappearance_events)::double / count(*), 6) AS reappearance_rate FROM t GROUP BY 1"))
def turnover_by_observed_days(spark, sf_dir):
    return derived.turnover_by_days(_run(_FACTS, spark, sf_dir))


@query(_over(_FACTS, "SELECT max_gap_days, count(*) AS n, round(count(*)::double / sum(count(*)) OVER (), 6) AS share FROM t GROUP BY 1"))
def max_gap_distribution(spark, sf_dir):
    return derived.share_of(_run(_FACTS, spark, sf_dir), "max_gap_days", "max_gap_days")


@query(_over(_FACTS, "SELECT median_gap_days, count(*) AS n, round(count(*)::double / sum(count(*)) OVER (), 6) AS share FROM t GROUP BY 1"))
def median_gap_distribution(spark, sf_dir):
    return derived.share_of(_run(_FACTS, spark, sf_dir), "median_gap_days", "median_gap_days")


# --- protocol and operations

_EXPECTED = f"""{_PLAN}, rg AS (SELECT hotel_id, effective_from, CASE label WHEN 'v1' THEN DATE '2024-01-15' END AS until FROM versions),
    x AS (SELECT p.owner_source AS source_code, p.crawl_date, p.checkin_date, rg.hotel_id FROM plan p JOIN rg ON p.crawl_date >= effective_from AND (until IS NULL OR p.crawl_date < until) WHERE p.crawl_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-12'),
    act AS (SELECT source_code, crawl_date, checkin_date, hotel_id, min(status) AS status FROM items WHERE hotel_id IS NOT NULL AND item_id % 3 > 0 GROUP BY 1, 2, 3, 4), ran AS (SELECT DISTINCT source_code, crawl_date FROM items WHERE NOT (source_code = 'b' AND crawl_date = DATE '2024-01-11')),
    o AS (SELECT x.*, coalesce(act.status, 'missing') AS outcome, CASE WHEN act.status IS NULL THEN CASE WHEN ran.source_code IS NULL THEN 'missing_source_run' ELSE 'missing_item_in_existing_run' END END AS missing_reason FROM x LEFT JOIN act USING (source_code, crawl_date, checkin_date, hotel_id) LEFT JOIN ran USING (source_code, crawl_date))"""


def _outcomes(spark, sf_dir) -> DataFrame:
    w = events_warehouse(spark, sf_dir)
    members = merge.cohort_ranges(_versions(w)).select("hotel_id", "effective_from", "effective_until")
    day = lambda d: F.lit(d).cast("date")
    expected = derived.expected_schedule(_plan(w), members, day("2024-01-10"), day("2024-01-12"))
    actual = w.items.filter("hotel_id is not null and item_id % 3 > 0").groupBy("source_code", "crawl_date", "checkin_date", "hotel_id").agg(F.min("status").alias("status"))
    runs = w.runs.filter(~((F.col("source_code") == "b") & (F.col("crawl_date") == day("2024-01-11"))))
    return derived.classify_schedule(expected, actual, runs)


@query(events_sql(f"{_EXPECTED} SELECT source_code, crawl_date, outcome, missing_reason, count(*) AS n FROM o GROUP BY ALL"))
def schedule_outcomes(spark, sf_dir):
    """Three days of plan and cohort, with a third of the items and one run taken away."""
    return _outcomes(spark, sf_dir).groupBy("source_code", "crawl_date", "outcome", "missing_reason").agg(F.count(F.lit(1)).alias("n"))


_OUT = ("success", "partial", "sold_out", "not_bookable", "error", "missing")


@query(events_sql(f"{_EXPECTED}, c AS (SELECT source_code, crawl_date, " + ", ".join(f"count(*) FILTER (outcome = '{s}') AS n_{s}" for s in _OUT) + ", count(*) AS n_scheduled FROM o GROUP BY 1, 2) SELECT *, round(n_success::double / n_scheduled, 6) AS success_rate, round((n_sold_out + n_not_bookable + n_partial)::double / n_scheduled, 6) AS unavailable_rate, round((n_error + n_missing)::double / n_scheduled, 6) AS failure_rate FROM c"))
def protocol_continuity_rates(spark, sf_dir):
    return derived.outcome_rates(derived.continuity(_outcomes(spark, sf_dir), "source_code", "crawl_date"))


@query(events_sql(f"{_EXPECTED} SELECT source_code, crawl_date, checkin_date, hotel_id, outcome FROM o WHERE outcome IN ('error', 'partial')"))
def protocol_exceptions(spark, sf_dir):
    return _outcomes(spark, sf_dir).filter(F.col("outcome").isin("error", "partial")).drop("missing_reason")


@query(events_sql("SELECT source_code, hour(finished_at + INTERVAL 7 HOUR)::int AS finish_hour, count(*) AS n_items FROM items GROUP BY 1, 2"))
def finish_hour_distribution(spark, sf_dir):
    return events_warehouse(spark, sf_dir).items.groupBy("source_code", F.hour(local_time("finished_at")).alias("finish_hour")).agg(F.count(F.lit(1)).alias("n_items"))


_DAILY = "d AS (SELECT source_code, crawl_date, round(count(*) FILTER (status = 'success')::double / count(*), 6) AS success_rate, count(*) AS n_items FROM items GROUP BY 1, 2)"
_Z = "CASE WHEN count({0}) OVER w >= 3 AND stddev_samp({0}) OVER w > 0 THEN round(({0} - avg({0}) OVER w) / stddev_samp({0}) OVER w, 6) END"


@query(events_sql(f"{_DAILY}, z AS (SELECT *, {_Z.format('success_rate')} AS z_success_rate, {_Z.format('n_items')} AS z_n_items FROM d WINDOW w AS (PARTITION BY source_code)) SELECT *, coalesce(abs(z_success_rate) >= 2, false) OR coalesce(abs(z_n_items) >= 2, false) AS flagged FROM z"))
def daily_operational_flags(spark, sf_dir):
    items = events_warehouse(spark, sf_dir).items
    daily = items.groupBy("source_code", "crawl_date").agg(r6(F.count_if(F.col("status") == "success") / F.count(F.lit(1))).alias("success_rate"), F.count(F.lit(1)).alias("n_items"))
    return derived.operational_flags(daily, ["success_rate", "n_items"])


@query(_over("run_duration_and_throughput", "SELECT source_code, round(quantile_cont(duration_minutes, 0.5), 6) AS median_minutes, round(quantile_cont(items_per_hour, 0.5), 6) AS median_items_per_hour FROM t WHERE is_protocol_run GROUP BY 1"))
def median_duration_and_throughput(spark, sf_dir):
    runs = _run("run_duration_and_throughput", spark, sf_dir).filter("is_protocol_run")
    return runs.groupBy("source_code").agg(r6(quantile("duration_minutes", 0.5)).alias("median_minutes"), r6(quantile("items_per_hour", 0.5)).alias("median_items_per_hour"))


_IDENTITY = """versions AS (SELECT hotel_id, DATE '2024-01-01' AS f, DATE '2024-01-15' AS u FROM hotels WHERE hotel_id % 7 <> 0 UNION ALL SELECT hotel_id, DATE '2024-01-15', NULL FROM hotels WHERE hotel_id % 11 <> 0),
    e AS (SELECT i.*, CASE WHEN i.hotel_id IS NOT NULL THEN i.hotel_id ELSE v.hotel_id END AS eff, CASE WHEN i.hotel_id IS NOT NULL THEN 'own' WHEN v.hotel_id IS NOT NULL THEN 'link' ELSE 'unattributed' END AS identity
          FROM items i LEFT JOIN versions v ON i.hotel_id IS NULL AND v.hotel_id = cast(regexp_extract(link, '/h([0-9]+)\\.html', 1) AS bigint) AND crawl_date >= f AND (u IS NULL OR crawl_date < u))"""


def _effective(spark, sf_dir) -> DataFrame:
    w = events_warehouse(spark, sf_dir)
    return derived.effective_hotel(w.items, merge.cohort_ranges(_versions(w)), w.hotels.select("slug", "hotel_id", "city"))


@query(events_sql(f"{_IDENTITY} SELECT item_id, eff AS effective_hotel_id, identity, city AS effective_city FROM e LEFT JOIN hotels h ON h.hotel_id = eff"))
def effective_hotel_identity(spark, sf_dir):
    return _effective(spark, sf_dir).select("item_id", "effective_hotel_id", "identity", "effective_city")


@query(events_sql(f"{_IDENTITY}, u AS (SELECT source_code, link, row_number() OVER (PARTITION BY source_code ORDER BY link) AS k FROM (SELECT DISTINCT source_code, link FROM e WHERE identity = 'unattributed')) SELECT source_code, (SELECT count(*) FROM e WHERE identity = 'unattributed' AND e.source_code = u.source_code) AS n_items, string_agg(link, ',' ORDER BY link) FILTER (k <= 10) AS sample_links FROM u GROUP BY 1"))
def unattributed_summary(spark, sf_dir):
    rows = _effective(spark, sf_dir).filter("identity = 'unattributed'")
    links = rows.groupBy("source_code", "link").agg(F.count(F.lit(1)).alias("n"))
    few = links.withColumn("k", F.row_number().over(Window.partitionBy("source_code").orderBy(F.asc_nulls_last("link")))).filter("k <= 10")
    few = few.groupBy("source_code").agg(F.array_join(F.array_sort(F.collect_list("link")), ",").alias("sample_links"))
    return links.groupBy("source_code").agg(F.sum("n").alias("n_items")).join(few, "source_code")


@query(events_sql(f"{_IDENTITY} SELECT crawl_date, coalesce(city, '(unknown)') AS city, count(DISTINCT eff) AS n_active_hotels, count(*) FILTER (status = 'success') AS n_success, count(*) AS n_items FROM e LEFT JOIN hotels h ON h.hotel_id = eff WHERE include_main GROUP BY 1, 2"))
def availability_on_resolved_identity(spark, sf_dir):
    rows = _effective(spark, sf_dir).filter("include_main").withColumn("city", derived.unknown_last("effective_city"))
    return rows.groupBy("crawl_date", "city").agg(F.countDistinct("effective_hotel_id").alias("n_active_hotels"), F.count_if(F.col("status") == "success").alias("n_success"), F.count(F.lit(1)).alias("n_items"))


# --- collisions: of one day and hotel, whatever the night, so that the events have many

_PAIRS = f"""{_IDENTITY}, r AS (SELECT item_id, source_code, status, finished_at, crawl_date, eff AS hotel_id FROM e WHERE eff IS NOT NULL),
    p AS (SELECT a.item_id AS item_id_a, b.item_id AS item_id_b, a.source_code AS source_a, b.source_code AS source_b, a.status AS status_a, b.status AS status_b, a.finished_at AS fa, b.finished_at AS fb, a.crawl_date, a.hotel_id FROM r a JOIN r b ON a.crawl_date = b.crawl_date AND a.hotel_id = b.hotel_id AND a.source_code < b.source_code)"""


def _pairs(spark, sf_dir) -> DataFrame:
    items = _effective(spark, sf_dir).drop("hotel_id").withColumnRenamed("effective_hotel_id", "hotel_id")
    return catalog.collision_pairs(items, ["crawl_date", "hotel_id"])


@query(events_sql(f"{_PAIRS} SELECT item_id_a, item_id_b, status_a, status_b, crawl_date, hotel_id FROM p"))
def collisions_on_resolved_identity(spark, sf_dir):
    return _pairs(spark, sf_dir).select("item_id_a", "item_id_b", "status_a", "status_b", "crawl_date", "hotel_id")


@query(events_sql(f"{_PAIRS} SELECT status_a, status_b, count(*) AS n_pairs FROM p GROUP BY 1, 2"))
def collision_status_matrix(spark, sf_dir):
    return derived.status_matrix(_pairs(spark, sf_dir))


@query(events_sql(f"{_PAIRS} SELECT count(*) AS n_pairs, count(*) FILTER (status_a = status_b) AS n_same, count(*) FILTER (status_a = 'success' AND status_b = 'success') AS n_both_success, round(count(*) FILTER (status_a = status_b)::double / count(*), 6) AS same_rate FROM p"))
def collision_concordance(spark, sf_dir):
    return derived.concordance(_pairs(spark, sf_dir))


_MIN = "abs(datediff('microsecond', fa, fb)) // 1000000 / 60.0"
_MB = "(VALUES ('0-5', 1), ('6-15', 2), ('16-60', 3), ('61+', 4)) AS b(minute_bucket, bucket_order)"


@query(events_sql(f"{_PAIRS}, g AS (SELECT CASE WHEN m < 6 THEN '0-5' WHEN m < 16 THEN '6-15' WHEN m < 61 THEN '16-60' ELSE '61+' END AS minute_bucket, count(*) AS n, count(*) FILTER (status_a = status_b) AS n_same FROM (SELECT *, {_MIN} AS m FROM p) GROUP BY 1) SELECT minute_bucket, bucket_order, coalesce(n, 0) AS n, coalesce(n_same, 0) AS n_same FROM {_MB} LEFT JOIN g USING (minute_bucket)"))
def collision_time_strata(spark, sf_dir):
    return derived.by_minutes(_pairs(spark, sf_dir), derived.apart("observed_finish_a", "observed_finish_b"), {"n_same": F.count_if(F.col("status_a") == F.col("status_b"))})


@query(events_sql(f"{_PAIRS}, c AS (SELECT source_a, source_b, crawl_date, hotel_id, count(*) AS n_pairs FROM p GROUP BY 1, 2, 3, 4) SELECT *, round(n_pairs::double / sum(n_pairs) OVER (PARTITION BY source_a, source_b, crawl_date), 6) AS day_share FROM c"))
def near_time_concentration(spark, sf_dir):
    return derived.near_concentration(_pairs(spark, sf_dir))


_OPTS = f"""{_PAIRS}, op AS (SELECT item_id, coalesce(room_key, '-') AS room_key, price_per_night AS price, breakfast_included, max_occupancy FROM observations UNION ALL SELECT item_id, coalesce(room_key, '-'), price_per_night, breakfast_included, max_occupancy FROM observations WHERE item_id % 6 = 0),
    sp AS (SELECT * FROM p WHERE status_a = 'success' AND status_b = 'success'),
    u AS (SELECT * FROM op WHERE (item_id, room_key) IN (SELECT (item_id, room_key) FROM op GROUP BY item_id, room_key HAVING count(*) = 1)),
    de AS (SELECT item_id_a, item_id_b, fa, fb, a.room_key, abs(a.price - b.price) AS abs_diff, abs(a.price - b.price) * 2 / nullif(a.price + b.price, 0) AS rel_diff, a.breakfast_included IS NOT DISTINCT FROM b.breakfast_included AS same_breakfast_included, a.max_occupancy IS NOT DISTINCT FROM b.max_occupancy AS same_max_occupancy FROM sp JOIN u a ON a.item_id = item_id_a JOIN u b ON b.item_id = item_id_b AND a.room_key = b.room_key)"""
_FIELDS = ["breakfast_included", "max_occupancy"]


def _options(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Success pairs, and options of which some stand twice in their item."""
    obs = events_warehouse(spark, sf_dir).observations.select("item_id", F.coalesce("room_key", F.lit("-")).alias("room_key"), F.col("price_per_night").alias("price"), *_FIELDS)
    return _pairs(spark, sf_dir).filter("status_a = 'success' and status_b = 'success'"), obs.unionByName(obs.filter("item_id % 6 = 0"))


@query(events_sql(f"{_OPTS} SELECT item_id_a, item_id_b, room_key, round(abs_diff, 6) AS abs_diff, round(rel_diff, 6) AS rel_diff, same_breakfast_included, same_max_occupancy FROM de"))
def paired_option_detail(spark, sf_dir):
    pairs, opts = _options(spark, sf_dir)
    return derived.paired_options(pairs, opts, ["room_key"], _FIELDS).select("item_id_a", "item_id_b", "room_key", r6("abs_diff").alias("abs_diff"), r6("rel_diff").alias("rel_diff"), "same_breakfast_included", "same_max_occupancy")


@query(events_sql(f"{_OPTS} SELECT count(*) AS n_options, count(*) FILTER (abs_diff = 0) AS n_equal_price, round(quantile_cont(abs_diff, 0.5), 6) AS median_abs_diff, round(avg(abs_diff), 6) AS mean_abs_diff, round(max(abs_diff), 6) AS max_abs_diff, round(quantile_cont(rel_diff, 0.5), 6) AS median_rel_diff, round(avg(same_breakfast_included::int), 6) AS same_breakfast_included_rate, round(avg(same_max_occupancy::int), 6) AS same_max_occupancy_rate FROM de"))
def paired_option_summary(spark, sf_dir):
    pairs, opts = _options(spark, sf_dir)
    return derived.option_summary(derived.paired_options(pairs, opts, ["room_key"], _FIELDS), _FIELDS)


@query(events_sql(f"{_OPTS}, g AS (SELECT CASE WHEN m < 6 THEN '0-5' WHEN m < 16 THEN '6-15' WHEN m < 61 THEN '16-60' ELSE '61+' END AS minute_bucket, count(*) AS n, count(*) FILTER (abs_diff = 0) AS n_exact FROM (SELECT *, {_MIN} AS m FROM de) GROUP BY 1) SELECT minute_bucket, bucket_order, coalesce(n, 0) AS n, coalesce(n_exact, 0) AS n_exact FROM {_MB} LEFT JOIN g USING (minute_bucket)"))
def paired_option_time_strata(spark, sf_dir):
    pairs, opts = _options(spark, sf_dir)
    return derived.by_minutes(derived.paired_options(pairs, opts, ["room_key"], _FIELDS), derived.apart("observed_finish_a", "observed_finish_b"), {"n_exact": F.count_if(F.col("abs_diff") == 0)})


_COVER = f"""{_OPTS}, k AS (SELECT item_id, room_key, count(*) AS n FROM op GROUP BY 1, 2), cv AS (SELECT item_id_a, item_id_b, room_key, count(*) FILTER (k.item_id = item_id_a) AS a, count(*) FILTER (k.item_id = item_id_b) AS b, max(n) AS n FROM sp JOIN k ON k.item_id IN (item_id_a, item_id_b) GROUP BY 1, 2, 3),
    co AS (SELECT item_id_a, item_id_b, sum(a)::bigint AS n_options_a, sum(b)::bigint AS n_options_b, count(*) FILTER (a > 0 AND b > 0) AS n_shared, count(*) AS n_union, count(*) FILTER (n > 1) AS n_ambiguous FROM cv GROUP BY 1, 2)"""


@query(events_sql(f"{_COVER} SELECT *, round(n_shared::double / n_union, 6) AS jaccard FROM co"))
def paired_option_coverage(spark, sf_dir):
    pairs, opts = _options(spark, sf_dir)
    return derived.option_coverage(pairs, opts, ["room_key"])


@query(events_sql(f"{_COVER} SELECT count(*) AS n_pairs, count(*) FILTER (n_shared > 0) AS n_pairs_sharing, sum(n_shared)::bigint AS n_shared, sum(n_union)::bigint AS n_union, round(avg(n_shared::double / n_union), 6) AS mean_jaccard FROM co"))
def paired_option_coverage_summary(spark, sf_dir):
    pairs, opts = _options(spark, sf_dir)
    return derived.option_coverage(pairs, opts, ["room_key"]).agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("n_shared") > 0).alias("n_pairs_sharing"), F.sum("n_shared").alias("n_shared"), F.sum("n_union").alias("n_union"), r6(F.avg(F.col("n_shared") / F.col("n_union"))).alias("mean_jaccard"))


# --- duplicates, over coarse keys, so that orders have many

_DUP = "u AS (SELECT *, split_part(room_key, '/', 1) AS rk FROM observations WHERE NOT is_sold_out), g AS (SELECT source_code, city, item_id, rk, count(*) AS n_rows, min(price_per_night) AS min_price, max(price_per_night) AS max_price, min(hotel_id) AS hotel_id FROM u GROUP BY 1, 2, 3, 4 HAVING count(*) > 1)"


def _dups(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = orders_warehouse(spark, sf_dir).observations.filter("not is_sold_out").withColumn("rk", F.substring_index("room_key", "/", 1))
    return rows, rows.groupBy("source_code", "city", "item_id", "rk").agg(F.count(F.lit(1)).alias("n_rows"), F.min("price_per_night").alias("min_price"), F.max("price_per_night").alias("max_price"), F.min("hotel_id").alias("hotel_id")).filter("n_rows > 1")


@query(orders_sql(f"{_DUP} SELECT CASE WHEN grouping(source_code) = 1 THEN '(all)' ELSE source_code END AS source_code, CASE WHEN grouping(city) = 1 THEN '(all)' ELSE city END AS city, count(*) AS n_groups, sum(n_rows - 1)::bigint AS n_extra, max(n_rows) AS largest_group FROM g GROUP BY CUBE (source_code, city)"))
def duplicate_summary(spark, sf_dir):
    return derived.duplicate_summary(_dups(spark, sf_dir)[1])


_SP = "(max_price - min_price)"
_RP = "(2 * (max_price - min_price) / nullif(max_price + min_price, 0))"


@query(orders_sql(f"{_DUP} SELECT CASE WHEN grouping(source_code) = 1 THEN '(all)' ELSE source_code END AS source_code, count(*) AS n_groups, " + ", ".join(f"round(quantile_cont({x}, {p}), 6) AS {n}_p{round(p * 100)}" for n, x in (("abs", _SP), ("rel", _RP)) for p in (0.25, 0.5, 0.75, 0.95, 0.99)) + " FROM g WHERE min_price IS NOT NULL GROUP BY ROLLUP (source_code)"))
def duplicate_price_spread(spark, sf_dir):
    return derived.spread_quantiles(_dups(spark, sf_dir)[1])


def _audit_part(name: str, value: str) -> str:
    return f"SELECT source_code, hotel_id, item_id, rk, '{name}' AS reason FROM (SELECT *, row_number() OVER (PARTITION BY source_code ORDER BY v DESC NULLS LAST, item_id, rk) AS k2 FROM (SELECT *, row_number() OVER (PARTITION BY source_code, hotel_id ORDER BY v DESC NULLS LAST, item_id, rk) AS k FROM (SELECT *, {value} AS v FROM g)) WHERE k = 1) WHERE k2 <= 8"


_AUDIT = f"{_DUP}, s AS ({_audit_part('large', 'n_rows')} UNION ALL {_audit_part('spread', 'round(' + _SP + ', 6)')}), ch AS (SELECT source_code, hotel_id, item_id, rk, string_agg(reason, '+' ORDER BY reason) AS reasons FROM s GROUP BY 1, 2, 3, 4)"


def _chosen(groups: DataFrame) -> DataFrame:
    return derived.audit_selection(groups, {"large": F.col("n_rows").cast("double"), "spread": r6(F.col("max_price") - F.col("min_price"))}, "hotel_id", ["item_id", "rk"])


@query(orders_sql(f"{_AUDIT} SELECT * FROM ch"))
def duplicate_audit_selection(spark, sf_dir):
    """The feature is a selection of eight groups a source and criterion."""
    return _chosen(_dups(spark, sf_dir)[1])


@query(orders_sql(f"{_AUDIT} SELECT u.item_id, u.rk, reasons, round(u.price_total, 6) AS price_total, row_number() OVER (PARTITION BY u.item_id, u.rk ORDER BY option_index, u.price_total) AS rank_in_group, count(*) OVER (PARTITION BY u.item_id, u.rk) AS group_rows FROM u JOIN (SELECT DISTINCT item_id, rk, reasons FROM ch) c USING (item_id, rk)"))
def duplicate_audit_sample(spark, sf_dir):
    rows, groups = _dups(spark, sf_dir)
    return derived.audit_rows(_chosen(groups).select("item_id", "rk", "reasons").distinct(), rows, ["item_id", "rk"], ["option_index", "price_total"]).select("item_id", "rk", "reasons", r6("price_total").alias("price_total"), "rank_in_group", "group_rows")


# --- calendar

_HOLIDAYS = [("2024-01-01", "new_year", "public_holiday", "national", None, False, "confirmed"), ("2024-02-10", "tet", "public_holiday", "national", None, True, "confirmed"), ("2024-01-20", "lantern", "festival", "city", "Hoi An", False, "provisional"), ("2024-01-20", "race", "major_event", "city", "Da Nang", False, "confirmed"), ("2024-02-11", "tet2", "public_holiday", "national", None, True, "provisional")]
_HOL = "hol(day, event_type, scope, hcity, is_tet, hstatus) AS (VALUES " + ", ".join(f"(DATE '{d}', '{t}', '{s}', {'NULL' if c is None else repr(c)}, {str(tet).lower()}, '{st}')" for d, _, t, s, c, tet, st in _HOLIDAYS) + ")"
_CAL = f"""{_HOL}, cells AS (SELECT DISTINCT o.checkin_date AS day, h.city FROM observations o CROSS JOIN (SELECT DISTINCT city FROM hotels WHERE city IS NOT NULL) h),
    cal AS (SELECT c.day, c.city, coalesce(bool_or(event_type = 'public_holiday'), false) AS is_public_holiday, coalesce(bool_or(event_type = 'festival'), false) AS is_festival_period, coalesce(bool_or(event_type = 'major_event'), false) AS is_major_event, coalesce(bool_or(is_tet), false) AS is_tet, count(*) FILTER (hstatus = 'confirmed') AS n_confirmed, count(*) FILTER (hstatus = 'provisional') AS n_provisional
            FROM cells c LEFT JOIN hol ON hol.day = c.day AND (scope = 'national' OR hcity = c.city) GROUP BY 1, 2)"""


def holidays(spark) -> DataFrame:
    rows = spark.createDataFrame(_HOLIDAYS, "d string, event_code string, event_type string, scope string, city string, is_tet boolean, status string")
    return rows.select(F.col("d").cast("date").alias("holiday_date"), "event_code", "event_type", "scope", "city", "is_tet", "status")


def _calendar(w) -> DataFrame:
    return derived.calendar_flags(w.observations.select(F.col("checkin_date").alias("day")), w.hotels.filter("city is not null"), holidays(w.spark))


@query(events_sql(f"{_CAL} SELECT * FROM cal"))
def calendar_flags_by_city(spark, sf_dir):
    return _calendar(events_warehouse(spark, sf_dir))


@query(events_sql(f"""{_CAL}, a AS (SELECT checkin_date, count(*) AS n_items, count(DISTINCT crawl_date) AS n_crawl_dates, count(DISTINCT source_code) AS n_sources, min(lead_time) AS min_lead_time, max(lead_time) AS max_lead_time FROM items WHERE include_main GROUP BY 1),
    f AS (SELECT day AS checkin_date, bool_or(is_public_holiday) AS is_public_holiday_any_city, bool_or(is_festival_period) AS is_festival_period_any_city, bool_or(is_major_event) AS is_major_event_any_city, bool_or(is_tet) AS is_tet_any_city FROM cal GROUP BY 1)
    SELECT a.*, isodow(checkin_date)::int AS weekday_number, dayname(checkin_date) AS weekday, isodow(checkin_date) IN (5, 6) AS is_weekend_fri_sat, coalesce(is_public_holiday_any_city, false) AS is_public_holiday_any_city, coalesce(is_festival_period_any_city, false) AS is_festival_period_any_city, coalesce(is_major_event_any_city, false) AS is_major_event_any_city, coalesce(is_tet_any_city, false) AS is_tet_any_city FROM a LEFT JOIN f USING (checkin_date)"""))
def checkin_anchor_dates(spark, sf_dir):
    w = events_warehouse(spark, sf_dir)
    return derived.anchor_dates(catalog.scope(w.items, "MAIN"), _calendar(w))


@query(events_sql(f"{_CAL} SELECT i.item_id, n.is_tet AS checkin_is_tet, n.is_festival_period AS checkin_is_festival_period, s.is_public_holiday AS seen_is_public_holiday FROM items i JOIN hotels h USING (hotel_id) LEFT JOIN cal n ON n.day = i.checkin_date AND n.city = h.city LEFT JOIN cal s ON s.day = i.crawl_date AND s.city = h.city WHERE include_main"))
def calendar_roles_of_items(spark, sf_dir):
    """Flags of the night and of the day it was seen, side by side."""
    w = events_warehouse(spark, sf_dir)
    rows = catalog.scope(w.items, "MAIN").join(w.hotels.select("hotel_id", "city"), "hotel_id")
    night, seen = (derived.in_role(_calendar(w), r) for r in ("checkin", "seen"))
    out = rows.join(night, ["checkin_date", "city"], "left").join(seen.withColumnRenamed("seen_date", "crawl_date"), ["crawl_date", "city"], "left")
    return out.select("item_id", "checkin_is_tet", "checkin_is_festival_period", "seen_is_public_holiday")


def _flagged(spark, sf_dir) -> DataFrame:
    w = events_warehouse(spark, sf_dir)
    rows = catalog.priced(w).join(w.hotels.select("hotel_id", "city"), "hotel_id", "left")
    flags = _calendar(w).select(F.col("day").alias("checkin_date"), "city", "is_public_holiday", "is_tet", "is_festival_period", "is_major_event")
    return rows.join(flags, ["checkin_date", "city"], "left").fillna(False, ["is_public_holiday", "is_tet", "is_festival_period", "is_major_event"])


_FOUR = ["is_public_holiday", "is_tet", "is_festival_period", "is_major_event"]
_FLAGGED = f"{_CAL}, pm AS (SELECT o.*, " + ", ".join(f"coalesce(cal.{f}, false) AS {f}" for f in _FOUR) + " FROM observations o JOIN items i USING (item_id) LEFT JOIN hotels h ON h.hotel_id = o.hotel_id LEFT JOIN cal ON cal.day = o.checkin_date AND cal.city = h.city WHERE i.include_main AND NOT is_sold_out AND price_per_night IS NOT NULL)"
_STATS_SQL = EVENTS["price_distribution_overall_main"].split("SELECT ")[-1].split(" FROM ")[0]


@query(events_sql(f"{_FLAGGED} SELECT {', '.join(_FOUR)}, {_STATS_SQL}, count(DISTINCT checkin_date) AS n_distinct_checkin_dates FROM pm GROUP BY 1, 2, 3, 4"))
def price_distribution_by_calendar_flags_main(spark, sf_dir):
    return catalog.price_stats(_flagged(spark, sf_dir), *_FOUR, more=[F.countDistinct("checkin_date").alias("n_distinct_checkin_dates")])


@query(events_sql(f"{_FLAGGED}, c AS (SELECT {', '.join(_FOUR)}, count(*) AS n FROM pm GROUP BY 1, 2, 3, 4) SELECT *, round(n::double / sum(n) OVER (), 6) AS share FROM c"))
def observation_counts_by_calendar_flags(spark, sf_dir):
    counts = _flagged(spark, sf_dir).groupBy(*_FOUR).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", r6(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))))


# --- summaries and findings


@query(_over("price_sensitivity_by_series_main", "SELECT v.variant, count(*) AS n_series_days, round(quantile_cont(v.price, 0.5), 6) AS median_price, round(avg(v.price), 6) AS mean_price FROM t, LATERAL (VALUES ('min_price', min_price), ('median_price', median_price)) AS v(variant, price) GROUP BY 1"))
def sensitivity_summary(spark, sf_dir):
    rows = _run("price_sensitivity_by_series_main", spark, sf_dir).unpivot(["hotel_id"], ["min_price", "median_price"], "variant", "price")
    return derived.variant_summary(rows, "variant", "price")


@query(events_sql("SELECT strftime(checkin_date, '%Y-%m') AS checkin_month, isodow(checkin_date)::int - 1 AS weekday_number, coalesce(city, '(unknown)') AS city, source_code, count(*) AS n_items FROM items LEFT JOIN hotels USING (hotel_id) WHERE include_main GROUP BY ALL"))
def item_coverage_table(spark, sf_dir):
    w = events_warehouse(spark, sf_dir)
    rows = catalog.with_city(catalog.scope(w.items, "MAIN"), w)
    return rows.groupBy(catalog.month("checkin_date").alias("checkin_month"), F.weekday("checkin_date").alias("weekday_number"), "city", "source_code").agg(F.count(F.lit(1)).alias("n_items"))


@query(orders_sql("SELECT city, count(*) AS n_a, count(*) FILTER (NOT is_sold_out OR hotel_id % 10 > 0) AS n_b, count(*) = count(*) FILTER (NOT is_sold_out OR hotel_id % 10 > 0) AS ok FROM observations GROUP BY 1"))
def count_reconciliation(spark, sf_dir):
    """With some rows taken from one side."""
    rows = orders_warehouse(spark, sf_dir).observations
    n = F.count(F.lit(1)).alias("n")
    return derived.counts_agree(rows.groupBy("city").agg(n), rows.filter("not is_sold_out or hotel_id % 10 > 0").groupBy("city").agg(n), "city")


@query(events_sql("""f AS (SELECT 'price_total_differs' AS check_name, 'warning' AS severity, 'observation' AS grain, (SELECT count(*) FROM observations WHERE abs(price_total - price_per_night) > 1e-9) AS n_found, (SELECT count(*) FROM observations) AS denominator,
        (SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT cast(record_id AS varchar) AS k FROM observations WHERE abs(price_total - price_per_night) > 1e-9 ORDER BY 1 LIMIT 5)) AS sample_keys
    UNION ALL SELECT 'night_count', 'error', 'item', (SELECT count(*) FROM items WHERE checkout_date - checkin_date <> 1), (SELECT count(*) FROM items), (SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT cast(item_id AS varchar) AS k FROM items WHERE checkout_date - checkin_date <> 1 ORDER BY 1 LIMIT 5))
    UNION ALL SELECT 'unfinished', 'error', 'item', 0, (SELECT count(*) FROM items), '') SELECT *, round(n_found::double / denominator, 6) AS rate FROM f"""))
def quality_findings(spark, sf_dir):
    w = events_warehouse(spark, sf_dir)
    return derived.findings({
        "price_total_differs": ("warning", "observation", w.observations.filter("abs(price_total - price_per_night) > 1e-9"), "record_id", w.observations),
        "night_count": ("error", "item", w.items.filter("datediff(checkout_date, checkin_date) <> 1"), "item_id", w.items),
        "unfinished": ("error", "item", w.items.filter("status = 'running'"), "item_id", w.items),
    })


@query(_over("lead_time_bucket_distribution_main", "SELECT lead_time_bucket, round(100.0 * n_observations / sum(n_observations) OVER (), 6) AS percent, h.p AS historical, round(100.0 * n_observations / sum(n_observations) OVER () - h.p, 6) AS delta, abs(100.0 * n_observations / sum(n_observations) OVER () - h.p) <= 0.5 AS within_tolerance FROM t LEFT JOIN (VALUES ('1-3', 3.0::double), ('61+', 39.0), ('4-7', 4.2)) h(b, p) ON b = lead_time_bucket"))
def coverage_against_history(spark, sf_dir):
    t = _run("lead_time_bucket_distribution_main", spark, sf_dir)
    now = t.select("lead_time_bucket", (100.0 * F.col("n_observations") / F.sum("n_observations").over(Window.partitionBy(F.lit(1)))).alias("percent"))
    history = spark.createDataFrame([("1-3", 3.0), ("61+", 39.0), ("4-7", 4.2)], "lead_time_bucket string, percent double")
    return derived.against_history(now, history, "lead_time_bucket", "percent")


@query(events_sql("j AS (SELECT * FROM items WHERE hotel_id IS NOT NULL), " + facts_sql("j", "source_code, hotel_id").lstrip()))
def item_series_facts(spark, sf_dir):
    return catalog.series_facts(events_warehouse(spark, sf_dir).items.filter("hotel_id is not null"), ["source_code", "hotel_id"])


@query(orders_sql("SELECT CASE WHEN grouping(city) = 1 THEN '(all)' ELSE city END AS city, count(*) AS n_series, count(*) FILTER (n >= 3) AS n_ge3, round(count(*) FILTER (n >= 3)::double / count(*), 6) AS share FROM (SELECT city, hotel_id, date_trunc('year', checkin_date) AS y, count(DISTINCT run_id) AS n FROM observations GROUP BY 1, 2, 3) GROUP BY GROUPING SETS ((city), ())"))
def evidence_run_share(spark, sf_dir):
    per = orders_warehouse(spark, sf_dir).observations.groupBy("city", "hotel_id", F.trunc("checkin_date", "year").alias("y")).agg(F.countDistinct("run_id").alias("n"))
    out = per.rollup("city").agg(F.count(F.lit(1)).alias("n_series"), F.count_if(F.col("n") >= 3).alias("n_ge3"), F.grouping("city").alias("_g"))
    return out.select(F.when(F.col("_g") == 1, "(all)").otherwise(F.col("city")).alias("city"), "n_series", "n_ge3", r6(F.col("n_ge3") / F.col("n_series")).alias("share"))
