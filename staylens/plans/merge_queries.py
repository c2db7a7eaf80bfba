"""Queries over merging, ownership, integrity, references and anomaly signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import r6
from ..functions.timeaxis import UNKNOWN, bucket
from ..operators import anomaly, merge, reference
from ..sources.bindings import events_warehouse, orders_warehouse, read
from .preludes import BUCKET, LEGACY_BUCKET, events_sql, orders_sql
from .registry import query

# --- merging

_HOTEL_ROWS = """r AS (SELECT s_suppkey // 2 AS hotel_id, CASE WHEN s_suppkey % 2 = 0 THEN 'a' ELSE 'b' END AS source_code, CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 2 END AS source_priority, s_name AS name, CASE WHEN s_suppkey % 3 > 0 THEN cast(s_nationkey AS varchar) END AS address,
    CASE WHEN s_suppkey % 5 > 0 THEN DATE '2024-01-01' + (s_suppkey * 7 % 30)::int END AS attributes_at, CASE WHEN s_suppkey % 4 = 0 THEN 'open' ELSE 'closed' END AS booking_status, CASE WHEN s_suppkey % 7 > 0 THEN DATE '2024-02-01' + (s_suppkey * 11 % 20)::int END AS status_at, DATE '2023-01-01' + (s_suppkey % 50)::int AS created_at FROM supplier)"""


def _hotel_rows(spark, sf_dir) -> DataFrame:
    k = F.col("s_suppkey")
    day = lambda d, n: F.date_add(F.lit(d).cast("date"), n.cast("int"))
    return read(spark, sf_dir, "supplier").select(
        F.floor(k / 2).alias("hotel_id"), F.when(k % 2 == 0, "a").otherwise("b").alias("source_code"), F.when(k % 2 == 0, 1).otherwise(2).alias("source_priority"), F.col("s_name").alias("name"), F.when(k % 3 > 0, F.col("s_nationkey").cast("string")).alias("address"),
        F.when(k % 5 > 0, day("2024-01-01", k * 7 % 30)).alias("attributes_at"), F.when(k % 4 == 0, "open").otherwise("closed").alias("booking_status"), F.when(k % 7 > 0, day("2024-02-01", k * 11 % 20)).alias("status_at"), day("2023-01-01", k % 50).alias("created_at"),
    )


@query(f"""WITH {_HOTEL_ROWS}, a AS (SELECT *, row_number() OVER (PARTITION BY hotel_id ORDER BY (attributes_at IS NOT NULL) DESC, attributes_at DESC, (address IS NOT NULL) DESC, source_priority) AS k FROM r), s AS (SELECT *, row_number() OVER (PARTITION BY hotel_id ORDER BY (status_at IS NOT NULL) DESC, status_at DESC, source_priority) AS k FROM r)
    SELECT a.hotel_id, a.name, a.address, a.attributes_at, s.booking_status, s.status_at, a.source_code AS attributes_source, s.source_code AS status_source, m.created_at, m.source_codes
    FROM a JOIN s USING (hotel_id) JOIN (SELECT hotel_id, min(created_at) AS created_at, string_agg(DISTINCT source_code, ',' ORDER BY source_code) AS source_codes FROM r GROUP BY 1) m USING (hotel_id) WHERE a.k = 1 AND s.k = 1""")
def hotels_merged_by_field_group(spark, sf_dir):
    return merge.merge_hotels(_hotel_rows(spark, sf_dir), "hotel_id", {"attributes": ("attributes_at", ["name", "address"]), "status": ("status_at", ["booking_status"])}, "created_at")


@query(f"""WITH {_HOTEL_ROWS} SELECT coalesce(a.hotel_id, b.hotel_id) AS hotel_id, coalesce(nullif(b.name, ''), a.name) AS name, coalesce(nullif(b.address, ''), a.address) AS address, coalesce(b.attributes_at, a.attributes_at) AS attributes_at
    FROM (SELECT * FROM r WHERE source_code = 'a') a FULL JOIN (SELECT * FROM r WHERE source_code = 'b') b ON a.hotel_id = b.hotel_id""")
def hotel_upsert(spark, sf_dir):
    rows = _hotel_rows(spark, sf_dir)
    return merge.upserted(rows.filter("source_code = 'a'"), rows.filter("source_code = 'b'"), "hotel_id", ["name", "address", "attributes_at"])


@query(events_sql("SELECT hotel_id, count(*) AS n_rows, max(crawl_date) AS attempt FROM observations o WHERE crawl_date = (SELECT max(crawl_date) FROM observations p WHERE p.hotel_id = o.hotel_id) GROUP BY 1"))
def rows_of_latest_attempt(spark, sf_dir):
    kept = merge.latest_attempt(events_warehouse(spark, sf_dir).observations, "hotel_id", "crawl_date")
    return kept.groupBy("hotel_id").agg(F.count(F.lit(1)).alias("n_rows"), F.max("crawl_date").alias("attempt"))


@query("SELECT source_code, source_priority, count(*) AS n FROM (SELECT 'a' AS source_code, 1 AS source_priority FROM supplier UNION ALL SELECT 'b', 2 FROM customer) GROUP BY ALL")
def sources_stacked(spark, sf_dir):
    one = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    two = read(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("k"))
    return merge.stacked({("a", 1): one, ("b", 2): two}).groupBy("source_code", "source_priority").agg(F.count(F.lit(1)).alias("n"))


# --- plans, cohorts, ownership: the plan owns four nights of five, on most days; cohorts change on the fifteenth day

_PLAN = """n AS (SELECT DISTINCT crawl_date, checkin_date FROM items),
    plan AS (SELECT crawl_date, checkin_date, CASE WHEN day(checkin_date) % 2 = 0 THEN 'a' ELSE 'b' END AS owner_source FROM n WHERE datediff('day', DATE '2024-01-01', checkin_date) % 5 <> 0 AND day(crawl_date) % 9 <> 4 AND crawl_date >= DATE '2024-01-03'),
    versions AS (SELECT 'v1' AS label, DATE '2024-01-01' AS effective_from, hotel_id, city FROM hotels WHERE hotel_id % 7 <> 0 UNION ALL SELECT 'v2', DATE '2024-01-15', hotel_id, city FROM hotels WHERE hotel_id % 11 <> 0)"""


def _plan(w) -> DataFrame:
    nights = w.items.select("crawl_date", "checkin_date").distinct()
    keep = (F.date_diff("checkin_date", F.lit("2024-01-01").cast("date")) % 5 != 0) & (F.dayofmonth("crawl_date") % 9 != 4) & (F.col("crawl_date") >= F.lit("2024-01-03").cast("date"))
    return nights.filter(keep).withColumn("owner_source", F.when(F.dayofmonth("checkin_date") % 2 == 0, "a").otherwise("b"))


def _versions(w) -> DataFrame:
    one = lambda label, day, k: w.hotels.filter(F.col("hotel_id") % k != 0).select(F.lit(label).alias("label"), F.lit(day).cast("date").alias("effective_from"), "hotel_id", "city")
    return one("v1", "2024-01-01", 7).unionByName(one("v2", "2024-01-15", 11))


_OWNERSHIP = f"""{_PLAN},
    c AS (SELECT i.*, hotel_id % CASE WHEN crawl_date >= DATE '2024-01-15' THEN 11 ELSE 7 END <> 0 AND hotel_id IS NOT NULL AND crawl_date >= DATE '2024-01-01' AS in_cohort FROM items i),
    x AS (SELECT c.item_id, c.source_code, c.status, c.hotel_id, c.in_cohort, p.owner_source, (SELECT count(*) FROM plan q WHERE q.owner_source = c.source_code AND q.crawl_date = c.crawl_date) > 0 AS plans_day, (SELECT count(*) FROM plan q WHERE q.owner_source = c.source_code AND q.checkin_date = c.checkin_date) > 0 AS plans_night, c.crawl_date, f.first, f.last
          FROM c LEFT JOIN plan p ON c.crawl_date = p.crawl_date AND c.checkin_date = p.checkin_date LEFT JOIN (SELECT owner_source, min(crawl_date) AS first, max(crawl_date) AS last FROM plan GROUP BY 1) f ON f.owner_source = c.source_code),
    s AS (SELECT *, CASE WHEN owner_source IS NULL THEN 'unassigned' WHEN owner_source <> source_code THEN 'non_owner_duplicate' WHEN hotel_id IS NOT NULL AND NOT in_cohort THEN 'protocol_deviation' WHEN status = 'success' THEN 'owner_success' ELSE 'owner_failure' END AS ownership,
          CASE WHEN owner_source IS NULL THEN CASE WHEN NOT plans_day THEN CASE WHEN first IS NULL THEN 'run_not_in_plan' WHEN crawl_date < first THEN 'before_first_day' WHEN crawl_date > last THEN 'after_last_day' ELSE 'day_not_in_plan' END WHEN plans_night THEN 'night_planned_on_other_day' ELSE 'night_never_planned' END
               WHEN owner_source <> source_code THEN 'non_owner_duplicate' WHEN hotel_id IS NOT NULL AND NOT in_cohort THEN 'hotel_outside_cohort' WHEN status <> 'success' THEN 'owner_failure_status_' || status END AS reason FROM x)"""


def _owned(w) -> DataFrame:
    items = merge.in_cohort(w.items.select("item_id", "source_code", "run_id", "crawl_date", "checkin_date", "status", "hotel_id"), _versions(w))
    runs = merge.owned_runs(w.runs.select("run_id", "source_code", "crawl_date"), _plan(w)).select("run_id", F.col("planned").alias("run_planned"))
    return merge.resolve_ownership(items.join(runs, "run_id"), _plan(w))


@query(events_sql(f"{_OWNERSHIP} SELECT item_id, ownership AS ownership_status, reason AS exclusion_reason, ownership IN ('owner_success', 'owner_failure') AND plans_day AS include_main, ownership = 'owner_success' AND plans_day AS include_reference FROM s"))
def item_ownership(spark, sf_dir):
    return _owned(events_warehouse(spark, sf_dir)).select("item_id", "ownership_status", "exclusion_reason", "include_main", "include_reference")


@query(events_sql(f"{_PLAN} SELECT r.run_id, count(p.owner_source) > 0 AS planned FROM runs r LEFT JOIN plan p ON p.owner_source = r.source_code AND p.crawl_date = r.crawl_date GROUP BY 1"))
def run_ownership(spark, sf_dir):
    w = events_warehouse(spark, sf_dir)
    return merge.owned_runs(w.runs, _plan(w)).select("run_id", "planned")


@query(events_sql(f"{_PLAN} SELECT crawl_date, checkin_date, count(DISTINCT o) AS n_owners, string_agg(DISTINCT o, ',' ORDER BY o) AS owners FROM (SELECT crawl_date, checkin_date, owner_source AS o FROM plan UNION ALL SELECT crawl_date, checkin_date, 'b' FROM plan WHERE day(crawl_date) = 2 + 10) GROUP BY 1, 2 HAVING count(DISTINCT o) > 1"))
def plan_conflicts(spark, sf_dir):
    """With a second owner put in for one day."""
    plan = _plan(events_warehouse(spark, sf_dir))
    return merge.plan_conflicts(plan.unionByName(plan.filter(F.dayofmonth("crawl_date") == 12).withColumn("owner_source", F.lit("b"))))


@query(events_sql(f"{_PLAN} SELECT unnest(['unknown_source', 'unknown_slot', 'slot_length', 'checkin_before_crawl']) AS rule, unnest([count(*) FILTER (day(crawl_date) = 11), count(*) FILTER (day(checkin_date) = 11), 0, 0]) AS n_violations FROM plan"))
def plan_row_violations(spark, sf_dir):
    plan = _plan(events_warehouse(spark, sf_dir)).withColumn("schedule_slot", F.when(F.dayofmonth("checkin_date") == 11, "noon").otherwise("night"))
    return merge.plan_violations(plan.withColumn("owner_source", F.when(F.dayofmonth("crawl_date") == 11, "z").otherwise(F.col("owner_source"))), ["a", "b"], ["night"])


@query(events_sql(f"{_PLAN} SELECT label, effective_from, count(*) AS n_hotels, count(*) - lag(count(*)) OVER (ORDER BY effective_from) AS change FROM versions GROUP BY 1, 2"))
def cohort_attrition(spark, sf_dir):
    return merge.cohort_sizes(_versions(events_warehouse(spark, sf_dir)))


@query(events_sql("SELECT 'two_cities' AS fault, cast(hotel_id AS varchar) AS subject FROM hotels WHERE hotel_id % 13 = 0 AND hotel_id % 7 <> 0 AND hotel_id % 11 <> 0"))
def cohort_history_faults(spark, sf_dir):
    """With some hotels moved to another city in the second version."""
    v = _versions(events_warehouse(spark, sf_dir)).withColumn("city", F.coalesce("city", F.lit(UNKNOWN)))
    return merge.cohort_faults(v.withColumn("city", F.when((F.col("label") == "v2") & (F.col("hotel_id") % 13 == 0), "Elsewhere").otherwise(F.col("city"))))


_DEVIATIONS = f"{_OWNERSHIP} SELECT hotel_id, count(*) AS n_deviations FROM s WHERE ownership = 'protocol_deviation' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50"


@query(events_sql(_DEVIATIONS))
def deviations_by_hotel(spark, sf_dir):
    """The feature is a top list of fifty."""
    return _owned(events_warehouse(spark, sf_dir)).filter("ownership_status = 'protocol_deviation'").groupBy("hotel_id").agg(F.count(F.lit(1)).alias("n_deviations")).orderBy(F.desc("n_deviations"), "hotel_id").limit(50)


# --- rejects and integrity

_REJECTS = """e AS (SELECT item_id, source_code, CASE WHEN item_id % 40 = 0 THEN 'bad_lead_time' WHEN item_id % 30 = 0 THEN 'no_link' END AS reason FROM items)"""


def _rejects(w) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    items = w.items.select("item_id", "source_code", "lead_time", "link")
    good, bad = merge.split_rejects(items, "items", "item_id", {"bad_lead_time": F.col("item_id") % 40 == 0, "no_link": F.col("item_id") % 30 == 0})
    obs = w.observations.join(w.items.select("item_id", "source_code"), "item_id").select("record_id", "item_id", "source_code")
    kept, lost = merge.cascade(obs, "observations", "record_id", "item_id", bad)
    return good, bad, kept, lost


@query(events_sql(f"{_REJECTS} SELECT source_code, 'items' AS table_name, reason, count(*) AS n FROM e WHERE reason IS NOT NULL GROUP BY ALL UNION ALL SELECT source_code, 'observations', 'parent_rejected', count(*) FROM e WHERE reason IS NOT NULL GROUP BY 1"))
def rejects_by_reason(spark, sf_dir):
    _, bad, _, lost = _rejects(events_warehouse(spark, sf_dir))
    return bad.unionByName(lost).groupBy("source_code", "table_name", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(events_sql(f"{_REJECTS}, t AS (SELECT source_code, count(*) AS n, count(reason) AS bad FROM e GROUP BY 1) SELECT source_code, 'items' AS table_name, n AS n_source, n - bad AS n_imported, bad AS n_row_error, 0 AS n_parent_rejected, true AS ok FROM t UNION ALL SELECT source_code, 'observations', n, n - bad, 0, bad, true FROM t"))
def import_reconciliation(spark, sf_dir):
    w = events_warehouse(spark, sf_dir)
    good, bad, kept, lost = _rejects(w)
    tagged = lambda df, name: df.select("source_code", F.lit(name).alias("table_name"))
    source = tagged(w.items, "items").unionByName(tagged(w.items, "observations"))
    return merge.reconcile(source, tagged(good, "items").unionByName(tagged(kept, "observations")), bad.unionByName(lost))


def _integrity(spark, sf_dir) -> DataFrame:
    """The warehouse with a fault of each kind put in, by id, and its maps from the sources."""
    e, o = events_warehouse(spark, sf_dir), orders_warehouse(spark, sf_dir)
    i, r = F.col("item_id"), F.col("record_id")
    items = e.items.withColumn("status", F.when(i % 501 == 0, "queued").otherwise(F.col("status"))).withColumn("reference_status", F.when(i % 640 == 0, "exact").otherwise("calibrating"))
    obs = e.observations.filter("record_id % 811 <> 3").join(e.items.select("item_id", "run_id"), "item_id").withColumn("run_id", F.when(r % 433 == 0, F.concat(F.lit("z"), "run_id")).otherwise(F.col("run_id"))).withColumn("is_reference_room", r % 547 == 0)
    runs = e.runs.withColumn("status", F.when((F.dayofmonth("crawl_date") == 5) & (F.col("source_code") == "a"), "running").otherwise(F.col("status")))
    run_map = e.runs.filter("dayofmonth(crawl_date) <> 9 or source_code = 'b'").select("run_id", "source_code", (F.dayofmonth("crawl_date") != 11).alias("include_main"))
    item_map = e.items.filter("item_id % 379 <> 2").select("item_id", "run_id", F.when(i % 283 == 4, "x").otherwise(F.col("source_code")).alias("source_code"), "include_raw", "include_main", "include_reference", F.when(i % 1000 == 26, "unassigned").otherwise(F.col("ownership_status")).alias("ownership_status"), "exclusion_reason", F.when(i % 613 != 5, "slot").alias("schedule_slot"))
    obs_map = e.observations.filter("record_id % 457 <> 6").select("record_id", F.when(r % 700 == 8, "ABC").otherwise(F.sha2(r.cast("string"), 256)).alias("source_record_sha256"))
    mapped = item_map.join(run_map.select("run_id", F.col("source_code").alias("run_source"), F.col("include_main").alias("run_main")), "run_id")
    refs = e.hotels.select("hotel_id", F.lit("approved").alias("status")).unionByName(e.hotels.filter("hotel_id % 8 = 0").select("hotel_id", F.lit("approved").alias("status")))
    return merge.checks({
        "items_without_run": merge.orphans(items, runs.filter("dayofmonth(crawl_date) <> 3"), "run_id"),
        "orphan_observations": merge.orphans(o.observations, o.items.filter("item_id % 100 <> 1"), "item_id"),
        "duplicate_item_option": merge.repeated(o.observations, "item_id", "option_index"),
        "observation_of_other_run": obs.join(items.select("item_id", F.col("run_id").alias("_run")), "item_id").filter("run_id <> _run"),
        "run_without_map": merge.orphans(runs, run_map, "run_id"),
        "item_without_map": merge.orphans(items, item_map, "item_id"),
        "observation_without_map": merge.orphans(obs, obs_map, "record_id"),
        "bad_fingerprint_format": obs_map.filter(~F.col("source_record_sha256").rlike("^[0-9a-f]{64}$")),
        "item_map_of_other_source": mapped.filter("source_code <> run_source"),
        "child_flag_above_parent": mapped.filter("include_main and not run_main"),
        "unassigned_with_flags": item_map.filter("ownership_status = 'unassigned' and (include_main or include_reference or exclusion_reason is null)"),
        "resolved_without_slot": item_map.filter("ownership_status <> 'unassigned' and schedule_slot is null"),
        "unfinished_runs": runs.filter(F.col("status").isin("queued", "running")),
        "unfinished_items_of_finished_runs": items.filter(F.col("status").isin("queued", "running")).join(runs.filter("status = 'completed'").select("run_id"), "run_id"),
        "success_without_hotel": items.filter("status = 'success' and hotel_id is null"),
        "success_without_observation": items.filter("status = 'success'").join(obs, "item_id", "left_anti"),
        "observation_reference_not_reset": obs.filter("is_reference_room"),
        "item_reference_not_reset": items.filter("reference_status <> 'calibrating'"),
        "series_with_many_approved": merge.repeated(refs.filter("status = 'approved'"), "hotel_id"),
        "city_outside_scope": e.hotels.filter(F.col("city").isNotNull() & ~F.col("city").isin("Hanoi", "Da Nang", "Hoi An", "Nha Trang")),
    })


_CHECKS = """it AS (SELECT * REPLACE (CASE WHEN item_id % 501 = 0 THEN 'queued' ELSE status END AS status) FROM items), ob AS (SELECT * FROM observations WHERE record_id % 811 <> 3),
    im AS (SELECT * REPLACE (CASE WHEN item_id % 283 = 4 THEN 'x' ELSE source_code END AS source_code, CASE WHEN item_id % 1000 = 26 THEN 'unassigned' ELSE ownership_status END AS ownership_status) FROM items WHERE item_id % 379 <> 2),
    rm AS (SELECT * FROM runs WHERE day(crawl_date) <> 9 OR source_code = 'b'), rs AS (SELECT * REPLACE (CASE WHEN day(crawl_date) = 5 AND source_code = 'a' THEN 'running' ELSE status END AS status) FROM runs),
    k(check_name, n_violations) AS (SELECT 'items_without_run', (SELECT count(*) FROM items WHERE day(crawl_date) = 3) UNION ALL SELECT 'orphan_observations', (SELECT count(*) FROM lineitem WHERE l_orderkey % 100 = 1)
    UNION ALL SELECT 'duplicate_item_option', (SELECT count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)) UNION ALL SELECT 'observation_of_other_run', (SELECT count(*) FROM ob WHERE record_id % 433 = 0)
    UNION ALL SELECT 'run_without_map', (SELECT count(*) FROM runs WHERE run_id NOT IN (SELECT run_id FROM rm)) UNION ALL SELECT 'item_without_map', (SELECT count(*) FROM items WHERE item_id % 379 = 2) UNION ALL SELECT 'observation_without_map', (SELECT count(*) FROM ob WHERE record_id % 457 = 6)
    UNION ALL SELECT 'bad_fingerprint_format', (SELECT count(*) FROM observations WHERE record_id % 457 <> 6 AND record_id % 700 = 8) UNION ALL SELECT 'item_map_of_other_source', (SELECT count(*) FROM im JOIN rm USING (run_id) WHERE im.source_code <> rm.source_code)
    UNION ALL SELECT 'child_flag_above_parent', (SELECT count(*) FROM im JOIN rm USING (run_id) WHERE include_main AND day(rm.crawl_date) = 11) UNION ALL SELECT 'unassigned_with_flags', (SELECT count(*) FROM im WHERE ownership_status = 'unassigned' AND (include_main OR include_reference OR exclusion_reason IS NULL))
    UNION ALL SELECT 'resolved_without_slot', (SELECT count(*) FROM im WHERE ownership_status <> 'unassigned' AND item_id % 613 = 5) UNION ALL SELECT 'unfinished_runs', (SELECT count(*) FROM rs WHERE status = 'running') UNION ALL SELECT 'unfinished_items_of_finished_runs', (SELECT count(*) FROM it JOIN rs USING (run_id) WHERE it.status = 'queued' AND rs.status = 'completed')
    UNION ALL SELECT 'success_without_hotel', (SELECT count(*) FROM it WHERE status = 'success' AND hotel_id IS NULL) UNION ALL SELECT 'success_without_observation', (SELECT count(*) FROM it WHERE status = 'success' AND item_id % 811 = 3)
    UNION ALL SELECT 'observation_reference_not_reset', (SELECT count(*) FROM ob WHERE record_id % 547 = 0) UNION ALL SELECT 'item_reference_not_reset', (SELECT count(*) FROM items WHERE item_id % 640 = 0)
    UNION ALL SELECT 'series_with_many_approved', (SELECT count(*) FROM hotels WHERE hotel_id % 8 = 0) UNION ALL SELECT 'city_outside_scope', (SELECT count(*) FROM hotels WHERE city = 'Da Lat'))"""


@query(events_sql(f"{_CHECKS} SELECT check_name, n_violations, n_violations = 0 AS ok FROM k"))
def integrity_checks(spark, sf_dir):
    return _integrity(spark, sf_dir)


@query(events_sql(f"{_CHECKS} SELECT bool_and(n_violations = 0) AS passed, count(*) AS n_checks, count(*) FILTER (n_violations > 0) AS n_failed FROM k"))
def batch_gate(spark, sf_dir):
    return merge.gate(_integrity(spark, sf_dir))


@query(events_sql("SELECT item_id FROM items WHERE item_id % 777 = 0"))
def timestamp_audit(spark, sf_dir):
    """With some merged timestamps moved by a second."""
    items = events_warehouse(spark, sf_dir).items.select("item_id", "finished_at")
    moved = items.withColumn("finished_at", F.when(F.col("item_id") % 777 == 0, F.col("finished_at") + F.expr("INTERVAL 1 SECOND")).otherwise(F.col("finished_at")))
    return merge.timestamp_audit(items, moved, "item_id", ["finished_at"])


@query(events_sql("""v AS (SELECT DISTINCT 'd' || (user_id % 8) AS dataset_version, CASE WHEN user_id % 8 = 5 THEN 'fail' ELSE 'pass' END AS status FROM events), n AS (SELECT 'd' || (user_id % 8) AS dataset_version, count(*) FILTER (event_type = 'purchase' AND user_id % 8 <> 2) AS a, count(*) FILTER (event_type = 'view') AS b, count(*) AS c FROM events GROUP BY 1)
    SELECT dataset_version, status, a AS n_reference_assignments, b AS n_item_matches, c AS n_samples, status = 'pass' AND a > 0 AND b > 0 AND c > 0 AS ready FROM v JOIN n USING (dataset_version)"""))
def wave_b_dataset_version_readiness(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_type", "user_id", F.concat(F.lit("d"), (F.col("user_id") % 8).cast("string")).alias("dataset_version"))
    versions = e.select("dataset_version", F.when(F.col("user_id") % 8 == 5, "fail").otherwise("pass").alias("status")).distinct()
    return merge.readiness(versions, n_reference_assignments=e.filter("event_type = 'purchase' and user_id % 8 <> 2"), n_item_matches=e.filter("event_type = 'view'"), n_samples=e)


@query(events_sql("SELECT run_id, count(*) AS n_total, count(*) AS n_processed, count(*) FILTER (s = 'success') AS n_success, count(*) FILTER (s = 'partial') AS n_partial, count(*) FILTER (s = 'sold_out') AS n_sold_out, count(*) FILTER (s = 'not_bookable') AS n_not_bookable, count(*) FILTER (s = 'error') AS n_error, true AS complete FROM (SELECT run_id, CASE WHEN status = 'partial' AND item_id % 2 = 0 THEN 'success' ELSE status END AS s FROM items) GROUP BY 1"))
def run_counters_after_backfill(spark, sf_dir):
    """Partial items that lack nothing but a reference become successes, then runs are counted anew."""
    items = events_warehouse(spark, sf_dir).items
    fixed = items.withColumn("status", F.when((F.col("status") == "partial") & (F.col("item_id") % 2 == 0), "success").otherwise(F.col("status")))
    return merge.run_counters(fixed)


# --- references, over years of stay and coarse keys, so that series have evidence

_YEARS = """y AS (SELECT o.* REPLACE (date_trunc('year', o.checkin_date)::date AS checkin_date, split_part(room_key, '/', 1) AS room_key, split_part(rate_key, '/', 2) AS rate_key), i.include_main, i.include_reference FROM observations o JOIN items i USING (item_id)),
    f AS (SELECT * FROM y WHERE include_reference AND NOT is_sold_out AND price_per_night IS NOT NULL AND room_key IS NOT NULL),
    el AS (SELECT hotel_id, checkin_date, count(DISTINCT item_id) AS eligible_items FROM f GROUP BY 1, 2),
    cand AS (SELECT hotel_id, checkin_date, room_key, rate_key, max(max_occupancy) AS max_occupancy, count(*) AS observation_count, count(DISTINCT run_id) AS distinct_run_count, count(DISTINCT item_id) AS distinct_item_count, min(crawl_date) AS first_seen, max(crawl_date) AS last_seen, any_value(eligible_items) AS eligible_items,
             round(least(1.0, count(DISTINCT item_id)::double / any_value(eligible_items)), 6) AS item_coverage FROM f JOIN el USING (hotel_id, checkin_date) GROUP BY 1, 2, 3, 4),
    refs AS (SELECT * EXCLUDE (k), CASE WHEN distinct_run_count >= 3 AND item_coverage >= 0.3 AND observation_count = distinct_item_count THEN 'approved' ELSE 'proposed' END AS status, round(item_coverage * CASE WHEN observation_count = distinct_item_count THEN 1.0 ELSE 0.6 END, 6) AS confidence
             FROM (SELECT *, row_number() OVER (PARTITION BY hotel_id, checkin_date ORDER BY (observation_count = distinct_item_count) DESC, item_coverage DESC, distinct_run_count DESC, (max_occupancy <= 2) DESC, observation_count DESC, room_key, rate_key) AS k FROM cand) WHERE k = 1)"""
LEAST = {"least_runs": 3, "least_coverage": 0.3}


def _years(spark, sf_dir) -> tuple:
    w = orders_warehouse(spark, sf_dir)
    obs = w.observations.withColumn("checkin_date", F.trunc("checkin_date", "year")).withColumn("room_key", F.substring_index("room_key", "/", 1)).withColumn("rate_key", F.substring_index("rate_key", "/", -1)).join(w.items.select("item_id", "include_main", "include_reference"), "item_id")
    return w, obs, reference.evidence(obs)


@query(orders_sql(f"{_YEARS} SELECT * FROM cand"))
def reference_candidates(spark, sf_dir):
    return reference.candidates(_years(spark, sf_dir)[2])


@query(orders_sql(f"{_YEARS} SELECT * FROM refs"))
def references_built(spark, sf_dir):
    return reference.build(_years(spark, sf_dir)[2], **LEAST)


def _matched(name: str, flag: str, spark, sf_dir) -> DataFrame:
    _, obs, found = _years(spark, sf_dir)
    marked, _ = reference.apply_approval(obs.filter(flag), reference.build(found, **LEAST))
    return marked


_REF = "a AS (SELECT hotel_id, checkin_date, room_key, rate_key FROM refs WHERE status = 'approved'), m AS (SELECT y.*, a.hotel_id IS NOT NULL AS hit FROM y LEFT JOIN a USING (hotel_id, checkin_date, room_key, rate_key){0})"


@query(orders_sql(f"{_YEARS}, {_REF.format(' WHERE include_main')} SELECT {BUCKET} AS lead_time_bucket, count(*) AS n_observations, count(*) FILTER (hit) AS n_matched FROM m GROUP BY 1"))
def reference_observation_match_main(spark, sf_dir):
    return _matched("m", "include_main", spark, sf_dir).groupBy(bucket("lead_time").alias("lead_time_bucket")).agg(F.count(F.lit(1)).alias("n_observations"), F.count_if("is_reference").alias("n_matched"))


@query(orders_sql(f"{_YEARS}, {_REF.format('')} SELECT {BUCKET} AS lead_time_bucket, count(*) AS n_observations, count(*) FILTER (hit) AS n_matched FROM m GROUP BY 1"))
def reference_observation_match_raw(spark, sf_dir):
    return _matched("m", "true", spark, sf_dir).groupBy(bucket("lead_time").alias("lead_time_bucket")).agg(F.count(F.lit(1)).alias("n_observations"), F.count_if("is_reference").alias("n_matched"))


def _series_exists(spark, sf_dir, buckets) -> DataFrame:
    from ..functions.timeaxis import BUCKETS

    _, obs, found = _years(spark, sf_dir)
    has = reference.build(found, **LEAST).filter("status = 'approved'").select("hotel_id", "checkin_date", F.lit(True).alias("has")).distinct()
    return obs.join(has, ["hotel_id", "checkin_date"], "left").groupBy(bucket("lead_time", buckets or BUCKETS).alias("lead_time_bucket")).agg(F.count(F.lit(1)).alias("n_observations"), F.count("has").alias("n_series_has_reference"))


_EXISTS = "a AS (SELECT DISTINCT hotel_id, checkin_date FROM refs WHERE status = 'approved') SELECT {0} AS lead_time_bucket, count(*) AS n_observations, count(*) FILTER (a.hotel_id IS NOT NULL) AS n_series_has_reference FROM y LEFT JOIN a USING (hotel_id, checkin_date) GROUP BY 1"


@query(orders_sql(f"{_YEARS}, {_EXISTS.format(BUCKET)}"))
def reference_series_exists_observation_coverage_raw(spark, sf_dir):
    return _series_exists(spark, sf_dir, None)


@query(orders_sql(f"{_YEARS}, {_EXISTS.format(LEGACY_BUCKET)}"))
def reference_series_exists_observation_coverage_raw_legacy_bucket(spark, sf_dir):
    from ..functions.timeaxis import LEGACY_BUCKETS

    return _series_exists(spark, sf_dir, LEGACY_BUCKETS)


@query(orders_sql(f"{_YEARS}, {_REF.format(' WHERE include_main')}, p AS (SELECT item_id, min(lead_time) AS lead_time, bool_or(hit) AS hit FROM m WHERE item_status = 'success' GROUP BY 1) SELECT {BUCKET} AS lead_time_bucket, count(*) AS n_items, count(*) FILTER (hit) AS n_items_matched FROM p GROUP BY 1"))
def reference_item_level_availability_main(spark, sf_dir):
    per = _matched("m", "include_main", spark, sf_dir).filter("item_status = 'success'").groupBy("item_id").agg(F.min("lead_time").alias("lead_time"), F.max("is_reference").alias("hit"))
    return per.groupBy(bucket("lead_time").alias("lead_time_bucket")).agg(F.count(F.lit(1)).alias("n_items"), F.count_if("hit").alias("n_items_matched"))


@query(orders_sql(f"{_YEARS} SELECT city, strftime(checkin_date, '%Y-%m') AS checkin_month, count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (status = 'proposed') AS proposed, count(*) AS n, round(count(*) FILTER (status = 'approved')::double / count(*), 6) AS approval_rate FROM refs JOIN hotels USING (hotel_id) GROUP BY 1, 2"))
def reference_approval_by_city_month(spark, sf_dir):
    w, _, found = _years(spark, sf_dir)
    rows = reference.build(found, **LEAST).join(w.hotels.select("hotel_id", "city"), "hotel_id")
    out = rows.groupBy("city", F.date_format("checkin_date", "yyyy-MM").alias("checkin_month")).agg(F.count_if(F.col("status") == "approved").alias("approved"), F.count_if(F.col("status") == "proposed").alias("proposed"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("approval_rate", r6(F.col("approved") / F.col("n")))


_SPREAD = [("runs", "distinct_run_count"), ("items", "distinct_item_count"), ("coverage", "item_coverage")]


@query(orders_sql(f"{_YEARS} SELECT status, count(*) AS n_references, count(DISTINCT (hotel_id, checkin_date)) AS n_series, " + ", ".join(f"min({c}) AS min_{n}, round(avg({c}), 6) AS mean_{n}, max({c}) AS max_{n}" for n, c in _SPREAD) + ", count(*) FILTER (distinct_run_count >= 3) AS n_with_ge3_runs, count(*) FILTER (item_coverage >= 0.8) AS n_with_coverage_ge_080 FROM refs GROUP BY 1"))
def reference_status_evidence_summary(spark, sf_dir):
    spread = [x for n, c in _SPREAD for x in (F.min(c).alias(f"min_{n}"), r6(F.avg(c)).alias(f"mean_{n}"), F.max(c).alias(f"max_{n}"))]
    return reference.build(_years(spark, sf_dir)[2], **LEAST).groupBy("status").agg(F.count(F.lit(1)).alias("n_references"), F.countDistinct("hotel_id", "checkin_date").alias("n_series"), *spread, F.count_if(F.col("distinct_run_count") >= 3).alias("n_with_ge3_runs"), F.count_if(F.col("item_coverage") >= 0.8).alias("n_with_coverage_ge_080"))


@query(orders_sql(f"{_YEARS}, s AS (SELECT hotel_id, checkin_date, count(*) FILTER (status = 'approved') AS n_approved FROM refs GROUP BY 1, 2) SELECT n_approved, count(*) AS n_series FROM s GROUP BY 1"))
def reference_uniqueness_per_series(spark, sf_dir):
    per = reference.build(_years(spark, sf_dir)[2], **LEAST).groupBy("hotel_id", "checkin_date").agg(F.count_if(F.col("status") == "approved").alias("n_approved"))
    return per.groupBy("n_approved").agg(F.count(F.lit(1)).alias("n_series"))


@query(orders_sql(f"""{_YEARS}, s AS (SELECT count(*) AS c FROM cand GROUP BY hotel_id, checkin_date) SELECT count(*) AS n_candidates, (SELECT count(*) FROM s) AS n_series_with_candidates, (SELECT round(avg(c), 6) FROM s) AS mean_candidates_per_series, (SELECT max(c) FROM s) AS max_candidates_per_series, round(avg(distinct_run_count), 6) AS mean_distinct_run_count, max(distinct_run_count) AS max_distinct_run_count, round(avg(distinct_item_count), 6) AS mean_distinct_item_count, round(avg(item_coverage), 6) AS mean_item_coverage,
    count(*) FILTER (distinct_run_count >= 3) AS n_candidates_ge3_runs, count(*) FILTER (item_coverage >= 0.8) AS n_candidates_coverage_ge_080 FROM cand"""))
def reference_candidate_coverage_summary(spark, sf_dir):
    sums = [("r", "distinct_run_count"), ("i", "distinct_item_count"), ("v", "item_coverage")]
    per = reference.candidates(_years(spark, sf_dir)[2]).groupBy("hotel_id", "checkin_date").agg(F.count(F.lit(1)).alias("c"), *[F.sum(x).alias(n) for n, x in sums], F.max("distinct_run_count").alias("m"), F.count_if(F.col("distinct_run_count") >= 3).alias("g"), F.count_if(F.col("item_coverage") >= 0.8).alias("h"))
    mean = lambda n: r6(F.sum(n) / F.sum("c"))
    return per.agg(F.sum("c").alias("n_candidates"), F.count(F.lit(1)).alias("n_series_with_candidates"), r6(F.avg("c")).alias("mean_candidates_per_series"), F.max("c").alias("max_candidates_per_series"), mean("r").alias("mean_distinct_run_count"), F.max("m").alias("max_distinct_run_count"), mean("i").alias("mean_distinct_item_count"), mean("v").alias("mean_item_coverage"), F.sum("g").alias("n_candidates_ge3_runs"), F.sum("h").alias("n_candidates_coverage_ge_080"))


@query(orders_sql(f"{_YEARS}, s AS (SELECT city, hotel_id, checkin_date, count(DISTINCT run_id) AS n FROM f GROUP BY 1, 2, 3) SELECT city, CASE WHEN n = 1 THEN '1' WHEN n = 2 THEN '2' ELSE '3+' END AS evidence_runs_bucket, count(*) AS n_series FROM s GROUP BY 1, 2"))
def series_evidence_runs_distribution(spark, sf_dir):
    per = _years(spark, sf_dir)[2].groupBy("city", "hotel_id", "checkin_date").agg(F.countDistinct("run_id").alias("n"))
    return per.groupBy("city", F.when(F.col("n") == 1, "1").when(F.col("n") == 2, "2").otherwise("3+").alias("evidence_runs_bucket")).agg(F.count(F.lit(1)).alias("n_series"))


@query(orders_sql(f"{_YEARS}, s AS (SELECT DISTINCT hotel_id, checkin_date FROM y WHERE NOT is_sold_out) SELECT count(*) AS n_series, count(a.hotel_id) AS n_ready, round(count(a.hotel_id)::double / count(*), 6) AS ready_ratio FROM s LEFT JOIN (SELECT DISTINCT hotel_id, checkin_date FROM refs WHERE status = 'approved') a USING (hotel_id, checkin_date)"))
def reference_ready_ratio(spark, sf_dir):
    _, obs, found = _years(spark, sf_dir)
    has = reference.build(found, **LEAST).filter("status = 'approved'").select("hotel_id", "checkin_date", F.lit(1).alias("has")).distinct()
    series = obs.filter("not is_sold_out").select("hotel_id", "checkin_date").distinct().join(has, ["hotel_id", "checkin_date"], "left")
    return series.agg(F.count(F.lit(1)).alias("n_series"), F.count("has").alias("n_ready"), r6(F.count("has") / F.count(F.lit(1))).alias("ready_ratio"))


_RUN = "'EUROPE|1997-06-01'"


@query(orders_sql(f"{_YEARS}, o AS (SELECT * FROM refs WHERE hotel_id % 3 = 0) SELECT hotel_id, checkin_date, status FROM refs UNION ALL SELECT hotel_id, checkin_date, 'retired' FROM o"))
def references_recalibrated(spark, sf_dir):
    found = _years(spark, sf_dir)[2]
    old = reference.build(found, **LEAST).filter("hotel_id % 3 = 0")
    return reference.recalibrate(old, found, **LEAST).select("hotel_id", "checkin_date", "status")


@query(orders_sql(f"""{_YEARS}, old AS (SELECT * FROM refs WHERE hotel_id % 3 = 0), t AS (SELECT DISTINCT f.hotel_id, f.checkin_date FROM f LEFT JOIN (SELECT * FROM old WHERE status = 'approved') o USING (hotel_id, checkin_date) WHERE source_code || '|' || date_part('year', crawl_date) = 'REGION_0|1997' AND o.hotel_id IS NULL)
    SELECT hotel_id, checkin_date, status FROM old WHERE (hotel_id, checkin_date) NOT IN (SELECT (hotel_id, checkin_date) FROM t) UNION ALL SELECT hotel_id, checkin_date, status FROM refs JOIN t USING (hotel_id, checkin_date)"""))
def references_refreshed_after_run(spark, sf_dir):
    """A run is a region's year here."""
    found = _years(spark, sf_dir)[2]
    old = reference.build(found, **LEAST).filter("hotel_id % 3 = 0")
    run = F.concat_ws("|", "source_code", F.year("crawl_date").cast("string"))
    return reference.refresh(old, found, run == "REGION_0|1997", **LEAST).select("hotel_id", "checkin_date", "status")


@query(orders_sql(f"{_YEARS} SELECT hotel_id, checkin_date, 2::bigint AS n_approved FROM refs WHERE status = 'approved' AND hotel_id % 5 = 0"))
def series_with_many_approved(spark, sf_dir):
    """Some approved references are stored twice."""
    refs = reference.build(_years(spark, sf_dir)[2], **LEAST)
    return reference.many_approved(refs.unionByName(refs.filter("hotel_id % 5 = 0")))


_CAUSAL = """i AS (SELECT hotel_id, checkin_date, room_key, rate_key, item_id, min(crawl_date) AS day, count(*) AS n, min(run_id) AS run_id FROM f GROUP BY 1, 2, 3, 4, 5),
    d AS (SELECT DISTINCT hotel_id, checkin_date, room_key, rate_key, day FROM i),
    e AS (SELECT d.*, count(*) AS items, sum(n) AS obs, count(DISTINCT run_id) AS runs FROM d JOIN i USING (hotel_id, checkin_date, room_key, rate_key) WHERE i.day <= d.day GROUP BY ALL),
    si AS (SELECT hotel_id, checkin_date, item_id, min(crawl_date) AS day FROM f GROUP BY 1, 2, 3),
    r AS (SELECT e.*, least(1.0, items::double / (SELECT count(*) FROM si WHERE si.hotel_id = e.hotel_id AND si.checkin_date = e.checkin_date AND si.day <= e.day)) AS coverage FROM e),
    ca AS (SELECT hotel_id, checkin_date, room_key, rate_key, approved_on, runs, items, round(coverage, 6) AS coverage FROM (SELECT *, day AS approved_on, row_number() OVER (PARTITION BY hotel_id, checkin_date ORDER BY day, coverage DESC, runs DESC, room_key, rate_key) AS k FROM r WHERE runs >= 3 AND coverage >= 0.3 AND obs = items) WHERE k = 1)"""


@query(orders_sql(f"{_YEARS}, {_CAUSAL} SELECT * FROM ca"))
def causal_reference_assignment(spark, sf_dir):
    return reference.causal_assignment(_years(spark, sf_dir)[2], **LEAST)


_WORDS = "list_distinct(string_split(trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g')), ' '))"
_SCORED = f"""{_CAUSAL}, asg AS (SELECT ca.hotel_id, ca.checkin_date, ca.room_key AS ref_room_key, ca.rate_key AS ref_rate_key, approved_on, min(room_name) AS ref_room_name, max(max_occupancy) AS ref_max_occupancy, min(room_area) AS ref_room_area FROM ca JOIN f USING (hotel_id, checkin_date, room_key, rate_key) GROUP BY ALL),
    ow AS (SELECT y.item_id, y.option_index, y.hotel_id, y.checkin_date, rate_key = ref_rate_key AS same_rate, room_key = ref_room_key AS same_room, {_WORDS.format('room_name')} AS a, {_WORDS.format('ref_room_name')} AS b, max_occupancy = ref_max_occupancy AS occ, room_area = ref_room_area AS area FROM y JOIN asg USING (hotel_id, checkin_date) WHERE y.crawl_date >= approved_on),
    os AS (SELECT *, 0.65 * len(list_intersect(a, b))::double / len(list_distinct(list_concat(a, b))) + 0.15 * occ::int + 0.1 * area::int + 0.1 * same_rate::int AS s FROM ow),
    sc AS (SELECT item_id, option_index, hotel_id, checkin_date, CASE WHEN same_rate AND same_room THEN 'exact' WHEN same_rate AND s >= 0.8 - 1e-12 THEN 'alias' ELSE 'not_reference' END AS match, CASE WHEN same_rate AND same_room THEN 1.0 ELSE round(s, 4) END AS score FROM os)"""


def _assigned(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """All observations, and the assigned references with what they are called in their evidence."""
    _, obs, found = _years(spark, sf_dir)
    first = reference.causal_assignment(found, **LEAST)
    told = found.join(first.select(*reference.CANDIDATE, "approved_on"), reference.CANDIDATE).groupBy(*reference.CANDIDATE, "approved_on").agg(F.min("room_name").alias("room_name"), F.max("max_occupancy").alias("max_occupancy"), F.min("room_area").alias("room_area"))
    return obs, told.select(*reference.SERIES, "approved_on", *[F.col(c).alias(f"ref_{c}") for c in ("room_key", "rate_key", "room_name", "max_occupancy", "room_area")])


@query(orders_sql(f"{_YEARS}, {_SCORED} SELECT item_id, option_index, hotel_id, checkin_date, match, round(score, 3) AS score FROM sc"))
def option_match_scores(spark, sf_dir):
    obs, assigned = _assigned(spark, sf_dir)
    rows = obs.join(assigned, reference.SERIES).filter(F.col("crawl_date") >= F.col("approved_on")).withColumn("m", reference.match_score())
    return rows.select("item_id", "option_index", "hotel_id", "checkin_date", "m.match", F.round("m.score", 3).alias("score"))


@query(orders_sql(f"""{_YEARS}, {_SCORED}, tp AS (SELECT item_id, hotel_id, checkin_date, max(score) FILTER (match <> 'not_reference') AS top FROM sc GROUP BY 1, 2, 3), b AS (SELECT item_id, hotel_id, checkin_date, any_value(top) AS top, count(*) FILTER (match <> 'not_reference' AND score = top) AS n, max(match) FILTER (match <> 'not_reference' AND score = top) AS match, max(option_index) FILTER (match <> 'not_reference' AND score = top) AS option_index FROM sc JOIN tp USING (item_id, hotel_id, checkin_date) GROUP BY 1, 2, 3)
    SELECT item_id, hotel_id, checkin_date, CASE WHEN n = 0 THEN 'unavailable' WHEN n > 1 THEN 'ambiguous' ELSE match END AS match_status, round(coalesce(top, 0), 3) AS score, CASE WHEN n = 1 THEN option_index END AS option_index FROM b"""))
def item_reference_matches(spark, sf_dir):
    obs, assigned = _assigned(spark, sf_dir)
    return reference.item_matches(obs, assigned).select("item_id", "hotel_id", "checkin_date", "match_status", F.round("score", 3).alias("score"), "option_index")


# --- anomaly signals

_SCOPE = "v AS (SELECT * FROM observations WHERE item_status = 'success' AND NOT is_sold_out AND price_per_night > 0), r AS (SELECT item_id, room_key, quantile_cont(price_per_night, 0.5) AS rep FROM v GROUP BY 1, 2)"


def _scope(spark, sf_dir) -> DataFrame:
    return anomaly.in_scope(orders_warehouse(spark, sf_dir).observations)


@query(events_sql("SELECT record_id, CASE WHEN price_per_night < 2 THEN 'high' ELSE 'notable' END AS severity FROM observations JOIN items USING (item_id) WHERE status = 'success' AND NOT is_sold_out AND price_per_night > 0 AND price_per_night < 5"))
def low_price_outliers(spark, sf_dir):
    """The events' prices are in another currency, so the thresholds are too."""
    w = events_warehouse(spark, sf_dir)
    obs = w.observations.join(w.items.select("item_id", F.col("status").alias("item_status")), "item_id")
    return anomaly.low_price(anomaly.in_scope(obs), high=2, notable=5).select("record_id", "severity")


@query(orders_sql(f"{_SCOPE} SELECT item_id, room_key, round(rep, 6) AS rep_price FROM r"))
def representative_prices(spark, sf_dir):
    return anomaly.representatives(_scope(spark, sf_dir)).select("item_id", "room_key", r6("rep_price").alias("rep_price"))


@query(orders_sql(f"{_SCOPE}, c AS (SELECT a.item_id, a.room_key, count(*) AS n, quantile_cont(b.rep, 0.5) AS med FROM r a JOIN r b ON a.item_id = b.item_id AND a.room_key <> b.room_key GROUP BY 1, 2 HAVING count(*) >= 2) SELECT item_id, option_index, room_key, round(price_per_night, 6) AS price, n::int AS context_room_count, round(med, 6) AS context_median FROM v JOIN c USING (item_id, room_key) WHERE price_per_night >= 1.5 * med"))
def context_level_high(spark, sf_dir):
    """At half above the other rooms, as the orders' prices lie close together."""
    obs = _scope(spark, sf_dir)
    return anomaly.context_high(obs, ratio=1.5).select("item_id", "option_index", "room_key", r6("price_per_night").alias("price"), "context_room_count", r6("context_median").alias("context_median"))


_TEMPORAL = "e AS (SELECT i.item_id, i.crawl_date, i.finished_at, o.hotel_id, room_key, price_per_night AS rep_price FROM items i JOIN observations o USING (item_id) WHERE status = 'success' AND price_per_night > 0)"


def _event_reps(spark, sf_dir) -> DataFrame:
    w = events_warehouse(spark, sf_dir)
    return w.items.filter("status = 'success'").select("item_id", "crawl_date", "finished_at").join(w.observations.select("item_id", F.col("hotel_id"), "room_key", F.col("price_per_night").alias("rep_price")), "item_id").filter("rep_price > 0")


@query(events_sql(f"{_TEMPORAL}, p AS (SELECT a.item_id, a.rep_price, count(*) AS prior_items, count(DISTINCT b.crawl_date) AS prior_dates, quantile_cont(b.rep_price, 0.5) AS med FROM e a JOIN e b ON a.hotel_id = b.hotel_id AND a.room_key = b.room_key AND (b.finished_at, b.item_id) < (a.finished_at, a.item_id) GROUP BY 1, 2) SELECT item_id, round(rep_price, 6) AS rep_price, prior_items, prior_dates, round(med, 6) AS prior_median FROM p WHERE prior_items >= 5 AND prior_dates >= 3 AND rep_price >= 3 * med"))
def temporal_level_shift(spark, sf_dir):
    out = anomaly.temporal_shift(_event_reps(spark, sf_dir), ["hotel_id", "room_key"], ["finished_at", "item_id"], "crawl_date", ratio=3.0)
    return out.select("item_id", r6("rep_price").alias("rep_price"), "prior_items", "prior_dates", r6("prior_median").alias("prior_median"))


_WIDE = """d AS (SELECT hotel_id, crawl_date, (hotel_id * 100000 + datediff('day', DATE '2020-01-01', crawl_date)) AS item_id, room_key || rate_key AS room_key, quantile_cont(price_per_night, 0.5) AS rep FROM (SELECT * FROM observations WHERE price_per_night > 0) GROUP BY 1, 2, 3, 4),
    i AS (SELECT hotel_id, item_id, crawl_date, count(*) AS n_rooms, row_number() OVER (PARTITION BY hotel_id ORDER BY crawl_date, item_id) AS seq FROM d GROUP BY 1, 2, 3),
    x AS (SELECT d.*, seq, n_rooms FROM d JOIN i USING (hotel_id, item_id)),
    f AS (SELECT a.hotel_id, a.item_id, a.seq - b.seq AS off, b.item_id AS base, count(*) AS n_pairs, count(*)::double / (any_value(a.n_rooms) + any_value(b.n_rooms) - count(*)) AS coverage, quantile_cont(a.rep / b.rep, 0.5) AS fac, stddev_samp(a.rep / b.rep) / avg(a.rep / b.rep) AS spread FROM x a JOIN x b ON a.hotel_id = b.hotel_id AND a.room_key = b.room_key AND a.seq - b.seq BETWEEN 1 AND 3 GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2),
    g AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY off) AS k FROM f WHERE coverage >= 0.2 AND fac >= 1.1 AND spread <= 1.2)
    SELECT hotel_id, item_id, off::int AS "offset", base AS baseline_item_id, n_pairs, round(coverage, 6) AS coverage, round(fac, 6) AS median_factor, round(spread, 6) AS spread, (SELECT count(*) - 1 FROM f WHERE f.item_id = g.item_id) AS n_other_baselines FROM g WHERE k = 1"""


@query(events_sql(_WIDE))
def hotel_wide_level_shift(spark, sf_dir):
    """A hotel's day is an item here, and the gates are wider than in production, so that the events have some."""
    obs = events_warehouse(spark, sf_dir).observations.filter("price_per_night > 0")
    item = F.col("hotel_id") * 100000 + F.date_diff("crawl_date", F.lit("2020-01-01").cast("date"))
    reps = anomaly.representatives(obs.withColumn("item_id", item).withColumn("room_key", F.concat("room_key", "rate_key")), ["hotel_id", "crawl_date"])
    out = anomaly.hotel_wide_shift(reps, ["hotel_id"], ["crawl_date"], pairs=2, coverage=0.2, factor=1.1, dispersion=1.2)
    return out.select("hotel_id", "item_id", "offset", "baseline_item_id", "n_pairs", r6("coverage").alias("coverage"), r6("median_factor").alias("median_factor"), r6("spread").alias("spread"), "n_other_baselines")


@query(events_sql("v AS (SELECT record_id, price_per_night AS p FROM observations WHERE price_per_night > 0) SELECT record_id, 'low' AS code, CASE WHEN p < 5 AND record_id % 2 = 0 THEN 'new' ELSE 'old' END AS severity FROM v WHERE (p < 5 AND record_id % 2 = 0) OR (p < 8 AND record_id % 2 = 1)"))
def signals_reconciled(spark, sf_dir):
    """Stored signals are those below 8; a run over the even records finds those below 5."""
    obs = events_warehouse(spark, sf_dir).observations.filter("price_per_night > 0").select("record_id", "price_per_night", F.lit("low").alias("code"))
    stored = obs.filter("price_per_night < 8").select("record_id", "code", F.lit("old").alias("severity"))
    found = obs.filter("price_per_night < 5 and record_id % 2 = 0").select("record_id", "code", F.lit("new").alias("severity"))
    return anomaly.reconcile_signals(stored, found, obs.filter("record_id % 2 = 0"), ["record_id", "code"])


@query(events_sql("SELECT record_id, hotel_id, round(price_per_night, 6) AS price FROM observations WHERE hotel_id = 8 AND price_per_night BETWEEN 3 AND 20"))
def review_member_preview(spark, sf_dir):
    return anomaly.preview_members(events_warehouse(spark, sf_dir).observations, hotel=8, low=3, high=20).select("record_id", "hotel_id", r6("price_per_night").alias("price"))
