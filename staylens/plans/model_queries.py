"""Queries over monitors, the review log, features, labels, forecasts and simulations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.running import running_median
from ..functions.stats import r6
from ..functions.timeaxis import bucket
from ..operators import catalog, features, models, monitor, review_log
from ..sources import files
from ..sources.bindings import events_warehouse, orders_warehouse
from ..sources.files import shared_path
from .preludes import BUCKET, events_sql, orders_sql
from .registry import query

# --- monitors

# Every tenth day's runs declare an item more; items count their options by id, some wrongly; some links lack a date.
_LINKED = "link || CASE WHEN item_id % 400 = 7 THEN '' ELSE '&checkout=' || cast(checkout_date AS varchar) END"
_PARSED = f"""mi AS (SELECT * REPLACE (CASE WHEN item_id % 900 = 11 THEN NULL ELSE {_LINKED} END AS link, CASE WHEN item_id % 501 = 0 THEN 'queued' ELSE status END AS status), item_id % 5 + 1 AS n_parsed, item_id % 2 AS n_duplicate, item_id % 5 + 1 - item_id % 2 - CASE WHEN item_id % 700 = 3 THEN 1 ELSE 0 END AS n_saved FROM items),
    mr AS (SELECT r.* REPLACE (CASE WHEN r.status = 'partial' AND r.source_code = 'b' THEN 'running' ELSE r.status END AS status), k + CASE WHEN day(crawl_date) % 10 = 0 THEN 1 ELSE 0 END AS n_declared, k AS n_processed FROM runs r JOIN (SELECT run_id, count(*) AS k FROM items GROUP BY 1) USING (run_id))"""
_MONITOR = f"""{_PARSED},
    pi AS (SELECT run_id, count(*) AS n, count(DISTINCT hotel_id) AS h, count(*) FILTER (status = 'error') AS e, count(*) FILTER (status = 'queued') AS q, count(*) FILTER (status IN ('success', 'partial') AND n_parsed <> n_saved + n_duplicate) AS u,
                  count(*) FILTER (status IN ('success', 'partial') AND NOT (contains(link, 'checkin=' || cast(checkin_date AS varchar)) AND contains(link, 'checkout=' || cast(checkout_date AS varchar)))) AS w, count(*) FILTER (checkout_date <> checkin_date + 1) AS c FROM mi GROUP BY 1),
    po AS (SELECT i.run_id, count(*) FILTER (NOT is_sold_out AND o.item_id % 600 = 5) AS np, count(*) FILTER (NOT is_sold_out AND o.item_id % 40 = 9) AS nr, count(*) FILTER (o.item_id % 60 = 0) AS na, count(*) FILTER (NOT is_sold_out AND o.item_id % 600 <> 5 AND (price_per_night < 0.05 OR price_per_night > 400)) AS nx FROM observations o JOIN items i USING (item_id) GROUP BY 1),
    w AS (SELECT r.*, pi.*, np, nr, na, nx, last_value(CASE WHEN status = 'completed' THEN h END IGNORE NULLS) OVER (PARTITION BY source_code ORDER BY crawl_date, r.run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hb FROM mr r JOIN pi USING (run_id) JOIN po USING (run_id)),
    g AS (SELECT run_id, 'run_completed' AS gate, CASE WHEN status = 'running' AND started_at < TIMESTAMP '2024-01-20' - INTERVAL 24 HOUR THEN 'fail' WHEN status <> 'completed' THEN 'warn' ELSE 'ok' END AS result FROM w
    UNION ALL SELECT run_id, 'item_accounting', CASE WHEN n <> n_declared OR n_processed <> n_declared OR q > 0 THEN 'warn' ELSE 'ok' END FROM w UNION ALL SELECT run_id, 'hotel_coverage', CASE WHEN h <> hb THEN 'warn' ELSE 'ok' END FROM w
    UNION ALL SELECT run_id, 'option_reconciliation', CASE WHEN u > 0 THEN 'fail' ELSE 'ok' END FROM w UNION ALL SELECT run_id, 'url_date_invariant', CASE WHEN w > 0 OR c > 0 THEN 'fail' ELSE 'ok' END FROM w
    UNION ALL SELECT run_id, 'error_taxonomy', CASE WHEN source_code = 'b' THEN 'fail' WHEN e > 0 THEN 'warn' ELSE 'ok' END FROM w UNION ALL SELECT run_id, 'missingness', CASE WHEN np > 0 THEN 'fail' WHEN nr > 0 THEN 'warn' ELSE 'ok' END FROM w
    UNION ALL SELECT run_id, 'price_sanity', CASE WHEN nx > 0 THEN 'fail' WHEN na > 0 THEN 'warn' ELSE 'ok' END FROM w UNION ALL SELECT run_id, 'anomaly_registry_integrity', CASE WHEN source_code = 'a' THEN 'warn' ELSE 'ok' END FROM w)"""


def _collected(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs, items and observations with the counts and faults that a collector leaves."""
    w = events_warehouse(spark, sf_dir)
    i = F.col("item_id")
    link = F.when(i % 900 != 11, F.concat("link", F.when(i % 400 == 7, "").otherwise(F.concat(F.lit("&checkout="), F.col("checkout_date").cast("string")))))
    items = w.items.select("*", (i % 5 + 1).alias("n_parsed"), (i % 2).alias("n_duplicate")).withColumn("link", link).withColumn("status", F.when(i % 501 == 0, "queued").otherwise(F.col("status"))).withColumn("n_saved", F.col("n_parsed") - F.col("n_duplicate") - F.when(i % 700 == 3, 1).otherwise(0))
    sizes = w.items.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_processed"))
    runs = w.runs.join(sizes, "run_id").withColumn("n_declared", F.col("n_processed") + F.when(F.dayofmonth("crawl_date") % 10 == 0, 1).otherwise(0)).withColumn("status", F.when((F.col("status") == "partial") & (F.col("source_code") == "b"), "running").otherwise(F.col("status")))
    obs = w.observations.withColumn("price_per_night", F.when(i % 600 != 5, F.col("price_per_night"))).withColumn("room_key", F.when(i % 40 != 9, F.col("room_key"))).withColumn("is_anomaly", i % 60 == 0)
    return runs, items, obs


def _gates(spark, sf_dir) -> DataFrame:
    runs, items, obs = _collected(spark, sf_dir)
    reviews = spark.createDataFrame([("b", 2)], "source_code string, n_review int")
    registry = spark.createDataFrame([("a", False), ("b", True)], "source_code string, registry_ok boolean")
    return monitor.run_monitor(runs, items, obs, reviews, registry, F.lit("2024-01-20").cast("timestamp_ntz"), 0.05, 400)


@query(events_sql(f"{_MONITOR} SELECT * FROM g"))
def run_monitor_gates(spark, sf_dir):
    return _gates(spark, sf_dir)


@query(events_sql(f"{_MONITOR} SELECT run_id, CASE WHEN bool_or(result = 'fail') THEN 'fail' WHEN bool_or(result = 'warn') THEN 'warn' ELSE 'ok' END AS overall, count(*) FILTER (result <> 'ok') AS n_not_ok FROM g GROUP BY 1"))
def run_monitor_overall(spark, sf_dir):
    return monitor.overall(_gates(spark, sf_dir), ["run_id"])


@query(orders_sql("""r AS (SELECT city, price_per_night AS p, row_number() OVER (PARTITION BY city ORDER BY price_per_night) - 1 AS i, count(*) OVER (PARTITION BY city) AS n FROM observations WHERE price_per_night IS NOT NULL)
    SELECT city, count(*) AS n, round(max(p) FILTER (i = greatest(0, floor(n * 0.05) - 1)), 6) AS p5, round(quantile_cont(p, 0.5), 6) AS median, round(max(p) FILTER (i = least(n - 1, floor(n * 0.95))), 6) AS p95 FROM r GROUP BY city"""))
def city_price_stats_by_index(spark, sf_dir):
    return monitor.indexed_price_stats(orders_warehouse(spark, sf_dir).observations.filter("price_per_night is not null"), "city")


@query(events_sql("SELECT CASE WHEN item_id % 4 = 0 THEN 'confirmed' ELSE 'legacy' END AS evidence, count(*) AS n_items, count(DISTINCT link) AS n_links FROM items WHERE status = 'not_bookable' AND item_id % 4 <> 1 GROUP BY 1"))
def dead_link_evidence(spark, sf_dir):
    items = events_warehouse(spark, sf_dir).items.filter("status = 'not_bookable'")
    told = items.withColumn("evidence_json", F.when(F.col("item_id") % 4 == 0, '{"verdict": "confirmed"}').when(F.col("item_id") % 4 == 1, '{"verdict": "not_confirmed"}'))
    return monitor.dead_link_split(told, "evidence_json")


_AUDIT = f"""{_PARSED}, ar AS (SELECT run_id, source_code, started_at, CASE WHEN source_code = 'a' THEN 'sha' WHEN day(crawl_date) % 2 = 0 THEN 'sha' END AS file, CASE WHEN source_code = 'b' THEN '[]' ELSE cast(day(crawl_date) % 2 AS varchar) END AS dates, CASE WHEN source_code = 'a' THEN 'v1' ELSE 'v' || (day(crawl_date) % 3) END AS version FROM runs),
    ai AS (SELECT *, CASE WHEN source_code = 'b' AND item_id % 77 = 0 THEN 'captcha' ELSE error_code END AS code, n_parsed + CASE WHEN item_id % 300 = 4 THEN 1 ELSE 0 END AS n_candidates, CASE WHEN item_id % 350 = 6 THEN 1 ELSE 0 END AS n_rejected FROM mi WHERE source_code = 'b' OR n_parsed = n_saved + n_duplicate),
    s1 AS (SELECT source_code, count(DISTINCT cast(started_at + INTERVAL 7 HOUR AS date)) AS days, count(DISTINCT coalesce(file, '')) AS files, count(*) FILTER (file IS NULL) AS nofile, count(DISTINCT dates) AS sets, count(DISTINCT version) AS versions, count(*) FILTER (hour(started_at + INTERVAL 7 HOUR) * 60 + minute(started_at + INTERVAL 7 HOUR) NOT BETWEEN 1290 AND 1350) AS off FROM ar GROUP BY 1),
    s2 AS (SELECT source_code, count(*) FILTER (status = 'error') AS errors, count(*) FILTER (code IN ('captcha', 'blocked')) AS blocked, count(*) FILTER (status IN ('success', 'partial') AND (n_rejected > 0 OR n_candidates <> n_parsed OR n_parsed <> n_saved + n_duplicate)) AS incomplete,
                  count(*) FILTER (link IS NOT NULL AND NOT (contains(link, 'checkin=' || cast(checkin_date AS varchar)) AND contains(link, 'checkout=' || cast(checkout_date AS varchar)))) AS urls, count(*) FILTER (link IS NULL) AS nourl FROM ai GROUP BY 1),
    rf AS (SELECT hotel_id, checkin_date, CASE WHEN hotel_id % 9 = 0 THEN 'proposed' ELSE 'approved' END AS status, hotel_id % 50 <> 1 AS sound FROM (SELECT DISTINCT hotel_id, checkin_date FROM observations)),
    se AS (SELECT DISTINCT ai.source_code, o.hotel_id, o.checkin_date FROM observations o JOIN ai USING (item_id) WHERE ai.status = 'success' AND NOT is_sold_out AND room_key IS NOT NULL AND o.item_id % 40 <> 9),
    s3 AS (SELECT source_code, count(*) AS series, count(*) FILTER (status = 'approved') AS ready FROM se JOIN rf USING (hotel_id, checkin_date) GROUP BY 1),
    w AS (SELECT *, (SELECT count(*) FROM rf WHERE status = 'approved') AS approved, (SELECT count(*) FROM rf WHERE status = 'approved' AND sound) AS sound FROM s1 JOIN s2 USING (source_code) JOIN s3 USING (source_code))
    SELECT source_code, u.* FROM w, LATERAL (VALUES ('six_distinct_real_days', 'gate', days::double, days >= 6), ('same_protocol_file', 'gate', files, files = 1 AND nofile = 0), ('same_checkin_dates', 'gate', sets, sets = 1), ('parser_complete', 'gate', incomplete, incomplete = 0), ('requested_url_dates', 'gate', urls, urls = 0), ('no_technical_errors', 'gate', errors, errors = 0), ('no_block_or_captcha', 'gate', blocked, blocked = 0),
        ('approved_references_valid', 'gate', approved - sound, approved > 0 AND approved = sound), ('reference_ready_ratio', 'gate', round(ready::double / series, 4), ready::double / series >= 0.8), ('off_schedule', 'warning', off, off = 0), ('mixed_scraper_versions', 'warning', versions, versions <= 1), ('requested_url_legacy_missing', 'warning', nourl, nourl = 0)) u(check_name, kind, value, passed)"""


@query(events_sql(_AUDIT))
def sampling_quality_audit(spark, sf_dir):
    runs, items, obs = _collected(spark, sf_dir)
    a, odd = F.col("source_code") == "a", F.dayofmonth("crawl_date") % 2
    i = F.col("item_id")
    runs = runs.select("run_id", "source_code", "started_at", F.when(a | (odd == 0), "sha").alias("file_sha256"), F.when(a, odd.cast("string")).otherwise("[]").alias("checkin_dates"), F.when(a, "v1").otherwise(F.concat(F.lit("v"), (F.dayofmonth("crawl_date") % 3).cast("string"))).alias("scraper_version"))
    items = items.filter(~a | (F.col("n_parsed") == F.col("n_saved") + F.col("n_duplicate"))).withColumn("error_code", F.when(~a & (i % 77 == 0), "captcha").otherwise(F.col("error_code"))).drop("source_code")
    items = items.withColumn("n_candidates", F.col("n_parsed") + F.when(i % 300 == 4, 1).otherwise(0)).withColumn("n_rejected", F.when(i % 350 == 6, 1).otherwise(0))
    h = F.col("hotel_id")
    found = obs.select("hotel_id", "checkin_date").distinct().select("*", F.when(h % 9 == 0, "proposed").otherwise("approved").alias("status"), F.lit(4).alias("distinct_run_count"), F.lit(0.9).alias("coverage"), F.lit(5).alias("observation_count"), F.when(h % 50 == 1, 4).otherwise(5).alias("distinct_item_count"))
    return monitor.sampling_audit(runs, items, obs, found)


@query(events_sql("SELECT run_id, count(*) AS n_items, count(*) AS n_done, arg_max(item_id, (finished_at, item_id)) AS latest_item, 100.0 AS percent FROM items GROUP BY 1"))
def crawl_progress(spark, sf_dir):
    return monitor.progress(events_warehouse(spark, sf_dir).items)


_DEAD = "d AS (SELECT user_id AS hotel_id, crawl_date, bool_and(status IN ('not_bookable', 'error', 'sold_out')) AS dead FROM items0 GROUP BY 1, 2)"


@query(events_sql(f"{_DEAD}, k AS (SELECT *, crawl_date - row_number() OVER (PARTITION BY hotel_id ORDER BY crawl_date)::int AS island FROM d WHERE dead) SELECT hotel_id, min(crawl_date) AS streak_start, count(*) AS streak_days, count(*) >= 3 AS needs_review FROM k GROUP BY hotel_id, island"))
def dead_link_streaks(spark, sf_dir):
    w = events_warehouse(spark, sf_dir)
    bad = F.col("status").isin("not_bookable", "error", "sold_out")
    days = w.items.join(w.observations.select("item_id", F.col("hotel_id").alias("h")), "item_id").groupBy(F.col("h").alias("hotel_id"), "crawl_date").agg(F.bool_and(bad).alias("dead"))
    return monitor.streaks(days, ["hotel_id"], "crawl_date", "dead")


@query(events_sql("q AS (SELECT item_id, run_id, hotel_id, CASE WHEN item_id % 3 = 0 THEN 'queued' ELSE status END AS s FROM items), c AS (SELECT run_id, hotel_id, max(s) FILTER (s IN ('not_bookable')) AS c FROM q GROUP BY 1, 2) SELECT item_id, CASE WHEN s = 'queued' AND c IS NOT NULL THEN c ELSE s END AS status_after FROM q LEFT JOIN c ON q.run_id = c.run_id AND q.hotel_id IS NOT DISTINCT FROM c.hotel_id"))
def confirmed_state_cascade(spark, sf_dir):
    items = events_warehouse(spark, sf_dir).items.withColumn("status", F.when(F.col("item_id") % 3 == 0, "queued").otherwise(F.col("status")))
    return monitor.cascade_closed(items, ["run_id", "hotel_id"], F.col("status") == "not_bookable").select("item_id", "status_after")


@query(events_sql("SELECT 'retry|' || run_id AS run_id, run_id AS retry_of_run_id, item_id AS retry_of_item_id, hotel_id, checkin_date, 'queued' AS status FROM items WHERE status IN ('error', 'partial')"))
def retry_items(spark, sf_dir):
    return monitor.retry_set(events_warehouse(spark, sf_dir).items, "retry")


@query(events_sql("e AS (SELECT * FROM items WHERE status = 'error' AND source_code = 'a') SELECT item_id, status, (SELECT count(*) FROM e) AS n_total, (SELECT string_agg(DISTINCT selector_version, ',' ORDER BY selector_version) FROM items) AS markets FROM e ORDER BY crawl_date DESC, item_id LIMIT 50 OFFSET 100"))
def filtered_item_page(spark, sf_dir):
    """The selector version stands for the market."""
    items = events_warehouse(spark, sf_dir).items
    return monitor.filtered_page(items, (F.col("status") == "error") & (F.col("source_code") == "a"), [F.desc("crawl_date"), F.col("item_id")], 100, 50, "selector_version").select("item_id", "status", "n_total", "markets")


@query(events_sql("SELECT run_id, item_id, status, error_code FROM items WHERE status IN ('error', 'partial', 'not_bookable')"))
def issue_sheet(spark, sf_dir):
    return events_warehouse(spark, sf_dir).items.filter(F.col("status").isin("error", "partial", "not_bookable")).select("run_id", "item_id", "status", "error_code")


@query(orders_sql("SELECT o.item_id, option_index, h.name, o.city, round(price_total, 6) AS price_total, i.status AS item_status, row_number() OVER (ORDER BY o.item_id, option_index, h.name, round(price_total, 6)) AS place FROM observations o JOIN hotels h USING (hotel_id) LEFT JOIN (SELECT * FROM items WHERE include_reference) i USING (item_id) WHERE date_part('year', o.crawl_date) = 1997"))
def run_export(spark, sf_dir):
    """A run is a year here, items are those of the reference scope; written in order, and read back with each row's place."""
    w = orders_warehouse(spark, sf_dir)
    items = w.items.filter("include_reference").select("item_id", F.col("status").alias("_status"))
    rows = w.observations.filter(F.year("crawl_date") == 1997).join(w.hotels.select("hotel_id", "name"), "hotel_id").join(items, "item_id", "left")
    rows = rows.select("item_id", "option_index", "name", "city", r6("price_total").alias("price_total"), F.col("_status").alias("item_status"))
    path = shared_path(spark, "export")
    return files.read_ordered(spark, path, files.export_ordered(rows, path, ["item_id", "option_index", "name", "price_total"])).drop("file")


# --- review log: a review for each hotel with low prices; some are superseded, some retracted

_LOG = """lo AS (SELECT record_id, hotel_id, CASE WHEN record_id % 2 = 0 THEN 'a' ELSE 'b' END AS source_code FROM observations WHERE price_per_night > 0 AND price_per_night < 5),
    st AS (SELECT hotel_id, CASE WHEN hotel_id % 5 = 0 THEN 'retracted' WHEN hotel_id % 3 = 0 THEN 'superseded' ELSE 'active' END AS state FROM (SELECT DISTINCT hotel_id FROM lo))"""


def _log(spark, sf_dir) -> DataFrame:
    w = events_warehouse(spark, sf_dir)
    low = w.observations.filter("price_per_night > 0 and price_per_night < 5")
    member = F.struct(F.when(F.col("record_id") % 2 == 0, "a").otherwise("b").alias("source_code"), "record_id", F.sha2(F.col("record_id").cast("string"), 256).alias("fingerprint"))
    per = low.groupBy("hotel_id").agg(F.array_sort(F.collect_list(member)).alias("members"))
    h = F.col("hotel_id")
    review = lambda s: F.concat(F.lit("r"), h.cast("string"), F.lit(s))
    at = lambda k: (h * 2 + k).alias("sequence")
    none = F.lit(None).cast("string")
    first = per.select(at(1), F.concat(F.lit("e"), (h * 2 + 1).cast("string")).alias("event_id"), F.lit("activate").alias("action"), review("a").alias("review_id"), none.alias("target_review_id"), F.when(h % 4 == 0, "keep").otherwise("exclude_from_train").alias("decision"), "members")
    gone = per.filter((h % 5 == 0) | (h % 3 == 0)).select(
        at(2), F.concat(F.lit("e"), (h * 2 + 2).cast("string")).alias("event_id"), F.when(h % 5 == 0, "retract").otherwise("supersede").alias("action"), F.when(h % 5 == 0, none).otherwise(review("b")).alias("review_id"), review("a").alias("target_review_id"), F.when(h % 5 == 0, none).otherwise(F.lit("exclude_from_train")).alias("decision"), F.when(h % 5 != 0, F.col("members")).otherwise(F.array().cast(per.schema["members"].dataType)).alias("members"),
    )
    return first.unionByName(gone).withColumn("decided_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("sequence")))


@query(events_sql(f"{_LOG} SELECT 'r' || hotel_id || 'a' AS review_id, state FROM st UNION ALL SELECT 'r' || hotel_id || 'b', 'active' FROM st WHERE state = 'superseded'"))
def review_states(spark, sf_dir):
    return review_log.review_states(_log(spark, sf_dir)).select("review_id", "state")


_RES = f"{_LOG}, re AS (SELECT lo.*, 'r' || hotel_id || CASE state WHEN 'superseded' THEN 'b' ELSE 'a' END AS review_id, CASE WHEN state = 'superseded' OR hotel_id % 4 <> 0 THEN 'exclude_from_train' ELSE 'keep' END AS decision FROM lo JOIN st USING (hotel_id) WHERE state <> 'retracted')"


@query(events_sql(f"{_RES} SELECT source_code, record_id, review_id, decision FROM re"))
def review_resolutions(spark, sf_dir):
    return review_log.resolutions(_log(spark, sf_dir)).drop("fingerprint")


def _records(spark, sf_dir) -> DataFrame:
    obs = events_warehouse(spark, sf_dir).observations
    return obs.select(F.when(F.col("record_id") % 2 == 0, "a").otherwise("b").alias("source_code"), "record_id", F.sha2(F.col("record_id").cast("string"), 256).alias("fingerprint"))


@query(events_sql(f"{_RES} SELECT o.record_id, re.record_id IS NOT NULL AS is_anomaly FROM observations o LEFT JOIN (SELECT * FROM re WHERE decision = 'exclude_from_train') re USING (record_id)"))
def anomaly_projection(spark, sf_dir):
    return review_log.projection(_records(spark, sf_dir), _log(spark, sf_dir)).select("record_id", "is_anomaly")


@query(events_sql(f"{_RES} SELECT record_id, true AS expected, false AS found FROM re WHERE decision = 'exclude_from_train' AND record_id % 7 = 0 UNION ALL SELECT record_id, false, true FROM observations WHERE record_id % 500 = 1 AND record_id NOT IN (SELECT record_id FROM re WHERE decision = 'exclude_from_train')"))
def anomaly_projection_mismatches(spark, sf_dir):
    """With some stored flags dropped and some put in."""
    log = _log(spark, sf_dir)
    stored = review_log.projection(_records(spark, sf_dir), log)
    k = F.col("record_id")
    stored = stored.withColumn("is_anomaly", F.when(F.col("is_anomaly") & (k % 7 == 0), False).when(k % 500 == 1, True).otherwise(F.col("is_anomaly")))
    return review_log.projection_mismatches(stored, log).select("record_id", "expected", "found")


@query(events_sql(f"{_RES} SELECT record_id, decision FROM re WHERE hotel_id * 2 + CASE WHEN hotel_id % 3 = 0 THEN 2 ELSE 1 END <= 100 UNION ALL SELECT record_id, CASE WHEN hotel_id % 4 = 0 THEN 'keep' ELSE 'exclude_from_train' END FROM lo JOIN st USING (hotel_id) WHERE hotel_id * 2 + 1 <= 100 AND hotel_id * 2 + 2 > 100 AND state <> 'active'"))
def resolutions_as_of(spark, sf_dir):
    cut = review_log.as_of(_log(spark, sf_dir), F.timestamp_seconds(F.lit(1_700_000_100)))
    return review_log.resolutions(cut).select("record_id", "decision")


def _faulty_log(spark, sf_dir) -> DataFrame:
    """Three events for each hotel, sound but for one fault that its number chooses. Sequences are dense over hotels 0, 1, 2 and on."""
    h = F.col("h")
    fault = lambda k: h % 12 == k
    of = lambda tail: F.concat(F.lit("r"), h.cast("string"), F.lit(tail))
    member = lambda name, n: F.struct(F.when(fault(4), F.lit("zz")).otherwise(F.lit("a")).alias("source_code"), (h * 10 + n).alias("record_id"), F.lit(name).alias("fingerprint"))
    one, other = F.array(member("f", 1)), F.array(member("f", 2))
    none = F.lit(None).cast("string")
    hotels = events_warehouse(spark, sf_dir).hotels.select(F.col("hotel_id").alias("h"))
    kinds = [  # action, review, target, decision, members
        (F.when(fault(3), "odd").otherwise("activate"), of("a"), none, F.lit("keep"), F.when(fault(5), F.concat(one, one)).otherwise(one)),
        (F.when(fault(10) | fault(6), "activate").otherwise("supersede"), F.when(fault(6), of("a")).otherwise(of("b")), F.when(fault(10) | fault(6), none).when(fault(7), F.lit("nobody")).otherwise(of("a")), F.lit("keep"), F.when(fault(9) | fault(6), other).otherwise(one)),
        (F.lit("retract"), none, F.when(fault(8), of("a")).when(fault(7), of("a")).when(fault(6), of("a")).otherwise(of("b")), none, F.array().cast("array<struct<source_code:string,record_id:bigint,fingerprint:string>>")),
    ]
    rows = []
    for k, (action, review, target, decision, members) in enumerate(kinds):
        sequence = h * 3 + k + 1 - (F.when(fault(1), 1).otherwise(0) if k == 1 else F.lit(0))
        event = F.concat(F.lit("e"), (h * 3 + F.when(fault(2) & F.lit(k == 1), 0).otherwise(k)).cast("string"))
        moved = F.lit(1_700_000_000) + h * 3 + k - (F.when(fault(11), 100).otherwise(0) if k == 2 else F.lit(0))
        row = hotels.select(sequence.cast("long").alias("sequence"), event.alias("event_id"), action.alias("action"), review.alias("review_id"), target.alias("target_review_id"), decision.alias("decision"), members.cast("array<struct<source_code:string,record_id:bigint,fingerprint:string>>").alias("members"), F.timestamp_seconds(moved).alias("decided_at"), h.alias("h"))
        rows.append(row.filter(~fault(0)) if k == 1 else row)
    return reduce(lambda a, b: a.unionByName(b), rows)


@query(events_sql("hh AS (SELECT hotel_id % 12 AS f FROM hotels) SELECT v.* FROM (SELECT count(*) FILTER (f = 1) AS rep, count(*) FILTER (f = 2) AS ev, count(*) FILTER (f = 3) AS act, count(*) FILTER (f = 4) AS src, count(*) FILTER (f IN (1, 5)) AS mem, count(*) FILTER (f = 6) AS reu, count(*) FILTER (f IN (0, 1, 3, 7)) AS unk, count(*) FILTER (f = 8) AS sta, count(*) FILTER (f = 10) AS ovl FROM hh) t, LATERAL (VALUES ('event_id_repeated', 2 * ev), ('unknown_action', act), ('unknown_source', 2 * src), ('member_repeated', mem), ('review_id_reused', reu), ('target_unknown', unk), ('target_not_active', sta), ('overlapping_ownership', ovl), ('sequence_repeated', rep)) v(violation, n)"))
def review_log_violations(spark, sf_dir):
    """Of the twelve rules those whose faults touch no other event; tests hold the other three against known logs."""
    found = review_log.violations(_faulty_log(spark, sf_dir), ["a", "b"]).groupBy("violation").agg(F.count(F.lit(1)).alias("n"))
    return found.filter(F.col("violation").isin("event_id_repeated", "unknown_action", "unknown_source", "member_repeated", "review_id_reused", "target_unknown", "target_not_active", "overlapping_ownership", "sequence_repeated"))


def _problems(spark, sf_dir) -> DataFrame:
    log = _log(spark, sf_dir)
    k = F.col("record_id")
    applied = review_log.log_hash(log).select("event_id", F.when(F.col("sequence") % 10 == 1, "x").otherwise(F.col("payload_sha256")).alias("payload_sha256"))
    states = review_log.review_states(log).filter("opened_at % 14 <> 1")
    resolved = review_log.resolutions(log).withColumn("review_id", F.when(k % 6 == 0, "other").otherwise(F.col("review_id")))
    records = review_log.projection(_records(spark, sf_dir), log).withColumn("fingerprint", F.when(k % 9 == 0, "x").otherwise(F.col("fingerprint")))
    return review_log.verify(log, applied, states, resolved, records)


@query(events_sql(f"{_RES}, se AS (SELECT hotel_id * 2 + 1 AS s FROM st UNION ALL SELECT hotel_id * 2 + 2 FROM st WHERE state <> 'active'), op AS (SELECT hotel_id * 2 + 1 AS s FROM st UNION ALL SELECT hotel_id * 2 + 2 FROM st WHERE state = 'superseded') SELECT 'events' AS layer, 'differs' AS problem, count(*) AS n FROM se WHERE s % 10 = 1 UNION ALL SELECT 'decisions', 'missing', count(*) FROM op WHERE s % 14 = 1 UNION ALL SELECT 'resolutions', 'differs', count(*) FROM re WHERE record_id % 6 = 0 UNION ALL SELECT 'fingerprints', 'differs', count(*) FROM re WHERE record_id % 9 = 0"))
def review_log_verification(spark, sf_dir):
    """With something wrong put into each layer."""
    return _problems(spark, sf_dir).groupBy("layer", "problem").agg(F.count(F.lit(1)).alias("n"))


@query(events_sql(f"{_LOG}, se AS (SELECT hotel_id * 2 + 1 AS s FROM st UNION ALL SELECT hotel_id * 2 + 2 FROM st WHERE state <> 'active') SELECT 'e' || s AS event_id FROM se WHERE s % 10 = 1"))
def review_payload_drift(spark, sf_dir):
    log = _log(spark, sf_dir)
    applied = review_log.log_hash(log).select("event_id", F.when(F.col("sequence") % 10 == 1, "x").otherwise(F.col("payload_sha256")).alias("payload_sha256"))
    return review_log.payload_drift(log, applied)


@query(events_sql(f"{_RES}, n AS (SELECT (SELECT count(*) FROM st WHERE (hotel_id * 2 + 1) % 10 = 1) + (SELECT count(*) FROM st WHERE state <> 'active' AND (hotel_id * 2 + 2) % 10 = 1) + (SELECT count(*) FROM st WHERE (hotel_id * 2 + 1) % 14 = 1) + (SELECT count(*) FROM st WHERE state = 'superseded' AND (hotel_id * 2 + 2) % 14 = 1) + (SELECT count(*) FROM re WHERE record_id % 6 = 0) + (SELECT count(*) FROM re WHERE record_id % 9 = 0) AS k) SELECT 'faulty' AS state, k AS n_problems, k = 0 AS open FROM n UNION ALL SELECT 'repaired', count(*) FILTER (record_id IS NULL), count(*) > 0 FROM re UNION ALL SELECT 'sync failed', count(*) FILTER (record_id IS NULL), count(*) < 0 FROM re UNION ALL SELECT 'other file', count(*) FILTER (record_id IS NULL), count(*) < 0 FROM re"))
def consumer_gate(spark, sf_dir):
    """With faults, after their repair, after a failed sync and with another file."""
    log = _log(spark, sf_dir)
    sound = review_log.verify(log, review_log.log_hash(log).select("event_id", "payload_sha256"), review_log.review_states(log), review_log.resolutions(log), review_log.projection(_records(spark, sf_dir), log))
    gates = {"faulty": (_problems(spark, sf_dir), True, True), "repaired": (sound, True, True), "sync failed": (sound, False, True), "other file": (sound, True, False)}
    rows = [review_log.consumer_gate(*g).select(F.lit(n).alias("state"), "n_problems", "open") for n, g in gates.items()]
    return reduce(lambda a, b: a.unionByName(b), rows)


# --- features and labels over (hotel, day) series of the events

_SNAP = """sn AS (SELECT record_id, hotel_id, crawl_date, round(price_per_night, 6) AS price, lead_time, checkin_date, CASE WHEN n > 1 THEN 'latest_of_day' ELSE 'only_of_day' END AS snapshot_reason FROM
    (SELECT *, row_number() OVER (PARTITION BY hotel_id, crawl_date ORDER BY observed_at DESC, record_id DESC) AS k, count(*) OVER (PARTITION BY hotel_id, crawl_date) AS n FROM observations WHERE price_per_night > 0) WHERE k = 1)"""
SERIES = ["hotel_id"]


def _snapshot(spark, sf_dir) -> DataFrame:
    obs = events_warehouse(spark, sf_dir).observations.filter("price_per_night > 0")
    snap = features.daily_snapshot(obs, SERIES, "crawl_date", "observed_at", "record_id")
    return snap.select("record_id", "hotel_id", "crawl_date", r6("price_per_night").alias("price"), "lead_time", "checkin_date", "snapshot_reason")


@query(events_sql(f"{_SNAP} SELECT * FROM sn"))
def daily_snapshot(spark, sf_dir):
    return _snapshot(spark, sf_dir)


_HD = "(VALUES (DATE '2024-01-01', NULL, false, false), (DATE '2024-02-10', NULL, true, false), (DATE '2024-01-20', 'Hoi An', false, true), (DATE '2024-02-11', NULL, true, false), (DATE '2024-01-25', 'Hanoi', false, true)) AS h(d, hc, tet, fest)"


def _near(kind: str, only: str) -> str:
    return f"min(checkin_date - d) FILTER (d <= checkin_date{only})::int AS days_since_{kind}, min(d - checkin_date) FILTER (d >= checkin_date{only})::int AS days_to_{kind}, min(abs(d - checkin_date)) FILTER (true{only})::int AS days_to_nearest_{kind}"


@query(events_sql(f"""{_SNAP}, pl AS (SELECT sn.*, h.city FROM sn JOIN hotels h USING (hotel_id)), nh AS (SELECT city, checkin_date, {_near('holiday', '')}, {_near('tet', ' AND tet')}, {_near('festival', ' AND fest')}, bool_or(d = checkin_date) AS is_holiday, bool_or(d - checkin_date = 1) AS is_eve FROM (SELECT DISTINCT city, checkin_date FROM pl), {_HD} WHERE hc IS NULL OR hc = city GROUP BY 1, 2)
    SELECT record_id, isodow(pl.checkin_date)::int - 1 AS dow, isodow(pl.checkin_date) IN (5, 6) AS is_weekend, month(pl.checkin_date)::int AS month, week(pl.checkin_date)::int AS week, quarter(pl.checkin_date)::int AS quarter, CASE WHEN month(pl.checkin_date) IN (12, 1, 2) THEN 'winter' WHEN month(pl.checkin_date) <= 5 THEN 'spring' WHEN month(pl.checkin_date) <= 8 THEN 'summer' ELSE 'autumn' END AS season,
           nh.* EXCLUDE (city, checkin_date), {BUCKET} AS lead_bucket, coalesce(lead_time <= 3, false) AS is_last_minute FROM pl JOIN nh ON nh.city IS NOT DISTINCT FROM pl.city AND nh.checkin_date = pl.checkin_date"""))
def calendar_and_lead_features(spark, sf_dir):
    """With two festivals of cities, and two days of Tet."""
    rows = features.calendar_features(_snapshot(spark, sf_dir), "checkin_date").join(events_warehouse(spark, sf_dir).hotels.select("hotel_id", "city"), "hotel_id")
    told = [("2024-01-01", None, False, False), ("2024-02-10", None, True, False), ("2024-01-20", "Hoi An", False, True), ("2024-02-11", None, True, False), ("2024-01-25", "Hanoi", False, True)]
    days = spark.createDataFrame(told, "d string, city string, is_tet boolean, is_festival boolean").select(F.col("d").cast("date").alias("holiday_date"), "city", "is_tet", "is_festival")
    out = features.lead_features(features.nearest_holidays(rows, "checkin_date", "city", days), "lead_time")
    return out.select("record_id", "dow", "is_weekend", "month", "week", "quarter", "season", *[f"{p}_{k}" for k in ("holiday", "tet", "festival") for p in ("days_since", "days_to", "days_to_nearest")], "is_holiday", "is_eve", "lead_bucket", "is_last_minute")


def _rng(agg: str, a: int, b: int) -> str:
    return f"{agg} OVER (PARTITION BY hotel_id ORDER BY crawl_date RANGE BETWEEN INTERVAL {a} DAY PRECEDING AND INTERVAL {b} DAY PRECEDING)"


_HISTORY = f"""{_SNAP}, hi AS (SELECT *, {", ".join(f"{_rng('max(price)', k, k)} AS lag_{k}" for k in (1, 3, 7, 14))}, round({_rng('avg(price)', 7, 1)}, 6) AS mean_7, round({_rng('avg(price)', 14, 1)}, 6) AS mean_14, round({_rng('stddev_samp(price)', 7, 1)}, 6) AS std_7, {_rng('min(price)', 14, 1)} AS min_14, {_rng('max(price)', 14, 1)} AS max_14, round(price / nullif({_rng('avg(price)', 30, 1)}, 0), 6) AS ratio_30,
        CASE WHEN price IS DISTINCT FROM lag(price) OVER w AND lag(crawl_date) OVER w IS NOT NULL THEN crawl_date END AS ch FROM sn WINDOW w AS (PARTITION BY hotel_id ORDER BY crawl_date))"""


@query(events_sql(f"{_HISTORY} SELECT record_id, lag_1, lag_3, lag_7, lag_14, mean_7, mean_14, std_7, min_14, max_14, ratio_30, round((price - lag_7) / 7, 6) AS velocity_7, (crawl_date - last_value(ch IGNORE NULLS) OVER (PARTITION BY hotel_id ORDER BY crawl_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::int AS days_since_change FROM hi"))
def price_history_features(spark, sf_dir):
    out = features.price_history(_snapshot(spark, sf_dir), SERIES, "crawl_date", "price")
    return out.select("record_id", *[f"lag_{k}" for k in (1, 3, 7, 14)], "mean_7", "mean_14", "std_7", "min_14", "max_14", "ratio_30", "velocity_7", "days_since_change")


def _label(k: int) -> str:
    return f"l{k}.price AS label_h{k}, l{k}.record_id AS label_record_h{k}, l{k}.price IS NOT NULL AS has_label_h{k}, round(l{k}.price - sn.price, 6) AS delta_h{k}, round((l{k}.price - sn.price) / nullif(sn.price, 0), 6) AS pct_h{k}, CASE WHEN (l{k}.price - sn.price) / nullif(sn.price, 0) > 0.02 THEN 'up' WHEN (l{k}.price - sn.price) / nullif(sn.price, 0) < -0.02 THEN 'down' WHEN l{k}.price IS NOT NULL THEN 'flat' END AS direction_h{k}"


@query(events_sql(f"{_SNAP} SELECT sn.record_id, {', '.join(_label(k) for k in (1, 3, 7, 14))} FROM sn " + " ".join(f"LEFT JOIN sn l{k} ON l{k}.hotel_id = sn.hotel_id AND l{k}.crawl_date = sn.crawl_date + {k}" for k in (1, 3, 7, 14))))
def horizon_labels(spark, sf_dir):
    out = features.labels(_snapshot(spark, sf_dir), SERIES, "crawl_date", "price", "record_id")
    return out.select("record_id", *[f"{c}_h{k}" for k in (1, 3, 7, 14) for c in ("label", "label_record", "has_label", "delta", "pct", "direction")])


_SPLIT = f"{_SNAP}, dd AS (SELECT DISTINCT datediff('day', DATE '1970-01-01', crawl_date) AS n FROM sn), cu AS (SELECT floor(quantile_cont(n::double, 0.7)) AS a, floor(quantile_cont(n::double, 0.85)) AS b FROM dd), sp AS (SELECT sn.*, CASE WHEN n <= a - 3 THEN 'train' WHEN n <= a THEN 'purge' WHEN n <= b - 3 THEN 'valid' WHEN n <= b THEN 'purge' ELSE 'test' END AS split FROM (SELECT *, datediff('day', DATE '1970-01-01', crawl_date) AS n FROM sn) sn, cu)"


@query(events_sql(f"{_SPLIT} SELECT split, count(*) AS n_rows, min(crawl_date) AS first_day, max(crawl_date) AS last_day FROM sp GROUP BY 1"))
def chronological_split(spark, sf_dir):
    """With a gap of three days, as the events span a month."""
    out = features.chronological_split(_snapshot(spark, sf_dir), "crawl_date", gap=3)
    return out.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.min("crawl_date").alias("first_day"), F.max("crawl_date").alias("last_day"))


_BASE = f"{_SNAP}, ba AS (SELECT sn.*, price AS persistence, round((SELECT quantile_cont(b.price, 0.5) FROM sn b WHERE b.hotel_id = sn.hotel_id AND b.crawl_date <= sn.crawl_date), 6) AS historical_median, (SELECT max(b.price) FROM sn b WHERE b.hotel_id = sn.hotel_id AND b.crawl_date = sn.crawl_date - 7) AS week_before, (SELECT max(b.price) FROM sn b WHERE b.hotel_id = sn.hotel_id AND b.crawl_date = sn.crawl_date + 1) AS y FROM sn)"


def _baselines(spark, sf_dir) -> DataFrame:
    snap = features.labels(_snapshot(spark, sf_dir), SERIES, "crawl_date", "price", "record_id", horizons=(1,))
    return features.baselines(snap, SERIES, "crawl_date", "price")


@query(events_sql(f"{_BASE} SELECT record_id, persistence, historical_median, week_before FROM ba"))
def baseline_forecasts(spark, sf_dir):
    return _baselines(spark, sf_dir).select("record_id", "persistence", "historical_median", "week_before")


_M = "count(*) AS n, round(avg((abs(y - f) <= 0.2 * abs(y))::int), 6) AS accuracy_20, round(avg(abs(y - f)), 6) AS mae, round(sqrt(avg((y - f) * (y - f))), 6) AS rmse, round(avg(abs(y - f) / nullif(abs(y), 0)), 6) AS mape, round(avg(2 * abs(y - f) / nullif(abs(y) + abs(f), 0)), 6) AS smape, round(1 - avg((y - f) * (y - f)) / nullif(var_pop(y), 0), 6) AS r2"


@query(events_sql(f"{_BASE}, m AS (SELECT *, historical_median AS f, {BUCKET} AS lead_bucket FROM ba WHERE y IS NOT NULL AND historical_median IS NOT NULL) SELECT CASE WHEN grouping(lead_bucket) = 1 THEN '(all)' ELSE lead_bucket END AS lead_bucket, {_M} FROM m GROUP BY ROLLUP (lead_bucket)"))
def forecast_metrics_by_bucket(spark, sf_dir):
    return features.metrics(_baselines(spark, sf_dir).withColumn("lead_bucket", bucket("lead_time")), "label_h1", "historical_median", "lead_bucket")


def _dir(a: str, b: str) -> str:
    return f"CASE WHEN ({b} - {a}) / nullif({a}, 0) > 0.02 THEN 'up' WHEN ({b} - {a}) / nullif({a}, 0) < -0.02 THEN 'down' WHEN {b} IS NOT NULL THEN 'flat' END"


@query(events_sql(f"{_BASE}, c AS (SELECT {_dir('price', 'y')} AS actual, {_dir('price', 'historical_median')} AS said FROM ba) SELECT actual, count(*) FILTER (said = 'up') AS said_up, count(*) FILTER (said = 'flat') AS said_flat, count(*) FILTER (said = 'down') AS said_down FROM c WHERE actual IS NOT NULL AND said IS NOT NULL GROUP BY 1"))
def direction_confusion(spark, sf_dir):
    return features.direction_confusion(_baselines(spark, sf_dir).withColumn("said", features.direction("price", "historical_median")), "direction_h1", "said")


_ALL_HORIZONS = f"{_BASE}, hz AS (" + " UNION ALL ".join(f"SELECT {k} AS horizon, ba.*, l.price AS actual, h.city, CASE WHEN review_score >= 8 THEN 'high' ELSE 'low' END AS tier FROM ba JOIN sn l ON l.hotel_id = ba.hotel_id AND l.crawl_date = ba.crawl_date + {k} JOIN hotels h ON h.hotel_id = ba.hotel_id" for k in (1, 3, 7, 14)) + ")"
_SHORT = "count(*) AS n, round(avg((abs(actual - historical_median) <= 0.2 * abs(actual))::int), 6) AS accuracy_20, round(avg(abs(actual - historical_median)), 6) AS mae, round(sqrt(avg((actual - historical_median) * (actual - historical_median))), 6) AS rmse, round(avg(abs(actual - historical_median) / nullif(abs(actual), 0)), 6) AS mape, round(avg(2 * abs(actual - historical_median) / nullif(abs(actual) + abs(historical_median), 0)), 6) AS smape, round(1 - avg((actual - historical_median) * (actual - historical_median)) / nullif(var_pop(actual), 0), 6) AS r2"


def _by_horizon(spark, sf_dir) -> DataFrame:
    snap = features.labels(_snapshot(spark, sf_dir), SERIES, "crawl_date", "price", "record_id")
    rows = features.baselines(snap, SERIES, "crawl_date", "price").join(events_warehouse(spark, sf_dir).hotels.select("hotel_id", "city", "review_score"), "hotel_id")
    return features.by_horizon(rows, ["hotel_id", "price", "historical_median", "lead_time", "city", "review_score"])


@query(events_sql(f"{_ALL_HORIZONS} SELECT horizon, 'all' AS dimension, '(all)' AS value, {_SHORT} FROM hz GROUP BY 1 UNION ALL SELECT horizon, 'lead_bucket', coalesce({BUCKET}, '(unknown)'), {_SHORT} FROM hz GROUP BY 1, 3 UNION ALL SELECT horizon, 'city', coalesce(city, '(unknown)'), {_SHORT} FROM hz GROUP BY 1, 3 UNION ALL SELECT horizon, 'score_tier', tier, {_SHORT} FROM hz GROUP BY 1, 3"))
def forecast_metrics_by_horizon(spark, sf_dir):
    tier = F.when(F.col("review_score") >= 8, "high").otherwise("low")
    return features.metrics_by(_by_horizon(spark, sf_dir), "actual", "historical_median", "horizon", {"lead_bucket": bucket("lead_time"), "city": F.col("city"), "score_tier": tier})


@query(events_sql(f"{_ALL_HORIZONS}, c AS (SELECT horizon, {_dir('price', 'actual')} AS actual, {_dir('price', 'historical_median')} AS said FROM hz) SELECT horizon, actual, count(*) FILTER (said = 'up') AS said_up, count(*) FILTER (said = 'flat') AS said_flat, count(*) FILTER (said = 'down') AS said_down FROM c WHERE actual IS NOT NULL AND said IS NOT NULL GROUP BY 1, 2"))
def direction_confusion_by_horizon(spark, sf_dir):
    rows = _by_horizon(spark, sf_dir).withColumn("said", features.direction("price", "historical_median"))
    return features.direction_confusion(rows, "direction", "said", "horizon")


@query(events_sql(f"{_ALL_HORIZONS}, c AS (SELECT horizon, {_dir('price', 'actual')} AS actual, {_dir('price', 'historical_median')} AS said FROM hz) SELECT horizon, count(*) AS n, round(avg((actual = said)::int), 6) AS direction_accuracy FROM c WHERE actual IS NOT NULL AND said IS NOT NULL GROUP BY 1"))
def direction_accuracy_by_horizon(spark, sf_dir):
    rows = _by_horizon(spark, sf_dir).withColumn("said", features.direction("price", "historical_median"))
    return features.direction_accuracy(rows, "direction", "said", "horizon")


_SETS = """cs AS (SELECT hotel_id, competitor_id, rank FROM (SELECT a.hotel_id, b.hotel_id AS competitor_id, row_number() OVER (PARTITION BY a.hotel_id ORDER BY round(abs(a.review_score - b.review_score), 6), b.hotel_id) AS rank, count(*) OVER (PARTITION BY a.hotel_id) AS n FROM hotels a JOIN hotels b ON a.city = b.city AND a.hotel_id <> b.hotel_id AND b.review_count >= 50 AND round(abs(a.review_score - b.review_score), 6) <= 0.5) WHERE n >= 5 AND rank <= 15)"""


@query(events_sql(f"{_SETS} SELECT * FROM cs"))
def competitor_sets(spark, sf_dir):
    return features.competitor_set(events_warehouse(spark, sf_dir).hotels)


_DAYP = f"{_SETS}, dp AS (SELECT hotel_id, crawl_date, round(avg(price_per_night), 6) AS price, round(avg(is_sold_out::int), 6) AS sold_out_share FROM observations GROUP BY 1, 2 HAVING avg(price_per_night) IS NOT NULL), sf AS (SELECT d.hotel_id, d.crawl_date, d.price, count(*) AS n_competitors, round(avg(o.price) + 1e-9, 4) AS set_mean, round(quantile_cont(o.price, 0.5), 6) AS set_median, min(o.price) AS set_min, max(o.price) AS set_max, round(avg(o.sold_out_share) + 1e-9, 4) AS set_sold_out_share, round(d.price / nullif(round(avg(o.price) + 1e-9, 4), 0) + 1e-9, 4) AS own_to_set, round(count(*) FILTER (o.price < d.price)::double / count(*), 6) AS position FROM dp d JOIN cs USING (hotel_id) JOIN dp o ON o.hotel_id = competitor_id AND o.crawl_date = d.crawl_date GROUP BY 1, 2, 3)"


def _compared(spark, sf_dir) -> DataFrame:
    w = events_warehouse(spark, sf_dir)
    day = w.observations.groupBy("hotel_id", "crawl_date").agg(r6(F.avg("price_per_night")).alias("price"), r6(F.avg(F.col("is_sold_out").cast("int"))).alias("sold_out_share")).filter("price is not null")
    return features.set_features(day, features.competitor_set(w.hotels), "crawl_date")


@query(events_sql(f"{_DAYP} SELECT * FROM sf"))
def competitor_set_features(spark, sf_dir):
    return _compared(spark, sf_dir)


@query(events_sql(f"{_DAYP} SELECT a.hotel_id, a.crawl_date, b.set_mean AS set_mean_lag_7, round((a.set_mean - b.set_mean) / 7, 6) AS set_velocity_7 FROM sf a LEFT JOIN sf b ON b.hotel_id = a.hotel_id AND b.crawl_date = a.crawl_date - 7"))
def competitor_set_history(spark, sf_dir):
    return features.set_history(_compared(spark, sf_dir), "crawl_date").select("hotel_id", "crawl_date", "set_mean_lag_7", "set_velocity_7")


@query(events_sql(f"{_DAYP} SELECT hotel_id, crawl_date, own_to_set, CASE WHEN own_to_set > 1 THEN 'above_set' ELSE 'below_set' END AS alert FROM sf WHERE abs(own_to_set - 1) >= 0.2"))
def price_position_alerts(spark, sf_dir):
    return features.position_alerts(_compared(spark, sf_dir)).select("hotel_id", "crawl_date", "own_to_set", "alert")


# The set's next mean is forecast by the median of its means so far.
_ADVICE = f"""{_DAYP}, fc AS (SELECT sf.*, round((SELECT quantile_cont(b.set_mean, 0.5) FROM sf b WHERE b.hotel_id = sf.hotel_id AND b.crawl_date <= sf.crawl_date), 6) AS set_next FROM sf),
    nx AS (SELECT a.hotel_id, a.crawl_date, round((b.price - a.price) / nullif(a.price, 0), 6) AS own_move, round((a.set_next - a.set_mean) / nullif(a.set_mean, 0), 6) AS set_move FROM fc a JOIN fc b ON a.hotel_id = b.hotel_id AND b.crawl_date = a.crawl_date + 1),
    ad AS (SELECT *, round(set_move - own_move, 6) AS gap, CASE WHEN round(set_move - own_move, 6) >= 0.05 THEN 'raise' WHEN round(set_move - own_move, 6) <= -0.05 THEN 'lower' ELSE 'hold' END AS advice FROM nx)"""


def _advice(spark, sf_dir) -> DataFrame:
    now = running_median(_compared(spark, sf_dir).select("hotel_id", "crawl_date", "price", "set_mean"), ["hotel_id"], ["crawl_date"], "set_mean", "set_next", inclusive=True)
    now = now.withColumn("set_next", r6("set_next"))
    later = now.select("hotel_id", F.date_sub("crawl_date", 1).alias("crawl_date"), F.col("price").alias("price_next"))
    return features.pricing_opportunity(now.join(later, ["hotel_id", "crawl_date"]), "price", "price_next", "set_mean", "set_next")


@query(events_sql(f"{_ADVICE} SELECT * FROM ad"))
def pricing_opportunities(spark, sf_dir):
    """A hotel's next move against the forecast move of its set."""
    return _advice(spark, sf_dir).select("hotel_id", "crawl_date", "own_move", "set_move", "gap", "advice")


@query(events_sql(f"{_ADVICE}, il AS (SELECT *, crawl_date - row_number() OVER (PARTITION BY hotel_id, advice ORDER BY crawl_date)::int AS island FROM ad), si AS (SELECT *, min(crawl_date) OVER (PARTITION BY hotel_id, advice, island) AS alert_since FROM il) SELECT hotel_id, crawl_date, advice, alert_since, (crawl_date - alert_since)::int AS lead_days FROM si WHERE advice <> 'hold' AND abs(own_move) >= 0.1"))
def alert_lead_days(spark, sf_dir):
    """How long an advice had held when a hotel's price moved by a tenth or more."""
    event = (F.col("advice") != "hold") & (F.abs("own_move") >= 0.1)
    out = features.alert_leads(_advice(spark, sf_dir), ["hotel_id"], "crawl_date", "advice", event)
    return out.select("hotel_id", "crawl_date", "advice", "alert_since", "lead_days")


@query(events_sql(f"{_BASE}, t AS (SELECT hotel_id, arg_min(price, crawl_date) AS first_price, min(price) AS best_price, coalesce(arg_min(price, crawl_date) FILTER (historical_median >= price), arg_max(price, crawl_date)) AS booked_price, arg_min(crawl_date, (price, crawl_date)) AS best_day FROM ba GROUP BY 1) SELECT *, round((first_price - booked_price) / nullif(first_price, 0), 6) AS saving, round((booked_price - best_price) / nullif(best_price, 0), 6) AS regret FROM t"))
def booking_timing(spark, sf_dir):
    return features.booking_timing(_baselines(spark, sf_dir), SERIES, "crawl_date", "price", "historical_median")


def _training(spark, sf_dir) -> DataFrame:
    rows = features.price_history(_snapshot(spark, sf_dir), SERIES, "crawl_date", "price")
    rows = features.calendar_features(features.labels(rows, SERIES, "crawl_date", "price", "record_id", horizons=(1,)), "checkin_date")
    return features.chronological_split(rows, "crawl_date", gap=3)


def _model(kind: str):
    def run(spark, sf_dir) -> DataFrame:
        rows = _training(spark, sf_dir)
        fitted = models.fit(rows.filter("split = 'train'"), ["price", "mean_7", "lead_time", "dow", "month"], "label_h1", kind)
        return features.metrics(fitted.transform(rows.filter("split = 'test'")), "label_h1", "prediction").withColumn("model", F.lit(kind))

    return run


@query()
def forecast_linear(spark, sf_dir):
    return _model("linear")(spark, sf_dir)


@query()
def forecast_random_forest(spark, sf_dir):
    return _model("random_forest")(spark, sf_dir)


@query()
def forecast_boosted_trees(spark, sf_dir):
    return _model("boosted_trees")(spark, sf_dir)


_NEXT = "(SELECT max(b.price) FROM sn b WHERE b.hotel_id = sp.hotel_id AND b.crawl_date = sp.crawl_date + 1)"


@query(events_sql(f"{_SPLIT}, ro AS (SELECT sp.split, price AS x, {_NEXT} AS y FROM sp), li AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM ro WHERE split = 'train' AND y IS NOT NULL), te AS (SELECT y, a + b * x AS f FROM ro, li WHERE split = 'test' AND y IS NOT NULL) SELECT {_M} FROM te"))
def forecast_linear_on_price(spark, sf_dir):
    """The linear model of the price alone, whose closed form SQL has too."""
    rows = features.chronological_split(features.labels(_snapshot(spark, sf_dir), SERIES, "crawl_date", "price", "record_id", horizons=(1,)), "crawl_date", gap=3)
    fitted = models.fit(rows.filter("split = 'train'"), ["price"], "label_h1", "linear")
    return features.metrics(fitted.transform(rows.filter("split = 'test'")), "label_h1", "prediction")


# Ridge in closed form: Spark scales the penalty by the label's deviation, so the slope shrinks by 1 + penalty / deviation.
_FOLDS = f"""{_SNAP}, se AS (SELECT s.crawl_date, datediff('day', DATE '1970-01-01', s.crawl_date) AS d, s.price AS x, l.price AS y FROM sn s JOIN sn l ON l.hotel_id = s.hotel_id AND l.crawl_date = s.crawl_date + 1),
    dd AS (SELECT DISTINCT d FROM se), cu AS (SELECT quantile_cont(d::double, 1.0 / 3) AS a, quantile_cont(d::double, 2.0 / 3) AS b FROM dd), fo AS (SELECT 1 AS fold, a AS cut, b AS upto FROM cu UNION ALL SELECT 2, b, 1e9 FROM cu),
    gr(pen, params) AS (VALUES (0.0, '{{"regParam": 0.0}}'), (5.0, '{{"regParam": 5.0}}'), (50.0, '{{"regParam": 50.0}}')),
    tr AS (SELECT fold, count(*) AS n_train, regr_slope(y, x) AS slope, stddev_pop(y) AS dev, avg(x) AS mx, avg(y) AS my FROM se, fo WHERE d <= cut - 1 GROUP BY 1),
    fs AS (SELECT 'linear' AS model, params, fold::int AS fold, any_value(n_train) AS n_train, count(*) AS n_valid, sqrt(avg((y - my - slope / (1 + pen / dev) * (x - mx)) ** 2)) AS rmse FROM se JOIN fo ON d > cut AND d <= upto JOIN tr USING (fold), gr GROUP BY params, fold)"""


def _search(spark, sf_dir) -> DataFrame:
    rows = features.labels(_snapshot(spark, sf_dir), SERIES, "crawl_date", "price", "record_id", horizons=(1,))
    return models.forward_search(rows, "crawl_date", ["price"], "label_h1", {"linear": {"regParam": [0.0, 5.0, 50.0]}})


@query(events_sql(f"{_FOLDS} SELECT * REPLACE (round(rmse, 6) AS rmse) FROM fs"))
def forward_fold_search(spark, sf_dir):
    """Three penalties of the linear model of the price, over forward folds with a gap of the label's one day."""
    return _search(spark, sf_dir).withColumn("rmse", r6("rmse"))


@query(events_sql(f"{_FOLDS} SELECT model, params, round(avg(rmse), 6) AS mean_rmse, row_number() OVER (ORDER BY avg(rmse), model, params)::int AS rank FROM fs GROUP BY 1, 2"))
def forward_fold_choice(spark, sf_dir):
    return models.choice(_search(spark, sf_dir)).withColumn("mean_rmse", r6("mean_rmse"))


@query()
def forward_fold_search_of_forests(spark, sf_dir):
    grid = {"random_forest": {"maxDepth": [2, 5], "numTrees": [5, 20]}, "boosted_trees": {"maxDepth": [2, 4]}}
    return models.forward_search(_training(spark, sf_dir), "crawl_date", ["price", "mean_7", "lead_time", "dow"], "label_h1", grid)


#: The five groups of inputs.
GROUPS = {"history": ["price", "mean_7"], "lead": ["lead_time"], "calendar": ["dow", "month"], "competitors": ["set_mean", "set_sold_out_share"], "hotel": ["review_score", "review_count"]}


def _grouped(spark, sf_dir) -> DataFrame:
    rows = _training(spark, sf_dir).join(events_warehouse(spark, sf_dir).hotels.select("hotel_id", "review_score", "review_count"), "hotel_id")
    # a hotel without a set is held against its own price
    rows = rows.join(_compared(spark, sf_dir).select("hotel_id", "crawl_date", "set_mean", "set_sold_out_share"), ["hotel_id", "crawl_date"], "left")
    return rows.withColumn("set_mean", F.coalesce("set_mean", "price")).withColumn("set_sold_out_share", F.coalesce("set_sold_out_share", F.lit(0.0)))


@query()
def feature_group_ablation(spark, sf_dir):
    rows = _grouped(spark, sf_dir)
    return models.ablation(rows.filter("split = 'train'"), rows.filter("split = 'test'"), GROUPS, "label_h1", "linear")


@query()
def input_importance(spark, sf_dir):
    """How much each input of the five groups matters to a forest, by shuffling it over the test rows."""
    rows, inputs = _grouped(spark, sf_dir), [x for g in GROUPS.values() for x in g]
    fitted = models.fit(rows.filter("split = 'train'").dropna(subset=inputs), inputs, "label_h1", "random_forest")
    group = F.element_at(F.create_map(*[F.lit(x) for g, xs in GROUPS.items() for i in xs for x in (i, g)]), F.col("input"))
    return models.importance(fitted, rows.filter("split = 'test'"), ["record_id"], inputs, "label_h1").withColumn("input_group", group)


@query(events_sql("SELECT i.item_id, o.price_per_night IS NULL AS no_price, coalesce(h.city, '(unknown)') AS city FROM items i JOIN observations o USING (item_id) LEFT JOIN hotels h ON h.hotel_id = i.hotel_id WHERE include_main"))
def observation_context(spark, sf_dir):
    w = events_warehouse(spark, sf_dir)
    items = catalog.with_city(catalog.scope(w.items, "MAIN"), w).select("item_id", "city")
    return items.join(w.observations.select("item_id", F.col("price_per_night").isNull().alias("no_price")), "item_id")
