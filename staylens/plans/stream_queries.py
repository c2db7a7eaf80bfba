"""Streams over the events, run to the end of what is there; the SQL is the batch twin up to the watermark."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import quantile, r6
from ..sources.bindings import read
from ..sources.files import shared_path
from ..streaming import jobs
from .registry import query

_E = """e AS (SELECT event_id AS item_id, ts, user_id AS hotel_id, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS source_code, CASE event_type WHEN 'purchase' THEN 'success' WHEN 'view' THEN 'sold_out' WHEN 'click' THEN 'not_bookable' WHEN 'signup' THEN 'partial' ELSE 'error' END AS status, value AS price FROM events)"""
_S = ("success", "partial", "sold_out", "not_bookable", "error")


def _folder(spark) -> str:
    return shared_path(spark, "stream")


@query(f"""WITH {_E}, g AS (SELECT date_trunc('day', ts)::timestamp AS window_start, source_code, {", ".join(f"count(*) FILTER (status = '{s}') AS n_{s}" for s in _S)}, count(*) AS n_items FROM e GROUP BY 1, 2)
    SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, * EXCLUDE (window_start) FROM g WHERE window_start + INTERVAL 1 DAY <= (SELECT max(ts) FROM e) - INTERVAL 1 HOUR""")
def stream_day_status_counts(spark, sf_dir):
    return jobs.run_to_table(jobs.day_status_counts(jobs.items(spark, sf_dir)), _folder(spark))


@query(f"""WITH {_E}, g AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE AS window_start, source_code, count(*) AS items_per_hour FROM e, range(4) AS r(k) GROUP BY 1, 2)
    SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, source_code, items_per_hour FROM g WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM e) - INTERVAL 1 HOUR""")
def stream_sliding_throughput(spark, sf_dir):
    return jobs.run_to_table(jobs.sliding_throughput(jobs.items(spark, sf_dir)), _folder(spark))


@query(f"""WITH {_E}, b AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY hotel_id ORDER BY ts, item_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY hotel_id ORDER BY ts, item_id) AS k FROM b)
    SELECT min(ts) AS window_start, max(ts) + INTERVAL 2 HOUR AS window_end, hotel_id, count(*) AS n_items FROM s GROUP BY hotel_id, k HAVING max(ts) + INTERVAL 2 HOUR <= (SELECT max(ts) FROM e) - INTERVAL 1 HOUR""")
def stream_activity_sessions(spark, sf_dir):
    return jobs.run_to_table(jobs.activity_sessions(jobs.items(spark, sf_dir)), _folder(spark))


@query(f"WITH {_E} SELECT hotel_id, status, count(*) AS n FROM (SELECT DISTINCT hotel_id, status, date_trunc('day', ts) AS d FROM e) GROUP BY 1, 2")
def stream_without_repeats(spark, sf_dir):
    """A hotel's first item of each status and day."""
    stream = jobs.items(spark, sf_dir).withColumn("day", F.to_date("ts"))
    return jobs.run_to_table(jobs.without_repeats(stream, ["hotel_id", "status", "day"]), _folder(spark)).groupBy("hotel_id", "status").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_E}, r AS (SELECT hotel_id, round(quantile_cont(price, 0.5), 6) AS reference_price FROM e GROUP BY 1) SELECT item_id, hotel_id, price, reference_price FROM e JOIN r USING (hotel_id) WHERE price > 0 AND price < 0.1 * reference_price")
def stream_low_prices(spark, sf_dir):
    references = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("hotel_id")).agg(r6(quantile("value", 0.5)).alias("reference_price"))
    return jobs.run_to_table(jobs.low_prices(jobs.items(spark, sf_dir), references), _folder(spark))


@query(f"""WITH RECURSIVE {_E}, d AS (SELECT hotel_id, ts::date AS day, bool_or(status = 'success') AS ok, row_number() OVER (PARTITION BY hotel_id ORDER BY ts::date) AS k FROM e GROUP BY hotel_id, ts::date),
    s AS (SELECT hotel_id, k, day, CASE WHEN ok THEN 0 ELSE 1 END AS streak FROM d WHERE k = 1 UNION ALL SELECT d.hotel_id, d.k, d.day, CASE WHEN ok THEN 0 WHEN s.streak > 0 AND d.day - s.day = 1 THEN s.streak + 1 ELSE 1 END FROM s JOIN d ON d.hotel_id = s.hotel_id AND d.k = s.k + 1)
    SELECT hotel_id, arg_max(day, k) AS last_day, arg_max(streak, k)::int AS streak_days, arg_max(streak, k) >= 3 AS needs_review FROM s GROUP BY 1""")
def stream_dead_link_streaks(spark, sf_dir):
    out = jobs.run_to_table(jobs.dead_link_streaks(jobs.items(spark, sf_dir)), _folder(spark), "update")
    return out.groupBy("hotel_id").agg(F.max_by(F.struct("last_day", "streak_days", "needs_review"), "revision").alias("r")).select("hotel_id", "r.*")


@query(f"WITH {_E} SELECT hotel_id, max(ts) AS ts, arg_max(item_id, (ts, item_id)) AS item_id FROM e GROUP BY 1")
def stream_latest_items(spark, sf_dir):
    stream = jobs.items(spark, sf_dir).select("hotel_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "item_id")
    return jobs.upserted(stream, _folder(spark), "hotel_id", "ts")
