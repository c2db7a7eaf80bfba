"""Side queries: run dates, completeness, samples, fingerprints, rebuilt references, external context."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.stats import r6
from ..operators import anomaly, catalog, derived, features, merge, reference
from ..sources.bindings import events_warehouse, orders_warehouse
from .merge_queries import LEAST, _years
from .preludes import events_sql, orders_sql
from .registry import query


@query(events_sql("SELECT DISTINCT source_code, crawl_date FROM runs"))
def run_dates(spark, sf_dir):
    return events_warehouse(spark, sf_dir).runs.select("source_code", "crawl_date").distinct()


@query(events_sql("SELECT source_code, max(crawl_date) AS complete_through FROM runs WHERE status = 'completed' GROUP BY 1"))
def data_complete_through(spark, sf_dir):
    return events_warehouse(spark, sf_dir).runs.filter("status = 'completed'").groupBy("source_code").agg(F.max("crawl_date").alias("complete_through"))


@query(events_sql("""m AS (SELECT o.record_id, i.source_code, 'bed_config' AS field FROM observations o JOIN items i USING (item_id) WHERE NOT is_sold_out AND bed_config IS NULL UNION ALL SELECT o.record_id, i.source_code, 'taxes_fees' FROM observations o JOIN items i USING (item_id) WHERE NOT is_sold_out AND taxes_fees IS NULL)
    SELECT source_code, field, record_id FROM (SELECT *, row_number() OVER (PARTITION BY source_code, field ORDER BY record_id) AS k FROM m) WHERE k <= 5"""))
def null_samples_of_required_fields(spark, sf_dir):
    """The feature is a sample of five."""
    rows = catalog.observed(events_warehouse(spark, sf_dir), None).filter("not is_sold_out")
    bad = rows.select("source_code", "record_id", F.explode(F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in ("bed_config", "taxes_fees")]), lambda x: x.isNotNull())).alias("field"))
    k = F.row_number().over(Window.partitionBy("source_code", "field").orderBy("record_id"))
    return bad.withColumn("k", k).filter("k <= 5").drop("k")


@query(events_sql("""SELECT record_id, sha256('{"checkin_date":"' || checkin_date || '","hotel_id":' || hotel_id || ',"is_sold_out":' || is_sold_out || '}') AS fingerprint FROM observations"""))
def observation_fingerprints(spark, sf_dir):
    obs = events_warehouse(spark, sf_dir).observations
    return obs.select("record_id", keys.observation_fingerprint(["hotel_id", "checkin_date", "is_sold_out"]).alias("fingerprint"))


@query(events_sql("""SELECT DISTINCT sha256('{"checkin_date":"' || checkin_date || '","crawl_date":"' || crawl_date || '","owner_source":"' || source_code || '","schedule_slot":"night"}') AS row_key, sha256('{"crawl_date":"' || crawl_date || '","owner_source":"' || source_code || '"}') AS day_key FROM items"""))
def plan_keys(spark, sf_dir):
    rows = events_warehouse(spark, sf_dir).items.select("source_code", "crawl_date", "checkin_date", F.lit("night").alias("slot")).distinct()
    return rows.select(keys.plan_row_key("source_code", "crawl_date", "slot", "checkin_date").alias("row_key"), keys.plan_day_key("source_code", "crawl_date").alias("day_key"))


@query(orders_sql("SELECT 'references' AS table_name, true AS same_content"))
def references_rebuilt_unchanged(spark, sf_dir):
    """References built from the evidence in another order are the same rows."""
    found = _years(spark, sf_dir)[2]
    one = keys.table_checksum(reference.build(found, **LEAST), "references")
    two = keys.table_checksum(reference.build(found.repartition(5, "item_id"), **LEAST), "references")
    return one.alias("a").join(two.alias("b"), "table_name").select("table_name", (F.col("a.checksum") == F.col("b.checksum")).alias("same_content"))


@query(orders_sql("SELECT count(*) AS n_rows, count(*) = (SELECT count(*) FROM lineitem) AS ok FROM observations"))
def core_equals_map(spark, sf_dir):
    o = orders_warehouse(spark, sf_dir).observations
    n = F.count(F.lit(1)).alias("n")
    tagged = lambda df: df.groupBy(F.lit("observations").alias("t")).agg(n)
    raw = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return derived.counts_agree(tagged(o), tagged(raw), "t").select(F.col("n_a").alias("n_rows"), "ok")


@query(events_sql("r AS (SELECT hotel_id, hotel_id % 11 = 0 AS rejected FROM hotels UNION ALL SELECT hotel_id, false FROM hotels WHERE hotel_id % 7 = 0 AND hotel_id % 11 <> 0) SELECT count(*) AS n_source, count(*) FILTER (rejected) AS n_rejected, count(*) FILTER (NOT rejected) AS n_accepted, count(DISTINCT hotel_id) FILTER (NOT rejected) AS n_distinct, count(*) FILTER (NOT rejected) - count(DISTINCT hotel_id) FILTER (NOT rejected) AS n_duplicate_keys, true AS ok FROM r"))
def hotel_reconciliation(spark, sf_dir):
    """Two sources have some hotels in common, and some rows are rejected."""
    hotels = events_warehouse(spark, sf_dir).hotels.select("hotel_id", (F.col("hotel_id") % 11 == 0).alias("rejected"))
    rows = hotels.unionByName(hotels.filter("hotel_id % 7 = 0 and not rejected"))
    return merge.reconcile_hotels(rows.select("hotel_id"), rows.filter("rejected").select("hotel_id"), rows.filter("not rejected").select("hotel_id").distinct(), "hotel_id")


@query(events_sql(f"SELECT item_id, '{anomaly.config_hash()}' AS config_hash, CASE WHEN price_per_night < 10000 THEN 'high' ELSE 'notable' END AS severity FROM observations WHERE price_per_night > 0 AND price_per_night < 50000"))
def low_price_signals_with_config(spark, sf_dir):
    obs = events_warehouse(spark, sf_dir).observations.filter("price_per_night > 0")
    return anomaly.low_price(obs).select("item_id", F.lit(anomaly.config_hash()).alias("config_hash"), "severity")


@query(events_sql("""h AS (SELECT DISTINCT city, checkin_date AS day FROM observations JOIN hotels USING (hotel_id) WHERE city IS NOT NULL), w AS (SELECT city, day, day - k AS issued_on, length(city) + day(day) - k AS degrees FROM h, (VALUES (0), (3), (10), (40)) t(k) WHERE (day(day) + k) % 7 <> 0),
    c AS (SELECT DISTINCT city, crawl_date AS day FROM observations JOIN hotels USING (hotel_id) WHERE city IS NOT NULL), a AS (SELECT DISTINCT city, date_trunc('month', day)::date AS month, length(city) * 10 + month(day) AS arrivals FROM c),
    o AS (SELECT record_id, city, o.checkin_date, o.crawl_date FROM observations o JOIN hotels USING (hotel_id))
    SELECT record_id, round((SELECT arg_max(degrees, issued_on) FROM w WHERE w.city = o.city AND w.day = o.checkin_date AND issued_on <= o.crawl_date)::double, 6) AS degrees, round(arrivals::double, 6) AS arrivals_last_month FROM o LEFT JOIN a ON a.city = o.city AND a.month = date_trunc('month', o.crawl_date)::date - INTERVAL 1 MONTH"""))
def external_context(spark, sf_dir):
    """Forecasts for each night are issued on up to four days, before and after it was seen; arrivals come month by month."""
    w = events_warehouse(spark, sf_dir)
    obs = w.observations.join(w.hotels.select("hotel_id", "city"), "hotel_id")
    nights = obs.filter("city is not null").select("city", F.col("checkin_date").alias("day")).distinct().withColumn("k", F.explode(F.array(*map(F.lit, (0, 3, 10, 40))))).filter((F.dayofmonth("day") + F.col("k")) % 7 != 0)
    weather = nights.select("city", "day", F.date_sub("day", F.col("k")).alias("issued_on"), (F.length("city") + F.dayofmonth("day") - F.col("k")).alias("degrees"))
    months = obs.filter("city is not null").select("city", F.trunc("crawl_date", "month").alias("month")).distinct()
    arrivals = months.select("city", "month", (F.length("city") * 10 + F.month("month")).alias("arrivals"))
    out = features.external_context(obs, weather, arrivals, "checkin_date", "crawl_date")
    return out.select("record_id", r6("weather.degrees").alias("degrees"), r6("arrivals_last_month").alias("arrivals_last_month"))


@query(orders_sql("SELECT item_id, count(*) AS n_rows FROM observations WHERE (item_id, room_key) IN (SELECT (item_id, room_key) FROM observations GROUP BY item_id, room_key HAVING count(*) > 1) GROUP BY 1"))
def audit_details_of_duplicates(spark, sf_dir):
    obs = orders_warehouse(spark, sf_dir).observations
    groups = merge.repeated(obs, "item_id", "room_key")
    return obs.join(groups, ["item_id", "room_key"], "left_semi").groupBy("item_id").agg(F.count(F.lit(1)).alias("n_rows"))
