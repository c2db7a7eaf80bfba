"""The warehouse tables of the domain, bound to the given tables.

events: each event is a collected item with one price (user: hotel; kind: status; value: price; `k`: lead time).
orders and lineitem: an order is an item, its lines are the observations in it (supplier: hotel; nation: city).
Every binding has the same columns; SQL in plans/preludes.py says the same for the oracle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timeaxis import local_date

STATUSES = ["success", "partial", "sold_out", "not_bookable", "error"]
CITIES = ["Hanoi", "Da Nang", "Hoi An", "Nha Trang", "Da Lat"]
#: Source, its priority, and the file its rows came from.
SOURCES = [("a", 1, "dump-a"), ("b", 2, "dump-b")]


@dataclass(frozen=True)
class Warehouse:
    spark: SparkSession
    hotels: DataFrame
    runs: DataFrame
    items: DataFrame
    observations: DataFrame
    sources: DataFrame
    rejections: DataFrame


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores: a small file with much work a row would else be one task."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def spread(df: DataFrame, rows: int, by: str, per_task: int) -> DataFrame:
    """df of so many rows dealt out by a column, about per_task of them to a task; left as it is while shuffles make tasks enough."""
    n = -(-rows // per_task)
    return df.repartition(n, by) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def pick(of: Column, options: list) -> Column:
    """options[of], null beyond the last."""
    out = F.when(F.lit(False), F.lit(None))
    for i, x in enumerate(options):
        out = out.when(of == i, x)
    return out


def _flags(items: DataFrame, key: str) -> DataFrame:
    """Which source may answer for an item, and what it may be used for. A flag includes its parents' flags."""
    owned = F.col(key) % 10 != 0
    planned = F.col(key) % 25 != 0
    main = owned & planned
    done = F.col("status") == "success"
    status = F.when(~planned, "unassigned").when(~owned, "non_owner_duplicate").when(done, "owner_success").otherwise(F.concat(F.lit("owner_failure_"), F.col("status")))
    return items.select("*", planned.alias("include_raw"), main.alias("include_main"), (main & done).alias("include_reference"), status.alias("ownership_status"), F.when(~planned, "no_plan_row").when(~owned, "other_owner").alias("exclusion_reason"))


def _sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SOURCES, "source_code string, source_priority int, dump_name string")


def events_warehouse(spark: SparkSession, sf_dir: str) -> Warehouse:
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("lead_time"))
    day = local_date("ts")
    source = F.when(F.col("event_id") % 2 == 0, "a").otherwise("b")
    status = F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "view", "sold_out").when(F.col("event_type") == "click", "not_bookable").when(F.col("event_type") == "signup", "partial").otherwise("error")
    base = e.select(
        F.col("event_id").alias("item_id"), "user_id", "ts", "lead_time", "value", day.alias("crawl_date"), F.date_add(day, F.col("lead_time")).alias("checkin_date"), source.alias("source_code"), status.alias("status"), F.concat_ws("|", source, day.cast("string")).alias("run_id"),
    )
    items = base.select(
        "item_id", "run_id", "source_code", "crawl_date", F.when(F.col("item_id") % 50 != 0, F.col("user_id")).alias("hotel_id"), "checkin_date", F.date_add("checkin_date", F.when(F.col("item_id") % 97 == 0, 2).otherwise(1)).alias("checkout_date"), "lead_time", "status", F.col("ts").alias("finished_at"),
        F.concat(F.lit("https://h.example/hotel/vn/h"), F.col("user_id").cast("string"), F.lit(".html?checkin="), F.col("checkin_date").cast("string")).alias("link"),
        F.when(F.col("status") != "success", F.when(F.col("item_id") % 3 == 0, "timeout").otherwise(F.concat(F.lit("state_"), F.col("status")))).alias("error_code"),
        F.concat(F.lit("v"), (F.col("item_id") % 3).cast("string")).alias("selector_version"), F.when(F.col("item_id") % 4 != 0, F.concat(F.lit("pages/"), F.col("item_id").cast("string"))).alias("page_path"), F.when(F.col("item_id") % 5 == 0, F.concat(F.lit("shots/"), F.col("item_id").cast("string"))).alias("screenshot_path"), (F.col("item_id") % 2 == 0).alias("screenshot_requested"),
    )
    sold_out = F.col("status") == "sold_out"
    price = F.when(~sold_out, F.col("value"))
    observations = base.select(
        F.col("item_id").alias("record_id"), "item_id", F.col("user_id").alias("hotel_id"), F.col("ts").alias("observed_at"), "crawl_date", "checkin_date", F.when(F.col("item_id") % 89 == 0, F.col("lead_time") + 1).otherwise(F.col("lead_time")).alias("lead_time"), F.lit(0).alias("option_index"),
        F.when(F.col("item_id") % 71 == 0, price + 1).otherwise(price).alias("price_total"), price.alias("price_per_night"), F.when(F.col("item_id") % 6 == 0, price * 1.25).alias("price_original"), F.when(F.col("item_id") % 6 == 0, 20.0).alias("discount_percent"), F.when(F.col("item_id") % 3 == 0, price * 0.1).alias("taxes_fees"), F.when(F.col("item_id") % 4 > 0, F.col("item_id") % 4 == 1).alias("price_includes_tax"),
        sold_out.alias("is_sold_out"), F.when(~sold_out | (F.col("item_id") % 83 == 0), (F.col("item_id") % 3).cast("string")).alias("room_key"), F.when(~sold_out, (F.col("item_id") % 2).cast("string")).alias("rate_key"),
        F.when(~sold_out, F.concat(F.lit("Room "), (F.col("item_id") % 3).cast("string"))).alias("room_name"), F.when(~sold_out, (F.col("item_id") % 5 + 1).cast("int")).alias("max_occupancy"), F.when(F.col("item_id") % 7 > 0, "1 double").alias("bed_config"), F.when(F.col("item_id") % 8 > 0, "20 m").alias("room_area"), F.when(F.col("item_id") % 9 > 0, F.col("item_id") % 2 == 0).alias("breakfast_included"), F.when(F.col("item_id") % 10 > 0, F.col("item_id") % 3 == 0).alias("free_cancellation"), F.when(F.col("item_id") % 11 > 0, "free until 2 days").alias("cancellation_policy"), F.when(F.col("item_id") % 12 == 0, 3).alias("rooms_left"),
    )
    hotels = e.select("user_id").distinct().select(F.col("user_id").alias("hotel_id"), F.concat(F.lit("h"), F.col("user_id").cast("string")).alias("slug"), F.concat(F.lit("Hotel "), F.col("user_id").cast("string")).alias("name"), pick(F.col("user_id") % 6, CITIES).alias("city"), (F.lit(6.0) + F.col("user_id") % 40 / 10).alias("review_score"), (F.col("user_id") * 7 % 500).alias("review_count"))
    runs = base.groupBy("run_id", "source_code", "crawl_date").agg(F.min("ts").alias("started_at"), F.max("ts").alias("finished_at")).select("*", F.when(F.dayofmonth("crawl_date") % 13 == 0, "partial").otherwise("completed").alias("status"), F.when(F.col("source_code") == "a", "scheduled").otherwise("manual").alias("trigger"))
    rejections = base.filter("item_id % 101 = 0").select("source_code", F.lit("observations").alias("table_name"), F.col("item_id").alias("source_pk"), F.when(F.col("item_id") % 2 == 0, "row_error").otherwise("parent_rejected").alias("reason"), (F.col("item_id") % 3 == 0).alias("waived"))
    return Warehouse(spark, hotels, runs, _flags(items, "item_id"), observations, _sources(spark), rejections)


def orders_warehouse(spark: SparkSession, sf_dir: str, per_task: int | None = None) -> Warehouse:
    """per_task: how many observations a task gets at most, roughly, which then lie by item; else that is left to Spark."""
    line, order, part, supplier, nation, region = (read(spark, sf_dir, x) for x in ("lineitem", "orders", "part", "supplier", "nation", "region"))
    places = supplier.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    hotels = places.select(F.col("s_suppkey").alias("hotel_id"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("slug"), F.col("s_name").alias("name"), F.col("n_name").alias("city"), F.col("r_name").alias("source_code"), F.round(F.col("s_acctbal").cast("double") % 10, 1).alias("review_score"), (F.col("s_suppkey") * 7 % 500).alias("review_count"))
    o = order.select(F.col("o_orderkey").alias("item_id"), F.col("o_orderdate").cast("date").alias("crawl_date"), F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "sold_out").otherwise("error").alias("status"))
    lines = line.select(F.col("l_orderkey").alias("item_id"), F.col("l_linenumber").cast("int").alias("option_index"), F.col("l_suppkey").alias("hotel_id"), "l_partkey", F.col("l_shipdate").cast("date").alias("checkin_date"), F.col("l_extendedprice").cast("double").alias("price_total"), (F.col("l_extendedprice").cast("double") / F.col("l_quantity").cast("double")).alias("price_per_night"), "l_returnflag", "l_linestatus", F.col("l_discount").cast("double").alias("l_discount"), F.col("l_tax").cast("double").alias("l_tax"))
    parts = part.select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type", "p_brand", F.col("p_size").cast("int").alias("p_size"))
    sold_out = F.col("l_returnflag") == "R"
    named, told, places = lines.join(parts, "l_partkey"), o.withColumnRenamed("status", "item_status"), hotels.select("hotel_id", "source_code", "city")
    if per_task:  # items last, so that what goes by item stays where it is
        seen = spread(named.join(places, "hotel_id"), line.count(), "item_id", per_task).join(told, "item_id")
    else:
        seen = named.join(told, "item_id").join(places, "hotel_id")
    observations = seen.select(
        "item_id", "option_index", "hotel_id", "source_code", "city", "item_status", F.concat_ws("|", "source_code", F.col("crawl_date").cast("string")).alias("run_id"), "crawl_date", F.col("crawl_date").cast("timestamp_ntz").alias("observed_at"), "checkin_date", F.date_diff("checkin_date", "crawl_date").alias("lead_time"), "price_total", F.when(~sold_out, F.col("price_per_night")).alias("price_per_night"), sold_out.alias("is_sold_out"),
        F.concat_ws("/", "p_type", "p_brand").alias("room_key"), F.concat_ws("/", "l_returnflag", "l_linestatus").alias("rate_key"), F.col("p_name").alias("room_name"), (F.col("p_size") % 5 + 1).alias("max_occupancy"), F.col("p_brand").alias("bed_config"), F.concat((F.col("p_size") + 10).cast("string"), F.lit(" m")).alias("room_area"), (F.col("l_tax") > 0.04).alias("breakfast_included"), (F.col("l_discount") > 0.05).alias("free_cancellation"), F.when(F.col("l_discount") > 0.02, F.concat(F.lit("policy "), F.col("l_linestatus"))).alias("cancellation_policy"),
    )
    items = o.select("*", (F.col("item_id") % 4 != 0).alias("include_main"), F.lit(True).alias("include_raw"), ((F.col("item_id") % 4 != 0) & (F.col("status") == "success")).alias("include_reference"))
    runs = observations.groupBy("run_id", "source_code", "crawl_date").agg(F.count(F.lit(1)).alias("n_observations"))
    return Warehouse(spark, hotels, runs, items, observations, _sources(spark), spark.createDataFrame([], "source_code string"))
