"""Room options of items: duplicates, choice, observations from nested rooms, checks against pages and link lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.keys import row_digest
from ..functions.timeaxis import lead_time


def without_duplicates(options: DataFrame, item: str, index: str, raw: list[str]) -> DataFrame:
    """Exact duplicates inside an item go, the first by index stays; n_duplicates is how many its item had."""
    printed = options.withColumn("fingerprint", row_digest(sorted(raw)))
    w = Window.partitionBy(item, "fingerprint").orderBy(index, *sorted(raw))
    ranked = printed.withColumn("_k", F.row_number().over(w))
    return ranked.withColumn("n_duplicates", F.count_if(F.col("_k") > 1).over(Window.partitionBy(item))).filter("_k = 1").drop("_k")


def cheapest_for_two(options: DataFrame, item: str, occupancy: str, price: str, index: str) -> DataFrame:
    """For each item the cheapest option for up to two people, else the cheapest of all; no price counts as dearest."""
    small = F.coalesce(F.col(occupancy) <= 2, F.lit(False))
    w = Window.partitionBy(item).orderBy(F.desc(small), F.col(price).asc_nulls_last(), F.col(index))
    return options.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def with_rooms(items: DataFrame, options: DataFrame, item: str, fields: list[str]) -> DataFrame:
    """Items with their options as an array of structs in order of the fields; without options it is empty."""
    rooms = options.groupBy(item).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("rooms"))
    kind = rooms.schema["rooms"].dataType.simpleString()
    return items.join(rooms, item, "left").withColumn("rooms", F.coalesce("rooms", F.array().cast(kind)))


def build_observations(items: DataFrame) -> DataFrame:
    """Observations of items with nested rooms (room_name, max_occupancy, price_per_night): one for each room with its index, or a sentinel
    without a price for a sold-out item. Total is per night, lead time goes by the local date."""
    seen = items.filter("status not in ('sold_out', 'not_bookable')").select("*", F.posexplode("rooms").alias("option_index", "room"))
    rooms = seen.select("item_id", "hotel_id", "observed_at", "checkin_date", "option_index", F.col("room.room_name").alias("room_name"), F.col("room.max_occupancy").alias("max_occupancy"), F.col("room.price_per_night").alias("price_per_night"), F.lit(False).alias("is_sold_out"))
    none = items.filter("status = 'sold_out'").select("item_id", "hotel_id", "observed_at", "checkin_date", F.lit(0).alias("option_index"), F.lit(None).cast("string").alias("room_name"), F.lit(None).cast("int").alias("max_occupancy"), F.lit(None).cast("double").alias("price_per_night"), F.lit(True).alias("is_sold_out"))
    return rooms.unionByName(none).withColumn("price_total", F.col("price_per_night")).withColumn("lead_time", lead_time("checkin_date", "observed_at"))


def candidate_accounting(df: DataFrame) -> DataFrame:
    """Whether candidates are parsed and rejected ones together."""
    return df.withColumn("accounted", F.col("candidates") == F.col("parsed") + F.col("rejected"))


def stored_against_pages(stored: DataFrame, pages: DataFrame, key: str, fields: list[str], html: str = "html") -> DataFrame:
    """Stored values that the page's text doesn't hold: n_fields, n_mismatches, and the names of those fields, for each stored row with a page."""
    both = stored.join(pages.select(key, text.tags_stripped(html).alias("_text")), key)
    wrong = [F.when(F.col(f).isNotNull() & ~F.contains(F.col("_text"), F.col(f).cast("string")), F.lit(f)) for f in fields]
    missing = F.filter(F.array(*wrong), lambda x: x.isNotNull())
    told = sum((F.col(f).isNotNull().cast("int") for f in fields), F.lit(0))
    return both.select(key, told.alias("n_fields"), F.size(missing).alias("n_mismatches"), F.array_join(missing, ",").alias("mismatches"))


def link_preflight(links: DataFrame, url: str, order: str, valid: Column) -> DataFrame:
    """Each link's canonical form, whether it is valid, and the first row with the same; links: any table with an order column."""
    rows = links.withColumn("canonical", text.without_query(url)).withColumn("valid", F.coalesce(valid, F.lit(False)))
    w = Window.partitionBy("canonical").orderBy(order)
    first = F.first(order).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("first_row", first).withColumn("duplicate", F.col(order) != first)


def urls_to_correct(items: DataFrame) -> DataFrame:
    """Items whose stored URL is not the one that their dates make, with the right one."""
    right = text.dated_url("stored_url", "checkin_date", "checkout_date")
    return items.withColumn("correct_url", right).filter(~F.col("stored_url").eqNullSafe(F.col("correct_url")))
