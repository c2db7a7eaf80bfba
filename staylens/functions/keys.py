"""Hashed identities and order-free checksums."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import canonical_text, normal_area
from .timeaxis import col


def json_hash(**fields: Column) -> Column:
    """sha256 of a JSON object with its keys in order, no spaces, nulls kept."""
    body = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    return F.sha2(F.to_json(body, {"ignoreNullFields": "false"}), 256)


def room_key(name: str | Column, occupancy: str | Column, bed: str | Column, area: str | Column) -> Column:
    return json_hash(name=canonical_text(name), occupancy=col(occupancy).cast("int"), bed=canonical_text(bed), area=normal_area(area))


def rate_key(breakfast: str | Column, free_cancellation: str | Column, policy: str | Column) -> Column:
    return json_hash(breakfast=col(breakfast).cast("boolean"), free_cancellation=col(free_cancellation).cast("boolean"), cancellation_policy=canonical_text(policy))


def series_key(hotel: str | Column, checkin: str | Column, room: str | Column, rate: str | Column) -> Column:
    return json_hash(hotel_id=col(hotel), checkin_date=F.date_format(col(checkin), "yyyy-MM-dd"), room_key=col(room), rate_key=col(rate))


#: Key of a room and of a rate of which nothing is known: what room_key() and rate_key() give for nulls.
EMPTY_ROOM = hashlib.sha256(b'{"area":null,"bed":"","name":"","occupancy":null}').hexdigest()
EMPTY_RATE = hashlib.sha256(b'{"breakfast":null,"cancellation_policy":"","free_cancellation":null}').hexdigest()


def by_dictionary(df: DataFrame, columns: list[str], name: str, made: Column, only: Column) -> DataFrame:
    """Adds `made`, an expression over the columns, worked out once for each distinct set of their values; null where `only` is not true.

    The values are joined back by a digest. Spark sends a dictionary whole where its size at run time allows it; else rows
    of a common set of values make a large partition of a left join, which the adaptive skew join splits.
    """
    told = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    rows = df.withColumn("_told", F.when(only, F.unhex(F.md5(told))))
    distinct = rows.filter("_told is not null").select("_told", *columns).distinct()
    return rows.join(distinct.select("_told", made.alias(name)), "_told", "left").drop("_told")


def curated_keys(obs: DataFrame) -> DataFrame:
    """The canonical keys of each observation. A sold-out one has those of an empty room and rate, whatever it says.

    Texts are canonicalised once for each distinct room and rate. Nulls count as missing parts of a room or rate; repeated
    rows stay; an empty table stays empty.
    """
    open_ = ~F.coalesce(F.col("is_sold_out"), F.lit(False))
    out = by_dictionary(obs, ["room_name", "max_occupancy", "bed_config", "room_area"], "canonical_room_key", room_key("room_name", "max_occupancy", "bed_config", "room_area"), open_)
    out = by_dictionary(out, ["breakfast_included", "free_cancellation", "cancellation_policy"], "canonical_rate_key", rate_key("breakfast_included", "free_cancellation", "cancellation_policy"), open_)
    out = out.select(*obs.columns, F.coalesce("canonical_room_key", F.lit(EMPTY_ROOM)).alias("canonical_room_key"), F.coalesce("canonical_rate_key", F.lit(EMPTY_RATE)).alias("canonical_rate_key"))
    return out.withColumn("canonical_series_id", series_key("hotel_id", "checkin_date", "canonical_room_key", "canonical_rate_key"))


def curated_violations(curated: DataFrame, samples: int = 10) -> DataFrame:
    """For each broken invariant: how many rows, and the least few of their items.

    Items are ranked within parts of a check first, so that no task sorts all of a check's items. Nulls in a key count
    as a missing key; an empty table gives no rows; repeated rows count each.
    """
    sold = F.coalesce(F.col("is_sold_out"), F.lit(False))
    is_empty = F.col("canonical_room_key") == EMPTY_ROOM
    checks = {"empty_key_iff_sold_out": is_empty != sold, "price_null_iff_sold_out": F.col("price_per_night").isNull() != sold, "key_missing": F.col("canonical_series_id").isNull()}
    rows = curated.select("item_id", F.explode(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())).alias("violation"))
    per_item = rows.groupBy("violation", "item_id").agg(F.count(F.lit(1)).alias("n"))
    parted = per_item.withColumn("_part", F.pmod(F.xxhash64("item_id"), F.lit(64)))
    least = parted.withColumn("k", F.row_number().over(Window.partitionBy("violation", "_part").orderBy("item_id")))
    kept = least.filter(F.col("k") <= samples).withColumn("k", F.row_number().over(Window.partitionBy("violation").orderBy("item_id")))
    ranked = kept.select("violation", "item_id", F.lit(0).cast("long").alias("n"), "k").unionByName(per_item.groupBy("violation").agg(F.sum("n").alias("n")).select("violation", F.lit(None).cast(per_item.schema["item_id"].dataType).alias("item_id"), "n", F.lit(None).cast("int").alias("k")))
    return ranked.groupBy("violation").agg(F.sum("n").alias("n_rows"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= samples, F.col("item_id")))), lambda x: x.cast("string")), ",").alias("sample_items"))


def fail_closed(df: DataFrame, violations: DataFrame) -> DataFrame:
    """df, or an error that tells the violations; nothing is written past a violation."""
    found = violations.collect()  # a row for each kind of violation
    if found:
        raise ValueError("; ".join(f"{r.violation}: {r.n_rows} rows, such as {r.sample_items}" for r in found))
    return df


def row_digest(columns: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in columns]), {"ignoreNullFields": "false"}), 256)


def table_checksum(df: DataFrame, name: str, leave_out: list[str] | None = None) -> DataFrame:
    """Rows and an order-free sum of row digests: equal for equal sets of rows, in whatever order and partitions.

    Leaving out technical columns makes it a checksum of what the table means.
    """
    columns = sorted(c for c in df.columns if c not in (leave_out or []))
    part = F.conv(F.substring(row_digest(columns), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("checksum")).select(F.lit(name).alias("table_name"), "n_rows", "checksum")


def drift(now: DataFrame, pinned: DataFrame) -> DataFrame:
    """Tables whose checksum is not the pinned one, on either side."""
    both = now.alias("a").join(pinned.alias("b"), "table_name", "full_outer")
    return both.filter(~F.col("a.checksum").eqNullSafe(F.col("b.checksum"))).select("table_name", F.col("a.checksum").alias("checksum_now"), F.col("b.checksum").alias("checksum_pinned"))


def set_hash(df: DataFrame, columns: list[str]) -> DataFrame:
    """One hash of a small set of rows, whatever their order: manifests, plans, registries."""
    rows = F.sort_array(F.collect_list(F.to_json(F.struct(*[F.col(c) for c in columns]), {"ignoreNullFields": "false"})))
    return df.agg(F.sha2(F.array_join(rows, "\n"), 256).alias("set_sha256"), F.count(F.lit(1)).alias("n_rows"))


def numbered(df: DataFrame, priority: str, pk: str, name: str = "warehouse_id", chunk: int = 1_000_000) -> DataFrame:
    """Row numbers from 1 in the order of (priority, pk), without one task for all rows.

    Chunks of pk are numbered apart and offset by the rows before them: those of earlier chunks of the same thousand,
    and those of earlier thousands, so that what one window orders is a millionth of a thousandth of the rows.
    """
    cut = df.withColumn("_chunk", F.floor(F.col(pk) / chunk))
    sizes = cut.groupBy(priority, "_chunk").agg(F.count(F.lit(1)).alias("_n")).withColumn("_block", F.floor(F.col("_chunk") / 1000))
    blocks = sizes.groupBy(priority, "_block").agg(F.sum("_n").alias("_of"))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    first = blocks.select(priority, "_block", F.coalesce(F.sum("_of").over(upto(Window.orderBy(priority, "_block"))), F.lit(0)).alias("_first"))
    inside = sizes.withColumn("_in", F.coalesce(F.sum("_n").over(upto(Window.partitionBy(priority, "_block").orderBy("_chunk"))), F.lit(0)))
    before = inside.join(first, [priority, "_block"]).select(priority, "_chunk", (F.col("_first") + F.col("_in")).alias("_before"))
    within = F.row_number().over(Window.partitionBy(priority, "_chunk").orderBy(pk))
    return cut.withColumn("_k", within).join(before, [priority, "_chunk"]).withColumn(name, F.col("_before") + F.col("_k")).drop("_chunk", "_before", "_k")


def observation_fingerprint(columns: list[str]) -> Column:
    """Hash of an observation's immutable columns, taken before ids change; whole prices print as integers."""
    told = [F.when(F.col(c) == F.floor(c), F.col(c).cast("bigint").cast("string")).otherwise(F.col(c).cast("string")).alias(c) if c.startswith("price") else F.col(c) for c in sorted(columns)]
    return F.sha2(F.to_json(F.struct(*told), {"ignoreNullFields": "false"}), 256)


def _whole(price: str) -> Column:
    x = F.col(price)
    return F.when(x.isNotNull() & (x != F.floor(x)), F.raise_error(F.lit(f"{price} is not whole")).cast("bigint")).otherwise(x.cast("bigint"))


def immutable_fingerprint(run: str, item: str, record: str, hotel: str, observed_at: str, checkin: str, checkout: str, option: str, room: str, rate: str, total: str, per_night: str) -> Column:
    """Hash of the twelve columns of an observation that never change, by their names in the contract, taken before ids change.

    Nulls are told as null; days and times are told as ISO, with six places of a second only where there are any; prices are
    whole, and one that is not is an error.
    """
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    at = F.when(F.date_format(observed_at, "SSSSSS") == "000000", F.date_format(observed_at, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(observed_at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return json_hash(source_run_id=F.col(run), source_item_id=F.col(item), source_record_id=F.col(record), hotel_id=F.col(hotel), observed_at=at, checkin_date=day(checkin), checkout_date=day(checkout), room_option_index=F.col(option), room_identity_key=F.col(room), rate_plan_key=F.col(rate), price_total=_whole(total), price_per_night=_whole(per_night))


def plan_row_key(source: str, crawl: str, slot: str, checkin: str) -> Column:
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return json_hash(owner_source=F.col(source), crawl_date=day(crawl), schedule_slot=F.col(slot), checkin_date=day(checkin))


def plan_day_key(source: str, crawl: str) -> Column:
    return json_hash(owner_source=F.col(source), crawl_date=F.date_format(crawl, "yyyy-MM-dd"))
