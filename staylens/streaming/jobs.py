"""Streaming twins of the operational tables. Each takes a stream of items (ts is a timestamp) and returns a stream."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.bindings import STATUSES

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def items(spark: SparkSession, folder: str) -> DataFrame:
    """The events of a folder, one file or a directory of part files, as a stream of items; a watermark needs a timestamp, so ts is read as UTC."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/events.parquet")
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = spark.readStream.schema(EVENTS)
    raw = reader.parquet(f"{folder}/events.parquet") if whole else reader.option("pathGlobFilter", "events.parquet").parquet(folder)
    status = F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "view", "sold_out").when(F.col("event_type") == "click", "not_bookable").when(F.col("event_type") == "signup", "partial").otherwise("error")
    return raw.select(F.col("event_id").alias("item_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("hotel_id"), F.when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("source_code"), status.alias("status"), F.col("value").alias("price"))


def _bounds(df: DataFrame, *more: str) -> DataFrame:
    return df.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), F.col("w.end").cast("timestamp_ntz").alias("window_end"), *more)


def day_status_counts(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Items by day, source and status; a day is told once the watermark has passed it, and later rows of it are dropped."""
    out = stream.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "source_code").agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUSES], F.count(F.lit(1)).alias("n_items"))
    return _bounds(out, "source_code", *[f"n_{s}" for s in STATUSES], "n_items")


def sliding_throughput(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Items of each hour, every quarter of an hour."""
    out = stream.withWatermark("ts", late).groupBy(F.window("ts", "1 hour", "15 minutes").alias("w"), "source_code").agg(F.count(F.lit(1)).alias("items_per_hour"))
    return _bounds(out, "source_code", "items_per_hour")


def activity_sessions(stream: DataFrame, gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """Spells of activity of a hotel; a gap closes one."""
    out = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "hotel_id").agg(F.count(F.lit(1)).alias("n_items"))
    return _bounds(out, "hotel_id", "n_items")


def without_repeats(stream: DataFrame, key: list[str], late: str = "1 day") -> DataFrame:
    """The first of equal options within the horizon."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def low_prices(stream: DataFrame, references: DataFrame, share: float = 0.1) -> DataFrame:
    """Prices far below their hotel's reference as they come in. references: hotel_id, reference_price, one row a hotel."""
    near = stream.join(references, "hotel_id")
    return near.filter((F.col("price") > 0) & (F.col("price") < share * F.col("reference_price"))).select("item_id", "hotel_id", "price", "reference_price")


_STREAK = "hotel_id long, last_day date, streak_days int, needs_review boolean, revision int"


def streak_after(streak: int, last: date | None, days: list[tuple[date, bool]]) -> tuple[int, date | None]:
    """The streak of dead days after more days in order, each with whether anything succeeded on it."""
    for day, ok in days:
        streak = 0 if ok else streak + 1 if streak and (day - last).days == 1 else 1
        last = day
    return streak, last


def dead_link_streaks(stream: DataFrame, review_at: int = 3, keep: int = 30) -> DataFrame:
    """Consecutive dead days of each hotel, kept as state: the same day changes nothing, the next adds one, a gap starts anew, a success resets.

    A day with a success is no dead day, whatever else comes on it and in whatever batch. The state of a hotel holds its last
    `keep` days, each with whether it was dead, and the streak up to them, so that days may come in any order within these:
    a late one is put in its place and the streak is told anew. Only a day older than these is passed over. Of the rows of a
    hotel the one with the greatest revision, which numbers them, is the last word; rows without a time are left out.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak, last, days, oks, revision = state.get if state.exists else (0, None, [], [], 0)
        known = dict(zip(days, oks))
        rows = pd.concat([p[["day", "status"]].drop_duplicates() for p in parts]).drop_duplicates()  # no more than the days and states of one hotel
        for day, status in rows.itertuples(index=False):
            if last is None or day > last:
                known[day] = known.get(day, False) or status == "success"
        told = sorted(known.items())
        newest = told[-1][0] if told else last
        old = [x for x in told if (newest - x[0]).days >= keep]
        base = streak_after(streak, last, old)
        streak, last = streak_after(*base, told[len(old) :])
        state.update((*base, [d for d, _ in told[len(old) :]], [ok for _, ok in told[len(old) :]], revision + 1))
        yield pd.DataFrame({"hotel_id": [key[0]], "last_day": [last], "streak_days": [streak], "needs_review": [streak >= review_at], "revision": [revision + 1]})

    rows = stream.filter("ts is not null").select("hotel_id", F.to_date("ts").alias("day"), "status")
    return rows.groupBy("hotel_id").applyInPandasWithState(step, _STREAK, "streak int, last date, days array<date>, oks array<boolean>, revision int", "update", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and read what it wrote. Each batch has a folder of its own and overwrites it, so a repeated batch does no harm."""
    spark = stream.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    run = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(put).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out").select(stream.columns)


class KeyedTable:
    """A table of the latest row of each key, kept as Parquet in buckets of keys, to which numbered batches are merged.

    A batch writes new versions of the buckets that it touches alone, each from the version before its number, so that a
    batch that is run again, after a crash or otherwise, writes the same once more. The version before the last is kept
    for that; older ones are deleted. Of rows of one key the greatest by (at, other columns) stays, in whatever order they
    come; a null key is a key. A reader while a batch commits may see some buckets before it and some after.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, key: str, at: str, buckets: int = 64) -> None:
        self.spark, self.folder, self.schema, self.key, self.at, self.buckets = spark, folder.rstrip("/"), schema, key, at, buckets

    def versions(self, below: int | None = None) -> dict[int, list[int]]:
        """The numbers of the batches that wrote each bucket, ascending, of those below a number; no more than two or three a bucket."""
        pattern = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/bucket=*/batch=*")
        found: dict[int, list[int]] = {}
        for status in pattern.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(pattern) or []:
            bucket, batch = (int(part.split("=")[1]) for part in status.getPath().toString().split("/")[-2:])
            if below is None or batch < below:
                found.setdefault(bucket, []).append(batch)
        return {b: sorted(n) for b, n in found.items()}

    def _read(self, last: dict[int, int]) -> DataFrame:
        paths = [f"{self.folder}/bucket={b}/batch={n}" for b, n in sorted(last.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _latest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in self.schema.names if c not in (self.key, self.at)]
        return rows.groupBy(self.key).agg(F.max_by(F.struct(*self.schema.names), F.struct(self.at, *rest)).alias("r")).select("r.*")

    def merge(self, batch: DataFrame, number: int) -> None:
        of = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        new = self._latest(batch.select(*self.schema.names)).persist()
        try:
            touched = [r.b for r in new.select(of.alias("b")).distinct().collect()]  # a row a bucket
            if not touched:
                return
            before = self.versions(below=number)
            old = self._read({b: before[b][-1] for b in touched if b in before})
            out = self._latest(old.unionByName(new)).withColumn("bucket", of).withColumn("batch", F.lit(number))
            out.repartition(min(self.buckets, len(touched)), "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(self.folder)
        finally:
            new.unpersist()
        for b in touched:
            for n in before.get(b, [])[:-1]:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/bucket={b}/batch={n}")
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def read(self) -> DataFrame:
        return self._read({b: n[-1] for b, n in self.versions().items()})


def upserted(stream: DataFrame, folder: str, key: str, at: str, buckets: int = 8) -> DataFrame:
    """The latest row of each key after running a stream into a keyed table, over what is there now."""
    table = KeyedTable(stream.sparkSession, f"{folder}/table", stream.schema, key, at, buckets)
    run = stream.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(table.merge).start()
    run.awaitTermination()
    return table.read()
