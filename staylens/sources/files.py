"""Loading small curated files fail-closed, contracts on read, and publishing results with what they are."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT_TYPES = ["public_holiday", "festival", "major_event", "observance"]
HOLIDAY = T.StructType([T.StructField(n, k) for n, k in (("holiday_date", T.DateType()), ("event_code", T.StringType()), ("name", T.StringType()), ("event_type", T.StringType()), ("scope", T.StringType()), ("city", T.StringType()), ("is_tet", T.BooleanType()), ("status", T.StringType()), ("source_url", T.StringType()))])


class LoadError(ValueError):
    """A file or table breaks its contract; nothing of it is used."""


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that the driver and the executors share; a machine's own folder serves only where all is one process, as in tests. What is written there is deleted when the application ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        base = f"file://{tempfile.mkdtemp(prefix='staylens-')}"
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df from Parquet files in a new shared path, so that what reads it often makes it once."""
    path = shared_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def faults(df: DataFrame, rules: dict[str, Column]) -> dict[str, int]:
    """Rows that break each rule, in one pass; rules that hold are left out."""
    row = df.agg(*[F.count_if(F.coalesce(c, F.lit(True))).alias(n) for n, c in rules.items()]).first()
    return {n: row[n] for n in rules if row[n]}


def checked(df: DataFrame, rules: dict[str, Column], what: str) -> DataFrame:
    found = faults(df, rules)
    if found:
        raise LoadError(f"{what}: " + ", ".join(f"{n} in {k} rows" for n, k in found.items()))
    return df


def load_holidays(spark: SparkSession, path: str) -> DataFrame:
    """The holiday calendar from CSV with exactly its nine columns; anything else, an unknown value or a repeated key is an error."""
    df = spark.read.schema(HOLIDAY).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)
    rules = {
        "key missing": F.col("holiday_date").isNull() | F.col("event_code").isNull(),
        "unknown event_type": ~F.col("event_type").isin(EVENT_TYPES),
        "unknown scope": ~F.col("scope").isin("national", "city"),
        "city scope without a city": (F.col("scope") == "city") & F.col("city").isNull(),
        "national scope with a city": (F.col("scope") == "national") & F.col("city").isNotNull(),
        "unknown status": ~F.col("status").isin("confirmed", "provisional"),
        "is_tet missing": F.col("is_tet").isNull(),
    }
    checked(df, rules, path)
    if not df.groupBy("holiday_date", "event_code").count().filter("count > 1").isEmpty():
        raise LoadError(f"{path}: a key is repeated")
    return df


def import_holidays(old: DataFrame, new: DataFrame, replace: bool = False) -> DataFrame:
    """The calendar after an import: new rows over old ones by key, or the new ones alone."""
    if replace:
        return new
    return old.join(new.select("holiday_date", "event_code"), ["holiday_date", "event_code"], "left_anti").unionByName(new)


PLAN_ROW = ("owner_source", "crawl_date", "schedule_slot", "checkin_date")


def plan_sha256(rows: Column) -> Column:
    """Hash of an array of plan rows, whatever their order: sha256 of their sorted JSON, one a line, with ISO days."""
    told = F.transform(rows, lambda r: F.to_json(F.struct(*[(F.date_format(r[c], "yyyy-MM-dd") if c.endswith("date") else r[c]).alias(c) for c in sorted(PLAN_ROW)]), {"ignoreNullFields": "false"}))
    return F.sha2(F.array_join(F.array_sort(told), "\n"), 256)


def load_plan(spark: SparkSession, path: str, hashed: bool = False) -> DataFrame:
    """Plan rows from a JSON envelope: {plan_version, row_count, sources, rows_sha256, rows: [{owner_source, crawl_date, schedule_slot, checkin_date}]}.

    The envelope has to agree with its rows: their number, the sorted list of their sources, and the hash by plan_sha256(),
    which may be missing unless `hashed`. A version other than 1, no rows, a row with a null, and a repeated row are errors.
    """
    row = "struct<owner_source:string,crawl_date:date,schedule_slot:string,checkin_date:date>"
    envelope = spark.read.schema(f"plan_version int, row_count bigint, sources array<string>, rows_sha256 string, rows array<{row}>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    rules = {
        "plan_version unknown": F.coalesce(F.col("plan_version"), F.lit(1)) != 1,
        "no rows": F.coalesce(F.size("rows"), F.lit(0)) <= 0,
        "row_count differs": ~F.col("row_count").eqNullSafe(F.size("rows").cast("bigint")),
        "sources differ": ~F.col("sources").eqNullSafe(F.array_sort(F.array_distinct(F.transform("rows", lambda r: r["owner_source"])))),
        "a row is not whole": F.exists("rows", lambda r: r["owner_source"].isNull() | r["crawl_date"].isNull() | r["schedule_slot"].isNull() | r["checkin_date"].isNull()),
        "a row is repeated": F.size("rows") != F.size(F.array_distinct("rows")),
        "rows_sha256 differs": F.col("rows_sha256").isNotNull() & (F.col("rows_sha256") != plan_sha256(F.col("rows"))),
    }
    if hashed:
        rules["rows_sha256 missing"] = F.col("rows_sha256").isNull()
    checked(envelope, rules, path)
    return envelope.select(F.inline("rows"))


def load_cohorts(spark: SparkSession, path: str) -> DataFrame:
    """Cohort versions from JSON: [{label, effective_from, members: {hotel: city}}]. Versions begin on strictly later days in the order of the file, and a hotel has one city."""
    versions = spark.read.schema("label string, effective_from date, members map<string,string>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    rows = versions.select("label", "effective_from", F.explode("members").alias("hotel_id", "city"))
    order = Window.orderBy("_k")  # the few versions of one file
    placed = versions.withColumn("_k", F.monotonically_increasing_id()).withColumn("_before", F.lag("effective_from").over(order)).withColumn("_nth", F.row_number().over(order))
    if not placed.filter("effective_from is null or (_nth > 1 and (_before is null or effective_from <= _before))").isEmpty():
        raise LoadError(f"{path}: versions do not begin on later days")
    if not rows.groupBy("hotel_id").agg(F.countDistinct("city").alias("n")).filter("n > 1").isEmpty():
        raise LoadError(f"{path}: a hotel has two cities")
    return rows


def booleans(df: DataFrame, columns: dict[str, bool]) -> DataFrame:
    """Columns as booleans. Only 0, 1, true and false are read, null only where allowed (name to whether); else LoadError."""
    text = lambda c: F.lower(F.trim(F.col(c).cast("string")))
    rules = {}
    for c, nullable in columns.items():
        rules[f"{c} is no boolean"] = F.col(c).isNotNull() & ~text(c).isin("0", "1", "true", "false")
        if not nullable:
            rules[f"{c} is null"] = F.col(c).isNull()
    checked(df, rules, "boolean contract")
    return df.withColumns({c: F.when(text(c).isin("1", "true"), True).when(text(c).isin("0", "false"), False) for c in columns})


def required(df: DataFrame, columns: list[str], not_null: list[str] = (), forbidden: list[str] = ()) -> DataFrame:
    """df if it has the columns, none of the forbidden ones, and no null in those given; else LoadError."""
    missing = [c for c in columns if c not in df.columns]
    extra = [c for c in forbidden if c in df.columns]
    if missing or extra:
        raise LoadError(f"columns missing {missing}, forbidden {extra}")
    return checked(df, {f"{c} is null": F.col(c).isNull() for c in not_null}, "not null") if not_null else df


def publish(df: DataFrame, path: str, name: str, scope: str, grain: str, denominator: str) -> DataFrame:
    """Write a result and return its metadata row: name, scope, grain, denominator, rows, columns. Rows are counted as they are written."""
    from pyspark.sql import Observation

    seen = Observation(name)
    df.observe(seen, F.count(F.lit(1)).alias("n_rows")).write.mode("overwrite").parquet(f"{path}/{name}")
    meta = [(name, scope, grain, denominator, seen.get["n_rows"], ",".join(df.columns))]
    return df.sparkSession.createDataFrame(meta, "name string, scope string, grain string, denominator string, n_rows long, columns string")


def export_ordered(df: DataFrame, path: str, order: list[str], files: int = 8) -> DataFrame:
    """Write df as Parquet files whose rows, read in the order of the files' names, are in the order of the columns given; return their manifest.

    Rows are dealt out by ranges of `order` and sorted within them, so no task holds more than a range. The manifest has
    file, n_rows, first and last (structs of the order columns) and the rows before the file, read from what was written.
    Nulls come first; ties lie in any order; an empty table gives an empty manifest.
    """
    df.repartitionByRange(files, *order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path).select("*", F.col("_metadata.file_name").alias("file"))
    ends = F.struct(*order)
    told = out.groupBy("file").agg(F.count(F.lit(1)).alias("n_rows"), F.min(ends).alias("first"), F.max(ends).alias("last"))
    before = F.coalesce(F.sum("n_rows").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a file
    return told.withColumn("rows_before", before)


def read_ordered(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """The rows of export_ordered() with their place from 1 in the whole export."""
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("_k"))
    return rows.join(manifest.select("file", "rows_before"), "file").withColumn("place", F.col("rows_before") + F.col("_k") + 1).drop("_k", "rows_before")


def load_core(spark: SparkSession, path: str, schemas: dict[str, T.StructType]) -> dict[str, DataFrame]:
    """Tables with pinned types; a file that has others is an error when it is read."""
    return {name: spark.read.schema(schema).parquet(f"{path}/{name}.parquet") for name, schema in schemas.items()}
