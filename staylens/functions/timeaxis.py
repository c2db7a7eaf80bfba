"""The two time axes: when a price was seen (UTC) and the night it is for; lead time joins them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Local dates are UTC and seven hours, whatever the session's zone.
LOCAL_OFFSET_HOURS = 7
#: Fixed: lead-time buckets, label and last day; the order is canonical.
BUCKETS = [("0", 0), ("1-3", 3), ("4-7", 7), ("8-14", 14), ("15-30", 30), ("31-60", 60), ("61+", None)]
#: The first two merged, as older tables had it.
LEGACY_BUCKETS = [("0-3", 3), ("4-7", 7), ("8-14", 14), ("15-30", 30), ("31-60", 60), ("61+", None)]
INVALID = "(invalid)"
UNKNOWN = "(unknown)"


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def local_time(ts: str | Column) -> Column:
    return col(ts) + F.expr(f"INTERVAL {LOCAL_OFFSET_HOURS} HOURS")


def local_date(ts: str | Column) -> Column:
    return local_time(ts).cast("date")


def local_text(ts: str | Column) -> Column:
    return F.date_format(local_time(ts), "yyyy-MM-dd HH:mm:ss")


def lead_time(checkin: str | Column, observed_at: str | Column) -> Column:
    return F.date_diff(col(checkin), local_date(observed_at))


def bucket(lead: str | Column, buckets: list = BUCKETS) -> Column:
    """Label of a lead time; null where it is null or negative."""
    lead = col(lead)
    out = F.when(lead < 0, F.lit(None).cast("string"))
    for label, last in buckets:
        out = out.otherwise(label) if last is None else out.when(lead <= last, label)
    return F.when(lead.isNotNull(), out)


def item_bucket(lead: str | Column, buckets: list = BUCKETS) -> Column:
    """As bucket(); what has none is (invalid)."""
    return F.coalesce(bucket(lead, buckets), F.lit(INVALID))


def bucket_order(label: str | Column, buckets: list = BUCKETS) -> Column:
    """Position of a label; labels that are not of the list come last, and no row is dropped."""
    at = F.array_position(F.array(*[F.lit(x) for x, _ in buckets]), col(label))
    return F.when(at > 0, at).otherwise(len(buckets) + 1).cast("int")


def bucket_table(spark, buckets: list = BUCKETS) -> DataFrame:
    """Every label with its position."""
    return spark.createDataFrame([(x, i + 1) for i, (x, _) in enumerate(buckets)], "lead_time_bucket string, bucket_order int")


def minute_bucket(minutes: str | Column) -> Column:
    m = col(minutes)
    return F.when(m < 6, "0-5").when(m < 16, "6-15").when(m < 61, "16-60").when(m.isNotNull(), "61+")


MINUTE_BUCKETS = ["0-5", "6-15", "16-60", "61+"]
