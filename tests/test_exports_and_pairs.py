import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from staylens.functions import keys
from staylens.operators import catalog, features
from staylens.sources import files


def test_export_read_in_name_order_is_in_order(spark, tmp_path):
    r = random.Random(1)
    rows = [(r.randint(0, 50), i, "x") for i in range(3000)] + [(None, 1, "n"), (None, 0, "n")]
    df = spark.createDataFrame(rows, "k int, i int, t string").repartition(6)
    path = f"file://{tmp_path}/out"
    manifest = files.export_ordered(df, path, ["k", "i"], files=5)
    told = manifest.orderBy("file").collect()
    assert len(told) == 5 and [m.rows_before for m in told] == [sum(x.n_rows for x in told[:j]) for j in range(5)]
    order = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert all(order(tuple(a.last)) <= order(tuple(b.first)) for a, b in zip(told, told[1:]) if a.last and b.first)
    back = files.read_ordered(spark, path, manifest).orderBy("place").collect()
    assert [(x.k, x.i, x.t) for x in back] == sorted(rows, key=order)
    assert [x.place for x in back] == list(range(1, len(rows) + 1))
    files_in_order = sorted((tmp_path / "out").glob("part-*.parquet"))
    assert [(x.k, x.i) for f in files_in_order for x in spark.read.parquet(str(f)).collect()] == [x[:2] for x in sorted(rows, key=order)]


def test_export_of_an_empty_table(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    assert files.export_ordered(spark.createDataFrame([], "k int"), path, ["k"]).collect() == []


def _items(spark, rows):
    return spark.createDataFrame(rows, "source_code string, item_id long, day date, hotel_id int").select("*", F.lit("s").alias("status"), F.lit("o").alias("ownership_status"), F.current_timestamp().alias("finished_at"))


@pytest.mark.parametrize("most", [3, 1000])
def test_sliced_pairs_equal_all_pairs(spark, most):
    r = random.Random(8)
    day = dt.date(2026, 1, 1)
    rows = [(r.choice("abc"), i, day, r.choice([1, 1, 1, 2, None])) for i in range(80)] + [("a", 900, day, 5), ("a", 901, day, 5), ("a", 0, day, 1)]
    got = Counter((x.source_a, x.source_b, x.item_id_a, x.item_id_b) for x in catalog.collision_pairs(_items(spark, rows), ["day", "hotel_id"], most).collect())
    assert got == Counter((a[0], b[0], a[1], b[1]) for a in rows for b in rows if a[3] is not None and a[3] == b[3] and a[0] < b[0])


def test_no_task_pairs_a_hot_key_alone(spark):
    """10,000 items of one key: each two slices of about 1,000 meet apart."""
    items = spark.range(10_000).selectExpr("if(id % 2 = 0, 'a', 'b') AS source_code", "id AS item_id", "date'2026-01-01' AS day", "1 AS hotel_id", "'s' AS status", "'o' AS ownership_status", "current_timestamp() AS finished_at")
    pairs = catalog.collision_pairs(items, ["day", "hotel_id"])
    cell = pairs.groupBy(F.pmod(F.xxhash64("item_id_a"), F.lit(10)).alias("a"), F.pmod(F.xxhash64("item_id_b"), F.lit(10)).alias("b")).count().collect()
    assert len(cell) == 100 and sum(x["count"] for x in cell) == 25_000_000 and max(x["count"] for x in cell) < 1000 * 1000


def test_lead_days_of_alerts(spark):
    d = lambda n: dt.date(2026, 1, 1) + dt.timedelta(n)
    told = [(1, d(0), "up", False), (1, d(1), "up", True), (1, d(2), "hold", True), (1, d(3), "up", False), (1, d(4), "up", False), (1, d(5), "up", True), (1, d(7), "up", True), (2, d(5), "up", True), (3, d(1), None, None)]
    got = features.alert_leads(spark.createDataFrame(told, "h int, day date, state string, event boolean"), ["h"], "day", "state", "event")
    assert sorted((x.h, x.day, x.alert_since, x.lead_days) for x in got.collect()) == [(1, d(1), d(0), 1), (1, d(2), d(2), 0), (1, d(5), d(3), 2), (1, d(7), d(7), 0), (2, d(5), d(5), 0)]


def test_nothing_passes_a_violation(spark):
    df = spark.createDataFrame([(1,)], "item_id int")
    none = spark.createDataFrame([], "violation string, n_rows long, sample_items string")
    assert keys.fail_closed(df, none) is df
    with pytest.raises(ValueError, match="key_missing: 3 rows, such as 7,8,9"):
        keys.fail_closed(df, spark.createDataFrame([("key_missing", 3, "7,8,9")], none.schema))
