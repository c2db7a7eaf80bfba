import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from staylens.operators import derived
from staylens.plans import registry

registry.load()


@pytest.fixture
def dealt(spark):
    """Eight partitions that adaptive plans don't put together, and no broadcasts."""
    told = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in told}
    for k, v in told.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_a_dropped_mark_that_would_be_put_in_is_dropped(spark, tmp_path):
    """Record 120001 is told apart by both 7 and 500."""
    at = dt.datetime(2024, 1, 3, 4, 5, 6)
    rows = [(i, at, 1, "click", v, '{"k": 4}') for i, v in ((120001, 3.0), (120008, 3.0), (501, 3.0), (1001, 9.0), (120002, 3.0))]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(registry.ORACLES["anomaly_projection_mismatches"]).fetchall()
    got = [tuple(r) for r in registry.QUERIES["anomaly_projection_mismatches"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) == [(1001, False, True), (120001, True, False), (120008, True, False)]


_ITEM = "item_id bigint, hotel_id bigint, link string, crawl_date date"


def _identified(spark, items):
    day = dt.date(2024, 1, 1)
    slugs = spark.createDataFrame([("h1", 1, "x"), ("h2", 2, "y")], "slug string, hotel_id bigint, city string")
    members = spark.createDataFrame([(1, day, dt.date(2024, 1, 5)), (1, dt.date(2024, 1, 5), None)], "hotel_id bigint, effective_from date, effective_until date")
    return derived.effective_hotel(spark.createDataFrame(items, _ITEM), members, slugs)


def test_identity_by_own_hotel_by_link_and_by_none(spark):
    url, day = "https://h.example/hotel/vn/{}.html", dt.date(2024, 1, 5)
    rows = [(1, 2, url.format("h1"), day), (2, None, url.format("h1"), day), (3, None, url.format("h2"), day), (4, None, None, day), (5, 9, None, day), (6, None, url.format("h1"), dt.date(2023, 1, 1)), (7, None, url.format("h1"), None)]
    got = {r.item_id: (r.effective_hotel_id, r.effective_city, r.identity) for r in _identified(spark, rows).collect()}
    none = (None, None, "unattributed")
    assert got == {1: (2, "y", "own"), 2: (1, "x", "link"), 3: none, 4: none, 5: (9, None, "own"), 6: none, 7: none}


def test_items_without_a_slug_do_not_meet_in_one_task(dealt):
    out = _identified(dealt, [(i, None, None, dt.date(2024, 1, 5)) for i in range(400)])
    per = [r["count"] for r in out.select(F.spark_partition_id().alias("part"), "effective_hotel_id").groupBy("part").count().collect()]
    assert sum(per) == 400 and max(per) < 200
