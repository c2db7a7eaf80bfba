import datetime as dt
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from staylens.operators import derived, monitor
from staylens.sources import files
from staylens.streaming import jobs

HEAD = "holiday_date,event_code,name,event_type,scope,city,is_tet,status,source_url\n"
GOOD = HEAD + "2026-01-01,ny,New Year,public_holiday,national,,false,confirmed,u\n2026-02-01,lan,Lanterns,festival,city,Hoi An,false,provisional,u\n"


def test_holidays_load_or_fail(spark, tmp_path):
    p = tmp_path / "h.csv"
    p.write_text(GOOD)
    df = files.load_holidays(spark, str(p))
    assert df.count() == 2
    for broken in (GOOD.replace("festival", "party"), GOOD.replace("Hoi An", ""), GOOD + GOOD.split("\n")[1] + "\n", GOOD.replace("confirmed", "maybe")):
        p.write_text(broken)
        with pytest.raises(files.LoadError):
            files.load_holidays(spark, str(p))
    p.write_text(GOOD.replace("event_code", "code"))
    with pytest.raises(Exception, match="(?i)header|column"):
        files.load_holidays(spark, str(p)).collect()


def test_festival_stays_in_its_city_and_national_days_reach_all(spark, tmp_path):
    p = tmp_path / "h.csv"
    p.write_text(GOOD)
    days = spark.createDataFrame([(dt.date(2026, 1, 1),), (dt.date(2026, 2, 1),)], "day date")
    cities = spark.createDataFrame([("Hoi An",), ("Hanoi",)], "city string")
    got = {(r.day.month, r.city): (r.is_public_holiday, r.is_festival_period, r.n_confirmed, r.n_provisional) for r in derived.calendar_flags(days, cities, files.load_holidays(spark, str(p))).collect()}
    assert got == {(1, "Hoi An"): (True, False, 1, 0), (1, "Hanoi"): (True, False, 1, 0), (2, "Hoi An"): (False, True, 0, 1), (2, "Hanoi"): (False, False, 0, 0)}


def test_import_upserts_or_replaces(spark, tmp_path):
    p = tmp_path / "h.csv"
    p.write_text(GOOD)
    old = files.load_holidays(spark, str(p)).withColumn("name", F.lit("old"))
    new = files.load_holidays(spark, str(p)).limit(1)
    assert sorted(r.name for r in files.import_holidays(old, new).collect()) == ["New Year", "old"]
    assert files.import_holidays(old, new, replace=True).count() == 1


def test_plan_and_cohorts(spark, tmp_path):
    row = {"owner_source": "a", "crawl_date": "2026-01-01", "schedule_slot": "night", "checkin_date": "2026-01-02"}
    (tmp_path / "p.json").write_text(json.dumps({"row_count": 1, "sources": ["a"], "rows": [row]}))
    assert files.load_plan(spark, str(tmp_path / "p.json")).columns == list(row)
    (tmp_path / "q.json").write_text(json.dumps({"row_count": 2, "sources": ["a"], "rows": [row]}))
    with pytest.raises(files.LoadError, match="row_count"):
        files.load_plan(spark, str(tmp_path / "q.json"))
    (tmp_path / "c.json").write_text(json.dumps([{"label": "v1", "effective_from": "2026-01-01", "members": {"h1": "x"}}, {"label": "v2", "effective_from": "2026-02-01", "members": {"h1": "y"}}]))
    with pytest.raises(files.LoadError, match="two cities"):
        files.load_cohorts(spark, str(tmp_path / "c.json"))


def test_boolean_contract(spark):
    df = spark.createDataFrame([("1", "true"), ("0", None)], "a string, b string")
    assert [tuple(r) for r in files.booleans(df, {"a": False, "b": True}).collect()] == [(True, True), (False, None)]
    with pytest.raises(files.LoadError, match="b is null"):
        files.booleans(df, {"b": False})
    with pytest.raises(files.LoadError, match="no boolean"):
        files.booleans(spark.createDataFrame([("2",)], "a string"), {"a": True})
    with pytest.raises(files.LoadError, match="forbidden"):
        files.required(df, ["a"], forbidden=["b"])


def test_publish_tells_what_it_wrote(spark, tmp_path):
    meta = files.publish(spark.range(7), str(tmp_path), "t", "MAIN", "row", "all").first()
    assert (meta.n_rows, meta.columns) == (7, "id") and spark.read.parquet(f"{tmp_path}/t").count() == 7


def test_streak_state_over_batches(spark, tmp_path):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    say = lambda i, d, kind: (i, dt.datetime(2026, 1, d), 1, kind, 1.0, "{}")
    src = tmp_path / "in"
    for n, rows in enumerate([[say(0, 1, "click"), say(1, 2, "click")], [say(2, 2, "view"), say(3, 3, "click")], [say(4, 5, "click")], [say(5, 6, "purchase")], [say(6, 7, "error")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        out = jobs.run_to_table(jobs.dead_link_streaks(_stream(spark, src, schema)), str(tmp_path / "out"), "update")
        last = out.orderBy(F.desc("last_day")).first()
        assert (last.streak_days, last.needs_review) == [(2, False), (3, True), (1, False), (0, False), (1, False)][n]


@pytest.mark.parametrize("batches", [[["purchase", "click"]], [["purchase"], ["click"]], [["click"], ["purchase"]], [["click"], ["purchase", "view"], ["click"]]])
def test_streak_of_a_day_does_not_depend_on_batches(spark, tmp_path, batches):
    """A day with a success leaves no streak, and the next dead day starts one."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    src, last = tmp_path / "in", None
    for n, kinds in enumerate([*batches, ["click"]]):
        day = 3 if n < len(batches) else 4
        spark.createDataFrame([(n * 10 + k, dt.datetime(2026, 1, day), 1, kind, 1.0, "{}") for k, kind in enumerate(kinds)], schema).coalesce(1).write.mode("append").parquet(str(src))
        out = jobs.run_to_table(jobs.dead_link_streaks(_stream(spark, src, schema)), str(tmp_path / "out"), "update")
        rows = spark.read.parquet(f"{tmp_path}/out/out/batch={n}").collect()
        last = rows[-1]
        if n == len(batches) - 1:
            assert (last.streak_days, last.last_day.day) == (0, 3)
    assert out.count() == len(batches) + 1 and (last.streak_days, last.last_day.day) == (1, 4)


def _stream(spark, folder, schema):
    raw = spark.readStream.schema(schema).parquet(str(folder))
    return raw.select(F.col("user_id").alias("hotel_id"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "purchase", "success").otherwise("error").alias("status"))


def test_batch_streaks(spark):
    days = spark.createDataFrame([(1, dt.date(2026, 1, d), dead) for d, dead in ((1, True), (2, True), (3, True), (5, True), (6, False), (7, True))], "h int, day date, dead boolean")
    got = sorted((r.streak_start.day, r.streak_days, r.needs_review) for r in monitor.streaks(days, ["h"], "day", "dead").collect())
    assert got == [(1, 3, True), (5, 1, False), (7, 1, False)]


def test_operational_flags_need_days_and_spread(spark):
    rows = [("a", d, 10.0) for d in range(9)] + [("a", 9, 100.0), ("b", 0, 1.0), ("b", 1, 9.0), ("c", 0, 5.0), ("c", 1, 5.0), ("c", 2, 5.0)]
    got = derived.operational_flags(spark.createDataFrame(rows, "source_code string, d int, m double"), ["m"]).collect()
    assert [(r.source_code, r.d) for r in got if r.flagged] == [("a", 9)]
    assert all(r.z_m is None for r in got if r.source_code in "bc")
    assert pd.Series([r.z_m for r in got if r.source_code == "a"]).notna().all()


@pytest.mark.parametrize("days", [["2026-02-01", "2026-01-01"], ["2026-01-01", "2026-01-01"], ["2026-01-01", None]])
def test_cohort_versions_begin_later_in_file_order(spark, tmp_path, days):
    told = lambda ds: json.dumps([{"label": f"v{i}", "effective_from": d, "members": {"h1": "x"}} for i, d in enumerate(ds)])
    (tmp_path / "c.json").write_text(told(days))
    with pytest.raises(files.LoadError, match="later days"):
        files.load_cohorts(spark, str(tmp_path / "c.json"))
    (tmp_path / "d.json").write_text(told(["2026-01-01", "2026-02-01", "2026-03-01"]))
    assert files.load_cohorts(spark, str(tmp_path / "d.json")).count() == 3
