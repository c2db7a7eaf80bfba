"""Tables over whole sets, their guards, findings, fingerprints, plan envelopes, and the state of streams."""

import datetime as dt
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from staylens.functions import keys
from staylens.operators import derived
from staylens.operators.derived import Check
from staylens.sources import files
from staylens.streaming import jobs

ROW = {"owner_source": "a", "crawl_date": "2026-01-01", "schedule_slot": "night", "checkin_date": "2026-01-02"}


def test_plan_envelope_hash(spark, tmp_path):
    rows = [ROW, {**ROW, "owner_source": "b"}]
    told = hashlib.sha256("\n".join(sorted(json.dumps(r, sort_keys=True, separators=(",", ":")) for r in rows)).encode()).hexdigest()

    def load(hashed=True, **change):
        body = {"plan_version": 1, "row_count": len(rows), "sources": ["a", "b"], "rows": rows, "rows_sha256": told, **change}
        (tmp_path / "p.json").write_text(json.dumps(body))
        return files.load_plan(spark, str(tmp_path / "p.json"), hashed).count()

    assert load() == 2 and load(rows=rows[::-1]) == 2 and load(hashed=False, rows_sha256=None) == 2
    for match, change in {"sha256 differs": {"rows_sha256": "0" * 64}, "sha256 missing": {"rows_sha256": None}, "version": {"plan_version": 2}, "sources differ": {"sources": ["b", "a"]}, "row_count": {"row_count": None}, "no rows": {"rows": []}, "repeated": {"rows": [ROW, ROW]}, "not whole": {"rows": [ROW, {**ROW, "schedule_slot": None}]}}.items():
        with pytest.raises(files.LoadError, match=match):
            load(**change)


def test_fingerprint_of_twelve_columns(spark):
    row = {"run": "a|1", "item": 7, "record": 9, "hotel": None, "at": dt.datetime(2026, 1, 2, 3, 4, 5, 60), "checkin": dt.date(2026, 2, 1), "checkout": dt.date(2026, 2, 2), "opt": 0, "room": "phòng", "rate": None, "total": 1500000.0, "per": None}
    types = "run string, item long, record long, hotel long, at timestamp_ntz, checkin date, checkout date, opt int, room string, rate string, total double, per double"
    df = spark.createDataFrame([tuple(row.values())], types)
    body = {"source_run_id": "a|1", "source_item_id": 7, "source_record_id": 9, "hotel_id": None, "observed_at": "2026-01-02T03:04:05.000060", "checkin_date": "2026-02-01", "checkout_date": "2026-02-02", "room_option_index": 0, "room_identity_key": "phòng", "rate_plan_key": None, "price_total": 1500000, "price_per_night": None}
    want = hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    assert df.select(keys.immutable_fingerprint(*row)).first()[0] == want
    with pytest.raises(Exception, match="not whole"):
        df.withColumn("total", F.lit(1.5)).select(keys.immutable_fingerprint(*row)).collect()


GROUPS = "source_code string, city string, is_main boolean, n_rows long, min_price double, max_price double"
TOTALS = "source_code string, city string, n_observations_raw long, n_observations_main long"


def test_duplicates_by_scope_and_their_guard(spark):
    groups = spark.createDataFrame([("a", "x", True, 3, 1.0, 1.0), ("a", "x", False, 2, 1.0, 2.0), ("b", "x", True, 2, None, None)], GROUPS)
    totals = spark.createDataFrame([("a", "x", 10, 6), ("b", "x", 5, 5), ("b", "y", 4, 0)], TOTALS)
    got = {(r.scope, r.source_code, r.city): r for r in derived.duplicate_scopes(groups, totals).collect()}
    assert len(got) == 2 * (3 + 2 + 2 + 1)
    raw = got["RAW", "(all)", "(all)"]
    assert (raw.n_observations, raw.n_groups, raw.n_duplicate_groups, raw.n_extra, raw.n_same_price_groups, raw.n_divergent_groups, raw.largest_group) == (19, 15, 3, 4, 1, 2, 3)
    none = got["MAIN", "b", "y"]
    assert (none.n_observations, none.n_groups, none.duplicate_rate, none.divergent_share) == (0, 0, None, None)
    counted = spark.createDataFrame([(3, 4, 15)], "n_duplicate_groups long, n_extra_observations long, n_total_groups long")
    summary = derived.duplicate_scopes(groups, totals)
    assert all(r.ok for r in derived.duplicates_reconciled(summary, counted).collect())
    off = derived.duplicates_reconciled(summary, counted.withColumn("n_extra_observations", F.lit(5)))
    assert [r.figure for r in off.filter("not ok").collect()] == ["n_extra"]
    empty = derived.duplicate_scopes(groups.limit(0), totals.limit(0)).collect()
    assert sorted((r.scope, r.source_code, r.city, r.n_groups) for r in empty) == [("MAIN", "(all)", "(all)", 0), ("RAW", "(all)", "(all)", 0)]


def test_availability_and_calendar_of_nothing_and_of_nulls(spark):
    items = spark.createDataFrame([("success", None), ("error", None), ("sold_out", "x")], "status string, city string")
    got = {r.city: (r.n_items, r.rate_success) for r in derived.availability(items, ["city"]).collect()}
    assert got == {None: (2, 0.5), "x": (1, 0.0)}
    assert derived.availability(items.limit(0), ["city"]).count() == 0
    zero = derived.availability(items.limit(0), [])
    assert (zero.first().n_items, zero.first().rate_error) == (0, None)
    assert {r.figure for r in derived.availability_reconciled(zero, derived.availability(items, [])).filter("not ok").collect()} == {"n_items", "n_success", "n_error", "n_sold_out"}
    nights = spark.createDataFrame([(dt.date(2026, 1, d), c) for d, c in ((1, "x"), (1, "x"), (1, "y"), (2, None))], "checkin_date date, city string")
    flags = spark.createDataFrame([(dt.date(2026, 1, 1), "x", True)], "day date, city string, f boolean")
    assert sorted(map(tuple, derived.calendar_coverage(nights, flags, ["f"]).collect())) == [(False, 2, 2, 2), (True, 2, 1, 1)]


def test_findings_tell_what_found_nothing_too(spark):
    rows = spark.createDataFrame([(k,) for k in (7, 5, 11)] + [(None,)], "k int")
    n = lambda f, d: spark.createDataFrame([(f, d)], "n_found long, denominator long")
    got = {r.check_name: r for r in derived.finding_rows([Check("some", "high", "RAW", "row", n(4, 8), rows, "k", "c", "a"), Check("none", "high", "RAW", "row", n(0, 8), rows.limit(0), "k", "c", "a"), Check("empty", "high", "MAIN", "row", n(None, 0), None, "", "c", "a")], 2).collect()}
    assert (got["some"].severity, got["some"].rate, got["some"].sample_keys) == ("high", 0.5, "11,5")
    assert (got["none"].severity, got["none"].n_found, got["none"].sample_keys) == ("info", 0, "")
    assert (got["empty"].severity, got["empty"].n_found, got["empty"].rate) == ("info", 0, None)


EVENT = "hotel_id long, ts timestamp, status string"


@pytest.mark.parametrize("seed", [1, 2])
def test_days_in_any_order_give_the_same_streaks(spark, tmp_path, seed):
    """Batches of days in random order, with repeats and late successes, end as one batch of all."""
    rng = random.Random(seed)
    rows = [(h, dt.datetime(2026, 1, d, rng.randrange(24)), "success" if rng.random() < 0.15 else "error") for h in (1, 2, 3) for d in rng.sample(range(1, 20), 14) for _ in range(rng.randrange(1, 3))]
    want = {}
    for h in (1, 2, 3):
        days = {}
        for _, ts, status in (r for r in rows if r[0] == h):
            days[ts.date()] = days.get(ts.date(), False) or status == "success"
        want[h] = jobs.streak_after(0, None, sorted(days.items()))
    rng.shuffle(rows)
    src = tmp_path / "in"
    for part in (rows[::2], rows[1::2]):
        spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(str(src))
        out = jobs.run_to_table(jobs.dead_link_streaks(spark.readStream.schema(EVENT).parquet(str(src))), str(tmp_path / "out"), "update")
    last = out.groupBy("hotel_id").agg(F.max_by(F.struct("streak_days", "last_day"), "revision").alias("r")).collect()
    assert {r.hotel_id: tuple(r.r) for r in last} == want


def test_days_before_those_kept_are_folded(spark, tmp_path):
    """Three kept days: the streak of what is older lives on, and a day older than that is passed over."""
    src = tmp_path / "in"
    for days in ([1, 2, 3, 4, 5, 6], [2], [7]):
        spark.createDataFrame([(1, dt.datetime(2026, 1, d), "success" if len(days) == 1 and d == 2 else "error") for d in days], EVENT).coalesce(1).write.mode("append").parquet(str(src))
        out = jobs.run_to_table(jobs.dead_link_streaks(spark.readStream.schema(EVENT).parquet(str(src)), keep=3), str(tmp_path / "out"), "update")
    assert [r.streak_days for r in out.orderBy("revision").collect()] == [6, 6, 7]


def test_keyed_table_merges_and_repeats_harmlessly(spark, tmp_path):
    schema = "k long, at timestamp_ntz, v string"
    say = lambda *rows: spark.createDataFrame([(k, dt.datetime(2026, 1, d), v) for k, d, v in rows], schema)
    table = jobs.KeyedTable(spark, str(tmp_path / "t"), say((1, 1, "")).schema, "k", "at", 3)
    rows = lambda: {r.k: r.v for r in table.read().collect()}
    assert rows() == {}
    table.merge(say(*[(k, 5, "a") for k in range(20)], (None, 1, "n"), (3, 6, "b"), (3, 6, "a")), 0)
    table.merge(say((1, 9, "new"), (2, 1, "old"), (50, 1, "x")), 1)
    want = {**{k: "a" for k in range(20)}, None: "n", 3: "b", 1: "new", 50: "x"}
    assert rows() == want
    for _ in range(2):
        table.merge(say((1, 9, "new"), (2, 1, "old"), (50, 1, "x")), 1)
        assert rows() == want
    table.merge(say((1, 9, "new")).limit(0), 2)
    for n in range(3, 7):
        table.merge(say((1, 9 + n, str(n))), n)
    assert rows() == {**want, 1: "6"} and max(len(v) for v in table.versions().values()) <= 2
