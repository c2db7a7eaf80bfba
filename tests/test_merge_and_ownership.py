import datetime as dt

import pytest
from pyspark.sql import functions as F

from staylens.operators import merge

D = dt.date


def test_field_groups_pick_their_own_winner(spark):
    rows = [(1, "a", 1, "old name", "addr", D(2026, 1, 1), "open", D(2026, 3, 1), D(2025, 1, 2)), (1, "b", 2, "new name", None, D(2026, 2, 1), "closed", D(2026, 2, 1), D(2025, 1, 1)), (2, "a", 1, "n", None, None, None, None, D(2025, 5, 5)), (2, "b", 2, "m", "x", None, "open", None, D(2025, 6, 6))]
    df = spark.createDataFrame(rows, "hotel_id int, source_code string, source_priority int, name string, address string, at date, booking_status string, sat date, created_at date")
    got = {r.hotel_id: r for r in merge.merge_hotels(df, "hotel_id", {"attributes": ("at", ["name", "address"]), "status": ("sat", ["booking_status"])}, "created_at").collect()}
    assert (got[1].name, got[1].address, got[1].booking_status, got[1].created_at) == ("new name", None, "open", D(2025, 1, 1))
    assert (got[1].attributes_source, got[1].status_source, got[1].source_codes) == ("b", "a", "a,b")
    assert (got[2].name, got[2].status_source) == ("m", "b")  # more fields filled


PLAN = [("a", D(2026, 1, 2), D(2026, 2, 1)), ("b", D(2026, 1, 2), D(2026, 2, 2)), ("a", D(2026, 1, 3), D(2026, 2, 3)), ("a", D(2026, 1, 5), D(2026, 2, 1)), ("b", D(2026, 1, 4), D(2026, 2, 4))]
ITEMS = [
    (1, "a", D(2026, 1, 2), D(2026, 2, 1), "success", 7, True, "owner_success", None),
    (2, "a", D(2026, 1, 2), D(2026, 2, 1), "error", None, False, "owner_failure", "owner_failure_status_error"),
    (3, "a", D(2026, 1, 2), D(2026, 2, 2), "success", 7, True, "non_owner_duplicate", "non_owner_duplicate"),
    (4, "a", D(2026, 1, 2), D(2026, 2, 1), "success", 8, False, "protocol_deviation", "hotel_outside_cohort"),
    (5, "a", D(2026, 1, 1), D(2026, 2, 9), "success", 7, True, "unassigned", "before_first_day"),
    (6, "a", D(2026, 1, 9), D(2026, 2, 9), "success", 7, True, "unassigned", "after_last_day"),
    (7, "a", D(2026, 1, 4), D(2026, 2, 9), "success", 7, True, "unassigned", "day_not_in_plan"),
    (8, "a", D(2026, 1, 2), D(2026, 2, 3), "success", 7, True, "unassigned", "night_planned_on_other_day"),
    (9, "a", D(2026, 1, 2), D(2026, 2, 9), "success", 7, True, "unassigned", "night_never_planned"),
    (10, "z", D(2026, 1, 7), D(2026, 2, 9), "success", 7, True, "unassigned", "run_not_in_plan"),
]


def test_ownership_precedence(spark):
    plan = spark.createDataFrame(PLAN, "owner_source string, crawl_date date, checkin_date date")
    items = spark.createDataFrame([(*r[:7], True) for r in ITEMS], "item_id int, source_code string, crawl_date date, checkin_date date, status string, hotel_id int, hotel_in_cohort boolean, run_planned boolean")
    got = {r.item_id: r for r in merge.resolve_ownership(items, plan).collect()}
    assert {k: (r.ownership_status, r.exclusion_reason) for k, r in got.items()} == {r[0]: r[7:] for r in ITEMS}
    assert {k for k, r in got.items() if r.include_main} == {1, 2} and {k for k, r in got.items() if r.include_reference} == {1}


def test_cohort_goes_by_the_day(spark):
    v = spark.createDataFrame([("v1", D(2026, 1, 1), 1, "x"), ("v2", D(2026, 1, 10), 2, "x")], "label string, effective_from date, hotel_id int, city string")
    items = spark.createDataFrame([(1, D(2026, 1, 5)), (1, D(2026, 1, 10)), (2, D(2026, 1, 9)), (2, D(2026, 3, 1)), (1, D(2025, 1, 1)), (None, D(2026, 1, 5))], "hotel_id int, crawl_date date")
    got = sorted((str(r.hotel_id), r.crawl_date, r.hotel_in_cohort) for r in merge.in_cohort(items, v).collect())
    assert [x for *_, x in got] == [False, True, False, False, True, False]


def test_every_check_fires(spark):
    parent, child = spark.range(5), spark.createDataFrame([(0,), (0,), (9,), (None,)], "id long")
    table = merge.checks({"orphans": merge.orphans(child, parent, "id"), "repeated": merge.repeated(child.dropna(), "id"), "clean": parent.filter("id < 0")})
    assert {r.check_name: r.n_violations for r in table.collect()} == {"orphans": 1, "repeated": 1, "clean": 0}
    assert tuple(merge.gate(table).first()) == (False, 3, 2)


def test_rejects_cascade_and_reconcile(spark):
    runs = spark.createDataFrame([("a", 1, -1), ("a", 2, 5)], "source_code string, run int, n int")
    good, bad = merge.split_rejects(runs, "runs", "run", {"negative": F.col("n") < 0})
    items = spark.createDataFrame([("a", 10, 1), ("a", 11, 2)], "source_code string, item int, run int")
    kept, lost = merge.cascade(items, "items", "item", "run", bad)
    assert [r.item for r in kept.collect()] == [11] and [r.reason for r in lost.collect()] == ["parent_rejected"]
    tag = lambda df, t: df.select("source_code", F.lit(t).alias("table_name"))
    out = merge.reconcile(tag(runs, "runs").unionByName(tag(items, "items")), tag(good, "runs").unionByName(tag(kept, "items")), bad.unionByName(lost)).collect()
    assert all(r.ok for r in out) and {r.table_name: (r.n_row_error, r.n_parent_rejected) for r in out} == {"runs": (1, 0), "items": (0, 1)}


@pytest.mark.parametrize("value", ["", None])
def test_upsert_leaves_old_where_new_is_missing(spark, value):
    old = spark.createDataFrame([(1, "x")], "k int, v string")
    new = spark.createDataFrame([(1, value), (2, "y")], "k int, v string")
    assert {r.k: r.v for r in merge.upserted(old, new, "k", ["v"]).collect()} == {1: "x", 2: "y"}
