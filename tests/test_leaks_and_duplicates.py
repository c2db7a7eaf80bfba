"""What must fail, and what must not be known yet."""

import datetime as dt
import unicodedata

import pytest
from pyspark.sql import functions as F

from staylens.functions import stats, text
from staylens.functions.keys import numbered
from staylens.operators import derived, features, merge, monitor

DAY = dt.date(2026, 3, 5)


def test_two_owners_of_a_night_fail(spark):
    items = spark.createDataFrame([("a", DAY, DAY, "success", 1, True, True)], "source_code string, crawl_date date, checkin_date date, status string, hotel_id int, hotel_in_cohort boolean, run_planned boolean")
    plan = lambda *owners: spark.createDataFrame([(o, DAY, DAY) for o in owners], "owner_source string, crawl_date date, checkin_date date")
    assert [r.ownership_status for r in merge.resolve_ownership(items, plan("a", "a")).collect()] == ["owner_success"]
    with pytest.raises(Exception, match="two owners of 2026-03-05"):
        merge.resolve_ownership(items, plan("a", "b")).collect()


def test_two_actual_items_of_a_key_fail(spark):
    key = "source_code string, crawl_date date, checkin_date date, hotel_id int"
    expected = spark.createDataFrame([("a", DAY, DAY, 1)], key)
    runs = spark.createDataFrame([("a", DAY)], "source_code string, crawl_date date")
    actual = lambda n: spark.createDataFrame([("a", DAY, DAY, 1, "success")] * n, f"{key}, status string")
    assert [r.outcome for r in derived.classify_schedule(expected, actual(1), runs).collect()] == ["success"]
    with pytest.raises(Exception, match="two actual items of a 2026-03-05"):
        derived.classify_schedule(expected, actual(2), runs).collect()


def test_context_is_as_known_on_the_day_seen(spark):
    d = lambda n: DAY + dt.timedelta(n)
    rows = spark.createDataFrame([(1, "x", d(30), d(0)), (2, "x", d(30), d(29)), (3, "x", d(30), d(-9)), (4, None, d(30), d(0))], "id int, city string, night date, seen date")
    weather = spark.createDataFrame([("x", d(30), d(-5), 1.0), ("x", d(30), d(0), 2.0), ("x", d(30), d(1), 3.0), ("x", d(30), d(30), 4.0)], "city string, day date, issued_on date, degrees double")
    arrivals = spark.createDataFrame([("x", dt.date(2026, m, 1), m) for m in (1, 2, 3, 4)], "city string, month date, arrivals int")
    got = {r.id: (r.weather.degrees if r.weather else None, r.arrivals_last_month) for r in features.external_context(rows, weather, arrivals, "night", "seen").collect()}
    assert got == {1: (2.0, 2), 2: (3.0, 3), 3: (None, 1), 4: (None, None)}


@pytest.mark.parametrize("form", ["NFC", "NFD", "NFKD"])
def test_composed_and_decomposed_texts_read_alike(spark, form):
    told = "Phòng 30m² hướng biển, Miễn phí hủy, bao gồm bữa sáng ở Hồ Chí Minh ệ ǖ"
    row = spark.createDataFrame([(unicodedata.normalize(form, told),)], "t string").select(text.canonical_text("t").alias("c"), text.composed("t").alias("n"), text.room_conditions(F.array("t")).alias("r")).first()
    assert row.c == "room 30m2 sea view mien phi huy bao gom bua sang o ho chi minh e u"
    assert row.r.breakfast_included and row.r.free_cancellation
    assert row.n == unicodedata.normalize("NFC", unicodedata.normalize(form, told))


def test_letters_of_other_forms_count(spark):
    told = ["Ｄｅｌｕｘｅ", "ﬁne", "½", "Ⅳ", "①", "𝐁𝐨𝐥𝐝", "№ 5", "m²"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in told], "t string").select(text.plain_words("t")).collect()]
    assert got == ["deluxe", "fine", "1 2", "iv", "1", "bold", "no 5", "m2"]


def test_numbers_run_on_over_chunks_and_blocks(spark):
    rows = spark.createDataFrame([(p, k) for p in (1, 2) for k in range(0, 5000, 7)], "p int, k long")
    got = [r.warehouse_id for r in numbered(rows, "p", "k", chunk=2).orderBy("p", "k").collect()]
    assert got == list(range(1, len(got) + 1))


def test_overall_quantiles_equal_percentile(spark):
    for rows in ([(float(x % 37) ** 2,) for x in range(500)] + [(None,)], [(3.0,)] * 9, [(1.0,), (2.0,)]):
        df = spark.createDataFrame(rows, "x double")
        points = [0.0, 0.05, 0.5, 0.9, 1.0]
        want = df.agg(F.percentile("x", F.array(*map(F.lit, points)))).first()[0]
        for few in (1, 10, 10_000):
            assert list(stats.overall_quantiles(df, "x", points, few, 16).first()) == pytest.approx(want, abs=1e-9)
    assert list(stats.overall_quantiles(spark.createDataFrame([], "x double"), "x", [0.5]).first()) == [None]


def test_dead_links_with_another_verdict_are_neither(spark):
    rows = [("l1", '{"verdict": "confirmed"}'), ("l2", '{"verdict": "not_confirmed"}'), ("l3", None), ("l3", None)]
    got = {r.evidence: (r.n_items, r.n_links) for r in monitor.dead_link_split(spark.createDataFrame(rows, "link string, e string"), "e").collect()}
    assert got == {"confirmed": (1, 1), "legacy": (2, 1)}


def test_hotels_reconcile_only_if_each_accepted_key_is_there_once(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "hotel_id int")
    got = merge.reconcile_hotels(ids(1, 1, 2, 3), ids(3), ids(1, 2), "hotel_id").first()
    assert (got.n_source, got.n_rejected, got.n_accepted, got.n_distinct, got.n_duplicate_keys, got.ok) == (4, 1, 3, 2, 1, True)
    assert not merge.reconcile_hotels(ids(1, 2), ids(), ids(1), "hotel_id").first().ok
    assert not merge.reconcile_hotels(ids(1), ids(), ids(1, 1), "hotel_id").first().ok
