import datetime as dt
import random

import pytest

from staylens.operators import features


def _brute(hotels, gap, least, most):
    out = set()
    for h, c, s, _ in hotels:
        near = sorted((round(abs(s - s2), 6), h2) for h2, c2, s2, n2 in hotels if None not in (c, s, s2) and c2 == c and h2 != h and n2 is not None and n2 >= 50 and round(abs(s - s2), 6) <= gap)
        if len(near) >= least:
            out |= {(h, o, k + 1) for k, (_, o) in enumerate(near[:most])}
    return out


@pytest.mark.parametrize(("digits", "n"), [(1, 250), (3, 250), (0, 120)])
def test_competitor_sets_equal_all_pairs(spark, digits, n):
    r = random.Random(digits)
    hotels = [(i, r.choice(["a", "a", "b", None]), r.choice([round(r.uniform(5, 10), digits)] * 9 + [None]), r.choice([10, 49, 50, 900, None])) for i in range(n)]
    df = spark.createDataFrame(hotels, "hotel_id long, city string, review_score double, review_count int")
    for gap, least, most in ((0.5, 5, 15), (0.1, 1, 3)):
        got = [tuple(x) for x in features.competitor_set(df, gap, 50, least, most).collect()]
        assert len(got) == len(set(got)) and set(got) == _brute(hotels, gap, least, most)
    assert features.competitor_set(df.filter("hotel_id < 0")).collect() == []


def test_a_city_of_50_000_hotels(spark):
    df = spark.range(50_000).selectExpr("id AS hotel_id", "'a' AS city", "round(6 + (id * 7919 % 4000) / 1000D, 3) AS review_score", "cast(id % 100 AS int) AS review_count")
    found = features.competitor_set(df)
    assert found.count() == 50_000 * 15
    hotels = [tuple(x) for x in df.collect()]
    for h in (0, 777, 49_999):
        mine = hotels[h]
        near = sorted((round(abs(mine[2] - s), 6), i) for i, _, s, n in hotels if i != h and n >= 50)[:15]
        assert sorted((x.rank, x.competitor_id) for x in found.filter(f"hotel_id = {h}").collect()) == [(k + 1, i) for k, (_, i) in enumerate(near)]


def test_holidays_from_both_sides(spark):
    d = lambda n: dt.date(2026, 2, 1) + dt.timedelta(n)
    days = spark.createDataFrame([(d(5), None, False, False), (d(9), "x", True, False), (d(20), "y", False, True), (d(5), None, False, False), (None, "x", True, True)], "holiday_date date, city string, is_tet boolean, is_festival boolean")
    rows = [(1, "x", d(7)), (2, "y", d(7)), (3, None, d(7)), (4, "x", d(4)), (5, "x", None), (6, "z", d(5)), (6, "z", d(5)), (7, "y", d(30))]
    got = features.nearest_holidays(spark.createDataFrame(rows, "id int, city string, night date"), "night", "city", days)
    told = sorted(tuple(r) for r in got.select("id", "days_since_holiday", "days_to_holiday", "days_to_nearest_holiday", "days_to_tet", "days_to_festival", "is_holiday", "is_eve").collect())
    assert told == [(1, 2, 2, 2, 2, None, False, False), (2, 2, 13, 2, None, 13, False, False), (3, 2, None, 2, None, None, False, False), (4, None, 1, 1, 5, None, False, True), (5, None, None, None, None, None, False, False), (6, 0, 0, 0, None, None, True, False), (6, 0, 0, 0, None, None, True, False), (7, 10, None, 10, None, None, False, False)]
