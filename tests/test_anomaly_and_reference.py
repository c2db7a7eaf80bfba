import datetime as dt

from pyspark.sql import functions as F

from staylens.operators import anomaly, catalog, reference, review_log

D = dt.date


def test_low_price_tiers(spark):
    df = spark.createDataFrame([(1, 9_999.0), (2, 10_000.0), (3, 49_999.0), (4, 50_000.0)], "record_id int, price_per_night double")
    assert {r.record_id: r.severity for r in anomaly.low_price(df).collect()} == {1: "high", 2: "notable", 3: "notable"}


def test_context_needs_two_other_rooms(spark):
    rows = [(1, "a", 1000.0), (1, "b", 100.0), (1, "c", 120.0), (2, "a", 1000.0), (2, "b", 10.0), (3, "a", 500.0), (3, "b", 510.0), (3, "c", 520.0)]
    df = spark.createDataFrame(rows, "item_id int, room_key string, price_per_night double")
    got = anomaly.context_high(df).collect()
    assert [(r.item_id, r.room_key, r.context_median, r.context_room_count) for r in got] == [(1, "a", 110.0, 2)]


def test_temporal_needs_items_and_dates_before(spark):
    base = [(i, 1, "r", D(2026, 1, 1 + i // 2), 100.0) for i in range(5)]
    df = spark.createDataFrame([*base, (9, 1, "r", D(2026, 1, 9), 500.0), (10, 2, "r", D(2026, 1, 9), 500.0)], "item_id int, hotel_id int, room_key string, day date, rep_price double")
    assert [r.item_id for r in anomaly.temporal_shift(df, ["hotel_id", "room_key"], ["day", "item_id"], "day").collect()] == [9]
    assert anomaly.temporal_shift(df.filter("item_id > 0"), ["hotel_id", "room_key"], ["day", "item_id"], "day").count() == 0


def test_whole_hotel_takes_the_nearest_passing_baseline(spark):
    rows = [(i, 1, D(2026, 1, i), f"r{k}", 100.0 + k) for i in (1, 2) for k in range(6)] + [(3, 1, D(2026, 1, 3), f"r{k}", 2.5 * (100.0 + k)) for k in range(6)]
    df = spark.createDataFrame(rows, "item_id int, hotel_id int, day date, room_key string, rep_price double")
    got = anomaly.hotel_wide_shift(df, ["hotel_id"], ["day"]).collect()
    assert [(r.item_id, r.offset, r.baseline_item_id, r.n_pairs, r.n_other_baselines) for r in got] == [(3, 1, 2, 6, 1)]
    assert anomaly.hotel_wide_shift(df.filter("room_key < 'r4'"), ["hotel_id"], ["day"]).count() == 0


def test_match_scores(spark):
    rows = [("deluxe double room", 2, "20 m", "k1", "p", "k1", "p", "deluxe double room", 2, "20 m"), ("deluxe double room", 2, "20 m", "k2", "p", "k1", "p", "room deluxe double", 2, "20 m"), ("deluxe double room", 2, "20 m", "k2", "q", "k1", "p", "deluxe double room", 2, "20 m"), ("suite", 4, "50 m", "k3", "p", "k1", "p", "deluxe double room", 2, "20 m")]
    df = spark.createDataFrame(rows, "room_name string, max_occupancy int, room_area string, room_key string, rate_key string, ref_room_key string, ref_rate_key string, ref_room_name string, ref_max_occupancy int, ref_room_area string")
    got = [(r.m.match, r.m.score) for r in df.select(reference.match_score().alias("m")).collect()]
    assert got == [("exact", 1.0), ("alias", 1.0), ("not_reference", 0.9), ("not_reference", 0.1)]


def test_best_match_is_ambiguous_on_a_tie(spark):
    df = spark.createDataFrame([(1, 0, "alias", 0.9), (1, 1, "alias", 0.9), (2, 0, "exact", 1.0), (2, 1, "alias", 0.9), (3, 0, "not_reference", 0.7)], "item_id int, option_index int, match string, score double")
    got = {r.item_id: (r.match_status, r.option_index) for r in reference.best_match(df, ["item_id"]).collect()}
    assert got == {1: ("ambiguous", None), 2: ("exact", 0), 3: ("unavailable", None)}


def test_references_are_approved_by_evidence(spark):
    rows = [(h, D(2026, 2, 1), "k", "p", i, f"run{i}", D(2026, 1, i), 2) for h, n in ((1, 3), (2, 2)) for i in range(1, n + 1)]
    found = spark.createDataFrame(rows, "hotel_id int, checkin_date date, room_key string, rate_key string, item_id int, run_id string, crawl_date date, max_occupancy int")
    assert {r.hotel_id: r.status for r in reference.build(found).collect()} == {1: "approved", 2: "proposed"}
    got = reference.causal_assignment(found).collect()
    assert [(r.hotel_id, r.approved_on) for r in got] == [(1, D(2026, 1, 3))]


def test_turnover_fixture(spark):
    days = spark.createDataFrame([(1, D(2026, 1, d)) for d in (1, 2, 4, 5, 8)], "s int, crawl_date date")
    r = catalog.series_facts(days, ["s"]).first()
    assert (r.max_gap_days, r.n_reappearance_events, r.median_gap_days, r.span_days) == (3, 2, 1.5, 8)
    assert (r.n_pairs_h1, r.n_pairs_h3, r.n_pairs_h7, r.n_pairs_h14) == (2, 3, 1, 0)


LOG = "sequence long, event_id string, action string, review_id string, target_review_id string, decision string, decided_at timestamp, members array<struct<source_code:string,record_id:long,fingerprint:string>>"


def _t(n):
    return dt.datetime(2026, 1, 1) + dt.timedelta(hours=n)


def _log(spark, rows):
    return spark.createDataFrame([(i + 1, f"e{i}", *r[:4], _t(i), r[4]) for i, r in enumerate(rows)], LOG)


M1, M2 = [("a", 1, "f1")], [("a", 1, "f1"), ("a", 2, "f2")]


def test_replay(spark):
    log = _log(spark, [("activate", "r1", None, "exclude_from_train", M2), ("supersede", "r2", "r1", "keep", M2), ("activate", "r3", None, "exclude_from_train", [("b", 5, "x")]), ("retract", None, "r3", None, [])])
    assert review_log.violations(log, ["a", "b"]).count() == 0
    assert {r.review_id: r.state for r in review_log.review_states(log).collect()} == {"r1": "superseded", "r2": "active", "r3": "retracted"}
    assert {(r.record_id, r.review_id) for r in review_log.resolutions(log).collect()} == {(1, "r2"), (2, "r2")}
    early = review_log.as_of(log, _t(0))
    assert {r.decision for r in review_log.resolutions(early).collect()} == {"exclude_from_train"}


def test_each_broken_rule_is_told(spark):
    def told(rows, sources=("a", "b")):
        return {r.violation for r in review_log.violations(_log(spark, rows), list(sources)).collect()}

    a = ("activate", "r1", None, "keep", M1)
    assert told([a, ("activate", "r2", None, "keep", M1)]) == {"overlapping_ownership"}
    assert told([a, ("supersede", "r2", "r1", "keep", M2)]) == {"supersede_changes_members"}
    assert told([a, ("retract", None, "r1", None, []), ("retract", None, "r1", None, [])]) == {"target_not_active"}
    assert told([a, ("retract", None, "r9", None, [])]) == {"target_unknown"}
    assert told([("activate", "r1", None, "keep", M1 + M1)]) == {"member_repeated"}
    assert told([a, ("activate", "r1", None, "keep", [("b", 3, "z")])]) == {"review_id_reused"}
    assert told([a], ["b"]) == {"unknown_source"}
    assert told([("shrug", "r1", None, "keep", M1)]) == {"unknown_action"}
    assert told([a, ("retract", None, "r1", None, []), ("activate", "r4", None, "keep", M1)]) == set()
    log = _log(spark, [a]).unionByName(_log(spark, [a]).withColumn("sequence", F.lit(3).cast("long")).withColumn("review_id", F.lit("r7")))
    assert {"sequence_gap", "event_id_repeated"} <= {r.violation for r in review_log.violations(log, ["a"]).collect()}
