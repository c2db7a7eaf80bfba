import hashlib
import json
import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from staylens.functions import keys, text
from staylens.functions import timeaxis as ta


def _one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) and not isinstance(v, bool) else 'boolean' if isinstance(v, bool) else 'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())) if values else spark.range(1)
    return row.select(expr.alias("x")).first().x


def _canonical(value):
    t = "".join(c for c in unicodedata.normalize("NFKD", value or "") if not unicodedata.combining(c)).replace("đ", "d").replace("Đ", "D").lower()
    t = " ".join(re.sub("[^a-z0-9]+", " ", t).split())
    for a, b in text.ALIASES.items():
        t = re.sub(rf"\b{a}\b", b, t)
    return " ".join(t.split())


def test_canonical_text_as_in_python(spark):
    said = ["Phòng Giường Đôi  có Ban Công", "KING BED, hướng biển!", None, "", "Nhìn ra thành phố 2", "Ä ö ß é", "giường đơn / single bed"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(said)], "i int, t string").select("i", text.canonical_text("t").alias("c")).collect()
    assert {r.i: r.c for r in rows} == {i: _canonical(x) for i, x in enumerate(said)}


def test_room_and_rate_keys_as_in_python(spark):
    row = ("Phòng Deluxe", 2, "1 giường đôi", "25 m²", True, None, "Hủy miễn phí")
    df = spark.createDataFrame([row], "n string, o int, b string, a string, bf boolean, fc boolean, p string")
    got = df.select(keys.room_key("n", "o", "b", "a").alias("room"), keys.rate_key("bf", "fc", "p").alias("rate")).first()
    digest = lambda d: hashlib.sha256(json.dumps(d, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert got.room == digest({"name": _canonical(row[0]), "occupancy": 2, "bed": _canonical(row[2]), "area": "25m"})
    assert got.rate == digest({"breakfast": True, "free_cancellation": None, "cancellation_policy": _canonical(row[6])})


def test_area_city_conditions(spark):
    assert _one(spark, text.normal_area(F.col("a")), a="Diện tích 32 m²") == "32m"
    assert _one(spark, text.normal_area(F.col("a")), a="large") is None
    assert _one(spark, text.canonical_city("a", "m"), a="12 Lê Lợi, Đà Lạt", m="Sài Gòn") == "Hồ Chí Minh"
    assert _one(spark, text.canonical_city("a", "m"), a="12 Lê Lợi, Đà Lạt", m="x") == "Đà Lạt"
    assert _one(spark, text.canonical_city("a", "m"), a="Phanoi road", m="x") is None
    got = _one(spark, text.room_conditions("l"), l=["Bao gồm bữa sáng", "Miễn phí hủy trước 2 ngày", "Còn 3 phòng"])
    assert (got.breakfast_included, got.free_cancellation, got.cancellation_policy, got.rooms_left) == (True, True, "Miễn phí hủy trước 2 ngày", 3)
    got = _one(spark, text.room_conditions("l"), l=["Không hoàn tiền"])
    assert (got.breakfast_included, got.free_cancellation, got.rooms_left) == (False, False, None)
    got = _one(spark, text.room_conditions("l"), l=[])
    assert got.breakfast_included is None and got.cancellation_policy is None


def test_room_class_and_occupancy(spark):
    assert _one(spark, text.room_class("n", "o", "b"), n="Deluxe Suite", o=2, b=True) == "suite_1-2p_bf"
    assert _one(spark, text.room_class("n", "o", "b"), n="Phòng Tiêu Chuẩn", o=3, b=False) == "standard_3p+_nobf"
    assert _one(spark, text.occupancy_by_name("n", "o"), n="Phòng 4 Người", o=2) == 4
    assert _one(spark, text.occupancy_by_name("n", "o"), n="Triple Room", o=5) == 5
    assert _one(spark, text.occupancy_by_name("n", "o"), n="Quadruple", o=2) == 4


def test_urls(spark):
    u = "https://www.example.com/hotel/vn/sunny-stay.vi.html?aid=1#x"
    assert _one(spark, text.hotel_slug("u"), u=u) == "sunny-stay"
    assert _one(spark, text.hotel_slug("u"), u="https://www.example.com/city/vn.html") is None
    assert _one(spark, text.without_query("u"), u=u) == u.split("?")[0]
    dated = _one(spark, text.dated_url("u", F.lit("2026-01-01").cast("date"), F.lit("2026-01-02").cast("date")), u=u)
    assert dated.startswith(u.split("?")[0] + "?") and dated.endswith("checkin=2026-01-01&checkout=2026-01-02")
    agrees = text.url_agrees("u", F.lit("2026-01-01").cast("date"), F.lit("2026-01-02").cast("date"))
    assert _one(spark, agrees, u=dated) is True and _one(spark, agrees, u=u) is False


def test_prices_taxes_states_errors(spark):
    assert _one(spark, text.price_number("t"), t="VND 1.234.567 / đêm") == 1234567.0
    assert _one(spark, text.price_number("t"), t="none") is None
    got = _one(spark, text.tax_info("t"), t="VND 500.000 + VND 50.000 thuế và phí")
    assert (got.price_includes_tax, got.taxes_fees) == (False, 50000.0)
    assert _one(spark, text.tax_info("t"), t="Đã bao gồm thuế và phí").price_includes_tax is True
    assert _one(spark, text.discount_percent("t"), t="Tiết kiệm 15%") == 15
    assert _one(spark, text.discount_percent("t", "b"), t="", b="Ưu đãi 20 %") == 20
    state = text.page_state("t", ["hết phòng"], ["không nhận đặt"])
    assert [_one(spark, state, t=t) for t in ("CAPTCHA hết phòng", "Access denied", "không nhận đặt; hết phòng", "Hết phòng", "ok")] == ["captcha", "blocked", "not_bookable", "sold_out", "open"]
    assert [_one(spark, text.error_code("m"), m=m) for m in ("Read timed out", "captcha", "robot check", "chrome not reachable", "?")] == ["NETWORK_TIMEOUT", "CAPTCHA", "BLOCKED", "DRIVER_INIT", "UNKNOWN"]


def test_buckets_cover_every_lead_time(spark):
    rows = spark.range(-3, 100).select(F.col("id").alias("n"), ta.bucket("id").alias("b"), ta.item_bucket("id").alias("i"), ta.bucket_order(ta.bucket("id")).alias("o")).collect()
    assert [r.b for r in rows[:4]] == [None, None, None, "0"] and rows[0].i == "(invalid)"
    assert {r.b for r in rows[3:]} == {x for x, _ in ta.BUCKETS}
    assert [r.o for r in rows[3:]] == sorted(r.o for r in rows[3:])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 10**7)), min_size=1, max_size=40, unique=True))
def test_numbers_follow_the_order(pairs):
    from pyspark.sql import SparkSession

    df = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    got = keys.numbered(df.createDataFrame(pairs, "p int, k long"), "p", "k", chunk=1_000_000).collect()
    assert {(r.p, r.k): r.warehouse_id for r in got} == {x: i + 1 for i, x in enumerate(sorted(pairs))}


def test_checksum_is_of_rows_not_order(spark):
    df = spark.range(100).withColumn("x", F.col("id") * 2)
    a = keys.table_checksum(df, "t").first()
    assert a == keys.table_checksum(df.orderBy(F.desc("id")).repartition(5), "t").first()
    assert a != keys.table_checksum(df.withColumn("x", F.col("x") + (F.col("id") == 7).cast("int")), "t").first()
    assert keys.table_checksum(df, "t", ["x"]).first().n_rows == 100


def test_keys_by_dictionary_equal_keys_by_row(spark):
    from staylens.functions import keys

    rows = [(i, i % 3 == 0, ["Phòng Đôi", "phong doi", None, "DELUXE Sea  View"][i % 4], [2, None, 3][i % 3], ["1 double", None][i % 2], "20 m²" if i % 5 else None, bool(i % 2), None, ["free", "Free", None][i % 3], "x", 7) for i in range(60)] + [(99, None, "a", 1, None, None, None, None, None, "x", 7)] * 3
    df = spark.createDataFrame(rows, "hotel_id int, is_sold_out boolean, room_name string, max_occupancy int, bed_config string, room_area string, breakfast_included boolean, free_cancellation boolean, cancellation_policy string, checkin_date string, n int").withColumn("checkin_date", F.lit("2026-01-02").cast("date"))
    sold = F.coalesce("is_sold_out", F.lit(False))
    none = lambda kind: F.lit(None).cast(kind)
    want = df.withColumn("canonical_room_key", F.when(sold, keys.room_key(none("string"), none("int"), none("string"), none("string"))).otherwise(keys.room_key("room_name", "max_occupancy", "bed_config", "room_area")))
    want = want.withColumn("canonical_rate_key", F.when(sold, keys.rate_key(none("boolean"), none("boolean"), none("string"))).otherwise(keys.rate_key("breakfast_included", "free_cancellation", "cancellation_policy")))
    want = want.withColumn("canonical_series_id", keys.series_key("hotel_id", "checkin_date", "canonical_room_key", "canonical_rate_key"))
    got = keys.curated_keys(df)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert keys.curated_keys(df.filter("n < 0")).collect() == []
