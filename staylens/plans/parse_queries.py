"""Queries over what is read from texts: cities, room conditions, occupancy, taxes, discounts, errors, URL dates.

The given tables have no such texts, so each row of one gets a text by its key, composed or decomposed.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from ..functions import text
from ..functions.stats import r6
from ..sources.bindings import dealt, events_warehouse, pick, read
from .preludes import events_sql, names_sql
from .registry import query


def _apart(x: str) -> str:
    return unicodedata.normalize("NFD", x)


_NAMES = ["Phòng 30m² hướng biển", "Phòng 30 m² hướng biển", _apart("Phòng Ｄｅｌｕｘｅ ban công"), "ﬁne Double Bed ½", "Giường đôi, nhìn ra thành phố", "Phòng Ⅳ · 25 ft", "", None]
# What the names come to, worked out by hand.
_CANONICAL = ["room 30m2 sea view", "room 30 m2 sea view", "room deluxe balcony", "fine double 1 2", "double city view", "room iv 25 ft", "", ""]
_AREAS = ["30m", "30m", None, None, None, "25ft", None, None]


@query(f"SELECT p_partkey, {names_sql(_CANONICAL, 'p_partkey % 8')} AS canonical, {names_sql(_AREAS, 'p_partkey % 8')} AS area, sha256({names_sql(_CANONICAL, 'p_partkey % 8')} || ' ' || lower(regexp_replace(p_name, '[^A-Za-z0-9]+', ' ', 'g'))) AS with_name FROM part")
def canonical_room_names(spark, sf_dir):
    p = dealt(read(spark, sf_dir, "part").select("p_partkey", "p_name")).withColumn("told", pick(F.col("p_partkey") % 8, _NAMES))
    return p.select("p_partkey", text.canonical_text("told").alias("canonical"), text.normal_area("told").alias("area"), F.sha2(F.concat_ws(" ", text.canonical_text("told"), text.canonical_text("p_name")), 256).alias("with_name"))


_PLACES = ["12 Lê Lợi, Quận 1, TP. Hồ Chí Minh", _apart("5 Phố Huế, Hà Nội"), "Dalat, Lam Dong", "Vũng Tàu", "Phu Quoc Island", "Danang", "Hanoian street 3", None]
_MARKETS = [None, "Saigon", "", "Hà Nội (trung tâm)", "elsewhere"]
_PADDED = "' ' || trim(regexp_replace(lower(strip_accents(replace(replace(coalesce({}, ''), 'đ', 'd'), 'Đ', 'D'))), '[^a-z0-9]+', ' ', 'g')) || ' '"


def _city_sql(column: str) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'''contains({column}, ' {n} ')''' for n in names)} THEN '{city}'" for city, names in text.CITY_NAMES.items()) + " END"


@query(f"WITH t AS (SELECT c_custkey, {names_sql(_PLACES, 'c_custkey % 8')} AS a, {names_sql(_MARKETS, 'c_custkey % 5')} AS m FROM customer), w AS (SELECT c_custkey, {_PADDED.format('a')} AS a, {_PADDED.format('m')} AS m FROM t) SELECT c_custkey, coalesce({_city_sql('m')}, {_city_sql('a')}) AS city FROM w")
def canonical_city_of_addresses(spark, sf_dir):
    c = dealt(read(spark, sf_dir, "customer").select("c_custkey")).select("c_custkey", pick(F.col("c_custkey") % 8, _PLACES).alias("address"), pick(F.col("c_custkey") % 5, _MARKETS).alias("market"))
    return c.select("c_custkey", text.canonical_city("address", "market").alias("city"))


_LINES = ["Bao gồm bữa sáng", _apart("Miễn phí hủy, bao gồm bữa sáng"), "Không hoàn tiền", "Phí hủy: 50%", " Còn 3 phòng ", _apart("Còn 12 căn"), "Free cancellation before 1 May", "wifi", "", None, "Non-refundable, breakfast included"]
_LINE_SQL = f"""WITH t AS (SELECT p_partkey, [{names_sql(_LINES, 'p_partkey % 11')}, {names_sql(_LINES, 'p_partkey // 11 % 11')}] AS two, p_partkey % 13 = 0 AS none FROM part),
    l AS (SELECT p_partkey, list_filter(list_transform(CASE WHEN none THEN [] ELSE two END, lambda x: trim(nfc_normalize(coalesce(x, '')))), lambda x: x <> '') AS l FROM t),
    f AS (SELECT *, list_filter(l, lambda x: regexp_matches(x, '(?i)miễn phí hủy|hủy miễn phí|free cancellation') OR regexp_matches(x, '(?i)không hoàn tiền|phí hủy[:\\s]|non-?refundable')) AS c, list_filter(l, lambda x: regexp_matches(x, '(?i)còn\\s+(\\d+)\\s*(?:căn|phòng)')) AS r FROM l)
    SELECT p_partkey, CASE WHEN NOT (p_partkey % 13 = 0) THEN len(list_filter(l, lambda x: regexp_matches(x, '(?i)bao gồm bữa sáng|bao bữa sáng|breakfast included'))) > 0 END AS breakfast_included,
           CASE WHEN len(c) > 0 THEN regexp_matches(c[-1], '(?i)miễn phí hủy|hủy miễn phí|free cancellation') END AS free_cancellation,
           nullif(array_to_string(list_filter(l, lambda x: regexp_matches(x, '(?i)hủy|hoàn tiền|refund|cancellation')), ' | '), '') AS cancellation_policy,
           CASE WHEN len(r) > 0 THEN cast(regexp_extract(r[-1], '(?i)còn\\s+(\\d+)\\s*(?:căn|phòng)', 1) AS int) END AS rooms_left FROM f"""


@query(_LINE_SQL)
def room_conditions_of_lines(spark, sf_dir):
    two = F.array(pick(F.col("p_partkey") % 11, _LINES), pick(F.floor(F.col("p_partkey") / 11) % 11, _LINES))
    p = dealt(read(spark, sf_dir, "part").select("p_partkey")).select("p_partkey", F.when(F.col("p_partkey") % 13 == 0, F.array().cast("array<string>")).otherwise(two).alias("lines"))
    return p.select("p_partkey", text.room_conditions("lines").alias("c")).select("p_partkey", "c.*")


_ROOMS = ["Phòng 4 người", _apart("Phòng 3 người"), "Triple room", "quadruple", "QUAD room", "double for 2 people", "10 people", "single", None]


@query(f"WITH t AS (SELECT p_partkey, p_size % 4 AS scraped, lower(nfc_normalize(coalesce({names_sql(_ROOMS, 'p_partkey % 9')}, ''))) AS n FROM part) SELECT p_partkey, greatest(CASE WHEN regexp_matches(n, '\\b[1-9]\\s*(?:người|nguoi|person|people)\\b') THEN cast(regexp_extract(n, '\\b([1-9])\\s*(?:người|nguoi|person|people)\\b', 1) AS int) WHEN regexp_matches(n, '\\btriple\\b') THEN 3 WHEN regexp_matches(n, '\\bquad(?:ruple)?\\b') THEN 4 END, scraped::int) AS occupancy FROM t")
def occupancy_of_room_names(spark, sf_dir):
    p = read(spark, sf_dir, "part").withColumn("told", pick(F.col("p_partkey") % 9, _ROOMS))
    return p.select("p_partkey", text.occupancy_by_name("told", F.col("p_size") % 4).alias("occupancy"))


_TAXES = ["Đã bao gồm thuế và phí", _apart("Chưa bao gồm thuế và phí"), "+ VND 120.000 thuế và phí", "taxes and fees: VND 99,500", _apart("Thuế,  phí\n VND 1.200.000"), "includes taxes and fees, VND 5", "price", None]


@query(f"""WITH t AS (SELECT p_partkey, trim(regexp_replace(nfc_normalize(coalesce({names_sql(_TAXES, 'p_partkey % 8')}, '')), '\\s+', ' ', 'g')) AS t FROM part),
    a AS (SELECT p_partkey, t, coalesce(nullif(regexp_extract(t, '(?i)(?:thuế và phí|thuế, phí|taxes and fees)[^\\d]{{0,30}}VND\\s*([\\d.,]+)', 1), ''), nullif(regexp_extract(t, '(?i)\\+\\s*VND\\s*([\\d.,]+)[^\\d]{{0,30}}(?:thuế và phí|thuế, phí|taxes and fees)', 1), '')) AS n FROM t)
    SELECT p_partkey, CASE WHEN regexp_matches(t, '(?i)đã bao gồm thuế và phí|includes taxes and fees') THEN true WHEN regexp_matches(t, '(?i)chưa bao gồm thuế và phí|excludes taxes and fees') OR regexp_matches(t, '(?i)\\+\\s*VND\\s*([\\d.,]+)[^\\d]{{0,30}}(?:thuế và phí|thuế, phí|taxes and fees)') THEN false END AS price_includes_tax, try_cast(regexp_replace(n, '[.,]', '', 'g') AS double) AS taxes_fees FROM a""")
def tax_of_texts(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", text.tax_info(pick(F.col("p_partkey") % 8, _TAXES)).alias("t"))
    return p.select("p_partkey", "t.*")


_DISCOUNTS, _BADGES = ["Tiết kiệm 20%", _apart("Giảm 15%"), "giam 5%", "no discount", None], ["Ưu đãi 7 %", _apart("tiết kiệm 9%"), "10%", None]


@query(f"WITH t AS (SELECT p_partkey, nfc_normalize(coalesce({names_sql(_DISCOUNTS, 'p_partkey % 5')}, '')) AS t, lower(nfc_normalize(coalesce({names_sql(_BADGES, 'p_partkey % 4')}, ''))) AS b FROM part) SELECT p_partkey, cast(coalesce(nullif(regexp_extract(t, '(?i)(?:ti[ếe]t ki[ệe]m|gi[aả]m)\\s+(\\d+)%', 1), ''), CASE WHEN regexp_matches(b, 'tiết kiệm|ưu đãi') THEN nullif(regexp_extract(b, '(\\d+)\\s*%', 1), '') END) AS int) AS discount FROM t")
def discount_of_texts(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.select("p_partkey", text.discount_percent(pick(F.col("p_partkey") % 5, _DISCOUNTS), pick(F.col("p_partkey") % 4, _BADGES)).alias("discount"))


_ERRORS = ["Timeout after 30 s", "net::ERR_CONNECTION_RESET", "please verify you are human", "Access Denied", "chromedriver is gone", "Robot check", "odd", None]


@query(events_sql(f"t AS (SELECT item_id, lower(coalesce({names_sql(_ERRORS, 'item_id % 8')}, '')) AS m FROM items), c AS (SELECT item_id, CASE WHEN regexp_matches(m, 'timeout|timed out|err_connection_reset') THEN 'NETWORK_TIMEOUT' WHEN regexp_matches(m, 'captcha|verify you are human') THEN 'CAPTCHA' WHEN regexp_matches(m, 'access denied|blocked|robot') THEN 'BLOCKED' WHEN regexp_matches(m, 'driver|chrome|edge') THEN 'DRIVER_INIT' WHEN item_id % 5 = 0 THEN 'SOLD_OUT' ELSE 'UNKNOWN' END AS error_code FROM t) SELECT item_id, error_code, error_code NOT IN ('PROPERTY_NOT_BOOKABLE', 'INVALID_LINK', 'SOLD_OUT') AS retryable FROM c"))
def error_codes_of_messages(spark, sf_dir):
    i = events_warehouse(spark, sf_dir).items.select("item_id", text.error_code(pick(F.col("item_id") % 8, _ERRORS)).alias("code"))
    settled = F.when((F.col("code") == "UNKNOWN") & (F.col("item_id") % 5 == 0), "SOLD_OUT").otherwise(F.col("code"))
    return i.select("item_id", settled.alias("error_code")).withColumn("retryable", text.retryable("error_code"))


@query(events_sql("u AS (SELECT item_id, checkin_date, checkout_date, link || CASE item_id % 3 WHEN 0 THEN '&checkout=' || cast(checkout_date AS varchar) WHEN 1 THEN '&x=1&checkout=' || cast(checkout_date + 1 AS varchar) || '#checkout' ELSE '' END AS url FROM items) SELECT item_id, coalesce(regexp_extract(url, '[?&]checkin=([^&#]*)', 1) = cast(checkin_date AS varchar) AND regexp_extract(url, '[?&]checkout=([^&#]*)', 1) = cast(checkout_date AS varchar), false) AS agrees FROM u"))
def url_dates_agree(spark, sf_dir):
    i = events_warehouse(spark, sf_dir).items
    tail = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("&checkout="), F.col("checkout_date").cast("string"))).when(F.col("item_id") % 3 == 1, F.concat(F.lit("&x=1&checkout="), F.date_add("checkout_date", 1).cast("string"), F.lit("#checkout"))).otherwise("")
    return i.withColumn("url", F.concat("link", tail)).select("item_id", text.url_agrees("url", "checkin_date", "checkout_date").alias("agrees"))


@query("SELECT p_partkey, round(p_retailprice::double, 6) AS price FROM part")
def price_numbers_of_texts(spark, sf_dir):
    """Prices written with separators, two digits after the last of them, read back."""
    p = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("VND "), F.format_number(F.col("p_retailprice").cast("double"), 2), F.lit(" / đêm")).alias("t"))
    return p.select("p_partkey", r6(text.price_number("t") / 100).alias("price"))
