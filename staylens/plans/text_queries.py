"""Queries over text, URL, option and key operators."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from ..functions import keys, text
from ..functions import timeaxis as ta
from ..functions.stats import r6
from ..operators import options
from ..sources.bindings import events_warehouse, orders_warehouse, pick, read
from .preludes import BUCKET, BUCKET_ORDER, events_sql, names_sql, orders_sql
from .registry import query

#: Options that a task sorts at most, roughly, where windows go over items.
PER_TASK = 500_000

_ALIASED = "trim(regexp_replace(regexp_replace(lower(strip_accents(coalesce({0}, ''))), '[^a-z0-9]+', ' ', 'g'), '^ | $', '', 'g'))"


def _canonical(column: str) -> str:
    out = _ALIASED.format(column)
    for phrase, stands in text.ALIASES.items():
        out = rf"regexp_replace({out}, '\b{phrase}\b', '{stands}', 'g')"
    return out


@query(f"SELECT doc_id, sha256({_canonical('text')}) AS canonical_sha256, length({_canonical('text')})::bigint AS n_chars_canonical FROM documents")
def canonical_document_text(spark, sf_dir):
    t = read(spark, sf_dir, "documents").select("doc_id", text.canonical_text("text").alias("t"))
    return t.select("doc_id", F.sha2("t", 256).alias("canonical_sha256"), F.length("t").cast("long").alias("n_chars_canonical"))


_SET = "list_distinct(string_split({}, ' '))"


@query(
    f"""WITH t AS (SELECT p_partkey, list_filter({_SET.format(_canonical('p_name'))}, lambda x: x <> '') AS a, list_filter({_SET.format(_canonical("(p_type || ' ' || p_name || ' ' || p_brand)"))}, lambda x: x <> '') AS b FROM part)
    SELECT p_partkey, round(CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) ELSE 0 END, 6) AS similarity FROM t"""
)
def token_similarity_of_names(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.select("p_partkey", r6(text.token_similarity("p_name", F.concat_ws(" ", "p_type", "p_name", "p_brand"))).alias("similarity"))


_PATH = "regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


@query(
    f"""WITH p AS (SELECT page_id, url, list_filter(string_split({_PATH}, '/'), lambda x: x <> '') AS parts, regexp_replace(url, '[?#][\\s\\S]*$', '') AS bare FROM pages)
    SELECT page_id, CASE WHEN len(parts) > 0 THEN lower(split_part(parts[-1], '.', 1)) END AS slug, bare AS clean_url,
           bare || '?group_adults=2&group_children=0&no_rooms=1&lang=vi&selected_currency=VND&checkin=2026-01-01&checkout=2026-01-02' AS search_url, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page_parameter FROM p"""
)
def url_parts_of_pages(spark, sf_dir):
    day = lambda x: F.lit(x).cast("date")
    return read(spark, sf_dir, "pages").select("page_id", text.last_segment("url").alias("slug"), text.without_query("url").alias("clean_url"), text.dated_url("url", day("2026-01-01"), day("2026-01-02")).alias("search_url"), text.query_value("url", "page").alias("page_parameter"))


@query(
    """WITH p AS (SELECT page_id, url, regexp_replace(url, '[?#][\\s\\S]*$', '') || '?group_adults=2&group_children=0&no_rooms=1&lang=vi&selected_currency=VND&checkin=' || cast(DATE '2026-01-01' + (page_id % 30)::int AS varchar) || '&checkout=' || cast(DATE '2026-01-02' + (page_id % 30)::int AS varchar) AS correct_url FROM pages)
    SELECT page_id, correct_url FROM p WHERE page_id % 3 > 0"""
)
def urls_rebuilt_by_date(spark, sf_dir):
    """A third of the pages' URLs are stored as they should be, the others as collected."""
    day = lambda n: F.date_add(F.lit(n).cast("date"), (F.col("page_id") % 30).cast("int"))
    pages = read(spark, sf_dir, "pages").select("page_id", "url", day("2026-01-01").alias("checkin_date"), day("2026-01-02").alias("checkout_date"))
    stored = pages.withColumn("stored_url", F.when(F.col("page_id") % 3 == 0, text.dated_url("url", "checkin_date", "checkout_date")).otherwise(F.col("url")))
    return options.urls_to_correct(stored).select("page_id", "correct_url")


_STRIPPED = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\\b.*?</script>', ' ', 'g'), '(?is)<style\\b.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(
    f"""WITH t AS (SELECT page_id, {_STRIPPED} AS t FROM pages)
    SELECT page_id, length(t)::bigint AS n_chars_text, CASE WHEN contains(lower(t), 'captcha') THEN 'captcha' WHEN contains(lower(t), 'access denied') THEN 'blocked' WHEN contains(lower(t), 'ning') THEN 'not_bookable' WHEN contains(lower(t), 'tion') THEN 'sold_out' ELSE 'open' END AS state,
           try_cast(nullif(regexp_replace(regexp_extract(t, '([0-9.,]+)', 1), '[.,]', '', 'g'), '') AS double) AS first_number FROM t"""
)
def page_state_and_number(spark, sf_dir):
    t = read(spark, sf_dir, "pages").select("page_id", text.tags_stripped("html").alias("t"))
    return t.select("page_id", F.length("t").cast("long").alias("n_chars_text"), text.page_state("t", ["tion"], ["ning"]).alias("state"), text.price_number("t").alias("first_number"))


@query(
    f"""WITH t AS (SELECT page_id, {_STRIPPED} AS t, regexp_extract(html, '<title>([^<]*)', 1) AS title, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages)
    SELECT page_id, 2::int AS n_fields, ((NOT contains(t, title))::int + (NOT contains(t, host))::int)::int AS n_mismatches, concat_ws(',', CASE WHEN NOT contains(t, title) THEN 'title' END, CASE WHEN NOT contains(t, host) THEN 'host' END) AS mismatches FROM t"""
)
def stored_values_against_pages(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    stored = pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"), F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"))
    return options.stored_against_pages(stored, pages, "page_id", ["title", "host"])


@query("""WITH p AS (SELECT page_id, regexp_replace(url, '[?#][\\s\\S]*$', '') AS canonical, coalesce(starts_with(url, 'https://'), false) AS valid FROM pages)
    SELECT page_id, canonical, valid, min(page_id) OVER (PARTITION BY canonical) AS first_row, page_id <> min(page_id) OVER (PARTITION BY canonical) AS duplicate FROM p""")
def link_list_preflight(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return options.link_preflight(pages, "url", "page_id", F.col("url").startswith("https://")).drop("url")


_TIER_NAMES = ["Junior SUITE", "Phòng Deluxe", "superior twin", "Studio", "Phòng gia đình", "Phòng tiêu chuẩn", unicodedata.normalize("NFD", "Phòng gia đình"), "standard family", None]
_TIER_SQL = "CASE WHEN n LIKE '%suite%' THEN 'suite' WHEN n LIKE '%deluxe%' THEN 'deluxe' WHEN n LIKE '%superior%' THEN 'superior' WHEN n LIKE '%studio%' THEN 'studio' WHEN n LIKE '%family%' OR n LIKE '%gia đình%' OR n LIKE '%gia dinh%' THEN 'family' WHEN n LIKE '%standard%' OR n LIKE '%tiêu chuẩn%' OR n LIKE '%tieu chuan%' THEN 'standard' ELSE 'other' END"


@query(orders_sql(f"""t AS (SELECT *, {names_sql(_TIER_NAMES, "item_id % 9")} || ' ' || room_name AS told FROM observations), l AS (SELECT *, lower(nfc_normalize(coalesce(told, ''))) AS n FROM t)
    SELECT item_id, option_index, hotel_id, checkin_date, room_name, price_total, {_TIER_SQL} || '_' || CASE WHEN max_occupancy <= 2 THEN '1-2p' ELSE '3p+' END || '_' || CASE WHEN breakfast_included THEN 'bf' ELSE 'nobf' END AS room_class FROM l"""))
def room_class_of_options(spark, sf_dir):
    """Names get a tier's words in front, composed and decomposed."""
    o = orders_warehouse(spark, sf_dir).observations.withColumn("told", F.concat(pick(F.col("item_id") % 9, _TIER_NAMES), F.lit(" "), "room_name"))
    return o.select("item_id", "option_index", "hotel_id", "checkin_date", "room_name", "price_total", text.room_class("told", "max_occupancy", "breakfast_included").alias("room_class"))


@query(orders_sql("""SELECT item_id, count(*) AS n_options, sum(k - 1)::bigint AS n_duplicates FROM (SELECT item_id, room_name, hotel_id, count(*) AS k FROM observations GROUP BY 1, 2, 3) GROUP BY 1"""))
def exact_duplicate_options(spark, sf_dir):
    o = orders_warehouse(spark, sf_dir, PER_TASK).observations.select("item_id", "option_index", "room_name", "hotel_id")
    left = options.without_duplicates(o, "item_id", "option_index", ["room_name", "hotel_id"])
    return left.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_options"), F.max("n_duplicates").alias("n_duplicates"))


@query(orders_sql("""SELECT item_id, round(price_per_night, 6) AS price, max_occupancy FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY (max_occupancy <= 2) DESC, round(price_per_night, 6) ASC NULLS LAST, max_occupancy) AS k FROM observations) WHERE k = 1"""))
def cheapest_option_for_two(spark, sf_dir):
    o = orders_warehouse(spark, sf_dir, PER_TASK).observations.withColumn("price", r6("price_per_night"))
    return options.cheapest_for_two(o, "item_id", "max_occupancy", "price", "max_occupancy").select("item_id", "price", "max_occupancy")


@query(orders_sql("""SELECT items.item_id, status, count(o.item_id) AS n_rooms, string_agg(o.option_index || ':' || room_name, ';' ORDER BY o.option_index, room_name) AS rooms FROM items LEFT JOIN observations o USING (item_id) GROUP BY 1, 2"""))
def items_with_nested_rooms(spark, sf_dir):
    w = orders_warehouse(spark, sf_dir)
    nested = options.with_rooms(w.items, w.observations, "item_id", ["option_index", "room_name"])
    told = F.nullif(F.array_join(F.transform("rooms", lambda r: F.concat_ws(":", r["option_index"].cast("string"), r["room_name"])), ";"), F.lit(""))
    return nested.select("item_id", "status", F.size("rooms").cast("long").alias("n_rooms"), told.alias("rooms"))


@query(orders_sql("""r AS (SELECT item_id, count(*) AS n, min(hotel_id) AS hotel_id, min(checkin_date) AS checkin_date FROM observations GROUP BY 1)
    SELECT item_id, CASE WHEN status = 'sold_out' THEN 1 ELSE n END AS n_observations, (checkin_date - cast(crawl_date::timestamp + INTERVAL 7 HOUR AS date))::int AS lead_time FROM items JOIN r USING (item_id)"""))
def observations_from_nested_rooms(spark, sf_dir):
    w = orders_warehouse(spark, sf_dir)
    told = w.observations.groupBy("item_id").agg(F.min("hotel_id").alias("hotel_id"), F.min("checkin_date").alias("checkin_date"))
    items = options.with_rooms(w.items.join(told, "item_id"), w.observations, "item_id", ["option_index", "room_name", "max_occupancy", "price_per_night"]).withColumn("observed_at", F.col("crawl_date").cast("timestamp_ntz"))
    built = options.build_observations(items)
    return built.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_observations"), F.max("lead_time").alias("lead_time"))


@query(events_sql("""SELECT item_id, CASE WHEN status = 'not_bookable' THEN 'not_bookable' WHEN status = 'sold_out' THEN 'sold_out' WHEN item_id % 7 = 0 OR item_id % 3 <> greatest(0, item_id % 5 - item_id % 2) THEN 'partial' ELSE 'success' END AS outcome, item_id % 4 = item_id % 3 + item_id % 2 AS accounted FROM items"""))
def item_outcome_from_counts(spark, sf_dir):
    i = F.col("item_id")
    items = events_warehouse(spark, sf_dir).items.select("item_id", (F.col("status") == "not_bookable").alias("nb"), (F.col("status") == "sold_out").alias("so"), F.when(i % 7 == 0, 1).otherwise(0).alias("rej"), (i % 3).alias("saved"), (i % 5).alias("found"), (i % 2).alias("dup"), (i % 4).alias("candidates"), (i % 3).alias("parsed"), (i % 2).alias("rejected"))
    return options.candidate_accounting(items).select("item_id", text.item_outcome("nb", "so", "rej", "saved", "found", "dup").alias("outcome"), "accounted")


@query(events_sql(f"""SELECT item_id, strftime(finished_at + INTERVAL 7 HOUR, '%Y-%m-%d %H:%M:%S') AS local_time, (checkin_date - cast(finished_at + INTERVAL 7 HOUR AS date))::int AS lead_time, lead_time_bucket, {BUCKET_ORDER} AS bucket_order FROM (SELECT *, {BUCKET} AS lead_time_bucket FROM items)"""))
def local_time_and_lead_time(spark, sf_dir):
    items = events_warehouse(spark, sf_dir).items.withColumn("lead_time_bucket", ta.bucket("lead_time"))
    return items.select("item_id", ta.local_text("finished_at").alias("local_time"), ta.lead_time("checkin_date", "finished_at").alias("lead_time"), "lead_time_bucket", ta.bucket_order("lead_time_bucket").alias("bucket_order"))


_NULL = "coalesce('\"' || {} || '\"', 'null')"
_AREA = "nullif(regexp_extract({0}, '([0-9]+)\\s*(m|ft)', 1) || regexp_extract({0}, '([0-9]+)\\s*(m|ft)', 2), '')".format(_canonical("room_area"))
_ROOM_KEY = f"""sha256('{{"area":' || {_NULL.format(_AREA)} || ',"bed":"' || {_canonical('bed_config')} || '","name":"' || {_canonical('room_name')} || '","occupancy":' || coalesce(cast(max_occupancy AS varchar), 'null') || '}}')"""
_RATE_KEY = f"""sha256('{{"breakfast":' || coalesce(cast(breakfast_included AS varchar), 'null') || ',"cancellation_policy":"' || {_canonical('cancellation_policy')} || '","free_cancellation":' || coalesce(cast(free_cancellation AS varchar), 'null') || '}}')"""
_EMPTY_ROOM = """sha256('{"area":null,"bed":"","name":"","occupancy":null}')"""
_EMPTY_RATE = """sha256('{"breakfast":null,"cancellation_policy":"","free_cancellation":null}')"""
_CURATED = f"""k AS (SELECT *, CASE WHEN is_sold_out THEN {_EMPTY_ROOM} ELSE {_ROOM_KEY} END AS canonical_room_key, CASE WHEN is_sold_out THEN {_EMPTY_RATE} ELSE {_RATE_KEY} END AS canonical_rate_key FROM observations),
    c AS (SELECT *, sha256('{{"checkin_date":"' || cast(checkin_date AS varchar) || '","hotel_id":' || hotel_id || ',"rate_key":"' || canonical_rate_key || '","room_key":"' || canonical_room_key || '"}}') AS canonical_series_id FROM k)"""


@query(orders_sql(f"{_CURATED} SELECT item_id, option_index, hotel_id, checkin_date, round(price_total, 6) AS price, canonical_room_key, canonical_rate_key, canonical_series_id FROM c"))
def curated_observation_keys(spark, sf_dir):
    c = keys.curated_keys(orders_warehouse(spark, sf_dir).observations)
    return c.select("item_id", "option_index", "hotel_id", "checkin_date", r6("price_total").alias("price"), "canonical_room_key", "canonical_rate_key", "canonical_series_id")


@query(
    events_sql("""v AS (SELECT item_id, 'price_null_iff_sold_out' AS violation FROM observations WHERE (CASE WHEN item_id % 500 = 3 THEN NULL ELSE price_per_night END IS NULL) <> is_sold_out),
    r AS (SELECT *, row_number() OVER (ORDER BY item_id) AS k FROM v) SELECT violation, count(*) AS n_rows, string_agg(cast(item_id AS varchar), ',' ORDER BY item_id) FILTER (k <= 10) AS sample_items FROM r GROUP BY 1""")
)
def curated_key_violations(spark, sf_dir):
    """Some prices are taken away first, so that the invariant has something to find."""
    o = events_warehouse(spark, sf_dir).observations.withColumn("price_per_night", F.when(F.col("item_id") % 500 != 3, F.col("price_per_night")))
    return keys.curated_violations(keys.curated_keys(o))


@query(
    events_sql("""SELECT source_code, item_id AS source_pk, row_number() OVER (ORDER BY source_code, item_id) AS warehouse_id FROM items""")
)
def deterministic_warehouse_ids(spark, sf_dir):
    items = events_warehouse(spark, sf_dir).items.select("source_code", F.col("item_id").alias("source_pk"))
    return keys.numbered(items, "source_code", "source_pk")


_DIGEST = """cast(('0x' || substr(sha256('{"checkin_date":"' || cast(checkin_date AS varchar) || '","hotel_id":' || coalesce(cast(hotel_id AS varchar), 'null') || ',"item_id":' || item_id || ',"status":"' || status || '"}'), 1, 15)) AS bigint)"""


@query(events_sql(f"""SELECT 'items' AS table_name, count(*) AS n_rows, cast(sum({_DIGEST}::hugeint) AS varchar) AS checksum FROM items"""))
def items_checksum(spark, sf_dir):
    items = events_warehouse(spark, sf_dir).items.select("item_id", "hotel_id", "checkin_date", "status", "finished_at")
    return keys.table_checksum(items, "items", leave_out=["finished_at"])


_STATE_DIGEST = "cast(('0x' || substr(sha256('{\"item_id\":' || item_id || ',\"status\":\"' || {} || '\"}'), 1, 15)) AS bigint)"


@query(events_sql(f"""s AS (SELECT cast(sum({_STATE_DIGEST.replace('{}', 'status')}::hugeint) AS varchar) AS pinned, cast(sum({_STATE_DIGEST.replace('{}', "CASE WHEN item_id % 4000 = 1 THEN status || 'x' ELSE status END")}::hugeint) AS varchar) AS now FROM items)
    SELECT * FROM (SELECT 'changed' AS table_name, now AS checksum_now, pinned AS checksum_pinned FROM s UNION ALL SELECT 'same', pinned, pinned FROM s) WHERE checksum_now <> checksum_pinned"""))
def checksum_drift_gate(spark, sf_dir):
    """A table with its rows dealt anew has its old checksum; one with a few changed values hasn't."""
    items = events_warehouse(spark, sf_dir).items.select("item_id", "status")
    changed = items.withColumn("status", F.when(F.col("item_id") % 4000 == 1, F.concat("status", F.lit("x"))).otherwise(F.col("status")))
    now = keys.table_checksum(items.repartition(7), "same").unionByName(keys.table_checksum(changed, "changed"))
    pinned = keys.table_checksum(items, "same").unionByName(keys.table_checksum(items, "changed"))
    return keys.drift(now, pinned)


@query(events_sql("""m AS (SELECT item_id, row_number() OVER (ORDER BY item_id) AS warehouse_id FROM items) SELECT m.warehouse_id, p.warehouse_id AS retry_of FROM m LEFT JOIN m p ON p.item_id = CASE WHEN m.item_id % 5 = 0 THEN m.item_id - 5 END"""))
def self_reference_remap(spark, sf_dir):
    """Rows that retry an earlier row point to its new id."""
    items = events_warehouse(spark, sf_dir).items.select(F.lit(1).alias("priority"), "item_id", F.when(F.col("item_id") % 5 == 0, F.col("item_id") - 5).alias("retry_of_item"))
    ids = keys.numbered(items, "priority", "item_id")
    parent = ids.select(F.col("item_id").alias("retry_of_item"), F.col("warehouse_id").alias("retry_of"))
    return ids.join(parent, "retry_of_item", "left").select("warehouse_id", "retry_of")


@query("SELECT count(*) AS n_rows, sha256(string_agg(j, chr(10) ORDER BY j)) AS set_sha256 FROM (SELECT '{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || '}' AS j FROM nation)")
def nation_set_hash(spark, sf_dir):
    return keys.set_hash(read(spark, sf_dir, "nation"), ["n_name", "n_nationkey"])
