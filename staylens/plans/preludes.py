"""DuckDB SQL of the bindings: the warehouse tables as common table expressions over the given tables."""

_CITY = "CASE user_id % 6 WHEN 0 THEN 'Hanoi' WHEN 1 THEN 'Da Nang' WHEN 2 THEN 'Hoi An' WHEN 3 THEN 'Nha Trang' WHEN 4 THEN 'Da Lat' END"

#: Bucket of `lead_time`, null where it is null or negative.
BUCKET = "CASE WHEN lead_time < 0 OR lead_time IS NULL THEN NULL WHEN lead_time <= 0 THEN '0' WHEN lead_time <= 3 THEN '1-3' WHEN lead_time <= 7 THEN '4-7' WHEN lead_time <= 14 THEN '8-14' WHEN lead_time <= 30 THEN '15-30' WHEN lead_time <= 60 THEN '31-60' ELSE '61+' END"
LEGACY_BUCKET = "CASE WHEN lead_time < 0 OR lead_time IS NULL THEN NULL WHEN lead_time <= 3 THEN '0-3' WHEN lead_time <= 7 THEN '4-7' WHEN lead_time <= 14 THEN '8-14' WHEN lead_time <= 30 THEN '15-30' WHEN lead_time <= 60 THEN '31-60' ELSE '61+' END"
BUCKET_TABLE = "(VALUES ('0', 1), ('1-3', 2), ('4-7', 3), ('8-14', 4), ('15-30', 5), ('31-60', 6), ('61+', 7)) AS b(lead_time_bucket, bucket_order)"
BUCKET_ORDER = "coalesce(list_position(['0', '1-3', '4-7', '8-14', '15-30', '31-60', '61+'], lead_time_bucket), 8)::int"

EVENTS = f"""
base AS (SELECT event_id AS item_id, user_id, ts, value, cast(json_extract(props, '$.k') AS int) AS lead_time, cast(ts + INTERVAL 7 HOUR AS date) AS crawl_date,
                CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS source_code,
                CASE event_type WHEN 'purchase' THEN 'success' WHEN 'view' THEN 'sold_out' WHEN 'click' THEN 'not_bookable' WHEN 'signup' THEN 'partial' ELSE 'error' END AS status FROM events),
items0 AS (SELECT *, source_code || '|' || cast(crawl_date AS varchar) AS run_id, crawl_date + lead_time AS checkin_date FROM base),
items AS (SELECT item_id, run_id, source_code, crawl_date, CASE WHEN item_id % 50 <> 0 THEN user_id END AS hotel_id, checkin_date, checkin_date + CASE WHEN item_id % 97 = 0 THEN 2 ELSE 1 END AS checkout_date, lead_time, status, ts AS finished_at,
                 'https://h.example/hotel/vn/h' || user_id || '.html?checkin=' || cast(checkin_date AS varchar) AS link,
                 CASE WHEN status <> 'success' THEN CASE WHEN item_id % 3 = 0 THEN 'timeout' ELSE 'state_' || status END END AS error_code,
                 'v' || (item_id % 3) AS selector_version, CASE WHEN item_id % 4 <> 0 THEN 'pages/' || item_id END AS page_path, CASE WHEN item_id % 5 = 0 THEN 'shots/' || item_id END AS screenshot_path, item_id % 2 = 0 AS screenshot_requested,
                 item_id % 25 <> 0 AS include_raw, item_id % 25 <> 0 AND item_id % 10 <> 0 AS include_main, item_id % 25 <> 0 AND item_id % 10 <> 0 AND status = 'success' AS include_reference,
                 CASE WHEN item_id % 25 = 0 THEN 'unassigned' WHEN item_id % 10 = 0 THEN 'non_owner_duplicate' WHEN status = 'success' THEN 'owner_success' ELSE 'owner_failure_' || status END AS ownership_status,
                 CASE WHEN item_id % 25 = 0 THEN 'no_plan_row' WHEN item_id % 10 = 0 THEN 'other_owner' END AS exclusion_reason FROM items0),
observations AS (SELECT item_id AS record_id, item_id, user_id AS hotel_id, ts AS observed_at, crawl_date, checkin_date, lead_time + CASE WHEN item_id % 89 = 0 THEN 1 ELSE 0 END AS lead_time, 0 AS option_index,
                 CASE WHEN status <> 'sold_out' THEN value + CASE WHEN item_id % 71 = 0 THEN 1 ELSE 0 END END AS price_total, CASE WHEN status <> 'sold_out' THEN value END AS price_per_night,
                 CASE WHEN status <> 'sold_out' AND item_id % 6 = 0 THEN value * 1.25 END AS price_original, CASE WHEN item_id % 6 = 0 THEN 20.0 END AS discount_percent, CASE WHEN status <> 'sold_out' AND item_id % 3 = 0 THEN value * 0.1 END AS taxes_fees, CASE WHEN item_id % 4 > 0 THEN item_id % 4 = 1 END AS price_includes_tax,
                 status = 'sold_out' AS is_sold_out, CASE WHEN status <> 'sold_out' OR item_id % 83 = 0 THEN cast(item_id % 3 AS varchar) END AS room_key, CASE WHEN status <> 'sold_out' THEN cast(item_id % 2 AS varchar) END AS rate_key,
                 CASE WHEN status <> 'sold_out' THEN 'Room ' || (item_id % 3) END AS room_name, CASE WHEN status <> 'sold_out' THEN item_id % 5 + 1 END AS max_occupancy, CASE WHEN item_id % 7 > 0 THEN '1 double' END AS bed_config, CASE WHEN item_id % 8 > 0 THEN '20 m' END AS room_area, CASE WHEN item_id % 9 > 0 THEN item_id % 2 = 0 END AS breakfast_included, CASE WHEN item_id % 10 > 0 THEN item_id % 3 = 0 END AS free_cancellation, CASE WHEN item_id % 11 > 0 THEN 'free until 2 days' END AS cancellation_policy, CASE WHEN item_id % 12 = 0 THEN 3 END AS rooms_left FROM items0),
hotels AS (SELECT DISTINCT user_id AS hotel_id, 'h' || user_id AS slug, 'Hotel ' || user_id AS name, {_CITY} AS city, 6.0::double + (user_id % 40)::double / 10 AS review_score, user_id * 7 % 500 AS review_count FROM events),
runs AS (SELECT run_id, source_code, crawl_date, min(ts) AS started_at, max(ts) AS finished_at, CASE WHEN day(crawl_date) % 13 = 0 THEN 'partial' ELSE 'completed' END AS status, CASE WHEN source_code = 'a' THEN 'scheduled' ELSE 'manual' END AS trigger FROM items0 GROUP BY ALL),
sources(source_code, source_priority, dump_name) AS (VALUES ('a', 1, 'dump-a'), ('b', 2, 'dump-b')),
rejections AS (SELECT source_code, 'observations' AS table_name, item_id AS source_pk, CASE WHEN item_id % 2 = 0 THEN 'row_error' ELSE 'parent_rejected' END AS reason, item_id % 3 = 0 AS waived FROM items0 WHERE item_id % 101 = 0)"""

ORDERS = """
hotels AS (SELECT s_suppkey AS hotel_id, 's' || s_suppkey AS slug, s_name AS name, n_name AS city, r_name AS source_code, round(s_acctbal::double % 10, 1) AS review_score, s_suppkey * 7 % 500 AS review_count
           FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
items AS (SELECT o_orderkey AS item_id, o_orderdate::date AS crawl_date, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'sold_out' ELSE 'error' END AS status,
                 o_orderkey % 4 <> 0 AS include_main, true AS include_raw, o_orderkey % 4 <> 0 AND o_orderstatus = 'F' AS include_reference FROM orders),
observations AS (SELECT l_orderkey AS item_id, l_linenumber::int AS option_index, l_suppkey AS hotel_id, source_code, city, status AS item_status, source_code || '|' || cast(crawl_date AS varchar) AS run_id, crawl_date, crawl_date::timestamp AS observed_at, l_shipdate::date AS checkin_date, l_shipdate::date - crawl_date AS lead_time,
                 l_extendedprice::double AS price_total, CASE WHEN l_returnflag <> 'R' THEN l_extendedprice::double / l_quantity::double END AS price_per_night, l_returnflag = 'R' AS is_sold_out,
                 p_type || '/' || p_brand AS room_key, l_returnflag || '/' || l_linestatus AS rate_key, p_name AS room_name, p_size % 5 + 1 AS max_occupancy, p_brand AS bed_config, (p_size + 10) || ' m' AS room_area, l_tax > 0.04 AS breakfast_included, l_discount > 0.05 AS free_cancellation, CASE WHEN l_discount > 0.02 THEN 'policy ' || l_linestatus END AS cancellation_policy
                 FROM lineitem JOIN part ON l_partkey = p_partkey JOIN items ON l_orderkey = items.item_id JOIN hotels ON l_suppkey = hotel_id),
runs AS (SELECT run_id, source_code, crawl_date, count(*) AS n_observations FROM observations GROUP BY ALL)"""


def events_sql(body: str) -> str:
    """body is a SELECT, or further common table expressions and a SELECT."""
    return f"WITH {EVENTS}{',' if body.lstrip()[:6].upper() != 'SELECT' else ''} {body}"


def orders_sql(body: str) -> str:
    return f"WITH {ORDERS}{',' if body.lstrip()[:6].upper() != 'SELECT' else ''} {body}"


def names_sql(options: list, of: str) -> str:
    """options[of], null beyond the last, as SQL."""
    told = ["NULL" if x is None else "'" + x.replace("'", "''") + "'" for x in options]
    return f"CASE {of} {' '.join(f'WHEN {i} THEN {x}' for i, x in enumerate(told))} END"
