"""DuckDB SQL for those queries that SQL can express."""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES = {
    "op1_decontaminate": rf"""
        WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
        i AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
        w AS (SELECT DISTINCT item_id, least(len(ws), 10) AS size, array_to_string(ws[k : k + 9], ' ') AS phrase
              FROM i, unnest(generate_series(1, greatest(len(ws) - 9, 1))) AS u(k) WHERE len(ws) > 0),
        p AS (SELECT doc_id, k, size, array_to_string(ws[k : k + size - 1], ' ') AS phrase
              FROM d, (SELECT DISTINCT size FROM w), unnest(generate_series(1, len(ws))) AS u(k) WHERE k + size - 1 <= len(ws)),
        m AS (SELECT doc_id, k, p.size, item_id FROM p JOIN w ON p.size = w.size AND p.phrase = w.phrase),
        h AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(generate_series(k, k + size - 1)) AS place FROM m) GROUP BY doc_id),
        t AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, cast(item_id AS varchar) AS item FROM m) GROUP BY doc_id)
        SELECT d.doc_id, len(ws)::bigint AS n_words, coalesce(h.n, 0)::bigint AS n_hit, coalesce(t.n, 0)::bigint AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op3_chat": r"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
        e AS (SELECT *, regexp_replace(text, '(\[|<)(\\*)(/?INST\]|/?s>)', '\1\\\2\3', 'g') AS text_out,
                     regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '(\[|<)(\\*)(/?INST\]|/?s>)', '\1\\\2\3', 'g') AS role_out FROM t)
        SELECT conv_id, count(*)::bigint AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               (7 + sum(14 + length(role_out) + length(text_out)))::bigint AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op5_url_filter": r"""
        WITH r(rule, host_part, path_part, verdict) AS (VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
                 ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
        p AS (SELECT page_id, url, coalesce(CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END, '') AS rest FROM pages),
        s AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
        f AS (SELECT s.*, r.rule, r.verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(r.rule) DESC NULLS LAST) AS k
              FROM s LEFT JOIN r ON (host = host_part OR ends_with(host, '.' || host_part)) AND starts_with(path, path_part))
        SELECT page_id, url, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE k = 1""",
}
