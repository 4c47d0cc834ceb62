"""SQL, for DuckDB, of the operators that SQL can express."""

from __future__ import annotations

from parchmint.llm.secrets import ACCESS, ASSIGN, HEX, KINDS, OPAQUE, OWNERS, REPOS

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _base32(hexed: str) -> str:
    """Base 32 of 40 hexadecimal digits: five of them are four characters."""
    parts = []
    for g in range(8):
        v = f"('0x' || substr({hexed}, {5 * g + 1}, 5))::INT"
        parts += [f"substr('{UPPER}234567', (({v} >> {shift}) & 31) + 1, 1)" for shift in (15, 10, 5, 0)]
    return " || ".join(parts)


WARC = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), o AS (SELECT h, max(page_id) AS owner FROM p GROUP BY h)
SELECT page_id, strlen(h) AS payload_bytes, {_base32('upper(sha1(h))')} AS payload_digest,
 CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> owner THEN owner END AS refers_to, true AS intact
FROM p JOIN o USING (h)"""


def _spans() -> str:
    parts = []
    for order, (kind, pattern) in enumerate(zip(KINDS, (ASSIGN, ACCESS, HEX, OPAQUE))):
        found = f"SELECT doc_id, source, regexp_extract_all(coalesce(text, ''), {_q(pattern)}) AS m, regexp_split_to_array(coalesce(text, ''), {_q(pattern)}) AS p FROM documents"
        place = "list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)"
        secret = f"regexp_extract(m[i], {_q(pattern)}, 2)" if kind == "assign" else "m[i]"
        parts.append(f"SELECT doc_id, source, {order} AS o, '{kind}' AS kind, ({place})::BIGINT AS s, ({place} + length(m[i]))::BIGINT AS e, {secret} AS secret FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM ({found}))")
    return " UNION ALL ".join(parts)


SECRETS = f"""WITH found AS ({_spans()}),
base AS (SELECT * FROM found WHERE (o = 0 AND length(secret) >= 8) OR (o = 1 AND length(secret) >= 16) OR o = 2),
opaque AS (SELECT * FROM found f WHERE o = 3 AND regexp_matches(secret, '[0-9]') AND regexp_matches(secret, '[a-z]') AND regexp_matches(secret, '[A-Z]')
 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = f.doc_id AND b.s < f.e AND f.s < b.e)),
spans AS (SELECT * FROM base UNION ALL SELECT * FROM opaque),
owners AS (SELECT secret, count(DISTINCT coalesce('s' || source, '')) AS n, count(DISTINCT struct_pack(o := source, r := doc_id)) AS r FROM spans GROUP BY secret),
kept AS (SELECT * FROM spans JOIN owners USING (secret) WHERE o < 3 OR n < 2),
told AS (SELECT doc_id, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex,
 sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) FILTER (o < 3), '')) AS base_sha256,
 string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) AS spans, count(*) FILTER (n < {OWNERS} AND r < {REPOS}) AS n_live, count(*) FILTER (n >= {OWNERS} OR r >= {REPOS}) AS n_copied FROM kept GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(base_sha256, sha256('')) AS base_sha256,
 coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied FROM documents LEFT JOIN told USING (doc_id)"""


_CRC_TABLE = "list_transform(range(0, 256), lambda i: list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i))"
_CRC = "xor(list_reduce(list_transform(regexp_extract_all(hex(encode(h)), '..'), lambda x: ('0x' || x)::BIGINT), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295)"
SHARDING = f"""WITH t AS MATERIALIZED (SELECT {_CRC_TABLE} AS tab),
d AS MATERIALIZED (SELECT doc_id, (strlen(h) + 16)::BIGINT AS size, ({_CRC})::BIGINT AS text_crc32, s FROM (SELECT doc_id, coalesce(text, '') AS h, coalesce('s' || source, 'null') AS s FROM documents), t),
k AS (SELECT *, ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, 'null') || ':' || text_crc32 || ':' || size), 1, 15))::BIGINT AS key FROM d),
f AS (SELECT *, (2 * row_number() OVER (PARTITION BY s ORDER BY key, doc_id, text_crc32, size) - 1) / (2 * count(*) OVER (PARTITION BY s)) AS fraction, count(*) OVER () AS total FROM k),
p AS (SELECT *, row_number() OVER (ORDER BY fraction, s, key, doc_id, text_crc32, size) - 1 AS place FROM f)
SELECT doc_id, size, text_crc32, 'rows' AS law, (place * 40 // total)::INT AS shard, (place - (place * 40 // total * total + 39) // 40)::BIGINT AS slot, NULL::INT AS grown_shard FROM p"""


#: Bytes as hexadecimal digits: a string of 200 bytes is 400 of them.
REPEATS = """WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 199)) AS i FROM d)),
h AS (SELECT doc_id, i FROM s SEMI JOIN (SELECT k FROM s GROUP BY k HAVING count(*) > 1) USING (k)),
f AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 200, true) AS first FROM h),
r AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM (SELECT *, sum(first::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM f) GROUP BY doc_id, run),
p AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
g AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM p JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)"""

JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[k:k + 2], ' ') AS t FROM (SELECT *, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS k FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS MATERIALIZED (SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL) JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
reach AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(least_id, doc_id)) AS component_id, coalesce(n_links, 0) AS n_links FROM documents LEFT JOIN n USING (doc_id)
LEFT JOIN (SELECT x AS doc_id, min(y) AS least_id FROM reach GROUP BY x) USING (doc_id) LEFT JOIN (SELECT x AS doc_id, count(*) AS n_links FROM link GROUP BY x) USING (doc_id)"""


def _words(table: str, key: str) -> str:
    lowered = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"
    return f"SELECT {key}, regexp_extract_all({lowered}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table}"


DECONTAMINATION = f"""WITH d AS ({_words('documents', 'doc_id')}), b AS ({_words('benchmark', 'item_id')}),
win AS (SELECT DISTINCT item_id::VARCHAR AS item, least(len(w), 10) AS size, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS t
 FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS k FROM b WHERE len(w) > 0)),
place AS (SELECT doc_id, k, size, array_to_string(w[k:k + size - 1], ' ') AS t FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS k FROM d, (SELECT DISTINCT size FROM win) WHERE len(w) >= size)),
hits AS (SELECT doc_id, k, size, item FROM place JOIN win USING (size, t)),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS j FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)"""
