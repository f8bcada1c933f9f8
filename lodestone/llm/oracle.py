"""DuckDB SQL with the rows of those corpus queries that SQL can express."""

from __future__ import annotations

#: Words of an item or document, and the windows of ten of them that occur in both.
OP4_SQL = r"""
WITH w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), bw AS (
    SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[j:j + least(10, len(ws)) - 1], ' ') AS win
    FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS j FROM b WHERE len(ws) > 0)
), sizes AS (
    SELECT DISTINCT n FROM bw
), dw AS (
    SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS win
    FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, sizes WHERE len(ws) >= n)
), m AS (
    SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win
), hit AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id
), it AS (
    SELECT doc_id, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""

CRC_TABLE = """crc_table AS MATERIALIZED (
    SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(i))
)"""


def octets(text: str) -> str:
    """The UTF-8 bytes of a text, as a list of numbers."""
    return f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS BIGINT))"


def crc32(numbers: str) -> str:
    """The CRC-32 of a list of bytes, where ``crc_table`` is joined."""
    return f"CAST(xor(list_reduce(list_prepend(4294967295, {numbers}), lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295) AS BIGINT)"


def little_endian(number: str) -> str:
    return "(" + " || ".join(f"printf('%02X', (({number}) >> {8 * i}) & 255)" for i in range(4)) + ")"


OP3_SQL = f"""
WITH {CRC_TABLE}, sized AS (
    SELECT doc_id, CAST(strlen(coalesce(text, '')) + 16 AS BIGINT) AS size, {crc32(octets("coalesce(text, '')"))} AS text_crc32 FROM documents, crc_table
), placed AS (
    SELECT *, CAST((2 * sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING) - size) * 40 // (2 * sum(size) OVER ()) AS INTEGER) AS shard FROM sized
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM placed
"""

#: Every window of 200 bytes, as hexadecimal text, counted by its digest.
OP9_SQL = """
WITH d AS MATERIALIZED (
    SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), blocks AS (
    SELECT r, k, substr(h, k * 2000 + 1, 2400) AS part, least(1000, length(h) // 2 - 199 - k * 1000) AS n FROM (SELECT r, h, unnest(range(0, (length(h) // 2 - 200) // 1000 + 1)) AS k FROM d WHERE length(h) >= 400)
), w AS (
    SELECT r, k * 1000 + i AS p, md5(substr(part, 2 * i + 1, 400)) AS m FROM (SELECT r, k, part, unnest(range(0, n)) AS i FROM blocks)
), twice AS (
    SELECT m FROM w GROUP BY m HAVING count(*) > 1
), starts AS (
    SELECT r, p FROM w SEMI JOIN twice USING (m)
), spans AS (
    SELECT r, min(p) AS a, max(p) + 200 AS z FROM (SELECT r, p, sum(fresh) OVER (PARTITION BY r ORDER BY p) AS g FROM (SELECT r, p, CASE WHEN p - lag(p) OVER (PARTITION BY r ORDER BY p) <= 200 THEN 0 ELSE 1 END AS fresh FROM starts)) GROUP BY r, g
), gaps AS (
    SELECT r, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS f, a AS t FROM spans
    UNION ALL SELECT d.r, coalesce(max(z), 0), length(any_value(h)) // 2 FROM d LEFT JOIN spans USING (r) GROUP BY d.r
), kept AS (
    SELECT r, string_agg(substr(h, f * 2 + 1, (t - f) * 2), '' ORDER BY f) AS h FROM gaps JOIN d USING (r) GROUP BY r
), removed AS (
    SELECT r, sum(z - a) AS n, count(*) AS s FROM spans GROUP BY r
)
SELECT doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(s, 0) AS BIGINT) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM d JOIN kept USING (r) LEFT JOIN removed USING (r)
"""

#: The samples' header in hexadecimal; no text of the tables embeds media.
OP10_SQL = f"""
WITH {CRC_TABLE}, padded AS (
    SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, coalesce(text, '') || repeat(' ', CAST(greatest(1, ceil(strlen(coalesce(text, '')) / 192.0)) * 192 - strlen(coalesce(text, '')) AS BIGINT)) AS payload FROM documents
), sampled AS (
    SELECT *, CAST(strlen(payload) AS BIGINT) AS n, {octets("payload")} AS b, hex(encode(payload)) AS h FROM padded
), stored AS (
    SELECT *, unhex('52494646' || {little_endian("n + 36")} || '57415645666D7420100000000100010040' || '1F0000401F0000' || '0100080064617461' || {little_endian("n")} || h) AS media FROM sampled
)
SELECT doc_id, n_bytes, n AS payload_bytes, sha256(payload) AS payload_sha256, {crc32("b[-16:]")} AS tail_crc32, n + 44 AS media_bytes, sha256(media) AS media_sha256,
    'audio/wav;samples=' || n || ';mean=' || CAST(list_sum(b) * 1000 // n AS BIGINT)
        || ';step=' || CAST(list_sum(list_transform(list_zip(b[:-2], b[2:]), lambda p: abs(p[1] - p[2]))) * 1000 // (n - 1) AS BIGINT) || ';carved=0' AS feature
FROM stored, crc_table
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_sharding": OP3_SQL, "op4_decontamination": OP4_SQL, "op9_suffix_dedup": OP9_SQL, "op10_media": OP10_SQL}
