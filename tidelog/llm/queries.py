"""The queries of the text operators, and SQL for those that SQL can express."""

from __future__ import annotations

from tidelog.llm import decontam, html_extract, jpeg, langid, packing, pii, quality, simhash, toxicity, warc

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_warc": warc.op2_warc,
    "op3_html": html_extract.op3_html,
    "op4_media": jpeg.op4_media,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_pii": pii.op6_pii,
    "op7_langid": langid.op7_langid,
    "op8_quality": quality.op8_quality,
    "op9_decontam": decontam.op9_decontam,
    "op10_packing": packing.op10_packing,
}

#: Words of whole texts, windows by position, and their union; as the contract states it, without fingerprints.
DECONTAM_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(10, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda i: list_aggregate(w[i : i + least(10, len(w)) - 1], 'string_agg', ' '))) AS win FROM b WHERE len(w) > 0),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: list_aggregate(w[i : i + n - 1], 'string_agg', ' '))) AS win FROM d, ns WHERE len(w) >= n),
h AS (SELECT rid, i, n, item FROM dw JOIN bw USING (n, win)),
c AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM h) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)
"""

WARC_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
bits AS (SELECT DISTINCT h, list_aggregate(list_transform(range(1, 41), lambda i: lpad(bin(instr('0123456789abcdef', h[i]) - 1), 4, '0')), 'string_agg', '') AS b FROM p),
b32 AS (SELECT h, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(list_sum(list_transform(range(1, 6), lambda j: CASE WHEN substr(b, 5 * i + j, 1) = '1' THEN CAST(pow(2, 5 - j) AS INT) ELSE 0 END)) AS INT) + 1, 1)), 'string_agg', '') AS d FROM bits)
SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN g USING (h) JOIN b32 USING (h)
"""

ORACLES = {"op2_warc": WARC_SQL, "op9_decontam": DECONTAM_SQL}
