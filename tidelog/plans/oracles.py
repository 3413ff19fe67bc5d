"""SQL that gives the same rows as the queries of the catalog, on the driver's tables in DuckDB."""

from __future__ import annotations

DAY = 86400000
NOW = 1706659200000

VIEWS = {
    "log": """log AS (SELECT 't' || (user_id % 3) AS tenant, 'default' AS namespace, event_type AS stream, CAST(user_id % 4 AS INT) AS shard,
  row_number() OVER (PARTITION BY event_type, user_id % 4 ORDER BY ts, event_id) - 1 AS "offset", epoch_us(ts) AS ts_us, 'user-' || user_id AS key, props AS payload,
  CAST(round(value * 100) AS BIGINT) AS cents, CASE event_id % 11 WHEN 0 THEN 'trim' WHEN 1 THEN 'producer' ELSE 'data' END AS mark_kind, event_id, user_id FROM events)""",
    "cache": f"""cache AS (SELECT CAST(user_id % 4 AS INT) AS shard, row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) - 1 AS "offset", epoch_us(ts) // 1000 AS ts_ms,
  CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op, 'user-' || user_id AS key, CASE WHEN event_type <> 'error' THEN CAST(round(value * 100) AS BIGINT) END AS value,
  CASE event_type WHEN 'purchase' THEN epoch_us(ts) // 1000 + {7 * DAY} WHEN 'view' THEN epoch_us(ts) // 1000 + {DAY} ELSE 0 END AS expires_at_millis, CAST(strlen(props) AS BIGINT) AS bytes FROM events)""",
    "counter": """counter AS (SELECT *, CASE WHEN "offset" % 500 = 250 THEN 'checkpoint' ELSE 'delta' END AS op FROM (SELECT event_type AS key, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS "offset",
  CASE WHEN event_id % 2 = 1 THEN -CAST(round(value * 100) AS BIGINT) ELSE CAST(round(value * 100) AS BIGINT) END AS amount FROM events))""",
    "heads": """heads AS (SELECT o_orderkey, CAST(o_custkey % 4 AS INT) AS shard, row_number() OVER (PARTITION BY o_custkey % 4 ORDER BY o_orderdate, o_orderkey) - 1 AS "offset", 'order-' || o_orderkey AS event FROM orders)""",
    "ops": """ops AS (SELECT shard, "offset", row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos, CASE WHEN l_linestatus = 'F' THEN 'delete' ELSE 'put' END AS op,
  'part-' || l_partkey AS key, CAST(round(l_extendedprice * 100) AS BIGINT) AS value FROM heads JOIN lineitem ON l_orderkey = o_orderkey)""",
    "producer": """sends AS (SELECT CAST(user_id % 4 AS INT) AS shard, user_id AS producer_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sequence, event_id, event_id * 2 AS arrival, props FROM events),
producer AS (SELECT shard, producer_id, sequence, arrival, props FROM sends UNION ALL SELECT shard, producer_id, sequence, arrival + 1 + 40 * (event_id % 3), props || CASE WHEN event_id % 70 = 0 THEN '!' ELSE '' END FROM sends WHERE event_id % 10 = 0)""",
    "hist": """hist AS (SELECT stream, shard, "offset", event_id AS value, ts_us AS invoke, ts_us + cents * 1000 AS complete, CASE event_id % 20 WHEN 0 THEN 'fail' WHEN 1 THEN 'info' ELSE 'ok' END AS outcome FROM log)""",
    "topics": """topics AS (SELECT *, 't' || (length(host) % 3) AS tenant FROM (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) || '/' || regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) AS topic, regexp_extract(url, '^https?://([^/]+)', 1) AS host,
  split_part(regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1), '/', 1) AS section FROM pages))""",
    "mounts": """mounts AS (SELECT 't' || (length(host) % 3) AS tenant, host || '/' AS prefix, 'host-' || host AS stream FROM topics UNION SELECT 't' || (length(host) % 3), host || '/' || section, 'lang-' || section FROM topics WHERE section <> '')""",
    "tails": """tails AS (SELECT stream, shard, min("offset") AS base, max("offset") + 1 AS tail FROM log GROUP BY ALL)""",
    "replicas": """r0 AS (SELECT *, shard + length(stream) AS s FROM tails),
replicas AS (SELECT stream, shard, tail, 'f1' AS member, tail - s % 3 AS reported, false AS halted FROM r0 UNION ALL SELECT stream, shard, tail, 'f2', tail - (s * 2) % 7, s % 4 = 0 FROM r0
  UNION ALL SELECT stream, shard, tail, 'f3', tail + 2, s % 5 = 0 FROM r0 UNION ALL SELECT stream, shard, tail, 'f4', tail - (s * 3) % 11, false FROM r0)""",
    "runs": """runs AS (SELECT stream AS workload, CAST(user_id % 5 AS INT) AS size, cents, event_id % 19 = 0 AS failed, ts_us // 86400000000 AS session, ts_us, user_id % 2 = 1 AS candidate FROM log)""",
    "streams": """st0 AS (SELECT tenant, stream, max(shard) + 1 AS shards, count(*) AS n FROM log GROUP BY ALL),
streams AS (SELECT *, n % 2 = 0 AS durable, CASE WHEN n % 3 = 0 THEN 'quorum' ELSE 'leader' END AS consistency, CASE WHEN n % 5 <> 0 THEN n - n % 4 * 1000 END AS retention_bytes FROM st0)""",
    "gops": """gops AS (SELECT shard, event_id AS idx, stream AS grp, CASE WHEN event_id % 20 < 8 THEN 'advance' WHEN event_id % 20 = 18 THEN 'seek' ELSE '-' END AS op, CAST(floor("offset" * 3 / 4) AS BIGINT) AS "to" FROM log),
gw AS (SELECT * FROM gops WHERE op = 'advance' OR (op = 'seek' AND idx % 40 = 18))""",
    "final": """h3 AS (SELECT stream, shard, "offset" * 3 AS "offset", value, outcome FROM hist),
final AS (SELECT stream, shard, "offset", value FROM h3 WHERE value % 97 <> 0 AND (outcome <> 'fail' OR value % 40 = 0) UNION ALL SELECT stream, shard, "offset" + 1, value FROM h3 WHERE value % 101 = 0
  UNION ALL SELECT stream, shard, "offset" + 2, -value FROM h3 WHERE value % 211 = 0)""",
}
LATEST = """last AS (SELECT *, row_number() OVER (PARTITION BY shard, key ORDER BY "offset" DESC) AS rn FROM cache)"""


def q(views: str, body: str) -> str:
    parts = [VIEWS[v] for v in views.split()]
    joined = body if body.startswith("SELECT") else ""
    if joined:
        return f"WITH {', '.join(parts)} {body}" if parts else body
    return f"WITH {', '.join([*parts, body])}"


def steps(views: str, rows: str, start: str, then: str, body: str) -> str:
    """SQL that folds rows in order, one by one: rows are numbered (n) by their key, then gives the state after row n from that before."""
    parts = [VIEWS[v] for v in views.split()]
    return f"WITH RECURSIVE {', '.join([*parts, f'r AS ({rows})', f'f AS ({start} UNION ALL {then})'])} {body}"


def _live(now: int) -> str:
    return f"""{LATEST} SELECT shard, key, value, "offset" AS version, expires_at_millis FROM last WHERE rn = 1 AND op = 'put' AND (expires_at_millis = 0 OR {now} < expires_at_millis)"""


TIMES = [1704067200000000 + i * 3 * DAY * 1000 for i in range(12)]
TOPIC_CASES = [(r"^.*$", 0, True), (r"^[^/]*/en(/.*)?$", 1, True), (r"^[^/]*/fr/[^/]*$", 2, True), (r"^m\.\+(/.*)?$", 1, False), (r"^[^/]*/de(/.*)?$", 1, True), (r"^\$sys(/.*)?$", 2, False), (r"^www\.example\.com/[^/]*$", 2, False), (r"^[^/]*/[^/]*/1$", 2, True)]
_CASES = [f"CASE WHEN {'topic NOT LIKE $$$%$$ AND ' if guard else ''}regexp_matches(topic, '{r}') THEN {n} END" for r, n, guard in TOPIC_CASES]
_TOPIC, _SUBSCRIBED = ", ".join(_CASES), ", ".join(_CASES[1:])

#: splitmix64 over FNV-1a, in unsigned 128-bit arithmetic.
_ROUTE = """h AS (SELECT key, list_reduce(list_prepend(CAST(14695981039346656037 AS UHUGEINT), list_transform(range(1, length(key) + 1), lambda i: CAST(ascii(key[i]) AS UHUGEINT))), lambda a, b: (xor(a, b) * 1099511628211) % 18446744073709551616) AS x FROM (SELECT DISTINCT key FROM log)),
f1 AS (SELECT key, (xor(x, x >> 30) * 13787848793156543929) % 18446744073709551616 AS x FROM h), f2 AS (SELECT key, (xor(x, x >> 27) * 10723151780598845931) % 18446744073709551616 AS x FROM f1),
f3 AS (SELECT key, xor(x, x >> 31) AS x FROM f2) SELECT event_id, key, CAST(x % 4 AS INT) AS routed FROM log JOIN f3 USING (key)"""

_ALL, _CRC64 = "CAST(18446744073709551615 AS UBIGINT)", "CAST(14514072000185962306 AS UBIGINT)"


def _fnv(numbers: str) -> str:
    return f"list_reduce(list_prepend(CAST(14695981039346656037 AS UHUGEINT), list_transform({numbers}, lambda v: CAST(v AS UHUGEINT))), lambda x, y: (xor(x, y) * 1099511628211) % 18446744073709551616)"


def _mix(h: str) -> str:
    """splitmix64's finalizer of a number, each step by a list of one."""
    for shift, factor in ((30, 13787848793156543929), (27, 10723151780598845931)):
        h = f"list_transform([{h}], lambda z: (xor(z, z >> {shift}) * {factor}) % 18446744073709551616)[1]"
    return f"list_transform([{h}], lambda z: xor(z, z >> 31))[1]"


_WINDOW = """e AS (SELECT epoch_us(ts) AS t, event_type, user_id, CAST(round(value * 100) AS BIGINT) AS cents FROM events)"""

ORACLES = {
    "q01_log_scan": q("log", """SELECT tenant, stream, shard, "offset", ts_us, key, payload FROM log WHERE stream = 'view' AND shard = 1"""),
    "q02_range_page": q("log", """p AS (SELECT *, row_number() OVER w AS n, sum(strlen(payload)) OVER w AS b FROM log WHERE "offset" >= 5 AND "offset" < 300 WINDOW w AS (PARTITION BY stream, shard ORDER BY "offset")),
k AS (SELECT * FROM p WHERE n <= 50 AND (n = 1 OR b <= 400)) SELECT stream, shard, "offset", payload, max("offset") OVER (PARTITION BY stream, shard) + 1 AS next_offset FROM k"""),
    "q03_start_positions": q("log tails", """SELECT stream, shard, base AS earliest, tail AS latest, least(greatest(10, base), tail) AS requested FROM tails"""),
    "q04_offset_for_time": q("log tails", f"""SELECT t.stream, t.shard, g.t AS time_us, (SELECT min("offset") FROM log l WHERE l.stream = t.stream AND l.shard = t.shard AND l.ts_us >= g.t) AS "offset" FROM tails t, (SELECT unnest({TIMES}) AS t) g"""),
    "q05_list_offsets": q("log", """SELECT stream, shard, min("offset") AS earliest, max("offset") + 1 AS latest, max("offset") FILTER (mark_kind = 'data') AS max_timestamp_offset, arg_max(ts_us // 1000, "offset") FILTER (mark_kind = 'data') AS max_timestamp_ms FROM log GROUP BY ALL"""),
    "q06_data_records": q("log", """SELECT shard, "offset", payload, "offset" - coalesce(lag("offset") OVER (PARTITION BY shard ORDER BY "offset"), -1) - 1 AS skipped_before FROM log WHERE stream = 'error' AND mark_kind = 'data'"""),
    "q07_sharded_merge": q("log", """SELECT stream, shard, max("offset") + 1 AS resume, count(*) AS records FROM log GROUP BY ALL"""),
    "q08_records_around": q("log", """n AS (SELECT *, row_number() OVER (PARTITION BY stream, shard, "offset" < 10 ORDER BY abs("offset" - 10 + 0.25)) AS k FROM log) SELECT stream, shard, "offset", substring(payload, 1, 5) AS payload FROM n WHERE k <= CASE WHEN "offset" < 10 THEN 3 ELSE 4 END"""),
    "q09_gap_report": """WITH t AS (SELECT conv_id AS sub, CAST(turn AS BIGINT) AS "offset", (conv_id * 7 + turn) % 5 = 0 AS gone, (conv_id * 7 + turn) % 5 = 0 AND (conv_id + turn) % 3 = 0 AS control FROM conversations),
k AS (SELECT * FROM t WHERE NOT gone), g AS (SELECT sub, "offset", coalesce(lag("offset") OVER (PARTITION BY sub ORDER BY "offset"), -1) AS prev FROM k)
SELECT sub, "offset", "offset" - prev - 1 AS gap, s AS skipped, "offset" - prev - 1 - s AS lost FROM (SELECT g.*, (SELECT count(*) FROM t WHERE t.sub = g.sub AND t.control AND t."offset" > g.prev AND t."offset" < g."offset") AS s FROM g) WHERE "offset" - prev - 1 > 0""",
    "q10_segment_report": q("log", """SELECT stream, shard, "offset" // 64 AS segment, min("offset") AS first_offset, max("offset") AS last_offset, count(*) AS records, CAST(sum(strlen(payload)) AS BIGINT) AS bytes, max(ts_us) AS newest_us FROM log GROUP BY stream, shard, "offset" // 64"""),
    "q11_assign_offsets": q("log", """t AS (SELECT stream, shard, count(*) AS tail FROM log WHERE event_id % 10 <> 3 GROUP BY ALL) SELECT stream, shard, event_id, payload, coalesce(tail, 0) + row_number() OVER (PARTITION BY stream, shard ORDER BY event_id) - 1 AS "offset" FROM log LEFT JOIN t USING (stream, shard) WHERE event_id % 10 = 3"""),
    "q12_topic_match": q("topics", f"""SELECT page_id, topic, CASE WHEN coalesce(topic, '') = '' THEN 'empty' WHEN strlen(topic) > 65535 THEN 'too long' WHEN regexp_matches(topic, '[+#]') THEN 'wildcard' END AS fault, greatest({_TOPIC}) AS qos FROM topics"""),
    "q13_route_modulo": q("log", _ROUTE),
    "q14_header_filter": """SELECT event_id, event_id % 9 = 0 AS refused, CASE WHEN event_id % 9 = 0 THEN 'sys.trace=' || event_id || ';' ELSE '' END || 'type=again-' || event_type || ';user=' || user_id AS view FROM events""",
    "q16_committed_visible": q("log tails", """m AS (SELECT stream, shard, CASE WHEN shard = 0 THEN 'unbounded' WHEN shard = 3 THEN 'refused' WHEN stream = 'error' THEN 'settling' ELSE 'committed' END AS kind, tail * 9 // 10 AS mark FROM tails)
SELECT stream, shard, count(*) AS visible, max("offset") AS last FROM log JOIN m USING (stream, shard) WHERE kind = 'unbounded' OR (kind = 'committed' AND "offset" < mark) GROUP BY ALL"""),
    "q17_mount_longest_prefix": q("topics mounts", """j AS (SELECT page_id, topics.tenant AS tenant, topic, prefix, mounts.stream AS stream, row_number() OVER (PARTITION BY page_id ORDER BY length(prefix) DESC) AS rn FROM topics JOIN mounts ON topics.tenant = mounts.tenant AND starts_with(topic, prefix)) SELECT page_id, tenant, topic, prefix, stream FROM j WHERE rn = 1"""),
    "q18_conditional_batches": q("log", """p AS (SELECT stream, shard, "offset", "offset" - "offset" % 3 AS batch, CAST("offset" % 3 AS INT) AS position, 3 AS len FROM log WHERE event_id % 17 <> 0),
b AS (SELECT stream, shard, batch, count(*) AS n, min("offset") AS first, max("offset") AS last FROM p GROUP BY ALL), t AS (SELECT stream, shard, arg_max(CASE WHEN n < 3 THEN first END, last) AS x, arg_max(n, last) AS n FROM b GROUP BY ALL),
k AS (SELECT b.* FROM b JOIN t USING (stream, shard) WHERE b.n = 3 AND (t.n >= 3 OR b.last < (SELECT min(first) FROM b b2 WHERE b2.stream = b.stream AND b2.shard = b.shard AND b2.last = (SELECT max(last) FROM b b3 WHERE b3.stream = b.stream AND b3.shard = b.shard))))
SELECT p.* FROM p SEMI JOIN k USING (stream, shard, batch)"""),
    "q19_quorum_offset": q("log tails replicas", """o AS (SELECT stream, shard, list_reverse_sort(list_append(list(least(reported, tail)) FILTER (member IN ('f1', 'f2') AND NOT halted), max(tail))) AS h FROM replicas GROUP BY stream, shard),
n AS (SELECT stream, shard, list_reverse_sort(list_append(coalesce(list(least(reported, tail)) FILTER (member IN ('f2', 'f3', 'f4') AND NOT halted), []), max(tail))) AS h FROM replicas GROUP BY stream, shard)
SELECT stream, shard, coalesce(o.h[2], 0) AS old_set, coalesce(n.h[3], 0) AS new_set, least(coalesce(o.h[2], 0), coalesce(n.h[3], 0)) AS "both" FROM o JOIN n USING (stream, shard)"""),
    "q20_cache_latest": q("cache", _live(NOW)),
    "q21_prefix_watch": q("cache", f"""o AS (SELECT * FROM cache WHERE starts_with(key, 'user-1')), l AS (SELECT *, row_number() OVER (PARTITION BY shard, key ORDER BY "offset" DESC) AS rn FROM o WHERE "offset" < 200)
SELECT 'retained' AS phase, shard, key, "offset", value FROM l WHERE rn = 1 AND op = 'put' AND (expires_at_millis = 0 OR {NOW} < expires_at_millis) UNION ALL SELECT 'change', shard, key, "offset", value FROM o WHERE "offset" >= 200"""),
    "q24_commit_state": q("heads ops", """l AS (SELECT *, row_number() OVER (PARTITION BY shard, key ORDER BY "offset" DESC, pos DESC) AS rn FROM ops) SELECT shard, key, value, "offset" AS version FROM l WHERE rn = 1 AND op = 'put'"""),
    "q24b_commit_events": q("heads", """SELECT shard, "offset", event, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n_ops FROM heads"""),
    "q25_counter_sum": q("counter", """m AS (SELECT key, max("offset") AS o, arg_max(amount, "offset") AS a FROM counter WHERE op = 'checkpoint' GROUP BY key)
SELECT c.key, CAST(coalesce(max(m.a), 0) + coalesce(sum(amount) FILTER (op = 'delta' AND (m.o IS NULL OR "offset" > m.o)), 0) AS BIGINT) AS value FROM counter c LEFT JOIN m ON c.key = m.key GROUP BY c.key"""),
    "q26_counter_running": q("counter", """e AS (SELECT *, sum(CASE WHEN op = 'checkpoint' THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY "offset") AS ep FROM counter), r AS (SELECT *, CAST(sum(amount) OVER (PARTITION BY key, ep ORDER BY "offset") AS BIGINT) AS running FROM e)
SELECT key, "offset", amount, running FROM r WHERE op = 'delta'"""),
    "q28_cursor_max": q("log gops", """s AS (SELECT shard, grp, max(idx) AS i, arg_max("to", idx) AS t FROM gw WHERE op = 'seek' GROUP BY ALL), a AS (SELECT shard, grp, max("to") AS f FROM gw LEFT JOIN s USING (shard, grp) WHERE op = 'advance' AND (i IS NULL OR idx > i) GROUP BY ALL)
SELECT shard, grp, CASE WHEN f IS NULL THEN t WHEN t IS NULL THEN f ELSE greatest(f, t) END AS cursor FROM a FULL JOIN s USING (shard, grp)"""),
    "q29_cursor_contiguous": q("log", """SELECT stream, shard, coalesce(min("offset") FILTER (event_id % 7 = 0), max("offset") + 1) AS cursor, count(*) FILTER (event_id % 7 <> 0) AS acked FROM log WHERE "offset" >= 3 GROUP BY ALL"""),
    "q30_idempotent_dedupe": q("producer", """w AS (SELECT *, row_number() OVER k AS n, first_value(props) OVER k AS fp, max(sequence) OVER (PARTITION BY shard, producer_id ORDER BY arrival) + 1 AS nx FROM producer WINDOW k AS (PARTITION BY shard, producer_id, sequence ORDER BY arrival))
SELECT shard, producer_id, sequence, arrival, CASE WHEN n = 1 THEN 'append' WHEN sequence < nx - 64 THEN 'expired' WHEN props <> fp THEN 'reused' ELSE 'duplicate' END AS verdict FROM w"""),
    "q30b_per_record": q("producer", """w AS (SELECT *, row_number() OVER k AS n, first_value(props) OVER k AS fp, max(sequence) OVER (PARTITION BY shard, producer_id ORDER BY arrival) + 1 AS nx FROM producer WINDOW k AS (PARTITION BY shard, producer_id, sequence ORDER BY arrival))
SELECT shard, producer_id, sequence, arrival, CASE WHEN n = 1 THEN 'append' WHEN sequence < nx - 64 THEN 'expired' WHEN props <> fp THEN 'reused' ELSE 'duplicate' END AS verdict FROM w"""),
    "q31_group_describe": q("log", """a AS (SELECT *, event_id % 7 <> 0 AS acked, 1 + event_id % 6 AS attempts FROM log), b AS (SELECT *, NOT acked AND attempts > 5 AS dead FROM a)
SELECT stream, shard, max("offset") + 1 AS tail, coalesce(min("offset") FILTER (NOT acked AND NOT dead), max("offset") + 1) AS committed, count(*) FILTER (NOT acked AND NOT dead AND attempts > 1) AS owed, count(*) FILTER (NOT acked AND NOT dead AND attempts <= 1) AS in_flight,
count(*) FILTER (dead) AS dead_letters, max("offset") + 1 - coalesce(min("offset") FILTER (NOT acked AND NOT dead), max("offset") + 1) AS lag FROM b GROUP BY stream, shard"""),
    "q32_backup_point": q("log tails", """SELECT stream, shard, tail AS committed FROM tails"""),
    "q33_trim_floor": q("log", """f AS (SELECT stream, shard, max("offset" // 2) AS fl FROM log WHERE mark_kind = 'trim' GROUP BY ALL) SELECT stream, shard, "offset", key FROM log LEFT JOIN f USING (stream, shard) WHERE "offset" >= coalesce(fl, 0)"""),
    "q34_compaction_survivors": q("cache", _live(0)),
    "q35_compaction_due": q("cache", f"""{LATEST} SELECT shard, CAST(sum(bytes) AS BIGINT) AS log_bytes, CAST(coalesce(sum(bytes) FILTER (rn = 1 AND op = 'put'), 0) AS BIGINT) AS live_bytes, sum(bytes) > 10000 AND sum(bytes) > 4 * coalesce(sum(bytes) FILTER (rn = 1 AND op = 'put'), 0) AS due FROM last GROUP BY shard"""),
    "q36_retention_prefix": q("log", f"""s AS (SELECT stream, shard, "offset" // 64 AS segment, max("offset") AS last_offset, CAST(sum(strlen(payload)) AS BIGINT) AS bytes, max(ts_us) AS newest FROM log GROUP BY stream, shard, "offset" // 64),
g AS (SELECT *, sum(bytes) OVER (PARTITION BY stream, shard ORDER BY segment DESC) AS rest, max(segment) OVER (PARTITION BY stream, shard) AS active FROM s), k AS (SELECT *, (rest > 4000 OR {NOW * 1000} - newest > {12 * DAY * 1000}) AND segment < active AS goes FROM g)
SELECT stream, shard, segment, last_offset, bytes FROM k WHERE goes AND NOT EXISTS (SELECT 1 FROM k b WHERE b.stream = k.stream AND b.shard = k.shard AND b.segment < k.segment AND NOT b.goes)"""),
    "q37_ring_tail": q("log", """r AS (SELECT *, sum(strlen(payload)) OVER (PARTITION BY stream, shard ORDER BY "offset" DESC) AS b, max("offset") OVER (PARTITION BY stream, shard) AS m FROM log) SELECT stream, shard, "offset", payload FROM r WHERE b <= 300 OR "offset" = m"""),
    "q38_epoch_ranges": q("log", """e AS (SELECT stream, shard, "offset" // 50 AS generation, min("offset") AS start_offset FROM log GROUP BY stream, shard, "offset" // 50) SELECT *, lead(start_offset) OVER (PARTITION BY stream, shard ORDER BY start_offset) AS end_offset FROM e"""),
    "q39_producer_lru": q("producer", """u AS (SELECT shard, producer_id, max(arrival) AS last_used FROM producer GROUP BY ALL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY shard ORDER BY last_used DESC, producer_id) AS INT) AS rank FROM u) SELECT * FROM r WHERE rank <= 10"""),
    "q40_promote": q("log tails replicas", """r AS (SELECT *, row_number() OVER (PARTITION BY stream, shard ORDER BY reported DESC, member DESC) AS rn FROM replicas WHERE NOT halted) SELECT stream, shard, member, reported FROM r WHERE rn = 1"""),
    "q42_tenant_delivery": q("log", """SELECT tenant, count(*) AS messages, CAST(sum(strlen(payload)) AS BIGINT) AS bytes FROM log WHERE mark_kind = 'data' GROUP BY tenant"""),
    "q43_subscriptions_page": q("log streams", """p AS (SELECT l.tenant, l.stream, l.shard, l.event_id AS id, l.key, s.consistency FROM log l JOIN streams s USING (tenant, stream) WHERE event_id % 7 > 0 AND (l.tenant, l.stream, l.shard, l.event_id) > ('t1', 'click', 1, 0)),
n AS (SELECT *, row_number() OVER (ORDER BY tenant, stream, shard, id) AS rn, count(*) OVER () > 25 AS more FROM p) SELECT tenant, stream, shard, id, key, consistency, more FROM n WHERE rn <= 25"""),
    "q44_change_feed": """SELECT o_orderkey AS seq, 'c-' || o_custkey AS key, CASE WHEN o_orderstatus = 'F' THEN 'delete' ELSE 'put' END AS op, 100 < (SELECT max(o_orderkey) FROM orders) - 499 AS resnapshot FROM orders WHERE o_orderkey >= 100 ORDER BY o_orderkey LIMIT 50""",
    "q45_keyset_page": """WITH p AS (SELECT c_mktsegment, c_custkey, c_name FROM customer WHERE (c_mktsegment, c_custkey) > ('BUILDING', 20)), n AS (SELECT *, row_number() OVER (ORDER BY c_mktsegment, c_custkey) AS rn, count(*) OVER () > 40 AS more FROM p) SELECT c_mktsegment, c_custkey, c_name, more FROM n WHERE rn <= 40""",
    "q46_grants": """WITH g AS (SELECT 'p' || (c_custkey % 20) AS principal, ['stream.subscribe', 'stream.manage', 'stream.publish'][c_custkey % 3 + 1] AS action, CASE WHEN c_custkey % 11 = 0 THEN 'cluster:*' WHEN c_custkey % 7 = 0 THEN '*' ELSE 'stream:t' || (c_custkey % 3) || '/*/' || substring(c_mktsegment, 1, 1) || '*' END AS pattern FROM customer),
a AS (SELECT * FROM g UNION ALL SELECT principal, i.b, pattern FROM g JOIN (VALUES ('stream.subscribe', 'group.consume'), ('stream.manage', 'group.manage'), ('stream.manage', 'stream.trim')) i(a, b) ON g.action = i.a),
r AS (SELECT DISTINCT 'p' || (c_nationkey % 20) AS principal, ['stream.subscribe', 'group.consume', 'stream.trim', 'stream.publish'][c_custkey % 4 + 1] AS action, CASE WHEN c_custkey % 13 = 0 THEN 'cluster:nodes' ELSE 'stream:t' || (c_custkey % 3) || '/n.s/' || c_mktsegment END AS resource FROM customer)
SELECT *, EXISTS (SELECT 1 FROM a WHERE a.principal = r.principal AND a.action = r.action AND CASE WHEN starts_with(resource, 'cluster:') THEN pattern = 'cluster:*' ELSE resource LIKE replace(pattern, '*', '%') END) AS allowed FROM r""",
    "q47_scoped_grants": """WITH g AS (SELECT 'p' || (c_custkey % 20) AS principal, 't' || (c_custkey % 3) AS a, substring(c_mktsegment, 1, 2) AS b, CASE c_custkey % 3 WHEN 0 THEN '*' WHEN 1 THEN 'user/*' ELSE 'user/' || c_custkey END AS k, c_custkey = 7 AS narrow FROM customer),
r AS (SELECT 'p' || (c_custkey % 20) AS principal, 't' || (c_nationkey % 3) AS a, c_mktsegment AS b, 'user/' || c_custkey AS k FROM customer)
SELECT DISTINCT r.principal, r.a || '/default/' || r.b || '/' || r.k AS resource FROM r JOIN g ON r.principal = g.principal AND r.a = g.a AND starts_with(r.b, g.b) AND CASE WHEN g.k LIKE '%*' THEN starts_with(r.k, rtrim(g.k, '*')) ELSE r.k = g.k END WHERE r.principal NOT IN (SELECT principal FROM g WHERE narrow)""",
    "q48_region_bridges": """WITH p AS (SELECT c_nationkey % 5 AS src, CAST(c_custkey % 5 AS INT) AS dst, c_custkey FROM customer), b AS (SELECT DISTINCT n_nationkey % 5 AS src, n_regionkey AS dst FROM nation WHERE n_nationkey % 5 <> n_regionkey) SELECT * FROM p WHERE src = dst OR EXISTS (SELECT 1 FROM b WHERE b.src = p.src AND b.dst = p.dst)""",
    "q49_mount_overlap": q("topics mounts", """d AS (SELECT DISTINCT tenant, prefix FROM mounts) SELECT DISTINCT a.tenant, a.prefix AS shorter, b.prefix AS longer FROM d a JOIN d b ON a.tenant = b.tenant AND a.prefix <> b.prefix AND starts_with(b.prefix, a.prefix)"""),
    "q50_ledger_verdict": """WITH w AS (SELECT event_id AS key, CASE event_id % 13 WHEN 0 THEN 'refused' WHEN 1 THEN 'in_doubt' ELSE 'acked' END AS outcome FROM events), s0 AS (SELECT event_id AS key FROM events WHERE event_id % 29 <> 0 AND (event_id % 13 <> 0 OR event_id % 26 = 0)),
s AS (SELECT key FROM s0 UNION ALL SELECT key FROM s0 WHERE key % 31 = 0 UNION ALL SELECT -1 - event_id FROM events WHERE event_id % 500 = 0), n AS (SELECT key, count(*) AS n FROM s GROUP BY key)
SELECT count(*) FILTER (outcome = 'acked' AND n IS NULL) AS gaps, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates, count(*) FILTER (outcome = 'acked' AND n = 1) AS acked_once, count(*) FILTER (outcome = 'refused' AND n IS NOT NULL) AS refused_present,
count(*) FILTER (outcome = 'in_doubt' AND n IS NOT NULL) AS in_doubt_landed, count(*) FILTER (outcome = 'in_doubt' AND n IS NULL) AS in_doubt_absent, count(*) FILTER (outcome IS NULL) AS unexpected FROM w FULL JOIN n USING (key)""",
    "q52_stalls": q("log", """o AS (SELECT stream, shard, ts_us AS b, ts_us + cents * 100 AS e FROM log WHERE cents * 100 >= 500000), m AS (SELECT *, max(e) OVER (PARTITION BY stream, shard ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM o),
g AS (SELECT *, sum(CASE WHEN coalesce(pm, -1) < b + 500000 THEN 1 ELSE 0 END) OVER (PARTITION BY stream, shard ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS grp FROM m) SELECT stream, shard, min(b) + 500000 AS from_us, max(e) AS until_us, count(*) AS waiting FROM g GROUP BY stream, shard, grp"""),
    "q53_divergence": q("cache", """a AS (SELECT key, arg_max(row(value), "offset") AS v FROM cache GROUP BY shard, key), r AS (SELECT key, arg_max(row(value), "offset") AS v FROM cache WHERE "offset" % 9 <> 0 GROUP BY shard, key)
SELECT a.key, a.v[1] AS value, r.v[1] AS local FROM a LEFT JOIN r ON a.key = r.key WHERE a.v[1] IS NOT NULL AND a.v[1] IS DISTINCT FROM r.v[1]"""),
    "q54_history_rules": q("log hist final", """rd AS (SELECT stream, shard, "offset", value + CASE WHEN value % 151 = 0 THEN 1 ELSE 0 END AS value FROM h3),
dl AS (SELECT stream || '/' || shard AS sub, stream, shard, value AS arrival, "offset" - CASE WHEN value % 131 = 0 THEN 15 ELSE 0 END AS "offset", value, value % 2 AS skipped FROM h3 WHERE value % 61 <> 0), mv AS (SELECT *, lag("offset") OVER (PARTITION BY sub ORDER BY arrival) AS prev FROM dl),
ld AS (SELECT stream, shard, "offset" // 150 AS g FROM h3 GROUP BY stream, shard, "offset" // 150 HAVING count(DISTINCT CASE WHEN value % 499 = 0 THEN 'n9' ELSE 'n' END) > 1),
sb AS (SELECT DISTINCT stream || '/' || shard AS sub, stream, shard, 0 AS start FROM h3 UNION ALL SELECT DISTINCT 'idle/' || stream, stream, 0, 30 FROM h3 WHERE shard = 0)
SELECT 'acked append is missing' AS rule, count(*) AS violations FROM h3 WHERE outcome = 'ok' AND value NOT IN (SELECT value FROM final)
UNION ALL SELECT 'value at two offsets', count(*) FROM (SELECT value FROM final GROUP BY value HAVING count(*) > 1)
UNION ALL SELECT 'read disagrees with the log', count(*) FROM rd JOIN final f ON rd.stream = f.stream AND rd.shard = f.shard AND rd."offset" = f."offset" AND rd.value <> f.value
UNION ALL SELECT 'value that nobody appended', count(*) FROM final WHERE value NOT IN (SELECT value FROM h3)
UNION ALL SELECT 'failed append is present', count(*) FROM h3 WHERE outcome = 'fail' AND value IN (SELECT value FROM final)
UNION ALL SELECT 'delivery goes back', count(*) FROM mv WHERE "offset" <= prev
UNION ALL SELECT 'delivery isn''t in the log', count(*) FROM dl WHERE NOT EXISTS (SELECT 1 FROM final f WHERE f.stream = dl.stream AND f.shard = dl.shard AND f."offset" = dl."offset" AND f.value = dl.value)
UNION ALL SELECT 'record hidden or never delivered', (SELECT count(*) FROM (SELECT DISTINCT dl.sub, dl."offset" - 1 AS o FROM dl JOIN final f ON dl.skipped = 1 AND f.stream = dl.stream AND f.shard = dl.shard AND f."offset" = dl."offset" - 1 WHERE dl."offset" - 1 >= 0))
  + (SELECT count(*) FROM sb WHERE EXISTS (SELECT 1 FROM final f WHERE f.stream = sb.stream AND f.shard = sb.shard AND f."offset" >= sb.start AND f."offset" > coalesce((SELECT max("offset") FROM dl WHERE dl.sub = sb.sub), -1)))
UNION ALL SELECT 'two writers in a generation', count(*) FROM ld"""),
    "q55_realtime_order": q("log hist", """o AS (SELECT stream, shard, value, invoke, complete, "offset" + CASE WHEN value % 37 = 0 THEN 30 ELSE 0 END AS "offset" FROM hist WHERE outcome = 'ok')
SELECT b.stream, b.shard, b.value, b."offset", max(a."offset") AS furthest FROM o a JOIN o b ON a.stream = b.stream AND a.shard = b.shard AND a.complete < b.invoke GROUP BY ALL HAVING max(a."offset") > b."offset" """),
    "q56_stale_get": q("log", """p AS (SELECT key, event_id AS put, ts_us AS invoke, ts_us + cents * 1000 AS complete, event_id % 10 <> 1 AS acked FROM log WHERE event_id % 3 <> 0),
g0 AS (SELECT key, event_id AS get, ts_us AS invoke, ts_us + 1000 AS complete, CASE WHEN event_id % 4 <> 0 THEN event_id - 1 - event_id % 7 END AS n FROM log WHERE event_id % 3 = 0),
g AS (SELECT key, get, invoke, complete, (SELECT max(put) FROM p WHERE p.key = g0.key AND p.put <= g0.n) AS seen FROM g0),
ev AS (SELECT key, complete AS at, invoke, put FROM p WHERE acked UNION ALL SELECT g.key, g.complete, p.invoke, p.put FROM g JOIN p ON p.key = g.key AND p.put = g.seen),
nw AS (SELECT g.key, g.get, g.seen, arg_max(ev.put, ev.invoke) AS newest, max(ev.invoke) AS ni FROM g JOIN ev ON ev.key = g.key AND ev.at < g.invoke GROUP BY ALL)
SELECT nw.key, nw.get, nw.seen, nw.newest FROM nw LEFT JOIN p ON p.key = nw.key AND p.put = nw.seen WHERE nw.seen IS NULL OR (p.acked AND nw.ni > p.complete)"""),
    "q57_commit_atomicity": q("heads", """e AS (SELECT shard, "offset" FROM heads WHERE "offset" % 50 <> 0), s AS (SELECT shard, "offset" FROM heads WHERE "offset" % 51 <> 0 AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey))
SELECT shard, "offset", 'event without state' AS fault FROM (SELECT * FROM e EXCEPT SELECT * FROM s) UNION ALL SELECT shard, "offset", 'state without event' FROM (SELECT * FROM s EXCEPT SELECT * FROM e)"""),
    "q58_cycles": q("log hist", """ap AS (SELECT stream, shard, "offset" * 2 AS o, value, invoke, complete, outcome FROM hist WHERE value % 13 <> 5 AND outcome <> 'fail'),
fin AS (SELECT stream, shard, o, value FROM ap UNION ALL SELECT stream, shard, o + 5, value FROM ap WHERE value % 101 = 0),
ow AS (SELECT *, sum(nw) OVER (PARTITION BY stream, shard ORDER BY o) - 1 AS place FROM (SELECT *, CASE WHEN lag(value) OVER (PARTITION BY stream, shard ORDER BY o) IS DISTINCT FROM value THEN 1 ELSE 0 END AS nw FROM fin)),
an AS (SELECT ap.stream, ap.shard, ap.value AS op, min(place) AS leads, max(place) AS entered, min(invoke) AS invoke, min(complete) AS complete, min(outcome) = 'ok' AS sure, false AS rd FROM ow JOIN ap ON ow.stream = ap.stream AND ow.shard = ap.shard AND ow.value = ap.value GROUP BY ap.stream, ap.shard, ap.value),
r0 AS (SELECT stream, shard, value AS op, invoke, invoke + 1000 AS complete, "offset" * 2 - 2 - CASE WHEN value % 7 = 0 THEN 14 ELSE 0 END + CASE WHEN value % 17 = 0 THEN 6 ELSE 0 END AS top FROM hist WHERE value % 13 = 5),
sn AS (SELECT r0.op, fin.o, an.entered FROM r0 JOIN fin ON fin.stream = r0.stream AND fin.shard = r0.shard AND fin.o IN (top - 4, top - 2, top) JOIN an ON an.stream = fin.stream AND an.shard = fin.shard AND an.op = fin.value),
r1 AS (SELECT r0.stream, r0.shard, r0.op, r0.invoke, r0.complete, coalesce(max(sn.o), -1) AS upto, coalesce(arg_max(sn.entered, sn.o), -1) AS entered FROM r0 LEFT JOIN sn ON sn.op = r0.op GROUP BY r0.stream, r0.shard, r0.op, r0.invoke, r0.complete),
rn AS (SELECT r1.stream, r1.shard, r1.op, (SELECT min(place) FROM ow WHERE ow.stream = r1.stream AND ow.shard = r1.shard AND ow.o > r1.upto) AS leads, entered, invoke, complete, true AS sure, true AS rd FROM r1),
nd AS (SELECT * FROM an UNION ALL SELECT * FROM rn),
tm AS (SELECT y.stream, y.shard, y.op, y.leads, y.rd, max(x.entered * 2 + CASE WHEN x.rd THEN 0 ELSE 1 END) AS fr FROM nd y JOIN nd x ON x.stream = y.stream AND x.shard = y.shard AND x.sure AND x.complete < y.invoke WHERE y.leads IS NOT NULL GROUP BY ALL),
bk AS (SELECT stream, shard, leads AS a, CAST(floor(fr / 2.0) AS BIGINT) AS b, CASE WHEN rd THEN 'G-single' WHEN fr % 2 = 0 THEN 'G1c' ELSE 'G0' END || '-realtime' AS rule, CAST(floor(fr / 2.0) AS BIGINT) - leads + 1 + CASE WHEN rd THEN 1 ELSE 0 END + CASE WHEN fr % 2 = 0 THEN 1 ELSE 0 END AS ops FROM tm WHERE floor(fr / 2.0) >= leads
  UNION ALL SELECT stream, shard, leads, entered, CASE WHEN rd THEN 'G-single' ELSE 'G0' END, entered - leads + CASE WHEN rd THEN 2 ELSE 0 END FROM nd WHERE entered > leads OR (rd AND entered >= leads)),
mg AS (SELECT *, sum(ap) OVER (PARTITION BY stream, shard ORDER BY a, b DESC, rule, ops ROWS UNBOUNDED PRECEDING) AS part FROM (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY stream, shard ORDER BY a, b DESC, rule, ops ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS ap FROM bk)),
cp AS (SELECT stream, shard, min(a) AS first, max(b) AS last, min(row(ops, rule)) AS c FROM mg GROUP BY stream, shard, part)
SELECT stream, shard, CAST(first AS BIGINT) AS first, CAST(last AS BIGINT) AS last, c[2] AS rule, CAST(c[1] AS BIGINT) AS ops, c[2] = 'G0-realtime' OR (c[2] = 'G0' AND EXISTS (SELECT 1 FROM an WHERE an.stream = cp.stream AND an.shard = cp.shard AND entered > leads)) AS explained FROM cp"""),
    "q60_bench_agg": q("log runs", """SELECT workload, size, count(*) AS trials, count(*) FILTER (failed) AS failures, quantile_cont(cents, 0.5) AS median, quantile_cont(cents, 0.1) AS p10, quantile_cont(cents, 0.9) AS p90, max(cents) AS most FROM runs GROUP BY workload, size"""),
    "q60b_latest_session": q("log runs", """SELECT session, workload, count(*) AS n FROM runs WHERE session = (SELECT session FROM runs GROUP BY session ORDER BY max(ts_us) DESC, session LIMIT 1) GROUP BY session, workload"""),
    "q61_percentile_definitions": q("log runs", """s AS (SELECT workload, list_sort(list(cents)) AS a, count(*) AS n FROM runs GROUP BY workload)
SELECT workload, a[CAST(floor((n - 1) * 0.95 + 0.5) AS BIGINT) + 1] AS rounded_rank, a[CAST(floor((n - 1) * 0.95 + 0.5) AS BIGINT) + 1] // 1000 AS rounded_rank_thousands, a[CAST(ceil(n * 0.95) AS BIGINT)] AS nearest_rank,
list_aggregate(a, 'quantile_cont', 0.95) AS linear, a[n // 2 + 1] AS upper_median FROM s"""),
    "q62_paired_interval": q("log runs", """m AS (SELECT workload AS cell, session % 12 AS rd, median(cents) FILTER (NOT candidate) AS b, median(cents) FILTER (candidate) AS c FROM runs GROUP BY workload, session % 12),
l AS (SELECT cell, list_sort(list(c / b)) AS r FROM m WHERE b > 0 AND c > 0 GROUP BY cell), k AS (SELECT *, CASE len(r) WHEN 6 THEN 1 WHEN 12 THEN 2 WHEN 24 THEN 6 END AS k FROM l) SELECT cell, CAST(len(r) AS INT) AS rounds, r[k] AS low, r[len(r) - k + 1] AS high FROM k WHERE k IS NOT NULL"""),
    "q64_metadata_lookup": q("log streams", """rd AS (SELECT DISTINCT 'p' || (user_id % 7) AS principal, tenant, stream FROM log WHERE event_id % 3 = 0) SELECT principal, tenant, stream, shards, consistency, coalesce(retention_bytes, 1) > 0 AS valid FROM streams JOIN rd USING (tenant, stream) WHERE durable"""),
    "q65_lifecycle_check": """WITH s AS (SELECT 'node-' || (user_id % 20) AS node, event_id AS seq, ['live', 'draining', 'down', 'live', 'left'][event_id % 5 + 1] AS state FROM events), m AS (SELECT *, lag(state) OVER (PARTITION BY node ORDER BY seq) AS before FROM s)
SELECT node, seq, before, state FROM m WHERE before <> state AND (before || '>' || state) NOT IN ('live>draining', 'live>down', 'draining>live', 'draining>down', 'draining>left', 'down>live', 'down>left')""",
    "q66_incarnation_visible": """WITH t AS (SELECT 's-' || o_custkey AS name, max(o_orderkey) AS d FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL) SELECT 's-' || o_custkey AS name, o_orderkey AS incarnation FROM orders LEFT JOIN t ON t.name = 's-' || o_custkey WHERE o_orderkey > coalesce(d, -1)""",
    "q67_shard_resolution": q("log tails", """n AS (SELECT *, length(stream) + shard AS n FROM tails), r AS (SELECT stream, shard, 'node-' || (n % 4 * 30) AS leader, n % 3 + 2 AS generation FROM n WHERE n % 5 <> 0), s AS (SELECT 'node-' || s_suppkey AS leader, CASE WHEN s_suppkey % 2 = 0 THEN 'live' ELSE 'down' END AS state FROM supplier),
a AS (SELECT n.stream, n.shard, leader, CASE WHEN leader IS NULL AND n % 2 = 0 THEN 'stale' WHEN leader IS NULL THEN 'no_assignment' WHEN n % 2 = 0 AND generation < 3 THEN 'stale' WHEN leader = 'node-30' THEN 'local' WHEN state IS NULL THEN 'leader_unknown' WHEN state <> 'live' THEN 'unavailable' ELSE 'elsewhere' END AS answer
FROM n LEFT JOIN r USING (stream, shard) LEFT JOIN s USING (leader)) SELECT stream, shard, answer, CASE WHEN answer IN ('local', 'elsewhere', 'unavailable') THEN leader END AS node FROM a"""),
    "st1_stream_tail": """SELECT event_id, user_id, epoch_us(ts) AS ts_us, props FROM events WHERE event_type = 'click'""",
    "st2_replay_then_live": """SELECT event_id, user_id, props FROM events WHERE event_id % 3 = 0 OR event_id % 3 <> 1""",
    "st3_stream_dedupe": """SELECT user_id, event_id, props FROM events""",
    "e1_tumbling": f"""WITH {_WINDOW} SELECT t // 21600000000 * 21600000000 AS start_us, t // 21600000000 * 21600000000 + 21600000000 AS end_us, event_type, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM e GROUP BY t // 21600000000, event_type""",
    "e2_sliding": f"""WITH {_WINDOW}, w AS (SELECT (t // 21600000000 - k) * 21600000000 AS s, e.* FROM e, (VALUES (0), (1)) v(k)) SELECT s AS start_us, s + 43200000000 AS end_us, event_type, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM w GROUP BY s, event_type""",
    "e3_session": f"""WITH {_WINDOW}, g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) < 7200000000 THEN 0 ELSE 1 END AS new FROM e), h AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t) AS s FROM g)
SELECT min(t) AS start_us, max(t) + 7200000000 AS end_us, user_id, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM h GROUP BY user_id, s""",
    "q06b_trailing_gap": q("log", """l AS (SELECT stream, shard, max("offset") AS last, max("offset") FILTER (mark_kind = 'data') AS d, min("offset") AS b FROM log GROUP BY ALL) SELECT stream, shard, coalesce(d + 1, b) AS first, last FROM l WHERE coalesce(d + 1, b) <= last"""),
    "q10b_offload": q("log", """s AS (SELECT *, "offset" // 64 AS seg, max("offset" // 64) OVER (PARTITION BY stream, shard) AS act FROM log) SELECT stream, shard, seg AS segment, min("offset") AS first_offset, max("offset") AS last_offset, count(*) AS records, CAST(sum(strlen(payload)) AS BIGINT) AS bytes, max(ts_us) AS newest_us FROM s WHERE seg < act GROUP BY stream, shard, seg"""),
    "q20b_index_read": q("cache", f"""{LATEST} SELECT shard, key, "offset" AS version, ts_ms, bytes FROM last WHERE rn = 1 AND op = 'put' AND (expires_at_millis = 0 OR {NOW} < expires_at_millis)"""),
    "st4_cache_watch": q("cache", f"""o AS (SELECT * FROM cache WHERE starts_with(key, 'user-1')), l AS (SELECT *, row_number() OVER (PARTITION BY shard, key ORDER BY "offset" DESC) AS rn FROM o WHERE "offset" < 200)
SELECT 'retained' AS phase, shard, key, "offset", value FROM l WHERE rn = 1 AND op = 'put' AND (expires_at_millis = 0 OR {NOW} < expires_at_millis) UNION ALL SELECT 'change', shard, key, "offset", value FROM o WHERE "offset" >= 200"""),
    "q21b_key_watch": q("cache", f"""o AS (SELECT * FROM cache WHERE key = 'user-7'), l AS (SELECT *, row_number() OVER (PARTITION BY shard, key ORDER BY "offset" DESC) AS rn FROM o WHERE "offset" < 20)
SELECT 'retained' AS phase, shard, key, "offset", value FROM l WHERE rn = 1 AND op = 'put' AND (expires_at_millis = 0 OR {NOW} < expires_at_millis) UNION ALL SELECT 'change', shard, key, "offset", value FROM o WHERE "offset" >= 20"""),
    "q21c_watch_resume": q("cache", f"""o AS (SELECT * FROM cache WHERE starts_with(key, 'user-1')), l AS (SELECT *, row_number() OVER (PARTITION BY shard, key ORDER BY "offset" DESC) AS rn FROM o WHERE shard * 60 < 100)
SELECT 'resnapshot' AS phase, shard, CAST(100 AS BIGINT) AS "offset", NULL AS key, CAST(NULL AS BIGINT) AS value FROM cache WHERE shard * 60 < 100 GROUP BY shard
UNION ALL SELECT 'retained', shard, "offset", key, value FROM l WHERE rn = 1 AND op = 'put' AND (expires_at_millis = 0 OR {NOW} < expires_at_millis)
UNION ALL SELECT 'change', shard, "offset", key, value FROM o WHERE shard * 60 >= 100 AND "offset" >= shard * 60
UNION ALL SELECT 'caught_up', shard, max("offset") + 1, NULL, NULL FROM cache GROUP BY shard"""),
    "q22b_ttl_sweep": q("cache", f"""{LATEST}, d AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY expires_at_millis, key) AS n FROM last WHERE rn = 1 AND op = 'put' AND expires_at_millis > 0 AND expires_at_millis <= {NOW}), t AS (SELECT shard, max("offset") + 1 AS tail FROM cache GROUP BY shard)
SELECT d.shard, key, 'delete' AS op, "offset" AS version, tail + n - 1 AS "offset" FROM d JOIN t ON d.shard = t.shard WHERE n <= 20"""),
    "q27c_attempts": q("log", """c AS (SELECT shard, stream AS grp, "offset" % 40 AS "offset", event_id AS idx FROM log WHERE event_id % 20 BETWEEN 11 AND 14) SELECT *, CAST(row_number() OVER w AS INT) AS attempt, row_number() OVER w > 1 AS redelivered FROM c WINDOW w AS (PARTITION BY shard, grp, "offset" ORDER BY idx)"""),
    "q15_conditional_publish": steps("log", """SELECT stream, shard, event_id AS arrival, CASE WHEN event_id % 5 <> 0 THEN "offset" - "offset" // 7 END AS expected, "offset" + 1 AS n FROM log""",
        """SELECT DISTINCT stream, shard, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS arrival, true AS applied, CAST(0 AS BIGINT) AS first_offset, CAST(0 AS BIGINT) AS tail FROM r""",
        """SELECT r.stream, r.shard, r.n, r.arrival, r.expected IS NULL OR r.expected = f.tail, CASE WHEN r.expected IS NULL OR r.expected = f.tail THEN f.tail END, f.tail + CASE WHEN r.expected IS NULL OR r.expected = f.tail THEN 1 ELSE 0 END FROM f JOIN r ON r.stream = f.stream AND r.shard = f.shard AND r.n = f.n + 1""",
        """SELECT stream, shard, arrival, applied, first_offset, tail FROM f WHERE n > 0"""),
    "q33b_trim_fold": steps("log", """SELECT stream, shard, event_id AS seq, "offset" // 2 AS before, CASE WHEN event_id % 4 = 0 THEN 0 WHEN event_id % 2 = 0 THEN "offset" // 4 END AS expected, row_number() OVER (PARTITION BY stream, shard ORDER BY event_id) AS n FROM log WHERE mark_kind = 'trim'""",
        """SELECT DISTINCT stream, shard, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS seq, true AS applied, CAST(0 AS BIGINT) AS floor FROM r""",
        """SELECT r.stream, r.shard, r.n, r.seq, r.expected IS NULL OR r.expected = f.floor, CASE WHEN r.expected IS NULL OR r.expected = f.floor THEN greatest(f.floor, r.before) ELSE f.floor END FROM f JOIN r ON r.stream = f.stream AND r.shard = f.shard AND r.n = f.n + 1""",
        """SELECT stream, shard, seq, applied, floor FROM f WHERE n > 0"""),
    "q22_cache_cas": steps("cache", """SELECT shard, key, "offset", ts_ms, op, expires_at_millis, CASE WHEN "offset" % 3 <> 0 THEN "offset" - "offset" % 50 END AS expected, row_number() OVER (PARTITION BY shard, key ORDER BY "offset") AS n FROM cache""",
        """SELECT DISTINCT shard, key, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS "offset", false AS applied, CAST(NULL AS BIGINT) AS version, CAST(0 AS BIGINT) AS expires FROM r""",
        """SELECT shard, key, n, "offset", ok, CASE WHEN NOT ok THEN version WHEN op = 'put' THEN "offset" END, CASE WHEN ok THEN expires_at_millis ELSE expires END FROM (SELECT r.*, f.version, f.expires, CASE WHEN f.expires <> 0 AND r.ts_ms >= f.expires THEN NULL ELSE f.version END IS NOT DISTINCT FROM r.expected AS ok FROM f JOIN r ON r.shard = f.shard AND r.key = f.key AND r.n = f.n + 1)""",
        """SELECT shard, key, "offset", applied, version FROM f WHERE n > 0"""),
    "q68_lease_holder": steps("cache", """SELECT 'lease-' || substring(key, 6, 1) AS lease, key AS holder, "offset" * 4 + shard AS "offset", ts_ms, row_number() OVER (PARTITION BY substring(key, 6, 1) ORDER BY "offset" * 4 + shard) AS n FROM cache""",
        """SELECT lease, n, holder, "offset" AS token, "offset" AS version, ts_ms + 21600000 AS until FROM r WHERE n = 1""",
        """SELECT lease, n, CASE WHEN free THEN new ELSE holder END, CASE WHEN free THEN o ELSE token END, CASE WHEN free OR holder = new THEN o ELSE version END, CASE WHEN free OR holder = new THEN ts_ms + 21600000 ELSE until END FROM (SELECT f.lease, r.n, f.holder, r.holder AS new, r."offset" AS o, f.token, f.version, f.until, r.ts_ms, r.ts_ms >= f.until AS free FROM f JOIN r ON r.lease = f.lease AND r.n = f.n + 1)""",
        f"""SELECT lease, holder, token, version, until > {NOW} AS held FROM f WHERE n = (SELECT max(n) FROM r WHERE r.lease = f.lease)"""),
    "q13b_route_jump": q("log", _ROUTE.partition(" SELECT event_id")[0] + """, j AS (SELECT key, (WITH RECURSIVE k AS (SELECT x AS st, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS g UNION ALL SELECT (st * 2862933555777941757 + 1) % 18446744073709551616, g, CAST(floor((g + 1) * (2147483648.0::DOUBLE / CAST(((((st * 2862933555777941757 + 1) % 18446744073709551616) >> 33) + 1) AS DOUBLE))) AS BIGINT) FROM k WHERE g < 4) SELECT max(b) FROM k) AS b FROM f3)
SELECT event_id, key, CAST(b AS INT) AS routed FROM log JOIN j USING (key)"""),
    "q45b_cursor_page": """WITH p AS (SELECT c_mktsegment, c_custkey, c_name FROM customer WHERE (c_mktsegment, c_custkey) > ('FURNITURE', 7)), n AS (SELECT *, row_number() OVER (ORDER BY c_mktsegment, c_custkey) AS rn, count(*) OVER () > 30 AS more FROM p) SELECT c_mktsegment, c_custkey, c_name, more FROM n WHERE rn <= 30""",
    "q52b_drain_time": q("log", f"""SELECT stream, shard, count(*) AS outstanding, max(ts_us + cents * 1000000) - {TIMES[4]} AS drain_us FROM log WHERE ts_us <= {TIMES[4]} AND ts_us + cents * 1000000 > {TIMES[4]} GROUP BY stream, shard"""),
    "q60c_jsonl_runs": q("log runs", """g AS (SELECT *, event_id % 19 = 0 AS bad, CAST(user_id % 5 AS INT) AS size FROM log WHERE event_id % 501 <> 0) SELECT stream AS workload, size, count(*) AS trials, count(*) FILTER (bad) AS failures, quantile_cont(cents, 0.5) AS median, quantile_cont(cents, 0.1) AS p10, quantile_cont(cents, 0.9) AS p90, CAST(max(cents) AS DOUBLE) AS most FROM g GROUP BY stream, size"""),
    "q64b_registry": """WITH o AS (SELECT 't' || (o_custkey % 3) AS tenant, 'stream' AS kind, 's-' || o_custkey AS name, o_orderkey AS seq, o_orderstatus = 'P' AS rm, o_orderstatus = 'F' AS durable FROM orders), g AS (SELECT name, max(seq) AS gone FROM o WHERE rm GROUP BY name)
SELECT tenant, kind, o.name, arg_min(durable, seq) AS durable, min(seq) AS since, count(*) - 1 AS again FROM o LEFT JOIN g ON g.name = o.name WHERE NOT rm AND seq > coalesce(gone, -1) GROUP BY tenant, kind, o.name""",
    "q69_json_props": q("log", """SELECT stream, count(regexp_extract(payload, '"k": ?(-?[0-9]+)', 1)) AS n, CAST(sum(CAST(regexp_extract(payload, '"k": ?(-?[0-9]+)', 1) AS BIGINT)) AS BIGINT) AS k, min(CAST(regexp_extract(payload, '"k": ?(-?[0-9]+)', 1) AS BIGINT)) AS least, max(CAST(regexp_extract(payload, '"k": ?(-?[0-9]+)', 1) AS BIGINT)) AS most FROM log GROUP BY stream"""),
    "q70_record_batches": q("log", """SELECT stream, shard, "offset", ts_us // 1000 AS ts_ms, key, payload, CAST(-1 AS BIGINT) AS producer_id, CAST(-1 AS BIGINT) AS sequence FROM log WHERE mark_kind = 'data'"""),
    "q71_commit_records": q("heads ops", """SELECT o.shard, o."offset", event, op, key, CASE WHEN op = 'put' THEN value END AS value FROM ops o JOIN heads h ON h.shard = o.shard AND h."offset" = o."offset" """),
    "q72_publish_report": q("log", _ROUTE.partition(" SELECT event_id")[0] + """, e AS (SELECT event_id // 50 AS batch, event_id % 50 AS pos, CAST(x % 4 AS INT) AS shard, strlen(payload) AS b FROM log JOIN f3 USING (key))
SELECT batch, shard, count(*) AS records, CAST(sum(b) AS BIGINT) AS bytes, (batch + shard) % 9 <> 0 AS ok, CASE WHEN (batch + shard) % 9 = 0 THEN string_agg(pos, ',' ORDER BY pos) END AS failed FROM e GROUP BY batch, shard"""),
    "q74_apply_in_order": q("log", """SELECT stream, shard, "offset", ts_us + cents * 1000 AS finished, max(ts_us + cents * 1000) OVER (PARTITION BY stream, shard ORDER BY "offset") AS applied FROM log"""),
    "q75_lag_notices": q("log tails", """s AS (SELECT 'sub/' || stream || '/' || shard AS sub, stream, shard, tail, tail * (shard + 6) // 10 AS position FROM tails) SELECT sub, stream, shard, tail - position - 64 AS dropped, position AS resume FROM s WHERE tail - position > 64"""),
    "q76_topic_subscription": q("topics", f"""m AS (SELECT topic, page_id, greatest({_SUBSCRIBED}) AS qos FROM topics WHERE topic <> '' AND strlen(topic) <= 65535 AND NOT regexp_matches(topic, '[+#]')) SELECT topic, 'pages' AS stream, CAST(page_id % 4 AS INT) AS shard, page_id // 4 AS "offset", qos FROM m WHERE qos IS NOT NULL AND page_id // 4 >= 3"""),
    "q77_retry_classes": """SELECT event_id, ['not_found', 'throttled', 'stale', 'other'][event_id % 4 + 1] AS code, ['never', 'later', 'refresh', 'never'][event_id % 4 + 1] AS retry FROM events""",
    "q30c_record_digest": q("log", f"""b AS (SELECT event_id, list_concat([0, 0, 0, 0, 0, 0, 0, length(payload)], list_transform(range(1, length(payload) + 1), lambda i: ascii(payload[i]))) AS bytes FROM log),
c AS (SELECT event_id, xor({_ALL}, list_reduce(list_prepend({_ALL}, list_transform(bytes, lambda b: CAST(b AS UBIGINT))), lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda k: CAST(k AS UBIGINT))), lambda h, k: xor(h >> 1, CASE WHEN h & 1 = 1 THEN {_CRC64} ELSE CAST(0 AS UBIGINT) END)))) AS d FROM b)
SELECT event_id, CAST(CASE WHEN d >= 9223372036854775808 THEN CAST(d AS HUGEINT) - 18446744073709551616 ELSE d END AS BIGINT) AS digest FROM c"""),
    "q41_rendezvous": q("log", f"""s AS (SELECT DISTINCT tenant, namespace, stream, shard FROM log), n AS (SELECT 'node-' || s_suppkey AS node FROM supplier),
l AS (SELECT *, {_mix(_fnv("list_concat(" + ", ".join(f"list_transform(range(1, length({c}) + 1), lambda i: ascii({c}[i])), [255]" for c in ("tenant", "namespace", "stream")) + ", [0, 0, 0, shard, 255])"))} AS a FROM s),
r AS (SELECT *, {_mix(_fnv("list_concat(list_transform(range(1, length(node) + 1), lambda i: ascii(node[i])), [255])"))} AS b FROM n),
p AS (SELECT l.*, node, {_mix("xor((a * 11400714819323198485) % 18446744073709551616, ((b << 32) % 18446744073709551616) | (b >> 32))")} AS score FROM l, r),
k AS (SELECT *, row_number() OVER (PARTITION BY tenant, namespace, stream, shard ORDER BY score DESC, node DESC) AS rn FROM p), w AS (SELECT tenant, namespace, stream, shard, node FROM k WHERE rn = 1)
SELECT w.*, count(*) OVER (PARTITION BY node) AS leads FROM w"""),
    "q73_reservoir": q("log", """r AS (SELECT stream, event_id, cents, row_number() OVER (PARTITION BY stream ORDER BY md5('42:' || event_id), event_id) AS n FROM log) SELECT stream, event_id, cents FROM r WHERE n <= 100"""),
    "x1_tenant_rate": steps("log", """SELECT tenant, ts_us AS at_us, CAST(1 AS BIGINT) AS msgs, cents AS bytes, row_number() OVER (PARTITION BY tenant ORDER BY ts_us, cents) AS n FROM log""",
        """SELECT DISTINCT tenant, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS at_us, CAST(0 AS BIGINT) AS msgs, CAST(0 AS BIGINT) AS bytes, true AS admitted, CAST(0 AS BIGINT) AS wait_ms, CAST(10 AS DOUBLE) AS m, CAST(2000 AS DOUBLE) AS b FROM r""",
        """SELECT tenant, n, at_us, msgs, bytes, w = 0, w, CASE WHEN w = 0 THEN greatest(m - msgs, -0.01::DOUBLE * 5) ELSE m END, CASE WHEN w = 0 THEN greatest(b - bytes, -2.0::DOUBLE * 5) ELSE b END FROM (SELECT *, greatest(CASE WHEN m < 0 THEN CAST(ceil(-m / 0.01::DOUBLE * 1000) AS BIGINT) ELSE 0 END, CASE WHEN b < 0 THEN CAST(ceil(-b / 2.0::DOUBLE * 1000) AS BIGINT) ELSE 0 END) AS w
  FROM (SELECT r.*, least(f.m + (r.at_us - coalesce(f.at_us, r.at_us)) / 1e6::DOUBLE * 0.01::DOUBLE, 10) AS m, least(f.b + (r.at_us - coalesce(f.at_us, r.at_us)) / 1e6::DOUBLE * 2.0::DOUBLE, 2000) AS b FROM f JOIN r ON r.tenant = f.tenant AND r.n = f.n + 1))""",
        """SELECT tenant, at_us, msgs, bytes, admitted, wait_ms FROM f WHERE n > 0"""),
    "q63_regression_verdict": q("log runs", """g AS (SELECT workload, candidate, cents + CASE WHEN candidate AND workload IN ('view', 'signup') THEN 1000 ELSE 0 END AS cents FROM runs WHERE NOT failed), s AS (SELECT workload, count(*) FILTER (NOT candidate) AS n0, count(*) FILTER (candidate) AS n1, median(cents) FILTER (NOT candidate) AS median0, median(cents) FILTER (candidate) AS median1,
  avg(cents) FILTER (NOT candidate) AS m0, avg(cents) FILTER (candidate) AS m1, var_samp(cents) FILTER (NOT candidate) / count(*) FILTER (NOT candidate) AS s0, var_samp(cents) FILTER (candidate) / count(*) FILTER (candidate) AS s1 FROM g GROUP BY workload),
t AS (SELECT *, abs(m0 - m1) / sqrt(s0 + s1) AS t, (s0 + s1) ^ 2 / (s0 ^ 2 / (n0 - 1) + s1 ^ 2 / (n1 - 1)) AS df, (median1 - median0) / median0 * 100 AS pct_change FROM s),
p AS (SELECT *, 1 - 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * t / 6000 * list_sum(list_transform(range(0, 2001), lambda i: CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(1 + (i * t / 2000) ^ 2 / df, -(df + 1) / 2))) AS p FROM t)
SELECT workload, n0, n1, median0, median1, pct_change, CASE WHEN pct_change > 0 AND p < 0.05 AND pct_change >= 3 THEN 'regression' WHEN pct_change >= 10 THEN 'inconclusive' ELSE 'ok' END AS status FROM p"""),
}
