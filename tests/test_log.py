"""Small fixtures with results that are known by hand."""

import pytest

from tidelog.functions import hashing, patterns
from tidelog.operators import history, metadata, predicates, projections, queues, reads
from tidelog.plans import catalog
from tidelog.streaming import queries as live

D = "/root/testdata/sf0.001"


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert len(catalog.QUERIES) >= 80


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def small_log(spark, items):
    return spark.createDataFrame([("s", 0, o, t, p) for o, t, p in items], "stream string, shard int, offset long, ts_us long, payload string")


def test_offset_for_time(spark):
    log = small_log(spark, [(0, 100, "a"), (1, 200, "b"), (2, 200, "c"), (3, 300, "d")])
    found = dict(rows(reads.offset_for_time(log, [0, 100, 101, 250, 301]), "time_us", "offset"))
    assert found == {0: 0, 100: 0, 101: 1, 250: 3, 301: None}
    from pyspark.sql import functions as F

    assert rows(reads.offset_for_time(log, [250], F.lit(3)), "time_us", "offset") == [(250, None)]


def test_range_page_returns_one_record_at_least(spark):
    log = small_log(spark, [(0, 1, "x" * 50), (1, 2, "y"), (2, 3, "z")])
    assert rows(reads.range_page(log, 0, 9, 10, 5), "offset", "next_offset") == [(0, 1)]
    assert rows(reads.range_page(log, 1, 9, 10, 5), "offset", "next_offset") == [(1, 3), (2, 3)]
    with pytest.raises(reads.CursorInFuture):
        reads.check_range(log, 9)
    with pytest.raises(reads.CursorTooOld):
        reads.check_range(log.where("offset > 0"), 0)


def test_routing_of_known_keys(spark):
    from pyspark.sql import functions as F

    keys = ["user-17", "user-42", "order-9001", "user-7", "user-8"]
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, key string")
    got = df.select("i", hashing.shard_modulo(F.col("key"), 4).alias("m"), hashing.shard_jump(F.col("key"), 4).alias("j"))
    assert rows(got, "i", "m", "j") == [(0, 3, 0), (1, 3, 3), (2, 3, 1), (3, 2, 3), (4, 0, 1)]


def test_record_digest_of_every_record(spark):
    payloads = {r["event_id"]: r["props"].encode() for r in spark.read.parquet(f"{D}/events.parquet").collect()}
    want = {i: hashing.crc64(len(p).to_bytes(8, "big") + p) for i, p in payloads.items()}
    got = {r["event_id"]: r["digest"] % (1 << 64) for r in catalog.QUERIES["q30c_record_digest"](spark, D).collect()}
    assert got == want
    odd = [b"", b"123456789", b"\x00" * 300, b"a"]
    assert hashing.crc64_all(odd).tolist() == [hashing.crc64(p) for p in odd] and len(hashing.crc64_all([])) == 0


def test_crc64_check_value():
    assert hashing.crc64(b"123456789") == 0x995DC9BBDF1939FA


def test_topic_filters():
    import re

    hits = lambda f, t: bool(re.search(patterns.topic_regex(f), t))
    assert hits("a/#", "a") and hits("a/#", "a/b/c") and not hits("a/#", "ab")
    assert hits("+/b", "a/b") and not hits("+/b", "a/c/b") and not hits("#", "$sys/x") and hits("$sys/#", "$sys/x")


def test_quorum(spark):
    def q(leader, followers):
        data = [("s", 0, leader, f"f{i}", t, h) for i, (t, h) in enumerate(followers, 1)]
        df = spark.createDataFrame(data, "stream string, shard int, tail long, member string, reported long, halted boolean")
        return queues.quorum_offset(df, [f"f{i}" for i in range(1, len(followers) + 1)], "q").first()["q"]

    assert q(10, [(8, False), (3, False)]) == 8
    assert q(10, [(4, False)]) == 4
    assert q(10, [(50, False), (9, False)]) == 10
    assert q(10, [(8, True), (3, False)]) == 3


def test_producer_verdicts(spark):
    seqs = [0, 1, 1, 5, 2, *range(3, 80), 4]
    data = [(0, 1, s, i, str(s)) for i, s in enumerate(seqs)] + [(0, 2, 7, 0, "x"), (0, 3, 0, 0, "a"), (0, 3, 0, 1, "b"), (0, 3, 0, 2, "a")]
    df = spark.createDataFrame(data, "shard int, producer_id long, sequence long, arrival long, payload string")
    got = {(p, a): v for p, a, v in rows(queues.idempotent_fold(df), "producer_id", "arrival", "verdict")}
    assert [got[1, i] for i in range(5)] == ["append", "append", "duplicate", "gap", "append"]
    assert got[1, len(seqs) - 1] == "expired" and got[2, 0] == "unknown"
    assert [got[3, i] for i in range(3)] == ["append", "reused", "duplicate"]


def test_producer_sequences_wrap(spark):
    df = spark.createDataFrame([(0, 1, s, i, str(i)) for i, s in enumerate([0, 1, 2, 3, 0, 1])], "shard int, producer_id long, sequence long, arrival long, payload string")
    assert [v for _, v in rows(queues.idempotent_fold(df, 4), "arrival", "verdict")] == ["append"] * 6


def test_group_fold_rules(spark):
    ops = [
        (1, "g", "advance", 5, None, 0), (2, "g", "dead_letter", None, 3, 0), (3, "g", "claim", None, 7, 0), (4, "g", "redrive", None, 3, 0),
        (5, "h", "advance", 2, None, 0), (6, "h", "delete", None, None, 0), (7, "h", "advance", 9, None, 5), (8, "g", "dead_letter", None, 6, 0),
    ]
    df = spark.createDataFrame([(0, i, g, o, to, t, c, 1) for i, g, o, to, t, c in ops], "shard int, idx long, grp string, op string, to long, target long, cre long, attempts int")
    got = {r["grp"]: r for r in queues.group_fold(df).collect()}
    assert set(got) == {"g"}
    assert (got["g"]["cursor"], got["g"]["dead"], got["g"]["redriven"], got["g"]["claims"]) == (5, [6], [3], [7])


def test_folds_are_the_same_on_any_split(spark):
    whole = rows(catalog.QUERIES["q22_cache_cas"](spark, D), "shard", "key", "offset", "applied")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert rows(catalog.QUERIES["q22_cache_cas"](spark, D), "shard", "key", "offset", "applied") == whole
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_cache_expiry_is_strict(spark):
    ops = [(0, 0, "a", "put", 1, 100), (0, 1, "b", "put", 2, 0), (0, 2, "c", "put", 3, 0), (0, 3, "c", "delete", None, 0)]
    df = spark.createDataFrame(ops, "shard int, offset long, key string, op string, value long, expires_at_millis long")
    assert rows(projections.cache_latest(df, 99), "key") == [("a",), ("b",)]
    assert rows(projections.cache_latest(df, 100), "key") == [("b",)]


def test_counter_saturates(spark):
    big = (1 << 63) - 1
    df = spark.createDataFrame([("k", 0, "delta", 5), ("k", 1, "checkpoint", big), ("k", 2, "delta", 7), ("n", 0, "delta", -3)], "key string, offset long, op string, amount long")
    assert rows(projections.counter_sum(df), "key", "value") == [("k", big), ("n", -3)]
    steps = [("k", i, "delta", a) for i, a in enumerate([big, 7, -7, 3])] + [("n", 0, "delta", -3), ("n", 1, "checkpoint", 4), ("n", 2, "delta", 1)]
    df = spark.createDataFrame(steps, "key string, offset long, op string, amount long")
    assert rows(projections.counter_running(df), "key", "offset", "running") == [("k", 0, big), ("k", 1, big), ("k", 2, big - 7), ("k", 3, big - 4), ("n", 0, -3), ("n", 2, 5)]
    assert rows(projections.counter_sum(df), "key", "value") == [("k", big - 4), ("n", 5)]


def test_running_sums_are_the_same_in_blocks(spark):
    from tidelog.sources import views

    ops = views.counter_ops(spark, "/root/testdata/sf0.01")
    whole = rows(projections.counter_running(ops), "key", "offset", "running")
    assert rows(projections.counter_running(ops, 64), "key", "offset", "running") == whole


def test_linearizable_verdicts(spark):
    def verdict(ops, **budget):
        df = spark.createDataFrame([("k", *o, *[None] * (7 - len(o))) for o in ops], "key string, invoke long, complete long, action string, value long, outcome string, expect long, applied boolean")
        return history.linearizable(df, **budget).first()["verdict"]

    assert verdict([(0, 1, "put", 1, "ok"), (2, 3, "get", 1, "ok")]) == "yes"
    assert verdict([(0, 1, "put", 1, "ok"), (2, 3, "put", 2, "ok"), (4, 5, "get", 1, "ok")]) == "no"
    assert verdict([(0, 9, "put", 1, "ok"), (1, 8, "put", 2, "ok"), (10, 11, "get", 1, "ok")]) == "yes"
    assert verdict([(0, 1, "put", 1, "info"), (2, 3, "get", None, "ok"), (4, 5, "get", 1, "ok")]) == "yes"
    assert verdict([(0, 1, "put", 1, "info"), (2, 3, "get", 1, "ok"), (4, 5, "get", None, "ok")]) == "no"
    assert verdict([(0, 1, "get", 1, "ok")]) == "no"
    # conditional puts, and deletes that report what they removed
    assert verdict([(0, 1, "put_if", 1, "ok", None, True), (2, 3, "put_if", 2, "ok", 1, True), (4, 5, "get", 2, "ok")]) == "yes"
    assert verdict([(0, 1, "put_if", 1, "ok", None, True), (2, 3, "put_if", 2, "ok", None, True)]) == "no"
    assert verdict([(0, 1, "put", 1, "ok"), (2, 3, "put_if", 2, "ok", 1, False)]) == "no"
    assert verdict([(0, 1, "put", 7, "info"), (2, 3, "put_if", 2, "ok", None, False), (4, 5, "get", 7, "ok")]) == "yes"
    assert verdict([(0, 1, "put", 1, "ok"), (2, 3, "delete", None, "ok", 1), (4, 5, "get", None, "ok")]) == "yes"
    assert verdict([(0, 1, "put", 1, "ok"), (2, 3, "delete", None, "ok", 2)]) == "no"
    # many unknown puts that nobody saw cost nothing; a stretch over the budget doesn't hide a fault after it
    assert verdict([(0, 1, "put", n, "info") for n in range(40)] + [(2, 3, "put", 99, "ok"), (4, 5, "get", 99, "ok")]) == "yes"
    crowd = [(0, 100, "put", n, "ok") for n in range(12)]
    assert verdict([*crowd, (200, 201, "get", 5, "ok")], most_states=50) == "unknown"
    assert verdict([*crowd, (200, 201, "get", 5, "ok"), (202, 203, "get", 6, "ok")], most_states=50) == "no"
    assert verdict([*crowd, (200, 201, "get", 5, "ok")]) == "yes"


def cycles_of(spark, appends, reads_, seen, final, exact=True):
    """appends: (op, invoke, complete, value, outcome); reads_: (op, invoke, complete); seen: (op, offset, value); final: (offset, value)."""
    a = spark.createDataFrame([("s", 0, *x) for x in appends], "stream string, shard int, op long, invoke long, complete long, value long, outcome string")
    r = spark.createDataFrame([("s", 0, *x) for x in reads_], "stream string, shard int, op long, invoke long, complete long")
    f = spark.createDataFrame([("s", 0, *x) for x in final], "stream string, shard int, offset long, value long")
    return rows(history.list_cycles(a, r, spark.createDataFrame(seen, "op long, offset long, value long"), f, exact), "rule", "ops", "explained")


def test_cycles_are_named(spark):
    contradictory = [(0, 0, 10, 0, "ok"), (1, 0, 10, 1, "ok")]
    assert cycles_of(spark, contradictory, [], [], [(0, 0), (1, 1), (2, 0)]) == [("G0", 2, True)]
    future = [(0, 0, 100, 1, "info"), (2, 10, 20, 0, "ok")]
    assert cycles_of(spark, future, [(1, 0, 5)], [(1, 1, 1)], [(0, 0), (1, 1)]) == [("G1c-realtime", 3, False)]
    stale = [(0, 0, 10, 0, "ok"), (1, 20, 30, 1, "ok")]
    assert cycles_of(spark, stale, [(2, 40, 50)], [(2, 0, 0)], [(0, 0), (1, 1)]) == [("G-single-realtime", 2, False)]
    assert cycles_of(spark, stale, [(2, 40, 50)], [(2, 0, 0)], [(0, 0), (1, 1)], exact=False) == []
    assert cycles_of(spark, stale[:1], [(1, 20, 30)], [], [(0, 0)]) == [("G-single-realtime", 2, False)]
    assert cycles_of(spark, [(1, 10, 20, 0, "ok")], [(0, 0, 5)], [], [(0, 0)]) == []
    late = [(0, 20, 30, 0, "ok"), (1, 0, 10, 1, "ok")]
    assert cycles_of(spark, late, [], [], [(0, 0), (1, 1)]) == [("G0-realtime", 2, True)]
    wrong = [(0, 0, 10, 0, "ok"), (1, 0, 10, 1, "ok")]  # a read that saw the second value at the first place
    assert ("G-single", 2, False) in cycles_of(spark, wrong, [(2, 0, 10)], [(2, 0, 1)], [(0, 0), (1, 1)])


def test_cycles_of_any_length_and_none_in_correct_histories(spark):
    n = 60
    backward = [(i, 0, 1000, i, "info") for i in range(n - 1)] + [(n - 1, 10, 20, n - 1, "ok")]
    backward[0] = (0, 30, 40, 0, "ok")  # began after the last one had ended, and stands first
    found = cycles_of(spark, backward, [], [], [(i, i) for i in range(n)])
    assert found == [("G0-realtime", n, True)]
    import random

    for seed in range(3):
        rng = random.Random(seed)
        appends, reads_, seen, final, now, op = [], [], [], [], 0, 0
        for _ in range(50):  # every operation takes effect at one moment within it
            moment, op = now + rng.randrange(1, 30), op + 1
            begin, end = moment - rng.randrange(40), moment + rng.randrange(40)
            if rng.random() < 0.6:
                appends.append((op, begin, end, op, rng.choice(["ok", "ok", "info"])))
                final.append((len(final), op))
            else:
                reads_.append((op, begin, end))
                seen += [(op, o, v) for o, v in final]
            now = moment
        assert cycles_of(spark, appends, reads_, seen or [(0, 0, 0)], final) == []


def test_rule_of_missing_deliveries(spark):
    final = spark.createDataFrame([("s", 0, o, 10 + o) for o in range(6)], "stream string, shard int, offset long, value long")
    appends = spark.createDataFrame([(10 + o, "ok") for o in range(6)], "value long, outcome string")
    subs = spark.createDataFrame([("full", "s", 0, 0), ("gap", "s", 0, 0), ("hidden", "s", 0, 2), ("short", "s", 0, 0), ("none", "s", 0, 5), ("after", "s", 0, 6)], "sub string, stream string, shard int, start long")
    got = [("full", o, 0) for o in range(6)] + [("gap", 0, 0), ("gap", 5, 0)] + [("hidden", 4, 3), ("hidden", 5, 0)] + [("short", 0, 0), ("short", 3, 0)]
    deliveries = spark.createDataFrame([(s, "s", 0, n, o, 10 + o, skipped) for n, (s, o, skipped) in enumerate(got)], "sub string, stream string, shard int, arrival long, offset long, value long, skipped_before long")
    leaders = spark.createDataFrame([("s", 0, 1, "a"), ("s", 0, 1, "b"), ("s", 0, 2, "a")], "stream string, shard int, generation long, node string")
    found = dict(rows(history.set_rules(appends, final, final, deliveries, leaders, subs), "rule", "violations"))
    # hidden was told that 2 and 3 (1 is before its start) hold nothing; short and none stop before the end; a gap that shows is allowed
    assert found.pop("record hidden or never delivered") == 4 and found.pop("two writers in a generation") == 1
    assert set(found.values()) == {0} and len(found) == 7


def test_tenant_rates(spark):
    def run(sends, msgs=0.0, size=0.0, burst=1.0):
        df = spark.createDataFrame(sends, "tenant string, at_us long, msgs long, bytes long")
        return [(r["admitted"], r["wait_ms"]) for r in queues.tenant_rate(df.coalesce(1), msgs, size, burst).collect()]

    burst = run([("t", 0, 1, 10)] * 102 + [("t", 10_000, 1, 10)], msgs=100.0)
    assert burst == [(True, 0)] * 101 + [(False, 10), (True, 0)]
    assert run([("t", 0, 1, 3000), ("t", 1, 1, 1)], size=1000.0) == [(True, 0), (False, 2000)]
    assert run([("t", 0, 1, 1_000_000), ("t", 1, 1, 1)], size=1000.0) == [(True, 0), (False, 5000)]
    assert run([("t", 0, 1, 100), ("t", 1, 1, 1)], msgs=0.5, size=1000.0, burst=0.1) == [(True, 0), (True, 0)]
    offered = run([("t", ms * 1000, 1, 100) for ms in range(10_000)], size=1000.0)
    assert 10_900 <= 100 * sum(a for a, _ in offered) <= 11_200


def claims_of(spark, events, visibility=30, bound=100):
    kinds = "stream string, shard int, at_ms long, seq long, event string, offset long, size int, consumer string, most int, delay_ms long"
    df = spark.createDataFrame([("s", 0, at, n, event, o, size, who, most, delay) for n, (at, event, o, size, who, most, delay) in enumerate(events)], kinds)
    return [(r["at_ms"], r["event"], r["offset"], r["result"], r["attempts"]) for r in sorted(queues.queue_claims(df, visibility, bound).collect(), key=lambda r: (r["seq"], r["offset"]))]


def test_queue_deliveries(spark):
    put = lambda at, o, size=1: (at, "publish", o, size, "p", 0, 0)
    poll = lambda at, most=10, who="a": (at, "poll", 0, 0, who, most, 0)
    do = lambda at, event, o, who="a", delay=0: (at, event, o, 0, who, 0, delay)
    first = (0, "poll", 0, "delivered", 1)
    # extended, so it doesn't lapse when it would have; then it does
    assert claims_of(spark, [put(0, 0), poll(0, 1), do(20, "extend", 0), poll(31), poll(51)]) == [first, (20, "extend", 0, "extended", 1), (51, "poll", 0, "redelivered", 2)]
    # a lost claim stays lost; the one who holds the new claim may extend it
    assert claims_of(spark, [put(0, 0), poll(0, 1), poll(31, 1, "b"), do(32, "extend", 0), do(32, "extend", 0, "b")])[2:] == [(32, "extend", 0, "ignored", 2), (32, "extend", 0, "extended", 2)]
    assert claims_of(spark, [put(0, 0), poll(0), do(31, "extend", 0), poll(31)])[1:] == [(31, "extend", 0, "ignored", 1), (31, "poll", 0, "redelivered", 2)]
    assert claims_of(spark, [put(0, 0), poll(0), do(1, "ack", 0), do(2, "extend", 0), poll(50)])[1:] == [(1, "ack", 0, "acked", None), (2, "extend", 0, "ignored", None)]
    # a delayed nack is owed once the delay has passed, and isn't extended
    assert claims_of(spark, [put(0, 0), poll(0), do(0, "nack", 0, delay=60), do(1, "extend", 0), poll(31), poll(61)])[1:] == [(0, "nack", 0, "owed", 1), (1, "extend", 0, "ignored", 1), (61, "poll", 0, "redelivered", 2)]
    # the bound of attempts
    assert claims_of(spark, [put(0, 0), poll(0), do(0, "nack", 0, delay=5), poll(6), do(6, "nack", 0, delay=5), poll(12), poll(90)], bound=2)[-1] == (12, "poll", 0, "dead_letter", 2)
    # what is owed comes before what is new; nothing is acknowledged that wasn't handed out
    assert claims_of(spark, [put(0, 0), poll(0), put(1, 1), put(1, 2), do(2, "ack", 2), poll(40, 2)])[1:] == [(2, "ack", 2, "ignored", None), (40, "poll", 0, "redelivered", 2), (40, "poll", 1, "delivered", 1)]


def test_bounds_of_a_poll(monkeypatch):
    queue = queues.Deliveries(30, 9)
    for o in range(5000):
        queue.publish(o, 1)
    assert len(list(queue.poll(0, "a", 9999))) == queues.POLL_RECORDS
    monkeypatch.setattr(queues, "IN_FLIGHT", 1200)
    assert len(list(queue.poll(0, "a", 1000))) == 200 and not list(queue.poll(1, "a", 10))
    large = queues.Deliveries(30, 9)
    for o in range(3):
        large.publish(o, 3 << 20)
    assert [o for o, *_ in large.poll(0, "a", 10)] == [0] and [o for o, *_ in large.poll(0, "a", 10)] == [1]


def test_mounts_are_a_tenant_s_own(spark):
    topics = spark.createDataFrame([(1, "a", "x/y/z"), (2, "b", "x/y/z"), (3, "c", "x/y/z")], "id int, tenant string, topic string")
    mounts = spark.createDataFrame([("a", "x/", "s1"), ("a", "x/y", "s2"), ("b", "x/", "s3"), ("b", "q", "s4")], "tenant string, prefix string, stream string")
    assert rows(predicates.longest_mount(topics, mounts), "id", "prefix", "stream") == [(1, "x/y", "s2"), (2, "x/", "s3")]


def test_regression_statuses(spark):
    from tidelog.operators import bench

    def status(base, cand, worse=True):
        df = spark.createDataFrame([("k", False, float(x)) for x in base] + [("k", True, float(x)) for x in cand], "k string, candidate boolean, m double")
        return bench.regression_verdict(df, "k", "candidate", "m", worse).first()["status"]

    assert status([10, 11, 10, 11, 10], [20, 21, 20, 21, 20]) == "regression"
    assert status([10, 11, 10, 11, 10], [20, 21, 20, 21, 20], worse=False) == "ok"
    assert status([10, 20, 30], [12, 24, 36]) == "inconclusive"
    assert status([10, 11, 10, 11], [10, 11, 11, 10]) == "ok" and status([10], [30]) == "inconclusive" and status([10, 11], []) == "insufficient_data"
    assert status([10, 10], [20, 20]) == "regression"
    p = bench._beta(10 / (10 + 2.228**2), 5, 0.5)
    assert abs(p - 0.05) < 0.002


def test_codecs():
    from tidelog.functions import codecs

    assert codecs.crc32c(b"123456789") == 0xE3069283
    block = codecs.encode_headers(b"k", [("a", b"1"), ("a", b"")])
    assert block == b"\x01\x00\x00\x00\x01k\x00\x00\x00\x02\x00\x01a\x00\x00\x00\x011\x00\x01a\x00\x00\x00\x00"
    assert codecs.decode_headers(block) == (b"k", [("a", b"1"), ("a", b"")]) and codecs.decode_headers(codecs.encode_headers(None, [])) == (None, [])
    commit = codecs.encode_commit(b"e", [("put", "k", b"v"), ("delete", "d", None)])
    assert commit == b"\x01\x00\x00\x00\x01e\x00\x00\x00\x02\x00\x00\x00\x00\x01k\x00\x00\x00\x01v\x01\x00\x00\x00\x01d"
    assert codecs.decode_commit(commit) == (b"e", [("put", "k", b"v"), ("delete", "d", None)])
    records = [(5, 1000, b"k", b"v" * 300, [("h", b"x")]), (7, 990, None, None, [])]
    data = codecs.encode_batch(5, records, 9, (3, 0, 4)) + codecs.encode_batch(10, [], 12)
    one, two = codecs.decode_batches(data)
    assert (one["base"], one["last"], one["producer"], one["records"]) == (5, 9, (3, 0, 4), records) and (two["base"], two["last"], two["records"]) == (10, 12, [])
    for bad in (block[:-1], block + b"x", b"\x02" + block[1:], b"\x00\x00\x00\x00\x00"):
        with pytest.raises(ValueError):
            codecs.decode_headers(bad)
    for bad in (commit[:-1], commit + b"x", b"\x02" + commit[1:]):
        with pytest.raises(ValueError):
            codecs.decode_commit(bad)
    for at in range(17, len(data) - 60, 7):
        with pytest.raises(ValueError):
            list(codecs.decode_batches(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]))


def test_cursors_and_pages(spark):
    from tidelog.functions import codecs

    df = spark.range(25).select("id")
    seen, after = [], None
    while True:
        page = metadata.keyset_page(df, ["id"], after, 10)
        seen += [r["id"] for r in page.collect()]
        after = metadata.next_cursor(page, ["id"])
        if after is None:
            break
    assert sorted(seen) == list(range(25)) and codecs.decode_cursor(codecs.encode_cursor(["a", 1]), 2) == ["a", 1]
    for bad in (0, 10_001):
        with pytest.raises(ValueError):
            metadata.keyset_page(df, ["id"], None, bad)
    with pytest.raises(ValueError):
        codecs.decode_cursor("!!", 1)


def test_batch_digests():
    one = [hashing.crc64(len(p).to_bytes(8, "big") + p) for p in (b"a", b"bc")]
    want = hashing.crc64(hashing.crc64((0).to_bytes(8, "big") + one[0].to_bytes(8, "big")).to_bytes(8, "big") + one[1].to_bytes(8, "big"))
    assert hashing.batch_digests([[b"a", b"bc"], []]).tolist() == [want, 0]


def test_hashes_of_long_and_short_keys_take_little_memory():
    keys = [b"x" * 200_000] + [b"k%d" % i for i in range(10_000)]
    got = hashing.fnv1a(keys)
    h = hashing.FNV_BASIS
    for b in b"k77":
        h = (h ^ b) * hashing.FNV_PRIME % (1 << 64)
    assert int(got[78]) == h


def test_scoped_grants(spark):
    requests = spark.createDataFrame([("p", "t/n/c/user/1"), ("p", "t/n/c/user/2"), ("p", "t/n/d/user/1"), ("q", "t/n/c/user/1"), ("r", "t/n/c/x")], "principal string, resource string")
    grants = spark.createDataFrame([("p", "t/*/c/user/1", None), ("q", "t/n/*/user/*", None), ("r", "*/*/*/*", None), ("r", None, "g")], "principal string, pattern string, grp string")
    assert rows(predicates.scoped_granted(requests, grants), "principal", "resource") == [("p", "t/n/c/user/1"), ("q", "t/n/c/user/1")]


def test_filters_reach_the_scan(spark):
    from tidelog.sources import views

    plan = views.log(spark, D).where("stream = 'view' AND shard = 1")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,view)" in plan


def test_topic_publishes(spark):
    df = spark.createDataFrame([("a/b", "x", 1, None, "text"), ("a/b", "y", None, None, None)], "topic string, payload string, qos int, retain boolean, content_type string")
    got = predicates.publish_headers(df, 4).collect()
    assert [[(h["name"], h["value"]) for h in r["headers"]] for r in got] == [[("qos", "1"), ("content_type", "text")], []]
    assert len({r["shard"] for r in got}) == 1 and {r["key"] for r in got} == {"a/b"}


def test_stream_of_claims_is_the_fold(spark, tmp_path):
    names = ("at_ms", "seq", "offset", "event", "result", "attempts")
    fold = rows(queues.queue_claims(catalog._claims(spark, D), 3600000), "stream", "shard", *names[:-1])
    assert rows(catalog.QUERIES["st5_queue_claims"](spark, D), "stream", "shard", *names[:-1]) == fold
    events = spark.createDataFrame([("s", 0, 1000, 0, "publish", 0, 1, "p", 0, 0), ("s", 0, 1000, 1, "poll", 0, 0, "a", 1, 0)], "stream string, shard int, at_ms long, seq long, event string, offset long, size int, consumer string, most int, delay_ms long")
    later = events.limit(1).selectExpr("stream", "CAST(9 AS INT) AS shard", "100000L AS at_ms", "2L AS seq", "event", "offset", "size", "consumer", "most", "delay_ms")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    live_rows = live.claims(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), 30)

    def run():
        live_rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "marks")).outputMode("append").trigger(availableNow=True).start().awaitTermination()

    run()
    for n in (2, 3):  # time goes on elsewhere: the claim's timer fires
        later.withColumn("seq", later["seq"] * n).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run()
    got = spark.read.parquet(str(tmp_path / "out")).where("shard = 0").collect()
    assert sorted((r["event"], r["result"]) for r in got) == [("poll", "delivered"), ("timer", "lapsed")]


def test_lifecycle_and_scope(spark):
    df = spark.createDataFrame([("n", 1, "live"), ("n", 2, "left"), ("n", 3, "live")], "node string, seq long, state string")
    assert rows(metadata.lifecycle_faults(df), "seq", "before", "state") == [(2, "live", "left"), (3, "left", "live")]
    with pytest.raises(metadata.UnknownScope):
        metadata.require_scope(spark.createDataFrame([("t", "s")], "tenant string, stream string"), "t", "x")


def test_mount_overlap(spark):
    df = spark.createDataFrame([("t", "a/"), ("t", "a/b"), ("t", "c"), ("u", "a")], "tenant string, prefix string")
    assert rows(predicates.mount_overlap(df), "tenant", "shorter", "longer") == [("t", "a/", "a/b")]


def test_stream_resumes_from_its_checkpoint(spark, tmp_path):
    source, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    run = lambda: live.resumed(spark.readStream.schema("id long").parquet(source), out, marks)
    spark.range(3).coalesce(1).write.parquet(source)
    assert rows(run(), "id") == [(i,) for i in range(3)]
    spark.range(3, 5).coalesce(1).write.mode("append").parquet(source)
    assert rows(run(), "id") == [(i,) for i in range(5)] and rows(run(), "id") == [(i,) for i in range(5)]


def test_reports_are_written(spark, tmp_path):
    from tidelog.operators import bench

    df = spark.createDataFrame([("a", 1)], "name string, n long")
    for form in ("csv", "parquet"):
        bench.write_report(df, str(tmp_path / form), form)
        reader = spark.read.option("header", True).schema(df.schema)
        assert rows(getattr(reader, form)(str(tmp_path / form)), "name", "n") == [("a", 1)]


def test_phantom_gets_are_reported_and_no_evidence(spark):
    puts = spark.createDataFrame([("k", 1, 0, 10, True), ("k", 2, 100, 110, False)], "key string, put long, invoke long, complete long, acked boolean")
    gets = [("k", 11, 20, 30, 1), ("k", 12, 20, 30, 7), ("k", 13, 40, 50, 2), ("k", 14, 60, 70, 1), ("k", 15, 60, 70, None), ("j", 16, 20, 30, 1)]
    got = history.stale_gets(puts, spark.createDataFrame(gets, "key string, get long, invoke long, complete long, seen long"))
    assert rows(got, "get", "seen", "newest") == sorted([(12, 7, None), (13, 2, None), (15, None, 1), (16, 1, None)])
