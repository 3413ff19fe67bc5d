"""Every query of the engine by name: (spark, folder of tables) -> DataFrame. The SQL beside it is in oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.functions import codecs
from tidelog.functions.hashing import record_digest, shard_jump, shard_modulo
from tidelog.functions.tables import shared_path, stored
from tidelog.operators import bench, history, metadata, predicates, projections, queues, reads
from tidelog.plans.oracles import ORACLES  # noqa: F401
from tidelog.sources import views as v
from tidelog.streaming import queries as live

NOW = v.NOW_MS
TIMES = [1704067200000000 + i * 3 * 86400000000 for i in range(12)]  # every third day from 2024-01-01
FILTERS = [("#", 0), ("+/en/#", 1), ("+/fr/+", 2), ("m.+/#", 1), ("+/de/#", 1), ("$sys/#", 2), ("www.example.com/+", 2), ("+/+/1", 2)]
RESERVED = "sys."


def _marks(spark, d):
    kind = F.when(F.col("shard") == 0, "unbounded").when(F.col("shard") == 3, "refused").when(F.col("stream") == "error", "settling").otherwise("committed")
    return v.tails(spark, d).select("stream", "shard", kind.alias("kind"), F.floor(F.col("tail") * 9 / 10).cast("long").alias("mark"))


def _pieces(spark, d):
    rows = v.log(spark, d).withColumn("position", (F.col("offset") % 3).cast("int")).withColumn("len", F.lit(3)).withColumn("batch", F.col("offset") - F.col("position"))
    return rows.where("event_id % 17 <> 0").select("stream", "shard", "offset", "batch", "position", "len")


def _mounts(spark, d):
    t = v.topics(spark, d)
    hosts = t.select("tenant", F.concat("host", F.lit("/")).alias("prefix"), F.concat(F.lit("host-"), "host").alias("stream"))
    return hosts.unionByName(t.where("section <> ''").select("tenant", F.concat("host", F.lit("/"), "section").alias("prefix"), F.concat(F.lit("lang-"), "section").alias("stream"))).distinct()


def _headers(spark, d):
    h = lambda n, c: F.struct(F.lit(n).alias("name"), c.cast("string").alias("value"))
    base = F.array(h("type", F.col("event_type")), h("user", F.col("user_id")), h("type", F.concat(F.lit("again-"), "event_type")))
    return v.table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 9 == 0, F.array_append(base, h("sys.trace", F.col("event_id")))).otherwise(base).alias("headers"))


def _attempts(spark, d):
    rows = v.log(spark, d)
    expected = F.when(F.col("event_id") % 5 != 0, F.col("offset") - F.floor(F.col("offset") / 7)).cast("long")
    return rows.select("stream", "shard", F.col("event_id").alias("arrival"), expected.alias("expected"), F.lit(1).alias("records"))


def _cas(spark, d):
    rows = v.cache_ops(spark, d)
    expected = F.when(F.col("offset") % 3 == 0, F.lit(None)).otherwise(F.col("offset") - F.col("offset") % 50).cast("long")
    return rows.select("shard", "key", "offset", "ts_ms", "op", "expires_at_millis", expected.alias("expected"))


def _group_ops(spark, d):
    kinds = ["advance"] * 8 + ["dead_letter"] * 3 + ["claim"] * 4 + ["redrive", "finish_redrive", "discard", "seek", "delete"]
    op = F.element_at(F.array(*(F.lit(k) for k in kinds)), (F.col("event_id") % 20 + 1).cast("int"))
    return v.log(spark, d).select("shard", F.col("event_id").alias("idx"), F.col("stream").alias("grp"), op.alias("op"), (F.col("offset") * 3 / 4).cast("long").alias("to"), F.col("offset").alias("target"), F.lit(0).cast("long").alias("cre"), (1 + F.col("event_id") % 6).cast("int").alias("attempts"))


def _group_writes(spark, d):
    return _group_ops(spark, d).where("op IN ('advance', 'seek') AND (op = 'advance' OR idx % 40 = 18)")


def _set_rules(spark, d):
    rows = stored(v.history(spark, d).withColumn("offset", F.col("offset") * 3))
    held = (F.col("value") % 97 != 0) & ((F.col("outcome") != "fail") | (F.col("value") % 40 == 0))
    place = lambda n, value: F.struct((F.col("offset") + n).alias("offset"), value.alias("value"))
    places = F.array(F.when(held, place(0, F.col("value"))), F.when(F.col("value") % 101 == 0, place(1, F.col("value"))), F.when(F.col("value") % 211 == 0, place(2, -F.col("value"))))
    final = rows.select("stream", "shard", F.explode(F.array_compact(places)).alias("p")).select("stream", "shard", "p.*")
    reads_ = rows.select("stream", "shard", "offset", (F.col("value") + (F.col("value") % 151 == 0).cast("int")).alias("value"))
    sub = F.concat_ws("/", "stream", "shard").alias("sub")
    got = rows.where("value % 61 <> 0").select(sub, "stream", "shard", F.col("value").alias("arrival"), (F.col("offset") - 15 * (F.col("value") % 131 == 0).cast("int")).alias("offset"), "value", (F.col("value") % 2).alias("skipped_before"))
    leaders = rows.select("stream", "shard", F.floor(F.col("offset") / 150).alias("generation"), F.when(F.col("value") % 499 == 0, "n9").otherwise(F.concat(F.lit("n"), "shard")).alias("node"))
    shards = rows.select("stream", "shard").distinct()
    waiting = shards.select(sub, "stream", "shard", F.lit(0).cast("long").alias("start"))
    idle = shards.where("shard = 0").select(F.concat(F.lit("idle/"), "stream").alias("sub"), "stream", "shard", F.lit(30).cast("long").alias("start"))
    return history.set_rules(rows.select("value", "outcome"), final, reads_, got, leaders, waiting.unionByName(idle))


def _realtime(spark, d):
    ops = v.history(spark, d).where("outcome = 'ok'").withColumn("offset", F.col("offset") + 30 * (F.col("value") % 37 == 0).cast("int"))
    return history.realtime_order(ops)


def _puts_gets(spark, d):
    rows = v.log(spark, d)
    puts = rows.where("event_id % 3 <> 0").select("key", F.col("event_id").alias("put"), F.col("ts_us").alias("invoke"), (F.col("ts_us") + F.col("cents") * 1000).alias("complete"), (F.col("event_id") % 10 != 1).alias("acked"))
    seen = F.when(F.col("event_id") % 4 == 0, F.lit(None)).otherwise(F.col("event_id") - 1 - F.col("event_id") % 7)
    gets = rows.where("event_id % 3 = 0").select("key", F.col("event_id").alias("get"), F.col("ts_us").alias("invoke"), (F.col("ts_us") + 1000).alias("complete"), seen.alias("seen"))
    return puts, gets


def _stale(spark, d):
    from pyspark.sql import Window

    puts, gets = _puts_gets(spark, d)
    # a get sees the put of its own key that is nearest below the number drawn for it
    line = puts.select("key", F.col("put").alias("at"), F.lit(0).alias("kind"), "put", *(F.lit(None).cast("long").alias(c) for c in ("get", "invoke", "complete")))
    line = line.unionByName(gets.select("key", F.coalesce("seen", F.lit(-1)).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("put"), "get", "invoke", "complete"))
    before = Window.partitionBy("key").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    gets = line.withColumn("seen", F.max("put").over(before)).where("kind = 1").select("key", "get", "invoke", "complete", "seen")
    return history.stale_gets(puts, gets)


def _cycles(spark, d):
    rows = stored(v.history(spark, d).withColumn("offset", F.col("offset") * 2))
    appends = rows.where("value % 13 <> 5 AND outcome <> 'fail'").withColumn("op", F.col("value"))
    final = appends.select("stream", "shard", "offset", "value").unionByName(appends.where("value % 101 = 0").select("stream", "shard", (F.col("offset") + 5).alias("offset"), "value"))
    top = F.col("offset") - 2 - 14 * (F.col("value") % 7 == 0).cast("int") + 6 * (F.col("value") % 17 == 0).cast("int")
    reads_ = rows.where("value % 13 = 5").select("stream", "shard", F.col("value").alias("op"), "invoke", (F.col("invoke") + 1000).alias("complete"), top.alias("top"))
    seen = reads_.select("stream", "shard", "op", F.explode(F.array(F.col("top") - 4, F.col("top") - 2, F.col("top"))).alias("offset")).join(final, ["stream", "shard", "offset"]).select("op", "offset", "value")
    return history.list_cycles(appends, reads_.drop("top"), seen, final)


def _registers(spark, d):
    rows = v.log(spark, d)
    action = F.when(F.col("event_id") % 3 == 0, "get").when(F.col("event_id") % 31 == 0, "delete").otherwise("put")
    value = F.when(F.col("event_id") % 3 == 0, F.lag("event_id").over(_by_key()))
    return rows.select("key", F.col("ts_us").alias("invoke"), (F.col("ts_us") + F.col("cents") * 10000).alias("complete"), action.alias("action"), F.when(action == "get", value).when(action == "put", F.col("event_id")).alias("value"), F.when(F.col("event_id") % 41 == 0, "info").otherwise("ok").alias("outcome"))


def _by_key():
    from pyspark.sql import Window

    return Window.partitionBy("key").orderBy("ts_us")


def _ledger(spark, d):
    e = v.table(spark, d, "events")
    writes = e.select(F.col("event_id").alias("key"), F.when(F.col("event_id") % 13 == 0, "refused").when(F.col("event_id") % 13 == 1, "in_doubt").otherwise("acked").alias("outcome"))
    seen = e.where("event_id % 29 <> 0 AND (event_id % 13 <> 0 OR event_id % 26 = 0)").select(F.explode(F.when(F.col("event_id") % 31 == 0, F.array("event_id", "event_id")).otherwise(F.array("event_id"))).alias("key"))
    return history.ledger_verdict(writes, seen.unionByName(e.where("event_id % 500 = 0").select((-1 - F.col("event_id")).alias("key"))))


def _divergence(spark, d):
    ops = v.cache_ops(spark, d)
    latest = lambda rows: projections.latest(rows).select("key", "value")
    return history.divergence(latest(ops), latest(ops.where("offset % 9 <> 0")))


def _stalls(spark, d):
    ops = v.log(spark, d).select("stream", "shard", F.col("ts_us").alias("begin"), (F.col("ts_us") + F.col("cents") * 100).alias("acked_at"))
    return history.stalls(ops, 500000)


def _runs(spark, d):
    rows = v.log(spark, d)
    return rows.select(F.col("stream").alias("workload"), (F.col("user_id") % 5).cast("int").alias("size"), "cents", (F.col("event_id") % 19 == 0).alias("failed"), F.floor(F.col("ts_us") / 86400000000).cast("long").alias("session"), "ts_us", (F.col("user_id") % 2 == 1).alias("candidate"))


def _rounds(spark, d):
    rows = _runs(spark, d).withColumn("round", F.col("session") % 12)
    side = lambda c: F.expr(f"percentile(CASE WHEN {c} THEN cents END, 0.5)")
    return rows.groupBy(F.col("workload").alias("cell"), "round").agg(side("NOT candidate").alias("baseline"), side("candidate").alias("candidate"))


def _slowed(spark, d):
    later = F.when(F.col("candidate") & F.col("workload").isin("view", "signup"), 1000).otherwise(0)
    return _runs(spark, d).where("NOT failed").withColumn("cents", F.col("cents") + later)


def _streams(spark, d):
    t = v.log(spark, d).groupBy("tenant", "stream").agg((F.max("shard") + 1).alias("shards"), F.count(F.lit(1)).alias("n"))
    return t.withColumn("durable", F.col("n") % 2 == 0).withColumn("consistency", F.when(F.col("n") % 3 == 0, "quorum").otherwise("leader")).withColumn("retention_bytes", F.when(F.col("n") % 5 != 0, F.col("n") - F.col("n") % 4 * 1000)).withColumn("retention_ms", F.lit(None).cast("long"))


def _readers(spark, d):
    return v.log(spark, d).where("event_id % 3 = 0").select(F.concat(F.lit("p"), (F.col("user_id") % 7).cast("string")).alias("principal"), "tenant", "stream").distinct()


def _states(spark, d):
    kinds = F.array(*(F.lit(s) for s in ("live", "draining", "down", "live", "left")))
    return v.table(spark, d, "events").select(F.concat(F.lit("node-"), (F.col("user_id") % 20).cast("string")).alias("node"), F.col("event_id").alias("seq"), F.element_at(kinds, (F.col("event_id") % 5 + 1).cast("int")).alias("state"))


def _incarnations(spark, d):
    o = v.table(spark, d, "orders")
    name = F.concat(F.lit("s-"), F.col("o_custkey").cast("string")).alias("name")
    return o.select(name, F.col("o_orderkey").alias("incarnation")), o.where("o_orderstatus = 'F'").select(name, F.col("o_orderkey").alias("deleted_through"))


def _resolution(spark, d):
    t = v.tails(spark, d).withColumn("n", F.length("stream") + F.col("shard"))
    wanted = t.select("stream", "shard", F.when(F.col("n") % 2 == 0, F.lit(3)).alias("wanted"))
    routes = t.where("n % 5 <> 0").select("stream", "shard", F.concat(F.lit("node-"), (F.col("n") % 4 * 30).cast("string")).alias("leader"), (F.col("n") % 3 + 2).cast("int").alias("generation"))
    states = v.nodes(spark, d).select("node", F.when(F.col("s_suppkey") % 2 == 0, "live").otherwise("down").alias("state"))
    return metadata.resolve(wanted, routes, states, "node-30")


def _grants(spark, d):
    c = v.table(spark, d, "customer")
    action = F.element_at(F.array(*(F.lit(a) for a in ("stream.subscribe", "stream.manage", "stream.publish"))), (F.col("c_custkey") % 3 + 1).cast("int"))
    pattern = F.when(F.col("c_custkey") % 11 == 0, "cluster:*").when(F.col("c_custkey") % 7 == 0, "*").otherwise(F.concat(F.lit("stream:t"), (F.col("c_custkey") % 3).cast("string"), F.lit("/*/"), F.substring("c_mktsegment", 1, 1), F.lit("*")))
    return c.select(F.concat(F.lit("p"), (F.col("c_custkey") % 20).cast("string")).alias("principal"), action.alias("action"), pattern.alias("pattern"))


def _requests(spark, d):
    c = v.table(spark, d, "customer")
    action = F.element_at(F.array(*(F.lit(a) for a in ("stream.subscribe", "group.consume", "stream.trim", "stream.publish"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    resource = F.when(F.col("c_custkey") % 13 == 0, "cluster:nodes").otherwise(F.concat(F.lit("stream:t"), (F.col("c_custkey") % 3).cast("string"), F.lit("/n.s/"), "c_mktsegment"))
    return c.select(F.concat(F.lit("p"), (F.col("c_nationkey") % 20).cast("string")).alias("principal"), action.alias("action"), resource.alias("resource")).distinct()


def _scoped(spark, d):
    c = v.table(spark, d, "customer")
    principal = F.concat(F.lit("p"), (F.col("c_custkey") % 20).cast("string")).alias("principal")
    tail = F.when(F.col("c_custkey") % 3 == 0, "*").when(F.col("c_custkey") % 3 == 1, "user/*").otherwise(F.concat(F.lit("user/"), F.col("c_custkey").cast("string")))
    pattern = F.concat(F.lit("t"), (F.col("c_custkey") % 3).cast("string"), F.lit("/d*/"), F.substring("c_mktsegment", 1, 2), F.lit("*/"), tail)
    grants = c.select(principal, pattern.alias("pattern"), F.when(F.col("c_custkey") == 7, "g").alias("grp"))
    resource = F.concat(F.lit("t"), (F.col("c_nationkey") % 3).cast("string"), F.lit("/default/"), "c_mktsegment", F.lit("/user/"), F.col("c_custkey").cast("string"))
    return predicates.scoped_granted(c.select(principal, resource.alias("resource")), grants)


def _regions(spark, d):
    pairs = v.table(spark, d, "customer").select((F.col("c_nationkey") % 5).alias("src"), (F.col("c_custkey") % 5).cast("int").alias("dst"), "c_custkey")
    bridges = v.table(spark, d, "nation").where("n_nationkey % 5 <> n_regionkey").select((F.col("n_nationkey") % 5).alias("src"), F.col("n_regionkey").alias("dst")).distinct()
    return predicates.bridged(pairs, bridges)


def _changes(spark, d):
    return v.table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("c-"), F.col("o_custkey").cast("string")).alias("key"), F.when(F.col("o_orderstatus") == "F", "delete").otherwise("put").alias("op"))


def _assign(spark, d):
    rows = v.log(spark, d)
    before = rows.where("event_id % 10 <> 3").groupBy("stream", "shard").agg(F.count(F.lit(1)).alias("tail"))
    return reads.assign_offsets(rows.where("event_id % 10 = 3").select("stream", "shard", "event_id", "payload"), before, ["event_id"])


def _leases(spark, d):
    rows = v.cache_ops(spark, d)
    return rows.select(F.concat(F.lit("lease-"), F.substring("key", 6, 1)).alias("lease"), F.col("key").alias("holder"), (F.col("offset") * 4 + F.col("shard")).alias("offset"), "ts_ms", F.lit(6 * 3600000).cast("long").alias("ttl_ms"))


def _claims(spark, d):
    rows = v.log(spark, d)
    event = F.element_at(F.array(*(F.lit(e) for e in ("poll", "poll", "ack", "poll", "nack", "extend"))), (F.col("event_id") % 6 + 1).cast("int"))
    none = F.lit(0).cast("long")
    published = F.struct((F.col("event_id") * 2).alias("seq"), F.lit("publish").alias("event"), F.col("offset").alias("offset"), F.octet_length("payload").alias("size"), none.alias("most"))
    asked = F.struct((F.col("event_id") * 2 + 1).alias("seq"), event.alias("event"), F.greatest(F.col("offset") - F.col("event_id") % 5 * 2 - 1, none).alias("offset"), F.lit(0).alias("size"), (1 + F.col("event_id") % 4).alias("most"))
    consumer = F.concat(F.lit("c"), (F.col("event_id") % 2).cast("string")).alias("consumer")
    return rows.select("stream", "shard", F.floor(F.col("ts_us") / 1000).cast("long").alias("at_ms"), F.explode(F.array(published, asked)).alias("e"), consumer, F.lit(60000).cast("long").alias("delay_ms")).select("stream", "shard", "at_ms", "e.*", "consumer", "delay_ms")


def _claims_live(spark, d):
    return live.arriving(_claims(spark, d), "at_ms", lambda events: live.claims(events, 3600000), "claims").where("result <> 'lapsed'")


def _watch_resume(spark, d):
    ops = v.cache_ops(spark, d)
    resume = ops.select("shard").distinct().withColumn("since", (F.col("shard") * 60).cast("long"))
    floors = ops.select("shard").distinct().withColumn("floor", F.lit(100).cast("long"))
    return projections.watch_resume(ops, projections.watched("user-1"), resume, floors, NOW)


def _trims(spark, d):
    rows = v.log(spark, d).where("mark_kind = 'trim'")
    expected = F.when(F.col("event_id") % 2 == 0, F.when(F.col("event_id") % 4 == 0, F.lit(0)).otherwise(F.floor(F.col("offset") / 4))).cast("long")
    return rows.select("stream", "shard", F.col("event_id").alias("seq"), F.floor(F.col("offset") / 2).cast("long").alias("before"), expected.alias("expected"))


def _jsonl_runs(spark, d):
    path = shared_path(spark, "runs")
    e = v.log(spark, d)
    line = F.to_json(F.struct(F.col("event_id").cast("string").alias("run_id"), (F.col("event_id") % 3).cast("string").alias("session_id"), F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), F.lit("abc").alias("git_sha"), (F.col("event_id") % 19 != 0).alias("success"), F.struct(F.col("stream").alias("name"), (F.col("user_id") % 5).cast("int").alias("size")).alias("workload"), F.struct(F.lit("h").alias("host")).alias("host_info"), F.struct(F.col("cents").cast("double").alias("cents")).alias("metrics")))
    e.select(F.when(F.col("event_id") % 501 == 0, "{not a run").otherwise(line).alias("value")).write.text(path)
    return bench.bench_groups(bench.load_runs(spark, path).withColumnRenamed("name", "workload"), ["workload", "size"], "cents")


def _published(spark, d):
    rows = v.log(spark, d).select(F.floor(F.col("event_id") / 50).cast("long").alias("batch"), (F.col("event_id") % 50).alias("position"), shard_modulo(F.col("key"), 4).alias("shard"), F.octet_length("payload").alias("bytes"))
    return reads.publish_report(rows, (F.col("batch") + F.col("shard")) % 9 == 0)


def _registered(spark, d):
    o = v.table(spark, d, "orders")
    return metadata.registry(o.select(F.concat(F.lit("t"), (F.col("o_custkey") % 3).cast("string")).alias("tenant"), F.lit("stream").alias("kind"), F.concat(F.lit("s-"), F.col("o_custkey").cast("string")).alias("name"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderstatus") == "P", "remove").otherwise("register").alias("op"), (F.col("o_orderstatus") == "F").alias("durable")))


def _lags(spark, d):
    tails = v.tails(spark, d)
    subs = tails.select(F.concat_ws("/", F.lit("sub"), "stream", "shard").alias("sub"), "stream", "shard", F.floor(F.col("tail") * (F.col("shard") + 6) / 10).cast("long").alias("position"))
    return reads.lag_notices(subs, tails, 64)


def _subscribed(spark, d):
    t = v.topics(spark, d)
    records = t.select("topic", F.lit("pages").alias("stream"), (F.col("page_id") % 4).cast("int").alias("shard"), F.floor(F.col("page_id") / 4).cast("long").alias("offset"))
    return predicates.subscribed(t.select("topic").distinct(), records, FILTERS[1:], 3).select("topic", "stream", "shard", "offset", "qos")


def _subscription_page(spark, d):
    rows = v.log(spark, d).select("tenant", "stream", "shard", F.col("event_id").alias("id"), "key", (F.col("event_id") % 7).alias("dropped"))
    rows = metadata.subscriptions(rows, dropping=True).join(_streams(spark, d).select("tenant", "stream", "consistency"), ["tenant", "stream"])
    return metadata.keyset_page(rows.drop("dropped"), ["tenant", "stream", "shard", "id"], ["t1", "click", 1, 0], 25)


def _rates(spark, d):
    sends = v.log(spark, d).select("tenant", F.col("ts_us").alias("at_us"), F.lit(1).cast("long").alias("msgs"), F.col("cents").alias("bytes"))
    return queues.tenant_rate(sends, 0.01, 2.0, 1000.0)


def _windowed(spark, d, window, keys):
    rows = v.table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "user_id", F.round(F.col("value") * 100).cast("long").alias("cents"))
    return live.windows(rows, window, keys)


def _shards(spark, d):
    return v.log(spark, d).select("tenant", "namespace", "stream", "shard").distinct()


LOG_COLUMNS = ["tenant", "stream", "shard", "offset", "ts_us", "key", "payload"]

QUERIES = {
    "q01_log_scan": lambda s, d: v.log(s, d).where("stream = 'view' AND shard = 1").select(LOG_COLUMNS),
    "q02_range_page": lambda s, d: reads.range_page(v.log(s, d), 5, 300, 50, 400).select("stream", "shard", "offset", "payload", "next_offset"),
    "q03_start_positions": lambda s, d: reads.start_positions(v.log(s, d), 10),
    "q04_offset_for_time": lambda s, d: reads.offset_for_time(v.log(s, d), TIMES),
    "q05_list_offsets": lambda s, d: reads.list_offsets(v.log(s, d)),
    "q06_data_records": lambda s, d: reads.data_records(v.log(s, d).where("stream = 'error'")).select("shard", "offset", "payload", "skipped_before"),
    "q06b_trailing_gap": lambda s, d: reads.trailing_gap(v.log(s, d)),
    "q07_sharded_merge": lambda s, d: reads.resume_vector(v.log(s, d)),
    "q08_records_around": lambda s, d: reads.records_around(v.log(s, d), 10, 3, 5).select("stream", "shard", "offset", "payload"),
    "q09_gap_report": lambda s, d: reads.gap_report(v.turns(s, d)),
    "q10_segment_report": lambda s, d: reads.segment_report(v.log(s, d)),
    "q10b_offload": lambda s, d: reads.segment_report(reads.offload(v.log(s, d), shared_path(s, "offload"))),
    "q11_assign_offsets": _assign,
    "q12_topic_match": lambda s, d: predicates.topic_match(v.topics(s, d).select("page_id", "topic"), FILTERS),
    "q13_route_modulo": lambda s, d: v.log(s, d).select("event_id", "key", shard_modulo(F.col("key"), 4).alias("routed")),
    "q13b_route_jump": lambda s, d: v.log(s, d).select("event_id", "key", shard_jump(F.col("key"), 4).alias("routed")),
    "q14_header_filter": lambda s, d: predicates.header_view(_headers(s, d), RESERVED).select("event_id", "refused", "view"),
    "q15_conditional_publish": lambda s, d: queues.conditional_publish(_attempts(s, d)),
    "q16_committed_visible": lambda s, d: reads.committed_visible(v.log(s, d), _marks(s, d)).groupBy("stream", "shard").agg(F.count(F.lit(1)).alias("visible"), F.max("offset").alias("last")),
    "q17_mount_longest_prefix": lambda s, d: predicates.longest_mount(v.topics(s, d).select("page_id", "tenant", "topic"), _mounts(s, d)),
    "q18_conditional_batches": lambda s, d: reads.conditional_batches(_pieces(s, d)),
    "q19_quorum_offset": lambda s, d: queues.quorum_offsets(v.replicas(s, d)),
    "q20_cache_latest": lambda s, d: projections.cache_latest(v.cache_ops(s, d), NOW),
    "q20b_index_read": lambda s, d: projections.index_read(projections.cache_latest(v.cache_ops(s, d), NOW), v.cache_ops(s, d)),
    "q21_prefix_watch": lambda s, d: projections.cache_watch(v.cache_ops(s, d), projections.watched("user-1"), 200, NOW),
    "q21b_key_watch": lambda s, d: projections.cache_watch(v.cache_ops(s, d), projections.watched(key="user-7"), 20, NOW),
    "q21c_watch_resume": _watch_resume,
    "q22_cache_cas": lambda s, d: projections.cache_cas(_cas(s, d)),
    "q22b_ttl_sweep": lambda s, d: projections.ttl_sweep(v.cache_ops(s, d), NOW, 20),
    "q24_commit_state": lambda s, d: projections.commit_state(v.commit_ops(s, d)),
    "q24b_commit_events": lambda s, d: projections.commit_events(v.commits(s, d).drop("o_orderkey"), v.commit_ops(s, d)),
    "q25_counter_sum": lambda s, d: projections.counter_sum(v.counter_ops(s, d)),
    "q26_counter_running": lambda s, d: projections.counter_running(v.counter_ops(s, d)),
    "q27_group_fold": lambda s, d: queues.group_fold(_group_ops(s, d)),
    "q27b_dead_letters": lambda s, d: queues.dead_letter_list(queues.group_fold(_group_ops(s, d))),
    "q27c_attempts": lambda s, d: queues.attempts_of(_group_ops(s, d).where("op = 'claim'").select("shard", "grp", (F.col("target") % 40).alias("offset"), "idx")),
    "q28_cursor_max": lambda s, d: queues.cursor_max(_group_writes(s, d)),
    "q29_cursor_contiguous": lambda s, d: queues.cursor_contiguous(v.acks(s, d), 3),
    "q30_idempotent_dedupe": lambda s, d: queues.idempotent_dedupe(v.producer(s, d)),
    "q30b_per_record": lambda s, d: queues.idempotent_fold(v.producer(s, d), queues.WRAP),
    "q30c_record_digest": lambda s, d: v.log(s, d).select("event_id", record_digest(F.col("payload")).alias("digest")),
    "q31_group_describe": lambda s, d: queues.group_describe(v.acks(s, d)),
    "q31s_queue_claims": lambda s, d: queues.queue_claims(_claims(s, d), 3600000),
    "q32_backup_point": lambda s, d: v.tails(s, d).select("stream", "shard", F.col("tail").alias("committed")),
    "q33_trim_floor": lambda s, d: reads.trim_floor(v.log(s, d), v.log(s, d).where("mark_kind = 'trim'").select("stream", "shard", F.floor(F.col("offset") / 2).cast("long").alias("floor"))).select("stream", "shard", "offset", "key"),
    "q33b_trim_fold": lambda s, d: reads.trim_fold(_trims(s, d)),
    "q34_compaction_survivors": lambda s, d: projections.compaction_survivors(v.cache_ops(s, d), 0),
    "q35_compaction_due": lambda s, d: projections.compaction_due(v.cache_ops(s, d), 10000, 4),
    "q36_retention_prefix": lambda s, d: reads.retention_prefix(reads.segment_report(v.log(s, d)), 4000, 12 * 86400000000, NOW * 1000).select("stream", "shard", "segment", "last_offset", "bytes"),
    "q37_ring_tail": lambda s, d: reads.ring_tail(v.log(s, d), 300).select("stream", "shard", "offset", "payload"),
    "q38_epoch_ranges": lambda s, d: reads.epoch_ranges(v.log(s, d), F.floor(F.col("offset") / 50).cast("long")),
    "q39_producer_lru": lambda s, d: queues.producer_lru(v.producer(s, d), 10),
    "q40_promote": lambda s, d: queues.promote(v.replicas(s, d)),
    "q41_rendezvous": lambda s, d: queues.rendezvous(_shards(s, d), v.nodes(s, d).select("node", "zone")),
    "q41b_bounded_placement": lambda s, d: queues.bounded_placement(_shards(s, d), v.nodes(s, d).select("node", "zone")),
    "q42_tenant_delivery": lambda s, d: metadata.tenant_delivery(v.log(s, d).where("mark_kind = 'data'")),
    "q43_subscriptions_page": _subscription_page,
    "q44_change_feed": lambda s, d: metadata.change_feed(_changes(s, d), 100, 50, 500),
    "q45_keyset_page": lambda s, d: metadata.keyset_page(v.table(s, d, "customer").select("c_mktsegment", "c_custkey", "c_name"), ["c_mktsegment", "c_custkey"], ["BUILDING", 20], 40),
    "q45b_cursor_page": lambda s, d: metadata.keyset_page(v.table(s, d, "customer").select("c_mktsegment", "c_custkey", "c_name"), ["c_mktsegment", "c_custkey"], codecs.encode_cursor(["FURNITURE", 7]), 30),
    "q46_grants": lambda s, d: predicates.granted(_requests(s, d), _grants(s, d)),
    "q47_scoped_grants": _scoped,
    "q48_region_bridges": _regions,
    "q49_mount_overlap": lambda s, d: predicates.mount_overlap(_mounts(s, d).select("tenant", "prefix").distinct()),
    "q50_ledger_verdict": _ledger,
    "q52_stalls": _stalls,
    "q52b_drain_time": lambda s, d: history.drain_time(v.log(s, d).select("stream", "shard", F.col("ts_us").alias("begin"), (F.col("ts_us") + F.col("cents") * 1000000).alias("acked_at")), TIMES[4]),
    "q53_divergence": _divergence,
    "q54_history_rules": _set_rules,
    "q55_realtime_order": _realtime,
    "q56_stale_get": _stale,
    "q57_commit_atomicity": lambda s, d: history.commit_atomicity(v.commits(s, d).where("offset % 50 <> 0"), v.commit_ops(s, d).where("offset % 51 <> 0").select("shard", "offset").distinct()),
    "q58_cycles": _cycles,
    "q59_linearizable": lambda s, d: history.linearizable(_registers(s, d)),
    "q60_bench_agg": lambda s, d: bench.bench_groups(_runs(s, d), ["workload", "size"], "cents"),
    "q60c_jsonl_runs": _jsonl_runs,
    "q60b_latest_session": lambda s, d: bench.latest_session(_runs(s, d)).groupBy("session", "workload").agg(F.count(F.lit(1)).alias("n")),
    "q61_percentile_definitions": lambda s, d: bench.percentile_definitions(_runs(s, d), "workload", "cents", 0.95),
    "q62_paired_interval": lambda s, d: bench.paired_interval(_rounds(s, d)),
    "q63_regression_verdict": lambda s, d: bench.regression_verdict(_slowed(s, d), "workload", "candidate", "cents", True).select("workload", "n0", "n1", "median0", "median1", "pct_change", "status"),
    "q64_metadata_lookup": lambda s, d: metadata.lookup(_streams(s, d), _readers(s, d)),
    "q64b_registry": _registered,
    "q65_lifecycle_check": lambda s, d: metadata.lifecycle_faults(_states(s, d)),
    "q66_incarnation_visible": lambda s, d: metadata.visible_incarnations(*_incarnations(s, d)),
    "q67_shard_resolution": _resolution,
    "q68_lease_holder": lambda s, d: projections.lease_holder(_leases(s, d), NOW),
    "q69_json_props": lambda s, d: v.log(s, d).select("stream", F.from_json("payload", "k long")["k"].alias("k")).groupBy("stream").agg(F.count("k").alias("n"), F.sum("k").alias("k"), F.min("k").alias("least"), F.max("k").alias("most")),
    "q70_record_batches": lambda s, d: codecs.produced(codecs.record_batches(v.log(s, d))),
    "q71_commit_records": lambda s, d: codecs.commit_operations(codecs.commit_records(v.commits(s, d), v.commit_ops(s, d))).select("shard", "offset", "event", "op", "key", "value"),
    "q72_publish_report": _published,
    "q73_reservoir": lambda s, d: bench.reservoir(v.log(s, d).select("stream", "event_id", "cents"), ["stream"], "event_id", 100),
    "q74_apply_in_order": lambda s, d: reads.apply_in_order(v.log(s, d).select("stream", "shard", "offset", (F.col("ts_us") + F.col("cents") * 1000).alias("finished"))),
    "q75_lag_notices": _lags,
    "q76_topic_subscription": _subscribed,
    "q77_retry_classes": lambda s, d: metadata.retry_classes(v.table(s, d, "events").select("event_id", F.element_at(F.array(*(F.lit(c) for c in ("not_found", "throttled", "stale", "other"))), (F.col("event_id") % 4 + 1).cast("int")).alias("code"))),
    "st1_stream_tail": lambda s, d: live.tail(s, d, "click"),
    "st2_replay_then_live": lambda s, d: live.replay_then_live(s, d, v.table(s, d, "events").where("event_id % 3 = 0"), F.col("event_id") % 3 != 1),
    "st3_stream_dedupe": lambda s, d: live.dedupe(s, d, "1 hour"),
    "st4_cache_watch": lambda s, d: live.cache_watch(v.cache_ops(s, d), projections.watched("user-1"), 200, NOW),
    "st5_queue_claims": _claims_live,
    "x1_tenant_rate": _rates,
    "e1_tumbling": lambda s, d: _windowed(s, d, F.window("ts", "6 hours"), ["event_type"]),
    "e2_sliding": lambda s, d: _windowed(s, d, F.window("ts", "12 hours", "6 hours"), ["event_type"]),
    "e3_session": lambda s, d: _windowed(s, d, F.session_window("ts", "2 hours"), ["user_id"]),
}
