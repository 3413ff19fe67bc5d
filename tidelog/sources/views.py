"""The canonical log tables, derived from the driver's tables by fixed rules.

Windows that number records are partitioned by the unit of order, the shard of a stream, as the log itself would be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NOW_MS = 1706659200000  # 2024-01-31
DAY_MS = 86400000


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def micros(ts: str | Column) -> Column:
    """Microseconds since the epoch of a zoneless timestamp, read as UTC."""
    c = F.col(ts) if isinstance(ts, str) else ts
    zero = F.lit("1970-01-01").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", zero, c)


def scoped(rows: DataFrame, scope: dict[str, Column], by: list[str]) -> DataFrame:
    """rows with their scope and their offset in it. The window is partitioned by the scope's own names, so that a filter on a scope passes
    below it, and from there to the scan."""
    order = Window.partitionBy(*scope).orderBy(*by)
    return rows.withColumns(scope).withColumn("offset", (F.row_number().over(order) - 1).cast("long"))


def log(spark: SparkSession, d: str) -> DataFrame:
    """One record per event, at its offset in (stream, shard)."""
    events = table(spark, d, "events").select("event_id", "ts", "user_id", "value", "props", F.col("event_type").alias("stream"))
    return scoped(events, {"shard": (F.col("user_id") % 4).cast("int")} | {"stream": F.col("stream")}, ["ts", "event_id"]).select(
        F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("tenant"),
        F.lit("default").alias("namespace"),
        "stream",
        "shard",
        "offset",
        micros("ts").alias("ts_us"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("key"),
        F.col("props").alias("payload"),
        F.round(F.col("value") * 100).cast("long").alias("cents"),
        F.when(F.col("event_id") % 11 == 0, "trim").when(F.col("event_id") % 11 == 1, "producer").otherwise("data").alias("mark_kind"),
        "event_id",
        "user_id",
    )


def cache_ops(spark: SparkSession, d: str) -> DataFrame:
    """Puts and deletes of a keyed cache, one shard per user_id modulo 4."""
    ms = F.floor(micros("ts") / 1000).cast("long")
    deleted = F.col("event_type") == "error"
    return scoped(table(spark, d, "events"), {"shard": (F.col("user_id") % 4).cast("int")}, ["ts", "event_id"]).select(
        "shard",
        "offset",
        ms.alias("ts_ms"),
        F.when(deleted, "delete").otherwise("put").alias("op"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("key"),
        F.when(~deleted, F.round(F.col("value") * 100).cast("long")).alias("value"),
        F.when(F.col("event_type") == "purchase", ms + 7 * DAY_MS).when(F.col("event_type") == "view", ms + DAY_MS).otherwise(F.lit(0)).cast("long").alias("expires_at_millis"),
        F.octet_length("props").cast("long").alias("bytes"),
    )


def counter_ops(spark: SparkSession, d: str) -> DataFrame:
    """Signed deltas per event type; every 500th operation of a key is a checkpoint."""
    cents = F.round(F.col("value") * 100).cast("long")
    rows = scoped(table(spark, d, "events"), {"key": F.col("event_type")}, ["ts", "event_id"])
    rows = rows.select("key", "offset", F.when(F.col("event_id") % 2 == 1, -cents).otherwise(cents).alias("amount"))
    return rows.withColumn("op", F.when(F.col("offset") % 500 == 250, "checkpoint").otherwise("delta"))


def commits(spark: SparkSession, d: str) -> DataFrame:
    """One atomic commit per order: shard, offset, event."""
    heads = scoped(table(spark, d, "orders"), {"shard": (F.col("o_custkey") % 4).cast("int")}, ["o_orderdate", "o_orderkey"])
    return heads.select("o_orderkey", "shard", "offset", F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("event"))


def commit_ops(spark: SparkSession, d: str) -> DataFrame:
    """The put and delete operations of the commits, a row each; place orders those of a commit."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_linestatus")
    rows = lines.join(commits(spark, d).drop("event"), F.col("l_orderkey") == F.col("o_orderkey"))  # lines go there as they are, which is narrow
    return rows.select(
        "o_orderkey",
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("place"),
        F.when(F.col("l_linestatus") == "F", "delete").otherwise("put").alias("op"),
        F.concat(F.lit("part-"), F.col("l_partkey").cast("string")).alias("key"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("value"),
        "shard",
        "offset",
    )


def producer(spark: SparkSession, d: str) -> DataFrame:
    """Sends of idempotent producers, the re-sends (every tenth event, every seventieth with another payload) included; arrival is their order of arrival."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    sends = table(spark, d, "events").select((F.col("user_id") % 4).cast("int").alias("shard"), F.col("user_id").alias("producer_id"), (F.row_number().over(order) - 1).cast("long").alias("sequence"), F.col("props").alias("payload"), "event_id", (F.col("event_id") * 2).alias("arrival"))
    again = sends.where("event_id % 10 = 0").withColumn("arrival", F.col("arrival") + 1 + 40 * (F.col("event_id") % 3))
    again = again.withColumn("payload", F.when(F.col("event_id") % 70 == 0, F.concat("payload", F.lit("!"))).otherwise(F.col("payload")))
    return sends.unionByName(again)


def acks(spark: SparkSession, d: str) -> DataFrame:
    """The log's records with acknowledgement and attempts of one consumer group."""
    return log(spark, d).withColumn("acked", F.col("event_id") % 7 != 0).withColumn("attempts", (1 + F.col("event_id") % 6).cast("int"))


def history(spark: SparkSession, d: str) -> DataFrame:
    """Appends of a client history: times, outcome, and the offset where the final log holds the value."""
    rows = log(spark, d)
    outcome = F.when(F.col("event_id") % 20 == 0, "fail").when(F.col("event_id") % 20 == 1, "info").otherwise("ok")
    return rows.select("stream", "shard", "offset", F.col("event_id").alias("value"), F.col("ts_us").alias("invoke"), (F.col("ts_us") + F.col("cents") * 1000).alias("complete"), outcome.alias("outcome"))


def turns(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries per conversation: turns with a fifth of them missing; of those a part is control records."""
    gone = (F.col("conv_id") * 7 + F.col("turn")) % 5 == 0
    return table(spark, d, "conversations").select(F.col("conv_id").alias("sub"), F.col("turn").cast("long").alias("offset"), "role", gone.alias("gone"), (gone & ((F.col("conv_id") + F.col("turn")) % 3 == 0)).alias("control"))


def topics(spark: SparkSession, d: str) -> DataFrame:
    """Topic names from page addresses: host and path."""
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    path = F.regexp_extract("url", "^https?://[^/]+/([^?#]*)", 1)
    tenant = F.concat(F.lit("t"), (F.length(host) % 3).cast("string"))
    return table(spark, d, "pages").select("page_id", tenant.alias("tenant"), F.concat(host, F.lit("/"), path).alias("topic"), host.alias("host"), F.split(path, "/")[0].alias("section"))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes from suppliers: zone is the nation, region the nation's region."""
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    place = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "supplier").join(place, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("node-"), F.col("s_suppkey").cast("string")).alias("node"), "s_suppkey", F.col("n_name").alias("zone"), F.col("r_name").alias("region"), "s_acctbal")


def tails(spark: SparkSession, d: str) -> DataFrame:
    """Base and tail of every shard of every stream."""
    return log(spark, d).groupBy("stream", "shard").agg(F.min("offset").alias("base"), (F.max("offset") + 1).alias("tail"))


def replicas(spark: SparkSession, d: str) -> DataFrame:
    """The leader's tail and four followers' of every shard."""
    t = tails(spark, d).withColumn("s", F.col("shard") + F.length("stream"))
    member = lambda name, lag, halted: F.struct(F.lit(name).alias("member"), (F.col("tail") - lag).alias("reported"), halted.alias("halted"))
    rows = F.array(
        member("f1", F.col("s") % 3, F.lit(False)),
        member("f2", (F.col("s") * 2) % 7, F.col("s") % 4 == 0),
        member("f3", F.lit(-2), F.col("s") % 5 == 0),
        member("f4", (F.col("s") * 3) % 11, F.lit(False)),
    )
    return t.select("stream", "shard", "tail", F.explode(rows).alias("r")).select("stream", "shard", "tail", "r.*")
