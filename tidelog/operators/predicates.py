"""Routing, topics, mounts, permissions and regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.hashing import shard_modulo
from tidelog.functions.patterns import best_match, glob_regex_column, topic_fault

# A grant of the first action also allows the others.
IMPLIED = (
    ("stream.subscribe", "group.consume"),
    ("stream.manage", "group.manage"),
    ("stream.manage", "stream.trim"),
)


def topic_match(topics: DataFrame, filters: list[tuple[str, int]]) -> DataFrame:
    """Topics with their fault, if any, and the best service level of the filters that match; the filters are a short list."""
    return topics.withColumn("fault", topic_fault(F.col("topic"))).withColumn("qos", best_match(F.col("topic"), filters))


def longest_mount(topics: DataFrame, mounts: DataFrame) -> DataFrame:
    """Topics (with their tenant) and their tenant's mount of the longest prefix. The lengths that prefixes have are few, so prefixes are
    joined by equality; those lengths, one row, are broadcast."""
    lengths = mounts.agg(F.array_sort(F.collect_set(F.length("prefix"))).alias("lengths")).withColumn("_k", F.lit(1))
    rows = topics.withColumn("_k", F.lit(1)).join(F.broadcast(lengths), "_k").withColumn("_p", F.explode(F.filter("lengths", lambda n: n <= F.length("topic"))))
    rows = rows.withColumn("prefix", F.col("topic").substr(F.lit(1), F.col("_p"))).join(mounts, ["tenant", "prefix"])
    best = rows.groupBy(*topics.columns).agg(F.max_by(F.struct("prefix", "stream"), "_p").alias("m"))
    return best.select(*topics.columns, F.col("m.prefix").alias("prefix"), F.col("m.stream").alias("stream"))


def mount_overlap(mounts: DataFrame) -> DataFrame:
    """Pairs of different mounts of a tenant of which one prefix starts with the other; joined on the prefix's own beginnings."""
    starts = mounts.select("tenant", F.col("prefix").alias("longer"), F.explode(F.transform(F.sequence(F.lit(1), F.length("prefix")), lambda n: F.col("prefix").substr(F.lit(1), n))).alias("prefix"))
    pairs = starts.join(mounts.select("tenant", "prefix"), ["tenant", "prefix"]).where("prefix <> longer")
    return pairs.select("tenant", F.col("prefix").alias("shorter"), "longer").distinct()


def subscribed(topics: DataFrame, records: DataFrame, filters: list[tuple[str, int]], offset: int) -> DataFrame:
    """What a topic subscription reads from an offset on: the records (stream, shard, offset, topic), from all shards, of topics that a filter matches."""
    fits = topic_match(topics, filters).where("fault IS NULL AND qos IS NOT NULL").select("topic", "qos").distinct()
    return records.where(F.col("offset") >= offset).join(fits, "topic")


def publish_headers(messages: DataFrame, shards: int) -> DataFrame:
    """Topic publishes (topic, payload, qos, retain, content_type) as records: the topic is the key, so that a topic stays in one shard; the
    message's own fields become headers, those that are set."""
    header = lambda name: F.struct(F.lit(name).alias("name"), F.col(name).cast("string").alias("value"))
    fields = F.filter(F.array(header("qos"), header("retain"), header("content_type")), lambda h: h["value"].isNotNull())
    return messages.select(F.col("topic").alias("key"), shard_modulo(F.col("topic"), shards).alias("shard"), "payload", fields.alias("headers"))


def header_view(records: DataFrame, reserved: str) -> DataFrame:
    """Headers (ordered, names may repeat) as one value per name, the last; and whether a name is reserved."""
    names = F.array_distinct(F.transform("headers", lambda h: h["name"]))
    last = lambda n: F.element_at(F.filter("headers", lambda h: h["name"] == n), -1)["value"]
    view = F.array_join(F.array_sort(F.transform(names, lambda n: F.concat_ws("=", n, last(n)))), ";")
    return records.withColumn("refused", F.exists("headers", lambda h: h["name"].startswith(reserved))).withColumn("view", view)


def granted(requests: DataFrame, grants: DataFrame) -> DataFrame:
    """Requests (principal, action, resource) with whether a grant (principal, action, pattern) allows them; nothing denies.

    cluster:* counts only literally. Joined on principal and action, so patterns are tried on their own requests only.
    """
    more = grants
    for action, implied in IMPLIED:
        more = more.unionByName(grants.where(F.col("action") == action).withColumn("action", F.lit(implied)))
    own = more.distinct().withColumn("_re", glob_regex_column(F.col("pattern")))
    fits = F.when(F.col("resource").startswith("cluster:"), F.col("pattern") == "cluster:*").otherwise(F.regexp_like("resource", "_re"))
    ok = requests.join(own, ["principal", "action"]).where(fits).select("principal", "action", "resource").distinct()
    return requests.join(ok.withColumn("_ok", F.lit(True)), ["principal", "action", "resource"], "left").withColumn("allowed", F.coalesce("_ok", F.lit(False))).drop("_ok")


def scoped_granted(requests: DataFrame, grants: DataFrame) -> DataFrame:
    """Cache-key requests (principal, resource of tenant/namespace/cache/key), matched segment by segment: a * in the first three
    stays within its segment, the last is an exact key, or a prefix before a final *. Principals with a grant narrowed to a group are left out.

    A request's key is looked up as it is, and by its beginnings of the lengths that prefixes have (few, one row, broadcast): grants are joined by
    equality, so that a principal's grants aren't tried on all its requests.
    """
    own = grants.where("pattern IS NOT NULL").select("principal", F.split("pattern", "/", 4).alias("_s")).where("size(_s) = 4")
    want = F.col("_s")[3]
    own = own.select("principal", want.endswith("*").alias("open"), F.when(want.endswith("*"), F.expr("substring(_s[3], 1, length(_s[3]) - 1)")).otherwise(want).alias("want"), F.transform(F.slice("_s", 1, 3), glob_regex_column).alias("_r")).distinct()
    lengths = own.where("open").agg(F.array_sort(F.collect_set(F.length("want"))).alias("lengths")).withColumn("_k", F.lit(1))
    parts = requests.select("principal", "resource", F.split("resource", "/", 4).alias("_q"), F.lit(1).alias("_k")).where("size(_q) = 4").distinct().join(F.broadcast(lengths), "_k")
    key = F.col("_q")[3]
    begins = F.transform(F.filter("lengths", lambda n: n <= F.length(key)), lambda n: F.struct(F.lit(True).alias("open"), key.substr(F.lit(1), n).alias("want")))
    asked = F.array_append(begins, F.struct(F.lit(False).alias("open"), key.alias("want")))
    parts = parts.select("principal", "resource", "_q", F.explode(asked).alias("a")).select("principal", "resource", "_q", "a.*")
    fits = F.lit(True)
    for i in range(3):
        fits = fits & F.regexp_like(F.get("_q", F.lit(i)), F.get("_r", F.lit(i)))
    narrowed = grants.where("grp IS NOT NULL").select("principal").distinct()
    hit = parts.join(own, ["principal", "open", "want"]).where(fits).select("principal", "resource").distinct()
    return hit.join(narrowed, "principal", "left_anti")


def bridged(pairs: DataFrame, bridges: DataFrame) -> DataFrame:
    """Pairs (src, dst) of regions that traffic may take: the same one, or along a bridge in its direction."""
    return pairs.where("src = dst").unionByName(pairs.where("src <> dst").join(bridges, ["src", "dst"], "left_semi"))
