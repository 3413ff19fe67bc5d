"""Metadata: catalogues, change feeds, pages, lifecycles, resolution of shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.codecs import decode_cursor, encode_cursor

# The lifecycle transitions that a node may take.
TRANSITIONS = (("live", "draining"), ("live", "down"), ("draining", "live"), ("draining", "down"), ("draining", "left"), ("down", "live"), ("down", "left"))

# The class of retry of each kind of error.
RETRY = {"not_found": "never", "unauthorized": "never", "not_leader": "elsewhere", "stale": "refresh", "throttled": "later", "unavailable": "later", "conflict": "reread"}


class UnknownScope(LookupError):
    """A tenant, namespace or stream that isn't registered: an error, not an empty result."""


def require_scope(streams: DataFrame, tenant: str, stream: str) -> None:
    if not streams.where((F.col("tenant") == tenant) & (F.col("stream") == stream)).take(1):
        raise UnknownScope(f"{tenant}/{stream}")


def retry_classes(errors: DataFrame) -> DataFrame:
    """Errors (code) with what a client does about them; an unknown code is never retried."""
    known = F.create_map(*(F.lit(x) for pair in sorted(RETRY.items()) for x in pair))
    return errors.withColumn("retry", F.when(F.col("code").isin(*RETRY), F.element_at(known, F.col("code"))).otherwise("never"))


def registry(ops: DataFrame) -> DataFrame:
    """What is registered after registrations and removals (tenant, kind, name, seq, op, durable): the last one counts. Registering again what is there
    isn't an error; its settings are those of the first registration after the last removal."""
    scope = ("tenant", "kind", "name")
    gone = ops.where("op = 'remove'").groupBy(*scope).agg(F.max("seq").alias("gone"))
    left = ops.where("op = 'register'").join(gone, list(scope), "left").where("gone IS NULL OR seq > gone")
    return left.groupBy(*scope).agg(F.min_by("durable", "seq").alias("durable"), F.min("seq").alias("since"), (F.count(F.lit(1)) - 1).alias("again"))


def subscriptions(rows: DataFrame, tenant: str | None = None, stream: str | None = None, shard: int | None = None, principal: str | None = None, dropping: bool | None = None) -> DataFrame:
    """A listing of subscriptions by any of their fields; dropping: whether records were dropped."""
    for name, value in (("tenant", tenant), ("stream", stream), ("shard", shard), ("principal", principal)):
        rows = rows if value is None else rows.where(F.col(name) == value)
    return rows if dropping is None else rows.where((F.col("dropped") > 0) == dropping)


def lookup(streams: DataFrame, readers: DataFrame) -> DataFrame:
    """Durable streams that each principal may read, with their settings checked: retention bounds are positive if given."""
    valid = (F.coalesce("retention_bytes", F.lit(1)) > 0) & (F.coalesce("retention_ms", F.lit(1)) > 0)
    return streams.where("durable").join(readers, ["tenant", "stream"]).select("principal", "tenant", "stream", "shards", "consistency", valid.alias("valid"))


def lifecycle_faults(states: DataFrame) -> DataFrame:
    """State changes of a node (node, seq, state) that aren't allowed."""
    order = Window.partitionBy("node").orderBy("seq")
    moves = states.withColumn("before", F.lag("state").over(order)).where("before IS NOT NULL AND before <> state")
    allowed = F.array(*(F.lit(f"{a}>{b}") for a, b in TRANSITIONS))
    return moves.where(~F.array_contains(allowed, F.concat_ws(">", "before", "state"))).select("node", "seq", "before", "state")


def visible_incarnations(incarnations: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Incarnations above what a delete covered: a delete hides every one up to it."""
    gone = tombstones.groupBy("name").agg(F.max("deleted_through").alias("deleted_through"))
    return incarnations.join(gone, "name", "left").where(F.col("incarnation") > F.coalesce("deleted_through", F.lit(-1))).drop("deleted_through")


def resolve(shards: DataFrame, routes: DataFrame, nodes: DataFrame, me: str) -> DataFrame:
    """Where a shard is served, in order: no route; route older than wanted; here, before any question of liveness; leader unknown; leader not live; elsewhere."""
    rows = shards.join(routes, ["stream", "shard"], "left").join(nodes.select(F.col("node").alias("leader"), "state"), "leader", "left")
    answer = (
        F.when(F.col("leader").isNull() & F.col("wanted").isNotNull(), "stale")
        .when(F.col("leader").isNull(), "no_assignment")
        .when(F.col("generation") < F.col("wanted"), "stale")
        .when(F.col("leader") == me, "local")
        .when(F.col("state").isNull(), "leader_unknown")
        .when(F.col("state") != "live", "unavailable")
        .otherwise("elsewhere")
    )
    return rows.select("stream", "shard", answer.alias("answer"), F.when(answer.isin("local", "elsewhere", "unavailable"), F.col("leader")).alias("node"))


def change_feed(changes: DataFrame, since: int, limit: int, kept: int) -> DataFrame:
    """Changes from since on, limit at most. The log holds its last `kept` changes: below those the reader must take a snapshot."""
    base = (changes.agg(F.max("seq")).first()[0] or 0) - kept + 1
    page = changes.where(F.col("seq") >= since).orderBy("seq").limit(limit)
    return page.select("seq", "key", "op", F.lit(since < base).alias("resnapshot"))


#: Entries of a page: the most, and how many there are where none is asked for.
MOST_ENTRIES, ENTRIES = 10_000, 1000


def keyset_page(rows: DataFrame, order: list[str], after: list | str | None, limit: int = ENTRIES) -> DataFrame:
    """The page after a key or a cursor (None: the first one), in order, and whether more follow. Only limit + 1 rows leave each task."""
    if not 1 <= limit <= MOST_ENTRIES:
        raise ValueError(f"limit must be from 1 to {MOST_ENTRIES}")
    key = decode_cursor(after, len(order)) if isinstance(after, str) else after
    if key is not None:
        later = F.lit(False)
        equal = F.lit(True)
        for name, value in zip(order, key):
            later = later | (equal & (F.col(name) > F.lit(value)))
            equal = equal & (F.col(name) == F.lit(value))
        rows = rows.where(later)
    page = rows.orderBy(*order).limit(limit + 1)
    n = Window.orderBy(*order)
    return page.withColumn("_n", F.row_number().over(n)).withColumn("more", F.max("_n").over(Window.partitionBy()) > limit).where(F.col("_n") <= limit).drop("_n")


def next_cursor(page: DataFrame, order: list[str]) -> str | None:
    """The cursor of what follows a page; None after the last one."""
    last = page.where("more").orderBy(*(F.desc(c) for c in order)).select(*order).first()
    return encode_cursor(list(last)) if last else None


def tenant_delivery(deliveries: DataFrame) -> DataFrame:
    return deliveries.groupBy("tenant").agg(F.count(F.lit(1)).alias("messages"), F.sum(F.octet_length("payload")).cast("long").alias("bytes"))
