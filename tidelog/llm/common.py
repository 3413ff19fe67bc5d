"""What several operators share: bounded Arrow batches, worker caches, shared folders, samples of labelled rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def chunks(batches: Iterator, column: str, max_bytes: int = 4 << 20) -> Iterator:
    """Slices of Arrow batches whose column holds about max_bytes at most; a longer value comes alone."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
            yield batch.slice(at, to - at)
            at = to
    batch = None
    release()


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def mapped(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """df.mapInArrow(run, schema), rows going to Python in batches of 4 MB: with the default, 64 MB, a batch of long texts takes several times as
    much memory on both sides. A session that has set another size keeps it."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_BYTES, None) == "67108864b":
        conf.set(BATCH_BYTES, "4m")
    return df.mapInArrow(run, schema)


def worker_cache(name: str, make: Callable, version: str = ""):
    """An object that outlives a task in a Python worker that Spark reuses, until another one, or another version of it, is asked for.

    Only caches and loaded files live here: no result depends on what is found.
    """
    import sys
    import types

    home = sys.modules.setdefault("_tidelog_worker_cache", types.ModuleType("_tidelog_worker_cache"))
    if getattr(home, "key", None) != (name, version):
        home.held = None
        release()
        home.key, home.held = (name, version), make()
        release()  # what was needed to make it
    return home.held


def release() -> None:
    """Gives memory that isn't used any more back to the system: a Python worker lives on between its tasks."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library that most systems have
    if trim:
        trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset (local runs and tests), one below the warehouse."""
    sc = spark.sparkContext
    given = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not given:
        given = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(given)
    return given.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut: written once as a table in the shared folder, and read from there."""
    path = shared_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_scratch: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, or in the innermost scratch() folder."""
    return f"{_scratch[-1] if _scratch else shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder that isn't read any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder for all tables that are written within, removed at the end: what is still wanted then must have been written elsewhere."""
    path = shared_path(spark, "scratch")
    _scratch.append(path)
    try:
        yield path
    finally:
        _scratch.remove(path)
        remove(spark, path)


#: Rows of a few numbers or a digest each that may be broadcast, once they were counted: some 100 MB in an executor.
BROADCAST_ROWS = 1_500_000


def broadcast_if_small(df: DataFrame, most: int | None = None) -> DataFrame:
    """df (already written, rows of a few numbers), marked for broadcast if it has at most `most` rows; else joins shuffle."""
    return F.broadcast(df) if is_small(df, most) else df


def is_small(df: DataFrame, most: int | None = None) -> bool:
    """Whether df (already written, rows of a few numbers) has at most `most` rows."""
    return df.count() <= (BROADCAST_ROWS if most is None else most)


def crc_mod(id_column: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(F.col(id_column).cast("string") if isinstance(id_column, str) else id_column), F.lit(n))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value computed once: lambdas would else compute it for each element."""
    return F.transform(F.array(value), body)[0]


def join_skewed(rows: DataFrame, table: DataFrame, key: str, share: int = 1000, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with table (unique by key, with n, the number of rows of that key) on key.

    Keys with more than a share-th of all rows, fewer than `share` of them, are joined by broadcast, so that none lands in one task.
    """
    total = table.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * share > total
    often, others = F.broadcast(table.where(hot).drop("n")), table.where(~hot).drop("n")
    rest = rows.join(often.select(key), key, "left_anti")
    return rows.join(often, key).unionByName(rest.join(others, key, how))


def least_hashed(rows: DataFrame, group: str, per_group: int, counts: dict, spare: int = 4) -> DataFrame:
    """Of each group the per_group rows (column _i, distinct) of the least hash of _i; counts: the number of rows of each group.

    Only rows under a threshold that lets some spare * per_group of a group through, as hashes are uniform, come to the driver, and are
    ranked there; where too few should pass, the threshold is raised.
    """
    span = 1 << 64
    while True:
        bounds = [(g, (1 << 63) - 1 if n <= spare * per_group else int(span * spare * per_group / n) - (1 << 63)) for g, n in sorted(counts.items())]
        limit = F.element_at(F.create_map(*(F.lit(x) for b in bounds for x in b)), F.col(group)) if bounds else F.lit(None)
        found = rows.withColumn("_h", F.xxhash64("_i")).where(F.col("_h") <= limit.cast("long")).select("_h", "_i", group).collect()
        by: dict = {}
        for r in sorted(found):
            by.setdefault(r[2], []).append(r[1])
        if all(len(by.get(g, ())) >= min(per_group, n) for g, n in counts.items()):
            break
        spare = 16 * max(spare, 1)
    picked = [(i, g) for g, ids in by.items() for i in ids[:per_group]]
    return rows.sparkSession.createDataFrame(picked, rows.select("_i", group).schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, per_class: int, max_chars: int) -> list[tuple[int, str, int]]:
    """(id, text, label) of at most per_class rows of each value of label, those of the least hashes of their id.

    docs: id and text; labels: id and label, unique by id after de-duplication. Rows of more than max_chars
    characters are left out of the sample, so that the driver never holds more than 2 * per_class * max_chars characters.
    """
    pick = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(id_col).alias("_i")).agg(F.max(label).cast("int").alias("_y"))
    sized = docs.where(F.length(text_col) <= max_chars).select(F.col(id_col).alias("_i"))
    pick = cut(pick.join(sized, "_i", "left_semi"))
    pick = least_hashed(pick, "_y", per_class, {r[0]: r[1] for r in pick.groupBy("_y").count().collect()})
    text = docs.where(F.length(text_col) <= max_chars).select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t"))
    got = text.join(F.broadcast(pick), "_i").groupBy("_i", "_y").agg(F.max("_t").alias("_t"))
    return [(r["_i"], r["_t"], int(r["_y"])) for r in sorted(got.collect(), key=lambda r: r["_i"])]
