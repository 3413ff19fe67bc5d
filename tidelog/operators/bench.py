"""Statistics of benchmark runs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Rounds of a paired comparison, and the rank of the ends of the median's interval.
RANKS = {6: 1, 12: 2, 24: 6}


def bench_groups(runs: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """Trials, failures, median, and 10th and 90th percentiles (linear) of each workload."""
    m = F.col(metric)
    return runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("trials"), F.count(F.when(F.col("failed"), 1)).alias("failures"), F.expr(f"percentile({metric}, 0.5)").alias("median"), F.expr(f"percentile({metric}, 0.1)").alias("p10"), F.expr(f"percentile({metric}, 0.9)").alias("p90"), F.max(m).alias("most"))


def percentile_definitions(values: DataFrame, key: str, value: str, q: float) -> DataFrame:
    """Four definitions of a percentile that aren't interchangeable, and the upper median.

    Equal values are counted before they are shuffled, so a window holds distinct values only.
    a: index round((n - 1) q); b: the same of values cut to thousands; c: nearest rank ceil(q n); d: linear interpolation.
    """
    counts = values.groupBy(key, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    order = Window.partitionBy(key).orderBy("v")
    ranked = counts.withColumn("upto", F.sum("c").over(order)).withColumn("n", F.sum("c").over(Window.partitionBy(key)))
    at = lambda index: F.min(F.when(F.col("upto") > index, F.col("v")))
    place = F.floor((F.col("n") - 1) * F.lit(q) + 0.5)
    low = F.floor((F.col("n") - 1) * F.lit(q))
    t = ranked.groupBy(key).agg(
        at(place).alias("rounded_rank"),
        at(F.ceil(F.col("n") * F.lit(q)) - 1).alias("nearest_rank"),
        at(low).alias("low"),
        at(F.least(low + 1, F.col("n") - 1)).alias("high"),
        at(F.floor(F.col("n") / 2)).alias("upper_median"),
        F.max((F.col("n") - 1) * F.lit(q) - low).alias("part"),
    )
    return t.select(key, "rounded_rank", F.floor(F.col("rounded_rank") / 1000).cast("long").alias("rounded_rank_thousands"), "nearest_rank", (F.col("low") + (F.col("high") - F.col("low")) * F.col("part")).alias("linear"), "upper_median")


def paired_interval(rounds: DataFrame) -> DataFrame:
    """Per cell the interval of the median of candidate / baseline over paired rounds; only cells with 6, 12 or 24 rounds decide."""
    ratio = (F.col("candidate") / F.col("baseline")).alias("ratio")
    rows = rounds.where("baseline > 0 AND candidate > 0").select("cell", ratio).groupBy("cell").agg(F.sort_array(F.collect_list("ratio")).alias("r"))  # 24 rounds at most
    rank = F.lit(None).cast("int")
    for n, k in RANKS.items():
        rank = F.when(F.size("r") == n, F.lit(k)).otherwise(rank)
    rows = rows.withColumn("k", rank).where("k IS NOT NULL")
    return rows.select("cell", F.size("r").alias("rounds"), F.expr("r[k - 1]").alias("low"), F.expr("r[size(r) - k]").alias("high"))


def _beta(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    import math

    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    f = c = 1.0
    d = 0.0
    for i in range(300):
        m = i // 2
        num = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or 1e-300)
        c = 1 + num / c or 1e-300
        f *= c * d
        if abs(c * d - 1) < 1e-12:
            break
    return front * (f - 1)


def welch_p(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t; for a few aggregated rows."""

    @F.pandas_udf("double")
    def run(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([_beta(n / (n + x * x), n / 2, 0.5) if n > 0 else 1.0 for x, n in zip(t, df)])

    return run(t, df)


def welch(runs: DataFrame, key: str, side: str, metric: str) -> DataFrame:
    """Of each side the number, mean, median, sample variance (0 of one value) and coefficient of variation in percent; Welch's t, its degrees
    of freedom and p-value, null where a side has fewer than two values. Sides without any spread: t 0, and a p-value near 0 unless they are equal."""
    base, cand = F.when(~F.col(side), F.col(metric)), F.when(F.col(side), F.col(metric))
    stats = []
    for n, values in enumerate((base, cand)):
        stats += [F.count(values).alias(f"n{n}"), F.avg(values).alias(f"m{n}"), F.median(values).alias(f"median{n}"), F.coalesce(F.var_samp(values), F.lit(0.0)).alias(f"v{n}")]
    t = runs.groupBy(key).agg(*stats)
    s0, s1 = F.col("v0") / F.col("n0"), F.col("v1") / F.col("n1")
    enough, flat = (F.col("n0") >= 2) & (F.col("n1") >= 2), (s0 + s1) <= 0
    t = t.withColumn("t", F.when(enough & flat, 0.0).when(enough, (F.col("m0") - F.col("m1")) / F.sqrt(s0 + s1)))
    free = (s0 + s1) ** 2 / (s0**2 / F.greatest(F.col("n0") - 1, F.lit(1)) + s1**2 / F.greatest(F.col("n1") - 1, F.lit(1)))
    t = t.withColumn("df", F.when(enough & flat, (F.col("n0") + F.col("n1") - 2).cast("double")).when(enough, free))
    p = F.when(enough & flat, F.when(F.col("m0") == F.col("m1"), 0.0).otherwise(1e-12)).when(enough, welch_p(F.coalesce("t", F.lit(0.0)), F.coalesce("df", F.lit(1.0))))
    cv = lambda n: F.when((F.col(f"n{n}") >= 2) & (F.col(f"m{n}") != 0), F.sqrt(f"v{n}") / F.col(f"m{n}") * 100)
    return t.withColumn("p", p).withColumn("cv0", cv(0)).withColumn("cv1", cv(1))


def regression_verdict(runs: DataFrame, key: str, side: str, metric: str, higher_is_worse: bool, alpha: float = 0.05, least_pct: float = 3.0, inconclusive_pct: float = 10.0) -> DataFrame:
    """The change of the median in percent, and a status: regression where it is for the worse, significant and at least least_pct; inconclusive
    where it is for the worse and at least inconclusive_pct, but no regression; insufficient_data without values on both sides; else ok."""
    t = welch(runs, key, side, metric)
    change = F.when(F.col("median0") == 0, 0.0).otherwise((F.col("median1") - F.col("median0")) / F.nullif("median0", F.lit(0.0)) * 100)
    t = t.withColumn("pct_change", change)
    worse = F.col("pct_change") > 0 if higher_is_worse else F.col("pct_change") < 0
    size = F.abs("pct_change")
    status = F.when((F.col("n0") == 0) | (F.col("n1") == 0), "insufficient_data").when(worse & F.coalesce(F.col("p") < alpha, F.lit(False)) & (size >= least_pct), "regression")
    status = status.when(worse & (size >= inconclusive_pct), "inconclusive").otherwise("ok")
    return t.select(key, "n0", "n1", "median0", "median1", "pct_change", "t", "df", "p", "cv0", "cv1", status.alias("status"))


#: A run as its log line gives it.
RUN = "run_id string, session_id string, timestamp string, git_sha string, success boolean, workload struct<name:string,size:int>, host_info struct<host:string>, metrics struct<cents:double>"


def load_runs(spark: SparkSession, path: str) -> DataFrame:
    """A JSONL log of runs, flat: one row for each line that is a run, in any order; other lines are left out."""
    lines = spark.read.schema(f"{RUN}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    return lines.where("_bad IS NULL AND run_id IS NOT NULL").select("run_id", F.col("session_id").alias("session"), F.to_timestamp("timestamp").alias("at"), "git_sha", (~F.coalesce("success", F.lit(False))).alias("failed"), "workload.name", "workload.size", "host_info.host", "metrics.cents")


def write_report(rows: DataFrame, path: str, form: str) -> None:
    """A report as CSV (with names) or Parquet; csv's only bounded input are aggregated rows."""
    writer = rows.write.mode("overwrite")
    writer.option("header", True).csv(path) if form == "csv" else writer.parquet(path)


def reservoir(rows: DataFrame, by: list[str], key: str, n: int, seed: int = 42) -> DataFrame:
    """A uniform sample of n rows of each group (all, if it has fewer), the same for the same seed: those of the least digests of seed and key.

    A group's rows are first reduced within slices of the digest, then once more, so that no group has to be in one task.
    """
    hashed = rows.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))))
    for part in ([F.substring("_h", 1, 2)], []):
        order = Window.partitionBy(*by, *part).orderBy("_h", key)
        hashed = hashed.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")
    return hashed.drop("_h")


def latest_session(runs: DataFrame) -> DataFrame:
    """Runs of the session whose last run is the latest."""
    last = runs.groupBy("session").agg(F.max("ts_us").alias("t")).orderBy(F.desc("t"), "session").limit(1)
    return runs.join(F.broadcast(last.select("session")), "session", "left_semi")
