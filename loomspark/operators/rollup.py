"""Operational rollups of event, error, metric and feedback rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = (5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000, 30000)


def histogram(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, le, n): cumulative counts at fixed bounds and for all."""
    counts = [F.count_if(F.col(value) <= b).alias(f"b{b}") for b in BUCKETS]
    x = df.groupBy(by).agg(*counts, F.count(value).alias("bInf"))
    pairs = F.array(*[F.struct(F.lit(str(b)).alias("le"), F.col(f"b{b}").alias("n")) for b in (*BUCKETS, "Inf")])
    return x.select(by, F.explode(pairs).alias("e")).select(by, "e.le", "e.n")


def summary(df: DataFrame, by: str, value: str) -> DataFrame:
    return df.groupBy(by).agg(F.count(value).alias("n"), F.round(F.sum(value), 4).alias("total"), F.round(F.avg(value), 4).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))


def indexed_quantile(df: DataFrame, by: str, value: str, q: float) -> DataFrame:
    """sorted[min(int(n * q), n - 1)] of each group: no group's values are gathered or sorted.

    Values are counted in three ranges about an approximate quantile; only the range that holds the wanted rank is ranked, by its distinct
    values. The approximation decides how much is ranked, never the result.
    """
    x = df.where(F.col(value).isNotNull()).select(F.col(by).alias("_by"), F.col(value).alias("_v"))
    near = F.percentile_approx("_v", [max(q - 0.001, 0.0), min(q + 0.001, 1.0)], F.lit(10000))
    bounds = x.groupBy(F.col("_by").alias("_g")).agg(near.alias("_b"))
    ranged = x.join(F.broadcast(bounds), F.equal_null("_by", "_g")).select("_by", "_v", F.when(F.col("_v") < F.col("_b")[0], 0).when(F.col("_v") <= F.col("_b")[1], 1).otherwise(2).alias("_r"))
    counts = ranged.groupBy("_by").agg(*[F.count_if(F.col("_r") == k).alias(f"_n{k}") for k in range(3)])
    n = F.col("_n0") + F.col("_n1") + F.col("_n2")
    at = counts.withColumn("_k", F.least(F.floor(n * q), n - 1) + 1)
    held = F.when(F.col("_k") <= F.col("_n0"), 0).when(F.col("_k") <= F.col("_n0") + F.col("_n1"), 1).otherwise(2)
    before = F.when(held == 0, 0).when(held == 1, F.col("_n0")).otherwise(F.col("_n0") + F.col("_n1"))
    at = at.select(F.col("_by").alias("_g"), held.alias("_held"), (F.col("_k") - before).alias("_k"))
    few = ranged.join(F.broadcast(at), F.equal_null("_by", "_g") & (F.col("_r") == F.col("_held"))).groupBy("_by", "_v", "_k").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy("_by").orderBy("_v"))
    found = few.select("_by", "_v", "_k", "_c", upto.alias("_upto")).where((F.col("_upto") >= F.col("_k")) & (F.col("_upto") - F.col("_c") < F.col("_k")))
    return found.select(F.col("_by").alias(by), F.col("_v").alias("quantile"))


def fingerprint(kind: Column, message: Column) -> Column:
    return F.substring(F.md5(F.concat_ws(":", kind, message)), 1, 16)


def error_rollup(errors: DataFrame) -> DataFrame:
    """Errors(type, message, ts, stack) by fingerprint: count, first and last seen, the first stack that there is."""
    x = errors.withColumn("fingerprint", fingerprint(F.col("type"), F.col("message")))
    return x.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.min_by("stack", F.when(F.col("stack").isNotNull(), F.col("ts"))).alias("stack"))


def feedback_stats(feedback: DataFrame) -> DataFrame:
    return feedback.agg(F.round(F.avg("rating"), 2).alias("mean"), *[F.count_if(F.col("rating") == k).alias(f"n{k}") for k in range(1, 6)])


def ab_stats(feedback: DataFrame) -> DataFrame:
    """Means and counts of the variants; a row without one counts as A."""
    v = F.coalesce("variant", F.lit("A"))
    a, b = F.avg(F.when(v == "A", F.col("rating"))), F.avg(F.when(v == "B", F.col("rating")))
    return feedback.agg(F.round(a, 6).alias("mean_a"), F.round(b, 6).alias("mean_b"), F.count_if(v == "A").alias("n_a"), F.count_if(v == "B").alias("n_b"), F.round((b - a) / a * 100, 4).alias("improvement"))


def sliding_count(df: DataFrame, key: str, ts: str, seconds: int = 60) -> DataFrame:
    """How many rows of the key fall in the ``seconds`` before each row (itself included, those exactly that old not)."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(at).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return df.withColumn("recent", F.count("*").over(w))


def newest(df: DataFrame, key: str, order: list, n: int) -> DataFrame:
    """A ring buffer's content: the last ``n`` rows of each key."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_k") <= n).drop("_k")


def prometheus(metrics: DataFrame) -> DataFrame:
    """Metric lines ``name{le="..."} n`` of histogram rows; names keep letters, digits and underscores."""
    name = F.regexp_replace(F.col("metric"), "[^A-Za-z0-9_]", "_")
    return metrics.select(F.concat(name, F.lit('_bucket{le="'), "le", F.lit('"} '), F.col("n").cast("string")).alias("line"))
