"""Ordering, sampling and queue operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import first_by


def in_order(values: Sequence[str], col: str) -> Column:
    """The place of a value in a list, for sorting; others come last."""
    at = F.array_position(F.array(*map(F.lit, values)), F.col(col))
    return F.when(at > 0, at).otherwise(len(values) + 1)


def dedup_first(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    return first_by(df, keys, *(F.col(c).asc() for c in order))


def dedup_last(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    return first_by(df, keys, *(F.col(c).desc() for c in order))


def stratified_sample(df: DataFrame, strata: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of each stratum (all, if it has no more), by the least hash of key and seed."""
    h = F.sha2(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")), 256)
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(strata).orderBy(h, key))).where(F.col("_rank") <= n).drop("_rank")


def hash_sample(df: DataFrame, key: str, percent: int, seed: int = 42) -> DataFrame:
    """About ``percent`` of the rows, the same ones each time."""
    h = F.conv(F.substring(F.sha2(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")), 256), 1, 8), 16, 10).cast("long")
    return df.where(h % 100 < percent)


def claim(jobs: DataFrame, order: str, model: str | None = None) -> DataFrame:
    """The pending job that comes first."""
    if model is not None:
        jobs = jobs.where(F.col("model") == model)
    return jobs.where("status = 'pending'").orderBy(order).limit(1)


def reset_stale(jobs: DataFrame, as_of: str, minutes: int) -> DataFrame:
    """In-progress jobs claimed ``minutes`` before as_of or earlier are pending again; ``was_reset`` marks them."""
    limit = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {minutes} minutes")
    stale = F.coalesce((F.col("status") == "in_progress") & (F.col("claimed_at") <= limit), F.lit(False))
    return jobs.withColumn("was_reset", stale).withColumns({"status": F.when(stale, "pending").otherwise(F.col("status")), "claimed_at": F.when(~stale, F.col("claimed_at"))})


def latest_state(events: DataFrame, key: str, *order: str) -> DataFrame:
    """The state of each key after all its events."""
    return dedup_last(events, [key], *order)


def normalised(df: DataFrame, name: str, up: Sequence[str], down: Sequence[str]) -> DataFrame:
    """Each column scaled to 0..1 over all rows, better being higher, 0.5 where it is constant; overall is the mean.

    df is a metric table, a row per model: its extremes are one row, joined to the rest.
    """
    cols = [*up, *down]
    ends = df.agg(*(f(c).alias(f"_{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))))
    out = df.crossJoin(F.broadcast(ends))
    for c in cols:
        span = F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
        place = (F.col(c) - F.col(f"_lo_{c}")) / span
        out = out.withColumn(f"norm_{c}", F.when(span > 0, place if c in up else 1 - place).otherwise(0.5))
    overall = sum((F.col(f"norm_{c}") for c in cols[1:]), F.col(f"norm_{cols[0]}")) / len(cols)
    return out.select(name, *(F.round(f"norm_{c}", 6).alias(f"norm_{c}") for c in cols), F.round(overall, 6).alias("overall"))


def quadrants(df: DataFrame, name: str, x: str, y: str, size: str) -> DataFrame:
    """Above or below the medians of x and y, and a bubble size."""
    mid = df.agg(F.median(x).alias("_mx"), F.median(y).alias("_my"))
    side = lambda c, m: F.when(F.col(c) >= F.col(m), "high").otherwise("low")
    return df.crossJoin(F.broadcast(mid)).select(name, F.concat(side(x, "_mx"), F.lit("_"), side(y, "_my")).alias("quadrant"), F.least(F.greatest(F.col(size) * 3, F.lit(30)), F.lit(400)).alias("bubble"))


def inverted(df: DataFrame, name: str, col: str) -> DataFrame:
    """The largest value of col less the row's."""
    top = df.agg(F.max(col).alias("_top"))
    return df.crossJoin(F.broadcast(top)).select(name, F.round(F.col("_top") - F.col(col), 6).alias("quality"))


def throughput(events: DataFrame, as_of: str, minutes: int, remaining: int) -> DataFrame:
    """Rate over the last minutes, (n - 1) / span, and the seconds that the remaining jobs take at it."""
    end = F.lit(as_of).cast("timestamp_ntz")
    late = events.where((F.col("ts") >= end - F.expr(f"interval {minutes} minutes")) & (F.col("ts") <= end))
    stats = late.agg(F.count("ts").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    span = F.unix_micros(F.col("b").cast("timestamp")) - F.unix_micros(F.col("a").cast("timestamp"))
    rate = F.when((F.col("n") >= 2) & (span > 0), (F.col("n") - 1) * 1e6 / span)
    return stats.select("n", F.round(rate, 6).alias("rate"), F.when(rate > 0, (remaining / rate).cast("long")).alias("eta_seconds"))


def monitor_rate(events: DataFrame, last: int = 600, least: int = 10) -> DataFrame:
    """n / span of the last rows by time."""
    tail = events.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(last)
    stats = tail.agg(F.count("ts").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    span = F.unix_micros(F.col("b").cast("timestamp")) - F.unix_micros(F.col("a").cast("timestamp"))
    return stats.select("n", F.round(F.when((F.col("n") >= least) & (span > 0), F.col("n") * 1e6 / span).otherwise(0.0), 6).alias("rate"))
