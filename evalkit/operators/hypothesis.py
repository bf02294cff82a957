"""Hypothesis tests and agreement statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..schemas import DIFFICULTIES, PHASES


def _ordered(df: DataFrame, key: str, order: Sequence[str], value: Column) -> DataFrame:
    """One row: ``v``, the means per key in the given order, without nulls. The key has as many values as the order."""
    means = df.where(F.col(key).isin(*order)).groupBy(key).agg(F.round(F.avg(value.cast("double")), 9).alias("m"))
    place = F.array_position(F.array(*map(F.lit, order)), F.col(key))
    listed = F.array_sort(F.collect_list(F.when(F.col("m").isNotNull(), F.struct(place.alias("k"), "m"))))
    return means.agg(F.transform(listed, lambda s: s["m"]).alias("v"))


def _steps(v: Column, rising: bool, strict: bool = False) -> Column:
    n = F.size(v)
    pairs = F.arrays_zip(F.slice(v, 1, F.greatest(n - 1, F.lit(0))).alias("a"), F.slice(v, 2, F.greatest(n - 1, F.lit(0))).alias("b"))
    if strict:
        return F.forall(pairs, lambda p: p["a"] < p["b"] if rising else p["a"] > p["b"])
    return F.forall(pairs, lambda p: p["a"] <= p["b"] if rising else p["a"] >= p["b"])


def _trend(v: Column, rising: bool) -> Column:
    """Monotonic at every step, and different at the ends; fewer than two values never support a trend."""
    ends = F.get(v, 0) < F.get(v, F.size(v) - 1) if rising else F.get(v, 0) > F.get(v, F.size(v) - 1)
    return F.when(F.size(v) < 2, False).otherwise(_steps(v, rising) & ends)


def trends(df: DataFrame, metrics: dict[str, tuple[str, bool]], order: Sequence[str] = DIFFICULTIES, key: str = "difficulty") -> DataFrame:
    """(metric, supported) for each metric: name to (column, whether it should rise)."""
    out = None
    for name, (col, rising) in metrics.items():
        row = _ordered(df, key, order, F.col(col)).select(F.lit(name).alias("metric"), _trend(F.col("v"), rising).alias("supported"))
        out = row if out is None else out.unionByName(row)
    return out


def h1(df: DataFrame) -> DataFrame:
    return trends(df, {"absolute_error": ("t1_absolute_error", True), "relative_error": ("t1_relative_error", True), "direction_accuracy": ("t1_direction_correct", False)})


def h2(df: DataFrame) -> DataFrame:
    return trends(df, {"absolute_cpl": ("t2_cpl", True), "clamped_cpl": ("t2_cpl_clamped", True), "wp_loss": ("t2_wp_loss", True)})


def h3(df: DataFrame) -> DataFrame:
    """Weakly falling scores: a flat series passes, a tier whose scores are all missing fails."""
    means = df.where(F.col("difficulty").isin(*DIFFICULTIES)).groupBy("difficulty").agg(F.count("t3_score").alias("n"))
    gaps = means.agg(F.coalesce(F.bool_or(F.col("n") == 0), F.lit(False)).alias("gap"))
    v = _ordered(df, "difficulty", DIFFICULTIES, F.col("t3_score")).crossJoin(gaps)
    return v.select(F.lit("t3_score").alias("metric"), ((F.size("v") >= 2) & ~F.col("gap") & _steps(F.col("v"), False)).alias("supported"))


def h4(scaling: DataFrame) -> DataFrame:
    """True if every family with two sizes is better in all at its largest; also if there is none."""
    return scaling.agg(F.count(F.lit(1)).alias("families"), F.coalesce(F.bool_and("all_better"), F.lit(True)).alias("supported"))


def h5(df: DataFrame) -> DataFrame:
    """Strictly falling gap between explanation score and legality from opening to endgame; takes all three phases."""
    means = df.where(F.col("phase").isin(*PHASES)).groupBy("phase").agg(F.avg(F.col("t3_score_v2").cast("double")).alias("t3"), F.avg(F.col("t2_legal_attempted").cast("double")).alias("t2"))
    gaps = means.select("phase", F.round(F.col("t3") / 2 - F.col("t2"), 9).alias("gap"))
    v = _ordered(gaps, "phase", PHASES, F.col("gap"))
    return v.select(F.lit("gap").alias("metric"), ((F.size("v") == 3) & _steps(F.col("v"), False, strict=True)).alias("supported"))


def direction_baselines(positions: DataFrame) -> DataFrame:
    """Class shares of the truth at each threshold, and the accuracy of always naming the largest class."""
    marks = F.array(*(F.struct(F.lit(t).alias("threshold"), X.direction(F.col("t1_stockfish_eval"), t).alias("side")) for t in X.THRESHOLDS))
    rows = positions.where("t1_stockfish_eval is not null").select(F.inline(marks))
    n = F.count(F.lit(1))
    share = {s: F.count_if(F.col("side") == s) / n for s in ("White", "Black", "Equal")}
    return rows.groupBy("threshold").agg(n.alias("n"), *(F.round(v, 6).alias(s.lower()) for s, v in share.items()), F.round(F.greatest(*share.values()), 6).alias("majority"))


def agreement(df: DataFrame) -> DataFrame:
    """Cohen's kappa and balanced accuracy per model and threshold; kappa is null if one class is all there is."""
    sides = ("White", "Black", "Equal")
    marks = F.array(*(F.struct(F.lit(t).alias("threshold"), X.direction(F.col("t1_model_eval"), t).alias("said"), X.direction(F.col("t1_stockfish_eval"), t).alias("is")) for t in X.THRESHOLDS))
    rows = df.where("model is not null and t1_model_eval is not null and t1_stockfish_eval is not null").select("model", F.inline(marks))
    n = F.count(F.lit(1))
    table = rows.groupBy("model", "threshold").agg(
        n.alias("n"), F.count_if(F.col("said") == F.col("is")).alias("same"),
        *(F.count_if(F.col(c) == s).alias(f"{c}_{s}") for c in ("said", "is") for s in sides), *(F.count_if((F.col("said") == s) & (F.col("is") == s)).alias(f"hit_{s}") for s in sides),
    )
    observed = F.col("same") / F.col("n")
    chance = sum((F.col(f"said_{s}") * F.col(f"is_{s}") for s in sides[1:]), F.col("said_White") * F.col("is_White")) / (F.col("n") * F.col("n"))
    recalls = F.filter(F.array(*(F.try_divide(F.col(f"hit_{s}"), F.col(f"is_{s}")) for s in sides)), lambda r: r.isNotNull())
    balanced = F.aggregate(recalls, F.lit(0.0), lambda a, r: a + r) / F.size(recalls)
    return table.select("model", "threshold", "n", F.round(observed, 6).alias("accuracy"), F.round(F.try_divide(observed - chance, 1 - chance), 6).alias("kappa"), F.round(balanced, 6).alias("balanced_accuracy"))


def by_side(df: DataFrame) -> DataFrame:
    return (
        df.where("model is not null").withColumn("white", X.white_to_move(F.col("fen"))).where("white is not null")
        .groupBy("model", "white").agg(F.count("t1_direction_correct").alias("n"), F.round(F.avg(F.col("t1_direction_correct").cast("double")), 6).alias("direction"), F.round(F.avg(F.col("t2_cpl").cast("double")), 6).alias("cpl"))
    )


def spearman(df: DataFrame) -> DataFrame:
    """Rank correlation of answer and truth per model, without mates; ties share their average rank."""
    rows = df.where("model is not null and t1_model_eval is not null").where(F.abs("t1_stockfish_eval") < X.MATE_FLOOR).select("model", "t1_model_eval", "t1_stockfish_eval")
    for c in ("t1_model_eval", "t1_stockfish_eval"):
        ties = F.count(F.lit(1)).over(Window.partitionBy("model", c))
        rows = rows.withColumn(f"rank_{c}", F.rank().over(Window.partitionBy("model").orderBy(c)) + (ties - 1) / 2)
    return rows.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("rank_t1_model_eval", "rank_t1_stockfish_eval"), 6).alias("rho"))


def regime_split(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows before and after the last illegal move that was written down; rows without time are unknown."""
    cut = df.where("t2_move is not null and not t2_legal").agg(F.max(ts).alias("cutover"))
    regime = F.when(F.col(ts).isNull(), "unknown").when(F.col("cutover").isNull() | (F.col(ts) > F.col("cutover")), "after").otherwise("before")
    return df.crossJoin(F.broadcast(cut)).groupBy(regime.alias("regime")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("t2_legal").cast("double")), 6).alias("legal"))


def bootstrap(df: DataFrame, value: str, rounds: int = 20, key: str = "event_id") -> DataFrame:
    """Mean of value per model, and its spread over Poisson-like resamples drawn by hash: each row weighs 0, 1 or 2 in each round."""
    rows = df.where(F.col(value).isNotNull() & F.col("model").isNotNull()).select("model", key, F.col(value).alias("x")).withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    draw = F.conv(F.substring(F.sha2(F.concat(F.col(key).cast("string"), F.lit(":"), F.col("round").cast("string")), 256), 1, 8), 16, 10).cast("long") % 4
    weight = F.when(draw == 0, 0).when(draw == 3, 2).otherwise(1)
    means = rows.groupBy("model", "round").agg((F.sum(weight * F.col("x")) / F.sum(weight)).alias("m"))
    return means.groupBy("model").agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.min("m"), 6).alias("low"), F.round(F.max("m"), 6).alias("high"))
