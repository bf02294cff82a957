"""Aggregations. A group-by drops null keys; averages skip nulls and count booleans as 0 and 1."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import direction_correct, score_t1, score_t3
from ..schemas import DIFFICULTIES, STATUSES

def mean(col: str) -> Column:
    return F.round(F.avg(F.col(col).cast("double")), 6)


def std(col: str) -> Column:
    return F.round(F.stddev_samp(F.col(col).cast("double")), 6)


def median(col: str) -> Column:
    return F.round(F.median(F.col(col).cast("double")), 6)


_STATS = {"mean": mean, "std": std, "median": median, "count": lambda c: F.count(c)}


def grouped(df: DataFrame, keys: Iterable[str], **measures: str) -> DataFrame:
    """Group-by without null keys; measures: name='stat:column'. Measures of absent columns are left out."""
    keys = list(keys)
    aggs = [_STATS[stat](col).alias(name) for name, (stat, col) in ((n, m.split(":")) for n, m in measures.items()) if col in df.columns]
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    return df.groupBy(*keys).agg(*aggs)


def flat(**stats: str) -> dict[str, str]:
    """column='mean std' becomes column_mean='mean:column' and so on."""
    return {f"{c}_{s}": f"{s}:{c}" for c, some in stats.items() for s in some.split()}


BY_MODEL = flat(
    t1_absolute_error="mean std median", t2_cpl="mean std median", t1_direction_correct="mean", t2_legal="mean", t3_p1_side_correct="mean",
    t3_p2_theme_correct="mean", t3_score="mean std", job_id="count", inference_ms="mean median", t1_relative_error="mean median",
    t1_abs_error_excl_mate="mean", t2_cpl_clamped="mean", t2_wp_loss="mean", t2_legal_attempted="mean", t3_p2_theme_v2="mean", t3_score_v2="mean",
    t1_direction_correct_t0="mean", t1_direction_correct_t50="mean", t1_direction_correct_t100="mean", t1_direction_correct_t200="mean",
)


def by_model(df: DataFrame) -> DataFrame:
    return grouped(df, ["model"], **BY_MODEL)


def _means(*cols: str) -> dict[str, str]:
    return {c: f"mean:{c}" for c in cols} | {"job_id": "count:job_id"}


def by_difficulty(df: DataFrame) -> DataFrame:
    cols = ("t1_absolute_error", "t1_direction_correct", "t2_legal", "t2_cpl", "t3_score", "t1_relative_error", "t1_abs_error_excl_mate", "t2_cpl_clamped", "t2_wp_loss", "t2_legal_attempted", "t3_score_v2")
    return grouped(df, ["model", "difficulty"], **_means(*cols))


def by_phase(df: DataFrame) -> DataFrame:
    return grouped(df, ["model", "phase"], **_means("t1_absolute_error", "t2_legal", "t3_score"))


def by_source(df: DataFrame) -> DataFrame:
    return grouped(df, ["model", "source"], **_means("t1_absolute_error", "t2_legal", "t2_cpl", "t3_score"))


def by_family(df: DataFrame) -> DataFrame:
    return grouped(df, ["model_family", "model_size_b"], **_means("t1_absolute_error", "t2_legal", "t2_cpl", "t3_score"))


def hallucination_rate(df: DataFrame) -> DataFrame:
    """Share of rows that are not legal, null counting as illegal."""
    df = df.withColumn("illegal", ~F.coalesce("t2_legal", F.lit(False)))
    return grouped(df, ["model", "difficulty"], hallucination_rate="mean:illegal", total="count:illegal")


SUMMARY = (
    "t1_absolute_error", "t1_abs_error_excl_mate", "t1_relative_error", "t1_direction_correct", "t1_direction_correct_t0", "t1_direction_correct_t50",
    "t1_direction_correct_t100", "t1_direction_correct_t200", "t2_legal", "t2_legal_attempted", "t2_cpl", "t2_cpl_clamped", "t2_wp_loss", "t3_score", "t3_score_v2",
)


def summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total_jobs"), F.countDistinct("model").alias("models_tested"), F.countDistinct("position_id").alias("positions_tested"),
        *(mean(c).alias(c) for c in SUMMARY if c in df.columns),
    )


def profile(positions: DataFrame, dims: Iterable[str] = ("difficulty", "phase", "source", "theme")) -> DataFrame:
    """(dim, value, n): a histogram for each dimension and the total, in one pass over the rows."""
    dims = list(dims)
    named = positions.select(*(F.coalesce(c, F.lit("unknown")).alias(c) for c in dims))
    pairs = F.array(F.struct(F.lit("total").alias("dim"), F.lit("all").alias("value")), *(F.struct(F.lit(c).alias("dim"), F.col(c).alias("value")) for c in dims))
    return named.select(F.inline(pairs)).groupBy("dim", "value").agg(F.count(F.lit(1)).alias("n"))


def status_pivot(jobs: DataFrame, models: Iterable[str] | None = None) -> DataFrame:
    if models is not None:
        jobs = jobs.where(F.col("model").isin(*models))
    return jobs.groupBy("model").agg(*(F.count_if(F.col("status") == s).alias(s) for s in STATUSES), F.count(F.lit(1)).alias("total"))


def job_progress(jobs: DataFrame) -> DataFrame:
    over = F.count_if(F.col("status").isin("done", "failed"))
    percent = F.coalesce(F.try_divide(over * 100.0, F.count(F.lit(1))), F.lit(0.0))
    return jobs.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in STATUSES), F.round(percent, 6).alias("percent"))


def dashboard(df: DataFrame, keys: Iterable[str], models: Iterable[str]) -> DataFrame:
    """Conditional means per key: a prompt format that asks for one task only says nothing of the others."""
    fmt = F.coalesce("prompt_format", F.lit(""))
    t1, t2 = ~fmt.isin("move_only", "explanation_only"), ~fmt.isin("eval_only", "explanation_only")
    right = direction_correct(F.col("t1_model_eval"), F.col("t1_stockfish_eval"), 100)
    shown = df.where(F.col("model").isin(*models)).withColumn("difficulty", F.coalesce("difficulty", F.lit("unknown")))
    avg = lambda c: F.round(F.avg(c.cast("double")), 6)
    return shown.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        avg(F.when(t1, F.col("t1_absolute_error"))).alias("t1_error"),
        avg(F.when(t1, right)).alias("t1_direction"),
        avg(F.when(t2, F.coalesce("t2_legal", F.lit(False)))).alias("t2_legal"),
        avg(F.col("t2_cpl")).alias("t2_cpl"),
        avg(F.col("t3_score")).alias("t3_score"),
    )


def completion(df: DataFrame, models: DataFrame, target: int, enough: int) -> DataFrame:
    """For each model and tier the count, whether it is complete, and the percentage; tiers without rows count 0."""
    tiers = models.sparkSession.createDataFrame([(t, k) for k, t in enumerate(DIFFICULTIES)], "difficulty string, tier_order int")
    counts = df.groupBy("model", "difficulty").agg(F.count(F.lit(1)).alias("n"))
    grid = F.broadcast(models.select("model").crossJoin(tiers))
    out = grid.join(counts, ["model", "difficulty"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select("model", "difficulty", "tier_order", "n", (F.col("n") >= enough).alias("complete"), F.bround(F.col("n") * 100.0 / target, 1).alias("percent"))


def first_incomplete(df: DataFrame, models: DataFrame, target: int, enough: int) -> DataFrame:
    """For each model the first tier, in their order, that is not complete; models that are done have none."""
    return completion(df, models, target, enough).where("not complete").groupBy("model").agg(F.min_by("difficulty", "tier_order").alias("difficulty"))


def ranked(df: DataFrame, col: str) -> DataFrame:
    """Rows that have a value, largest first."""
    return df.where(F.col(col).isNotNull()).orderBy(F.col(col).desc())


def family_profile(df: DataFrame, meta: DataFrame) -> DataFrame:
    """Mean and deviation, per family and tier, of the models' means."""
    one = grouped(df, ["model", "difficulty"], cpl="mean:t2_cpl")
    return one.join(F.broadcast(meta.select("model", "family")), "model").groupBy("family", "difficulty").agg(mean("cpl").alias("cpl_mean"), std("cpl").alias("cpl_std"), F.count("cpl").alias("n_models"))


def family_scaling(df: DataFrame) -> DataFrame:
    """Smallest against largest size of each family that has two sizes or more."""
    sizes = grouped(df.where(F.col("model_size_b").isNotNull()), ["model_family", "model_size_b"], t1="mean:t1_absolute_error", t2="mean:t2_cpl", t3="mean:t3_score")
    ends = sizes.groupBy("model_family").agg(
        F.count(F.lit(1)).alias("n_sizes"), F.min("model_size_b").alias("small"), F.max("model_size_b").alias("large"),
        *(f(c, "model_size_b").alias(f"{c}_{n}") for c in ("t1", "t2", "t3") for n, f in (("small", F.min_by), ("large", F.max_by))),
    ).where("n_sizes >= 2")
    better = {"better_t1": F.col("t1_large") < F.col("t1_small"), "better_t2": F.col("t2_large") < F.col("t2_small"), "better_t3": F.col("t3_large") > F.col("t3_small")}
    out = ends.select("model_family", "small", "large", *(F.coalesce(v, F.lit(False)).alias(k) for k, v in better.items()))
    return out.withColumn("all_better", F.col("better_t1") & F.col("better_t2") & F.col("better_t3"))


def validation_report(df: DataFrame) -> DataFrame:
    return df.groupBy("model").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("t2_legal")).alias("legal"), F.count_if(F.col("t1_model_eval").isNull()).alias("no_eval"),
        F.count_if(F.col("t2_move").isNull()).alias("no_move"), F.count_if(F.col("t3_explanation").isNull()).alias("no_explanation"),
        F.round(F.count_if(F.col("t2_legal")) * 100.0 / F.count(F.lit(1)), 6).alias("legal_percent"), mean("t3_score").alias("t3_mean"),
        F.array_join(F.array_sort(F.collect_set("difficulty")), ",").alias("tiers"),
    )


def validation_issues(df: DataFrame, legal: Column | None = None) -> DataFrame:
    """(model, job_id, field, stored, recalculated) of every stored score that scoring again does not give; ``legal`` is the legality of the move, where it is judged again."""
    c = F.col
    again = score_t1(c("t1_model_eval"), c("t1_stockfish_eval")) | score_t3(c("t3_explanation"), c("t3_side_claimed"), c("t1_stockfish_eval"), c("theme"))
    if legal is not None:
        again["t2_legal"] = legal
    fields = [F.struct(F.lit(k).alias("field"), c(k).cast("string").alias("stored"), v.cast("string").alias("recalculated")) for k, v in again.items() if k in df.columns and k != "t3_score"]
    wrong = F.filter(F.array(*fields), lambda x: ~x["stored"].eqNullSafe(x["recalculated"]))
    return df.select("model", "job_id", F.inline(wrong))


def issue_report(issues: DataFrame, cap: int = 10, parts: int = 64) -> DataFrame:
    """Per model the number of jobs with issues and of issues, the first ``cap`` of them by job and field, and how many more there are. Firsts are taken in parts before they meet."""
    line = F.concat_ws(" ", F.concat("job_id", F.lit(":")), "field", F.concat(F.lit("stored="), F.coalesce("stored", F.lit("none"))), F.concat(F.lit("recalculated="), F.coalesce("recalculated", F.lit("none"))))
    part = F.pmod(F.xxhash64("job_id"), F.lit(parts))
    first = issues.select("model", "job_id", "field", line.alias("line"), part.alias("part"))
    for keys in (["model", "part"], ["model"]):
        first = first.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("job_id", "field"))).where(F.col("_k") <= cap)
    lines = first.groupBy("model").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "line"))), lambda x: x["line"]), "; ").alias("first"))
    counts = issues.groupBy("model").agg(F.count_distinct("job_id").alias("jobs"), F.count(F.lit(1)).alias("issues"))
    return counts.join(lines, "model").select("model", "jobs", "issues", "first", F.greatest(F.col("issues") - cap, F.lit(0)).alias("more"))


def cpl_buckets(df: DataFrame, bounds: Iterable[int] = (25, 100, 500, 1000)) -> DataFrame:
    """Counts and shares of losses per half-open bucket."""
    bounds = list(bounds)
    label = F.lit(f">={bounds[-1]}")
    for k in reversed(range(len(bounds))):
        label = F.when(F.col("t2_cpl") < bounds[k], f"<{bounds[0]}" if k == 0 else f"{bounds[k - 1]}-{bounds[k]}").otherwise(label)
    n = df.where("t2_cpl is not null").groupBy(label.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    # One row per bucket: the only window without partitions.
    return n.select("bucket", "n", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 6).alias("share"))


def blunders(df: DataFrame, limit: int = 1000) -> DataFrame:
    over = F.when(F.col("t2_cpl").isNotNull(), F.col("t2_cpl") >= limit)
    return df.where("model is not null").groupBy("model").agg(
        F.count("t2_cpl").alias("n"), F.round(F.avg(over.cast("double")), 6).alias("blunder_rate"), F.round(F.avg(F.when(~over, F.col("t2_cpl"))), 6).alias("mean_unsaturated")
    )


def active_model(df: DataFrame, target: int) -> DataFrame:
    """Of the models with fewer rows than the target, the one with the latest row."""
    latest = df.where("model is not null").groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("latest")).where(F.col("n") < target)
    return latest.agg(F.max(F.struct("latest", "model")).alias("top")).select("top.model", "top.latest")


def job_estimate(positions: DataFrame, models: int, formats: int, share: float = 0.2) -> DataFrame:
    n = F.count(F.lit(1)) * models * formats
    corrections = (n * share * 2).cast("long")
    return positions.agg(F.count(F.lit(1)).alias("positions"), n.alias("standard_jobs"), corrections.alias("correction_jobs"), (n + corrections).alias("total_jobs"))
