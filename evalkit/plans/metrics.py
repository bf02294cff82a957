"""Metric tables, profiles and reports over the evaluation facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.themes import THEME_PHRASES
from ..operators import aggs
from ..operators.derive import derive
from .fixture import FAMILY_ORDER, MODELS, POSITIONS, THEMES, WITH, evals, pick, positions

_PHRASES = ", ".join(f"('{t}', '{p}')" for t in THEMES for p in [*THEME_PHRASES[t], "".join(" " + c.lower() if c.isupper() else c for c in t), t.lower()])
_SIDE = "CASE WHEN {x} > {t} THEN 1 WHEN {x} < -{t} THEN -1 ELSE 0 END"


def _same(t: int, m: str = "t1_model_eval", s: str = "t1_stockfish_eval") -> str:
    return f"CASE WHEN {m} IS NOT NULL AND {s} IS NOT NULL THEN ({_SIDE.format(x=m, t=t)}) = ({_SIDE.format(x=s, t=t)}) END"


_CL = "greatest(-1000, least(1000, {}))"
DERIVED = f"""{WITH}, d0 AS (
  SELECT *, split_part(fen, ' ', 2) = 'w' AS white,
    CASE WHEN t2_cpl IS NOT NULL THEN CASE WHEN split_part(fen, ' ', 2) = 'w' THEN t1_stockfish_eval - t2_cpl ELSE t1_stockfish_eval + t2_cpl END END AS after
  FROM evals
), phrases(theme, phrase) AS (VALUES {_PHRASES}),
named AS (SELECT e.event_id, max(CASE WHEN contains(lower(e.t3_explanation), p.phrase) THEN 1 ELSE 0 END) AS hit FROM evals e JOIN phrases p USING (theme) WHERE t3_explanation IS NOT NULL GROUP BY 1),
derived AS (
  SELECT d0.*, abs(t1_model_eval - t1_stockfish_eval) / greatest(abs(t1_stockfish_eval), 100)::DOUBLE AS t1_relative_error,
    CASE WHEN abs(t1_stockfish_eval) < 9000 THEN t1_absolute_error END AS t1_abs_error_excl_mate,
    {", ".join(f"{_same(t)} AS t1_direction_correct_t{t}" for t in X.THRESHOLDS)},
    {_same(50, "greatest(-2000, least(2000, t1_model_eval))", "greatest(-2000, least(2000, t1_stockfish_eval))").replace("greatest(-2000, least(2000, t1_model_eval)) IS NOT NULL", "t1_model_eval IS NOT NULL")} AS t1_direction_correct,
    CASE WHEN after IS NOT NULL THEN greatest(0.0::DOUBLE, (CASE WHEN white THEN 1 ELSE -1 END * ({_CL.format("t1_stockfish_eval")} - {_CL.format("after")}))::DOUBLE) END AS t2_cpl_clamped,
    CASE WHEN after IS NOT NULL THEN greatest(0.0::DOUBLE, CASE WHEN white THEN 1 ELSE -1 END * (1 / (1 + exp(-{_CL.format("t1_stockfish_eval")} / 400.0::DOUBLE)) - 1 / (1 + exp(-{_CL.format("after")} / 400.0::DOUBLE)))) * 1000 END AS t2_wp_loss,
    CASE WHEN t2_move IS NOT NULL THEN t2_legal END AS t2_legal_attempted, hit AS t3_p2_theme_v2, t3_p1_side_correct + hit AS t3_score_v2
  FROM d0 LEFT JOIN named ON d0.event_id = named.event_id
)"""


def derived(spark, d):
    return derive(evals(spark, d))


def _stat(stat: str, col: str) -> str:
    if stat == "count":
        return f"count({col})"
    return f"round({ {'mean': 'avg', 'std': 'stddev_samp', 'median': 'median'}[stat] }({col}::DOUBLE), 6)"


def _sql(keys: list[str], measures: dict[str, str], source: str = "derived") -> str:
    cols = ", ".join(f"{_stat(*m.split(':'))} AS {n}" for n, m in measures.items())
    return f"{DERIVED} SELECT {', '.join(keys)}, {cols} FROM {source} WHERE {' AND '.join(k + ' IS NOT NULL' for k in keys)} GROUP BY {', '.join(keys)}"


def _means(*cols: str) -> dict[str, str]:
    return {c: f"mean:{c}" for c in cols} | {"job_id": "count:job_id"}


def model_meta(spark):
    return spark.createDataFrame(list(MODELS), "model string, family string, size int")


_META = "meta(model, family, size) AS (VALUES " + ", ".join(f"('{m}', '{f}', {s})" for m, f, s in MODELS) + ")"
_NAMES = [m for m, _, _ in MODELS][:18]
_IN = ", ".join(f"'{m}'" for m in _NAMES)
_STATUS = ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("pending", "in_progress", "done", "failed"))


def _dash(keys: str) -> str:
    t1, t2 = "coalesce(prompt_format, '') NOT IN ('move_only', 'explanation_only')", "coalesce(prompt_format, '') NOT IN ('eval_only', 'explanation_only')"
    return f"""{DERIVED} SELECT {keys}, count(*) AS n, round(avg(CASE WHEN {t1} THEN t1_absolute_error END), 6) AS t1_error,
      round(avg(CASE WHEN {t1} THEN t1_direction_correct_t100::INT END), 6) AS t1_direction, round(avg(CASE WHEN {t2} THEN coalesce(t2_legal, false)::INT END), 6) AS t2_legal,
      round(avg(t2_cpl), 6) AS t2_cpl, round(avg(t3_score), 6) AS t3_score FROM derived WHERE model IN ({_IN}) GROUP BY {keys}"""


_FLAGS = ", ".join(f"avg({c}::DOUBLE)" for c in ("t1_absolute_error",))
_DIMS = ("difficulty", "phase", "source", "theme")

QUERIES = {
    "agg_by_model": (lambda s, d: aggs.by_model(derived(s, d)), _sql(["model"], aggs.BY_MODEL)),
    "agg_by_difficulty": (
        lambda s, d: aggs.by_difficulty(derived(s, d)),
        _sql(["model", "difficulty"], _means("t1_absolute_error", "t1_direction_correct", "t2_legal", "t2_cpl", "t3_score", "t1_relative_error", "t1_abs_error_excl_mate", "t2_cpl_clamped", "t2_wp_loss", "t2_legal_attempted", "t3_score_v2")),
    ),
    "agg_by_phase": (lambda s, d: aggs.by_phase(derived(s, d)), _sql(["model", "phase"], _means("t1_absolute_error", "t2_legal", "t3_score"))),
    "agg_by_source": (lambda s, d: aggs.by_source(derived(s, d)), _sql(["model", "source"], _means("t1_absolute_error", "t2_legal", "t2_cpl", "t3_score"))),
    "agg_by_family": (lambda s, d: aggs.by_family(derived(s, d)), _sql(["model_family", "model_size_b"], _means("t1_absolute_error", "t2_legal", "t2_cpl", "t3_score"))),
    "hallucination_rate": (
        lambda s, d: aggs.hallucination_rate(evals(s, d)),
        f"{WITH} SELECT model, difficulty, round(avg((NOT coalesce(t2_legal, false))::INT), 6) AS hallucination_rate, count(*) AS total FROM evals WHERE model IS NOT NULL GROUP BY model, difficulty",
    ),
    "global_summary": (
        lambda s, d: aggs.summary(derived(s, d)),
        f"{DERIVED} SELECT count(*) AS total_jobs, count(DISTINCT model) AS models_tested, count(DISTINCT position_id) AS positions_tested, "
        + ", ".join(f"round(avg({c}::DOUBLE), 6) AS {c}" for c in aggs.SUMMARY)
        + " FROM derived",
    ),
    "dataset_profile": (
        lambda s, d: aggs.profile(positions(evals(s, d))),
        f"{WITH}, pos AS ({POSITIONS}) SELECT 'total' AS dim, 'all' AS value, count(*) AS n FROM pos "
        + " ".join(f"UNION ALL SELECT '{c}', coalesce({c}, 'unknown'), count(*) FROM pos GROUP BY 2" for c in _DIMS),
    ),
    "job_status_pivot": (lambda s, d: aggs.status_pivot(evals(s, d), _NAMES), f"{WITH} SELECT model, {_STATUS}, count(*) AS total FROM evals WHERE model IN ({_IN}) GROUP BY model"),
    "job_progress": (
        lambda s, d: aggs.job_progress(evals(s, d)),
        f"{WITH} SELECT count(*) AS total, {_STATUS}, round(count(*) FILTER (status IN ('done', 'failed')) * 100.0::DOUBLE / count(*), 6) AS percent FROM evals",
    ),
    "job_counts": (
        lambda s, d: evals(s, d).groupBy("status").agg(F.count(F.lit(1)).alias("n")),
        f"{WITH} SELECT status, count(*) AS n FROM evals GROUP BY status",
    ),
    "dashboard_metrics_by_model": (lambda s, d: aggs.dashboard(evals(s, d), ["model"], _NAMES), _dash("model")),
    "dashboard_metrics_by_difficulty": (lambda s, d: aggs.dashboard(evals(s, d), ["model", "difficulty"], _NAMES), _dash("model, difficulty")),
    "pipeline_completion": (
        lambda s, d: aggs.completion(evals(s, d), model_meta(s), 120, 100),
        f"""{WITH}, {_META}, tiers(difficulty, tier_order) AS (VALUES ('easy', 0), ('medium', 1), ('hard', 2), ('extreme', 3)),
        c AS (SELECT model, difficulty, count(*) AS n FROM evals GROUP BY 1, 2)
        SELECT model, difficulty, tier_order, coalesce(n, 0) AS n, coalesce(n, 0) >= 100 AS complete, round_even(coalesce(n, 0) * 100.0::DOUBLE / 120, 1) AS percent
        FROM meta CROSS JOIN tiers LEFT JOIN c USING (model, difficulty)""",
    ),
    "family_profile": (
        lambda s, d: aggs.family_profile(evals(s, d), model_meta(s)),
        f"""{WITH}, {_META}, one AS (SELECT model, difficulty, round(avg(t2_cpl), 6) AS cpl FROM evals WHERE model IS NOT NULL GROUP BY 1, 2)
        SELECT family, difficulty, round(avg(cpl), 6) AS cpl_mean, round(stddev_samp(cpl), 6) AS cpl_std, count(cpl) AS n_models FROM one JOIN meta USING (model) GROUP BY 1, 2""",
    ),
    "family_series": (
        lambda s, d: aggs.grouped(evals(s, d), ["model", "difficulty"], cpl="mean:t2_cpl").join(F.broadcast(model_meta(s)), "model").select("family", "model", "size", "difficulty", "cpl"),
        f"{WITH}, {_META} SELECT family, model, size, difficulty, round(avg(t2_cpl), 6) AS cpl FROM evals JOIN meta USING (model) GROUP BY ALL",
    ),
    "validation_report": (
        lambda s, d: aggs.validation_report(evals(s, d)),
        f"""{WITH} SELECT model, count(*) AS total, count(*) FILTER (t2_legal) AS legal, count(*) FILTER (t1_model_eval IS NULL) AS no_eval, count(*) FILTER (t2_move IS NULL) AS no_move,
        count(*) FILTER (t3_explanation IS NULL) AS no_explanation, round(count(*) FILTER (t2_legal) * 100.0::DOUBLE / count(*), 6) AS legal_percent, round(avg(t3_score), 6) AS t3_mean,
        array_to_string(list_sort(list(DISTINCT difficulty)), ',') AS tiers FROM evals GROUP BY model""",
    ),
    "family_scaling": (
        lambda s, d: aggs.family_scaling(evals(s, d)),
        f"""{WITH}, sz AS (SELECT model_family, model_size_b, round(avg(t1_absolute_error), 6) t1, round(avg(t2_cpl), 6) t2, round(avg(t3_score), 6) t3 FROM evals WHERE model_family IS NOT NULL GROUP BY 1, 2),
        e AS (SELECT model_family, min(model_size_b) AS small, max(model_size_b) AS "large", count(*) AS n, arg_min(t1, model_size_b) a1, arg_max(t1, model_size_b) b1, arg_min(t2, model_size_b) a2,
          arg_max(t2, model_size_b) b2, arg_min(t3, model_size_b) a3, arg_max(t3, model_size_b) b3 FROM sz GROUP BY 1 HAVING count(*) >= 2)
        SELECT model_family, small, "large", b1 < a1 AS better_t1, b2 < a2 AS better_t2, b3 > a3 AS better_t3, b1 < a1 AND b2 < a2 AND b3 > a3 AS all_better FROM e""",
    ),
    "cpl_buckets": (
        lambda s, d: aggs.cpl_buckets(evals(s, d)),
        f"""{WITH}, n AS (SELECT CASE WHEN t2_cpl < 25 THEN '<25' WHEN t2_cpl < 100 THEN '25-100' WHEN t2_cpl < 500 THEN '100-500' WHEN t2_cpl < 1000 THEN '500-1000' ELSE '>=1000' END AS bucket,
        count(*) AS n FROM evals WHERE t2_cpl IS NOT NULL GROUP BY 1) SELECT bucket, n, round(n * 100.0::DOUBLE / sum(n) OVER (), 6) AS share FROM n""",
    ),
    "blunder_rate": (
        lambda s, d: aggs.blunders(evals(s, d)),
        f"{WITH} SELECT model, count(t2_cpl) AS n, round(avg((t2_cpl >= 1000)::INT), 6) AS blunder_rate, round(avg(CASE WHEN t2_cpl < 1000 THEN t2_cpl END), 6) AS mean_unsaturated FROM evals WHERE model IS NOT NULL GROUP BY model",
    ),
    "active_model": (
        lambda s, d: aggs.active_model(evals(s, d), 450),
        f"{WITH}, l AS (SELECT model, count(*) n, max(ts) latest FROM evals WHERE model IS NOT NULL GROUP BY 1 HAVING count(*) < 450) SELECT (SELECT model FROM l ORDER BY latest DESC, model DESC LIMIT 1) AS model, (SELECT max(latest) FROM l) AS latest",
    ),
    "job_estimate": (
        lambda s, d: aggs.job_estimate(positions(evals(s, d)), len(MODELS), 6),
        f"{WITH}, pos AS ({POSITIONS}) SELECT count(*) AS positions, count(*) * 132 AS standard_jobs, floor(count(*) * 132 * 0.4)::BIGINT AS correction_jobs, count(*) * 132 + floor(count(*) * 132 * 0.4)::BIGINT AS total_jobs FROM pos",
    ),
    "relative_error": (
        lambda s, d: derived(s, d).select("event_id", F.round("t1_relative_error", 6).alias("t1_relative_error"), "t1_abs_error_excl_mate"),
        f"{DERIVED} SELECT event_id, round(t1_relative_error, 6) AS t1_relative_error, t1_abs_error_excl_mate FROM derived",
    ),
    "clamped_cpl": (
        lambda s, d: derived(s, d).select("event_id", "t2_cpl_clamped", F.round("t2_wp_loss", 6).alias("t2_wp_loss")),
        f"{DERIVED} SELECT event_id, t2_cpl_clamped, round(t2_wp_loss, 6) AS t2_wp_loss FROM derived",
    ),
    "raw_cpl": (
        lambda s, d: evals(s, d).select("event_id", X.raw_cpl(F.col("t1_stockfish_eval"), F.col("t1_model_eval"), X.white_to_move(F.col("fen"))).cast("long").alias("raw_cpl")),
        f"{DERIVED} SELECT event_id, CASE WHEN t1_model_eval IS NULL THEN 0 WHEN white THEN greatest(0, t1_stockfish_eval - t1_model_eval) ELSE greatest(0, t1_model_eval - t1_stockfish_eval) END::BIGINT AS raw_cpl FROM derived",
    ),
    "legality_attempted": (
        lambda s, d: aggs.grouped(derived(s, d), ["model", "prompt_format"], attempted="mean:t2_legal_attempted", plain="mean:t2_legal", n="count:t2_legal_attempted"),
        _sql(["model", "prompt_format"], {"attempted": "mean:t2_legal_attempted", "plain": "mean:t2_legal", "n": "count:t2_legal_attempted"}),
    ),
    "direction_thresholds": (
        lambda s, d: derived(s, d).select("event_id", *(f"t1_direction_correct_t{t}" for t in X.THRESHOLDS)),
        f"{DERIVED} SELECT event_id, {', '.join(f't1_direction_correct_t{t}' for t in X.THRESHOLDS)} FROM derived",
    ),
    "score_t1": (
        lambda s, d: evals(s, d).select("event_id", *(c.alias(n) for n, c in X.score_t1(F.col("t1_model_eval"), F.col("t1_stockfish_eval")).items())),
        f"{DERIVED} SELECT event_id, t1_absolute_error, t1_direction_correct FROM derived",
    ),
    "score_t3_theme": (
        lambda s, d: evals(s, d).select("event_id", *(c.alias(n) for n, c in X.score_t3(F.col("t3_explanation"), F.col("t3_side_claimed"), F.col("t1_stockfish_eval"), F.col("theme")).items())),
        f"""{DERIVED} SELECT event_id, p1 AS t3_p1_side_correct, hit AS t3_p2_theme_correct, p1 + hit AS t3_score FROM (SELECT event_id, t3_p2_theme_v2 AS hit, CASE WHEN t3_explanation IS NOT NULL THEN
        (t3_side_claimed = CASE WHEN t1_stockfish_eval > 50 THEN 'White' WHEN t1_stockfish_eval < -50 THEN 'Black' ELSE 'Equal' END)::INT END AS p1 FROM derived)""",
    ),
    "theme_rescore": (
        lambda s, d: aggs.grouped(derived(s, d), ["theme"], named="mean:t3_p2_theme_v2", score="mean:t3_score_v2", n="count:t3_p2_theme_v2"),
        _sql(["theme"], {"named": "mean:t3_p2_theme_v2", "score": "mean:t3_score_v2", "n": "count:t3_p2_theme_v2"}),
    ),
    "correction_trigger": (
        lambda s, d: evals(s, d).groupBy(X.triggers_correction(F.col("t2_cpl")).alias("triggers")).agg(F.count(F.lit(1)).alias("n")),
        f"{WITH} SELECT coalesce(t2_cpl > 50, false) AS triggers, count(*) AS n FROM evals GROUP BY 1",
    ),
}
