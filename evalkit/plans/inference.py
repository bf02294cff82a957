"""Hypothesis tests and agreement statistics."""

from __future__ import annotations

from ..functions import exprs as X
from ..operators import aggs
from ..operators import hypothesis as H
from .fixture import POSITIONS, WITH, evals, positions
from .metrics import DERIVED, QUERIES as METRICS, derived

_ORDER = "CASE difficulty WHEN 'easy' THEN 0 WHEN 'medium' THEN 1 WHEN 'hard' THEN 2 ELSE 3 END"


def _trend(metrics: dict[str, tuple[str, bool]]) -> str:
    parts = []
    for name, (col, rising) in metrics.items():
        strict = "<" if rising else ">"
        parts.append(f"""SELECT '{name}' AS metric, CASE WHEN count(*) < 2 THEN false ELSE coalesce(bool_and(m {'>=' if rising else '<='} prev), true) AND arg_min(m, k) {strict} arg_max(m, k) END AS supported
        FROM (SELECT k, m, lag(m) OVER (ORDER BY k) AS prev FROM (SELECT {_ORDER} AS k, round(avg({col}::DOUBLE), 9) AS m FROM derived WHERE difficulty IS NOT NULL GROUP BY 1) WHERE m IS NOT NULL)""")
    return f"{DERIVED} {' UNION ALL '.join(parts)}"


_SIDES = ("White", "Black", "Equal")
_CLASS = "CASE WHEN {c} > t THEN 'White' WHEN {c} < -t THEN 'Black' ELSE 'Equal' END"
_T = "th(t) AS (VALUES " + ", ".join(f"({t})" for t in X.THRESHOLDS) + ")"

QUERIES = {
    "trend_h1": (lambda s, d: H.h1(derived(s, d)), _trend({"absolute_error": ("t1_absolute_error", True), "relative_error": ("t1_relative_error", True), "direction_accuracy": ("t1_direction_correct", False)})),
    "trend_h2": (lambda s, d: H.h2(derived(s, d)), _trend({"absolute_cpl": ("t2_cpl", True), "clamped_cpl": ("t2_cpl_clamped", True), "wp_loss": ("t2_wp_loss", True)})),
    "trend_h3": (
        lambda s, d: H.h3(derived(s, d)),
        f"{DERIVED}, m AS (SELECT {_ORDER} AS k, round(avg(t3_score), 9) AS m FROM derived GROUP BY 1) SELECT 't3_score' AS metric, count(*) >= 2 AND bool_and(m IS NOT NULL) AND coalesce(bool_and(m <= prev), true) AS supported FROM (SELECT *, lag(m) OVER (ORDER BY k) AS prev FROM m)",
    ),
    "trend_h4": (
        lambda s, d: H.h4(aggs.family_scaling(evals(s, d))),
        f"SELECT count(*) AS families, coalesce(bool_and(all_better), true) AS supported FROM ({METRICS['family_scaling'][1]})",
    ),
    "trend_h5": (
        lambda s, d: H.h5(derived(s, d)),
        f"""{DERIVED}, g AS (SELECT CASE phase WHEN 'opening' THEN 0 WHEN 'middlegame' THEN 1 ELSE 2 END AS k, round(avg(t3_score_v2) / 2 - avg(t2_legal_attempted::INT), 9) AS gap FROM derived GROUP BY 1)
        SELECT 'gap' AS metric, count(*) = 3 AND coalesce(bool_and(gap < prev), true) AS supported FROM (SELECT *, lag(gap) OVER (ORDER BY k) AS prev FROM g)""",
    ),
    "direction_baselines": (
        lambda s, d: H.direction_baselines(positions(evals(s, d))),
        f"""{WITH}, {_T}, p AS ({POSITIONS}), c AS (SELECT t, {_CLASS.format(c='t1_stockfish_eval')} AS side FROM p, th)
        SELECT t AS threshold, count(*) AS n, {', '.join(f"round(count(*) FILTER (side = '{x}') / count(*)::DOUBLE, 6) AS {x.lower()}" for x in _SIDES)},
        round(greatest({', '.join(f"count(*) FILTER (side = '{x}')" for x in _SIDES)}) / count(*)::DOUBLE, 6) AS majority FROM c GROUP BY t""",
    ),
    "cohen_kappa": (
        lambda s, d: H.agreement(evals(s, d)),
        f"""{WITH}, {_T}, c AS (SELECT model, t, {_CLASS.format(c='t1_model_eval')} AS said, {_CLASS.format(c='t1_stockfish_eval')} AS truth FROM evals, th WHERE t1_model_eval IS NOT NULL AND model IS NOT NULL),
        n AS (SELECT model, t, count(*)::DOUBLE AS n, count(*) FILTER (said = truth) / count(*)::DOUBLE AS po, ({' + '.join(f"count(*) FILTER (said = '{x}') * count(*) FILTER (truth = '{x}')" for x in _SIDES)}) / (count(*) * count(*))::DOUBLE AS pe,
          list_avg([{', '.join(f"count(*) FILTER (said = '{x}' AND truth = '{x}') / nullif(count(*) FILTER (truth = '{x}'), 0)::DOUBLE" for x in _SIDES)}]) AS bal FROM c GROUP BY 1, 2)
        SELECT model, t AS threshold, n::BIGINT AS n, round(po, 6) AS accuracy, round((po - pe) / nullif(1 - pe, 0), 6) AS kappa, round(bal, 6) AS balanced_accuracy FROM n""",
    ),
    "side_split": (
        lambda s, d: H.by_side(derived(s, d)),
        f"{DERIVED} SELECT model, white, count(t1_direction_correct) AS n, round(avg(t1_direction_correct::INT), 6) AS direction, round(avg(t2_cpl), 6) AS cpl FROM derived WHERE model IS NOT NULL GROUP BY model, white",
    ),
    "spearman": (
        lambda s, d: H.spearman(evals(s, d)),
        f"""{WITH}, v AS (SELECT model, t1_model_eval AS a, t1_stockfish_eval AS b FROM evals WHERE model IS NOT NULL AND t1_model_eval IS NOT NULL AND abs(t1_stockfish_eval) < 9000),
        r AS (SELECT model, rank() OVER (PARTITION BY model ORDER BY a) + (count(*) OVER (PARTITION BY model, a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (PARTITION BY model ORDER BY b) + (count(*) OVER (PARTITION BY model, b) - 1) / 2.0::DOUBLE AS rb FROM v)
        SELECT model, count(*) AS n, round(corr(ra, rb), 6) AS rho FROM r GROUP BY model""",
    ),
    "regime_split": (
        lambda s, d: H.regime_split(evals(s, d)),
        f"{WITH}, c AS (SELECT max(ts) AS cut FROM evals WHERE t2_move IS NOT NULL AND NOT t2_legal) SELECT CASE WHEN ts IS NULL THEN 'unknown' WHEN cut IS NULL OR ts > cut THEN 'after' ELSE 'before' END AS regime, count(*) AS n, round(avg(t2_legal::INT), 6) AS legal FROM evals, c GROUP BY 1",
    ),
    "bootstrap_cpl": (
        lambda s, d: H.bootstrap(evals(s, d), "t2_cpl"),
        f"""{WITH}, r AS (SELECT model, k, t2_cpl AS x, ('0x' || substr(sha256(event_id::VARCHAR || ':' || k::VARCHAR), 1, 8))::BIGINT % 4 AS d FROM evals, range(20) g(k) WHERE t2_cpl IS NOT NULL AND model IS NOT NULL),
        m AS (SELECT model, k, sum(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END * x)::DOUBLE / sum(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END) AS m FROM r GROUP BY 1, 2)
        SELECT model, round(avg(m), 6) AS mean, round(min(m), 6) AS low, round(max(m), 6) AS high FROM m GROUP BY model""",
    ),
}
