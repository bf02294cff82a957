"""Joins, set operations, sampling, queue and chart-frame queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import aggs, joins, windows
from .fixture import AS_OF, FAMILY_ORDER, MODELS, POSITIONS, WITH, evals, positions, table
from .metrics import _META, DERIVED, derived, model_meta

_POS = f"{WITH}, pos AS ({POSITIONS})"
_TINY_MODELS, _FORMATS = ("llama3.2:3b", "solar:10.7b", "mixtral:8x7b"), ("fen_only", "cot")
_BOUNDS = (("easy", 0, 1200), ("medium", 1200, 1600), ("hard", 1600, 2000), ("extreme", 2000, 4000))


def _pos(s, d):
    return positions(evals(s, d))


def _claimed(df):
    """Jobs with the time of their claim, for those in progress."""
    return df.select("event_id", "job_id", "model", "status", F.when(F.col("status") == "in_progress", F.col("ts")).alias("claimed_at"))


_CLAIMED = f"{WITH}, jobs AS (SELECT event_id, job_id, model, status, CASE WHEN status = 'in_progress' THEN ts END AS claimed_at FROM evals)"


def _matrix(s, d):
    return joins.job_matrix(_pos(s, d), _TINY_MODELS, _FORMATS)


_MATRIX = (
    f"{_POS}, m(model) AS (VALUES " + ", ".join(f"('{m}')" for m in _TINY_MODELS) + "), f(prompt_format) AS (VALUES " + ", ".join(f"('{m}')" for m in _FORMATS) + "), "
    "matrix AS (SELECT position_id, model, prompt_format, 'job_' || lpad(position_id::VARCHAR, 5, '0') || '_' || translate(model, ':.', '__') || '_' || prompt_format || '_1' AS job_id, "
    "sha256(position_id::VARCHAR || model || prompt_format || '1') AS hash, 'pending' AS status FROM pos, m, f)"
)


def _insert(s, d):
    batch = _matrix(s, d)
    target = batch.where("position_id % 3 = 0").select("job_id", "hash")
    twice = batch.withColumn("seq", F.explode(F.array(F.lit(2), F.lit(1))))
    return joins.insert_if_absent(target, twice, "seq").select("job_id", "seq")


def _enrich_cpl(s, d):
    e = evals(s, d)
    work = e.where("t2_legal").select("event_id", "fen", "t2_move", "t2_best_move")
    before = _pos(s, d).select("fen", F.col("t1_stockfish_eval").alias("eval_before"))
    after = _pos(s, d).where("position_id % 4 <> 0").select("fen", F.explode(F.array(F.lit("e4"), F.lit("Nf3"), F.lit("O-O"))).alias("move"), (F.col("t1_stockfish_eval") + F.col("position_id") % 300 - 100).alias("eval_after"))
    return joins.enrich_losses(work, before, after).select("event_id", "t2_cpl")


def _upsert(s, d):
    e = evals(s, d).select("job_id", "model", "t2_cpl")
    new = e.where("t2_cpl is null").select("job_id", F.lit(77).cast("long").alias("t2_cpl"))
    return joins.upsert(e, new, "job_id", ["t2_cpl"]).select("job_id", "t2_cpl")


def _retried(s, d):
    return evals(s, d).where("event_id % 3 = 0 and not coalesce(t2_legal, false)").select("job_id", (F.col("event_id") % 2 == 0).alias("retried_legal"))


_SIMILAR = f"""{_POS}, free AS (SELECT * FROM pos WHERE position_id % 5 <> 0), r AS (SELECT job_id, position_id, theme, difficulty FROM evals WHERE job_type = 'correction'),
j AS (SELECT *, ('0x' || substr(sha256(job_id), 1, 8))::BIGINT AS x FROM r),
h AS (SELECT *, row_number() OVER t - 1 AS k1, count(*) OVER (PARTITION BY theme, difficulty) AS n1, row_number() OVER w - 1 AS k2, count(*) OVER (PARTITION BY difficulty) AS n2 FROM (SELECT *, sha256(position_id::VARCHAR) AS h FROM free)
  WINDOW t AS (PARTITION BY theme, difficulty ORDER BY h, position_id), w AS (PARTITION BY difficulty ORDER BY h, position_id)),
c AS (SELECT job_id, 0 AS lv, k1 <> x % n1 AS later, h.position_id AS f FROM j JOIN h USING (theme, difficulty) WHERE k1 IN (x % n1, (x + 1) % n1) AND h.position_id <> j.position_id
  UNION ALL SELECT job_id, 1, k2 <> x % n2, h.position_id FROM j JOIN h USING (difficulty) WHERE k2 IN (x % n2, (x + 1) % n2) AND h.position_id <> j.position_id),
b AS (SELECT job_id, lv, f, row_number() OVER (PARTITION BY job_id ORDER BY lv, later) AS k FROM c)
SELECT r.job_id, r.position_id, b.f AS follow_up, b.lv = 1 AS fell_back FROM r LEFT JOIN (SELECT * FROM b WHERE k = 1) b USING (job_id)"""


def _docs(s, d):
    return table(s, d, "documents")


def _chart(s, d):
    return aggs.grouped(derived(s, d), ["model"], cpl="mean:t2_cpl", error="mean:t1_relative_error", legal="mean:t2_legal_attempted", score="mean:t3_score_v2")


_CHART = f"{DERIVED}, chart AS (SELECT model, round(avg(t2_cpl), 6) AS cpl, round(avg(t1_relative_error), 6) AS error, round(avg(t2_legal_attempted::INT), 6) AS legal, round(avg(t3_score_v2), 6) AS score FROM derived WHERE model IS NOT NULL GROUP BY model)"
_NORM = {"legal": "(legal - min(legal) OVER ()) / (max(legal) OVER () - min(legal) OVER ())", "score": "(score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ())",
         "cpl": "1 - (cpl - min(cpl) OVER ()) / (max(cpl) OVER () - min(cpl) OVER ())", "error": "1 - (error - min(error) OVER ()) / (max(error) OVER () - min(error) OVER ())"}
_FAMILY_PLACE = "CASE family " + " ".join(f"WHEN '{f}' THEN {k + 1}" for k, f in enumerate(FAMILY_ORDER)) + f" ELSE {len(FAMILY_ORDER) + 1} END"
_SOLO = ("Solar", "Phi-4", "WizardLM", "CodeLlama", "Yi", "Command-R")

QUERIES = {
    "filter_multi": (
        lambda s, d: evals(s, d).where(F.col("difficulty").isin("easy", "hard") & (F.col("phase") == "opening") & F.col("theme").isin("fork", "skewer", "pin")).select("event_id", "difficulty", "phase", "theme"),
        f"{WITH} SELECT event_id, difficulty, phase, theme FROM evals WHERE difficulty IN ('easy', 'hard') AND phase = 'opening' AND theme IN ('fork', 'skewer', 'pin')",
    ),
    "enrich_worklist": (
        lambda s, d: joins.worklist(evals(s, d)).select("job_id", "todo"),
        f"{WITH} SELECT job_id, coalesce(t2_legal, false) AND t2_move IS NOT NULL AND t2_cpl IS NULL AS todo FROM evals",
    ),
    "needs_eval": (
        lambda s, d: evals(s, d).where(F.col("t1_model_eval").isNull() | F.col("t2_move").isNull()).select("event_id"),
        f"{WITH} SELECT event_id FROM evals WHERE t1_model_eval IS NULL OR t2_move IS NULL",
    ),
    "join_fen_lookup": (
        lambda s, d: joins.back_fill_fen(evals(s, d).drop("fen"), _pos(s, d)).select("event_id", "fen"),
        f"{_POS} SELECT event_id, pos.fen FROM evals LEFT JOIN pos USING (position_id)",
    ),
    "join_enrich_positions": (
        lambda s, d: joins.enrich_jobs(evals(s, d).select("job_id", "position_id", "status"), _pos(s, d).where("position_id % 10 <> 3")).select("job_id", "status", "truth"),
        f"{_POS} SELECT job_id, CASE WHEN pos.fen IS NULL THEN 'failed' ELSE status END AS status, CASE WHEN pos.fen IS NOT NULL THEN coalesce(pos.t1_stockfish_eval, 0) END AS truth FROM evals LEFT JOIN (SELECT * FROM pos WHERE position_id % 10 <> 3) pos USING (position_id)",
    ),
    "join_learning_deltas": (
        lambda s, d: joins.learning_deltas(evals(s, d)),
        f"""{WITH} SELECT c.model, c.parent_job_id, p.t2_cpl AS cpl_attempt_1, c.t2_cpl AS cpl_correction, k.t2_cpl AS cpl_control, p.t2_cpl - c.t2_cpl AS delta_correction, p.t2_cpl - k.t2_cpl AS delta_control,
        (p.t2_cpl - c.t2_cpl) - (p.t2_cpl - k.t2_cpl) AS net_feedback_effect FROM evals c JOIN evals p ON c.parent_job_id = p.job_id AND p.job_type = 'standard' JOIN evals k ON k.parent_job_id = c.parent_job_id AND k.job_type = 'control'
        WHERE c.job_type = 'correction' AND p.t2_cpl IS NOT NULL AND c.t2_cpl IS NOT NULL AND k.t2_cpl IS NOT NULL""",
    ),
    "join_enrich_cpl": (
        _enrich_cpl,
        f"""{_POS}, a AS (SELECT fen, unnest(['e4', 'Nf3', 'O-O']) AS move, t1_stockfish_eval + position_id % 300 - 100 AS eval_after FROM pos WHERE position_id % 4 <> 0)
        SELECT event_id, CASE WHEN e.t2_move = e.t2_best_move THEN 0 WHEN eval_after IS NOT NULL THEN CASE WHEN split_part(e.fen, ' ', 2) = 'w' THEN greatest(0, pos.t1_stockfish_eval - eval_after) ELSE greatest(0, eval_after - pos.t1_stockfish_eval) END END AS t2_cpl
        FROM evals e LEFT JOIN pos ON e.fen = pos.fen LEFT JOIN a ON a.fen = e.fen AND a.move = e.t2_move WHERE e.t2_legal""",
    ),
    "join_upsert": (_upsert, f"{WITH} SELECT job_id, coalesce(t2_cpl, 77) AS t2_cpl FROM evals"),
    "join_model_meta": (
        lambda s, d: evals(s, d).groupBy("model").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(model_meta(s).where("size > 7")), "model", "left").select("model", "n", F.coalesce("family", F.lit("Other")).alias("family"), F.coalesce("size", F.lit(0)).alias("size")),
        f"{WITH}, {_META} SELECT model, count(*) AS n, coalesce(any_value(family), 'Other') AS family, coalesce(any_value(size), 0) AS size FROM evals LEFT JOIN (SELECT * FROM meta WHERE size > 7) USING (model) GROUP BY model",
    ),
    "cross_job_matrix": (_matrix, f"{_MATRIX} SELECT * FROM matrix"),
    "insert_if_absent": (_insert, f"{_MATRIX} SELECT job_id, 1 AS seq FROM matrix WHERE position_id % 3 <> 0"),
    "semi_needed": (
        lambda s, d: _pos(s, d).join(evals(s, d).where("status = 'pending' and event_id % 5 = 0").select("position_id"), "position_id", "left_semi").select("position_id", "difficulty"),
        f"{_POS} SELECT position_id, difficulty FROM pos WHERE position_id IN (SELECT position_id FROM evals WHERE status = 'pending' AND event_id % 5 = 0)",
    ),
    "anti_retried": (
        lambda s, d: evals(s, d).select("job_id").join(_retried(s, d), "job_id", "left_anti"),
        f"{WITH} SELECT job_id FROM evals WHERE NOT (event_id % 3 = 0 AND NOT coalesce(t2_legal, false))",
    ),
    "retry_candidates": (
        lambda s, d: joins.retry_candidates(evals(s, d), _retried(s, d)).select("job_id", "model"),
        f"{WITH} SELECT job_id, model FROM evals WHERE NOT coalesce(t2_legal, false) AND event_id % 3 <> 0 AND prompt_format IN ('fen_only', 'pgn+fen', 'cot', 'move_only')",
    ),
    "retry_summary": (
        lambda s, d: joins.retry_summary(_retried(s, d)),
        f"{WITH} SELECT count(*) AS retried, count(*) FILTER (event_id % 2 = 0) AS became_legal, count(*) FILTER (event_id % 2 <> 0) AS still_illegal, round(count(*) FILTER (event_id % 2 = 0) * 100.0::DOUBLE / count(*), 6) AS percent FROM evals WHERE event_id % 3 = 0 AND NOT coalesce(t2_legal, false)",
    ),
    "rating_tier": (
        lambda s, d: table(s, d, "part").select("p_partkey", X.rating_tier(F.col("p_retailprice").cast("int") * 2 - 100, _BOUNDS).alias("tier")),
        "SELECT p_partkey, CASE WHEN r >= 0 AND r < 1200 THEN 'easy' WHEN r >= 1200 AND r < 1600 THEN 'medium' WHEN r >= 1600 AND r < 2000 THEN 'hard' ELSE 'extreme' END AS tier FROM (SELECT p_partkey, trunc(p_retailprice)::BIGINT * 2 - 100 AS r FROM part)",
    ),
    "id_range_tier": (
        lambda s, d: table(s, d, "part").select("p_partkey", F.when(F.col("p_partkey") <= 500, "easy").when(F.col("p_partkey") <= 1000, "medium").when(F.col("p_partkey") <= 1500, "hard").otherwise("extreme").alias("tier")),
        "SELECT p_partkey, CASE WHEN p_partkey <= 500 THEN 'easy' WHEN p_partkey <= 1000 THEN 'medium' WHEN p_partkey <= 1500 THEN 'hard' ELSE 'extreme' END AS tier FROM part",
    ),
    "paired_jobs": (
        lambda s, d: joins.correction_pairs(evals(s, d).where(X.triggers_correction(F.col("t2_cpl"))), (F.col("position_id") + 1) % 997),
        f"""{WITH}, t AS (SELECT * FROM evals WHERE t2_cpl > 50) SELECT job_id || '_correction' AS job_id, 'correction' AS job_type, job_id || '_control' AS paired_control_job_id, (position_id + 1) % 997 AS position_id, job_id AS parent_job_id FROM t
        UNION ALL SELECT job_id || '_control', 'control', job_id || '_correction', (position_id + 1) % 997, job_id FROM t""",
    ),
    "similar_position": (
        lambda s, d: joins.similar_position(evals(s, d).where("job_type = 'correction'").select("job_id", "position_id", "theme", "difficulty"), _pos(s, d), _pos(s, d).where("position_id % 5 = 0")),
        _SIMILAR,
    ),
    "follow_up_state": (
        lambda s, d: joins.assign_follow_ups(evals(s, d).where("job_type = 'correction'").select("job_id", "position_id", "theme", "difficulty"), _pos(s, d), _pos(s, d).where("position_id % 5 = 0")),
        f"""{_POS}, t AS (SELECT job_id, position_id, theme, difficulty FROM evals WHERE job_type = 'correction'),
        free AS (SELECT *, sha256(position_id::VARCHAR) AS h FROM pos WHERE position_id % 5 <> 0 AND position_id NOT IN (SELECT position_id FROM t)),
        a AS (SELECT *, row_number() OVER (PARTITION BY theme, difficulty ORDER BY sha256(job_id), job_id) AS k FROM t), b AS (SELECT *, row_number() OVER (PARTITION BY theme, difficulty ORDER BY h, position_id) AS k FROM free),
        one AS (SELECT a.job_id, b.position_id AS follow_up FROM a JOIN b USING (theme, difficulty, k)),
        a2 AS (SELECT *, row_number() OVER (PARTITION BY difficulty ORDER BY sha256(job_id), job_id) AS k FROM t WHERE job_id NOT IN (SELECT job_id FROM one)),
        b2 AS (SELECT *, row_number() OVER (PARTITION BY difficulty ORDER BY h, position_id) AS k FROM free WHERE position_id NOT IN (SELECT follow_up FROM one)),
        two AS (SELECT a2.job_id, b2.position_id AS follow_up FROM a2 JOIN b2 USING (difficulty, k))
        SELECT t.job_id, x.follow_up FROM t LEFT JOIN (SELECT * FROM one UNION ALL SELECT * FROM two) x USING (job_id)""",
    ),
    "validation_issues": (
        lambda s, d: aggs.issue_report(aggs.validation_issues(evals(s, d).drop("t3_p2_theme_correct"))),
        f"""{WITH}, p AS (SELECT *, CASE WHEN t3_explanation IS NOT NULL THEN coalesce(t3_side_claimed = CASE WHEN t1_stockfish_eval > 50 THEN 'White' WHEN t1_stockfish_eval < -50 THEN 'Black' ELSE 'Equal' END, false)::INT END AS again FROM evals),
        i AS (SELECT model, job_id, job_id || ': t3_p1_side_correct stored=' || coalesce(t3_p1_side_correct::VARCHAR, 'none') || ' recalculated=' || coalesce(again::VARCHAR, 'none') AS line FROM p WHERE t3_p1_side_correct IS DISTINCT FROM again),
        r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY job_id) AS k FROM i)
        SELECT model, count(DISTINCT job_id) AS jobs, count(*) AS issues, string_agg(line, '; ' ORDER BY k) FILTER (k <= 10) AS first, greatest(count(*) - 10, 0) AS more FROM r GROUP BY model""",
    ),
    "first_incomplete_tier": (
        lambda s, d: aggs.first_incomplete(evals(s, d).where("event_id % 3 > 0"), model_meta(s), 200, 60),
        f"""{WITH}, {_META}, t(difficulty, o) AS (VALUES ('easy', 0), ('medium', 1), ('hard', 2), ('extreme', 3)), c AS (SELECT model, difficulty, count(*) AS n FROM evals WHERE event_id % 3 > 0 GROUP BY ALL)
        SELECT model, min_by(t.difficulty, o) AS difficulty FROM meta CROSS JOIN t LEFT JOIN c USING (model, difficulty) WHERE coalesce(n, 0) < 60 GROUP BY model""",
    ),
    "ranked_rows": (
        lambda s, d: aggs.ranked(evals(s, d).select("event_id", "t2_cpl"), "t2_cpl"),
        f"{WITH} SELECT event_id, t2_cpl FROM evals WHERE t2_cpl IS NOT NULL ORDER BY t2_cpl DESC",
    ),
    "dedup_first": (
        lambda s, d: windows.dedup_first(_docs(s, d), ["text"], "doc_id").select("doc_id"),
        "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text",
    ),
    "dedup_last": (
        lambda s, d: windows.dedup_last(_docs(s, d), ["text"], "doc_id").select("doc_id"),
        "SELECT max(doc_id) AS doc_id FROM documents GROUP BY text",
    ),
    "stratified_sample": (
        lambda s, d: windows.stratified_sample(_pos(s, d), "difficulty", "position_id", 20).select("difficulty", "position_id"),
        f"{_POS} SELECT difficulty, position_id FROM (SELECT difficulty, position_id, row_number() OVER (PARTITION BY difficulty ORDER BY sha256(position_id::VARCHAR || ':42'), position_id) AS k FROM pos) WHERE k <= 20",
    ),
    "hash_sample": (
        lambda s, d: windows.hash_sample(_pos(s, d), "position_id", 10).select("position_id"),
        f"{_POS} SELECT position_id FROM pos WHERE ('0x' || substr(sha256(position_id::VARCHAR || ':42'), 1, 8))::BIGINT % 100 < 10",
    ),
    "fifo_claim": (
        lambda s, d: windows.claim(evals(s, d), "event_id", "phi4:14b").select("job_id"),
        f"{WITH} SELECT job_id FROM evals WHERE status = 'pending' AND model = 'phi4:14b' ORDER BY event_id LIMIT 1",
    ),
    "stale_reset": (
        lambda s, d: windows.reset_stale(_claimed(evals(s, d)), AS_OF, 10).select("job_id", "status", "claimed_at", "was_reset"),
        f"""{_CLAIMED} SELECT job_id, CASE WHEN r THEN 'pending' ELSE status END AS status, CASE WHEN NOT r THEN claimed_at END AS claimed_at, r AS was_reset
        FROM (SELECT *, coalesce(status = 'in_progress' AND claimed_at <= TIMESTAMP '{AS_OF}' - INTERVAL 10 MINUTE, false) AS r FROM jobs)""",
    ),
    "latest_state": (
        lambda s, d: windows.latest_state(table(s, d, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type"),
        "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1",
    ),
    "union_sources": (
        lambda s, d: evals(s, d).select("position_id", "difficulty").where("difficulty = 'easy'").unionByName(evals(s, d).where("difficulty = 'hard'").select("position_id", "difficulty", "theme"), allowMissingColumns=True),
        f"{WITH} SELECT position_id, difficulty, CASE WHEN difficulty = 'hard' THEN theme END AS theme FROM evals WHERE difficulty IN ('easy', 'hard')",
    ),
    "except_models": (
        lambda s, d: model_meta(s).select("model").subtract(evals(s, d).where("event_id % 600 = 1").select("model")),
        f"{WITH}, {_META} SELECT model FROM meta EXCEPT SELECT model FROM evals WHERE event_id % 600 = 1",
    ),
    "distinct_ids": (lambda s, d: evals(s, d).select("position_id").distinct(), f"{WITH} SELECT DISTINCT position_id FROM evals"),
    "heatmap_normalised": (
        lambda s, d: windows.normalised(_chart(s, d), "model", ["legal", "score"], ["cpl", "error"]),
        f"{_CHART}, n AS (SELECT model, {', '.join(f'{v} AS n_{k}' for k, v in _NORM.items())} FROM chart) SELECT model, {', '.join(f'round(n_{k}, 6) AS norm_{k}' for k in _NORM)}, round((n_legal + n_score + n_cpl + n_error) / 4, 6) AS overall FROM n",
    ),
    "quality_inverted": (lambda s, d: windows.inverted(_chart(s, d), "model", "cpl"), f"{_CHART} SELECT model, round(max(cpl) OVER () - cpl, 6) AS quality FROM chart"),
    "quadrants": (
        lambda s, d: windows.quadrants(_chart(s, d).join(F.broadcast(model_meta(s)), "model"), "model", "score", "legal", "size"),
        f"{_CHART.replace('WITH', 'WITH ' + _META + ',', 1)}, mid AS (SELECT median(score) AS ms, median(legal) AS ml FROM chart) SELECT model, CASE WHEN score >= ms THEN 'high' ELSE 'low' END || '_' || CASE WHEN legal >= ml THEN 'high' ELSE 'low' END AS quadrant, least(greatest(size * 3, 30), 400) AS bubble FROM chart JOIN meta USING (model), mid",
    ),
    "illegal_rate": (lambda s, d: _chart(s, d).select("model", F.round(1 - F.col("legal"), 6).alias("illegal")), f"{_CHART} SELECT model, round(1 - legal, 6) AS illegal FROM chart"),
    "family_buckets": (
        lambda s, d: model_meta(s).select("model", F.when(F.col("family").isin(*_SOLO), F.col("family")).otherwise("Others").alias("bucket"), windows.in_order(FAMILY_ORDER, "family").alias("place")),
        f"WITH {_META} SELECT model, CASE WHEN family IN ({', '.join(repr(x) for x in _SOLO)}) THEN family ELSE 'Others' END AS bucket, {_FAMILY_PLACE} AS place FROM meta",
    ),
    "throughput_eta": (
        lambda s, d: windows.throughput(table(s, d, "events"), AS_OF, 600, 5000),
        f"""WITH l AS (SELECT ts FROM events WHERE ts BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 600 MINUTE AND TIMESTAMP '{AS_OF}'), r AS (SELECT count(*) AS n, CASE WHEN count(*) >= 2 AND max(ts) > min(ts) THEN (count(*) - 1) * 1e6 / (epoch_us(max(ts)) - epoch_us(min(ts))) END AS rate FROM l)
        SELECT n, round(rate, 6) AS rate, trunc(5000 / rate)::BIGINT AS eta_seconds FROM r""",
    ),
    "throughput_monitor": (
        lambda s, d: windows.monitor_rate(table(s, d, "events")),
        "SELECT count(*) AS n, round(count(*) * 1e6 / (epoch_us(max(ts)) - epoch_us(min(ts))), 6) AS rate FROM (SELECT ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 600)",
    ),
}
