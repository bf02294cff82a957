"""The evaluation facts that the catalog's queries run on, derived from the driver's tables.

The tables hold no evaluation data, so every column is integer arithmetic on ``events``
(and the text of the document with the event's number), in SQL that Spark and DuckDB read alike. All attributes
of a position depend on position_id alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schemas import DIFFICULTIES, PHASES, PROMPT_FORMATS

SOURCES = ("puzzle_db", "real_game", "generated")
THEMES = ("fork", "pin", "skewer", "discoveredAttack", "backRankMate", "deflection", "endgame", "advancedPawn")
PHRASES = ("a knight fork wins", "the rook is pinned", "the back rank is weak", "an endgame ending", "nothing special")
BOARDS = (
    "rnbqkbnr/pppppppp/8/8/4P3/8/PPPP1PPP/RNBQKBNR",
    "r1bqkbnr/pppp1ppp/2n5/4p3/2B1P3/5N2/PPPP1PPP/RNBQK2R",
    "8/2k5/3p4/p2P1p2/P2P1P2/8/8/4K3",
    "r4rk1/1pp1qppp/p1np1n2/2b1p1B1/2B1P1b1/P1NP1N2/1PP1QPPP/R4RK1",
    "8/8/8/3k4/8/3K4/4R3/8",
)
#: The models, and their families and sizes in billions for display.
MODELS = (
    ("llama3.2:3b", "LLaMA 3", 3), ("llama3.1:8b", "LLaMA 3", 8), ("llama3.3:70b", "LLaMA 3", 70), ("gemma3:4b", "Gemma 3", 4),
    ("gemma3:12b", "Gemma 3", 12), ("gemma4:e2b", "Gemma 4", 2), ("gemma4:e4b", "Gemma 4", 4), ("gemma4:26b", "Gemma 4", 26),
    ("gemma4:31b", "Gemma 4", 31), ("qwen2.5:7b", "Qwen 2.5", 7), ("qwen2.5:14b", "Qwen 2.5", 14), ("qwen2.5:32b", "Qwen 2.5", 32),
    ("deepseek-r1:7b", "DeepSeek-R1", 7), ("deepseek-r1:14b", "DeepSeek-R1", 14), ("mistral:7b", "Mistral", 7), ("mixtral:8x7b", "Mistral", 47),
    ("solar:10.7b", "Solar", 11), ("phi4:14b", "Phi-4", 14), ("wizardlm2:7b", "WizardLM", 7), ("codellama:34b", "CodeLlama", 34),
    ("yi:34b", "Yi", 34), ("command-r:35b", "Command-R", 35),
)
FAMILY_ORDER = ("LLaMA 3", "Gemma 3", "Gemma 4", "Qwen 2.5", "DeepSeek-R1", "Mistral", "Solar", "Phi-4", "WizardLM", "CodeLlama", "Yi", "Command-R")


def pick(values, index: str) -> str:
    """SQL for the index-th of some values."""
    quote = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"CASE {index} " + " ".join(f"WHEN {k} THEN {quote(v)}" for k, v in enumerate(values)) + " END"


def _div(a: str, b: int) -> str:
    return f"CAST(floor({a} / {b}) AS BIGINT)"


_TRUTH = "CASE WHEN p % 13 = 0 THEN (CASE WHEN p % 2 = 0 THEN 1 ELSE -1 END) * (10000 - 10 * (p % 30 + 1)) ELSE p * 7919 % 4001 - 2000 END"

EVALS = f"""
SELECT event_id, job_id, position_id, fen, difficulty, phase, source, theme, model, model_family, CAST(model_size_b AS DOUBLE) AS model_size_b, prompt_format,
  job_type, parent_job_id, status, t1_model_eval, t1_stockfish_eval,
  CASE WHEN t1_model_eval IS NOT NULL THEN abs(least(greatest(t1_model_eval, -2000), 2000) - least(greatest(t1_stockfish_eval, -2000), 2000)) END AS t1_absolute_error,
  t2_move, t2_best_move, t2_legal, CASE WHEN t2_legal AND event_id % 37 <> 0 THEN event_id * 31 % 2600 END AS t2_cpl,
  t3_explanation, CASE WHEN t3_explanation IS NOT NULL THEN t3_side END AS t3_side_claimed,
  CASE WHEN t3_explanation IS NOT NULL THEN event_id % 2 END AS t3_p1_side_correct, CASE WHEN t3_explanation IS NOT NULL THEN event_id % 7 % 2 END AS t3_p2_theme_correct,
  CASE WHEN t3_explanation IS NOT NULL THEN event_id % 2 + event_id % 7 % 2 END AS t3_score, inference_ms, ts
FROM (
  SELECT event_id, p AS position_id, concat('job_', CAST(event_id AS STRING)) AS job_id,
    concat({pick(BOARDS, "p % 5")}, CASE WHEN p % 2 = 0 THEN ' w ' ELSE ' b ' END, '- - 0 ', CAST(p + 1 AS STRING)) AS fen,
    {pick(DIFFICULTIES, "p % 4")} AS difficulty, {pick(PHASES, _div("p", 4) + " % 3")} AS phase, {pick(SOURCES, _div("p", 12) + " % 3")} AS source,
    {pick(THEMES, "p % 8")} AS theme, {pick([m[0] for m in MODELS], "m")} AS model,
    {pick([next((f for f in ("qwen", "llama", "mistral", "phi", "gemma") if m[0].startswith(f)), "unknown") for m in MODELS], "m")} AS model_family,
    {pick([m[2] for m in MODELS], "m")} AS model_size_b, fmt AS prompt_format,
    CASE event_id % 50 WHEN 1 THEN 'correction' WHEN 2 THEN 'control' ELSE 'standard' END AS job_type,
    CASE WHEN event_id % 50 IN (1, 2) THEN concat('job_', CAST(event_id - event_id % 50 AS STRING)) END AS parent_job_id,
    {pick(("done", "done", "done", "failed", "in_progress", "pending", "done"), "event_id % 7")} AS status,
    CASE WHEN event_id % 17 <> 0 AND fmt NOT IN ('move_only', 'explanation_only') THEN event_id * 104729 % 4401 - 2200 END AS t1_model_eval,
    {_TRUTH} AS t1_stockfish_eval,
    CASE WHEN fmt NOT IN ('eval_only', 'explanation_only') AND event_id % 11 <> 0 THEN {pick(("e4", "Nf3", "O-O", "Qxd5", "Rd1"), "event_id % 5")} END AS t2_move,
    {pick(("e4", "Nf3", "O-O", "Qxd5", "Rd1"), "p % 5")} AS t2_best_move,
    CASE WHEN fmt NOT IN ('eval_only', 'explanation_only') AND event_id % 11 <> 0 AND event_id % 29 <> 0 THEN true
         WHEN fmt NOT IN ('eval_only', 'explanation_only') THEN false END AS t2_legal,
    CASE WHEN fmt NOT IN ('eval_only', 'move_only') THEN concat(word, ': ', {pick(PHRASES, "event_id % 5")}) END AS t3_explanation,
    {pick(("White", "Black", "Equal"), "event_id % 3")} AS t3_side, CAST(round(value * 100) AS BIGINT) AS inference_ms, ts
  FROM (
    SELECT e.event_id, e.event_id % 997 AS p, e.user_id % 22 AS m, {pick(PROMPT_FORMATS, "e.event_id % 6")} AS fmt, e.value, e.ts, coalesce(d.word, '') AS word
    FROM events e LEFT JOIN (SELECT doc_id, text AS word FROM documents) d ON e.event_id = d.doc_id
  ) base
) made
"""

#: What a query's SQL begins with.
WITH = f"WITH evals AS ({EVALS})"
POSITIONS = "SELECT DISTINCT position_id, fen, difficulty, phase, source, theme, t1_stockfish_eval, t2_best_move FROM evals"
#: The instant that stands for now.
AS_OF = "2024-01-15 12:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def evals(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = EVALS.replace("FROM events e", "FROM {events} e").replace("FROM documents)", "FROM {documents})")
    return spark.sql(sql, events=table(spark, sf_dir, "events"), documents=table(spark, sf_dir, "documents"))


def positions(facts: DataFrame) -> DataFrame:
    return facts.select("position_id", "fen", "difficulty", "phase", "source", "theme", "t1_stockfish_eval", "t2_best_move").distinct()
