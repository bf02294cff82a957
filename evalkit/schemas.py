"""Schemas of the library's records. Missing values are NULL, never NaN."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(), "array<string>": T.ArrayType(T.StringType()),
}


def _schema(fields: str) -> T.StructType:
    """name type, name type, ...: without a JVM, so that workers can import this module."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (f.split() for f in fields.split(","))])


POSITION = _schema(
    "id long, fen string, pgn_moves string, theme string, difficulty string, phase string, source string, rating int, stockfish_eval long, stockfish_best_move string"
)
JOB = _schema(
    "job_id string, job_type string, position_id long, model string, prompt_format string, trial int, status string, worker_id string, claimed_at timestamp,"
    " completed_at timestamp, paired_control_job_id string, parent_job_id string, hash string, created_at timestamp, error_message string"
)
PARSED = _schema("eval long, move string, explanation string, side_claimed string, parse_errors array<string>")
RESULT = _schema(
    "job_id string, job_type string, attempt int, parent_job_id string, position_id long, fen string, model string, model_family string, model_size_b double,"
    " prompt_format string, difficulty string, phase string, source string, theme string, stockfish_eval long, stockfish_best_move string, inference_ms long,"
    " timestamp timestamp, t1_model_eval long, t1_stockfish_eval long, t1_absolute_error long, t1_direction_correct boolean, t2_move string, t2_best_move string,"
    " t2_legal boolean, t2_cpl long, t3_explanation string, t3_side_claimed string, t3_p1_side_correct int, t3_p2_theme_correct int, t3_score double, parse_errors array<string>"
)
RETRY = _schema(
    "job_id string, model string, fen string, original_move string, retried_move string, retried_legal boolean, retried_cpl long, stockfish_best_move string, inference_ms long"
)
PUZZLE_CSV = _schema(
    "PuzzleId string, FEN string, Moves string, Rating string, RatingDeviation string, Popularity string, NbPlays string, Themes string, GameUrl string, OpeningTags string"
)

#: The categories and their order.
DIFFICULTIES = ("easy", "medium", "hard", "extreme")
PHASES = ("opening", "middlegame", "endgame")
PROMPT_FORMATS = ("fen_only", "pgn+fen", "cot", "eval_only", "move_only", "explanation_only")
STATUSES = ("pending", "in_progress", "done", "failed")
