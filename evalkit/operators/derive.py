"""Derived columns of the result facts, added in one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X


def derive(df: DataFrame, fen: Column | None = None) -> DataFrame:
    """Adds the error, loss, legality, theme and direction columns whose inputs df has."""
    have, c = set(df.columns), F.col
    out: dict[str, Column] = {}
    if {"t1_model_eval", "t1_stockfish_eval"} <= have:
        out["t1_relative_error"] = X.relative_error(c("t1_model_eval"), c("t1_stockfish_eval"))
        out |= {f"t1_direction_correct_t{t}": X.direction_correct(c("t1_model_eval"), c("t1_stockfish_eval"), t) for t in X.THRESHOLDS}
        out["t1_direction_correct"] = X.score_t1(c("t1_model_eval"), c("t1_stockfish_eval"))["t1_direction_correct"]
    if {"t1_absolute_error", "t1_stockfish_eval"} <= have:
        out["t1_abs_error_excl_mate"] = X.exclude_mate(c("t1_absolute_error"), c("t1_stockfish_eval"))
    if {"t1_stockfish_eval", "t2_cpl"} <= have and (fen is not None or "fen" in have):
        white = X.white_to_move(fen if fen is not None else c("fen"))
        out["t2_cpl_clamped"] = X.clamped_cpl(c("t1_stockfish_eval"), c("t2_cpl"), white)
        out["t2_wp_loss"] = X.wp_loss(c("t1_stockfish_eval"), c("t2_cpl"), white)
    if {"t2_move", "t2_legal"} <= have:
        out["t2_legal_attempted"] = X.legal_attempted(c("t2_move"), c("t2_legal"))
    if {"t3_explanation", "theme"} <= have:
        out["t3_p2_theme_v2"] = X.names_theme(c("t3_explanation"), c("theme"))
    df = df.withColumns(out)
    # From the column, so that phrases are looked for once per row.
    return df.withColumn("t3_score_v2", c("t3_p1_side_correct") + c("t3_p2_theme_v2")) if "t3_p2_theme_v2" in out and "t3_p1_side_correct" in have else df
