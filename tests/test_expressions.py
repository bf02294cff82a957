from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from evalkit.functions import exprs as X
from evalkit.functions.themes import THEME_PHRASES
from evalkit.operators import hypothesis as H
from evalkit.operators.derive import derive


def one(spark, *cols):
    return tuple(spark.range(1).select(*(c.alias(f"c{k}") for k, c in enumerate(cols))).first())


def lit(*values):
    return [F.lit(v) for v in values]


def test_relative_error_has_a_floor(spark):
    m, t = F.lit(150), F.lit(50)
    assert one(spark, X.relative_error(m, t), X.relative_error(F.lit(None).cast("int"), t), X.relative_error(F.lit(900), F.lit(-1000))) == (1.0, None, 1.9)
    with pytest.raises(ValueError):
        X.relative_error(m, t, 0)


def test_losses_are_bounded_and_null_safe(spark):
    white = F.lit(True)
    assert one(spark, X.clamped_cpl(F.lit(5000), F.lit(9000), white), X.clamped_cpl(F.lit(100), F.lit(-50), white), X.clamped_cpl(F.lit(100), F.lit(None).cast("int"), white)) == (2000.0, 0.0, None)
    loss = one(spark, X.wp_loss(F.lit(0), F.lit(400), white))[0]
    assert loss == pytest.approx(231.0586, abs=1e-3)
    assert one(spark, X.raw_cpl(F.lit(50), F.lit(80), ~white), X.raw_cpl(F.lit(50), F.lit(80), white)) == (30, 0)


def test_direction_buckets_are_strict(spark):
    assert one(spark, *(X.direction(F.lit(v), 50) for v in (51, 50, -50, -51)), X.direction(F.lit(None).cast("int"), 50)) == ("White", "Equal", "Equal", "Black", None)


def test_mates_are_left_out_of_errors(spark):
    assert [one(spark, X.exclude_mate(F.lit(7), F.lit(t)))[0] for t in (50, 9999, -200, -12000, 0)] == [7, None, 7, None, 7]


def test_themes_are_found_by_phrase_and_by_label(spark):
    find = lambda text, theme: one(spark, X.names_theme(F.lit(text).cast("string"), F.lit(theme).cast("string")))[0]
    assert [find("A KNIGHT FORK!", "fork"), find("weak back rank", "backRankMate"), find("quiet", "fork"), find("some odd theme", "oddTheme"), find("odd  theme", "oddTheme")] == [1, 1, 0, 1, 0]
    assert find(None, "fork") is None and find("x", None) is None
    assert len(THEME_PHRASES) == 67


def test_texts(spark):
    assert one(spark, X.camel_words(F.lit("xRAyAttack")), X.first_integer(F.lit("about -0.2 or 7")), X.first_integer(F.lit("+80")), X.first_integer(F.lit("no"))) == ("x r ay attack", 0, 80, None)
    assert one(spark, X.clean_move(F.lit("**12...Nf3.** best")), X.clean_move(F.lit("`e4`,\nd4")), X.clean_move(F.lit("  "))) == ("Nf3", "e4", None)
    assert one(spark, X.job_id(F.lit(1022141060), F.lit("a.b:7"), F.lit("cot"), F.lit(1)), X.job_id(F.lit(7), F.lit("m"), F.lit("cot"), F.lit(2))) == ("job_1022141060_a_b_7_cot_1", "job_00007_m_cot_2")
    assert one(spark, X.model_family(F.lit("Qwen2.5:7b")), X.model_size(F.lit("solar:10.7b")), X.model_size(F.lit("mixtral:8x7b")), X.model_size(F.lit("none"))) == ("qwen", 10.7, 0.0, 0.0)
    assert one(spark, X.moves_to_pgn(F.array(*lit("e4", "e5", "Nf3"))), X.first_theme(F.lit("  a b")), X.first_theme(F.lit("")), X.slug(F.lit("Qwen 2.5"))) == ("1. e4 e5 2. Nf3", "a", "tactics", "qwen_25")
    assert one(spark, X.duration_seconds(F.lit("2h")), X.duration_seconds(F.lit("90m")), X.duration_seconds(F.lit("30s")), X.duration_seconds(F.lit("5"))) == (7200, 5400, 30, 300)
    assert one(spark, X.eta_text(F.lit(3725)), X.eta_text(F.lit(65)), X.progress_bar(F.lit(1), F.lit(0), 4)) == ("~1h 2m", "~1m 5s", "----")


def test_engine_lines_use_the_last_score(spark):
    lines = F.array(*lit("info score cp 10", "info depth 2 score mate -3 nodes 1", "bestmove x"))
    assert one(spark, X.engine_score(lines, F.lit(True)), X.engine_score(lines, F.lit(False)), X.engine_score(F.array(*lit("x")), F.lit(True))) == (-9970, 9970, None)
    assert one(spark, X.wdl_to_cp(F.lit(1.0), F.lit(0.0)), X.wdl_to_cp(F.lit(0.0), F.lit(0.0)), X.wdl_to_cp(F.lit(0.3), F.lit(0.4))) == (10000, -10000, 0)


def test_phases(spark):
    start = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1"
    assert one(spark, X.phase(F.lit(start), F.lit(20)), X.phase(F.lit(start), F.lit(21)), X.phase(F.lit("8/8/8/3k4/8/3K4/4R3/8 w - - 0 1"), F.lit(60))) == ("opening", "middlegame", "endgame")


def test_derive_adds_what_its_inputs_allow(spark):
    assert derive(spark.createDataFrame([(1, 2)], "t1_model_eval long, t1_stockfish_eval long")).columns[2:] == ["t1_relative_error", *(f"t1_direction_correct_t{t}" for t in X.THRESHOLDS), "t1_direction_correct"]


@pytest.mark.parametrize(("values", "rising", "want"), [((1, 2, 3, 4), True, True), ((1, 1, 1, 1), True, False), ((1, 3, 2, 4), True, False), ((4, 4, 3, 1), False, True), ((1, None, None, None), True, False)])
def test_trends_are_monotonic_with_different_ends(spark, values, rising, want):
    marks = [None if v is None else float(v) for v in values]
    df = spark.createDataFrame(list(zip(("easy", "medium", "hard", "extreme"), marks, strict=True)), "difficulty string, v double")
    assert H.trends(df, {"v": ("v", rising)}).first().supported is want


def test_flat_scores_do_not_fall_but_pass_the_weak_test(spark):
    df = spark.createDataFrame([(d, 1.0) for d in ("easy", "medium", "hard", "extreme")], "difficulty string, t3_score double")
    assert H.h3(df).first().supported
    assert not H.h3(df.withColumn("t3_score", F.when(F.col("difficulty") != "hard", F.col("t3_score")))).first().supported


def test_no_family_supports_the_scaling_hypothesis(spark):
    from evalkit.operators.aggs import family_scaling

    df = spark.createDataFrame([("a", 7.0, 1, 1, 1)], "model_family string, model_size_b double, t1_absolute_error int, t2_cpl int, t3_score int")
    assert tuple(H.h4(family_scaling(df)).first()) == (0, True)
