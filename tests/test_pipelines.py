from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from evalkit.functions import exprs as X
from evalkit.operators.generate import Stub
from evalkit.plans import pipelines as P


def test_colliding_ids_are_hashed_again(spark, monkeypatch):
    monkeypatch.setattr(X, "id32", lambda text: F.conv(F.substring(F.sha2(text, 256), 1, 2), 16, 10).cast("long"))
    rows = spark.createDataFrame([(f"fen {k}", f"{k:03d}") for k in range(60)], "fen string, ord string")
    got = P.unique_ids(rows).collect()
    assert len({r.id for r in got}) == len(got) == 60


def test_datasets_keep_the_first_of_equal_positions(spark):
    a = spark.createDataFrame([("f1", "easy", "a"), ("f2", "hard", "a")], "fen string, difficulty string, tag string")
    b = spark.createDataFrame([("f1", "easy", "b"), ("f3", "easy", "b")], "fen string, difficulty string, tag string")
    got = {r.fen: r.tag for r in P.build_dataset([a, b], 10).collect()}
    assert got == {"f1": "a", "f2": "a", "f3": "b"}


def test_jobs_run_from_prompt_to_record(spark):
    fen = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1"
    dataset = spark.createDataFrame([(1, fen, "easy", "opening", "s", "fork", 30, "e4")], "position_id long, fen string, difficulty string, phase string, source string, theme string, t1_stockfish_eval long, t2_best_move string")
    jobs = spark.createDataFrame([(f"j{f}", "standard", 1, "m:7b", f, "pending") for f in ("cot", "eval_only", "move_only", "explanation_only")], "job_id string, job_type string, position_id long, model string, prompt_format string, status string")

    class Fixed(Stub):
        def __call__(self, model, prompt):
            return "Eval: 40\nMove: e4\nExplanation: Equal - a fork"

    got = {r.prompt_format: r for r in P.run_jobs(jobs, dataset, Fixed).collect()}
    assert (got["cot"].t1_absolute_error, got["cot"].t2_move, got["cot"].t2_legal, got["cot"].t2_cpl, got["cot"].t3_score) == (10, "e4", True, 0, 2.0)
    assert got["eval_only"].t2_legal is None and got["eval_only"].t1_model_eval == 40
    assert got["move_only"].t1_model_eval is None and got["move_only"].t2_legal
    assert got["explanation_only"].t1_model_eval is None and got["explanation_only"].t3_explanation == "Equal - a fork"


def _board_jobs(spark, ids, fens=("rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1",)):
    rows = [(k, f, "easy", "opening", "s", "fork", 30, "e4") for k, f in enumerate(fens)]
    dataset = spark.createDataFrame(rows, "position_id long, fen string, difficulty string, phase string, source string, theme string, t1_stockfish_eval long, t2_best_move string")
    jobs = [(j, "standard", k % len(fens), "m:7b", "move_only", "pending") for k, j in enumerate(ids)]
    return spark.createDataFrame(jobs, "job_id string, job_type string, position_id long, model string, prompt_format string, status string").coalesce(1), dataset


@pytest.mark.parametrize("few", [50_000, 0])
def test_small_job_tables_are_dealt_to_all_tasks(spark, monkeypatch, few):
    class Where(Stub):
        """Answers with the number of its task."""

        def __call__(self, model, prompt):
            from pyspark import TaskContext

            return f"Eval: 1\nMove: e4\nExplanation: Equal - task {TaskContext.get().partitionId()}"

    monkeypatch.setattr(P, "FEW_BOARDS", few, raising=False)
    got = P.run_jobs(*_board_jobs(spark, [f"j{k}" for k in range(200)]), Where).collect()
    assert len(got) == 200 and all(r.t2_legal for r in got)
    assert len({r.t3_explanation for r in got}) == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1


def test_each_job_gives_one_record(spark):
    got = P.run_jobs(*_board_jobs(spark, ["a", "a", None, "b"]), Stub).collect()
    assert sorted(str(r.job_id) for r in got) == ["None", "a", "a", "b"]


def test_moves_of_a_board_are_generated_once_for_all_its_jobs(spark):
    """Rows that the functions with the rules of chess got: with moves generated, one for each board; without, one for each job."""
    fens = ["rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1", "8/8/8/3k4/8/3K4/4R3/8 w - - 0 1", None, "no board"]
    df = P.run_jobs(*_board_jobs(spark, [f"j{k}" for k in range(400)], fens), Stub)
    assert df.count() == 400
    df.collect()
    seen = {}

    def walk(node):
        inner = {"AdaptiveSparkPlanExec": "executedPlan", "ReusedExchangeExec": "child"}.get(node.getClass().getSimpleName())
        if inner or node.getClass().getSimpleName().endswith("QueryStageExec"):
            walk(getattr(node, inner or "plan")())
        children = node.children()
        for k in range(children.size()):
            walk(children.apply(k))
        if node.getClass().getSimpleName() == "ArrowEvalPythonExec":
            for name in ("legal_lists", "legal_moves", "is_legal", "rescue_move", "settle"):
                if f"{name}(" in node.simpleString(200):
                    seen[name] = seen.get(name, 0) + node.metrics().apply("pythonNumRowsReceived").value()

    walk(df._jdf.queryExecution().executedPlan())
    assert seen == {"legal_lists": len(fens), "settle": 400}


def test_unknown_models_are_errors(spark):
    meta = spark.createDataFrame([("a", "A", 1)], "model string, family string, size int")
    assert P.known_family(spark.createDataFrame([("a",)], "model string"), meta).first().exact_family == "A"
    with pytest.raises(Exception, match="unknown model zzz"):
        P.known_family(spark.createDataFrame([("zzz",)], "model string"), meta).collect()
