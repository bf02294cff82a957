"""Whole jobs, composed of the operators: dataset build, job population, job execution, metric suite."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import board_udfs, parser, prompts
from ..functions import exprs as X
from ..operators import aggs, generate, joins, windows
from ..operators import hypothesis as H
from ..operators.derive import derive
from ..sources import writers
from .fixture import MODELS, POSITIONS, WITH, evals, positions
from .metrics import DERIVED, derived


def unique_ids(rows: DataFrame, text: str = "fen", order: str = "ord") -> DataFrame:
    """Adds a 32-bit ``id`` from the text's hash. Rows that collide hash the text with a counter until all differ; the first keeps its own."""
    out = rows.withColumn("_try", F.lit(0))
    while True:
        salted = F.when(F.col("_try") == 0, F.col(text)).otherwise(F.concat(F.col(text), F.lit("#"), F.col("_try").cast("string")))
        out = out.withColumn("id", X.id32(salted))
        rank = F.row_number().over(windows.Window.partitionBy("id").orderBy("_try", order)) - 1
        clash = out.withColumn("_rank", rank)
        if not clash.where("_rank > 0").limit(1).count():
            return out.drop("_try")
        out = clash.withColumn("_try", F.col("_try") + F.col("_rank")).drop("_rank", "id")


def build_dataset(sources: Sequence[DataFrame], per_tier: int, seed: int = 42) -> DataFrame:
    """Positions of all sources: the first of each FEN in the order of sources and tiers, sampled per tier, with ids."""
    union = None
    for k, df in enumerate(sources):
        part = df.withColumn("ord", F.concat(F.lit(f"{k}:"), F.format_string("%d", windows.in_order(("easy", "medium", "hard", "extreme"), "difficulty")), F.lit(":"), F.sha2("fen", 256)))
        union = part if union is None else union.unionByName(part, allowMissingColumns=True)
    unique = windows.dedup_first(union, ["fen"], "ord")
    return unique_ids(windows.stratified_sample(unique, "difficulty", "fen", per_tier, seed)).drop("ord")


def populate_jobs(existing: DataFrame, dataset: DataFrame, models: Sequence[str], formats: Sequence[str], tier: str | None = None, per_tier: int | None = None) -> DataFrame:
    """The jobs that a dataset, models and formats call for and that do not exist yet."""
    if tier is not None:
        dataset = dataset.where(F.col("difficulty") == tier)
    if per_tier is not None:
        dataset = windows.stratified_sample(dataset, "difficulty", "position_id", per_tier)
    return joins.insert_if_absent(existing, joins.job_matrix(dataset, models, formats), "job_id")


#: So many positions with their legal moves, under 1 KB each, are broadcast; more are joined by a shuffle.
FEW_BOARDS = 50_000


def run_jobs(jobs: DataFrame, dataset: DataFrame, provider: Callable[[], Callable[[str, str], str]]) -> DataFrame:
    """Jobs through prompt, model, parser, move rescue and scoring, as result records: one for each job. A failed call leaves a record without answers.

    Legal moves are generated once for each position that has jobs, and handed to its jobs.
    Jobs are dealt by number, as their bytes say nothing of what a model's call costs.
    """
    parts = int(jobs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    used = dataset.join(jobs.select("position_id").distinct(), "position_id", "left_semi")
    dim = used.select("position_id", "fen", F.col("t1_stockfish_eval").alias("truth"), "difficulty", "phase", "source", "theme", "t2_best_move")
    boards = dim.repartition(parts, "position_id").withColumn("legal", board_udfs.legal_lists("fen")).select("*", "legal.san", "legal.uci").drop("legal")
    if dim.limit(FEW_BOARDS + 1).count() <= FEW_BOARDS:
        work = joins.at_positions(jobs.repartition(parts, "job_id"), F.broadcast(boards))
    else:
        work = joins.at_positions(jobs, boards).repartition(parts, "job_id")
    asked = work.withColumn("prompt", prompts.build(F.col("fen"), F.lit(""), F.col("prompt_format"), F.split("san", " ")))
    answers = generate.infer(asked, provider, columns=work.columns).drop("success", "error", "inference_ms")
    takes_move = ~F.col("prompt_format").isin("eval_only", "explanation_only")
    parsed = answers.withColumn("p", parser.parse(F.col("response"), F.col("prompt_format")))
    settled = parsed.withColumn("m", board_udfs.settle("fen", *(F.when(takes_move, F.col(c)) for c in ("san", "uci", "p.move", "response"))))
    scored = settled.withColumns({
        "t2_move": F.when(takes_move, F.col("m.move")),
        "t1_model_eval": F.when(~F.col("prompt_format").isin("move_only", "explanation_only"), F.col("p.eval")), "t1_stockfish_eval": F.col("truth"),
        "t2_legal": F.when(takes_move, F.col("m.legal")), "t3_explanation": F.col("p.explanation"), "t3_side_claimed": F.col("p.side_claimed"),
        "parse_errors": F.col("p.parse_errors"), "model_family": X.model_family(F.col("model")), "model_size_b": X.model_size(F.col("model")),
    })
    return writers.result_record(
        scored.withColumns({
            **X.score_t1(F.col("t1_model_eval"), F.col("t1_stockfish_eval")), **X.score_t3(F.col("t3_explanation"), F.col("t3_side_claimed"), F.col("t1_stockfish_eval"), F.col("theme")),
            "t2_cpl": F.when(F.col("t2_legal") & (F.col("t2_move") == F.col("t2_best_move")), 0),
        })
    )


def metric_suite(results: DataFrame) -> dict[str, DataFrame]:
    """The metric tables of a result log, for writers.metrics."""
    df = derive(results).cache()
    return {
        "by_model": aggs.by_model(df), "by_difficulty": aggs.by_difficulty(df), "by_phase": aggs.by_phase(df), "by_source": aggs.by_source(df), "by_model_family": aggs.by_family(df),
        "hallucination_rate": aggs.hallucination_rate(df), "summary": aggs.summary(df), "hypotheses": H.h1(df).unionByName(H.h2(df)).unionByName(H.h3(df)),
    }


def preferred(df: DataFrame, new: str, old: str) -> Column:
    """The new column if the table has it, else the old one: by table, not by row."""
    return F.col(new if new in df.columns else old).alias(old)


def known_family(results: DataFrame, meta: DataFrame) -> DataFrame:
    """Results with the family and size of their exact model tag; a tag without entry is an error."""
    out = results.join(joins.small(meta.select("model", F.col("family").alias("exact_family"), F.col("size").alias("exact_size"))), "model", "left")
    return out.withColumn("exact_family", F.coalesce("exact_family", F.raise_error(F.concat(F.lit("unknown model "), F.col("model")))))


def provenance(results: DataFrame) -> DataFrame:
    """What a metric table rests on: rows, distinct jobs, first and last time, and a digest that any change of rows changes."""
    row = F.xxhash64("job_id", "model", "t1_model_eval", "t2_move", "t2_cpl")
    return results.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("job_id").alias("jobs"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.bit_xor(row).alias("digest"))


def _sources(s, d):
    pos = positions(evals(s, d))
    return [pos.where("position_id % 3 = 0").select("fen", "difficulty", "theme"), pos.where("position_id % 2 = 0").select("fen", "difficulty", "phase")]


def _jobs(s, d):
    pos, models = positions(evals(s, d)), [m for m, _, _ in MODELS[:4]]
    old = joins.job_matrix(pos.where("position_id < 100"), models, ["cot"]).select("job_id", "hash")
    return populate_jobs(old, pos, models, ["cot", "fen_only"], tier="easy").select("job_id", "position_id", "model", "prompt_format")


_LIST = ", ".join(f"('{m}')" for m, _, _ in MODELS[:4])

QUERIES = {
    "dataset_build": (
        lambda s, d: build_dataset(_sources(s, d), 30).select("fen", "difficulty", "theme", "phase", "id"),
        f"""{WITH}, pos AS ({POSITIONS}), u AS (SELECT fen, difficulty, CASE WHEN position_id % 3 = 0 THEN theme END AS theme, CASE WHEN position_id % 3 <> 0 THEN phase END AS phase FROM pos WHERE position_id % 3 = 0 OR position_id % 2 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY difficulty ORDER BY sha256(fen || ':42'), fen) AS k FROM u) SELECT fen, difficulty, theme, phase, ('0x' || substr(sha256(fen), 1, 8))::BIGINT AS id FROM r WHERE k <= 30""",
    ),
    "job_population": (
        _jobs,
        f"""{WITH}, pos AS ({POSITIONS}), m(model) AS (VALUES {_LIST}), f(prompt_format) AS (VALUES ('cot'), ('fen_only'))
        SELECT 'job_' || lpad(position_id::VARCHAR, 5, '0') || '_' || translate(model, ':.', '__') || '_' || prompt_format || '_1' AS job_id, position_id, model, prompt_format FROM pos, m, f
        WHERE difficulty = 'easy' AND NOT (position_id < 100 AND prompt_format = 'cot')""",
    ),
    "job_execution": (
        lambda s, d: run_jobs(evals(s, d).select("job_id", "job_type", "position_id", "model", "prompt_format", "status"), positions(evals(s, d)), generate.Stub),
        None,
    ),
    "metric_suite_sizes": (
        lambda s, d: s.createDataFrame([(name, df.count()) for name, df in metric_suite(evals(s, d)).items()], "name string, n long"),
        f"""{DERIVED} SELECT 'by_model' AS name, count(DISTINCT model) AS n FROM derived UNION ALL SELECT 'by_difficulty', count(DISTINCT (model, difficulty)) FROM derived UNION ALL SELECT 'by_phase', count(DISTINCT (model, phase)) FROM derived
        UNION ALL SELECT 'by_source', count(DISTINCT (model, source)) FROM derived UNION ALL SELECT 'by_model_family', count(DISTINCT (model_family, model_size_b)) FROM derived
        UNION ALL SELECT 'hallucination_rate', count(DISTINCT (model, difficulty)) FROM derived UNION ALL SELECT 'summary', 1 UNION ALL SELECT 'hypotheses', 7""",
    ),
    "preferred_column": (
        lambda s, d: derived(s, d).select("event_id", preferred(derived(s, d), "t2_legal_attempted", "t2_legal")),
        f"{DERIVED} SELECT event_id, t2_legal_attempted AS t2_legal FROM derived",
    ),
    "provenance": (lambda s, d: provenance(evals(s, d)), None),
}
