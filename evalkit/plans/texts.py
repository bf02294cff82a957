"""Scalar functions, parsing, boards, prompts, inference and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import board_udfs, parser, prompts
from ..functions import exprs as X
from ..operators import generate, windows
from ..streaming import streams
from .fixture import MODELS, POSITIONS, WITH, evals, positions, table
from .metrics import _META, model_meta

_ROWS = "SELECT event_id, user_id, value, ts, event_type FROM events"
_P = "pos AS (" + POSITIONS + ")"


def _events(s, d):
    return table(s, d, "events")


def _words(s, d):
    return table(s, d, "documents").select("doc_id", "text")


_WORDS = "(SELECT doc_id, text FROM documents)"


def _stream(s, d):
    """The events as a stream of one file."""
    schema = table(s, d, "events").schema
    return s.readStream.format("parquet").schema(schema).option("pathGlobFilter", "events.parquet").load(d)


def _named(frame, mode):
    return streams.finish(frame, mode, f"q_{uuid.uuid4().hex}")


def _answers(s, d):
    """Answers in the shapes that models give, around the conversations' texts."""
    c = table(s, d, "conversations").select("conv_id", "turn", F.regexp_replace("text", "\\s+", " ").alias("t"))
    n = (F.col("conv_id") * 7 + F.col("turn") * 13) % 900 - 450
    ev = n.cast("string")
    shapes = [
        F.concat(F.lit("Eval: "), ev, F.lit("\nMove: Nf3\nExplanation: White - "), "t"),
        F.concat(F.lit("**1. Eval:** +"), ev, F.lit("\n**2. Move:** `e4`\n**3. Explanation:** Black is better. "), "t"),
        F.concat(F.lit("1. "), ev, F.lit("\n2. 12...Qxd5,\n3. Equal because "), "t"),
        F.concat("t", F.lit("\nmove: O-O.")),
    ]
    k = F.col("conv_id") % 4
    return c.withColumns({"n": n, "answer": F.when(k == 0, shapes[0]).when(k == 1, shapes[1]).when(k == 2, shapes[2]).otherwise(shapes[3])})


def _parse(s, d):
    p = parser.parse(F.col("answer"))
    return _answers(s, d).select("conv_id", "turn", "answer", p.alias("p")).select("conv_id", "turn", "p.eval", "p.move", "p.side_claimed", F.size("p.parse_errors").alias("n_errors"))


def _parse_labelled(s, d):
    return _parse(s, d).select("conv_id", "turn", "eval", "move", "side_claimed", "n_errors")


def _boards(s, d):
    return positions(evals(s, d)).select("position_id", "fen")


def _stub(s, d):
    jobs = evals(s, d).select("job_id", "model", prompts.build(F.col("fen"), F.lit(""), F.col("prompt_format")).alias("prompt"))
    out = generate.infer(jobs, generate.Stub)
    p = parser.parse(F.col("response"))
    return out.select("job_id", "model", "success", p.alias("p")).select("job_id", "model", "success", "p.eval", "p.move", "p.side_claimed")


def _dedup_eval(s, d):
    def score(batches):
        for pdf in batches:
            yield pdf.assign(eval_before=pdf["fen"].map(lambda f: len(f) * 7 % 400 - 200))

    work = evals(s, d).select("event_id", "fen")
    return generate.dedup_eval(work, ["fen"], "fen string, eval_before long", score).select("event_id", "eval_before")


def _predict(s, d):
    """A linear model over vectors, in Arrow batches."""
    return table(s, d, "embeddings").select("vec_id", F.round(generate.head_sum("embedding"), 4).alias("score"))


QUERIES = {
    "fen_features": (
        lambda s, d: positions(evals(s, d)).select("position_id", X.white_to_move(F.col("fen")).alias("white"), X.pieces(F.col("fen"), "a-zA-Z").alias("pieces"), X.phase(F.col("fen"), (F.col("position_id") % 40)).alias("phase")),
        f"""{WITH}, {_P}, c AS (SELECT position_id, split_part(fen, ' ', 2) = 'w' AS white, length(regexp_replace(split_part(fen, ' ', 1), '[^a-zA-Z]', '', 'g')) AS pieces, length(regexp_replace(split_part(fen, ' ', 1), '[^qQ]', '', 'g')) AS q,
        length(regexp_replace(split_part(fen, ' ', 1), '[^rbnRBN]', '', 'g')) AS m FROM pos)
        SELECT position_id, white, pieces, CASE WHEN position_id % 40 <= 20 AND pieces >= 28 THEN 'opening' WHEN pieces <= 10 OR (q = 0 AND m <= 4) THEN 'endgame' ELSE 'middlegame' END AS phase FROM c""",
    ),
    "position_id_hash": (
        lambda s, d: positions(evals(s, d)).select("fen", X.id32(F.col("fen")).alias("id"), X.content_hash(F.col("position_id"), F.lit("m"), F.lit(1)).alias("hash")),
        f"{WITH}, {_P} SELECT fen, ('0x' || substr(sha256(fen), 1, 8))::BIGINT AS id, sha256(position_id::VARCHAR || 'm' || '1') AS hash FROM pos",
    ),
    "model_info": (
        lambda s, d: model_meta(s).select("model", X.model_family(F.col("model")).alias("family"), X.model_size(F.col("model")).alias("size_b"), X.short_name(F.col("model")).alias("short"), X.slug(F.col("family")).alias("slug")),
        f"""WITH {_META} SELECT model, CASE WHEN model LIKE 'qwen%' THEN 'qwen' WHEN model LIKE 'llama%' THEN 'llama' WHEN model LIKE 'mistral%' THEN 'mistral' WHEN model LIKE 'phi%' THEN 'phi' WHEN model LIKE 'gemma%' THEN 'gemma' ELSE 'unknown' END AS family,
        coalesce(try_cast(replace(split_part(model, ':', 2), 'b', '') AS DOUBLE), 0) AS size_b, replace(replace(model, 'deepseek-r1', 'ds-r1'), 'command-r', 'cmd-r') AS short, replace(translate(lower(family), ' -', '__'), '.', '') AS slug FROM meta""",
    ),
    "parallelism_rules": (
        lambda s, d: model_meta(s).select("model", X.parallelism(F.col("model")).alias("r")).select("model", "r.*"),
        f"WITH {_META}, r AS (SELECT model, CASE " + " ".join(f"WHEN regexp_matches(model, '{p}') THEN [{a}, {b}]" for p, a, b in X.PARALLELISM) + " END AS v FROM meta) SELECT model, v[1] AS num_parallel, v[2] AS workers FROM r",
    ),
    "model_options": (
        lambda s, d: model_meta(s).select("model", X.model_options(F.col("model")).alias("o")).select("model", "o.*"),
        f"WITH {_META} SELECT model, CASE WHEN model LIKE '%70b%' OR model LIKE '%72b%' THEN 26 END AS num_gpu, CASE WHEN model LIKE '%70b%' OR model LIKE '%72b%' THEN 512 ELSE 1024 END AS num_ctx, 400 AS num_predict FROM meta",
    ),
    "first_integer": (
        lambda s, d: _events(s, d).select("event_id", X.first_integer(F.concat(F.lit("about "), (F.col("event_id") % 300 - 150).cast("string"), F.lit(".5 or so"))).alias("n")),
        f"SELECT event_id, event_id % 300 - 150 AS n FROM ({_ROWS})",
    ),
    "move_cleaner": (
        lambda s, d: _words(s, d).select("doc_id", X.clean_move(F.concat(F.lit(" **"), (F.col("doc_id") % 40).cast("string"), F.lit("...`"), F.split("text", " ")[0], F.lit("`**., best\nsecond"))).alias("move")),
        f"SELECT doc_id, nullif(regexp_replace(regexp_extract(text, '^([^ \\n\\t]*)', 1), '[.,;:]+$', ''), '') AS move FROM (SELECT doc_id, replace(split_part(text, ' ', 1), '**', '') || '.,' AS text FROM {_WORDS})",
    ),
    "moves_to_pgn": (
        lambda s, d: _events(s, d).select("event_id", X.moves_to_pgn(F.slice(F.array(*map(F.lit, ("e4", "e5", "Nf3", "Nc6", "Bb5"))), 1, (F.col("event_id") % 5 + 1).cast("int"))).alias("pgn")),
        f"SELECT event_id, array_to_string(list_transform(range(event_id % 5 + 1), lambda i: CASE WHEN i % 2 = 0 THEN (i // 2 + 1)::VARCHAR || '. ' ELSE '' END || (['e4', 'e5', 'Nf3', 'Nc6', 'Bb5'])[i + 1]), ' ') AS pgn FROM ({_ROWS})",
    ),
    "wdl_to_cp": (
        lambda s, d: _events(s, d).select("event_id", X.wdl_to_cp(F.col("event_id") % 101 / 100.0 * 0.7, F.lit(0.3)).alias("cp")),
        f"SELECT event_id, CASE WHEN s >= 0.999 THEN 10000 WHEN s <= 0.001 THEN -10000 ELSE greatest(-10000, least(10000, trunc(111.714::DOUBLE * tan(1.5620688::DOUBLE * (s - 0.5)))::INT)) END AS cp FROM (SELECT event_id, event_id % 101 / 100.0::DOUBLE * 0.7::DOUBLE + 0.3::DOUBLE / 2 AS s FROM ({_ROWS}))",
    ),
    "engine_lines": (
        lambda s, d: _events(s, d).select(
            "event_id",
            X.engine_score(F.array(F.lit("info depth 1 score cp 13"), F.concat(F.lit("info depth 9 score "), F.when(F.col("event_id") % 5 == 0, "mate ").otherwise("cp "), (F.col("event_id") % 21 - 10).cast("string")), F.lit("bestmove e2e4")), F.col("event_id") % 2 == 0).alias("cp"),
        ),
        f"SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END * CASE WHEN event_id % 5 <> 0 THEN n WHEN n > 0 THEN 10000 - 10 * n ELSE -10000 - 10 * n END AS cp FROM (SELECT event_id, event_id % 21 - 10 AS n FROM ({_ROWS}))",
    ),
    "camel_words": (
        lambda s, d: positions(evals(s, d)).select("theme").distinct().select("theme", X.camel_words(F.col("theme")).alias("words")),
        f"{WITH} SELECT DISTINCT theme, lower(regexp_replace(theme, '([A-Z])', ' \\1', 'g')) AS words FROM evals",
    ),
    "first_theme": (
        lambda s, d: _words(s, d).select("doc_id", X.first_theme(F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("  "), F.element_at(F.split("text", " "), 1), F.lit(" x")))).alias("theme")),
        f"SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN regexp_extract(split_part(text, ' ', 1), '^[^\\s]*') ELSE 'tactics' END AS theme FROM {_WORDS}",
    ),
    "display_texts": (
        lambda s, d: _events(s, d).select("event_id", X.eta_text(F.col("event_id") * 37).alias("eta"), X.progress_bar(F.col("event_id") % 100, F.lit(100)).alias("bar"), X.duration_seconds(F.concat((F.col("event_id") % 90).cast("string"), F.element_at(F.array(*map(F.lit, ("h", "m", "s", ""))), (F.col("event_id") % 4 + 1).cast("int")))).alias("seconds")),
        f"""SELECT event_id, CASE WHEN t // 3600 > 0 THEN '~' || (t // 3600) || 'h ' || (t % 3600 // 60) || 'm' ELSE '~' || (t % 3600 // 60) || 'm ' || (t % 60) || 's' END AS eta,
        repeat('#', (event_id % 100 * 20 // 100)::INT) || repeat('-', (20 - event_id % 100 * 20 // 100)::INT) AS bar, (event_id % 90) * CASE event_id % 4 WHEN 0 THEN 3600 WHEN 2 THEN 1 ELSE 60 END AS seconds FROM (SELECT event_id, event_id * 37 AS t FROM ({_ROWS}))""",
    ),
    "stamps": (
        lambda s, d: _events(s, d).select("event_id", X.utc_stamp(F.col("ts")).alias("stamp"), X.run_id(F.col("ts")).alias("run_id"), X.parse_stamp(X.utc_stamp(F.col("ts"))).cast("timestamp_ntz").alias("back")),
        f"SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp, strftime(ts, '%Y%m%d_%H%M%S') AS run_id, date_trunc('second', ts)::TIMESTAMP AS back FROM ({_ROWS})",
    ),
    "clean_numbers": (
        lambda s, d: _events(s, d).select("event_id", F.round(X.clean_number(F.when(F.col("event_id") % 5 == 0, float("nan")).when(F.col("event_id") % 7 == 0, float("inf")).otherwise(F.col("value"))), 6).alias("value"), X.round1(F.col("event_id") / 4.0).alias("rounded")),
        f"SELECT event_id, CASE WHEN event_id % 5 <> 0 AND event_id % 7 <> 0 THEN round(value, 6) END AS value, round_even(event_id / 4.0::DOUBLE, 1) AS rounded FROM ({_ROWS})",
    ),
    "parse_response": (_parse, None),
    "parse_labelled": (
        _parse_labelled,
        """SELECT conv_id, turn, CASE WHEN conv_id % 4 < 3 THEN (conv_id * 7 + turn * 13) % 900 - 450 END AS eval, CASE conv_id % 4 WHEN 0 THEN 'Nf3' WHEN 1 THEN 'e4' WHEN 2 THEN 'Qxd5' ELSE 'O-O' END AS move,
        CASE conv_id % 4 WHEN 0 THEN 'White' WHEN 1 THEN 'Black' WHEN 2 THEN 'Equal' END AS side_claimed, CASE WHEN conv_id % 4 < 3 THEN 0 ELSE 2 END AS n_errors FROM conversations""",
    ),
    "parse_eval_only": (
        lambda s, d: _answers(s, d).select("conv_id", "turn", parser.parse(F.concat(F.lit("I say "), F.col("n").cast("string")), F.lit("eval_only"))["eval"].alias("eval")),
        "SELECT conv_id, turn, (conv_id * 7 + turn * 13) % 900 - 450 AS eval FROM conversations",
    ),
    "parse_explanation": (lambda s, d: _answers(s, d).select("conv_id", "turn", parser.parse(F.col("answer"), F.lit("explanation_only")).alias("p")).select("conv_id", "turn", "p.eval", "p.explanation", "p.side_claimed"), None),
    "prompts": (lambda s, d: positions(evals(s, d)).select("position_id", F.explode(F.array(*map(F.lit, ("fen_only", "pgn+fen", "cot", "eval_only", "explanation_only", "move_only")))).alias("fmt"), "fen").select("position_id", "fmt", prompts.build(F.col("fen"), F.lit("1. e4 e5"), F.col("fmt"), board_udfs.legal_moves("fen")).alias("prompt")), None),
    "follow_up_prompts": (
        lambda s, d: evals(s, d).where("t2_move is not null").select(
            "event_id",
            F.md5(prompts.retry(F.col("fen"), F.when(F.col("event_id") % 3 > 0, F.col("t2_move")), F.array(F.lit("e4"), F.lit("d4")))).alias("retry"),
            F.md5(prompts.correction(F.col("fen"), F.col("t2_move"), F.col("t2_best_move"), F.lit("F2"), F.lit(""), F.lit("fen_only"))).alias("correction"),
        ),
        f"""{WITH} SELECT event_id, md5(CASE WHEN event_id % 3 > 0 THEN 'Your previous move "' || t2_move || '" is not legal in this position.' ELSE '{prompts.NO_MOVE}' END
        || replace(replace('{prompts.RETRY}', '{{fen}}', fen), '{{legal}}', 'e4, d4')) AS retry,
        md5(replace(replace(replace('{prompts.FEEDBACK}', '{{fen}}', fen), '{{move}}', t2_move), '{{best}}', t2_best_move) || '{(prompts.INTRO + prompts.FEN.replace("{fen}", "F2") + prompts.QUESTIONS + prompts.FORMAT).replace("'", "''")}') AS correction
        FROM evals WHERE t2_move IS NOT NULL""",
    ),
    "legal_moves": (lambda s, d: _boards(s, d).select("position_id", F.size(board_udfs.legal_moves("fen")).alias("n"), F.array_sort(board_udfs.legal_moves("fen")).alias("moves")), None),
    "move_legality": (lambda s, d: _boards(s, d).select("position_id", board_udfs.is_legal("fen", F.lit("Nc3")).alias("legal"), board_udfs.fen_after("fen", F.lit("Nc3")).alias("after")), None),
    "rescue_move": (lambda s, d: _boards(s, d).select("position_id", board_udfs.rescue_move("fen", F.lit("I would play 12...Qxh9, or g1f3! maybe Kd2.")).alias("move")), None),
    "validate_position": (lambda s, d: _boards(s, d).select("position_id", board_udfs.valid_position("fen").alias("valid")), None),
    "planes": (lambda s, d: _boards(s, d).select("position_id", F.size(board_udfs.planes("fen")).alias("size"), F.aggregate(board_udfs.planes("fen"), F.lit(0.0), lambda a, x: a + x).alias("total")), None),
    "gen_positions": (lambda s, d: generate.positions(s, 60), None),
    "llm_stub_pipeline": (_stub, None),
    "engine_dedup_eval": (_dedup_eval, f"{WITH} SELECT event_id, length(fen) * 7 % 400 - 200 AS eval_before FROM evals"),
    "batch_predict": (_predict, "SELECT vec_id, round(list_sum(list_transform(embedding[1:8], lambda x: x::DOUBLE)), 4) AS score FROM embeddings"),
    "stream_model_counts": (
        lambda s, d: _named(streams.model_counts(_stream(s, d)), "complete"),
        "SELECT event_type, count(*) AS n, max(ts) AS latest FROM events GROUP BY event_type",
    ),
    "stream_dedup": (
        lambda s, d: _named(streams.deduplicated(_stream(s, d), "user_id", "3650 days").select("user_id"), "append"),
        "SELECT DISTINCT user_id FROM events",
    ),
    "stream_sliding_rate": (
        lambda s, d: _named(streams.sliding_rate(_stream(s, d), "60 minutes", "30 minutes"), "complete"),
        """WITH w AS (SELECT unnest([date_trunc('hour', ts) + INTERVAL 30 MINUTE * (minute(ts) // 30), date_trunc('hour', ts) + INTERVAL 30 MINUTE * (minute(ts) // 30 - 1)]) AS window_start, ts FROM events)
        SELECT window_start, count(*) AS n, CASE WHEN count(*) >= 2 AND max(ts) > min(ts) THEN round((count(*) - 1) * 1e6 / (epoch_us(max(ts)) - epoch_us(min(ts))), 6) END AS rate FROM w GROUP BY window_start""",
    ),
}
