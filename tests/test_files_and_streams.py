from __future__ import annotations

import json
import uuid

import pytest
from pyspark.sql import functions as F

from evalkit.sources import readers, writers
from evalkit.streaming import streams


def test_json_lines_are_read_tolerantly(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"job_id": "a", "model": "m", "t2_cpl": 5}\n\n{"job_id": "b", "mod\n{"job_id": "c", "timestamp": "2024-01-01T00:00:00Z"}\n')
    assert {r.job_id: r.t2_cpl for r in readers.json_lines(spark, str(path)).collect()} == {"a": 5, "c": None}
    assert {r.job_id for r in readers.completed_ids(spark, str(path)).collect()} == {"a", "b", "c"}
    assert readers.json_lines(spark, str(tmp_path / "none")).collect() == [] and readers.completed_ids(spark, str(tmp_path / "none")).collect() == []


def test_tiers_are_read_in_order_and_the_last_wins(spark, tmp_path):
    for tier, fen in (("easy", "first"), ("hard", "last")):
        (tmp_path / f"{tier}.json").write_text(json.dumps([{"id": 7, "fen": fen, "difficulty": tier}, {"fen": "no id"}]))
    assert readers.tiers(spark, str(tmp_path)).count() == 4
    assert [(r.id, r.fen) for r in readers.keyed_positions(spark, str(tmp_path)).collect()] == [(7, "last")]


def test_later_logs_win(spark, tmp_path):
    for k, cpl in enumerate((1, 2)):
        (tmp_path / f"{k}.jsonl").write_text(json.dumps({"job_id": "a", "t2_cpl": cpl}) + "\n")
    assert [r.t2_cpl for r in readers.merged(spark, str(tmp_path / "0.jsonl"), str(tmp_path / "1.jsonl")).collect()] == [2]


def test_puzzles_become_positions(spark, tmp_path):
    path = tmp_path / "p.csv"
    start = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1"
    path.write_text(f"PuzzleId,FEN,Moves,Rating,RatingDeviation,Popularity,NbPlays,Themes,GameUrl,OpeningTags\n1,{start},e2e4,1700,,,,fork pin,,\n2,junk,,,,,,,,\n")
    rows = readers.puzzle_positions(readers.puzzles(spark, str(path))).collect()
    assert [(r.theme, r.difficulty, r.phase, r.rating) for r in rows] == [("fork", "hard", "opening", 1700)]


def test_api_lines_flat_or_nested(spark):
    lines = spark.createDataFrame([(0, '{"puzzle": {"fen": "a", "rating": 9, "themes": ["x"]}}'), (1, '{"fen": "b"}'), (2, "junk"), (3, '{"fen": "late"}')], "n int, value string")
    assert [tuple(r) for r in readers.api_puzzles(lines, 3).collect()] == [("a", 9, "x"), ("b", 1500, "tactics")]


def test_games_are_read_from_pgn(spark, tmp_path):
    path = tmp_path / "g.pgn"
    path.write_text('[Event "A"]\n[Site "x"]\n\n1. e4 {good} e5 2. Nf3 1-0\n\n[Event "B"]\n\n1. d4 d5 1/2-1/2\n')
    assert sorted(r.moves for r in readers.games(spark, str(path)).collect()) == [["d4", "d5"], ["e4", "e5", "Nf3"]]


def test_config_overrides_keep_types(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("workers:\n  count: 1\n  live: true\n  name: a\n")
    assert readers.config(str(path), "app", {"APP_WORKERS_COUNT": "4", "APP_WORKERS_LIVE": "false"}) == {"workers": {"count": 4, "live": False, "name": "a"}}


def test_replace_may_read_what_it_writes(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.append_json(spark.range(3).toDF("n"), path)
    writers.append_json(spark.range(3, 5).toDF("n"), path)
    writers.replace(spark.read.schema("n long").json(path).withColumn("n", F.col("n") * 10), path)
    assert sorted(r.n for r in spark.read.schema("n long").json(path).collect()) == [0, 10, 20, 30, 40]


def test_metric_files_of_empty_tables_go(spark, tmp_path):
    path = str(tmp_path / "m")
    full = spark.createDataFrame([("a", 1.5)], "model string, x double")
    assert writers.metrics({"by_model": full, "deltas": full}, path) == ["by_model", "deltas"]
    assert writers.metrics({"by_model": full, "deltas": full.limit(0)}, path) == ["by_model"]
    assert readers.exists(spark, f"{path}/by_model.csv") and not readers.exists(spark, f"{path}/deltas.csv")
    writers.document(spark, {"n": 1}, f"{path}/run.json")
    assert json.loads((tmp_path / "m" / "run.json").read_text()) == {"n": 1}


def test_result_records_have_all_fields(spark):
    rows = spark.createDataFrame([("a", 2, ["x"]), ("b", 1, [])], "job_id string, trial int, parse_errors array<string>")
    got = {r.job_id: r for r in writers.result_record(rows).collect()}
    assert got["a"].attempt == 2 and got["a"].parse_errors == ["x"] and got["b"].parse_errors is None and got["b"].model is None


def _name():
    return f"t_{uuid.uuid4().hex}"


def test_streams_equal_their_batches(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    path = str(tmp_path / "ev")
    events.repartition(4).write.parquet(path)
    stream = lambda: streams.file_stream(spark, path, events.schema, "parquet", 1)
    rows = lambda df: sorted(map(repr, map(tuple, df.collect())))
    assert rows(streams.finish(streams.model_counts(stream()), "complete", _name())) == rows(streams.model_counts(events))
    assert rows(streams.finish(streams.sliding_rate(stream(), "60 minutes", "30 minutes"), "complete", _name())) == rows(streams.sliding_rate(events, "60 minutes", "30 minutes"))
    twice = str(tmp_path / "twice")
    events.union(events).repartition(3).write.parquet(twice)
    assert streams.finish(streams.deduplicated(streams.file_stream(spark, twice, events.schema, "parquet"), late="3650 days"), "append", _name()).count() == events.count()


def test_job_states_follow_their_events(spark, tmp_path):
    path = str(tmp_path / "jobs")
    log = [("a", "claim", 1), ("a", "complete", 2), ("a", "claim", 3), ("b", "claim", 1), ("b", "reset", 5), ("c", "claim", 2), ("c", "fail", 3), ("c", "reset", 9)]
    df = spark.createDataFrame(log, "job_id string, event string, s long").select("job_id", "event", F.timestamp_seconds("s").alias("ts"))
    df.write.parquet(path)
    out = streams.finish(streams.job_states(streams.file_stream(spark, path, df.schema, "parquet")), "update", _name())
    assert {r.job_id: r.status for r in out.collect()} == {"a": "done", "b": "pending", "c": "pending"}


def test_streams_resume_from_their_checkpoint(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    schema = spark.range(1).schema
    for k in range(2):
        spark.range(k * 5, k * 5 + 5).write.mode("append").json(source)
        streams.to_files(streams.file_stream(spark, source, schema), out, mark)
    assert sorted(r.id for r in spark.read.schema(schema).json(out).collect()) == list(range(10))


def test_similar_positions_fall_back_to_the_tier(spark):
    from evalkit.operators.joins import similar_position

    pos = spark.createDataFrame([(1, "fork", "easy"), (2, "fork", "easy"), (3, "pin", "easy"), (4, "pin", "hard")], "position_id long, theme string, difficulty string")
    jobs = pos.selectExpr("concat('j', position_id) AS job_id", "position_id", "theme", "difficulty")
    got = {r.job_id: (r.follow_up, r.fell_back) for r in similar_position(jobs, pos, pos.limit(0)).collect()}
    assert got["j1"] == (2, False) and got["j2"] == (1, False) and got["j3"][1] and got["j4"] == (None, None)


@pytest.mark.parametrize("n", [0, 1])
def test_progress_of_no_jobs_is_zero(spark, n):
    from evalkit.operators.aggs import job_progress

    df = spark.createDataFrame([("done",)], "status string").limit(n)
    assert job_progress(df).first().percent == 100.0 * n
