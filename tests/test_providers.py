from __future__ import annotations

import json
import sys
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

from evalkit.functions.board import START, Board, legal_sans
from evalkit.operators import generate
from evalkit.sources import readers, writers

ENGINE = """
import sys
left = int(open(sys.argv[1]).read())
for line in sys.stdin:
    word = line.split()
    if word[0] == 'uci':
        print('uciok', flush=True)
    elif word[0] == 'position':
        fen = line
    elif word[0] == 'go':
        if left:
            open(sys.argv[1], 'w').write(str(left - 1))
            sys.exit()
        print('info depth 1 score cp', 30 if ' w ' in fen else 50, flush=True)
        print('bestmove e2e4', flush=True)
"""


class _Chat(BaseHTTPRequestHandler):
    seen: list = []

    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.seen.append(asked)
        body = json.dumps({"message": {"content": f"echo {asked['messages'][0]['content']}"}}).encode()
        self.send_response(200 if asked["model"] != "none" else 404)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


def test_chat_server_answers_and_failures_are_recorded(spark):
    server = HTTPServer(("127.0.0.1", 0), _Chat)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    jobs = spark.createDataFrame([("a", "m", "hello"), ("b", "none", "x")], "job_id string, model string, prompt string")
    got = {r.job_id: r for r in generate.infer(jobs, lambda: generate.ChatServer(url, {"num_ctx": 512}), retries=1).collect()}
    server.shutdown()
    assert (got["a"].response, got["a"].success, got["a"].error) == ("echo hello", True, None) and got["a"].inference_ms >= 0
    assert got["b"].response is None and not got["b"].success and "404" in got["b"].error
    assert _Chat.seen[0]["options"] == {"num_ctx": 512} and _Chat.seen[0]["stream"] is False


def test_engine_is_started_again_once(spark, tmp_path):
    script, dies = tmp_path / "engine.py", tmp_path / "dies"
    script.write_text(ENGINE)
    for times, value in ((0, 30), (1, 30), (9, None)):
        dies.write_text(str(times))
        make = lambda: generate.Engine([sys.executable, str(script), str(dies)], "depth 1")
        got = generate.evaluate(spark.createDataFrame([(Board.of(START).fen(),), (None,)], "fen string"), make).collect()
        assert [r.value for r in got] == [value]


def test_engine_losses(spark, tmp_path):
    script, dies = tmp_path / "engine.py", tmp_path / "dies"
    script.write_text(ENGINE)
    dies.write_text("0")
    fen = Board.of(START).fen()
    rows = spark.createDataFrame([("a", fen, "e4", "d4", True), ("b", fen, "d4", "d4", True), ("c", fen, "e5", "d4", False)], "job_id string, fen string, t2_move string, t2_best_move string, t2_legal boolean")
    got = {r.job_id: r.t2_cpl for r in generate.engine_losses(rows, lambda: generate.Engine([sys.executable, str(script), str(dies)], "depth 1")).collect()}
    assert got == {"a": 80, "b": 0, "c": None}  # 30 for White before; 50 for Black to move after


def test_retry_asks_again_and_judges(spark):
    class Flaky:
        calls = 0

        def __call__(self, model, prompt):
            if model == "gone":
                raise ConnectionError("gone")
            if model == "bad":
                raise ValueError("bad")
            Flaky.calls += 1
            if model == "late" and Flaky.calls % 3:
                raise TimeoutError("late")
            return "e4" if "not legal" in prompt else "Ke9"

    fen = Board.of(START).fen()
    mated = "rnb1kbnr/pppp1ppp/8/4p3/6Pq/5P2/PPPPP2P/RNBQKBNR w KQkq - 1 3"
    assert legal_sans(mated) == []
    rows = [("a", "m", fen, "e9", "e4"), ("b", "m", fen, "e9", "d4"), ("c", "m", fen, None, "e4"), ("d", "late", fen, "x", "e4"), ("e", "gone", fen, "x", "e4"), ("f", "bad", fen, "x", "e4"), ("g", "m", mated, "x", "e4")]
    df = spark.createDataFrame(rows, "job_id string, model string, fen string, t2_move string, t2_best_move string").coalesce(1)
    got = {r.job_id: (r.retried_move, r.retried_legal, r.retried_cpl, r.skipped) for r in generate.retry_moves(df, Flaky).collect()}
    assert got["a"] == got["d"] == ("e4", True, 0, None) and got["b"] == ("e4", True, None, None) and got["c"][1:] == (False, None, None)
    assert got["e"] == (None, None, None, "gone") and got["f"] == (None, None, None, "bad") and got["g"] == (None, None, None, "no legal moves")


def test_generators_know_their_themes_and_endgames():
    import random

    rng = random.Random(1)
    assert all(Board.of(f) for some in generate.THEME_STARTS.values() for f in some) and "discovery" in generate.THEME_STARTS
    board, _ = generate.themed(rng, "no such theme")
    assert len(board.fen().split()[0]) > 10
    kinds = {generate.make_position(k, 3)[4] for k in range(2, 200, 3)}
    assert kinds == {f"endgame_{k}" for k in generate.MIXED_ENDGAMES}


def test_replace_recovers_and_merged_takes_the_last_line(spark, tmp_path):
    path = str(tmp_path / "table")
    writers.replace(spark.createDataFrame([(1,)], "x int"), path)
    writers.replace(spark.read.json(path).selectExpr("x + 1 AS x"), path)
    assert [r.x for r in spark.read.json(path).collect()] == [2]
    (tmp_path / "table").rename(tmp_path / "table.old")  # as if cut between the renames
    writers.recover(spark, path)
    assert [r.x for r in spark.read.json(path).collect()] == [2] and not (tmp_path / "table.old").exists()
    one, two = tmp_path / "one.jsonl", tmp_path / "two.jsonl"
    one.write_text("".join(json.dumps({"job_id": f"j{k % 3}", "model": str(k)}) + "\n" for k in range(9)))
    two.write_text(json.dumps({"job_id": "j1", "model": "two"}) + "\n")
    got = {r.job_id: r.model for r in readers.merged(spark, str(one), str(two), str(tmp_path / "none.jsonl")).collect()}
    assert got == {"j0": "6", "j1": "two", "j2": "8"}
