"""Position generators and inference operators: one seed per row, so that a row never depends on its partition."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import board_udfs, prompts
from ..functions import exprs as X
from ..functions.board import START, Board
from ..functions.board import is_legal as board_is_legal
from ..functions.parser import clean_token
from .joins import enrich_losses

_OUT = "row long, kind string, fen string, moves int, theme string, attempts int"
#: The pieces of each endgame beside the kings, White's first; and those that a mixed set draws from.
ENDGAMES = {"KQvK": ("Q", ""), "KRvK": ("R", ""), "KBBvK": ("BB", ""), "KBNvK": ("BN", ""), "KPvK": ("P", ""), "KRvKR": ("R", "r"), "KPvKP": ("P", "p")}
MIXED_ENDGAMES = ("KQvK", "KRvK", "KPvK", "KRvKR", "KPvKP")
#: Positions from which themed games begin.
THEME_STARTS = {
    "fork": ["r1bqkb1r/pppp1ppp/2n2n2/4p2Q/2B1P3/8/PPPP1PPP/RNB1K1NR w KQkq - 4 4", "r1bqkbnr/pppp1ppp/2n5/4p3/2B1P3/5N2/PPPP1PPP/RNBQK2R w KQkq - 4 4"],
    "pin": ["r1bqkbnr/pppp1ppp/2n5/1B2p3/4P3/5N2/PPPP1PPP/RNBQK2R b KQkq - 3 3", "rnbqk1nr/pppp1ppp/4p3/8/1bPP4/2N5/PP2PPPP/R1BQKBNR w KQkq - 2 4"],
    "skewer": ["8/8/8/3k4/8/3B4/3K4/8 w - - 0 1"],
    "passed_pawn": ["8/5P2/8/8/8/8/8/4K2k w - - 0 1", "8/8/8/8/8/5p2/8/4K2k b - - 0 1"],
    "discovery": ["r1bqkbnr/pppp1ppp/2n5/4p3/2B1P3/5N2/PPPP1PPP/RNBQK2R w KQkq - 4 4"],
}


def random_play(rng: random.Random, board: Board, low: int, high: int) -> tuple[Board, int]:
    """A game of random legal moves; it stops early where there are none."""
    n = 0
    for n in range(rng.randint(low, high) + 1):
        moves = board.legal()
        if not moves:
            break
        board = board.push(rng.choice(moves)) if n < high else board
    return board, n


def themed(rng: random.Random, theme: str) -> tuple[Board, int]:
    """Up to three random moves from one of the theme's positions; an unknown theme is a random game."""
    if theme not in THEME_STARTS:
        return random_play(rng, Board.of(START), 10, 60)
    return random_play(rng, Board.of(rng.choice(THEME_STARTS[theme])), 0, 3)


def endgame(rng: random.Random, kind: str) -> Board:
    """The pieces of an endgame on random squares, pawns on none of the outer ranks; an unknown kind is any."""
    white, black = ENDGAMES[kind if kind in ENDGAMES else rng.choice(list(ENDGAMES))]
    cells = ["."] * 64
    for piece in "Kk" + white + black:
        free = [s for s in range(64) if cells[s] == "." and (piece not in "Pp" or 8 <= s < 56)]
        cells[rng.choice(free)] = piece
    return Board("".join(cells), rng.random() < 0.5)


def make_position(row: int, seed: int, tries: int = 30, themes: tuple[str, ...] = tuple(THEME_STARTS)) -> tuple:
    """A valid position: by rows in turn from random play, from a theme's position, and an endgame. ``tries`` is ten for each position of a set, as a kind has a third of them."""
    rng = random.Random(f"{seed}:{row}")
    kind = ("random", "themed", "endgame")[row % 3]
    theme = None
    for attempt in range(1, tries + 1):
        if kind == "random":
            board, moves = random_play(rng, Board.of(START), 10, 60)
        elif kind == "themed":
            theme = rng.choice(themes)
            board, moves = themed(rng, theme)
        else:
            config = rng.choice(MIXED_ENDGAMES)
            theme, board, moves = f"endgame_{config}", endgame(rng, config), 0
        if board.valid():
            return row, kind, board.fen(), moves, theme, attempt
    return row, kind, None, 0, theme, tries


def positions(spark: SparkSession, count: int, seed: int = 42) -> DataFrame:
    """``count`` positions, fewer where no valid one was found, with their phase and id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([make_position(int(r), seed) for r in pdf["id"]], columns=["row", "kind", "fen", "moves", "theme", "attempts"])

    made = spark.range(count).mapInPandas(run, _OUT).where("fen is not null")
    return made.withColumns({"phase": X.phase(F.col("fen"), F.col("moves")), "position_id": X.id32(F.col("fen"))})


def dedup_eval(work: DataFrame, key: list[str], schema: str, evaluate: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> DataFrame:
    """Runs a costly evaluation once per distinct key and joins its results back."""
    return work.join(work.select(*key).distinct().mapInPandas(evaluate, schema), key, "left")


@F.pandas_udf(T.DoubleType())
def head_sum(vectors: pd.Series) -> pd.Series:
    """A linear model in batches: the sum of a vector's first eight values."""
    return pd.Series(np.stack(vectors.to_numpy())[:, :8].astype(np.float64).sum(axis=1))


class Stub:
    """A model that answers from a hash of its prompt: what tests and dry runs use in place of a server."""

    def __call__(self, model: str, prompt: str) -> str:
        import hashlib

        h = int(hashlib.sha256(f"{model}|{prompt}".encode()).hexdigest()[:8], 16)
        return f"Eval: {h % 801 - 400}\nMove: {('e4', 'Nf3', 'O-O', 'd4')[h % 4]}\nExplanation: {('White', 'Black', 'Equal')[h % 3]} - because of the structure"


class ChatServer:
    """A model behind an HTTP chat interface: one JSON request per prompt, the whole answer at once."""

    def __init__(self, url: str, options: dict | None = None, timeout: float = 120.0):
        self.url, self.options, self.timeout = url.rstrip("/"), options or {}, timeout

    def __call__(self, model: str, prompt: str) -> str:
        import json
        import urllib.request

        body = {"model": model, "messages": [{"role": "user", "content": prompt}], "stream": False, "options": self.options}
        request = urllib.request.Request(f"{self.url}/api/chat", json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return json.load(answer)["message"]["content"]


class Engine:
    """A chess engine that speaks UCI in a process of its own, started once per task and again, once for each request, if it dies."""

    def __init__(self, command: list[str], go: str = "depth 15"):
        self.command, self.go, self.process = command, go, None

    def _start(self) -> None:
        import subprocess

        self.close()
        self.process = subprocess.Popen(self.command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True, bufsize=1)
        self._ask("uci", "uciok")

    def _ask(self, text: str, last: str) -> list[str]:
        self.process.stdin.write(f"{text}\n")
        self.process.stdin.flush()
        lines = []
        for line in self.process.stdout:
            lines.append(line.strip())
            if lines[-1].startswith(last):
                return lines
        raise OSError("the engine ended")

    def lines(self, fen: str) -> list[str]:
        """What the engine says about a position, up to its best move."""
        for again in (True, False):
            try:
                if self.process is None:
                    self._start()
                return self._ask(f"position fen {fen}\ngo {self.go}", "bestmove")
            except OSError:
                self.close()
                if not again:
                    raise
        return []

    def close(self) -> None:
        if self.process is not None:
            self.process.kill()
            self.process.wait()
            self.process = None


def evaluate(positions: DataFrame, make: Callable[[], Engine]) -> DataFrame:
    """(fen, value): the engine's value of each distinct position for White; null where it fails twice."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = make()
        try:
            for pdf in batches:
                said = []
                for fen in pdf["fen"]:
                    try:
                        said.append(engine.lines(fen))
                    except OSError:
                        said.append([])
                yield pd.DataFrame({"fen": pdf["fen"], "said": said})
        finally:
            engine.close()

    out = positions.select("fen").where("fen is not null").distinct().mapInPandas(run, "fen string, said array<string>")
    return out.select("fen", X.engine_score(F.col("said"), X.white_to_move(F.col("fen"))).cast("long").alias("value"))


def engine_losses(rows: DataFrame, make: Callable[[], Engine]) -> DataFrame:
    """Rows with t2_cpl by the engine: its values of the distinct positions before and after the legal moves played."""
    played = rows.where("t2_legal").select("fen", "t2_move").distinct().select("fen", "t2_move", board_udfs.fen_after("fen", "t2_move").alias("next"))
    values = evaluate(played.select("fen").union(played.select("next")), make)
    before = values.select("fen", F.col("value").alias("eval_before"))
    after = played.join(values.select(F.col("fen").alias("next"), F.col("value").alias("eval_after")), "next").select("fen", F.col("t2_move").alias("move"), "eval_after")
    return enrich_losses(rows.drop("t2_cpl"), before, after)


_RETRIED = "job_id string, model string, fen string, original_move string, retried_move string, retried_legal boolean, retried_cpl long, best_move string, inference_ms long, skipped string"


def retry_moves(rows: DataFrame, provider: Callable[[], Callable[[str, str], str]], attempts: int = 5) -> DataFrame:
    """Asks once more for the moves of (job_id, model, fen, t2_move, t2_best_move), naming the problem and all legal moves.

    Lost connections and timeouts are asked again, ``attempts`` times in all, with a provider
    made anew; other failures, and positions without moves, are skipped with the reason. A
    legal move that is the best one loses nothing; the loss of others is not known here.
    """
    problem = rows.withColumn("_legal", board_udfs.legal_moves("fen"))
    asked = problem.select("job_id", "model", "fen", "t2_move", "t2_best_move", F.size("_legal").alias("n"), prompts.retry(F.col("fen"), F.col("t2_move"), F.col("_legal")).alias("prompt"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        ask = provider()
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                answer, reason, begun = None, None, time.monotonic()
                if r.n <= 0:
                    reason = "no legal moves"
                else:
                    for _ in range(attempts):
                        try:
                            answer, reason = ask(r.model, r.prompt), None
                            break
                        except (ConnectionError, TimeoutError) as e:
                            reason, ask = str(e) or type(e).__name__, provider()
                        except Exception as e:  # any other failure of a provider is final
                            reason = str(e) or type(e).__name__
                            break
                move = clean_token(answer.strip().splitlines()[0]) if answer and answer.strip() else None
                legal = None if answer is None else bool(move) and board_is_legal(r.fen, move)
                loss = 0 if legal and move == r.t2_best_move else None
                took = int((time.monotonic() - begun) * 1000)
                out.append((r.job_id, r.model, r.fen, r.t2_move, move, legal, loss, r.t2_best_move, took, reason))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _RETRIED.split(", ")]).astype({"retried_cpl": "Int64", "retried_legal": "boolean"})

    return asked.mapInPandas(run, _RETRIED)


_ANSWER = T.StructType([T.StructField("response", T.StringType()), T.StructField("success", T.BooleanType()), T.StructField("error", T.StringType()), T.StructField("inference_ms", T.LongType())])


def infer(asked: DataFrame, provider: Callable[[], Callable[[str, str], str]], retries: int = 3, columns: Sequence[str] = ("job_id", "model", "prompt")) -> DataFrame:
    """Adds response, success, error and inference_ms to the named columns of rows with model and prompt. A provider is made once per task; failures are retried, then recorded."""
    columns = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import time

        ask = provider()
        for batch in batches:
            rows = []
            for model, prompt in zip(batch.column("model").to_pylist(), batch.column("prompt").to_pylist(), strict=True):
                answer, error, begun = None, None, time.monotonic()
                for attempt in range(retries):
                    begun = time.monotonic()
                    try:
                        answer, error = ask(model, prompt), None
                        break
                    except Exception as e:  # any failure of a provider is data
                        error = str(e)
                        time.sleep(min(2**attempt, 8) if attempt + 1 < retries else 0)
                rows.append((answer, error is None, error, int((time.monotonic() - begun) * 1000)))
            answers = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.bool_(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *answers], names=[*columns, *_ANSWER.names])

    needed = asked.select(*dict.fromkeys([*columns, "model", "prompt"]))
    return needed.mapInArrow(run, T.StructType([*(needed.schema[c] for c in columns), *_ANSWER.fields]))


def fen_sampler(games: DataFrame, percent: int = 10) -> DataFrame:
    """(game_id, ply, fen, moves) for about ``percent`` of the positions of games given as arrays of moves in SAN."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for game, moves in zip(pdf["game_id"], pdf["moves"], strict=True):
                board = Board.of(START)
                for ply, san in enumerate(moves if moves is not None else [], 1):
                    try:
                        board = board.push(board.parse_san(san))
                    except ValueError:
                        break
                    if random.Random(f"{game}:{ply}").random() * 100 < percent and board.valid():
                        out.append((game, ply, board.fen()))
            yield pd.DataFrame(out, columns=["game_id", "ply", "fen"])

    return games.select("game_id", "moves").mapInPandas(run, "game_id long, ply int, fen string")
