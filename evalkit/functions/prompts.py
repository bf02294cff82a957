"""Prompts as string expressions. The wording is a template that callers may replace."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The wording of the prompts. {fen}, {moves} and {side} are filled in.
INTRO = "You are analysing a chess position."
MOVES = "\nMoves played so far:\n{moves}\n"
FEN = "\nCurrent position (FEN):\n{fen}"
QUESTIONS = """
Answer all three questions below.

1. What is the centipawn evaluation of this position from White's perspective?
   A positive number means White is better. A negative number means Black is better.
   0 means equal. Give only a number, no explanation.

2. What is the best move for the side to play? Give only the move in SAN notation.

3. Who stands better in this position — White, Black, or is it equal?
   Give a one-sentence explanation of the key reason."""
STEPS = """

Think step by step before answering:
- What are the key features of this position?
- Who controls more space? Who has more active pieces?
- What is the most forcing move available?"""
FORMAT = """

Respond using this exact format:
Eval: <integer>
Move: <SAN move>
Explanation: <White / Black / Equal> — <one sentence reason>"""
EVAL_ONLY = """

What is the centipawn evaluation of this position from White's perspective?
Positive = White is better. Negative = Black is better. 0 = equal.
Respond with a single integer only."""
EXPLANATION_ONLY = """

Who stands better in this position — White, Black, or is it equal?
Give a one-sentence explanation of the key reason.

Respond using this exact format:
Explanation: <White / Black / Equal> — <one sentence reason>"""
MOVE_ONLY = """Position (FEN): {fen}
It is {side} to move.

Legal moves: {legal}

What is the best move for {side}? You MUST pick one of the listed legal moves. Respond with the SAN move only."""

NOT_LEGAL = 'Your previous move "{move}" is not legal in this position.'
NO_MOVE = "You did not provide a move for this position."
RETRY = """

Position (FEN): {fen}

The complete list of legal moves in SAN notation is:
{legal}

Pick the best move from the list above. Output only the move — no explanation, no move numbers."""
FEEDBACK = """Your move was not the best.

Position: {fen}
Your move: {move}
Best move: {best}

Explain why {best} is stronger. Then answer the same three questions
for the following new position of the same type.

---

"""


def fill(template: str, **values: Column) -> Column:
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def build(fen: Column, moves: Column, fmt: Column, legal: Column | None = None) -> Column:
    """The prompt of a format; moves appear where the format has them and there are any."""
    told = F.when(F.coalesce(moves, F.lit("")) != "", fill(MOVES, moves=moves)).otherwise("")
    at = fill(FEN, fen=fen)
    side = F.when(F.split(fen, " ")[1] == "w", "White").otherwise("Black")
    listed = F.array_join(legal, ", ") if legal is not None else F.lit("")
    return (
        F.when(fmt == "eval_only", F.concat(F.lit(INTRO), told, at, F.lit(EVAL_ONLY)))
        .when(fmt == "explanation_only", F.concat(F.lit(INTRO), told, at, F.lit(EXPLANATION_ONLY)))
        .when(fmt == "move_only", fill(MOVE_ONLY, fen=fen, side=side, legal=listed))
        .when(fmt == "cot", F.concat(F.lit(INTRO), told, at, F.lit(QUESTIONS + STEPS + FORMAT)))
        .when(fmt == "pgn+fen", F.concat(F.lit(INTRO), told, at, F.lit(QUESTIONS + FORMAT)))
        .otherwise(F.concat(F.lit(INTRO), at, F.lit(QUESTIONS + FORMAT)))
    )


def retry(fen: Column, move: Column, legal: Column) -> Column:
    """Asks again after an illegal or a missing move."""
    problem = F.when(F.coalesce(move, F.lit("")) != "", fill(NOT_LEGAL, move=move)).otherwise(NO_MOVE)
    return F.concat(problem, fill(RETRY, fen=fen, legal=F.array_join(legal, ", ")))


def correction(fen: Column, move: Column, best: Column, next_fen: Column, next_moves: Column, fmt: Column) -> Column:
    """Feedback on a move, followed by the prompt of another position."""
    return F.concat(fill(FEEDBACK, fen=fen, move=move, best=best), build(next_fen, next_moves, fmt))
