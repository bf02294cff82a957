"""The rules of chess as Arrow-batched functions. Null and unreadable positions give null, false or an empty list."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import board as B


@F.pandas_udf(T.BooleanType())
def is_legal(fen: pd.Series, san: pd.Series) -> pd.Series:
    return pd.Series([B.is_legal(f, s) for f, s in zip(fen, san, strict=True)], dtype=bool)


@F.pandas_udf(T.ArrayType(T.StringType()))
def legal_moves(fen: pd.Series) -> pd.Series:
    return fen.map(B.legal_sans)


@F.pandas_udf(T.StringType())
def rescue_move(fen: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([B.rescue(f, t) for f, t in zip(fen, text, strict=True)], dtype=object)


@F.pandas_udf(T.StructType([T.StructField("san", T.StringType()), T.StructField("uci", T.StringType())]))
def legal_lists(fen: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([B.legal_lists(f) for f in fen], columns=["san", "uci"], dtype=object)


@F.pandas_udf(T.StructType([T.StructField("move", T.StringType()), T.StructField("legal", T.BooleanType())]))
def settle(fen: pd.Series, sans: pd.Series, ucis: pd.Series, move: pd.Series, text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([B.settle(*row) for row in zip(fen, sans, ucis, move, text, strict=True)], columns=["move", "legal"], dtype=object)


@F.pandas_udf(T.BooleanType())
def valid_position(fen: pd.Series) -> pd.Series:
    def ok(f):
        try:
            return B.Board.of(f or "").valid()
        except ValueError:
            return False

    return fen.map(ok).astype(bool)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def planes(fen: pd.Series) -> pd.Series:
    return fen.map(B.planes)


@F.pandas_udf(T.StringType())
def fen_after(fen: pd.Series, san: pd.Series) -> pd.Series:
    def after(f, s):
        try:
            b = B.Board.of(f or "")
            return b.push(b.parse_san(s or "")).fen()
        except ValueError:
            return None

    return pd.Series([after(f, s) for f, s in zip(fen, san, strict=True)], dtype=object)
