"""A small corpus with every odd case, and the helpers that the tests of this folder share."""

from __future__ import annotations

import random
import re

from pyspark.sql import DataFrame, SparkSession

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: Columns whose names operators use themselves.
CLASHES = "kept boolean, n long, h long, num long, place long, k_id long, k_tx long, cls long, name string, shard int, bucket int, score double"


def corpus(seed: int = 5) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and", *("".join(rng.choice("aeioustrnlm") for _ in range(rng.randint(2, 8))) for _ in range(400))]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage = prose(120), prose(60)
    rows: list[tuple[int | None, str | None]] = [(k, prose(rng.randint(1, 90))) for k in range(20)]
    rows += [(20 + k, base) for k in range(5)]
    rows += [(30 + k, base.replace(base.split()[k * 9 + 3], "changed", 1)) for k in range(6)]
    rows += [(40 + k, f"{prose(15)}\n{passage}\t{prose(10)}") for k in range(4)]
    rows += [(50, base.upper()), (51, None), (52, None), (53, ""), (54, "  \n\t "), (55, "one"), (56, "One  two"), (57, "one two")]
    rows += [(60, prose(4000)), (61, "x" * 20_000), (62, "ab " * 300), (None, base), (None, "nameless words are here"), (-5, prose(40))]
    rows += [rows[0], rows[0], (3, "a second text of document three " * 5), (70, "été " * 30 + "ÉTÉ naïve \U0001f600 日本")]
    rng.shuffle(rows)
    return rows


def frame(spark: SparkSession, rows: list[tuple[int | None, str | None]], parts: int = 3) -> DataFrame:
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return df.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "length(text) AS n_chars", *(f"CAST(NULL AS {kind}) AS {name}" for name, kind in (c.split() for c in CLASHES.split(", "))))


def empty(spark: SparkSession) -> DataFrame:
    return frame(spark, [(1, "x")]).limit(0)


def collected(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
