"""Readers. All take explicit schemas, so nothing is inferred and unread columns are never parsed."""

from __future__ import annotations

import os
from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exprs as X
from ..operators.joins import first_by
from ..schemas import DIFFICULTIES, POSITION, PUZZLE_CSV, RESULT

_BAD = "_corrupt_record"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, wherever Spark can read it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def json_lines(spark: SparkSession, path: str, schema: T.StructType = RESULT, keep_bad: bool = False) -> DataFrame:
    """A tolerant scan of JSON lines: a missing path is empty, blank lines are skipped, bad lines dropped (or kept to be counted)."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    wide = T.StructType([*schema.fields, T.StructField(_BAD, T.StringType())])
    rows = spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _BAD).json(path)
    return rows if keep_bad else rows.where(F.col(_BAD).isNull()).drop(_BAD)


def tier(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One difficulty's positions, a JSON array in a file of its own."""
    path = f"{folder}/{name}.json"
    return spark.read.option("multiLine", True).schema(POSITION).json(path) if exists(spark, path) else spark.createDataFrame([], POSITION)


def tiers(spark: SparkSession, folder: str, names: Iterable[str] = DIFFICULTIES) -> DataFrame:
    """All tiers' positions with ``tier_order``, their place in the given order."""
    out = None
    for k, name in enumerate(names):
        part = tier(spark, folder, name).withColumn("tier_order", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


def keyed_positions(spark: SparkSession, folder: str) -> DataFrame:
    """A position for each id: the last tier's."""
    return first_by(tiers(spark, folder).where("id is not null"), ["id"], F.col("tier_order").desc(), F.col("fen"))


def merged(spark: SparkSession, *paths: str, schema: T.StructType = RESULT, key: str = "job_id") -> DataFrame:
    """Rows of several logs, the last one per key: later files win, and inside a file later lines."""
    out = None
    for k, path in enumerate(paths):
        part = json_lines(spark, path, schema)
        if part.inputFiles():
            # A line's place: its file, the split's offset in it, and the row's number in the scan of the split.
            place = F.struct(F.lit(k), F.col("_metadata.file_modification_time"), F.col("_metadata.file_name"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
            part = part.select("*", place.alias("_line"))
            out = part if out is None else out.unionByName(part)
    return first_by(out, [key], F.col("_line").desc()).drop("_line") if out is not None else spark.createDataFrame([], schema)


def completed_ids(spark: SparkSession, path: str) -> DataFrame:
    """The distinct job ids of a log, found by pattern, so that half-written lines count too."""
    if not exists(spark, path):
        return spark.createDataFrame([], "job_id string")
    found = spark.read.text(path).select(F.regexp_extract("value", r'"job_id"\s*:\s*"([^"]+)"', 1).alias("job_id"))
    return found.where("job_id <> ''").distinct()


def puzzles(spark: SparkSession, path: str) -> DataFrame:
    """FEN, rating (1500 if unreadable), themes of a puzzle CSV; the other columns are never parsed."""
    rows = spark.read.schema(PUZZLE_CSV).option("header", True).csv(path).select("FEN", "Rating", "Themes")
    return rows.select("FEN", F.coalesce(F.col("Rating").try_cast("int"), F.lit(1500)).alias("Rating"), "Themes")


#: Rating ranges of the tiers.
TIER_BOUNDS = (("easy", 0, 1200), ("medium", 1200, 1600), ("hard", 1600, 2000), ("extreme", 2000, 4000))


def puzzle_positions(rows: DataFrame, bounds=TIER_BOUNDS) -> DataFrame:
    """Puzzle rows as positions; rows that cannot be played are left out."""
    from ..functions.board_udfs import valid_position

    out = rows.select(
        X.id32(F.col("FEN")).alias("id"), F.col("FEN").alias("fen"), F.lit("").alias("pgn_moves"), X.first_theme(F.col("Themes")).alias("theme"),
        X.rating_tier(F.col("Rating"), bounds).alias("difficulty"), X.phase(F.col("FEN"), F.lit(20)).alias("phase"), F.lit("puzzle_db").alias("source"), F.col("Rating").alias("rating"),
    )
    return out.where(valid_position("fen"))


def api_puzzles(lines: DataFrame, count: int) -> DataFrame:
    """Positions from NDJSON lines (n, value) that an HTTP fetch left: the first ``count``, flat or nested under ``puzzle``, bad lines dropped."""
    flat = "fen string, rating int, themes array<string>"
    parsed = lines.orderBy("n").limit(count).select(F.from_json("value", f"puzzle struct<{flat.replace(' string', ': string').replace(' int', ': int').replace(' array', ': array')}>, {flat}").alias("r"))
    get = lambda c: F.coalesce(F.col(f"r.puzzle.{c}"), F.col(f"r.{c}"))
    out = parsed.select(get("fen").alias("fen"), F.coalesce(get("rating"), F.lit(1500)).alias("rating"), F.coalesce(F.get(get("themes"), 0), F.lit("tactics")).alias("theme"))
    return out.where("fen is not null")


def games(spark: SparkSession, path: str) -> DataFrame:
    """(game_id, moves) of a PGN file: games are separated by their Event tags, headers, comments, numbers and results are dropped."""
    text = spark.read.option("lineSep", "[Event ").text(path)
    body = F.regexp_replace(F.regexp_replace(F.col("value"), r"\[[^\]]*\]|\{[^}]*\}|^[^\n]*\]", " "), r"\d+\.+|1-0|0-1|1/2-1/2|\*|\$\d+", " ")
    moves = F.filter(F.split(body, r"\s+"), lambda m: m.rlike(r"^[NBRQKa-hO]"))
    return text.select(F.monotonically_increasing_id().alias("game_id"), moves.alias("moves")).where(F.size("moves") > 0)


def config(path: str, prefix: str, env: dict[str, str] | None = None) -> dict[str, Any]:
    """A YAML file; PREFIX_SECTION_KEY in the environment overrides a value and takes its type."""
    import yaml

    with open(path, encoding="utf-8") as f:
        out = yaml.safe_load(f) or {}
    env = dict(os.environ) if env is None else env
    for section, values in out.items():
        for key, old in values.items() if isinstance(values, dict) else ():
            new = env.get(f"{prefix}_{section}_{key}".upper())
            if new is not None:
                values[key] = new.lower() in ("1", "true", "yes") if isinstance(old, bool) else type(old)(new) if isinstance(old, (int, float)) else new
    return out
