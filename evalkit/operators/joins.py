"""Joins and set operations of the job and result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X

#: A dimension that is known to be this small may be broadcast.
SMALL_ROWS = 1_000_000


def small(dim: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """The dimension, marked for broadcast if it has at most ``most`` rows; else left to a shuffled join."""
    return F.broadcast(dim) if dim.limit(most + 1).count() <= most else dim


def first_by(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def fen_lookup(positions: DataFrame) -> DataFrame:
    return positions.where("position_id is not null and fen is not null").select("position_id", "fen")


def back_fill_fen(results: DataFrame, positions: DataFrame) -> DataFrame:
    """Adds fen by position where results have no such column; where they have one, its nulls stay."""
    return results if "fen" in results.columns else results.join(small(fen_lookup(positions)), "position_id", "left")


def enrich_jobs(jobs: DataFrame, positions: DataFrame) -> DataFrame:
    """Jobs with their position; without one a job is failed. An absent evaluation is 0."""
    return at_positions(jobs, small(positions.select("position_id", "fen", F.col("t1_stockfish_eval").alias("truth"))))


def at_positions(jobs: DataFrame, dim: DataFrame) -> DataFrame:
    """enrich_jobs() with all columns of a table of position_id, fen, truth and others; how it is joined is the caller's choice."""
    out = jobs.join(dim, "position_id", "left")
    return out.withColumns({"status": F.when(F.col("fen").isNull(), "failed").otherwise(F.col("status")), "truth": F.when(F.col("fen").isNotNull(), F.coalesce("truth", F.lit(0)))})


def learning_deltas(results: DataFrame, order: str = "event_id") -> DataFrame:
    """Loss of a correction and its control against their parent's; the first match counts on each side."""
    kind = lambda k: results.where(F.col("job_type") == k)
    parent = first_by(kind("standard"), ["job_id"], F.col(order)).select(F.col("job_id").alias("parent_job_id"), F.col("t2_cpl").alias("cpl_attempt_1"))
    control = first_by(kind("control").where("parent_job_id is not null"), ["parent_job_id"], F.col(order)).select("parent_job_id", F.col("t2_cpl").alias("cpl_control"))
    fix = kind("correction").where("parent_job_id is not null and parent_job_id <> ''").select("model", "parent_job_id", F.col("t2_cpl").alias("cpl_correction"))
    out = fix.join(parent, "parent_job_id").join(control, "parent_job_id").dropna(subset=["cpl_attempt_1", "cpl_correction", "cpl_control"])
    first, second = F.col("cpl_attempt_1") - F.col("cpl_correction"), F.col("cpl_attempt_1") - F.col("cpl_control")
    return out.select(
        "model", "parent_job_id", "cpl_attempt_1", "cpl_correction", "cpl_control", first.alias("delta_correction"), second.alias("delta_control"), (first - second).alias("net_feedback_effect")
    )


def worklist(results: DataFrame) -> DataFrame:
    """Adds todo: a legal move without a loss."""
    return results.withColumn("todo", F.col("t2_legal").eqNullSafe(True) & F.col("t2_move").isNotNull() & F.col("t2_cpl").isNull())


def enrich_losses(work: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Losses from evaluations before (fen) and after (fen, move); the best move loses nothing."""
    out = work.join(before, "fen", "left").join(after.withColumnRenamed("move", "t2_move"), ["fen", "t2_move"], "left")
    loss = X.raw_cpl(F.col("eval_before"), F.col("eval_after"), X.white_to_move(F.col("fen")))
    known = F.col("eval_before").isNotNull() & F.col("eval_after").isNotNull()
    return out.withColumn("t2_cpl", F.when(F.col("t2_move") == F.col("t2_best_move"), F.lit(0)).when(known, loss).cast("long"))


def upsert(old: DataFrame, new: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """old with cols replaced by new's where new has the key (all rows of a key get them)."""
    fresh = new.select(key, *(F.col(c).alias(f"_new_{c}") for c in cols), F.lit(True).alias("_found"))
    out = old.join(fresh, key, "left")
    return out.withColumns({c: F.when(F.col("_found"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in cols}).select(*old.columns)


def job_matrix(positions: DataFrame, models: Sequence[str], formats: Sequence[str]) -> DataFrame:
    """Every position with every model and prompt format: id and hash of each job. Models and formats are exploded, not joined."""
    out = positions.select("position_id", F.explode(F.array(*map(F.lit, models))).alias("model")).withColumn("prompt_format", F.explode(F.array(*map(F.lit, formats))))
    trial = F.lit(1)
    return out.withColumns({
        "job_id": X.job_id(F.col("position_id"), F.col("model"), F.col("prompt_format"), trial),
        "hash": X.content_hash(F.col("position_id"), F.col("model"), F.col("prompt_format"), trial),
        "status": F.lit("pending"),
    })


def insert_if_absent(target: DataFrame, batch: DataFrame, order: str, keys: Sequence[str] = ("job_id", "hash")) -> DataFrame:
    """The rows of batch that would be inserted: first of their batch, and new to the target, by each key."""
    for k in keys:
        batch = first_by(batch, [k], F.col(order)).join(target.select(k), k, "left_anti")
    return batch


def correction_pairs(results: DataFrame, follow_up: Column) -> DataFrame:
    """A correction and a control job for each row, linked to each other and to the parent."""
    made = lambda kind, other: F.struct(
        F.concat(F.col("job_id"), F.lit(f"_{kind}")).alias("job_id"), F.lit(kind).alias("job_type"),
        F.concat(F.col("job_id"), F.lit(f"_{other}")).alias("paired_control_job_id"), follow_up.alias("position_id"), F.col("job_id").alias("parent_job_id"),
    )
    return results.select(F.inline(F.array(made("correction", "control"), made("control", "correction"))))


def numbered(rows: DataFrame, keys: Sequence[str], order: Column, tie: str, parts: int = 256) -> DataFrame:
    """Adds ``place``, a row's number from 0 among those of its keys in the order of a hash in hexadecimal, and ``many``, how many there are.

    Rows are numbered inside each leading byte of the hash, after those of smaller bytes,
    so that no key is sorted in one task.
    """
    spread = rows.withColumns({"_h": order, "_b": F.conv(F.substring(order, 1, 2), 16, 10).cast("int") * parts / 256}).withColumn("_b", F.col("_b").cast("int"))
    within = spread.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("_h", tie)) - 1)
    sizes = spread.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # ``parts`` rows of a key at most
    sizes = sizes.select(*keys, "_b", (F.sum("_n").over(ahead) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(*keys)).alias("many"))
    return within.join(sizes, [*keys, "_b"]).withColumn("place", F.col("_before") + F.col("_k")).drop("_h", "_b", "_k", "_before")


def similar_position(rows: DataFrame, positions: DataFrame, exclude: DataFrame) -> DataFrame:
    """For each row of (job_id, position_id, theme, difficulty) a position of the same theme and difficulty, else of the same difficulty.

    Positions are numbered by key; the job's hash modulo their number says which one it is,
    or the next if that is the job's own. Every position may be chosen, by an equi-join.
    """
    free = positions.join(exclude.select("position_id").distinct(), "position_id", "left_anti").select("position_id", "theme", "difficulty")
    out, number = None, F.conv(F.substring(F.sha2("job_id", 256), 1, 8), 16, 10).cast("long")
    for level, keys in enumerate((["theme", "difficulty"], ["difficulty"])):
        pool = numbered(free, keys, F.sha2(F.col("position_id").cast("string"), 256), "position_id")
        sizes = pool.groupBy(*keys).agg(F.first("many").alias("many"))
        asked = rows.join(small(sizes), keys).select("job_id", "position_id", *keys, F.posexplode(F.array((number % F.col("many")), (number + 1) % F.col("many"))).alias("_later", "place"))
        found = asked.join(pool.select(*keys, "place", F.col("position_id").alias("follow_up")), [*keys, "place"]).where("follow_up <> position_id")
        found = found.select("job_id", F.struct(F.lit(level).alias("level"), "_later", "follow_up").alias("pick"))
        out = found if out is None else out.unionByName(found)
    chosen = out.groupBy("job_id").agg(F.min("pick").alias("p")).select("job_id", F.col("p.follow_up").alias("follow_up"), (F.col("p.level") == 1).alias("fell_back"))
    return rows.select("job_id", "position_id").join(chosen, "job_id", "left")


def assign_follow_ups(triggers: DataFrame, positions: DataFrame, used: DataFrame) -> DataFrame:
    """(job_id, follow_up): for each row of (job_id, position_id, theme, difficulty) a position of its theme and difficulty that no other row gets and that is not used yet, else one of its difficulty that is left; none if none is left.

    The k-th row of a key, in the order of the hash of its job, gets the k-th free position:
    the state that a loop over jobs would keep is the number itself. A row's own position is
    free for others only.
    """
    own = triggers.select("position_id").union(used.select("position_id")).distinct()
    free = positions.join(own, "position_id", "left_anti").select("position_id", "theme", "difficulty")
    left, done = triggers.select("job_id", "theme", "difficulty"), None
    for keys in (["theme", "difficulty"], ["difficulty"]):
        asks = numbered(left, keys, F.sha2("job_id", 256), "job_id").drop("many")
        pool = numbered(free, keys, F.sha2(F.col("position_id").cast("string"), 256), "position_id").select(*keys, "place", F.col("position_id").alias("follow_up"))
        found = asks.join(pool, [*keys, "place"]).select("job_id", "follow_up")
        done = found if done is None else done.unionByName(found)
        left = left.join(found, "job_id", "left_anti")
        free = free.join(found.select(F.col("follow_up").alias("position_id")), "position_id", "left_anti")
    return triggers.select("job_id").join(done, "job_id", "left")


def retry_candidates(results: DataFrame, retried: DataFrame, formats: Sequence[str] = ("fen_only", "pgn+fen", "cot", "move_only")) -> DataFrame:
    """Rows that are not legal (null counts), of the formats that ask for a move, and not retried yet."""
    open_ = results.where(~F.coalesce("t2_legal", F.lit(False)) & F.col("prompt_format").isin(*formats))
    return open_.join(retried.select("job_id").distinct(), "job_id", "left_anti")


def retry_summary(retries: DataFrame) -> DataFrame:
    legal = F.count_if(F.col("retried_legal"))
    n = F.count(F.lit(1))
    return retries.agg(n.alias("retried"), legal.alias("became_legal"), (n - legal).alias("still_illegal"), F.round(legal * 100.0 / F.greatest(n, F.lit(1)), 6).alias("percent"))
