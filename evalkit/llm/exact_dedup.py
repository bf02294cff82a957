"""Operator 2: exact deduplication by deterministic block naming.

Karp-Miller-Rosenberg naming over fixed-size blocks:

0. Each normalised text is cut into blocks of BLOCK bytes (the last one shorter; an empty
   text is one empty block). The distinct blocks are shuffled by a 64-bit hash, sorted,
   and numbered in that order: a name per distinct block.
1. Names of adjacent blocks (2j, 2j+1) form pairs (a lone last one pairs with 0, which is
   no name); the distinct pairs are sorted and numbered again, and so on until each
   document has one name. Documents with equal (levels, name) have equal texts and no
   others do: names stand for contents, never for hashes.

Block contents are shuffled once, to be named. Blocks look their names up by the hash
alone where it belongs to one distinct content, and by hash and content where two contents
share it (that set is measured, and is empty as a rule), so nothing rests on the hash.
Naming aggregates before it shuffles, and look-ups are plain equi-joins that adaptive
execution splits, so a block that a third of all documents share is no hot task. Rows meet
the totals of their group in SALTS parts, so a group of any size is none either.

Defined cases. Null counts as empty; a null doc_id is the smallest; if all of a group's
doc_ids are null, keep_id is null and the rows stay. Of several rows with the group's
largest doc_id, which are one document listed several times (their texts may differ in the
case of letters), ``kept`` is true for each; ``keep_one`` keeps a single one of them, the
one with the least text. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, documents, lower_ascii
from .textscan import LOWER, slices

BLOCK = 4096
#: Blocks that a task remembers to have handed on.
SENT = 200_000
#: Parts in which the rows of a group meet its totals.
SALTS = 64


def _blocks(size: int, contents: bool):
    """Rows (hash, block) of a task's distinct blocks, or (doc_id, row digest, block hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for s in slices(batches):
            data = LOWER[s.data].tobytes()
            if contents:
                seen = {data[p : min(p + size, b)] for a, b in zip(s.bounds[:-1].tolist(), s.bounds[1:].tolist(), strict=True) for p in range(a, max(b, a + 1), size)}
                digests = {x: hashlib.sha256(x).digest() for x in seen}
                found = [x for x, d in digests.items() if d not in sent]
                if len(sent) > SENT:
                    sent.clear()
                sent.update(digests.values())
                yield pa.record_batch([pa.array([_hash(x) for x in found], pa.int64()), pa.array(found, pa.binary())], ["h", "block"])
            else:
                sha, names = [], []
                for a, b in zip(s.bounds[:-1].tolist(), s.bounds[1:].tolist(), strict=True):
                    text = data[a:b]
                    sha.append(hashlib.sha256(text).digest())
                    names.append([_hash(text[p : p + size]) for p in range(0, max(b - a, 1), size)])
                yield pa.record_batch([s.rows.column("doc_id"), pa.array(sha, pa.binary()), pa.array(names, pa.list_(pa.int64()))], ["doc_id", "sha", "hs"])

    return run


def _hash(block: bytes) -> int:
    return xxhash.xxh3_64_intdigest(block) - 2**63


def _named(distinct: DataFrame, *keys: str) -> DataFrame:
    """Distinct rows, shuffled by all keys (many pairs may begin with one common block) and sorted by them, with their place in that order as ``name`` (from 1)."""
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return distinct.repartition(parts, *keys).sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id() + 1)


def block_identities(docs: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: row, doc_id, sha (of the normalised text), levels, name."""
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # Tasks hand on a block once, so one exchange by hash serves the grouping, the sort and the look for equal hashes.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = raw.select("text").mapInArrow(_blocks(block, True), "h long, block binary").repartition(parts, "h").groupBy("h", "block").agg(F.lit(1).alias("one"))
    alike = F.count(F.lit(1)).over(Window.partitionBy("h"))
    names = distinct.sortWithinPartitions("h", "block").withColumn("name", F.monotonically_increasing_id() + 1).withColumn("alike", alike)
    names = scratch.save(names.select("h", "name", F.when(F.col("alike") > 1, F.col("block")).alias("block")))

    rows = raw.mapInArrow(_blocks(block, False), "doc_id long, sha binary, hs array<long>")
    # A row's number: rows that share id and text get numbers of their own. Saved, so that it stays.
    rows = scratch.save(rows.withColumn("row", F.monotonically_increasing_id()))
    shared = [r.h for r in names.where("block is not null").select("h").distinct().limit(1).collect()]
    level = rows.select("row", F.size("hs").alias("n"), F.posexplode("hs").alias("pos", "h"))
    if shared:
        level = _by_content(raw, rows, names, level, block)
    else:
        level = level.join(names.select("h", "name"), "h").select("row", "n", "pos", "name")
    level, levels, done = scratch.save(level), 0, []
    while True:
        done.append(level.where("n = 1").select("row", F.lit(levels).alias("levels"), "name"))
        rest = level.where("n > 1")
        if not rest.limit(1).count():
            break
        # Pairs of adjacent names: two rows of a (document, pair) meet by shuffle key, never more.
        pairs = rest.groupBy("row", F.floor(F.col("pos") / 2).cast("int").alias("p"), F.ceil(F.col("n") / 2).cast("int").alias("m")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(0)).alias("b")
        )
        pairs = scratch.save(pairs)
        named = _named(pairs.groupBy("a", "b").agg(F.lit(1).alias("one")), "a", "b").select("a", "b", "name")
        level = scratch.save(pairs.join(named, ["a", "b"]).select("row", F.col("m").alias("n"), F.col("p").alias("pos"), "name"))
        levels += 1
    ids = done[0]
    for more in done[1:]:
        ids = ids.unionByName(more)
    return rows.select("row", "doc_id", "sha").join(ids, "row")


def _by_content(raw: DataFrame, rows: DataFrame, names: DataFrame, level: DataFrame, block: int) -> DataFrame:
    """The look-up where some hash belongs to several contents: those blocks join on their content too."""
    split = names.where("block is not null")
    plain = level.join(names.where("block is null").select("h", "name"), "h").select("row", "n", "pos", "name")
    sought = split.select("h").distinct()
    numbered = rows.select("row", F.hex("sha").alias("sha"), F.size("hs").alias("n"), F.posexplode("hs").alias("pos", "h")).join(sought, "h")
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = raw.select(F.upper(F.sha2(F.encode(lower, "UTF-8"), 256)).alias("sha"), F.encode(lower, "UTF-8").alias("bytes")).dropDuplicates(["sha"])
    found = numbered.join(texts, "sha").select("row", "n", "pos", "h", F.substring("bytes", F.col("pos") * block + 1, F.lit(block)).alias("block"))
    return plain.unionByName(found.join(split, ["h", "block"]).select("row", "n", "pos", "name"))


def _with_totals(ids: DataFrame) -> DataFrame:
    """Each row of ids with its group's largest doc_id and number of rows: keep_id, group_size."""
    # A group may hold a third of all rows: it meets its totals in SALTS parts, whose own totals are SALTS rows at most.
    salted = ids.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)))
    parts = salted.groupBy("levels", "name", "salt").agg(F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("levels", "name")
    groups = parts.select("levels", "name", "salt", F.max("top").over(whole).alias("keep_id"), F.sum("n").over(whole).alias("group_size"))
    return salted.join(groups, ["levels", "name", "salt"])


def exact_dedup(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256. Of equal texts the largest doc_id stays."""
    scratch = Scratch(docs.sparkSession, "exact")
    out = _with_totals(scratch.save(block_identities(docs, scratch, block)))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def keep_one(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of docs, all columns, that stay: one of each group of equal texts."""
    scratch = Scratch(docs.sparkSession, "exact")
    ids = scratch.save(block_identities(docs, scratch, block))
    top = _with_totals(ids).where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).withColumnRenamed("keep_id", "id")
    # Texts are told by their normalised digest; a group of one row at the top needs no more than its id and that.
    top = scratch.save(top.groupBy("id", "sha").agg(F.count(F.lit(1)).alias("listed")))
    names = [f"_{k}" for k in range(len(docs.columns))]
    named = docs.toDF(*names)
    id_, text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))
    sha = F.unhex(F.sha2(F.encode(lower_ascii(F.coalesce(text, F.lit(""))), "UTF-8"), 256))
    found = lambda some: named.join(some.select("id", "sha").hint("merge"), id_.cast("long").eqNullSafe(F.col("id")) & (sha == F.col("sha")), "left_semi")
    once = found(top.where("listed = 1"))
    if not top.where("listed > 1").limit(1).count():
        return once.toDF(*docs.columns)
    several = found(top.where("listed > 1")).groupBy(id_.alias("_id"), sha.alias("_sha")).agg(F.min_by(F.struct(*names), text).alias("row"))
    return once.unionByName(several.select("row.*")).toDF(*docs.columns)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""
