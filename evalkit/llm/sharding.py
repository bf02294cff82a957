"""Operator 10: balanced contiguous shards from global prefix sums.

Documents are put in the order of (doc_id, text hash) by a range shuffle of small rows
(the text itself stays where it is). Each range partition yields one total; the running
sum of those totals is the only thing that is ever put in one place, and its length is
the number of partitions. With it, a row's place in the corpus is its partition's offset
plus a running sum inside the partition, and the shard is the equal-size cut in which the
middle of the row's bytes falls.

Defined cases. A null text weighs only the overhead and its crc32 is that of no bytes;
a null doc_id comes first; repeated rows are placed one after the other, each with its
own slot; an empty table gives an empty result; one very long text lies in one shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, documents

SHARDS = 40
OVERHEAD = 16
#: Rows that one range partition should hold; their rows are about 40 bytes.
ROWS_PER_PART = 500_000


def shard(docs: DataFrame, shards: int = SHARDS, overhead: int = OVERHEAD) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, shard, slot, byte_start."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "shard")
    raw = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    rows = scratch.save(docs.select("doc_id", (F.octet_length(raw) + F.lit(overhead)).cast("long").alias("size"), F.crc32(raw).alias("text_crc32")))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS_PER_PART))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")]
    placed = scratch.save(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))

    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # One row per partition from here: the only global window.
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = placed.groupBy("part").agg(F.sum("size").alias("bytes"))
    totals = totals.select("part", (F.sum("bytes").over(ahead) - F.col("bytes")).alias("offset"), F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"))
    located = placed.withColumn("upto", F.sum("size").over(within)).join(totals, "part")
    start = F.col("offset") + F.col("upto") - F.col("size")
    cut = F.expr(f"least(coalesce(({shards}L * (2 * (offset + upto - size) + size)) div nullif(2 * all_bytes, 0), 0L), {shards - 1}L)").cast("int")
    cut_rows = scratch.save(located.select("part", "doc_id", "size", "text_crc32", start.alias("byte_start"), cut.alias("shard")))

    # A shard's slots run through the partitions it spans: again one small row per (partition, shard).
    ahead = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = cut_rows.groupBy("part", "shard").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("part", "shard", (F.sum("n").over(ahead) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("part", "shard").orderBy("byte_start", *order))
    return (
        cut_rows.withColumn("rank", rank)
        .join(counts, ["part", "shard"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("rank") - 1).cast("long").alias("slot"), "byte_start")
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: No crc32 in the oracle's SQL, so the query is tested against brute force.
SQL = None
