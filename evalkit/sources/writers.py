"""Writers. Spark's commit protocol takes the place of file locks: a reader sees a write as a whole or not at all."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import RESULT


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def recover(spark: SparkSession, path: str) -> None:
    """Puts back what a replace() that was cut short left aside."""
    fs, target = _fs(spark, path)
    old = _fs(spark, f"{path}.old")[1]
    if fs.exists(old):
        if fs.exists(target):
            fs.delete(old, True)
        else:
            fs.rename(old, target)


def replace(df: DataFrame, path: str) -> None:
    """Puts df in place of what path holds, which df may read: it is written beside, the old table is renamed aside, the new one renamed in, the old one deleted. At each moment one of them is whole; recover() or the next call mends a cut."""
    spark, beside = df.sparkSession, f"{path}.new"
    recover(spark, path)
    df.write.mode("overwrite").json(beside)
    fs, target = _fs(spark, path)
    old = _fs(spark, f"{path}.old")[1]
    if fs.exists(target):
        fs.rename(target, old)
    fs.rename(_fs(spark, beside)[1], target)
    fs.delete(old, True)


def tiers(positions: DataFrame, path: str) -> None:
    positions.write.mode("overwrite").partitionBy("difficulty").json(path)


def metrics(tables: Mapping[str, DataFrame], path: str) -> list[str]:
    """A CSV per table that has rows; a table without rows leaves none behind. Metric tables are small: one file each."""
    written = []
    for name, df in tables.items():
        spark, target = df.sparkSession, f"{path}/{name}.csv"
        if df.limit(1).count():
            df.coalesce(1).write.mode("overwrite").option("header", True).csv(target)
            written.append(name)
        else:
            fs, p = _fs(spark, target)
            fs.delete(p, True)
    return written


def document(spark: SparkSession, value: Mapping[str, Any], path: str) -> None:
    """A small JSON document, such as a run's summary or log."""
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(value, indent=1, default=str).encode()))
    out.close()


def result_record(rows: DataFrame) -> DataFrame:
    """Jobs joined with parsed answers and scores, as result records: all fields of the schema, absent ones null, ``trial`` as ``attempt``."""
    have = set(rows.columns)

    def column(field) -> Column:
        name = "trial" if field.name == "attempt" and "attempt" not in have else field.name
        return (F.col(name) if name in have else F.lit(None)).cast(field.dataType).alias(field.name)

    out = rows.select(*(column(f) for f in RESULT.fields))
    return out.withColumn("parse_errors", F.when(F.size("parse_errors") > 0, F.col("parse_errors")))


def clear(target: DataFrame, path: str) -> None:
    """Leaves an empty table of the same schema."""
    target.limit(0).write.mode("overwrite").parquet(path)
