"""What the operators of this subpackage share: the scratch folder and row identity."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalkit.session import ship

#: The key of a null doc_id: it sorts before every real one.
NULL_ID = -(2**63)

_own_root: dict[str, str] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text (null: empty) with the row's identity: (k_id, k_tx).

    k_id is doc_id with null mapped to the smallest long; k_tx is a hash of the text, so
    rows that repeat a doc_id with another text stay apart. Rows equal in both are one
    document that is listed several times. All other columns are left out, so that extra
    columns never clash with the operators' own.
    """
    k_id, k_tx = key_columns()
    return docs.select("doc_id", k_id.alias("k_id"), k_tx.alias("k_tx"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def key_columns() -> tuple[Column, Column]:
    """A row's identity, from doc_id and text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one of our own."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if sc.applicationId not in _own_root:
        _own_root[sc.applicationId] = f"file://{tempfile.mkdtemp(prefix='evalkit-')}"
    return _own_root[sc.applicationId]


class Scratch:
    """Written tables in the shared folder. They cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.n = spark, f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}", 0
        atexit.register(self.close)

    def save(self, df: DataFrame) -> DataFrame:
        """Writes df and returns it as read back; ``df.scratch_path`` names the folder for drop()."""
        self.n += 1
        path = f"{self.base}/{self.n:03d}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no later read needs."""
        for t in tables:
            self._delete(t.scratch_path)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def close(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            try:
                self._delete(self.base)
            except Exception:  # the JVM may be gone at exit; the folder is the cluster's to clean then
                pass
