"""Operator 3: quality classifier, naive Bayes support vectors (NB-SVM).

Features are indicators of n-grams. Of the UTF-8 bytes of a text: n = 1, 2 and 3 (trigrams
hashed to 17 bits). Of its words: n = PATTERN words up to renaming, that is, which of them
are equal to which; such a pattern tells prose from lists and loops in any vocabulary. Each
indicator is scaled by its class log-count ratio r = log((p / |p|) / (q / |q|)), p and q
being the smoothed numbers of good and bad training texts with the n-gram, and a linear
model with hinge loss is fitted to the scaled indicators by dual coordinate descent. A
logistic curve fitted on training rows that the descent has not seen turns margins into
scores.

The fit uses SAMPLE labelled rows at most, those with the smallest hashes of doc_id, one
row per doc_id, and of these as many as have SAMPLE_BYTES of features; all are counted and
cut where they lie, so that the driver gets no more than that. The sample's ids, a bounded
number, are broadcast to pick their texts; the corpus is never shuffled. Every whole text
is scored in one scan; the broadcast model has a fixed size.

Defined cases. Null texts count as empty, and an empty text gets the score of the bias
alone; a null doc_id counts as held out and is never learned from; null labels are left
out, of several labels of one document the smallest counts, of several texts the one with
the smallest hash; repeated rows get equal scores. Without training rows of both classes
every score is the share of good labels, 0.5 if there are none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, key_columns
from .textscan import LOWER, Slice, slices, word_hashes, words

#: Labelled rows that the fit uses at most, bytes of their features, and the share of them that calibrates.
SAMPLE, SAMPLE_BYTES, CALIBRATE = 10_000, 200_000_000, 0.2
FOLDS, THRESHOLD = 5, 0.3
SMOOTH, COST, SWEEPS = 1.0, 1.0, 12
_TRI_BITS = 17
PATTERN = 4
_BYTE_DIMS = 256 + 65536 + (1 << _TRI_BITS)
#: A pattern is a bit for each two of its words.
_DIMS = _BYTE_DIMS + (1 << PATTERN * (PATTERN - 1) // 2)


def remainder(doc_id: Column, folds: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def _grams(s: Slice) -> Iterator[np.ndarray]:
    """For each row the (repeated) indices of its n-grams."""
    d = s.data.astype(np.int32)
    two = 256 + d[:-1] * 256 + d[1:] if len(d) > 1 else np.zeros(0, np.int32)
    mixed = (d[:-2].astype(np.uint32) << 16 | d[1:-1].astype(np.uint32) << 8 | d[2:].astype(np.uint32)) * np.uint32(2654435761) if len(d) > 2 else np.zeros(0, np.uint32)
    three = (mixed >> np.uint32(32 - _TRI_BITS)).astype(np.int32) + 256 + 65536
    shape, first = _patterns(s)
    for k, (a, b) in enumerate(zip(s.bounds[:-1].tolist(), s.bounds[1:].tolist(), strict=True)):
        yield np.concatenate([d[a:b], two[a : max(a, b - 1)], three[a : max(a, b - 2)], shape[first[k] : max(first[k], first[k + 1] - PATTERN + 1)]])


def _patterns(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """The index of the pattern that begins at each word, and each row's first word."""
    begin, end, first = words(s.data, s.bounds)
    h = word_hashes(LOWER[s.data], begin, end)
    n = max(len(h) - PATTERN + 1, 0)
    out, bit = np.full(n, _BYTE_DIMS, np.int32), 0
    for a in range(1, PATTERN):
        for b in range(a):
            out += (h[a : a + n] == h[b : b + n]).astype(np.int32) << bit
            bit += 1
    return out, first


@dataclass
class Model:
    """score = 1 / (1 + exp(-(slope * margin + offset))); margin is the mean weight of a text's n-grams times the root of their number, plus bias."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def scores(self, s: Slice) -> list[float]:
        on, out = np.zeros(_DIMS, np.float32), []
        for g in _grams(s):
            on[g] = 1
            n = float(on.sum())
            m = float(self.weights @ on) / max(n, 1.0) ** 0.5 + self.bias
            on[g] = 0
            out.append(1 / (1 + np.exp(-(self.slope * m + self.offset))))
        return out


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, dims: int, cost: float, sweeps: int, seed: int = 7) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L2-regularised hinge loss: each dual variable in turn to its best value from 0 to cost; the last weight is the bias."""
    w, bias, alpha = np.zeros(dims), 0.0, np.zeros(len(rows))
    square = np.array([v @ v + 1 for v in values])
    order = np.random.default_rng(seed)
    for _ in range(sweeps):
        largest = 0.0
        for i in order.permutation(len(rows)):
            x, v = rows[i], values[i]
            g = y[i] * (w[x] @ v + bias) - 1
            a = min(max(alpha[i] - g / square[i], 0.0), cost)
            if a != alpha[i]:
                step = (a - alpha[i]) * y[i]
                w[x] += step * v
                bias += step
                alpha[i] = a
                largest = max(largest, abs(g))
        if largest < 0.01:
            break
    return w, bias


def _calibrate(margin: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Newton's method for a logistic curve over margins, with Platt's smoothed targets."""
    n1 = good.sum()
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (len(good) - n1 + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        e, v = p - target, p * (1 - p) + 1e-9
        g = np.array([e @ margin + 1e-3 * a, e.sum()])
        h = np.array([[v @ margin**2 + 1e-3, v @ margin], [v @ margin, v.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return a, b


def fit(rows: list[np.ndarray], good: np.ndarray) -> Model:
    """rows: each text's distinct n-gram indices, sorted; good: their labels."""
    if not len(rows) or good.all() or not good.any():
        share = good.mean() if len(rows) else 0.5
        share = min(max(float(share), 1e-6), 1 - 1e-6)
        return Model(np.zeros(_DIMS, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    late = max(1, int(len(rows) * (1 - CALIBRATE)))
    if good[:late].all() or not good[:late].any() or len(rows) - late < 20:
        late = len(rows)
    p, q = np.full(_DIMS, SMOOTH), np.full(_DIMS, SMOOTH)
    for x, g in zip(rows[:late], good[:late], strict=True):
        (p if g else q)[x] += 1
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    values = [ratio[x] / max(len(x), 1) ** 0.5 for x in rows]
    w, bias = descend(rows[:late], values[:late], np.where(good[:late], 1.0, -1.0), _DIMS, COST, SWEEPS)
    unseen = slice(late, None) if late < len(rows) else slice(None)
    margin = np.array([w[x] @ v + bias for x, v in zip(rows[unseen], values[unseen], strict=True)])
    slope, offset = _calibrate(margin, good[unseen])
    return Model((w * ratio).astype(np.float32), float(bias), float(slope), float(offset))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = FOLDS) -> Model:
    """Fits on at most ``sample`` labelled rows outside the held-out fold."""
    known = labels.where("doc_id is not null and quality is not null").where(remainder(F.col("doc_id"), folds) != 0)
    known = known.groupBy("doc_id").agg(F.min("quality").alias("good"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches):
            found = [np.unique(g).astype(np.int32).tobytes() for g in _grams(s)]
            yield pa.record_batch([*(s.rows.column(c) for c in ("doc_id", "k_tx", "good")), pa.array(found, pa.binary())], ["doc_id", "k_tx", "good", "grams"])

    # The sample's ids are at most ``sample`` rows, so this broadcast is bounded.
    scratch = Scratch(docs.sparkSession, "quality")
    texts = docs.select("doc_id", key_columns()[1].alias("k_tx"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = texts.mapInArrow(features, "doc_id long, k_tx long, good int, grams binary")
    rows = scratch.save(rows.groupBy("doc_id").agg(F.min_by(F.struct("good", "grams"), "k_tx").alias("row")).select("doc_id", F.xxhash64("doc_id").alias("place"), "row.*"))
    # A row of two numbers for each id of the sample: where the features of the rows before reach SAMPLE_BYTES.
    sizes = rows.select("place", "doc_id", F.octet_length("grams").alias("n")).orderBy("place", "doc_id").toArrow()
    total = np.cumsum(np.asarray(sizes["n"], np.int64)) if sizes.num_rows else np.zeros(0, np.int64)
    last = int(np.searchsorted(total, SAMPLE_BYTES, side="right"))
    if last < sizes.num_rows:
        place, doc = sizes["place"][last].as_py(), sizes["doc_id"][last].as_py()
        rows = rows.where((F.col("place") < place) | (F.col("place") == place) & (F.col("doc_id") < doc))
    table = rows.toArrow()
    order = np.argsort(np.array(table["doc_id"].to_pylist(), np.int64), kind="stable")
    rows, good = table["grams"].to_pylist(), np.array(table["good"].to_pylist(), np.int64) == 1
    mixed = np.random.default_rng(11).permutation(order)
    return fit([np.frombuffer(rows[i], np.int32) for i in mixed], good[mixed])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs' doc_id with ``score``, for every row; all other columns are left out."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches):
            yield pa.record_batch([s.rows.column("doc_id"), pa.array(shared.value.scores(s), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose score reaches the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches):
            yield s.rows.filter(pa.array([x >= threshold for x in shared.value.scores(s)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, model)
    return out.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


#: A fitted model is not SQL; the query is tested for held-out accuracy.
SQL = None
