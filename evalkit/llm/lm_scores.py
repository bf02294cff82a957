"""Operator 6: language-model scoring with a log-frequency Bloom filter.

The model is an interpolated bigram model. Its counts live in a Bloom filter: the count c
of an n-gram is quantised to level j = 1 + floor(log(c) / log(BASE)), and the n-gram is
inserted once for each level 1 to j. A count is read back by probing level after level
until one misses. Text tokens repeat, so a slice of text probes each of its distinct
n-grams once.

    P(w | h) = m * c(h w) / c(h) + (1 - m) * (c(w) + 1) / (N + V + 1),  m = LAMBDA * c(h) / (c(h) + PRIOR)

with all c from the filter and m = 0 for a history it doesn't hold.

1. One scan counts words. Distinct words go to a table (exact, one row each).
2. One scan counts unigrams and bigrams into hash buckets, as packed arrays that are
   pre-aggregated per task; each bucket, of about BUCKET_TOKENS tokens whatever the size
   of the corpus, becomes one block of the filter, of BITS bits per inserted level. Every
   n-gram is inserted, those seen once too. Blocks are a table in the shared folder that
   grows with the corpus; no process holds them all.
3. One scan packs rows into units of about UNIT_BYTES of text, a row each, and a scan over
   these lists each unit's distinct n-grams by bucket. Requests meet their block in a join on the bucket, which
   answers with one byte, the level, for each n-gram; answers meet their unit's rows in a
   join on the unit, which scores them. It also gets the exact counts of the most frequent
   words (HOT_WORDS at most). Base scores are exact: words outside the hot table are
   joined with the exact count table and come back as one sum per document.

An unseen n-gram is read as one seen once by chance, about one time in 85; a stored one is
never read too low. Counts are quantised, so the probabilities of a history's words add up
to one only as far as the levels allow. Words are identified by 64-bit hashes of their
bytes; among V distinct words about V**2 / 2**65 pairs can be expected to collide.

Defined cases. A null text counts as empty and has one token, the end; a null doc_id has
the crc32 of an empty text as its fold; repeated rows each count in training and get equal
scores; without any training row N = V = 0 and each token's probability is 1.
"""

from __future__ import annotations

import io
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, keyed
from .quality import remainder
from .textscan import LOWER, Slice, mix, slices, word_hashes, words

FOLDS, HELD_OUT = 7, 2
BASE, PROBES, BITS = 1.5, 4, 10
LAMBDA, PRIOR = 0.6, 30.0
HOT_WORDS, BUCKET_TOKENS = 1_000_000, 1 << 20
#: Bytes of text that are scored together.
UNIT_BYTES = 8 << 20
#: Entries that a task gathers before it hands them on.
GATHERED = 2_000_000
_U = np.uint64
_END, _BEGIN = int(mix(np.array([101], _U))[0]), int(mix(np.array([202], _U))[0])


def token_hashes(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a slice's tokens, each row's words and then its end, and where each row's tokens begin."""
    data = LOWER[s.data]
    begin, end, first = words(data, s.bounds)
    n = len(s)
    starts = first + np.arange(n + 1)
    out = np.full(len(begin) + n, _END, _U)
    body = np.ones(len(out), bool)
    body[starts[1:] - 1] = False
    out[body] = word_hashes(data, begin, end)
    return out, starts


def bigram_hashes(tokens: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(histories, bigrams) of each token; a row's first token follows the begin mark."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[starts[:-1]] = _BEGIN
    with np.errstate(over="ignore"):
        return before, mix(before * _U(0x9E3779B97F4A7C15) + mix(tokens))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts[:0]


class _Gather:
    """Counts of hashed keys, merged as they come in."""

    def __init__(self):
        self.keys, self.counts, self.n = [], [], 0

    def add(self, keys: np.ndarray) -> None:
        k, c = np.unique(keys, return_counts=True)
        self.keys.append(k)
        self.counts.append(c.astype(np.int64))
        self.n += len(k)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        k, c = _summed(np.concatenate(self.keys), np.concatenate(self.counts)) if self.keys else (np.zeros(0, _U), np.zeros(0, np.int64))
        self.keys, self.counts, self.n = [], [], 0
        return k, c


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = _Gather()

    def out():
        k, c = found.take()
        for a in range(0, len(k), 100_000):
            yield pa.record_batch([pa.array(k[a : a + 100_000].view(np.int64)), pa.array(c[a : a + 100_000])], ["h", "c"])

    for s in slices(batches):
        found.add(token_hashes(s)[0])
        if found.n >= GATHERED:
            yield from out()
    if found.n:
        yield from out()


def _count_ngrams(buckets: int):
    shift = _U(64 - (buckets.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Gather()

        def out():
            k, c = found.take()
            cut = np.searchsorted(k >> shift, np.arange(buckets + 1, dtype=_U))
            rows: list[tuple[int, bytes, bytes]] = []
            for b in range(buckets):
                x, y = k[cut[b] : cut[b + 1]], c[cut[b] : cut[b + 1]]
                if len(x):
                    rows.append((b, _inner(x, shift).tobytes(), np.minimum(y, 255).astype(np.uint8).tobytes()))
                    big = np.flatnonzero(y > 255)
                    if len(big):  # the rest of large counts, in 64 bits
                        rows.append((b, _inner(x[big], shift).tobytes(), (y[big] - 255).tobytes()))
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "keys", "counts"])

        for s in slices(batches):
            tokens, starts = token_hashes(s)
            found.add(np.concatenate([tokens, np.full(len(s), _BEGIN, _U), bigram_hashes(tokens, starts)[1]]))
            if found.n >= GATHERED:
                yield from out()
        if found.n:
            yield from out()

    return run


def _inner(keys: np.ndarray, shift: np.uint64) -> np.ndarray:
    """32 bits of a key below those that choose its bucket."""
    return (keys >> (shift - _U(32))).astype(np.uint32)


def levels(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(BASE) + 1e-9).astype(np.int64)


def count_of(level: np.ndarray) -> np.ndarray:
    """The middle of the counts of a level; 0 for level 0."""
    low, high = np.ceil(BASE ** (level - 1.0)), np.maximum(np.ceil(BASE ** (level * 1.0)) - 1, 1)
    return np.where(level > 0, (low + np.maximum(low, high)) / 2, 0.0)


def _probe(inner: np.ndarray, level: np.ndarray | int, probe: int, bits: np.ndarray | int) -> np.ndarray:
    """The bit, within its block, that a probe of an n-gram's level looks at."""
    with np.errstate(over="ignore"):
        x = inner.astype(_U) + _U(1) + (np.asarray(level, _U) << _U(34)) + (_U(probe) << _U(42))
        return (mix(x) % np.asarray(bits, _U)).astype(np.int64)


def _block(most_bits: int | None = None):
    """Builds a bucket's block of the filter from its packed counts: BITS bits per inserted level, or most_bits at most."""

    def run(table: pa.Table) -> pa.Table:
        keys, counts = [], []
        for k, c in zip(table["keys"].to_pylist(), table["counts"].to_pylist(), strict=True):
            x = np.frombuffer(k, np.uint32)
            keys.append(x)
            counts.append(np.frombuffer(c, np.uint8 if len(c) == len(x) else np.int64).astype(np.int64))
        k, c = _summed(np.concatenate(keys), np.concatenate(counts))
        top = levels(c)
        bits = max(64, BITS * int(top.sum()))
        bits = bits if most_bits is None else min(bits, most_bits)
        bits += -bits % 8
        on = np.zeros(bits, bool)
        for level in range(1, int(top.max(initial=0)) + 1):
            here = k[top >= level]
            for p in range(PROBES):
                on[_probe(here, level, p, bits)] = True
        return pa.table({"bucket": pa.array([table["bucket"][0].as_py()], pa.int32()), "block": pa.array([np.packbits(on).tobytes()], pa.binary())})

    return run


def _read_levels(inner: np.ndarray, data: np.ndarray, offset: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The levels of n-grams, by probing one level after the other; offset and bits are those of each one's block in data."""
    level, alive, at = np.zeros(len(inner), np.int64), np.arange(len(inner)), 1
    while len(alive):
        for p in range(PROBES):
            i = offset[alive] + _probe(inner[alive], at, p, bits[alive])
            alive = alive[(data[i >> 3] >> (7 - (i & 7)).astype(np.uint8)) & 1 > 0]
        level[alive] = at
        at += 1
    return level


@dataclass
class Filter:
    """The blocks one after another; offset and bits of each bucket's block."""

    data: np.ndarray
    offset: np.ndarray
    bits: np.ndarray

    @classmethod
    def of(cls, blocks: dict[int, bytes], buckets: int) -> Filter:
        none = b"\0" * 8
        parts = [blocks.get(b, none) for b in range(buckets)]
        size = np.array([len(p) for p in parts], np.int64)
        return cls(np.frombuffer(b"".join(parts), np.uint8), (np.cumsum(size) - size) * 8, size * 8)

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The quantised counts of distinct keys, by probing one level after the other."""
        shift = _U(64 - (len(self.bits).bit_length() - 1))
        bucket, inner = (keys >> shift).astype(np.int64), _inner(keys, shift)
        offset, bits = self.offset[bucket], self.bits[bucket]
        return count_of(_read_levels(inner, self.data, offset, bits))


@dataclass
class Blocks:
    """The filter as a table (bucket, block), and the number of buckets."""

    table: DataFrame
    buckets: int


@dataclass
class Model:
    filter: Blocks
    hot: np.ndarray
    hot_counts: np.ndarray
    tokens: int
    distinct: int


def _ngrams(tokens: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    return np.concatenate([tokens, pairs, np.array([_BEGIN], _U)])


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(unit, data): rows of about UNIT_BYTES of text, packed as a compressed Arrow stream of slices."""
    held, size = [], 0

    def packed() -> pa.RecordBatch:
        out = io.BytesIO()
        with pa.ipc.new_stream(out, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            for rows in held:
                w.write_batch(rows)
        return pa.record_batch([pa.array([int.from_bytes(os.urandom(8), "little", signed=True)]), pa.array([out.getvalue()], pa.binary())], ["unit", "data"])

    for s in slices(batches):
        held.append(s.rows.select(["doc_id", "text"]))
        size += len(s.data)
        if size >= UNIT_BYTES:
            yield packed()
            held, size = [], 0
    if held:
        yield packed()


def _slices_of(data: pa.Scalar) -> Iterator[Slice]:
    return slices(iter(pa.ipc.open_stream(data.as_buffer())))


def _requests(buckets: int):
    """Each unit's distinct n-grams: a row (unit, bucket, keys) for each bucket."""
    shift = _U(64 - (buckets.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit, data in zip(batch.column("unit").to_pylist(), batch.column("data"), strict=True):
                grams = []
                for s in _slices_of(data):
                    tokens, starts = token_hashes(s)
                    grams.append(np.unique(_ngrams(tokens, bigram_hashes(tokens, starts)[1])))
                k = np.unique(np.concatenate(grams))
                bucket = (k >> shift).astype(np.int32)
                at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                ends = pa.py_buffer(np.append(at, len(k)).astype(np.int32) * 4)
                keys = pa.Array.from_buffers(pa.binary(), len(at), [None, ends, pa.py_buffer(_inner(k, shift))])
                yield pa.record_batch([pa.array(np.full(len(at), unit)), pa.array(bucket[at]), keys], ["unit", "bucket", "keys"])

    return run


def _answer(requests: pa.Table, blocks: pa.Table) -> pa.Table:
    """(unit, bucket, levels) for the requests of a bucket: a byte for each n-gram."""
    keys = requests["keys"].to_pylist()
    size = np.array([len(k) // 4 for k in keys], np.int64)
    inner = np.frombuffer(b"".join(keys), np.uint32)
    level = np.zeros(len(inner), np.uint8)
    if blocks.num_rows and len(inner):
        data = np.frombuffer(blocks["block"][0].as_py(), np.uint8)
        distinct, which = np.unique(inner, return_inverse=True)
        level = _read_levels(distinct, data, np.zeros(len(distinct), np.int64), np.full(len(distinct), len(data) * 8)).astype(np.uint8)[which]
    cut = np.concatenate([[0], np.cumsum(size)])
    parts = [level[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return pa.table({"unit": requests["unit"], "bucket": requests["bucket"], "levels": pa.array(parts, pa.binary())})


_SCORED = ["doc_id", "n", "known", "base", "score", "rest"]


def _score_unit(shared):
    """For each row of a unit: n tokens, known hot tokens, sum of log10(c + 1) over hot tokens, score; and the tokens that aren't hot."""

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        all_hot, hot_counts, n_tokens, distinct = shared.value
        total = np.float64(max(n_tokens + distinct + 1, 1))
        parts = []
        for s in (x for data in rows["data"] for x in _slices_of(data)):
            tokens, starts = token_hashes(s)
            parts.append((s, tokens, starts, *bigram_hashes(tokens, starts)))
        grams = np.unique(np.concatenate([_ngrams(tokens, pairs) for _, tokens, _, _, pairs in parts]))
        got = dict(zip(answers["bucket"].to_pylist(), answers["levels"].to_pylist(), strict=True))
        level = np.frombuffer(b"".join(got[b] for b in sorted(got)), np.uint8)
        if len(level) != len(grams):
            raise ValueError(f"{len(level)} levels for {len(grams)} n-grams")
        counts = count_of(level.astype(np.int64))
        out = []
        for s, tokens, starts, before, pairs in parts:
            word, which = np.unique(tokens, return_inverse=True)
            at = np.minimum(np.searchsorted(all_hot, word), max(len(all_hot) - 1, 0))
            is_hot = all_hot[at] == word if len(all_hot) else np.zeros(len(word), bool)
            exact = np.where(is_hot, hot_counts[at], 0) if len(all_hot) else np.zeros(len(word), np.int64)
            c_word, c_pair = counts[np.searchsorted(grams, word)][which], counts[np.searchsorted(grams, pairs)]
            c_before = np.empty(len(tokens))
            c_before[1:] = c_word[:-1]
            c_before[starts[:-1]] = counts[np.searchsorted(grams, _U(_BEGIN))]
            m = LAMBDA * c_before / (c_before + PRIOR)
            p = m * np.minimum(c_pair / np.maximum(c_before, 1), 1) + (1 - m) * (c_word + 1) / total
            hot = is_hot[which]
            add = lambda x: np.add.reduceat(x, starts[:-1])  # noqa: B023, E731  each row has a token at least
            cold = np.concatenate([[0], np.cumsum(~hot)])[starts].astype(np.int32)
            rest = pa.ListArray.from_arrays(pa.array(cold), pa.array(tokens[~hot].view(np.int64)))
            known, base = add((hot & (exact[which] > 0)).astype(np.int64)), add(np.where(hot, np.log10(exact[which] + 1.0), 0.0))
            out.append(pa.record_batch([s.rows.column("doc_id"), pa.array(np.diff(starts)), pa.array(known), pa.array(base), pa.array(add(np.log10(np.minimum(p, 1.0)))), rest], _SCORED))
        return pa.Table.from_batches(out)

    return run


def train(docs: DataFrame, scratch: Scratch) -> tuple[Model, DataFrame]:
    """The model of docs' texts, and the exact counts (h, c) of their words."""
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    counts = scratch.save(texts.mapInArrow(_count_words, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")))
    octave = F.floor(F.log2("c")).cast("int")
    spread = counts.groupBy(octave.alias("o")).agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("n")).collect()
    tokens, distinct = sum(r.n for r in spread), sum(r.v for r in spread)
    floor, size = 63, 0
    for r in sorted(spread, key=lambda r: -r.o):
        if size + r.v > HOT_WORDS:
            break
        size, floor = size + r.v, r.o
    table = counts.where(octave >= floor).toArrow()
    hot, c = np.array(table["h"]).astype(np.int64).view(_U), np.array(table["c"]).astype(np.int64)
    order = np.argsort(hot)

    buckets = 1 << max(6, (max(tokens, 1) * 2 // BUCKET_TOKENS).bit_length())
    packed = texts.mapInArrow(_count_ngrams(buckets), "bucket int, keys binary, counts binary")
    blocks = scratch.save(packed.groupBy("bucket").applyInArrow(_block(), "bucket int, block binary"))
    return Model(Blocks(blocks, buckets), hot[order], c[order], tokens, distinct), counts


def score(docs: DataFrame, model: Model, counts: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, n_known, base_score, score."""
    units = scratch.save(keyed(docs).mapInArrow(_units, "unit long, data binary"))  # written, as the units' names are random
    requests = units.mapInArrow(_requests(model.filter.buckets), "unit long, bucket int, keys binary")
    answers = requests.groupBy("bucket").cogroup(model.filter.table.groupBy("bucket")).applyInArrow(_answer, "unit long, bucket int, levels binary")
    shared = docs.sparkSession.sparkContext.broadcast((model.hot, model.hot_counts, model.tokens, model.distinct))
    rows = units.groupBy("unit").cogroup(answers.groupBy("unit")).applyInArrow(_score_unit(shared), "doc_id long, n long, known long, base double, score double, rest array<long>")
    # A row's number, short beside its id and text; saved, so that it stays.
    rows = scratch.save(rows.withColumn("row", F.monotonically_increasing_id()))
    shared.destroy()
    scratch.drop(units)
    rest = rows.select("row", F.explode("rest").alias("h")).join(counts, "h")
    tail = rest.groupBy("row").agg(F.count(F.lit(1)).alias("more"), F.sum(F.log10(F.col("c") + 1)).alias("logs"))
    per_token = float(np.log10(max(model.tokens + model.distinct + 1, 1)))
    return rows.drop("rest").join(tail, "row", "left").select(
        "doc_id",
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        (F.col("base") + F.coalesce("logs", F.lit(0.0)) - F.col("n") * F.lit(per_token)).alias("base_score"),
        "score",
    )


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = documents(spark, sf_dir), Scratch(spark, "lm")
    fold = remainder(F.col("doc_id"), FOLDS)
    model, counts = train(docs.where(fold != HELD_OUT), scratch)
    out = score(docs, model, counts, scratch)
    return out.select("doc_id", (fold == HELD_OUT).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


#: The filter is not SQL; the query's exact columns are tested against brute force.
SQL = None
