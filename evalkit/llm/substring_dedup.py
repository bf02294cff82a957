"""Operator 1: substring deduplication with a log-structured fingerprint index.

A word is removed if a window of WINDOW words that covers it occurs earlier, in a document
of smaller doc_id or further left in its own; windows are judged on the input.

The index is made of logs. A log is a set of sorted immutable runs, bucketed files keyed by
a hash; a new batch is one more run, which is merge-joined with the older ones bucket by
bucket without a shuffle. FANOUT runs of one level are compacted into a run of the next, so
an entry is rewritten once per level. There are three logs:

* documents: the digest of a document's words, and the first document that has it;
* anchors: of the hashes of the ANCHOR-word windows inside a window of WINDOW words, the
  least (the leftmost of equals) is the window's anchor. Equal windows have equal anchors,
  so a window can only repeat if its anchor does, and anchors are an eighth of the words.
  The log has how often an anchor occurs, and the place of one that occurs once;
* windows: the digest of every window whose anchor occurs more than once, and its first place.

``append`` takes a batch of documents and returns what repeats in it, against all batches
before and the batch itself:

1. A document with the words of an earlier one, of WINDOW words or more, loses all of them
   and is done. The texts of the others become a run of their own, by number.
2. The batch's anchors become a run. Joined with the older ones it tells which anchors of
   the batch occur nowhere else, and which anchors that were alone so far no longer are.
3. Verify. Windows whose anchor occurs elsewhere are candidates, in the batch and at the
   places in older documents that step 2 found. Their digests (96 bits over the words'
   bytes) are joined with the log of windows; first places stay, all others are repeats.
4. Cut. Each document's words under a repeat go; the rest is joined by single spaces.

What travels back to a document is its own places, whatever number of copies a window has,
and documents are only ever joined by their numbers, which are unique. ``save`` writes the
index's list of runs, ``open`` goes on from there.

Defined cases. Null and empty texts have no words; texts under WINDOW words are left alone;
a null doc_id comes first; rows equal in doc_id and text are one document listed several
times and get equal results; rows that share a doc_id but not the text are separate
documents, in the order of their text hashes. A word may have any length.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, documents, keyed
from .textscan import Slice, slices, window_hashes, window_starts, word_hashes, words

WINDOW, ANCHOR, BATCHES = 20, 8, 2
#: Runs of a level that are compacted into one of the next.
FANOUT = 4
#: A place is a document's number times 2**PLACE plus the word's.
PLACE = 28
_U = np.uint64


@dataclass
class Windows:
    """The windows of a slice: the word each begins with, its row, and the word its anchor begins with."""

    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hashes: np.ndarray
    start: np.ndarray
    row: np.ndarray
    anchor: np.ndarray
    anchor_hash: np.ndarray


def windows(s: Slice, size: int = WINDOW, anchor: int = ANCHOR) -> Windows:
    begin, end, first = words(s.data, s.bounds)
    hashes = word_hashes(s.data, begin, end, 2)
    start, row = window_starts(first, size)
    if not len(start):
        return Windows(begin, end, first, hashes, start, row, start, np.zeros(0, _U))
    grams = window_hashes(hashes[:, 0], anchor)
    # The least of each run of ``span`` grams: hash above, place below, so that the leftmost of equals wins.
    span, low = size - anchor + 1, _U(max(22, int(len(hashes)).bit_length()))
    key = (grams >> low) << low | np.arange(len(grams), dtype=_U)
    wide = 1
    while wide * 2 <= span:
        key = np.minimum(key[: len(key) - wide], key[wide:])
        wide *= 2
    if wide < span:
        key = np.minimum(key[: len(key) - (span - wide)], key[span - wide :])
    at = (key[start] & ((_U(1) << low) - _U(1))).astype(np.int64)
    return Windows(begin, end, first, hashes, start, row, at, grams)


def _inventory(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's number of words and the digest of its words joined by spaces."""
    for s in slices(batches):
        begin, end, first = words(s.data, s.bounds)
        sha = [_joined(s.data, begin[a:b], end[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        yield pa.record_batch([s.rows.column("num"), pa.array(np.diff(first)), pa.array(sha, pa.binary())], ["num", "n_words", "sha"])


def _joined(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> bytes:
    """SHA-256 of the words joined by one space."""
    if not len(begin):
        return hashlib.sha256(b"").digest()
    a, b = int(begin[0]), int(end[-1])
    size = end - begin
    if int(size.sum()) + len(begin) - 1 == b - a:  # one white-space byte between words already
        text = data[a:b].copy()
        text[end[:-1] - a] = 0x20
        return hashlib.sha256(text.tobytes()).digest()
    out = np.full(int(size.sum()) + len(begin) - 1, 0x20, np.uint8)
    to = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(to, size) + inside] = data[np.repeat(begin, size) + inside]
    return hashlib.sha256(out.tobytes()).digest()


def _fingerprints(size: int, anchor: int):
    """(h, num, pos) of every anchor of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches):
            w = windows(s, size, anchor)
            at, one = np.unique(w.anchor, return_index=True)
            row = w.row[one]
            num = np.asarray(s.rows.column("num"))
            yield pa.record_batch([pa.array(w.anchor_hash[at].view(np.int64)), pa.array(num[row]), pa.array((at - w.first[row]).astype(np.int32))], ["h", "num", "pos"])

    return run


def _listed(s: Slice, w: Windows, column: str) -> np.ndarray:
    """The words, as places in the slice, that a column lists for each row."""
    lists = s.rows.column(column)
    count = np.array([len(x) if x.is_valid else 0 for x in lists], np.int64)
    return np.asarray(lists.flatten()).astype(np.int64) + np.repeat(w.first[:-1], count)


def _candidates(s: Slice, w: Windows) -> np.ndarray:
    """Which windows have an anchor that is not among its row's single ones."""
    single = np.zeros(len(w.hashes), bool)
    single[_listed(s, w, "single")] = True
    return ~single[w.anchor]


def _digests(s: Slice, w: Windows, on: np.ndarray, size: int) -> pa.RecordBatch:
    """(d, e, place) of the windows that are on; d and e are 96 bits of digest."""
    start, row = w.start[on], w.row[on]
    d, e = (window_hashes(w.hashes[:, k], size) for k in (0, 1))
    d, e = (x[start] if len(x) else x for x in (d, e))
    place = (np.asarray(s.rows.column("num"))[row] << PLACE) + start - w.first[row]
    return pa.record_batch([pa.array(d.view(np.int64)), pa.array((e >> _U(32)).astype(np.uint32).view(np.int32)), pa.array(place)], ["d", "e", "place"])


def _verify(size: int, anchor: int):
    """(d, e, place) of every candidate window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches):
            w = windows(s, size, anchor)
            yield _digests(s, w, _candidates(s, w), size)

    return run


def _verify_old(size: int, anchor: int):
    """(d, e, place) of the windows whose anchors are listed in ``alone``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches):
            w = windows(s, size, anchor)
            found = np.zeros(len(w.hashes), bool)
            found[_listed(s, w, "alone")] = True
            yield _digests(s, w, found[w.anchor], size)

    return run


def _cut(size: int, anchor: int):
    """(num, n_removed, sha) of every row; ``first`` has the starts of the candidates that are their windows' first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches):
            w = windows(s, size, anchor)
            repeat = np.zeros(len(w.hashes) + size + 1, np.int64)
            on = np.zeros(len(w.hashes), bool)
            on[w.start[_candidates(s, w)]] = True
            on[_listed(s, w, "first")] = False
            start = np.flatnonzero(on)
            repeat[start] += 1
            repeat[start + size] -= 1
            gone = np.cumsum(repeat)[: len(w.hashes)] > 0
            total = np.concatenate([[0], np.cumsum(gone)])[w.first]
            sha = []
            for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
                kept = ~gone[a:b]
                sha.append(_joined(s.data, w.begin[a:b][kept], w.end[a:b][kept]))
            yield pa.record_batch([s.rows.column("num"), pa.array(np.diff(total)), pa.array(sha, pa.binary())], ["num", "n_removed", "sha"])

    return run


class _Log:
    """Runs of rows that are unique in their keys, by level; ``merge`` says what two rows of a key make."""

    def __init__(self, index: FingerprintIndex, name: str, keys: list[str], merge: dict[str, str]):
        self.index, self.name, self.keys, self.merge = index, name, keys, merge
        self.levels: list[list[str]] = []

    @property
    def runs(self) -> list[DataFrame]:
        return [self.index.spark.table(t) for level in self.levels for t in level]

    def write(self, rows: DataFrame) -> DataFrame:
        """A new run of the lowest level."""
        name = self.index.write(rows, self.keys)
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(name)
        return self.index.spark.table(name)

    def _both(self, a: DataFrame, b: DataFrame) -> DataFrame:
        both = a.alias("a").join(b.alias("b"), self.keys, "full_outer")
        return both.select(*self.keys, *(F.expr(rule.format(a=f"a.{c}", b=f"b.{c}")).alias(c) for c, rule in self.merge.items()))

    def compact(self) -> None:
        """Merges the runs of each full level, bucket by bucket, into one of the next."""
        for k in range(len(self.levels)):
            if len(self.levels[k]) >= FANOUT:
                old = self.levels[k]
                merged = self.index.spark.table(old[0])
                for more in old[1:]:
                    merged = self._both(merged, self.index.spark.table(more))
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(self.index.write(merged, self.keys))
                self.levels[k] = []
                self.index.drop(old)


class FingerprintIndex:
    """The logs of all documents so far, in a folder; see the top of this module."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None, size: int = WINDOW, anchor: int = ANCHOR):
        self.spark, self.folder, self.size, self.anchor = spark, folder.rstrip("/"), size, anchor
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.scratch = Scratch(spark, "substring")
        self.documents = _Log(self, "documents", ["sha"], {"num": "least({a}, {b})"})
        self.anchors = _Log(self, "anchors", ["h"], {"n": "coalesce({a}, 0) + coalesce({b}, 0)", "num": "coalesce({a}, {b})", "pos": "coalesce({a}, {b})"})
        self.windows = _Log(self, "windows", ["d", "e"], {"place": "least({a}, {b})"})
        self.texts: list[str] = []

    @property
    def logs(self) -> list[_Log]:
        return [self.documents, self.anchors, self.windows]

    def write(self, rows: DataFrame, keys: list[str]) -> str:
        """Rows as a table of files bucketed and sorted by the keys."""
        name = f"run_{uuid.uuid4().hex}"
        rows.write.format("parquet").option("compression", "zstd").option("path", f"{self.folder}/{name}").bucketBy(self.buckets, *keys).sortBy(*keys).saveAsTable(name)
        return name

    def drop(self, names: list[str], files: bool = True) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            if files:
                self.scratch._delete(f"{self.folder}/{name}")

    def save(self) -> None:
        """Writes the list of runs, from which open() goes on."""
        state = {log.name: log.levels for log in self.logs} | {"texts": self.texts, "buckets": self.buckets, "size": self.size, "anchor": self.anchor}
        state["schemas"] = {t: self.spark.table(t).schema.simpleString()[7:-1] for t in [*self.texts, *(t for log in self.logs for level in log.levels for t in level)]}
        self.spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/states/{len(self.texts):09d}")

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> FingerprintIndex:
        """The index that was last saved in a folder."""
        rows = spark.read.parquet(f"{folder.rstrip('/')}/states/*").select("state", F.input_file_name().alias("at"))
        state = json.loads(rows.orderBy(F.desc("at")).first().state)
        out = cls(spark, folder, state["buckets"], state["size"], state["anchor"])
        out.texts = state["texts"]
        keys = {t: ["num"] for t in out.texts}
        for log in out.logs:
            log.levels = state[log.name]
            keys |= {t: log.keys for level in log.levels for t in level}
        for t, by in keys.items():
            columns = ", ".join(c.replace(":", " ", 1) for c in state["schemas"][t].split(","))
            spark.sql(f"CREATE TABLE IF NOT EXISTS {t} ({columns}) USING parquet CLUSTERED BY ({', '.join(by)}) SORTED BY ({', '.join(by)}) INTO {out.buckets} BUCKETS LOCATION '{out.folder}/{t}'")
        return out

    def close(self, files: bool = False) -> None:
        """Takes the runs out of the session's catalog, and with ``files`` off the disk."""
        for log in self.logs:
            self.drop([t for level in log.levels for t in level], files)
        self.drop(self.texts, files)

    def append(self, batch: DataFrame) -> DataFrame:
        """Adds documents (num, text), whose numbers are unique and above all before, and returns (num, n_words, n_removed, sha) for them: what is left without repeats."""
        size, anchor = self.size, self.anchor
        rows = self.scratch.save(batch.mapInArrow(_inventory, "num long, n_words long, sha binary"))
        fresh = rows.where(F.col("n_words") >= size).groupBy("sha").agg(F.min("num").alias("num"))
        for old in self.documents.runs:
            fresh = fresh.join(old.select("sha"), "sha", "left_anti")
        fresh = self.documents.write(fresh)
        own = self.write(batch.join(fresh.select("num").hint("merge"), "num", "left_semi").select("num", "text"), ["num"])
        texts = self.spark.table(own)

        found = texts.mapInArrow(_fingerprints(size, anchor), "h long, num long, pos int")
        older = self.anchors.runs
        run = self.anchors.write(found.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("num").alias("num"), F.min("pos").alias("pos")))
        known = run.select("h", "n", "num", "pos", F.lit(0).cast("long").alias("was"), F.lit(None).cast("long").alias("old"), F.lit(None).cast("int").alias("at"))
        for r in older:
            r = r.select("h", F.col("n").alias("m"), F.col("num").alias("num_"), F.col("pos").alias("pos_"))
            known = known.join(r, "h", "left").select("h", "n", "num", "pos", (F.col("was") + F.coalesce("m", F.lit(0))).alias("was"), F.coalesce("num_", "old").alias("old"), F.coalesce("pos_", "at").alias("at"))
        single = known.where("n = 1 and was = 0").groupBy("num").agg(F.collect_list("pos").alias("single"))
        work = texts.join(single.hint("merge"), "num", "left")
        candidates = work.mapInArrow(_verify(size, anchor), "d long, e int, place long")
        if older:
            alone = known.where("was = 1").groupBy(F.col("old").alias("num")).agg(F.collect_list("at").alias("alone"))
            for t in self.texts:
                again = self.spark.table(t).join(alone.hint("merge"), "num")
                candidates = candidates.union(again.mapInArrow(_verify_old(size, anchor), "d long, e int, place long"))
        older = self.windows.runs
        first = self.windows.write(candidates.groupBy("d", "e").agg(F.min("place").alias("place")))
        for r in older:
            first = first.join(r.select("d", "e"), ["d", "e"], "left_anti")
        # First places in older documents meet no document of the batch and fall out of the join.
        first = first.select(F.shiftright("place", PLACE).alias("num"), F.col("place").bitwiseAND(F.lit((1 << PLACE) - 1)).cast("int").alias("start"))
        first = first.groupBy("num").agg(F.collect_list("start").alias("first"))
        cut = work.join(first.hint("merge"), "num", "left").mapInArrow(_cut(size, anchor), "num long, n_removed long, sha binary")

        cut = cut.withColumnRenamed("sha", "cut")
        out = rows.join(cut.hint("merge"), "num", "left")
        copy = F.col("n_removed").isNull() & (F.col("n_words") >= size)
        removed = F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
        left = F.when(copy, F.unhex(F.lit(hashlib.sha256(b"").hexdigest()))).otherwise(F.coalesce("cut", "sha"))
        out = self.scratch.save(out.select("num", "n_words", removed.alias("n_removed"), left.alias("sha")))
        self.texts.append(own)
        for log in self.logs:
            log.compact()
        return out


def _numbered(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, bool]:
    """(texts: num, text; rows: doc_id, num; whether rows are listed several times). num keeps the order of (k_id, k_tx) and fits a place."""
    rows = scratch.save(keyed(docs).select("k_id", "k_tx", "doc_id"))
    span = rows.agg(F.min("k_id").alias("a"), F.max("k_id").alias("b"), F.count_distinct("k_id").alias("ids"), F.count_distinct("k_id", "k_tx").alias("keys"), F.count(F.lit(1)).alias("rows")).first()
    if span.a is None or (span.ids == span.keys and span.b - span.a < 1 << (62 - PLACE)):
        num = (F.col("k_id") - F.lit(span.a or 0)).alias("num")
        return keyed(docs).select(num, "text"), rows.select("doc_id", num), span.rows != span.keys
    keys = rows.select("k_id", "k_tx").distinct()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A partition's rows are numbered from its own offset: as monotonically_increasing_id, without gaps to speak of.
    keys = scratch.save(keys.repartitionByRange(parts, "k_id", "k_tx").sortWithinPartitions("k_id", "k_tx").withColumn("m", F.monotonically_increasing_id()))
    part = F.shiftright("m", 33)
    sizes = keys.groupBy(part.alias("part")).count()
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row per partition
    offset = sizes.select("part", (F.sum("count").over(ahead) - F.col("count")).alias("offset"))
    # The offsets are a row per partition.
    names = scratch.save(keys.withColumn("part", part).join(F.broadcast(offset), "part").select("k_id", "k_tx", (F.col("offset") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))).alias("num")))
    texts = scratch.save(keyed(docs).select("k_id", "k_tx", "text").join(names, ["k_id", "k_tx"]).select("num", "text"))
    return texts, rows.join(names, ["k_id", "k_tx"]).select("doc_id", "num"), span.rows != span.keys


def substring_dedup(docs: DataFrame, size: int = WINDOW, anchor: int = ANCHOR, batches: int = BATCHES) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256. The documents are appended to a new index in ``batches`` batches."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring")
    texts, rows, several = _numbered(docs, scratch)
    index = FingerprintIndex(spark, f"{scratch.base}/index", size=size, anchor=anchor)
    last = rows.agg(F.max("num")).first()[0] or 0
    found = None
    try:
        for k in range(batches):
            batch = texts.where(F.col("num").between(k * (last + 1) // batches, (k + 1) * (last + 1) // batches - 1))
            done = index.append(batch.dropDuplicates(["num"]) if several else batch)
            found = done if found is None else found.union(done)
    finally:
        index.close(files=True)
    return rows.join(found.hint("merge"), "num").select("doc_id", "n_words", "n_removed", F.lower(F.hex("sha")).alias("kept_sha256"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir))


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 18), lambda s: {'s': s, 'k': md5(array_to_string(ws[s : s + 19], ' '))})) AS v FROM w WHERE len(ws) >= 20),
r AS (SELECT doc_id, v.s AS s, row_number() OVER (PARTITION BY v.k ORDER BY doc_id, v.s) AS n FROM p),
c AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM r WHERE n > 1),
x AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
k AS (SELECT x.doc_id, count(c.i) AS n_removed, string_agg(word, ' ' ORDER BY x.i) FILTER (c.i IS NULL) AS kept FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.i = c.i GROUP BY x.doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""
