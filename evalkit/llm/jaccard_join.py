"""Operator 9: n-gram Jaccard join by grouped prefixes, up to connected components.

A document's set holds the hashes of its word shingles. Two sets link when
100 * |intersection| >= PERCENT * |union|. In one global order of shingles, linked sets
share a shingle among the first n - ceil(n * PERCENT / 100) + 1 of each: the prefixes.

1. A fixed-size count sketch over all documents orders shingles from rare to frequent (any
   order is right; this one keeps frequent shingles out of prefixes). One scan gives each
   row its set size, a 128-bit digest of its set, and its prefix.
2. Equal sets are one class. Classes of equal size with equal prefixes are one group, and
   the group's prefix is indexed once.
3. Stars: of the groups that share a prefix shingle, each is paired with the one in which
   the shingle comes earliest; members of a group are paired with its first. Pairs are
   filtered by size and by the bound that their prefixes' overlap puts on the sets', then
   verified on the whole sets. Verified links make first components.
4. The rest: where a prefix shingle (or group) still holds several components, all pairs of
   classes from different components that pass the size filter, and have the shingle early
   enough for the two sizes, are expanded, filtered and verified. Pairs inside one component need no test, as they change nothing.

So every pair of sets that may link is verified or already connected, while a large family
of near copies costs a pair per member and not the square. Whole sets are read again only
for classes in surviving pairs, picked in the scan by a fixed-size Bloom filter.

Defined cases. Null and empty texts, and texts of white space, have no shingles, link with
nothing, and are their own components; a text of fewer than SHINGLE words has its whole
sequence as its one shingle; rows equal in id and text are equal sets; null doc_ids count
as the smallest id, so a component with one has a null id. Shingles are identified by
64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, Scratch, documents, key_columns, keyed
from .components import connected
from .textscan import LOWER, Slice, mix, slices, window_hashes, window_starts, word_hashes, words

SHINGLE, PERCENT = 4, 85
#: Bytes of text per counter of the sketch, and its largest size: 2**MOST counters of a byte once broadcast.
BYTES_PER_COUNTER, LEAST, MOST = 192, 14, 24
_CHUNK = 1 << 12
_U = np.uint64


def shingles(s: Slice, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row of a slice."""
    data = LOWER[s.data]
    begin, end, first = words(data, s.bounds)
    hashes = word_hashes(data, begin, end)
    starts, row = window_starts(first, size)
    grams = window_hashes(hashes, size)[starts]
    cut = np.searchsorted(row, np.arange(len(s) + 1))
    count = np.diff(first)
    for k in range(len(s)):
        if 0 < count[k] < size:
            yield window_hashes(hashes[first[k] : first[k + 1]], int(count[k]))
        else:
            yield np.unique(grams[cut[k] : cut[k + 1]])


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - (percent * n + 99) // 100 + 1 if n else 0


def _count(bits: int, size: int):
    """A task's counters, in compressed chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.uint32)
        for s in slices(batches):
            found = list(shingles(s, size))
            if found:
                np.add.at(total, (np.concatenate(found) >> _U(64 - bits)).astype(np.int64), np.uint32(1))
        chunks = [k for k in range(0, 1 << bits, _CHUNK) if total[k : k + _CHUNK].any()]
        if chunks:
            packed = [pa.compress(total[k : k + _CHUNK].tobytes(), "zstd", asbytes=True) for k in chunks]
            yield pa.record_batch([pa.array([k // _CHUNK for k in chunks], pa.int32()), pa.array(packed, pa.binary())], ["chunk", "counts"])

    return run


def _add_counts(table: pa.Table) -> pa.Table:
    total = np.zeros(_CHUNK, np.uint64)
    for c in table["counts"].to_pylist():
        total += np.frombuffer(pa.decompress(c, _CHUNK * 4, "zstd", asbytes=True), np.uint32)
    # Eighths of an octave: a byte per counter.
    rank = np.minimum(np.floor(8 * np.log2(total + 1.0)), 255).astype(np.uint8)
    return pa.table({"chunk": table["chunk"][:1], "rank": pa.array([rank.tobytes()], pa.binary())})


def rarity(docs: DataFrame, size: int = SHINGLE) -> np.ndarray:
    """For each value of a shingle's top bits how frequent, on a log scale, its shingles are."""
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    bits = int(min(max(int(total // BYTES_PER_COUNTER).bit_length(), LEAST), MOST))
    parts = keyed(docs).select("text").mapInArrow(_count(bits, size), "chunk int, counts binary").groupBy("chunk").applyInArrow(_add_counts, "chunk int, rank binary").toArrow()
    out = np.zeros(1 << bits, np.uint8)
    for chunk, rank in zip(parts["chunk"].to_pylist(), parts["rank"].to_pylist(), strict=True):
        out[chunk * _CHUNK : (chunk + 1) * _CHUNK] = np.frombuffer(rank, np.uint8)
    return out


def _prefixes(rank, size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = rank.value
        shift = _U(64 - (len(order).bit_length() - 1))
        for s in slices(batches):
            n, digest, own, prefix = [], [], [], []
            for h in shingles(s, size):
                n.append(len(h))
                digest.append(xxhash.xxh3_128_digest(h.tobytes()))
                k = prefix_length(len(h), percent)
                # h is sorted, and the sort is stable: rank first, then hash.
                first = h[np.argsort(order[(h >> shift).astype(np.int64)], kind="stable")[:k]]
                own.append(xxhash.xxh3_128_digest(first.tobytes()))
                prefix.append(first.view(np.int64))
            offs = np.concatenate([[0], np.cumsum([len(p) for p in prefix])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(prefix)))
            yield pa.record_batch(
                [*(s.rows.column(c) for c in ("k_id", "k_tx")), pa.array(n, pa.int32()), pa.array(digest, pa.binary()), pa.array(own, pa.binary()), lists],
                ["k_id", "k_tx", "n", "digest", "own", "prefix"],
            )

    return run


_BLOOM_PROBES = 5


def _bloom_bits(keys: np.ndarray, bits: int) -> np.ndarray:
    return np.stack([(mix(keys + _U(p * 0x9E3779B9 + 1)) % _U(bits)).astype(np.int64) for p in range(_BLOOM_PROBES)])


def _row_key(k_id: np.ndarray, k_tx: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(k_id.astype(np.int64).view(_U) * _U(0x9E3779B97F4A7C15) ^ k_tx.astype(np.int64).view(_U))


def _bloom(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of (k_id, k_tx): 16 bits a key, at most 2**28 bits."""
    bits = 1 << min(max((keys.count() * 16).bit_length(), 15), 28)
    span = 1 << 15

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(_bloom_bits(_row_key(np.asarray(b.column("k_id")), np.asarray(b.column("k_tx"))), bits))
            cut = np.unique(at // span)
            yield pa.record_batch([pa.array(cut.astype(np.int32)), pa.array([(at[at // span == c] % span).astype(np.uint16).tobytes() for c in cut], pa.binary())], ["part", "at"])

    def block(table: pa.Table) -> pa.Table:
        on = np.zeros(span, bool)
        for x in table["at"].to_pylist():
            on[np.frombuffer(x, np.uint16)] = True
        return pa.table({"part": table["part"][:1], "on": pa.array([np.packbits(on).tobytes()], pa.binary())})

    out = np.zeros(bits // 8, np.uint8)
    got = keys.mapInArrow(places, "part int, at binary").groupBy("part").applyInArrow(block, "part int, on binary").toArrow()
    for part, on in zip(got["part"].to_pylist(), got["on"].to_pylist(), strict=True):
        out[part * span // 8 : (part + 1) * span // 8] = np.frombuffer(on, np.uint8)
    return out


def _sets_of(bloom, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = bloom.value
        for batch in batches:
            at = _bloom_bits(_row_key(np.asarray(batch.column("k_id")), np.asarray(batch.column("k_tx"))), len(on) * 8)
            hit = ((on[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(0)
            if hit.any():
                for s in slices(iter([batch.filter(pa.array(hit))])):
                    found = [h.tobytes() for h in shingles(s, size)]
                    yield pa.record_batch([s.rows.column("k_id"), s.rows.column("k_tx"), pa.array(found, pa.binary())], ["k_id", "k_tx", "hashes"])

    return run


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


class _Join:
    def __init__(self, docs: DataFrame, size: int, percent: int):
        self.docs, self.size, self.percent = docs, size, percent
        self.spark, self.scratch = docs.sparkSession, Scratch(docs.sparkSession, "jaccard")

    def prepare(self) -> None:
        rank = self.spark.sparkContext.broadcast(rarity(self.docs, self.size))
        schema = "k_id long, k_tx long, n int, digest binary, own binary, prefix array<long>"
        rows = self.scratch.save(keyed(self.docs).select("k_id", "k_tx", "text").mapInArrow(_prefixes(rank, self.size, self.percent), schema))
        rank.destroy()
        self.rows = rows.select("k_id", "k_tx", "n", "digest")
        sets = rows.where("n > 0").groupBy("n", "digest").agg(F.min(F.struct("k_id", "k_tx")).alias("rep"), F.first("own").alias("own"), F.first("prefix").alias("prefix"))
        self.classes = self.scratch.save(sets.select(F.monotonically_increasing_id().alias("cls"), "n", "digest", "rep", "own", "prefix"))
        groups = self.classes.groupBy("n", "own").agg(F.min("cls").alias("gid"))
        self.member = self.scratch.save(self.classes.select("cls", "n", "own").join(groups, ["n", "own"]).select("cls", "gid", "n"))

    def shared(self) -> DataFrame:
        """Index entries (token, gid, n, pos, first) of shingles that at least two groups have in their prefixes; first is the group that has it earliest."""
        index = self.classes.join(self.member.where("cls = gid").select("cls"), "cls", "left_semi").select(F.col("cls").alias("gid"), "n", F.posexplode("prefix").alias("pos", "token"))
        first = index.groupBy("token").agg(F.count(F.lit(1)).alias("many"), F.min(F.struct("pos", "gid", "n")).alias("first")).where("many > 1")
        return self.scratch.save(index.join(first.select("token", "first"), "token"))

    def may_link(self, x: str, y: str) -> str:
        """Whether a shared shingle at pos of x and of y can be the first that two linking sets of n shingles share.

        Linking sets share at least a = ceil(percent * (x.n + y.n) / (100 + percent)), so
        at most n - a of a set come before the first shared one; what comes before it in
        both, itself and what follows bounds the overlap. Every linking pair passes at its
        first shared shingle.
        """
        a = f"(({self.percent} * ({x}.n + {y}.n) + {99 + self.percent}) div {100 + self.percent})"
        return (
            f"100 * least({x}.n, {y}.n) >= {self.percent} * greatest({x}.n, {y}.n) and {x}.pos <= {x}.n - {a} and {y}.pos <= {y}.n - {a}"
            f" and least({x}.pos, {y}.pos) + 1 + least({x}.n - {x}.pos, {y}.n - {y}.pos) - 1 >= {a}"
        )

    def verify(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of classes whose sets link."""
        side = self.classes.select("cls", "n", "prefix")
        wide = pairs.join(side.toDF("a", "na", "pa"), "a").join(side.toDF("b", "nb", "pb"), "b")
        # All shared shingles up to the earlier of the two prefixes' ends are in both prefixes.
        bound = "size(array_intersect(pa, pb)) + greatest(na - size(pa), nb - size(pb))"
        live = self.scratch.save(wide.where(f"{100 + self.percent} * ({bound}) >= {self.percent} * (na + nb)").select("a", "b"))
        wanted = live.select("a").union(live.select("b")).toDF("cls").distinct().join(self.classes.select("cls", "rep.*"), "cls")
        wanted = self.scratch.save(wanted)
        bloom = self.spark.sparkContext.broadcast(_bloom(wanted.select("k_id", "k_tx")))
        found = keyed(self.docs).select("k_id", "k_tx", "text").mapInArrow(_sets_of(bloom, self.size), "k_id long, k_tx long, hashes binary")
        sets = self.scratch.save(found.join(wanted, ["k_id", "k_tx"]).groupBy("cls").agg(F.first("hashes").alias("hashes")))
        bloom.destroy()
        both = live.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
        links = self.scratch.save(both.mapInArrow(_linked(self.percent), "a long, b long"))
        self.scratch.drop(sets)
        return links

    def stars(self, shared: DataFrame) -> DataFrame:
        index = shared.alias("x").where("gid <> first.gid").where(self.may_link("x", "first")).select(F.least("gid", "first.gid").alias("a"), F.greatest("gid", "first.gid").alias("b"))
        inside = self.member.where("cls <> gid").select(F.col("gid").alias("a"), F.col("cls").alias("b"))
        return self.scratch.save(index.union(inside).distinct())

    def rest(self, shared: DataFrame, tried: DataFrame, comps: DataFrame) -> DataFrame:
        """Untried pairs of classes in different components that share a prefix shingle, or a group."""
        own = self.member.join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
        own = self.scratch.save(own)
        several = own.groupBy("gid").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"))
        tokens = shared.select("token", "gid").join(several, "gid").groupBy("token").agg(F.min("c1").alias("c1"), F.max("c2").alias("c2")).where("c1 <> c2").select("token")
        open_ = shared.select("token", "gid", "pos").join(tokens, "token").join(own.select("gid", "cls", "n", "comp"), "gid")
        # A group's members have their whole prefix in common: position 0 of the group as a shingle of its own.
        inner = several.where("c1 <> c2").select("gid").join(own.select("gid", "cls", "n", "comp"), "gid")
        inner = inner.select((F.col("gid") * 2 + 1).alias("token"), F.lit(True).alias("grp"), "gid", F.lit(0).alias("pos"), "cls", "n", "comp")
        open_ = self.scratch.save(open_.select("token", F.lit(False).alias("grp"), "gid", "pos", "cls", "n", "comp").union(inner))
        x, y = open_.alias("x"), open_.alias("y")
        pairs = x.join(y, F.expr(f"x.token = y.token and x.grp = y.grp and x.comp < y.comp and {self.may_link('x', 'y')}"))
        pairs = pairs.select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b")).distinct()
        return self.scratch.save(pairs.join(tried, ["a", "b"], "left_anti"))

    def run(self) -> DataFrame:
        self.prepare()
        shared = self.shared()
        tried = self.stars(shared)
        links = self.verify(tried)
        comps = connected(links, self.scratch)
        more = self.rest(shared, tried, comps)
        if more.limit(1).count():
            again = self.verify(more)
            if again.limit(1).count():
                comps = connected(comps.where("node <> comp").toDF("a", "b").union(again), self.scratch)
        place = self.classes.select("cls", "n", "digest", F.col("rep.k_id").alias("low")).join(comps.withColumnRenamed("node", "cls"), "cls", "left")
        place = self.scratch.save(place.select("n", "digest", "low", F.coalesce("comp", "cls").alias("comp")))
        lowest = place.groupBy("comp").agg(F.min("low").alias("least"))
        named = place.join(lowest, "comp").select("n", "digest", "least")
        return self.rows.join(named, ["n", "digest"], "left").select("k_id", "k_tx", "n", F.coalesce("least", "k_id").alias("least"))


def keep_one(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all columns, that stay: of each component the document with the smallest doc_id, of several texts under that id the one with the least hash. Documents without shingles all stay; rows equal in id and text stay or go together."""
    scratch = Scratch(docs.sparkSession, "near")
    found = _Join(docs, size, percent).run()
    lone = found.where("n = 0").select("k_id", "k_tx")
    firsts = found.where("n > 0").groupBy("least").agg(F.min(F.struct("k_id", "k_tx")).alias("first")).select("first.*")
    kept = scratch.save(firsts.union(lone).distinct()).toDF("_k_id", "_k_tx").hint("merge")
    id_, tx = key_columns()
    return docs.join(kept, (id_ == F.col("_k_id")) & (tx == F.col("_k_tx")), "left_semi")


def jaccard_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest doc_id of those it reaches by links)."""
    out = _Join(docs, size, percent).run()
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(real("k_id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), real("least").alias("component_id"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(ws) - 2, 2)), lambda s: array_to_string(ws[s : s + 3], ' '))) AS gram FROM w WHERE len(ws) > 0
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
pair AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN low ON w.doc_id = a
"""
