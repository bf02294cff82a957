"""Operator 8: benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts and items are lower-cased and their white space is collapsed. A document is
contaminated by an item of L characters if some passage of it is within
floor(RATE * L) edits of the item. Per item-sized window of a document:

1. The CGK random walk embeds the window: step j outputs character x[i] and moves on by a
   random bit of (j, x[i]). Windows within few edits of an item meet its walk again and
   again, so edit distance becomes Hamming distance.
2. LSH samples SAMPLED positions of the walk, REPEATS times for each of WALKS independent
   walks; a window is a candidate if one sample agrees with the item's throughout. The
   constants are set for a recall of 0.99 or more of windows at the threshold while about
   one in twenty-five unrelated windows passes; the tests measure both.
3. The candidate's passage, widened by the threshold on both sides, is verified by exact
   (bit-parallel) infix edit distance.

Windows are laid where a match is possible at all: an item cut into k + SEEDS pieces has,
within k edits, SEEDS pieces that occur unchanged, on diagonals at most k apart. One
automaton finds the pieces of all items in a text; windows without SEEDS consistent
pieces cannot be within k edits and are not embedded. That rule loses nothing. Items of
fewer than SHORT characters allow too few edits for the walk to tell; their windows are all
candidates, and an item that allows no edit is its own only piece.

One scan over the documents, no shuffle. Items are broadcast in blocks of BLOCK_CHARS
characters, dealt by item and not by text, so that equal items spread; a larger benchmark
takes more scans, whose results are joined.

Defined cases. Null and empty texts are clean; null items and items without a character
other than white space match nothing; an item may be as short as one character, and matches
inside words too; equal items are each reported; repeated rows get equal results; null
doc_ids are carried through.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, keyed
from .textscan import mix

RATE, SEEDS, SHORT = 0.1, 2, 32
WALKS, REPEATS, SAMPLED = 16, 64, 6
BLOCK_CHARS = 4_000_000
_CLASSES = 64


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def allowed(length: int, rate: float = RATE) -> int:
    return int(rate * length)


def infix_distance(item: str, masks: dict[str, int], text: str, most: int) -> int:
    """The least edit distance of item to a substring of text (Myers' bit vectors); most + 1 if it is larger."""
    n = len(item)
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score, best = full, 0, n, n
    for c in text:
        eq = masks.get(c, 0)
        x = eq | down
        diag = ((((eq & up) + up) ^ up) | eq | down) & full
        right, left = (down | ~(diag | up)) & full, up & diag
        if right & top:
            score += 1
        elif left & top:
            score -= 1
            if score < best:
                best = score
        right, left = (right << 1) & full, (left << 1) & full
        up, down = (left | ~(x | right)) & full, right & x
    return min(best, most + 1)


def masks_of(item: str) -> dict[str, int]:
    out: dict[str, int] = defaultdict(int)
    for k, c in enumerate(item):
        out[c] |= 1 << k
    return dict(out)


class Walks:
    """CGK walks and the positions that the LSH samples from them."""

    def __init__(self, longest: int, walks: int = WALKS, repeats: int = REPEATS, sampled: int = SAMPLED):
        self.shape = (walks, repeats, sampled)
        # The walk moves on at half its steps, so that two steps a character cover the window.
        self.steps = max(2 * longest, 1)
        grid = np.arange(walks * self.steps * _CLASSES, dtype=np.uint64).reshape(walks, self.steps, _CLASSES)
        self.moves = (mix(grid + np.uint64(0x51ED270B)) & np.uint64(1)).astype(np.int64)
        self.unit = (mix(np.arange(walks * repeats * sampled, dtype=np.uint64) + np.uint64(0xA5A5)) >> np.uint64(11)).astype(np.float64) / 2**53

    def sketches(self, texts: list[str], lengths: list[int]) -> np.ndarray:
        """For each text the sampled characters of its walks, (walks, repeats, sampled). A text is cut or padded to its length; samples lie within its own 2 * length steps."""
        walks, repeats, sampled = self.shape
        size = np.array(lengths, np.int64)
        wide = int(size.max()) + 1
        chars = np.zeros((len(texts), wide), np.int32)
        for k, t in enumerate(texts):
            raw = np.frombuffer(t[: lengths[k]].encode("utf-32-le", "surrogatepass"), np.uint32)
            chars[k, : len(raw)] = raw
        kind = (mix(chars.astype(np.uint64)) % np.uint64(_CLASSES)).astype(np.int64)
        rows = np.arange(len(texts))
        out = np.zeros((len(texts), walks, repeats * sampled), np.int32)
        for w in range(walks):
            at = (self.unit[w * repeats * sampled : (w + 1) * repeats * sampled][None, :] * (2 * size[:, None])).astype(np.int64)
            path = np.zeros((len(texts), 2 * wide), np.int32)
            i = np.zeros(len(texts), np.int64)
            for j in range(2 * (wide - 1)):
                path[:, j] = chars[rows, i]
                i = np.minimum(i + self.moves[w, j][kind[rows, i]], size)
            out[:, w] = np.take_along_axis(path, at, 1)
        return out.reshape(len(texts), walks, repeats, sampled)


class Matcher:
    """Finds the items of one block in normalised texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE, seeds: int = SEEDS):
        import ahocorasick

        self.items = [(i, t) for i, t in items if t]
        self.most = [allowed(len(t), rate) for _, t in self.items]
        self.masks = [masks_of(t) for _, t in self.items]
        self.seeds = [seeds if k else 1 for k in self.most]
        self.short = np.array([len(t) < SHORT for _, t in self.items], bool)
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, t) in enumerate(self.items):
            n = self.most[k] + self.seeds[k]
            cuts = [j * len(t) // n for j in range(n + 1)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                pieces[t[a:b]].append((k, a))
        self.automaton = ahocorasick.Automaton()
        for p, where in pieces.items():
            self.automaton.add_word(p, (len(p), where))
        if self.items:
            self.automaton.make_automaton()
            self.walks = Walks(max(len(t) for _, t in self.items))
            texts = [t for _, t in self.items]
            self.sketch = self.walks.sketches(texts, [len(t) for t in texts])

    def windows(self, text: str) -> list[tuple[int, int]]:
        """(item, start) of the item-sized windows of a text with enough consistent pieces."""
        seen: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for end, (n, where) in self.automaton.iter(text):
            for k, a in where:
                seen[k].append((end + 1 - n - a, a))
        out = []
        for k, found in seen.items():
            most, done, seeds = self.most[k], None, self.seeds[k]
            if len(found) < seeds:
                continue
            found.sort()
            lo = 0
            for hi, (diagonal, _) in enumerate(found):
                while diagonal - found[lo][0] > most:
                    lo += 1
                if hi - lo + 1 >= seeds and (done is None or found[lo][0] > done) and len({a for _, a in found[lo : hi + 1]}) >= seeds:
                    out.append((k, max(0, found[(lo + hi) // 2][0])))
                    done = found[hi][0]
        return out

    def search(self, texts: list[str]) -> list[dict[int, int]]:
        """For each text the items (their place in the block) that it holds, with the least edit distance."""
        out: list[dict[int, int]] = [{} for _ in texts]
        if not self.items:
            return out
        asked = [(d, k, a) for d, text in enumerate(texts) for k, a in self.windows(text)]
        for part in range(0, len(asked), 500):
            block = asked[part : part + 500]
            sizes = [len(self.items[k][1]) for _, k, _ in block]
            sketch = self.walks.sketches([texts[d][a : a + n] for (d, _, a), n in zip(block, sizes, strict=True)], sizes)
            which = [k for _, k, _ in block]
            agree = (sketch == self.sketch[which]).all(-1).any((1, 2)) | self.short[which]
            for (d, k, a), n, hit in zip(block, sizes, agree.tolist(), strict=True):
                if not hit or out[d].get(k) == 0:
                    continue
                item, most = self.items[k][1], self.most[k]
                # The window may begin up to the threshold off the passage, and the passage be longer by as much.
                passage = texts[d][max(0, a - 2 * most) : a + n + 2 * most]
                distance = 0 if item in passage else infix_distance(item, self.masks[k], passage, most)
                if distance <= most:
                    out[d][k] = min(distance, out[d].get(k, distance))
        return out


def _blocks(items: DataFrame, id_col: str = "item_id") -> Iterator[list[tuple[int, str]]]:
    """Normalised items, in blocks of about BLOCK_CHARS characters."""
    rows = items.where("text is not null").select(F.col(id_col).cast("long").alias("i"), "text")
    size = rows.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    blocks = -(-size // BLOCK_CHARS) or 1
    for b in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("i", "text"), F.lit(blocks)) == b).orderBy("i", "text").collect()
        yield [(r.i, normal(r.text)) for r in part]


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [normal(t) if t else "" for t in batch.column("text").to_pylist()]


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, item_ids (sorted), distances (in their order)."""
    kind, schema = pa.list_(pa.struct([("item", pa.int64()), ("distance", pa.int32())])), "k_id long, k_tx long, doc_id long, hits array<struct<item: long, distance: int>>"
    scans = []
    for block in _blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value)
            for batch in batches:
                for k in range(0, batch.num_rows, 200):
                    part = batch.slice(k, 200)
                    hits = [[{"item": matcher.items[i][0], "distance": d} for i, d in found.items()] for found in matcher.search(_texts(part))]
                    yield pa.record_batch([*(part.column(c) for c in ("k_id", "k_tx", "doc_id")), pa.array(hits, kind)], ["k_id", "k_tx", "doc_id", "hits"])

        scans.append(keyed(docs).mapInArrow(run, schema))
    out = scans[0]
    for k, more in enumerate(scans[1:]):
        found = more.where(F.size("hits") > 0).groupBy("k_id", "k_tx").agg(F.first("hits").alias(f"hits{k}"))
        out = out.join(found, ["k_id", "k_tx"], "left").withColumn("hits", F.concat("hits", F.coalesce(f"hits{k}", F.array().cast("array<struct<item: long, distance: int>>")))).drop(f"hits{k}")
    hits = F.array_sort("hits")
    return out.select("doc_id", F.transform(hits, lambda h: h["item"]).alias("item_ids"), F.transform(hits, lambda h: h["distance"]).alias("distances"))


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that hold no item."""
    for block in _blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value)
            for batch in batches:
                for k in range(0, batch.num_rows, 200):
                    part = batch.slice(k, 200)
                    yield part.filter(pa.array([not found for found in matcher.search(_texts(part))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), F.size("item_ids").cast("long").alias("n_items"), "item_ids", F.array_min("distances").alias("least_distance"))


#: Edit distance within windows is not SQL; tested against brute force.
SQL = None
