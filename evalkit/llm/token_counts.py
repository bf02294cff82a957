"""Operator 7: token counts without ids.

A text's tokens are the tokens of its pre-tokens, so each distinct pre-token of the corpus
is encoded once, and a document's count is the sum over its pre-tokens of frequency times
pieces.

1. A scan gives each task's distinct pre-tokens with their frequencies; one aggregation
   makes the corpus vocabulary, and every entry is encoded once.
2. The most frequent entries, HOT_ENTRIES at most, are broadcast: a frequency threshold
   read off a histogram keeps that bound at any corpus size. They cover nearly all
   occurrences, and no frequent pre-token is ever a shuffle key.
3. A second scan forms each document's pre-token frequencies and sums those it finds in
   the broadcast table; the few that it doesn't find go to a join with the rest of the
   vocabulary and come back as one number per document.

Defined cases. A null or empty text has no bytes and no tokens; repeated rows each get
their count; a null doc_id is carried through; very long texts are cut at pre-token
boundaries only by the pattern itself, never truncated.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, keyed
from .textscan import slices

TOKENIZER = "byte_bpe_50k.json"
#: Entries of the broadcast table at most, and bytes that an entry may have to be in it.
HOT_ENTRIES, HOT_BYTES = 250_000, 64
#: Bytes of text that a task splits at once; a longer text is taken alone.
SLICE = 1 << 21
LIMIT = 512
#: Outside these blocks, whose letters, digits and spaces all Unicode versions class alike, the library's own splitter is used.
_UNSURE = regex.compile("[^\\x00-\u0557\u2010-\u2027\u2030-\u205e\u20a0-\u20bf\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]").search


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: White space other than a space or a line feed, as a class of RE2.
_OTHER_SPACE = r"[\x09\x0b-\x0d\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@dataclass
class Units:
    """Some texts as units: a word that follows a space, a text's first word, or a text that doesn't split at its spaces.

    Text k, which is row ``rows[k]``, has the units ``of[bounds[k] : bounds[k + 1]]``, one at
    least. Unit ``unit[j]`` holds the distinct pre-token ``pres[code[j]]``, once for each j.
    """

    rows: np.ndarray
    bounds: np.ndarray
    of: np.ndarray
    n: int
    pres: pa.Array
    code: np.ndarray
    unit: np.ndarray


class PreTokens:
    """Splits a text as the tokenizer's byte-level pre-tokenizer does; special strings stand alone."""

    def __init__(self, path: str):
        import json

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or spec["normalizer"] or spec["post_processor"]:
            raise ValueError("only byte-level tokenizers without normalizer, prefix space or post-processor")
        import public_tokenizers

        special = "|".join(regex.escape(t["content"]) for t in spec["added_tokens"])
        self.special = regex.compile(special) if special else None
        self.marks = {t["content"] for t in spec["added_tokens"]}
        # What a text that splits at its spaces has not, but for spaces beside letters and line feeds beside letters.
        self.apart = "|".join(["  ", "\n ", " \n", r"\A ", r" \z", _OTHER_SPACE, *(re.escape(m) for m in self.marks)])
        self.plain = regex.compile(public_tokenizers.PATTERN).findall
        # The same pattern for ASCII texts, whose letters and digits need no tables.
        self.ascii = re.compile(public_tokenizers.PATTERN.replace(r"\p{L}", "A-Za-z", 99).replace(r"\p{N}", "0-9").replace(" ?A-Za-z+", " ?[A-Za-z]+").replace(" ?0-9+", " ?[0-9]+"), re.ASCII).findall
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str

    def splits(self, text: str) -> bool:
        """Whether the text splits at its spaces.

        A space with no other white space beside it always begins a pre-token, so a word's
        pre-tokens depend on the word alone. Not so beside other white space, nor in a text
        with a special string.
        """
        if "  " in text or text[:1] == " " or text[-1:] == " " or any(m in text for m in self.marks):
            return False
        first, *rest = text.split(" ")
        return not (first[-1:].isspace() and rest) and not any(w[0].isspace() or w[-1].isspace() for w in rest)

    def of_words(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The pre-tokens of words that each follow a space, and the place of the word that each is of."""
        pres, places = [pa.array([], pa.string())], [np.zeros(0, np.int64)]
        ascii_ = pc.string_is_ascii(words).to_numpy(zero_copy_only=False)
        for some in (np.flatnonzero(ascii_), np.flatnonzero(~ascii_)):
            if len(some):
                # One text of all words: they hold no space, so the pre-tokens that begin with one begin the words.
                found = pa.array(self.find(" " + " ".join(words.take(pa.array(some)).to_pylist())), pa.string())
                pres.append(found)
                places.append(some[np.cumsum(pc.starts_with(found, " ").to_numpy(zero_copy_only=False)) - 1])
        return pa.concat_arrays(pres), np.concatenate(places)

    def units(self, texts: pa.Array) -> Units:
        doubtful = pc.match_substring_regex(texts, self.apart).to_numpy(zero_copy_only=False)
        whole = np.array([k for k in np.flatnonzero(doubtful).tolist() if not self.splits(texts[k].as_py())], np.int64)
        rows = np.setdiff1d(np.arange(len(texts)), whole)
        lists = pc.split_pattern(texts.take(pa.array(rows)), " ")
        bounds, coded = lists.offsets.to_numpy().astype(np.int64), lists.flatten().dictionary_encode()
        of, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary.cast(pa.string())
        # The first words, which no space precedes, and the whole texts are units beyond the words.
        firsts, which = np.unique(of[bounds[:-1]], return_inverse=True)
        of[bounds[:-1]] = len(words) + which
        following = np.flatnonzero(np.bincount(of, minlength=len(words))[: len(words)])
        found, places = self.of_words(words.take(pa.array(following)))
        alone = [self.find(w) for w in words.take(pa.array(firsts)).to_pylist()] + [self(texts[k].as_py()) for k in whole.tolist()]
        pres = pa.concat_arrays([found, pa.array(list(chain.from_iterable(alone)), pa.string())]).dictionary_encode()
        unit = np.concatenate([following[places], len(words) + np.repeat(np.arange(len(alone)), [len(x) for x in alone])])
        wholes = np.arange(len(whole))
        return Units(
            np.concatenate([rows, whole]),
            np.concatenate([bounds, bounds[-1] + 1 + wholes]),
            np.concatenate([of, len(words) + len(firsts) + wholes]),
            len(words) + len(alone),
            pres.dictionary,
            pres.indices.to_numpy().astype(np.int64),
            unit,
        )

    def find(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii(text)
        if not _UNSURE(text):
            return self.plain(text)
        return [text[a:b] for _, (a, b) in self.exact(text)]

    def __call__(self, text: str) -> list[str]:
        if self.special is None or not any(m in text for m in self.marks):
            return self.find(text)
        parts = regex.split(f"({self.special.pattern})", text)
        return list(chain.from_iterable([p] if p in self.marks else self.find(p) for p in parts))


def _tally(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = PreTokens(path)
        for s in slices(batches, most=SLICE):
            u = split.units(s.rows.column("text"))
            times = np.bincount(u.of, minlength=u.n)
            freq = np.bincount(u.code, weights=times[u.unit], minlength=len(u.pres))
            yield pa.record_batch([u.pres, pa.array(freq.astype(np.int64))], ["pre", "freq"])

    return run


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a core per task
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                # One encoding for many pre-tokens: each of its pieces tells the pre-token that it is of.
                made = tok.encode(part.column("pre").to_pylist(), is_pretokenized=True, add_special_tokens=False)
                n = np.bincount(np.array(made.word_ids, np.int64), minlength=part.num_rows)
                yield pa.record_batch([part.column("pre"), part.column("freq"), pa.array(n, pa.int32())], ["pre", "freq", "pieces"])

    return run


def _missing(u: Units, known: np.ndarray) -> pa.Array:
    """For each text its pre-tokens that are not known, with their frequencies."""
    lacks = np.flatnonzero(~known[u.code])
    lacks = lacks[np.argsort(u.unit[lacks], kind="stable")]
    n = np.bincount(u.unit[lacks], minlength=u.n)
    begin = np.cumsum(n) - n
    at = np.flatnonzero(n[u.of])
    text, unit = np.searchsorted(u.bounds, at, side="right") - 1, u.of[at]
    times = n[unit]
    inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    code = u.code[lacks[np.repeat(begin[unit], times) + inner]]
    pairs, freq = np.unique(np.repeat(text, times) * len(u.pres) + code, return_counts=True)
    text, code = np.divmod(pairs, max(len(u.pres), 1))
    entries = pa.StructArray.from_arrays([u.pres.take(pa.array(code)), pa.array(freq.astype(np.int64))], ["pre", "freq"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(u.rows) + 1)), pa.int32()), entries)


def _add_up(path: str, hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, pieces = PreTokens(path), hot.value
        for s in slices(batches, most=SLICE):
            u = split.units(s.rows.column("text"))
            part = s.rows.take(pa.array(u.rows))
            made = np.array([pieces.get(p, -1) for p in u.pres.to_pylist()], np.int64)
            of_unit = np.bincount(u.unit, weights=np.maximum(made, 0)[u.code], minlength=u.n).astype(np.int64)
            found = np.add.reduceat(of_unit[u.of], u.bounds[:-1])
            size = pc.binary_length(part.column("text")).cast(pa.int64())
            yield pa.record_batch(
                [*(part.column(c) for c in ("k_id", "k_tx", "doc_id")), size, pa.array(found), _missing(u, made >= 0)], ["k_id", "k_tx", "doc_id", "n_bytes", "found", "rest"]
            )

    return run


def vocabulary(docs: DataFrame, path: str) -> DataFrame:
    """pre, freq, pieces: every distinct pre-token of docs, encoded once."""
    tallies = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_tally(path), "pre string, freq long")
    return tallies.groupBy("pre").agg(F.sum("freq").alias("freq")).mapInArrow(_encode(path), "pre string, freq long, pieces int")


def frequent(vocab: DataFrame, most: int = HOT_ENTRIES) -> DataFrame:
    """The entries at or above the lowest frequency (by octave, then exactly inside it) that keeps them to ``most``."""
    short = vocab.where(F.octet_length("pre") <= HOT_BYTES)
    octave = F.floor(F.log2(F.col("freq"))).cast("int")
    floor, total = None, 0
    for row in sorted(short.groupBy(octave.alias("o")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r.o):
        if total + row.n > most:
            break
        total, floor = total + row.n, row.o
    return short.where(octave >= floor) if floor is not None else short.where(F.lit(False))


def token_counts(docs: DataFrame, path: str, hot_entries: int = HOT_ENTRIES) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    vocab = scratch.save(vocabulary(docs, path))
    table = frequent(vocab, hot_entries).select("pre", "pieces").toArrow()
    hot = spark.sparkContext.broadcast(dict(zip(table["pre"].to_pylist(), table["pieces"].to_pylist(), strict=True)))

    rows = scratch.save(
        keyed(docs).mapInArrow(
            _add_up(path, hot), "k_id long, k_tx long, doc_id long, n_bytes long, found long, rest array<struct<pre: string, freq: long>>"
        )
    )
    hot.destroy()
    rest = rows.where(F.size("rest") > 0)
    # Rows equal in id and text bring the same list: it counts once, and the sum serves each of them.
    rest = rest.groupBy("k_id", "k_tx").agg(F.first("rest").alias("rest")).select("k_id", "k_tx", F.inline("rest"))
    tail = rest.join(vocab.select("pre", "pieces"), "pre").groupBy("k_id", "k_tx").agg(F.sum(F.col("freq") * F.col("pieces")).alias("tail"))
    return rows.drop("rest").join(tail, ["k_id", "k_tx"], "left").select("doc_id", "n_bytes", (F.col("found") + F.coalesce("tail", F.lit(0))).alias("n_tokens"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts(documents(spark, sf_dir), tokenizer_path(TOKENIZER))
    return out.withColumn("over_limit", F.col("n_tokens") > LIMIT)


#: Byte-pair merges are not SQL; the query is tested against the library.
SQL = None
