"""Operator 4: personal data, with information-theoretic sanitisation.

Base spans are e-mail addresses, IP addresses, card and phone numbers, found per kind from
left to right in linear time. Each distinct value is a protected entity e, the words of a
document that lie outside its spans are terms t, and the corpus says how much a term
reveals of an entity: with c(t) documents that have t and n(t, e) that have both,

    doubt = log2((c(t) + SMOOTH) / n(t, e))

bits of doubt about e remain to a reader who sees t (IC(e) - PMI(t; e), smoothed by SMOOTH
documents without e, so that a single occurrence does not prove as much as many). In a
document with e, a term that leaves REMOVE bits or less is removed, one that leaves
GENERALISE bits or less is replaced by its class. Terms that leave more doubt stay.

Counts cover all documents and whole texts. Entities that occur in the same documents have
the same counts and are one class, so an address book is one class however many values it
has; a class that occurs in d documents can only be revealed by terms of 2**GENERALISE * d
- SMOOTH documents or less, and only such pairs are counted. For classes of one document
the count is one, and nothing is counted at all. Every count is aggregated before it is
shuffled, so an entity that a third of all documents share is an ordinary key.

Defined cases. Null counts as empty and has no spans; a null doc_id is carried through;
rows equal in id and text are one document for the counts and get equal spans; empty tables
give empty results; a span's offsets are code points of the unchanged text, end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, keyed
from .textscan import LOWER, slices, word_hashes, words

KINDS = ("email", "ip", "card", "phone")
SMOOTH, REMOVE, GENERALISE = 1, 1.0, 2.0

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: Each match begins with a whole run of digits, so that a failed run is passed over at once.
_IP = re.compile(r"[0-9]++((?:\.[0-9]++){3})?+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]").search


def emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > done and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            done = m.end()
            out.append((a, done))
        at = text.find("@", max(at + 1, done))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _IP.finditer(text) if m[1] is not None and all(len(p.lstrip("0")) < 4 and int(p[-4:]) < 256 for p in m[0].split("."))]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    if "+" not in text:
        return []
    return [m.span() for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of each of KINDS."""
    digits = _DIGIT(text) is not None
    return [emails(text), ips(text) if digits else [], cards(text) if digits else [], phones(text) if digits else []]


def _words(text: str, raw: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end (code points) of the words that touch no span."""
    begin, end, _ = words(raw, np.array([0, len(raw)]))
    hashes = word_hashes(LOWER[raw], begin, end).view(np.int64)
    place = np.concatenate([np.cumsum((raw & 0xC0) != 0x80) - 1, [len(text)]])
    a, b = place[begin], np.where(end < len(raw), place[np.minimum(end, len(raw))], len(text))
    free = np.ones(len(a), bool)
    for s, e in spans:
        free[np.searchsorted(b, s, side="right") : np.searchsorted(a, e, side="left")] = False
    return hashes[free], a[free], b[free]


_ROWS = "k_id long, k_tx long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, entities array<long>, terms array<long>, text string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Base spans of each row; of rows that have some also the distinct entities and terms, and the text."""
    longs = pa.list_(pa.int64())
    for s in slices(batches):
        counts, base, entities, terms, kept = [[] for _ in KINDS], [], [], [], []
        for k, text in enumerate(s.rows.column("text").to_pylist()):
            found = base_spans(text)
            for n, some in zip(counts, found, strict=True):
                n.append(len(some))
            spans = [(kind, a, b) for kind, some in zip(KINDS, found, strict=True) for a, b in some]
            base.append(",".join(f"{kind}:{a}:{b}" for kind, a, b in spans))
            entities.append(sorted({xxhash.xxh3_64_intdigest(f"{kind}:{text[a:b].lower()}") - 2**63 for kind, a, b in spans}))
            terms.append(np.unique(_words(text, s.data[s.bounds[k] : s.bounds[k + 1]], [x[1:] for x in spans])[0]) if spans else [])
            kept.append(text if spans else None)
        cols = [*(s.rows.column(c) for c in ("k_id", "k_tx", "doc_id")), *(pa.array(n, pa.int64()) for n in counts), pa.array(base, pa.string())]
        yield pa.record_batch([*cols, pa.array(entities, longs), pa.array(terms, longs), pa.array(kept, pa.string())], ["k_id", "k_tx", "doc_id", *(f"n_{k}" for k in KINDS), "base", "entities", "terms", "text"])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, c): in how many of a task's documents each word occurs."""
    keys, held = [], 0

    def out() -> pa.RecordBatch:
        h, c = np.unique(np.concatenate(keys), return_counts=True)
        return pa.record_batch([pa.array(h), pa.array(c.astype(np.int64))], ["h", "c"])

    for s in slices(batches):
        data = LOWER[s.data]
        begin, end, first = words(data, s.bounds)
        h = word_hashes(data, begin, end).view(np.int64)
        row = np.repeat(np.arange(len(s)), np.diff(first))
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        keys.append(h[new])
        held += int(new.sum())
        if held >= 2_000_000:
            yield out()
            keys, held = [], 0
    if held:
        yield out()


def revealing(rows: DataFrame, counts: DataFrame, scratch: Scratch, smooth: int = SMOOTH, generalise: float = GENERALISE) -> DataFrame:
    """(k_id, k_tx, t, doubt): the terms of each document that leave ``generalise`` bits of doubt or less about one of its entities."""
    most = float(2**generalise)
    held = rows.select("k_id", "k_tx", F.explode("entities").alias("e"))
    sets = held.groupBy("e").agg(F.count(F.lit(1)).alias("d"), F.sum(F.xxhash64("k_id", "k_tx").cast("decimal(38,0)")).alias("of"))
    classes = scratch.save(held.join(sets, "e").select("k_id", "k_tx", "d", "of").distinct())
    top = classes.agg(F.max("d")).first()[0] or 0
    rare = counts.where(F.col("c") + smooth <= most * top).select(F.col("h").alias("t"), "c")
    terms = scratch.save(rows.select("k_id", "k_tx", F.explode("terms").alias("t")).join(rare, "t"))
    # Documents whose entities occur nowhere else: each count is one.
    alone = classes.where("d = 1").select("k_id", "k_tx").distinct()
    lone = terms.where(F.col("c") + smooth <= most).join(alone, ["k_id", "k_tx"], "left_semi").select("k_id", "k_tx", "t", F.log2(F.col("c") + smooth).alias("doubt"))
    both = classes.where("d > 1").join(terms, ["k_id", "k_tx"]).where(F.col("c") + smooth <= most * F.col("d"))
    told = both.groupBy("d", "of", "t").agg(F.count(F.lit(1)).alias("n"), F.max("c").alias("c"))
    told = told.select("d", "of", "t", F.log2((F.col("c") + smooth) / F.col("n")).alias("doubt")).where(F.col("doubt") <= generalise)
    return lone.union(both.join(told, ["d", "of", "t"]).select("k_id", "k_tx", "t", "doubt")).groupBy("k_id", "k_tx", "t").agg(F.min("doubt").alias("doubt"))


_TERMS = "array<struct<a: int, b: int, doubt: double>>"


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every place of a document's listed terms."""
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("doubt", pa.float64())]))
    for s in slices(batches):
        out = []
        for k, (text, base, told) in enumerate(zip(*(s.rows.column(c).to_pylist() for c in ("text", "base", "told")), strict=True)):
            spans = [tuple(map(int, x.split(":")[1:])) for x in base.split(",")]
            h, a, b = _words(text, s.data[s.bounds[k] : s.bounds[k + 1]], spans)
            doubt = {x["t"]: x["doubt"] for x in told}
            out.append([{"a": x, "b": y, "doubt": doubt[w]} for w, x, y in zip(h.tolist(), a.tolist(), b.tolist(), strict=True) if w in doubt])
        yield pa.record_batch([s.rows.column("k_id"), s.rows.column("k_tx"), pa.array(out, kind)], ["k_id", "k_tx", "terms"])


def find(docs: DataFrame, smooth: int = SMOOTH, generalise: float = GENERALISE) -> DataFrame:
    """One row per row of docs: k_id, k_tx, doc_id, n_email, n_ip, n_card, n_phone, base, terms.

    base is a string of kind:start:end; terms an array of (start, end, doubt) by start.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    found = scratch.save(keyed(docs).mapInArrow(_scan, _ROWS))
    # Rows equal in id and text are one document.
    held = scratch.save(found.where("base <> ''").select("k_id", "k_tx", "base", "entities", "terms", "text").dropDuplicates(["k_id", "k_tx"]))
    counts = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_frequencies, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    told = revealing(held, counts, scratch, smooth, generalise)
    # A list per document, of its own distinct words at most.
    told = told.groupBy("k_id", "k_tx").agg(F.collect_list(F.struct("t", "doubt")).alias("told"))
    terms = held.select("k_id", "k_tx", "base", "text").join(told, ["k_id", "k_tx"]).mapInArrow(_place, f"k_id long, k_tx long, terms {_TERMS}")
    none = F.array().cast(_TERMS)
    return found.drop("entities", "terms", "text").join(terms, ["k_id", "k_tx"], "left").withColumn("terms", F.coalesce("terms", none))


def word_class(word: str) -> str:
    """What a generalised word becomes."""
    if any(c.isdigit() for c in word):
        return "[NUMBER]"
    return "[NAME]" if word[:1].isupper() else "[WORD]"


def sanitise_text(text: str, base: str, terms: list, remove: float = REMOVE) -> str:
    """The text with base spans replaced by their kind and revealing terms generalised or removed."""
    cuts = [(int(a), int(b), f"[{k.upper()}]") for k, a, b in (x.split(":") for x in base.split(",") if x)]
    cuts += [(t["a"], t["b"], "[REMOVED]" if t["doubt"] <= remove else word_class(text[t["a"] : t["b"]])) for t in terms]
    out, done = [], 0
    for a, b, new in sorted(cuts):
        if a >= done:
            out += [text[done:a], new]
        elif b > done:  # it overlaps the one before, which covers it
            a = done
        done = max(done, b)
    return "".join([*out, text[done:]])


def sanitise(docs: DataFrame, remove: float = REMOVE, generalise: float = GENERALISE) -> DataFrame:
    """doc_id and the sanitised text of every row of docs."""
    spans = find(docs, generalise=generalise).select("k_id", "k_tx", "base", "terms").where("base != ''").dropDuplicates(["k_id", "k_tx"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                text if not base else sanitise_text(text, base, terms or [], remove)
                for text, base, terms in zip(*(batch.column(c).to_pylist() for c in ("text", "base", "terms")), strict=True)
            ]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return keyed(docs).join(spans, ["k_id", "k_tx"], "left").select("doc_id", "text", "base", "terms").mapInArrow(run, "doc_id long, text string")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find(documents(spark, sf_dir))
    more = F.array_join(F.transform("terms", lambda t: F.concat(F.lit("term:"), t["a"].cast("string"), F.lit(":"), t["b"].cast("string"))), ",")
    spans = F.concat_ws(",", F.nullif(F.col("base"), F.lit("")), F.nullif(more, F.lit("")))
    return out.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(F.encode("base", "UTF-8"), 256).alias("base_sha256"), spans.alias("spans"))


#: The spans are not SQL; base spans are tested against the plain patterns, terms against brute force.
SQL = None
