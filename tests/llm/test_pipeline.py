from __future__ import annotations

import corpus_pipeline
from evalkit.llm import decontaminate, queries

from .odd import LOWER, corpus, frame


def test_stages_keep_columns_and_only_drop_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {tuple(r) for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        after = {tuple(r) for r in docs.collect()}
        assert docs.columns == columns and after <= before, name
    ids = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in ids.collect()} == {r.doc_id for r in docs.collect()}
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, sf).collect()) == sorted(r.doc_id for r in docs.collect())


def test_stages_take_odd_rows(spark, sf):
    docs = frame(spark, corpus())
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and {r.doc_id for r in out.collect()} <= {i for i, _ in corpus()}


def test_near_stage_takes_five_words_and_four_fifths(spark, sf):
    """Pairs between 0.80 and 0.85 go, pairs below 0.80 stay."""
    sets = lambda words: {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
    rows, near = [], []
    for k, length in enumerate((99, 104, 110, 80)):
        words = [f"d{k}w{n}" for n in range(length)]
        other = [*words[:25], "x", *words[26:70], "y", *words[71:]]  # two changed words, five shingles each
        x, y = sets(words), sets(other)
        near.append(len(x & y) / len(x | y))
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    assert all(0.80 <= v < 0.85 for v in near[:3]) and near[3] < 0.80
    kept = {r.doc_id for r in corpus_pipeline.near_copies(spark, frame(spark, rows), sf).collect()}
    assert kept == {0, 2, 4, 6, 7}


def test_rows_are_told_apart_by_id_and_text(spark, sf):
    rows = [(3, "same text"), (3, "another text"), (5, "same text"), (5, "same text"), (None, "lone"), (None, None), (8, ""), (9, "Same Text"), (9, "same TEXT"), (None, "lone")]
    kept = sorted(((r.doc_id, r.text) for r in corpus_pipeline.exact_copies(spark, frame(spark, rows), sf).collect()), key=repr)
    assert kept == sorted([(3, "another text"), (9, "Same Text"), (None, "lone"), (8, "")], key=repr)
    words = [f"w{k}" for k in range(60)]
    base, copy, other = " ".join(words), " ".join([*words[:59], "x"]), " ".join(f"o{k}" for k in range(30))
    rows = [(3, base), (3, other), (5, copy), (2, copy + " y"), (7, None), (None, ""), (9, "one")]
    kept = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, frame(spark, rows), sf).collect()), key=repr)
    assert kept == sorted([(2, copy + " y"), (3, other), (7, None), (None, ""), (9, "one")], key=repr)


def test_exact_and_decontaminate_stages_match_brute_force(spark, sf):
    docs = frame(spark, corpus())
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    key = lambda r: (r[0] is not None, r[0] or 0)
    best: dict[str, tuple] = {}
    for r in sorted(rows, key=lambda r: (key(r), [-ord(c) for c in r[1] or ""])):
        best[(r[1] or "").translate(LOWER)] = r
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.exact_copies(spark, docs, sf).collect()), key=repr)
    assert sorted((repr(i), (t or "").translate(LOWER)) for i, t in got) == sorted((repr(r[0]), t) for t, r in best.items())
    clean = corpus_pipeline.benchmark_free(spark, docs, sf)
    hit = [r for r in decontaminate.matches(docs, items).collect() if r.item_ids]
    assert clean.count() == len(rows) - len(hit)


def test_stages_take_empty_tables(spark, sf):
    docs = frame(spark, corpus()).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).collect() == []


def test_every_query_is_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 11)]
    assert set(queries.oracle_sql()) <= set(names)
