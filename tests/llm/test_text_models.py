from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from evalkit.llm import decontaminate, lm_scores, pii, quality, sentencepiece_codec, token_counts
from evalkit.llm.common import Scratch

from .odd import LOWER, WORDS, collected, corpus, empty, frame


def _share(i, folds):
    return zlib.crc32(("" if i is None else str(i)).encode()) % folds


# quality


def _labelled(n=600):
    rng = random.Random(1)
    good = ["market", "river", "garden", "winter", "story", "letter"]
    rows, labels = [], []
    for k in range(n):
        ok = rng.random() < 0.7
        words = [rng.choice(good) + rng.choice(["", "s", "ed"]) for _ in range(rng.randint(5, 60))]
        text = " ".join(words) if ok else rng.choice([" | ".join(words), "!! ".join(words).upper(), " ".join(w for w in words for _ in range(6))])
        rows.append((k, text))
        labels.append((k, int(ok), 0))
    return rows, labels


def test_quality_classifier_is_right_on_the_held_out_fold(spark):
    rows, labels = _labelled()
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in quality.score(docs, quality.train(docs, marks)).collect()}
    held = [(k, q) for k, q, _ in labels if _share(k, quality.FOLDS) == 0]
    assert all(0 <= s <= 1 for s in got.values())
    assert sum((got[k] >= quality.THRESHOLD) == (q == 1) for k, q in held) >= 0.97 * len(held)
    kept = quality.keep_good(docs, marks)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, s in got.items() if s >= quality.THRESHOLD}


def test_quality_ignores_the_labels_of_the_held_out_fold(spark):
    rows, labels = _labelled(300)
    docs = frame(spark, rows)
    turned = [(k, 1 - q if _share(k, quality.FOLDS) == 0 else q, t) for k, q, t in labels]
    a, b = (quality.train(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, turned))
    assert np.array_equal(a.weights, b.weights) and (a.bias, a.slope, a.offset) == (b.bias, b.slope, b.offset)


def test_quality_of_odd_rows(spark):
    rows, labels = _labelled(200)
    odd = frame(spark, corpus())
    marks = spark.createDataFrame([*labels, (None, 1, 0), (5, None, 0), (7, 0, 1)], "doc_id long, quality int, toxic int")
    scores = quality.score(odd, quality.train(frame(spark, rows), marks)).collect()
    assert len(scores) == len(corpus()) and all(0 <= r.score <= 1 for r in scores)
    nothing = quality.train(frame(spark, rows), marks.limit(0))
    assert {r.score for r in quality.score(odd, nothing).collect()} == {0.5}
    assert quality.score(empty(spark), nothing).collect() == []


def test_a_labelled_id_that_repeats_counts_once(spark, monkeypatch):
    rows, labels = _labelled(120)
    chosen = next(k for k, _, _ in labels if _share(k, quality.FOLDS))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    many = frame(spark, rows).union(frame(spark, [rows[chosen]]).crossJoin(spark.range(50_000)).drop("id"))
    seen = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda x, good: seen.append((sum(map(len, x)) * 4, len(x))) or fit(x, good))
    a, b = quality.train(frame(spark, rows), marks), quality.train(many, marks)
    assert np.array_equal(a.weights, b.weights) and seen[0] == seen[1]
    monkeypatch.setattr(quality, "SAMPLE_BYTES", seen[0][0] // 2)
    quality.train(many, marks)
    assert seen[0][0] // 4 < seen[2][0] <= seen[0][0] // 2


def test_ratios_and_dual_match_brute_force():
    """Ratios from plain counts; the descent's weights against plain projected ascent on the dual."""
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 12, 6)) for _ in range(40)]
    good = np.array([(x < 5).sum() > (x >= 8).sum() for x in rows])
    p, q = (np.array([1.0 + sum(k in x for x, g in zip(rows, good, strict=True) if g == side) for k in range(12)]) for side in (True, False))
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    values = [ratio[x] for x in rows]
    y = np.where(good, 1.0, -1.0)
    w, bias = quality.descend(rows, values, y, 12, 0.7, 4000)
    dense = np.zeros((40, 13))
    for k, x in enumerate(rows):
        dense[k, x], dense[k, 12] = values[k], 1.0
    signed = dense * y[:, None]
    alpha, gram = np.zeros(40), signed @ signed.T
    for _ in range(60_000):
        alpha = np.clip(alpha - (gram @ alpha - 1) / np.linalg.norm(gram, 2), 0, 0.7)
    assert np.allclose(np.append(w, bias), signed.T @ alpha, atol=0.02)


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(0)
    y = np.where(rng.random(200) < 0.5, 1.0, -1.0)
    rows = [np.array([0 if v > 0 else 1, 2 + k % 5]) for k, v in enumerate(y)]
    w, bias = quality.descend(rows, [np.ones(2)] * 200, y, 7, 1.0, 50)
    assert all((w[x].sum() + bias) * v > 0 for x, v in zip(rows, y, strict=True))


# personal data

_PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def _valid(kind, text):
    digits = re.sub(r"\D", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and sum(d if k % 2 == 0 else sum(map(int, str(2 * d))) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def test_base_spans_are_those_of_the_plain_patterns():
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab@.-_1234567890+ ()0") for _ in range(rng.randint(1, 90))) for _ in range(5000)]
    texts += ["é@b.c_x@d.e a@b.c@d.e.f 4111 1111 1111 1111 +1 (017) 555-7713 1.2.3.4.5.6.7.8 999.1.1.1.1 01.002.3.4", "x" * 50_000 + "@" + "y" * 50_000, "1" * 50_000]
    for t in texts:
        assert pii.base_spans(t) == [[m.span() for m in p.finditer(t) if _valid(k, m[0])] for k, p in _PLAIN.items()] if len(t) < 1000 else pii.base_spans(t) == [[], [], [], []]


def test_terms_are_those_that_reveal_an_entity(spark):
    common = "the of and to in is was for on with as by at from that this it are be or " * 3
    rows = [(k, f"{common} please write to agent zorblat quixley at zq@mail.example.com about {common}") for k in range(4)]
    rows += [(10 + k, f"{common} please write to about at") for k in range(30)]
    rows += [(50, f"{common} once hapax +1 (017) 555-7713 {common}")]
    got = {r.doc_id: r for r in pii.find(frame(spark, rows)).collect()}
    words = lambda i, text: {text[t["a"] : t["b"]] for t in got[i].terms}
    assert words(0, rows[0][1]) == {"zorblat", "quixley", "agent"}
    assert words(50, rows[-1][1]) == {"once", "hapax"}
    assert got[0].n_email == 1 and all(not got[k].terms for k in range(10, 40))
    clean = {r.doc_id: r.text for r in pii.sanitise(frame(spark, rows)).collect()}
    assert "[EMAIL]" in clean[0] and "zorblat" not in clean[0] and clean[12] == rows[6][1]


def test_terms_match_brute_force_counts(spark):
    """Over whole documents, with entities of one, some and many documents, and many values that occur together."""
    rng = random.Random(6)
    names = [f"n{k}" for k in range(60)] + [f"r{k}" for k in range(400)]
    book = " ".join(f"b{k}@ex.org" for k in range(9))
    prose = lambda n: " ".join(rng.choice(names) for _ in range(n))
    mark = lambda k: f"u{k % 7}@ex.org" if k % 2 else f"s{k}@ex.org" if k % 6 == 0 else book if k % 8 == 2 else "all@ex.org" if k % 8 == 4 else ""
    rows = [(k, f"{prose(30)} {mark(k)} {prose(30)}") for k in range(60)]
    docs = [{m[0] for m in WORDS.finditer(t)} for _, t in rows]
    for generalise in (1.0, 2.0, 4.0):
        want = {}
        for k, t in rows:
            least = {}
            for e in (w for w in docs[k] if "@" in w):
                for w in docs[k]:
                    if "@" not in w:
                        n, c = sum(e in x and w in x for x in docs), sum(w in x for x in docs)
                        least[w] = min(least.get(w, 99.0), math.log2((c + pii.SMOOTH) / n))
            want[k] = [(m.start(), m.end(), round(least[m[0]], 9)) for m in WORDS.finditer(t) if least.get(m[0], 99.0) <= generalise]
        got = {r.doc_id: [(t["a"], t["b"], round(t["doubt"], 9)) for t in r.terms] for r in pii.find(frame(spark, rows), generalise=generalise).collect()}
        assert got == want and any(want.values())


def test_pii_of_odd_rows(spark):
    rows = [*corpus(), (80, None), (81, "mail a@b.cc " * 3000), (81, "mail a@b.cc " * 3000), (None, "+1 (017) 555-7713")]
    got = pii.find(frame(spark, rows)).collect()
    assert len(got) == len(rows) and sum(r.n_phone for r in got) == 1
    assert [r.n_email for r in got if r.doc_id == 81] == [3000, 3000]
    assert pii.find(empty(spark)).collect() == []


# language model


def test_lm_exact_columns_match_brute_force(spark):
    rows = corpus()
    scratch = Scratch(spark, "test")
    docs = frame(spark, rows)
    train = [(i, t) for i, t in rows if _share(i, lm_scores.FOLDS) != lm_scores.HELD_OUT]
    model, counts = lm_scores.train(frame(spark, train), scratch)
    tokens = lambda t: [*WORDS.findall((t or "").translate(LOWER)), None]
    c = Counter(w for _, t in train for w in tokens(t))
    n, v = sum(c.values()), len(c)
    assert (model.tokens, model.distinct) == (n, v)
    want = sorted((-1 if i is None else i, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t in rows)
    for hot in (lm_scores.HOT_WORDS, 40):
        if hot == 40:  # most words take the way of the join
            keep = np.argsort(-model.hot_counts)[:40]
            keep = keep[np.argsort(model.hot[keep])]
            model = lm_scores.Model(model.filter, model.hot[keep], model.hot_counts[keep], n, v)
        got = lm_scores.score(docs, model, counts, scratch).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
        assert all(r.score <= 0 for r in got)
    scratch.close()


def test_filter_returns_quantised_counts():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 2**63, 3000).astype(np.uint64)
    counts = rng.integers(1, 5000, 3000)
    import pyarrow as pa

    shift = np.uint64(64 - 6)
    blocks = {}
    for b in range(64):
        on = (keys >> shift) == b
        if on.any():
            x, y = keys[on], counts[on]
            packed = pa.table({"bucket": [b, b], "keys": [lm_scores._inner(x, shift).tobytes()] * 2, "counts": [np.minimum(y, 255).astype(np.uint8).tobytes(), (y - np.minimum(y, 255)).astype(np.int64).tobytes()]})
            blocks[b] = lm_scores._block(1 << 24)(packed)["block"][0].as_py()
    f = lm_scores.Filter.of(blocks, 64)
    got, want = f.counts(keys), lm_scores.count_of(lm_scores.levels(counts))
    assert (got >= want).all() and (got == want).mean() > 0.97
    other = rng.integers(0, 2**63, 5000).astype(np.uint64)
    assert (f.counts(other) > 0).mean() < 0.02


def test_lm_scores_match_brute_force_whatever_the_filter_holds(spark, monkeypatch):
    """Scores from quantised counts; once, a size limit of the filter made them wrong for larger corpora."""
    monkeypatch.setattr(lm_scores, "FILTER_BYTES", 2048, raising=False)
    monkeypatch.setattr(lm_scores, "UNIT_BYTES", 1000, raising=False)
    rng = random.Random(8)
    prose = lambda n: " ".join(f"w{min(int(rng.expovariate(0.02)), 600)}" for _ in range(n))
    rows = [(k, prose(rng.randint(1, 120))) for k in range(150)] + [(900, ""), (901, None), (902, "unseen words w1 w2")]
    train = rows[:100]
    tokens = lambda t: [*WORDS.findall(t or ""), "<end>"]
    c = Counter(x for _, t in train for x in ["<begin>", *tokens(t), *zip(["<begin>", *tokens(t)], tokens(t), strict=False)])
    total = sum(len(tokens(t)) for _, t in train) + len({w for _, t in train for w in tokens(t)}) + 1
    read = lambda x: float(lm_scores.count_of(lm_scores.levels(np.array([c[x]])))[0]) if c[x] else 0.0

    def want(t):
        out = 0.0
        for h, w in zip(["<begin>", *tokens(t)], tokens(t), strict=False):
            m = lm_scores.LAMBDA * read(h) / (read(h) + lm_scores.PRIOR)
            out += math.log10(m * min(read((h, w)) / max(read(h), 1), 1) + (1 - m) * (read(w) + 1) / total)
        return out

    scratch = Scratch(spark, "test")
    model, counts = lm_scores.train(frame(spark, train), scratch)
    got = {r.doc_id: r.score for r in lm_scores.score(frame(spark, rows), model, counts, scratch).collect()}
    assert len(got) == len(rows)
    off = [abs(got[k] - want(t)) / len(tokens(t)) for k, t in rows]
    assert sum(off) / len(off) < 0.0035  # a level is read too high by chance, once in 85
    scratch.close()


def test_lm_prefers_text_like_the_training_text(spark):
    rng = random.Random(2)
    pairs = [("red", "apple"), ("blue", "sky"), ("green", "field"), ("cold", "winter")]
    text = lambda n: " ".join(" ".join(rng.choice(pairs)) for _ in range(n))
    scratch = Scratch(spark, "test")
    model, counts = lm_scores.train(frame(spark, [(k, text(50)) for k in range(40)]), scratch)
    test = [(1, text(40)), (2, " ".join(rng.sample([w for p in pairs for w in p] * 10, 80)))]
    got = {r.doc_id: r for r in lm_scores.score(frame(spark, test), model, counts, scratch).collect()}
    assert got[1].score > got[1].base_score and got[1].score > got[2].score
    nothing, none = lm_scores.train(empty(spark), scratch)
    assert {(r.n_known, r.base_score) for r in lm_scores.score(frame(spark, test), nothing, none, scratch).collect()} == {(0, 0.0)}
    scratch.close()


# tokens


def test_token_counts_are_the_librarys(spark):
    from tokenizers import Tokenizer

    path = token_counts.tokenizer_path(token_counts.TOKENIZER)
    library = Tokenizer.from_file(path)
    rng = random.Random(9)
    rows = [*corpus(), (90, "a<|endoftext|>b <|endoftext|>"), (91, "it's I'LL  \n\n x\x1c\x85 ١٢ ½ 1\t\t2 "), (92, " lead"), (93, "trail \n"), (94, "࢏\U00011f04 ͸x")]
    rows += [(100 + k, "".join(rng.choice("ab' \n\t1,.é\xa0 's") for _ in range(60))) for k in range(200)]
    for hot in (token_counts.HOT_ENTRIES, 20):
        got = token_counts.token_counts(frame(spark, rows), path, hot_entries=hot)
        want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False))) for i, t in rows]
        assert collected(got) == sorted(want, key=repr)
    assert token_counts.token_counts(empty(spark), path).collect() == []


# sentence pieces


@pytest.fixture(scope="module")
def codec():
    return sentencepiece_codec.Codec(sentencepiece_codec.model_path())


def _texts():
    rng = random.Random(3)
    out = [t for _, t in corpus() if t is not None]
    out += ["", " ", "  x\n\n y\t\tz  ", "日本語 \U0001f600 \x00 x", "ab" * 3000, " " * 40 + "z", "<s> <0x0A>", "a▁b"]
    return out + ["".join(rng.choice("abcdethion  \n.,éß漢") for _ in range(rng.randint(1, 80))) for _ in range(300)]


def test_pieces_are_the_librarys_and_decode_to_the_text(codec):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.model_path())
    for t in _texts():
        ids = codec.encode(t)
        assert np.frombuffer(ids, "<i4").tolist() == library.encode(t)
        assert codec.decode(ids) == t.replace("▁", " ")


def test_texts_longer_than_a_slice(codec):
    """Over 2 MB in one text, with and without boundaries, beside short ones."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.model_path())
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choice("abcdethion") for _ in range(rng.randint(1, 9))) for _ in range(420_000)), "short", "", "".join(rng.choice("abcdethion漢") for _ in range(30_000))]
    offs, ids = codec.encode_all(pa.array(texts))
    assert len(texts[0]) > 2 << 20
    for k, t in enumerate(texts):
        assert ids[offs[k] : offs[k + 1]].tolist() == library.encode(t)


def test_search_holds_a_bounded_window(codec):
    """What is not committed yet stays within a few pieces, whatever the length; the pieces are those of a search from the end."""
    rng = random.Random(2)
    for text in ("x" * 5000, "ab" * 3000, "".join(rng.choice("abcdethion") for _ in range(8000)), "▁" * 300 + "z", "漢字" * 900):
        held = []
        assert "".join(codec.search(text, held)) == text
        assert max(held) <= 6 * codec.longest


def test_searches_alone_and_in_lockstep_agree(codec):
    rng = random.Random(5)
    words = list({"▁" + "".join(rng.choice("abcdethion.,é漢\U0001f600") for _ in range(rng.randint(1, 60))) for _ in range(400)})
    for own in (codec, sentencepiece_codec.Codec.of(_UNIGRAM, True)):
        assert own._many_ids(words) == [own._ids(w) for w in words]
    deep = sentencepiece_codec.Codec.of({"a": -3.0, "b": -3.1, "aa": -1.0, "ab": -1.5, "ba": -1.2}, True)
    far = [c + "a" * (90 + k) + d for c in "ab" for d in "ab" for k in range(20)]  # paths that differ by one up to the end
    assert deep._many_ids(far) == [deep._ids(w) for w in far]


_UNIGRAM = {"a": -2.0, "b": -2.1, "ab": -3.0, "ba": -3.3, "aba": -4.9, "bb": -3.9, "abab": -5.7}


def test_unigram_search_is_optimal():
    """Against all segmentations of short texts, with scores of a unigram model."""
    codec = sentencepiece_codec.Codec.of(_UNIGRAM, True)

    def best(t):
        return max((codec.score[t[:n]] + best(t[n:]) for n in range(1, len(t) + 1) if t[:n] in codec.score), default=float("-inf")) if t else 0.0

    rng = random.Random(1)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 22))) for _ in range(200)]
    names = list(codec.score)
    for t, ids in zip(texts, codec._many_ids(texts), strict=True):
        for pieces in (list(codec.search(t)), [names[i] for i in np.frombuffer(ids, np.int32)]):
            assert "".join(pieces) == t and abs(sum(codec.score[p] for p in pieces) - best(t)) < 1e-9


def test_neighbours_are_those_that_merging_gives_back(codec):
    rng = random.Random(4)
    pieces = [p for p in codec.made if len(p) < 6]
    for _ in range(20_000):
        a, b = rng.choice(pieces), rng.choice(pieces)
        assert codec._fit(a, b) == (codec.merged(a + b) == [a, b])


def test_codec_of_odd_rows(spark):
    rows = corpus()
    path = sentencepiece_codec.model_path()
    got = sentencepiece_codec.encode(frame(spark, rows), path)
    assert collected(sentencepiece_codec.decode(got, path)) == sorted(rows, key=repr)
    assert {(r.round_trip, r.ids is None) for r in got.collect()} == {(True, False), (None, True)}
    assert sentencepiece_codec.encode(empty(spark), path).collect() == []


# benchmark


def _edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        p = rng.randrange(len(out))
        kind = rng.choice("sid")
        if kind == "s":
            out[p] = rng.choice("abcdefgh thei")
        elif kind == "i":
            out.insert(p, rng.choice("abcdefgh thei"))
        else:
            del out[p]
    return "".join(out)


def _distance(item, text):
    """Least edit distance of item to a substring, by the plain recurrence."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_infix_distance_matches_the_plain_recurrence():
    rng = random.Random(7)
    for _ in range(200):
        item, text = ("".join(rng.choice("abc") for _ in range(rng.randint(a, b))) for a, b in ((1, 12), (0, 30)))
        assert decontaminate.infix_distance(item, decontaminate.masks_of(item), text, 99) == _distance(item, text)


def test_decontamination_recall_and_precision(spark):
    rng = random.Random(12)
    words = ["".join(rng.choice("aeiourstnl") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, prose(rng.randint(10, 40))) for k in range(30)]
    rows = []
    for k, t in items:
        for n in range(4):
            body = _edited(rng, t, int(len(t) * 0.1 * n / 3))
            rows.append((k * 10 + n, f"{prose(50)} {body.upper() if n == 1 else body} {prose(50)}"))
    rows += [(1000 + k, prose(120)) for k in range(60)]
    got = {r.doc_id: dict(zip(r.item_ids, r.distances, strict=True)) for r in decontaminate.matches(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    due = hit = 0
    for i, t in rows:
        text = decontaminate.normal(t)
        for k, item in items:
            item = decontaminate.normal(item)
            if i // 10 == k or k in got[i]:
                d = _distance(item, text)
                due += d <= decontaminate.allowed(len(item))
                hit += k in got[i]
                assert k not in got[i] or got[i][k] == d <= decontaminate.allowed(len(item))
    assert due >= 100 and hit >= 0.99 * due
    assert all(not got[1000 + k] for k in range(60))


def test_embedding_and_samples_find_windows_at_the_threshold():
    """The LSH alone, window against item: recall where the edits are as many as allowed, and what passes by chance."""
    rng = random.Random(21)
    words = ["".join(rng.choice("aeiourstnl") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [prose(rng.randint(8, 40)) for _ in range(200)]
    sizes = [len(t) for t in items]
    near = [(_edited(rng, t, decontaminate.allowed(len(t))) + prose(8))[: len(t)] for t in items]
    walks = decontaminate.Walks(max(sizes))
    own, other, chance = (walks.sketches(x, sizes) for x in (items, near, [prose(60) for _ in items]))
    passes = lambda x: (own == x).all(-1).any((1, 2)).mean()
    assert passes(other) >= 0.99 and passes(chance) <= 0.1


def test_short_items_are_found_exactly(spark):
    items = [(1, "zq"), (2, "seven ate"), (3, "a dozen grey doves"), (4, "thirty characters or so in one")]
    rows = [(1, "nothing here"), (2, "ZQ"), (3, "six  Seven\nate nine"), (4, "seven hate"), (5, "see a dozen gray doves fly"), (6, "see a dizen gray doves fly"), (7, "thirty charactrs or so on one x"), (8, "thirty characs or so on x")]
    got = {r.doc_id: r.item_ids for r in decontaminate.matches(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {i: [k for k, t in items if _distance(t, decontaminate.normal(x)) <= decontaminate.allowed(len(t))] for i, x in rows}
    assert got == want and want[2] == [1] and want[3] == [2] and want[5] == [3] and want[7] == [4] and not want[6]


def test_decontamination_of_odd_rows(spark):
    rows = corpus()
    long = next(t for i, t in rows if i == 20)
    items = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, long), (5, long), (None, long)], "item_id long, text string")
    df = frame(spark, rows)
    got = decontaminate.matches(df, items).collect()
    assert len(got) == len(rows)
    assert {tuple(r.item_ids) for r in got if r.doc_id == 20} == {(None, 4, 5)}
    kept = decontaminate.keep_clean(df, items)
    assert kept.columns == df.columns and kept.count() == sum(not r.item_ids for r in got)
    assert decontaminate.matches(empty(spark), items).collect() == []
    assert decontaminate.keep_clean(df, items.limit(0)).count() == len(rows)
