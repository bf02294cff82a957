from __future__ import annotations

import hashlib
import random

import numpy as np

from evalkit.llm import exact_dedup, jaccard_join, sharding, substring_dedup, textscan
from evalkit.llm.common import Scratch
from evalkit.llm.components import connected

from .odd import LOWER, WORDS, collected, corpus, empty, frame

LEAST = -(2**63)


def _key(i):
    return LEAST if i is None else i


def test_substring_dedup_matches_brute_force(spark):
    rows = corpus()
    docs = sorted({(i, t or "") for i, t in rows}, key=lambda r: (_key(r[0]), r[1]))
    # Rows that share a doc_id but not the text come in the order of a hash: give them ids of their own for the comparison.
    shared = {i for i in {r[0] for r in docs} if sum(r[0] == i for r in docs) > 1}
    rows = [r for r in rows if r[0] not in shared]
    seen, want = set(), {}
    for i, t in sorted({(i, t or "") for i, t in rows}, key=lambda r: _key(r[0])):
        w = WORDS.findall(t)
        gone = [False] * len(w)
        for j in range(len(w) - 19):
            if tuple(w[j : j + 20]) in seen:
                gone[j : j + 20] = [True] * 20
            seen.add(tuple(w[j : j + 20]))
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    got = substring_dedup.substring_dedup(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert all((r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id] for r in got)
    assert sum(w[1] for w in want.values()) > 500


def test_substring_dedup_of_shared_ids_and_empty_tables(spark):
    rows = corpus()
    got = substring_dedup.substring_dedup(frame(spark, rows)).collect()
    assert sorted((_key(r.doc_id), r.n_words) for r in got) == sorted((_key(i), len(WORDS.findall(t or ""))) for i, t in rows)
    assert substring_dedup.substring_dedup(empty(spark)).collect() == []


def test_substring_dedup_does_not_depend_on_batches(spark):
    df = frame(spark, corpus(8))
    assert collected(substring_dedup.substring_dedup(df, batches=1)) == collected(substring_dedup.substring_dedup(df, batches=4))


def _alternating(k):
    """Two different words of 2**k letters that a sum over powers cannot tell apart modulo 2**64."""
    a, b = "a", "b"
    for _ in range(k):
        a, b = a + b, b + a
    return a, b


def test_words_are_told_apart_by_their_bytes():
    for k in (1, 3, 6, 7, 10):
        a, b = _alternating(k)
        data = np.frombuffer(f"{a} {b} {a}".encode(), np.uint8)
        begin, end, _ = textscan.words(data, np.array([0, len(data)]))
        x, y, z = textscan.word_hashes(data, begin, end, 2).tolist()
        assert x == z and x[0] != y[0] and x[1] != y[1]
    data = np.frombuffer(b"\x00 \x00\x00 abcdefgh\x00 abcdefgh", np.uint8)
    assert len(set(textscan.word_hashes(data, *textscan.words(data, np.array([0, len(data)]))[:2]).tolist())) == 4


def test_alike_hashing_words_of_old_are_no_repeats_and_no_links(spark):
    a, b = _alternating(10)
    tail = " ".join(f"w{k}" for k in range(19))
    rows = [(1, f"{a} {tail}"), (2, f"{b} {tail}"), (3, f"{a} x y z"), (4, f"{b} x y z")]
    assert {r.n_removed for r in substring_dedup.substring_dedup(frame(spark, rows)).collect()} == {0}
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(frame(spark, rows[2:])).collect()}
    assert got == {3: 3, 4: 4}


def _brute(rows):
    """(n_words, n_removed, sha of what is left) by number, in the order of the numbers."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = WORDS.findall(t)
        gone = [False] * len(w)
        for j in range(len(w) - 19):
            if tuple(w[j : j + 20]) in seen:
                gone[j : j + 20] = [True] * 20
            seen.add(tuple(w[j : j + 20]))
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).digest())
    return out


def test_index_tells_each_batch_its_repeats_is_compacted_saved_and_opened(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(substring_dedup, "FANOUT", 2)
    rng = random.Random(11)
    prose = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    passages = [prose(45) for _ in range(6)]
    rows = [(k, " ".join([prose(rng.randint(0, 40)), *rng.sample(passages, rng.randint(0, 2)), prose(rng.randint(0, 30))])) for k in range(70)]
    rows += [(70, rows[3][1]), (71, rows[69][1]), (72, passages[0]), (73, "")]
    want, index = _brute(rows), substring_dedup.FingerprintIndex(spark, str(tmp_path / "index"))
    for k in range(5):
        part = rows[k * 15 : (k + 1) * 15]
        got = index.append(spark.createDataFrame(part, "num long, text string"))
        assert {r.num: (r.n_words, r.n_removed, bytes(r.sha)) for r in got.collect()} == {i: want[i] for i, _ in part}
        if k == 2:
            index.save()
            index.close()
            index = substring_dedup.FingerprintIndex.open(spark, str(tmp_path / "index"))
    assert [len(x) for x in index.anchors.levels] == [1, 0, 1]  # five runs: four are one of the third level
    assert sum(w[1] for w in want.values()) > 500
    index.close(files=True)


def test_many_copies_of_one_text_are_no_hot_task(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(k, text) for k in range(3000)] + [(5000 + k, "") for k in range(3000)]
    got = substring_dedup.substring_dedup(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(k, 60 * (k > 0)) for k in range(3000)] + [(5000 + k, 0) for k in range(3000)]


def test_texts_longer_than_a_slice(spark):
    """The slices of the scans are half a MB; these texts are longer."""
    rng = random.Random(4)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(120_000))
    tail = " ".join(long.split()[-2000:])
    rows = [(1, long), (2, f"some words before {tail}"), (3, "x" * 600_000 + " " + tail), (4, long)]
    assert len(long) > textscan.SLICE
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(frame(spark, rows)).collect()}
    assert got == {1: (120_000, 0), 2: (2003, 2000), 3: (2001, 2000), 4: (120_000, 120_000)}
    kept = {r.doc_id: r.kept for r in exact_dedup.exact_dedup(frame(spark, rows)).collect()}
    assert kept == {1: False, 2: True, 3: True, 4: True}
    assert {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(frame(spark, rows)).collect()} == {1: 1, 2: 2, 3: 2, 4: 1}


def test_exact_dedup_matches_brute_force(spark):
    rows = corpus()
    groups: dict[str, list] = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    for block in (7, 4096):
        got = exact_dedup.exact_dedup(frame(spark, rows), block=block).collect()
        want = []
        for t, ids in groups.items():
            known = [i for i in ids if i is not None]
            keep = max(known) if known else None
            want += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert exact_dedup.exact_dedup(empty(spark)).collect() == []


def test_one_row_of_a_large_group_stays(spark):
    rows = [(k, "Copied text") for k in range(2000)] + [(None, "no id")] * 300 + [(None, "NO ID"), (7, "alone"), (1999, "COPIED text")]
    got = sorted((r.doc_id is None, r.doc_id, r.text) for r in exact_dedup.keep_one(frame(spark, rows, 8)).collect())
    assert got == [(False, 7, "alone"), (False, 1999, "COPIED text"), (True, None, "NO ID")]


def test_exact_dedup_of_texts_that_share_their_first_block(spark):
    head = "h" * 64
    rows = [(k, f"{head}{k % 2500:06d}") for k in range(5000)] + [(9000, f"{head}000001"), (9000, f"{head.upper()}000001")]
    got = exact_dedup.exact_dedup(frame(spark, rows), block=16).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got if r.doc_id in (1, 2501, 9000, 7, 2507)} == {(1, 9000, 4, False), (2501, 9000, 4, False), (9000, 9000, 4, True), (7, 2507, 2, False), (2507, 2507, 2, True)}


def test_exact_dedup_survives_hash_collisions(spark, monkeypatch):
    rows = [(k, t) for k, t in enumerate(["abcdefgh", "abcdefgx", "abcdefgh", "", "zz", "abcdabcd", "ABCDABCD"])]
    scratch = Scratch(spark, "test")
    docs = frame(spark, rows)
    raw = docs.selectExpr("doc_id", "coalesce(text, '') AS text")
    # One hash for all blocks, as if they all collided.
    names = spark.createDataFrame([(1, k + 1, bytearray(b)) for k, b in enumerate([b"", b"abcd", b"efgh", b"efgx", b"zz"])], "h long, name long, block binary")
    numbered = [(k, k, bytearray(hashlib.sha256(t.lower().encode()).digest()), [1] * max(1, -(-len(t) // 4))) for k, t in rows]
    numbered = spark.createDataFrame(numbered, "row long, doc_id long, sha binary, hs array<long>")
    level = numbered.selectExpr("row", "size(hs) AS n", "posexplode(hs) AS (pos, h)")
    out = exact_dedup._by_content(raw, numbered, names, level, 4)
    found = {(r.row, r.pos): r.name for r in out.collect()}
    assert found == {(0, 0): 2, (0, 1): 3, (1, 0): 2, (1, 1): 4, (2, 0): 2, (2, 1): 3, (3, 0): 1, (4, 0): 5, (5, 0): 2, (5, 1): 2, (6, 0): 2, (6, 1): 2}
    scratch.close()


def _components(rows, size=4, percent=85):
    sets = {}
    for i, t in rows:
        w = WORDS.findall((t or "").translate(LOWER))
        sets[_key(i), t or ""] = frozenset(tuple(w[j : j + size]) for j in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    nodes = list(sets)
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a in range(len(nodes)):
        for b in range(a):
            x, y = sets[nodes[a]], sets[nodes[b]]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                lo, hi = sorted((root(nodes[a]), root(nodes[b])))
                parent[hi] = lo
    return {n: (len(sets[n]), min(m[0] for m in nodes if root(m) == root(n))) for n in nodes}


def test_jaccard_components_match_brute_force(spark):
    rows = corpus()
    want = _components(rows)
    got = jaccard_join.jaccard_components(frame(spark, rows)).collect()
    assert sorted((_key(r.doc_id), r.n_shingles, _key(r.component_id)) for r in got) == sorted((_key(i), *want[_key(i), t or ""]) for i, t in rows)
    assert jaccard_join.jaccard_components(empty(spark)).collect() == []


def test_jaccard_components_of_chains_and_families(spark):
    """Near copies of near copies, without a common centre: stars alone would not connect them."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    base = [rng.choice(words) for _ in range(100)]
    rows, text = [], list(base)
    for k in range(25):
        rows.append((k, " ".join(text)))
        text[(k * 7) % 100] = f"new{k}"
    for k in range(60):
        other = list(base)
        for _ in range(rng.randint(0, 3)):
            other[rng.randrange(100)] = f"edit{rng.randrange(40)}"
        rows.append((100 + k, " ".join(other)))
    want = _components(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(frame(spark, rows)).collect()}
    assert got == {i: v for (i, _), v in want.items()}
    assert len({c for _, c in got.values()}) > 1


def test_components_of_paths_stars_and_cycles(spark):
    path = [(k, k + 1) for k in range(30)]
    star = [(100, 101 + k) for k in range(40)]
    cycle = [(200 + k, 200 + (k + 1) % 9) for k in range(9)]
    got = {r.node: r.comp for r in connected(spark.createDataFrame(path + star + cycle, "a long, b long"), Scratch(spark, "test")).collect()}
    assert got == {**{k: 0 for k in range(31)}, **{100 + k: 100 for k in range(41)}, **{200 + k: 200 for k in range(9)}}


def test_shards_are_balanced_contiguous_and_gapless(spark):
    import zlib

    rows = corpus()
    for shards in (1, 7, 40):
        got = sharding.shard(frame(spark, rows), shards=shards).collect()
        assert sorted((_key(r.doc_id), r["size"], r.text_crc32) for r in got) == sorted((_key(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
        by = {}
        for r in got:
            by.setdefault(r.shard, []).append(r)
        total, largest = sum(r["size"] for r in got), max(r["size"] for r in got)
        assert all(0 <= s < shards for s in by)
        for part in by.values():
            assert sorted(r.slot for r in part) == list(range(len(part)))
            assert abs(sum(r["size"] for r in part) - total / shards) <= largest
        order = sorted(got, key=lambda r: r.byte_start)
        assert [r.shard for r in order] == sorted(r.shard for r in got)
        assert [_key(r.doc_id) for r in order] == sorted(_key(r.doc_id) for r in got)
    assert sharding.shard(empty(spark)).collect() == []
