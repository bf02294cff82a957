"""Operator 5: SentencePiece encoding and decoding by streaming Viterbi.

The lattice of a text has an edge for each vocabulary piece (or lone unknown character)
between two character positions. For a unigram model an edge weighs the piece's score.
For a BPE model, whose scores are merge ranks and not log-probabilities, the weight is a
hard constraint on neighbouring edges instead: 0 if merging the two pieces' characters
gives back exactly these two pieces, minus infinity otherwise. A piece sequence is the BPE
encoding of a text if and only if all its neighbours satisfy this, so each prefix has one
best last piece and the search gives the library's own ids.

The search streams, over texts of any length alike. A window holds the last ``longest``
positions, the only ones at which a further piece can begin; each has its best path. A
position that leaves the window without a path through it is dropped, with what only it
led to. As soon as all paths that survive go through one boundary, the ids up to it are
committed and forgotten. What is held is the window and the paths that still differ.

Where no piece of the vocabulary can cross a boundary (before a space that follows
something else, around a line feed) all paths meet at once, so a text is searched stretch
by stretch. Stretches repeat: each distinct one of a slice of rows is searched once, and a
worker remembers a bounded number of short ones. Many stretches are searched in lockstep,
position by position in arrays; when only a few longer ones are left, these are searched
one by one. Both ways are the same search, with the same window and the same commits.

Decoding looks up each id's bytes; the query decodes the ids that it returns.

Defined cases. Null stays null ids and null text; an empty text has no ids; U+2581 in a
text is encoded as the library does, as a space, so that it alone does not survive the
round trip; characters outside the vocabulary become byte pieces. Repeated rows and null
doc_ids are rows as any other. Models that normalise texts, and types other than unigram
and BPE, are refused.
"""

from __future__ import annotations

import functools
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .textscan import slices, text_buffer

MODEL = "piece_bpe_32k.model"
#: Stretches whose ids a worker keeps, in each of two generations, and the characters that one may have.
KEPT, SHORT = 120_000, 64
#: Pairs of pieces of which a worker remembers whether they may be neighbours.
FITS = 400_000
#: Bytes of text that are encoded together; a longer text is a slice of its own.
TOGETHER = 2 << 20
#: Stretches that are searched in lockstep, at most and at least.
LOCKSTEP, FEW = 1 << 15, 32
#: Positions between commits that a lockstep search has room for; a stretch whose paths meet later is searched alone.
SPAN = 64
_MARK = "▁"
_NEVER = 1 << 40
#: Values of the model file's format: model types, and fields of its messages.
_UNIGRAM, _BPE = 1, 2
_TRAINER, _NORMALIZER, _TYPE, _CHARSMAP, _DUMMY_PREFIX, _EXTRA_SPACES = 2, 3, 3, 2, 3, 4


def _fields(message: bytes) -> dict[int, int | bytes]:
    """The last value of each field of a protocol-buffer message."""
    at, out = 0, {}

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = number()
        kind = key & 7
        if kind == 0:
            out[key >> 3] = number()
        else:
            size = number() if kind == 2 else 8 if kind == 1 else 4
            out[key >> 3] = message[at : at + size]
            at += size
    return out


class _Table:
    """A hash table of whole arrays: positive 64-bit keys, 32-bit values."""

    def __init__(self, most: int):
        bits = max(8, (2 * most).bit_length())
        self.shift, self.last, self.room, self.n = np.uint64(64 - bits), (1 << bits) - 1, most, 0
        self.keys, self.values = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The keys' values; -1 where there is none."""
        slot = self._slots(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], np.int32(-1))
        left = np.flatnonzero((there != keys) & (there != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & self.last
            there = self.keys[slot[left]]
            hit = there == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (there != 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds distinct keys that are not there; all others go if there is no room."""
        if self.n + len(keys) > self.room:
            self.keys[:], self.n = 0, 0
            keys, values = keys[: self.room], values[: self.room]
        self.n += len(keys)
        slot, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            self.keys[slot[free]] = keys[free]
            done = free[self.keys[slot[free]] == keys[free]]
            self.values[slot[done]] = values[done]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & self.last


class Codec:
    """encode() and decode() for the pieces of a SentencePiece model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = _fields(sp.serialized_model_proto())
        trainer, normalizer = (_fields(spec.get(k, b"")) for k in (_TRAINER, _NORMALIZER))
        kind = trainer.get(_TYPE, _UNIGRAM)
        if kind not in (_UNIGRAM, _BPE) or normalizer.get(_CHARSMAP) or normalizer.get(_EXTRA_SPACES, 1):
            raise ValueError("only unigram and BPE models that leave texts as they are")
        byte, ids, score, shown = {}, {}, {}, []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte[int(piece[3:5], 16)] = i
                shown.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                shown.append(b"")
            else:
                ids[piece] = i
                score[piece] = sp.get_score(i)
                shown.append(piece.replace(_MARK, " ").encode())
        self._prepare(ids, score, kind == _UNIGRAM, bool(normalizer.get(_DUMMY_PREFIX, 1)), byte, sp.unk_id(), shown)

    @classmethod
    def of(cls, score: dict[str, float], unigram: bool) -> Codec:
        """A codec of pieces numbered in the order given, without prefix or byte pieces."""
        out = cls.__new__(cls)
        out._prepare({p: k for k, p in enumerate(score)}, dict(score), unigram, False, {}, len(score), [p.replace(_MARK, " ").encode() for p in score] + [b""])
        return out

    def _prepare(self, ids: dict[str, int], score: dict[str, float], unigram: bool, prefix: bool, byte: dict[int, int], unk: int, shown: list[bytes]) -> None:
        import ahocorasick

        self.ids, self.score, self.unigram, self.prefix, self.byte, self.unk = ids, score, unigram, prefix, byte, unk
        self.shown = pa.array(shown, pa.binary())
        self.longest = max(map(len, ids))
        self.unknown = min(score.values()) - 10.0
        #: A piece's place in the order of merging; equal scores are equal places.
        places = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank = {p: places[s] for p, s in score.items()}
        #: Of each piece that merging can bring about: the places of its merges in their order, and the first and last symbol after each.
        self.made: dict[str, tuple[list[int], list[str], list[str]]] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        #: Finds all pieces that end at a position, longest first.
        self.automaton = ahocorasick.Automaton()
        for p in ids:
            if unigram or self._made(p) is not None:
                self.automaton.add_word(p, (len(p), p))
        self.automaton.make_automaton()
        held = set("".join(ids))
        self._number(held)
        #: Bytes that are stretches of their own, and whether a space that follows something else begins a stretch.
        self.alone = [ord(c) for c in "\n\t\r" if c not in held]
        self.cut = all(_MARK not in p.lstrip(_MARK) for p in ids)
        self.kept: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _merging(self, text: str) -> tuple[list[str], list[int], list[str], list[str]]:
        """The BPE pieces of a text, by merging the best pair (the leftmost of equals) again and again; with each merge's place and the first and last symbol after it."""
        parts, rank = list(text), self.rank
        gain = [rank.get(a + b, _NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        order, first, last = [], [parts[0]], [parts[-1]]
        while gain:
            best = min(gain)
            if best == _NEVER:
                break
            k = gain.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del gain[k]
            if k:
                gain[k - 1] = rank.get(parts[k - 1] + parts[k], _NEVER)
            if k < len(gain):
                gain[k] = rank.get(parts[k] + parts[k + 1], _NEVER)
            order.append(best)
            first.append(parts[0])
            last.append(parts[-1])
        return parts, [*order, _NEVER], first, last

    def merged(self, text: str) -> list[str]:
        return self._merging(text)[0]

    def _made(self, piece: str) -> tuple[list[int], list[str], list[str]] | None:
        found = self.made.get(piece)
        if found is None:
            parts, *found = self._merging(piece)
            if len(parts) > 1:
                return None
            self.made[piece] = found = tuple(found)
        return found

    def _fit(self, a: str, b: str) -> bool:
        """Whether merging a + b gives back a and b: no pair across the boundary is ever the best one.

        The merges inside a and inside b do not depend on each other; the better next one
        comes first, a's if they are equal, and a pair across is left of all of b's.
        """
        (x, _, last), (y, first, _) = self._made(a), self._made(b)
        i = j = 0
        rank, ok = self.rank, True
        while True:
            across = rank.get(last[i] + first[j], _NEVER)
            if x[i] <= y[j]:
                if across < x[i]:
                    ok = False
                    break
                if x[i] == _NEVER:
                    break
                i += 1
            else:
                if across <= y[j]:
                    ok = False
                    break
                j += 1
        return ok

    def byte_ids(self, char: str) -> list[int]:
        return [self.byte[x] for x in char.encode()] if self.byte else [self.unk]

    def _edges(self, text: str) -> Iterator[tuple[int, list[str]]]:
        """Each position with the pieces that end there, longest first; a character outside the vocabulary is an edge of its own."""
        at, here = 1, []
        for end, (_, piece) in self.automaton.iter(text):
            while at <= end:
                yield at, here or [text[at - 1]]
                at, here = at + 1, []
            here.append(piece)
        while at <= len(text):
            yield at, here or [text[at - 1]]
            at, here = at + 1, []

    def search(self, text: str, watch: list | None = None) -> Iterator[str]:
        """Streaming Viterbi over a text in which spaces are marks: yields its pieces as they are committed.

        A node is [piece, node before, paths that go on from it, in the window, value].
        ``watch`` gets the number of positions between the last commit and each position.
        """
        fits, fit, unigram, score = self.fits, self._fit, self.unigram, self.score
        most = self.longest
        ring: list = [None] * (most + 1)
        root = ring[0] = ["", None, 0, True, 0.0]
        done = 0
        for i, pieces in self._edges(text):
            value, best, before = 0.0, None, None
            for piece in pieces:
                node = ring[(i - len(piece)) % (most + 1)]
                if unigram:
                    v = node[4] + score.get(piece, self.unknown)
                    if best is None or v > value:
                        value, best, before = v, piece, node
                else:
                    last = node[0]
                    if last:
                        ok = fits.get((last, piece))
                        if ok is None:
                            if len(fits) >= FITS:
                                fits.clear()
                            ok = fits[last, piece] = fit(last, piece)
                        if not ok:
                            continue
                    best, before = piece, node
                    break
            if best is None:
                # Only a character's own edge is left: always a path, as merging has one result.
                best = text[i - 1]
                before = ring[(i - 1) % (most + 1)]
                value = before[4] + self.unknown
            before[2] += 1
            if i >= most:
                # The position that leaves the window; a path that ends there ends for good.
                gone = ring[(i - most) % (most + 1)]
                gone[3] = False
                node = gone
                while node is not root and not node[2] and not node[3]:
                    node = node[1]
                    node[2] -= 1
            ring[i % (most + 1)] = node = [best, before, 0, True, value]
            if not root[3] and root[2] == 1:
                path = []
                while node is not root:
                    path.append(node)
                    node = node[1]
                while not root[3] and root[2] == 1:
                    root = path.pop()
                    done += len(root[0])
                    yield root[0]
                root[1] = None
            if watch is not None:
                watch.append(i - done)
        path, node = [], ring[len(text) % (most + 1)]
        while node is not root:
            path.append(node[0])
            node = node[1]
        yield from reversed(path)

    def _number(self, held: set[str]) -> None:
        """Numbers for pieces and held characters, and a trie of the pieces read backwards, for the lockstep search."""
        pieces = [p for p in self.ids if self.unigram or p in self.made]
        self.names = [*pieces, *sorted(held - set(pieces))]
        #: Two more numbers: the beginning of a stretch, and a character of no piece.
        self.start, self.other = len(self.names), len(self.names) + 1
        self.id_of = np.array([*(self.ids.get(p, -1) for p in self.names), -1, -1], np.int32)
        self.value_of = np.array([*(self.score.get(p, self.unknown) for p in self.names), 0.0, self.unknown])
        chars = sorted(held)
        self.kind = np.zeros(0x110000, np.int32)  # of a code point; 0: of no piece
        self.kind[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        number = {p: k for k, p in enumerate(self.names)}
        self.lone = np.array([self.other, *(number[c] for c in chars)], np.int32)
        kinds, nodes, ends = {c: k + 1 for k, c in enumerate(chars)}, {}, [-1]
        for k, p in enumerate(pieces):
            node = 0
            for c in reversed(p):
                key = (node << 21) + kinds[c]
                node = nodes.get(key)
                if node is None:
                    node = nodes[key] = len(ends)
                    ends.append(-1)
            ends[node] = k
        self.trie, self.ends = _Table(len(nodes) + 1), np.array(ends, np.int32)
        self.trie.put(np.fromiter(nodes.keys(), np.int64, len(nodes)), np.fromiter(nodes.values(), np.int32, len(nodes)))
        self.pairs = _Table(FITS)

    def _fit_all(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """_fit for pairs of numbers."""
        keys = (a.astype(np.int64) << 24) + b + 1
        ok = self.pairs.get(keys)
        ok[(a >= self.start) | (b >= self.start)] = 1
        if (ok < 0).any():
            new = np.unique(keys[ok < 0])
            names = self.names
            fit = np.array([self._fit(names[(k - 1) >> 24], names[(k - 1) & 0xFFFFFF]) for k in new.tolist()], np.int32)
            missing = np.flatnonzero(ok < 0)
            ok[missing] = fit[np.searchsorted(new, keys[missing])]
            self.pairs.put(new, fit)
        return ok > 0

    def _lockstep(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The search over stretches, longest first, at once: (offsets, numbers) of their pieces, and which stretches it could not finish."""
        size = np.array(list(map(len, stretches)), np.int64)
        codes = np.frombuffer("".join(stretches).encode("utf-32-le", "surrogatepass"), np.uint32)
        kind, first = self.kind[codes], np.cumsum(size) - size
        rows, most, room = len(size), self.longest, SPAN
        number, length = np.full((room, rows), self.start, np.int32), np.zeros((room, rows), np.int8)
        masks, values = np.zeros((most + 1, rows), np.uint64), np.zeros((most + 1, rows))
        masks[0] = 1  # bit k: the path goes through the boundary k positions back
        done, lost = np.zeros(rows, np.int64), np.zeros(rows, bool)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def commit(row: np.ndarray, to: np.ndarray) -> None:
            begin, at = done[row], to.copy()
            done[row] = to
            while len(row):
                n = length[at % room, row]
                out.append((row, at, number[at % room, row]))
                at = at - n
                go = at > begin
                row, at, begin = row[go], at[go], begin[go]

        alive = rows
        for i in range(1, int(size[0]) + 1):
            alive = int(np.searchsorted(-size, -i, side="right"))
            row, node, found = np.arange(alive), np.zeros(alive, np.int64), []
            for n in range(1, min(i, most) + 1):
                node = self.trie.get((node << 21) + kind[first[row] + (i - n)]).astype(np.int64)
                go = node > 0
                if not go.all():
                    row, node = row[go], node[go]
                    if not len(row):
                        break
                piece = self.ends[node]
                has = piece >= 0
                found.append((n, row[has], piece[has]))
            best, long = self.lone[kind[first[:alive] + (i - 1)]], np.ones(alive, np.int8)
            if self.unigram:
                value = values[(i - 1) % (most + 1), :alive] + self.unknown
                value[best < self.start] = -np.inf
                value = np.where(self.id_of[best] < 0, values[(i - 1) % (most + 1), :alive] + self.unknown, value)
                for n, row, piece in found:
                    v = values[(i - n) % (most + 1), row] + self.value_of[piece]
                    up = v >= value[row]
                    row, piece = row[up], piece[up]
                    value[row], best[row], long[row] = v[up], piece, n
                values[i % (most + 1), :alive] = value
            else:
                free = np.ones(alive, bool)
                for n, row, piece in reversed(found):
                    go = free[row]
                    row, piece = row[go], piece[go]
                    ok = self._fit_all(number[(i - n) % room, row] if i > n else np.full(len(row), self.start, np.int32), piece)
                    row, piece = row[ok], piece[ok]
                    free[row], best[row], long[row] = False, piece, n
            number[i % room, :alive], length[i % room, :alive] = best, long
            back = masks[(i - long) % (most + 1), np.arange(alive)]
            masks[i % (most + 1), :alive] = (back << long.astype(np.uint64)) | np.uint64(1)
            if i >= most:
                # The boundaries that the paths of all positions in the window share.
                all_ = np.full(alive, ~np.uint64(0))
                for k in range(most):
                    all_ &= masks[(i - k) % (most + 1), :alive] << np.uint64(k)
                far = np.where(all_ > 0, i - np.log2((all_ & -all_.astype(np.int64).view(np.uint64)).astype(np.float64) + (all_ == 0)).astype(np.int64), 0)
                row = np.flatnonzero(far > done[:alive])
                if len(row):
                    commit(row, far[row])
                lost[:alive] |= i - done[:alive] >= room - 1
                done[:alive][lost[:alive]] = i
            over = int(np.searchsorted(-size, -i - 1, side="right"))
            if over < alive:
                row = np.arange(over, alive)
                row = row[done[row] < i]
                commit(row, np.full(len(row), i))
        none = np.zeros(0, np.int64)
        row, at, piece = (np.concatenate(x) for x in zip((none, none, none), *out, strict=True))
        order = np.lexsort((at, row))
        return np.searchsorted(row[order], np.arange(rows + 1)), piece[order].astype(np.int32), lost

    def _many_ids(self, stretches: list[str]) -> list[bytes]:
        """The ids of distinct stretches: in lockstep as long as there are FEW of a length."""
        order = sorted(range(len(stretches)), key=lambda k: -len(stretches[k]))
        out: list[bytes] = [b""] * len(stretches)
        limit = len(stretches[order[FEW - 1]]) if len(order) >= FEW else 0
        alone = 0
        while alone < len(order) and len(stretches[order[alone]]) > limit:
            out[order[alone]] = self._ids(stretches[order[alone]])
            alone += 1
        for a in range(alone, len(order), LOCKSTEP):
            some = order[a : a + LOCKSTEP]
            offs, numbers, lost = self._lockstep([stretches[k] for k in some])
            ids = self.id_of[numbers]
            odd = lost.copy()  # with characters that have no id of their own
            np.logical_or.at(odd, np.searchsorted(offs, np.flatnonzero(ids < 0), side="right") - 1, True)
            raw = ids.tobytes()
            for k, x, y, o in zip(some, (offs[:-1] * 4).tolist(), (offs[1:] * 4).tolist(), odd.tolist(), strict=True):
                out[k] = self._ids(stretches[k]) if o else raw[x:y]
        return out

    def _ids(self, stretch: str) -> bytes:
        ids, out = self.ids, []
        for p in self.search(stretch):
            i = ids.get(p)
            if i is not None:
                out.append(i)
            else:
                out.extend(self.byte_ids(p))
        return array("i", out).tobytes()

    def _all_ids(self, stretches: list[str]) -> list[bytes]:
        """The ids of distinct stretches, as 32-bit integers."""
        kept, old = self.kept, self.old
        out = [kept.get(s) or old.get(s) for s in stretches]
        new = [k for k, ids in enumerate(out) if ids is None]
        if new:
            for k, ids in zip(new, self._many_ids([stretches[k].replace(" ", _MARK) for k in new]), strict=True):
                out[k] = ids
        if len(kept) + len(stretches) > KEPT:
            # What is used again moves to the young generation; the rest goes with the old.
            self.old, self.kept = kept, {}
        self.kept.update((s, ids) for s, ids in zip(stretches, out, strict=True) if len(s) <= SHORT)
        return out

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): the ids of a slice of texts without nulls, one after the other."""
        texts = texts.cast(pa.large_string())
        if pc.any(pc.match_substring(texts, _MARK)).as_py():
            texts = pc.replace_substring(texts, _MARK, " ")
        if self.prefix:  # an empty text has no prefix either
            texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
        data, bounds = text_buffer(texts)
        data = data[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        begin = np.zeros(len(data) + 1, bool)
        begin[bounds] = True
        if self.cut:
            space = data == 0x20
            begin[1:-1] |= space[1:] & ~space[:-1]
        for c in self.alone:
            lone = data == c
            begin[:-1] |= lone
            begin[1:] |= lone
        begin[-1] = False
        at = np.flatnonzero(begin)
        ends = pa.py_buffer(np.append(at, len(data)).astype(np.int64))
        named = pa.LargeStringArray.from_buffers(len(at), ends, pa.py_buffer(data)).dictionary_encode()
        found = self._all_ids(named.dictionary.to_pylist())
        size = np.array([len(x) >> 2 for x in found], np.int64)
        flat, place = np.frombuffer(b"".join(found), np.int32), np.cumsum(size) - size
        which = np.asarray(named.indices)
        count = size[which]
        total = np.concatenate([[0], np.cumsum(count)])
        ids = flat[np.repeat(place[which] - total[:-1], count) + np.arange(int(total[-1]))]
        return total[np.searchsorted(at, bounds)], ids

    def raw(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) that ids stand for."""
        return text_buffer(self.shown.take(pa.array(ids)).cast(pa.large_binary()))

    def text_of(self, raw: bytes) -> bytes:
        """The UTF-8 text of the bytes of a text's ids."""
        raw = raw[1:] if self.prefix and raw[:1] == b" " else raw
        return raw.decode("utf-8", "replace").encode()

    def encode(self, text: str) -> bytes:
        """The ids of a text, as 32-bit integers."""
        return self.encode_all(pa.array([text]))[1].tobytes()

    def decode(self, ids: bytes) -> str:
        data, _ = self.raw(np.frombuffer(ids, np.int32))
        return self.text_of(data.tobytes()).decode()


@functools.cache
def codec(model: str) -> Codec:
    """A worker's codec, which keeps its tables from task to task; a public model's name, or a path that workers can read."""
    return Codec(model if "/" in model else model_path(model))


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """One row per row of docs: doc_id, ids (array<int>), n_bytes, decoded_sha256, round_trip."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for s in slices(batches, most=TOGETHER):
            texts = s.rows.column("text")
            null = np.asarray(texts.is_null())
            starts, ids = own.encode_all(texts.fill_null(""))
            data, offs = own.raw(ids)
            raw, edges, source = data.tobytes(), offs[starts].tolist(), s.data.tobytes()
            bounds, skip = s.bounds.tolist(), int(own.prefix)
            sha, same = [], []
            for k, no in enumerate(null.tolist()):
                text, back = source[bounds[k] : bounds[k + 1]], raw[edges[k] + skip : edges[k + 1]]
                equal = back == text and (not skip or not text or raw[edges[k]] == 0x20)
                if not equal:
                    back = own.text_of(raw[edges[k] : edges[k + 1]])
                sha.append(None if no else hashlib.sha256(back).hexdigest())
                same.append(None if no else back == text)
            lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids), mask=pa.array(null))
            yield pa.record_batch(
                [s.rows.column("doc_id"), lists, pa.array(np.diff(s.bounds), mask=null), pa.array(sha, pa.string()), pa.array(same, pa.bool_())],
                ["doc_id", "ids", "n_bytes", "decoded_sha256", "round_trip"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, n_bytes long, decoded_sha256 string, round_trip boolean")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text from doc_id and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            texts = [None if x.as_py() is None else own.decode(np.array(x.as_py(), np.int32).tobytes()) for x in batch.column("ids")]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, and the digest of the text that they decode to."""
    return encode(documents(spark, sf_dir)).select("doc_id", F.size("ids").alias("n_tokens"), "n_bytes", "ids", "decoded_sha256", "round_trip")


#: Tested against the library's ids, brute force and exact round trips.
SQL = None
