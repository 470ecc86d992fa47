"""SentencePiece encoding and decoding by a batched numpy Viterbi.

The words of a batch are grouped by length; the words of one length advance
together, one position at a time. Hashes of all substrings up to the longest
piece probe the sorted hashes of the pieces, and the lattice keeps one best way
into each position with a backpointer.

* ``unigram`` models: the score of a way is the sum of its pieces' scores, and
  the vectorised maximum picks the last piece.
* ``bpe`` models merge by score instead of adding scores. Their result is the
  only way whose neighbouring pieces never merge across their border, so a
  transition counts 0 if the two pieces may stand side by side and minus
  infinity if not; the maximum over the last piece is again the Viterbi step.
  Whether two pieces may stand side by side is read from their merge trees:
  walking both borders back in merge order, no pair of symbols that touch may
  form a piece that would have been merged first.

Spaces become U+2581, one is put in front, nothing else is normalised (models
that are not of this kind are refused). Runs of spaces merge last, from the
left. Characters without a piece become byte pieces. Decoding is exact except
that a U+2581 in the text comes back as a space.

Null text: null ids, decoded to null. Empty text: no ids, decoded to an empty
text. A text is never cut; the memory of a task is a batch of texts, the model
and a bounded cache of words. Extra columns are ignored unless carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15)
NONE = np.int64(1) << 62
#: Words whose encoding a task remembers, and characters encoded at once.
CACHE_WORDS = 700_000
CHUNK_CHARS = 2_000_000


def _mix(codes: np.ndarray) -> np.ndarray:
    x = codes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _mix_pair(key: np.ndarray) -> np.ndarray:
    """One to one on 64 bits, so equal values are equal pairs."""
    return key.astype(np.uint64) * BASE


def _text_hash(s: str) -> np.uint64:
    h = np.ones(1, np.uint64)
    for c in _mix(np.frombuffer(s.encode("utf-32-le"), "<u4")):
        h = h * BASE + c
    return h[0]


class Probe:
    """Sorted keys with the place where each leading-bits bucket begins."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, bits: int = 20):
        at = np.argsort(keys)
        self.keys, self.values, self.shift = keys[at], values[at], np.uint64(64 - bits)
        self.begin = np.searchsorted(self.keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64))

    def get(self, wanted: np.ndarray, missing: int) -> np.ndarray:
        out = np.full(wanted.shape, missing, np.int64)
        flat, res = wanted.reshape(-1), out.reshape(-1)
        bucket = (flat >> self.shift).astype(np.int64)
        at, end = self.begin[bucket], self.begin[bucket + 1]
        left = np.flatnonzero(at < end)
        at, end, key = at[left], end[left], flat[left]
        while len(left):
            hit = self.keys[at] == key
            res[left[hit]] = self.values[at[hit]]
            at = at + 1
            go = ~hit & (at < end)
            left, at, end, key = left[go], at[go], end[go], key[go]
        return out


def _gather(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The values of flat in the spans (begin, size), one after the other."""
    to = np.cumsum(size)
    return flat[np.arange(to[-1] if len(to) else 0) + np.repeat(begin - to + size, size)]


@dataclass
class Model:
    """Arrays of a model, small enough to broadcast (tens of bytes a piece)."""

    pieces: list[str]
    scores: np.ndarray
    kinds: np.ndarray  # 0 normal, 1 control or unknown, 2 byte
    bpe: bool
    unk: int = 0
    longest: int = field(init=False)

    def __post_init__(self):
        normal = [i for i, k in enumerate(self.kinds) if k == 0]
        self.index = {self.pieces[i]: i for i in normal}
        mixed = [p for p in self.index if SPACE in p[1:] and p.strip(SPACE)]
        if mixed:
            raise ValueError(f"pieces with spaces after their start aren't supported: {mixed[:3]}")
        self.bytes = np.full(256, self.unk)
        for i, k in enumerate(self.kinds):
            if k == 2:
                self.bytes[int(self.pieces[i][3:5], 16)] = i
        self.raw = [bytes([int(p[3:5], 16)]) if k == 2 else b"" if k == 1 else p.replace(SPACE, " ").encode()
                    for p, k in zip(self.pieces, self.kinds)]
        if self.bpe:
            self._trees()
        usable = [i for i in normal if self.pieces[i] == SPACE or self.pieces[i].strip(SPACE) and (not self.bpe or self.whole[i])]
        hashes = np.array([_text_hash(self.pieces[i]) for i in usable], np.uint64)
        self.probe = Probe(hashes, np.array(usable, np.int64))
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two pieces have one hash")
        self.raw_flat = np.frombuffer(b"".join(self.raw), np.uint8)
        self.raw_size = np.array(list(map(len, self.raw)), np.int64)
        self.raw_begin = np.cumsum(self.raw_size) - self.raw_size
        self.longest = max(len(self.pieces[i]) for i in usable)

    # -- merge trees of BPE pieces
    def _merge(self, s: str) -> list[tuple[str, int, int, int]]:
        """Symbols left after merging s: (text, last left id, last right id, time)."""
        sym = [(c, -1, -1, -1) for c in s]
        while True:
            best = None
            for i in range(len(sym) - 1):
                j = self.index.get(sym[i][0] + sym[i + 1][0])
                if j is not None and (best is None or self.scores[j] > best[0]):
                    best = (self.scores[j], i, j)
            if best is None:
                return sym
            _, i, j = best
            sym[i:i + 2] = [(sym[i][0] + sym[i + 1][0], self.index.get(sym[i][0], -1), self.index.get(sym[i + 1][0], -1), j)]

    def _trees(self) -> None:
        n = len(self.pieces)
        self.left, self.right = np.full(n, -1), np.full(n, -1)
        self.whole = np.zeros(n, bool)
        order = np.unique(-self.scores, return_inverse=True)[1].astype(np.int64)
        self.rank = order
        self.birth = np.full(n + 1, -1, np.int64)  # characters, and at n an unknown one, are there from the start
        pairs, ranks = [], []
        for p, i in self.index.items():
            if not p.strip(SPACE) and len(p) > 1:
                continue
            for c in range(1, len(p)):
                a, b = self.index.get(p[:c]), self.index.get(p[c:])
                if a is not None and b is not None:
                    pairs.append(a * (n + 1) + b)
                    ranks.append(order[i])
            if len(p) == 1:
                self.whole[i] = True
                continue
            if any(c not in self.index for c in p):
                raise ValueError(f"a character of {p!r} is no piece")
            end = self._merge(p)
            if len(end) == 1:
                self.whole[i], self.left[i], self.right[i], self.birth[i] = True, end[0][1], end[0][2], order[i]
        late = [i for i in np.flatnonzero(self.whole) if self.left[i] >= 0 and max(self.birth[self.left[i]], self.birth[self.right[i]]) >= self.birth[i]]
        if late:
            raise ValueError(f"pieces that score above their parts aren't supported: {[self.pieces[i] for i in late[:3]]}")
        self.pairs = Probe(_mix_pair(np.array(pairs, np.int64)), np.array(ranks, np.int64))

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the pieces a and b, side by side, stay as they are. -1: the start."""
        n = len(self.pieces)
        ok = np.ones(len(a), bool)
        live = np.flatnonzero((a >= 0) & (a < n) & (b < n))
        x, y = a[live], b[live]
        dx, dy = np.full(len(live), NONE), np.full(len(live), NONE)
        while len(live):
            rank = self.pairs.get(_mix_pair(x * (n + 1) + y), NONE)
            bad = (rank < dx) & (rank <= dy) & (rank < NONE)
            ok[live[bad]] = False
            bx, by = self.birth[x], self.birth[y]
            go = ~bad & ((bx >= 0) | (by >= 0))
            live, x, y, dx, dy, bx, by = (v[go] for v in (live, x, y, dx, dy, bx, by))
            down = bx > by
            dx, dy = np.where(down, bx, dx), np.where(down, dy, by)
            x, y = np.where(down, self.right[x], x), np.where(down, y, self.left[y])
        return ok

    # -- the lattice
    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words one after the other, how many each has, and where an
        id stands for an unknown character, its code point plus one (else 0). All words
        have the same length."""
        n, v, many = len(words[0]), len(self.pieces), len(words)
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(many, n)
        mixed = _mix(codes)
        h = np.ones((many, n), np.uint64)  # not 0, so that the length counts
        parts = []
        for k in range(min(self.longest, n)):
            h = h[:, :n - k] * BASE + mixed[:, k:]
            found = self.probe.get(h, -1 if k else v)
            w, start = np.nonzero(found >= 0)
            parts.append((w, start, np.full(len(w), k + 1), found[w, start]))
        w, start, size, piece = (np.concatenate(x) for x in zip(*parts))
        end = start + size
        at = np.argsort(end, kind="stable")
        w, start, size, piece = w[at], start[at], size[at], piece[at]
        edge = np.searchsorted(end[at], np.arange(1, n + 2))
        last = np.full((many, n + 1), -2, np.int64)  # -2: no way leads here, -1: the start
        last[:, 0] = -1
        back = np.zeros((many, n + 1), np.int64)
        best = np.zeros((many, n + 1))
        worth = np.append(self.scores, self.scores.min() - 10.0)
        for i in range(1, n + 1):
            span = slice(edge[i - 1], edge[i])
            wi, si, zi, pi = w[span], start[span], size[span], piece[span]
            prev = last[wi, si]
            can = prev > -2
            if self.bpe:
                can[can] = self.compatible(prev[can], pi[can])
                wi, zi, pi = wi[can], zi[can], pi[can]
            else:
                wi, si, zi, pi = wi[can], si[can], zi[can], pi[can]
                value = best[wi, si] + worth[pi]
                order = np.lexsort((value, wi))
                top = order[np.append(wi[order][1:] != wi[order][:-1], True)] if len(order) else order
                wi, zi, pi = wi[top], zi[top], pi[top]
                best[wi, i] = value[top]
            last[wi, i], back[wi, i] = pi, zi
        if (last[:, n] == -2).any():
            raise ValueError("a word has no segmentation")
        steps, pos, rows = [], np.full(many, n), np.arange(many)
        while len(rows):
            at = pos[rows]
            steps.append((rows, last[rows, at], np.where(last[rows, at] == v, codes[rows, at - 1] + np.uint32(1), 0)))
            pos[rows] = at - back[rows, at]
            rows = rows[pos[rows] > 0]
        order = np.argsort(np.concatenate([r for r, _, _ in steps[::-1]]), kind="stable")
        ids, unknown = (np.concatenate([x[j] for x in steps[::-1]])[order] for j in (1, 2))
        return ids, np.bincount(np.concatenate([r for r, _, _ in steps]), minlength=many), unknown

    def spaces(self, n: int) -> list[int]:
        """Ids of a run of n spaces that no word takes: merged in order of score, leftmost first."""
        if not self.bpe:
            return self._space_ways(n)
        one = max((len(p) for p in self.index if not p.strip(SPACE)), default=1)
        out: list[int] = []
        while n > 4 * one and SPACE * one in self.index:  # a full piece on the left is never touched again
            out.append(self.index[SPACE * one])
            n -= one
        return out + [self.index[s[0]] for s in self._merge(SPACE * n)]

    def _space_ways(self, n: int) -> list[int]:
        """Best ways of a run of n spaces under a unigram model."""
        sizes = sorted((len(p), i) for p, i in self.index.items() if not p.strip(SPACE))
        best, back = [0.0], [(0, 0)]
        for i in range(1, n + 1):
            score, k, j = max((best[i - k] + self.scores[j], k, j) for k, j in sizes if k <= i)
            best.append(score)
            back.append((k, j))
        out = []
        while n:
            k, j = back[n]
            out.append(j)
            n -= k
        return out[::-1]


class Encoder:
    def __init__(self, model: Model):
        self.m = model
        self.space = model.index.get(SPACE, model.unk)
        self._forget()

    def _forget(self) -> None:
        """place: word to its number; its ids are the span (begin, size) of flat."""
        self.place: dict[str, int] = {}
        self.flat, self.begin, self.size = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _learn(self, texts: list[list[str]]) -> None:
        all_words = set().union(*texts)
        all_words.discard("")
        new = all_words.difference(self.place)
        if len(self.place) + len(new) > CACHE_WORDS:
            self._forget()
            new = all_words
        by: dict[int, list[str]] = {}
        for w in new:
            by.setdefault(len(w), []).append(w)
        flats, sizes, count = [self.flat], [self.size], len(self.place)
        for n in sorted(by):
            step = max(1, 300_000 // (n + 1))
            for at in range(0, len(by[n]), step):
                some = by[n][at:at + step]
                ids, size, unknown = self.m.words([SPACE + w for w in some])
                if unknown.any():
                    ids, size = self._bytes(ids, size, unknown)
                flats.append(ids.astype(np.int32))
                sizes.append(size)
                self.place.update(zip(some, range(count, count + len(some))))
                count += len(some)
        self.flat, self.size = np.concatenate(flats), np.concatenate(sizes)
        self.begin = np.cumsum(self.size) - self.size

    def _bytes(self, ids: np.ndarray, size: np.ndarray, unknown: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unknown characters as their byte pieces."""
        code = {c: self.m.bytes[list(chr(c - 1).encode("utf-8", "replace"))] for c in np.unique(unknown[unknown > 0]).tolist()}
        count = np.ones(len(ids), np.int64)
        at = np.flatnonzero(unknown)
        count[at] = [len(code[c]) for c in unknown[at].tolist()]
        out = np.repeat(ids, count)
        begin = np.cumsum(count) - count
        for i in at.tolist():
            out[begin[i]:begin[i] + count[i]] = code[int(unknown[i])]
        return out, np.add.reduceat(count, np.cumsum(size) - size)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each text has (null: none)."""
        ids, sizes, at = [], [], 0
        while at < len(texts):
            some, size = [], 0
            while at < len(texts) and (not some or size < CHUNK_CHARS):
                some.append(texts[at] or "")
                size += len(some[-1])
                at += 1
            i, n = self._encode(some)
            ids.append(i)
            sizes.append(n)
        return (np.concatenate(ids), np.concatenate(sizes)) if ids else (np.empty(0, np.int32), np.empty(0, np.int64))

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        split = [t.replace(SPACE, " ").split(" ") if t else [] for t in texts]
        self._learn(split)
        place, ids, sizes = self.place, [], np.zeros(len(texts), np.int64)
        for d, parts in enumerate(split):
            if "" in parts:
                got = self._spaced(parts)
            else:
                at = np.fromiter(map(place.__getitem__, parts), np.int64, len(parts))
                got = _gather(self.flat, self.begin[at], self.size[at])
            ids.append(got)
            sizes[d] = len(got)
        return np.concatenate(ids), sizes

    def _spaced(self, parts: list[str]) -> np.ndarray:
        """A text with runs of spaces, which are the empty parts."""
        out, run = [], 0
        for w in [*parts, None]:
            if w == "":
                run += 1
                continue
            got = self.flat[:0]
            if w is not None:
                i = self.place[w]
                got = self.flat[self.begin[i]:self.begin[i] + self.size[i]]
            if run and len(got) and got[0] == self.space:
                run, got = run + 1, got[1:]
            if run:
                out.append(np.array(self.m.spaces(run), np.int32))
            out.append(got)
            run = 0
        return np.concatenate(out)

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """Texts of consecutive ids."""
        m = self.m
        lens = m.raw_size[ids]
        raw = _gather(m.raw_flat, m.raw_begin[ids], lens).tobytes()
        ends = np.concatenate(([0], np.cumsum(lens)))[np.cumsum(sizes)]
        out, a = [], 0
        for b in ends.tolist():
            out.append(raw[a + (raw[a:a + 1] == b" " and a < b):b].decode("utf-8", "replace"))
            a = b
        return out


def load_model(path: str) -> Model:
    """Pieces and scores of a SentencePiece model file."""
    from sentencepiece import SentencePieceProcessor

    p = SentencePieceProcessor(model_file=path)
    n = p.get_piece_size()
    kinds = np.array([2 if p.is_byte(i) else 1 if p.is_control(i) or p.is_unknown(i) else 0 for i in range(n)])
    probe = " a  b "
    if p.decode(p.encode(probe)) != probe:
        raise ValueError("the model normalises white space")
    # in the file's trainer settings, field 3 is the type: 1 unigram, 2 BPE; BPE scores are whole numbers by rank
    scores = np.array([p.get_score(i) for i in range(n)])
    bpe = bool((scores == np.round(scores)).all())
    return Model([p.id_to_piece(i) for i in range(n)], scores, kinds, bpe, p.unk_id())


_ready: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    """One encoder for each Python worker and model."""
    key = shared.value[0]
    if key not in _ready:
        _ready.clear()
        _ready[key] = Encoder(shared.value[1])
    return _ready[key]


def _share(spark: SparkSession, model: Model):
    name = hashlib.sha256("\n".join(model.pieces).encode() + model.scores.tobytes()).hexdigest()
    return spark.sparkContext.broadcast((name, model))


def encode(docs: DataFrame, model: Model, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, n_tokens, token_ids, and what the ids decode to."""
    shared = _share(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                texts = part.column(0).to_pylist()
                null = np.array([t is None for t in texts])
                ids, sizes = enc.encode(texts)
                decoded = enc.decode(ids, sizes)
                ends = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], pa.array(sizes, pa.int64(), mask=null),
                     pa.ListArray.from_arrays(ends, pa.array(ids), mask=pa.array(null)),
                     pa.array(decoded, pa.string(), mask=null)],
                    [*carry, "n_tokens", "token_ids", "decoded"])

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in carry)
    return docs.select(F.col(text), *carry).mapInArrow(run, kinds + "n_tokens long, token_ids array<int>, decoded string")


def decode(rows: DataFrame, model: Model, ids: str = "token_ids", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns and the text of the ids."""
    shared = _share(rows.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared)
        for b in batches:
            lists = b.column(0).to_pylist()
            sizes = np.array([len(x or ()) for x in lists], np.int64)
            ids = np.array([i for x in lists for i in x or ()], np.int64)
            text = [None if x is None else t for x, t in zip(lists, enc.decode(ids, sizes))]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(text, pa.string())], [*carry, "text"])

    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in carry)
    return rows.select(F.col(ids), *carry).mapInArrow(run, kinds + "text string")
