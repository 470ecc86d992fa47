"""Phrase collocation mining: candidates in double-array tries, walked by numpy.

A text is lower-cased (A-Z), cut into pieces and words. Per language, every phrase
of up to ``max_words`` words that occurs ``min_count`` times or more is found:

1. Words. The different words are counted, and the frequent ones numbered. The texts
   are stored once more as word numbers, -1 for gaps and other words.
2. Sketch. Tasks hash every phrase of frequent words into one of 2^bits buckets (bits
   from the size of the texts), and groups of buckets of bounded size are summed; a
   phrase's count is at most its bucket's.
3. Candidates. Tasks list the different phrases whose bucket reaches ``min_count``
   and whose parts without the first and without the last word do so too (Apriori),
   as packed word numbers by ranges of their hash; a range's lists are merged. The
   frequent buckets are broadcast as a Bloom filter of two to four bytes a key, in
   slices of at most ``slice_keys`` keys; what it lets through too much fails the count.
4. Tries. Ranges make shards of about ``shard_entries`` candidates of one length, and
   each shard becomes a double-array trie over word numbers of two digits, in a file
   that the cluster shares.
5. Counting. One pass for all shards. A task holds GROUP_WORDS words, sorts their places
   by the same hash, and each shard's trie, read in turn, walks the places that can be
   its own: numpy moves the states of many places at once, digit by digit, and adds up
   the accepting states by bincount; Spark sums the groups' counts.
6. Scores by joins on the parts of a phrase, in exact decimals.

Passes: two over the texts; over their numbers two, and one for each slice. Each place
is walked once a length, however many shards there are; what grows with shards times
text is that each group of words reads every trie that it has places for.

A null text is empty, a null language is ``und``, together with texts of the
language ``und``. Repeated rows count as often as they occur. Ties go to the
phrase that is smaller in bytes. An empty table, or one without frequent phrases,
gives no rows. Texts have no bound but memory. Other columns are ignored.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from bnlake.llm.common import byte_texts, staged

#: What ends a piece, and what else separates words.
PIECE_ENDS, GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"
STOP = b"."
LOWER = bytes.maketrans(PIECE_ENDS + GAPS + bytes(range(65, 91)), STOP * len(PIECE_ENDS) + b" " * len(GAPS) + bytes(range(97, 123)))
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Bytes of text that a task holds as one block.
BLOCK_BYTES = 4 << 20
#: Words whose phrases a task sums up before it hands them on; bytes of text for a part of the buckets.
SKETCH_WORDS, PART_BYTES = 3_000_000, 12 << 20
#: Words whose places a task deals out together; bytes of text of a task that does; places walked at once; hash ranges of a shard.
GROUP_WORDS, TASK_BYTES, WALK, RANGES = 4_000_000, 96 << 20, 1 << 19, 8
#: Words of 64 bits in a part of the Bloom filter; word numbers in a file.
FILTER_PART, VOCABULARY_ROWS = 1 << 17, 500_000
#: Places that are tried for the children of a state before they go to the end of the array.
PROBES = 48
#: Different words that a task gathers before it sums them up.
GATHERED = 1_000_000
UNKNOWN_LANG = "und"


class Words:
    """The words of a language's texts in a block: the different ones (``words``), and
    their numbers in the order of the texts (``code``), -1 between pieces and texts."""

    def __init__(self, texts: list[bytes]):
        found = STOP.join(texts).translate(LOWER).replace(STOP, b" " + STOP + b" ").split()
        coded = pa.array(found, pa.binary()).dictionary_encode()
        self.words = coded.dictionary
        self.code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        stop = pc.index(self.words, pa.scalar(STOP, pa.binary())).as_py()
        self.code[self.code == stop] = -1


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Words]]:
    """(language, words) of blocks of the rows (lang, text)."""
    held, size = {}, 0
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), byte_texts(b.column(1))):
            held.setdefault(lang, []).append(text or b"")
            size += len(text or b"")
            if size >= BLOCK_BYTES:
                yield from ((k, Words(t)) for k, t in held.items())
                held, size = {}, 0
    yield from ((k, Words(t)) for k, t in held.items())


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, f) of the rows (lang, text); the sums of some blocks."""
    def summed(held: list[pa.Table]) -> list[pa.RecordBatch]:
        found = pa.concat_tables(held).group_by(["lang", "word"]).aggregate([("f", "sum")])
        return pa.table({"lang": found["lang"], "word": found["word"].cast(pa.string()), "f": found["f_sum"]}).to_batches()

    held, size = [], 0
    for lang, w in blocks(batches):
        times = np.bincount(w.code[w.code >= 0], minlength=len(w.words))
        at = pa.array(np.flatnonzero(times))
        held.append(pa.table({"lang": pa.array([lang] * len(at), pa.string()), "word": w.words.take(at), "f": pa.array(times).take(at)}))
        size += len(at)
        if size >= GATHERED:
            yield from summed(held)
            held, size = [], 0
    if held:
        yield from summed(held)


def _column(path: str, name: str) -> pa.Array:
    """A column of a Parquet file in the shared folder."""
    where, path = fs.FileSystem.from_uri(path)
    with where.open_input_file(path) as f:
        return pq.ParquetFile(f).read([name])[name].combine_chunks()


def word_numbers(asked: dict[str, pa.Array], vocabulary: list[str]) -> dict[str, np.ndarray]:
    """The numbers of each language's words, -1 without one: a word's place in the
    files of the vocabulary, one file after the other."""
    out = {lang: np.full(len(words), -1, np.int32) for lang, words in asked.items()}
    first = 0
    for path in vocabulary:
        langs, words = _column(path, "lang"), _column(path, "word").cast(pa.binary())
        for lang, mine in asked.items():
            there = np.flatnonzero(pc.equal(langs, lang).to_numpy(zero_copy_only=False))
            if len(there) and len(mine):
                at = pc.fill_null(pc.index_in(mine, value_set=words.take(pa.array(there))), -1).to_numpy(zero_copy_only=False)
                known = np.flatnonzero(at >= 0)
                out[lang][known] = there[at[known]] + first
        first += len(words)
    return out


def _encoded(vocabulary: list[str]):
    """The rows (lang, text) as word numbers of frequent words, -1 for others, between pieces and after texts."""
    def numbered(held: list[tuple[str, pa.Array, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        asked: dict[str, list[pa.Array]] = {}
        for lang, words, _ in held:
            asked.setdefault(lang, []).append(words)
        numbers = word_numbers({lang: pa.concat_arrays(x) for lang, x in asked.items()}, vocabulary)
        first = dict.fromkeys(numbers, 0)
        for lang, words, code in held:
            mine = np.append(numbers[lang][first[lang]:first[lang] + len(words)], np.int32(-1))  # the last is for gaps
            first[lang] += len(words)
            yield pa.RecordBatch.from_arrays([pa.array([np.append(mine[code], np.int32(-1)).tobytes()], pa.binary())], ["code"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for lang, w in blocks(batches):
            held.append((lang, w.words, w.code.astype(np.int32)))
            size += len(w.code)
            if size >= GROUP_WORDS:
                yield from numbered(held)
                held, size = [], 0
        yield from numbered(held)

    return run


def dealt(files: list[str], tasks: int) -> list[list[str]]:
    """The files of each task."""
    n = max(1, min(tasks, len(files)))
    return [files[i::n] for i in range(n)]


def by_task(spark: SparkSession, files: list[list[str]]) -> DataFrame:
    """A row for each task, which reads its files itself: no large batches pass through the JVM."""
    return spark.range(0, len(files), 1, len(files))


def groups(batches: Iterator[pa.RecordBatch], files: list[list[str]], most: int) -> Iterator[np.ndarray]:
    """The word numbers of some rows at once, about as many as ``most``."""
    held, size = [], 0
    for path in (path for b in batches for i in b.column(0).to_pylist() for path in files[i]):
        where, path = fs.FileSystem.from_uri(path)
        with where.open_input_file(path) as f:
            for b in pq.ParquetFile(f, pre_buffer=False).iter_batches(1, columns=["code"]):
                held += (np.frombuffer(x.as_buffer(), np.int32) for x in b.column(0))
                size += sum(map(len, held[-len(b):]))
                if size >= most:
                    code, held, size = np.concatenate(held), [], 0
                    yield code
    if size:
        yield np.concatenate(held)


def phrase_hash(numbers: list[np.ndarray]) -> np.ndarray:
    """A hash of phrases by the numbers of their first, second, ... words."""
    acc = np.zeros(len(numbers[0]), np.uint64)
    for x in numbers:
        h = (x.astype(np.uint64) + BASE) * MIX
        acc = acc * BASE + (h ^ (h >> np.uint64(31)))
    acc = (acc ^ (acc >> np.uint64(29))) * MIX
    return (acc ^ (acc >> np.uint64(32))) * BASE


def phrases_of(code: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, hashes) of the phrases of n frequent words, for parts of a sequence of word numbers."""
    for begin in range(0, len(code) - n + 1, WALK):
        part = code[begin:begin + WALK + n - 1]
        size = len(part) - n + 1
        ok = part[:size] >= 0
        for i in range(1, n):
            ok &= part[i:size + i] >= 0
        at = np.flatnonzero(ok)
        yield at + begin, phrase_hash([part[at + i] for i in range(n)])


def by_hash(places: Iterator[tuple[np.ndarray, np.ndarray]], code: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of their hashes, and the edges of ranges of hashes; places of equal phrases are neighbours but for rare cases."""
    bits, size, both = np.uint64(len(code).bit_length()), 0, np.empty(len(code), np.uint64)
    for at, h in places:
        both[size:size + len(at)] = h >> bits << bits | at.astype(np.uint64)
        size += len(at)
    both = both[:size]
    both.sort()
    edges = np.searchsorted(both, np.array([-(-(i << 32) // ranges) << 32 for i in range(ranges)], np.uint64))
    both &= (np.uint64(1) << bits) - np.uint64(1)
    return both.view(np.int64), np.append(edges, size)


def _sketch(files: list[list[str]], max_words: int, bits: int, shift: int, enough: int):
    """(words, part, keys, times): the sums of some million phrases by parts of the
    buckets, keys as differences, so that a part costs a few bytes a bucket."""
    def packed(n: int, keys: list[np.ndarray]) -> pa.RecordBatch:
        found, times = np.unique(np.concatenate(keys), return_counts=True)
        part = found >> shift
        begin = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        step = np.diff(found, prepend=0)
        step[begin] = found[begin] & ((1 << shift) - 1)
        at = np.append(begin, len(found)).tolist()
        step, times = step.astype(np.uint32), np.minimum(times, enough).astype(np.uint32 if enough > 255 else np.uint8)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(begin), n, np.int32)), pa.array(part[begin]), pa.array([step[x:y].tobytes() for x, y in zip(at, at[1:])], pa.binary()),
             pa.array([times[x:y].tobytes() for x, y in zip(at, at[1:])], pa.binary())], ["words", "part", "keys", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for code in groups(batches, files, SKETCH_WORDS):
            for n in range(2, max_words + 1):
                keys = [(h >> np.uint64(64 - bits)).view(np.int64) for _, h in phrases_of(code, n)]
                if any(map(len, keys)):
                    yield packed(n, keys)

    return run


def _frequent(shift: int, enough: int):
    """The keys of a part's buckets that are frequent."""
    def run(found: pa.Table) -> pa.Table:
        n, part = found["words"][0].as_py(), found["part"][0].as_py()
        keys = np.concatenate([np.cumsum(np.frombuffer(k, np.uint32), dtype=np.int64) for k in found["keys"].to_pylist()])
        times = np.concatenate([np.frombuffer(t, np.uint32 if enough > 255 else np.uint8) for t in found["times"].to_pylist()])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        total = np.add.reduceat(times[order].astype(np.int64), begin)
        return pa.table({"key": pa.array(keys[begin[total >= enough]] + (part << shift) + (n << 48), pa.int64())})

    return run


def key_bits(keys: np.ndarray) -> np.ndarray:
    """The four bits of keys in their word of the filter."""
    mixed = keys.view(np.uint64) * BASE
    out = np.zeros(len(keys), np.uint64)
    for shift in (58, 52, 46, 40):
        out |= np.uint64(1) << (mixed >> np.uint64(shift) & np.uint64(63))
    return out


def _filter_words(size: int):
    """A part of the Bloom filter of size words."""
    def run(found: pa.Table) -> pa.Table:
        keys = found["key"].to_numpy()
        words = np.zeros(min(size, FILTER_PART), np.uint64)
        np.bitwise_or.at(words, keys & (len(words) - 1), key_bits(keys))
        return pa.table({"part": pa.array([found["part"][0].as_py()], pa.int64()), "words": pa.array([words.tobytes()], pa.binary())})

    return run


class KeyFilter:
    """Bloom filter of keys, which are hashes: the last bits choose one of its words."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @classmethod
    def of(cls, keys: DataFrame, n: int) -> KeyFilter:
        """Of the n rows of keys; tasks make the parts."""
        size = 1 << max(0, (max(n, 1) - 1).bit_length() - 2)
        parts = keys.select(F.shiftright(F.col("key").bitwiseAND(size - 1), FILTER_PART.bit_length() - 1).alias("part"), "key")
        words = np.zeros(size, np.uint64)
        for r in parts.groupBy("part").applyInArrow(_filter_words(size), "part long, words binary").toLocalIterator():
            some = np.frombuffer(r["words"], np.uint64)
            words[r["part"] * FILTER_PART:][:len(some)] = some
        return cls(words)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        bits = key_bits(keys)
        return self.words[keys & (len(self.words) - 1)] & bits == bits


def _candidates(files: list[list[str]], shared, max_words: int, bits: int, ranges: dict[int, tuple[int, int]]):
    """(range, words, numbers): a group's different phrases of the slice; ranges: the first and the number of those of each length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, hi, words = shared.value
        frequent = KeyFilter(words)

        def kept(code: np.ndarray, n: int, before: np.ndarray, safe: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for at, h in phrases_of(code, n):
                ok = before[at] & before[at + 1]
                at, h = at[ok], h[ok]
                key = (h >> np.uint64(64 - bits)).view(np.int64) | np.int64(n << 48)
                other = (key < lo) | (key >= hi)
                mine = ~other
                mine[mine] = frequent.holds(key[mine])
                safe[at] = mine | other  # a bucket of another slice may be frequent
                yield at[mine], h[mine]

        for code in groups(batches, files, GROUP_WORDS):
            safe = code >= 0
            for n in range(1, max_words + 1):
                before, safe = safe, np.zeros(len(code), bool)
                first, many = ranges.get(n, (0, 0))
                if n == 1:
                    safe, places = before, phrases_of(code, 1) if lo <= 2 << 48 else iter(())  # with the first slice
                else:
                    places = kept(code, n, before, safe)
                if not many:
                    continue
                at, edges = by_hash(places, code, many)
                numbers = [code[at + i] for i in range(n)]
                new = np.ones(len(at), bool)
                new[1:] = np.any([x[1:] != x[:-1] for x in numbers], axis=0)
                for i in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
                    one = slice(edges[i], edges[i + 1])
                    yield pa.RecordBatch.from_arrays([pa.array([first + i], pa.int32()), pa.array([n], pa.int32()), pa.array([b"".join(x[one][new[one]].tobytes() for x in numbers)], pa.binary())],
                                                     ["range", "words", "numbers"])

    return run


def unpacked(found: pa.Table) -> np.ndarray:
    """The word numbers of candidates of a length: a row for the first, second, ... words."""
    n = found["words"][0].as_py()
    return np.concatenate([np.frombuffer(x.as_buffer(), np.int32).reshape(n, -1) for x in found["numbers"]], axis=1)


def _different(found: pa.Table) -> pa.Table:
    """A range's different candidates."""
    numbers = unpacked(found)
    h = phrase_hash(list(numbers))
    order = np.argsort(h, kind="stable")
    h, numbers = h[order], numbers[:, order]
    new = np.ones(len(h), bool)
    new[1:] = (numbers[:, 1:] != numbers[:, :-1]).any(axis=0)
    if (h[1:] == h[:-1])[new[1:]].any():  # different phrases of the same hash
        numbers = np.unique(numbers, axis=1)
    else:
        numbers = numbers[:, new]
    return pa.table({"range": found["range"][:1], "words": found["words"][:1], "numbers": pa.array([numbers.tobytes()], pa.binary())})


def radix_of(n_words: int) -> int:
    return max(2, math.isqrt(max(0, n_words - 1)) + 1)


class Trie:
    """A double-array trie of word sequences: the child of state s by symbol c is
    base[s] + c if check[base[s] + c] is s. A word's number makes two symbols."""

    def __init__(self, sequences: list[np.ndarray], n_words: int):
        """sequences: for 1, 2, ... words an array with one row of word numbers a
        phrase; entries are numbered through them in order."""
        self.radix = radix = radix_of(n_words)
        depth = max([i + 1 for i, s in enumerate(sequences) if len(s)], default=0)
        rows = sum(map(len, sequences))
        symbols = np.full((rows, 2 * depth), -1, np.int64)
        size = np.zeros(rows, np.int64)
        at = 0
        for s in sequences:
            if len(s):
                symbols[at:at + len(s), 0:2 * s.shape[1]:2] = s // radix
                symbols[at:at + len(s), 1:2 * s.shape[1]:2] = s % radix
                size[at:at + len(s)] = 2 * s.shape[1]
                at += len(s)
        # nodes level by level; the root is node 0
        node, parents, by = np.zeros(rows, np.int64), [np.array([-1])], [np.array([-1])]
        ends, n_nodes = np.zeros(rows, np.int64), 1
        for level in range(2 * depth):
            on = np.flatnonzero(size > level)
            different, back = np.unique(node[on] * radix + symbols[on, level], return_inverse=True)
            parents.append(different // radix)
            by.append(different % radix)
            node[on] = n_nodes + back
            done = on[size[on] == level + 1]
            ends[done] = node[done]
            n_nodes += len(different)
        self._place(np.concatenate(parents)[1:], np.concatenate(by)[1:], n_nodes)
        self.entry = np.full(len(self.check), -1, np.int32)
        self.entry[self._slot[ends]] = np.arange(rows, dtype=np.int32)
        self.entries = rows
        self.depth = depth
        del self._slot

    def _place(self, parent: np.ndarray, by: np.ndarray, n_nodes: int) -> None:
        """Places for all nodes but the root; node i + 1 is the child of parent[i] by by[i]."""
        order = np.argsort(parent, kind="stable")
        owner, begin, many = np.unique(parent[order], return_index=True, return_counts=True)
        used = bytearray(2 * n_nodes + 4 * self.radix)
        used[0] = 1  # the root
        base = np.zeros(n_nodes, np.int64)
        symbols = by[order]
        end, probe = 1, 1  # behind the last place used; a fixed sequence of places to try
        for i in np.flatnonzero(many > 1)[np.argsort(-many[many > 1], kind="stable")].tolist():
            cs = symbols[begin[i]:begin[i] + many[i]].tolist()
            least, place = cs[0], max(end, cs[0])
            for _ in range(PROBES):
                probe = (probe * 1103515245 + 12345) & 0x7FFFFFFF
                found = used.find(0, probe % end, end)
                if found >= least and not any(used[found - least + c] for c in cs):
                    place = found
                    break
            b = place - least
            base[owner[i]] = b
            for c in cs:
                used[b + c] = 1
            end = max(end, b + cs[-1] + 1)
            if len(used) < end + 2 * self.radix:
                used.extend(bytes(len(used)))
        # single children go to the free places, one each
        single = np.flatnonzero(many == 1)
        c = symbols[begin[single]]
        free = np.flatnonzero(np.frombuffer(used, np.uint8) == 0)
        free = free[free >= self.radix][:len(single)]
        if len(free) < len(single):
            free = np.concatenate((free, len(used) + np.arange(len(single) - len(free))))
        base[owner[single]] = free - c
        slot = np.zeros(n_nodes, np.int64)
        slot[order + 1] = base[parent[order]] + symbols
        top = int(slot.max()) + 2 * self.radix + 1
        self.check = np.full(top, -1, np.int32)
        self.check[slot[1:]] = slot[parent]
        self.base = np.zeros(top, np.int32)
        self.base[slot] = base
        self._slot = slot

    def digits(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The two symbols of word numbers; negative for -1, a word of no entry."""
        return np.where(numbers < 0, -1, numbers // self.radix), numbers % self.radix

    def count(self, high: np.ndarray, low: np.ndarray, into: np.ndarray, at: np.ndarray | None = None) -> None:
        """Add to ``into`` how often each entry occurs in a sequence of words, given by
        their digits, or begins at some of its places; a negative high digit is a word
        of no entry, or a gap."""
        at = np.flatnonzero(high >= 0) if at is None else at
        state = np.zeros(len(at), np.int64)
        for _ in range(self.depth):
            for digit in (high, low):
                to = self.base[state] + digit[at]
                ok = self.check[to] == state
                at, state = at[ok], to[ok]
            found = self.entry[state]
            found = found[found >= 0]
            if len(found):
                into += np.bincount(found, minlength=self.entries)
            at = at + 1
            ok = at < len(high)
            ok[ok] = high[at[ok]] >= 0
            at, state = at[ok], state[ok]


def _build(n_words: int):
    """A shard's candidates as a pickled trie, and their word numbers in the order of its entries."""
    def run(found: pa.Table) -> pa.Table:
        numbers = unpacked(found)
        n = len(numbers)
        trie = Trie([np.empty((0, k), np.int64) for k in range(1, n)] + [numbers.T.astype(np.int64)], n_words)
        return pa.table({"shard": pa.array([found["shard"][0].as_py()], pa.int32()), "trie": pa.array([pickle.dumps(trie, protocol=5)], pa.binary()),
                         "words": found["words"][:1], "numbers": pa.array([numbers.tobytes()], pa.binary())})

    return run


def _count(files: list[list[str]], n_words: int, tries: dict[int, list[tuple[int, str | None]]]):
    """(shard, held, times, large): a group's counts of a shard's entries. tries: (shard, file) of each length."""
    def sums_of(code: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        radix = radix_of(n_words)
        kind = np.int16 if radix < 1 << 15 else np.int32
        high, low = (code // radix).astype(kind), (code % radix).astype(kind)  # -1 // radix is -1
        for n, shards in tries.items():
            at, edges = by_hash(phrases_of(code, n), code, len(shards))
            for (shard, path), begin, end in zip(shards, edges, edges[1:]):
                if path is None or begin == end:
                    continue
                trie = pickle.loads(_column(path, "trie")[0].as_buffer())
                sums = np.zeros(trie.entries, np.int64)
                for x in range(begin, end, WALK):
                    trie.count(high, low, sums, at[x:min(end, x + WALK)])
                del trie  # before the next one is read
                yield shard, sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for code in groups(batches, files, GROUP_WORDS):
            for shard, sums in sums_of(code):
                times = sums[sums > 0]
                blobs = np.packbits(sums > 0), np.minimum(times, 255).astype(np.uint8), times[times >= 255]
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in blobs)], ["shard", "held", "times", "large"])

    return run


def _total(vocabulary: list[str], min_count: int):
    """(lang, phrase, words, f) of a shard's entries that occur min_count times or more, from the groups' counts."""
    def run(entries: pa.Table, found: pa.Table) -> pa.Table:
        numbers = unpacked(entries)
        total = np.zeros(numbers.shape[1], np.int64)
        for held, times, large in zip(found["held"], found["times"], found["large"]):
            at = np.flatnonzero(np.unpackbits(np.frombuffer(held.as_buffer(), np.uint8), count=len(total)))
            some = np.frombuffer(times.as_buffer(), np.uint8).astype(np.int64)
            some[some == 255] = np.frombuffer(large.as_buffer(), np.int64)
            total[at] += some
        at = np.flatnonzero(total >= min_count)
        langs, words = (pa.chunked_array([_column(path, name) for path in vocabulary], pa.string()).combine_chunks() for name in ("lang", "word"))
        parts = [words.take(pa.array(x[at])) for x in numbers]
        phrase = parts[0] if len(parts) == 1 else pc.binary_join_element_wise(*parts, " ")
        return pa.table({"lang": langs.take(pa.array(numbers[0][at])), "phrase": phrase, "words": pa.array(np.full(len(at), len(parts), np.int32)), "f": pa.array(total[at])})

    return run


def candidates(spark: SparkSession, files: list[str], size: int, n_words: int, max_words: int, min_count: int, shard_entries: int, slice_keys: int) -> tuple[DataFrame, dict[int, list[int]]]:
    """(shard, words, numbers) of all phrases that may occur min_count times, as a stored table, and the shards of each length; files: of the word numbers; size: bytes of the texts."""
    bits = min(40, max(20, size.bit_length()))
    shift = bits - min(bits, max(bits - 32, (size // PART_BYTES).bit_length()))
    each = dealt(files, len(files))
    sketch = by_task(spark, each).mapInArrow(_sketch(each, max_words, bits, shift, min_count), "words int, part long, keys binary, times binary")
    frequent = staged(sketch.groupBy("words", "part").applyInArrow(_frequent(shift, min_count), "key long"), "phrase-buckets")
    lengths = {r["w"]: r["n"] for r in frequent.groupBy((F.shiftright("key", 48)).alias("w")).agg(F.count("*").alias("n")).collect()}
    n = sum(lengths.values())
    edges = [1 << 48, (max_words + 1) << 48]
    if n > slice_keys:
        # keys are hashes: equal ranges of those of each length hold about equal numbers
        edges = [(w << 48) + (i << bits) // k for w in range(2, max_words + 1) for k in [-(-2 * lengths.get(w, 1) // slice_keys)] for i in range(k)] + edges[1:]
    shards, last = {}, 0
    for w, many in sorted({1: n_words, **lengths}.items()):
        shards[w] = list(range(last, last := last - (-many // shard_entries)))
    ranges = {w: (RANGES * mine[0], RANGES * len(mine)) for w, mine in shards.items()}
    some, out = dealt(files, max(4 * spark.sparkContext.defaultParallelism, size // TASK_BYTES)), None
    for lo, hi in zip(edges, edges[1:]):
        shared = spark.sparkContext.broadcast((lo, hi, KeyFilter.of(frequent.filter((F.col("key") >= lo) & (F.col("key") < hi)), min(n, slice_keys)).words))
        listed = by_task(spark, some).mapInArrow(_candidates(some, shared, max_words, bits, ranges), "range int, words int, numbers binary")
        found = staged(listed.groupBy("range").applyInArrow(_different, "range int, words int, numbers binary"), "phrase-candidates")
        shared.unpersist()
        out = found if out is None else out.unionByName(found)
    return out.select(F.floor(F.col("range") / RANGES).cast("int").alias("shard"), "words", "numbers"), shards


def frequent_phrases(docs: DataFrame, max_words: int = 3, min_count: int = 10, shard_entries: int = 600_000,
                     slice_keys: int = 32_000_000) -> DataFrame:
    """(lang, phrase, words, f) of all phrases of 1 to max_words words that occur
    min_count times or more, and (lang, '', 0, number of words), as a stored table."""
    if not 0 < max_words < 128 or min_count < 1:
        raise ValueError("max_words must be from 1 to 127, min_count positive")
    rows = docs.select(F.coalesce("lang", F.lit(UNKNOWN_LANG)).alias("lang"), "text")
    spark = docs.sparkSession
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    words = staged(rows.mapInArrow(_word_counts, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f")), "phrase-words")
    known = staged(words.filter(F.col("f") >= min_count).select("lang", "word"), "phrase-vocabulary", maxRecordsPerFile=VOCABULARY_ROWS)
    vocabulary, n_words = sorted(known.inputFiles()), known.count()
    if not n_words:
        return spark.createDataFrame([], "lang string, phrase string, words int, f long")
    code = sorted(staged(rows.mapInArrow(_encoded(vocabulary), "code binary"), "phrase-texts").inputFiles())
    found, shards = candidates(spark, code, size, n_words, max_words, min_count, shard_entries, slice_keys)
    # a file for each shard, so that tasks can read one after the other
    tries = staged(found.groupBy("shard").applyInArrow(_build(n_words), "shard int, trie binary, words int, numbers binary"), "phrase-tries", maxRecordsPerFile=1)
    path = {r["shard"]: r["path"] for r in tries.select("shard", F.input_file_name().alias("path")).collect()}
    some = dealt(code, max(4 * spark.sparkContext.defaultParallelism, size // TASK_BYTES))
    count = _count(some, n_words, {n: [(i, path.get(i)) for i in mine] for n, mine in shards.items()})
    sums = by_task(spark, some).mapInArrow(count, "shard int, held binary, times binary, large binary")
    entries = tries.select("shard", "words", "numbers")
    counts = entries.groupBy("shard").cogroup(sums.groupBy("shard")).applyInArrow(_total(vocabulary, min_count), "lang string, phrase string, words int, f long")
    totals = words.groupBy("lang").agg(F.sum("f").alias("f")).select("lang", F.lit("").alias("phrase"), F.lit(0).alias("words"), "f")
    return staged(counts.unionByName(totals), "phrase-counts")


def _part(first: int | Column, n: Column) -> Column:
    return F.array_join(F.slice("w", first, n), " ")


def scored(f: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of phrases of two words or more, with their
    weakest cut: floor(10^6 a^2 / (l r)) is smallest, then the first part shortest."""
    many = f.filter("words > 1").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = many.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(1, F.col("k")).alias("first"), _part(F.col("k") + 1, F.size("w")).alias("rest"))
    left = f.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = f.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    both = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    wide = "cast({} as decimal(15, 0))"
    score = F.expr(f"(cast({wide.format('a')} * {wide.format('a')} as decimal(30, 0)) * 1000000bd) div ({wide.format('l')} * {wide.format('r')})")
    best = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "a", "b.l", "b.r", "b.score")


def inside_longer(f: DataFrame) -> DataFrame:
    """(lang, phrase, most): phrases of two words or more inside longer frequent ones, with the largest count of those."""
    longer = f.filter("words > 2").select("lang", "f", "words", F.split("phrase", " ").alias("w"))
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(
        F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))))
    return longer.select("lang", F.explode(spans).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))


def collocations(docs: DataFrame, max_words: int = 3, min_count: int = 10, inside_percent: int = 50, top: int = 2000,
                 salts: int = 32, **sizes) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases by score,
    count and name. A phrase inside a longer one that occurs at least inside_percent
    as often is left out."""
    f = frequent_phrases(docs, max_words, min_count, **sizes)
    within = inside_longer(f)
    left = scored(f).join(within, ["lang", "phrase"], "left").filter(F.col("most").isNull() | (100 * F.col("most") < inside_percent * F.col("a")))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # the best of every part of a language first, so that no task ranks a whole one
    salt = F.pmod(F.xxhash64("phrase"), F.lit(salts))
    some = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))).filter(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    n = f.filter("words = 0").select("lang", F.col("f").alias("n"))
    return best.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
