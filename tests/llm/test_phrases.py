"""Collocations against plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from bnlake.llm import phrases


def brute(rows, max_words, min_count, percent, top):
    """rows: (lang, text)."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + k])) for k in range(1, max_words + 1) for i in range(len(w) - k + 1))
    kept = {(lang, p): a for (lang, p), a in f.items() if len(p) > 1 and a >= min_count}
    most = Counter()
    for (lang, p), a in kept.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                most[lang, p[i:i + k]] = max(most[lang, p[i:i + k]], a)
    out = {}
    for (lang, p), a in kept.items():
        if (lang, p) in most and 100 * most[lang, p] >= percent * a:
            continue
        score, k = min((10 ** 6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return [(lang, i, p.decode(), -a, left, r, n[lang], -s) for lang in sorted(out) for i, (s, a, p, left, r) in enumerate(sorted(out[lang])[:top], 1)]


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def texts(seed, n, words, langs=("en", "fr", None, "und")):
    rnd = random.Random(seed)
    gaps = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", " . "]
    return [(rnd.choice(langs), "".join(rnd.choice(words) + rnd.choice(gaps) for _ in range(rnd.randint(0, 60)))) for _ in range(n)]


@pytest.mark.parametrize("seed,max_words,min_count,how", [
    (1, 3, 10, {}), (2, 3, 2, {"shard_entries": 7, "slice_keys": 11}), (3, 4, 3, {"shard_entries": 40}), (4, 2, 4, {"slice_keys": 5})])
def test_collocations(spark, seed, max_words, min_count, how, monkeypatch):
    rows = texts(seed, 150 if not how else 25, ["a", "B", "cé", "the", "of", "Þ", "x\x00y", "\x1c", "😀"])
    df = spark.createDataFrame([(lang, t, 1, "p") for lang, t in rows], "lang string, text string, f int, phrase string").repartition(4)
    got = rows_of(phrases.collocations(df, max_words, min_count, 50, 30, **how))
    want = brute(rows, max_words, min_count, 50, 30)
    assert got == sorted(want) and want


def test_collocations_on_odd_rows(spark, odd_docs):
    rows = [(r.lang, r.text) for r in odd_docs.select("lang", "text").collect()]
    assert rows_of(phrases.collocations(odd_docs, 3, 2, 50, 100)) == sorted(brute(rows, 3, 2, 50, 100))
    assert rows_of(phrases.collocations(odd_docs.limit(0))) == []
    assert rows_of(phrases.collocations(odd_docs.filter("text is null or text = ''"))) == []


def test_ties_and_copies(spark):
    rows = [("en", "a b. b a. c d")] * 12 + [("en", "new york city")] * 10 + [("en", "new york")] * 5
    got = rows_of(phrases.collocations(spark.createDataFrame(rows, "lang string, text string"), 3, 10, 50, 3))
    assert got == sorted(brute(rows, 3, 10, 50, 3))
    assert [r[2] for r in got] == ["c d", "new york city", "a b"]


def test_large_counts_are_exact(spark):
    big = 10 ** 13 + 7
    f = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big + 2), ("en", "a b", 2, big - 5)], "lang string, phrase string, words int, f long")
    row = phrases.scored(f).first()
    assert row.score == 10 ** 6 * (big - 5) ** 2 // (big * (big + 2))


@pytest.mark.parametrize("seed,n_words,n", [(0, 1, 1), (1, 2, 4), (2, 30, 200), (3, 5000, 3000)])
def test_trie_counts(seed, n_words, n):
    rnd = np.random.default_rng(seed)
    seqs = [np.unique(rnd.integers(0, n_words, (n, k)), axis=0) for k in (1, 2, 3)]
    trie = phrases.Trie(seqs, n_words)
    text = rnd.integers(-1, n_words, 4000)
    for s in seqs:
        at = rnd.integers(0, 3990, 50)
        for i, j in zip(at, rnd.integers(0, len(s), 50)):
            text[i:i + s.shape[1]] = s[j]
    got = np.zeros(trie.entries, np.int64)
    trie.count(*trie.digits(text), got)
    seen = Counter(tuple(text[i:i + k]) for k in (1, 2, 3) for i in range(len(text) - k + 1))
    assert got.tolist() == [seen[tuple(row)] for s in seqs for row in s.tolist()]


def test_trie_without_entries():
    trie = phrases.Trie([np.empty((0, 1), np.int64)], 0)
    got = np.zeros(0, np.int64)
    trie.count(*trie.digits(np.array([-1, -1])), got)
    assert trie.entries == 0


def test_reads_of_the_texts_do_not_grow_with_shards(spark):
    rows = texts(5, 40, ["a", "b", "c", "d", "e"], ("en", "fr"))
    docs = spark.createDataFrame(rows, "lang string, text string")
    reads = []
    for how in ({}, {"shard_entries": 5}):
        read = spark.sparkContext.accumulator(0)

        def counted(batches, read=read):
            for b in batches:
                read.add(b.num_rows)
                yield b

        found = phrases.frequent_phrases(docs.mapInArrow(counted, docs.schema), 3, 2, **how)
        assert {(r.lang, r.phrase): r.f for r in found.filter("words > 0").collect()} == frequent(rows, 3, 2)
        reads.append(read.value)
    assert len(frequent(rows, 3, 2)) > 100 and reads[0] == reads[1]


def frequent(rows, max_words, min_count):
    f = Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = piece.split()
            f.update((lang, " ".join(w[i:i + k])) for k in range(1, max_words + 1) for i in range(len(w) - k + 1))
    return {p: a for p, a in f.items() if a >= min_count}


def test_filter_holds_its_keys_and_few_others(spark):
    rnd = np.random.default_rng(1)
    keys = rnd.integers(0, 1 << 34, 40_000) | (2 << 48)
    some = phrases.KeyFilter.of(spark.createDataFrame([(k,) for k in keys[:20_000].tolist()], "key long"), 20_000)
    assert some.holds(keys[:20_000]).all() and some.holds(keys[20_000:]).mean() < 0.02
    assert not phrases.KeyFilter.of(spark.createDataFrame([], "key long"), 0).holds(keys).any()


def test_candidates_of_unknown_words_go_and_equal_words_of_languages_differ(spark):
    rows = [("en", "x y. x y. x")] * 3 + [("fr", "x y z. y x")] * 3 + [("de", "only once")]
    for how in ({}, {"shard_entries": 1, "slice_keys": 1}):
        found = phrases.frequent_phrases(spark.createDataFrame(rows, "lang string, text string"), 3, 3, **how)
        assert {(r.lang, r.phrase): r.f for r in found.filter("words > 0").collect()} == frequent(rows, 3, 3)
