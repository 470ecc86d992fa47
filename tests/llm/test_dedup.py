"""Substring dedup and SimHash against brute force."""

import hashlib
import random

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from bnlake.llm import simhash, substring
from bnlake.llm.common import table


def words(t):
    return (t or "").encode().split()


def brute_substring(rows, n):
    """rows: (id, text), ids unique."""
    first = {}
    for i, t in sorted(rows):
        w = words(t)
        for s in range(len(w) - n + 1):
            first.setdefault(tuple(w[s:s + n]), (i, s))
    out = {}
    for i, t in rows:
        w = words(t)
        gone = set()
        for s in range(len(w) - n + 1):
            if first[tuple(w[s:s + n])] < (i, s):
                gone.update(range(s, s + n))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def check_substring(spark, rows, n, gram=6):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.dedup_substrings(df, n, gram).collect()}
    assert got == brute_substring(rows, n)


def test_substring_on_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    check_substring(spark, rows, 20)


@pytest.mark.parametrize("seed,n,gram", [(0, 5, 2), (1, 4, 4), (2, 7, 3)])
def test_substring_few_words(spark, seed, n, gram, monkeypatch):
    rnd = random.Random(seed)
    rows = [(i, " ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 40)))) for i in range(40)]
    check_substring(spark, rows, n, gram)


def test_substring_overlap_in_one_text(spark):
    check_substring(spark, [(3, "a " * 50), (1, "a " * 21), (2, None), (4, "")], 20)


def test_substring_odd_rows(spark, odd_docs):
    got = substring.dedup_substrings(odd_docs, 20).collect()
    assert len(got) == odd_docs.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_words, r.n_removed))
    assert by[5] == [(2, 0), (2, 0)] and by[3] == [(0, 0)] and by[9] == [(0, 0)]
    assert sorted(by[None]) == [(0, 0), (60, 0)]  # a null id comes first
    assert by[1] == [(60, 60)] and by[8] == [(60, 60)]
    assert by[2] == [(70, 40)]
    assert by[7][0] == (9000, 6000)


def brute_rows(rows, n):
    """rows: (id, tie, text); windows of rows that share id and tie are the same places."""
    least = -(1 << 63)
    key = lambda i, t, s: (least if i is None else i, t, s)
    first = {}
    for i, t, x in rows:
        w = words(x)
        for s in range(len(w) - n + 1):
            g = tuple(w[s:s + n])
            first[g] = min(first.get(g, key(i, t, s)), key(i, t, s))
    out = []
    for i, t, x in rows:
        w = words(x)
        gone = {k for s in range(len(w) - n + 1) if first[tuple(w[s:s + n])] < key(i, t, s) for k in range(s, s + n)}
        out.append((str(i), len(w), len(gone), hashlib.sha256(b" ".join(v for k, v in enumerate(w) if k not in gone)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("few", [100, 0])
def test_substring_shared_and_null_ids(spark, monkeypatch, few):
    """Each row keeps its own words, however many share its id."""
    monkeypatch.setattr(substring, "BROADCAST_IDS", few)
    rnd = random.Random(4)
    line = lambda c, k: " ".join(f"{c}{j}" for j in range(k))
    rows = [(5, line("z", 50)), (5, line("y", 50)), (7, line("r", 30)), (7, line("q", 10) + " " + line("y", 30)), (None, line("u", 60)),
            (None, line("p", 40)), (None, line("p", 40) + " x"), (None, line("p", 40)), (5, line("z", 50))]
    rows += [(rnd.choice([None, 1, 2, 3, 90 + i]), " ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 50)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    shared = {i for i in {r[0] for r in rows} if sum(r[0] == i for r in rows) > 1}
    hashed = df.selectExpr("doc_id", "xxhash64(text) AS t", "text").collect()
    keyed = [(r.doc_id, r.t if r.doc_id in shared or not few else 0, r.text) for r in hashed]
    got = substring.dedup_substrings(df.repartition(5), 20).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_rows(keyed, 20)
    whole = {r.kept_sha256 for r in got if r.n_removed == 0}
    assert {hashlib.sha256(t.encode()).hexdigest() for t in (line("z", 50), line("u", 60), line("r", 30))} <= whole


def test_substring_intervals():
    assert substring.intervals([0, 3, 30], 10) == [(0, 13), (30, 40)]
    assert substring.intervals(None, 10) == []


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert substring.dedup_substrings(none).collect() == []
    assert simhash.near_duplicates(none).collect() == []
    assert simhash.drop_near_duplicates(none).collect() == []


def brute_fingerprint(t, k=4):
    w = [x.lower() for x in words(t)]
    if not w:
        return 0
    s = [b" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_roots(fps, bits):
    """fps: list of unsigned values; smallest index reachable of each."""
    v = np.array(fps, np.uint64)
    root = list(range(len(v)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v[i] ^ v) <= bits):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(v))]


def test_simhash_on_documents(spark, sf):
    docs = table(spark, sf, "documents")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    fps = [brute_fingerprint(t) for _, t in rows]
    roots = brute_roots(fps, 4)
    want = {i: (f"{f:016x}", rows[r][0]) for (i, _), f, r in zip(rows, fps, roots)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == want


@pytest.mark.parametrize("bits,limit", [(4, 20000), (4, 12), (3, 12), (1, 20000), (5, 20000)])
def test_links_of_clustered_fingerprints(spark, bits, limit):
    """Clusters around a few values, with and without the path for overfull keys."""
    rnd = random.Random(bits)
    fps = set()
    for _ in range(6):
        c = rnd.getrandbits(64)
        for _ in range(60 if limit > 100 else 30):
            x = c
            for b in rnd.sample(range(64), rnd.randint(0, 6)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {r.node: r.root for r in simhash.components(simhash.links(df, bits, limit)).collect()}
    groups, want = {}, {}
    for x in signed:
        groups.setdefault(got.get(x, x), set()).add(x)
    for x, r in zip(signed, brute_roots(fps, bits)):
        want.setdefault(r, set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_simhash_odd_rows(spark, odd_docs):
    got = simhash.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.fingerprint, r.component_id))
    assert by[3] == [("0" * 16, 3)] and by[4] == [("0" * 16, 3)] and ("0" * 16, 3) in by[None]
    assert {c for _, c in by[8] + by[1]} == {1}
    kept = simhash.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(i for i in ids if i is not None))
    assert {1, 3, 5}.issubset(ids) and 8 not in ids and 4 not in ids and None not in ids
