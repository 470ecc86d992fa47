"""Quality rules, licence scans and decontamination: edges, and agreement with plain Python."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from bnlake.llm import decontam, licenses, quality
from bnlake.llm.licence_library import HEADERS, full_texts

LIMITS = quality.LineLimits(min_texts=3, min_share=0.0, max_removed=0.5)


def split(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]


def brute_quality(rows, limits):
    """rows: (id, text, host); the tuple of measures for each row."""
    norm = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x).strip(" ").lower()
    holders, hosts = defaultdict(set), defaultdict(set)
    for _, t, h in rows:
        hosts[h].add(t)
        for x in (t or "").split("\n"):
            if norm(x):
                holders[h, norm(x)].add(t)
    out = []
    for i, t, h in rows:
        w, lines = split(t), (t or "").split("\n")
        grams = [tuple(w[k:k + 5]) for k in range(len(w) - 4)]
        n = Counter(grams)
        rep = {k + j for k, g in enumerate(grams) if n[g] > 1 for j in range(5)}
        full = [x for x in lines if split(x)]
        gone = sum(len(split(x)) for x in lines if norm(x) and len(holders[h, norm(x)]) >= max(limits.min_texts, limits.min_share * len(hosts[h])))
        failed = len(w) < 10 or 100 * len(rep) > 20 * len(w)
        out.append((i, len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(full) - len(set(full)), len(rep),
                    failed, not failed and gone <= limits.max_removed * len(w), gone))
    return out


def measured(df, limits):
    return [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, r.n_line_words)
            for r in quality.judge(df, limits=limits).collect()]


def order(rows):
    return sorted(rows, key=str)


def test_quality_on_random_texts(spark):
    rnd = random.Random(1)
    lines = [" ".join(rnd.choice(["a", "b", "C", "d#", "é<"]) for _ in range(rnd.randint(0, 12))) for _ in range(25)]
    rows = [(i, "\n".join(rnd.choice(lines) for _ in range(rnd.randint(0, 9))), rnd.choice(["h1", "h2", None])) for i in range(120)]
    rows += rows[:7]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    assert order(measured(df, LIMITS)) == order(brute_quality(rows, LIMITS))


def test_quality_odd_rows(spark, odd_docs):
    rows = [(r.doc_id, r.text, r.source) for r in odd_docs.collect()]
    assert order(measured(odd_docs, LIMITS)) == order(brute_quality(rows, LIMITS))
    assert quality.judge(odd_docs.limit(0)).collect() == []
    kept = quality.filter_documents(odd_docs, limits=LIMITS)
    assert kept.columns == odd_docs.columns
    good = [r[0] for r in brute_quality(rows, LIMITS) if r[7]]
    assert order([r.doc_id for r in kept.collect()]) == order(good)
    assert quality.judge(odd_docs).filter("kept and n_words > 3").count() <= odd_docs.count()


def test_frequent_lines_are_cut(spark):
    own = " ".join(f"own{k}" for k in range(15))
    rows = [(i, f"Menu  HOME\n{own} {i}\nmenu home", "h") for i in range(5)] + [(9, "menu home " * 9, "h"), (10, f"menu home\n{own} x", "other")]
    rows += [(20 + i, "\n".join(["menu home"] * 12) + f"\nlast {i}", "h") for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in quality.filter_documents(df, limits=LIMITS).collect()}
    assert got == {**{i: f"{own} {i}" for i in range(5)}, 10: f"menu home\n{own} x"}


def brute_leaks(docs, items, threshold=0.8, n=5):
    toks = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = lambda w, k: {" ".join(w[i:i + k]) for i in range(len(w) - k + 1)}
    out = set()
    for j, it in items:
        w = toks(it)
        k = min(n, len(w))
        want = grams(w, k) if k else set()
        for i, t in docs:
            hit = len(want & grams(toks(t), k)) if want else 0
            if want and hit >= round(threshold * len(want), 6):
                out.add((i, j, len(want), hit))
    return out


@pytest.mark.parametrize("rows", [1_000_000, 0])
def test_leaks(spark, rows):
    rnd = random.Random(2)
    text = lambda k: " ".join(rnd.choice("abcdefgh") + rnd.choice("xyz") for _ in range(k))
    items = [(j, text(rnd.randint(1, 40))) for j in range(25)] + [(90, None), (91, ""), (92, "One, two!"), (92, "One, two!")]
    docs = []
    for i in range(60):
        t = text(rnd.randint(0, 60)).split()
        for _, it in rnd.sample(items[:25], 2):
            w = it.split()
            if rnd.random() < 0.5:
                w[rnd.randrange(len(w))] = "zz"
            at = rnd.randint(0, len(t))
            t[at:at] = w
        docs.append((i, " ".join(t).upper()))
    docs += [(70, None), (71, ""), (72, "well one -- two."), (72, "well one -- two.")]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, n int")
    b = spark.createDataFrame([(*r, 2) for r in items], "item_id long, text string, h int")
    got = decontam.leaks(d, b, broadcast_rows=rows).collect()
    assert {(r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in got} == brute_leaks(docs, items)
    assert len(got) == len(brute_leaks(docs, items))
    left = decontam.decontaminate(d, b)
    bad = {x[0] for x in brute_leaks(docs, items)}
    assert sorted(r.doc_id for r in left.collect()) == sorted(i for i, _ in docs if i not in bad)


def test_leaks_of_nothing(spark, odd_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.leaks(odd_docs, none).collect() == []
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(30)))], "item_id long, text string")
    assert decontam.leaks(odd_docs.limit(0), items).collect() == []
    left = [r.doc_id for r in decontam.decontaminate(odd_docs, items).collect()]
    assert sorted(map(str, left)) == sorted(map(str, [2, 3, 4, 5, 5, 7, None, 9, 10, 11]))


def test_licences(spark):
    apache, mit = "Licensed under the Apache License, Version 2.0", "Released under the MIT License."
    files = [("r/LICENSE", f"some words first\n{apache}"), ("r/a.py", "code of ours"), ("r/sub/b.py", "x"), ("r/sub/LICENSE.txt", mit),
             ("r/sub/deep/c.py", "y"), ("r/d.py", f"# {mit}\ncode"), ("other/e.py", None), (None, mit), ("LICENSE", ""), ("r2/COPYING", "nothing here"),
             ("r2/f.py", "the the the the"), ("r/d.py", f"# {mit}\ncode"), ("r/subx/g.py", "z"), ("top.py", "q")]
    df = spark.createDataFrame([(*f, 3) for f in files], "path string, text string, score int")
    got = Counter((r.path, r.licence, r.how) for r in licenses.scan(df).collect())
    assert got == Counter([
        ("r/LICENSE", "Apache-2.0", "header"), ("r/a.py", "Apache-2.0", "inherited"), ("r/sub/b.py", "MIT", "inherited"),
        ("r/sub/LICENSE.txt", "MIT", "header"), ("r/sub/deep/c.py", "MIT", "inherited"), ("r/d.py", "MIT", "header"), ("r/d.py", "MIT", "header"),
        ("other/e.py", None, None), (None, "MIT", "header"), ("LICENSE", None, None), ("r2/COPYING", None, None), ("r2/f.py", None, None),
        ("r/subx/g.py", "Apache-2.0", "inherited"), ("top.py", None, None)])
    assert licenses.scan(df.limit(0)).collect() == []


def test_whole_licence_file(spark):
    text = "Licensed under the\nApache License,\nVersion 2.0."
    df = spark.createDataFrame([("p/LICENSE", text), ("p/x.py", text)], "path string, text string")
    got = {r.path: (r.licence, r.how) for r in licenses.scan(df).collect()}
    assert got == {"p/LICENSE": ("Apache-2.0", "file"), "p/x.py": ("Apache-2.0", "inherited")}


def test_real_licence_files_and_headers(spark):
    full = dict(full_texts())
    mit = "Copyright (c) 2021 Some One\n\n" + full["MIT"]
    apache = next(t for n, t in HEADERS if n == "Apache-2.0")
    header = "\n".join(f"# {x}" for x in ["Copyright 2020 Some Authors", "", *apache.split("\n")]) + "\nimport os\nprint(os.sep)"
    gnu = next(t for n, t in licenses.library(()) if n == "GPL-2.0" and "either version 2 " in t)
    files = [("a/LICENSE", mit), ("b/LICENSE.txt", "Copyright Some One. All rights reserved.\n" + full["BSD-3-Clause"]), ("c/COPYING", full["GPL-3.0"]),
             ("d/LICENSE", full["Apache-2.0"]), ("e/x.py", header), ("f/y.c", "/*\n" + gnu.replace("\n", "\n * ") + "\n */\nint a;"),
             ("g/z.txt", "some words\nLicensed under CC BY-NC 4.0.\nother words"), ("h/w.js", "// SPDX-License-Identifier: MPL-2.0\nlet a"),
             ("i/v.c", "\n".join(["int a;", *mit.split("\n"), "int b;"])), ("j/u.c", "int a;\nint b;")]
    got = {r.path: (r.licence, r.how) for r in licenses.scan(spark.createDataFrame(files, "path string, text string"), runs=True).collect()}
    assert {p: x for p, (x, _) in got.items()} == {
        "a/LICENSE": "MIT", "b/LICENSE.txt": "BSD-3-Clause", "c/COPYING": "GPL-3.0", "d/LICENSE": "Apache-2.0", "e/x.py": "Apache-2.0", "f/y.c": "GPL-2.0",
        "g/z.txt": "CC-BY-NC-4.0", "h/w.js": "MPL-2.0", "i/v.c": "MIT", "j/u.c": None}
    assert {got[p][1] for p in ("e/x.py", "f/y.c", "g/z.txt", "i/v.c")} == {"header"}


def test_common_words_weigh_little(spark):
    line = "Released under the MIT License. en"
    files = [(f"d/{i}.txt", "en and on be") for i in range(300)] + [(f"m/{i}.txt", "Released under the MIT License.") for i in range(3)]
    df = spark.createDataFrame([*files, ("x.txt", line)], "path string, text string")
    row = licenses.scan(df, templates=licenses.TEMPLATES).filter("path = 'x.txt'").first()
    # by hand: N 304, df of en 301, of the line's other terms 4
    rare, often = math.log(305 / 5) + 1, math.log(305 / 302) + 1
    assert (row.licence, row.how) == ("MIT", "header")
    assert abs(row.score - (5 * rare * rare) / (math.sqrt(5) * rare * math.sqrt(5 * rare * rare + often * often))) < 1e-5


def test_leaks_without_ids(spark):
    said = " ".join(f"w{i}" for i in range(30))
    other = " ".join(f"v{i}" for i in range(30))
    docs = spark.createDataFrame([(None, f"a b {said} c"), (1, f"d {other}"), (None, "x y z"), (2, f"{said} e")], "doc_id long, text string")
    items = spark.createDataFrame([(7, said), (None, other)], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_found) for r in decontam.leaks(docs, items).collect()}
    assert got == {(None, 7, 26), (2, 7, 26), (1, None, 26)}
    assert [r.text for r in decontam.decontaminate(docs, items).collect()] == ["x y z"]
