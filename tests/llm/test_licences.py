"""Licence scans with runs against plain Python."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from bnlake.llm import licenses
from bnlake.llm.licence_library import full_texts

SMALL = (("A", "alpha beta gamma delta epsilon zeta eta theta"), ("A", "licensed under alpha"), ("B", "beta gamma licence of the kind"), ("C", "rights reserved"))


def brute(files, templates, threshold=0.8):
    """files: (path, text), paths unique: own (licence, how, score) of each."""
    terms = licenses._terms
    df = Counter(t for _, text in files for t in set(terms(text or "")))
    n = len(files)
    idf = lambda t: math.log((1 + n) / (1 + df[t])) + 1

    def vector(w):
        v = {t: c * idf(t) for t, c in Counter(w).items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()}

    sides = [(name, vector(terms(t)), len(terms(t))) for name, t in templates]
    out = {}
    for path, text in files:
        best = []

        def look(w, whole, some):
            v = vector(w)
            for name, side, _ in some:
                cos = round(sum(x * side.get(t, 0.0) for t, x in v.items()), 6)
                if cos >= threshold:
                    best.append((-cos, name, whole))

        lines = [terms(x) for x in (text or "").split("\n")] if text is not None else []
        flat, begin = [t for x in lines for t in x], 0
        for i, line in enumerate(lines):
            if line:
                look(line, 0, sides)
                for side in sides:
                    if set(line) & set(side[1]) and len(line) < side[2] and (side[2] <= licenses.LONG or i == 0 or not lines[i - 1]):
                        look(flat[begin:begin + side[2]], 0, [side])
            begin += len(line)
        if flat and "LICENSE" in path:
            look(flat, 1, sides)
        if best:
            score, name, whole = min(best)
            out[path] = (name, "file" if whole else "header", -score)
    return out


def test_runs_against_brute_force(spark):
    rnd = random.Random(9)
    words = sorted({w for _, t in SMALL for w in licenses._terms(t)}) + ["code", "x", "y"]
    files = [(f"d{i % 7}/{'LICENSE-' if i % 5 == 0 else ''}{i}", None if i == 3 else "".join(
        rnd.choice(words) + rnd.choice([" ", " ", "\n", "\n\n"]) for _ in range(rnd.randint(0, 25)))) for i in range(300)]
    files += [("d1/x1", SMALL[0][1].replace(" ", "\n", 3)), ("d2/x2", "code\n" + SMALL[0][1][:20] + "\n" + SMALL[0][1][20:] + "\ncode y"), ("d3/x3", "Rights\nReserved")]
    df = spark.createDataFrame([(p, t, 1, "w") for p, t in files], "path string, text string, unit int, w string").repartition(3)
    got = {r.path: (r.licence, r.how, r.score) for r in licenses.scan(df, SMALL, runs=True).filter("how in ('header', 'file')").collect()}
    want = brute(files, SMALL)
    assert got.keys() == want.keys() and len(got) > 10
    for path, (name, how, score) in want.items():
        assert got[path][1] == how and abs(got[path][2] - score) < 2e-6
        assert got[path][0] == name


def test_runs_of_a_long_file_stay_few(spark):
    """A full text between thousands of lines of code: few runs are cut out."""
    text = dict(full_texts())["GPL-3.0"]
    code = "".join(f"int value{i} = call{i}(the, program, {i});\n" for i in range(4000))
    lines = [licenses._terms(x) for x in (code + "\n" + text + "\n" + code).split("\n")]
    may = spark.createDataFrame([("f", code + "\n" + text + "\n" + code)], "file string, text string")
    df = Counter(t for w in lines for t in set(w))
    (vector,) = licenses.template_vectors([("GPL-3.0", text)], {t: math.log(2 / (1 + min(1, df[t]))) + 1 for t in licenses._terms(text)})
    sides = spark.createDataFrame([(t, 0, x) for t, x in vector.items()], "term string, template int, w double")
    lengths = spark.createDataFrame([(0, len(licenses._terms(text)))], "template int, terms int")
    pairs = spark.createDataFrame([("f", 0)], "file string, template int")
    runs = licenses.header_runs(may, pairs, F.broadcast(sides), F.broadcast(lengths), 0.8)
    cut = runs.select(F.count("*").alias("n"), F.sum(F.size("w")).alias("terms")).first()
    assert 1 <= cut.n <= 400


def test_ties_and_long_texts(spark):
    files = [("a/x", "one two"), ("a/y", ("word " * 200_000) + "\none two"), ("a/z", "")]
    got = {r.path: (r.licence, r.how) for r in licenses.scan(spark.createDataFrame(files, "path string, text string"), (("Z", "one two"), ("Y", "one two")), runs=True).collect()}
    assert got == {"a/x": ("Y", "header"), "a/y": ("Y", "header"), "a/z": (None, None)}
