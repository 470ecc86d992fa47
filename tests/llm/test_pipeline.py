"""The pipeline's stages, each against plain Python on its own input, and the entry."""

import corpus_pipeline
from bnlake.llm import queries
from bnlake.llm.common import table
from tests.llm.test_dedup import brute_fingerprint, brute_roots, brute_substring, words
from tests.llm.test_native import brute_leaks, brute_quality
from bnlake.llm.quality import LineLimits


def test_stages_and_run(spark, sf, tmp_path):
    docs = table(spark, sf, "documents")
    before = [tuple(r) for r in docs.select(*corpus_pipeline.COLUMNS).collect()]
    results = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        results.append(docs)
        if i < 4:
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
    tables = [before] + [[tuple(r) for r in d.collect()] for d in results[:4]]
    # quality rules
    limits = LineLimits()
    verdicts = brute_quality([(r[0], r[1], r[3]) for r in tables[0]], limits)
    assert sorted(r[0] for r in tables[1]) == sorted(v[0] for v in verdicts if v[7])
    clean = {r[0]: r[1] for r in tables[0]}
    touched = {v[0] for v in verdicts if v[8]}
    assert all(r[1] == clean[r[0]] for r in tables[1] if r[0] not in touched)
    # SimHash: the smallest id of each component
    rows = sorted((r[0], r[1]) for r in tables[1])
    roots = brute_roots([brute_fingerprint(t) for _, t in rows], 4)
    assert sorted(r[0] for r in tables[2]) == sorted({rows[k][0] for k in roots})
    assert {r for r in tables[2]} <= set(tables[1])
    # substrings
    want = brute_substring([(r[0], r[1]) for r in tables[2]], 20)
    assert sorted(r[0] for r in tables[3]) == sorted(i for i, (n, gone, _) in want.items() if not n or gone < n)
    text = {r[0]: r[1] for r in tables[2]}
    for r in tables[3]:
        n, gone, _ = want[r[0]]
        assert len(words(r[1])) == n - gone and (gone or r[1] == text[r[0]])
    # benchmark
    items = [tuple(r) for r in table(spark, sf, "benchmark").select("item_id", "text").collect()]
    bad = {x[0] for x in brute_leaks([(r[0], r[1]) for r in tables[3]], items)}
    assert sorted(tables[4]) == sorted(r for r in tables[3] if r[0] not in bad)
    # tokens
    from sentencepiece import SentencePieceProcessor
    p = SentencePieceProcessor(model_file=queries.TOKENIZER)
    left = {r[0]: r[1] for r in tables[4]}
    last = results[4].collect()
    assert len(last) == len(left) and all(r.token_ids == p.encode(left[r.doc_id]) and r.round_trip for r in last)
    assert sorted(map(str, corpus_pipeline.run(spark, sf).collect())) == sorted(map(str, last))


def test_stages_on_nothing_and_odd_rows(spark, sf, odd_docs):
    odd = odd_docs.selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as long) as n_chars", "'x' as __n")
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            docs = spark.createDataFrame(stage(spark, docs, sf).collect(), stage(spark, docs, sf).schema)
    assert docs.count() == 0


def test_entry_registers_the_queries():
    import __spark_entry__ as e
    names = e.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in names} and "pipeline" in names
    assert set(queries.ORACLES) <= set(e.oracle_sql())
