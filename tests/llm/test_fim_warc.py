"""Fill-in-middle and WARC archives against plain Python."""

import base64
import gzip
import hashlib
import io
import random
import re

import pytest

from bnlake.llm import fim, warc

MARKS = fim.Sentinels().bytes


def brute_fim(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(text)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


def test_fim_rows(spark, odd_docs):
    rnd = random.Random(3)
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    rows += [(i, "".join(rnd.choice("a<>PSM é漢😀\n\0") for _ in range(rnd.randint(0, 30)))) for i in range(100, 500)]
    rows += [(600 + i, "ab" * (20_000 * i)) for i in range(3)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, output string, n int").repartition(4)
    out = fim.restore(fim.transform(df)).collect()
    got = sorted((str(r.doc_id), r.n, r.form, str(r.prefix_chars), str(r.middle_chars), r.output, r.restored) for r in out)
    want = []
    for doc_id, text in rows:
        n, form, a, m, o = brute_fim(doc_id, text)
        want.append((str(doc_id), n, form, str(a), str(m), o, text or ""))
    assert got == sorted(want)
    assert {r.form for r in out} == {"plain", "psm", "spm"}


def test_fim_empty_table_and_carry(spark, odd_docs):
    assert fim.restore(fim.transform(odd_docs.limit(0))).collect() == []
    out = fim.transform(odd_docs, carry=("lang", "key"))
    assert out.columns[-2:] == ["lang", "key"] and out.count() == odd_docs.count()


@pytest.mark.parametrize("form", ["psm", "spm"])
def test_fim_every_cut(form):
    raw = "a<é>P>M".encode()
    for a in range(len(raw) + 1):
        for b in range(a, len(raw) + 1):
            out = bytes(fim.arrange(raw, a, b, form, MARKS))
            pre, mid, suf = raw[:a], raw[a:b], raw[b:]
            assert out == (b"<P>" + pre + b"<S>" + suf if form == "psm" else b"<S>" + suf + b"<P>" + pre) + b"<M>" + mid
            assert fim.rebuild(out, form, MARKS) == raw


def test_fim_sentinels_are_checked():
    assert fim.Sentinels("<|pre|>", "<|suf|>", "<|mid|>")
    for bad in (("", "a", "b"), ("<P<", "<S>", "<M>"), ("<P>", "<P>x", "<M>")):
        with pytest.raises(ValueError):
            fim.Sentinels(*bad)


PAGES = [(1, "http://a.org/", "same"), (2, "http://b.org/", "same"), (3, "http://c.org/\r\nX: y", "other <p>é</p>"), (4, None, None), (5, "u", ""),
         (6, "http://d.org/", "same"), (None, "n1", "same"), (None, "n2", "only nulls"), (None, "n3", "only nulls"), (7, "x", "W" * 300_000),
         (8, "y", "WARC/1.1\r\n\r\n\x1f"), (9, "t", "twice"), (9, "t", "twice"), (3, "z", "twice")]


def expect(rows):
    top = {}
    for i, _, h in rows:
        if i is not None:
            top[h or ""] = max(i, top.get(h or "", i))
    out = []
    for i, _, h in rows:
        raw, latest = (h or "").encode(), top.get(h or "")
        back = latest is not None and i != latest
        out.append((str(i), len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if back else "response", str(latest if back else None)))
    return sorted(out)


def digest_rows(df):
    return sorted((str(r.page_id), r.payload_bytes, r.digest, r.type, str(r.refers_to)) for r in df.collect())


@pytest.fixture(scope="module")
def pages(spark):
    rnd = random.Random(5)
    rows = PAGES + [(100 + i, f"http://h{i}.org/", "".join(chr(rnd.randint(33, 0x2FF)) for _ in range(rnd.randint(0, 3000)))) for i in range(120)]
    rows += [(1000 + i, "hot", "hot payload") for i in range(60)]
    return rows, spark.createDataFrame([(*r, 1, "b") for r in rows], "page_id long, url string, html string, bytes int, path string").repartition(3)


@pytest.mark.parametrize("how", [{}, {"broadcast_rows": 0, "salts": 3}])
def test_warc_round_trip(spark, pages, how):
    rows, df = pages
    manifest = warc.write_archives(df, **how)
    for size in (1 << 20, 700):
        out = warc.read_archives(spark, manifest, range_bytes=size)
        assert digest_rows(out) == expect(rows)
    got = out.collect()
    assert all(r.intact for r in got if r.type == "response")
    assert sorted(r.payload.decode() for r in got if r.type == "response") == sorted(h or "" for i, _, h in rows if is_response(rows, i, h))
    urls = {r.page_id: r.url for r in got}
    assert urls[1] == "http://a.org/" and urls[4] is None
    assert {r.url for r in got if r.page_id == 3} == {"http://c.org/%0D%0AX:%20y", "z"}


def is_response(rows, page_id, html):
    ids = [i for i, _, h in rows if (h or "") == (html or "") and i is not None]
    return not ids or page_id == max(ids)


def test_warc_files_are_plain_gzip(spark, pages):
    rows, df = pages
    files = warc.write_archives(df).collect()
    assert sum(f.records for f in files) == len(rows)
    for f in files:
        raw = open(f.path.removeprefix("file:"), "rb").read()
        assert len(raw) == f.bytes
        text = gzip.decompress(raw)
        assert text.startswith(b"WARC/1.1\r\n") and text.count(b"WARC-Record-ID") == f.records


def test_warc_revisit_from(spark, pages):
    rows, df = pages
    out = warc.read_archives(spark, warc.write_archives(df, revisit_from=6)).collect()
    kinds = {r.page_id: r.type for r in out}
    assert kinds[1] == kinds[2] == "response" and kinds[1000] == "revisit" and kinds[1059] == "response"


def test_warc_empty_table(spark, pages):
    out = warc.read_archives(spark, warc.write_archives(pages[1].limit(0)))
    assert out.collect() == []


class Mem(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_warc_ranges_own_each_record_once():
    rnd = random.Random(1)
    parts = [warc.member(warc.record(i, "u", bytes(rnd.randrange(256) for _ in range(rnd.choice((0, 5, 9000)))), None, False, "d")) for i in range(30)]
    parts[4] = gzip.compress(b"not a record")
    parts[7] = parts[7][:-9] + b"\0" * 9
    parts.insert(12, warc.MAGIC + b"junk" + warc.MAGIC)
    data = b"".join(parts)
    for step in (97, 1000, 5000, len(data)):
        got = [warc.parse(r)["page_id"] for a in range(0, len(data), step) for r in warc.records_in(Mem(data), a, min(a + step, len(data)))]
        assert got == [i for i in range(30) if i not in (4, 7)]
