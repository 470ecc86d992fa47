"""Fill-in-middle transformation by block rotation in place.

A text is cut into prefix, middle and suffix at two places drawn from the
document's id. The sentinels go into a bytearray of the text at the cuts,
``P prefix M middle S suffix``; one rotation by three reversals then exchanges
two neighbouring blocks:

* psm, ``P prefix S suffix M middle``: the blocks ``M middle`` and ``S suffix``;
* spm, ``S suffix P prefix M middle``: the blocks ``P prefix M middle`` and ``S suffix``.

``restore`` finds the sentinels in the output, rotates back and takes them out.
A text that holds a sentinel stays plain, so each is found once.

Cuts count code points. Null and empty texts are plain, n = 0, with empty output.
Rows are independent of each other: rows that repeat an id get the same draws, a
null id draws as the empty string. Texts have no bound but memory; an empty table
gives an empty one. Columns other than doc_id and text are ignored unless carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from bnlake.llm.common import byte_texts


@dataclass(frozen=True)
class Sentinels:
    """Marks of the three parts. The first byte of a mark occurs nowhere else in the
    marks, so a mark never arises where a text and a mark meet."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        marks = self.bytes
        starts = {m[:1] for m in marks}
        if b"" in marks or any(m[i:i + 1] in starts for m in marks for i in range(1, len(m))):
            raise ValueError("a sentinel must not be empty, nor hold the first byte of one after its own")
        if any(a.startswith(b) for i, a in enumerate(marks) for j, b in enumerate(marks) if i != j):
            raise ValueError("no sentinel may begin with another")

    @property
    def bytes(self) -> tuple[bytes, bytes, bytes]:
        return self.prefix.encode(), self.suffix.encode(), self.middle.encode()


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four 32-bit draws of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i:i + 8], 16) for i in (0, 8, 16, 24)]


def rotate(buf: bytearray, lo: int, mid: int, hi: int) -> None:
    """Exchange the blocks [lo, mid) and [mid, hi) in place, by three reversals."""
    view = np.frombuffer(buf, np.uint8)
    for a, b in ((lo, mid), (mid, hi), (lo, hi)):
        view[a:b] = view[a:b][::-1]


def code_points(raw: bytes) -> np.ndarray:
    """Offsets where the code points of UTF-8 begin."""
    return np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)


def arrange(raw: bytes, first: int, second: int, form: str, marks: tuple[bytes, bytes, bytes]) -> bytearray:
    """The text with its parts, cut at two byte offsets, in the order of the form."""
    p, s, m = marks
    buf = bytearray(raw)
    buf[second:second] = s
    buf[first:first] = m
    buf[0:0] = p
    mid, suf = len(p) + first, len(p) + len(m) + second
    rotate(buf, mid if form == "psm" else 0, suf, len(buf))
    return buf


def rebuild(output: bytes, form: str, marks: tuple[bytes, bytes, bytes]) -> bytes:
    """The text from the output alone."""
    if form == "plain":
        return output
    p, s, m = marks
    buf = bytearray(output)
    lo, cut = (buf.find(s), buf.find(m)) if form == "psm" else (0, buf.find(p))
    rotate(buf, lo, cut, len(buf))
    suf = lo + len(buf) - cut
    mid = lo if form == "psm" else buf.find(m)
    del buf[suf:suf + len(s)]
    del buf[mid:mid + len(m)]
    del buf[:len(p)]
    return bytes(buf)


def _transform(seed: int, plain_from: int, spm_below: int, marks: tuple[bytes, bytes, bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_units, forms, prefixes, middles, outputs = [], [], [], [], []
            for doc_id, raw in zip(b.column(0).to_pylist(), byte_texts(b.column(1))):
                raw = raw or b""
                at = code_points(raw)
                n = len(at)
                h1, h2, h3, h4 = draws(seed, doc_id)
                form, cuts, out = "plain", (None, None), raw
                if n and h3 % 100 < plain_from and not any(x in raw for x in marks):
                    form = "spm" if h4 % 100 < spm_below else "psm"
                    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
                    cuts = (lo, hi - lo)
                    out = bytes(arrange(raw, *(int(at[i]) if i < n else len(raw) for i in (lo, hi)), form, marks))
                n_units.append(n)
                forms.append(form)
                prefixes.append(cuts[0])
                middles.append(cuts[1])
                outputs.append(out)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_units, pa.int64()), pa.array(forms, pa.string()), pa.array(prefixes, pa.int64()),
                 pa.array(middles, pa.int64()), pa.array(outputs, pa.binary()).cast(pa.string()),
                 *[b.column(i) for i in range(2, b.num_columns)]],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", *b.schema.names[2:]])

    return run


def _restore(marks: tuple[bytes, bytes, bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if o is None or f is None else rebuild(o, f, marks)
                     for o, f in zip(byte_texts(b.column("output")), b.column("form").to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.binary()).cast(pa.string())], [*b.schema.names, "restored"])

    return run


def _kinds(df: DataFrame, names) -> str:
    return "".join(f", `{c}` {df.schema[c].dataType.simpleString()}" for c in names)


def transform(docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20,
              sentinels: Sentinels = Sentinels(), carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) and the carried
    columns, one row for each row of docs (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", *carry).mapInArrow(
        _transform(seed, 100 - plain_percent, spm_percent, sentinels.bytes),
        f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string" + _kinds(docs, carry))


def restore(transformed: DataFrame, sentinels: Sentinels = Sentinels()) -> DataFrame:
    """All columns, with the text ``restored`` from output and form (null where either is)."""
    rows = transformed.drop("restored")
    return rows.mapInArrow(_restore(sentinels.bytes), _kinds(rows, rows.columns)[2:] + ", restored string")
