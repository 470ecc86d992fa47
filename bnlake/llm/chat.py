"""Chat formatting into prefix trees.

A conversation becomes turns ``<|im_start|>role\\n`` text ``<|im_end|>\\n``. In
roles and texts every ``<`` that backslashes and ``|`` follow gets one more
backslash, so no control string appears inside them, and reading back removes it.

Conversations that share their first turns share nodes: a tree's turns are
emitted once, depth-first, as one run of tokens. Each token carries its position
in its conversation and whether it is trained on (assistant text only); each
turn carries its parent and the intervals of the run that it may attend to: its
ancestors' turns and itself, up to the token. Tokens are byte-level BPE ids,
control strings are single ids above the vocabulary.

Equal conversations are one leaf. A tree is cut into packs of at most
``pack_chars`` characters (one conversation is never cut), in each of which
shared turns appear once; so a first turn that a third of all conversations
share is spread over many tasks. Conversations are dealt by the sorted hashes of
their turns, which keeps those with shared turns together.

Null text and null role are empty. Turns are ordered by turn, role and text;
repeated rows are turns of their own. A null conv_id is one conversation. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
ESCAPE, UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")
TRAINED = "assistant"


def escape(text: str) -> str:
    return ESCAPE.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"<\1|", text)


class Codec:
    """Token ids of a byte-level BPE vocabulary plus the two control ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        self.bpe = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.start = max(ranks.values()) + 1
        self.end = self.start + 1

    def turn(self, role: str, text: str) -> tuple[list[int], list[bool]]:
        """Tokens of a turn, and which of them are trained on."""
        head = [self.start, *self.bpe.encode_ordinary(escape(role) + "\n")]
        body = self.bpe.encode_ordinary(escape(text))
        tail = [self.end, *self.bpe.encode_ordinary("\n")]
        on = role == TRAINED
        return head + body + tail, [False] * len(head) + [on] * len(body) + [False] * len(tail)

    def text(self, ids: list[int]) -> str:
        """Formatted text of tokens."""
        out, plain = [], []
        for i in [*ids, None]:
            if i is None or i >= self.start:
                out.append(self.bpe.decode(plain))
                plain = []
                if i is not None:
                    out.append(START if i == self.start else END)
            else:
                plain.append(i)
        return "".join(out)


def load_ranks(path: str) -> dict[bytes, int]:
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_ready: dict[int, Codec] = {}


def _codec(shared) -> Codec:
    key = hash(shared.value[0])
    if key not in _ready:
        _ready[key] = Codec(*shared.value[1])
    return _ready[key]


def parse(formatted: str) -> list[tuple[str, str]]:
    """Turns (role, text) of a formatted conversation."""
    out = []
    for part in formatted.split(START)[1:]:
        role, _, rest = part.partition("\n")
        out.append((unescape(role), unescape(rest[:-len(END) - 1])))
    return out


class Pack:
    """A prefix tree being emitted depth-first."""

    def __init__(self):
        self.tokens: list[int] = []
        self.positions: list[int] = []
        self.trained: list[bool] = []
        self.nodes: list[dict] = []
        self.leaves: list[dict] = []
        self.open: list[tuple[tuple[str, str], int]] = []  # turns of the last conversation, with their nodes
        self.chars = 0

    def shared(self, turns: list[tuple[str, str]]) -> int:
        n = 0
        while n < min(len(turns), len(self.open)) and self.open[n][0] == turns[n]:
            n += 1
        return n

    def add(self, key: str, turns: list[tuple[str, str]], codec: Codec) -> None:
        del self.open[self.shared(turns):]
        for role, text in turns[len(self.open):]:
            up = self.nodes[self.open[-1][1]] if self.open else None
            ids, on = codec.turn(role, text)
            begin, first = len(self.tokens), up["depth"] if up else 0
            spans = [dict(s) for s in up["attends"]] if up else []
            if spans and spans[-1]["to"] == begin:
                spans[-1]["to"] = begin + len(ids)
            else:
                spans.append({"from": begin, "to": begin + len(ids)})
            self.nodes.append({"parent": self.open[-1][1] if up else -1, "begin": begin, "end": begin + len(ids),
                               "depth": first + len(ids), "attends": spans})
            self.tokens += ids
            self.positions += range(first, first + len(ids))
            self.trained += on
            self.open.append(((role, text), len(self.nodes) - 1))
            self.chars += len(role) + len(text)
        self.leaves.append({"key": key, "node": self.open[-1][1] if self.open else -1})


SPAN = "struct<from: long, to: long>"
NODE = f"struct<parent: int, begin: long, end: long, depth: long, attends: array<{SPAN}>>"
PACK = f"tokens array<int>, positions array<int>, trained array<boolean>, nodes array<{NODE}>, leaves array<struct<key: string, node: int>>"


def conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, key, turns): ordered turns, and a digest that names their content."""
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    turns = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return whole.select("conv_id", turns.alias("turns")).select("conv_id", F.sha2(F.to_json("turns").cast("binary"), 256).alias("key"), "turns")


def packs(convs: DataFrame, ranks: dict[bytes, int], pattern: str, pack_chars: int = 32_000) -> DataFrame:
    """One row for each pack. convs: (conv_id, key, turns)."""
    spark = convs.sparkSession
    name = hashlib.sha256(pattern.encode() + str(sorted(ranks.items())[:100]).encode()).hexdigest()
    shared = spark.sparkContext.broadcast((name, (ranks, pattern)))
    kinds = _schema(spark)
    different = convs.groupBy("key").agg(F.first("turns").alias("turns"))
    path = F.transform("turns", lambda x: F.xxhash64(x["role"], x["text"]))
    dealt = different.select("key", "turns", path.alias("path")).repartitionByRange("path").sortWithinPartitions("path", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, pack = _codec(shared), Pack()
        for b in batches:
            for key, turns in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                turns = [(t["role"], t["text"]) for t in turns]
                new = sum(len(r) + len(t) for r, t in turns[pack.shared(turns):])
                if pack.leaves and pack.chars + new > pack_chars:
                    yield _row(pack, kinds)
                    pack = Pack()
                pack.add(key, turns, codec)
        if pack.leaves:
            yield _row(pack, kinds)

    return dealt.select("key", "turns").mapInArrow(run, PACK)


def _schema(spark) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(PACK))


def _row(pack: Pack, kinds: pa.Schema) -> pa.RecordBatch:
    values = [pack.tokens, pack.positions, pack.trained, pack.nodes, pack.leaves]
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, kinds)], schema=kinds)


def read_back(found: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """(key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of
    every leaf, from the tokens that it attends to."""
    name = hashlib.sha256(pattern.encode() + str(sorted(ranks.items())[:100]).encode()).hexdigest()
    shared = found.sparkSession.sparkContext.broadcast((name, (ranks, pattern)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for b in batches:
            rows = []
            for tokens, trained, nodes, leaves in zip(*(b.column(i).to_pylist() for i in range(4))):
                for leaf in leaves:
                    spans = nodes[leaf["node"]]["attends"] if leaf["node"] >= 0 else []
                    ids = [t for s in spans for t in tokens[s["from"]:s["to"]]]
                    on = [t for s in spans for t in trained[s["from"]:s["to"]]]
                    formatted = codec.text(ids)
                    turns = parse(formatted)
                    told = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                    loss = "".join(map(unescape, _trained_texts(codec, ids, on)))
                    rows.append((leaf["key"], len(turns), told, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()])],
                ["key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return found.select("tokens", "trained", "nodes", "leaves").mapInArrow(
        run, "key string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _trained_texts(codec: Codec, ids: list[int], on: list[bool]) -> list[str]:
    """Texts of the runs of trained tokens."""
    out, run = [], []
    for i, x in zip([*ids, None], [*on, False]):
        if x:
            run.append(i)
        elif run:
            out.append(codec.text(run))
            run = []
    return out


def format_all(rows: DataFrame, ranks: dict[bytes, int], pattern: str, pack_chars: int = 32_000) -> DataFrame:
    """What read_back() finds, for each conv_id."""
    convs = conversations(rows)
    found = read_back(packs(convs, ranks, pattern, pack_chars), ranks, pattern)
    return convs.select("conv_id", "key").join(found, "key").drop("key")
