"""URL filter: host and path rules, and a block list as a Bloom filter cascade.

The cascade answers exactly for every key of the universe it was built for, and
is looked up without a join. Level 1 is a Bloom filter of the listed keys; level
2 one of the universe's other keys that pass level 1; level 3 one of the listed
keys that pass level 2, and so on until no key passes by mistake. A key is listed
if the number of levels it passes in a row, from the first, is odd.

The universe is every host of the table with all its parent domains; a host is
listed if it or a parent domain is. Listed keys that the corpus never asks for
are encoded too, which is harmless.

Keys are dealt into shards by hash, so many that one shard's levels stay below
``shard_bytes``; shards are broadcast one after the other and each looks up its
own keys, so no broadcast grows with the list. Bits are set in Spark: rows of
(word, bit) merged by bit_or.

Null url, or one without ``://``: host and path are empty, no rule fits, and the
empty host is never listed. Repeated rows give repeated results; a list may hold
repeated, null and empty entries. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bnlake.llm.common import lower_ascii, staged

ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    """host and its subdomains, paths that start with path."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass
class Level:
    """One Bloom filter: bits in 64-bit words, probed at ``probes`` places."""

    bits: int
    probes: int
    words: np.ndarray


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(__u, instr(__u, '://') + 3)")).otherwise(F.lit(""))
    host = lower_ascii(F.regexp_extract(rest, r"\A([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return host, path


def parse_urls(pages: DataFrame) -> DataFrame:
    """(page_id, host, path)."""
    u = pages.select("page_id", F.coalesce("url", F.lit("")).alias("__u"))
    host, path = host_and_path(F.col("__u"))
    return u.select("page_id", host.alias("host"), path.alias("path"))


def best_rule(rules: Sequence[Rule]) -> Column:
    """(rule, verdict) of the longest rule that fits columns host and path; null if none."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def domains(host: Column) -> Column:
    """The host and its parent domains."""
    parts = F.split(host, r"\.")
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), ".")))


# -- places of a key: seed 2 * level and 2 * level + 1 give start and step
def _hash(key: Column, seed: int) -> Column:
    return F.xxhash64(F.concat(F.lit(f"{seed}|"), key))


def _places(key: Column, level: int, bits: int, probes: int) -> Column:
    start, step = F.pmod(_hash(key, 2 * level), F.lit(bits)), F.pmod(_hash(key, 2 * level + 1), F.lit(bits))
    return F.array(*[F.pmod(start + i * step, F.lit(bits)) for i in range(probes)])


def _hash_many(keys: list[str], seed: int, bits: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(f"{seed}|{k}", 42) for k in keys], np.uint64).view(np.int64) % bits


def passes(keys: list[str], number: int, level: Level) -> np.ndarray:
    start, step = _hash_many(keys, 2 * number, level.bits), _hash_many(keys, 2 * number + 1, level.bits)
    ok = np.ones(len(keys), bool)
    for i in range(level.probes):
        at = (start + i * step) % level.bits
        ok &= (level.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
    return ok


def _build_level(keys: DataFrame, number: int, count: int, rate: float) -> Level:
    """Bloom filter of the keys with the false positive rate; its words reach the driver."""
    bits = max(64, math.ceil(-count * math.log(rate) / math.log(2) ** 2 / 64) * 64)
    probes = max(1, round(bits / count * math.log(2)))
    at = keys.select(F.explode(_places(F.col("key"), number, bits, probes)).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at & 63 AS int))")).alias("bits"))
    out = np.zeros(bits // 64, np.uint64)
    for part in words.toArrow().to_batches():
        out[part.column(0).to_numpy()] = part.column(1).to_numpy().view(np.uint64)
    return Level(bits, probes, out)


def _passing(keys: DataFrame, number: int, level: Level) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(passes(b.column(0).to_pylist(), number, shared.value)))

    return keys.mapInArrow(run, "key string")


def build_cascade(universe: DataFrame, listed: DataFrame, first_rate: float = 0.05, rate: float = 0.5) -> list[Level]:
    """Levels for the keys of both tables (column key, no repeats)."""
    levels: list[Level] = []
    inside, outside = listed, universe.join(listed, "key", "left_anti")
    many = inside.count()
    while many:
        level = _build_level(inside, len(levels), many, rate if levels else first_rate)
        levels.append(level)
        # those of the other side that pass by mistake are encoded next
        wrong = staged(_passing(outside, len(levels) - 1, level), "bloom")
        inside, outside = wrong, inside
        many = wrong.count()
    return levels


def member(keys: list[str], levels: list[Level]) -> np.ndarray:
    depth = np.zeros(len(keys), int)
    live = np.arange(len(keys))
    for number, level in enumerate(levels):
        live = live[passes([keys[i] for i in live], number, level)]
        depth[live] += 1
    return depth % 2 == 1


def judge_urls(pages: DataFrame, rules: Sequence[Rule], listed: DataFrame, shard_bytes: int = 64 << 20) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) of each row: the longest
    rule's verdict, else block if the host is listed. The cascade is looked up in
    the row itself, whatever the number of rows of one host."""
    parsed = parse_urls(pages)
    own = staged(listed.select(lower_ascii(F.col("key").cast("string")).alias("key")).filter("key is not null and key <> ''").distinct(), "listed")
    universe = staged(parsed.select("host").distinct().select(F.explode(domains(F.col("host"))).alias("key")).distinct(), "universe")
    shards = max(1, math.ceil(own.count() * 2 / shard_bytes))
    rows = parsed.withColumn("listed", F.lit(False))
    for s in range(shards):
        shard = F.pmod(F.xxhash64("key"), F.lit(shards))
        rows = _mark(rows, build_cascade(universe.filter(shard == s), own.filter(shard == s)), s, shards)
    picked = rows.withColumn("r", best_rule(rules))
    return picked.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce(
        "r.verdict", F.when(F.col("listed"), F.lit(BLOCK)).otherwise(F.lit(ALLOW))).alias("verdict"), "listed")


def _mark(rows: DataFrame, levels: list[Level], number: int, shards: int) -> DataFrame:
    """listed also where a domain of the host is in this shard's cascade."""
    shared = rows.sparkSession.sparkContext.broadcast(levels)
    kind = rows.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts = b.column(1).to_pylist()
            names = {d for h in set(hosts) for d in _domains(h)}
            names = sorted(d for d in names if shards == 1 or _hash_plain(d) % shards == number)
            hit = {d for d, x in zip(names, member(names, shared.value)) if x}
            mark = [old or any(d in hit for d in _domains(h)) for h, old in zip(hosts, b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(mark, pa.bool_())], ["page_id", "host", "path", "listed"])

    return rows.mapInArrow(run, f"page_id {kind}, host string, path string, listed boolean")


def _domains(host: str) -> list[str]:
    parts = host.split(".")
    return [".".join(parts[i:]) for i in range(len(parts))] if host else []


def _hash_plain(key: str) -> int:
    h = xxhash.xxh64_intdigest(key, 42)
    return h - (1 << 64) if h >> 63 else h
