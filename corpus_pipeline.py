"""The corpus pipeline: quality rules, SimHash near-dedup, substring dedup,
benchmark decontamination, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bnlake.llm.common import staged, table
from bnlake.llm.decontam import decontaminate
from bnlake.llm.quality import filter_documents
from bnlake.llm.queries import TOKENIZER, piece_model
from bnlake.llm.sentencepiece import encode
from bnlake.llm.simhash import drop_near_duplicates
from bnlake.llm.substring import dedup_substrings

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without their hosts' frequent lines."""
    kept = filter_documents(docs.select(*COLUMNS))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of fingerprints within 4 bits, over 4-word shingles."""
    return drop_near_duplicates(docs.select(*COLUMNS), shingle=4, max_bits=4).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of windows of 20 that start earlier elsewhere;
    documents that lose all words go. A document that loses nothing keeps its text."""
    found = dedup_substrings(docs.select(*COLUMNS), window=20, carry=("text", "lang", "source", "n_chars"))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    left = found.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    return left.select("doc_id", text.alias("text"), "lang", "source", chars.alias("n_chars"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, token_ids and whether they decode to the text."""
    out = encode(docs, piece_model(TOKENIZER), carry=("doc_id", "lang", "source", "text"))
    same = F.col("decoded").eqNullSafe(F.translate("text", "▁", " "))
    return out.select("doc_id", "lang", "source", "n_tokens", "token_ids", same.alias("round_trip"))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece_encoding", sentencepiece_encoding),
]

#: SQL has no XXH64 fingerprints and no BPE; tests/llm/test_pipeline.py compares
#: run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is a Parquet table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
