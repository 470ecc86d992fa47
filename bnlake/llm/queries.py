"""Queries of the training-data operators over the given tables, and their SQL."""

from __future__ import annotations

import importlib.util
import os
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bnlake.llm import chat, decontam, fim, html_extract, langid, licence_library, licenses, phrases, quality, sentencepiece, simhash, substring, url_filter, warc
from bnlake.llm.common import table, words


def _tokenizer_dir() -> str:
    found = importlib.util.find_spec("public_tokenizers")
    return os.path.dirname(found.origin) if found else "/opt/tokenizers"


#: The public SentencePiece model; another path can be passed to piece_model().
TOKENIZER = f"{_tokenizer_dir()}/piece_bpe_32k.model"
CHAT_TOKENIZER = f"{_tokenizer_dir()}/byte_bpe_50k.tiktoken"


@lru_cache(maxsize=2)
def piece_model(path: str) -> sentencepiece.Model:
    return sentencepiece.load_model(path)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded; ids_hash is Spark's xxhash64 of the ids."""
    docs = table(spark, sf_dir, "documents")
    out = sentencepiece.encode(docs, piece_model(TOKENIZER), carry=("doc_id", "text"))
    return out.select("doc_id", "n_tokens", F.xxhash64("token_ids").alias("ids_hash"),
                      F.col("decoded").eqNullSafe(F.translate("text", "▁", " ")).alias("round_trip"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


# The rules of the query, and the listed domains.
URL_RULES = (
    url_filter.Rule("org", "/", "allow"),
    url_filter.Rule("example.org", "/es/", "block"),
    url_filter.Rule("example.org", "/en/1", "block"),
    url_filter.Rule("com", "/fr/", "allow"),
    url_filter.Rule("com", "/de/", "block"),
)
LISTED_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED_DOMAINS = tuple(f"{n}.example.{t}" for n in LISTED_NAMES for t in ("com", "net", "org"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(d,) for d in LISTED_DOMAINS], "key string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES, listed)


@lru_cache(maxsize=2)
def chat_ranks(path: str) -> dict[bytes, int]:
    return chat.load_ranks(path)


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], rows.schema)
    return chat.format_all(rows.unionByName(extra), chat_ranks(CHAT_TOKENIZER), public_tokenizers.PATTERN)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.dedup_substrings(table(spark, sf_dir, "documents"), window=20)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files: two levels of directories below the source; a text of
    at most 40 words is its directory's licence file."""
    n_words = F.size(words(F.col("text")))
    folder = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.concat(F.lit("p"), F.floor(F.col("doc_id") / 50) % 20),
                         F.concat(F.lit("q"), F.col("doc_id") % 5))
    name = F.when(n_words <= 40, F.concat(F.lit("LICENSE-"), F.col("doc_id"))).otherwise(F.concat(F.col("doc_id"), F.lit(".txt")))
    return docs.select("doc_id", F.concat_ws("/", folder, name).alias("path"), "text")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(document_files(table(spark, sf_dir, "documents")), keep=("doc_id",), runs=True)
    return found.select("doc_id", "path", "licence", "how", "score")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return out.select("doc_id", "fingerprint", "component_id")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), max_words=3, min_count=10, inside_percent=50, top=2000)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back from them."""
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), revisit_from=0)
    return warc.read_archives(spark, manifest).select(
        "page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document transformed, and restored from the output."""
    out = fim.restore(fim.transform(table(spark, sf_dir, "documents"), seed=1, plain_percent=10, spm_percent=20))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2("restored", 256).alias("restored_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_language_id": op2_language_id,
    "op3_quality_rules": op3_quality_rules,
    "op4_html_extraction": op4_html_extraction,
    "op5_url_filter": op5_url_filter,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_license_scan": op8_license_scan,
    "op9_decontamination": op9_decontamination,
    "op10_simhash": op10_simhash,
    "op11_collocations": op11_collocations,
    "op12_warc": op12_warc,
    "op13_fill_in_middle": op13_fill_in_middle,
    "pipeline": pipeline,
}

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_TERMS = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda x: x <> '')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ORACLES = {
    "op3_quality_rules": rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, text AS raw, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
win AS (SELECT rid, i, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
rep AS (SELECT rid, g FROM win GROUP BY rid, g HAVING count(*) > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM win JOIN rep USING (rid, g), (SELECT unnest(range(5)) AS k) GROUP BY rid),
lines AS (
  SELECT rid, line, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS norm,
         len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM lines WHERE n > 0 GROUP BY rid),
freq AS (
  SELECT source, norm, count(DISTINCT raw) AS texts FROM lines JOIN d USING (rid) WHERE norm <> '' GROUP BY source, norm),
host AS (SELECT source, count(DISTINCT coalesce(raw, 'null')) AS of_texts FROM d GROUP BY source),
gone AS (
  SELECT l.rid, sum(l.n) AS n FROM lines l JOIN d USING (rid) JOIN freq f ON f.source IS NOT DISTINCT FROM d.source AND f.norm = l.norm
  JOIN host h ON h.source IS NOT DISTINCT FROM d.source
  WHERE f.texts >= 20 AND f.texts >= 0.01 * h.of_texts GROUP BY l.rid),
m AS (
  SELECT doc_id, len(w) AS n_words, len(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
         coalesce(cov.n, 0) AS n_repeat_words, cast(coalesce(gone.n, 0) AS bigint) AS n_line_words
  FROM d LEFT JOIN dup USING (rid) LEFT JOIN cov USING (rid) LEFT JOIN gone USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (n_line_words > 0.75 * n_words) AS kept,
       n_line_words, n_line_words > 0.75 * n_words AS depleted FROM m""",
    "op5_url_filter": rf"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rhost, rpath, says) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fit AS (
  SELECT page_id, host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(says, length(rhost || rpath)) AS says
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id, host, path),
l(d) AS (VALUES {", ".join(f"('{d}')" for d in LISTED_DOMAINS)}),
hit AS (SELECT DISTINCT host FROM p JOIN l ON host = d OR ends_with(host, '.' || d))
SELECT p.page_id, p.host, p.path, fit.rule, coalesce(fit.says, CASE WHEN hit.host IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
       hit.host IS NOT NULL AS listed
FROM p LEFT JOIN fit ON fit.page_id = p.page_id AND fit.host = p.host AND fit.path = p.path LEFT JOIN hit ON hit.host = p.host""",
    "op8_license_scan": rf"""
WITH t(tid, licence, body) AS (VALUES {", ".join(f"({i}, {_quoted(n)}, {_quoted(b)})" for i, (n, b) in enumerate(licence_library.library(licenses.TEMPLATES)))}),
tt AS (SELECT tid, licence, {_TERMS.format("body")} AS w FROM t),
te AS (SELECT tid, licence, term, count(*) AS tf FROM (SELECT tid, licence, unnest(w) AS term FROM tt) GROUP BY ALL),
d AS (
  SELECT doc_id, coalesce(text, '') AS text, concat_ws('/', coalesce(source, 'none'), 'p' || cast(floor(doc_id / 50) AS bigint) % 20, 'q' || doc_id % 5) AS folder,
         len({_WORDS}) <= 40 AS named FROM documents),
f AS (SELECT doc_id, text, {_TERMS.format("text")} AS w, folder, named, folder || '/' || CASE WHEN named THEN 'LICENSE-' || doc_id ELSE doc_id || '.txt' END AS path FROM d),
total AS (SELECT count(*) AS n FROM documents),
ft AS (SELECT doc_id, unnest(list_distinct(w)) AS term FROM f),
df AS (SELECT term, count(*) AS df FROM ft GROUP BY term),
idf AS (SELECT term, ln((1 + n) / (1 + coalesce(df, 0))) + 1 AS idf FROM (SELECT term FROM df UNION SELECT term FROM te) LEFT JOIN df USING (term), total),
tv AS (SELECT tid, licence, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY tid)) AS v FROM te JOIN idf USING (term)),
pair AS (SELECT doc_id, tid FROM ft JOIN tv USING (term) GROUP BY doc_id, tid HAVING sum(v * v) >= 0.64 - 1e-6),
line AS (
  SELECT doc_id, pos, {_TERMS.format("body")} AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) AS pos
        FROM f WHERE doc_id IN (SELECT doc_id FROM pair))),
placed AS (
  SELECT doc_id, pos, len(w) AS n, sum(len(w)) OVER o - len(w) AS begun, coalesce(lag(len(w)) OVER o, 0) = 0 AS opens
  FROM line WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
unit AS (
  SELECT doc_id, 0 AS whole, pos, -1 AS tpl, w FROM line WHERE len(w) > 0
  UNION ALL SELECT doc_id, 1, 0, -1, w FROM f WHERE named AND doc_id IN (SELECT doc_id FROM pair)
  UNION ALL SELECT doc_id, 0, pos, tid, f.w[begun + 1:begun + len(tt.w)]
  FROM (SELECT DISTINCT doc_id, pos, tid FROM (SELECT doc_id, pos, unnest(w) AS term FROM line) JOIN tv USING (term)) JOIN pair USING (doc_id, tid)
  JOIN placed p USING (doc_id, pos) JOIN tt USING (tid) JOIN f USING (doc_id) WHERE n < len(tt.w) AND (len(tt.w) <= {licenses.LONG} OR opens)),
x AS (
  SELECT doc_id, whole, pos, tpl, term, count(*) * any_value(idf) AS x
  FROM (SELECT doc_id, whole, pos, tpl, unnest(w) AS term FROM unit) JOIN idf USING (term) GROUP BY ALL),
size AS (SELECT doc_id, whole, pos, tpl, sqrt(sum(x * x)) AS size FROM x GROUP BY ALL),
dot AS (SELECT doc_id, whole, pos, tpl, tid, licence, sum(x * v) AS dot FROM x JOIN tv USING (term) WHERE tpl = -1 OR tpl = tid GROUP BY ALL),
s AS (SELECT doc_id, whole, licence, round(dot / size, 6) AS score FROM dot JOIN size USING (doc_id, whole, pos, tpl)),
own AS (
  SELECT doc_id, first(licence ORDER BY score DESC, licence, whole) AS own, first(score ORDER BY score DESC, licence, whole) AS own_score,
         first(whole ORDER BY score DESC, licence, whole) AS own_whole FROM s WHERE score >= 0.8 GROUP BY doc_id),
dirs AS (
  SELECT folder AS dir, first(own ORDER BY own_score DESC, own) AS licence, first(own_score ORDER BY own_score DESC, own) AS dscore
  FROM f JOIN own USING (doc_id) WHERE named GROUP BY folder),
near AS (
  SELECT a.folder, first(licence ORDER BY len(dir) DESC) AS up, first(dscore ORDER BY len(dir) DESC) AS up_score
  FROM (SELECT DISTINCT folder FROM f) a JOIN dirs ON a.folder = dir OR starts_with(a.folder, dir || '/') GROUP BY a.folder)
SELECT doc_id, path, coalesce(own, up) AS licence,
       CASE WHEN own IS NOT NULL THEN CASE WHEN own_whole = 1 THEN 'file' ELSE 'header' END WHEN up IS NOT NULL THEN 'inherited' END AS how,
       coalesce(own_score, up_score) AS score
FROM f LEFT JOIN own USING (doc_id) LEFT JOIN near USING (folder)""",
    "op9_decontamination": r"""
WITH toks AS (
  SELECT 'd' AS side, doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') FROM benchmark),
isz AS (SELECT DISTINCT least(len(w), 5) AS n FROM toks WHERE side = 'i' AND len(w) > 0),
sh AS (
  SELECT DISTINCT side, id, n, array_to_string(w[i:i+n-1], ' ') AS g FROM (
    SELECT side, id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM toks, isz
    WHERE len(w) >= n AND (side = 'd' OR n = least(len(w), 5)))),
items AS (SELECT id AS item_id, n, g, count(*) OVER (PARTITION BY id) AS n_shingles FROM sh WHERE side = 'i')
SELECT sh.id AS doc_id, item_id, n_shingles, count(*) AS n_found, count(*) / n_shingles AS containment
FROM sh JOIN items USING (n, g) WHERE side = 'd' GROUP BY sh.id, item_id, n_shingles HAVING count(*) >= round(0.8 * n_shingles, 6)""",
    "op11_collocations": r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ 	]+'), lambda x: x <> '') AS w FROM p),
g AS (
  SELECT lang, len(v) AS words, array_to_string(v, ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS v FROM w, (VALUES (1), (2), (3)) t(k) WHERE len(w) >= k)
  GROUP BY ALL),
total AS (SELECT lang, cast(sum(f) AS bigint) AS n FROM g WHERE words = 1 GROUP BY lang),
c AS (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS v FROM g WHERE words > 1 AND f >= 10),
cut AS (
  SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r, cast((cast(a AS hugeint) * a * 1000000) // (cast(x.f AS hugeint) * y.f) AS bigint) AS score
  FROM (SELECT *, unnest(range(1, words)) AS k FROM c) c
  JOIN g x ON x.lang = c.lang AND x.phrase = array_to_string(v[1:k], ' ') JOIN g y ON y.lang = c.lang AND y.phrase = array_to_string(v[k + 1:], ' ')),
s AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, part, max(a) AS most FROM (SELECT lang, a, unnest([array_to_string(v[1:2], ' '), array_to_string(v[2:3], ' ')]) AS part FROM c WHERE words = 3)
  GROUP BY lang, part)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM s JOIN total USING (lang) LEFT JOIN longer ON longer.lang = s.lang AND part = phrase
WHERE most IS NULL OR 100 * most < 50 * a QUALIFY rank <= 2000""",
    "op12_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
last AS (SELECT body, max(page_id) AS latest FROM p GROUP BY body)
SELECT page_id, cast(strlen(body) AS bigint) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + cast((cast('0x' || substr(h, cast(5 * (i // 4) + 1 AS bigint), 5) AS bigint) >> cast(15 - 5 * (i % 4) AS bigint)) & 31 AS bigint), 1)), '') AS payload_digest,
       CASE WHEN page_id = latest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> latest THEN latest END AS refers_to
FROM p JOIN last USING (body)""",
    "op13_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(cast(doc_id AS varchar), '')) AS h FROM documents),
x AS (
  SELECT doc_id, t, n, cast('0x' || substr(h, 1, 8) AS bigint) % (n + 1) AS c1, cast('0x' || substr(h, 9, 8) AS bigint) % (n + 1) AS c2,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR cast('0x' || substr(h, 17, 8) AS bigint) % 100 >= 90 THEN 'plain'
              WHEN cast('0x' || substr(h, 25, 8) AS bigint) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
y AS (SELECT *, substr(t, 1, least(c1, c2)) AS pre, substr(t, least(c1, c2) + 1, greatest(c1, c2) - least(c1, c2)) AS mid, substr(t, greatest(c1, c2) + 1) AS suf FROM x)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(c1, c2) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN greatest(c1, c2) - least(c1, c2) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM y""",
}
