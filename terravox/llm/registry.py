"""Queries of the training-data operators over the driver's tables, and their DuckDB SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import functools
import uuid

from terravox.llm.byte_bpe import encode_texts, round_trip
from terravox.llm.chat import rotate_perspectives
from terravox.llm.decontaminate import contamination
from terravox.llm.fingerprints import version_fingerprints
from terravox.llm.html_text import main_text
from terravox.llm.jaccard import jaccard_groups
from terravox.llm.sentence_spans import without_repeats
from terravox.llm.sharding import shard_documents
from terravox.llm.toxicity import with_toxicity
from terravox.llm.training_order import materialise, record_digests
from terravox.plans.storage import shared_root

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Common table expressions of the link graph of a table or expression d(doc_id, text).
JACCARD_SQL = f"""
w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\t-\\r ]+'), lambda x: x <> '') AS w FROM d),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT o.a, o.b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b WHERE 100 * o.o >= 80 * (x.n + y.n - o.o)),
r AS (SELECT a AS doc_id, a AS c FROM l UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id),
c AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)"""


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of the shards of all documents, with the digest of every record as it stands in the files."""
    folder = f"{shared_root(spark)}/shards-{uuid.uuid4().hex}"
    encode = functools.partial(encode_texts, path=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN)
    manifest = materialise(_table(spark, sf_dir, "documents"), folder, length=2048, end=50256, pad=50257, key=20260101, per_shard=4096, ids_column="text", encode=encode)
    return manifest.join(record_digests(spark, folder, 2048, "<u2", 4096), "slot")


@query
def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate_perspectives(_table(spark, sf_dir, "conversations"))


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_toxicity(docs, _table(spark, sf_dir, "labels")).drop("text")


@query
def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(_table(spark, sf_dir, "documents"))


ORACLES["op5_ngram_jaccard_join"] = f"""WITH RECURSIVE d AS (SELECT * FROM documents), {JACCARD_SQL}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""


@query
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


#: Common table expressions of what is found in d(doc_id, text): p(doc_id, n_words, n_hit, items).
CONTAMINATION_SQL = f"""
dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM d),
iw AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 11))) AS i FROM iw WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
dwin AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k)),
f AS (SELECT DISTINCT doc_id, item_id, i, k FROM dwin JOIN win USING (k, s)),
h AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS j FROM f) GROUP BY doc_id),
it AS (SELECT doc_id, list_sort(list(DISTINCT item_id)) AS items FROM f GROUP BY doc_id),
p AS (SELECT dw.doc_id, len(dw.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(it.items, CAST([] AS VARCHAR[])) AS items FROM dw LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id))"""
ORACLES["op4_benchmark_decontamination"] = f"""WITH d AS (SELECT * FROM documents), {CONTAMINATION_SQL}
SELECT doc_id, n_words, n_hit, len(items) AS n_items, sha256(array_to_string(items, ',')) AS items_sha256, n_hit > 0 AND 20 * n_hit >= n_words AS contaminated FROM p"""


@query
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), shifted=True)


@query
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).drop("text")


@query
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"), shards=16).drop("text")


@query
def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return version_fingerprints(_table(spark, sf_dir, "documents"))

ORACLES["op2_chat_formatting"] = """WITH t AS (
  SELECT conv_id, turn, regexp_replace(replace(coalesce(role, 'unknown'), '<|', '< |'), '[\\r\\n]+', ' ', 'g') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
h AS (SELECT t.conv_id, p.perspective, t.turn, t.speaker, t.text,
    '<|im_start|>' || CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN speaker ELSE 'user name=' || speaker END || chr(10) AS head
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
r AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS rendered FROM h),
s AS (SELECT *, CAST(sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, speaker, text ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e FROM r)
SELECT conv_id, perspective, turn, CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN speaker ELSE 'user' END AS role,
  CASE WHEN speaker <> perspective AND speaker <> 'system' THEN speaker END AS name, e - length(rendered) AS start, e AS "end", rendered,
  CASE WHEN speaker = perspective THEN e - length(rendered) + length(head) ELSE e END AS mask_start,
  CASE WHEN speaker = perspective THEN e - length(rendered) + length(head) + length(text) + 10 ELSE e END AS mask_end FROM s"""


@query
def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
