"""A corpus pipeline of five stages; each reads the documents its predecessor kept and writes what it keeps.

Every function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of
``documents``; ``n_chars`` follows the text where a stage changes it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terravox.llm.byte_bpe import round_trip
from terravox.llm.decontaminate import contamination
from terravox.llm.jaccard import jaccard_groups
from terravox.llm.sentence_spans import without_repeats
from terravox.llm.toxicity import with_toxicity
from terravox.plans.storage import cut

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below one half stay, those without an id or a text too; repeated rows stay repeated, an empty
    table gives no rows, other columns are dropped. Texts are scored whole, whatever their length."""
    scored = with_toxicity(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where("predicted = 0").select(*COLUMNS)


def _row_id(doc_id: Column, text: Column) -> Column:
    """A name for a row that sorts by doc_id (null last) and tells rows of one doc_id apart by their text."""
    number = F.lpad((doc_id.cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0")
    return F.concat(F.coalesce(number, F.lit("null")), F.lit("-"), F.coalesce(F.md5(text.cast("binary")), F.lit("null")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents connected by links the one with the smallest id stays (null last; of rows of one id
    that of the least MD5 of the text), once, however often its id and text are repeated.

    Documents that share an id but nothing else are told apart, so none is lost. Null, empty and wordless texts are
    linked with nothing and stay, once for each id. An empty table gives no rows; other columns are dropped.
    """
    docs = docs.select(*COLUMNS, _row_id(F.col("doc_id"), F.col("text")).alias("row_id"))
    firsts = jaccard_groups(docs, id_column="row_id").where("doc_id = component_id").select(F.col("doc_id").alias("row_id")).distinct()
    return docs.join(firsts, "row_id", "left_semi").dropDuplicates(["row_id"]).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sentences covered by a run that occurred before leave the texts; every row stays, though its text may become empty.
    Null texts stay null, rows that agree in id and text are treated alike, an empty table gives no rows, other columns
    are dropped. Texts are read whole, whatever their length."""
    return without_repeats(docs.select(*COLUMNS), shifted=True).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; words of benchmark windows leave the texts of the others. Null and empty texts have no
    windows and stay, repeated rows are treated alike, an empty table or benchmark changes nothing, other columns are
    dropped. Texts are scanned whole, whatever their length."""
    clean = contamination(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), remove="both")
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every text that is left: one row for each, repeated ones too; null and empty texts have
    no tokens, an empty table gives no rows, other columns are dropped. Texts are encoded whole, whatever their length."""
    return round_trip(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).drop("text")


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole ``documents`` table, each from the written result of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't express the learned toxicity scores or the rank-table merges; tests hold each stage against brute force.
ORACLE_SQL = None
