"""A corpus pipeline: five stages from raw documents to training tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bpe, decontaminate, language, line_dedup, near_dedup
from textloom.llm.catalog import TOKENIZER
from textloom.session import staged


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear, with ``lang`` set to it."""
    model = language.fit(docs)
    known = language.predict(docs, model).filter(~F.col("rejected"))
    return known.withColumn("lang", F.col("lang_pred")).select(docs.columns)


def _with_length(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text, where the table has it."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without lines of windows that occurred before."""
    return _with_length(line_dedup.dedup_lines(docs).select(docs.columns))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dedup.drop_near_duplicates(docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no passage of the benchmark."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the token ids; ``text`` is what the ids decode to."""
    coded = bpe.encode_decode(docs, TOKENIZER)
    return coded.select("doc_id", "lang", "source", F.col("decoded").alias("text"), "n_tokens", "ids")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", remove_repeated_lines),
    ("near_dedup", remove_near_duplicates),
    ("decontamination", remove_contaminated),
    ("bpe_codec", tokenise),
]

#: SQL cannot express the language, near-duplicate and token stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
