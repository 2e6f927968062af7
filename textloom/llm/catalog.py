"""One query per operator over a folder of tables, and the SQL they match."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import arrays as ar
from textloom.llm import (
    ann,
    bpe,
    decontaminate,
    exact_dedup,
    language,
    line_dedup,
    near_dedup,
    pii,
    quality,
    resampling,
    scoring,
    token_count,
    whitening,
)

#: Key of the surrogates in the query; a deployment brings a secret one.
KEY = b"surrogates of the test tables"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, path: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def op1_pii_surrogates(spark: SparkSession, path: str) -> DataFrame:
    docs = _table(spark, path).select("doc_id", "text")
    return pii.pseudonymise(docs, KEY)


def op2_minhash_near_dedup(spark: SparkSession, path: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, path))


def op3_quality_rules(spark: SparkSession, path: str) -> DataFrame:
    train = ar.rest_of_crc(F.col("doc_id"), 5) != 0
    return quality.score(_table(spark, path), _table(spark, path, "labels"), train)


def op4_exact_dedup(spark: SparkSession, path: str) -> DataFrame:
    return exact_dedup.exact_copies(spark, f"{path}/documents.parquet")


def op5_line_dedup(spark: SparkSession, path: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, path).select("doc_id", "text"))


def op6_language_id(spark: SparkSession, path: str) -> DataFrame:
    docs = _table(spark, path)
    held_out = ar.rest_of_crc(F.col("doc_id"), 4) == 2
    model = language.fit(docs.filter(~held_out))
    return language.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected"
    )


def op7_token_counts(spark: SparkSession, path: str) -> DataFrame:
    return token_count.count_tokens(_table(spark, path), TOKENIZER).withColumn(
        "over_limit", F.col("n_tokens") > 512
    )


def op8_lm_scoring(spark: SparkSession, path: str) -> DataFrame:
    train = ar.rest_of_crc(F.col("doc_id"), 5) != 1
    return scoring.score(_table(spark, path).select("doc_id", "text", train.alias("train")))


def op9_decontamination(spark: SparkSession, path: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, path), _table(spark, path, "benchmark"))
    n_hit = decontaminate.n_hit(F.col("spans"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op10_bpe_codec(spark: SparkSession, path: str) -> DataFrame:
    docs = _table(spark, path).select("doc_id", "text")
    return bpe.encode_decode(docs, TOKENIZER, ids=False, digests=True).drop("text")


def op11_nearest_neighbours(spark: SparkSession, path: str) -> DataFrame:
    return ann.search(_table(spark, path, "embeddings"), F.col("vec_id") % 20 == 0)


def op12_importance_resampling(spark: SparkSession, path: str) -> DataFrame:
    return resampling.resample(_table(spark, path), _table(spark, path, "benchmark"))


def op13_embedding_whitening(spark: SparkSession, path: str) -> DataFrame:
    return whitening.whiten(_table(spark, path, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_pii_surrogates,
        op2_minhash_near_dedup,
        op3_quality_rules,
        op4_exact_dedup,
        op5_line_dedup,
        op6_language_id,
        op7_token_counts,
        op8_lm_scoring,
        op9_decontamination,
        op10_bpe_codec,
        op11_nearest_neighbours,
        op12_importance_resampling,
        op13_embedding_whitening,
    )
}

ORACLE = {
    "op4_exact_dedup": exact_dedup.oracle_sql(),
    "op5_line_dedup": line_dedup.oracle_sql(),
    "op9_decontamination": decontaminate.oracle_sql(),
    "op11_nearest_neighbours": ann.oracle_sql(),
}
