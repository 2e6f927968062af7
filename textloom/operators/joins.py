"""Joins of the corpus tables.

Sentence counts are taken per document before any join, so a join moves one
row per document instead of all its sentences. Row-level joins leave the
choice of strategy and the splitting of skewed partitions to adaptive
execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.ordering import first_n


def _bounded(df: DataFrame, limit: int | None, order: list[str]) -> DataFrame:
    return df if limit is None else first_n(df, limit, order)


def join_doc_sent(
    doc: DataFrame, sent: DataFrame, where: Column | None = None, limit: int | None = None
) -> DataFrame:
    s = sent if where is None else sent.filter(where)
    out = s.join(doc, "doc_id").select("doc_id", "file", "six", "sid", "sent")
    return _bounded(out, limit, ["doc_id", "six"]).drop("six")


def join_source_url(corp_doc: DataFrame, corp_src: DataFrame) -> DataFrame:
    src = corp_src.select(F.col("id").alias("name"), "url")
    return corp_doc.join(src, "name").select("name", "file", "url").orderBy("name", "file")


def join_source_by_sid(
    corp_doc: DataFrame, corp_src: DataFrame, sent: DataFrame, source: str | None = None
) -> DataFrame:
    """Alternative key: the source's surrogate id, given as ``sid`` in
    ``corp_src``."""
    src = corp_src.select("sid", "id", F.col("name").alias("src_name"), "url")
    if source is not None:
        src = src.filter(F.col("id") == source)
    docs = corp_doc.join(src, "sid").select(
        "doc_id", "id", F.col("src_name").alias("name"), "url", "file"
    )
    return sent.join(docs, "doc_id").select("id", "name", "url", "file", "sent")


def docs_of_sources(
    corp_src: DataFrame, corp_doc: DataFrame, doc: DataFrame, source: str | None = None
) -> DataFrame:
    """Documents with their source, one row per document and source entry."""
    src = corp_src.select("id", F.col("name").alias("src_name"), "url")
    cd = corp_doc.select("doc_id", F.col("name").alias("id"), "file")
    if source is not None:
        src, cd = src.filter(F.col("id") == source), cd.filter(F.col("id") == source)
    return (
        cd.join(src, "id")
        .join(doc.select("doc_id"), "doc_id")
        .select("doc_id", "id", F.col("src_name").alias("name"), "url", "file")
    )


def join_star4(
    corp_src: DataFrame,
    corp_doc: DataFrame,
    doc: DataFrame,
    sent: DataFrame,
    source: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    docs = docs_of_sources(corp_src, corp_doc, doc, source)
    out = sent.join(docs, "doc_id").select("id", "name", "file", "doc_id", "six", "sent")
    return _bounded(out, limit, ["id", "doc_id", "six"]).drop("doc_id")


def count_star4(
    corp_src: DataFrame, corp_doc: DataFrame, doc: DataFrame, sent: DataFrame,
    source: str | None = None,
) -> DataFrame:
    """Sentences of one source (or all), counted per document before the join."""
    n = sent.groupBy("doc_id").agg(F.count("*").alias("_n"))
    docs = docs_of_sources(corp_src, corp_doc, doc, source)
    return docs.join(n, "doc_id").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("cnt"))


def join_doc_counts(doc: DataFrame, corp_doc: DataFrame, doc_counts: DataFrame) -> DataFrame:
    return (
        doc.join(corp_doc.select("doc_id", F.col("name").alias("corpus")), "doc_id")
        .join(doc_counts, "doc_id")
        .select("doc_id", "corpus", "file", "cnt")
        .orderBy("cnt", "doc_id")
    )


def theta_lang_mix(doc: DataFrame, profile: DataFrame) -> DataFrame:
    """Foreign-language sentences of the documents that have target ones.

    The inequality only compares with the constant target, so both counts are
    in the document profile.
    """
    mixed = profile.filter("sq_cnt > 0 and other_cnt > 0").select("doc_id", F.col("other_cnt").alias("cnt"))
    return mixed.join(doc, "doc_id").select("doc_id", "file", "cnt")


def lang_mismatch_sample(
    doc: DataFrame, sent: DataFrame, lang_dist: DataFrame, target: str, limit: int = 50
) -> DataFrame:
    """Sentences of documents with a single target sentence."""
    single = lang_dist.filter((F.col("lang") == target) & (F.col("cnt") == 1)).select(
        "doc_id", F.col("lang").alias("dist_lang"), "cnt"
    )
    out = (
        sent.join(single.join(doc.select("doc_id", "file"), "doc_id"), "doc_id")
        .select(
            "doc_id", "file", "dist_lang", F.col("lang").alias("sent_lang"), "cnt", "sent", "six"
        )
    )
    return first_n(out, limit, ["doc_id", "six"]).drop("six")


def anti_no_target(doc: DataFrame, profile: DataFrame) -> DataFrame:
    """Documents without any target sentence, with their sentence counts."""
    known = doc.join(profile.select("doc_id", "sq_cnt", "tot_cnt"), "doc_id", "left")
    return known.filter(F.coalesce("sq_cnt", F.lit(0)) == 0).select(
        "doc_id", "file", F.coalesce("tot_cnt", F.lit(0)).cast("bigint").alias("cnt")
    )


def semi_kept_docs(sent: DataFrame, keys: DataFrame) -> DataFrame:
    return sent.join(keys.select("doc_id"), "doc_id", "left_semi")


def anti_topn(sent: DataFrame, n: int = 500) -> DataFrame:
    """Without the first ``n`` rows in (sent, doc_id, six) order.

    The rows to drop end at one known row: everything behind it stays, so
    there is no join and the input is only compared with that row.
    """
    order = ["sent", "doc_id", "six"]
    if n <= 0:
        return sent
    last = first_n(sent.select(*order), n, order).agg(
        F.max(F.struct(*order)).alias("last")
    )
    # NULL on an empty input: nothing to keep either way.
    return sent.filter(F.struct(*order) > last.scalar())


def join_doc_keep(doc: DataFrame, corp_doc: DataFrame, profile: DataFrame) -> DataFrame:
    """Names and statistics of the documents with target sentences, largest
    documents first."""
    return (
        doc.select("doc_id", "file")
        .join(corp_doc.select("doc_id", "name"), "doc_id")
        .join(profile.filter("sq_cnt > 0"), "doc_id")
        .select("doc_id", "name", "file", "sq_cnt", "tot_cnt", "sq_prop", "avg", "min")
        .orderBy(F.desc("tot_cnt"), "doc_id")
    )


def join_sent_keep(sent: DataFrame, doc_keep: DataFrame, target: str) -> DataFrame:
    """Unquoted target-language sentences of the kept documents."""
    s = sent.filter((F.col("lang") == target) & ~F.col("sent").startswith('"'))
    return semi_kept_docs(s, doc_keep)


def apply_split_ids(df: DataFrame, split_ids: DataFrame, key: str) -> DataFrame:
    ids = split_ids.select(F.col("row_id").alias(key), "split")
    return df.join(ids, key)
