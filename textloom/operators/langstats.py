"""Counts, language mix and sentence statistics.

Every grouped count combines on the map side first, so a hot document,
source or sentence reaches the shuffle as one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.operators.joins import semi_kept_docs
from textloom.operators.ordering import first_n


def _count() -> Column:
    return F.count("*").alias("cnt")


def count_rows(df: DataFrame) -> DataFrame:
    return df.agg(_count())


def count_distinct_names(corp_doc: DataFrame) -> DataFrame:
    return corp_doc.agg(F.countDistinct("name").alias("cnt"))


def corpus_doc_counts(corp_doc: DataFrame) -> DataFrame:
    return corp_doc.groupBy("name").agg(F.count("name").alias("cnt"))


def single_doc_corpora(corp_doc: DataFrame) -> DataFrame:
    return corpus_doc_counts(corp_doc).filter(F.col("cnt") == 1).select("name")


def sents_per_doc(sent: DataFrame) -> DataFrame:
    return sent.groupBy("doc_id").agg(_count())


def doc_counts(doc: DataFrame, sent: DataFrame) -> DataFrame:
    """Sentences per document, zeros kept."""
    return doc.select("doc_id").join(sents_per_doc(sent), "doc_id", "left").select(
        "doc_id", F.coalesce("cnt", F.lit(0)).cast("bigint").alias("cnt")
    )


def scalar_subquery_counts(doc: DataFrame, sent: DataFrame, where: Column | None = None) -> DataFrame:
    """A correlated count per document, as one grouped conditional count."""
    cond = F.lit(True) if where is None else where
    n = sent.groupBy("doc_id").agg(F.count_if(cond).alias("cnt"))
    return doc.select("doc_id").join(n, "doc_id", "left").select(
        "doc_id", F.coalesce("cnt", F.lit(0)).cast("bigint").alias("cnt")
    )


def lang_dist_by_doc(sent: DataFrame) -> DataFrame:
    return sent.filter(F.col("lang").isNotNull()).groupBy("doc_id", "lang").agg(_count())


def no_lang_dist_by_doc(sent: DataFrame) -> DataFrame:
    return sent.filter(F.col("lang").isNull()).groupBy("doc_id").agg(_count())


def no_lang_report(corp_doc: DataFrame, no_lang: DataFrame) -> DataFrame:
    """Documents with undetected sentences and their corpus, most first."""
    return corp_doc.join(no_lang.filter("cnt > 0"), "doc_id").orderBy(F.desc("cnt"), "doc_id")


def lang_report(doc: DataFrame, lang_dist: DataFrame, target: str | None) -> DataFrame:
    """Per-document counts of one language (``None``: of a missing one)."""
    cond = F.col("lang").isNull() if target is None else F.col("lang") == target
    return (
        doc.select("doc_id", "file")
        .join(lang_dist.filter(cond), "doc_id")
        .orderBy("cnt", "doc_id")
        .select("file", "lang", "cnt")
    )


def doc_profile(sent: DataFrame, target: str) -> DataFrame:
    """All per-document statistics in one grouped pass."""
    is_target = F.col("lang") == target
    return (
        sent.groupBy("doc_id")
        .agg(
            F.count_if(is_target).alias("sq_cnt"),
            F.count_if(~is_target).alias("other_cnt"),
            F.count_if(F.col("lang").isNull()).alias("no_lang_cnt"),
            F.count("*").alias("tot_cnt"),
            F.sum(F.length("sent")).alias("_chars"),
            F.count("sent").alias("_n"),
            F.min(F.length("sent")).alias("min"),
        )
        .withColumn("sq_prop", F.col("sq_cnt").cast("double") / F.col("tot_cnt"))
        .withColumn("avg", F.col("_chars").cast("double") / F.nullif("_n", F.lit(0)))
        .drop("_chars", "_n")
    )


def lang_prop_by_doc(sent: DataFrame, target: str) -> DataFrame:
    """Language proportions of the documents with any target sentence."""
    return (
        doc_profile(sent, target)
        .filter(F.col("sq_cnt") > 0)
        .select("doc_id", "sq_cnt", "sq_prop", "other_cnt", "no_lang_cnt", "tot_cnt")
    )


def sent_stats_by_doc(sent: DataFrame) -> DataFrame:
    return sent.groupBy("doc_id").agg(
        F.avg(F.length("sent")).alias("avg"), F.min(F.length("sent")).alias("min")
    )


def lang_prop_report(doc: DataFrame, corp_doc: DataFrame, lang_prop: DataFrame) -> DataFrame:
    """Proportions with corpus names and a cross-check of the totals: target,
    other and undetected sentences must be all of them."""
    parts = F.col("sq_cnt") + F.col("other_cnt") + F.col("no_lang_cnt")
    return (
        lang_prop.join(doc.select("doc_id", "file"), "doc_id")
        .join(corp_doc.select("doc_id", "name"), "doc_id")
        .select(
            "doc_id", "name", "file", "sq_prop", "sq_cnt", "tot_cnt",
            (parts != F.col("tot_cnt")).alias("bad_cnt"),
        )
        .orderBy("sq_prop", "doc_id")
    )


def low_count_report(doc: DataFrame, corp_doc: DataFrame, lang_prop: DataFrame) -> DataFrame:
    """The same documents, smallest first."""
    return (
        lang_prop.join(doc.select("doc_id", "file"), "doc_id")
        .join(corp_doc.select("doc_id", "name"), "doc_id")
        .select("doc_id", "name", "file", "sq_cnt", "tot_cnt", "sq_prop")
        .orderBy("tot_cnt", "doc_id")
    )


def corpus_totals(
    corp_doc: DataFrame, lang_prop: DataFrame, cols: Sequence[str] = ("tot_cnt",)
) -> DataFrame:
    """Sums by corpus of each column, as (name, col, cnt), from one pass."""
    sums = (
        corp_doc.select("doc_id", "name")
        .join(lang_prop.select("doc_id", *cols), "doc_id")
        .groupBy("name")
        .agg(*[F.sum(c).alias(c) for c in cols])
    )
    return sums.unpivot(["name"], list(cols), "col", "cnt").orderBy("cnt", "name")


def corpus_avg_prop(corp_doc: DataFrame, corp_src: DataFrame, lang_prop: DataFrame) -> DataFrame:
    """Average proportion by corpus, lowest first; averaged before the join
    with the sources."""
    by_name = (
        corp_doc.select("doc_id", F.col("name").alias("id"))
        .join(lang_prop.select("doc_id", "sq_prop"), "doc_id")
        .groupBy("id")
        .agg(F.avg("sq_prop").alias("sq_prop_ave"))
    )
    return (
        by_name.join(corp_src, "id")
        .select("name", "url", "sq_prop_ave")
        .orderBy("sq_prop_ave", "name")
    )


def _long_foreign(sent: DataFrame, target: str, min_len: int) -> DataFrame:
    return (
        sent.filter((F.col("lang") != target) & (F.length("sent") > min_len))
        .groupBy("doc_id")
        .agg(_count())
    )


def top_foreign_docs(
    doc: DataFrame, sent: DataFrame, target: str, min_len: int = 50, k: int = 20
) -> DataFrame:
    """Documents with the most long foreign sentences."""
    out = _long_foreign(sent, target, min_len).join(doc.select("doc_id", "file"), "doc_id")
    return first_n(out.select("doc_id", "file", "cnt"), k, [("cnt", False), "doc_id"])


def having_foreign_gt(
    doc: DataFrame, corp_doc: DataFrame, sent: DataFrame, target: str,
    n: int = 20, k: int | None = 5, min_len: int = 50,
) -> DataFrame:
    """The first ``k`` documents with more than ``n`` long foreign sentences."""
    bad = _long_foreign(sent, target, min_len).filter(F.col("cnt") > n).select("doc_id")
    bad = semi_kept_docs(bad, corp_doc)
    if k is not None:
        bad = first_n(bad, k, ["doc_id"])
    docs = doc.select("doc_id", "file").join(corp_doc.select("doc_id", "name"), "doc_id")
    return semi_kept_docs(docs, bad).select("doc_id", "name", "file")


def doc_total(doc: DataFrame, sent: DataFrame, doc_id: int) -> DataFrame:
    n = sents_per_doc(sent.filter(F.col("doc_id") == doc_id))
    return doc.filter(F.col("doc_id") == doc_id).join(n, "doc_id").select("file", "cnt")


def lang_dist_one_doc(sent: DataFrame, doc_id: int) -> DataFrame:
    """Language histogram of one document; undetected sentences count 0, as a
    count of the language itself does."""
    return (
        sent.filter(F.col("doc_id") == doc_id)
        .groupBy("lang")
        .agg(F.count("lang").alias("cnt"))
        .orderBy(F.desc("cnt"), "lang")
    )


def lowest_prop_docs(lang_prop: DataFrame, k: int) -> DataFrame:
    return first_n(lang_prop.select("sq_prop", "doc_id"), k, ["sq_prop", "doc_id"]).select("doc_id")


def lang_dist_low_prop(sent: DataFrame, lang_prop: DataFrame, k: int = 10) -> DataFrame:
    return (
        semi_kept_docs(sent.filter(F.col("lang").isNotNull()), lowest_prop_docs(lang_prop, k))
        .groupBy("lang")
        .agg(_count())
        .orderBy("cnt", "lang")
    )


def bottom_k_docs(sent: DataFrame, lang_prop: DataFrame, k: int = 2) -> DataFrame:
    return semi_kept_docs(sent, lowest_prop_docs(lang_prop, k))


def dup_report(sent: DataFrame) -> DataFrame:
    return sent.groupBy("sent").agg(_count()).orderBy(F.desc("cnt"), "sent")


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


def sum_tokens_chars(sent: DataFrame) -> DataFrame:
    return sent.agg(
        F.sum("toklen").alias("tokens"), F.sum(F.length("sent")).alias("characters")
    )


def max_cast(doc: DataFrame) -> DataFrame:
    """Largest numeric directory id; other ids do not count."""
    return doc.agg(
        F.max(F.col("dir_id").try_cast("decimal(38,0)")).cast("bigint").alias("max_id")
    )


def fit_stop_words(labelled: DataFrame, k: int = 100) -> dict[str, list[str]]:
    """The ``k`` most frequent words of each language in (lang, sent) rows, for
    ``vote_lang``; ties go to the first word.

    Counts cover all rows; the rank limit also applies before the shuffle, and
    ``k`` words per language come to the driver.
    """
    words = labelled.filter("lang IS NOT NULL").select("lang", F.explode(F.split(F.lower("sent"), " ")).alias("word"))
    counts = words.filter(F.col("word").rlike(r"\p{L}")).groupBy("lang", "word").agg(_count())
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("cnt"), "word"))
    top: dict[str, list[str]] = {}
    for row in counts.withColumn("_rn", rank).filter(F.col("_rn") <= k).collect():
        top.setdefault(row["lang"], []).append(row["word"])
    return top
