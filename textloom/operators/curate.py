"""Curation: kept documents, kept sentences, clean-up, exact dedup."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions import text as fx
from textloom.operators import filters as fl
from textloom.operators.joins import anti_topn, join_sent_keep
from textloom.operators.langstats import doc_profile
from textloom.session import staged


@dataclass(frozen=True)
class CurateParams:
    """Default values of the curation steps.

    ``drop_first`` removes that many sentences in text order, a decision to be
    taken for a corpus at hand.
    """

    min_cnt: int = 50
    min_prop: float = 0.95
    min_avg: float = 30
    exclude_sources: Sequence[str] = fl.EXCLUDED_SOURCES
    lo_tokens: int = 5
    hi_tokens: int = 450
    drop_first: int = 0
    min_chars: int = 10
    safe_tags: bool = False


def doc_keep(doc: DataFrame, corp_doc: DataFrame, sent: DataFrame, target: str, params: CurateParams) -> DataFrame:
    """Documents within the quality bounds.

    Language proportions and sentence statistics come from one grouped pass,
    and the bounds cut the documents before they are joined.
    """
    good = fl.filter_doc_quality(
        doc_profile(sent, target).filter(F.col("sq_cnt") > 0),
        params.min_cnt, params.min_prop, params.min_avg,
    )
    names = fl.filter_sources(corp_doc.select("doc_id", "name"), params.exclude_sources)
    return (
        good.join(names, "doc_id")
        .join(doc.select("doc_id", "file"), "doc_id")
        .select("doc_id", "name", "file", "sq_cnt", "tot_cnt", "sq_prop", "avg", "min")
    )


def clean_text(sent: DataFrame, safe_tags: bool = False) -> DataFrame:
    """Leading digits, then the ordered trims, in one projection."""
    col = fx.strip_digits("sent")
    if safe_tags:
        head = [s for s in fx.TRIM_SETS if not s.startswith("<")][:-1]
        col = fx.trim_chain(fx.strip_tags(fx.trim_chain(col, head)), [" "])
    else:
        col = fx.trim_chain(col)
    return sent.withColumn("sent", col)


def clean_sents(sent_keep: DataFrame, params: CurateParams) -> DataFrame:
    """Everything between the kept sentences and the deduplication.

    Token counts are those before the trims.
    """
    s = fl.filter_toklen(sent_keep, params.lo_tokens, params.hi_tokens)
    s = clean_text(fl.filter_garbage(s), params.safe_tags)
    if params.drop_first > 0:
        # Read twice: for the last row to drop, and for the rows behind it.
        s = anti_topn(staged(s, "cleaned"), params.drop_first)
    return s.filter(F.length("sent") >= params.min_chars)


def dedup_exact(sent: DataFrame) -> DataFrame:
    """The row with the lowest (doc_id, six) of each sentence.

    ``min_by`` combines on the map side, so copies of a hot sentence shuffle
    once per task, and each survivor travels with its row: no join back.
    """
    others = [c for c in sent.columns if c != "sent"]
    key = F.struct("doc_id", "six")
    best = sent.groupBy("sent").agg(F.min_by(F.struct(*others), key).alias("_row"))
    return best.select("_row.*", "sent").select(*sent.columns)


def dedup_rank(sent: DataFrame) -> DataFrame:
    """The same survivors by rank; the rank limit also applies before the
    shuffle."""
    w = W.partitionBy("sent").orderBy("doc_id", "six")
    return sent.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def final_sent(sent_keep: DataFrame) -> DataFrame:
    return sent_keep.select("doc_id", "six", "sid", "sent", "spans", "toklen")


def insert_select(
    sent_keep: DataFrame, sent: DataFrame, corp_doc: DataFrame, source: str, target: str
) -> DataFrame:
    """Kept sentences plus the target-language sentences of one source."""
    docs = corp_doc.filter(F.col("name") == source).select("doc_id")
    more = sent.filter(F.col("lang") == target).join(docs, "doc_id", "left_semi")
    return sent_keep.unionByName(more.select(*sent_keep.columns))


def curate(
    doc: DataFrame, corp_doc: DataFrame, sent: DataFrame, target: str,
    params: CurateParams = CurateParams(),
) -> DataFrame:
    """The whole chain: one doc-level shuffle, one for the deduplication. The ids of
    the kept documents are written, so that their size decides how the sentences meet
    them; few enough go to the sentences, which then stay where they are."""
    keep = staged(doc_keep(doc, corp_doc, sent, target, params).select("doc_id"), "keep")
    kept = join_sent_keep(sent, keep, target)
    return final_sent(dedup_exact(clean_sents(kept, params)))
