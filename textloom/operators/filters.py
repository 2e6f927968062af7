"""Row filters, projections and rewrites (narrow: no shuffle)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as fx
from textloom.session import computed

# Beginnings of garbage sentences, as LIKE patterns with escape \.
GARBAGE_PATTERNS = (r"\% %", "/ /%", "* CAPTCHA%", "( Burime të%")

# Corpora left out of the kept documents.
EXCLUDED_SOURCES = ("GNOME", "Ubuntu", "WikiMatrix")


def filter_lang(sent: DataFrame, target: str, negate: bool = False) -> DataFrame:
    """Sentences in the target language, or in another known one."""
    return sent.filter(F.col("lang") != target if negate else F.col("lang") == target)


def filter_len(sent: DataFrame, min_len: int | None = None, max_len: int | None = None) -> DataFrame:
    """``length > min_len`` and ``length < max_len``."""
    n = F.length("sent")
    if min_len is not None:
        sent = sent.filter(n > min_len)
    if max_len is not None:
        sent = sent.filter(n < max_len)
    return sent


def filter_null_lang(sent: DataFrame, keep_null: bool = True) -> DataFrame:
    return sent.filter(F.col("lang").isNull() if keep_null else F.col("lang").isNotNull())


def filter_like(df: DataFrame, col: str, pattern: str, negate: bool = False) -> DataFrame:
    """Case-insensitive LIKE; NULLs match neither form."""
    hit = F.col(col).ilike(pattern)
    return df.filter(~hit if negate else hit)


def matches_any(col: Column, patterns: Sequence[str]) -> Column:
    hit = F.lit(False)
    for p in patterns:
        hit = hit | col.ilike(p)
    return hit


def filter_garbage(sent: DataFrame, patterns: Sequence[str] = GARBAGE_PATTERNS) -> DataFrame:
    return delete_where(sent, matches_any(F.col("sent"), patterns))


def filter_toklen(sent: DataFrame, lo: int = 5, hi: int = 450) -> DataFrame:
    """Token counts within bounds; unknown counts go."""
    return sent.filter(F.col("toklen").between(lo, hi))


def filter_sources(df: DataFrame, names: Sequence[str] = EXCLUDED_SOURCES) -> DataFrame:
    return df.filter(~F.col("name").isin(*names))


def filter_doc_quality(
    stats: DataFrame, min_cnt: int = 50, min_prop: float = 0.95, min_avg: float = 30
) -> DataFrame:
    return stats.filter(
        (F.col("sq_cnt") > min_cnt) & (F.col("sq_prop") > min_prop) & (F.col("avg") > min_avg)
    )


def filter_low_prop(lang_prop: DataFrame, corp_doc: DataFrame, max_prop: float = 0.25) -> DataFrame:
    low = lang_prop.filter(F.col("sq_prop") < max_prop)
    return low.join(corp_doc, "doc_id").select("doc_id", "name", "file", "sq_cnt", "sq_prop")


def delete_where(df: DataFrame, pred: Column) -> DataFrame:
    """SQL DELETE: a row whose predicate is NULL stays."""
    return df.filter(~F.coalesce(pred, F.lit(False)))


def update_col(df: DataFrame, col: str, expr: Column, cond: Column | None = None) -> DataFrame:
    if cond is not None:
        expr = F.when(cond, expr).otherwise(F.col(col))
    return df.withColumn(col, expr)


def doc_exists(doc: DataFrame, doc_id: int) -> DataFrame:
    return doc.filter(F.col("doc_id") == doc_id).agg(F.count("*").alias("cnt"))


def get_sent(sent: DataFrame, doc_id: int, six: int) -> DataFrame:
    return sent.filter((F.col("doc_id") == doc_id) & (F.col("six") == six))


def sents_of_doc(sent: DataFrame, doc_id: int) -> DataFrame:
    return (
        sent.filter(F.col("doc_id") == doc_id).select("sent", "spans", "sid", "six").orderBy("six")
    )


def project_bool(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    return df.withColumn(name, F.col(a) != F.col(b))


def strip_quote_tokens(sent: DataFrame) -> DataFrame:
    """Adds the tokens of each sentence, without enclosing double quotes."""
    return sent.withColumn("tokens", fx.strip_quote_tokens(fx.decode_spans("sent", "spans")))


def check_roundtrip(sent: DataFrame) -> DataFrame:
    """Sentences whose spans do not give back their tokens (expected none).

    Text and spans are worked out before, as a function of each span would join the
    whole text anew.
    """
    made = computed(sent, _text=fx.sent_text("tokens"), _spans=fx.encode_spans("tokens"))
    back = computed(made, _back=fx.decode_spans("_text", "_spans"))
    return back.filter(~F.col("_back").eqNullSafe(F.col("tokens"))).select(sent.columns)


def detect_lang(sent: DataFrame, stop_words=fx.STOP_WORDS, default: str | None = None) -> DataFrame:
    return sent.withColumn("lang", fx.vote_lang("sent", stop_words, default))
