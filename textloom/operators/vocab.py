"""Vocabulary: split, distinct, filters."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as fx
from textloom.operators.ordering import indexed_table
from textloom.session import computed


def split_words(sent: DataFrame) -> DataFrame:
    """Non-empty words between blanks; narrow."""
    return sent.select("doc_id", "six", F.explode(F.split("sent", " ")).alias("value")).filter(
        "value != ''"
    )


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they have ``size`` bytes."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.nbytes
        if n >= size:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def vocab_filter(vocab: DataFrame, lo: int = 2, hi: int = 20) -> DataFrame:
    """Token lengths within bounds, no digits or excluded characters."""
    t = F.col("token")
    bad = t.rlike(r"[-., $+0-9]") | t.ilike("www%") | t.startswith("'")
    return vocab.filter(F.length(t).between(lo, hi) & ~bad)


def vocab_case_filter(vocab: DataFrame) -> DataFrame:
    """Without tokens that begin with three capitals or have only capitals
    (characters without an ASCII lower case count as capitals)."""
    t = F.col("token")
    head = F.substring(t, 1, 3)
    shouted = (head == fx.ascii_upper(head)) & (F.length(t) > 3)
    return vocab.filter(~shouted & (t != fx.ascii_upper(t)))


def vocab_charset_filter(vocab: DataFrame, max_codepoint: int = 255) -> DataFrame:
    return vocab.filter(~F.col("token").rlike(rf"[^\x{{1}}-\x{{{max_codepoint:x}}}]"))


def count_vocab(sent: DataFrame) -> DataFrame:
    """Distinct cleaned tokens with their number ``n``.

    Only the cheap length bound is checked for every occurrence of a word; the
    patterns are matched once per distinct word. The words have no blanks to
    trim, so trimming cannot make two of them equal.
    """
    value = F.col("value")
    words = split_words(sent).select("value").filter(F.length(value).between(2, 20))
    counts = words.groupBy("value").agg(F.count("*").alias("n"))
    tokens = computed(counts, token=fx.trim_token(value)).select("token", "n")
    return vocab_charset_filter(vocab_case_filter(vocab_filter(tokens)))


def build_vocab(sent: DataFrame) -> DataFrame:
    """Distinct cleaned tokens."""
    return count_vocab(sent).select("token")


def vocab_ids(vocab: DataFrame, first_id: int) -> DataFrame:
    """(token, id) with dense ids from ``first_id`` on, in token order, and the
    tokens' numbers ``n`` where they are known."""
    known = [c for c in vocab.columns if c == "n"]
    ids = indexed_table(vocab.select("token", *known), ["token"], "_id")
    return ids.select("token", (F.col("_id") + first_id).cast("int").alias("id"), *known)
