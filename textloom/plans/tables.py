"""The corpus tables derived from a directory of Parquet inputs.

``documents`` becomes doc, sent, corp_doc and corp_src. Sentences come out of
one narrow projection per document, so nothing shuffles until an operator
groups or joins.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import markup
from textloom.functions import text as fx
from textloom.functions.langprofile import LangProfile
from textloom.schemas import SENT_COLUMNS
from textloom.session import computed, spread, staged

TARGET = "en"


def raw_sentences(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, six, raw) before tokenisation: enough to count sentences."""
    return docs.select("doc_id", F.posexplode(fx.text_sentences(text)).alias("six", "raw"))


def sentences_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, …, text) rows to (doc_id, six, sid, tokens)."""
    return computed(raw_sentences(docs, text), tokens=fx.tokenize("raw")).select(
        "doc_id", "six", F.col("six").cast("string").alias("sid"), "tokens"
    )


def sentence_columns(tokens: DataFrame) -> DataFrame:
    """(doc_id, six, sid, tokens) rows with text, spans and length; the
    columns a query does not use are pruned."""
    s = tokens.withColumn("sent", fx.sent_text("tokens"))
    return s.select(
        "doc_id", "six", "sid", "sent",
        fx.encode_spans("tokens").alias("spans"), fx.toklen("tokens").alias("toklen"), "tokens",
    )


def with_lang(sent: DataFrame, lang: str | None = None, profile: LangProfile | None = None) -> DataFrame:
    """Adds the configured language, or the detected one: by a fitted profile, or by
    the vote of frequent words."""
    if lang is not None:
        return sent.withColumn("lang", F.lit(lang))
    if profile is not None:
        return sent.withColumn("lang", profile.column("sent"))
    return computed(sent, lang=fx.vote_lang("sent"))


@dataclass
class Corpus:
    """The four corpus tables."""

    doc: DataFrame
    sent: DataFrame
    corp_doc: DataFrame
    corp_src: DataFrame


@dataclass
class Inputs:
    """Lazy frames over the Parquet tables of one directory."""

    spark: SparkSession
    path: str

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{table}.parquet")

    @cached_property
    def documents(self) -> DataFrame:
        return self.read("documents")

    @cached_property
    def doc(self) -> DataFrame:
        sid = F.regexp_extract("source", r"(\d+)$", 1)
        file = F.concat_ws(
            "/", F.lit("corpus"), F.lit("finetune"), "lang", sid, "source",
            F.concat(F.col("doc_id").cast("string"), F.lit(".xml")),
        )
        return self.documents.select(
            "doc_id", F.col("doc_id").cast("string").alias("dir_id"), file.alias("file")
        )

    @cached_property
    def corp_doc(self) -> DataFrame:
        return corp_doc_of(self.doc)

    @cached_property
    def corp_src(self) -> DataFrame:
        return self.documents.select("source").distinct().select(
            F.col("source").alias("id"),
            F.col("source").alias("name"),
            F.concat(F.lit("https://example.org/"), "source").alias("url"),
        )

    @cached_property
    def corp_src_sid(self) -> DataFrame:
        """Sources with their surrogate id."""
        sid = F.regexp_extract("id", r"(\d+)$", 1).cast("bigint")
        return self.corp_src.withColumn("sid", sid)

    @cached_property
    def texts(self) -> DataFrame:
        return spread(self.documents.select("doc_id", "text"), "doc_id")

    @cached_property
    def places(self) -> DataFrame:
        """Keys of the sentences, for counts."""
        return raw_sentences(self.texts).select("doc_id", "six")

    @cached_property
    def tokens(self) -> DataFrame:
        return sentences_of(self.texts)

    @cached_property
    def plain(self) -> DataFrame:
        """Sentences without their language."""
        return sentence_columns(self.tokens).drop("tokens")

    @cached_property
    def sent(self) -> DataFrame:
        return with_lang(self.plain).select(*SENT_COLUMNS)

    @cached_property
    def stored(self) -> DataFrame:
        """The sentences as a written table, for queries that use them more
        than once. Spans follow from the text and are filled in on reading."""
        cols = ["doc_id", "six", "sid", "lang", "sent", "toklen"]
        table = staged(self.sent.select(*cols), "sent")
        spans = fx.encode_spans(F.split("sent", " "))
        return table.withColumn("spans", spans).select(*SENT_COLUMNS)

    @cached_property
    def paragraphs(self) -> DataFrame:
        return self.texts.select(
            "doc_id", F.posexplode(fx.split_paragraphs("text")).alias("para_no", "para")
        )

    @cached_property
    def pages(self) -> DataFrame:
        return spread(self.read("pages").select("page_id", "html"), "page_id")

    @cached_property
    def corpus(self) -> Corpus:
        return Corpus(self.doc, self.sent, self.corp_doc, self.corp_src)


def corp_doc_of(doc: DataFrame, offset: int = 4) -> DataFrame:
    """Source id, corpus and path in it of each document; a file path without a
    source id fails."""
    parts = fx.split_path("file", offset)
    return doc.select("doc_id", parts.alias("_p")).select(
        "doc_id", "_p.sid", "_p.name", F.col("_p.sub_path").alias("file")
    )


def corp_doc_tolerant(doc: DataFrame, offset: int = 4) -> tuple[DataFrame, DataFrame]:
    """As ``corp_doc_of``, with the documents that have no such path returned apart,
    by file and reason."""
    fault = fx.path_fault("file", offset)
    bad = doc.withColumn("reason", fault).filter("reason IS NOT NULL").select("doc_id", "file", "reason")
    return corp_doc_of(doc.filter(fault.isNull() & F.col("file").isNotNull()), offset), bad


def strip_html(pages: DataFrame) -> DataFrame:
    """Visible paragraphs of HTML pages."""
    return pages.select(
        "page_id", F.posexplode(markup.html_paragraphs(F.col("html"))).alias("para_no", "para")
    )
