"""Queries for readers, writers and jobs.

Each one writes files that Spark derives from the given tables in the format
of the operator, and reads them back through it.
"""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as fx
from textloom.operators import dataset as ds
from textloom.operators import embeddings as em
from textloom.operators import joins as jn
from textloom.operators import ml
from textloom.operators import reports as rp
from textloom.operators import vocab as vo
from textloom.plans import jobs
from textloom.plans.catalog import PARAMS, SEED, curated, flat_sent, joined, query
from textloom.plans.tables import TARGET, Inputs
from textloom.session import new_path, spread, staged
from textloom.sources import named, plugin, readers, writers
from textloom.streaming.curation import Curation
from textloom.streaming.ingest import ingest_stream as start_ingest


def new_db(t: Inputs) -> str:
    db = f"textloom_{uuid.uuid4().hex}"
    writers.create_schema(t.spark, db, new_path(t.spark, db))
    return db


# --- readers ---------------------------------------------------------------


def tok_xml_files(t: Inputs, below: str = "") -> str:
    """A new folder with tokenised XML of all sentences, ``below`` it if given."""
    root = new_path(t.spark, "tokxml")
    path = f"{root}/{below}".rstrip("/")
    rows = t.tokens.select(F.concat_ws(":", "doc_id", "six").alias("_id"), F.col("tokens").alias("w"))
    write_tok_xml(rows, path)
    return root


def write_tok_xml(rows: DataFrame, path: str) -> None:
    """Word elements each in a line, which no blanks indent: these are most of a file."""
    rows.write.format("xml").option("rootTag", "text").option("rowTag", "s").option("indent", "").save(path)


@query
def read_tok_xml(t: Inputs) -> DataFrame:
    rows = readers.read_tok_xml(t.spark, tok_xml_files(t), glob="part-*")
    return rows.select("sid", joined("tokens", " "))


@query
def read_tok_xml_splits(t: Inputs) -> DataFrame:
    """One file of all sentences, read whole and in byte ranges of two sizes."""
    spark, path = t.spark, new_path(t.spark, "tokxml")
    # Sorted as one string each: tokens have no blanks and are not empty.
    rows = t.tokens.select("doc_id", "six", joined("tokens", " ").alias("_sent")).orderBy("doc_id", "six").coalesce(1)
    words = F.filter(F.split("_sent", " "), lambda w: w != "")
    write_tok_xml(rows.select(F.concat_ws(":", "doc_id", "six").alias("_id"), words.alias("w")), path)
    size = readers.list_files(spark, path, "part-*").agg(F.sum("size").alias("n")).first().n
    key, parts = "spark.sql.files.maxPartitionBytes", []
    before = spark.conf.get(key)
    try:
        for n in (1, 4, 9):
            spark.conf.set(key, str(size // n + 1))
            read = readers.read_tok_xml(spark, path, glob="part-*")
            read = read.select(F.lit(n).alias("n_splits"), "six", "sid", joined("tokens", " "))
            parts.append(read)  # the files are parsed already
    finally:
        spark.conf.set(key, before)
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def read_tolerant(t: Inputs) -> DataFrame:
    """Readable records, and the lines that are none."""
    path = crawl_files(t)
    bad = F.concat(F.lit('{"content": bad '), F.col("doc_id").cast("string"))
    t.documents.filter("doc_id % 5 = 0").select(bad).write.mode("append").text(path)
    good, left = readers.read_tolerant(t.spark, path, "crawl")
    return good.select("content", F.lit(True).alias("ok")).unionAll(left.select("reason", F.lit(False)))


@query
def read_registered(t: Inputs) -> DataFrame:
    """As read_crawl, through a parser that is registered as a data source."""
    plugin.register_parser(t.spark, "crawl_lines", plugin.CRAWL, plugin.parse_crawl)
    rows = t.spark.read.format("crawl_lines").option("glob", "part-*").option("splitBytes", 1 << 20)
    found = readers.crawl_sentences(staged(rows.load(crawl_files(t)), "parsed"), TARGET)
    return found.select(joined("tokens", " "))


@query
def read_sent_xml(t: Inputs) -> DataFrame:
    path = new_path(t.spark, "sentxml")
    rows = t.plain.select(F.concat_ws(":", "doc_id", "six").alias("_id"), F.col("sent").alias("_VALUE"))
    rows.write.format("xml").option("rootTag", "text").option("rowTag", "s").save(path)
    return readers.read_sent_xml(t.spark, path, glob="part-*").select("sid", joined("tokens", " "))


def wiki_files(t: Inputs) -> str:
    path = new_path(t.spark, "wiki")
    head = F.concat(
        F.lit("'''"), "source", F.lit("''' [["), "lang", F.lit("|"), "source", F.lit("]]. {{t|{{u|"),
        "source", F.lit("}}}}!\n"),
    )
    pages = t.documents.select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("title"),
        F.struct(
            F.struct(
                F.octet_length("text").cast("bigint").alias("_bytes"),
                F.concat(head, "text").alias("_VALUE"),
            ).alias("text")
        ).alias("revision"),
    )
    pages.write.format("xml").option("rootTag", "mediawiki").option("rowTag", "page").save(path)
    return path


@query
def read_wiki(t: Inputs) -> DataFrame:
    rows = readers.read_wiki(t.spark, wiki_files(t), glob="part-*")
    return rows.select("doc_id", "six", "sid", joined("tokens", " "))


#: Characters of the texts that would be markup themselves.
MARKUP_CHARS = "[]{}|<>='&!"


@query
def strip_markup(t: Inputs) -> DataFrame:
    """Whole texts in links, templates, parameters, references, comments and tables
    that nest one to six deep."""
    from textloom.functions import markup

    depth = F.expr("cast(pmod(doc_id, 6) + 1 as int)")
    text, source, lang = F.translate("text", MARKUP_CHARS, ""), F.col("source"), F.col("lang")

    def within(left: str, inner: F.Column, right: str) -> F.Column:
        return F.concat(F.repeat(F.lit(left), depth), inner, F.repeat(F.lit(right), depth))

    page = F.concat(
        F.lit("== "), within("[[a|", source, "]]"), F.lit(" ==\n<!-- "), within("[[", lang, "{{"), F.lit("-->"),
        within("{{t|k=[[x|", text, "]]|z}}"), F.lit("\n"), within("{{{p|", lang, "}}}"),
        F.lit("[[File:f.png|thumb|"), within("[[b|", lang, "]]"), F.lit("]]"),
        within("<ref>", within("{{q|", source, "}}"), "</ref>"), F.lit("<ref name=\"x\"/> '''"),
        within("[http://x.y/z ", source, "]"), F.lit("'''\n{{t|\n{|\n| "), within("{{c|", lang, "}}"), F.lit("\n|}|z}}"),
    )
    return t.documents.select("doc_id", markup.strip_markup(page).alias("text"))


def crawl_rows(t: Inputs) -> DataFrame:
    """One record per document; warnings and identifications vary with the
    document and line number."""
    k = F.pmod("doc_id", F.lit(4))
    warnings = (
        F.when(k == 1, F.array(F.lit("tiny")))
        .when(k == 2, F.array(F.lit("short_sentences"), F.lit("tiny")))
        .when(k == 3, F.array(F.lit("noisy")))
    )
    lang = F.col("lang")

    def ident(i: F.Column) -> F.Column:
        m = F.pmod(i, F.lit(5))
        prob = F.when(m == 0, F.lit(0.9)).otherwise(F.lit(0.95))
        return F.when(m != 1, F.struct(lang.alias("label"), prob.alias("prob")))

    ids = F.transform(F.split("text", "\n"), lambda _, i: ident(i))
    return t.documents.select(
        F.col("text").alias("content"),
        F.struct(warnings.alias("quality_warnings"), ids.alias("sentence_identifications")).alias("metadata"),
    )


def crawl_files(t: Inputs) -> str:
    path = new_path(t.spark, "crawl")
    crawl_rows(t).write.option("ignoreNullFields", "false").json(path)
    return path


@query
def read_crawl_jsonl(t: Inputs) -> DataFrame:
    return readers.read_crawl_jsonl(t.spark, crawl_files(t), "part-*").select(
        "content",
        F.size(F.coalesce("metadata.quality_warnings", F.array().cast("array<string>"))).alias("n_warnings"),
        F.size("metadata.sentence_identifications").alias("n_lines"),
    )


@query
def filter_quality_warnings(t: Inputs) -> DataFrame:
    rows = readers.read_crawl_jsonl(t.spark, crawl_files(t), "part-*")
    return readers.filter_quality_warnings(rows).select("content")


@query
def filter_lang_prob(t: Inputs) -> DataFrame:
    rows = readers.read_crawl_jsonl(t.spark, crawl_files(t), "part-*")
    return readers.filter_lang_prob(rows, TARGET).select("line_no", "text")


@query
def read_crawl(t: Inputs) -> DataFrame:
    return readers.read_crawl(t.spark, crawl_files(t), TARGET, glob="part-*").select(
        joined("tokens", " ")
    )


@query
def list_files(t: Inputs) -> DataFrame:
    """Bytes of text files written by source."""
    path = new_path(t.spark, "files")
    t.documents.select("text", "source").write.partitionBy("source").text(path)
    name = F.regexp_extract("path", r"/source=([^/]+)/", 1).alias("name")
    return readers.list_files(t.spark, path, "*.txt").groupBy(name).agg(F.sum("size").alias("size"))


@query
def read_sources(t: Inputs) -> DataFrame:
    path = new_path(t.spark, "sources")
    t.corp_src.write.option("header", "true").csv(path)
    return readers.read_sources(t.spark, path)


def review_rows(t: Inputs) -> DataFrame:
    label = F.when(F.pmod("doc_id", F.lit(3)) == 0, "+").when(F.pmod("doc_id", F.lit(3)) == 1, "-").otherwise("n")
    topic = F.when(F.pmod("doc_id", F.lit(7)) != 0, F.col("source"))
    return t.documents.select(
        "lang", "text", label.alias("label"), topic.alias("topic"), F.lit("joy").alias("emotion")
    )


@query
def read_reviews(t: Inputs) -> DataFrame:
    """Reviews of one language out of a folder per language."""
    path = new_path(t.spark, "reviews")
    rows = review_rows(t).filter(F.col("lang") == TARGET).drop("lang")
    (
        rows.write.option("header", "true").option("escape", '"')
        .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
        .csv(f"{path}/{TARGET}.csv")
    )
    return readers.read_reviews(t.spark, path, TARGET)


def annotation_rows(t: Inputs) -> DataFrame:
    d = t.read("labels").join(t.documents.select("doc_id", "lang", "source"), "doc_id")
    return d.select(
        F.col("source").alias("a1_topic"),
        F.when(F.pmod("doc_id", F.lit(9)) != 0, F.col("source")).alias("a2_topic"),
        F.col("lang").alias("a1_emotion"),
        F.when(F.pmod("doc_id", F.lit(2)) == 0, F.col("lang")).otherwise(F.lit("en")).alias("a2_emotion"),
        F.col("quality").alias("a1_label"),
        F.col("toxic").alias("a2_label"),
        F.lit("x").alias("notes"),
    )


@query
def read_annotations(t: Inputs) -> DataFrame:
    path = new_path(t.spark, "annotations")
    annotation_rows(t).write.option("header", "true").csv(path)
    return readers.read_annotations(t.spark, path)


def split_id_files(t: Inputs) -> str:
    path = new_path(t.spark, "splits")
    split = staged(ds.stratified_split(t.read("labels"), ["doc_id"], "quality", seed=SEED), "split")
    for name in ("train", "validation", "test"):
        split.filter(F.col("split") == name).select(F.col("doc_id").cast("string")).write.text(
            f"{path}/{name}.txt"
        )
    return path


@query
def read_split_ids(t: Inputs) -> DataFrame:
    return readers.read_split_ids(t.spark, split_id_files(t))


@query
def apply_split_ids(t: Inputs) -> DataFrame:
    ids = readers.read_split_ids(t.spark, split_id_files(t))
    return jn.apply_split_ids(t.documents.select("doc_id", "lang"), ids, "doc_id")


@query
def named_query(t: Inputs) -> DataFrame:
    return named.named_query(
        t.spark, "select_corpus_sources", doc=t.doc, sent=t.plain, corp_doc=t.corp_doc, corp_src=t.corp_src
    )


def named_row(name: str) -> None:
    def run(t: Inputs) -> DataFrame:
        vocab = vo.build_vocab(t.plain)
        out = named.named_query(
            t.spark, name, named.EXAMPLES.get(name), doc=t.doc, sent=t.plain, corp_doc=t.corp_doc,
            corp_src=t.corp_src, vocab=vocab,
        )
        return flat_sent(out) if "spans" in out.columns else out

    run.__name__ = f"named_{name}"
    query(run)


for _name in named.NAMED:
    named_row(_name)


@query
def read_dataset(t: Inputs) -> DataFrame:
    path = new_path(t.spark, "dataset")
    writers.write_dataset(t.plain, path)
    return readers.read_dataset(t.spark, path, 2000)


@query
def stage_docs(t: Inputs) -> DataFrame:
    path = new_path(t.spark, "staged")
    writers.stage_docs(t.tokens, path)
    return t.spark.read.parquet(path).select("doc_id", "six", "sid", joined("tokens", " "))


# --- writers ---------------------------------------------------------------


@query
def create_schema(t: Inputs) -> DataFrame:
    """The declared tables after loading the documents into one of them."""
    db = new_db(t)
    writers.recreate_or_append(t.doc, f"{db}.doc")
    counts = [
        t.spark.table(f"{db}.{name}").agg(F.count("*").alias("cnt")).select(F.lit(name).alias("name"), "cnt")
        for name in ("doc", "sent", "corp_doc", "corp_src")
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionAll(c)
    return out


@query
def append_docs(t: Inputs) -> DataFrame:
    """Two appends; ids go on from the first one."""
    db = new_db(t)
    writers.append_docs(t.doc, f"{db}.doc")
    return writers.append_docs(t.doc, f"{db}.doc")


@query
def append_sents(t: Inputs) -> DataFrame:
    db = new_db(t)
    writers.append_sents(t.sent, f"{db}.sent")
    return flat_sent(t.spark.table(f"{db}.sent"))


@query
def assign_dir_id(t: Inputs) -> DataFrame:
    return writers.assign_dir_id(t.doc.select("doc_id", "file"), t.doc)


@query
def recreate_or_append(t: Inputs) -> DataFrame:
    name = f"{new_db(t)}.corp_doc"
    writers.recreate_or_append(t.corp_doc, name)
    writers.recreate_or_append(t.corp_doc, name)
    twice = t.spark.table(name).agg(F.count("*").alias("cnt")).first()[0]
    writers.recreate_or_append(t.corp_doc, name, recreate=True)
    return t.spark.table(name).agg(F.count("*").alias("cnt")).select(F.lit(twice).alias("appended"), "cnt")


@query
def load_if_empty(t: Inputs) -> DataFrame:
    """The second load finds rows and does nothing."""
    name = f"{new_db(t)}.doc"
    first = writers.load_if_empty(t.doc, name)
    second = writers.load_if_empty(t.doc, name)
    return t.spark.table(name).select("*", F.lit(first).alias("first"), F.lit(second).alias("second"))


@query
def refresh_corp_doc(t: Inputs) -> DataFrame:
    name = f"{new_db(t)}.corp_doc"
    writers.refresh_corp_doc(t.doc, table=name)
    return t.spark.table(name)


@query
def refresh_corp_src(t: Inputs) -> DataFrame:
    name = f"{new_db(t)}.corp_src"
    writers.refresh_corp_src(t.corp_src, name)
    return t.spark.table(name)


@query
def insert_source(t: Inputs) -> DataFrame:
    return writers.insert_source(t.corp_src, "extra", "Extra", "https://example.org/extra")


@query
def ctas(t: Inputs) -> DataFrame:
    return writers.ctas(t.corp_doc, f"{new_db(t)}.kept", table=True)


@query
def dump_csv(t: Inputs) -> DataFrame:
    path = new_path(t.spark, "dump")
    writers.dump_csv(t.plain, path, seed=SEED)
    return t.spark.read.schema("did bigint, sid string, text string").option("header", "true").option(
        "escape", '"'
    ).csv(path)


@query
def write_dataset(t: Inputs) -> DataFrame:
    """Texts with their place in the export."""
    path = new_path(t.spark, "dataset")
    writers.write_dataset(t.plain, path)
    return writers.export_with_positions(t.spark, path)


@query
def write_report(t: Inputs) -> DataFrame:
    path = new_path(t.spark, "report")
    writers.write_report({"stats": rp.corpus_stats(t.corp_doc, t.doc, t.plain)}, path)
    return t.spark.read.schema("description string, value bigint").option("header", "true").csv(
        f"{path}/stats"
    )


@query
def write_metrics(t: Inputs) -> DataFrame:
    path = new_path(t.spark, "metrics")
    writers.write_metrics(rp.classification_metrics(t.read("labels"), "quality", "toxic"), path)
    got = t.spark.read.schema("metric string, value double").option("header", "true").csv(path)
    return got.withColumn("value", F.round("value", 6))


# --- jobs ------------------------------------------------------------------


@query
def build_corpus(t: Inputs) -> DataFrame:
    """Tokenised XML of the documents, built into a corpus."""
    raw = tok_xml_files(t, "corpus/finetune/lang/17/Books/xml")
    store = jobs.build_corpus(
        t.spark, {"tok_xml": raw}, new_path(t.spark, "corpus"), recreate=True, glob="part-*", base=raw
    )
    return store.table("sent").select("sid", "lang", "sent", fx.spans_to_text("spans").alias("spans"), "toklen")


@query
def build_dataset(t: Inputs) -> DataFrame:
    sent = staged(curated(t), "curated")
    packed, masked = jobs.build_dataset(sent, vo.build_vocab(sent), seed=SEED)
    return masked


@query
def print_stats(t: Inputs) -> DataFrame:
    return jobs.print_stats(t.corp_doc, t.doc, t.plain)


@query
def write_stats(t: Inputs) -> DataFrame:
    path = new_path(t.spark, "stats")
    notes = annotation_rows(t).drop("notes").dropna("any")
    jobs.write_stats(t.corp_src, t.corp_doc, t.doc, t.plain, path, notes)
    return t.spark.read.schema("name string, url string, count bigint").option("header", "true").csv(
        f"{path}/corpus_sources"
    )


@query
def dump_corpus(t: Inputs) -> DataFrame:
    path = new_path(t.spark, "dump")
    jobs.dump_corpus(curated(t), path, row_size=1000)
    return t.spark.read.schema("did bigint, sid string, text string").option("header", "true").option(
        "escape", '"'
    ).csv(path)


@query
def ingest_stream(t: Inputs) -> DataFrame:
    """The documents as a file stream; the same sentences as a batch."""
    out = new_path(t.spark, "stream")
    q = start_ingest(t.spark, f"{t.path}/documents*.parquet", "documents", new_path(t.spark, "check"), out)
    q.awaitTermination()
    return t.spark.read.parquet(f"{out}/sent").select("doc_id", "six", "sid", "lang", "sent", "toklen")


@query
def curate_increments(t: Inputs) -> DataFrame:
    """The documents in three deliveries, each curated as it comes."""
    src, out = new_path(t.spark, "deliveries"), new_path(t.spark, "curated")
    curation = Curation(
        t.spark, src, "documents", out, TARGET, replace(PARAMS, drop_first=0),
        names=lambda doc: t.corp_doc.join(doc.select("doc_id"), "doc_id", "left_semi"),
    )
    part = F.pmod(F.xxhash64("doc_id"), F.lit(3))
    for k in range(3):
        t.documents.filter(part == k).select("doc_id", "text").write.mode("append").parquet(src)
        curation.update()
    return flat_sent(curation.sentences())


# --- models ----------------------------------------------------------------


@query
def word_vectors(t: Inputs) -> DataFrame:
    d = t.plain.select("doc_id", "six", "sent")
    out = ml.word_vectors(d, partitions=t.spark.sparkContext.defaultParallelism)
    return out.withColumn("values", vector_to_array("vector")).select(
        "doc_id", "six", F.size("values").alias("size"),
        F.forall("values", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))).alias("finite"),
    )


@query
def cooccurrence(t: Inputs) -> DataFrame:
    return em.cooccurrence(t.plain.select("doc_id", "six", "sent"))


@query
def word_vectors_sharded(t: Inputs) -> DataFrame:
    """As word_vectors, with all parameters in Spark."""
    d = staged(t.plain.select("doc_id", "six", "sent"), "sent")
    out = em.average_vectors(d, em.train_vectors(em.cooccurrence(d)))
    return out.select(
        "doc_id", "six", F.size("vector").alias("size"),
        F.forall("vector", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))).alias("finite"),
    )


@query
def sentiment_classifier(t: Inputs) -> DataFrame:
    """Quality labels from text, language and source."""
    d = t.read("labels").join(t.documents.select("doc_id", "text", "lang"), "doc_id")
    d = ds.one_hot(
        d.select("doc_id", "text", "lang", F.col("quality").cast("string").alias("label")),
        "lang", ("de", "en", "es", "fr"), "topic_bits",
    )
    split = staged(spread(ds.stratified_split(d, ["doc_id"], "label", seed=SEED), "doc_id"), "labelled")
    train = split.filter(F.col("split") == "train")
    pred = ml.sentiment_classifier(
        train, split.filter(F.col("split") != "train"), ("0", "1"), ["topic_bits"]
    )
    return pred.groupBy("split").agg(
        F.count("*").alias("cnt"), (F.avg((F.col("label") == F.col("label_pred")).cast("double")) > 0.8).alias("accurate")
    )
