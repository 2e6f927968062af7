"""Every operator as a query over a directory of Parquet tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import tablefns
from textloom.functions import text as fx
from textloom.functions.langprofile import fit_profile
from textloom.operators import curate as cu
from textloom.operators import dataset as ds
from textloom.operators import filters as fl
from textloom.operators import joins as jn
from textloom.operators import langstats as ls
from textloom.operators import ordering as od
from textloom.operators import reports as rp
from textloom.operators import vocab as vo
from textloom.session import staged
from textloom.plans.tables import TARGET, Inputs, strip_html

# Bounds that keep part of the test documents; the reference values are the
# operators' defaults.
PARAMS = cu.CurateParams(
    min_cnt=10, min_prop=0.3, min_avg=30, exclude_sources=("src0", "src1", "src2"), drop_first=20
)
SEED = 7
TOPIC = ("view", "click", "purchase", "signup", "error")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
    QUERIES[f.__name__.rstrip("_")] = lambda spark, path: f(Inputs(spark, path))
    return f


def joined(col: str, sep: str = "|") -> F.Column:
    """Arrays as text, so that results compare as plain columns."""
    return F.array_join(F.col(col).cast("array<string>"), sep, "-").alias(col)


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def lang_prop(t: Inputs) -> DataFrame:
    """Proportions over the stored sentences, for queries that read those too."""
    return ls.lang_prop_by_doc(t.stored, TARGET)


def profile(t: Inputs) -> DataFrame:
    return ls.doc_profile(t.sent, TARGET)


def lang_prop_once(t: Inputs) -> DataFrame:
    return ls.lang_prop_by_doc(t.sent, TARGET)


def sent_keep(t: Inputs) -> DataFrame:
    keep = cu.doc_keep(t.doc, t.corp_doc, t.stored, TARGET, PARAMS)
    return jn.join_sent_keep(t.stored, keep, TARGET)


def curated(t: Inputs) -> DataFrame:
    return cu.curate(t.doc, t.corp_doc, t.stored, TARGET, PARAMS)


def flat_sent(df: DataFrame) -> DataFrame:
    """Sentence rows with the text form of the spans."""
    return df.withColumn("spans", fx.spans_to_text("spans"))


# --- scalar functions ------------------------------------------------------


@query
def split_paragraphs(t: Inputs) -> DataFrame:
    return t.paragraphs


@query
def split_sentences(t: Inputs) -> DataFrame:
    return t.paragraphs.select(
        "doc_id", "para_no", F.posexplode(fx.split_sentences("para")).alias("pos", "sent")
    )


@query
def tokenize(t: Inputs) -> DataFrame:
    return t.tokens.select("doc_id", "six", joined("tokens", " "))


@query
def sent_text(t: Inputs) -> DataFrame:
    return t.tokens.select("doc_id", "six", fx.sent_text("tokens").alias("sent"))


@query
def encode_spans(t: Inputs) -> DataFrame:
    return flat_sent(t.plain.select("doc_id", "six", "spans"))


@query
def decode_spans(t: Inputs) -> DataFrame:
    return t.plain.select("doc_id", "six", fx.decode_spans("sent", "spans").alias("tokens")).select(
        "doc_id", "six", joined("tokens")
    )


@query
def check_roundtrip(t: Inputs) -> DataFrame:
    return fl.check_roundtrip(t.tokens).select("doc_id", "six", "sid")


@query
def toklen(t: Inputs) -> DataFrame:
    return t.plain.select(
        "doc_id", "six", "toklen",
        fx.toklen_of_spans(fx.spans_to_text("spans")).alias("toklen_of_spans"),
    )


@query
def split_path(t: Inputs) -> DataFrame:
    return t.doc.select("doc_id", fx.split_path("file").alias("p")).select("doc_id", "p.*")


@query
def detect_lang(t: Inputs) -> DataFrame:
    return fl.detect_lang(t.plain.select("doc_id", "six", "sent")).select("doc_id", "six", "lang")


@query
def detect_lang_fitted(t: Inputs) -> DataFrame:
    """By the frequent words of the languages that the documents are labelled
    with."""
    labelled = t.plain.select("doc_id", "sent").join(t.documents.select("doc_id", "lang"), "doc_id")
    lists = ls.fit_stop_words(labelled)
    return t.plain.select("doc_id", "six", fx.vote_lang("sent", lists).alias("lang"))


@query
def detect_lang_profile(t: Inputs) -> DataFrame:
    """By trigram probabilities, counted on three quarters of the documents."""
    profile = fit_profile(t.documents.filter(F.pmod("doc_id", F.lit(4)) != 2))
    return t.plain.select("doc_id", "six", profile.column("sent").alias("lang"))


@query
def strip_digits(t: Inputs) -> DataFrame:
    return t.plain.select("doc_id", "six", fx.strip_digits("sent").alias("sent"))


@query
def trim_chain(t: Inputs) -> DataFrame:
    return t.plain.select("doc_id", "six", fx.trim_chain("sent").alias("sent"))


@query
def trim_token(t: Inputs) -> DataFrame:
    return t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("w")).select(
        "doc_id", fx.trim_token(F.concat(F.lit("  "), "w", F.lit(" "))).alias("token")
    )


@query
def fn_scalars(t: Inputs) -> DataFrame:
    """The scalar functions the curation statements use, side by side."""
    s = F.col("sent")
    return t.plain.select(
        "doc_id",
        "six",
        F.length(s).alias("len"),
        F.substring(s, 2, 5).alias("sub"),
        F.instr(s, " ").alias("pos"),
        F.replace(s, F.lit("e"), F.lit("")).alias("rep"),
        fx.ascii_upper(s).alias("up"),
        F.trim(s).alias("trimmed"),
        F.col("sid").cast("int").alias("num"),
        s.rlike("^[0-9]").alias("glob_digit"),
        s.ilike("the %").alias("like_the"),
        s.isNotNull().alias("is_text"),
    )


@query
def json_fields(t: Inputs) -> DataFrame:
    return t.read("events").select(
        "event_id", fx.json_fields("props", "k bigint").alias("p")
    ).select("event_id", "p.k")


@query
def xpath_fields(t: Inputs) -> DataFrame:
    """Tokens of each sentence, read back out of an XML string by path."""
    words = F.transform("tokens", lambda x: F.concat(F.lit("<w>"), esc_col(x), F.lit("</w>")))
    xml = F.concat(F.lit('<s id="'), F.col("sid"), F.lit('">'), F.array_join(words, ""), F.lit("</s>"))
    d = t.tokens.select("doc_id", "six", xml.alias("xml"))
    d = d.withColumn("_found", fx.xpath_lists("xml", "s/w/text()", "s/@id"))
    words, sid = F.get("_found", F.lit(0)), F.get("_found", F.lit(1))
    return d.select(
        "doc_id", "six", F.array_join(words, "|").alias("words"), F.get(sid, F.lit(0)).alias("sid")
    )


def esc_col(x: F.Column) -> F.Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


@query
def set_difference(t: Inputs) -> DataFrame:
    first = F.slice("tokens", F.lit(1), F.lit(3))
    return t.tokens.select(
        "doc_id",
        "six",
        F.array_join(F.array_sort(fx.set_difference("tokens", first)), "|").alias("diff"),
        F.array_join(F.array_sort(fx.set_union("tokens", first)), "|").alias("both"),
    )


@query
def strip_html_(t: Inputs) -> DataFrame:
    return strip_html(t.pages)


# --- filters and projections -----------------------------------------------


@query
def filter_lang(t: Inputs) -> DataFrame:
    other = fl.filter_lang(t.sent, TARGET, negate=True).select("doc_id", "six", "lang")
    return fl.filter_lang(t.sent, TARGET).select("doc_id", "six", "lang").unionAll(other)


@query
def filter_len(t: Inputs) -> DataFrame:
    return fl.filter_len(t.plain, 50, 120).select("doc_id", "six", "sent")


@query
def filter_null_lang(t: Inputs) -> DataFrame:
    return fl.filter_null_lang(t.sent).select("doc_id", "six", "sent")


@query
def filter_like(t: Inputs) -> DataFrame:
    return fl.filter_like(t.plain, "sent", "the %").select("doc_id", "six", "sent")


@query
def filter_garbage(t: Inputs) -> DataFrame:
    return fl.filter_garbage(t.plain, (*fl.GARBAGE_PATTERNS, "and %", "%.")).select(
        "doc_id", "six", "sent"
    )


@query
def filter_toklen(t: Inputs) -> DataFrame:
    return fl.filter_toklen(t.plain).select("doc_id", "six", "toklen")


@query
def filter_sources(t: Inputs) -> DataFrame:
    return fl.filter_sources(t.corp_doc, PARAMS.exclude_sources)


@query
def filter_doc_quality(t: Inputs) -> DataFrame:
    stats = profile(t).filter("sq_cnt > 0")
    kept = fl.filter_doc_quality(stats, 10, 0.3, 30)
    return r6(kept, "sq_prop", "avg").select("doc_id", "sq_cnt", "sq_prop", "avg", "min")


@query
def filter_low_prop(t: Inputs) -> DataFrame:
    return r6(fl.filter_low_prop(lang_prop_once(t), t.corp_doc), "sq_prop")


@query
def doc_exists(t: Inputs) -> DataFrame:
    return fl.doc_exists(t.doc, 3)


@query
def get_sent(t: Inputs) -> DataFrame:
    return fl.get_sent(t.sent, 3, 2).select("doc_id", "six", "sid", "sent", "lang", "toklen")


@query
def sents_of_doc(t: Inputs) -> DataFrame:
    return flat_sent(fl.sents_of_doc(t.plain, 3))


@query
def vocab_filter(t: Inputs) -> DataFrame:
    return vo.vocab_filter(ls.distinct_values(words_as_tokens(t), "token"))


def words_as_tokens(t: Inputs) -> DataFrame:
    return vo.split_words(t.plain).select(F.col("value").alias("token"))


@query
def vocab_case_filter(t: Inputs) -> DataFrame:
    return vo.vocab_case_filter(ls.distinct_values(words_as_tokens(t), "token"))


@query
def vocab_charset_filter(t: Inputs) -> DataFrame:
    return vo.vocab_charset_filter(ls.distinct_values(words_as_tokens(t), "token"), 127)


@query
def project_bool(t: Inputs) -> DataFrame:
    d = lang_prop_once(t).select("doc_id", "sq_cnt", "tot_cnt")
    return fl.project_bool(d, "sq_cnt", "tot_cnt", "mixed")


@query
def strip_quote_tokens(t: Inputs) -> DataFrame:
    """Sentences put in quotes where their index is even, and taken out."""
    q = F.array(F.lit('"'))
    d = t.tokens.select(
        "doc_id", "six",
        F.when(F.pmod("six", F.lit(2)) == 0, F.concat(q, "tokens", q)).otherwise(F.col("tokens")).alias("tokens"),
    )
    return d.select("doc_id", "six", fx.strip_quote_tokens("tokens").alias("tokens")).select(
        "doc_id", "six", joined("tokens")
    )


@query
def delete_where(t: Inputs) -> DataFrame:
    return fl.delete_where(t.sent, F.col("lang") == TARGET).select("doc_id", "six", "lang")


@query
def update_col(t: Inputs) -> DataFrame:
    return fl.update_col(
        t.plain, "sent", F.substring("sent", 2, 1 << 30), F.col("sent").rlike("^[0-9]")
    ).select("doc_id", "six", "sent")


@query
def table_scan(t: Inputs) -> DataFrame:
    return t.doc.select("doc_id", "dir_id", "file")


# --- joins -----------------------------------------------------------------


@query
def join_doc_sent(t: Inputs) -> DataFrame:
    return jn.join_doc_sent(t.doc, t.sent, (F.col("lang") != TARGET) & (F.length("sent") > 50))


@query
def join_source_url(t: Inputs) -> DataFrame:
    return jn.join_source_url(t.corp_doc, t.corp_src)


@query
def join_source_by_sid(t: Inputs) -> DataFrame:
    return jn.join_source_by_sid(t.corp_doc, t.corp_src_sid, t.plain, "src3")


@query
def join_star4(t: Inputs) -> DataFrame:
    return jn.join_star4(t.corp_src, t.corp_doc, t.doc, t.plain, "src3")


@query
def count_star4(t: Inputs) -> DataFrame:
    return jn.count_star4(t.corp_src, t.corp_doc, t.doc, ls_target(t), "src3")


def ls_target(t: Inputs) -> DataFrame:
    return fl.filter_lang(t.sent, TARGET)


@query
def join_source_by_sid_all(t: Inputs) -> DataFrame:
    return jn.join_source_by_sid(t.corp_doc, t.corp_src_sid, t.plain)


@query
def join_star4_all(t: Inputs) -> DataFrame:
    return jn.join_star4(t.corp_src, t.corp_doc, t.doc, t.plain)


@query
def count_star4_all(t: Inputs) -> DataFrame:
    return jn.count_star4(t.corp_src, t.corp_doc, t.doc, ls_target(t))


@query
def join_doc_counts(t: Inputs) -> DataFrame:
    return jn.join_doc_counts(t.doc, t.corp_doc, ls.doc_counts(t.doc, t.places))


@query
def theta_lang_mix(t: Inputs) -> DataFrame:
    return jn.theta_lang_mix(t.doc, profile(t))


@query
def lang_mismatch_sample(t: Inputs) -> DataFrame:
    return jn.lang_mismatch_sample(t.doc, t.stored, ls.lang_dist_by_doc(t.stored), TARGET)


@query
def anti_no_target(t: Inputs) -> DataFrame:
    return jn.anti_no_target(t.doc, profile(t))


@query
def semi_kept_docs(t: Inputs) -> DataFrame:
    keep = cu.doc_keep(t.doc, t.corp_doc, t.stored, TARGET, PARAMS)
    return jn.semi_kept_docs(t.stored, keep).select("doc_id", "six")


@query
def anti_topn(t: Inputs) -> DataFrame:
    return jn.anti_topn(t.stored, 500).select("doc_id", "six", "sent")


@query
def scalar_subquery_counts(t: Inputs) -> DataFrame:
    return ls.scalar_subquery_counts(t.doc, t.sent, F.col("lang") != TARGET)


@query
def join_doc_keep(t: Inputs) -> DataFrame:
    keep = jn.join_doc_keep(t.doc, t.corp_doc, profile(t))
    kept = fl.filter_doc_quality(fl.filter_sources(keep, PARAMS.exclude_sources), 10, 0.3, 30)
    return r6(kept, "sq_prop", "avg")


@query
def join_sent_keep(t: Inputs) -> DataFrame:
    return sent_keep(t).select("doc_id", "six", "sent", "toklen")


# --- aggregations ----------------------------------------------------------


@query
def count_rows(t: Inputs) -> DataFrame:
    return ls.count_rows(t.places)


@query
def count_distinct_names(t: Inputs) -> DataFrame:
    return ls.count_distinct_names(t.corp_doc)


@query
def corpus_doc_counts(t: Inputs) -> DataFrame:
    return ls.corpus_doc_counts(t.corp_doc)


@query
def single_doc_corpora(t: Inputs) -> DataFrame:
    """Corpora named after source and language: some hold one document."""
    d = t.documents.select(
        "doc_id", F.concat_ws("-", "source", "lang", F.floor(F.col("n_chars") / 500).cast("string")).alias("name")
    )
    return ls.single_doc_corpora(d)


@query
def doc_counts(t: Inputs) -> DataFrame:
    return ls.doc_counts(t.doc, t.places)


@query
def lang_dist_by_doc(t: Inputs) -> DataFrame:
    return ls.lang_dist_by_doc(t.sent)


@query
def no_lang_dist_by_doc(t: Inputs) -> DataFrame:
    return ls.no_lang_report(t.corp_doc, ls.no_lang_dist_by_doc(t.sent))


@query
def lang_report(t: Inputs) -> DataFrame:
    return ls.lang_report(t.doc, ls.lang_dist_by_doc(t.sent), TARGET)


@query
def lang_prop_by_doc(t: Inputs) -> DataFrame:
    return r6(lang_prop_once(t), "sq_prop")


@query
def lang_prop_report(t: Inputs) -> DataFrame:
    return r6(ls.lang_prop_report(t.doc, t.corp_doc, lang_prop_once(t)), "sq_prop")


@query
def low_count_report(t: Inputs) -> DataFrame:
    return r6(ls.low_count_report(t.doc, t.corp_doc, lang_prop_once(t)), "sq_prop")


@query
def corpus_totals(t: Inputs) -> DataFrame:
    return ls.corpus_totals(t.corp_doc, lang_prop_once(t), ("tot_cnt", "sq_cnt"))


@query
def corpus_avg_prop(t: Inputs) -> DataFrame:
    return r6(ls.corpus_avg_prop(t.corp_doc, t.corp_src, lang_prop_once(t)), "sq_prop_ave")


@query
def sent_stats_by_doc(t: Inputs) -> DataFrame:
    return r6(ls.sent_stats_by_doc(t.plain), "avg")


@query
def top_foreign_docs(t: Inputs) -> DataFrame:
    return ls.top_foreign_docs(t.doc, t.sent, TARGET)


@query
def having_foreign_gt(t: Inputs) -> DataFrame:
    return ls.having_foreign_gt(t.doc, t.corp_doc, t.sent, TARGET, n=5)


@query
def doc_total(t: Inputs) -> DataFrame:
    return ls.doc_total(t.doc, t.places, 3)


@query
def lang_dist_one_doc(t: Inputs) -> DataFrame:
    return ls.lang_dist_one_doc(t.sent, 3)


@query
def lang_dist_low_prop(t: Inputs) -> DataFrame:
    return ls.lang_dist_low_prop(t.stored, lang_prop(t))


@query
def dup_report(t: Inputs) -> DataFrame:
    return ls.dup_report(t.plain)


@query
def dedup_exact(t: Inputs) -> DataFrame:
    return cu.dedup_exact(t.plain.select("doc_id", "six", "sent", "toklen"))


@query
def distinct_values(t: Inputs) -> DataFrame:
    return ls.distinct_values(words_as_tokens(t), "token")


@query
def sum_tokens_chars(t: Inputs) -> DataFrame:
    return ls.sum_tokens_chars(t.plain)


@query
def max_cast(t: Inputs) -> DataFrame:
    return ls.max_cast(t.doc)


@query
def corpus_stats(t: Inputs) -> DataFrame:
    return rp.corpus_stats(t.corp_doc, t.doc, t.plain)


@query
def corpus_sources(t: Inputs) -> DataFrame:
    return rp.corpus_sources(t.corp_src, t.corp_doc, t.doc, t.places)


@query
def cohen_kappa(t: Inputs) -> DataFrame:
    d = t.read("labels").join(t.documents.select("doc_id", "lang", "source"), "doc_id")
    return r6(
        rp.cohen_kappa(d, {"flags": ("quality", "toxic"), "same": ("quality", "quality")}), "value"
    )


@query
def toklen_histogram(t: Inputs) -> DataFrame:
    return r6(rp.toklen_histogram(t.plain), "lo", "hi")


@query
def classification_metrics(t: Inputs) -> DataFrame:
    return r6(rp.classification_metrics(t.read("labels"), "quality", "toxic"), "value")


# --- windows, order, limits ------------------------------------------------


@query
def sentence_index(t: Inputs) -> DataFrame:
    return od.sentence_index(t.paragraphs)


@query
def chunk_docs(t: Inputs) -> DataFrame:
    """Chunks of the target-language sentences, whose index has gaps."""
    return od.chunk_docs(ls_target(t).select("doc_id", "six"), 20)


@query
def chunk_docs_sql(t: Inputs) -> DataFrame:
    """The same pieces by a table function in SQL, each given when it is full."""
    tablefns.register(t.spark)
    view = f"sents_{uuid.uuid4().hex}"
    t.sent.filter(F.col("lang") == TARGET).select("doc_id", "six", "sent").createOrReplaceTempView(view)
    out = t.spark.sql(
        f"SELECT p.* FROM doc_chunks(TABLE({view}) PARTITION BY (doc_id) ORDER BY (six), 20) AS p"
    )
    t.spark.catalog.dropTempView(view)
    pieces = F.explode(F.arrays_zip("six", "sents")).alias("s")
    return out.select("doc_id", "chunk_id", pieces).select("doc_id", "s.six", "chunk_id", F.col("s.sents").alias("sent"))


@query
def token_index(t: Inputs) -> DataFrame:
    return od.token_index(t.tokens).select("doc_id", "six", F.inline("tokens"))


@query
def dedup_rank(t: Inputs) -> DataFrame:
    return cu.dedup_rank(t.plain.select("doc_id", "six", "sent", "toklen"))


@query
def ordered_export(t: Inputs) -> DataFrame:
    return od.ordered_export(t.plain.select("doc_id", "six", "sent"), 5000)


@query
def bottom_k_docs(t: Inputs) -> DataFrame:
    return ls.bottom_k_docs(t.stored.select("doc_id", "six", "sent"), lang_prop(t))


@query
def sorted_peek(t: Inputs) -> DataFrame:
    return od.sorted_peek(t.plain.select("doc_id", "six", "sent"))


@query
def sample_limit(t: Inputs) -> DataFrame:
    return od.sample_limit(t.sent.select("doc_id", "six", "lang", "toklen"), 50, ["doc_id", "six"])


@query
def shuffle_docs(t: Inputs) -> DataFrame:
    """The shuffled order, as positions of the documents in it."""
    first = od.shuffle_docs(t.plain.select("doc_id", "six", "sent"), SEED)
    return first.withColumn("doc_hash", od.seeded_hash(SEED, "doc_id"))


@query
def insert_select(t: Inputs) -> DataFrame:
    keep = sent_keep(t).select("doc_id", "six", "sent", "toklen")
    return cu.insert_select(keep, t.stored, t.corp_doc, "src3", TARGET)


@query
def split_words(t: Inputs) -> DataFrame:
    return vo.split_words(t.plain)


# --- curation, vocabulary --------------------------------------------------


@query
def final_sent(t: Inputs) -> DataFrame:
    return flat_sent(cu.final_sent(t.plain))


@query
def curate_corpus(t: Inputs) -> DataFrame:
    return flat_sent(curated(t))


@query
def build_vocab(t: Inputs) -> DataFrame:
    return vo.build_vocab(curated(t))


# --- training data ---------------------------------------------------------


@query
def train_test_split(t: Inputs) -> DataFrame:
    sent = staged(t.plain.select("doc_id", "six", "sent"), "sent")
    return ds.train_test_split(sent, ["doc_id", "six"], 0.25, SEED)


@query
def stratified_split(t: Inputs) -> DataFrame:
    return ds.stratified_split(t.read("labels"), ["doc_id"], "quality", seed=SEED)


@query
def text_batches(t: Inputs) -> DataFrame:
    return ds.text_batches(t.plain, 1000).select("batch_id", joined("texts", "\n"))


@query
def vocab_target(t: Inputs) -> DataFrame:
    return ds.vocab_target(ls.distinct_values(words_as_tokens(t), "token"))


@query
def word_freq(t: Inputs) -> DataFrame:
    return ds.word_freq(t.plain)


@query
def pair_freq(t: Inputs) -> DataFrame:
    return ds.pair_freq(ds.word_freq(t.plain))


def with_vocabulary(t: Inputs) -> tuple[DataFrame, DataFrame]:
    """Sentences and vocabulary as tables of their own, built once."""
    sent = staged(t.plain.select("doc_id", "six", "sent"), "sent")
    return sent, vo.vocab_ids(vo.count_vocab(sent), ds.FIRST_TOKEN_ID)


def encoded(t: Inputs) -> DataFrame:
    return ds.encode_tokens(*with_vocabulary(t))


@query
def encode_tokens(t: Inputs) -> DataFrame:
    return encoded(t).select("doc_id", "six", joined("input_ids"), joined("word_ids"))


@query
def pack_sequences(t: Inputs) -> DataFrame:
    return ds.pack_sequences(encoded(t)).select(
        "batch_id", "chunk_no", joined("input_ids"), joined("word_ids")
    )


@query
def copy_labels(t: Inputs) -> DataFrame:
    return ds.copy_labels(ds.pack_sequences(encoded(t).drop("word_ids"))).select(
        "batch_id", "chunk_no", joined("input_ids"), joined("labels")
    )


@query
def mask_whole_word(t: Inputs) -> DataFrame:
    d = ds.mask_whole_word(ds.pack_sequences(encoded(t)), seed=SEED)
    return d.select("batch_id", "chunk_no", joined("input_ids"), joined("labels"))


@query
def mask_tokens(t: Inputs) -> DataFrame:
    sent, ids = with_vocabulary(t)
    size = ids.count() + ds.FIRST_TOKEN_ID
    enc = ds.encode_tokens(sent, ids).drop("word_ids")
    d = ds.mask_tokens(ds.pack_sequences(enc), vocab_size=size, seed=SEED)
    return d.select("batch_id", "chunk_no", joined("input_ids"), joined("labels"))


@query
def steps_per_epoch(t: Inputs) -> DataFrame:
    return ds.steps_per_epoch(t.places)


@query
def one_hot_topic(t: Inputs) -> DataFrame:
    d = ds.one_hot_topic(t.read("events"), TOPIC, "event_type")
    return d.select("event_id", joined("top"))


@query
def one_hot_emotion(t: Inputs) -> DataFrame:
    d = ds.one_hot_emotion(t.read("conversations"), ("user", "assistant"), "role")
    return d.select("conv_id", "turn", joined("emot"))


@query
def label_index(t: Inputs) -> DataFrame:
    return ds.label_index(t.read("events"), TOPIC, "event_type").select("event_id", "label_idx")


@query
def propagate_labels(t: Inputs) -> DataFrame:
    d = t.documents.select(
        "text", F.col("source").alias("topic"), F.col("lang").alias("emotion"),
        F.lit("n").alias("label"),
    )
    return ds.propagate_labels(d)
