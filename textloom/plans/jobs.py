"""End-to-end jobs over corpus tables stored below one folder."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom import schemas
from textloom.functions.langprofile import LangProfile
from textloom.operators import curate as cu
from textloom.operators import dataset as ds
from textloom.operators import reports as rp
from textloom.operators import vocab as vo
from textloom.operators.ordering import dense_ids
from textloom.plans.tables import corp_doc_of, sentence_columns, with_lang
from textloom.session import staged
from textloom.sources import readers, writers


@dataclass
class Store:
    """Corpus tables as Parquet folders below ``path``."""

    spark: SparkSession
    path: str

    def exists(self, name: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def table(self, name: str) -> DataFrame:
        ddl = schemas.TABLES[name]
        if not self.exists(name):
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.schema(ddl).parquet(f"{self.path}/{name}")

    def write(self, name: str, df: DataFrame, mode: str) -> None:
        df.write.mode(mode).option("compression", "zstd").parquet(f"{self.path}/{name}")


def relative_path(file: F.Column, base: str | None) -> F.Column:
    """A file's path below ``base``, without a URI scheme."""
    plain = F.regexp_replace(file, "^[a-z0-9]+:/+", "/")
    if base is None:
        return plain
    base = re.sub("^[a-z0-9]+:/+", "/", base).strip("/")
    return F.regexp_replace(plain, rf"^.*?\Q{base}\E/", "")


def build_corpus(
    spark: SparkSession,
    inputs: Mapping[str, str],
    path: str,
    lang: str | None = None,
    recreate: bool = False,
    force: bool = False,
    sources: str | None = None,
    base: str | None = None,
    offset: int = 4,
    target: str = "en",
    glob: str | None = None,
    profile: LangProfile | None = None,
) -> Store:
    """Reads, parses and loads files into doc, sent, corp_doc and corp_src.

    ``inputs`` maps reader names to folders. A corpus with sentences stays as
    it is unless ``force`` is given; with ``recreate`` it is replaced, else
    appended to. New document ids go on from the largest one. Without ``lang`` the
    language is detected, by ``profile`` where one is given. A file whose path below
    ``base`` has no source id fails the build.
    """
    store = Store(spark, path)
    if not (force or recreate) and not store.table("sent").isEmpty():
        return store

    def read(fmt: str, src: str) -> DataFrame:
        args = {"target": target} if fmt == "crawl" else {}
        if glob is not None:
            args["glob"] = glob
        rows = readers.READERS[fmt](spark, src, **args)
        # A page of a dump is a document of its own; elsewhere a file is one.
        doc = F.concat_ws("#", "file", F.col("doc_id").cast("string")) if fmt == "wiki" else F.col("file")
        return rows.select(doc.alias("file"), "six", "sid", "tokens")

    parsed = reduce(DataFrame.unionAll, [read(f, s) for f, s in inputs.items()])
    if not set(inputs) <= readers.WRITTEN:
        parsed = staged(parsed, "parsed")
    mode = "overwrite" if recreate else "append"
    old = spark.createDataFrame([], schemas.DOC) if recreate else store.table("doc")
    top = old.agg(F.coalesce(F.max("doc_id") + 1, F.lit(0)).alias("n")).scalar()
    top_dir = old.agg(
        F.coalesce(F.max(F.col("dir_id").try_cast("decimal(38,0)")) + 1, F.lit(0)).alias("n")
    ).scalar()
    ids = staged(
        dense_ids(parsed, "file", "_id").select(
            F.col("file").alias("_file"),
            (F.col("_id") + top).cast("bigint").alias("doc_id"),
            (F.col("_id") + top_dir).cast("bigint").cast("string").alias("dir_id"),
        ),
        "ids",
    )
    doc = ids.select("doc_id", "dir_id", relative_path(F.col("_file"), base).alias("file"))
    sent = parsed.withColumnRenamed("file", "_file").join(ids.select("_file", "doc_id"), "_file")
    sent = with_lang(sentence_columns(sent), lang, profile).select(*schemas.SENT_COLUMNS)
    store.write("sent", sent, mode)
    store.write("doc", doc, mode)
    store.write("corp_doc", corp_doc_of(store.table("doc"), offset), "overwrite")
    if sources is not None:
        store.write("corp_src", readers.read_sources(spark, sources), "overwrite")
    return store


def curate_corpus(store: Store, target: str, params: cu.CurateParams = cu.CurateParams()) -> DataFrame:
    """Curated sentences of a stored corpus."""
    return cu.curate(
        store.table("doc"), store.table("corp_doc"), store.table("sent"), target, params
    )


def build_vocab(sent: DataFrame) -> DataFrame:
    return vo.build_vocab(sent)


def build_dataset(
    sent: DataFrame,
    vocab: DataFrame,
    test_size: float = 0.25,
    chunk_size: int = 16,
    batch: int = 1000,
    mask: str = "token",
    p: float = 0.15,
    seed: int = 0,
    epoch: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """Split, encoded, packed and masked examples: (packed, masked).

    Splits are packed apart, so no chunk mixes them. ``mask`` is ``token`` or
    ``word``.
    """
    ids = vo.vocab_ids(vocab, ds.FIRST_TOKEN_ID)
    split = staged(
        ds.train_test_split(sent.select("doc_id", "six", "sent"), ["doc_id", "six"], test_size, seed),
        "split",
    )

    def pack(name: str) -> DataFrame:
        enc = ds.encode_tokens(split.filter(F.col("split") == name), ids)
        return ds.pack_sequences(enc, chunk_size, batch).withColumn("split", F.lit(name))

    packed = staged(ds.copy_labels(pack("train").unionByName(pack("test"))), "packed")

    def masked(name: str) -> DataFrame:
        part = packed.filter(F.col("split") == name)
        if mask == "word":
            out = ds.mask_whole_word(part, p, seed=seed, epoch=epoch)
        else:
            size = ids.agg(F.count("*") + ds.FIRST_TOKEN_ID).first()[0]
            out = ds.mask_tokens(part, size, p, seed=seed, epoch=epoch)
        return out.withColumn("split", F.lit(name))

    return packed, masked("train").unionByName(masked("test"))


def print_stats(corp_doc: DataFrame, doc: DataFrame, sent: DataFrame) -> DataFrame:
    """The statistics table, also shown to the caller."""
    stats = rp.corpus_stats(corp_doc, doc, sent)
    rows = stats.collect()
    for row in rows:
        print(f"{row['description']}: {row['value']}")
    return sent.sparkSession.createDataFrame(rows, stats.schema)


def write_stats(
    corp_src: DataFrame, corp_doc: DataFrame, doc: DataFrame, sent: DataFrame, path: str,
    annotations: DataFrame | None = None,
) -> None:
    """Statistics, sources and agreement as described CSV tables."""
    tables = {
        "corpus_statistics": writers.describe(
            rp.corpus_stats(corp_doc, doc, sent),
            "Corpus Statistics", {"description": "Description", "value": "Count"},
        ),
        "corpus_sources": writers.describe(
            rp.corpus_sources(corp_src, corp_doc, doc, sent),
            "Corpus Sources", {"name": "Name", "url": "URL", "count": "Count"},
        ),
    }
    if annotations is not None:
        pairs = {c: (f"a1_{c}", f"a2_{c}") for c in ("topic", "emotion", "label")}
        tables["kappa_scores"] = writers.describe(
            rp.cohen_kappa(annotations, pairs), "Kappa Scores", {}
        )
    writers.write_report(tables, path)


def dump_corpus(
    sent: DataFrame, path: str, row_size: int = 5000, file_limit: int | None = None, seed: int = 0
) -> None:
    writers.dump_csv(sent, path, row_size, file_limit, seed)

