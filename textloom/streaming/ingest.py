"""Incremental ingest of new files with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom import schemas
from textloom.plans.tables import sentence_columns, sentences_of, with_lang
from textloom.session import staged
from textloom.sources import readers

DOCUMENTS = "doc_id bigint, text string"


def _documents(spark: SparkSession, path: str, **options: str) -> DataFrame:
    return spark.readStream.schema(DOCUMENTS).options(**options).parquet(path)


def _crawl(spark: SparkSession, path: str, **options: str) -> DataFrame:
    return (
        spark.readStream.schema(schemas.CRAWL)
        .option("mode", "FAILFAST")
        .options(**options)
        .json(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            "content",
            "metadata",
            F.col("_metadata.file_block_start").alias("_block"),
        )
    )


def _xml(spark: SparkSession, path: str, **options: str) -> DataFrame:
    return (
        spark.readStream.format("xml")
        .schema(schemas.TOK_XML)
        .option("rowTag", "s")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .option("ignoreSurroundingSpaces", "false")
        .options(**options)
        .load(path)
        .select(
            "*",
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("_block"),
        )
    )


def _parse_documents(batch: DataFrame, target: str) -> DataFrame:
    return sentences_of(batch).withColumn("file", F.col("doc_id").cast("string"))


def _parse_crawl(batch: DataFrame, target: str) -> DataFrame:
    placed = batch.withColumn("_row", F.monotonically_increasing_id())
    return readers.crawl_sentences(placed, target)


def _parse_xml(batch: DataFrame, target: str) -> DataFrame:
    placed = batch.withColumn("_row", F.monotonically_increasing_id())
    return readers.xml_sentences(readers.good_files(placed)[0], F.col("w"))


FORMATS: dict[str, tuple[Callable, Callable]] = {
    "documents": (_documents, _parse_documents),
    "crawl": (_crawl, _parse_crawl),
    "tok_xml": (_xml, _parse_xml),
}


def ingest_stream(
    spark: SparkSession, path: str, fmt: str, checkpoint: str, out: str,
    lang: str | None = None, target: str = "en",
    then: Callable[[DataFrame, DataFrame, int], None] | None = None, **options: str,
) -> StreamingQuery:
    """Parses files that are new since the last run into ``out/doc`` and
    ``out/sent``.

    A file is always whole within one batch, so sentences number as in a
    batch read. Document ids go on from those of earlier batches. A batch
    writes its own folders and overwrites them when it is repeated: results
    stay exactly-once. ``then`` is called with the sentences and documents that a
    batch has written and its number, again where the batch is repeated.
    ``options`` such as ``maxFilesPerTrigger`` or
    ``maxBytesPerTrigger`` bound a batch.
    """
    source, parse = FORMATS[fmt]

    def load(batch: DataFrame, batch_id: int) -> None:
        rows = staged(parse(batch, target), "parsed")
        docs = rows.select("file", "doc_id").distinct()
        if fmt != "documents" and batch_id > 0:
            top = (
                spark.read.parquet(f"{out}/doc").filter(F.col("batch") < batch_id)
                .agg(F.coalesce(F.max("doc_id") + 1, F.lit(0)).alias("n")).scalar()
            )
            rows = rows.withColumn("doc_id", F.col("doc_id") + top)
            docs = docs.withColumn("doc_id", F.col("doc_id") + top)
        sents = with_lang(sentence_columns(rows), lang).select(*schemas.SENT_COLUMNS)
        sents.write.mode("overwrite").parquet(f"{out}/sent/batch={batch_id}")
        docs.write.mode("overwrite").parquet(f"{out}/doc/batch={batch_id}")
        if then is not None:
            written = (
                spark.read.schema(df.schema).parquet(f"{out}/{name}/batch={batch_id}")
                for name, df in (("sent", sents), ("doc", docs))
            )
            then(*written, batch_id)

    return (
        source(spark, path, **options)
        .writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
