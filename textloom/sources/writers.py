"""Corpus tables, exports and reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom import schemas
from textloom.operators.ordering import (
    indexed_table,
    ordered_export,
    read_indexed,
    seeded_hash,
)
from textloom.plans.tables import corp_doc_of
from textloom.session import new_path


def create_schema(spark: SparkSession, db: str, location: str | None = None) -> None:
    """Declares the four corpus tables."""
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {db}{where}")
    for name, ddl in schemas.TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {db}.{name} ({ddl}) USING parquet")


def _append(df: DataFrame, table: str) -> None:
    """Appends in the table's column order; no shuffle."""
    df.select(*df.sparkSession.table(table).columns).write.mode("append").insertInto(table)


def assign_dir_id(new_docs: DataFrame, existing: DataFrame) -> DataFrame:
    """Numeric directory ids that go on from the largest one, in file order."""
    top = existing.agg(
        F.coalesce(F.max(F.col("dir_id").try_cast("decimal(38,0)")), F.lit(-1)).alias("m")
    ).scalar()
    rows = indexed_table(new_docs, ["file"], "_idx")
    return rows.withColumn("dir_id", (top + F.col("_idx") + 1).cast("bigint").cast("string")).drop("_idx")


def append_docs(docs: DataFrame, table: str) -> DataFrame:
    """Appends (file) rows with new ids and returns them with those ids."""
    spark = docs.sparkSession
    old = spark.table(table)
    top = old.agg(F.coalesce(F.max("doc_id"), F.lit(-1)).alias("m")).scalar()
    numbered = assign_dir_id(docs.select("file"), old)
    rows = indexed_table(numbered, ["file"], "_idx").select(
        (top + F.col("_idx") + 1).cast("bigint").alias("doc_id"), "dir_id", "file"
    )
    # Written first, so that the ids do not depend on the table they go into.
    path = new_path(spark, "docs")
    rows.write.parquet(path)
    added = spark.read.schema(schemas.DOC).parquet(path)
    _append(added, table)
    return added


def append_sents(sents: DataFrame, table: str) -> None:
    _append(sents, table)


def recreate_or_append(df: DataFrame, table: str, recreate: bool = False) -> None:
    if recreate or not df.sparkSession.catalog.tableExists(table):
        df.write.mode("overwrite").format("parquet").saveAsTable(table)
    else:
        _append(df, table)


def load_if_empty(df: DataFrame, table: str, force: bool = False) -> bool:
    """Loads only into an empty table, unless forced."""
    spark = df.sparkSession
    if not force and spark.catalog.tableExists(table) and not spark.table(table).isEmpty():
        return False
    recreate_or_append(df, table, recreate=force)
    return True


def refresh_corp_doc(doc: DataFrame, offset: int = 4, table: str | None = None) -> DataFrame:
    """Document-to-corpus rows from the document paths, replacing ``table``."""
    rows = corp_doc_of(doc, offset)
    if table is not None:
        rows.write.mode("overwrite").format("parquet").saveAsTable(table)
    return rows


def refresh_corp_src(src: DataFrame, table: str) -> None:
    src.select("id", "name", "url").write.mode("overwrite").format("parquet").saveAsTable(table)


def insert_source(corp_src: DataFrame, id: str, name: str, url: str) -> DataFrame:
    row = corp_src.sparkSession.createDataFrame([(id, name, url)], schemas.CORP_SRC)
    return corp_src.select("id", "name", "url").unionByName(row)


def ctas(df: DataFrame, name: str, table: bool = False) -> DataFrame:
    """Keeps a result under a name: a view, or a stored table."""
    if table:
        df.write.mode("overwrite").format("parquet").saveAsTable(name)
    else:
        df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def stage_docs(docs: DataFrame, path: str) -> None:
    """Parsed sentences between parsing and loading; replaces earlier ones."""
    docs.write.mode("overwrite").parquet(path)


def dump_csv(
    sent: DataFrame, directory: str, row_size: int = 5000, file_limit: int | None = None, seed: int = 0
) -> None:
    """Seeded document order as CSV files of ``row_size`` rows each.

    A row's file follows from its position. Range partitions end between
    files, so every file but the last is full.
    """
    rows = sent.select(
        seeded_hash(seed, "doc_id").alias("_h"), F.col("doc_id").alias("did"), "six",
        F.concat_ws("-", "doc_id", "six").alias("sid"), F.col("sent").alias("text"),
    )
    placed = indexed_table(rows, ["_h", "did", "six"]).withColumn(
        "_file", F.floor(F.col("idx") / row_size)
    )
    if file_limit is not None:
        placed = placed.filter(F.col("_file") < file_limit)
    (
        placed.repartitionByRange("_file")
        .sortWithinPartitions("_file", "idx")
        .select("did", "sid", "text")
        .write.mode("overwrite")
        .option("header", "true")
        .option("escape", '"')
        .option("maxRecordsPerFile", row_size)
        .csv(directory)
    )


def write_dataset(
    sent: DataFrame, path: str, batch_size: int = 1000, sent_limit: int | None = None,
    batches_per_file: int = 1000,
) -> None:
    """Texts in corpus order; a file holds at most ``batches_per_file``
    batches."""
    (
        ordered_export(sent.select("doc_id", "six", "sent"), sent_limit)
        .select(F.col("sent").alias("text"))
        .write.mode("overwrite")
        .option("maxRecordsPerFile", batch_size * batches_per_file)
        .parquet(path)
    )


def export_with_positions(spark: SparkSession, path: str) -> DataFrame:
    """An exported dataset with each text's position."""
    return read_indexed(spark, path)


def describe(df: DataFrame, title: str, columns: Mapping[str, str]) -> DataFrame:
    """Column descriptions as metadata."""
    for name, text in columns.items():
        df = df.withMetadata(name, {"description": text, "title": title})
    return df


def write_report(tables: Mapping[str, DataFrame], path: str) -> None:
    """One CSV per result table and the column descriptions beside them."""
    spark = next(iter(tables.values())).sparkSession
    meta = []
    for name, df in tables.items():
        df.coalesce(1).write.mode("overwrite").option("header", "true").csv(f"{path}/{name}")
        for f in df.schema.fields:
            meta.append((name, f.metadata.get("title", name), f.name, f.metadata.get("description", "")))
    spark.createDataFrame(meta, "name string, title string, column string, description string").coalesce(
        1
    ).write.mode("overwrite").json(f"{path}/columns")


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)
