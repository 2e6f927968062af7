"""Exact deduplication as a stateful stream.

Keyed state on disk (RocksDB, without expiry) holds for each digest the stable
identifier of the row to keep, the locator of its content and the number of
rows. Rows that hit a digest are compared with the located bytes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.arrays import lower_ascii
from textloom.session import new_path, staged

#: State on disk; between batches it lies in the shared checkpoint only, so that
#: executors hold the files of the partitions at work and not of all.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}

#: Rows of a group that are compared with one copy of its located text.
PART = 256
#: A text with more than this share of the rows (one in so many) meets its state in as
#: many parts; there can't be more such texts.
SHARE = 64


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _keyed(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """doc_id, normalised text, digest, and where the row's content lies."""
    meta = docs.metadataColumn("_metadata")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        lower_ascii(F.col("text")).alias("norm"),
        F.struct(meta["file_path"].alias("file"), meta["row_index"].alias("row")).alias("at"),
    ).withColumn("digest", digest(F.col("norm")))


def digest_state(
    spark: SparkSession,
    path: str,
    checkpoint: str,
    digest: Callable[[Column], Column] = sha256,
    **options: str,
) -> DataFrame:
    """Runs the stream over all files below ``path`` that ``checkpoint`` has not
    seen yet, and returns the state: digest, keep (doc_id and locator), n.

    Rows of a digest meet as one partial row per task, so a very frequent text
    is no hot key. ``options`` are the file source's (``maxFilesPerTrigger``,
    ``maxBytesPerTrigger``) and bound a batch; the state is the same for any.
    """
    path = path.rstrip("/")
    schema = spark.read.parquet(path).schema
    # As a pattern, the path may name a file as well as a folder.
    docs = spark.readStream.schema(schema).options(**options).parquet(f"{path[:-1]}[{path[-1]}]")
    counted = (
        _keyed(docs, digest)
        .groupBy("digest")
        .agg(F.max(F.struct("doc_id", "at")).alias("keep"), F.count(F.lit(1)).alias("n"))
    )
    before = {key: spark.conf.get(key, None) for key in SETTINGS}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    try:
        run = (
            counted.writeStream.format("noop")
            .outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        run.awaitTermination()
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    state = spark.read.format("statestore").load(checkpoint)
    return state.select("key.digest", F.col("value.max").alias("keep"), F.col("value.count").alias("n"))


def exact_copies(
    spark: SparkSession,
    path: str,
    digest: Callable[[Column], Column] = sha256,
    checkpoint: str | None = None,
    **options: str,
) -> DataFrame:
    """Groups of texts that are equal after lower-casing A-Z.

    Reads every row below ``path`` (Parquet with doc_id, text; null text is
    empty) and returns for each: doc_id, keep_id, group_size, kept,
    text_sha256. Of a group the row with the largest doc_id stays, of repeated
    rows of that id the last by file and position, so exactly one is kept; ids
    that are null come last. An empty table gives no rows.

    Texts of one digest that differ in their bytes are separate groups.
    """
    state = staged(
        digest_state(spark, path, checkpoint or new_path(spark, "stream"), digest, **options), "state"
    )
    if not state.take(1):
        state = state.limit(0)
    rows = _keyed(spark.read.parquet(path), digest).withColumn("sha", sha256(F.col("norm")))
    several = F.col("n") > 1
    total = state.agg(F.sum("n").alias("n")).first().n or 0
    frequent = state.filter((F.col("n") > PART) & (F.col("n") * SHARE > total)).select("digest").collect()
    often = F.col("digest").isin([r.digest for r in frequent]) if frequent else F.lit(False)
    salt = F.when(often, F.pmod(F.xxhash64("doc_id", "at.row"), F.lit(SHARE)).cast("int")).otherwise(0)
    salts = F.when(often, F.sequence(F.lit(0), F.lit(SHARE - 1))).otherwise(F.array(F.lit(0)))
    state = state.withColumn("salt", F.explode(salts))
    grouped = staged(
        rows.withColumn("salt", salt).join(state, ["digest", "salt"]).select(
            "digest",
            "at",
            "doc_id",
            "sha",
            "n",
            F.col("keep.doc_id").alias("keep_id"),
            (F.col("at") == F.col("keep.at")).alias("kept"),
            F.when(several, F.col("norm")).alias("norm"),
        ),
        "grouped",
    )
    # A large group is dealt out in parts, each with the located text beside it.
    parts = (F.col("n") / PART).cast("int") + 1
    located = grouped.filter(several & F.col("kept")).select(
        "digest", F.col("norm").alias("located"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")
    )
    same = F.col("norm") == F.col("located")
    hits = staged(
        grouped.filter(several)
        .withColumn("part", F.pmod(F.xxhash64("doc_id"), parts).cast("int"))
        .join(located, ["digest", "part"])
        .select(
            "digest", "at", "doc_id", "sha", "n", "keep_id", "kept",
            same.alias("same"), F.when(~same, F.col("norm")).alias("norm"),
        ),
        "hits",
    )
    apart = hits.filter("not same")
    fewer = apart.groupBy("digest").agg(F.count("*").alias("apart"))
    other = apart.groupBy("digest", "norm").agg(F.max(F.struct("doc_id", "at")).alias("keep"), F.count("*").alias("n"))
    out = ["doc_id", "keep_id", F.col("n").alias("group_size"), "kept", F.col("sha").alias("text_sha256")]
    hit = (
        hits.filter("same")
        .join(fewer, "digest", "left")
        .withColumn("n", F.col("n") - F.coalesce("apart", F.lit(0)))
        .select(out)
    )
    collided = (
        apart.select("digest", "norm", "doc_id", "sha", "at")
        .join(other, ["digest", "norm"])
        .withColumn("kept", F.col("at") == F.col("keep.at"))
        .withColumn("keep_id", F.col("keep.doc_id"))
        .select(out)
    )
    return grouped.filter("n = 1").select(out).unionByName(hit).unionByName(collided)


def oracle_sql() -> str:
    """The same over ``documents`` with distinct ids."""
    return """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""
