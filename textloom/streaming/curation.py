"""Incremental curation: a new batch meets keyed state, not the batches before it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom import schemas
from textloom.operators import curate as cu
from textloom.operators.joins import join_sent_keep
from textloom.plans.tables import corp_doc_of
from textloom.streaming.ingest import ingest_stream

#: State on disk, in the shared checkpoint only between batches.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}

KEPT = f"doc_id bigint, six int, sid string, sent string, spans {schemas.SPANS}, toklen int"
KEEP = (
    "doc_id bigint, name string, file string, sq_cnt bigint, tot_cnt bigint, sq_prop double, avg double, min int"
)
SEEN = "doc_id bigint"


@contextmanager
def _disk_state(spark: SparkSession) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in STATE}
    for key, value in STATE.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _keyed(spark: SparkSession, path: str, schema: str, key: str, value: F.Column, checkpoint: str,
           each: Callable[[DataFrame, int], None]) -> None:
    """Runs ``value`` per ``key`` as state over the files below ``path`` that are new
    to ``checkpoint``; ``each`` gets the keys that a batch has changed."""
    changed = spark.readStream.schema(schema).parquet(path).groupBy(key).agg(value.alias("value"))
    with _disk_state(spark):
        run = changed.writeStream.outputMode("update").foreachBatch(each)
        run.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class Curation:
    """A curated corpus below ``out`` that grows with the files below ``path``.

    ``update`` takes the files that are new. Its batches are parsed, profiled and
    cleaned by themselves, as a file and so a document is whole within one batch,
    and leave one candidate row of each sentence. Two streams with keyed state on disk
    then see the candidates and document ids of new batches only: for each
    sentence the lowest (doc_id, six), and for each document the number of
    batches that brought it.

    Folders: ``sent`` and ``doc`` as ``ingest_stream`` writes them, ``keep`` (the kept
    documents with their profiles), ``kept`` (candidates), ``changes`` (what each
    update made a sentence's survivor), ``state``. A batch overwrites its own
    folders and minima do not depend on order, so a repeated batch, a lost
    executor and any order of the files give the same rows as ``curate`` over
    ``sent`` and ``doc``. Formats without document ids number files as they
    come, so there the order decides which copy of a sentence stays.

    ``names`` gives (doc_id, name) for the documents of a batch, by default from
    their paths. A document that two batches bring would have a profile from parts;
    the update that meets it fails before the survivors change. ``drop_first``
    ranks the whole corpus and is not open to batches.
    """

    def __init__(
        self, spark: SparkSession, path: str, fmt: str, out: str, target: str,
        params: cu.CurateParams = cu.CurateParams(), lang: str | None = None,
        names: Callable[[DataFrame], DataFrame] = corp_doc_of, **options: str,
    ):
        if params.drop_first:
            raise ValueError("drop_first ranks all sentences; apply it to the whole corpus")
        self.spark, self.path, self.fmt, self.out, self.target = spark, path, fmt, out.rstrip("/"), target
        self.params, self.lang, self.names, self.options = params, lang, names, options

    def _folder(self, name: str, batch_id: int) -> str:
        return f"{self.out}/{name}/batch={batch_id}"

    def _curate(self, sent: DataFrame, doc: DataFrame, batch_id: int) -> None:
        """Kept documents and candidate sentences of one batch."""
        keep = cu.doc_keep(doc, self.names(doc), sent, self.target, self.params)
        keep.write.mode("overwrite").parquet(self._folder("keep", batch_id))
        keep = self.spark.read.schema(KEEP).parquet(self._folder("keep", batch_id))
        clean = cu.clean_sents(join_sent_keep(sent, keep, self.target), self.params)
        rows = cu.final_sent(cu.dedup_exact(clean))
        rows.write.mode("overwrite").parquet(self._folder("kept", batch_id))
        doc.select("doc_id").distinct().write.mode("overwrite").parquet(self._folder("seen", batch_id))

    @staticmethod
    def _once(changed: DataFrame, batch_id: int) -> None:
        twice = changed.filter("value > 1").select("doc_id").orderBy("doc_id").limit(5).collect()
        if twice:
            raise ValueError(f"documents of several batches: {[r.doc_id for r in twice]}")

    def _changes(self, changed: DataFrame, batch_id: int) -> None:
        rows = changed.select("value.doc_id", "value.six", "sent")
        rows.write.mode("overwrite").parquet(self._folder("changes", batch_id))

    def update(self) -> None:
        """Takes all new files."""
        ingest_stream(
            self.spark, self.path, self.fmt, f"{self.out}/state/files", self.out, lang=self.lang,
            target=self.target, then=self._curate, **self.options,
        ).awaitTermination()
        if not _exists(self.spark, f"{self.out}/kept"):
            return
        _keyed(
            self.spark, f"{self.out}/seen", SEEN, "doc_id", F.count(F.lit(1)), f"{self.out}/state/documents", self._once
        )
        first = F.min(F.struct("doc_id", "six"))
        _keyed(self.spark, f"{self.out}/kept", KEPT, "sent", first, f"{self.out}/state/sentences", self._changes)

    def documents(self) -> DataFrame:
        """The kept documents with their profiles."""
        if not _exists(self.spark, f"{self.out}/keep"):
            return self.spark.createDataFrame([], KEEP)
        return self.spark.read.schema(KEEP).parquet(f"{self.out}/keep").drop("batch")

    def sentences(self) -> DataFrame:
        """The curated sentences after the last update."""
        if not _exists(self.spark, f"{self.out}/changes"):
            return self.spark.createDataFrame([], KEPT)
        state = self.spark.read.format("statestore").load(f"{self.out}/state/sentences")
        best = state.select(F.col("value.min.doc_id").alias("doc_id"), F.col("value.min.six").alias("six"))
        kept = self.spark.read.schema(KEPT).parquet(f"{self.out}/kept")
        return kept.join(best, ["doc_id", "six"], "left_semi").drop("batch")
