"""Incremental curation against curation of the whole corpus."""

import pytest
from pyspark.sql import functions as F

from textloom import schemas
from textloom.operators import curate as cu
from textloom.streaming.curation import Curation

PARAMS = cu.CurateParams(min_cnt=3, min_prop=0.5, min_avg=10, exclude_sources=("bad",), lo_tokens=2, min_chars=5)
HOT = "This line is in every one of them."
TEXTS = {
    k: "\n".join([HOT, f"A first line of number {k} here.", f"Shared by pairs, line {k // 2}.", f"The end of {k} comes now."])
    for k in range(12)
} | {12: "Too short.", 13: "", 14: None}
PARTS = [[0, 3, 6, 9, 12, 13], [1, 4, 7, 10, 14], [2, 5, 8, 11]]


def names(doc):
    return doc.select("doc_id", F.when(F.col("doc_id") == 4, "bad").otherwise("good").alias("name"))


def deliver(spark, src, ids):
    rows = spark.createDataFrame([(k, TEXTS[k]) for k in ids], "doc_id bigint, text string")
    rows.coalesce(1).write.mode("append").parquet(src)


def curation(spark, tmp_path, kind=Curation):
    src = str(tmp_path / "in")
    return src, kind(spark, src, "documents", str(tmp_path / "out"), "en", PARAMS, lang="en", names=names)


def rows(df):
    return sorted((r.doc_id, r.six, r.sid, r.sent, r.toklen) for r in df.collect())


def whole(spark, out):
    """The same corpus curated at once."""
    sent = spark.read.schema(schemas.SENT).parquet(f"{out}/sent").drop("batch")
    doc = spark.read.schema("doc_id bigint, file string").parquet(f"{out}/doc").drop("batch")
    return rows(cu.curate(doc, names(doc), sent, "en", PARAMS))


def test_any_order_of_batches(spark, tmp_path):
    src, c = curation(spark, tmp_path)
    for k in (2, 0, 1):
        deliver(spark, src, PARTS[k])
        c.update()
    got = rows(c.sentences())
    assert got == whole(spark, c.out)
    assert [r[0] for r in got if r[3].startswith(HOT[:-1])] == [0], got[:4]
    assert {r.doc_id for r in c.documents().collect()} == set(range(12)) - {4}
    # Each update changes its own sentences and those that it brings a lower row of.
    changed = [r.n for r in spark.read.parquet(f"{c.out}/changes").groupBy("batch").agg(F.count("*").alias("n")).collect()]
    assert len(changed) == 3 and sum(changed) < 3 * len(got)


class Lost(Curation):
    """Fails once after a batch has been written, at each of its steps."""

    failed = frozenset()

    def _fail(self, step):
        if step not in self.failed:
            self.failed = self.failed | {step}
            raise RuntimeError(step)

    def _curate(self, sent, doc, batch_id):
        super()._curate(sent, doc, batch_id)
        self._fail(f"curate {batch_id}")

    def _changes(self, changed, batch_id):
        super()._changes(changed, batch_id)
        self._fail(f"changes {batch_id}")


def test_repeated_batches(spark, tmp_path):
    src, c = curation(spark, tmp_path, Lost)
    for ids in (PARTS[0] + PARTS[2], PARTS[1]):
        deliver(spark, src, ids)
        for _ in range(2):
            with pytest.raises(Exception, match="curate|changes"):
                c.update()
        c.update()
    assert len(c.failed) == 4 and rows(c.sentences()) == whole(spark, c.out)


def test_a_document_of_two_batches_fails(spark, tmp_path):
    src, c = curation(spark, tmp_path)
    deliver(spark, src, PARTS[0])
    c.update()
    before = rows(c.sentences())
    deliver(spark, src, [3, 5])
    with pytest.raises(Exception, match=r"several batches: \[3\]"):
        c.update()
    assert rows(c.sentences()) and {r[3] for r in rows(c.sentences())} == {r[3] for r in before}


def test_no_files_and_no_global_rank(spark, tmp_path):
    (tmp_path / "in").mkdir()
    _, c = curation(spark, tmp_path)
    c.update()
    assert c.sentences().count() == 0 and c.documents().count() == 0
    with pytest.raises(ValueError, match="drop_first"):
        Curation(spark, "", "documents", "", "en", cu.CurateParams(drop_first=1))
