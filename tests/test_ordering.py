"""Ranks and limits against plain sorting, with blocks small enough to cross."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import ordering as od


@pytest.fixture(scope="module")
def skewed(spark):
    """One document holds most rows, and positions have gaps."""
    rng = random.Random(1)
    rows = [(0, i * 3, f"s{rng.randrange(50)}") for i in range(3000)]
    rows += [(d, i, f"s{rng.randrange(50)}") for d in range(1, 300) for i in range(rng.randrange(4))]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "doc_id bigint, six int, sent string").repartition(7)


def test_rank_in_doc(skewed, monkeypatch):
    rows, df = skewed
    monkeypatch.setattr(od, "BLOCK_BITS", 5)
    got = {(r.doc_id, r.six): r["rank"] for r in od.rank_in_doc(df).collect()}
    want, seen = {}, {}
    for d, i, _ in sorted(rows):
        want[d, i] = seen.get(d, 0)
        seen[d] = want[d, i] + 1
    assert got == want


def test_chunks(skewed):
    rows, df = skewed
    out = od.chunk_docs(df, 500).groupBy("doc_id", "chunk_id").count().collect()
    assert max(r["count"] for r in out) == 500
    assert sum(r["count"] for r in out) == len(rows)


def test_sentence_index(spark, monkeypatch):
    monkeypatch.setattr(od, "BLOCK_BITS", 2)
    paras = [(d, p, "a. " * (p % 3) + "tail") for d in range(3) for p in range(40)]
    df = spark.createDataFrame(paras, "doc_id bigint, para_no int, para string")
    got = sorted((r.doc_id, r.six, r.sid) for r in od.sentence_index(df).collect())
    n = sum(p % 3 for p in range(40))
    assert got == sorted((d, i, str(i)) for d in range(3) for i in range(n))


def test_indexed_table_and_first_n(skewed, monkeypatch):
    rows, df = skewed
    order = ["sent", "doc_id", "six"]
    want = sorted(rows, key=lambda r: (r[2], r[0], r[1]))
    got = sorted(od.indexed_table(df, order).collect(), key=lambda r: r.idx)
    assert [(r.doc_id, r.six, r.sent) for r in got] == want
    assert [r.idx for r in got] == list(range(len(want)))


@pytest.mark.parametrize("size, pivots, prefix", [(1 << 14, 64, 24), (7, 3, 1), (1, 64, 2)])
def test_first_n(spark, monkeypatch, size, pivots, prefix):
    """One text in half of the rows, nulls, long common beginnings, equal rows."""
    for name, value in (("SLICE", size), ("PIVOTS", pivots), ("PREFIX", prefix)):
        monkeypatch.setattr(od, name, value)
    draw = random.Random(2)
    texts = ["same"] * 120 + [None] * 9 + ["", "a", "ab"] + ["long beginning " * 3 + str(draw.randrange(30)) for _ in range(100)]
    rows = [(t, draw.choice([None, 0.5, -1.0, 2.0]), draw.randrange(5)) for t in texts]
    df = spark.createDataFrame(rows, "t string, x double, i int").repartition(3)

    def place(r):
        return (r[0] is not None, r[0] or ""), (r[1] is None, -(r[1] or 0)), r[2]

    want = sorted(rows, key=place)
    for n in (0, 1, 5, 60, 121, 200, 500) if size > 7 else (60, 121):
        got = [tuple(r) for r in od.first_n(df, n, ["t", ("x", False), "i"]).collect()]
        assert got == want[:n]


def test_many_files_are_numbered(spark, tmp_path):
    df = spark.range(0, 300, 1, 40).select((F.col("id") * 7).alias("v"))
    placed = od.indexed_table(df, ["v"], "at").collect()
    assert all(r.v == 7 * r["at"] for r in placed) and len(placed) == 300


def test_dense_ids(spark):
    df = spark.createDataFrame([(f"k{i % 97}",) for i in range(1000)], "k string")
    ids = [r.id for r in od.dense_ids(df, "k", "id").collect()]
    assert sorted(ids) == list(range(97))


def test_shuffle_keeps_documents_together(skewed):
    _, df = skewed
    rows = [(r.doc_id, r.six) for r in od.shuffle_docs(df, 3).collect()]
    docs = [d for i, (d, _) in enumerate(rows) if i == 0 or rows[i - 1][0] != d]
    assert len(docs) == len(set(docs)) and docs != sorted(docs)
    assert all(a[0] != b[0] or a[1] < b[1] for a, b in zip(rows, rows[1:]))


def test_nest_documents(spark):
    df = spark.createDataFrame([(1, 0, 1, ["b"]), (1, 0, 0, ["a"])], "doc_id bigint, chunk_id int, six int, tokens array<string>")
    out = od.nest_documents(df.withColumn("tokens", F.col("tokens"))).first()
    assert [s.tokens for s in out.sents] == [["a"], ["b"]]
