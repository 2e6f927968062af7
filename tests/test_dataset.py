"""Splits, packing and masking against brute force."""

import hashlib
import math

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.operators import dataset as ds
from textloom.operators import ml
from textloom.plans import jobs


@pytest.fixture(scope="module")
def enc(spark):
    rows = []
    for d in range(60):
        for i in range(d % 7):
            n = (d * 3 + i) % 11
            ids = [0] + [5 + (d + k) % 40 for k in range(n)] + [2]
            words = [None] + [k // 2 for k in range(n)] + [None]
            rows.append((d, i, ids, words))
    df = spark.createDataFrame(
        rows, "doc_id bigint, six int, input_ids array<int>, word_ids array<int>"
    ).repartition(5)
    return rows, df


def py_pack(rows, size, batch):
    out = {}
    rows = sorted(rows)
    for b in range(math.ceil(len(rows) / batch)):
        part = rows[b * batch : (b + 1) * batch]
        ids = [x for r in part for x in r[2]]
        words = [x for r in part for x in r[3]]
        for c in range(len(ids) // size):
            out[b, c] = (ids[c * size : (c + 1) * size], words[c * size : (c + 1) * size])
    return out


def py_words(words):
    cur, n, out = -1, -1, []
    for w in words:
        if w is not None and w != cur:
            cur, n = w, n + 1
        out.append(None if w is None else n)
    return out


@pytest.mark.parametrize("size,batch", [(16, 10), (7, 3), (400, 10), (5, 1000)])
def test_pack(enc, size, batch):
    rows, df = enc
    got = {(r.batch_id, r.chunk_no): (r.input_ids, r.word_ids) for r in ds.pack_sequences(df, size, batch).collect()}
    assert got == py_pack(rows, size, batch)


def test_pack_without_word_ids(enc):
    """Chunks of an input without word ids are the same, and no word ids move."""
    rows, df = enc
    out = ds.pack_sequences(df.drop("word_ids"), 16, 10)
    assert out.columns == ["batch_id", "chunk_no", "input_ids"]
    want = {k: ids for k, (ids, _) in py_pack(rows, 16, 10).items()}
    assert {(r.batch_id, r.chunk_no): r.input_ids for r in out.collect()} == want


def test_whole_word_mask(enc):
    _, df = enc
    packed = ds.pack_sequences(df, 16, 20)
    src = {(r.batch_id, r.chunk_no): r for r in packed.collect()}
    a = {(r.batch_id, r.chunk_no): r for r in ds.mask_whole_word(packed, 0.4, seed=1).collect()}
    b = {(r.batch_id, r.chunk_no): r for r in ds.mask_whole_word(packed.repartition(3), 0.4, seed=1).collect()}
    other = {(r.batch_id, r.chunk_no): r for r in ds.mask_whole_word(packed, 0.4, seed=1, epoch=1).collect()}
    assert a == b and a != other
    hit = total = 0
    for k, s in src.items():
        words, masked = py_words(s.word_ids), {}
        for i, w in enumerate(words):
            drawn = a[k].labels[i] != ds.IGNORED
            assert a[k].labels[i] in (ds.IGNORED, s.input_ids[i])
            assert a[k].input_ids[i] == (ds.SPECIAL_IDS["mask"] if drawn else s.input_ids[i])
            if w is None:
                assert not drawn
            else:
                assert masked.setdefault(w, drawn) == drawn
        hit += sum(masked.values())
        total += len(masked)
    assert 0.3 < hit / total < 0.5
    assert all(set(r.labels) == {ds.IGNORED} for r in ds.mask_whole_word(packed, 0.0).collect())


def test_token_mask(spark):
    packed = spark.range(2000).select(
        (F.col("id") % 20).alias("batch_id"), F.floor(F.col("id") / 20).cast("int").alias("chunk_no"),
        F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.when(i == 0, 2).otherwise(50 + i)).alias("input_ids"),
    )
    src = {(r.batch_id, r.chunk_no): r.input_ids for r in packed.collect()}
    kinds = {"mask": 0, "keep": 0, "random": 0}
    n = 0
    for r in ds.mask_tokens(packed, vocab_size=10_000_000, p=0.15).collect():
        s = src[r.batch_id, r.chunk_no]
        assert r.labels[0] == ds.IGNORED and r.input_ids[0] == 2
        for x, y, lab in zip(s[1:], r.input_ids[1:], r.labels[1:]):
            n += 1
            if lab == ds.IGNORED:
                assert x == y
                continue
            assert lab == x
            kinds["mask" if y == ds.SPECIAL_IDS["mask"] else "keep" if y == x else "random"] += 1
    drawn = sum(kinds.values())
    assert 0.14 < drawn / n < 0.16
    assert 0.77 < kinds["mask"] / drawn < 0.83
    assert 0.08 < kinds["random"] / drawn < 0.12


def test_token_draws_are_digests(spark):
    """Tokens are drawn by the digest of their place, in one pass and not by an expression
    per element, whatever is null."""
    rows = [(b, c, list(range(3, 20))) for b in (0, 7, None) for c in (None, 0, 12)] + [(1, 1, None), (1, 2, []), (1, 3, [9, None, 8])]
    packed = spark.createDataFrame(rows, "batch_id bigint, chunk_no int, input_ids array<int>")
    out = ds.mask_tokens(packed, 1000, p=0.5, seed=3, epoch=2)
    got = {(r.batch_id, r.chunk_no): r.labels for r in out.collect()}

    def label(b, c, i, x):
        key = ":".join(str(k) for k in ("3:2:token", b, c, i) if k is not None)
        low = int(hashlib.md5(key.encode()).hexdigest()[:10], 16) / 2**40 < 0.5
        return x if low and x is not None and x not in ds.SPECIAL_IDS.values() else ds.IGNORED

    assert got == {(b, c): None if xs is None else [label(b, c, i, x) for i, x in enumerate(xs)] for b, c, xs in rows}
    assert "ArrowEvalPython" in out._jdf.queryExecution().executedPlan().toString()


def test_splits(spark):
    df = spark.range(1001).select("id", F.when(F.col("id") < 700, "+").when(F.col("id") < 990, "-").alias("label"))
    a = {r.id: r.split for r in ds.train_test_split(df, ["id"], 0.25, 3).collect()}
    b = {r.id: r.split for r in ds.train_test_split(df.repartition(7), ["id"], 0.25, 3).collect()}
    assert a == b and len(a) == 1001
    assert list(a.values()).count("test") == math.ceil(1001 * 0.25)
    counts = {}
    for r in ds.stratified_split(df, ["id"], "label").collect():
        counts[r.label, r.split] = counts.get((r.label, r.split), 0) + 1
    assert counts["+", "train"] == 560 and counts["+", "test"] == 70 and counts["+", "validation"] == 70
    assert counts["-", "train"] == 232 and counts["-", "test"] == 29
    assert sum(v for (lab, _), v in counts.items() if lab is None) == 11


@pytest.mark.parametrize("head", [1, 2, 100])
def test_encode_does_not_depend_on_the_head(spark, head):
    rows = [(1, 0, "the a the zz b"), (1, 1, "a"), (2, 0, "the the"), (3, 0, ""), (4, 0, None)]
    sent = spark.createDataFrame(rows, "doc_id bigint, six int, sent string").repartition(3)
    vocab = spark.createDataFrame([("the", 5), ("a", 6), ("b", 7)], "token string, id int")
    want = {(1, 0): [0, 5, 6, 5, 3, 7, 2], (1, 1): [0, 6, 2], (2, 0): [0, 5, 5, 2], (3, 0): [0, 3, 2]}
    out = ds.encode_tokens(sent, vocab, head=head)
    got = {(r.doc_id, r.six): r for r in out.collect()}
    assert {k: r.input_ids for k, r in got.items()} == want
    assert got[1, 0].word_ids == [None, 0, 1, 2, 3, 4, None]
    plain = ds.encode_tokens(sent, vocab, special=None, head=head)
    assert {(r.doc_id, r.six): (r.input_ids, r.word_ids) for r in plain.collect()}[1, 1] == ([6], [0])
    if head == 100:
        assert "Exchange" not in ds.encode_tokens(sent.coalesce(1), vocab)._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]


def test_tokens_of_no_vocabulary_are_not_joined(spark):
    """Beyond the head only words of the vocabulary are looked up by a join, and rows
    stay whole where their keys repeat or are null."""
    rows = [(1, 0, "the rare ."), (1, 0, "the odd . rare odd"), (None, None, "rare . x"), (2, 0, "the . . y")] * 5
    sent = spark.createDataFrame(rows, "doc_id bigint, six int, sent string")
    vocab = spark.createDataFrame([("the", 5, 15), ("rare", 6, 3), ("odd", 7, 1)], "token string, id int, n bigint")
    out = ds.encode_tokens(sent, vocab, head=1)
    want = [(0, 5, 6, 3, 2), (0, 5, 7, 3, 6, 7, 2), (0, 6, 3, 3, 2), (0, 5, 3, 3, 3, 2)] * 5
    assert sorted(tuple(r.input_ids) for r in out.collect()) == sorted(want)
    bits = ds._bits(vocab.filter("n < 4"), ds.LEAST_BITS)
    maybe = ds._maybe(pa.array(["rare", "odd", ".", "x", "y", "the"]), bits)
    assert maybe.tolist() == [True, True, False, False, False, False]


def test_categories(spark):
    df = spark.createDataFrame(
        [("+", "general", "joy"), ("n", None, "fear"), ("?", "other", None)],
        "label string, topic string, emotion string",
    )
    rows = ds.label_index(ds.one_hot_emotion(ds.one_hot_topic(df))).collect()
    assert [r.label_idx for r in rows] == [0, 2, None]
    assert rows[0].top == [0, 0, 0, 0, 1, 0, 0, 0, 0] and sum(rows[1].top) == sum(rows[2].top) == 0
    assert rows[1].emot == [0, 0, 0, 0, 1, 0, 0]


def test_pairs_and_vocab_target(spark):
    sent = spark.createDataFrame([(1, 0, "aba ab"), (1, 1, "x")], "doc_id bigint, six int, sent string")
    freq = ds.word_freq(sent)
    assert {r.word: r.freq for r in freq.collect()} == {"aba": 1, "ab": 1, "x": 1}
    assert {(r.left, r.right): r.freq for r in ds.pair_freq(freq).collect()} == {("a", "b"): 2, ("b", "a"): 1}
    assert tuple(ds.vocab_target(spark.range(5)).first()) == (5, 7)
    assert ds.steps_per_epoch(spark.range(65)).first().steps == 2


def test_build_dataset(spark):
    rows = [(d, i, f"the word{(d + i) % 9} goes on and on .") for d in range(20) for i in range(10)]
    sent = spark.createDataFrame(rows, "doc_id bigint, six int, sent string")
    vocab = spark.createDataFrame([("the",), ("goes",), ("on",)], "token string")
    for mask in ("word", "token"):
        packed, masked = jobs.build_dataset(sent, vocab, chunk_size=8, batch=20, mask=mask)
        n = {r.split: r["count"] for r in packed.groupBy("split").count().collect()}
        # 9 ids per sentence: 20 sentences make 22 chunks of 8.
        assert n == {"train": 22 * 7 + 11, "test": 22 * 2 + 11}
        assert packed.filter("size(input_ids) != 8 OR input_ids != labels").count() == 0
        assert masked.count() == packed.count()


def test_classifier_learns(spark):
    rows = [(i, "good fine" if i % 2 else "bad poor", "+" if i % 2 else "-") for i in range(60)]
    df = spark.createDataFrame(rows, "id int, text string, label string")
    out = ml.sentiment_classifier(df.filter("id < 40"), df.filter("id >= 40"), ("+", "-")).collect()
    assert len(out) == 20 and all(r.label == r.label_pred for r in out)


def test_propagate(spark):
    df = spark.createDataFrame([("One. two", "t", "e", "+")], "text string, topic string, emotion string, label string")
    assert [tuple(r) for r in ds.propagate_labels(df).collect()] == [("One.", "t", "e", "+"), ("two", "t", "e", "+")]
