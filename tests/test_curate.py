"""Filters, clean-up, dedup and vocabulary on hand-made rows."""

from dataclasses import replace

from pyspark.sql import functions as F

from textloom.functions import text as fx
from textloom.operators import curate as cu
from textloom.operators import filters as fl
from textloom.operators import joins as jn
from textloom.operators import langstats as ls
from textloom.operators import reports as rp
from textloom.operators import vocab as vo


def sents(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, six int, lang string, sent string, toklen int")


def texts(df, col="sent"):
    return sorted(r[col] for r in df.collect())


def test_null_semantics(spark):
    df = sents(spark, [(1, 0, "sq", "a", 1), (1, 1, None, "b", None), (1, 2, "en", "c", 9)])
    assert texts(fl.filter_lang(df, "sq", negate=True)) == ["c"]
    assert texts(fl.delete_where(df, F.col("lang") == "sq")) == ["b", "c"]
    assert texts(fl.filter_toklen(df)) == ["c"]
    assert texts(fl.filter_null_lang(df)) == ["b"]
    assert texts(fl.update_col(df, "sent", F.lit("z"), F.col("lang") == "sq")) == ["b", "c", "z"]


def test_garbage_and_quotes(spark):
    rows = ["% x", "%x", "/ / x", "* captcha now", "( Burime TË x", '" quoted', "fine"]
    df = sents(spark, [(1, i, "sq", s, 9) for i, s in enumerate(rows)])
    assert texts(fl.filter_garbage(df)) == sorted(["%x", '" quoted', "fine"])
    assert texts(fl.filter_like(df, "sent", '"%')) == ['" quoted']
    keep = spark.createDataFrame([(1,)], "doc_id bigint")
    assert '" quoted' not in texts(jn.join_sent_keep(df, keep, "sq"))


def test_dedup(spark):
    rows = [(d, i, "sq", f"s{(d * i) % 5}", 9) for d in range(20) for i in range(20)]
    df = sents(spark, rows).repartition(5)
    first = {}
    for d, i, _, s, _ in sorted(rows):
        first.setdefault(s, (d, i))
    for f in (cu.dedup_exact, cu.dedup_rank):
        out = f(df)
        assert {r.sent: (r.doc_id, r.six) for r in out.collect()} == first
        assert f(out).count() == len(first) == ls.distinct_values(df, "sent").count()


def test_anti_topn(spark):
    df = sents(spark, [(1, i, "sq", "ab"[i % 2], 9) for i in range(10)])
    assert [(r.sent, r.six) for r in jn.anti_topn(df, 6).orderBy("sent", "six").collect()] == [
        ("b", 3), ("b", 5), ("b", 7), ("b", 9)
    ]
    assert jn.anti_topn(df, 100).count() == 0
    assert jn.anti_topn(df, 0).count() == 10


def test_clean_order(spark):
    """Length is judged after the trims, token counts before them."""
    df = sents(spark, [(1, 0, "sq", "12345 short #", 9), (1, 1, "sq", "99 long enough book .", 9)])
    out = cu.clean_sents(df, replace(cu.CurateParams(), drop_first=0))
    assert texts(out) == ["long enough book"]
    safe = cu.clean_text(sents(spark, [(1, 0, "sq", "span good names", 9)]), safe_tags=True)
    assert texts(safe) == ["span good names"]


def test_vocab(spark):
    words = "a ab x-y WWWx 'q a1 ABCd ABC abc Abc ëab Ëab ЖЖ žž wordthatiswaytoolongx".split()
    df = sents(spark, [(1, 0, "sq", " ".join(words), 9)])
    # An accented letter has no ASCII upper case; ž lies beyond U+00FF.
    assert texts(vo.build_vocab(df), "token") == sorted(["ab", "abc", "Abc", "ëab", "Ëab"])
    ids = vo.vocab_ids(vo.build_vocab(df), 5)
    assert sorted(r.id for r in ids.collect()) == list(range(5, 10))


def test_lang_prop_invariant(spark):
    rows = [(d, i, ["sq", "en", None][(d + i) % 3], "x" * i, 9) for d in range(10) for i in range(d)]
    prop = ls.lang_prop_by_doc(sents(spark, rows), "sq")
    assert prop.filter("sq_cnt + other_cnt + no_lang_cnt != tot_cnt").count() == 0
    assert prop.filter("sq_cnt = 0").count() == 0


def test_doc_keep_defaults(spark):
    rows = [(1, i, "sq", "y" * 40, 9) for i in range(60)] + [(2, i, "sq", "y" * 40, 9) for i in range(60)]
    doc = spark.createDataFrame([(1, "0", "f1"), (2, "1", "f2")], "doc_id bigint, dir_id string, file string")
    cd = spark.createDataFrame([(1, 3, "Books", "f1"), (2, 4, "Ubuntu", "f2")], "doc_id bigint, sid int, name string, file string")
    keep = cu.doc_keep(doc, cd, sents(spark, rows), "sq", cu.CurateParams())
    assert [r.doc_id for r in keep.collect()] == [1]


def test_kappa(spark):
    df = spark.createDataFrame(
        [("x", "x", "a", "b"), ("y", "y", "b", "a"), ("x", "y", "a", "a"), ("y", "y", "b", "b")],
        "a1 string, a2 string, b1 string, b2 string",
    )
    got = {r.description: r.value for r in rp.cohen_kappa(
        df, {"self": ("a1", "a1"), "p": ("a1", "a2"), "q": ("b1", "b2")}
    ).collect()}
    assert got["self"] == 1.0 and got["sentences"] == 4
    assert abs(got["p"] - 0.5) < 1e-9 and abs(got["q"]) < 1e-9
    one = spark.createDataFrame([("x", "x")], "a string, b string")
    assert {r.description: r.value for r in rp.cohen_kappa(one, {"k": ("a", "b")}).collect()}["k"] is None


def test_metrics_zero_division(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "a"), ("b", "a"), ("c", "d")], "y string, p string")
    got = {r.metric: r.value for r in rp.classification_metrics(df, "y", "p").collect()}
    # Per class a: P 2/3, R 1, F1 0.8; b, c, d: 0.
    assert abs(got["macro_F1"] - 0.2) < 1e-9
    assert abs(got["weighted_F1"] - 0.4) < 1e-9
    assert got["accuracy"] == got["micro_F1"] == 0.5 and got["n"] == 4


def test_histogram_edges(spark):
    df = sents(spark, [(1, i, "sq", "x", n) for i, n in enumerate([4, 5, 9, 10, 99, 100, 101, None])])
    rows = {r.bin: r.cnt for r in rp.toklen_histogram(df).collect()}
    assert sum(rows.values()) == 5 and len(rows) == 20
    assert rows[1] == 2 and rows[2] == 1 and rows[20] == 2


def test_nothing_is_dropped_by_default():
    assert cu.CurateParams().drop_first == 0


def test_fitted_language(spark):
    rows = [("sq", "une jam ketu dhe ti"), ("sq", "dhe une"), ("en", "i am here and you"), (None, "dhe and")]
    lists = ls.fit_stop_words(spark.createDataFrame(rows, "lang string, sent string"), 3)
    assert lists["sq"][:2] == ["dhe", "une"] and len(lists["en"]) == 3
    got = spark.createDataFrame([("ti dhe une",), ("you am",), ("?",)], "sent string").select(fx.vote_lang("sent", lists))
    assert [r[0] for r in got.collect()] == ["sq", "en", None]


def test_sentences_stay_where_few_documents_are_kept(spark):
    """The kept documents' ids have a known size, so no sentence moves to meet them."""
    rows = [(d, i, f"the {d} word {i} goes on and on here", "sq") for d in range(4) for i in range(60)]
    sent = spark.createDataFrame(
        [(d, i, str(i), s, None, 9, lang) for d, i, s, lang in rows], "doc_id bigint, six int, sid string, sent string, "
        "spans array<struct<start:int,end:int>>, toklen int, lang string",
    )
    doc = spark.createDataFrame([(d, f"{d}.xml") for d in range(4)], "doc_id bigint, file string")
    names = spark.createDataFrame([(d, "books") for d in range(4)], "doc_id bigint, name string")
    out = cu.curate(doc, names, sent, "sq", cu.CurateParams(min_avg=5))
    assert out.count() == 240
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
