"""Registered parsers, table functions and language profiles."""

import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions import langprofile, tablefns
from textloom.functions import text as fx
from textloom.operators import ordering as od
from textloom.plans.tables import Inputs
from textloom.sources import plugin, readers


@pytest.mark.parametrize("end", ["", "\n"])
def test_a_line_is_in_one_range(tmp_path, end, monkeypatch):
    draw = random.Random(3)
    text = "\n".join(draw.choice(["", "a", "é" * 5, "x" * 40]) for _ in range(60)) + end
    path = tmp_path / "f.txt"
    path.write_text(text)
    size = os.path.getsize(path)
    want = text.split("\n")
    want = want[:-1] if want[-1] == "" else want
    for chunk in (1, 7, 1 << 20):
        monkeypatch.setattr(plugin, "_CHUNK", chunk)
        for step in (1, 5, 64, size, 10 * size):
            parts = plugin._ranges([(0, str(path), size)], step)
            found = [line for p in parts for line in plugin.lines(p)]
            assert [x[2] for x in found] == want
            assert all(path.read_bytes()[at : at + len(x.encode())].decode() == x for _, at, x in found)


def upper_parser():
    def upper(found):
        for path, at, line in found:
            yield path.rsplit("/", 1)[1], at, line.upper()

    return upper


def test_a_users_parser(spark, tmp_path):
    for name, lines in (("a.txt", "one\ntwo\n"), ("b.txt", "three"), ("c.log", "no\n"), ("_hidden.txt", "no\n")):
        (tmp_path / name).write_text(lines)
    plugin.register_parser(spark, "shout", "file string, at bigint, line string", upper_parser())
    df = spark.read.format("shout").option("glob", "*.txt").option("splitBytes", 3).load(str(tmp_path))
    assert sorted(map(tuple, df.collect())) == [("a.txt", 0, "ONE"), ("a.txt", 4, "TWO"), ("b.txt", 0, "THREE")]
    assert spark.read.format("shout").load(str(tmp_path / "c.log")).count() == 1
    plugin.register_parser(spark, "shout", "n bigint", lambda found: ((1,) for _ in found))
    assert spark.read.format("shout").load(str(tmp_path)).columns == ["n"]


def test_a_users_parser_as_stream(spark, tmp_path):
    src, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    src.mkdir()
    plugin.register_parser(spark, "shout", "file string, at bigint, line string", upper_parser())

    def run():
        stream = spark.readStream.format("shout").load(str(src)).writeStream.option("checkpointLocation", check)
        query = stream.format("parquet").trigger(availableNow=True).start(out)
        query.awaitTermination()
        return sorted(r.line for r in spark.read.parquet(out).collect())

    (src / "a.txt").write_text("one\ntwo\n")
    assert run() == ["ONE", "TWO"]
    (src / "b.txt").write_text("three\n")
    assert run() == ["ONE", "THREE", "TWO"]
    assert run() == ["ONE", "THREE", "TWO"]


def test_registered_crawl_equals_the_reader(spark, tmp_path):
    ids = [{"label": "sq", "prob": 0.95}, None, {"label": "sq", "prob": 0.2}, {"label": "sq", "prob": 1.0}]
    rows = [
        {"content": f"first {i}\nno\nlow\nlast é {i}", "metadata": {"quality_warnings": w, "sentence_identifications": ids}}
        for i, w in enumerate([None, ["tiny"], ["noisy"], []] * 5)
    ]
    (tmp_path / "c.jsonl").write_text("\n".join(json.dumps(r) for r in rows) + "\n")
    plugin.register_parser(spark, "crawl_lines", plugin.CRAWL, plugin.parse_crawl)
    got = spark.read.format("crawl_lines").option("splitBytes", 100).load(str(tmp_path))
    place = ["six", "sid", "tokens"]
    got = readers.crawl_sentences(got, "sq").select(place).collect()
    want = readers.read_crawl(spark, str(tmp_path), "sq").select(place).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(want) == 30


def test_doc_chunks_in_sql(spark):
    rows = [(d, i, f"s{d}.{i}") for d in range(9) for i in range(d * 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, six int, sent string").repartition(4)
    tablefns.register(spark)
    df.createOrReplaceTempView("sents")
    got = spark.sql("SELECT * FROM doc_chunks(TABLE(sents) PARTITION BY (doc_id) ORDER BY (six), 5)").collect()
    want = {}
    for r in od.chunk_docs(df, 5).collect():
        want.setdefault((r.doc_id, r.chunk_id), []).append((r.six, r.sent))
    assert {(r.doc_id, r.chunk_id): list(zip(r.six, r.sents, strict=True)) for r in got} == {
        k: sorted(v) for k, v in want.items()
    }
    with pytest.raises(Exception, match="chunk size"):
        spark.sql("SELECT * FROM doc_chunks(TABLE(sents) PARTITION BY (doc_id) ORDER BY (six), 0)").collect()


def test_profile_beats_the_vote(spark, sf_dir):
    """On held-out sentences of three to eight tokens, against the document's label."""
    t = Inputs(spark, sf_dir)
    held = F.pmod("doc_id", F.lit(4)) == 2
    profile = langprofile.fit_profile(t.documents.filter(~held))
    short = t.plain.filter(held & (F.col("toklen").between(3, 8))).join(t.documents.select("doc_id", "lang"), "doc_id")
    by = short.select(
        (F.coalesce(profile.column("sent"), F.lit("")) == F.col("lang")).cast("double").alias("profile"),
        (F.coalesce(fx.vote_lang("sent"), F.lit("")) == F.col("lang")).cast("double").alias("vote"),
    ).agg(F.avg("profile"), F.avg("vote"), F.count("*")).first()
    assert by[2] > 100 and by[0] > 0.9 and by[0] > by[1] + 0.1


def test_profile_of_odd_texts(spark):
    rows = [("the cat and the dog", "en"), ("der hund und die katze", "de"), (None, "en"), ("x", None), ("", "fr")]
    labelled = spark.createDataFrame(rows * 20, "text string, lang string")
    profile = langprofile.fit_profile(labelled)
    assert profile.langs == ("de", "en")
    cases = ["THE DOG!", "die Katze", "", None, "123 ?!", "źżćŋ ħđßę ŧħə"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, s string")
    got = [r.got for r in df.withColumn("got", profile.column("s")).orderBy("i").collect()]
    assert got == ["en", "de", None, None, None, None]
    none = langprofile.fit_profile(labelled.limit(0))
    assert {r[0] for r in df.select(none.column("s")).collect()} == {None}
    points = langprofile._trigrams([" ab ", "", "é", " c "])
    slot = [(ord(a) * 8191 + ord(b) * 127 + ord(c)) % langprofile.SLOTS for a, b, c in (" ab", "ab ", " c ")]
    assert points[0].tolist() == slot and points[1].tolist() == [0, 0, 3]


def test_trigrams_come_in_bounded_pieces(monkeypatch):
    """A batch is counted piece by piece; a long text shares two characters between its
    parts, so that no trigram is lost or counted twice."""
    texts = ["", " ab ", " " + "abcdefg" * 40 + " ", "", " é ", " c ", "x"]
    slot, of = langprofile._trigrams(texts)
    whole = sorted(zip(of.tolist(), slot.tolist(), strict=True))
    weights = np.random.default_rng(1).integers(-9000, -1, (3, langprofile.SLOTS)).astype(float)
    profile = langprofile.LangProfile(("a", "b", "c"), weights, -9000)
    want = profile.predict(texts)
    monkeypatch.setattr(langprofile, "PIECE", 16)
    got, most = [], 0
    for first, part in langprofile._pieces(texts):
        most = max(most, sum(map(len, part)))
        s, o = langprofile._trigrams(part)
        got += zip((o + first).tolist(), s.tolist(), strict=True)
    assert sorted(got) == whole and most <= 16
    assert profile.predict(texts) == want
