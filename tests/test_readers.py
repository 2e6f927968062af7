"""Readers on small hand-made files."""

import json

import pytest

from textloom.plans import jobs
from textloom.sources import named, readers, writers
from textloom.streaming.ingest import ingest_stream


@pytest.fixture
def xml_dir(tmp_path):
    d = tmp_path / "corpus" / "finetune" / "sq" / "17" / "Books" / "xml"
    d.mkdir(parents=True)
    (d / "a.xml").write_text(
        '<?xml version="1.0"?>\n<text><p><s id="s1"><w>Hello</w> <w>&amp; you</w></s><s id="s2"/></p>'
        '<div><p><s id="s3"><w>b</w><w>.</w></s></p></div></text>'
    )
    (d / "b.xml").write_text('<text><s id="1"><w>one</w></s><s id="2"><w>two</w></s></text>')
    (d / "bad.xml").write_text('<text><s id="1"><w>ok</w></s><s id="2"><w>open</s></text>')
    (d / "big.xml").write_text(
        "<text>" + "".join(f'<s id="{i}"><w>t{i}</w></s>' for i in range(500)) + "</text>"
    )
    return tmp_path


def by_file(df):
    out = {}
    for r in df.orderBy("file", "six").collect():
        out.setdefault(r.file.rsplit("/", 1)[1], []).append((r.six, r.sid, r.tokens))
    return out


def test_tok_xml(spark, xml_dir):
    df = readers.read_tok_xml(spark, str(xml_dir))
    got = by_file(df)
    assert set(got) == {"a.xml", "b.xml", "big.xml"}
    assert got["a.xml"] == [(0, "s1", ["Hello", "& you"]), (1, "s3", ["b", "."])]
    assert [(i, s) for i, s, _ in got["big.xml"]] == [(i, str(i)) for i in range(500)]
    assert sorted({r.doc_id for r in df.collect()}) == [0, 1, 2]
    assert set(by_file(readers.read_tok_xml(spark, str(xml_dir), size_limit=5000))) == {"a.xml", "b.xml"}


def test_tolerant(spark, xml_dir):
    good, bad = readers.read_tolerant(spark, str(xml_dir), "tok_xml")
    assert set(by_file(good)) == {"a.xml", "b.xml", "big.xml"}
    assert [r.file.rsplit("/", 1)[1] for r in bad.collect()] == ["bad.xml"]


def test_size_limit_is_reported(spark, xml_dir):
    good, bad = readers.read_tolerant(spark, str(xml_dir), "tok_xml", size_limit=5000)
    assert set(by_file(good)) == {"a.xml", "b.xml"}
    assert {r.file.rsplit("/", 1)[1]: r.reason[:4] for r in bad.collect()}["big.xml"] == "size"


def test_large_files_are_read_by_default(spark, xml_dir):
    assert "big.xml" in by_file(readers.read_tok_xml(spark, str(xml_dir)))
    assert readers.list_files(spark, str(xml_dir), "*.xml").count() == 4


@pytest.mark.parametrize("read", ["tok", "sent", "crawl", "wiki"])
def test_raw_files_are_parsed_once(spark, xml_dir, tmp_path, read):
    """What is returned reads the written rows, not the raw files."""
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "c.jsonl").write_text(record("One line here .", [ident("en", 0.99)]))
    (tmp_path / "s.xml").write_text('<text><s id="1">some words</s></text>')
    (tmp_path / "d.xml").write_text('<m><page><id>1</id><revision><text bytes="99">Some text.</text></revision></page></m>')
    df = {
        "tok": lambda: readers.read_tok_xml(spark, str(xml_dir)),
        "sent": lambda: readers.read_sent_xml(spark, str(tmp_path), glob="s.xml"),
        "crawl": lambda: readers.read_crawl(spark, str(tmp_path / "lines"), "en"),
        "wiki": lambda: readers.read_wiki(spark, str(tmp_path), glob="d.xml"),
    }[read]()
    raw = [f for f in df.inputFiles() if not f.endswith(".parquet")]
    assert not raw and df.count() > 0


def test_list_files(spark, xml_dir):
    rows = readers.list_files(spark, str(xml_dir), "*.xml", 5000).collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in rows) == ["a.xml", "b.xml", "bad.xml"]


def test_sent_xml(spark, tmp_path):
    (tmp_path / "s.xml").write_text('<text><s id="1"> two  words </s><s id="2"></s><s id="3">x</s></text>')
    got = by_file(readers.read_sent_xml(spark, str(tmp_path)))
    assert got["s.xml"] == [(0, "1", ["two", "words"]), (1, "3", ["x"])]


def test_wiki(spark, tmp_path):
    page = '<page><title>{0}</title><id>{1}</id><revision><id>9</id><text bytes="{2}" xml:space="preserve">{3}</text></revision></page>'
    body = "'''A''' [[b|c]]. {{t|v}}!\n== H ==\nTail. none"
    dump = '<mediawiki xmlns="http://www.mediawiki.org/xml/export-0.10/">' + page.format("x", 5, 71, body) + page.format("y", 6, 70, "Small.") + "</mediawiki>"
    (tmp_path / "dump.xml").write_text(dump)
    rows = readers.read_wiki(spark, str(tmp_path)).orderBy("six").collect()
    assert [(r.doc_id, r.six, r.tokens) for r in rows] == [
        (5, 0, ["A", "c", "."]), (5, 1, ["v", "!"]), (5, 2, ["Tail", "."])
    ]
    named_t = readers.read_wiki(spark, str(tmp_path), template_fn=lambda name, args: name.upper())
    assert named_t.filter("six = 1").first().tokens == ["T", "!"]


def test_wiki_quarantines_the_page(spark, tmp_path):
    page = '<page><id>{0}</id><revision><text bytes="99">{1}</text></revision></page>'
    (tmp_path / "dump.xml").write_text("<m>" + page.format("x1", "Bad id.") + page.format(7, "Good page.") + "</m>")
    good, bad = readers.read_tolerant(spark, str(tmp_path), "wiki")
    assert [(r.doc_id, r.tokens) for r in good.collect()] == [(7, ["Good", "page", "."])]
    assert [r.file.rsplit("/", 1)[1] for r in bad.collect()] == ["dump.xml"]
    assert readers.read_wiki(spark, str(tmp_path)).count() == 1


def record(content, ids, warnings=None):
    return json.dumps({"content": content, "metadata": {"quality_warnings": warnings, "sentence_identifications": ids}})


def ident(label, prob):
    return {"label": label, "prob": prob}


def test_crawl(spark, tmp_path):
    lines = [
        record("keep me\nlow\nequal\nother\nnone", [ident("sq", 0.95), ident("sq", 0.5), ident("sq", 0.9), ident("en", 0.99), None]),
        record("noisy", [ident("sq", 0.99)], ["noisy", "tiny"]),
        record("tiny one\ntiny two", [ident("sq", 0.91), ident("sq", 1.0)], ["tiny", "short_sentences"]),
    ]
    (tmp_path / "c.jsonl").write_text("\n".join(lines) + "\n")
    rows = readers.read_crawl(spark, str(tmp_path), "sq").orderBy("six").collect()
    assert [(r.six, r.sid, r.tokens) for r in rows] == [
        (0, "0", ["keep", "me"]), (1, "1", ["tiny", "one"]), (2, "2", ["tiny", "two"])
    ]


@pytest.mark.parametrize("line", [
    record("a", [ident("sq", 1.0)], ["strange"]),
    record("a\nb", [ident("sq", 1.0)]),
    '{"content": ',
])
def test_crawl_failures(spark, tmp_path, line):
    (tmp_path / "c.jsonl").write_text(line + "\n")
    with pytest.raises(Exception):
        readers.read_crawl(spark, str(tmp_path), "sq").collect()


def test_crawl_quarantine(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text(record("a", [None]) + "\n{bad\n")
    good, bad = readers.read_tolerant(spark, str(tmp_path), "crawl")
    assert good.count() == 1 and [r.reason for r in bad.collect()] == ["{bad"]


def test_csv_inputs(spark, tmp_path):
    (tmp_path / "src.csv").write_text("id,name,url\nA,Alpha,http://a\n")
    assert tuple(readers.read_sources(spark, str(tmp_path / "src.csv")).first()) == ("A", "Alpha", "http://a")
    (tmp_path / "sq.csv").write_text('text,label,topic,emotion\n"one, ""two""",+,general,joy\nthree,n,,fear\n')
    rows = readers.read_reviews(spark, str(tmp_path), "sq").collect()
    assert [tuple(r) for r in rows] == [('one, "two"', "+", "general", "joy"), ("three", "n", None, "fear")]
    (tmp_path / "ann.csv").write_text(
        "a1_topic,a2_topic,a1_emotion,a2_emotion,a1_label,a2_label,notes\nx,x,j,j,1,1,\nx,,j,j,1,0,n\n"
    )
    rows = readers.read_annotations(spark, str(tmp_path / "ann.csv")).collect()
    assert [tuple(r) for r in rows] == [("x", "x", "j", "j", 1, 1)]


def test_split_ids(spark, tmp_path):
    for name, ids in (("train", "1\n2\n"), ("test", "3\n")):
        (tmp_path / f"{name}.txt").write_text(ids)
    got = sorted(tuple(r) for r in readers.read_split_ids(spark, str(tmp_path)).collect())
    assert got == [(1, "train"), (2, "train"), (3, "test")]


def test_split_ids_are_whole(spark, tmp_path):
    (tmp_path / "train.txt").write_text("1\n3000000000\n\n")
    assert sorted(r.row_id for r in readers.read_split_ids(spark, str(tmp_path)).collect()) == [1, 3000000000]
    (tmp_path / "test.txt").write_text("x7\n")
    with pytest.raises(Exception, match="not a row id"):
        readers.read_split_ids(spark, str(tmp_path)).collect()


def test_dump_files_are_full(spark, tmp_path):
    rows = [(d, i, f"s {d} {i}") for d in range(30) for i in range(7)]
    df = spark.createDataFrame(rows, "doc_id bigint, six int, sent string").repartition(6)
    writers.dump_csv(df, str(tmp_path / "all"), row_size=50, seed=1)
    sizes = sorted(len(f.read_text().splitlines()) - 1 for f in (tmp_path / "all").glob("*.csv"))
    assert sizes == [10, 50, 50, 50, 50]
    writers.dump_csv(df, str(tmp_path / "two"), row_size=50, file_limit=2, seed=1)
    assert len(list((tmp_path / "two").glob("*.csv"))) == 2


def test_dataset_round_trip(spark, tmp_path):
    rows = [(d, i, f"{d}-{i}") for d in range(40) for i in range(25)]
    df = spark.createDataFrame(rows, "doc_id bigint, six int, sent string").repartition(6)
    path = str(tmp_path / "ds")
    writers.write_dataset(df, path, batch_size=10, batches_per_file=3)
    want = [t for _, _, t in sorted(rows)]
    assert [r.text for r in readers.read_dataset(spark, path, 333).collect()] == want[:333]
    assert sorted(r.text for r in readers.read_dataset(spark, path).collect()) == sorted(want)
    writers.write_dataset(df, path, sent_limit=17)
    assert sorted(r.text for r in readers.read_dataset(spark, path).collect()) == sorted(want[:17])


def test_build_corpus(spark, xml_dir, tmp_path):
    (tmp_path / "src.csv").write_text("id,name,url\nBooks,Books,http://b\n")
    args = dict(lang="sq", sources=str(tmp_path / "src.csv"), base=str(tmp_path))
    path = str(tmp_path / "store")
    store = jobs.build_corpus(spark, {"tok_xml": str(xml_dir)}, path, **args)
    assert store.table("doc").count() == 3
    assert {r.lang for r in store.table("sent").collect()} == {"sq"}
    assert {(r.sid, r.name) for r in store.table("corp_doc").collect()} == {(17, "Books")}
    again = jobs.build_corpus(spark, {"tok_xml": str(xml_dir)}, path, **args)
    assert again.table("doc").count() == 3
    more = jobs.build_corpus(spark, {"tok_xml": str(xml_dir)}, path, force=True, **args)
    ids = sorted(r.doc_id for r in more.table("doc").collect())
    assert ids == list(range(6)) and sorted(int(r.dir_id) for r in more.table("doc").collect()) == ids
    assert more.table("sent").count() == 2 * 504
    fresh = jobs.build_corpus(spark, {"tok_xml": str(xml_dir)}, path, recreate=True, **args)
    assert fresh.table("sent").count() == 504
    tables = {n: fresh.table(n) for n in ("doc", "sent", "corp_doc", "corp_src")}
    src = named.named_query(spark, "select_corpus_sources", **tables).collect()
    assert [tuple(r) for r in src] == [("Books", "http://b", 504)]


def test_named_queries_analyze(spark):
    from textloom import schemas

    tables = {n: spark.createDataFrame([], s) for n, s in schemas.TABLES.items()}
    tables["vocab"] = spark.createDataFrame([], "token string")
    for name, sql in named.NAMED.items():
        named.named_query(spark, name, [0] * sql.count("?"), **tables).collect()


def test_stream_continues(spark, tmp_path):
    src, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    src.mkdir()
    for k in range(2):
        (src / f"c{k}.jsonl").write_text(record(f"first {k}\nsecond {k}", [ident("sq", 1.0)] * 2) + "\n")
        ingest_stream(spark, str(src), "crawl", check, out, lang="sq", target="sq").awaitTermination()
    got = sorted((r.doc_id, r.six, r.sent, r.lang) for r in spark.read.parquet(out + "/sent").collect())
    assert got == [(k, i, f"{w} {k}", "sq") for k in range(2) for i, w in enumerate(("first", "second"))]
    batch = readers.read_crawl(spark, str(src), "sq")
    assert sorted(" ".join(r.tokens) for r in batch.collect()) == sorted(g[2] for g in got)


def test_stream_xml(spark, xml_dir, tmp_path):
    path = str(xml_dir / "corpus" / "finetune" / "sq" / "17" / "Books" / "xml")
    out = str(tmp_path / "out")
    ingest_stream(spark, path, "tok_xml", str(tmp_path / "check"), out, lang="sq").awaitTermination()
    got = sorted((r.six, r.sent) for r in spark.read.parquet(out + "/sent").collect())
    batch = readers.read_tok_xml(spark, path)
    assert got == sorted((r.six, " ".join(r.tokens)) for r in batch.collect())
