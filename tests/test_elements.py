"""XML files that are cut into byte ranges, against reading them whole."""

import re
from contextlib import contextmanager

import pytest

from textloom import schemas
from textloom.plans import io_catalog, jobs
from textloom.plans.catalog import QUERIES
from textloom.sources import elements, readers


@contextmanager
def split_bytes(spark, n):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    for key in keys:
        spark.conf.set(key, str(n))
    try:
        yield
    finally:
        for key in keys:
            spark.conf.unset(key)


def sentence(i):
    words = "".join(f'<w n="{j}">t{i}é{j}</w>' for j in range(i % 4))
    return f"<s/>\n<p a='>'><s id='{i}' x=\"a>b\">{words}\n</s ></p>".replace("</s >", "</s>")


ORDINARY = {
    "plain.xml": "<?xml version='1.0' encoding='UTF-8'?>\n<text>" + "".join(map(sentence, range(24))) + "</text>\n",
    "escaped.xml": "<t><s id='1'><w>one</w></s><s id='2'><w>&lt;/s&gt; &amp;</w></s></t>",
    "root.xml": "<s id='1'><w>one</w></s>\n",
    "none.xml": "<text><seg><w>no sentence</w></seg></text>",
    "self.xml": "<text><s id='1'/><s id='2'><w>x</w></s><s id='3'/></text>",
    "empty.xml": "",
}
ODD = {
    "comment.xml": "<text><!-- </s> --><s id='1'><w>a</w></s><!-- <s><w>no</w></s> --></text>",
    "cdata.xml": "<text><s id='1'><w><![CDATA[</s>]]></w></s><s id='2'><w>b</w></s></text>",
    "space.xml": "<text><s id='1'><w>a</w></s ><s id='2'><w>b</w></s\n></text>",
    "latin.xml": "<?xml version='1.0' encoding='ISO-8859-1'?><text><s id='1'><w>a</w></s></text>",
    "roots.xml": "<s id='1'><w>one</w></s><s id='2'><w>two</w></s>",
    "roots_line.xml": "<s id='1'><w>one</w></s><s id='2'><w>two</w></s>\n",
    "end.xml": "<s id='1'><w>one</w></s>",
    "doctype.xml": "<!DOCTYPE text><text><s id='1'><w>a</w></s></text>",
}
MALFORMED = {
    "open.xml": "<text><s id='1'><w>ok</w></s><s id='2'><w>open</s></text>",
    "cut.xml": "<text><s id='1'><w>ok</w></s><s id='2'><w>cut</w>",
}


def write(folder, files):
    for name, content in files.items():
        (folder / name).write_text(content, encoding="utf-8")
    return str(folder)


def rows(df):
    found = df.orderBy("file", "_block", "_row").collect()
    return [(r.file.rsplit("/", 1)[1], r._id, r.w, r._corrupt) for r in found]


@pytest.mark.parametrize("size", [97, 1 << 20])
def test_ordinary_files_are_cut(spark, tmp_path, size):
    path = write(tmp_path, ORDINARY)
    want = rows(elements.whole_files(spark, path, "s", schemas.TOK_XML, "*.xml", None))
    # Reading whole yields no row for an element that closes itself, or an empty one.
    want = [r for r in want if r[1] is not None and r[2]]
    with split_bytes(spark, size):
        raw = elements._pieces(spark, path, "s", "*.xml", None)
        assert size > 97 or raw.rdd.getNumPartitions() > 8
        got = rows(elements.read_elements(spark, path, "s", schemas.TOK_XML))
    assert [r for r in got if r[2]] == want and len(want) > 15
    assert elements._odd_files(elements._parsed(raw, "s", schemas.TOK_XML)).count() == 0


@pytest.mark.parametrize("size", [211, 1 << 20])
def test_odd_files_are_read_whole(spark, tmp_path, size, monkeypatch):
    path = write(tmp_path, ORDINARY | ODD)
    want = rows(elements.whole_files(spark, path, "s", schemas.TOK_XML, "*.xml", None))
    want = [r for r in want if r[1] is not None and r[2]]
    for named in (1000, 2):
        monkeypatch.setattr(elements, "NAMED_FILES", named)
        with split_bytes(spark, size):
            got = rows(elements.read_elements(spark, path, "s", schemas.TOK_XML))
        assert [r for r in got if r[2]] == want
    assert {r[0] for r in want} > set(ODD) - {"comment.xml"}


@pytest.mark.parametrize("size", [211, 1 << 20])
def test_malformed_files_are_reported(spark, tmp_path, size):
    path = write(tmp_path, ORDINARY | MALFORMED)
    with split_bytes(spark, size):
        good, bad = readers.read_tolerant(spark, path, "tok_xml")
        assert {r.file.rsplit("/", 1)[1] for r in bad.collect()} == set(MALFORMED)
        names = {r.file.rsplit("/", 1)[1] for r in good.select("file").distinct().collect()}
    assert names >= {"plain.xml", "root.xml", "self.xml"} and "open.xml" not in names


@pytest.mark.parametrize("size", [701, 1 << 20])
def test_wiki_pages_are_cut(spark, tmp_path, size):
    page = "<page>\n<title>t</title><id>{0}</id><revision><text bytes='{1}' xml:space='preserve'>{2}</text></revision></page>"
    body = "Text of [[page|{0}]] here. &lt;!-- &lt;/page&gt; --&gt;{{{{t|[[a|more]]}}}}!\n"
    dump = "<mediawiki xmlns='http://x/'>" + "".join(
        page.format(i, 60 + i, body.format(i) * (1 + i % 5)) for i in range(20)
    ) + page.format("bad", 99, "Bad id.") + "</mediawiki>"
    path = write(tmp_path, {"dump.xml": dump})
    with split_bytes(spark, size):
        good, bad = readers.read_tolerant(spark, path, "wiki")
        got = sorted((r.doc_id, r.six, " ".join(r.tokens)) for r in good.collect())
        assert bad.count() == 1
    want = []
    for i in range(11, 20):
        texts = [f"Text of {i} here .", "more !"] * (1 + i % 5)
        want += [(i, six, t) for six, t in enumerate(texts)]
    assert got == want


def test_rows_do_not_gather_by_file(spark, tmp_path):
    """Only sums by byte range meet at their file: the tokens of one large file do not
    go to one task, neither for its id nor for its quarantine."""
    for k in range(3):
        (tmp_path / f"f{k}.xml").write_text("<text>" + "".join(map(sentence, range(40))) + "</text>")
    (tmp_path / "bad.xml").write_text(MALFORMED["open.xml"])
    rows = readers.read_tok_xml(spark, str(tmp_path))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    lone = [m for m in re.finditer(r"hashpartitioning\(file#\d+, \d+\)", plan)]
    assert len(lone) == 1
    got = [(r.file[-6:], r.six) for r in rows.collect()]
    assert sorted(got) == [(f"f{k}.xml", i) for k in range(3) for i in range(30)]
    assert len({r.doc_id for r in rows.collect()}) == 3


@pytest.mark.parametrize("size", [97, 1 << 20])
def test_sentences_are_ranked_where_they_are_parsed(spark, tmp_path, size):
    """Elements count on through Arrow batches, byte ranges and files of one task, empty
    ones don't count, and tokens are not shuffled for their numbers."""
    write(tmp_path, ORDINARY | MALFORMED | {"cdata.xml": ODD["cdata.xml"]})
    for k in range(3):
        body = "".join(f"<s id='{i}'>" + "".join(f"<w>{k}.{i}.{j}</w>" for j in range(i % 3)) + "</s>" for i in range(50))
        (tmp_path / f"more{k}.xml").write_text(f"<text>{body}</text>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        with split_bytes(spark, size):
            df = readers.read_tok_xml(spark, str(tmp_path))
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert not re.search(r"hashpartitioning\([^)]*(_block|_blk)", plan) and "Window" in plan
            found = df.orderBy("file", "six").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {}
    for r in found:
        got.setdefault(r.file.rsplit("/", 1)[1], []).append((r.six, r.sid))
    ids = lambda n, k: [str(i) for i in range(n) if i % k]
    assert got.pop("plain.xml") == list(enumerate(ids(24, 4)))
    for k in range(3):
        assert got.pop(f"more{k}.xml") == list(enumerate(ids(50, 3)))
    assert got.pop("cdata.xml") == [(0, "1"), (1, "2")] and not set(got) & set(MALFORMED)


def test_written_xml_is_not_indented(spark, sf_dir):
    path = io_catalog.tok_xml_files(io_catalog.Inputs(spark, sf_dir))
    lines = spark.read.option("pathGlobFilter", "part-*").text(path)
    assert lines.count() > 1000 and lines.filter("value LIKE ' %'").isEmpty()


def test_a_corpus_is_built_from_the_parsed_rows(spark, sf_dir, monkeypatch):
    """The reader has written them; they are not written again to be numbered."""
    names, write = [], elements.staged

    def named(df, name="staged"):
        names.append(name)
        return write(df, name)

    for module in (jobs, elements, readers):
        monkeypatch.setattr(module, "staged", named)
    assert QUERIES["build_corpus"](spark, sf_dir).count() > 1000 and names.count("parsed") == 1


def test_splits_write_parsed_rows_only(spark, sf_dir, monkeypatch):
    """A file that is read in three sizes is parsed and written thrice, but the numbered
    rows are not written again."""
    names, write = [], io_catalog.staged

    def named(df, name="staged"):
        names.append(name)
        return write(df, name)

    for module in (io_catalog, elements, readers):
        monkeypatch.setattr(module, "staged", named)
    rows = QUERIES["read_tok_xml_splits"](spark, sf_dir)
    assert rows.groupBy("n_splits").count().select("count").distinct().count() == 1
    assert names.count("parsed") == 3 and "read" not in names
