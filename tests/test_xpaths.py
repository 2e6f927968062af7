"""Paths followed while parsing against Spark's xpath."""

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as fx
from textloom.functions import xpaths

PATHS = ("s/w/text()", "/s/w/text()", "s/@id", "s/w/@id", "s/text()", "s/w", "//w/text()", "s/*/text()", "s/w[1]/text()")
ROWS = (
    "<s id='1'><w>a</w><w>b &amp; c</w></s>", "<s id='2'><w>a<b/>c</w></s>", "<s><w/><w></w><w> </w></s>",
    "<s><w>a&#10;b\r\nc</w>tail</s>", "<s><w>a<!--x-->b</w></s>", "<s><w><![CDATA[x]]>y</w></s>",
    "<s><t><w>n</w></t><w>k</w><s><w>i</w></s></s>", "<s id='a\nb'/>", "<r><s><w>x</w></s></r>",
    "<p:s xmlns:p='u'><w>q</w></p:s>", "<s xmlns='u'><w>q</w></s>", "<p:s><p:w>q</p:w></p:s>", "", None, " <s><w>z</w></s>",
    "<?xml version='1.1'?><s><w>&#1;</w></s>", "<s><w>\U0001f600 é a\u0085b</w></s>", "<s é='1'><w>a</w></s>",
    "<s id='&lt;\t&#9;'><w id=''>&lt;&gt;</w><w id='3'/></s>", "<s x:id='1' id='2'><w xml:id='4'>a</w></s>",
    "<!DOCTYPE s [<!ENTITY e 'v'><!ATTLIST s id CDATA 'd'>]><s><w>&e;</w></s>", "<s>" + "<w>x</w>" * 50 + "</s>",
    "<s><w>" + "long " * 9000 + "&amp;</w></s>", "<s>" + "<w>" * 300 + "y" + "</w>" * 300 + "</s>",
)
BROKEN = ("<s><w>a</s>", "<s/>x", "<s><w>\x01</w></s>", "<s a='1' a='2'/>", "<s>&e;</s>", "<s>]]></s>", "﻿<s/>", "<s>￾</s>")


@pytest.mark.parametrize("path", PATHS)
def test_path_gives_what_xpath_gives(spark, path):
    df = spark.createDataFrame(list(enumerate(ROWS)), "id int, x string")
    got = df.select("id", fx.xpath_fields("x", path).alias("got"), F.xpath("x", F.lit(path)).alias("want"))
    assert [(r.id, r.got) for r in got.collect()] == [(r.id, r.want) for r in got.collect()]


@pytest.mark.parametrize("xml", BROKEN)
def test_broken_rows_fail_as_in_xpath(spark, xml):
    df = spark.createDataFrame([(xml,)], "x string")
    with pytest.raises(Exception, match="(?i)xml"):
        df.select(fx.xpath_fields("x", "s/w/text()")).collect()


def test_bytes_that_are_no_text(spark):
    df = spark.createDataFrame([(b"<s><w>a\xffb</w></s>",)], "x binary").select(F.expr("cast(x as string)").alias("x"))
    row = df.select(fx.xpath_fields("x", "s/w/text()").alias("got"), F.xpath("x", F.lit("s/w/text()")).alias("want")).first()
    assert row.got == row.want


def test_plain_rows_need_no_xpath():
    """Rows of elements, attributes and text are read by the shared parse."""
    rows = [b"<s id='1'><w>a</w><w>b &amp; c</w></s>", None, b"<s><!--x--></s>", b"<s/>"] * 3
    assert xpaths.read(rows, ["s/w/text()", "s/@id"]) == [[["a", "b & c"], ["1"]], None, None, [[], []]] * 3


@pytest.mark.parametrize("rows", [(b"<s>", b"</s>"), (b"<s/><s>", b"</s>"), (b"<s/><s/>", b"<s/>"), (b"<s/>x", b"<s/>")])
def test_rows_are_whole_by_themselves(rows):
    """Rows that only make a document together are left to xpath, not the others."""
    good = b"<s><w>a</w></s>"
    want = [[["a"]], *[[[]] if r == b"<s/>" else None for r in rows], [["a"]]]
    assert xpaths.read([good, *rows, good], ["s/w/text()"]) == want
