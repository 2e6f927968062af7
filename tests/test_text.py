"""Text expressions against plain Python."""

import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import markup
from textloom.functions import text as fx
from textloom.operators import filters as fl
from textloom.plans import tables

PUNCT = set("\\(){}[]=&|^+<>/*%;.'\"?!~-")


def py_sentences(text):
    out = []
    for para in text.split("\n"):
        cur = ""
        for ch in para:
            cur += ch
            if ch in ".!?":
                out.append(cur)
                cur = ""
    return out


def py_tokens(sent):
    out, word = [], ""
    for ch in sent + " ":
        if re.fullmatch(r"\w", ch):
            word += ch
            continue
        if word:
            out.append(word)
            word = ""
        if ch in PUNCT:
            out.append(ch)
    return out


def py_spans(toks):
    if len(toks) < 2:
        return None
    at, out = 0, []
    for t in toks:
        out.append((at, at + len(t)))
        at += len(t) + 1
    return out


alphabet = st.sampled_from(list("aZ é9ß_,:#@$ \n.!?\"'-[](){}&^|*%/<>=~;\\+"))
texts = st.text(alphabet, max_size=80)


@settings(max_examples=8, deadline=None)
@given(st.lists(texts, min_size=1, max_size=60))
def test_parse_matches_python(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, text string")
    sents = df.select("id", F.posexplode(fx.text_sentences("text")).alias("six", "raw"))
    toks = sents.withColumn("tokens", fx.tokenize("raw"))
    rows = toks.select(
        "id", "six", "raw", "tokens", fx.sent_text("tokens").alias("sent"),
        fx.encode_spans("tokens").alias("spans"), fx.token_index("tokens").alias("ti"),
    ).withColumn("back", fx.decode_spans("sent", "spans")).withColumn(
        "again", fx.spans_from_text(fx.spans_to_text("spans"))
    ).collect()
    want = {(i, k): s for i, v in enumerate(values) for k, s in enumerate(py_sentences(v))}
    assert {(r.id, r.six): r.raw for r in rows} == want
    for r in rows:
        assert r.tokens == py_tokens(r.raw)
        spans = None if r.spans is None else [tuple(s) for s in r.spans]
        assert spans == py_spans(r.tokens)
        assert r.back == r.tokens
        assert r.again == r.spans
        starts = [s for s, _ in py_spans(r.tokens)] if spans else [0]
        assert [tuple(t) for t in r.ti] == [(i, s, i, t) for i, (s, t) in enumerate(zip(starts, r.tokens))]


def test_paragraph_sentences_agree(spark):
    df = spark.createDataFrame([("One. Two!\n\ntail\nThree...? x",), ("",), ("no end",)], "t string")
    rows = df.select(
        fx.text_sentences("t").alias("a"),
        F.flatten(F.transform(fx.split_paragraphs("t"), fx.split_sentences)).alias("b"),
    ).collect()
    assert rows[0].a == ["One.", " Two!", "Three.", ".", ".", "?"]
    assert all(r.a == r.b for r in rows)


def test_long_tail_is_linear(spark):
    df = spark.range(1).select(F.concat(F.lit("A. "), F.repeat(F.lit("word "), 400_000)).alias("t"))
    assert df.select(F.size(fx.text_sentences("t"))).first()[0] == 1


def test_language_vote(spark):
    cases = [
        ("the end of der Tag", "en"), ("der the", "de"), ("la", "es"), ("le la", "fr"),
        ("nothing here", None), ("theory", None), ("The THE der die", "de"), ("", None),
    ]
    df = spark.createDataFrame(cases, "s string, want string")
    for r in df.select("*", fx.vote_lang("s").alias("got"), fx.vote_lang("s", default="sq").alias("d")).collect():
        assert r.got == r.want
        assert r.d == "sq"


def test_trims(spark):
    cases = [
        ("12abc", "abc"), ("# - . 'x' ", "x"), ("span good names", "good name"),
        ("...hello...", "hello"), ("", ""), ("--12", "12"),
    ]
    df = spark.createDataFrame(cases, "s string, want string")

    def by_hand(s):
        s = s.lstrip("0123456789")
        for chars in fx.TRIM_SETS:
            s = s.strip(chars)
        return s

    for r in df.select("*", fx.trim_chain(fx.strip_digits("s")).alias("got")).collect():
        assert r.got == by_hand(r.s)
    tagged = spark.createDataFrame([("< / span > plain text < / i >",)], "s string")
    assert tagged.select(fx.strip_tags("s")).first()[0].strip() == "plain text"


def test_split_path(spark):
    files = ["corpus/finetune/sq/17/Books/xml/a/b.xml", "c/f/sq/3000000000/Books", None]
    df = spark.createDataFrame([(f,) for f in files], "file string")
    got = [r[0] for r in df.select(fx.split_path("file")).collect()]
    assert tuple(got[0]) == (17, "Books", "xml/a/b.xml") and tuple(got[1]) == (3000000000, "Books", "")
    assert got[2].sid is None
    bad = [(1, "corpus/finetune/sq/x/Books"), (2, "corpus/finetune/sq/17"), (3, files[0])]
    docs = spark.createDataFrame(bad, "doc_id bigint, file string")
    with pytest.raises(Exception, match="no source id|short path"):
        tables.corp_doc_of(docs).collect()
    good, left = tables.corp_doc_tolerant(docs)
    assert [tuple(r) for r in good.collect()] == [(3, 17, "Books", "xml/a/b.xml")]
    assert {r.doc_id: r.reason[:10] for r in left.collect()} == {1: "no source ", 2: "short path"}


def test_quotes_and_case(spark):
    df = spark.createDataFrame(
        [(['"', "a", '"'], ["a"]), (['"'], []), (["a", '"'], ["a", '"']), ([], [])],
        "t array<string>, want array<string>",
    )
    for r in df.select("*", fx.strip_quote_tokens("t").alias("got")).collect():
        assert r.got == r.want
    up = spark.createDataFrame([("aëZ1",)], "s string").select(fx.ascii_upper("s")).first()[0]
    assert up == "AëZ1"


def test_wiki_markup(spark):
    src = (
        "'''Bold''' [[Page|label]] and [[Other]].<!-- gone -->\n"
        "== Head ==\n{{cite|title={{deep|x}}|y}} {{name}} [http://e.org text] <ref>r</ref>end."
        "[[File:a.png|thumb|cap [[b]]]]"
    )
    df = spark.createDataFrame([(src,), (None,)], "w string")
    got = [r[0] for r in df.select(markup.strip_markup("w")).collect()]
    assert got == ["Bold label and Other.\nHead\nx name text end.", None]


def test_template_depth():
    deep = "{{a|" * 30 + "core" + "}}" * 30
    assert markup.resolve(deep) == "core"
    assert markup.resolve("{{{p|d}}} {{{q}}}") == "d "


def test_html(spark):
    html = "<head><title>t</title></head><p>A &amp; B<br>C</p><script>x('</p>')</script><!-- c --><div> D </div>"
    df = spark.createDataFrame([(html,)], "h string")
    assert df.select(markup.html_paragraphs(F.col("h"))).first()[0] == ["A & B", "C", "D"]


def nested_markup(draw, depth):
    """Random well-formed markup and what it shows."""
    if depth == 0 or draw.random() < 0.15:
        word = draw.choice(["a", "b c", "", "x.\ny", "é", "} {", "1-2"])
        return word, word
    kind = draw.randint(0, 9)
    a, shown = nested_markup(draw, depth - 1)
    b, other = nested_markup(draw, depth - 1)
    return [
        (f"[[{a}]]", shown),
        (f"[[t|{a}]]", shown),
        (f"[[File:{a}|{b}]]", ""),
        (f"{{{{n|{a}|{b}}}}}", shown),
        (f"{{{{n|k={a}|{b}}}}}", shown),
        (f"{{{{{{p|{a}}}}}}}", shown),
        (f"[http://u.v/w?x {a}]", shown),
        (f"<ref name='r'>{a}</ref>{b}", other),
        (f"<!-- {{{{ [[ -->{a}<ref n=1 />{b}", shown + other),
        (f"{{{{n|q\n{{|\n| {a} || {b}\n|}}|z}}}}", f"q\n{{|\n| {shown} || {other}\n|}}"),
    ][kind]


def test_markup_nests_to_any_depth():
    draw = random.Random(6)
    for i in range(4000):
        parts = [nested_markup(draw, 1 + i % 6) for _ in range(3)]
        text, want = (" ".join(p) for p in zip(*parts, strict=True))
        assert markup.resolve(text) == want, text


@pytest.mark.parametrize("text, want", [
    ("[[a|[[b]] c", "[[a|b c"),
    ("{{a|[[b}} c]]", "[[b c]]"),
    ("{{{{a}}}} {{{{{p|t}}}|x}}", "{} x"),
    ("a]] }} |} -->", "a]] }} |} -->"),
    ("[http://x y z", "[http://x y z"),
    ("<!-- open [[a]]", "<!-- open a"),
    ("<ref>open [[a]]", "<ref>open a"),
    ("[[:Category:x]] [[ category:y]] [[Image:a|b [[c|d]] {{e}}]]!", ":Category:x  !"),
    ("[[a|b|c]] {{t||v}} {{{p}}}", "b|c  "),
])
def test_markup_without_pairs(text, want):
    assert markup.resolve(text) == want


def test_markup_template_callback():
    assert markup.resolve("{{a|b|c=1}} {{x|{{y|2}}}}", lambda n, args: f"{n}{args}") == "a['b', 'c=1'] x[\"y['2']\"]"
    assert markup.resolve("p {{a|b}} q", None) == "p  q"


@pytest.mark.parametrize("unit, tail", [
    ("[[", ""), ("{{", ""), ("{{a|[[b|", ""), ("{|\n", ""), ("<ref>", ""), ("<!-- ", ""), ("[http://x ", ""),
    ("{{a|", "}}"), ("[[a|", "]]"), ("{", "}"), ("[[{{a|", "}}]]"), ("]] }} ", ""), ("{{a|[[", "}}"),
])
def test_markup_is_linear(unit, tail):
    def seconds(n):
        text = unit * n + tail * n
        start = time.perf_counter()
        markup.resolve(text)
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(160_000) < 60 * max(seconds(10_000), 0.002)


def test_roundtrip_joins_each_text_once(spark):
    """Neither the text nor the spans are worked out anew for each span; the check still
    finds what spans do not give back."""
    rows = [(1, 0, ["a", "b c", "d"]), (1, 1, ["x"]), (None, 2, []), (2, 3, None), (2, 4, ["a", None, "b"])]
    df = spark.createDataFrame(rows, "doc_id long, six int, tokens array<string>")
    out = fl.check_roundtrip(df)
    assert out.columns == df.columns
    assert {r.six for r in out.collect()} == {2, 3, 4}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("array_join(") == 1


def test_patterns_find_the_same(spark):
    """Sentences and tokens as the plain patterns give them; the quicker ones try no
    character of a sentence twice."""
    rows = ["", None, "a", "a.", "a..b!\n\n?c", "\n", ".\n.", "a\r\n b.\r\n", "\U0001f600x. y?\x00z", "a.\n\nb", "x\ny_9.é٣z²-~\\"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    plain = F.filter(F.split("t", "(?<=[.!?])\n?|\n"), lambda s: F.substring(s, -1, 1).isin(".", "!", "?"))
    for r in df.select(
        fx.text_sentences("t").alias("a"), plain.alias("b"), fx.tokenize("t").alias("c"),
        F.regexp_extract_all("t", F.lit(fx.TOKEN_PATTERN), F.lit(0)).alias("d"),
    ).collect():
        assert r.a == r.b and r.c == r.d
    assert "(?<=" not in df.select(fx.text_sentences("t"))._jdf.queryExecution().analyzed().toString()
