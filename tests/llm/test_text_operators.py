"""Token, language, quality and scoring operators on small tables."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textloom.llm import arrays as ar
from textloom.llm import bpe, catalog, language, pretokens, quality, scoring, token_count
from textloom.llm.vocabulary import load

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, _row string, score string"
LONG = "word and another one, " * 20_000
ODD = [
    (1, "", "en", "a", 0, "x", "y", "z"),
    (2, None, "en", None, None, "x", "y", "z"),
    (None, "no id here", None, "a", 10, None, None, None),
    (3, "same text", "en", "a", 9, "x", "y", "z"),
    (3, "same text", "en", "a", 9, "x", "y", "z"),
    (4, LONG, "en", "b", len(LONG), "x", "y", "z"),
    (5, "\n\n  \t 123 !?", "de", "b", 1, "x", "y", "z"),
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def content():
    with open(PATH, encoding="utf-8") as f:
        return f.read()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def samples(n=1500, seed=3):
    parts = ["'s", "'re", "'ll", "'", "a", "b", " ", "  ", "\n", "\t", "\r\n", "é", "ß", "1", "23", "!", "--", "日本", "語"]
    parts += ["　", "\xa0", "<|endoftext|>", "the", "ing", " The", "I'm", "'d've", "😀", "́", "A", "²", "٣", "\x00"]
    draw = random.Random(seed)
    fixed = ["", "'", " 's", "  's", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "a" * 200, " " * 37 + "x", "-" * 99]
    return fixed + ["".join(draw.choice(parts) for _ in range(draw.randint(0, 50))) for _ in range(n)]


def test_pretokens_follow_the_pattern():
    import regex

    for text in samples(400):
        raw = text.encode()
        if not raw:
            continue
        data = np.frombuffer(raw, np.uint8)
        got = np.flatnonzero(pretokens.byte_begins(data, np.array([0, len(data)]))).tolist()
        want = [len(text[: m.start()].encode()) for m in regex.finditer(public_tokenizers.PATTERN, text)]
        assert got == want, text


def test_pretokens_do_not_depend_on_chunks():
    points = np.array([ord(c) for c in "".join(samples(60))], np.uint32)
    starts = np.array([0, 5, 100])
    whole = pretokens.begins(points, starts, chunk=1 << 20)
    for chunk in (1, 2, 7, 64):
        assert (pretokens.begins(points, starts, chunk=chunk) == whole).all()


@pytest.mark.parametrize("states", [3, 200, 1 << 15])
def test_token_counts_are_the_librarys(library, content, states):
    texts = samples()
    machine = token_count.Transducer(load(content), states)
    values, owner, added = machine.vocabulary.parts(pa.array([t.encode() for t in texts], pa.binary()))
    total = np.zeros(len(texts), np.int64)
    for i, j, data, offsets in ar.pieces(values, 500):
        np.add.at(total, owner[i:j], machine.counts(data, pretokens.byte_begins(data, offsets), offsets))
    for part, _ in added:
        total[owner[part]] += 1
    assert total.tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_ids_are_the_librarys(library, content):
    texts = samples(seed=4)
    coder = bpe.Encoder(load(content))
    got = list(coder.encode_all(pa.array([t.encode() for t in texts], pa.binary())))
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert got == want
    assert [coder.decode(w) for w in want] == library.decode_batch(want, skip_special_tokens=False)


def test_no_token_holds_a_forced_cut(content):
    coder = bpe.Encoder(load(content))
    assert not coder.inside.all()
    assert all(coder.inside[a, b] for t in coder.vocabulary.tokens for a, b in zip(t, t[1:], strict=False))


def test_other_tokenizers_are_refused():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f, pytest.raises(ValueError):
        load(f.read())


def test_codec_round_trip_and_odd_rows(odd, empty, library):
    out = bpe.encode_decode(odd, PATH, digests=True)
    rows = out.collect()
    assert len(rows) == len(ODD)
    assert out.columns[:3] == ["doc_id", "text", "lang"] and out.columns.count("ids") == 1
    for r in rows:
        assert r.decoded == (r.text or "")
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids
        assert r.n_tokens == len(r.ids)
    assert bpe.encode_decode(empty, PATH).count() == 0


def test_counts_of_odd_rows(odd, empty, library):
    got = Counter(tuple(r) for r in token_count.count_tokens(odd, PATH).collect())
    want = Counter((i, len((t or "").encode()), len(library.encode(t or "").ids)) for i, t, *_ in ODD)
    assert got == want
    assert token_count.count_tokens(empty, PATH).count() == 0


def test_language_of_test_tables(spark, sf_dir):
    got = catalog.op6_language_id(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    held = got.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert held > 0.95


def test_language_of_odd_rows(spark, odd, empty):
    model = language.fit(odd)
    assert list(model.contents) == ["en", "de"]
    rows = language.predict(odd, model).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        if not r.text or not re.search("[a-z]", r.text):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        else:
            assert r.lang_pred in ("en", "de") and 0 <= r.score <= 1
    assert language.predict(empty, model).count() == 0
    nothing = language.fit(empty)
    assert {r.lang_pred for r in language.predict(odd, nothing).collect()} == {"und"}


def test_narrow_margins_are_rejected(spark):
    docs = spark.createDataFrame(
        [(i, "abc def ghi jkl mno", k) for i, k in enumerate(["aa", "bb"] * 3)], "doc_id long, text string, lang string"
    )
    rows = language.predict(docs, language.fit(docs)).collect()
    assert all(r.rejected for r in rows)


def test_quality_on_held_out_rows(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = catalog.op3_quality_rules(spark, sf_dir).join(labels, "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(r.held_out == (r in held) for r in rows)
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.9


def test_quality_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (7, None)], "doc_id long, quality int")
    rows = quality.score(odd, labels, F.lit(True)).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 3}) == 1
    one = quality.score(odd, labels.filter("quality = 1"), F.lit(True)).collect()
    assert len({r.score for r in one}) == 1 and one[0].score > 0.5
    assert quality.score(empty, labels, F.lit(True)).count() == 0
    assert {r.score for r in quality.score(odd, labels.limit(0), F.lit(True)).collect()} == {0.5}


def test_compiled_rules_are_the_rules(spark):
    rule = (("digit", True, 0.5), ("upper", False, 0.25))
    model = quality.Model((rule,), (2.0,), -1.0)
    df = spark.createDataFrame([(0.5, 0.3), (0.6, 0.3), (0.1, 0.25)], "digit double, upper double")
    got = [r[0] for r in df.select(model.log_odds()).collect()]
    assert got == [1.0, -1.0, -1.0]


def unigram(docs, train):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for i, t in docs]
    count = Counter(w for (i, ws), k in zip(words, train, strict=True) if k for w in ws)
    ends = sum(train)
    n, v = sum(count.values()) + ends, len(count) + (ends > 0)
    out = []
    for i, ws in words:
        cs = [count[w] for w in ws] + [ends]
        base = sum(math.log10((c + 0.5) / (n + 0.5 * (v + 1))) for c in cs)
        out.append((i, len(cs), sum(c > 0 for c in cs), n, base))
    return out


def test_scoring_against_brute_force(spark):
    draw = random.Random(5)
    texts = [" ".join(draw.choice(["The", "the", "cat", "sat", "on", "é", "x\ty"]) for _ in range(draw.randint(0, 30))) for _ in range(80)]
    docs = list(enumerate([*texts, "", None]))
    train = [i % 3 > 0 for i, _ in docs]
    df = spark.createDataFrame([(i, t, k) for (i, t), k in zip(docs, train, strict=True)], "doc_id long, text string, train boolean")
    got = {r.doc_id: r for r in scoring.score(df.repartition(3)).collect()}
    for i, n, known, whole, base in unigram(docs, train):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, whole, not train[i])
        assert r.base_score == pytest.approx(base) and r.score < 0


def brute_ppm(texts, order=scoring.ORDER):
    """Counts by context, and the probability of a symbol by walking down."""
    counts = {}
    for t in texts:
        tape = [0xFE] * order + list(t) + [0xFF]
        for i in range(order, len(tape)):
            for k in range(order + 1):
                counts.setdefault(tuple(tape[i - k : i]), Counter())[tape[i]] += 1

    def p(context, symbol):
        total, excluded = 1.0, set()
        for k in range(order, -1, -1):
            seen = counts.get(tuple(context[len(context) - k :]))
            if seen is None:
                continue
            left = {s: 2 * c - 1 for s, c in seen.items() if s not in excluded}
            whole = sum(left.values()) + len(left)
            if symbol in left:
                return total * left[symbol] / whole
            if left:
                total *= len(left) / whole
            excluded |= set(seen)
        return total / (256 - len(excluded))

    return p


def test_trie_is_partial_matching():
    draw = random.Random(6)
    texts = [bytes(draw.choice(b"abcab ") for _ in range(draw.randint(0, 40))) for _ in range(30)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    keys, _ = scoring.grams(data, offsets)
    tables = []
    for k in range(scoring.ORDER + 1):
        tables.append(scoring.counted(keys & np.uint64((1 << 8 * (k + 1)) - 1)))
    trie, p = scoring.Trie(tables), brute_ppm(texts)
    for text in [*texts[:5], b"", b"zzz", b"abx ab", bytes(range(97, 123))]:
        keys, _ = scoring.grams(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        tape = [0xFE] * scoring.ORDER + list(text) + [0xFF]
        want = [math.log10(p(tape[:i], tape[i])) for i in range(scoring.ORDER, len(tape))]
        assert trie.log10(keys).tolist() == pytest.approx(want)
    symbols = np.array([sum(c << 8 * (5 - i) for i, c in enumerate([*b"cabca", s])) for s in range(256)], np.uint64)
    assert (10 ** trie.log10(symbols)).sum() == pytest.approx(1)


def test_scoring_without_training_rows(spark, odd, empty):
    rows = scoring.score(odd.withColumn("train", F.lit(None).cast("boolean"))).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert r.held_out and r.n_known == 0 and r.train_tokens == 0
    assert {r.score for r in rows if r.doc_id == 1}.pop() == pytest.approx(-math.log10(256))
    assert scoring.score(empty.withColumn("train", F.lit(True))).count() == 0


def test_scoring_with_fewer_entries_stays_nested(spark, odd):
    rows = scoring.score(odd.withColumn("train", F.lit(True)), entries=40).collect()
    assert len(rows) == len(ODD) and all(math.isfinite(r.score) and r.score < 0 for r in rows)


def test_scores_are_partial_matching_of_all_grams(spark):
    draw = random.Random(8)
    texts = ["".join(draw.choice("abcab é") for _ in range(draw.randint(0, 40))) for _ in range(60)] + ["abz", "zq", ""]
    rows = [(i, t, i % 3 > 0) for i, t in enumerate(texts)]
    p = brute_ppm([t.encode() for _, t, k in rows if k])
    got = scoring.score(spark.createDataFrame(rows, "doc_id long, text string, train boolean").repartition(3)).collect()
    assert len(got) == len(rows)
    for r in got:
        tape = [0xFE] * scoring.ORDER + list(texts[r.doc_id].encode()) + [0xFF]
        want = sum(math.log10(p(tape[:i], tape[i])) for i in range(scoring.ORDER, len(tape)))
        assert r.score == pytest.approx(want)


def test_rare_grams_stay_in_a_large_model(spark):
    # More than 2^22 distinct grams of six bytes; the rare ones must keep their counts.
    n = (1 << 22) + 1000
    counts = spark.range(n).select((F.col("id") * 256 + 0x61).alias("key"), F.lit(1).cast("long").alias("n"))
    counts = counts.union(spark.range(1).select((F.col("id") + 0x62).alias("key"), F.lit(9).cast("long")))
    got = {r.key: r.p for r in scoring.probabilities(counts).filter("key < 1024").collect()}
    assert got[256 + 0x61] == pytest.approx(math.log10(1 / 2))
    assert got[0x61] == pytest.approx(math.log10(1 / (1 + 17 + 2)))


# --- words whose polynomial hashes agree ---------------------------------------


def morse(n, a, b):
    """Thue-Morse word of n letters and its complement, which agree in every
    polynomial modulo 2^64 from some length on."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


PAIRS = [morse(n, *ab) for n in (1024, 2048, 8192) for ab in ("ab", "01", "et", "-=")]


def test_hostile_spans_part():
    for x, y in PAIRS:
        data = np.frombuffer((x + y).encode(), np.uint8)
        n = len(x)
        assert len(np.unique(ar.span_hashes(data, np.array([0, n]), np.array([n, 2 * n])))) == 2


def test_distinct_spans_compare_bytes(monkeypatch):
    """Right with hashes that tell nothing apart, for short and long spans."""
    draw = random.Random(4)
    spans = [("ab"[draw.randint(0, 1)] * draw.randint(1, 3)) * draw.choice([1, 2, 40]) for _ in range(600)]
    data = np.frombuffer("".join(spans).encode(), np.uint8)
    ends = np.cumsum([len(x) for x in spans])
    starts = ends - [len(x) for x in spans]
    for hashes in (ar.span_hashes, lambda v, s, e: np.zeros(len(s), np.uint64)):
        monkeypatch.setattr(ar, "span_hashes", hashes)
        first, which = ar.distinct_spans(data, starts, ends)
        assert len(first) == len(set(spans))
        assert [spans[first[w]] for w in which] == spans


def test_hostile_spans_are_encoded(content, library):
    texts = [t for pair in PAIRS for t in pair]
    coder, machine = bpe.Encoder(load(content)), token_count.Transducer(load(content))
    for batch in (texts, [t for t in texts for _ in range(2)]):
        for text, ids in zip(batch, coder.encode_all(pa.array([t.encode() for t in batch], pa.binary())), strict=True):
            assert ids == library.encode(text, add_special_tokens=False).ids
            assert coder.decode(ids) == text
        data = np.frombuffer("".join(batch).encode(), np.uint8)
        offsets = np.append(0, np.cumsum([len(t) for t in batch]))
        counts = machine.counts(data, pretokens.byte_begins(data, offsets), offsets)
        assert counts.tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in batch]


def test_hostile_words_are_counted_apart(spark):
    x, y = PAIRS[0]
    rows = spark.createDataFrame([(1, x, True), (2, y, False)], "doc_id long, text string, train boolean")
    assert {r.doc_id: r.n_known for r in scoring.score(rows).collect()} == {1: 2, 2: 1}
