"""Text expressions: paragraphs, sentences, tokens, spans, language, clean-up.

All stay in the JVM as built-in expressions, but for simple paths in XML.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import xpaths

# The characters that are tokens on their own, and the word class
# (written out because \w is ASCII in Java).
TOKEN_PATTERN = r"""[\\(){}\[\]=&|^+<>/*%;.'"?!~-]|[\p{L}\p{N}_]+"""
SENTENCE_END = r"[.!?]"
# The same tokens and pieces as above and in ``split_sentences``, for the JVM: listed
# characters are looked up before classes, and nothing is tried twice.
_ASCII_WORD = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_"
_TOKENS = rf"""[{_ASCII_WORD}\p{{L}}\p{{N}}]++|[\\(){{}}\[\]=&|^+<>/*%;.'"?!~-]"""
_PIECES = r"[^.!?\n]*+(?:[.!?]|\n|\z)"

# Stop words that vote for a sentence's language.
STOP_WORDS: dict[str, tuple[str, ...]] = {
    "de": ("der", "die", "das", "und", "ist"),
    "en": ("the", "of", "and", "to", "is"),
    "es": ("el", "la", "los", "y", "es"),
    "fr": ("le", "la", "les", "et", "est"),
}

# Character sets trimmed from both ends, in this order.
TRIM_SETS: tuple[str, ...] = (
    "#", "-", ".", "'", "[", "[", '"', ". . .", "$", "*", ",", "-", "+", "&", "%", ")",
    "/", ":", ";", "< / span >", "< / q >", "< / h2 >", "< / i >", "< / cite >", " ",
)

# The tags behind the last sets above, for the tag-safe variant.
TRIM_TAGS: tuple[str, ...] = ("span", "q", "h2", "i", "cite")

ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def split_paragraphs(text: Column | str) -> Column:
    """Non-empty lines."""
    return F.filter(F.split(_col(text), "\n"), lambda p: p != "")


def split_sentences(para: Column | str) -> Column:
    """Shortest runs ended by ``.``, ``!`` or ``?``; the unterminated tail goes.

    Splitting behind each terminator is linear in the text, and the last piece
    is always the tail (empty if the text ends with a terminator).
    """
    pieces = F.split(_col(para), f"(?<={SENTENCE_END})")
    return F.slice(pieces, F.lit(1), F.size(pieces) - 1)


def text_sentences(text: Column | str) -> Column:
    """Sentences of all paragraphs of a text, in order, in one pass.

    Also ends pieces at line ends; those without a terminator are paragraph tails.
    A piece is taken up to the end of the text, so this is linear too.
    """
    pieces = F.regexp_extract_all(_col(text), F.lit(_PIECES), F.lit(0))
    ends = [F.lit(x) for x in ".!?"]
    return F.filter(pieces, lambda s: F.endswith(s, ends[0]) | F.endswith(s, ends[1]) | F.endswith(s, ends[2]))


def tokenize(sent: Column | str) -> Column:
    return F.regexp_extract_all(_col(sent), F.lit(_TOKENS), F.lit(0))


def split_whitespace(text: Column | str) -> Column:
    """Whitespace tokens, none for blank text."""
    return F.filter(F.split(_col(text), r"\s+"), lambda t: t != "")


def sent_text(tokens: Column | str) -> Column:
    return F.array_join(_col(tokens), " ")


def _spans(toks: Column) -> Column:
    """``(start, end)`` of each token, folded in one pass."""
    acc0 = F.struct(
        F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out")
    )

    def step(acc: Column, t: Column) -> Column:
        end = (acc["at"] + F.length(t)).cast("int")
        span = F.struct(acc["at"].alias("start"), end.alias("end"))
        return F.struct((end + 1).alias("at"), F.array_append(acc["out"], span).alias("out"))

    return F.aggregate(toks, acc0, step, lambda acc: acc["out"])


def encode_spans(tokens: Column | str) -> Column:
    """``(start, end)`` of each token in the space-joined text; NULL for fewer
    than two tokens."""
    toks = _col(tokens)
    return F.when(F.size(toks) > 1, _spans(toks))


def decode_spans(text: Column | str, spans: Column | str) -> Column:
    """Tokens cut from the text; the whole text where spans are NULL."""
    t, s = _col(text), _col(spans)
    cut = F.transform(s, lambda x: F.substring(t, x["start"] + 1, x["end"] - x["start"]))
    return F.when(s.isNull(), F.array(t)).otherwise(cut)


def spans_to_text(spans: Column | str) -> Column:
    """``(0,3),(4,9)``: the import and export form."""
    s = _col(spans)
    parts = F.transform(
        s, lambda x: F.concat(F.lit("("), x["start"], F.lit(","), x["end"], F.lit(")"))
    )
    return F.when(s.isNotNull(), F.array_join(parts, ","))


def spans_from_text(col: Column | str) -> Column:
    """Inverse of :func:`spans_to_text`."""
    c = _col(col)
    pairs = F.regexp_extract_all(c, F.lit(r"\(\d+,\d+\)"), F.lit(0))
    return F.when(
        c.isNotNull(),
        F.transform(
            pairs,
            lambda p: F.struct(
                F.regexp_extract(p, r"\((\d+),", 1).cast("int").alias("start"),
                F.regexp_extract(p, r",(\d+)\)", 1).cast("int").alias("end"),
            ),
        ),
    )


def toklen(tokens: Column | str) -> Column:
    return F.size(_col(tokens)).cast("int")


def toklen_of_spans(spans_text: Column | str) -> Column:
    """Tokens counted in the text form of spans; NULL for singletons."""
    s = _col(spans_text)
    return (F.length(s) - F.length(F.replace(s, F.lit("("), F.lit("")))).cast("int")


def token_index(tokens: Column | str) -> Column:
    """Token position, character offset, position in sentence and form."""
    toks = _col(tokens)
    pairs = F.arrays_zip(toks.alias("norm"), _spans(toks).alias("span"))
    return F.transform(
        pairs,
        lambda p, i: F.struct(
            i.alias("i"), p["span"]["start"].alias("idx"), i.alias("i_sent"), p["norm"].alias("norm")
        ),
    )


def strip_quote_tokens(tokens: Column | str) -> Column:
    """Without the first and last token where both are double quotes."""
    toks = _col(tokens)
    quoted = (F.get(toks, F.lit(0)) == '"') & (F.try_element_at(toks, F.lit(-1)) == '"')
    inner = F.slice(toks, F.lit(2), F.greatest(F.size(toks) - 2, F.lit(0)))
    return F.when(quoted, inner).otherwise(toks)


def vote_lang(
    sent: Column | str,
    stop_words: Mapping[str, Sequence[str]] = STOP_WORDS,
    default: str | None = None,
) -> Column:
    """The language whose stop words occur most in a space-joined sentence.

    Ties go to the first language code, no hit gives NULL. Only the words that
    are in some list reach the counting. ``default`` overrides the vote, as a
    configured language does.
    """
    if default is not None:
        return F.lit(default)
    codes = sorted(stop_words)
    words = sorted({w for ws in stop_words.values() for w in ws})
    names = F.array(*[F.lit(c) for c in codes])

    def winner(counts: Column) -> Column:
        return F.get(names, (F.array_position(counts, F.array_max(counts)) - 1).cast("int"))

    def vote(found: Column) -> Column:
        counts = F.array(*[hits_in(found, stop_words[c]) for c in codes])
        return F.when(F.size(found) > 0, once(counts, winner))

    return once(hits_among(F.split(F.lower(_col(sent)), " "), words), vote)


def hits_among(found: Column, words: Sequence[str]) -> Column:
    return F.filter(found, lambda w: w.isin(*words))


def hits_in(found: Column, words: Sequence[str]) -> Column:
    return F.size(hits_among(found, words))


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip_digits(col: Column | str) -> Column:
    return F.regexp_replace(_col(col), "^[0-9]+", "")


def trim_chain(col: Column | str, sets: Sequence[str] = TRIM_SETS) -> Column:
    """Character-set trims in order; a set like ``< / span >`` also eats the
    letters in it."""
    out = _col(col)
    for chars in sets:
        out = F.btrim(out, F.lit(chars))
    return out


def strip_tags(col: Column | str, tags: Sequence[str] = TRIM_TAGS) -> Column:
    """Tag-safe variant: removes spaced end tags at both ends, keeps letters."""
    alt = "|".join(rf"<\s*/?\s*{t}\s*>" for t in tags)
    return F.regexp_replace(_col(col), rf"^(?:\s*(?:{alt}))+|(?:\s*(?:{alt}))+\s*$", "")


def trim_token(col: Column | str) -> Column:
    return F.trim(_col(col))


def ascii_upper(col: Column | str) -> Column:
    return F.translate(_col(col), ASCII_LOWER, ASCII_UPPER)


def path_fault(file: Column | str, offset: int = 4) -> Column:
    """Why a corpus file path has no source id or name; NULL if it has both."""
    parts = F.split(_col(file), "/")
    sid = F.get(parts, F.lit(offset - 1))
    return (
        F.when(F.size(parts) <= offset, F.concat(F.lit("short path: "), _col(file)))
        .when(sid.try_cast("bigint").isNull(), F.concat(F.lit("no source id: "), _col(file)))
    )


def split_path(file: Column | str, offset: int = 4) -> Column:
    """``sid``, ``name`` and ``sub_path`` of a corpus file path. A path without
    them fails; ``path_fault`` finds such paths before."""
    parts = F.split(_col(file), "/")
    fault = path_fault(file, offset)
    sid = F.get(parts, F.lit(offset - 1)).try_cast("bigint")
    return F.struct(
        F.when(fault.isNotNull(), F.raise_error(fault).cast("bigint")).otherwise(sid).alias("sid"),
        F.get(parts, F.lit(offset)).alias("name"),
        F.array_join(F.slice(parts, F.lit(offset + 2), F.size(parts)), "/").alias("sub_path"),
    )


def json_fields(col: Column | str, ddl: str) -> Column:
    return F.from_json(_col(col), ddl)


def xpath_fields(col: Column | str, path: str) -> Column:
    """The values of a path in XML text."""
    return F.get(xpaths.xpath_lists(_col(col), [path]), F.lit(0))


def xpath_lists(col: Column | str, *paths: str) -> Column:
    """An array of the values of each path in XML text, which is parsed once."""
    return xpaths.xpath_lists(_col(col), paths)


def set_difference(a: Column | str, b: Column | str) -> Column:
    return F.array_except(_col(a), _col(b))


def set_union(a: Column | str, b: Column | str) -> Column:
    return F.array_union(_col(a), _col(b))
