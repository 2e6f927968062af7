"""Surrogates for personal data.

Detected entities get replacements that a key determines: of the same type,
format, script and gender, the same for every mention of an entity, and different
for different entities, which a check over all entities makes sure of.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import arrays as ar
from textloom.session import staged

#: Forms of address and given names by gender.
TITLES = {
    "m": ("Mr", "Herr", "Herrn", "M", "Monsieur", "Señor", "Sr", "Sir", "господин", "κύριος"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Mlle", "Señora", "Sra", "Srta", "госпожа", "κυρία"),
    "u": ("Dr", "Prof", "Mx"),
}
GIVEN = {
    "m": ("James", "John", "Robert", "Michael", "William", "David", "Thomas", "Hans", "Peter", "Klaus", "Jürgen")
    + ("Pierre", "Jean", "Michel", "Louis", "Antoine", "José", "Juan", "Carlos", "Luis", "Miguel", "Иван", "Сергей"),
    "f": ("Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Susan", "Sarah", "Anna", "Ursula", "Monika", "Petra")
    + ("Marie", "Jeanne", "Camille", "Sophie", "Chloé", "María", "Carmen", "Ana", "Lucía", "Isabel", "Анна", "Мария"),
}
#: Syllables of made-up names, and endings by gender.
SYLLABLES = {
    "LATIN": tuple(c + v for c in "bdfgklmnprstv" for v in "aeiou"),
    "CYRILLIC": tuple(c + v for c in "бвгдзклмнпрст" for v in "аеиоу"),
    "GREEK": tuple(c + v for c in "βγδζκλμνπρστφ" for v in "αειου"),
}
ENDINGS = {
    "LATIN": {"m": "n", "f": "ra", "u": "l"},
    "CYRILLIC": {"m": "н", "f": "ра", "u": "л"},
    "GREEK": {"m": "ς", "f": "ρα", "u": "ν"},
}

#: Letters to draw from where a script has more than are in common use.
ALPHABETS = {
    "LATIN": "abcdefghijklmnopqrstuvwxyz",
    "CYRILLIC": "абвгдежзиклмнопрстуфхцчшщыэюя",
    "GREEK": "αβγδεζηθικλμνξοπρστυφχψω",
}
#: Country calling codes of two digits. Those that begin with 1 or 7 have
#: one digit, all others three.
CODES = frozenset(
    "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 "
    "81 82 84 86 90 91 92 93 94 95 98".split()
)
#: The country of a number that is written (212) 555-0134 or 212-555-0134.
HOME = "1"
#: Words that stand behind a form of address and are no name.
NO_NAME = frozenset(
    "a an and are as at but by chairman der die das el for from he i in is it la le les los m mr mrs ms of on or "
    "president she speaker that the they this to und et y was we will you".split()
)

_TITLE_OF = {t.casefold(): g for g, all_ in TITLES.items() for t in all_}
_GIVEN_OF = {n.casefold(): g for g, all_ in GIVEN.items() for n in all_}
_NAME = r"[^\W\d_a-zà-öø-ÿа-яα-ω][^\W\d_]+(?:[-'’][^\W\d_]+)*"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_ADDRESS = sorted({f(t) for v in TITLES.values() for t in v for f in (str, str.upper)})
_FIRST = sorted({f(n) for v in GIVEN.values() for n in v for f in (str, str.upper)})
_PERSON = (
    r"(?<!\w)(?:(?P<title>" + "|".join(t if len(t) > 1 else t + r"(?=\.)" for t in _ADDRESS) + r")\.?[ \xa0]+"
    rf"(?P<first>{_NAME})(?:[ \xa0]+(?P<second>{_NAME}))?"
    r"|(?P<given>" + "|".join(_FIRST) + rf")[ \xa0]+(?P<family>{_NAME}))(?!\w)"
)
_PATTERNS = {
    "email": r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}",
    "secret": r"(?<!\w)(?:[0-9a-fA-F]{32,}|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z_-]{20,})(?!\w)",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "ip6": r"(?<![\w:.])(?:[0-9a-fA-F]{1,4}:){2,7}(?:[0-9a-fA-F]{1,4}|(?::[0-9a-fA-F]{1,4}){1,5}|:)(?![\w:]|\.\d)"
    r"|(?<![\w:.])[0-9a-fA-F]{1,4}::(?:[0-9a-fA-F]{1,4}:){1,5}[0-9a-fA-F]{1,4}(?![\w:]|\.\d)",
    "ip": rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\w]|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w-])(?:\d{13,19}|\d{4}(?P<gap>[ -])\d{4}(?P=gap)\d{4}(?P=gap)\d{4})(?![\w-])",
    "phone": r"(?<![\w])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}"
    r"|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)",
}
_ANY = re.compile("|".join([*(f"(?P<{k}>{v})" for k, v in _PATTERNS.items()), _PERSON]))
#: What every mention contains, to pass over other texts quickly.
_HINT = r"\p{Nd}|@|[a-fA-F]{32}|AKIA[A-Z]{16}|gh[pousr]_[A-Za-z]{36}|sk-[A-Za-z_-]{20}|" + "|".join(
    [*(t if len(t) > 1 else t + r"\." for t in _ADDRESS), *_FIRST]
)

#: A mention: start, end, type (names: given or family with gender), canonical form.
Mention = tuple[int, int, str, str]


def _gender(name: str, title: str | None) -> str:
    known = _TITLE_OF.get((title or "").casefold(), "u")
    return known if known != "u" else _GIVEN_OF.get(name.casefold(), "u")


def _ascii_digits(text: str) -> str:
    """Digits of any script as 0 to 9."""
    return text if text.isascii() else "".join(str(unicodedata.decimal(c)) if c.isdecimal() else c for c in text)


def _in_script(digit: str, like: str) -> str:
    """A digit in the script of another one; anything else stays."""
    if not (digit.isdecimal() and like.isdecimal()):
        return digit
    return chr(ord(like) - unicodedata.decimal(like) + unicodedata.decimal(digit))


def _mod97(iban: str) -> int:
    """1 for a valid IBAN."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _phone(mention: str) -> str:
    """Country code and national number, the same for every way to write them."""
    digits = re.sub(r"\D", "", mention.replace("(0)", "") if mention.startswith("+") else mention)
    if not mention.startswith("+"):
        return f"{HOME}.{digits}"
    code = 1 if digits[0] in "17" else 2 if digits[:2] in CODES else 3
    return f"{digits[:code]}.{digits[code:]}"


def _address(mention: str) -> str | None:
    """The eight groups of an IPv6 address with at least three of them written, one with a digit."""
    groups = [g for g in mention.split(":") if g]
    if len(groups) < 3 or not any(c.isdigit() for c in mention):
        return None
    try:
        return ipaddress.IPv6Address(mention).exploded
    except ValueError:
        return None


def _canonical(kind: str, text: str, start: int, end: int) -> str | None:
    """The form that all mentions of an entity share; None where what looks like one
    is none by its check digits: long numbers written without gaps, and IBANs that are
    not called so."""
    mention = text[start:end]
    if kind == "email":
        return mention.lower()
    if kind == "secret":
        return mention
    if kind == "ip6":
        return _address(mention)
    plain = _ascii_digits(mention)
    if kind == "ip":
        return plain
    if kind == "phone":
        return _phone(plain)
    canon = re.sub(r"[^0-9A-Za-z]", "", plain).upper()
    if kind == "card" and plain.isdigit() and _luhn(canon):
        return None
    if kind == "iban" and _mod97(canon) != 1 and "IBAN" not in text[max(0, start - 8) : start].upper():
        return None
    return canon


def _found(text: str) -> Iterator[tuple[re.Match, str | None, str]]:
    """Matches with the type and canonical form, None and empty for a person."""
    at = 0
    while m := _ANY.search(text, at):
        kind = next((k for k in _PATTERNS if m[k]), None)
        canon = "" if kind is None else _canonical(kind, text, *m.span())
        if canon is None or kind is None and m["title"] and m["first"].casefold() in NO_NAME:
            at = m.start() + 1
            continue
        yield m, kind, canon
        at = m.end()


def mentions(text: str) -> Iterator[Mention]:
    """Entities of a text, from left to right; a name's parts come one by one."""
    for m, kind, canon in _found(text):
        if kind is None:
            title, first, second = m["title"], m["first"] or m["given"], m["second"] or m["family"]
            if title and (not second or second.casefold() in NO_NAME):
                yield *m.span("first"), "family", first.casefold()
                continue
            at = "first" if m["first"] else "given"
            yield *m.span(at), "given-" + _gender(first, title), first.casefold()
            yield *m.span("second" if m["second"] else "family"), "family", second.casefold()
        else:
            yield *m.span(), kind, canon


class _Stream:
    """Numbers that a key draws for an entity."""

    def __init__(self, key: bytes, *of: str):
        self.key, self.of, self.rest = key, "\x1f".join(of).encode(), b""
        self.n = 0

    def below(self, n: int) -> int:
        if len(self.rest) < 8:
            self.rest += hmac.new(self.key, self.of + self.n.to_bytes(4, "big"), hashlib.sha256).digest()
            self.n += 1
        value, self.rest = int.from_bytes(self.rest[:8], "big"), self.rest[8:]
        return value % n


def _luhn(digits: str) -> int:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10


def _script(c: str) -> str:
    return unicodedata.name(c, "LATIN").split()[0]


@lru_cache(4096)
def _letters(letter: str) -> str:
    """Letters of the script of a letter in lower case: its alphabet, or the letters of
    its kind near it in the code table, more for scripts with thousands."""
    script = _script(letter)
    if script in ALPHABETS:
        return ALPHABETS[script]
    size = 4096 if script in ("CJK", "HANGUL") else 64
    start = ord(letter) // size * size
    kind = unicodedata.category(letter)
    return "".join(
        c for c in map(chr, range(start, start + size))
        if unicodedata.category(c) == kind and _script(c) == script and len(c.upper()) == 1
    ) or letter


def _alike(c: str, draw: _Stream) -> str:
    """A character of the same class, script and case."""
    if c.isdecimal():
        return _in_script(str(draw.below(10)), c)
    if c.isalpha():
        of = _letters(c.lower() if len(c.lower()) == 1 else c)
        letter = of[draw.below(len(of))]
        return letter.upper() if c.isupper() else letter
    return c


def _name(kind: str, canon: str, attempt: int, draw: _Stream) -> str:
    script = _script(canon[0])
    if script not in SYLLABLES:  # no made-up syllables: letter by letter
        return "".join(_alike(c, draw) for c in canon + canon[0] * (attempt // 2))
    parts = [SYLLABLES[script][draw.below(65)] for _ in range(2 + (kind == "family") + attempt // 2)]
    gender = kind[-1] if kind.startswith("given") else "u"
    return "".join(parts) + ENDINGS[script][gender]


def surrogate(key: bytes, kind: str, canon: str, attempt: int) -> str:
    """Replacement of a canonical form; further attempts draw anew and, from the
    fifth on, have more room by a longer form."""
    draw = _Stream(key, kind, canon, str(attempt))
    more = attempt // 5
    if kind == "family" or kind.startswith("given"):
        return _name(kind, canon, attempt, draw)
    if kind == "email":
        local, _, domain = canon.partition("@")
        host, _, top = domain.rpartition(".")
        of_host = _Stream(key, "host", host)  # one domain stays one domain
        new = "".join(_alike(c, draw) for c in local) + "".join(_alike("a", draw) for _ in range(more))
        return f"{new}@{''.join(_alike(c, of_host) for c in host)}.{top}"
    if kind == "ip":
        ranges = {1: (1, 9), 2: (10, 90), 3: (100, 156)} if not more else dict.fromkeys((1, 2, 3), (1, 255))
        return ".".join(str(lo + draw.below(n)) for lo, n in (ranges[len(o)] for o in canon.split(".")))
    if kind == "ip6":  # groups of zeros stay, so that a short form stays one
        zero = "0000" if not more else ""
        return ":".join(g if g == zero else f"{1 + draw.below(0xFFFF):04x}" for g in canon.split(":"))
    if kind == "phone":
        code, _, number = canon.partition(".")
        return f"{code}." + "".join(_alike(c, draw) for c in number + "0" * more)
    if kind == "iban":
        body = "".join(_alike(c, draw) for c in canon[4:] + "0" * more)
        check = 98 - _mod97(f"{canon[:2]}00{body}") if _mod97(canon) == 1 else draw.below(100)
        return f"{canon[:2]}{check:02d}{body}"
    if kind == "secret":
        if re.fullmatch("[0-9a-fA-F]+", canon):
            digits = "0123456789abcdef" if canon.lower() == canon else "0123456789ABCDEF"
            return "".join(digits[draw.below(16)] for _ in range(len(canon) + more))
        head = re.match(r"AKIA|gh._|sk-|", canon)[0]
        return head + "".join(_alike(c, draw) for c in canon[len(head) :]) + "".join(_alike("a", draw) for _ in range(more))
    keep = int(kind == "card")
    new = canon[:keep] + "".join(_alike(c, draw) for c in canon[keep:] + "0" * more)
    if kind == "card" and _luhn(canon) == 0:
        body = new[:-1]
        new = next(body + d for d in "0123456789" if _luhn(body + d) == 0)
    return new


def rendered(kind: str, mention: str, new: str) -> str:
    """The replacement in the form of a mention: its separators, its case and its
    script's digits."""
    if kind == "family" or kind.startswith("given"):
        return new.upper() if mention.isupper() else new[:1].upper() + new[1:]
    if kind == "phone":
        code, _, number = new.partition(".")
        plus = mention.startswith("+")
        # The country code and a trunk (0) are as they were, so what is written is
        # distinct where the surrogates are.
        left, rest = len(code) if plus else 0, iter(number)
        trunk = _ascii_digits(mention).find("(0)") + 1 if plus else 0
        parts = []
        for i, c in enumerate(mention):
            if not c.isdecimal() or trunk and i == trunk:
                parts.append(c)
            elif left:
                parts.append(c)
                left -= 1
            else:
                parts.append(_in_script(next(rest), c))
        like = next(c for c in reversed(mention) if c.isdecimal())
        return "".join(parts) + "".join(_in_script(d, like) for d in rest)
    if kind in ("card", "ssn", "iban"):
        rest = iter(new)
        text = "".join(_in_script(next(rest, ""), c) if c.isalnum() else c for c in mention)
        return text + "".join(rest)
    if kind == "ip6":
        short = new if len(mention) == 39 else ":".join(g.lstrip("0") or "0" for g in new.split(":"))
        text = ipaddress.IPv6Address(new).compressed if "::" in mention else short
        return text.upper() if mention.upper() == mention else text
    if kind == "ip" and not mention.isascii():
        like = next(c for c in mention if c.isdecimal() and not c.isascii())
        return "".join(_in_script(c, like) for c in new)
    return new.upper() if kind in ("email",) and mention.isupper() else new


def detected(docs: DataFrame) -> DataFrame:
    """(doc_id, _row, kind, canon, n): the entities of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            rows: dict[tuple[int, str, str], int] = {}
            hint = pc.indices_nonzero(pc.match_substring_regex(texts, _HINT)).to_pylist()
            for i in hint:
                for _, _, kind, canon in mentions(texts[i].as_py()):
                    rows[i, kind, canon] = rows.get((i, kind, canon), 0) + 1
            at = pa.array([i for i, _, _ in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(at),
                    batch.column("_row").take(at),
                    pa.array([k for _, k, _ in rows], pa.string()),
                    pa.array([c for _, _, c in rows], pa.string()),
                    pa.array(list(rows.values()), pa.int64()),
                ],
                names=["doc_id", "_row", "kind", "canon", "n"],
            )

    return docs.select("doc_id", "_row", "text").mapInArrow(
        run, "doc_id long, _row long, kind string, canon string, n long"
    )


def _drawn(entities: DataFrame, key: bytes) -> DataFrame:
    """Adds the surrogate of (kind, canon, attempt)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c) for c in ("kind", "canon", "attempt")]
            new = [surrogate(key, *x) for x in zip(*(c.to_pylist() for c in columns), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(new, pa.string())], names=["kind", "canon", "attempt", "surrogate"]
            )

    return entities.select("kind", "canon", "attempt").mapInArrow(
        run, "kind string, canon string, attempt int, surrogate string"
    )


def _family(kind: str = "kind") -> F.Column:
    """Given names share one space of surrogates whatever their gender."""
    return F.split(kind, "-")[0]


def surrogates(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, canon, surrogate) for distinct entities, without collisions: no two
    entities of a type share a surrogate, and none is a real entity's form.

    Of entities that draw the same one keeps it, the others draw again, until
    none is left; longer forms make room where a format is used up.
    """
    real = entities.select(_family().alias("type"), F.col("canon").alias("surrogate")).distinct()
    now = staged(_drawn(entities.withColumn("attempt", F.lit(0)), key), "surrogates")
    while True:
        typed = now.withColumn("type", _family()).withColumn("low", F.lower("surrogate"))
        first = typed.groupBy("type", "low").agg(F.min(F.struct("kind", "canon")).alias("owner"), F.count("*").alias("k"))
        clash = typed.join(first.filter("k > 1"), ["type", "low"]).filter(F.struct("kind", "canon") != F.col("owner"))
        own = typed.join(
            real.select("type", F.lower("surrogate").alias("low")).distinct(), ["type", "low"], "left_semi"
        )
        names = ["kind", "canon", "attempt"]
        again = staged(clash.select(names).union(own.select(names)).distinct(), "clashes")
        if not again.take(1):
            return now.select("kind", "canon", "surrogate")
        drawn = _drawn(again.withColumn("attempt", F.col("attempt") + 1), key)
        now = staged(now.join(again, ["kind", "canon"], "left_anti").unionByName(drawn), "surrogates")


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """Every row of ``docs`` with its text's entities replaced, n_entities
    (mentions) and n_distinct.

    Types: e-mail and IP addresses (of version 6 with three groups or more),
    phone numbers, card numbers (13 to 19 digits without gaps need a valid last
    digit), social security numbers, IBANs (valid, or behind that word), keys and
    long hex strings, and names behind a form of address or a common given name.
    All mentions of an entity, in any document and format, get the same surrogate,
    a phone number with its country code (``HOME`` where none is written); a
    family name alone refers to the same name as with a given name. Surrogates keep
    the script, and check digits stay valid. Texts without entities
    stay as they are, a null text stays null, columns of these names are
    replaced and others pass through. Rows equal in doc_id and text are alike.
    """
    keyed = ar.nested(docs)
    found = staged(detected(keyed.select("doc_id", "_row", F.col("doc.text").alias("text"))).distinct(), "mentions")
    mapped = surrogates(found.select("kind", "canon").distinct(), key)
    of_doc = (
        found.join(mapped, ["kind", "canon"])
        .groupBy("doc_id", "_row")
        .agg(F.collect_list(F.struct("kind", "canon", "surrogate")).alias("new"), F.sum("n").alias("total"))
        .select(F.col("doc_id").alias("_id"), F.col("_row").alias("_same"), "new", "total")
    )
    names = [c for c in docs.columns if c not in ("n_entities", "n_distinct")]
    extra = "new"
    while extra in docs.columns:
        extra += "_"
    ready = keyed.join(of_doc, ar.same_row(keyed), "left").select(
        *[F.col("doc").getField(c).alias(c) for c in names],
        F.coalesce("total", F.lit(0)).cast("long").alias("n_entities"),
        F.coalesce(F.size("new"), F.lit(0)).cast("long").alias("n_distinct"),
        F.col("new").alias(extra),
    )
    schema = ready.drop(extra).schema
    order = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, new = batch.column("text"), batch.column(extra)
            changed = {}
            for i in pc.indices_nonzero(new.is_valid()).to_pylist():
                of = {(x["kind"], x["canon"]): x["surrogate"] for x in new[i].as_py()}
                text, parts, at = texts[i].as_py(), [], 0
                for start, end, kind, canon in mentions(text):
                    parts += [text[at:start], rendered(kind, text[start:end], of[kind, canon])]
                    at = end
                changed[i] = "".join([*parts, text[at:]])
            if changed:
                values = texts.to_pylist()
                for i, value in changed.items():
                    values[i] = value
                texts = pa.array(values, pa.string())
            columns = [texts if c == "text" else batch.column(c) for c in order]
            yield pa.RecordBatch.from_arrays(columns, names=order)

    return ready.mapInArrow(run, schema)
