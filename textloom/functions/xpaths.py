"""XML values by path, read while many rows are parsed at once.

Spark's ``xpath`` builds a document and its tables for each row and path. A path of
child steps that ends in ``text()`` or an attribute is read from one parse of many
rows instead. A row that is anything but plain elements, attributes and text is left
to ``xpath``, and so are all other paths, so values and failures are those of ``xpath``.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that both parsers take alike.
_NAME = r"[A-Za-z_][A-Za-z0-9_.-]{0,99}"
_PLAIN = re.compile(_NAME)
_PATH = re.compile(rf"/?({_NAME}(?:/{_NAME})*)/(text\(\)|@{_NAME})")
#: Comments, declarations, sections, instructions and namespaces are left to ``xpath``.
_OTHER = (b"<!", b"<?", b"xmlns", b"xml:", b"<_row")
#: Attributes of an element, and open elements, at most: above, the limits are those of ``xpath``.
ATTRIBUTES, DEPTH = 64, 100
#: Bytes of rows that are parsed at once.
PIECE = 1 << 18

Element = ElementTree.Element


def _parsed(rows: list[bytes]) -> list[Element] | None:
    """The root of each row; None unless every row is one plain document. An element
    of its own behind each row shows that the row is closed there."""
    try:
        tree = ElementTree.fromstring(b"<_rows>" + b"<_row/>".join([*rows, b"</_rows>"]))
    except ElementTree.ParseError:
        return None
    roots, marks = tree[::2], tree[1::2]
    if not len(roots) == len(marks) == len(rows) or any(m.tag != "_row" for m in marks):
        return None
    if any(e.tail and not e.tail.isspace() for e in tree):
        return None
    names, level = set(), roots
    for _ in range(DEPTH):
        names.update([e.tag for e in level])
        keys = [k for e in level if (k := e.keys())]
        if any(len(k) > ATTRIBUTES for k in keys):
            return None
        names.update(*keys)
        level = [c for e in level for c in e]
        if not level:
            return roots if all(map(_PLAIN.fullmatch, names)) else None
    return None


def _pieces(rows: list[bytes | None]) -> Iterator[list[int]]:
    """Places of plain rows, of about PIECE bytes together."""
    held, size = [], 0
    for i, row in enumerate(rows):
        if row is None or not row.startswith(b"<") or any([x in row for x in _OTHER]):
            continue
        held.append(i)
        size += len(row)
        if size >= PIECE:
            yield held
            held, size = [], 0
    if held:
        yield held


def _simple(path: str) -> tuple[list[str], str] | None:
    """The steps of a path and what it ends in; None if it is left to ``xpath``."""
    found = _PATH.fullmatch(path)
    return (found[1].split("/"), found[2]) if found else None


def _values(root: Element, path: tuple[list[str], str]) -> list[str]:
    (first, *steps), last = path
    found = [root] if root.tag == first else []
    for step in steps:
        found = [c for e in found for c in e if c.tag == step]
    if last != "text()":
        return [v for e in found if (v := e.get(last[1:])) is not None]
    out = []
    for e in found:
        if e.text:
            out.append(e.text)
        if len(e):
            out += [c.tail for c in e if c.tail]
    return out


def read(rows: list[bytes | None], paths: Sequence[str]) -> list[list[list[str]] | None]:
    """Each row's values of the simple paths; None for a row that is left to ``xpath``."""
    steps = [_simple(p) for p in paths]
    out: list[list[list[str]] | None] = [None] * len(rows)
    collects = gc.isenabled()
    gc.disable()  # the elements have no cycles, and are many
    try:
        for held in _pieces(rows):
            roots = _parsed([rows[i] for i in held])
            if roots is None:  # the rows that are at fault are found one by one
                alone = [_parsed([rows[i]]) for i in held]
                held, roots = [i for i, r in zip(held, alone, strict=True) if r], [r[0] for r in alone if r]
            for i, root in zip(held, roots, strict=True):
                out[i] = [_values(root, s) for s in steps]
    finally:
        if collects:
            gc.enable()
    return out


def xpath_lists(col: Column, paths: Sequence[str]) -> Column:
    """An array of what ``xpath`` gives for each path, from one parse."""
    whole = F.array(*[F.xpath(col, F.lit(p)) for p in paths])
    if not all(map(_simple, paths)):
        return whole

    @F.arrow_udf("array<array<string>>")
    def followed(rows: pa.Array) -> pa.Array:
        # As bytes: strings that are no UTF-8 are left to xpath too.
        return pa.array(read(rows.cast(pa.binary()).to_pylist(), paths), pa.list_(pa.list_(pa.string())))

    return F.coalesce(followed(col), whole)
