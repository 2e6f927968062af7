"""HTML and wiki markup to plain text."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import split_paragraphs

# Elements dropped with their content, and elements that end a line.
HTML_DROP = ("script", "style", "head", "nav")
HTML_BLOCK = (
    "p", "div", "br", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "tr", "table",
    "article", "section", "header", "footer", "blockquote", "pre", "hr",
)
ENTITIES = (
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"),
)


def html_rules() -> list[tuple[str, str]]:
    """Pattern and replacement, in order; no lookaround or backreference."""
    rules = [(r"(?s)<!--.*?-->", "")]
    rules += [(rf"(?is)<{t}\b[^>]*>.*?</{t}\s*>", "") for t in HTML_DROP]
    rules.append((rf"(?i)</?(?:{'|'.join(HTML_BLOCK)})\b[^>]*>", "\n"))
    rules.append((r"<[^>]+>", ""))
    return rules


def html_text(html: Column) -> Column:
    out = html
    for pattern, repl in html_rules():
        out = F.regexp_replace(out, pattern, repl)
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def html_paragraphs(html: Column) -> Column:
    """Trimmed non-empty lines of the visible text."""
    lines = F.transform(split_paragraphs(html_text(html)), lambda p: F.trim(p))
    return F.filter(lines, lambda p: p != "")


def first_arg(name: str, args: list[str]) -> str:
    """A template's first argument value, else its name."""
    return args[0].split("=", 1)[-1] if args else name


# Link targets that are not text.
HIDDEN_TARGETS = ("file:", "image:", "category:")

_MARK = re.compile(
    r"<!--|<ref(?=[\s/>])[^<>]*>|</ref\s*>|\[\[|\[(?:https?:|ftp:)?//[^\s\[\]{}|<>]*|\]+"
    r"|^[ \t:]*\{\||\{\{+|\}\}+|\|",
    re.IGNORECASE | re.MULTILINE,
)
#: What a text without any of these has no use for the automaton.
_ANY = re.compile(r"\[|\{|<!--|<ref", re.IGNORECASE)

#: Text as nested lists of strings, so that what a bracket holds is never copied.
Rope = list


class _Open:
    """An open bracket: its kind, its text ``n`` times, and its content by parts."""

    __slots__ = ("kind", "mark", "n", "parts")

    def __init__(self, kind: str, mark: str, n: int = 1):
        self.kind, self.mark, self.n, self.parts = kind, mark, n, [[]]

    def literal(self) -> Rope:
        out: Rope = [self.mark * self.n]
        for i, part in enumerate(self.parts):
            if i:
                out.append("|")
            out.append(part)
        return out


def _flat(rope: Rope) -> str:
    out: list[str] = []
    todo = [iter(rope)]
    while todo:
        for piece in todo[-1]:
            if isinstance(piece, str):
                out.append(piece)
            else:
                todo.append(iter(piece))
                break
        else:
            todo.pop()
    return "".join(out)


def _joined(parts: list[Rope]) -> Rope:
    out: Rope = []
    for i, part in enumerate(parts):
        if i:
            out.append("|")
        out.append(part)
    return out


def _value(arg: Rope) -> Rope:
    """What follows the first equals sign of the argument's own text, if any."""
    for i, piece in enumerate(arg):
        if isinstance(piece, str) and "=" in piece:
            return [piece.split("=", 1)[1], *arg[i + 1 :]]
    return arg


class _Automaton:
    """One pass over a text with a stack of open brackets.

    A closing bracket ends the nearest open one of its kind; brackets opened in
    between and never closed are text. A single one ends an outer link only where
    nothing else is open within it. Every piece of text is moved once, whatever
    the depth, unless ``template`` is the caller's own function, which is given
    strings.
    """

    def __init__(self, template: Callable[[str, list[str]], str] | None):
        self.template = template
        self.stack = [_Open("", "")]
        self.count = dict.fromkeys("LTXBR", 0)

    def add(self, piece: str | Rope) -> None:
        if piece:
            self.stack[-1].parts[-1].append(piece)

    def push(self, kind: str, mark: str, n: int = 1) -> None:
        self.stack.append(_Open(kind, mark, n))
        self.count[kind] += 1

    def pop(self, kind: str) -> _Open:
        """The nearest open bracket of the kind, with all above it as its text."""
        i = len(self.stack) - 1
        while self.stack[i].kind != kind:
            i -= 1
        found = self.stack[i]
        for other in self.stack[i + 1 :]:
            found.parts[-1].append(other.literal())
            self.count[other.kind] -= 1
        del self.stack[i:]
        self.count[kind] -= 1
        return found

    def close_link(self) -> None:
        target, *rest = self.pop("L").parts
        head = target[0] if target and isinstance(target[0], str) else ""
        if not head.lstrip().lower().startswith(HIDDEN_TARGETS):
            self.add(_joined(rest) if rest else target)

    def close_outer_link(self) -> None:
        (shown,) = self.pop("X").parts
        if shown and isinstance(shown[0], str):
            shown[0] = shown[0].lstrip()
        self.add(shown)

    def close_braces(self, n: int) -> int:
        """Closes one template or parameter with up to ``n`` braces; the rest."""
        found = self.pop("T")
        size = 3 if min(n, found.n) >= 3 else 2
        if size == 3:
            value: str | Rope = found.parts[1] if len(found.parts) > 1 else ""
        elif self.template is None:
            value = ""
        elif self.template is first_arg:
            value = _value(found.parts[1]) if len(found.parts) > 1 else found.parts[0]
        else:
            name, *args = map(_flat, found.parts)
            value = self.template(name, args)
        left = found.n - size
        if left >= 2:
            self.push("T", "{", left)
        else:
            self.add("{" * left)
        self.add(value)
        return n - size

    def run(self, text: str) -> str:
        at, comments = 0, True
        for m in _MARK.finditer(text):
            start, mark = m.start(), m.group()
            if start < at:  # inside a comment
                continue
            self.add(text[at:start])
            at = m.end()
            top = self.stack[-1].kind
            if mark == "<!--":
                end = text.find("-->", at) if comments else -1
                comments = end >= 0
                if comments:
                    at = end + 3
                else:
                    self.add(mark)
            elif mark == "|":
                if top == "B" and text.startswith("}", at):
                    at += 1
                    self.add([self.pop("B").literal(), "|}"])
                elif top in ("L", "T"):
                    self.stack[-1].parts.append([])
                else:
                    self.add(mark)
            elif mark[0] == "]":
                n = len(mark)
                while n:
                    if self.stack[-1].kind == "X":
                        self.close_outer_link()
                        n -= 1
                    elif self.count["L"] and n >= 2:
                        self.close_link()
                        n -= 2
                    else:
                        self.add("]" * n)
                        n = 0
            elif mark[0] == "}":
                n = len(mark)
                while n >= 2 and self.count["T"]:
                    n = self.close_braces(n)
                self.add("}" * n)
            elif mark == "[[":
                self.push("L", mark)
            elif mark[0] == "[":
                self.push("X", mark)
            elif mark.startswith("{{"):
                self.push("T", "{", len(mark))
            elif mark.endswith("{|"):
                self.push("B", mark)
            elif mark[1] == "/":
                if self.count["R"]:
                    self.pop("R")
                else:
                    self.add(mark)
            elif not mark.endswith("/>"):
                self.push("R", mark)
        self.add(text[at:])
        return _flat([other.literal() for other in self.stack])


def resolve(text: str, template: Callable[[str, list[str]], str] | None = first_arg) -> str:
    """Comments and references removed; links, templates, parameters and outer links
    replaced by what they show, at any depth. Tables keep their marks."""
    return _Automaton(template).run(text) if _ANY.search(text) else text


def _resolve_udf(template: Callable[[str, list[str]], str] | None):
    @F.pandas_udf("string")
    def resolved(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else resolve(t, template))

    return resolved


def strip_markup(
    col: Column | str, template: Callable[[str, list[str]], str] | None = first_arg
) -> Column:
    """Wiki markup removed, templates replaced by ``template(name, args)``, or
    dropped without one.

    What nests is resolved by one pass with a stack, in an Arrow function; lines,
    tags and emphasis are expressions.
    """
    out = _resolve_udf(template)(F.col(col) if isinstance(col, str) else col)
    out = F.regexp_replace(out, r"(?m)^[ \t:]*\{\|.*$|^\|\}.*$|^\|-.*$", "")
    out = F.regexp_replace(out, r"(?m)^[|!]\+?(?:[^|\n\[]*\|(?!\|))?", "")
    out = F.regexp_replace(out, r"</?[a-zA-Z][^<>]*>", "")
    out = F.regexp_replace(out, r"'{2,5}", "")
    out = F.regexp_replace(out, r"(?m)^=+\s*(.*?)\s*=+\s*$", "$1")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out
