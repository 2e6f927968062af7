"""Language of short texts by character trigrams.

A profile holds log probabilities of hashed trigrams for each language that labelled
texts know. It is counted by Spark, has a fixed size a language, and is applied as a
column. Unlike a list of frequent words it says something about every sentence, and
text that is likelier under no language at all stays unknown.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots of a language's trigrams, and the factors that place three code points.
SLOTS = 1 << 14
PLACE = (8191, 127, 1)
#: Characters whose trigrams are looked up at once.
PIECE = 1 << 18


def letters(text: Column | str) -> Column:
    """Lower-case words between single blanks, with one at both ends; empty
    without a letter."""
    words = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "))
    return F.when(words != "", F.concat(F.lit(" "), words, F.lit(" "))).otherwise("")


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The slots of all trigrams, and the text each is of. For a piece of a batch, as
    several numbers are held for each character."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    size = np.array([len(t) for t in texts], np.int64)
    text = np.repeat(np.arange(len(texts)), size)
    whole = text[2:] == text[: max(len(text) - 2, 0)]
    if not whole.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    slot = (points[:-2] * PLACE[0] + points[1:-1] * PLACE[1] + points[2:] * PLACE[2]) % SLOTS
    return slot[whole], text[2:][whole]


def _pieces(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about PIECE characters, and the first one's place. A longer text
    comes in parts that share two characters, so each trigram is in one part."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        if size and size + len(text) > PIECE:
            yield first, held
            first, held, size = i, [], 0
        while len(text) > PIECE:
            yield i, [text[:PIECE]]
            text = text[PIECE - 2 :]
        held.append(text)
        size += len(text)
    if held:
        yield first, held


@dataclass(frozen=True)
class LangProfile:
    """``weights`` has a row of 1000 * log probabilities per language in ``langs``;
    ``unknown`` is that of a trigram where all are equally likely."""

    langs: tuple[str, ...]
    weights: np.ndarray
    unknown: int

    def predict(self, texts: list[str]) -> list[str | None]:
        scores, n = np.zeros((len(self.langs), len(texts))), np.zeros(len(texts), np.int64)
        for first, part in _pieces(texts):
            slot, text = _trigrams(part)
            own = slice(first, first + len(part))
            n[own] += np.bincount(text, minlength=len(part))
            for total, w in zip(scores, self.weights, strict=True):
                total[own] += np.bincount(text, w[slot], len(part))
        best = np.argmax(scores, axis=0) if self.langs else np.zeros(len(texts), int)
        known = (np.max(scores, axis=0) > n * self.unknown) & (n > 0) if self.langs else n < 0
        return [self.langs[b] if k else None for b, k in zip(best, known, strict=True)]

    def column(self, text: Column | str) -> Column:
        """The likeliest language, of equals the first by name; NULL without letters
        or where no language makes the text likelier than chance."""

        @F.pandas_udf("string")
        def likeliest(texts: pd.Series) -> pd.Series:
            return pd.Series(self.predict(texts.fillna("").tolist()), dtype=object)

        return likeliest(letters(F.col(text) if isinstance(text, str) else text))


def fit_profile(labelled: DataFrame, text: str = "text", lang: str = "lang") -> LangProfile:
    """Counts the trigrams of all texts with a label. Tasks send one count per
    language and slot; the driver gets SLOTS numbers a language at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for first, part in _pieces(batch.column("text").to_pylist()):
                slot, of = _trigrams(part)
                names = langs[first : first + len(part)]
                for name in set(names):
                    own = np.bincount(slot[(names == name)[of]], minlength=SLOTS)
                    totals[name] = totals.get(name, 0) + own
        for name, total in totals.items():
            at = np.flatnonzero(total)
            columns = [pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(total[at])]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "slot", "part"])

    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(lang).cast("string").alias("lang"), letters(text).alias("text"))
    parts = rows.mapInArrow(count, "lang string, slot long, part long")
    table = parts.groupBy("lang", "slot").agg(F.sum("part").alias("n")).toPandas()
    langs = tuple(sorted(table["lang"].unique()))
    weights = np.zeros((len(langs), SLOTS))
    for i, name in enumerate(langs):
        own = table[table["lang"] == name]
        total = int(own["n"].sum()) + SLOTS
        weights[i] = math.floor(1000 * math.log(1.0 / total))
        weights[i, own["slot"]] = [math.floor(1000 * math.log((n + 1.0) / total)) for n in own["n"].tolist()]
    return LangProfile(langs, weights, math.floor(1000 * math.log(1.0 / SLOTS)))
