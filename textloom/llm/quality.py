"""Text quality by a sparse rule ensemble.

Paths of boosted trees over text statistics become conjunctive rules, a lasso
logistic model weighs them, and the rules that keep a weight are compiled into
one Spark column expression.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm import arrays as ar
from textloom.session import staged

#: Labelled rows that a model is fitted on, about, drawn by a hash of the id.
SAMPLE = 20_000

STATISTICS = (
    "log_bytes",
    "upper",
    "digit",
    "blank",
    "punctuation",
    "marks",
    "symbols",
    "pipes",
    "beyond_ascii",
    "letter_runs",
    "log_words",
    "word_length",
    "long_words",
    "distinct_words",
    "repeated_pairs",
    "top_word",
    "same_next",
    "line_length",
    "distinct_lines",
    "end_marks",
)

_SETS = {
    "upper": range(65, 91),
    "digit": range(48, 58),
    "blank": (9, 10, 11, 12, 13, 32),
    "punctuation": b".,;:'\"()-",
    "marks": b"!?",
    "symbols": b"#$%&*@^~=+<>[]{}\\/_`",
    "pipes": b"|",
    "beyond_ascii": range(128, 256),
    "letter_runs": range(97, 123),
}
_MEMBER = np.array([[b in members for b in range(256)] for members in map(set, _SETS.values())], float).T
_LINES = ar.byte_table(b"\n")


def _distinct(groups: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each group and the count of its most frequent one."""
    order = np.lexsort((keys, groups))
    g, k = groups[order], keys[order]
    first = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (k[1:] != k[:-1]))[: len(g)])
    most = np.zeros(n)
    np.maximum.at(most, g[first], np.diff(np.append(first, len(g))))
    return np.bincount(g[first], minlength=n), most


def _statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text."""
    n, size = len(offsets) - 1, np.diff(offsets)
    owner = np.repeat(np.arange(n), size)
    histogram = np.bincount(owner * 256 + data, minlength=n * 256).reshape(n, 256)
    share = histogram @ _MEMBER / np.maximum(size, 1)[:, None]
    starts, ends, hashes, bounds = ar.words(data, offsets)
    words = np.diff(bounds)
    at = np.repeat(np.arange(n), words)
    some = np.maximum(words, 1)
    length = ends - starts
    distinct, most = _distinct(at, hashes, n)
    inner = np.flatnonzero(at[1:] == at[:-1]) if len(at) else np.zeros(0, np.int64)
    pairs = np.bincount(at[inner], minlength=n)
    pair_kinds, _ = _distinct(at[inner], ar._rolled(hashes, 2)[inner], n)
    same = np.bincount(at[inner], hashes[inner] == hashes[inner + 1], minlength=n)
    line_at, line_end, line_hash, line_bounds = ar.words(data, offsets, _LINES)
    lines = np.diff(line_bounds)
    of = np.repeat(np.arange(n), lines)
    kinds, _ = _distinct(of, line_hash, n)
    closed = np.isin(data[line_end - 1], np.frombuffer(b".!?", np.uint8)) if len(of) else np.zeros(0)
    return np.column_stack(
        [
            np.log1p(size),
            share,
            np.log1p(words),
            np.bincount(at, length, minlength=n) / some,
            np.bincount(at, length > 12, minlength=n) / some,
            distinct / some,
            1 - pair_kinds / np.maximum(pairs, 1),
            most / some,
            same / some,
            words / np.maximum(lines, 1),
            kinds / np.maximum(lines, 1),
            np.bincount(of, closed, minlength=n) / np.maximum(lines, 1),
        ]
    )


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and STATISTICS of each whole text; a null text is empty, and the
    statistics of an empty one are 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in ar.pieces(ar.texts(batch)):
                table = np.ascontiguousarray(_statistics(data, offsets).T)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[i:j], *map(pa.array, table)], names=["doc_id", *STATISTICS]
                )

    schema = "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


#: A condition: statistic, whether it is at most the bound (else above), bound.
Condition = tuple[str, bool, float]


@dataclass(frozen=True)
class Model:
    """Weighted rules: log odds of label 1 are the intercept and the weights of
    the rules that hold."""

    rules: tuple[tuple[Condition, ...], ...]
    weights: tuple[float, ...]
    intercept: float

    def log_odds(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            total = total + F.when(holds(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return total

    def score(self) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.log_odds()))


def holds(rule: tuple[Condition, ...]) -> Column:
    out = F.lit(True)
    for name, low, bound in rule:
        out = out & (F.col(name) <= bound if low else F.col(name) > bound)
    return out


def tree_rules(text: str) -> list[tuple[Condition, ...]]:
    """The path to every node of a printed tree, as conditions."""
    path: list[tuple[int, Condition]] = []
    rules = []
    for line in text.splitlines():
        found = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if found:
            depth = len(found[1])
            path = [p for p in path if p[0] < depth]
            path.append((depth, (STATISTICS[int(found[2])], found[3] == "<=", float(found[4]))))
            rules.append(tuple(c for _, c in path))
    return rules


def fit(
    labelled: DataFrame, trees: int = 12, depth: int = 3, lasso: float = 0.002, sample: int = SAMPLE
) -> Model:
    """Fits a model on rows of doc_id, STATISTICS and label (0 or 1).

    About ``sample`` rows, drawn by a hash of doc_id, form a bounded training
    table; rows with another label teach nothing. Without rows, or with one
    label only, the model is the smoothed share of label 1.
    """
    known = labelled.filter(F.col("label").isin(0, 1)).select(
        "doc_id", *STATISTICS, F.col("label").cast("double").alias("label")
    )
    n = known.count()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    bound = (1 << 30) if n <= sample else int((1 << 30) * sample / n)
    vector = VectorAssembler(inputCols=list(STATISTICS), outputCol="features")
    train = staged(vector.transform(known.filter(draw < bound).coalesce(2)).select("features", "label"), "labelled")
    seen = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    if len(seen) < 2:
        ones, every = seen.get(1.0, 0), sum(seen.values())
        return Model((), (), float(np.log((ones + 0.5) / (every - ones + 0.5))))
    boosted = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7).fit(train)
    rules = list(dict.fromkeys(r for tree in boosted.trees for r in tree_rules(tree.toDebugString)))
    flat = train.select("label", F.col("features"))
    names = [f"r{i}" for i in range(len(rules))]
    from pyspark.ml.functions import vector_to_array

    values = flat.withColumn("x", vector_to_array("features")).select(
        "label", *[F.get("x", F.lit(i)).alias(s) for i, s in enumerate(STATISTICS)]
    )
    held = values.select("label", *[holds(r).cast("double").alias(x) for r, x in zip(rules, names, strict=True)])
    table = staged(VectorAssembler(inputCols=names, outputCol="features").transform(held).select("label", "features"), "rules")
    weighed = LogisticRegression(elasticNetParam=1.0, regParam=lasso, standardization=False, maxIter=60).fit(table)
    used = [(r, float(w)) for r, w in zip(rules, weighed.coefficients.toArray(), strict=True) if w != 0]
    return Model(tuple(r for r, _ in used), tuple(w for _, w in used), float(weighed.intercept))


def score(docs: DataFrame, labels: DataFrame, train: Column, threshold: float = 0.3) -> DataFrame:
    """Scores every row of ``docs`` (doc_id, text) as ``labels`` (doc_id,
    quality) mark quality, learning only from rows where ``train`` (over doc_id)
    holds.

    Returns doc_id, held_out, score (0 to 1) and predicted (1 from the
    threshold on). The score is a function of the whole text alone, also for an
    empty or null one. Several labels of a document all count; a null label,
    doc_id or other column teaches nothing.
    """
    table = staged(with_statistics(docs), "statistics")
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label"))
    model = fit(table.join(marked, "doc_id").filter(train))
    return table.select(
        "doc_id", (~train).alias("held_out"), model.score().alias("score")
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
