"""Nearest neighbours by inner product, with randomly rotated one-bit codes.

A vector's offset from the centre is turned by a random rotation and kept as its
signs, packed, with two scalars: its length and how well the signs point along it.
The inner product of a query with these signs estimates the true one, with an error
bound that shrinks with the root of the dimension. A query takes the vectors with
the best estimates first; the k-th score then found is the mark that the upper bound
of every other vector must reach to be looked at too, on the original vectors. Scores
of these are matrix products at first; those that reach the mark are added anew in
order of components.

Equal vectors are one candidate with their smallest ids, so that a vector with a
third of all rows is scanned once. Vectors and queries meet in a grid of blocks of
bounded size, each a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.llm import vectors as vx
from textloom.session import staged

#: Entries of the table of estimates that a task holds at once.
_CELLS = 1 << 21
#: Times k: vectors reranked first, whose k-th score is the mark for all others.
_HEAD = 8
#: Pairs whose original vectors are multiplied at once.
_PAIRS = 1 << 15


@dataclass(frozen=True)
class Codes:
    """``epsilon`` is the error bound in standard deviations of an estimate. Blocks
    have at most about ``block`` bytes of vectors."""

    epsilon: float = 4.0
    seed: int = 11
    block: int = 1 << 25
    least_rows: int = 1024
    least_blocks: int = 12

    def blocks(self, n: int, width: int) -> int:
        whole = -(-n * width * 8 // self.block)
        return max(1, whole, min(self.least_blocks, n // self.least_rows))


@lru_cache(maxsize=2)
def rotation(width: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, width)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, centre: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, lengths, and the cosine between signs and rotated offset."""
    width = vectors.shape[1]
    turned = (vectors - centre) @ rotation(width, seed).T
    length = np.sqrt(np.square(turned).sum(1))
    with np.errstate(invalid="ignore", divide="ignore"):
        along = np.abs(turned).sum(1) / (length * np.sqrt(width))
    return np.packbits(turned >= 0, axis=1), length, np.where(length > 0, along, 1.0)


def estimate(
    codes: np.ndarray, length: np.ndarray, along: np.ndarray, queries: np.ndarray, centre: np.ndarray, c: Codes
) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products, queries by vectors, and their error bounds."""
    width = queries.shape[1]
    size = np.sqrt(np.square(queries).sum(1))
    turned = (queries @ rotation(width, c.seed).T / size[:, None]).astype(np.float32)
    signs = np.unpackbits(codes, axis=1, count=width).astype(np.float32) * 2 - 1
    scale = (length / (along * np.sqrt(width))).astype(np.float32)
    spread = c.epsilon * length * np.sqrt(np.maximum(1 / along**2 - 1, 0) / max(width - 1, 1))
    about = (turned @ signs.T) * scale + (queries @ centre / size).astype(np.float32)[:, None]
    slack = 1e-5 * (length + np.linalg.norm(centre))  # single precision
    return about, (spread + slack).astype(np.float32)


def products(vectors: np.ndarray, queries: np.ndarray, v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of pairs in double precision, added in order of components."""
    out = np.empty(len(v))
    for i in range(0, len(v), _PAIRS):
        a, b = vectors[v[i : i + _PAIRS]].T, queries[q[i : i + _PAIRS]].T
        total = np.zeros(a.shape[1])
        for x, y in zip(a, b, strict=True):
            total += x * y
        out[i : i + _PAIRS] = total
    return out


def _best(q: np.ndarray, v: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int):
    """Per query its k best pairs, ties to the smaller id."""
    order = np.lexsort((ids[v], -score, q))
    q, v, score = q[order], v[order], score[order]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
    place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    keep = place < k
    return q[keep], v[keep], score[keep]


def nearest(vectors, codes, length, along, ids, queries, centre, k: int, c: Codes):
    """The k best vectors of each query in one block: query, vector, score."""
    n, found = len(vectors), []
    step, head = max(1, _CELLS // max(n, 1)), min(n, k * _HEAD)
    # How far a matrix product can lie from the sum in order of components.
    error = 4 * np.finfo(float).eps * vectors.shape[1] * np.sqrt(np.square(vectors).sum(1)).max(initial=0)
    for i in range(0, len(queries), step):
        part = queries[i : i + step]
        about, spread = estimate(codes, length, along, part, centre, c)
        if head == n:
            reach = np.ones(about.shape, bool)
        else:
            size = np.sqrt(np.square(part).sum(1))
            first = np.argpartition(-about, head - 1, axis=1)[:, :head]
            close = part @ vectors.T
            best = -np.partition(-np.take_along_axis(close, first, 1), k - 1, axis=1)[:, k - 1]
            mark = best - 1e-12 * np.abs(best) - 2 * error * size
            reach = about + spread >= (mark / size).astype(np.float32)[:, None]
            np.put_along_axis(reach, first, True, 1)
            reach &= close >= mark[:, None]
        rows, first = np.nonzero(reach)
        score = products(vectors, part, first, rows)
        q, v, s = _best(rows, first, score, ids, k)
        found.append((q + i, v, s))
    if not found:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _candidates(valid: DataFrame, k: int) -> DataFrame:
    """Each distinct vector with the k + 1 smallest of its ids: no query can need a
    further one, whichever of them is its own."""
    by_id = W.partitionBy("vector").orderBy("id")
    first = valid.withColumn("_n", F.dense_rank().over(by_id)).filter(F.col("_n") <= k + 1)
    return first.groupBy("vector").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def _coded(items: DataFrame, width: int, centre: np.ndarray, c: Codes) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, length, along = encode(vx.matrix(batch.column("vector"), width).astype(float), centre, c.seed)
            packed = pa.array([row.tobytes() for row in codes], pa.binary())
            columns = [batch.column("vector"), batch.column("ids"), packed, pa.array(length), pa.array(along)]
            yield pa.RecordBatch.from_arrays(columns, ["vector", "ids", "code", "length", "along"])

    kind = items.schema["vector"].dataType.simpleString()
    return items.mapInArrow(run, f"vector {kind}, ids array<long>, code binary, length double, along double")


def search(
    table: DataFrame,
    is_query: Column,
    k: int = 20,
    key: str = "vec_id",
    column: str = "embedding",
    codes: Codes = Codes(),  # noqa: B008  (frozen)
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` nearest, nearest first, ties
    to the smaller id. ``is_query`` is a condition on the table's columns.

    Rows without an id, and vectors that are null, zero, hold a null or non-finite
    component, or have another length than most, take no part. Rows that repeat both
    id and vector count once. A query never finds a row of its own id; an id with
    several vectors asks with all of them under one ``query_id``, and each own row
    among the nearest is left out, not replaced. Fewer candidates than ``k`` give
    fewer rows, an empty table none.
    """
    valid = table.select(
        F.col(key).cast("long").alias("id"), F.col(column).alias("vector"), is_query.alias("query")
    ).filter(
        F.col("id").isNotNull() & vx.finite(F.col("vector")) & F.exists("vector", lambda x: x != 0)
    )
    width = vx.common_length(valid, "vector")
    valid = valid.filter(F.size("vector") == width)
    items = staged(_candidates(valid, k), "vectors")
    asked = valid.filter("query").select("id", "vector")
    named = asked.groupBy("vector").agg(F.min("id").alias("q1")).withColumn("q2", F.xxhash64("vector"))
    named = staged(named, "queries")

    size = max(width, 1)
    sums = vx.totals(
        items.select("vector"),
        lambda b: np.concatenate([[b.num_rows], vx.matrix(b.column("vector"), size).astype(float).sum(0)]),
        size + 1,
    )
    n, centre = int(sums[0]), sums[1:] / max(sums[0], 1)
    n_rows, n_asked = codes.blocks(n, size), max(1, -(-named.count() * size * 8 // codes.block))
    # Blocks of vectors, each once for every block of queries, and the reverse.
    left = (
        _coded(items, size, centre, codes)
        .withColumn("row_block", F.pmod(F.xxhash64("vector"), F.lit(n_rows)).cast("int"))
        .withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1))))
    )
    right = named.withColumn(
        "query_block", F.pmod(F.xxhash64("q2", "q1"), F.lit(n_asked)).cast("int")
    ).withColumn("row_block", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))))
    most = k + 1

    def cell(rows: pa.Table, asked: pa.Table) -> pa.Table:
        found = pa.table(
            {"q1": pa.array([], pa.int64()), "q2": pa.array([], pa.int64()), "score": pa.array([], pa.float64()),
             "ids": pa.array([], pa.list_(pa.int64()))}
        )
        if not rows.num_rows or not asked.num_rows:
            return found
        packed = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
        ids = rows.column("ids").combine_chunks()
        smallest = ids.flatten().to_numpy()[np.cumsum(np.r_[0, ids.value_lengths().to_numpy()[:-1]])]
        q, v, score = nearest(
            vx.matrix(rows.column("vector"), size).astype(float), packed, rows.column("length").to_numpy(),
            rows.column("along").to_numpy(), smallest, vx.matrix(asked.column("vector"), size).astype(float),
            centre, most, codes,
        )
        return pa.table(
            {"q1": asked.column("q1").take(pa.array(q)), "q2": asked.column("q2").take(pa.array(q)),
             "score": pa.array(score), "ids": ids.take(pa.array(v))}
        )

    grid = ["row_block", "query_block"]
    found = (
        left.groupBy(*grid)
        .cogroup(right.groupBy(*grid))
        .applyInArrow(cell, "q1 long, q2 long, score double, ids array<long>")
    )
    order = W.partitionBy("q1", "q2").orderBy(F.desc("score"), F.col("ids")[0])
    best = found.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most)
    hit = F.transform("ids", lambda i: F.struct((-F.col("score")).alias("far"), i.alias("vec")))
    lists = best.groupBy("q1", "q2").agg(
        F.slice(F.array_sort(F.flatten(F.collect_list(hit))), 1, most).alias("hits")
    )
    answered = named.join(lists, ["q1", "q2"]).select("vector", "hits")
    own = F.slice(F.filter("hits", lambda h: h.vec != F.col("id")), 1, k)
    per_id = asked.distinct().join(answered, "vector").select("id", own.alias("hits"))
    per_id = per_id.groupBy("id").agg(
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))), 1, k).alias("hits")
    )
    return per_id.select(F.col("id").alias("query_id"), F.posexplode("hits").alias("at", "hit")).select(
        "query_id",
        (F.col("at") + 1).alias("rank"),
        F.col("hit.vec").alias("vec_id"),
        (-F.col("hit.far")).alias("score"),
    )


def oracle_sql(every: int = 20, k: int = 20) -> str:
    """Brute force; for vectors of one length."""
    return f"""
WITH v AS (
  SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([c for c in embedding if c IS NULL OR NOT isfinite(c)]) = 0
    AND len([c for c in embedding if c <> 0]) > 0
), p AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e) AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % {every} = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {k}
"""
