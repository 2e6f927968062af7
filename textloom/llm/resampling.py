"""Importance resampling of documents towards a target's distribution of word runs.

Runs of one to three words fall into hashed buckets. Bucket counts of the corpus and
of the target give every bucket a gain; a document's weight is the sum of the gains
of its runs, looked up in an array. Seeded Gumbel noise turns the highest scores into
a weighted draw without replacement. The k-th highest key is found by distributed
quickselect: random keys out of the open interval are pivots, exact counts before, at
and behind each pivot narrow the interval, and only the winners are sorted.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.llm import arrays as ar
from textloom.llm import vectors as vx
from textloom.session import staged

BUCKETS = 10_000
#: Words are runs of ASCII letters and digits and of bytes from 128 on.
_TABLE = ar.byte_table(bytes(b for b in range(128) if not chr(b).isalnum()))
#: A checksum moves over so many bytes by one lookup, over more by powers of two.
_SHIFT = 64
#: Words beyond this many bytes are summed one by one.
_LONG = 256
#: Random pivots of one round, and slices in which winners are ranked.
PIVOTS = 48
SLICE = 20_000


@cache
def _step() -> np.ndarray:
    """The usual table of crc32: the effect of one byte on the state."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


@cache
def _shifts() -> np.ndarray:
    """By length and byte of a checksum: what zeros behind the data make of it."""
    step = _step()
    out = np.empty((_SHIFT + 1, 4, 256), np.uint32)
    for byte in range(4):
        out[0, byte] = np.arange(256, dtype=np.uint32) << np.uint32(8 * byte)
    for n in range(1, _SHIFT + 1):
        out[n] = step[out[n - 1] & np.uint32(255)] ^ (out[n - 1] >> np.uint32(8))
    return out


def _looked_up(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return (
        tables[..., 0, :].ravel()[crc & np.uint32(255)]
        ^ tables[..., 1, :].ravel()[(crc >> np.uint32(8)) & np.uint32(255)]
        ^ tables[..., 2, :].ravel()[(crc >> np.uint32(16)) & np.uint32(255)]
        ^ tables[..., 3, :].ravel()[crc >> np.uint32(24)]
    )


@cache
def _power(j: int) -> np.ndarray:
    """As ``_shifts`` for 2^j zeros."""
    half = _shifts()[_SHIFT // 2] if 1 << j == _SHIFT else _power(j - 1)
    return _looked_up(half, half)


def _moved(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """crc32 of data, moved in front of ``n`` further bytes each."""
    tables, few = _shifts(), n % _SHIFT
    crc = (
        tables[few, 0, crc & np.uint32(255)]
        ^ tables[few, 1, (crc >> np.uint32(8)) & np.uint32(255)]
        ^ tables[few, 2, (crc >> np.uint32(16)) & np.uint32(255)]
        ^ tables[few, 3, crc >> np.uint32(24)]
    )
    j = _SHIFT.bit_length() - 1
    while (n >> j).any():
        at = np.flatnonzero(n >> j & 1)
        if len(at):
            crc[at] = _looked_up(_power(j), crc[at])
        j += 1
    return crc


def checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of many spans of bytes at once."""
    step, size = _step(), ends - starts
    order = np.argsort(-size, kind="stable")
    at, by_size = starts[order], size[order]
    crc = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    longer = int(np.searchsorted(-by_size, -_LONG, "left"))
    for k in range(int(by_size[longer]) if longer < len(at) else 0):
        m = int(np.searchsorted(-by_size, -k, "left"))
        head = crc[longer:m]
        crc[longer:m] = step[(head ^ data[at[longer:m] + k]) & np.uint32(255)] ^ (head >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    for i in range(longer):
        crc[i] = zlib.crc32(data[at[i] : at[i] + by_size[i]].tobytes())
    out = np.empty(len(starts), np.uint32)
    out[order] = crc
    return out


def buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs of one to three words: the text each is of, its bucket, and the
    words of every text."""
    value = _TABLE[data]
    starts, ends, bounds = ar.word_spans(value, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    lower = (np.maximum(value, 1) - np.uint64(1)).astype(np.uint8)
    one, size = checksums(lower, starts, ends), ends - starts
    space, width = np.uint32(zlib.crc32(b" ")), np.ones(len(one), np.int64)
    found, last = [one], one
    for k in (1, 2):
        last = _moved(_moved(last[: len(one) - k], width[: max(len(one) - k, 0)]) ^ space, size[k:]) ^ one[k:]
        found.append(last)
    texts = [text]
    for k in (1, 2):
        inside = text[k:] == text[: max(len(text) - k, 0)]
        texts.append(text[k:][inside])
        found[k] = found[k][inside]
    return np.concatenate(texts), np.concatenate(found) % np.uint32(BUCKETS), np.diff(bounds)


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """How often each bucket occurs in all texts."""

    def count(batch: pa.RecordBatch) -> np.ndarray:
        total = np.zeros(BUCKETS, np.int64)
        for _, _, data, offsets in ar.pieces(ar.texts(batch)):
            total += np.bincount(buckets(data, offsets)[1], minlength=BUCKETS)
        return total

    return vx.totals(docs.select("text"), count, BUCKETS, np.int64)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log ratio) of every bucket's smoothed shares."""
    s_all, t_all = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    ratios = ((t + 1.0) * s_all / ((s + 1.0) * t_all) for s, t in zip(source.tolist(), target.tolist(), strict=True))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in ar.pieces(ar.texts(batch)):
                text, bucket, n_words = buckets(data, offsets)
                weight = np.zeros(j - i, np.int64)
                np.add.at(weight, text, gain[bucket])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[i:j],
                        pa.array(n_words.astype(np.int64)),
                        pa.array(np.bincount(text, minlength=j - i).astype(np.int64)),
                        pa.array(weight),
                    ],
                    ["doc_id", "n_words", "n_features", "weight"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """A thousand times a Gumbel variate, fixed by seed and id, rounded down."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


# --- distributed quickselect --------------------------------------------------


def _key(row) -> Column:
    """A literal of the composite key: ascending (-score, id)."""
    return F.struct(F.lit(row[0]).cast("long").alias("far"), F.lit(row[1]).cast("long").alias("id"))


def _places(keys: DataFrame, pivots: list) -> dict[int, int]:
    """Rows by place among ascending distinct pivots: 2i lies before pivot i and
    behind the one before it, 2i + 1 is the pivot itself."""
    fixed = F.array(*[_key(p) for p in pivots])
    behind = F.aggregate(
        fixed, F.lit(0), lambda n, p: n + F.when(F.col("key") > p, 2).when(F.col("key") == p, 1).otherwise(0)
    )
    return {r.place: r["count"] for r in keys.groupBy(behind.alias("place")).count().collect()}


def _pivots(keys: DataFrame, n: int, *salt) -> list:
    """At most ``n`` random distinct keys, ascending: of each of ``n`` classes of a hash
    that with the least hash. A task sends one key a class."""
    draw = F.xxhash64(*[F.lit(x) for x in salt], "key.far", "key.id")
    drawn = keys.groupBy(F.pmod(draw, F.lit(n)).alias("part")).agg(F.min_by("key", draw).alias("key"))
    return sorted((r.key.far, r.key.id) for r in drawn.collect())


def quickselect(keys: DataFrame, k: int, seed: int = 0, pivots: int = PIVOTS):
    """The k-th smallest ``key`` (from 1), counted with repetitions, and the rows
    before it. ``keys`` should be a written table, as each round reads it."""
    low = high = None
    before, turn = 0, 0
    while True:
        inside = keys
        if low is not None:
            inside = inside.filter(F.col("key") > _key(low))
        if high is not None:
            inside = inside.filter(F.col("key") < _key(high))
        chosen = _pivots(inside, pivots, seed, turn)
        counts = _places(inside, chosen)
        for place in range(2 * len(chosen) + 1):
            n = counts.get(place, 0)
            if before + n >= k:
                break
            before += n
        if place % 2:
            return chosen[place // 2], before
        i = place // 2
        low, high = chosen[i - 1] if i else low, chosen[i] if i < len(chosen) else high
        turn += 1


def ranked(keys: DataFrame, total: int, seed: int = 0) -> DataFrame:
    """Rows with ``rank`` from 1 by ascending ``key``. Random keys cut the rows in
    slices whose exact counts give each slice its first rank; a slice is one task's
    sort."""
    n = min(256, total // SLICE)
    cuts = _pivots(keys, n, seed, "slice") if n else []
    if not cuts:
        place, first = F.lit(0), {0: 0}
    else:
        fixed = F.array(*[_key(c) for c in cuts])
        place = F.aggregate(
            fixed, F.lit(0), lambda n, p: n + F.when(F.col("key") > p, 2).when(F.col("key") == p, 1).otherwise(0)
        )
        counts, first, so_far = _places(keys, cuts), {}, 0
        for i in range(2 * len(cuts) + 1):
            first[i] = so_far
            so_far += counts.get(i, 0)
    starts = F.array(*[F.lit(first[i]).cast("long") for i in range(len(first))])
    order = W.partitionBy("_place").orderBy("key", "tie")
    return (
        keys.withColumn("_place", place)
        .withColumn("rank", F.get(starts, F.col("_place")) + F.row_number().over(order))
        .drop("_place")
    )


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42
) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``docs``.

    ``floor(percent * N / 100)`` of the N rows with at least ``least_words`` words
    are drawn and ranked by falling score, ties by smaller id; the others' rank is
    null. A null text has no words. A null id counts as an empty text in the noise
    and comes before other ids of its score. Repeated rows are drawn one by one; of
    equal ids and scores the rows with more features come first. An empty target
    has count 0 in all buckets, an empty table gives no rows.
    """
    texts = docs.select("doc_id", "text")
    gain = gains(bucket_counts(texts), bucket_counts(target.select("text")))
    scored = weigh(texts, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    key = F.struct((-F.col("score")).alias("far"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"))
    scored = staged(
        scored.withColumn("key", key).withColumn("tie", F.struct((-F.col("n_features")).alias("n"), "weight")),
        "scored",
    )
    fit = F.col("n_words") >= least_words
    wanted = percent * scored.filter(fit).count() // 100
    out = ["doc_id", "n_features", "weight", "score", "rank"]
    if not wanted:
        return scored.withColumn("rank", F.lit(None).cast("long")).select(out)
    last, before = quickselect(scored.filter(fit).select("key"), wanted, seed)
    won = fit & (F.col("key") <= _key(last))
    winners = scored.filter(won)
    same = scored.filter(fit & (F.col("key") == _key(last))).count()
    placed = ranked(winners, before + same, seed)
    rank = F.when(F.col("rank") <= wanted, F.col("rank")).alias("rank")
    rest = scored.filter(~won).withColumn("rank", F.lit(None).cast("long"))
    return placed.withColumn("rank", rank).select(out).unionByName(rest.select(out))
