"""Benchmark decontamination by a prefix-filtered set join.

A window is ten consecutive words of a benchmark item. All of a window's
shingles must be present, so its necessary prefix is one shingle: the rarest one
over all documents. Documents meet windows at that shingle only, positions and
lengths bound where the window can lie, and its words are then compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm import arrays as ar
from textloom.session import staged

WINDOW = 10
#: Words of a shingle; a window of fewer words is one shingle.
WORDS = 3
#: Windows that are sent to the tasks at once: this bounds what is broadcast. A
#: larger benchmark is joined block by block.
BLOCK = 100_000
#: Bytes of texts whose words a task hashes at once.
PIECE = 1 << 19

#: Words are digits, letters a-z and everything beyond ASCII.
_TABLE = ar.byte_table(bytes(b for b in range(128) if not chr(b).isalnum()))
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    return ar._rolled(hashes, size)


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows with their items: words (joined by blanks), size, items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, joined, sizes = [], [], []
            for i, _, data, offsets in ar.pieces(ar.texts(batch), PIECE):
                starts, ends, _, bounds = ar.words(data, offsets, _TABLE)
                low = data.tobytes().translate(_LOWER)
                own = [low[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    for x in range(a, max(b - window, a) + 1 if b > a else a):
                        parts = own[x : min(x + window, b)]
                        items.append(batch.column("item_id")[i + k].as_py())
                        joined.append(b" ".join(parts))
                        sizes.append(len(parts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(items, pa.string()), pa.array(joined, pa.binary()).cast(pa.string()), pa.array(sizes, pa.int32())],
                names=["item", "words", "size"],
            )

    ids = F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id")
    return (
        benchmark.select(ids, "text")
        .mapInArrow(run, "item string, words string, size int")
        .groupBy("words", "size")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )


class _Block:
    """Windows of one block with, once ``frequency`` is known, their prefixes."""

    def __init__(self, rows: list):
        self.parts = [r["words"].encode().split(b" ") for r in rows]
        self.items = [r["items"] for r in rows]
        self.tokens = []
        for parts in self.parts:
            joined = b" ".join(parts)
            data = np.frombuffer(joined, np.uint8)
            _, _, hashes, _ = ar.words(data, np.array([0, len(data)]), _TABLE)
            self.tokens.append(_shingles(hashes, min(WORDS, len(hashes))))
        self.sizes = sorted({min(WORDS, len(p)) for p in self.parts})
        self.shingles = np.unique(np.concatenate(self.tokens)) if self.tokens else np.zeros(0, np.uint64)
        self.prefix: dict[int, list[tuple[int, int]]] = {}

    def order(self, frequency: dict[int, int]) -> None:
        """Chooses each window's rarest shingle (ties: the first)."""
        for k, tokens in enumerate(self.tokens):
            at = min(range(len(tokens)), key=lambda i: (frequency.get(int(tokens[i]), 0), i))
            if int(tokens[at]) in frequency:
                self.prefix.setdefault(int(tokens[at]), []).append((k, at))
        self.shingles = np.array(sorted(self.prefix), np.uint64)
        self.tokens = []

    def finder(self) -> ar.HashIndex:
        return ar.HashIndex(self.shingles)

    def hits(self, index: ar.HashIndex, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of shingles of the block among the words: first word, size, shingle."""
        at, size, key = [], [], []
        for k in self.sizes:
            rolled = _shingles(hashes, k)
            found = np.flatnonzero(index.find(rolled) >= 0) if len(self.shingles) else np.zeros(0, np.int64)
            at.append(found)
            size.append(np.full(len(found), k))
            key.append(rolled[found])
        if not at:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return np.concatenate(at), np.concatenate(size), np.concatenate(key)


def _frequencies(docs: DataFrame, shared) -> dict[int, int]:
    """How often the block's shingles occur in all documents. As many numbers as
    the block has shingles come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        index = block.finder()
        total = np.zeros(len(block.shingles), np.int64)
        for batch in batches:
            for _, _, data, offsets in ar.pieces(ar.texts(batch), PIECE):
                _, _, hashes, bounds = ar.words(data, offsets, _TABLE)
                at, size, key = block.hits(index, hashes)
                inside = at + size <= bounds[np.searchsorted(bounds, at, "right")] if len(at) else at > 0
                total += np.bincount(index.find(key[inside]), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(block.shingles[some].view(np.int64)), pa.array(total[some])], names=["key", "n"]
        )

    rows = docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()
    return {r["key"] % (1 << 64): r["n"] for r in rows}


_FOUND = "doc_id long, _row long, n_words long, spans array<struct<lo:int,hi:int>>, items array<string>"


def _matches(docs: DataFrame, shared, every: bool) -> DataFrame:
    """Per document the spans of words under windows of the block, and the
    windows' items; only documents with such unless ``every``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        index = block.finder()
        for batch in batches:
            counts, spans, items = [], [], []
            for _, _, data, offsets in ar.pieces(ar.texts(batch), PIECE):
                starts, ends, hashes, bounds = ar.words(data, offsets, _TABLE)
                counts.extend(np.diff(bounds).tolist())
                own: dict[int, tuple[set, set]] = {}
                at, _, key = block.hits(index, hashes)
                doc = np.searchsorted(bounds, at, "right") - 1
                low = data.tobytes().translate(_LOWER) if len(at) else b""
                for a, k, d in zip(at.tolist(), key.tolist(), doc.tolist(), strict=True):
                    for number, shift in block.prefix[k]:
                        parts = block.parts[number]
                        x, y = a - shift, a - shift + len(parts)
                        if x < bounds[d] or y > bounds[d + 1]:
                            continue
                        if all(low[starts[x + i] : ends[x + i]] == p for i, p in enumerate(parts)):
                            hit = own.setdefault(d, (set(), set()))
                            hit[0].add((x - int(bounds[d]), y - int(bounds[d])))
                            hit[1].update(block.items[number])
                for d in range(len(offsets) - 1):
                    hit = own.get(d, ((), ()))
                    spans.append([{"lo": a, "hi": b} for a, b in sorted(hit[0])])
                    items.append(sorted(hit[1]))
            out = pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("_row"),
                    pa.array(counts, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))),
                    pa.array(items, pa.list_(pa.string())),
                ],
                names=["doc_id", "_row", "n_words", "spans", "items"],
            )
            yield out if every else out.filter(pa.array([bool(s) for s in spans], pa.bool_()))

    return docs.mapInArrow(run, _FOUND)


def _blocks(benchmark: DataFrame, window: int, block: int) -> Iterator[_Block]:
    """The windows in blocks that a driver and a task can hold."""
    found = staged(windows(benchmark, window), "windows")
    n = -(-found.count() // block)
    draw = F.pmod(F.xxhash64("words"), F.lit(max(n, 1)))
    for k in range(max(n, 1)):
        yield _Block(found.filter(draw == k).collect())


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK
) -> DataFrame:
    """Words of documents that lie in a window of a benchmark item.

    Reads doc_id and text of ``docs`` and item_id and text of ``benchmark``; A-Z
    are lower-cased and words are runs of digits, letters and bytes beyond
    ASCII. An item of fewer than ``window`` words is one window, an item without
    words none. Returns per row of ``docs``: doc_id, _row (a hash of the text),
    n_words, spans (word positions lo to hi - 1 under each occurrence), items
    (ids as strings, sorted; that of a null id is empty). A null text has no
    words. Repeated documents and items count like others.
    """
    spark = docs.sparkSession
    texts = ar.with_row_hash(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    result = None
    for own in _blocks(benchmark, window, block):
        counted = spark.sparkContext.broadcast(own)
        frequency = _frequencies(texts, counted) if own.parts else {}
        own.order(frequency)
        found = _matches(texts, spark.sparkContext.broadcast(own), result is None)
        if result is None:
            result = found
            continue
        more = found.select(
            F.col("doc_id").alias("_id"), F.col("_row").alias("_same"), F.col("spans").alias("s"), F.col("items").alias("i")
        ).dropDuplicates(["_id", "_same"])
        joined = result.join(more, result["doc_id"].eqNullSafe(F.col("_id")) & (result["_row"] == F.col("_same")), "left")
        result = joined.select(
            "doc_id",
            "_row",
            "n_words",
            F.when(F.col("s").isNull(), F.col("spans")).otherwise(F.concat("spans", "s")).alias("spans"),
            F.when(F.col("i").isNull(), F.col("items")).otherwise(F.array_union("items", "i")).alias("items"),
        )
    assert result is not None
    return result.withColumn("items", F.sort_array("items"))


def n_hit(spans: Column) -> Column:
    """Words under any of the spans."""
    words = F.flatten(F.transform(spans, lambda s: F.sequence(s["lo"], s["hi"] - 1)))
    return F.size(F.array_distinct(words)).cast("long")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without a word of a window; all columns stay.

    Names of the others are written, so that no text moves while windows are sought,
    nor later where these names are few enough to be broadcast.
    """
    bad = (
        contamination(docs, benchmark, window)
        .filter(F.size("spans") > 0)
        .select(F.col("doc_id").alias("_id"), F.col("_row").alias("_same"))
        .distinct()
    )
    bad = staged(bad, "contaminated")
    keyed = ar.nested(docs)
    return keyed.join(bad, ar.same_row(keyed), "left_anti").select("doc.*")


def oracle_sql() -> str:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated over
    ``documents`` and ``benchmark`` with distinct ids."""
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = f"regexp_extract_all({low}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {words} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS k
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
),
pos AS (
  SELECT doc_id, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS k
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM d, (SELECT DISTINCT size FROM win) WHERE len(w) >= size)
),
hit AS (SELECT doc_id, i, pos.size, item FROM pos JOIN win ON pos.k = win.k AND pos.size = win.size),
n AS (SELECT doc_id, count(DISTINCT x) AS n_hit
      FROM (SELECT doc_id, unnest(range(i, i + size)) AS x FROM hit) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
