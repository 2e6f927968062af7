"""Language-model scoring by prediction by partial matching.

A byte-context trie with the counts of the training texts. A byte is coded in the
longest context that has it; each longer context in which it did not occur is
left by an escape, and the bytes of that context are excluded below. The counts
stay a Spark table, where every distinct gram gets its probability once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.llm import arrays as ar
from textloom.session import staged

#: Longest context in bytes; six bytes of context and symbol fill a key.
ORDER = 5
#: Bytes that never occur in UTF-8: before a text, and its end as a symbol.
_BEFORE, _END = 0xFE, 0xFF
#: Bytes of text that are worked on at once, with some 200 bytes of arrays each.
PIECE = 1 << 19

_LOWER = (ar.byte_table(b"") - np.uint64(1)).astype(np.uint8)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of every symbol with the ORDER bytes before it, end symbols included,
    and where each text's begin."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    tape = np.full(len(data) + n * (ORDER + 1), _BEFORE, np.uint8)
    shift = np.repeat(np.arange(n) * (ORDER + 1) + ORDER, sizes)
    tape[np.arange(len(data)) + shift] = _LOWER[data]
    tape[offsets[1:] + np.arange(1, n + 1) * (ORDER + 1) - 1] = _END
    keys = np.zeros(len(tape), np.uint64)
    for back in range(ORDER + 1):
        keys[back:] |= tape[: len(tape) - back].astype(np.uint64) << np.uint64(8 * back)
    symbol = np.ones(len(tape), bool)
    symbol[(offsets[:-1] + np.arange(n) * (ORDER + 1))[:, None] + np.arange(ORDER)] = False
    return keys[symbol], offsets + np.arange(n + 1)


def counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their weights."""
    if weights is None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        return keys[first], np.diff(np.append(first, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.add.reduceat(weights, first) if len(first) else weights


def seen(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of six bytes, ascending, with their numbers in training."""
    marked, n = counted(keys << np.uint64(1) | train.astype(np.uint64))
    keys, n = marked >> np.uint64(1), n * (marked & np.uint64(1)).astype(np.int64)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.add.reduceat(n, first) if len(first) else n


class Sums:
    """Sums by key, merged whenever many are pending, so that what is held
    follows the distinct keys."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.pending, self.room = 0, 1 << 20

    def add(self, keys: np.ndarray, sums: np.ndarray) -> None:
        self.parts.append((keys, sums))
        self.pending += len(keys)
        if self.pending > self.room:
            merged = self.total()
            self.room = max(self.room, 2 * len(merged[0]))

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        keys, sums = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts = [counted(keys, sums)]
        self.pending = len(self.parts[0][0])
        return self.parts[0]


class Trie:
    """log10 probabilities of symbols in context, from (keys, counts) by order:
    what ``probabilities`` gives, for tables that fit in memory.

    Escapes follow the estimate of half a count: a symbol of count c weighs
    2c - 1, the escape as much as there are distinct symbols.
    """

    def __init__(self, tables: list[tuple[np.ndarray, np.ndarray]]):
        self.levels = []
        for order, (keys, counts) in enumerate(tables):
            weight = 2.0 * counts - 1
            context = keys >> np.uint64(8)
            first = np.flatnonzero(np.append(True, context[1:] != context[:-1])[: len(keys)])
            total = np.add.reduceat(weight, first) if len(first) else np.zeros(0)
            kinds = np.diff(np.append(first, len(keys))).astype(float)
            level = {
                "entries": ar.HashIndex(keys),
                "contexts": ar.HashIndex(context[first]),
                "weight": np.log10(weight).astype(np.float32),
                "whole": np.log10(total + kinds).astype(np.float32),
                "escape": (np.log10(kinds) - np.log10(total + kinds)).astype(np.float32),
                "kinds": kinds,
                "total": total,
            }
            if order:
                low, mask = self.levels[-1], np.uint64((1 << 8 * order) - 1)
                owner = np.repeat(np.arange(len(first)), kinds.astype(np.int64))
                below = 2.0 * tables[order - 1][1][low["entries"].find(keys & mask)] - 1
                shorter = low["contexts"].find(context[first] & (mask >> np.uint64(8)))
                left = low["kinds"][shorter] - kinds
                rest = np.maximum(low["total"][shorter] - np.bincount(owner, below, len(first)), 0) + left
                some = left > 0
                whole = np.log10(np.where(some, rest, 1))
                level["whole_below"] = whole.astype(np.float32)
                level["escape_below"] = np.where(some, np.log10(np.where(some, left, 1)) - whole, 0).astype(np.float32)
                level["shorter"] = shorter
            self.levels.append(level)
        kinds = self.levels[0]["kinds"]
        for level in self.levels:
            del level["kinds"], level["total"]
        self.unseen = -np.log10(max(1.0, 256 - (kinds[0] if len(kinds) else 0)))

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each key's symbol in its context."""
        out = np.zeros(len(keys))
        rest = np.arange(len(keys))
        # The place of the context one order up that was left by an escape, or -1.
        above = np.full(len(keys), -1)
        for order in range(len(self.levels) - 1, -1, -1):
            level = self.levels[order]
            key = keys[rest] & np.uint64((1 << 8 * (order + 1)) - 1)
            entry = level["entries"].find(key)
            hit = entry >= 0
            free = above < 0
            context = np.full(len(rest), -1)
            context[free] = level["contexts"].find(key[free] >> np.uint64(8))
            if order + 1 < len(self.levels):
                up = self.levels[order + 1]
                context[~free] = up["shorter"][above[~free]]
            gain = np.zeros(len(rest))
            plain = hit & free
            gain[plain] = level["weight"][entry[plain]] - level["whole"][context[plain]]
            leave = ~hit & free & (context >= 0)
            gain[leave] = level["escape"][context[leave]]
            if (~free).any():
                under = hit & ~free
                gain[under] = level["weight"][entry[under]] - up["whole_below"][above[under]]
                under = ~hit & ~free
                gain[under] = up["escape_below"][above[under]]
            out[rest] += gain
            rest, above = rest[~hit], context[~hit]
        out[rest] += self.unseen
        return out


_KINDS = {"texts": 0, "word": 1, "gram": 2}
_BLOCKED = "kind int, block long, texts binary, key long, n long"


def _packed(batch: pa.RecordBatch) -> bytes:
    """Rows as one compressed value, about a third of their size."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _blocked(docs: DataFrame) -> DataFrame:
    """One pass over the texts (doc_id, text, train), block by block: the packed
    rows, and the block's distinct words and grams with their training counts. A block is one Arrow batch, so what belongs to it is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for number, batch in enumerate(batches):
            block = (task << 24) + number
            train = batch.column("train").to_numpy(zero_copy_only=False).astype(bool)
            words, symbols = Sums(), Sums()
            for i, j, data, offsets in ar.pieces(ar.texts(batch), PIECE):
                yield _rows("texts", block, 1, texts=pa.array([_packed(batch.slice(i, j - i))], pa.binary()))
                _, _, hashes, bounds = ar.words(data, offsets)
                own = np.repeat(train[i:j], np.diff(bounds))
                words.add(*counted(hashes, own.astype(np.int64)))
                keys, at = grams(data, offsets)
                symbols.add(*seen(keys, np.repeat(train[i:j], np.diff(at))))
            if batch.num_rows:
                for kind, sums in (("word", words), ("gram", symbols)):
                    key, n = sums.total()
                    yield _rows(kind, block, len(key), key=pa.array(key.view(np.int64)), n=pa.array(n))
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, _BLOCKED)


def _rows(kind: str, block: int, size: int, **columns: pa.Array) -> pa.RecordBatch:
    types = {"texts": pa.binary(), "key": pa.int64(), "n": pa.int64()}
    base = [pa.array(np.full(size, _KINDS[kind], np.int32)), pa.array(np.full(size, block, np.int64))]
    rest = [columns.get(k, pa.nulls(size, t)) for k, t in types.items()]
    return pa.RecordBatch.from_arrays([*base, *rest], names=["kind", "block", *types])


def _least(orders: list[DataFrame], entries: int) -> int:
    """The smallest common count that leaves at most ``entries`` of each order."""
    least = 1
    for table in orders:
        # Counts in classes of a sixteenth of a power of two, a few hundred rows.
        steps = table.filter("n > 0").groupBy(F.floor(F.log2("n") * 16).alias("step")).agg(F.count("*").alias("k"))
        above = 0
        for step, k in sorted(((r["step"], r["k"]) for r in steps.collect()), reverse=True):
            above += k
            if above > entries:
                least = max(least, int(2 ** ((step + 1) / 16)) + 1)
                break
    return least


def probabilities(counts: DataFrame, entries: int | None = None) -> DataFrame:
    """(key, p): the log10 probability of each gram of ``counts`` (key, n), whose
    ``n`` is its number in training, 0 for a gram that is only scored.

    An order's table holds the last bytes of every longer gram, so a gram finds
    its shorter one by a join and its context's other symbols in a window of at
    most 256 rows. Going up from order 0, ``free`` is the value where no longer
    context was left, ``under`` that below the context of the same length.
    """
    orders = [counts]
    for order in range(ORDER - 1, -1, -1):
        key = F.col("key").bitwiseAND(F.lit((1 << 8 * (order + 1)) - 1))
        orders.append(staged(orders[-1].groupBy(key.alias("key")).agg(F.sum("n").alias("n")), f"grams{order}"))
    if entries is not None:
        kept = F.col("n") >= _least(orders, entries)
        orders = [t.select("key", F.when(kept, F.col("n")).otherwise(0).alias("n")) for t in orders]

    n, total, kinds = (F.col(c) for c in ("n", "total", "kinds"))
    weight = 2 * n - 1
    of = W.partitionBy(F.shiftright("key", 8))
    sums = {"total": F.sum(F.when(n > 0, weight).otherwise(0)).over(of), "kinds": F.count_if(n > 0).over(of)}
    own = F.log10(weight) - F.log10(total + kinds)
    escape = F.log10(kinds) - F.log10(total + kinds)
    unseen = -F.log10(F.greatest(F.lit(1), 256 - kinds))
    below = None
    for order, table in enumerate(reversed(orders)):
        if below is None:
            full = table.withColumns(sums).withColumn("under", unseen)
            longest = unseen
        else:
            low = below.select(F.col("key").alias("short"), *[F.col(c).alias(f"{c}_low") for c in below.columns[1:]])
            joined = table.join(low, F.col("key").bitwiseAND(F.lit((1 << 8 * order) - 1)) == F.col("short"))
            weight_low = 2 * F.col("n_low") - 1
            full = joined.withColumns({**sums, "gone": F.sum(F.when(n > 0, weight_low).otherwise(0)).over(of)})
            left = F.col("kinds_low") - kinds
            rest = F.greatest(F.col("total_low") - F.col("gone"), F.lit(0)) + left
            under = (
                F.when(F.col("n_low") > 0, F.log10(weight_low) - F.log10(rest))
                .when(left > 0, F.log10(left) - F.log10(rest) + F.col("under_low"))
                .otherwise(F.col("under_low"))
            )
            full = full.withColumn("under", under)
            longest = F.col("free_low")
        free = F.when(n > 0, own).when(kinds > 0, escape + F.col("under")).otherwise(longest)
        below = full.select("key", "n", "total", "kinds", "under", free.alias("free"))
    return below.select("key", F.col("free").alias("p"))


def score(docs: DataFrame, entries: int | None = None) -> DataFrame:
    """Scores every row of ``docs`` (doc_id, text, train boolean), learning from
    the rows where ``train`` is true.

    Words are runs of no ASCII white space after lower-casing A-Z, followed by
    an end token. Returns doc_id, held_out (not train), n_tokens, n_known,
    train_tokens, base_score (the smoothed unigram model) and score (log10
    probability of the bytes and the end under the trie). A null text is empty
    and has the end token only. Repeated rows are scored, and learned from, once
    each; without training rows every token is unknown and every byte equally
    likely. Other columns are ignored.

    Word counts and gram probabilities come back to the texts by block: each
    distinct word or gram of a block is one row, is counted over all blocks in
    one shuffle, and returns to its block in another, so a frequent one is one
    row per block. All counts are used, whatever their number, unless the caller
    sets ``entries``: then those below the least common count that leaves at
    most so many grams of each order are taken as unseen.
    """
    flags = F.coalesce("train", F.lit(False)).alias("train")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", flags)
    blocks = staged(_blocked(rows), "blocks")
    texts = blocks.filter("kind = 0").select("block", "texts")
    same, within = W.partitionBy("key"), W.partitionBy("key").orderBy("block")
    words = staged(
        blocks.filter("kind = 1").select(
            "block", "key", F.sum("n").over(same).alias("c"), (F.row_number().over(within) == 1).alias("once")
        ),
        "words",
    )
    ends = rows.filter("train").count()
    sums = words.filter("once").agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    n, v = (sums["n"] or 0) + ends, sums["v"] + (ends > 0)
    grams_ = staged(blocks.filter("kind = 2").groupBy("key").agg(F.sum("n").alias("n")), "grams")
    chances = blocks.filter("kind = 2").select("block", "key").join(probabilities(grams_, entries), "key")
    whole = n + 0.5 * (v + 1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        gram = right.column("gram").to_numpy(zero_copy_only=False).astype(bool)
        key, value = right.column("key").to_numpy().view(np.uint64), right.column("value").to_numpy()
        index, p = ar.HashIndex(key[gram]), value[gram]
        key, c = key[~gram], value[~gram]
        order = np.argsort(key)
        key, c = key[order], c[order].astype(np.int64)
        out: dict[str, list[np.ndarray]] = {k: [] for k in ("n_tokens", "n_known", "base_score", "score")}
        ids, held = [], []
        for packed in left.column("texts"):
            batch = pa.ipc.open_stream(packed.as_buffer()).read_next_batch()
            ids.append(batch.column("doc_id"))
            held.append(~batch.column("train").to_numpy(zero_copy_only=False).astype(bool))
            for _, _, data, offsets in ar.pieces(ar.texts(batch), PIECE):
                _, _, hashes, bounds = ar.words(data, offsets)
                # Each text's words, then its end.
                count = np.full(len(hashes) + len(offsets) - 1, ends, np.int64)
                at = np.arange(len(hashes)) + np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
                count[at] = c[np.searchsorted(key, hashes)] if len(hashes) else 0
                first = bounds[:-1] + np.arange(len(offsets) - 1)
                logs = np.log10((count + 0.5) / whole)
                symbols, begin = grams(data, offsets)
                out["n_tokens"].append(np.diff(bounds) + 1)
                out["n_known"].append(np.add.reduceat((count > 0).astype(np.int64), first))
                out["base_score"].append(np.add.reduceat(logs, first))
                out["score"].append(np.add.reduceat(p[index.find(symbols)], begin[:-1]))
        n_tokens, n_known, base, score_ = (pa.array(np.concatenate(x)) for x in out.values())
        tokens = pa.array(np.full(len(n_tokens), n, np.int64))
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        pa.default_memory_pool().release_unused()
        return pa.Table.from_arrays(
            [pa.concat_arrays(ids), pa.array(np.concatenate(held)), n_tokens, n_known, tokens, base, score_], names=names
        )

    # A count is a whole number below 2^53, which a double holds.
    own = words.select(F.col("block").alias("of"), F.lit(False).alias("gram"), "key", F.col("c").cast("double").alias("value"))
    own = own.union(chances.select("block", F.lit(True), "key", "p"))
    schema = (
        "doc_id long, held_out boolean, n_tokens long, n_known long, "
        "train_tokens long, base_score double, score double"
    )
    return texts.groupBy("block").cogroup(own.groupBy("of")).applyInArrow(run, schema)
