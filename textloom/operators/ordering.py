"""Positions, ranks, ordered limits and seeded order.

A rank over a whole table, or within a key that may hold a third of the rows,
never goes through one task: rows are ranked in small blocks and each block
starts at the prefix sum of the blocks before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions import text as fx
from textloom.session import new_path, staged

BLOCK_BITS = 14
#: A slice of at most this many rows is sorted by one task.
SLICE = 1 << 14
#: Pivots of one pass, and characters of a text that are a pivot at first.
PIVOTS, PREFIX = 64, 24

#: A column's name, ascending, or the name and whether it ascends.
Key = str | tuple[str, bool]


def running_sum(
    df: DataFrame,
    group: Sequence[str],
    block: Column,
    order: Sequence[str],
    name: str,
    value: Column | None = None,
) -> DataFrame:
    """Sum of ``value`` over the earlier rows of the group (a 0-based rank by
    default).

    ``block`` must grow with ``order``, and group columns must not be NULL. A
    window never holds more than one
    block of rows or one row per block of a group; rows shuffle once, on
    (group, block).
    """
    value = F.lit(1) if value is None else value
    d = df.withColumn("_blk", block).withColumn("_val", value.cast("bigint"))
    keys = [*group, "_blk"]
    before = W.partitionBy(*group).orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        d.groupBy(*keys)
        .agg(F.sum("_val").alias("_tot"))
        .select(*keys, F.coalesce(F.sum("_tot").over(before), F.lit(0)).alias("_start"))
    )
    within = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (
        d.join(starts, keys)
        .withColumn(name, F.col("_start") + F.coalesce(F.sum("_val").over(within), F.lit(0)))
        .drop("_blk", "_val", "_start")
    )


def rank_in_doc(sent: DataFrame, name: str = "rank") -> DataFrame:
    """0-based position among the document's remaining sentences."""
    return running_sum(sent, ["doc_id"], F.shiftright("six", BLOCK_BITS), ["six"], name)


def seeded_hash(seed: int, *keys: str) -> Column:
    """Hex digest that fixes a pseudo-random order for a key.

    Stable under repartitioning and retries, unlike a generator, and the same
    in any SQL engine.
    """
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def hash_rank(df: DataFrame, keys: Sequence[str], seed: int, group: Sequence[str], name: str) -> DataFrame:
    """0-based rank in seeded order within each group; blocks are uniform
    slices of the digest."""
    h = df.withColumn("_hash", seeded_hash(seed, *keys))
    return running_sum(h, group, F.substring("_hash", 1, 4), ["_hash", *keys], name).drop("_hash")


def dense_ids(keys: DataFrame, key: str, name: str) -> DataFrame:
    """A dense 0-based id per distinct key, in digest order."""
    d = keys.select(key).distinct().withColumn("_all", F.lit(0))
    return hash_rank(d, [key], 0, ["_all"], name).drop("_all")


def indexed_table(df: DataFrame, order: Sequence[str], name: str = "idx") -> DataFrame:
    """The rows with their 0-based position in a total order.

    The order is a range-partitioned sort written once to the shared folder;
    a row's position is its row number in the file plus the rows of the files
    before it. Reading back also cuts the lineage.
    """
    spark = df.sparkSession
    path = new_path(spark, "indexed")
    df.orderBy(*order).write.parquet(path)
    return read_indexed(spark, path, name)


def read_indexed(spark: SparkSession, path: str, name: str = "idx") -> DataFrame:
    """A sorted write with each row's position over all its part files.

    A file starts at the prefix sum of the files before it, in two levels: within
    runs of files, and over the runs. The starts are a written table, whose size
    decides how it is joined.
    """
    rows = spark.read.parquet(path)
    cols = rows.columns
    file = F.col("_metadata.file_name").alias("_file")
    part = F.regexp_extract("_file", r"^part-(\d+)", 1).cast("int")
    split = F.regexp_extract("_file", r"-c(\d+)\.", 1).cast("int")  # not a part of the name's UUID
    files = rows.select(file).groupBy("_file").agg(F.count("*").alias("_n"))
    files = files.select("_file", "_n", part.alias("_part"), split.alias("_split"), F.lit(0).alias("_all"))
    starts = running_sum(files, ["_all"], F.shiftright("_part", 10), ["_part", "_split"], "_first", F.col("_n"))
    starts = staged(starts.select("_file", "_first"), "starts")
    return (
        rows.select("*", file, F.col("_metadata.row_index").alias("_row"))
        .join(starts, "_file")
        .select(*cols, (F.col("_first") + F.col("_row")).alias(name))
    )


class _Cut:
    """Finds which rows of a table come first: conditions for rows that surely do,
    and one for the slice that holds the last of them."""

    def __init__(self, rows: DataFrame, n: int):
        self.rows, self.need = rows, n
        self.sure: list[Column] = []
        self.slice: Column = F.lit(True)
        self.size = rows.count()

    def _take(self, before: Column, n: int, then: Column, size: int) -> None:
        self.sure.append(self.slice & before)
        self.need -= n
        self.slice, self.size = self.slice & then, size

    def by(self, name: str, up: bool) -> None:
        """Narrows the slice by one column, to few rows or to one value."""
        col = F.col(name)
        nulls = self.rows.filter(self.slice & col.isNull()).count()
        there = self.size - nulls
        if up and self.need <= nulls or not up and self.need > there:
            if up:
                self.slice, self.size = self.slice & col.isNull(), nulls
            else:
                self._take(col.isNotNull(), there, col.isNull(), nulls)
            return
        if up and nulls:
            self._take(col.isNull(), nulls, col.isNotNull(), there)
        self.slice, self.size = self.slice & col.isNotNull(), there
        text = dict(self.rows.dtypes)[name] == "string"
        turn, width = 0, PREFIX
        while self.size > SLICE:
            pivots = self._pivots(col, F.substring(col, 1, width) if text else col, turn, up)
            turn += 1
            if not pivots:  # all longer than what was looked at
                width *= 4
                continue
            if self._narrow(col, pivots, up):
                return

    def _pivots(self, col: Column, value: Column, turn: int, up: bool) -> list:
        """Values that part the slice: of each of many hash classes the least hash's."""
        draw = F.xxhash64(value, F.lit(turn))
        drawn = (
            self.rows.filter(self.slice)
            .groupBy(F.pmod(draw, F.lit(PIVOTS)).alias("_class"))
            .agg(F.min_by(value, draw).alias("_v"), F.min(col).alias("_low"), F.max(col).alias("_high"))
            .collect()
        )
        low, high = min(r._low for r in drawn), max(r._high for r in drawn)
        # The prefix of a text can lie before all texts of the slice.
        return sorted({r._v for r in drawn if low <= r._v <= high}, reverse=not up)

    def _narrow(self, col: Column, pivots: list, up: bool) -> bool:
        """One pass counts the rows before, at and behind each pivot; whether a
        single value is left."""
        fixed = F.array(*[F.lit(p) for p in pivots])
        place = F.aggregate(
            fixed, F.lit(0),
            lambda n, p: n + F.when(col > p if up else col < p, 2).when(col == p, 1).otherwise(0),
        )
        counted = self.rows.filter(self.slice).groupBy(place.alias("_place")).count().collect()
        counts = {r._place: r["count"] for r in counted}
        before, at = 0, 0
        while before + counts.get(at, 0) < self.need:
            before += counts.get(at, 0)
            at += 1
        i, size = at // 2, counts[at]
        if at % 2:
            self._take(col < pivots[i] if up else col > pivots[i], before, col == F.lit(pivots[i]), size)
            return True
        then = F.lit(True)
        if i < len(pivots):
            then = col < F.lit(pivots[i]) if up else col > F.lit(pivots[i])
        if i:
            edge = F.lit(pivots[i - 1])
            self._take(col <= edge if up else col >= edge, before, then & (col > edge if up else col < edge), size)
        else:
            self.slice, self.size = self.slice & then, size
        return False


def first_n(df: DataFrame, n: int, order: Sequence[Key]) -> DataFrame:
    """The first ``n`` rows of an order, sorted; nulls come first, or last where a
    column descends.

    Counts between pivots narrow the place of the n-th row, column by column, until
    its slice is small. Only that slice is sorted by one task; the rows before it are
    taken by comparison, whatever ``n`` is. Of rows that agree in the whole order
    some are taken, so that there are ``n``.
    """
    keys = [(k, True) if isinstance(k, str) else k for k in order]
    sort = [F.asc(k) if up else F.desc(k) for k, up in keys]
    rows = staged(df, "rows")
    cut = _Cut(rows, n)
    if n <= 0 or cut.size <= n:
        return rows.orderBy(*sort) if n > 0 else rows.limit(0)
    for name, up in keys:
        if cut.size <= SLICE:
            break
        cut.by(name, up)
    last = rows.filter(cut.slice)
    if cut.size <= SLICE:
        out = last.orderBy(*sort).limit(cut.need)
    else:
        path = new_path(df.sparkSession, "equal")
        last.write.parquet(path)
        out = read_indexed(df.sparkSession, path, "_idx").filter(F.col("_idx") < cut.need).drop("_idx")
    for sure in cut.sure:
        out = out.unionByName(rows.filter(sure))
    return out.orderBy(*sort)


def ordered_export(sent: DataFrame, n: int | None = None) -> DataFrame:
    if n is None:
        return sent.orderBy("doc_id", "six")
    return first_n(sent, n, ["doc_id", "six"])


def sorted_peek(sent: DataFrame, n: int = 10000) -> DataFrame:
    """First ``n`` sentences in binary text order."""
    return first_n(sent, n, ["sent", "doc_id", "six"])


def sample_limit(df: DataFrame, n: int, keys: Sequence[str]) -> DataFrame:
    """``n`` rows, fixed by the order of ``keys``."""
    return first_n(df, n, keys)


def shuffle_docs(sent: DataFrame, seed: int = 0) -> DataFrame:
    """Documents in seeded order, each document's sentences in their own."""
    return (
        sent.withColumn("doc_hash", seeded_hash(seed, "doc_id"))
        .orderBy("doc_hash", "doc_id", "six")
        .drop("doc_hash")
    )


def sentence_index(paras: DataFrame) -> DataFrame:
    """Sentences of (doc_id, para_no, para) rows with an index that runs
    through the document."""
    d = paras.withColumn("_ss", fx.split_sentences("para"))
    placed = running_sum(
        d, ["doc_id"], F.shiftright(F.col("para_no").cast("bigint"), BLOCK_BITS), ["para_no"],
        "_first", F.size("_ss"),
    )
    out = placed.select("doc_id", "_first", F.posexplode("_ss").alias("_pos", "sent"))
    six = (F.col("_first") + F.col("_pos")).cast("int")
    return out.select("doc_id", six.alias("six"), six.cast("string").alias("sid"), "sent")


def chunk_docs(sent: DataFrame, n: int = 500) -> DataFrame:
    """Pieces of at most ``n`` sentences per document."""
    return (
        rank_in_doc(sent, "_rank")
        .withColumn("chunk_id", F.floor(F.col("_rank") / n).cast("int"))
        .drop("_rank")
    )


def token_index(sent: DataFrame, tokens: str = "tokens") -> DataFrame:
    return sent.select("doc_id", "six", fx.token_index(tokens).alias("tokens"))


def nest_documents(indexed: DataFrame) -> DataFrame:
    """One row per document chunk with its sentences nested in order.

    Takes (doc_id, chunk_id, six, tokens): a group is at most one chunk.
    """
    return indexed.groupBy("doc_id", "chunk_id").agg(
        F.array_sort(F.collect_list(F.struct("six", "tokens"))).alias("sents")
    )
