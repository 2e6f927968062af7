"""Training-data operators: splits, counts, encoding, packing, masking."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions import text as fx
from textloom.operators.ordering import indexed_table, seeded_hash
from textloom.operators.vocab import gathered, split_words
from textloom.session import staged

# Special token ids, and the label that training ignores.
SPECIAL_IDS = {"cls": 0, "pad": 1, "sep": 2, "unk": 3, "mask": 4}
FIRST_TOKEN_ID = 5
IGNORED = -100
#: Words of a vocabulary that every task holds, at most: some 20 MB.
HEAD_WORDS = 1 << 19
#: Bytes of sentences that one look-up covers.
LOOK_UP = 4 << 20
#: Bits for the words of the tail, at least and at most: 32 MB, which tell most tokens
#: apart up to some hundred million words.
LEAST_BITS, MOST_BITS = 1 << 18, 1 << 28

# Categories of the labelled reviews.
TOPICS = (
    "institution", "project", "online", "learning", "general", "subject", "professor",
    "assessment", "online learning",
)
EMOTIONS = ("surprise", "joy", "sadness", "neutral", "fear", "love", "anger")
LABELS = ("+", "-", "n")


def _quota_split(
    df: DataFrame, keys: Sequence[str], seed: int, group: Column,
    quotas: Callable[[Column], Sequence[tuple[str, Column]]], rest: str,
) -> DataFrame:
    """Rows of each group divided at exact counts of their seeded order.

    ``quotas`` gives each split's cumulative count for a group size. The rows
    themselves never shuffle: counts of digest slices locate the slice in
    which a quota ends, ranks within that slice give the last row before the
    cut, and every row is compared with its group's cuts.
    """
    d = df.withColumns({"_g": group, "_h": seeded_hash(seed, *keys)})
    place = F.struct("_h", *keys)
    upto = W.partitionBy("_g").orderBy("_b")
    slices = (
        d.groupBy("_g", F.substring("_h", 1, 5).alias("_b"))
        .agg(F.count("*").alias("_c"))
        .withColumn("_cum", F.sum("_c").over(upto))
        .withColumn("_n", F.sum("_c").over(W.partitionBy("_g")))
    )
    names = [n for n, _ in quotas(F.lit(0))]
    wanted = F.array(
        *[
            F.struct(F.lit(n).alias("_split"), q.cast("bigint").alias("_quota"))
            for n, q in quotas(F.col("_n"))
        ]
    )
    ends = (
        slices.select("*", F.inline(wanted))
        .filter(F.col("_quota").between(F.col("_cum") - F.col("_c") + 1, F.col("_cum")))
        .select("_g", "_b", "_split", (F.col("_quota") - F.col("_cum") + F.col("_c")).alias("_need"))
    )
    ends = staged(ends, "ends")
    ranked = (
        d.select("_g", F.substring("_h", 1, 5).alias("_b"), place.alias("_at"))
        .join(ends, ["_g", "_b"])
        .withColumn("_rn", F.row_number().over(W.partitionBy("_g", "_split").orderBy("_at")))
    )
    cuts = ranked.filter("_rn = _need").groupBy("_g").agg(
        *[F.max(F.when(F.col("_split") == n, F.col("_at"))).alias(f"_{n}") for n in names]
    )
    out = d.join(staged(cuts, "cuts"), "_g", "left")
    split = F.lit(rest)
    for n in reversed(names):
        split = F.when(place <= F.col(f"_{n}"), n).otherwise(split)
    return out.withColumn("split", split).select(*df.columns, "split")


def train_test_split(
    df: DataFrame, key: Sequence[str], test_size: float = 0.25, seed: int = 0
) -> DataFrame:
    """Exactly ``ceil(test_size * rows)`` rows held out, in seeded order."""
    return _quota_split(
        df, key, seed, F.lit(0), lambda n: [("test", F.ceil(n * F.lit(test_size)))], "train"
    )


def stratified_split(
    df: DataFrame,
    key: Sequence[str],
    label: str,
    fractions: Mapping[str, float] | None = None,
    seed: int = 0,
) -> DataFrame:
    """Each label divided by the fractions.

    Shares are cut at rounded cumulative counts, so that every row gets one
    split and each share is within one row of its fraction.
    """
    # The shares of the splits.
    fractions = fractions or {"train": 0.8, "test": 0.1, "validation": 0.1}
    *names, rest = fractions

    def quotas(n: Column) -> list[tuple[str, Column]]:
        total, out = 0.0, []
        for name in names:
            total += fractions[name]
            out.append((name, F.floor(n * F.lit(round(total, 9)) + F.lit(0.5))))
        return out

    # NULL labels are a group of their own.
    group = F.coalesce(F.col(label).cast("string"), F.lit("\u0000"))
    return _quota_split(df, key, seed, group, quotas, rest)


def text_batches(sent: DataFrame, n: int = 1000) -> DataFrame:
    """Texts in corpus order, ``n`` to a batch."""
    rows = indexed_table(sent.select("doc_id", "six", "sent"), ["doc_id", "six"])
    batch = F.floor(F.col("idx") / n).alias("batch_id")
    return (
        rows.groupBy(batch)
        .agg(F.array_sort(F.collect_list(F.struct("idx", "sent"))).alias("_rows"))
        .select("batch_id", F.col("_rows.sent").alias("texts"))
    )


def vocab_target(vocab: DataFrame, add_portion: float = 0.5) -> DataFrame:
    prev = F.count("*")
    return vocab.agg(
        prev.alias("prev"), (prev + F.floor(prev * F.lit(add_portion))).alias("total")
    )


def word_freq(sent: DataFrame) -> DataFrame:
    return (
        split_words(sent).groupBy(F.col("value").alias("word")).agg(F.count("*").alias("freq"))
    )


def pair_freq(word_freq: DataFrame) -> DataFrame:
    """Adjacent symbols, weighted by word frequency: counted over distinct
    words, not over the text."""
    chars = F.regexp_extract_all("word", F.lit(r"(?s)."), F.lit(0))
    pairs = F.zip_with(
        F.slice("_c", F.lit(1), F.size("_c") - 1),
        F.slice("_c", F.lit(2), F.size("_c") - 1),
        lambda a, b: F.struct(a.alias("left"), b.alias("right")),
    )
    return (
        word_freq.select("freq", chars.alias("_c"))
        .filter(F.size("_c") > 1)
        .select("freq", F.explode(pairs).alias("_p"))
        .groupBy(F.col("_p.left").alias("left"), F.col("_p.right").alias("right"))
        .agg(F.sum("freq").alias("freq"))
    )


def _bits(words: DataFrame, size: int) -> np.ndarray:
    """``size`` bits with two set for each word, at places that its checksum gives."""
    slot = F.explode(F.transform(F.array(*_places(F.crc32("token"), size)), lambda x: x + 1))  # bitmaps count from 1
    parts = words.select(slot.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")
    )
    out = np.zeros(size // 8, np.uint8)
    for part, bits in parts.collect():
        out[(part - 1) * len(bits) : part * len(bits)] = np.frombuffer(bits, np.uint8)
    return out


def _places(checksum, size: int) -> list:
    """Two places below ``size``, a power of two, for columns or arrays of checksums."""
    return [checksum % size, checksum * 1640531527 % 4294967291 % size]


def _maybe(words: pa.Array, bits: np.ndarray) -> np.ndarray:
    """Whether the words may be among those of the bits; surely not where False."""
    sums = np.array([zlib.crc32(w) for w in words.cast(pa.binary()).to_pylist()], np.int64)
    first, second = (bits[at >> 3] >> (at & 7) & 1 for at in _places(sums, 8 * len(bits)))
    return (first & second).astype(bool)


def encode_tokens(
    sent: DataFrame, vocab: DataFrame, unk_id: int = SPECIAL_IDS["unk"],
    special: tuple[int, int] | None = (SPECIAL_IDS["cls"], SPECIAL_IDS["sep"]),
    head: int = HEAD_WORDS,
) -> DataFrame:
    """Sentences as vocabulary ids with the word index of each.

    ``vocab`` is (token, id), with ``n``, the tokens' numbers, where they are
    known. Tasks hold at most ``head`` of the most frequent words and
    look tokens up in place, so these never move. In a larger vocabulary the
    tokens beyond the head, none of them frequent, are joined and put back by
    position; bits for the words of the tail tell them from tokens of no
    vocabulary, which may be frequent. The result is the same for any head. Special ids at both ends
    have no word index.
    """
    words = vocab.select("token", "id")
    whole = words.limit(head + 1).count() <= head
    rows = sent.select("doc_id", "six", "sent").filter("sent IS NOT NULL")
    if not whole:
        if "n" not in vocab.columns:
            counts = split_words(sent).groupBy(F.col("value").alias("token")).agg(F.count("*").alias("n"))
            vocab = words.join(counts, "token", "left").na.fill(0, ["n"])
        # Classes of numbers, a sixteenth of a doubling wide, from the top while there
        # is room: some hundred of them, whatever the vocabulary.
        width = F.floor(F.log2(F.col("n") + 1) * 16).cast("int")
        room, cut, tail = head, None, 0
        for row in vocab.groupBy(width.alias("c")).count().orderBy(F.desc("c")).collect():
            room -= row["count"]
            if room < 0:
                tail += row["count"]
            else:
                cut = row.c
        often = width >= cut if cut is not None else F.lit(False)
        frequent = vocab.filter(often).select("token", "id")
        words = vocab.filter(~often).select("token", "id")
    table = (words if whole else frequent).toArrow()
    bits = None if whole else _bits(words, min(max(1 << (8 * tail).bit_length(), LEAST_BITS), MOST_BITS))
    shared = sent.sparkSession.sparkContext.broadcast(
        (table.column("token").combine_chunks(), table.column("id").to_numpy(), bits)
    )
    first, last = special or (None, None)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, ids, bits = shared.value
        ids = np.append(ids, unk_id).astype(np.int32)
        # A look-up builds the index of the words anew, so it covers many rows.
        for batch in gathered(batches, LOOK_UP):
            pieces = pc.split_pattern(batch.column("sent"), " ")
            coded = pieces.flatten().dictionary_encode()
            of, seen = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
            at = pc.fill_null(pc.index_in(seen, value_set=tokens), len(ids) - 1).to_numpy(zero_copy_only=False)
            start = pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
            size = np.diff(start)
            found = ids[at][of]
            within = np.arange(len(found)) - np.repeat(start[:-1], size)
            ends = np.zeros(0, np.int64)
            if special is not None:
                start = start + 2 * np.arange(len(start))
                ends = np.concatenate([start[:-1], start[1:] - 1])
            flat = np.zeros(start[-1], np.int32)
            inner = np.ones(start[-1], bool)
            inner[ends] = False
            flat[inner] = found
            index = np.zeros(start[-1], np.int32)
            index[inner] = within
            if special is not None:
                flat[start[:-1]], flat[start[1:] - 1] = first, last
            lists = [
                pa.ListArray.from_arrays(pa.array(start, pa.int32()), values)
                for values in (pa.array(flat), pa.array(index, mask=~inner))
            ]
            if bits is not None:
                # Tokens that the tail may know, and their positions in the ids.
                far = np.flatnonzero(at == len(ids) - 1)
                far = np.isin(of, far[_maybe(seen.take(pa.array(far)), bits)])
                far_start = np.concatenate([[0], np.cumsum(far)])[pieces.offsets.to_numpy() - pieces.offsets[0].as_py()]
                place = within[far] + (special is not None)
                holes = pa.StructArray.from_arrays(
                    [pa.array(place, pa.int32()), seen.take(pa.array(of[far])).cast(pa.string())], ["at", "token"]
                )
                lists.append(pa.ListArray.from_arrays(pa.array(far_start, pa.int32()), holes))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), *lists], names=[*keys, *added])

    keys, added = ["doc_id", "six"], ["input_ids", "word_ids"] + ([] if whole else ["holes"])
    types = [*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keys), "input_ids array<int>", "word_ids array<int>"]
    if not whole:
        types.append("holes array<struct<at:int,token:string>>")
    encoded = rows.mapInArrow(look_up, ", ".join(types))
    out = ["doc_id", "six", "input_ids", "word_ids"]
    if whole:
        return encoded.select(*out)
    encoded = staged(encoded, "encoded")
    open_ = F.size("holes") > 0
    # A row is named by its place in the written files, as keys may repeat.
    name = [F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    rest = encoded.filter(open_).select(*out, "holes", *name)
    holes = rest.select("_file", "_row", F.inline("holes"))
    filled = (
        holes.join(words, "token")
        .groupBy("_file", "_row")
        .agg(F.map_from_entries(F.collect_list(F.struct("at", "id"))).alias("_new"))
    )
    patched = rest.join(filled, ["_file", "_row"], "left").withColumn(
        "input_ids", F.transform("input_ids", lambda x, i: F.coalesce(F.try_element_at("_new", i), x).cast("int"))
    )
    return encoded.filter(~open_).select(*out).unionByName(patched.select(*out))


def _chunks(ids: Column, size: int) -> Column:
    """Full chunks of an array; none if it is shorter than one."""

    def cut(a: Column) -> Column:
        n = F.floor(F.size(a) / size).cast("int")
        starts = F.when(n > 0, F.sequence(F.lit(0), n - 1))
        return F.transform(starts, lambda i: F.slice(a, i * size + 1, F.lit(size)))

    return fx.once(ids, cut)


def pack_sequences(enc: DataFrame, chunk_size: int = 16, batch: int = 1000) -> DataFrame:
    """Token lists of each batch of rows concatenated and cut into chunks of
    equal length; a batch's remainder is dropped.

    Batches follow corpus order, so a group never exceeds ``batch`` rows. Where ``enc``
    comes without ``word_ids``, as for masks of single tokens, none move and the
    chunks have none.
    """
    lists = [c for c in ("input_ids", "word_ids") if c in enc.columns]
    rows = indexed_table(enc.select("doc_id", "six", *lists), ["doc_id", "six"])
    batches = rows.groupBy(F.floor(F.col("idx") / batch).alias("batch_id")).agg(
        F.array_sort(F.collect_list(F.struct("idx", *lists))).alias("_r")
    )
    cut = batches.select(
        "batch_id",
        F.arrays_zip(*[_chunks(F.flatten(f"_r.{c}"), chunk_size).alias(c) for c in lists]).alias("_z"),
    )
    return cut.select("batch_id", F.posexplode("_z").alias("chunk_no", "_c")).select(
        "batch_id", "chunk_no", *[f"_c.{c}" for c in lists]
    )


def copy_labels(packed: DataFrame) -> DataFrame:
    return packed.withColumn("labels", F.col("input_ids"))


def word_index(word_ids: Column) -> Column:
    """Word number in the chunk: it grows when the word id changes, and stays
    NULL without one."""
    start = F.struct(
        F.lit(-1).alias("word"), F.lit(-1).alias("n"), F.array().cast("array<int>").alias("out")
    )

    def step(acc: Column, w: Column) -> Column:
        same = w.isNull() | (w == acc["word"])
        n = F.when(same, acc["n"]).otherwise(acc["n"] + 1)
        return F.struct(
            F.coalesce(w, acc["word"]).alias("word"),
            n.alias("n"),
            F.array_append(acc["out"], F.when(w.isNotNull(), n)).alias("out"),
        )

    return F.aggregate(word_ids, start, step, lambda acc: acc["out"])


def _draw(seed: int, epoch: int, tag: str, i: Column) -> Column:
    """Uniform draw in [0, 1) fixed by chunk and position, the same in any SQL
    engine."""
    key = F.concat_ws(
        ":", F.lit(f"{seed}:{epoch}:{tag}"), F.col("batch_id").cast("string"),
        F.col("chunk_no").cast("string"), i.cast("string"),
    )
    return F.conv(F.substring(F.md5(key), 1, 10), 16, 10).cast("bigint") / F.lit(float(1 << 40))


def _below(p: float, seed: int, epoch: int, tag: str, size: Column) -> Column:
    """Whether ``_draw`` is below ``p`` at each of ``size`` positions, as an array: a
    digest for every token, which an expression per element takes long for."""
    first, least = f"{seed}:{epoch}:{tag}".encode(), p * (1 << 40)

    @F.arrow_udf("array<boolean>")
    def run(rest: pa.Array, size: pa.Array) -> pa.Array:
        n = pc.fill_null(size, 0).to_numpy(zero_copy_only=False)
        ends = [b":%d" % i for i in range(int(n.max(initial=0)))]
        drawn = bytearray()
        for key, k in zip(rest.cast(pa.binary()).to_pylist(), n.tolist(), strict=True):
            key = first + key
            for end in ends[:k]:
                drawn += hashlib.md5(key + end).digest()[:5]
        high = np.frombuffer(drawn, np.uint8).reshape(-1, 5) @ 256.0 ** np.arange(4, -1, -1)
        start = np.concatenate([[0], np.cumsum(n)])
        return pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.array(high < least))

    rest = F.concat_ws(":", F.lit(""), F.col("batch_id").cast("string"), F.col("chunk_no").cast("string"))
    return run(rest, size)


def mask_whole_word(
    packed: DataFrame, p: float = 0.15, mask_id: int = SPECIAL_IDS["mask"], seed: int = 0,
    epoch: int = 0,
) -> DataFrame:
    """All pieces of a drawn word become the mask id and keep their label."""
    d = copy_labels(packed) if "labels" not in packed.columns else packed
    d = d.withColumn("_w", word_index(F.col("word_ids")))
    hit = F.transform(
        "_w", lambda w: F.coalesce((_draw(seed, epoch, "word", w) < p) & w.isNotNull(), F.lit(False))
    )
    d = d.withColumn("_hit", hit)
    return d.select(
        "batch_id",
        "chunk_no",
        F.zip_with("input_ids", "_hit", lambda x, h: F.when(h, F.lit(mask_id)).otherwise(x)).alias(
            "input_ids"
        ),
        F.zip_with("labels", "_hit", lambda x, h: F.when(h, x).otherwise(F.lit(IGNORED))).alias(
            "labels"
        ),
    )


def mask_tokens(
    packed: DataFrame, vocab_size: int, p: float = 0.15, mask_id: int = SPECIAL_IDS["mask"],
    seed: int = 0, epoch: int = 0, special_ids: Sequence[int] = tuple(SPECIAL_IDS.values()),
) -> DataFrame:
    """Single tokens drawn with probability ``p``: 80 % become the mask id,
    10 % a random id, 10 % stay; special ids are never drawn."""
    d = copy_labels(packed) if "labels" not in packed.columns else packed
    d = d.withColumn("_low", _below(p, seed, epoch, "token", F.size("input_ids")))
    d = d.withColumn("_hit", F.zip_with("input_ids", "_low", lambda x, low: low & ~x.isin(*special_ids)))

    def replaced(x: Column, i: Column) -> Column:
        kind = _draw(seed, epoch, "kind", i)
        rand = F.floor(_draw(seed, epoch, "id", i) * vocab_size).cast("int")
        new = F.when(kind < 0.8, F.lit(mask_id)).when(kind < 0.9, rand).otherwise(x)
        return F.when(F.get("_hit", i), new).otherwise(x)

    return d.select(
        "batch_id",
        "chunk_no",
        F.transform("input_ids", replaced).alias("input_ids"),
        F.zip_with("labels", "_hit", lambda x, h: F.when(h, x).otherwise(F.lit(IGNORED))).alias(
            "labels"
        ),
    )


def steps_per_epoch(df: DataFrame, batch_size: int = 32) -> DataFrame:
    return df.agg(F.floor(F.count("*") / batch_size).cast("bigint").alias("steps"))


def one_hot(df: DataFrame, col: str, categories: Sequence[str], name: str) -> DataFrame:
    """Fixed categories; a value outside them has no bit set."""
    bits = [F.coalesce((F.col(col) == c).cast("int"), F.lit(0)) for c in categories]
    return df.withColumn(name, F.array(*bits))


def one_hot_topic(df: DataFrame, categories: Sequence[str] = TOPICS, col: str = "topic") -> DataFrame:
    return one_hot(df, col, categories, "top")


def one_hot_emotion(
    df: DataFrame, categories: Sequence[str] = EMOTIONS, col: str = "emotion"
) -> DataFrame:
    return one_hot(df, col, categories, "emot")


def label_index(df: DataFrame, labels: Sequence[str] = LABELS, col: str = "label") -> DataFrame:
    """0-based position of the label; NULL for an unknown one."""
    pos = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(col))
    return df.withColumn("label_idx", F.when(pos > 0, pos - 1).cast("int"))


def propagate_labels(reviews: DataFrame) -> DataFrame:
    """Each sentence of a review with the review's topic, emotion and label.

    A review keeps its unterminated tail.
    """
    pieces = F.transform(F.split("text", r"(?<=[.!?])"), lambda s: F.trim(s))
    return reviews.select(
        F.explode(F.filter(pieces, lambda s: s != "")).alias("sent"), "topic", "emotion", "label"
    )

