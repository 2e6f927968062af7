"""MinHash near-deduplication with SetSketch registers.

A document's set holds its distinct five-word shingles. Every register keeps the
smallest of a hash over the set, seen as an exponential variable and truncated to
exponentially spaced levels, so registers of parts merge by their maximum. Bands
of registers find candidates, the joint likelihood of two sketches discards what
can't be similar, and the full sets decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.llm import arrays as ar
from textloom.llm.graph import components
from textloom.session import staged

#: Elements of a set that meet all registers at once.
_BLOCK = 4096
#: Bytes of texts whose words a task hashes at once, and pairs whose sets it holds.
PIECE, PAIRS = 1 << 18, 100


@dataclass(frozen=True)
class Sketch:
    """``bands`` x ``rows`` registers of levels 0 .. q + 1 spaced by ``base``.

    With 40 bands of 4, a pair of similarity 0.75 shares none with probability
    (1 - 0.75^4)^40 = 3e-7. A pair leaves before the full sets are compared
    when its best likelihood is ``e^doubt`` times that of any similarity from
    the threshold on.
    """

    bands: int = 40
    rows: int = 4
    base: float = 1.001
    rate: float = 20.0
    q: int = (1 << 16) - 2
    percent: int = 75
    doubt: float = 16.0

    @property
    def size(self) -> int:
        return self.bands * self.rows

    def _draws(self) -> tuple[np.ndarray, np.ndarray]:
        i = np.arange(1, self.size + 1, dtype=np.uint64)
        return ar.mix(i * np.uint64(3)), ar.mix(i * np.uint64(5)) | np.uint64(1)

    def registers(self, items: np.ndarray) -> np.ndarray:
        """Registers of a set of 64-bit hashes; those of an empty set are 0."""
        flip, factor = self._draws()
        least = np.full(self.size, np.iinfo(np.uint64).max)
        for i in range(0, len(items), _BLOCK):
            drawn = (items[i : i + _BLOCK, None] ^ flip) * factor
            np.minimum(least, drawn.min(axis=0), out=least)
        if not len(items):
            return np.zeros(self.size, np.uint16)
        with np.errstate(divide="ignore"):
            level = np.floor(1 - np.log(-np.log1p(-(least + 0.5) / 2.0**64) / self.rate) / np.log(self.base))
        return np.clip(level, 0, self.q + 1).astype(np.uint16)

    def band_keys(self, registers: np.ndarray) -> np.ndarray:
        key = np.arange(1, self.bands + 1, dtype=np.uint64)
        for column in registers.reshape(self.bands, self.rows).T:
            key = ar.mix(key * np.uint64(0xA0761D6478BD642F) + column.astype(np.uint64))
        return key.view(np.int64)

    def likelihood(
        self, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, steps: int = 96
    ) -> tuple[np.ndarray, np.ndarray]:
        """Joint maximum-likelihood similarity of each pair of sketches, and by
        how much its log likelihood exceeds the best from the threshold on."""
        more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
        same = self.size - more - less
        u = (na / (na + nb))[:, None]
        v = 1 - u
        top = np.minimum(u / v, v / u)
        least = self.percent / 100
        grid = np.concatenate([np.linspace(0, least, steps, endpoint=False), np.linspace(least, 1, steps // 2)])
        j = np.minimum(grid[None, :], top)

        def chance(x: np.ndarray) -> np.ndarray:
            x = np.clip(x, 1e-12, 1)
            return -np.log1p(-x * (self.base - 1) / self.base) / np.log(self.base)

        p, m = chance(u - v * j), chance(v - u * j)
        log = more * np.log(p) + less * np.log(m) + same * np.log(np.clip(1 - p - m, 1e-12, 1))
        at = log.argmax(1)
        rows = np.arange(len(at))
        return j[rows, at], log[rows, at] - log[:, steps:].max(1)


SCHEMA = "doc_id long, n_shingles long, d1 long, d2 long, registers binary, bands array<long>"


def merge(a: bytes, b: bytes) -> bytes:
    """Registers of the union of two sets."""
    return np.maximum(np.frombuffer(a, np.uint16), np.frombuffer(b, np.uint16)).tobytes()


def sketches(docs: DataFrame, sketch: Sketch) -> DataFrame:
    """Per document: set size, a 128-bit digest of the set, registers, band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = ar.texts(batch)
            for i, j, data, offsets in ar.pieces(values, PIECE):
                _, _, hashes, bounds = ar.words(data, offsets)
                n, d1, d2, registers, bands = [], [], [], [], []
                for items in ar.shingle_sets(hashes, bounds):
                    own = sketch.registers(items)
                    n.append(len(items))
                    d1.append(int(ar.mix(items + np.uint64(1)).sum().astype(np.uint64).view(np.int64)))
                    d2.append(int(ar.mix(items * np.uint64(7)).sum().astype(np.uint64).view(np.int64)))
                    registers.append(own.tobytes())
                    bands.append(sketch.band_keys(own))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[i:j],
                        pa.array(n, pa.int64()),
                        pa.array(d1, pa.int64()),
                        pa.array(d2, pa.int64()),
                        pa.array(registers, pa.binary()),
                        pa.array(bands, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "d1", "d2", "registers", "bands"],
                )
            pa.default_memory_pool().release_unused()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def _likely(pairs: DataFrame, reps: DataFrame, sketch: Sketch) -> DataFrame:
    """Pairs (node, pivot) whose sketches leave the threshold possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(batch: pa.RecordBatch, name: str) -> np.ndarray:
            joined = b"".join(batch.column(name).to_pylist())
            return np.frombuffer(joined, np.uint16).reshape(batch.num_rows, sketch.size)

        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                na, nb = (batch.column(x).to_numpy().astype(float) for x in ("na", "nb"))
                _, doubt = sketch.likelihood(of(batch, "ra"), of(batch, "rb"), na, nb)
                fits = 100 * np.minimum(na, nb) >= sketch.percent * np.maximum(na, nb)
                keep = pa.array(fits & (doubt < sketch.doubt))
                yield batch.select(["node", "pivot"]).filter(keep)

    a = reps.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("na"), F.col("registers").alias("ra"))
    b = reps.select(F.col("doc_id").alias("pivot"), F.col("n_shingles").alias("nb"), F.col("registers").alias("rb"))
    joined = pairs.join(a, "node").join(b, "pivot")
    return joined.mapInArrow(run, "node long, pivot long").distinct()


def _confirmed(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full shingle sets are similar enough, as links (u, v)."""

    def sets(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
        found: list[np.ndarray] = []
        for _, _, data, offsets in ar.pieces(ar.texts(batch, name), PIECE):
            _, _, hashes, bounds = ar.words(data, offsets)
            found.extend(ar.shingle_sets(hashes, bounds))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PAIRS):
                batch = whole.slice(at, PAIRS)
                keep = []
                for a, b in zip(sets(batch, "ta"), sets(batch, "tb"), strict=True):
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    keep.append(both > 0 and 100 * both >= percent * (len(a) + len(b) - both))
                yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))
            pa.default_memory_pool().release_unused()

    a = docs.select(F.col("doc_id").alias("u"), F.col("text").alias("ta"))
    b = docs.select(F.col("doc_id").alias("v"), F.col("text").alias("tb"))
    named = pairs.select(F.col("node").alias("u"), F.col("pivot").alias("v"))
    return named.join(a, "u").join(b, "v").select("u", "v", "ta", "tb").mapInArrow(run, "u long, v long")


#: Slots of the map that tells a task which texts can be wanted: 512 KB.
_SLOTS = 1 << 22


def _texts_of(docs: DataFrame, named: DataFrame) -> DataFrame:
    """doc_id and text of the documents in ``named``. A bit map of their hashed
    ids, of fixed size, keeps most other texts out of the shuffle."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(_SLOTS)).alias("slot")
    used = np.zeros(_SLOTS, bool)
    used[named.select(slot).distinct().toArrow().column("slot").to_numpy()] = True
    bits = docs.sparkSession.sparkContext.broadcast(np.packbits(used))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(bits.value).astype(bool)
        for batch in batches:
            keep = wanted[batch.column("slot").to_numpy()]
            yield batch.select(["doc_id", "text"]).filter(pa.array(keep))

    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    return some.select("*", slot).mapInArrow(run, "doc_id long, text string").join(named, "doc_id", "left_semi")


#: Each turns the order of the ids into another one, whose
#: smallest member is a further pivot of every bucket.
_TURNS = (0, 0x2545F4914F6CDD1D, 0x1B873593CC9E2D51)


def _class_of(label: DataFrame, node: str, name: str) -> DataFrame:
    return label.select(F.col("node").alias(node), F.col("component").alias(name))


def _links(likely: DataFrame, texts: DataFrame, percent: int, before: DataFrame | None = None) -> DataFrame:
    """Confirmed links that join all classes which ``likely`` pairs can join,
    besides the links ``before``: each node's first pair, then the pairs that are
    not in one class yet."""
    lowest = likely.groupBy("node").agg(F.min("pivot").alias("pivot"))
    found = staged(_confirmed(lowest, texts, percent), "links")
    label = staged(components(found if before is None else found.union(before)), "classes")
    left = (
        likely.join(lowest, ["node", "pivot"], "left_anti")
        .join(_class_of(label, "node", "cn"), "node", "left")
        .join(_class_of(label, "pivot", "cp"), "pivot", "left")
        .filter("not (coalesce(cn, node) <=> coalesce(cp, pivot))")
        .select("node", "pivot")
    )
    return found.union(staged(_confirmed(left, texts, percent), "links"))


def _open(shared: DataFrame, label: DataFrame) -> DataFrame:
    """(node, class) of the members that a bucket has tested against its pivots
    only, where they are in several classes."""
    member = shared.filter("n - size(pivots) > 1 and not array_contains(pivots, node)")
    member = member.select("band", "key", "node").join(_class_of(label, "node", "class"), "node", "left")
    member = member.select("band", "key", "node", F.coalesce("class", "node").alias("class"))
    mixed = member.groupBy("band", "key").agg(F.min("class").alias("low"), F.max("class").alias("high"))
    return member.join(mixed.filter("low != high"), ["band", "key"]).select("node", "class").distinct()


def _prefix_pairs(texts: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (node, pivot) of different classes that can be similar enough.

    Every set is put in order of how rare its shingles are over ``nodes``. Of a
    pair's common shingles the first is among the first (1 - t) of the larger
    set and the first (1 - t) / (1 + t) of the smaller one, and at least the
    overlap that the lengths demand follows it in both, so that no pair is lost.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column("doc_id")
            for i, j, data, offsets in ar.pieces(ar.texts(batch), PIECE):
                _, _, hashes, bounds = ar.words(data, offsets)
                for at, items in zip(range(i, j), ar.shingle_sets(hashes, bounds), strict=True):
                    digest = int(ar.mix(items + np.uint64(1)).sum().astype(np.uint64).view(np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(items), nodes[at].as_py(), np.int64)),
                            pa.array(np.full(len(items), digest, np.int64)),
                            pa.array(np.full(len(items), len(items), np.int64)),
                            pa.array(items.view(np.int64)),
                        ],
                        names=["node", "d1", "size", "item"],
                    )

    once = texts.join(nodes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi").dropDuplicates()
    items = once.mapInArrow(run, "node long, d1 long, size long, item long").distinct().join(nodes, "node")
    items = staged(items, "items")
    count = items.groupBy("item").agg(
        F.count("*").alias("df"),
        (F.min("class") != F.max("class")).alias("mixed"),
        F.mode("class", True).alias("main"),
    )
    order = W.partitionBy("node", "d1").orderBy("df", "item")
    placed = items.join(count, "item").withColumn("at", F.row_number().over(order))
    probe = staged(placed.filter(f"mixed and at <= size - ceil({percent} * size / 100) + 1"), "prefixes")
    index = probe.filter(f"at <= size - ceil({2 * percent} * size / {100 + percent}) + 1")
    # Members of an item's largest class meet only those of other classes.
    a, b = probe.alias("a"), index.alias("b")
    fits = F.expr(
        "a.item = b.item and a.class != b.class and (b.size < a.size or b.size = a.size and b.node < a.node)"
        f" and 100 * b.size >= {percent} * a.size"
        f" and least(a.size - a.at, b.size - b.at) + 1 >= ceil({percent} * (a.size + b.size) / {100 + percent})"
    )
    pair = [F.greatest("a.node", "b.node").alias("node"), F.least("a.node", "b.node").alias("pivot")]
    other = a.filter("a.class != a.main").join(b, fits).select(*pair)
    main = a.filter("a.class = a.main").join(b.filter("b.class != b.main"), fits).select(*pair)
    return other.union(main).distinct()


def near_duplicates(docs: DataFrame, sketch: Sketch | None = None) -> DataFrame:
    """Classes of near-duplicate documents.

    Returns per row of ``docs`` (doc_id, text, any other columns): doc_id,
    n_shingles, component_id (smallest doc_id reachable over links of at least
    ``percent`` similarity) and kept (doc_id = component_id). Rows of one doc_id
    are one document. A null or wordless text has no shingles and no links. A
    null doc_id can't be named by a class: its row has a null component and is
    kept. An empty table gives no rows.

    Equal sets meet by digest and go on as one. Each bucket of a band tests its
    members against up to three pivots, not against each other, and members
    that are in a pivot's class already are not tested again, so the work is in
    proportion to the members however large a bucket is. Members of a bucket
    that are in several classes after this meet by their rarest shingles.
    """
    sketch = sketch or Sketch()
    all_rows = staged(sketches(docs, sketch), "sketches")
    # Written, so that the join below can split the rows of a very frequent set.
    sets = staged(
        all_rows.filter("n_shingles > 0 and doc_id is not null")
        .groupBy("d1", "d2", "n_shingles")
        .agg(F.min("doc_id").alias("node")),
        "nodes",
    )
    member = staged(
        all_rows.select("doc_id", "n_shingles", "d1", "d2").join(sets, ["d1", "d2", "n_shingles"], "left"),
        "members",
    )
    first = member.filter("doc_id = node").select("doc_id", "n_shingles", "d1", "d2").distinct()
    reps = staged(
        all_rows.join(first, ["doc_id", "n_shingles", "d1", "d2"], "left_semi").dropDuplicates(
            ["doc_id", "n_shingles", "d1", "d2"]
        ),
        "sets",
    )
    banded = reps.select(F.col("doc_id").alias("node"), F.posexplode("bands").alias("band", "key"))
    turned = [F.min(F.col("node").bitwiseXOR(F.lit(t))).alias(f"t{i}") for i, t in enumerate(_TURNS)]
    pivots = banded.groupBy("band", "key").agg(F.count("*").alias("n"), *turned).filter("n > 1")
    pivots = pivots.select(
        "band",
        "key",
        "n",
        F.array_distinct(
            F.array(*[F.col(f"t{i}").bitwiseXOR(F.lit(t)) for i, t in enumerate(_TURNS)])
        ).alias("pivots"),
    )
    # Written, as few registers share a bucket: later steps don't meet the others again.
    shared = staged(banded.join(pivots, ["band", "key"]), "buckets")
    pairs = (
        shared.select("node", F.explode("pivots").alias("pivot"))
        .filter("node != pivot")
        .select(F.greatest("node", "pivot").alias("node"), F.least("node", "pivot").alias("pivot"))
        .distinct()
    )
    likely = staged(_likely(pairs, reps, sketch), "pairs")
    named = likely.select(F.explode(F.array("node", "pivot")).alias("doc_id")).distinct()
    wanted = staged(_texts_of(docs, staged(named, "named")), "texts")

    # A document with several texts links whatever one of its texts links to.
    same = member.filter("doc_id != node").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    found = _links(likely, wanted, sketch.percent)
    several = same.join(
        member.filter("node is not null").groupBy("doc_id").agg(F.count_distinct("node").alias("k")).filter("k > 1"),
        F.col("u") == F.col("doc_id"),
        "left_semi",
    )
    links = staged(found.union(several), "links")
    label = staged(components(links), "classes")
    rest = staged(_open(shared, label), "open")
    if not rest.isEmpty():
        texts = staged(_texts_of(docs, rest.select(F.col("node").alias("doc_id")).distinct()), "texts")
        close = _prefix_pairs(texts, rest, sketch.percent)
        likely = staged(_likely(close, reps, sketch), "pairs")
        label = components(links.union(_links(likely, texts, sketch.percent, links)))
    final = _class_of(label, "node", "component_id")
    return (
        member.withColumn("node", F.coalesce("node", "doc_id"))
        .join(final, "node", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.coalesce("component_id", "node").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("doc_id").isNull()))
    )


def _named(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows as ``ar.nested`` has them, with an ``id`` that rows share only
    when they are equal in doc_id and text; null without doc_id. It is a hash
    that is drawn anew until no two names share one. Also (id, low): the names."""
    keyed, salt = ar.nested(docs), 0
    while True:
        hashed = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "_row", F.lit(salt)))
        named = keyed.withColumn("id", hashed)
        name = F.struct("doc_id", "_row")
        of = named.filter("id is not null").groupBy("id").agg(F.min(name).alias("low"), F.max(name).alias("high"))
        names = staged(of, "names")
        if names.filter("low != high").isEmpty():
            return named, names.select("id", "low")
        salt += 1


def drop_near_duplicates(docs: DataFrame, sketch: Sketch | None = None) -> DataFrame:
    """The documents with one row of each class of texts, that of the smallest
    doc_id (of its texts the one of the smallest hash). Rows that share a doc_id
    but not the text are different documents; of rows equal in both, that of the
    smallest hash of all columns stays. Rows without doc_id stay."""
    named, names = _named(docs)
    found = near_duplicates(named.select(F.col("id").alias("doc_id"), F.col("doc.text").alias("text")), sketch)
    classes = staged(
        found.filter("doc_id is not null").select(F.col("doc_id").alias("id"), "component_id").distinct(), "classes"
    )
    several = classes.join(names, "id").groupBy("component_id").agg(
        F.min(F.struct("low", "id")).alias("first"), F.count("*").alias("n")
    )
    dropped = classes.join(several.filter("n > 1"), "component_id").filter("id != first.id").select("id")
    rest = named.filter("id is not null").join(dropped, "id", "left_anti")
    columns = [F.col("doc").getField(c).alias(c) for c in docs.columns]
    once = rest.groupBy("id").agg(F.min_by("doc", F.xxhash64("doc")).alias("doc")).select(*columns)
    return once.unionByName(docs.filter(F.col("doc_id").cast("long").isNull()))
