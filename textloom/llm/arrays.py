"""Texts of an Arrow batch as bytes, word hashes and shingles, by numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are worked on at once; a longer text is one piece.
PIECE = 1 << 21
SHINGLE = 5

#: Moduli of the two polynomials of a hash, primes just below 2^31 (each as its
#: distance from 2^31), and their bases.
_PRIMES = ((1, 0x3C6EF372), (19, 0x5BE0CD19))
_powers: dict[int, np.ndarray] = {}


def with_row_hash(docs: DataFrame, name: str = "_row") -> DataFrame:
    """Adds a hash of the text; with ``doc_id`` it names a row. Rows that agree
    in both are repeated rows and share every decision."""
    return docs.withColumn(name, F.xxhash64(F.coalesce("text", F.lit(""))))


def nested(docs: DataFrame) -> DataFrame:
    """The rows as one column ``doc``, beside doc_id and ``_row``: no column of
    ``docs`` can clash with a name that is used on the way."""
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("_row"),
    )


def same_row(named: DataFrame) -> Column:
    """Whether a row of ``nested`` is that of ``_id`` and ``_same``."""
    return named["doc_id"].eqNullSafe(F.col("_id")) & (named["_row"] == F.col("_same"))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; null counts as empty."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(text, F.lit("")), upper, upper.lower())


def rest_of_crc(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def texts(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """A text column as binary values; null is empty."""
    values = batch.column(column)
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return pc.fill_null(values.cast(pa.binary()), b"")


def pieces(values: pa.Array, size: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts: first, behind last, their bytes, their offsets."""
    _, offsets, data = values.buffers()
    n = len(values)
    if not n:
        return
    at = np.frombuffer(offsets, np.int32, n + 1, values.offset * 4).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def byte_table(separators: bytes) -> np.ndarray:
    """0 for separators, else the lower-cased byte plus 1."""
    table = np.arange(1, 257, dtype=np.uint64)
    table[65:91] += np.uint64(32)
    table[list(separators)] = 0
    return table


#: ASCII white space.
SPACES = byte_table(b"\x20\x09\x0a\x0b\x0c\x0d")


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _reduced(x: np.ndarray, off: int) -> np.ndarray:
    """``x`` below 2^63, modulo 2^31 - off."""
    low, high, off = np.uint64((1 << 31) - 1), np.uint64(31), np.uint64(off)
    for _ in range(3):
        x = (x & low) + (x >> high) * off
    return np.where(x > low - off, x - (low - off + np.uint64(1)), x)


def _power(n: int, off: int, base: int) -> np.ndarray:
    """Powers of ``base``, at least the first ``n``."""
    table = _powers.get(base, np.ones(1, np.uint64))
    while len(table) < n:
        step = np.uint64(pow(base, len(table), (1 << 31) - off))
        table = np.concatenate([table, _reduced(table * step, off)])
    _powers[base] = table
    return table


_SALT = np.uint64(0xD6E8FEB86659FD93)


def span_hashes(value: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of ``value``: a span's polynomials, modulo two primes,
    are taken from running sums and moved back to its start, so equal spans agree
    anywhere. Equal hashes are no proof of equal spans: see ``distinct_spans``."""
    out = (ends - starts).astype(np.uint64) * _SALT
    total = np.zeros(len(value) + 1, np.uint64)
    entry = value.astype(np.uint64)
    entry += np.uint64(1)
    for i, (off, base) in enumerate(_PRIMES):
        prime = (1 << 31) - off
        power = _power(len(value) + 1, off, base)
        inverse = _power(len(value) + 1, off, pow(base, -1, prime))
        term = entry * power[: len(value)]
        if len(value) >> 22:  # entries stay below 2^9, powers below 2^31
            term = (term & np.uint64((1 << 31) - 1)) + (term >> np.uint64(31)) * np.uint64(off)
        np.cumsum(term, out=total[1:])
        part = _reduced(_reduced(total[ends] - total[starts], off) * inverse[starts], off)
        out += part << np.uint64(32 * i)
    return mix(out)


#: Spans from this size on are compared one by one.
_LONG = 64


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A span of each content, and which of them each span equals, byte for byte.

    Hashes group the spans; every span is then compared with its group's first one,
    and those that differ are told apart by their bytes.
    """
    _, first, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    size, model = ends - starts, first[which]
    wrong = size != size[model]
    check = np.flatnonzero(~wrong & (model != np.arange(len(model))))
    check = check[np.argsort(-size[check], kind="stable")]
    longer = int(np.searchsorted(-size[check], -_LONG, "right"))
    for i in check[:longer].tolist():
        a, b = starts[i], starts[model[i]]
        wrong[i] = not np.array_equal(data[a : a + size[i]], data[b : b + size[i]])
    check = check[longer:]
    mine, theirs, left = starts[check], starts[model[check]], size[check]
    differs = np.zeros(len(check), bool)
    for k in range(int(left.max(initial=0))):
        m = int(np.searchsorted(-left, -k, "left"))
        differs[:m] |= data[mine[:m] + k] != data[theirs[:m] + k]
    wrong[check[differs]] = True
    own: dict[bytes, int] = {}
    more: list[int] = []
    for i in np.flatnonzero(wrong).tolist():
        content = data[starts[i] : ends[i]].tobytes()
        if content not in own:
            own[content] = len(first) + len(more)
            more.append(i)
        which[i] = own[content]
    return np.concatenate([first, np.array(more, first.dtype)]), which


def word_spans(value: np.ndarray, offsets: np.ndarray):
    """Runs of values above 0 within the texts: starts, ends, and where each text's
    runs begin (one entry more than texts)."""
    on = value != 0
    first = on.copy()
    first[1:] &= ~on[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(value)]
    first[cuts] = on[cuts]
    last = on.copy()
    last[:-1] &= ~on[1:] | first[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = SPACES):
    """Words of the texts: starts, ends, 64-bit hashes, and where each text's
    words begin (one entry more than texts)."""
    value = table[data]
    starts, ends, bounds = word_spans(value, offsets)
    return starts, ends, span_hashes(value, starts, ends), bounds


def _rolled(hashes: np.ndarray, k: int) -> np.ndarray:
    n = len(hashes) - k + 1
    total = np.full(max(n, 0), k, np.uint64)
    for j in range(k if n > 0 else 0):
        total = total * np.uint64(0xA0761D6478BD642F) + hashes[j : j + n]
    return mix(total)


def shingle_sets(
    hashes: np.ndarray, bounds: np.ndarray, k: int = SHINGLE
) -> Iterator[np.ndarray]:
    """Each text's distinct hashes of k consecutive words, ascending. A text of
    fewer words has its whole sequence as one, a text without words has none."""
    rolled = _rolled(hashes, k)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= k:
            yield np.unique(rolled[a : b - k + 1])
        else:
            yield _rolled(hashes[a:b], int(b - a))[: int(b > a)]


class HashIndex:
    """Places of distinct 64-bit keys, found for whole arrays at once."""

    def __init__(self, keys: np.ndarray):
        keys = keys.astype(np.uint64)
        self.mask = np.int64((1 << max(4, (len(keys) * 3 // 2).bit_length())) - 1)
        self.place = np.full(self.mask + 1, -1, np.int32)
        self.key = np.zeros(self.mask + 1, np.uint64)
        rest, at = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(rest):
            free = np.flatnonzero(self.place[at] < 0)
            self.place[at[free]] = rest[free]  # of several keys of a slot one stays
            won = self.place[at] == rest
            self.key[at[won]] = keys[rest[won]]
            rest, at = rest[~won], (at[~won] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return mix(keys).view(np.int64) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        keys = keys.astype(np.uint64)
        at = self._slot(keys)
        out = self.place[at]
        more = np.flatnonzero((out >= 0) & (self.key[at] != keys))
        out[more] = -1
        at = at[more]
        while len(more):
            at = (at + 1) & self.mask
            place = self.place[at]
            hit = (place >= 0) & (self.key[at] == keys[more])
            out[more[hit]] = place[hit]
            on = ~hit & (place >= 0)
            more, at = more[on], at[on]
        return out
