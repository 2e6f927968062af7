"""BPE encoding and decoding with forced boundaries.

Two bytes that stand side by side in no token mark a certain cut. A text falls
into fragments at such cuts and at pretoken boundaries; distinct fragments are
encoded once, all in step, and the results are strung together.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import arrays as ar
from textloom.llm import pretokens
from textloom.llm.vocabulary import Vocabulary, load

#: Bytes whose fragments are encoded together.
PIECE = 1 << 20
#: Rows whose ids are held as lists at once.
ROWS = 400


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        #: May the second byte follow the first inside a token?
        self.inside = np.zeros((256, 256), bool)
        for token in vocabulary.tokens:
            for a, b in zip(token, token[1:], strict=False):
                self.inside[a, b] = True
        merges = sorted((a << 32 | b, rank, to) for (a, b), (rank, to) in vocabulary.merges.items())
        keys, ranks, to = (np.array(x, np.int64) for x in zip(*merges, strict=True))
        self.to = np.zeros(len(keys), np.int64)
        self.to[ranks] = to
        self.none = len(keys)
        self.index = ar.HashIndex(keys)
        self.rank_at = np.append(ranks, self.none)
        top = max(vocabulary.bytes) + 1
        self.token_bytes = [vocabulary.bytes.get(i, b"") for i in range(top)]
        self.token_names = [str(i) for i in range(top)]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, or ``none``."""
        return self.rank_at[self.index.find(left << 32 | right)]

    def merged(self, tokens: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encodes fragments, given the tokens of their bytes and the fragment of
        each (ascending). A round merges in every fragment all places
        of its pair of the lowest rank, from the left. Returns both arrays anew."""
        if not len(tokens):
            return tokens, owner
        done_tokens, done_owner = [], []
        rank = np.full(len(tokens), self.none, np.int64)
        rank[:-1] = self.ranks(tokens[:-1], tokens[1:])
        rank[:-1][owner[:-1] != owner[1:]] = self.none
        while len(tokens):
            heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.minimum.reduceat(rank, heads)
            sizes = np.diff(np.append(heads, len(tokens)))
            best_of = np.repeat(best, sizes)
            over = best_of == self.none
            if over.any():
                done_tokens.append(tokens[over])
                done_owner.append(owner[over])
                tokens, owner, rank, best_of = (x[~over] for x in (tokens, owner, rank, best_of))
                if not len(tokens):
                    break
            hit = rank == best_of
            # Of overlapping places every other one, counted from the left.
            places = np.flatnonzero(hit)
            run = np.ones(len(places), bool)
            run[1:] = np.diff(places) != 1
            index = np.arange(len(places))
            since = index - np.maximum.accumulate(np.where(run, index, 0))
            places = places[since % 2 == 0]
            tokens[places] = self.to[rank[places]]
            gone = np.zeros(len(tokens), bool)
            gone[places + 1] = True
            new = np.zeros(len(tokens), bool)
            new[places] = True
            tokens, owner, rank, new = (x[~gone] for x in (tokens, owner, rank, new))
            again = np.flatnonzero(new | np.append(new[1:], False))
            again = again[again < len(tokens)]
            inner = again[again < len(tokens) - 1]
            rank[again] = self.none
            rank[inner] = np.where(
                owner[inner] == owner[inner + 1], self.ranks(tokens[inner], tokens[inner + 1]), self.none
            )
        tokens, owner = np.concatenate(done_tokens), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return tokens[order], owner[order]

    def spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of spans that are encoded each by itself, and the span of each id."""
        sizes = ends - starts
        owner = np.repeat(np.arange(len(starts)), sizes)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        flat = data[np.repeat(starts, sizes) + within]
        return self.merged(self.vocabulary.base[flat].astype(np.int64), owner)

    def lengths(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return np.bincount(self.spans(data, starts, ends)[1], minlength=len(starts))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts at ``offsets`` of ``data``, and where each text's begin."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        cut = pretokens.byte_begins(data, offsets)
        cut[1:] |= ~self.inside[data[:-1], data[1:]]
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        first, which = ar.distinct_spans(data, starts, ends)
        tokens, owner = self.spans(data, starts[first], ends[first])
        count = np.bincount(owner, minlength=len(first))
        begin = np.cumsum(count) - count
        per = count[which]
        ids = tokens[np.repeat(begin[which], per) + np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)]
        upto = np.append(0, np.cumsum(per))
        return ids, upto[np.searchsorted(starts, offsets)]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")

    def encode_all(self, values: pa.Array) -> Iterator[list[int]]:
        """Ids of each text, added tokens included."""
        parts, owner, added = self.vocabulary.parts(values)
        marks = dict(added)
        row, held = 0, []
        for i, j, data, offsets in ar.pieces(parts, PIECE):
            ids, at = self.encode(data, offsets)
            for k in range(i, j):
                while row < owner[k]:
                    yield held
                    row, held = row + 1, []
                if k in marks:
                    held.append(marks[k])
                held.extend(ids[at[k - i] : at[k - i + 1]].tolist())
        if len(values):
            yield held


@functools.lru_cache(maxsize=2)
def encoder(content: str) -> Encoder:
    return Encoder(load(content))


def encode_decode(docs: DataFrame, tokenizer: str, ids: bool = True, digests: bool = False) -> DataFrame:
    """Adds n_tokens, ids and decoded to every row of ``docs``.

    ``tokenizer`` is the path of a byte-level BPE file, read on the driver. A
    null text counts as empty: 0 tokens, no ids, an empty decoded text. With
    ``digests`` ids_sha256 and decoded_sha256 (lowercase hex) are added, and
    without ``ids`` the two large columns are left out. Columns of these names
    are replaced; all others pass through.
    """
    with open(tokenizer, encoding="utf-8") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())
    types = {"n_tokens": "long"}
    types |= {"ids": "array<int>", "decoded": "string"} if ids else {}
    types |= {"ids_sha256": "string", "decoded_sha256": "string"} if digests else {}
    names = [c for c in docs.columns if c not in types]
    kept = docs.select(*names)
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(content.value)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                out: dict[str, list] = {k: [] for k in types}
                for tokens in coder.encode_all(ar.texts(batch)):
                    text = coder.decode(tokens)
                    out["n_tokens"].append(len(tokens))
                    if ids:
                        out["ids"].append(tokens)
                        out["decoded"].append(text)
                    if digests:
                        joined = ",".join(map(coder.token_names.__getitem__, tokens))
                        out["ids_sha256"].append(hashlib.sha256(joined.encode()).hexdigest())
                        out["decoded_sha256"].append(hashlib.sha256(text.encode()).hexdigest())
                kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
                added = [pa.array(v, kinds.get(k, pa.string())) for k, v in out.items()]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *added], names=[*names, *types])
            pa.default_memory_pool().release_unused()

    return kept.mapInArrow(run, ", ".join([*schema, *(f"{k} {v}" for k, v in types.items())]))
