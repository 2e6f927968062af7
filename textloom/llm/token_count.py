"""Token counts by a compiled finite-state transducer.

The transducer reads a pretoken byte by byte and its transitions carry by how
many tokens the encoding of what was read changes. What later bytes can depend on
is finite: the longest suffix that begins a token, and the last token and count
at each place where a token may still begin. Such states are built when first
met, and their transitions are exact for every text. Distinct pretokens of many
texts run in step; the pretokens themselves come from another automaton, whose
state maps over chunks are composed by a parallel prefix scan.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import arrays as ar
from textloom.llm import pretokens
from textloom.llm.bpe import Encoder
from textloom.llm.vocabulary import Vocabulary, load

#: States that a process builds (1.3 KB each). They are built as met, so frequent
#: ones come first; a pretoken that leaves them is counted by its merges.
STATES = 1 << 15


class Suffixes:
    """Automaton of the tokens' prefixes, with links to shorter suffixes."""

    def __init__(self, tokens: dict[bytes, int]):
        self.edges: list[dict[int, int]] = [{}]
        self.depth = [0]
        token = [-1]
        for word, number in tokens.items():
            node = 0
            for b in word:
                if b not in self.edges[node]:
                    self.edges[node][b] = len(self.edges)
                    self.edges.append({})
                    self.depth.append(self.depth[node] + 1)
                    token.append(-1)
                node = self.edges[node][b]
            token[node] = number
        self.shorter = [0] * len(self.edges)
        queue = list(self.edges[0].values())
        for node in queue:
            for b, child in self.edges[node].items():
                self.shorter[child] = self.step(self.shorter[node], b)
                queue.append(child)
        self.token = token

    def step(self, node: int, b: int) -> int:
        while b not in self.edges[node]:
            if not node:
                return 0
            node = self.shorter[node]
        return self.edges[node][b]

    def chain(self, node: int) -> Iterator[int]:
        """The node and its ever shorter suffixes, the empty one last."""
        while node:
            yield node
            node = self.shorter[node]
        yield 0


#: A place where a token may begin: its distance back, the token that ends
#: there (-1 at the pretoken's start), and the count there less that of now.
Place = tuple[int, int, int]


class Transducer:
    """States are numbered from 1; 0 marks a transition that isn't built yet."""

    def __init__(self, vocabulary: Vocabulary, states: int = STATES):
        self.vocabulary = vocabulary
        self.suffixes = Suffixes(vocabulary.tokens)
        self.fits: dict[tuple[int, int], bool] = {}
        self.encoder = Encoder(vocabulary)
        self.room = states
        self.after = np.zeros(self.room * 256, np.int32)
        self.adds = np.zeros(self.room * 256, np.int8)
        self.keys: list[tuple[int, tuple[Place, ...]]] = [(0, ())]
        self.number: dict[tuple[int, tuple[Place, ...]], int] = {}
        self.start = self.intern((0, ((0, -1, 0),)))

    def intern(self, key: tuple[int, tuple[Place, ...]]) -> int:
        if key not in self.number:
            self.number[key] = len(self.keys)
            self.keys.append(key)
        return self.number[key]

    def follows(self, left: int, right: int) -> bool:
        """Whether the encoding of both tokens' bytes is the two tokens."""
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) > 1 << 20:
                self.fits.clear()
            of = self.vocabulary.bytes
            alone = of[right] if left < 0 else of[left] + of[right]
            known = self.vocabulary.encode(alone) == ([right] if left < 0 else [left, right])
            self.fits[left, right] = known
        return known

    def build(self, state: int, b: int) -> None:
        """Works out one transition."""
        node, places = self.keys[state]
        at = {d: (last, count) for d, last, count in places}
        node = self.suffixes.step(node, b)
        last = count = None
        for suffix in self.suffixes.chain(node):
            token = self.suffixes.token[suffix]
            if token >= 0:
                before = at.get(self.suffixes.depth[suffix] - 1)
                if before and self.follows(before[0], token):
                    last, count = token, before[1] + 1
                    break
        assert last is not None and count is not None
        # A suffix that no token goes on from begins no later token.
        now: list[Place] = [(0, last, 0)]
        while node and not self.suffixes.edges[node]:
            node = self.suffixes.shorter[node]
        for suffix in self.suffixes.chain(node):
            d = self.suffixes.depth[suffix]
            if d and self.suffixes.edges[suffix] and d - 1 in at:
                now.append((d, at[d - 1][0], at[d - 1][1] - count))
        self.after[state * 256 + b] = self.intern((node, tuple(now)))
        self.adds[state * 256 + b] = count

    def lengths(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each pretoken, all read in step; -1 where a pretoken leaves
        the states that there is room for."""
        order = np.argsort(starts - ends, kind="stable")
        at, size = starts[order], (ends - starts)[order]
        state = np.full(len(at), self.start, np.int64)
        count = np.zeros(len(at), np.int64)
        live = np.searchsorted(-size, -np.arange(size.max(initial=0)), "left")
        for i, k in enumerate(live):
            key = state[:k] * 256 + data[at[:k] + i]
            after = self.after[key]
            missing = np.flatnonzero((after == 0) & (state[:k] > 0))
            if len(missing):
                for x in np.unique(key[missing]).tolist():
                    if len(self.keys) < self.room:
                        self.build(x >> 8, x & 255)
                after = self.after[key]
                after[state[:k] == 0] = 0
            count[:k] += self.adds[key]
            state[:k] = after
        count[state == 0] = -1
        out = np.empty(len(at), np.int64)
        out[order] = count
        return out

    def counts(self, data: np.ndarray, begins: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text at ``offsets`` of ``data``."""
        if not len(data):
            return np.zeros(len(offsets) - 1, np.int64)
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data))
        first, which = ar.distinct_spans(data, starts, ends)
        own = self.lengths(data, starts[first], ends[first])
        out = np.flatnonzero(own < 0)
        own[out] = self.encoder.lengths(data, starts[first[out]], ends[first[out]])
        upto = np.append(0, np.cumsum(own[which]))
        return np.diff(upto[np.searchsorted(starts, offsets)])


@functools.lru_cache(maxsize=2)
def transducer(content: str) -> Transducer:
    return Transducer(load(content))


def count_tokens(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for each row of ``docs`` (doc_id, text).

    ``tokenizer`` is the path of a byte-level BPE file, read on the driver. Its
    added tokens inside a text count as one token each. A null or empty text has
    0 bytes and 0 tokens; other columns are ignored.
    """
    with open(tokenizer, encoding="utf-8") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(content.value)
        for batch in batches:
            values = ar.texts(batch)
            n_bytes = np.diff(np.frombuffer(values.buffers()[1], np.int32, len(values) + 1, values.offset * 4))
            parts, owner, added = machine.vocabulary.parts(values)
            total = np.zeros(len(values), np.int64)
            for i, j, data, offsets in ar.pieces(parts):
                np.add.at(total, owner[i:j], machine.counts(data, pretokens.byte_begins(data, offsets), offsets))
            for part, _ in added:
                total[owner[part]] += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_bytes.astype(np.int64)), pa.array(total)],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long"
    )
