"""A byte-level BPE vocabulary file, read once per process."""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa


@functools.cache
def _byte_names() -> dict[str, int]:
    """Byte by the printable character that stands for it in the file: printable
    bytes stand for themselves, the others follow from 256 in their order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {chr(b): b for b in printable}
    others = [b for b in range(256) if b not in names.values()]
    return names | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Tokens as bytes, merges by rank, and added tokens of a tokenizer file."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model, names = spec["model"], _byte_names()
        split = spec.get("pre_tokenizer") or {}
        plain = not spec.get("normalizer") and split.get("type") == "ByteLevel" and split.get("use_regex", True)
        flags = [t for t in spec["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"]]
        if model["type"] != "BPE" or not plain or split.get("add_prefix_space") or flags:
            raise ValueError("not a byte-level BPE of the supported form")

        def raw(token: str) -> bytes:
            return bytes(names[c] for c in token)

        ids: dict[str, int] = model["vocab"]
        self.added = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.bytes: dict[int, bytes] = {v: raw(k) for k, v in ids.items() if k.encode() not in self.added}
        self.bytes |= {v: k for k, v in self.added.items()}
        self.base = np.zeros(256, np.int32)
        for b, name in ((raw(c)[0], c) for c in names):
            self.base[b] = ids[name]
        #: (left id, right id) -> (rank, merged id)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[ids[left], ids[right]] = (rank, ids[left + right])
        self.tokens = {self.bytes[m]: m for _, m in self.merges.values()} | {
            bytes([b]): int(i) for b, i in enumerate(self.base)
        }

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one pretoken, merge by merge; for single short pieces."""
        out = [int(self.base[b]) for b in piece]
        while len(out) > 1:
            best = min(
                ((self.merges[p][0], i) for i, p in enumerate(zip(out, out[1:], strict=False)) if p in self.merges),
                default=None,
            )
            if best is None:
                break
            i = best[1]
            out[i : i + 2] = [self.merges[out[i], out[i + 1]][1]]
        return out

    def parts(self, values: pa.Array) -> tuple[pa.Array, np.ndarray, list[tuple[int, int]]]:
        """Texts cut at added tokens: the parts, the text that each belongs to,
        and for each added token the part behind it and its id."""
        n = len(values)
        found: list[tuple[int, int]] = []
        data = values.buffers()[2]
        whole = memoryview(data) if data is not None else b""
        if not any(pa.py_buffer(t).size and bytes(whole).find(t) >= 0 for t in self.added):
            return values, np.arange(n), found
        out: list[bytes] = []
        owner: list[int] = []
        for i, value in enumerate(values):
            rest = value.as_py()
            while True:
                hits = [(at, -len(t), t) for t in self.added if (at := rest.find(t)) >= 0]
                if not hits:
                    break
                at, _, token = min(hits)
                out.append(rest[:at])
                owner.append(i)
                found.append((len(out), self.added[token]))
                rest = rest[at + len(token) :]
            out.append(rest)
            owner.append(i)
        return pa.array(out, pa.binary()), np.array(owner), found


@functools.lru_cache(maxsize=4)
def load(content: str) -> Vocabulary:
    return Vocabulary(content)
