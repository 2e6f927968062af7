"""Language identification by compression.

One raw-content zstandard dictionary per language; a text belongs to the
language whose dictionary makes it smallest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import arrays as ar
from textloom.session import staged

UNKNOWN = "und"



@dataclass(frozen=True)
class Params:
    """``samples`` excerpts of ``excerpt`` characters form a dictionary, at most
    one from each of as many hash classes of the labelled rows of a language:
    this bounds what is learned from, and is the same at every corpus size.
    Texts are compressed in blocks of ``block`` bytes at ``level``, in lower case
    and with a space for every ASCII character that is no letter. A text is
    rejected when the best two languages differ by less than ``margin`` of the
    best size."""

    samples: int = 64
    excerpt: int = 1500
    block: int = 1024
    level: int = 6
    margin: float = 0.003


@dataclass(frozen=True)
class Model:
    """Dictionary contents by language, the most frequent language first."""

    contents: dict[str, bytes] = field(default_factory=dict)
    params: Params = Params()


_FOLD = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def folded(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace").translate(_FOLD)


def fit(docs: DataFrame, params: Params | None = None) -> Model:
    """Dictionaries from rows with lang and text; other rows teach nothing.

    The number of languages is that of the values of ``lang``; each brings at
    most ``samples * excerpt`` characters to the driver.
    """
    params = params or Params()
    known = docs.filter("lang is not null and text is not null").select(
        "lang", "text", F.xxhash64("doc_id", "text").alias("draw")
    )
    parts = F.pmod("draw", F.lit(params.samples))
    chosen = staged(known.groupBy("lang", parts.alias("part")).agg(
        F.min("draw").alias("draw"), F.count("*").alias("n")
    ), "chosen")
    room = F.greatest(F.length("text") - params.excerpt, F.lit(0)) + 1
    start = F.pmod(F.shiftright("draw", 8), room).cast("int") + 1
    excerpts = (
        known.join(chosen.select("lang", "draw"), ["lang", "draw"])
        .select("lang", "draw", F.substring("text", start, F.lit(params.excerpt)).alias("text"))
        .dropDuplicates(["lang", "draw"])
        .collect()
    )
    count = {r["lang"]: r["n"] for r in chosen.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    contents: dict[str, bytes] = {}
    for row in sorted(excerpts, key=lambda r: (-count[r.lang], r.lang, r.draw)):
        contents[row.lang] = contents.get(row.lang, b"") + folded(row.text) + b" "
    return Model(contents, params)


class _Encoders:
    """Compressors of one task, one per language."""

    def __init__(self, model: Model):
        self.langs = list(model.contents)
        self.block = model.params.block
        level = model.params.level
        self.all = []
        for lang in self.langs:
            words = zstandard.ZstdCompressionDict(model.contents[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(level=level)
            settings = zstandard.ZstdCompressionParameters.from_level(
                level, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS
            )
            self.all.append(zstandard.ZstdCompressor(dict_data=words, compression_params=settings))

    def sizes(self, data: bytes) -> np.ndarray:
        """Compressed size of all of ``data`` in each language."""
        blocks = [data[i : i + self.block] for i in range(0, len(data), self.block)]
        return np.array([sum(len(c.compress(b)) for b in blocks) for c in self.all], float)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Adds lang_pred, score and rejected to every row of ``docs``.

    ``lang_pred`` is the language of the smallest encoding (ties: the more
    frequent one), ``und`` for a null text, one without a letter, or a model without
    languages. ``score`` (0 to 1) weighs the sizes as code lengths per block
    and is 0 for ``und``. ``rejected``: ``und``, or a narrow margin. Columns of
    these names are replaced; all others pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = ("lang_pred", "score", "rejected")
    names = [c for c in docs.columns if c not in added]
    kept = docs.select(*names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = _Encoders(shared.value)
        margin = shared.value.params.margin
        for batch in batches:
            pred, score, rejected = [], [], []
            has = pc.match_substring_regex(pc.fill_null(batch.column("text"), ""), r"\p{L}").to_pylist()
            for data, letter in zip(ar.texts(batch), has, strict=True):
                best, sure, no = UNKNOWN, 0.0, True
                if letter and encoders.langs:
                    sizes = encoders.sizes(folded(data.as_py().decode("utf-8", "replace")))
                    at = int(sizes.argmin())
                    best = encoders.langs[at]
                    # Relative differences of size, as steps of one part in a hundred.
                    sure = float(1 / np.exp(-(sizes - sizes[at]) / sizes[at] * 100).sum())
                    rest = np.delete(sizes, at)
                    no = bool(len(rest) and rest.min() - sizes[at] < margin * sizes[at])
                pred.append(best)
                score.append(sure)
                rejected.append(no)
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                names=[*names, *added],
            )

    return kept.mapInArrow(run, f"{schema}, lang_pred string, score double, rejected boolean")
