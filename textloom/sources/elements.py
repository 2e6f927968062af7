"""XML elements of files that many tasks read at once.

A file is cut behind every closing tag of the wanted element: the tag is the line
separator of a text read, so Spark deals byte ranges of the file to tasks and each
finds its first element by itself. What precedes a closing tag holds one element,
which an expression parses.

That is right where a closing tag ends an element: not within comments, CDATA
sections or other declarations, where elements of the name nest, or in encodings that
aren't a superset of ASCII. Files with any of these are found by the same pass and
read whole, one task a file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.session import staged

#: So many files are named in a filter of the reader that reads whole files.
NAMED_FILES = 1000
# Encodings whose ASCII characters are single bytes of that value.
PLAIN_ENCODINGS = ("", "utf-8", "utf8", "us-ascii", "ascii")


def whole_files(spark: SparkSession, path: str, tag: str, ddl: str, glob: str, size_limit: int | None) -> DataFrame:
    """One row per element at any depth, with its file and place in it. Files
    from a size limit on are not opened."""
    rows = (
        spark.read.format("xml")
        .schema(ddl)
        .option("rowTag", tag)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .option("ignoreSurroundingSpaces", "false")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(path)
    )
    if size_limit is not None:
        rows = rows.filter(F.col("_metadata.file_size") < size_limit)
    return rows.select(
        "*",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )


def _is_open(piece: Column, tag: str) -> Column:
    """Whether a piece begins with an opening tag that doesn't close itself."""
    quoted = r"""[^<>"']*+(?:"[^"]*+"[^<>"']*+|'[^']*+'[^<>"']*+)*+"""
    return piece.rlike(rf"^<{tag}(?:\s{quoted})?(?<!/)>")


def _pieces(spark: SparkSession, path: str, tag: str, glob: str, size_limit: int | None) -> DataFrame:
    """What lies before each closing tag, from opening tags on, and its marks."""
    rows = (
        spark.read.option("lineSep", f"</{tag}>")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .text(path)
    )
    if size_limit is not None:
        rows = rows.filter(F.col("_metadata.file_size") < size_limit)
    encoding = F.lower(F.regexp_extract("value", r"""^\W{0,4}<\?xml[^>]*?encoding\s*=\s*["']([^"']+)""", 1))
    strange = (
        F.col("value").contains("<!")
        | F.col("value").contains("\u0000")
        | F.col("value").rlike(rf"<\?(?!xml\s)|</{tag}\s")
        | ~encoding.isin(*PLAIN_ENCODINGS)
    )
    return rows.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.col("_metadata.file_size").alias("_size"),
        F.monotonically_increasing_id().alias("_row"),
        (F.octet_length("value") + len(f"</{tag}>")).cast("long").alias("_bytes"),
        strange.alias("_strange"),
        F.col("value").contains("</").alias("_closes"),
        F.split("value", rf"(?=<{tag}[\s>])").alias("_cut"),
    )


def _parsed(pieces: DataFrame, tag: str, ddl: str) -> DataFrame:
    last = F.element_at("_cut", -1)
    n_open = F.size(F.filter("_cut", lambda c: _is_open(c, tag)))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "ignoreSurroundingSpaces": "false"}
    element = F.from_xml(F.concat(last, F.lit(f"</{tag}>")), ddl, options)
    kind = F.when(n_open == 0, 0).when((n_open == 1) & _is_open(last, tag), 1).otherwise(2)
    return pieces.withColumn("_kind", kind).select(
        "file", "_block", "_row", "_size", "_bytes", "_strange", "_closes", "_kind",
        F.when(F.col("_kind") == 1, element).alias("_element"),
    )


def _running_rank(there: Column) -> Column:
    """The number of earlier rows of a byte range for which ``there`` is true, null for
    other rows. A task reads each of its ranges from start to end, so it counts alone."""

    @F.arrow_udf("long")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        last, n = None, 0
        for place, found in batches:
            place, found = place.to_numpy(), found.to_numpy(zero_copy_only=False)
            if not len(place):
                yield pa.array([], pa.int64())
                continue
            before = np.cumsum(found) - found
            first = np.append(True, place[1:] != place[:-1])
            base = before[first]
            if place[0] == last:
                base[0] -= n
            rank = before - base[np.cumsum(first) - 1]
            last, n = place[-1], int(rank[-1] + found[-1])
            yield pa.array(rank, pa.int64(), mask=~found)

    return run.asNondeterministic()(F.xxhash64("file", "_block"), F.coalesce(there, F.lit(False)))


def _odd_files(rows: DataFrame) -> DataFrame:
    """Files whose elements the closing tags don't tell apart.

    Each piece must hold one element, and only the rest of a file none, which no
    closing tag follows: the bytes of all pieces then exceed the file's by one tag.
    The rest closes the root, unless the one element is the root itself.
    """
    per_file = rows.groupBy("file").agg(
        F.max((F.col("_strange") | (F.col("_kind") == 2)).cast("int")).alias("strange"),
        F.count("*").alias("pieces"),
        F.count_if(F.col("_kind") == 0).alias("empty"),
        F.max_by(F.struct("_kind", "_closes"), F.struct("_block", "_row")).alias("last"),
        F.sum("_bytes").alias("bytes"),
        F.max("_size").alias("size"),
    )
    ends = (
        (F.col("empty") == 1)
        & (F.col("last._kind") == 0)
        & (F.col("bytes") > F.col("size"))
        & (F.col("last._closes") | (F.col("pieces") <= 2))
    )
    return per_file.filter((F.col("strange") == 1) | ~ends).select("file")


def read_elements(
    spark: SparkSession, path: str, tag: str, ddl: str, glob: str = "*.xml", size_limit: int | None = None,
    wanted: Column | None = None,
) -> DataFrame:
    """The elements ``tag`` of all files: the columns of ``ddl``, file, ``_block`` and
    ``_row`` in the order of the file, as ``whole_files`` gives them.

    The files are read once, and parsed rows are written; a second read covers odd
    files only. With ``wanted``, a condition on the columns of ``ddl``, wanted elements
    have their ``_rank`` in their byte range.
    """
    if not re.fullmatch(r"[A-Za-z_][\w.-]*", tag):
        raise ValueError(f"not an element name: {tag}")
    rank = [] if wanted is None else ["_rank"]

    def ranked(rows: DataFrame, there: Column) -> DataFrame:
        return rows.withColumn("_rank", _running_rank(there)) if rank else rows

    rows = _parsed(_pieces(spark, path, tag, glob, size_limit), tag, ddl)
    rows = ranked(rows.select("*", "_element.*"), wanted).select(*rows.columns, *rank)
    rows = staged(rows, "parsed")
    odd = staged(_odd_files(rows), "odd_files")
    cut = rows.filter("_kind = 1").select("_element.*", "file", "_block", "_row", *rank)
    names = [r.file for r in odd.limit(NAMED_FILES + 1).collect()]
    if not names:
        return cut
    cut = cut.join(odd, "file", "left_anti")
    whole = whole_files(spark, path, tag, ddl, glob, size_limit)
    if len(names) <= NAMED_FILES:
        whole = whole.filter(F.col("file").isin(names))
    else:
        whole = whole.join(odd, "file", "left_semi")
    return cut.unionByName(staged(ranked(whole, wanted), "parsed").select(cut.columns))
