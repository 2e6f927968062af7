"""Readers of raw corpora: XML, wiki dumps, crawl JSONL, CSV, id lists.

Sentence readers give ``file, doc_id, six, sid, tokens``. Rows keep their
place in a file by the split they come from and their order in it, so a large
splittable file is parsed by many tasks and still numbered in order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom import schemas
from textloom.functions import markup
from textloom.functions import text as fx
from textloom.operators.ordering import dense_ids, read_indexed, running_sum
from textloom.session import staged
from textloom.sources.elements import read_elements

WIKI_MIN_BYTES = 70

# Quality warnings that keep a crawl record, and all known ones.
OK_WARNINGS = ("tiny", "short_sentences")
KNOWN_WARNINGS = ("tiny", "short_sentences", "header", "footer", "noisy")


def list_files(
    spark: SparkSession, root: str, glob: str = "*", size_limit: int | None = None
) -> DataFrame:
    """Files below a folder, if given those smaller than a limit; contents stay
    unread."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(root)
        .select("path", F.col("length").alias("size"))
    )
    return files if size_limit is None else files.filter(F.col("size") < size_limit)


def too_large(spark: SparkSession, root: str, glob: str, size_limit: int) -> DataFrame:
    """Files from the limit on, in the form of quarantined inputs."""
    large = list_files(spark, root, glob).filter(F.col("size") >= size_limit)
    return large.select(
        F.col("path").alias("file"), F.concat(F.lit("size "), F.col("size").cast("string")).alias("reason")
    )


def corrupt_reason(other: str) -> Column:
    """The corrupt record, if any; Spark only reads it beside another column."""
    seen = F.coalesce(F.col(other).cast("string") == F.lit("\u0000"), F.lit(False))
    return F.when(~seen, F.col("_corrupt"))


def good_files(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the well-formed files, and the files with a malformed row.

    As one bad element makes a file unreadable, all of its rows go. The bad files are
    a written table, whose size decides how it is joined: rows needn't gather by file.
    """
    reason = corrupt_reason(rows.columns[0])
    bad = rows.select("file", reason.alias("reason")).filter("reason IS NOT NULL")
    bad = staged(bad.groupBy("file").agg(F.max("reason").alias("reason")), "bad_files")
    good = rows.join(bad, "file", "left_anti").drop("_corrupt")
    return good, bad


def number_docs(rows: DataFrame, six: str = "six", files: DataFrame | None = None) -> DataFrame:
    """Adds ``doc_id``, one per file; ``files`` are rows that name the same files, where
    these are cheaper to read. The ids are a written table, whose size decides how it is
    joined."""
    ids = staged(dense_ids(rows if files is None else files, "file", "doc_id"), "ids")
    return rows.join(ids, "file").select(
        "file", "doc_id", six, "sid", "tokens"
    )


def _number_sentences(rows: DataFrame, order: Sequence[str] = ("_row",)) -> DataFrame:
    d = running_sum(rows, ["file"], F.col("_block"), list(order), "_six")
    return d.withColumn("six", F.col("_six").cast("int"))


def _xml_sentences(
    spark: SparkSession, path: str, ddl: str, tokens: Column, glob: str, size_limit: int | None
) -> tuple[DataFrame, DataFrame]:
    # Parsed once: numbering and the quarantine read the written rows.
    good, bad = good_files(read_elements(spark, path, "s", ddl, glob, size_limit, F.size(tokens) > 0))
    if size_limit is not None:
        bad = bad.unionByName(too_large(spark, path, glob, size_limit))
    return _ranked_sentences(good, tokens), bad


def _ranked_sentences(rows: DataFrame, tokens: Column) -> DataFrame:
    """As ``xml_sentences``, where the ranks within byte ranges are known: only the
    ranges' sizes and the files' ids are shuffled, and join by size."""
    d = rows.filter("_rank IS NOT NULL")
    sizes = staged(d.groupBy("file", "_block").agg((F.max("_rank") + 1).alias("_n")), "sizes")
    ranges = staged(sizes.join(dense_ids(sizes, "file", "doc_id"), "file"), "ids")
    before = W.partitionBy("file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    starts = ranges.select("file", "_block", "doc_id", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return d.join(starts, ["file", "_block"]).select(
        "file", "doc_id", (F.col("_start") + F.col("_rank")).cast("int").alias("six"), F.col("_id").alias("sid"),
        tokens.alias("tokens"),
    )


def xml_sentences(rows: DataFrame, tokens: Column) -> DataFrame:
    """Non-empty sentence elements, numbered within their files."""
    d = rows.select("file", "_block", "_row", F.col("_id").alias("sid"), tokens.alias("tokens"))
    d = d.filter(F.size("tokens") > 0)
    return number_docs(_number_sentences(d), files=d)


def read_tok_xml(
    spark: SparkSession, path: str, size_limit: int | None = None, glob: str = "*.xml"
) -> DataFrame:
    """Sentences ``s`` of word elements ``w``; empty sentences and malformed
    files are left out."""
    return _xml_sentences(spark, path, schemas.TOK_XML, F.col("w"), glob, size_limit)[0]


def read_sent_xml(
    spark: SparkSession, path: str, size_limit: int | None = None, glob: str = "*.xml"
) -> DataFrame:
    """Untokenised sentences, split at whitespace."""
    tokens = fx.split_whitespace("_VALUE")
    return _xml_sentences(spark, path, schemas.SENT_XML, tokens, glob, size_limit)[0]


def read_tolerant(
    spark: SparkSession, path: str, fmt: str, size_limit: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Readable sentences and the quarantined inputs with a reason.

    ``fmt`` is ``tok_xml``, ``sent_xml`` (by file), ``wiki`` (by page) or
    ``crawl`` (by line). XML files from a size limit on are quarantined unread.
    """
    if fmt == "wiki":
        pages, bad = _wiki_pages(spark, path, "*.xml", size_limit)
        return _wiki_sentences(pages, WIKI_MIN_BYTES, markup.first_arg), bad
    if fmt == "crawl":
        rows = (
            spark.read.schema(schemas.CRAWL + ", _corrupt string")
            .option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt")
            .json(path)
            .select("*", F.col("_metadata.file_path").alias("file"))
        )
        rows = rows.withColumn("reason", corrupt_reason("content")).drop("_corrupt")
        bad = rows.filter("reason IS NOT NULL").select("file", "reason")
        return rows.filter("reason IS NULL").drop("reason"), bad
    ddl, tokens = {
        "tok_xml": (schemas.TOK_XML, F.col("w")),
        "sent_xml": (schemas.SENT_XML, fx.split_whitespace("_VALUE")),
    }[fmt]
    return _xml_sentences(spark, path, ddl, tokens, "*.xml", size_limit)


def _wiki_pages(spark: SparkSession, path: str, glob: str, size_limit: int | None) -> tuple[DataFrame, DataFrame]:
    """Well-formed pages, and the malformed ones by file and reason."""
    pages = read_elements(spark, path, "page", schemas.WIKI_PAGE, glob, size_limit)
    bad = pages.filter("_corrupt IS NOT NULL").select("file", F.col("_corrupt").alias("reason"))
    if size_limit is not None:
        bad = bad.unionByName(too_large(spark, path, glob, size_limit))
    return pages.filter("_corrupt IS NULL").drop("_corrupt"), bad


def _wiki_sentences(
    pages: DataFrame, min_bytes: int, template_fn: Callable[[str, list[str]], str] | None
) -> DataFrame:
    plain = pages.filter(F.col("revision.text._bytes") > min_bytes).select(
        "file",
        F.col("id").alias("doc_id"),
        markup.strip_markup(F.col("revision.text._VALUE"), template_fn).alias("_text"),
    )
    return plain.select(
        "file", "doc_id", F.posexplode(fx.text_sentences("_text")).alias("six", "_s")
    ).select("file", "doc_id", "six", F.col("six").cast("string").alias("sid"), fx.tokenize("_s").alias("tokens"))


def read_wiki(
    spark: SparkSession,
    path: str,
    min_bytes: int = WIKI_MIN_BYTES,
    template_fn: Callable[[str, list[str]], str] | None = markup.first_arg,
    glob: str = "*.xml",
    size_limit: int | None = None,
) -> DataFrame:
    """Sentences of the dump's pages above a size; a page is a document and
    keeps the name of its file. A malformed page is left out alone;
    ``read_tolerant`` reports it."""
    return _wiki_sentences(_wiki_pages(spark, path, glob, size_limit)[0], min_bytes, template_fn)


def read_crawl_jsonl(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Crawl records with nested metadata; a bad line fails the read."""
    return (
        spark.read.schema(schemas.CRAWL)
        .option("mode", "FAILFAST")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .json(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            "content",
            "metadata",
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_row"),
        )
    )


def filter_quality_warnings(
    crawl: DataFrame, ok: Sequence[str] = OK_WARNINGS, known: Sequence[str] = KNOWN_WARNINGS
) -> DataFrame:
    """Records whose warnings are all allowed; an unknown warning fails."""
    none = F.array().cast("array<string>")
    warnings = F.coalesce(F.col("metadata.quality_warnings"), none)
    unknown = F.array_except(warnings, F.array(*[F.lit(w) for w in known]))
    bad = F.array_except(warnings, F.array(*[F.lit(w) for w in ok]))
    keep = F.when(
        F.size(unknown) > 0,
        F.raise_error(F.concat(F.lit("unknown warnings: "), F.array_join(unknown, ","))).cast("boolean"),
    ).otherwise(F.size(bad) == 0)
    return crawl.filter(keep)


def filter_lang_prob(crawl: DataFrame, target: str, min_prob: float = 0.9) -> DataFrame:
    """Content lines identified as the target language above a probability.

    Lines and identifications pair up by position; a different number of them
    fails, a missing identification drops its line.
    """
    lines = F.split("content", "\n")
    ids = F.col("metadata.sentence_identifications")
    pairs = F.when(
        F.size(lines) == F.size(ids),
        F.arrays_zip(lines.alias("text"), ids.alias("ident")),
    ).otherwise(
        F.raise_error(
            F.concat(F.lit("lines: "), F.size(lines), F.lit(", identifications: "), F.size(ids))
        )
    )
    place = [c for c in ("_block", "_row") if c in crawl.columns]
    rows = crawl.select("file", *place, F.posexplode(pairs).alias("line_no", "_p"))
    hit = (F.col("_p.ident.label") == target) & (F.col("_p.ident.prob") > min_prob)
    return rows.filter(hit).select("file", "line_no", F.col("_p.text").alias("text"), *place)


def read_crawl(
    spark: SparkSession, path: str, target: str, min_prob: float = 0.9, glob: str = "*"
) -> DataFrame:
    return crawl_sentences(staged(read_crawl_jsonl(spark, path, glob), "parsed"), target, min_prob)


def crawl_sentences(crawl: DataFrame, target: str, min_prob: float = 0.9) -> DataFrame:
    """Kept lines as sentences, numbered through each file."""
    kept = filter_lang_prob(filter_quality_warnings(crawl), target, min_prob)
    rows = kept.select("file", "_block", "_row", "line_no", fx.tokenize("text").alias("tokens"))
    numbered = _number_sentences(rows, ("_row", "line_no"))
    return number_docs(numbered.withColumn("sid", F.col("six").cast("string")), files=rows)


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CORP_SRC).option("header", "true").csv(path)


def _csv(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return (
        spark.read.schema(ddl)
        .option("header", "true")
        .option("multiLine", "true")
        .option("escape", '"')
        .csv(path)
    )


def read_reviews(spark: SparkSession, directory: str, lang: str) -> DataFrame:
    return _csv(spark, f"{directory}/{lang}.csv", schemas.REVIEWS)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Doubly annotated rows that are complete."""
    return _csv(spark, path, schemas.ANNOTATIONS).drop("notes").dropna("any")


def read_split_ids(spark: SparkSession, directory: str) -> DataFrame:
    """Row ids with the split that their list is named after. Blank lines don't
    count; a line that is no id fails the read."""
    row_id = F.trim("value").try_cast("bigint")
    return (
        spark.read.text(f"{directory}/*.txt")
        .filter(F.trim("value") != "")
        .select(
            F.when(row_id.isNotNull(), row_id)
            .otherwise(F.raise_error(F.concat(F.lit("not a row id: "), "value")).cast("bigint"))
            .alias("row_id"),
            F.regexp_extract("_metadata.file_path", r"/([^/]+)\.txt(?:/|$)", 1).alias("split"),
        )
    )


def table_scan(spark: SparkSession, name: str, cols: Sequence[str] | None = None) -> DataFrame:
    df = spark.table(name)
    return df if cols is None else df.select(*cols)


def read_dataset(spark: SparkSession, path: str, read_limit: int | None = None) -> DataFrame:
    """An exported text dataset; with a limit, its first rows in export order."""
    df = spark.read.schema(schemas.DATASET).parquet(path)
    if read_limit is None:
        return df
    placed = read_indexed(spark, path, "_idx")
    return placed.filter(F.col("_idx") < read_limit).orderBy("_idx").select("text")


#: Readers whose rows are read from a written table and follow in one stage.
WRITTEN = frozenset({"tok_xml", "sent_xml"})

# Parser plug-ins: format name to reader of (spark, path).
READERS: dict[str, Callable[..., DataFrame]] = {
    "tok_xml": read_tok_xml,
    "sent_xml": read_sent_xml,
    "wiki": read_wiki,
    "crawl": read_crawl,
}
