"""Line deduplication over overlapping windows of three lines.

Built from DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.arrays import nested, same_row
from textloom.session import staged

WINDOW = 3


def _order() -> Column:
    """Order of occurrences: by doc_id with nulls last, text hash, position."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row", "pos")


def _windows(docs: DataFrame) -> DataFrame:
    """doc_id, _row, pos and a 128-bit key for each window that is not blank."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    at = F.posexplode("lines").alias("pos", "line")
    # A window's lines are looked up beside its position, so nothing is sorted.
    three = [F.get("lines", F.col("pos") + i) for i in range(WINDOW)]
    return (
        docs.select("doc_id", "_row", lines.alias("lines"))
        .filter(F.size("lines") >= WINDOW)
        .select("doc_id", "_row", "lines", at)
        .filter(F.col("pos") <= F.size("lines") - WINDOW)
        .filter(F.concat(*three).rlike(r"\S"))
        .select(
            "doc_id",
            "_row",
            "pos",
            F.xxhash64(*three).alias("k1"),
            F.xxhash64(F.lit(1), *reversed(three)).alias("k2"),
        )
    )


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, _row, covered): for each row of ``docs`` (doc_id, _row, text) the
    positions of the lines to remove, those within any window that occurred
    before: in a document of smaller doc_id, or further up in the same one."""
    windows = staged(_windows(docs), "windows")
    first = windows.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min(_order()).alias("first"))
    first = first.filter("n > 1").select("k1", "k2", "first")
    later = windows.join(first, ["k1", "k2"]).filter(_order() != F.col("first"))
    covered = later.select("doc_id", "_row", F.explode(F.sequence("pos", F.col("pos") + WINDOW - 1)).alias("line"))
    return covered.groupBy("doc_id", "_row").agg(F.collect_set("line").alias("covered"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` stripped of repeated lines, n_lines and n_removed.

    Lines end at a line feed and count as they are. Three consecutive lines that
    are not all blank form a window; of equal windows anywhere the first one
    stays, by doc_id and position, and the lines under the others go. A document
    of fewer than three lines stays as it is, one that loses all its lines has
    an empty text, a null text stays null with 0 lines. Rows equal in doc_id and
    text are one document. Other columns pass through.
    """
    keyed = nested(docs)
    covered = repeated_lines(keyed.select("doc_id", "_row", F.col("doc.text").alias("text"))).select(
        F.col("doc_id").alias("_id"), F.col("_row").alias("_same"), "covered"
    )
    joined = keyed.join(covered, same_row(keyed), "left").withColumn("lines", F.split("doc.text", "\n", -1))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("covered"))
    text = F.when(F.col("covered").isNull(), F.col("doc.text")).otherwise(
        F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")
    )
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return joined.select(
        *[text.alias(c) if c == "text" else F.col("doc").getField(c).alias(c) for c in names],
        F.when(F.col("doc.text").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.coalesce(F.size("covered"), F.lit(0)).cast("long").alias("n_removed"),
    )


def oracle_sql() -> str:
    """The same as SQL over ``documents``."""
    return """
WITH d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
w AS (
  SELECT doc_id, i, l[i] || chr(10) || l[i + 1] || chr(10) || l[i + 2] AS k
  FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM d WHERE len(l) > 2)
),
v AS (SELECT * FROM w WHERE regexp_matches(k, '[^ \\t\\n\\v\\f\\r]')),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM v),
c AS (
  SELECT doc_id, list(DISTINCT x) AS gone
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS x FROM r WHERE n > 1) GROUP BY doc_id
),
k AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS rest
  FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM d)
  LEFT JOIN c USING (doc_id)
  WHERE gone IS NULL OR NOT list_contains(gone, i)
  GROUP BY doc_id
)
SELECT d.doc_id, CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(l) END AS BIGINT) AS n_lines,
  CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(rest, '') END AS text
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)
"""
