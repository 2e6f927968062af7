"""Connected components over an edge table, by Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.session import staged


def _hook(edges: DataFrame, both: bool) -> DataFrame:
    """One star step: neighbours move to the smallest node near ``u``.

    ``both`` looks at all neighbours and moves the larger ones (large star);
    otherwise at the smaller ones and moves all of them (small star). The
    smallest neighbour is a combined aggregate and the join can be split, so a
    node with very many neighbours does not meet in one task.
    """
    turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    near = edges.union(turned) if both else edges.union(turned).filter("v < u")
    low = near.groupBy("u").agg(F.min("v").alias("m"))
    low = low.select("u", F.least("u", "m").alias("m"))
    moved = near.join(low, "u")
    if both:
        out = moved.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            low.select("u", F.col("m").alias("v"))
        )
    return out.filter("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v): component is the
    smallest node that can be reached. Null ends are left out; no edges give
    no rows. Rounds are written to the shared folder, so lineage stays short."""
    now = staged(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .filter("u is not null and v is not null and u != v")
        .distinct(),
        "edges",
    )
    before = None
    while True:
        sign = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if sign["n"] == 0 or sign == before:
            break
        before = sign
        now = staged(_hook(_hook(now, True), False), "edges")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
