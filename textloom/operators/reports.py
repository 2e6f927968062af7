"""Corpus statistics, sources, agreement and classification metrics."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.langstats import sents_per_doc


def corpus_stats(corp_doc: DataFrame, doc: DataFrame, sent: DataFrame) -> DataFrame:
    """(description, value) rows, one pass per table."""

    def rows(df: DataFrame, **aggs) -> DataFrame:
        one = df.agg(*[a.cast("bigint").alias(n) for n, a in aggs.items()])
        pairs = [
            F.struct(F.lit(n.replace("_", " ")).alias("description"), F.col(n).alias("value"))
            for n in aggs
        ]
        return one.select(F.inline(F.array(*pairs)))

    return (
        rows(corp_doc, corpus_sources=F.countDistinct("name"))
        .unionAll(rows(doc, documents=F.count("*")))
        .unionAll(
            rows(
                sent,
                sentences=F.count("*"),
                tokens=F.sum("toklen"),
                characters=F.sum(F.length("sent")),
            )
        )
    )


def corpus_sources(
    corp_src: DataFrame, corp_doc: DataFrame, doc: DataFrame, sent: DataFrame
) -> DataFrame:
    """Sentences by source.

    Counted per document, summed per corpus, and only then joined with the
    sources: no sentence and no hot source goes through a join.
    """
    by_name = (
        corp_doc.select("doc_id", F.col("name").alias("id"))
        .join(doc.select("doc_id"), "doc_id")
        .join(sents_per_doc(sent), "doc_id")
        .groupBy("id")
        .agg(F.sum("cnt").alias("_n"))
    )
    return (
        by_name.join(corp_src.select("id", "url"), "id")
        .groupBy(F.col("id").alias("name"))
        .agg(F.min("url").alias("url"), F.sum("_n").alias("count"))
    )


def cohen_kappa(df: DataFrame, pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Unweighted agreement per pair of columns, and the number of rows.

    All pairs share one pass over the rows; the rest works on the confusion
    counts. NULL where chance agreement is total.
    """
    cells = (
        df.select(
            F.explode(
                F.array(
                    *[
                        F.struct(
                            F.lit(n).alias("description"),
                            F.col(a).cast("string").alias("a"),
                            F.col(b).cast("string").alias("b"),
                        )
                        for n, (a, b) in pairs.items()
                    ]
                )
            ).alias("p")
        )
        .select("p.*")
        .groupBy("description", "a", "b")
        .agg(F.count("*").alias("c"))
    )
    observed = cells.groupBy("description").agg(
        F.sum("c").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0)).alias("same")
    )
    left = cells.groupBy("description", F.col("a").alias("k")).agg(F.sum("c").alias("ca"))
    right = cells.groupBy("description", F.col("b").alias("k")).agg(F.sum("c").alias("cb"))
    chance = (
        left.join(right, ["description", "k"])
        .groupBy("description")
        .agg(F.sum(F.col("ca").cast("double") * F.col("cb")).alias("e"))
    )
    n = F.col("n").cast("double")
    po = F.col("same") / n
    pe = F.coalesce("e", F.lit(0.0)) / (n * n)
    kappa = F.when(pe < 1, (po - pe) / (F.lit(1.0) - pe))
    scores = observed.join(chance, "description", "left").select(
        "description", kappa.alias("value")
    )
    total = df.agg(F.count("*").cast("double").alias("value")).select(
        F.lit("sentences").alias("description"), "value"
    )
    return total.unionByName(scores)


def toklen_histogram(sent: DataFrame, lo: int = 5, hi: int = 100, bins: int = 20) -> DataFrame:
    """Token-count bins over [lo, hi]; the last edge is closed, empty bins stay."""
    inside = sent.filter(F.col("toklen").between(lo, hi))
    num = ((F.col("toklen") - lo) * bins).cast("bigint")
    slot = F.least((num - F.pmod(num, F.lit(hi - lo))) / (hi - lo), F.lit(bins - 1))
    counts = inside.groupBy((slot.cast("int") + 1).alias("bin")).agg(F.count("*").alias("cnt"))
    width = (hi - lo) / bins
    edges = sent.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return edges.join(counts, "bin", "left").select(
        "bin",
        (F.lit(float(lo)) + (F.col("bin") - 1) * F.lit(width)).alias("lo"),
        (F.lit(float(lo)) + F.col("bin") * F.lit(width)).alias("hi"),
        F.coalesce("cnt", F.lit(0)).cast("bigint").alias("cnt"),
    )


def classification_metrics(pred: DataFrame, label: str, prediction: str) -> DataFrame:
    """Weighted, micro and macro precision, recall and F1, accuracy and count.

    Worked out from the confusion counts; a division by zero counts as 0.
    """
    cells = (
        pred.select(F.col(label).cast("string").alias("y"), F.col(prediction).cast("string").alias("p"))
        .groupBy("y", "p")
        .agg(F.count("*").alias("c"))
    )
    # Each cell counts once for its true and once for its predicted class.
    per_class = (
        cells.select(
            F.inline(
                F.array(
                    F.struct(
                        F.col("y").alias("k"),
                        F.col("c").alias("support"),
                        F.lit(0).cast("bigint").alias("predicted"),
                        F.when(F.col("y") == F.col("p"), F.col("c")).otherwise(0).alias("tp"),
                    ),
                    F.struct(
                        F.col("p").alias("k"),
                        F.lit(0).cast("bigint").alias("support"),
                        F.col("c").alias("predicted"),
                        F.lit(0).cast("bigint").alias("tp"),
                    ),
                )
            )
        )
        .groupBy("k")
        .agg(*[F.sum(c).cast("double").alias(c) for c in ("support", "predicted", "tp")])
    )

    def ratio(a, b):
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    scored = per_class.withColumns(
        {"P": ratio(F.col("tp"), F.col("predicted")), "R": ratio(F.col("tp"), F.col("support"))}
    ).withColumn("F1", ratio(F.col("P") * F.col("R") * 2, F.col("P") + F.col("R")))
    n = F.sum("support")
    micro = F.sum("tp") / n
    names = {}
    for m in ("F1", "P", "R"):
        names[f"weighted_{m}"] = F.sum(F.col(m) * F.col("support")) / n
        names[f"micro_{m}"] = micro
        names[f"macro_{m}"] = F.avg(m)
    names["accuracy"] = micro
    names["n"] = n
    one = scored.agg(*[e.alias(k) for k, e in names.items()])
    return one.select(
        F.inline(
            F.array(
                *[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in names]
            )
        )
    )
