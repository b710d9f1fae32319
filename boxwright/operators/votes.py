"""Votes of several sources on a row's label. A row's ballots are an array of (label, score), so no vote leaves its row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ballots(**sources: tuple[Column, Column]) -> Column:
    """An array of (source, label, score) of the sources with a label."""
    return F.array_compact(F.array(*[F.when(label.isNotNull(), F.struct(F.lit(name).alias("source"), label.alias("label"), score.cast("double").alias("score"))) for name, (label, score) in sources.items()]))


def counted(votes: Column, strong: float) -> Column:
    """(-n, label, strong) of each label, most votes first, then by label."""

    def of(label: Column) -> Column:
        own = F.filter(votes, lambda v: v["label"] == label)
        return F.struct((-F.size(own)).alias("neg"), label.alias("label"), F.size(F.filter(own, lambda v: v["score"] >= strong)).alias("strong"))

    return F.array_sort(F.transform(F.array_distinct(F.transform(votes, lambda v: v["label"])), of))


def majority(rows: DataFrame, votes: Column, strong: float = 0.7) -> DataFrame:
    """The rows with majority_label (ties to the first label), agreement_ratio, strong_agreement_count, conflict_labels, entropy; nulls without a vote."""
    r = rows.withColumn("_votes", votes).withColumn("_ranked", counted(F.col("_votes"), strong))
    total, first = F.size("_votes"), F.get("_ranked", F.lit(0))
    share = lambda x: -x["neg"] / total
    entropy = -F.aggregate("_ranked", F.lit(0.0), lambda acc, x: acc + share(x) * F.log(share(x)))
    return r.withColumns(
        {
            "majority_label": first["label"],
            "agreement_ratio": share(first),
            "strong_agreement_count": first["strong"].cast("long"),
            "conflict_labels": F.array_sort(F.transform(F.slice("_ranked", 2, F.greatest(F.size("_ranked"), F.lit(1))), lambda x: x["label"])),
            "entropy": F.when(total > 0, entropy),
        }
    ).drop("_votes", "_ranked")


def unique_winner(rows: DataFrame, votes: Column, least: int = 2) -> DataFrame:
    """The rows with winner: the label with most votes, at least so many; null on a tie."""

    def first(ranked: Column) -> Column:
        one, two = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
        return F.when((-one["neg"] >= least) & F.coalesce(two["neg"] > one["neg"], F.lit(True)), one["label"])

    # within a lambda the votes are counted once, however often the ranks are looked at and wherever Spark moves the winner
    return rows.withColumn("winner", F.get(F.transform(F.array(counted(votes, 0.0)), first), F.lit(0)))
