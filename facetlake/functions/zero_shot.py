"""Scores of labels as column expressions: soft maximum, the best few, short names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def softmax(scores: Column) -> Column:
    """exp(x - max) / sum over an array of doubles; an empty array stays empty."""
    # What holds for a whole array is an entry of an array around it, so it is worked out once and not for each score.
    powers = F.transform(F.array(F.array_max(scores)), lambda top: F.transform(scores, lambda x: F.exp(x - top)))
    totals = F.transform(powers, lambda p: F.struct(p.alias("p"), F.aggregate(p, F.lit(0.0), lambda a, x: a + x).alias("total")))
    return F.transform(totals, lambda t: F.transform(t["p"], lambda x: x / t["total"]))[0]


def best_labels(scored: Column, k: int = 5) -> Column:
    """The ``k`` best of array<struct<label, score>>; of equals the first by name."""
    order = F.array_sort(
        scored,
        lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["label"] < b["label"], -1).when(a["label"] > b["label"], 1).otherwise(0),
    )
    return F.slice(order, 1, k)


def short_label(label: Column) -> Column:
    return F.replace(F.replace(label, F.lit("a photo of "), F.lit("")), F.lit("a "), F.lit(""))


def first_seen_union(*tags: Column) -> Column:
    """All tags in order of first appearance, without repeats; null arrays count as empty."""
    return F.array_distinct(F.concat(*[F.coalesce(t, F.array().cast("array<string>")) for t in tags]))


def block_results(probabilities: Column, blocks: dict[str, list[str]], least: float = 0.1) -> Column:
    """array<struct<category, tag, scores>>: the likeliest label of each block, the first of equals, and all above ``least``.

    ``blocks`` name the labels in the order of the probabilities; what comes after them is not read. A block that the
    probabilities do not fill has no tag and no scores.
    """
    made, start = [], 1
    for category, labels in blocks.items():
        part = F.slice(probabilities, start, len(labels))
        whole = F.size(part) == len(labels)
        names = F.array(*[F.lit(x) for x in labels])
        tag = F.when(whole, F.element_at(names, F.array_position(part, F.array_max(part)).cast("int")))
        scores = F.map_from_entries(F.filter(F.arrays_zip(names.alias("label"), part.alias("score")), lambda s: s["score"] > least))
        made.append(F.struct(F.lit(category).alias("category"), tag.alias("tag"), F.when(whole, scores).alias("scores")))
        start += len(labels)
    return F.array(*made)
