"""Connected components of a table of links, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.session import keep


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of a link; the label is the least node of its component.

    A round takes the least label among neighbours and then the label's own label, so a chain
    halves; every round is written, so a lost executor costs a read. A node with very many links
    meets them in joins, which Spark can split, and in minima, which are taken before the shuffle.
    """
    both = links.select(F.col(a).alias("node"), F.col(b).alias("near")).union(
        links.select(F.col(b), F.col(a))
    )
    both = keep(both, "links")
    least = F.least("node", F.min("near")).alias("label")
    labels = keep(both.groupBy("node").agg(least), "labels")
    while True:
        near = labels.select(F.col("node").alias("near"), F.col("label").alias("found"))
        found = both.join(near, "near").groupBy("node").agg(F.min("found").alias("found"))
        step = labels.join(found, "node").select("node", F.col("label").alias("old"), F.least("label", "found").alias("mid"))
        ends = labels.select(F.col("node").alias("mid"), F.col("label").alias("end"))
        new = keep(step.join(ends, "mid").select("node", "old", F.least("mid", "end").alias("label")), "labels")
        moved = new.where(F.col("old") != F.col("label")).limit(1).count()
        labels = new.select("node", "label")
        if not moved:
            return labels


def apart(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b, class_a, class_b) of those pairs whose ends are of different classes so far; a node
    that `classes` lacks is its own class."""
    of = lambda end: classes.select(F.col("node").alias(end), F.col("label").alias(f"class_{end}"))
    known = pairs.join(of("b"), "b", "left").join(of("a"), "a", "left")
    classed = known.select(
        "a", "b", F.coalesce("class_a", "a").alias("class_a"), F.coalesce("class_b", "b").alias("class_b")
    )
    return classed.where(F.col("class_a") != F.col("class_b"))


def grown(classes: DataFrame, links: DataFrame) -> DataFrame:
    """`classes` with those made one that `links` (a, b) join; only classes are nodes here, so the
    links of a large class among its own members cost nothing again."""
    between = apart(links, classes).select(F.col("class_a").alias("a"), F.col("class_b").alias("b")).distinct()
    found = components(between)
    over = found.select(F.col("node").alias("label"), F.col("label").alias("over"))
    old = classes.join(over, "label", "left").select("node", F.coalesce("over", "label").alias("label"))
    return keep(old.unionByName(found.join(classes, "node", "left_anti")), "classes")
