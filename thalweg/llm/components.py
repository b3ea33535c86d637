"""Connected components of links, by distributed minimum labels with pointer jumping."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, scratch, stored


def components(links: DataFrame) -> DataFrame:
    """links: (a, b) LONG -> (node, component): the smallest node reachable. Nodes without a link are absent.

    Null ends, loops and repeated links are harmless. Each node first takes the least of itself and its neighbours, and the
    links are drawn anew between the nodes taken: stars, as the callers send them, fall together to a link or none, so a
    large group is joined once for each link and not in every round. What is left is labelled in rounds: the least label
    among neighbours, then the label of that label, so paths shrink by half at least. Each round is stored. A hub's links
    are joined from two stored tables, so adaptive execution can split them.
    """
    spark = links.sparkSession
    ends = links.where("a is not null and b is not null and a <> b")
    with scratch(spark):
        once = stored(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        taken = _least_neighbours(once)
        a, b = (taken.select(F.col("node").alias(c), F.col("component").alias(t)) for c, t in (("a", "of_a"), ("b", "of_b")))
        drawn = once.join(a, "a").join(b, "b").where("of_a <> of_b").select(F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b"))
        # all of a component's nodes are joined to nodes taken, the least of which is its own
        top = _labelled(stored(drawn.distinct())).select(F.col("node").alias("component"), F.col("component").alias("top"))
        return durable(taken.join(top, "component", "left").select("node", F.coalesce("top", "component").alias("component")), keep=True)


def _least_neighbours(once: DataFrame) -> DataFrame:
    """once: distinct (a, b), a < b -> (node, component): the least of each node and its neighbours."""
    ways = F.array(F.struct(F.col("a").alias("node"), F.col("a").alias("to")), F.struct(F.col("b").alias("node"), F.col("a").alias("to")))
    return stored(once.select(F.explode(ways).alias("w")).groupBy("w.node").agg(F.min("w.to").alias("component")))


def _labelled(once: DataFrame) -> DataFrame:
    """once: distinct (a, b), a < b -> (node, component), in rounds."""
    both = stored(once.unionByName(once.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = _least_neighbours(once)
    while True:
        near = both.join(labels.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.min("component").alias("other"))
        lower = labels.join(near, "node").select("node", "component", F.least("component", "other").alias("now"))
        up = lower.select(F.col("node").alias("now"), F.col("now").alias("top"))
        now = stored(lower.join(up, "now", "left").select("node", F.col("component").alias("was"), F.coalesce(F.least("now", "top"), "now").alias("component")))
        labels = now.select("node", "component")
        if now.where("was <> component").isEmpty():
            return labels


def stars(near: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """near: which of the nodes `rows` are linked to which of `columns` -> the least node that each of either reaches."""
    of_rows, of_columns = rows.astype(np.int64), columns.astype(np.int64)
    while True:
        low = np.minimum(of_rows, np.where(near, of_columns[None, :], np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max))
        right = np.minimum(of_columns, np.where(near, low[:, None], np.iinfo(np.int64).max).min(0, initial=np.iinfo(np.int64).max))
        if (low == of_rows).all() and (right == of_columns).all():
            return low, right
        of_rows, of_columns = low, right
