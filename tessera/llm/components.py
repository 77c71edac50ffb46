"""Connected components of a link table, by contraction: links stay distributed from start to end.

In each round every node joins the neighbour (or itself) that comes first in an order by a hash that changes with
every other round; links between what then are the same node go. The number of nodes that still have links falls by a
constant factor with a new order on average, whatever the shape of the components, so long chains take few rounds too.
The second round with an order gathers what the first left around one node, so stars, of any size, take two.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import release, store


def components(links: DataFrame, scope: str = "op") -> DataFrame:
    """(node, root) for every node of links (a, b): two nodes have the same root if links connect them."""
    spark, own = links.sparkSession, f"{scope}-{uuid.uuid4().hex}"
    edges = store(_tidy(links.select("a", "b")), "links", own)
    labels = None
    round_ = 0
    while not edges.isEmpty():
        order = lambda c, r=round_ // 2: F.struct(F.xxhash64(F.lit(r), F.col(c)).alias("h"), F.col(c).alias("node"))
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(order("b")).alias("best"))
        parents = store(best.select("a", F.least(order("a"), F.col("best"))["node"].alias("parent")), "parents", own)
        if labels is None:
            labels = parents.select(F.col("a").alias("node"), F.col("parent").alias("root"))
        else:
            moved = labels.join(parents, labels["root"] == parents["a"], "left")
            labels = store(moved.select("node", F.coalesce("parent", "root").alias("root")), "labels", own)
        one = edges.join(parents, "a").select(F.col("parent").alias("x"), "b")
        two = one.join(parents.select(F.col("a").alias("b"), "parent"), "b").select(F.col("x").alias("a"), F.col("parent").alias("b"))
        edges = store(_tidy(two), "links", own)
        round_ += 1
    if labels is None:
        labels = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    labels = store(labels, "components", scope)
    release(spark, own)
    return labels


def _tidy(links: DataFrame) -> DataFrame:
    pair = links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pair.distinct()
