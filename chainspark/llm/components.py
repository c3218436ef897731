"""Connected components of a table of edges, without bringing edges or labels to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node of each node's component. ``edges``: ``a, b``, in any direction, repeats allowed.

    Each round takes the smallest label among a node's neighbours and then jumps to the label's own label, so the
    number of rounds grows with the logarithm of the diameter; a written table ends each round.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")))
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "b"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m"))
        lower = labels.join(near, "node").select("node", F.least("root", "m").alias("root"), F.col("root").alias("old"))
        heads = labels.select(F.col("node").alias("root"), F.col("root").alias("top"))
        # A label is a node of the component itself, and its own label is never larger.
        new = stored(lower.join(heads, "root").select("node", F.least("root", "top").alias("root"), "old"))
        if new.where("root <> old").isEmpty():
            return new.select("node", "root")
        labels = new.select("node", "root")


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (``node, root``) after more links ``a, b``: only the classes that the links join are worked on.

    A node that ``roots`` doesn't hold is a class of its own.
    """
    own = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    edges = links.join(own("a"), "a", "left").join(own("b"), "b", "left")
    edges = edges.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    higher = components(edges)
    known = roots.join(higher.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    new = higher.join(roots, "node", "left_anti")
    return stored(known.select("node", F.coalesce("top", "root").alias("root")).unionByName(new))
