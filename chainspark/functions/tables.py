"""Tables in the shared folder, joins with a few very frequent keys, and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key of more rows than FREQUENT may be treated apart; at most MOST_FREQUENT keys are, so their facts fit anywhere.
FREQUENT, MOST_FREQUENT = 10_000, 256
#: Rows of a table that may be broadcast.
SMALL = 50_000


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in ``spark.checkpoint.dir``: computed once, and read again when an executor is lost.

    A session that runs in one process may leave the folder unset; on a cluster that is an error.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tables-")
    df.write.parquet(path := f"{folder}/{uuid.uuid4().hex}")
    return spark.read.schema(df.schema).parquet(path)


def dimension(table: DataFrame, most: int = SMALL) -> DataFrame:
    """``table`` to be broadcast, if it has at most ``most`` rows; a larger one is joined as Spark sees fit."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def with_facts(rows: DataFrame, facts: DataFrame, keys: list[str], times: str) -> DataFrame:
    """Inner join of many rows with one fact per key; ``times``: the facts' column with the number of rows of the key.

    The facts of the most frequent keys, MOST_FREQUENT at most, are broadcast, so the rows of such a key stay where they
    are; any other key is joined by a shuffle.
    """
    top = facts.where(F.col(times) > FREQUENT).orderBy(F.desc(times), *keys).limit(MOST_FREQUENT)
    hot = written(top.withColumn("is_hot", F.lit(True)))
    marked = rows.join(F.broadcast(hot.select(*keys, "is_hot")), keys, "left")
    often = marked.where("is_hot").drop("is_hot").join(F.broadcast(hot.drop("is_hot")), keys)
    seldom = marked.where("is_hot is null").drop("is_hot").join(facts, keys)
    return often.unionByName(seldom)


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: of each node of ``a, b`` the smallest node that it is connected with.

    A round takes the smallest label around each node, then the label of that label, so rounds grow with the logarithm
    of the longest path. Each round ends in a written table; nothing but the number of changes comes to the driver.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    changed = 1
    while changed:
        seen = both.join(labels.select(F.col("node").alias("b"), F.col("root").alias("other")), "b")
        lowest = seen.groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other"))
        step = labels.join(lowest, "node").select("node", F.col("root").alias("old"), F.least("root", "other").alias("root"))
        heads = labels.select(F.col("node").alias("root"), F.col("root").alias("head"))
        new = written(step.join(heads, "root").select("node", "old", F.least("root", "head").alias("root")))
        changed = new.where("root < old").count()
        labels = new.select("node", "root")
    return labels
