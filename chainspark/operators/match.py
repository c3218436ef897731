"""Raw names to canonical ids through an alias table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import candidates, normalize


def alias_index(entries: DataFrame) -> DataFrame:
    """``key, id`` from ``pos, id, name, aliases``; of several entries with a key the later one owns it."""
    names = F.concat(F.array("id", "name"), F.coalesce("aliases", F.array().cast("array<string>")))
    keys = entries.select("pos", "id", F.explode(names).alias("alias")).withColumn("key", normalize(F.col("alias")))
    return keys.where("key <> ''").groupBy("key").agg(F.max_by("id", "pos").alias("id"))


def runs_of(names: DataFrame, column: str) -> DataFrame:
    """``column, pos, variant, key`` of the distinct names: the whole name (``pos`` -1), then runs of tokens, longest first,
    each exact and then without trailing digits (if four characters stay)."""
    raw = names.select(column).where(F.col(column).isNotNull()).distinct()
    name = F.col(column)
    whole = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(0).alias("variant"), normalize(name).alias("key")))
    exact = F.transform(candidates(name), lambda run, i: F.struct(i.alias("pos"), F.lit(0).alias("variant"), run.alias("key")))
    bare = F.transform(candidates(name), lambda run, i: F.struct(i.alias("pos"), F.lit(1).alias("variant"), F.regexp_replace(run, "[0-9]+$", "").alias("key")))
    cut = F.filter(F.arrays_zip(bare.alias("b"), exact.alias("e")), lambda x: (x.b.key != x.e.key) & (F.length(x.b.key) >= 4))
    return raw.select(column, F.explode(F.concat(whole, exact, F.transform(cut, lambda x: x.b))).alias("run")).select(column, "run.*")


def matches(names: DataFrame, index: DataFrame, column: str = "tool_raw", out: str = "matched") -> DataFrame:
    """``column, out, hit_rank`` of the distinct names, by the first of a name's runs that the index has. Rank -1 is the
    whole name. ``index``: ``key, id``, a table of aliases; Spark broadcasts it where it is small."""
    hits = runs_of(names, column).join(index, "key")
    return hits.groupBy(column).agg(F.min_by("id", F.struct("pos", "variant")).alias(out), F.min("pos").alias("hit_rank"))


def with_matches(steps: DataFrame, tools: DataFrame, databases: DataFrame, column: str = "tool_raw") -> DataFrame:
    """``steps`` with ``matched`` and ``matched_db``. Distinct names are looked up once, in both indexes together.

    A few names make up most steps: count per name first (``counted``) wherever single steps aren't needed.
    """
    both = alias_index(tools).withColumn("kind", F.lit("tool")).unionByName(alias_index(databases).withColumn("kind", F.lit("db")))
    order = F.struct("pos", "variant")
    first = lambda kind: F.min_by(F.when(F.col("kind") == kind, F.col("id")), F.when(F.col("kind") == kind, order))
    found = runs_of(steps, column).join(both, "key").groupBy(column).agg(first("tool").alias("matched"), first("db").alias("matched_db"))
    return steps.join(found, column, "left")


def counted(steps: DataFrame, *by: str, column: str = "tool_raw") -> DataFrame:
    """Steps per name and ``by``, as ``n``: what matching and counting need, in a table that doesn't grow with the steps."""
    return steps.groupBy(*by, column).agg(F.count(F.lit(1)).alias("n"))
