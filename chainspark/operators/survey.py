"""Consensus, drift and coverage of a corpus of steps.

``steps`` has one row per step: ``paper, date, step_pos, role, tool, version, matched, matched_db``. Counts are always
made per (role, key) first, so that a few roles never decide how the work is dealt out. Rows that stand for several
steps (``match.counted``) have their number in ``n``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.tables import dimension
from ..functions.text import period
from .corpus import outcome

LEAST_USES, LEAST_PER_PERIOD = 3, 6


def usage_key(matched: Column, tool: Column) -> Column:
    return F.coalesce(matched, F.nullif(F.lower(tool), F.lit("")))


def keyed(steps: DataFrame) -> DataFrame:
    return steps.withColumn("key", usage_key(F.col("matched"), F.col("tool")))


def weight(steps: DataFrame) -> Column:
    return F.col("n") if "n" in steps.columns else F.lit(1)


def role_counts(steps: DataFrame, *more: str) -> DataFrame:
    return keyed(steps).where("key is not null").groupBy("role", *more, "key").agg(F.sum(weight(steps)).alias("n"))


def with_stage(rows: DataFrame, roles: DataFrame) -> DataFrame:
    dim = dimension(roles.select(F.col("id").alias("role"), "stage", "substitutable"))
    stage = F.coalesce(F.when(F.col("stage").isin("acquire", "preprocess"), "reads").otherwise(F.col("stage")), F.lit("specialty"))
    return rows.join(dim, "role", "left").withColumn("stage", stage).withColumn("substitutable", F.coalesce("substitutable", F.lit(True)))


def ranked_tools(counts: DataFrame, *by: str, top_n: int | None = None) -> DataFrame:
    """Counts (``by, key, n``) with ``rank``, most used first, ties to the smaller key; at most ``top_n`` of a group."""
    order = W.partitionBy(*by).orderBy(F.desc("n"), "key")
    ranked = counts.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= top_n) if top_n else ranked


def consensus(steps: DataFrame, roles: DataFrame, least: int = LEAST_USES, top_n: int | None = None) -> DataFrame:
    """Per role: uses, leading tool, its share, and the tools ranked (``top_n`` of them at most, if given).

    ``custom`` and rare roles are left out. Without ``top_n`` the list grows with the distinct names of a role.
    """
    counts = role_counts(steps).where("role <> 'custom'")
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "key")))
    per = counts.groupBy("role").agg(F.sum("n").alias("n"), *([] if top_n else [ranked.alias("ranked")])).where(F.col("n") >= least)
    if top_n:
        per = per.join(ranked_tools(counts, "role", top_n=top_n).groupBy("role").agg(ranked.alias("ranked")), "role")
    per = per.select("role", "n", F.col("ranked")[0]["key"].alias("top"), (-F.col("ranked")[0]["m"]).alias("top_n"), F.array_join(F.transform("ranked", lambda x: F.concat(x.key, F.lit(":"), (-x.m).cast("string"))), "|").alias("tools"))
    return with_stage(per, roles).select("role", "stage", "substitutable", "n", "top", (F.col("top_n") / F.col("n")).alias("concentration"), "tools")


def version_rate(steps: DataFrame) -> DataFrame:
    """Steps and steps with a version per period."""
    dated = steps.withColumn("period", period(F.col("date"))).where("period is not null")
    return dated.groupBy("period").agg(F.count_if(F.coalesce("version", F.lit("")) != "").alias("with_version"), F.count(F.lit(1)).alias("total"))


def drift(steps: DataFrame) -> DataFrame:
    """Uses of each role in each period, zeros included, with the leading tool and its share."""
    dated = steps if "period" in steps.columns else steps.withColumn("period", period(F.col("date")))
    dated = dated.where("period is not null")
    counts = role_counts(dated.where("role <> 'custom'"), "period")
    per = counts.groupBy("role", "period").agg(F.sum("n").alias("n"), F.min(F.struct((-F.col("n")).alias("m"), "key")).alias("top"))
    grid = per.select("role").distinct().crossJoin(F.broadcast(dated.select("period").distinct()))  # roles x periods, two small dimensions
    full = grid.join(per, ["role", "period"], "left")  # roles x periods rows on both sides
    return full.select("role", "period", F.coalesce("n", F.lit(0)).alias("n"), F.col("top.key").alias("top"), (-F.col("top.m") / F.col("n")).alias("top_share"))


def powered(drifts: DataFrame, least: int = LEAST_PER_PERIOD) -> DataFrame:
    """Per role: total uses, and whether at least two periods have enough of them."""
    return drifts.groupBy("role").agg(F.sum("n").alias("total"), (F.count_if(F.col("n") >= least) >= 2).alias("powered"))


def unmatched(steps: DataFrame) -> DataFrame:
    return steps.where("tool is not null and matched is null and matched_db is null").select("tool").distinct().orderBy(F.lower("tool"), "tool")


def custom_uses(steps: DataFrame, roles: DataFrame) -> DataFrame:
    """What ``custom`` steps are called and where they stand: ``key, before, after, n``, with the stages of the steps next to them
    (null at the ends of a chain). Those of many uses are candidates for a role of their own.

    ``steps``: single steps with ``paper, step_pos, role, tool, matched``. Unnamed ones have a null key.
    """
    order = W.partitionBy("paper").orderBy("step_pos")  # the steps of one paper
    placed = with_stage(keyed(steps), roles).withColumns({"before": F.lag("stage").over(order), "after": F.lead("stage").over(order)})
    return placed.where("role = 'custom'").groupBy("key", "before", "after").agg(F.count(F.lit(1)).alias("n"))


def summary(steps: DataFrame) -> DataFrame:
    """One row about all steps. ``steps`` are single steps, or counts of them by ``paper`` and ``role`` among others."""
    n = weight(steps)
    count = lambda when: F.coalesce(F.sum(F.when(when, n)), F.lit(0))
    named = F.col("tool").isNotNull()
    return steps.agg(
        *([F.countDistinct("paper").alias("papers")] if "paper" in steps.columns else []), count(F.lit(True)).alias("steps"), count(named).alias("named"),
        F.coalesce(F.try_divide(count(named & F.col("matched").isNotNull()).cast("double"), count(named).cast("double")), F.lit(0.0)).alias("match_rate"),
        count(named & F.col("matched").isNull() & F.col("matched_db").isNotNull()).alias("named_databases"),
        F.countDistinct("role").alias("roles"),
    )


def record_labels(records: DataFrame) -> DataFrame:
    """Papers plotted, empty and too short; ``records``: ``methods_chars`` and ``steps`` (array)."""
    label = outcome(F.col("methods_chars"), F.col("steps"))
    return records.agg(*[F.count_if(label == x).alias(x) for x in ("plotted", "empty", "too_short")])


def by_step_count(records: DataFrame) -> DataFrame:
    """``records`` with ``n_steps``, longest chains first, then in run order."""
    n = F.greatest(F.coalesce(F.size("steps"), F.lit(0)), F.lit(0))
    return records.withColumn("n_steps", n).orderBy(F.desc("n_steps"), "run_ord", "rec_ord")


def role_share(drifts: DataFrame, role: str, *others: str) -> DataFrame:
    """Per period: the share of ``role`` among itself and ``others``, and whether it went on rising or falling so far."""
    chosen = F.col("role").isin(role, *others)
    per = drifts.where(chosen).groupBy("period").agg(F.sum(F.when(F.col("role") == role, F.col("n"))).alias("own"), F.sum("n").alias("all"))
    order = W.orderBy("period")  # one row a period
    shares = per.select("period", F.try_divide(F.col("own").cast("double"), F.col("all").cast("double")).alias("share"))
    change = F.signum(F.col("share") - F.lag("share").over(order))
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    signs = shares.withColumn("sign", change).withColumn("kinds", F.size(F.collect_set(F.nullif("sign", F.lit(0.0))).over(so_far)))
    return signs.select("period", "share", (F.col("kinds") <= 1).alias("monotonic"))


def role_precedence(steps: DataFrame) -> DataFrame:
    """For ordered pairs of roles: chains with both, and chains in which all of a comes before all of b.

    A chain has few roles, whatever its length: their first and last places are one row, and pairs come from it.
    """
    span = steps.groupBy("paper", "role").agg(F.min("step_pos").alias("lo"), F.max("step_pos").alias("hi"))
    spans = span.groupBy("paper").agg(F.collect_list(F.struct("role", "lo", "hi")).alias("spans"))
    one = spans.select("spans", F.explode("spans").alias("x"))
    pairs = one.select("x", F.explode(F.filter("spans", lambda y: y["role"] != F.col("x.role"))).alias("y"))
    return pairs.groupBy(F.col("x.role").alias("a"), F.col("y.role").alias("b")).agg(F.count(F.lit(1)).alias("chains"), F.count_if(F.col("x.hi") < F.col("y.lo")).alias("before"))


def ranked_drift(steps: DataFrame, top_n: int = 10) -> DataFrame:
    """The ``top_n`` most used tools of each role in each period: ``role, period, rank, key, n, share``; ties to the smaller key.

    A row a tool, ranked in a window over counts, so a role of very many names is never one row or one list.
    """
    dated = steps if "period" in steps.columns else steps.withColumn("period", period(F.col("date")))
    counts = role_counts(dated.where("period is not null and role <> 'custom'"), "period")
    total = counts.groupBy("role", "period").agg(F.sum("n").alias("all"))  # roles x periods
    return ranked_tools(counts, "role", "period", top_n=top_n).join(F.broadcast(total), ["role", "period"]).select("role", "period", "rank", "key", "n", (F.col("n") / F.col("all")).alias("share"))


def hint_inversions(steps: DataFrame, roles: DataFrame) -> DataFrame:
    """Neighbouring steps of a chain whose order hint falls."""
    dim = dimension(roles.select(F.col("id").alias("role"), "order_hint"))
    order = W.partitionBy("paper").orderBy("step_pos")
    seen = steps.join(dim, "role").withColumn("prev_role", F.lag("role").over(order)).withColumn("prev_hint", F.lag("order_hint").over(order))
    return seen.where("order_hint < prev_hint").groupBy(F.col("prev_role"), "role").agg(F.count(F.lit(1)).alias("n"))


def consensus_chains(steps: DataFrame) -> DataFrame:
    """Role sequences of chains, how many chains have each, and the share of all chains."""
    chain = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step_pos", "role"))), lambda s: s.role), ">")
    sequences = steps.groupBy("paper").agg(chain.alias("sequence")).groupBy("sequence").agg(F.count(F.lit(1)).alias("chains"))
    total = sequences.agg(F.sum("chains").alias("all"))
    return sequences.crossJoin(F.broadcast(total)).select("sequence", "chains", (F.col("chains") / F.col("all")).alias("share"))  # one row
