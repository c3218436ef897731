"""Archetypes of chains and their usual forms, substitutes, roles that one side leaves out, holes, judgments to renew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.tables import dimension, written


def archetypes_of(steps: DataFrame, archetypes: DataFrame) -> DataFrame:
    """``rec_id, archetype``: archetypes whose required roles a chain has all of; one without required roles needs an expected role."""
    roles = steps.groupBy("rec_id").agg(F.collect_set("role").alias("has"))
    dim = dimension(archetypes.select(F.col("id").alias("archetype"), *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("required_roles", "expected_roles")]))
    whole = (F.size("required_roles") > 0) & (F.size(F.array_except("required_roles", "has")) == 0)
    expected = (F.size("required_roles") == 0) & F.arrays_overlap("expected_roles", "has")
    return roles.join(dim, whole | expected).select("rec_id", "archetype")  # a dimension of archetypes


def orphan_roles(steps: DataFrame) -> DataFrame:
    """Per role: the share of observed and of claimed chains that have it, and the difference."""
    chains = steps.select("rec_id", "chain").distinct().groupBy("chain").agg(F.count(F.lit(1)).alias("all"))
    used = steps.select("rec_id", "chain", "role").distinct().groupBy("chain", "role").agg(F.count(F.lit(1)).alias("n"))
    shares = used.join(F.broadcast(chains), "chain").select("role", "chain", (F.col("n") / F.col("all")).alias("share"))  # two rows
    side = lambda name: F.coalesce(F.max(F.when(F.col("chain") == name, F.col("share"))), F.lit(0.0)).alias(name)
    return shares.groupBy("role").agg(side("observed"), side("claimed")).withColumn("gap", F.col("observed") - F.col("claimed"))


def stale(judgments: DataFrame, model: str, prompt_version: str) -> DataFrame:
    """Judgments of another model or prompt than the present ones; a missing name counts as another."""
    now = F.col("model").eqNullSafe(F.lit(model)) & F.col("prompt_version").eqNullSafe(F.lit(prompt_version))
    return judgments.where(~now)


def archetype_consensus(chains: DataFrame, *by: str) -> DataFrame:
    """Per archetype (and ``by``): chains, variants, the most frequent role sequence and its share; ties to the smaller one.

    ``chains``: ``archetype, sequence`` and ``by``, a row for each chain. Sequences are counted before they are ranked.
    """
    counts = chains.groupBy("archetype", *by, "sequence").agg(F.count(F.lit(1)).alias("n"))
    per = counts.groupBy("archetype", *by).agg(F.sum("n").alias("chains"), F.count(F.lit(1)).alias("variants"), F.min(F.struct((-F.col("n")).alias("m"), "sequence")).alias("top"))
    return per.select("archetype", *by, "chains", "variants", F.col("top.sequence").alias("sequence"), (-F.col("top.m") / F.col("chains")).alias("share"))


def modal_tools(uses: DataFrame, *by: str) -> DataFrame:
    """Per archetype, ``by`` and role: uses, different tools, the most used tool and its share; ties to the smaller name.

    ``uses``: ``archetype, role, key`` and ``by``, a row for each use, or counts of them in ``n``.
    """
    n = F.sum("n") if "n" in uses.columns else F.count(F.lit(1))
    place = ["archetype", *by, "role"]
    counts = uses.where("key is not null").groupBy(*place, "key").agg(n.alias("n"))
    per = counts.groupBy(*place).agg(F.sum("n").alias("uses"), F.count(F.lit(1)).alias("tools"), F.min(F.struct((-F.col("n")).alias("m"), "key")).alias("top"))
    return per.select(*place, "uses", "tools", F.col("top.key").alias("tool"), (-F.col("top.m") / F.col("uses")).alias("share"))


def substitutes(counts: DataFrame, *by: str, top_n: int | None = None) -> DataFrame:
    """Pairs of tools at one role of an archetype (and ``by``), ``a`` before ``b`` by name, with their shares of the role's uses.

    ``counts``: ``archetype, role, key, n`` and ``by``. Keys should be ids of the tool table, so a role has some dozens of
    them; ``top_n`` keeps only pairs among the most used ones. The tools of a role are one row, and its pairs come from it.
    """
    place = ["archetype", *by, "role"]
    total = counts.groupBy(*place).agg(F.sum("n").alias("all"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "key"))).alias("ranked"))
    ranked = F.slice("ranked", 1, top_n) if top_n else F.col("ranked")
    share = lambda x: -x["m"] / F.col("all")
    one = total.select(*place, "all", ranked.alias("other"), F.explode(ranked).alias("x"))
    pairs = one.select(*place, "all", "x", F.explode(F.filter("other", lambda y: y["key"] > F.col("x.key"))).alias("y"))
    return pairs.select(*place, F.col("x.key").alias("a"), F.col("y.key").alias("b"), share(F.col("x")).alias("share_a"), share(F.col("y")).alias("share_b"))


def substitution_classes(counts: DataFrame, roles: DataFrame) -> DataFrame:
    """Per archetype and role: how evenly its tools are used (entropy in bits, leading share) against what the ontology says.

    ``surprising``: tools are swapped freely where the ontology forbids it, or one has nearly all uses where it allows it.
    """
    place = ["archetype", "role"]
    total = counts.groupBy(*place).agg(F.sum("n").alias("uses"), F.count(F.lit(1)).alias("tools"), F.max("n").alias("most"), F.sum(F.col("n") * F.log2("n")).alias("logs"))
    entropy = F.round(F.log2("uses") - F.col("logs") / F.col("uses"), 9) + F.lit(0.0)
    dim = F.broadcast(roles.select(F.col("id").alias("role"), "substitutable"))  # some dozens of roles
    seen = total.join(dim, "role", "left").withColumn("substitutable", F.coalesce("substitutable", F.lit(True)))
    lead = F.col("most") / F.col("uses")
    surprising = F.when(F.col("substitutable"), lead >= 0.9).otherwise(lead < 0.5)
    return seen.select(*place, "uses", "tools", entropy.alias("entropy"), lead.alias("lead"), "substitutable", surprising.alias("surprising"))


def coverage_cells(records: DataFrame, axes: dict[str, list[str]]) -> DataFrame:
    """Every cell of the axes with ``records``, the number of records that cover it (1 where records have no ``rec_id``).
    ``records`` have an array for each axis; an empty one, or ``ANY``, covers all values.

    The axes are closed lists of some dozens of values, and so is their grid.
    """
    grid = records.sparkSession.range(1).select()
    covered = records.select((F.col("rec_id") if "rec_id" in records.columns else F.lit(0)).alias("rec_id"), *axes)
    for name, values in axes.items():
        every = F.array(*map(F.lit, values))
        grid = grid.withColumn(name, F.explode(every))
        open_ = (F.coalesce(F.size(name), F.lit(0)) <= 0) | F.array_contains(name, "ANY")
        covered = covered.withColumn(name, F.explode(F.when(open_, every).otherwise(F.array_distinct(name))))
    counts = covered.groupBy(*axes).agg(F.countDistinct("rec_id").alias("records"))
    return grid.join(counts, list(axes), "left").withColumn("records", F.coalesce("records", F.lit(0)))


def coverage_holes(records: DataFrame, axes: dict[str, list[str]]) -> DataFrame:
    """Cells of the axes that no record covers."""
    return coverage_cells(records, axes).where("records = 0").select(*axes)


def coverage_totals(records: DataFrame, axes: dict[str, list[str]]) -> DataFrame:
    """Sub-totals of coverage over each choice of axes: ``level`` counts the axes that are summed over, which are null.

    ``cells, covered, holes``: how many cells there are, with and without a record; ``most``: records of the best covered one.
    """
    cells = coverage_cells(records, axes)
    hole = F.count_if(F.col("records") == 0)
    told = cells.cube(*axes).agg(F.bit_count(F.grouping_id()).alias("level"), F.count(F.lit(1)).alias("cells"), (F.count(F.lit(1)) - hole).alias("covered"), hole.alias("holes"), F.max("records").alias("most"))
    return told.select(*axes, "level", "cells", "covered", "holes", "most")


def role_sets(steps: DataFrame, roles: list[str], *by: str) -> DataFrame:
    """``mask, n`` (and ``by``): the different sets of roles of chains, as bits by place in ``roles``, with the number of chains.

    Roles that are not listed don't count. Chains of one set are counted before anything else is done with them.
    """
    if len(roles) > 62:
        raise ValueError("at most 62 roles fit into a mask")
    bit = F.coalesce(*[F.when(F.col("role") == r, F.lit(1 << i)) for i, r in enumerate(roles)], F.lit(0)).cast("bigint")
    return steps.groupBy("rec_id", *by).agg(F.bit_or(bit).alias("mask")).groupBy("mask", *by).agg(F.count(F.lit(1)).alias("n"))


def derived_archetypes(sets: DataFrame, k: int, rounds: int = 10) -> tuple[DataFrame, list[int]]:
    """``mask, n, cluster`` of every role set, and the modes of the clusters, by k-modes over the sets.

    The ``k`` most frequent sets are the first modes. A set joins the mode from which it differs in the fewest roles (ties: the
    first mode); the roles that at least half the chains of a cluster have are its next mode. It ends when no mode changes,
    or after ``rounds``. Counts decide, so reruns and other partitions agree. The driver holds ``k`` numbers.
    """
    sets = written(sets.groupBy("mask").agg(F.sum("n").alias("n")))
    modes = [r.mask for r in sets.orderBy(F.desc("n"), "mask").limit(k).collect()]
    if not modes:
        return sets.withColumn("cluster", F.lit(0)), modes

    def assigned(modes: list[int]) -> DataFrame:
        far = F.array(*[F.struct(F.bit_count(F.col("mask").bitwiseXOR(F.lit(m))).alias("d"), F.lit(i).alias("cluster")) for i, m in enumerate(modes)])
        return sets.withColumn("cluster", F.array_min(far)["cluster"])

    for _ in range(rounds):
        has = [F.sum(F.when(F.col("mask").bitwiseAND(F.lit(1 << b)) != 0, F.col("n")).otherwise(0)).alias(f"b{b}") for b in range(62)]
        found = {r.cluster: r for r in assigned(modes).groupBy("cluster").agg(F.sum("n").alias("all"), *has).collect()}  # k rows
        new = [sum(1 << b for b in range(62) if 2 * found[i][f"b{b}"] >= found[i]["all"]) if i in found else m for i, m in enumerate(modes)]
        if new == modes:
            break
        modes = new
    return assigned(modes), modes


def archetype_contingency(clustered: DataFrame, archetypes: DataFrame, roles: list[str]) -> DataFrame:
    """``archetype, cluster, chains`` and the shares of either: how hand-written archetypes meet the clusters of role sets.

    A set belongs to each archetype whose required roles it has (``archetypes_of``), and to none (null) otherwise. Everything
    follows from the set, so sets are compared and never chains.
    """
    bit = lambda c: F.aggregate(F.coalesce(c, F.array().cast("array<string>")), F.lit(0).cast("bigint"), lambda m, r: m.bitwiseOR(F.coalesce(*[F.when(r == x, F.lit(1 << i)) for i, x in enumerate(roles)], F.lit(1 << 62)).cast("bigint")))
    dim = archetypes.select(F.col("id").alias("archetype"), bit("required_roles").alias("required"), bit("expected_roles").alias("expected"))
    mask = F.col("mask")
    fits = F.when(F.col("required") != 0, mask.bitwiseAND(F.col("required")) == F.col("required")).otherwise(mask.bitwiseAND(F.col("expected")) != 0)
    met = clustered.join(F.broadcast(dim), fits, "left")  # a dimension of archetypes
    cells = met.groupBy("archetype", "cluster").agg(F.sum("n").alias("chains"))
    of = lambda c: F.col("chains") / F.sum("chains").over(W.partitionBy(c))  # noqa: E731  a cell for each archetype and cluster
    return cells.select("archetype", "cluster", "chains", of("archetype").alias("of_archetype"), of("cluster").alias("of_cluster"))


def opaque_suites(steps: DataFrame, tools: DataFrame) -> DataFrame:
    """``rec_id`` of chains that are one call of a suite. ``tools``: ``id, kind``."""
    kinds = steps.join(tools.select(F.col("id").alias("tool"), "kind"), "tool", "left")
    suite = F.coalesce(F.col("kind") == "suite", F.lit(False))
    return kinds.groupBy("rec_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and(suite).alias("suite")).where("n = 1 and suite").select("rec_id")


def ladder_differences(datasets: DataFrame, first: DataFrame, rules: list[tuple[str, str]], otherwise: str) -> DataFrame:
    """Datasets for which the best-ranked record is another than the old ladder of rules (strategy, record) gives.

    ``first``: ``dataset_id, rec_id`` of rank 1.
    """
    old = F.coalesce(*[F.when(F.upper("strategy") == s, F.lit(r)) for s, r in rules], F.lit(otherwise))
    both = datasets.select("dataset_id", old.alias("by_rules")).join(first.select("dataset_id", F.col("rec_id").alias("by_rank")), "dataset_id", "left")
    return both.where(~F.col("by_rules").eqNullSafe(F.col("by_rank")))


def leading_periods(drifts: DataFrame) -> DataFrame:
    """First and last period in which each tool leads a role. ``drifts``: ``role, period, top``."""
    return drifts.where("top is not null").groupBy("role", "top").agg(F.min("period").alias("first"), F.max("period").alias("last"), F.count(F.lit(1)).alias("periods"))
