"""Claimed against observed chains, final tiers, and candidates for datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Best first (fixed values).
TIERS = ["reference", "usable", "documented", "paper_only", "rejected"]


def divergences(steps: DataFrame) -> DataFrame:
    """``rec_id, type, role``: what a record's observed chain has otherwise than its claimed one, role by role.

    ``steps``: ``rec_id, chain, pos, role, tool, version`` and, if there, ``params, database``. Records without an observed
    chain have no rows. Versions, parameters and databases differ only where both sides state any. A database of the same
    name with another release is ``db_version_mismatch``; one without a number in it, ``db_unspecified``, and another name
    ``tool_substitution``. Orders differ where two roles' first steps are swapped.
    """
    stated = [c for c in ("tool", "version", "params", "database") if c in steps.columns]
    side = lambda name: steps.where(F.col("chain") == name).groupBy("rec_id", "role").agg(*[F.array_sort(F.collect_set(c)).alias(f"{name}_{c}") for c in stated], F.min("pos").alias(f"{name}_pos"))
    seen = steps.where("chain = 'observed'").select("rec_id").distinct()
    both = side("claimed").join(seen, "rec_id", "left_semi").join(side("observed"), ["rec_id", "role"], "full")
    there = F.col("claimed_pos").isNotNull() & F.col("observed_pos").isNotNull()
    differ = lambda c: F.col(f"claimed_{c}") != F.col(f"observed_{c}")
    each = lambda c: (F.size(f"claimed_{c}") > 0) & (F.size(f"observed_{c}") > 0) & differ(c)
    kinds = [
        F.when(F.col("claimed_pos").isNull(), "undisclosed_step"), F.when(F.col("observed_pos").isNull(), "missing_step"),
        F.when(there & differ("tool"), "tool_substitution"), F.when(there & each("version"), "version_mismatch"),
    ]
    if "params" in stated:
        kinds.append(F.when(there & each("params"), "param_mismatch"))
    if "database" in stated:
        names = lambda s: F.array_sort(F.array_distinct(F.transform(F.col(f"{s}_database"), lambda d: F.regexp_replace(F.lower(d), r"[\W_]*v?\d.*$", ""))))
        same = names("claimed") == names("observed")
        unspecified = lambda s: (F.size(f"{s}_database") > 0) & ~F.exists(f"{s}_database", lambda d: d.rlike(r"\d"))
        kinds += [
            F.when(there & each("database") & same & ~unspecified("claimed") & ~unspecified("observed"), "db_version_mismatch"),
            F.when(unspecified("claimed") | unspecified("observed"), "db_unspecified"), F.when(there & each("database") & ~same, "tool_substitution"),
        ]
    single = both.select("rec_id", F.explode(F.array_distinct(F.array_compact(F.array(*kinds)))).alias("type"), "role")
    spots = both.where(there).groupBy("rec_id").agg(F.collect_list(F.struct("role", F.col("claimed_pos").alias("c"), F.col("observed_pos").alias("o"))).alias("spots"))  # the roles of one record
    swapped = F.filter("spots", lambda x: F.exists("spots", lambda y: (x["c"] < y["c"]) & (x["o"] > y["o"])))
    return single.unionByName(spots.select("rec_id", F.lit("order_mismatch").alias("type"), F.explode(F.transform(swapped, lambda x: x["role"])).alias("role")))


def final_tier(records: DataFrame) -> DataFrame:
    """``records`` with ``final_tier``: the reviewer's, else ``paper_only`` without code, else the judge's, else the scorecard's."""
    return records.withColumn("final_tier", F.coalesce("tier_override", F.when(F.coalesce("code", F.lit(0)) == 0, "paper_only"), "adjudicated_tier", "scorecard_tier"))


def ranked_candidates(datasets: DataFrame, records: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` best records for each dataset: by tier, then by how many axes they name, then by environment, then by id.

    ``datasets``: ``dataset_id, platform, strategy, environment``. ``records``: ``rec_id, tier`` and arrays ``platforms,
    strategies, environments``, where an empty array or ``ANY`` takes all. The environment ranks and never excludes.
    Axes meet in one equi-join of cells. A cell keeps its ``k`` best records, and its ``k`` best of each environment, so
    a dataset meets a few records however many the catalog has; no other record of the cell can be among its ``k`` best.
    """
    wild = lambda c: F.when((F.coalesce(F.size(c), F.lit(0)) <= 0) | F.array_contains(c, "ANY"), F.array(F.lit("ANY"))).otherwise(F.array_distinct(c))
    tier = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier")), F.lit(0)), F.lit(len(TIERS) + 1))
    cells = records.select("rec_id", tier.alias("tier_rank"), "environments", F.explode(wild("platforms")).alias("p"), wild("strategies").alias("s")).withColumn("s", F.explode("s"))
    own = F.array_distinct(F.array_compact(F.coalesce("environments", F.array().cast("array<string>"))))
    cells = cells.withColumn("e", F.explode(F.concat(F.array(F.lit("any")), F.transform(own, lambda x: F.concat(F.lit("="), x)))))
    best = W.partitionBy("p", "s", "e").orderBy("tier_rank", "rec_id")
    cells = cells.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).drop("place")
    keys = datasets.select("*", F.explode(F.array_distinct(F.array(F.coalesce("platform", F.lit("ANY")), F.lit("ANY")))).alias("p"))
    keys = keys.withColumn("s", F.explode(F.array_distinct(F.array(F.coalesce("strategy", F.lit("ANY")), F.lit("ANY")))))
    keys = keys.withColumn("e", F.explode(F.array_compact(F.array(F.lit("any"), F.concat(F.lit("="), F.col("environment"))))))
    met = keys.join(cells, ["p", "s", "e"])
    scored = met.select("dataset_id", "rec_id", "tier_rank", ((F.col("p") != "ANY").cast("int") + (F.col("s") != "ANY").cast("int")).alias("axes"), F.coalesce(F.array_contains("environments", F.col("environment")), F.lit(False)).alias("same_environment")).distinct()
    order = W.partitionBy("dataset_id").orderBy("tier_rank", F.col("axes").desc(), F.col("same_environment").desc(), "rec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: Files that start a workflow engine, most telling first, and files that fix an environment (fixed values).
ENGINES = (("nextflow", r"(^|/)main\.nf$"), ("snakemake", r"(^|/)Snakefile$"), ("cwl", r"\.cwl$"), ("wdl", r"\.wdl$"), ("rmarkdown", r"\.Rmd$"), ("shell", r"\.sh$"))
ENVIRONMENTS = ("environment.yml", "Dockerfile", "renv.lock", "requirements.txt", "modules.json")


def repository_kinds(files: DataFrame) -> DataFrame:
    """``repo, engine, environments``: from the paths of each repository. ``files``: ``repo, path``.

    The engine is that of the most telling entry file, null without one; environments are the known files there, sorted.
    """
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    rank = F.coalesce(*[F.when(F.col("path").rlike(p), F.lit(i)) for i, (_, p) in enumerate(ENGINES)])
    per = files.groupBy("repo").agg(F.min(rank).alias("rank"), F.array_sort(F.collect_set(F.when(name.isin(*ENVIRONMENTS), name))).alias("environments"))  # five names at most
    return per.select("repo", F.try_element_at(F.array(*[F.lit(e) for e, _ in ENGINES]), F.col("rank") + 1).alias("engine"), "environments")


def scorecard(files: DataFrame, records: DataFrame) -> DataFrame:
    """Facts about each record's repository, one column each; no sum of them is stored. ``records``: ``rec_id, repo``."""
    path = F.lower("path")
    facts = {"has_readme": path.rlike(r"(^|/)readme(\.|$)"), "has_license": path.rlike(r"(^|/)licen[cs]e(\.|$)"), "has_tests": path.rlike(r"(^|/)tests?/"), "has_ci": path.rlike(r"^\.github/workflows/|(^|/)\.gitlab-ci\.yml$")}
    told = files.groupBy("repo").agg(F.count(F.lit(1)).alias("files"), *[F.bool_or(v).alias(k) for k, v in facts.items()])
    kinds = repository_kinds(files).select("repo", "engine", (F.size("environments") > 0).alias("has_environment"))
    return records.select("rec_id", "repo").join(told, "repo", "left").join(kinds, "repo", "left")


def unspecified_databases(steps: DataFrame, databases: DataFrame) -> DataFrame:
    """``rec_id, role``: roles of a record that need a database, where no step of either chain names a release of one.

    ``steps``: ``rec_id, role, database``. ``databases``: ``roles`` of each; a release is any number in the text.
    """
    needy = databases.select(F.explode("roles").alias("role")).distinct()
    stated = F.coalesce(F.col("database").rlike(r"\d"), F.lit(False))
    return steps.join(needy, "role", "left_semi").groupBy("rec_id", "role").agg(F.bool_or(stated).alias("stated")).where("not stated").select("rec_id", "role")


def spot_checks(judged: DataFrame, per_cent: int = 5, seed: int = 0) -> DataFrame:
    """The fixed share of records that people look at, chosen by a digest of the id: the same ones in every run and under any
    partitioning, and a larger share holds the smaller. Records without id are never chosen."""
    digest = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("rec_id").cast("string"))), 1, 8), 16, 10).cast("bigint")
    return judged.where(digest % 100 < per_cent)


def agreement(checked: DataFrame) -> DataFrame:
    """Per batch, in order of the batches: how many records were looked at by both, the share on which person and judge agree,
    and by how much it fell since the last batch with any (``fell``, 0 at least)."""
    agree = (F.col("human_tier") == F.col("judged_tier")).cast("double")
    per = checked.groupBy("batch").agg(F.count(agree).alias("checked"), F.avg(agree).alias("agreement"))
    before = F.last("agreement", ignorenulls=True).over(W.orderBy("batch").rowsBetween(W.unboundedPreceding, -1))  # one row a batch
    return per.withColumn("fell", F.greatest(before - F.col("agreement"), F.lit(0.0)))
