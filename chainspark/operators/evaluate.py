"""Extracted chains against expectations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import loosely_contains


def assertions(chains: DataFrame, expect: DataFrame) -> DataFrame:
    """``run, fixture_id, label, ok`` for each chain and expectation of its fixture.

    ``chains``: ``run, fixture_id, completeness, steps`` (structs in order with ``role, tool_raw, params, database``).
    ``expect``: ``fixture_id, kind, arg, arg2``; several choices in ``arg`` are split at ``|``. An unknown kind fails.
    """
    texts = lambda *names: F.concat_ws(" | ", *[F.col("steps").getField(n) for n in names])
    flat = chains.select("run", "fixture_id", "completeness", F.coalesce(F.col("steps.role"), F.array().cast("array<string>")).alias("roles"), F.lower(texts("tool_raw")).alias("tools"), texts("params", "database").alias("texts"))
    choices, has = F.split("arg", r"\|"), F.array_contains("roles", F.col("arg"))
    named = F.col("tools").contains(F.lower("arg"))
    last = F.size("roles") + 1 - F.array_position(F.reverse("roles"), F.col("arg"))
    kinds = {
        "roles_present": has, "roles_absent": ~has, "roles_any_of": F.arrays_overlap("roles", choices),
        "tools_present": named, "tools_absent": ~named, "text_anywhere": loosely_contains(F.col("texts"), F.col("arg")),
        "min_steps": F.size("roles") >= F.col("arg").try_cast("int"), "max_steps": F.size("roles") <= F.col("arg").try_cast("int"),
        "completeness": F.col("completeness") == F.col("arg"), "completeness_in": F.array_contains(choices, F.col("completeness")),
        "role_order": has & F.array_contains("roles", F.col("arg2")) & (last < F.array_position("roles", F.col("arg2"))),
    }
    ok = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in kinds.items()], F.lit(False))
    label = F.concat_ws(":", "kind", "arg", "arg2")
    return flat.join(expect, "fixture_id").select("run", "fixture_id", label.alias("label"), ok.alias("ok"))


def passed(results: DataFrame) -> DataFrame:
    return results.groupBy("run", "fixture_id").agg(F.count_if("ok").alias("passed"), F.count(F.lit(1)).alias("total"))


def failures(results: DataFrame) -> DataFrame:
    """Failing expectations by how often they fail over all runs."""
    return results.where(~F.col("ok")).groupBy("fixture_id", "label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "fixture_id", "label")


def role_scores(steps: DataFrame, labelled: DataFrame, *by: str) -> DataFrame:
    """Precision, recall and counts of extracted roles (over all, or per ``by``); both tables: ``doc, role``.

    Repeated pairs count once; a ratio without denominator is null.
    """
    got = steps.select("doc", "role").withColumns({"got": F.lit(1), "want": F.lit(0)})
    want = labelled.select("doc", "role").withColumns({"got": F.lit(0), "want": F.lit(1)})
    pairs = got.unionByName(want).groupBy("doc", "role").agg(F.max("got").alias("got"), F.max("want").alias("want"))
    hits = F.sum(F.col("got") * F.col("want"))
    told = [F.sum("got").alias("extracted"), F.sum("want").alias("labelled"), F.try_divide(hits.cast("double"), F.sum("got").cast("double")).alias("precision"), F.try_divide(hits.cast("double"), F.sum("want").cast("double")).alias("recall")]
    return pairs.groupBy(*by).agg(*told)


def run_costs(runs: DataFrame) -> DataFrame:
    """Per fixture: runs, failed runs, seconds, tokens and the share of reasoning among them. Failed runs are counted, not fatal.

    ``runs``: ``fixture_id, error, elapsed_s, completion_tokens, reasoning_tokens``.
    """
    fine = F.col("error").isNull()
    when = lambda c: F.sum(F.when(fine, F.col(c)))
    return runs.groupBy("fixture_id").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(~fine).alias("errors"), when("elapsed_s").alias("seconds"), F.avg(F.when(fine, F.col("elapsed_s"))).alias("seconds_a_run"),
        when("completion_tokens").alias("tokens"), F.try_divide(when("reasoning_tokens").cast("double"), when("completion_tokens").cast("double")).alias("reasoning_share"),
    )


def chosen_fixtures(fixtures: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """All fixtures, or those of the given ids; a choice that finds none is an error."""
    chosen = fixtures.where(F.col("fixture_id").isin(*ids)) if ids else fixtures
    if chosen.isEmpty():
        raise ValueError(f"no fixture of {ids or 'any id'}")
    return chosen
