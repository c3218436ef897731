"""Checks of catalog records. Every check yields rows ``rec_id, severity, code, where, message``.

``steps``: one row per step, ``rec_id, chain, pos, step_id, order, depends_on, alternative_of, role, tool, tool_raw, evidence``
(``evidence``: how many). ``records``: ``rec_id, stem, archetype, sources, code, tier, observed, divergences`` (``sources``,
``code`` and ``divergences``: how many; ``observed``: whether there is such a chain).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import dimension

CHAIN = ["rec_id", "chain"]


def _issue(when: Column, severity: str, code: str, message: Column) -> Column:
    return F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), message.alias("message")))


def _rows(table: DataFrame, where: Column, checks: list[Column]) -> DataFrame:
    """All checks in one pass over the table."""
    found = table.select("rec_id", where.alias("where"), F.explode(F.array_compact(F.array(*checks))).alias("i"))
    return found.select("rec_id", "i.severity", "i.code", "where", F.substring("i.message", 1, 200).alias("message"))


def chain_issues(steps: DataFrame, roles: DataFrame, tools: DataFrame) -> DataFrame:
    """Issues of single steps and of the steps that they name.

    Unknown roles and tools, tools at other roles than they declare, unnamed and repeated steps, missing evidence;
    dependencies and alternatives that name no step of the chain, name the step itself, or come no earlier in order. The
    last of several steps with an id counts. A chain becomes one row, in one shuffle; all else happens in the row.
    """
    role_dim = dimension(roles.select(F.col("id").alias("role"), F.lit(True).alias("role_known")))
    tool_dim = dimension(tools.select(F.col("id").alias("tool"), F.col("roles").alias("tool_roles"), F.lit(True).alias("tool_known")))
    known, tool_known = F.col("role_known").isNotNull(), F.col("tool_known").isNotNull()
    named = F.coalesce("tool", F.lit("")) != ""
    alone = [
        _issue(~known, "error", "unknown_role", F.coalesce("role", F.lit(""))),
        _issue(named & ~tool_known, "warning", "unknown_tool", F.col("tool")),
        _issue(known & tool_known & ~F.array_contains("tool_roles", F.col("role")), "warning", "tool_at_other_role", F.concat_ws(" at ", "tool", "role")),
        _issue(~named & (F.coalesce("tool_raw", F.lit("")) == ""), "warning", "unnamed_step", F.lit("no tool")),
        _issue((F.col("chain") == "observed") & (F.coalesce("evidence", F.lit(0)) == 0), "warning", "no_evidence", F.lit("observed without evidence")),
    ]
    seen = steps.join(role_dim, "role", "left").join(tool_dim, "tool", "left")
    step = F.struct("pos", "step_id", "order", "depends_on", "alternative_of", F.array_compact(F.array(*alone)).alias("issues"))
    chains = seen.groupBy(*CHAIN).agg(F.array_sort(F.collect_list(step), lambda x, y: F.when(x["pos"] < y["pos"], -1).when(x["pos"] > y["pos"], 1).otherwise(0)).alias("steps"))

    none = F.array().cast("array<struct<severity: string, code: string, message: string>>")

    def references(s: Column) -> Column:
        def one(kind: str, target: Column) -> Column:
            same = F.filter("steps", lambda x: x["step_id"] == target)
            there, depends = F.size(same) > 0, F.lit(kind == "depends_on")
            return F.array_compact(F.array(
                _issue(depends & ~there, "error", "unknown_dependency", target), _issue(depends & there & (target == s["step_id"]), "error", "self_dependency", target),
                _issue(~depends & ~there, "error", "unknown_alternative", target), _issue(depends & (F.try_element_at(same, F.lit(-1))["order"] >= s["order"]), "error", "dependency_order", target),
            ))

        named = F.flatten(F.transform(s["depends_on"], lambda t: one("depends_on", t)))
        return F.concat(F.coalesce(named, none), F.when(s["alternative_of"].isNotNull(), one("alternative_of", s["alternative_of"])).otherwise(none))

    def told(s: Column, i: Column) -> Column:
        again = _issue(F.exists(F.slice("steps", F.lit(1), i), lambda x: x["step_id"] == s["step_id"]), "error", "duplicate_step", s["step_id"])
        found = F.concat(s["issues"], F.array_compact(F.array(again)), references(s))
        return F.transform(found, lambda x: F.struct(s["pos"].alias("pos"), x["severity"].alias("severity"), x["code"].alias("code"), x["message"].alias("message")))

    rows = chains.select(*CHAIN, F.inline(F.flatten(F.transform("steps", told))))
    where = F.concat(F.col("chain"), F.lit("["), F.col("pos").cast("string"), F.lit("]"))
    return rows.select("rec_id", "severity", "code", where.alias("where"), F.substring("message", 1, 200).alias("message"))


def record_issues(records: DataFrame, archetypes: DataFrame) -> DataFrame:
    """File name, archetype, provenance, divergence and tier."""
    seen = records.join(dimension(archetypes.select(F.col("id").alias("archetype"), F.lit(True).alias("known"))), "archetype", "left")
    code, sources = F.coalesce("code", F.lit(0)) > 0, F.coalesce("sources", F.lit(0)) > 0
    checks = [
        _issue((F.col("stem") != F.col("rec_id").cast("string")) & ~F.col("stem").startswith("_"), "warning", "file_name", F.col("stem")),
        _issue(F.col("archetype").isNotNull() & F.col("known").isNull(), "error", "unknown_archetype", F.col("archetype")),
        _issue(~code & ~sources, "error", "no_provenance", F.lit("neither sources nor code")),
        _issue(~F.coalesce("observed", F.lit(False)) & (F.coalesce("divergences", F.lit(0)) > 0), "error", "divergence_unobserved", F.lit("divergence without an observed chain")),
        _issue(F.col("tier").isin("reference", "usable") & ~code, "error", "tier_needs_code", F.col("tier")),
        _issue((F.col("tier") == "paper_only") & code, "warning", "tier_has_code", F.col("tier")),
    ]
    return _rows(seen, F.lit("record"), checks)


def effective_chain(observed: Column, claimed: Column) -> Column:
    """The observed chain (a struct), else the claimed one, else null. A struct without any field counts as none; an observed
    chain without steps is a chain, and wins."""
    filled = lambda chain: F.when(F.to_json(chain) != "{}", chain)
    return F.coalesce(filled(observed), filled(claimed))


def role_issues(records: DataFrame, steps: DataFrame, archetypes: DataFrame) -> DataFrame:
    """Required and red-flag roles of the archetype that the effective chain (observed, else claimed) lacks."""
    def coded(column: str, code: str) -> Column:
        return F.transform(F.coalesce(column, F.array().cast("array<string>")), lambda r: F.struct(F.lit(code).alias("code"), r.alias("role")))

    wanted = F.concat(coded("required_roles", "missing_required_role"), coded("red_flag_missing", "missing_red_flag_role"))
    needs = archetypes.select(F.col("id").alias("archetype"), F.explode(wanted).alias("w")).select("archetype", "w.*")
    chain = records.select("rec_id", "archetype", F.when(F.col("observed"), "observed").otherwise("claimed").alias("chain"))
    need = chain.join(dimension(needs), "archetype")
    lacking = need.join(steps.select(*CHAIN, "role").distinct(), [*CHAIN, "role"], "left_anti")
    return lacking.select("rec_id", F.lit("warning").alias("severity"), "code", F.col("chain").alias("where"), F.col("role").alias("message"))


def issues(records: DataFrame, steps: DataFrame, roles: DataFrame, tools: DataFrame, archetypes: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [chain_issues(steps, roles, tools), record_issues(records, archetypes), role_issues(records, steps, archetypes)])


#: Orders that are disputed: a step of the first role (and, where given, of these tools) anywhere before one of the second.
PRACTICES = (
    ("rarefied_before_composition_test", "normalize", None, "differential_abundance", ["ancombc", "aldex2"]),
    ("primers_removed_after_denoising", "denoise", None, "remove_primers", None),
)


def practice_findings(steps: DataFrame, practices=PRACTICES) -> DataFrame:
    """``rec_id, chain, practice, first_pos, then_pos``: chains in which a disputed order stands, with its first and last step.

    Findings, not errors. ``steps``: ``rec_id, chain, pos, role, tool``. ``practices`` are a small table of (name, role, tools,
    role, tools); null tools are any. Each step meets the sides of the table in one broadcast join, and chains are
    grouped once, by partial sums.
    """
    sides = [(name, side, role, tools) for name, a, a_tools, b, b_tools in practices for side, role, tools in (("first", a, a_tools), ("then", b, b_tools))]
    table = steps.sparkSession.createDataFrame(sides, "practice string, side string, role string, tools array<string>")
    met = steps.join(F.broadcast(table), "role").where(F.col("tools").isNull() | F.array_contains("tools", F.col("tool")))
    at = lambda side: F.when(F.col("side") == side, F.col("pos"))
    return met.groupBy(*CHAIN, "practice").agg(F.min(at("first")).alias("first_pos"), F.max(at("then")).alias("then_pos")).where("first_pos < then_pos")


def collapsed(found: DataFrame) -> DataFrame:
    """Issues of a record that differ only in a trailing index, with their number and the first index among them.

    ``orderBy("rec_id", "first_index")`` lists a record's issues as they were first seen.
    """
    place, index = F.regexp_replace("where", r"\[\d+\]$", ""), F.regexp_extract("where", r"\[(\d+)\]$", 1).try_cast("bigint")
    return found.groupBy("rec_id", "severity", "code", place.alias("where"), "message").agg(F.count(F.lit(1)).alias("n"), F.min(index).alias("first_index"))


def totals(found: DataFrame, records: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """Errors, warnings and whether the catalog passes, with the number of ``records`` if given; ``strict``: warnings fail too."""
    errors, warnings = (F.count_if(F.col("severity") == s) for s in ("error", "warning"))
    told = found.agg(errors.alias("errors"), warnings.alias("warnings")).withColumn("passed", (F.col("errors") == 0) & (F.lit(not strict) | (F.col("warnings") == 0)))
    return told if records is None else told.crossJoin(F.broadcast(records.agg(F.count(F.lit(1)).alias("records"))))  # one row each
