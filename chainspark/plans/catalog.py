"""Queries of the catalog jobs: each order is a record, its lines are the claimed chain and, for every third, the observed one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ontology
from ..operators import catalog, evaluate, meta, vetting

TOOL_IDS = [*[t[0] for t in ontology.TOOLS], "homemade", None]
ROLE_IDS = [r[1] for r in ontology.role_rows()]
ARCHETYPES = [("amplicon_survey", ["denoise", "taxonomy_assign"], ["trim"]), ("genome_recovery", ["assemble", "bin"], ["bin_qc"])]
EXPECT = [("f0", "roles_present", "trim", None), ("f0", "roles_absent", "bin", None), ("f0", "min_steps", "3", None), ("f1", "roles_any_of", "denoise|cluster_otu|bin", None),
          ("f1", "tools_present", "BWA", None), ("f1", "role_order", "trim", "assemble"), ("f2", "max_steps", "4", None), ("f2", "text_anywhere", "k=2 1", None),
          ("f2", "completeness_in", "full|partial", None), ("f2", "tools_absent", "kraken", None)]


def _pick(values: list, at):
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    sides = F.array_compact(F.array(F.lit("claimed"), F.when((F.col("l_orderkey") % 3 == 0) & (F.col("l_quantity") >= 10), "observed")))
    rows = lines.select("*", F.explode(sides).alias("chain"))
    step = lambda n: F.concat(F.lit("s"), n.cast("string"))
    line, part, observed = F.col("l_linenumber"), F.col("l_partkey"), F.col("chain") == "observed"
    return rows.select(
        F.col("l_orderkey").alias("rec_id"), "chain", (line * 10000000 + part).alias("pos"), step(line).alias("step_id"), (part % 20).alias("order"),
        F.when(line > 1, F.array(step(line - 1))).alias("depends_on"), F.when(part % 50 == 0, "s9").alias("alternative_of"),
        F.when(part % 97 == 0, "mystery").otherwise(_pick(ROLE_IDS, part % 48)).alias("role"),
        _pick(TOOL_IDS, (F.col("l_suppkey") + F.when(observed & (part % 7 == 0), 1).otherwise(0)) % 10).alias("tool"),
        F.when(part % 2 == 0, "named").alias("tool_raw"), (F.col("l_suppkey") % 3).alias("evidence"),
        F.when(part % 4 > 0, (F.col("l_suppkey") % 3 + F.when(observed & (part % 5 == 0), 1).otherwise(0)).cast("string")).alias("version"),
    )


def step_checks(spark, sf_dir):
    table = steps(spark, sf_dir)
    found = catalog.chain_issues(table, ontology.roles(spark), ontology.tools(spark))
    return catalog.collapsed(found)


def record_checks(spark, sf_dir):
    """Records with a file name, an archetype, provenance and a tier taken from the order."""
    key = F.col("o_orderkey")
    records = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        key.alias("rec_id"), F.when(key % 11 == 0, F.lit("x")).otherwise(key.cast("string")).alias("stem"), _pick(["amplicon_survey", "genome_recovery", "other"], key % 3).alias("archetype"),
        (key % 2).alias("sources"), (key % 5).alias("code"), _pick(vetting.TIERS, key % 4).alias("tier"), (key % 3 == 0).alias("observed"), (key % 7).alias("divergences"),
    )
    archetypes = spark.createDataFrame(ARCHETYPES, "id string, required_roles array<string>, red_flag_missing array<string>")
    found = catalog.record_issues(records, archetypes).unionByName(catalog.role_issues(records, steps(spark, sf_dir), archetypes))
    return found.groupBy("severity", "code").agg(F.count(F.lit(1)).alias("n"))


def chain_divergences(spark, sf_dir):
    return vetting.divergences(steps(spark, sf_dir))


def assertion_rows(spark, sf_dir) -> DataFrame:
    """Expectations of three fixtures on claimed chains as their repeated runs."""
    rows = steps(spark, sf_dir).where("chain = 'claimed'")
    struct = F.struct("pos", "role", F.col("tool").alias("tool_raw"), F.concat(F.lit("k = "), (F.col("pos") % 30).cast("string")).alias("params"), F.lit(None).cast("string").alias("database"))
    chains = rows.groupBy(F.col("rec_id").alias("run")).agg(F.array_sort(F.collect_list(struct)).alias("steps"))
    chains = chains.withColumn("fixture_id", F.concat(F.lit("f"), (F.col("run") % 3).cast("string"))).withColumn("completeness", _pick(["full", "partial", "none"], F.col("run") % 7 % 3))
    expect = spark.createDataFrame(EXPECT, "fixture_id string, kind string, arg string, arg2 string")
    return evaluate.assertions(chains, expect)


def expectation_results(spark, sf_dir):
    return evaluate.passed(assertion_rows(spark, sf_dir))


def dataset_candidates(spark, sf_dir):
    """Customers as datasets, nations as records that cover platforms and strategies."""
    key, n = F.col("c_custkey"), F.col("n_nationkey")
    datasets = spark.read.parquet(f"{sf_dir}/customer.parquet").select(key.alias("dataset_id"), _pick(["P0", "P1", "P2", "P3"], key % 4).alias("platform"), _pick(["S0", "S1", "S2"], key % 3).alias("strategy"), _pick(["E0", "E1"], key % 2).alias("environment"))
    names = lambda x, size: F.when(n % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit(x), (n % size).cast("string"))))
    records = spark.read.parquet(f"{sf_dir}/nation.parquet").select(n.alias("rec_id"), _pick(vetting.TIERS, n % 4).alias("tier"), names("P", 4).alias("platforms"), names("S", 3).alias("strategies"), names("E", 2).alias("environments"))
    return vetting.ranked_candidates(datasets, records, 3).select("dataset_id", "rank", "rec_id", "axes")


QUERIES = {f.__name__: f for f in (step_checks, record_checks, chain_divergences, expectation_results, dataset_candidates)}


def _sql() -> dict[str, str]:
    text = lambda x: "NULL" if x is None else "'" + x + "'"
    listed = lambda xs: "[" + ", ".join(map(text, xs)) + "]"
    base = f"""
WITH l AS (SELECT *, 'claimed' AS chain FROM lineitem UNION ALL SELECT *, 'observed' FROM lineitem WHERE l_orderkey % 3 = 0 AND l_quantity >= 10),
steps AS (
  SELECT l_orderkey AS rec_id, chain, CAST(l_linenumber AS BIGINT) * 10000000 + l_partkey AS pos, l_linenumber AS line, 's' || CAST(l_linenumber AS VARCHAR) AS step_id, l_partkey % 20 AS ord, l_partkey % 50 = 0 AS alt,
    CASE WHEN l_partkey % 97 = 0 THEN 'mystery' ELSE {listed(ROLE_IDS)}[CAST(l_partkey % 48 AS INT) + 1] END AS role,
    {listed(TOOL_IDS)}[CAST((l_suppkey + CASE WHEN chain = 'observed' AND l_partkey % 7 = 0 THEN 1 ELSE 0 END) % 10 AS INT) + 1] AS tool,
    l_partkey % 2 = 0 AS raw, l_suppkey % 3 AS evidence,
    CASE WHEN l_partkey % 4 > 0 THEN CAST(l_suppkey % 3 + CASE WHEN chain = 'observed' AND l_partkey % 5 = 0 THEN 1 ELSE 0 END AS VARCHAR) END AS version
  FROM l),
tool_dim(id, roles) AS (VALUES {", ".join(f"({text(t[0])}, {listed(t[3])})" for t in ontology.TOOLS)})"""
    kinds = {
        "roles_present": "list_contains(roles, arg)", "roles_absent": "NOT list_contains(roles, arg)", "roles_any_of": "list_has_any(roles, string_split(arg, '|'))",
        "tools_present": "contains(tools, lower(arg))", "tools_absent": "NOT contains(tools, lower(arg))", "text_anywhere": "contains(lower(texts), lower(arg)) OR contains(translate(lower(texts), ', ', ''), translate(lower(arg), ', ', ''))",
        "min_steps": "len(roles) >= TRY_CAST(arg AS INT)", "max_steps": "len(roles) <= TRY_CAST(arg AS INT)", "completeness_in": "list_contains(string_split(arg, '|'), completeness)",
        "role_order": "list_contains(roles, arg) AND list_contains(roles, arg2) AND len(roles) + 1 - list_position(list_reverse(roles), arg) < list_position(roles, arg2)",
    }
    return {
        "step_checks": base + """,
t AS (SELECT rec_id, chain, step_id, max_by(ord, pos) AS ord FROM steps GROUP BY ALL),
s AS (SELECT steps.*, d.roles, row_number() OVER (PARTITION BY rec_id, chain, step_id ORDER BY pos) AS nth FROM steps LEFT JOIN tool_dim d ON d.id = tool),
dep AS (SELECT s.*, 's' || CAST(line - 1 AS VARCHAR) AS target, t.ord AS target_ord FROM s LEFT JOIN t ON t.rec_id = s.rec_id AND t.chain = s.chain AND t.step_id = 's' || CAST(s.line - 1 AS VARCHAR) WHERE line > 1),
i AS (
  SELECT rec_id, chain, pos, 'error' AS severity, 'unknown_role' AS code, role AS message FROM s WHERE role = 'mystery'
  UNION ALL SELECT rec_id, chain, pos, 'warning', 'unknown_tool', tool FROM s WHERE tool IS NOT NULL AND roles IS NULL
  UNION ALL SELECT rec_id, chain, pos, 'warning', 'tool_at_other_role', tool || ' at ' || role FROM s WHERE role <> 'mystery' AND roles IS NOT NULL AND NOT list_contains(roles, role)
  UNION ALL SELECT rec_id, chain, pos, 'warning', 'unnamed_step', 'no tool' FROM s WHERE tool IS NULL AND NOT raw
  UNION ALL SELECT rec_id, chain, pos, 'error', 'duplicate_step', step_id FROM s WHERE nth > 1
  UNION ALL SELECT rec_id, chain, pos, 'warning', 'no_evidence', 'observed without evidence' FROM s WHERE chain = 'observed' AND evidence = 0
  UNION ALL SELECT rec_id, chain, pos, 'error', 'unknown_dependency', target FROM dep WHERE target_ord IS NULL
  UNION ALL SELECT rec_id, chain, pos, 'error', 'dependency_order', target FROM dep WHERE target_ord >= ord
  UNION ALL SELECT s.rec_id, s.chain, s.pos, 'error', 'unknown_alternative', 's9' FROM s LEFT JOIN t ON t.rec_id = s.rec_id AND t.chain = s.chain AND t.step_id = 's9' WHERE alt AND t.step_id IS NULL)
SELECT rec_id, severity, code, chain AS "where", message, count(*) AS n, min(pos) AS first_index FROM i GROUP BY ALL""",
        "record_checks": base + f""",
r AS (SELECT o_orderkey AS k, {listed(["amplicon_survey", "genome_recovery", "other"])}[CAST(o_orderkey % 3 AS INT) + 1] AS archetype, {listed(vetting.TIERS)}[CAST(o_orderkey % 4 AS INT) + 1] AS tier FROM orders),
need(archetype, code, role) AS (VALUES {", ".join(f"({text(a)}, {text(c)}, {text(x)})" for a, req, red in ARCHETYPES for c, xs in (("missing_required_role", req), ("missing_red_flag_role", red)) for x in xs)}),
i AS (
  SELECT 'warning' AS severity, 'file_name' AS code FROM r WHERE k % 11 = 0
  UNION ALL SELECT 'error', 'unknown_archetype' FROM r WHERE archetype = 'other'
  UNION ALL SELECT 'error', 'no_provenance' FROM r WHERE k % 2 = 0 AND k % 5 = 0
  UNION ALL SELECT 'error', 'divergence_unobserved' FROM r WHERE k % 3 <> 0 AND k % 7 > 0
  UNION ALL SELECT 'error', 'tier_needs_code' FROM r WHERE tier IN ('reference', 'usable') AND k % 5 = 0
  UNION ALL SELECT 'warning', 'tier_has_code' FROM r WHERE tier = 'paper_only' AND k % 5 > 0
  UNION ALL SELECT 'warning', need.code FROM r JOIN need USING (archetype)
    WHERE NOT EXISTS (SELECT 1 FROM steps WHERE rec_id = k AND chain = CASE WHEN k % 3 = 0 THEN 'observed' ELSE 'claimed' END AND steps.role = need.role))
SELECT severity, code, count(*) AS n FROM i GROUP BY ALL""",
        "chain_divergences": base + """,
g AS (SELECT rec_id, role, chain, list_sort(list(DISTINCT tool) FILTER (tool IS NOT NULL)) AS tools, list_sort(list(DISTINCT version) FILTER (version IS NOT NULL)) AS versions, min(pos) AS pos FROM steps GROUP BY rec_id, role, chain),
c AS (SELECT * FROM g WHERE chain = 'claimed' AND rec_id IN (SELECT rec_id FROM steps WHERE chain = 'observed')), o AS (SELECT * FROM g WHERE chain = 'observed'),
b AS (SELECT c.rec_id, c.role, c.pos AS cp, o.pos AS op, c.tools AS ct, o.tools AS ot, c.versions AS cv, o.versions AS ov FROM c JOIN o USING (rec_id, role))
SELECT rec_id, 'undisclosed_step' AS type, role FROM o ANTI JOIN c USING (rec_id, role)
UNION ALL SELECT rec_id, 'missing_step', role FROM c ANTI JOIN o USING (rec_id, role)
UNION ALL SELECT rec_id, 'tool_substitution', role FROM b WHERE coalesce(ct, []) <> coalesce(ot, [])
UNION ALL SELECT rec_id, 'version_mismatch', role FROM b WHERE len(cv) > 0 AND len(ov) > 0 AND cv <> ov
UNION ALL SELECT DISTINCT x.rec_id, 'order_mismatch', x.role FROM b x JOIN b y ON x.rec_id = y.rec_id AND x.cp < y.cp AND x.op > y.op""",
        "expectation_results": base + f""",
e(fixture_id, kind, arg, arg2) AS (VALUES {", ".join("(" + ", ".join(map(text, r)) + ")" for r in EXPECT)}),
c AS (SELECT rec_id AS run, 'f' || CAST(rec_id % 3 AS VARCHAR) AS fixture_id, ['full', 'partial', 'none'][CAST(rec_id % 7 % 3 AS INT) + 1] AS completeness, list(role ORDER BY pos, role, tool) AS roles,
  coalesce(lower(string_agg(tool, ' | ' ORDER BY pos, role, tool)), '') AS tools, string_agg('k = ' || CAST(pos % 30 AS VARCHAR), ' | ' ORDER BY pos, role, tool) AS texts FROM steps WHERE chain = 'claimed' GROUP BY rec_id),
r AS (SELECT run, fixture_id, CASE {" ".join(f"WHEN kind = '{k}' THEN coalesce({v}, false)" for k, v in kinds.items())} ELSE false END AS ok FROM c JOIN e USING (fixture_id))
SELECT run, fixture_id, count(*) FILTER (ok) AS passed, count(*) AS total FROM r GROUP BY ALL""",
        "dataset_candidates": """
WITH d AS (SELECT c_custkey AS dataset_id, c_custkey % 4 AS p, c_custkey % 3 AS s, c_custkey % 2 AS e FROM customer),
m AS (SELECT dataset_id, n_nationkey AS rec_id, CASE WHEN n_nationkey % 5 = 0 THEN 0 ELSE 2 END AS axes, n_nationkey % 4 AS tier, n_nationkey % 5 > 0 AND n_nationkey % 2 = e AS env
  FROM d JOIN nation ON n_nationkey % 5 = 0 OR (n_nationkey % 4 = p AND n_nationkey % 3 = s)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY dataset_id ORDER BY tier, axes DESC, env DESC, rec_id) AS INT) AS rank FROM m)
SELECT dataset_id, rank, rec_id, CAST(axes AS INT) AS axes FROM r WHERE rank <= 3""",
    }


SQL = _sql()


def role_gaps(spark, sf_dir):
    return meta.orphan_roles(steps(spark, sf_dir))


QUERIES["role_gaps"] = role_gaps
SQL["role_gaps"] = SQL["chain_divergences"].split(",\ng AS")[0] + """,
u AS (SELECT role, chain, CAST(count(DISTINCT rec_id) AS DOUBLE) / any_value(n) AS share FROM steps JOIN (SELECT chain, count(DISTINCT rec_id) AS n FROM steps GROUP BY chain) USING (chain) GROUP BY role, chain),
s AS (SELECT role, coalesce(max(share) FILTER (chain = 'observed'), 0.0) AS observed, coalesce(max(share) FILTER (chain = 'claimed'), 0.0) AS claimed FROM u GROUP BY role)
SELECT role, observed, claimed, observed - claimed AS gap FROM s"""
