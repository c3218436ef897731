"""Queries over archetypes, coverage, vetting and evaluation, on the chains of ``plans.catalog`` and on other given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ontology
from ..functions.text import period
from ..operators import catalog, evaluate, extract, meta, vetting
from .catalog import ROLE_IDS, SQL as CATALOG_SQL
from .catalog import _pick as pick
from .catalog import steps

#: Required, expected and red-flag roles of some archetypes; the last has no required ones.
ARCHETYPES = [("amplicon", ["denoise"], ["trim"]), ("genomes", ["assemble"], ["bin"]), ("reads", ["trim", "qc_raw"], []), ("ecology", [], ["diversity", "ordination"])]
CLUSTERS, ROUNDS = 5, 3
AXES = {"platforms": ["P0", "P1", "P2", "P3"], "strategies": ["S0", "S1", "S2"], "environments": ["E0", "E1"]}
PRACTICES = (("normalized_before_test", "normalize", None, "differential_abundance", ["dada2", "bwa"]), ("primers_after_denoising", "denoise", None, "remove_primers", None), ("binned_before_polish", "bin", ["megahit", "bwa", "kraken2"], "polish", None))
RULES = [("S0", "r0"), ("S1", "r1")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def archetypes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ARCHETYPES, "id string, required_roles array<string>, expected_roles array<string>")


def claimed(spark, sf_dir) -> DataFrame:
    return steps(spark, sf_dir).where("chain = 'claimed'")


def tool_uses(spark, sf_dir) -> DataFrame:
    """``archetype, period, role, key, n`` of all claimed steps; a record without archetype has none."""
    rows = claimed(spark, sf_dir)
    dated = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rec_id"), period(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("period"))
    per = rows.groupBy("rec_id", "role", F.col("tool").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    kinds = meta.archetypes_of(rows, archetypes(spark)).join(dated, "rec_id")
    return per.join(kinds, "rec_id").where("key is not null").groupBy("archetype", "period", "role", "key").agg(F.sum("n").alias("n"))


def archetype_matches(spark, sf_dir):
    return meta.archetypes_of(claimed(spark, sf_dir), archetypes(spark)).groupBy("archetype").agg(F.count(F.lit(1)).alias("records"))


def archetype_tools(spark, sf_dir):
    """The usual tool of each role, by archetype and period."""
    return meta.modal_tools(tool_uses(spark, sf_dir), "period")


def tool_substitutes(spark, sf_dir):
    return meta.substitutes(tool_uses(spark, sf_dir).groupBy("archetype", "role", "key").agg(F.sum("n").alias("n")))


def substitution_classes(spark, sf_dir):
    counts = tool_uses(spark, sf_dir).groupBy("archetype", "role", "key").agg(F.sum("n").alias("n"))
    return meta.substitution_classes(counts, ontology.roles(spark)).select("archetype", "role", "uses", "tools", F.round("entropy", 6).alias("entropy"), "lead", "substitutable", "surprising")


def archetype_clusters(spark, sf_dir):
    """Clusters of role sets against the archetypes."""
    clustered, _ = meta.derived_archetypes(meta.role_sets(claimed(spark, sf_dir), ROLE_IDS), CLUSTERS, ROUNDS)
    return meta.archetype_contingency(clustered, archetypes(spark), ROLE_IDS)


def vetted(spark, sf_dir) -> DataFrame:
    """Suppliers as records that cover platforms, strategies and environments; some cover all of an axis."""
    n = F.col("s_suppkey")
    one = lambda x, size, every: F.when(n % every == 0, F.array(F.lit("ANY"))).otherwise(F.array(F.concat(F.lit(x), (n * n % size).cast("string"))))
    rows = table(spark, sf_dir, "supplier").where(n % 4 == 0)
    return rows.select(n.alias("rec_id"), one("P", 4, 28).alias("platforms"), one("S", 3, 20).alias("strategies"), F.when(n % 44 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("E"), (n % 3 % 2).cast("string")))).alias("environments"))


def coverage_totals(spark, sf_dir):
    return meta.coverage_totals(vetted(spark, sf_dir), AXES)


def practice_findings(spark, sf_dir):
    return catalog.practice_findings(steps(spark, sf_dir), PRACTICES)


def judged(spark, sf_dir) -> DataFrame:
    """Orders as judged records, in batches by month; people agree with the judge less and less."""
    n, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        n.alias("rec_id"), F.date_format("o_orderdate", "yyyy-MM").alias("batch"), pick(vetting.TIERS, n % 5).alias("judged_tier"), F.when(n % 9 > 0, pick(vetting.TIERS, (n + F.when(c % 6 == 0, 1).otherwise(0)) % 5)).alias("human_tier"),
        pick(["m1", "m2"], c % 2).alias("model"), F.when(n % 7 > 0, pick(["v1", "v2", "v3"], n % 3)).alias("prompt_version"), F.when(c % 11 == 0, pick(vetting.TIERS, c % 5)).alias("tier_override"), (c % 3).alias("code"), F.when(n % 3 > 0, pick(vetting.TIERS, n % 5)).alias("adjudicated_tier"), pick(vetting.TIERS, c % 5).alias("scorecard_tier"),
    )


def spot_agreement(spark, sf_dir):
    """Agreement over time on one record in five."""
    return vetting.agreement(vetting.spot_checks(judged(spark, sf_dir), 20))


def stale_judgments(spark, sf_dir):
    return meta.stale(judged(spark, sf_dir), "m1", "v2").groupBy("model", "prompt_version").agg(F.count(F.lit(1)).alias("n"))


def final_tiers(spark, sf_dir):
    return vetting.final_tier(judged(spark, sf_dir)).groupBy("final_tier").agg(F.count(F.lit(1)).alias("records"))


def evidence_checks(spark, sf_dir):
    """Quotes of every document against its text: one from its middle, one with a word more, and an empty one."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    quote = F.substring("text", 1 + F.col("doc") % 50, 60 + F.col("doc") % 40)
    kind = lambda i, x: F.struct(F.lit(i).alias("step"), x.alias("evidence"))
    kinds = F.array(kind(0, quote), kind(1, F.concat(quote, F.lit(" qqzzq"))), kind(2, F.lit("  ")))
    found = extract.evidence_found(docs.select("doc", F.inline(kinds)), docs, "doc")
    return found.groupBy("step", "verbatim").agg(F.count(F.lit(1)).alias("n"))


def extraction_scores(spark, sf_dir):
    """Labels as truth; what a document's length and text say, as extracted."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("doc"), "quality", "toxic")
    roles = lambda good, bad: F.explode(F.array_compact(F.array(F.when(good, "quality"), F.when(bad, "toxic"))))
    want = labels.select("doc", roles(F.col("quality") == 1, F.col("toxic") == 1).alias("role"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), roles(F.length("text") >= 800, F.col("text").contains("!")).alias("role"))
    return evaluate.role_scores(docs.join(labels.select("doc"), "doc", "left_semi"), want, "role")


def fixture_runs(spark, sf_dir) -> DataFrame:
    n, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("f"), (c % 7).cast("string")).alias("fixture_id"), F.when(n % 10 == 3, "timeout").alias("error"), (c % 60).cast("double").alias("elapsed_s"), (c % 900).alias("completion_tokens"), (n % 500).alias("reasoning_tokens"))


def run_costs(spark, sf_dir):
    return evaluate.run_costs(fixture_runs(spark, sf_dir))


def single_suites(spark, sf_dir):
    """Records that are one call of a suite."""
    tools = ontology.tools(spark).select("id", F.when(F.col("id").isin("dada2", "bwa", "fastqc"), "suite").otherwise("tool").alias("kind"))
    return meta.opaque_suites(claimed(spark, sf_dir), tools)


def rule_ladder(spark, sf_dir):
    """Customers as datasets: where a fixed ladder of rules and the best-ranked record differ."""
    n = F.col("c_custkey")
    datasets = table(spark, sf_dir, "customer").select(n.alias("dataset_id"), pick(["s0", "S1", "s2"], n % 3).alias("strategy"))
    first = table(spark, sf_dir, "customer").where(n % 13 > 0).select(n.alias("dataset_id"), F.concat(F.lit("r"), (n % 4).cast("string")).alias("rec_id"))
    return meta.ladder_differences(datasets, first, RULES, "r2")


def catalog_totals(spark, sf_dir):
    """Records, errors and warnings of all steps, and whether the catalog passes."""
    rows = steps(spark, sf_dir)
    found = catalog.chain_issues(rows, ontology.roles(spark), ontology.tools(spark))
    return catalog.totals(found, table(spark, sf_dir, "orders"))


QUERIES = {f.__name__: f for f in (archetype_matches, archetype_tools, tool_substitutes, substitution_classes, archetype_clusters, coverage_totals, practice_findings, spot_agreement, stale_judgments, final_tiers, evidence_checks, extraction_scores, run_costs, single_suites, rule_ladder, catalog_totals)}


def _sql() -> dict[str, str]:
    text = lambda x: "NULL" if x is None else "'" + x + "'"
    listed = lambda xs: "CAST([" + ", ".join(map(text, xs)) + "] AS VARCHAR[])"
    chains = CATALOG_SQL["chain_divergences"].split(",\ng AS")[0]
    tiers = listed(vetting.TIERS)
    kinds = chains + f""",
arch(archetype, req, exp) AS (VALUES {", ".join(f"({text(a)}, {listed(r)}, {listed(e)})" for a, r, e in ARCHETYPES)}),
has AS (SELECT rec_id, list(DISTINCT role) AS roles FROM steps WHERE chain = 'claimed' GROUP BY rec_id),
kinds AS (SELECT rec_id, archetype FROM has, arch WHERE CASE WHEN len(req) > 0 THEN list_has_all(roles, req) ELSE list_has_any(exp, roles) END)"""
    uses = kinds + """,
y AS (SELECT o_orderkey AS rec_id, CAST(year(o_orderdate) - year(o_orderdate) % 3 AS INT) AS y FROM orders),
uses AS (SELECT archetype, CAST(y AS VARCHAR) || '-' || substr(CAST(y + 2 AS VARCHAR), 3, 2) AS period, role, tool AS key, count(*) AS n FROM steps JOIN kinds USING (rec_id) JOIN y USING (rec_id) WHERE chain = 'claimed' AND tool IS NOT NULL GROUP BY ALL),
counts AS (SELECT archetype, role, key, CAST(sum(n) AS BIGINT) AS n FROM uses GROUP BY ALL)"""
    bit = "CASE role " + " ".join(f"WHEN {text(r)} THEN {1 << i}" for i, r in enumerate(ROLE_IDS)) + " ELSE 0 END"
    far = "min({'d': bit_count(xor(mask, mode)), 'i': i})"
    mode = lambda k: f"""
, a{k} AS (SELECT mask, n, {far}.i AS cluster FROM sets, m{k} GROUP BY mask, n)
, m{k + 1} AS (SELECT i, coalesce(new, mode) AS mode FROM m{k} LEFT JOIN (
    SELECT cluster AS i, CAST(sum(CASE WHEN 2 * w >= total THEN 1::BIGINT << b ELSE 0 END) AS BIGINT) AS new FROM (
      SELECT cluster, b, sum(CASE WHEN mask & (1::BIGINT << b) <> 0 THEN n ELSE 0 END) AS w, sum(n) AS total FROM a{k}, (SELECT CAST(unnest(range(48)) AS INT) AS b) GROUP BY cluster, b) GROUP BY cluster) USING (i))"""  # noqa: E731
    clusters = kinds + f""",
c AS (SELECT rec_id, CAST(bit_or({bit}) AS BIGINT) AS mask FROM steps WHERE chain = 'claimed' GROUP BY rec_id),
sets AS MATERIALIZED (SELECT mask, count(*) AS n FROM c GROUP BY mask),
m0 AS (SELECT CAST(row_number() OVER (ORDER BY n DESC, mask) - 1 AS INT) AS i, mask AS mode FROM (SELECT * FROM sets ORDER BY n DESC, mask LIMIT {CLUSTERS}))""" + "".join(map(mode, range(ROUNDS))) + f"""
, last AS (SELECT mask, {far}.i AS cluster FROM sets, m{ROUNDS} GROUP BY mask)
, cells AS (SELECT archetype, cluster, count(*) AS chains FROM c JOIN last USING (mask) LEFT JOIN kinds USING (rec_id) GROUP BY ALL)"""
    cell = " AND ".join(f"({a} IS NULL OR list_contains({a}, 'ANY') OR len({a}) = 0 OR list_contains({a}, g.{a[0]}))" for a in AXES)
    side = lambda r, t, name: f"CASE WHEN role = {text(r)}" + (f" AND tool IN ({', '.join(map(text, t))})" if t else "") + f" THEN pos END AS {name}"
    practices = "\nUNION ALL ".join(f"SELECT rec_id, chain, {text(name)} AS practice, min(f) AS first_pos, max(t) AS then_pos FROM (SELECT rec_id, chain, {side(a, at, 'f')}, {side(b, bt, 't')} FROM steps) GROUP BY rec_id, chain HAVING min(f) < max(t)" for name, a, at, b, bt in PRACTICES)
    at = lambda x: f"{tiers}[CAST({x} AS INT) + 1]"
    judged_sql = f"""
WITH j AS (SELECT o_orderkey AS rec_id, strftime(o_orderdate, '%Y-%m') AS batch, {at("o_orderkey % 5")} AS judged_tier, CASE WHEN o_orderkey % 9 > 0 THEN {at("(o_orderkey + CASE WHEN o_custkey % 6 = 0 THEN 1 ELSE 0 END) % 5")} END AS human_tier,
  CASE WHEN o_custkey % 2 = 0 THEN 'm1' ELSE 'm2' END AS model, CASE WHEN o_orderkey % 7 > 0 THEN ['v1', 'v2', 'v3'][CAST(o_orderkey % 3 AS INT) + 1] END AS prompt_version,
  CASE WHEN o_custkey % 11 = 0 THEN {at("o_custkey % 5")} END AS tier_override, o_custkey % 3 AS code, CASE WHEN o_orderkey % 3 > 0 THEN {at("o_orderkey % 5")} END AS adjudicated_tier, {at("o_custkey % 5")} AS scorecard_tier FROM orders)"""
    flat = lambda x: rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"
    issues = CATALOG_SQL["step_checks"].rpartition("\nSELECT rec_id")[0]
    return {
        "archetype_matches": kinds + "\nSELECT archetype, count(*) AS records FROM kinds GROUP BY archetype",
        "archetype_tools": uses + """
SELECT archetype, period, role, CAST(sum(n) AS BIGINT) AS uses, count(*) AS tools, first(key ORDER BY n DESC, key) AS tool, CAST(max(n) AS DOUBLE) / sum(n) AS share FROM uses GROUP BY archetype, period, role""",
        "tool_substitutes": uses + """, t AS (SELECT archetype, role, sum(n) AS total FROM counts GROUP BY ALL)
SELECT archetype, role, x.key AS a, y.key AS b, CAST(x.n AS DOUBLE) / total AS share_a, CAST(y.n AS DOUBLE) / total AS share_b FROM counts x JOIN counts y USING (archetype, role) JOIN t USING (archetype, role) WHERE x.key < y.key""",
        "substitution_classes": uses + f""", roles(role, sub) AS (VALUES {", ".join(f"({text(r[1])}, {r[4]})" for r in ontology.role_rows())}),
t AS (SELECT archetype, role, CAST(sum(n) AS BIGINT) AS uses, count(*) AS tools, CAST(max(n) AS DOUBLE) / sum(n) AS lead, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM counts GROUP BY ALL)
SELECT archetype, role, uses, tools, round(h, 6) + 0.0 AS entropy, lead, coalesce(sub, true) AS substitutable, CASE WHEN coalesce(sub, true) THEN lead >= 0.9 ELSE lead < 0.5 END AS surprising FROM t LEFT JOIN roles USING (role)""",
        "archetype_clusters": clusters + """
SELECT archetype, cluster, chains, CAST(chains AS DOUBLE) / sum(chains) OVER (PARTITION BY archetype) AS of_archetype, CAST(chains AS DOUBLE) / sum(chains) OVER (PARTITION BY cluster) AS of_cluster FROM cells""",
        "coverage_totals": f"""
WITH v AS (
  SELECT s_suppkey AS n, CASE WHEN s_suppkey % 28 = 0 THEN ['ANY'] ELSE ['P' || CAST(s_suppkey * s_suppkey % 4 AS VARCHAR)] END AS platforms, CASE WHEN s_suppkey % 20 = 0 THEN ['ANY'] ELSE ['S' || CAST(s_suppkey * s_suppkey % 3 AS VARCHAR)] END AS strategies,
    CASE WHEN s_suppkey % 44 = 0 THEN CAST([] AS VARCHAR[]) ELSE ['E' || CAST(s_suppkey % 3 % 2 AS VARCHAR)] END AS environments FROM supplier WHERE s_suppkey % 4 = 0
), g AS (SELECT * FROM (SELECT unnest({listed(AXES["platforms"])}) AS p), (SELECT unnest({listed(AXES["strategies"])}) AS s), (SELECT unnest({listed(AXES["environments"])}) AS e)),
c AS (SELECT p, s, e, count(n) AS r FROM g LEFT JOIN v ON {cell} GROUP BY p, s, e)
SELECT p AS platforms, s AS strategies, e AS environments, CAST(grouping(p) + grouping(s) + grouping(e) AS INT) AS level, count(*) AS cells, count(*) FILTER (r > 0) AS covered, count(*) FILTER (r = 0) AS holes, max(r) AS most FROM c GROUP BY CUBE (p, s, e)""",
        "practice_findings": chains + "\n" + practices,
        "spot_agreement": judged_sql + """, k AS (SELECT * FROM j WHERE CAST('0x' || md5('0:' || CAST(rec_id AS VARCHAR))[1:8] AS BIGINT) % 100 < 20),
a AS (SELECT batch, count(human_tier = judged_tier) AS checked, avg(CAST(human_tier = judged_tier AS INT)) AS agreement FROM k GROUP BY batch)
SELECT batch, checked, agreement, greatest(last_value(agreement IGNORE NULLS) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - agreement, 0.0) AS fell FROM a""",
        "stale_judgments": judged_sql + "\nSELECT model, prompt_version, count(*) AS n FROM j WHERE model <> 'm1' OR coalesce(prompt_version, '') <> 'v2' GROUP BY ALL",
        "final_tiers": judged_sql + "\nSELECT coalesce(tier_override, CASE WHEN code = 0 THEN 'paper_only' END, adjudicated_tier, scorecard_tier) AS final_tier, count(*) AS records FROM j GROUP BY ALL",
        "evidence_checks": f"""
WITH q AS (SELECT doc_id, text, substr(text, CAST(1 + doc_id % 50 AS BIGINT), CAST(60 + doc_id % 40 AS BIGINT)) AS q FROM documents),
s AS (SELECT 0 AS step, text, {flat("q")} AS q FROM q UNION ALL SELECT 1, text, {flat("q || ' qqzzq'")} FROM q UNION ALL SELECT 2, text, '' FROM q)
SELECT step, q <> '' AND contains({flat("text")}, q) AS verbatim, count(*) AS n FROM s GROUP BY ALL""",
        "extraction_scores": """
WITH l AS (SELECT doc_id, 'quality' AS role FROM labels WHERE quality = 1 UNION SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1),
d AS (SELECT doc_id, 'quality' AS role FROM documents SEMI JOIN labels USING (doc_id) WHERE length(text) >= 800 UNION SELECT doc_id, 'toxic' FROM documents SEMI JOIN labels USING (doc_id) WHERE contains(text, '!')),
f AS (SELECT role, d.doc_id AS g, l.doc_id AS w FROM d FULL JOIN l USING (doc_id, role))
SELECT role, CAST(count(g) AS INT) AS extracted, CAST(count(w) AS INT) AS labelled, CASE WHEN count(g) > 0 THEN count(*) FILTER (g IS NOT NULL AND w IS NOT NULL) / count(g) END AS precision, CASE WHEN count(w) > 0 THEN count(*) FILTER (g IS NOT NULL AND w IS NOT NULL) / count(w) END AS recall FROM f GROUP BY role""",
        "run_costs": """
SELECT 'f' || CAST(o_custkey % 7 AS VARCHAR) AS fixture_id, count(*) AS runs, count(*) FILTER (o_orderkey % 10 = 3) AS errors, CAST(sum(o_custkey % 60) FILTER (o_orderkey % 10 <> 3) AS DOUBLE) AS seconds, CAST(sum(o_custkey % 60) FILTER (o_orderkey % 10 <> 3) AS DOUBLE) / count(*) FILTER (o_orderkey % 10 <> 3) AS seconds_a_run,
  CAST(sum(o_custkey % 900) FILTER (o_orderkey % 10 <> 3) AS BIGINT) AS tokens, CAST(sum(o_orderkey % 500) FILTER (o_orderkey % 10 <> 3) AS DOUBLE) / CAST(sum(o_custkey % 900) FILTER (o_orderkey % 10 <> 3) AS DOUBLE) AS reasoning_share FROM orders GROUP BY ALL""",
        "single_suites": chains + "\nSELECT rec_id FROM steps WHERE chain = 'claimed' GROUP BY rec_id HAVING count(*) = 1 AND bool_and(coalesce(tool IN ('dada2', 'bwa', 'fastqc'), false))",
        "rule_ladder": """
WITH d AS (SELECT c_custkey AS dataset_id, CASE c_custkey % 3 WHEN 0 THEN 'r0' WHEN 1 THEN 'r1' ELSE 'r2' END AS by_rules, CASE WHEN c_custkey % 13 > 0 THEN 'r' || CAST(c_custkey % 4 AS VARCHAR) END AS by_rank FROM customer)
SELECT * FROM d WHERE by_rules IS DISTINCT FROM by_rank""",
        "catalog_totals": issues + "\nSELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'error') = 0 AS passed, (SELECT count(*) FROM orders) AS records FROM i",
    }


SQL = _sql()
