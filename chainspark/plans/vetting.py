"""Queries of repositories, databases, expectations, steps and tools, where no other plan has them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ontology
from ..operators import corpus, evaluate, extract, meta, survey, vetting
from . import catalog, survey as surveys
from .catalog import EXPECT, ROLE_IDS
from .catalog import _pick as pick

PATHS = ["main.nf", "workflow/Snakefile", "tools/x.cwl", "run.sh", "env/environment.yml", "Dockerfile", "README.md", "LICENSE", "tests/a.py", ".github/workflows/ci.yml", "docs/notes.Rmd", "src/z.py"]
DATABASES = [None, "SILVA 138", "SILVA", "GTDB r95", "own genomes"]
DB_ROLES = [["taxonomy_assign", "classify_genomes"], ["detect_amr", "taxonomy_assign"]]
STEP = "struct<order: int, role: string, tool_raw: string, version: string, params: string>"


def repo_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as repositories, their lines as paths."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("repo"), pick(PATHS, (F.col("l_partkey") + F.col("l_linenumber")) % len(PATHS)).alias("path"))


def repository_scores(spark, sf_dir):
    """Facts of the repositories of all records, counted."""
    records = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("rec_id"), F.when(F.col("o_custkey") % 4 > 0, F.col("o_orderkey")).alias("repo"))
    facts = ["engine", "has_readme", "has_license", "has_tests", "has_ci", "has_environment"]
    return vetting.scorecard(repo_files(spark, sf_dir), records).groupBy(*facts).agg(F.count(F.lit(1)).alias("records"), F.sum("files").alias("files"))


def unspecified_databases(spark, sf_dir):
    """Roles that need a database, in records that name none with a release."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    steps = lines.select(F.col("l_orderkey").alias("rec_id"), pick(ROLE_IDS, F.col("l_partkey") % 48).alias("role"), pick(DATABASES, F.col("l_suppkey") % len(DATABASES)).alias("database"))
    return vetting.unspecified_databases(steps, spark.createDataFrame([(x,) for x in DB_ROLES], "roles array<string>"))


def failing_expectations(spark, sf_dir):
    """Expectations that chains of all orders fail, by how often."""
    return evaluate.failures(catalog.assertion_rows(spark, sf_dir))


def step_quality(spark, sf_dir):
    n = F.col("l_suppkey")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(pick(["Fennel v0.9", "sorrel", "", None, "Ocelot 12", "wren (3.1)"], F.col("l_partkey") % 6).alias("tool_raw"), F.when(n % 3 > 0, F.when(n % 5 > 0, "quote").otherwise(" \n")).alias("evidence"))
    return extract.step_quality(rows)


def record_tools(spark, sf_dir):
    """Known and unknown tools of each paper, in order of steps."""
    rows = surveys.named(surveys.lines(spark, sf_dir))
    kinds = surveys.matched_counts(spark, rows).select("tool_raw", "matched")
    lists = extract.tool_lists(rows.join(kinds, "tool_raw", "left"), ["paper"])
    return lists.select("paper", F.array_join("tools_known", "|").alias("known"), F.array_join("tools_unknown", "|").alias("unknown"))


def denoising_share(spark, sf_dir):
    """How denoising replaces clustering, period by period."""
    return survey.role_share(survey.drift(surveys.period_counts(spark, sf_dir)), "denoise", "cluster_otu")


def tool_ranks(spark, sf_dir):
    """The three most used tools of each role and period."""
    return survey.ranked_drift(surveys.period_counts(spark, sf_dir), 3)


def leading_tools(spark, sf_dir):
    """First and last period in which a tool leads a role."""
    return meta.leading_periods(survey.drift(surveys.period_counts(spark, sf_dir)))


def custom_uses(spark, sf_dir):
    """Custom steps by name and by the stages around them."""
    rows = surveys.named(surveys.lines(spark, sf_dir)).withColumn("matched", F.lit(None).cast("string"))
    return survey.custom_uses(rows, ontology.roles(spark))


def records(spark, sf_dir) -> DataFrame:
    """Orders as records of runs: nested papers and chains, with markup in titles and names."""
    line = F.struct(F.col("l_linenumber").alias("order"), pick([*ROLE_IDS[:47], "no_such_role"], F.col("l_partkey") % 48).alias("role"), F.concat(F.lit("<i>"), pick(surveys.NAMES, (F.col("l_suppkey") * 7 + F.col("l_partkey")) % len(surveys.NAMES)), F.lit("</i> ")).alias("tool_raw"),
                    F.when(F.col("l_quantity") >= 15, "1.0").alias("version"), F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("k  = "), F.repeat(F.lit("9 "), (F.col("l_partkey") % 150).cast("int")))).otherwise("<b></b>").alias("params"))
    chains = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("key")).agg(F.array_sort(F.collect_list(line)).alias("steps"))
    key, date = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm")
    paper = F.struct(key.cast("string").alias("id"), F.concat(F.lit("A <b>title</b>\n no. "), key.cast("string")).alias("title"), date.alias("date"), F.concat(F.lit("10.5/"), key.cast("string")).alias("doi"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(key.alias("key"), (key % 7).cast("int").alias("run_ord"), key.alias("rec_ord"), paper.alias("paper"))
    return orders.join(chains, "key").select("run_ord", "rec_ord", "paper", F.struct(F.lit("partial").alias("completeness"), F.col("steps").cast(f"array<{STEP}>").alias("steps")).alias("chain"))


def paper_steps(spark, sf_dir):
    """Steps of all papers as they are shown: cleaned, with stage and matches."""
    found = corpus.paper_steps(records(spark, sf_dir), ontology.roles(spark), ontology.tools(spark), ontology.databases(spark))
    told = found.groupBy("date", "completeness", "role", "stage", "tool", "matched", "matched_db", "version").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("params")).alias("chars"), F.count("params").alias("with_params"), F.min("title").alias("title"), F.max("doi").alias("doi"))
    return told


def longest_chains(spark, sf_dir):
    """The fifty longest chains, in order of length, run and record."""
    rows = records(spark, sf_dir).select("run_ord", "rec_ord", F.col("chain.steps").alias("steps"))
    return survey.by_step_count(rows).limit(50).select("run_ord", "rec_ord", "n_steps")


QUERIES = {f.__name__: f for f in (repository_scores, unspecified_databases, failing_expectations, step_quality, record_tools, denoising_share, tool_ranks, leading_tools, custom_uses, paper_steps, longest_chains)}


def _sql() -> dict[str, str]:
    text = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    at = lambda xs, i: "[" + ", ".join(map(text, xs)) + f"][CAST({i} AS INT) + 1]"
    whole = surveys.SQL["tool_drift"].rpartition("\nSELECT role, period")[0]
    fact = lambda pattern: f"bool_or(regexp_matches(lower(path), {text(pattern)}))"
    expect = catalog.SQL["expectation_results"].rpartition("\nSELECT run")[0].replace("SELECT run, fixture_id, CASE", "SELECT run, fixture_id, concat_ws(':', kind, arg, arg2) AS label, CASE")
    engines = " ".join(f"WHEN bool_or(regexp_matches(path, {text(p)})) THEN {text(e)}" for e, p in vetting.ENGINES)
    name = lambda a: f"n[CAST((l_suppkey * 7 + l_partkey) % {len(surveys.NAMES)} AS INT) + 1]"
    stage = "CASE WHEN stage IN ('acquire', 'preprocess') THEN 'reads' ELSE coalesce(stage, 'specialty') END"
    return {
        "repository_scores": f"""
WITH f AS (SELECT l_orderkey AS repo, {at(PATHS, f"(l_partkey + l_linenumber) % {len(PATHS)}")} AS path FROM lineitem),
g AS (SELECT repo, count(*) AS files, CASE {engines} END AS engine, {fact(r"(^|/)readme(\.|$)")} AS has_readme, {fact(r"(^|/)licen[cs]e(\.|$)")} AS has_license, {fact("(^|/)tests?/")} AS has_tests, {fact(r"^\.github/workflows/")} AS has_ci,
  bool_or(path IN ('env/environment.yml', 'Dockerfile')) AS has_environment FROM f GROUP BY repo),
r AS (SELECT o_orderkey AS rec_id, CASE WHEN o_custkey % 4 > 0 THEN o_orderkey END AS repo FROM orders)
SELECT engine, has_readme, has_license, has_tests, has_ci, has_environment, count(*) AS records, CAST(sum(files) AS BIGINT) AS files FROM r LEFT JOIN g USING (repo) GROUP BY ALL""",
        "unspecified_databases": f"""
WITH s AS (SELECT l_orderkey AS rec_id, {at(ROLE_IDS, "l_partkey % 48")} AS role, {at(DATABASES, f"l_suppkey % {len(DATABASES)}")} AS db FROM lineitem)
SELECT rec_id, role FROM s WHERE role IN ('taxonomy_assign', 'classify_genomes', 'detect_amr') GROUP BY ALL HAVING NOT bool_or(coalesce(regexp_matches(db, '[0-9]'), false))""",
        "failing_expectations": expect + "\nSELECT fixture_id, label, count(*) AS n FROM r WHERE NOT ok GROUP BY ALL",
        "step_quality": """
SELECT count(*) AS steps, count(*) FILTER (l_partkey % 6 IN (0, 5)) AS version_in_name, count(*) FILTER (l_partkey % 6 = 2) AS empty_name, count(*) FILTER (l_suppkey % 3 = 0 OR l_suppkey % 5 = 0) AS without_evidence FROM lineitem""",
        "record_tools": whole + """
SELECT paper, coalesce(string_agg(matched, '|' ORDER BY step_pos, matched) FILTER (matched IS NOT NULL), '') AS known, coalesce(string_agg(tool_raw, '|' ORDER BY step_pos, tool_raw) FILTER (matched IS NULL), '') AS unknown FROM m GROUP BY paper""",
        "denoising_share": whole + """, p AS (SELECT period, CAST(sum(n) FILTER (role = 'denoise') AS DOUBLE) / sum(n) AS share FROM full_grid WHERE role IN ('denoise', 'cluster_otu') GROUP BY period),
s AS (SELECT period, share, nullif(sign(share - lag(share) OVER (ORDER BY period)), 0) AS s FROM p)
SELECT period, share, count(DISTINCT s) OVER (ORDER BY period) <= 1 AS monotonic FROM s""",
        "tool_ranks": whole + """, c AS (SELECT role, period, key, count(*) AS n FROM m WHERE role <> 'custom' GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY role, period ORDER BY n DESC, key) AS INT) AS rank, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY role, period) AS share FROM c)
SELECT role, period, rank, key, n, share FROM r WHERE rank <= 3""",
        "leading_tools": whole + "\nSELECT role, top.k AS top, min(period) AS first, max(period) AS last, count(*) AS periods FROM full_grid WHERE top IS NOT NULL GROUP BY role, top.k",
        "custom_uses": whole + f""", s AS (SELECT paper, step_pos, steps.role AS role, lower(tool_raw) AS key, {stage} AS stage FROM steps LEFT JOIN role_dim USING (role)),
p AS (SELECT *, lag(stage) OVER w AS before, lead(stage) OVER w AS after FROM s WINDOW w AS (PARTITION BY paper ORDER BY step_pos))
SELECT key, before, after, count(*) AS n FROM p WHERE role = 'custom' GROUP BY ALL""",
        "paper_steps": whole + f""",
e AS (SELECT l_orderkey AS key, strftime(o_orderdate, '%Y-%m-%d') AS date, CASE WHEN l_partkey % 48 = 47 THEN 'no_such_role' ELSE r[CAST(l_partkey % 48 AS INT) + 1] END AS role, {name("")} AS tool, CASE WHEN l_quantity >= 15 THEN '1.0' END AS version,
  CASE WHEN l_partkey % 2 = 0 THEN rtrim('k = ' || rtrim(repeat('9 ', CAST(l_partkey % 150 AS INT)))) END AS params FROM lineitem JOIN orders ON l_orderkey = o_orderkey, names)
SELECT date, 'partial' AS completeness, e.role AS role, {stage} AS stage, tool, t.id AS matched, b.id AS matched_db, version, count(*) AS n, CAST(sum(length(params[1:200])) AS BIGINT) AS chars, count(params) AS with_params, min('A title no. ' || CAST(key AS VARCHAR)) AS title, max('10.5/' || CAST(key AS VARCHAR)) AS doi
FROM e LEFT JOIN role_dim d ON d.role = e.role LEFT JOIN tool_hits t ON t.tool_raw = tool LEFT JOIN db_hits b ON b.tool_raw = tool GROUP BY ALL""",
        "longest_chains": """
SELECT CAST(o_orderkey % 7 AS INT) AS run_ord, o_orderkey AS rec_ord, CAST(count(*) AS INT) AS n_steps FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey ORDER BY n_steps DESC, run_ord, rec_ord LIMIT 50""",
    }


SQL = _sql()
