"""Queries over steps and papers derived from ``lineitem`` and ``orders``: each line is a step, each order a paper."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ontology
from ..functions.text import clean, period
from ..operators import corpus, survey
from ..operators.match import alias_index, counted, matches, with_matches

#: Surface forms of names as papers write them.
NAMES = ["DADA2", "dada2 pipeline", "Kraken 2", "kraken2 classifier", "BWA mem", "MEGAHIT3", "MetaBAT 2", "CheckM2", "FastQC", "SILVA 138", "GTDB", "own script", "wfmash", "Picard"]


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps without what their papers say about them."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    return rows.select(
        F.col("l_orderkey").alias("paper"), (F.col("l_linenumber") * 10000000 + F.col("l_partkey")).alias("step_pos"), pick([r[1] for r in ontology.role_rows()], F.col("l_partkey") % 48).alias("role"),
        pick(NAMES, (F.col("l_suppkey") * 7 + F.col("l_partkey")) % len(NAMES)).alias("tool_raw"), F.when(F.col("l_quantity") >= 15, F.concat(F.lit("1."), F.col("l_linenumber").cast("string"))).alias("version"),
    )


def named(rows: DataFrame) -> DataFrame:
    return rows.withColumn("tool", F.nullif(clean(F.col("tool_raw")), F.lit("")))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("paper"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    return named(lines(spark, sf_dir).join(orders, "paper"))


def matched_counts(spark: SparkSession, rows: DataFrame, *by: str) -> DataFrame:
    """Names are matched after counting: the steps of a frequent name never meet in one task."""
    return with_matches(named(counted(rows, *by)), ontology.tools(spark), ontology.databases(spark))


def period_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched_counts(spark, steps(spark, sf_dir).withColumn("period", period(F.col("date"))), "role", "period")


def role_consensus(spark, sf_dir):
    """The leading tool of each role and its hundred most used ones; more names than that stay out of a row."""
    return survey.consensus(matched_counts(spark, lines(spark, sf_dir), "role"), ontology.roles(spark), top_n=100)


def tool_drift(spark, sf_dir):
    return survey.drift(period_counts(spark, sf_dir))


def powered_roles(spark, sf_dir):
    return survey.powered(survey.drift(period_counts(spark, sf_dir)))


def version_reporting(spark, sf_dir):
    return survey.version_rate(steps(spark, sf_dir))


def unmatched_names(spark, sf_dir):
    return survey.unmatched(matched_counts(spark, lines(spark, sf_dir)))


def corpus_summary(spark, sf_dir):
    rows = lines(spark, sf_dir)
    papers = rows.agg(F.countDistinct("paper").alias("papers"))  # one row
    return survey.summary(matched_counts(spark, rows, "role")).crossJoin(F.broadcast(papers))


def name_matches(spark, sf_dir):
    return matches(lines(spark, sf_dir), alias_index(ontology.tools(spark))).select("tool_raw", "matched", "hit_rank")


def role_precedence(spark, sf_dir):
    return survey.role_precedence(steps(spark, sf_dir))


def hint_inversions(spark, sf_dir):
    return survey.hint_inversions(steps(spark, sf_dir), ontology.roles(spark))


def consensus_chains(spark, sf_dir):
    return survey.consensus_chains(steps(spark, sf_dir))


def first_records(spark, sf_dir):
    """Orders as records of runs: the customer is the paper, every fifth has no id."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    records = orders.select(F.when(F.col("o_custkey") % 5 > 0, F.concat(F.lit("P"), F.col("o_custkey").cast("string"))).alias("id"), (F.col("o_orderkey") % 7).alias("run_ord"), F.col("o_orderkey").alias("rec_ord"))
    return corpus.merged_runs(records, F.col("id"), ["run_ord", "rec_ord"])


def cleaned_pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.md5(clean(F.col("html"))).alias("digest"), F.length(clean(F.col("html"))).cast("bigint").alias("chars"))


QUERIES = {f.__name__: f for f in (role_consensus, tool_drift, powered_roles, version_reporting, unmatched_names, corpus_summary, name_matches, role_precedence, hint_inversions, consensus_chains, first_records, cleaned_pages)}


def _sql() -> dict[str, str]:
    text = lambda x: "'" + x.replace("'", "''") + "'"
    roles = ", ".join(text(r[1]) for r in ontology.role_rows())
    role_table = ", ".join(f"({text(r[1])}, {text(r[2])}, {r[3]}, {r[4]})" for r in ontology.role_rows())
    index = lambda entries: ", ".join(f"({text(a)}, {text(e[0])}, {i})" for i, e in enumerate(entries) for a in [e[0], e[1], *e[2]])
    base = f"""
WITH names AS (SELECT [{", ".join(map(text, NAMES))}] AS n, [{roles}] AS r),
role_dim(role, stage, hint, sub) AS (VALUES {role_table}),
steps AS (
  SELECT l_orderkey AS paper, l_linenumber * 10000000 + l_partkey AS step_pos, r[CAST(l_partkey % 48 AS INT) + 1] AS role,
    n[CAST((l_suppkey * 7 + l_partkey) % {len(NAMES)} AS INT) + 1] AS tool_raw,
    CASE WHEN l_quantity >= 15 THEN '1.' || CAST(l_linenumber AS VARCHAR) END AS version, strftime(o_orderdate, '%Y-%m-%d') AS date
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey, names),
dated AS (SELECT *, CAST(y - y % 3 AS VARCHAR) || '-' || substr(CAST(y - y % 3 + 2 AS VARCHAR), 3, 2) AS period FROM (SELECT *, CAST(substr(date, 1, 4) AS INT) AS y FROM steps))"""
    match = "".join(
        f""",
{k}_keys AS (SELECT key, max_by(id, pos) AS id FROM (SELECT regexp_replace(lower(a), '[^a-z0-9]', '', 'g') AS key, id, pos FROM (VALUES {index(e)}) t(a, id, pos)) GROUP BY key),
{k}_runs AS (
  SELECT tool_raw, -1 AS pos, 0 AS variant, regexp_replace(lower(tool_raw), '[^a-z0-9]', '', 'g') AS key FROM distinct_names
  UNION ALL SELECT tool_raw, pos, 0, run FROM runs
  UNION ALL SELECT tool_raw, pos, 1, regexp_replace(run, '[0-9]+$', '') FROM runs WHERE regexp_matches(run, '[0-9]$') AND length(regexp_replace(run, '[0-9]+$', '')) >= 4),
{k}_hits AS (SELECT tool_raw, min_by(id, pos * 2 + variant) AS id, min(pos) AS hit_rank FROM {k}_runs JOIN {k}_keys USING (key) GROUP BY tool_raw)"""
        for k, e in (("tool", [(t[0], t[1], t[2]) for t in ontology.TOOLS]), ("db", ontology.DATABASES))
    )
    runs = """,
distinct_names AS (SELECT DISTINCT tool_raw FROM steps),
split AS (SELECT tool_raw, list_filter(string_split_regex(tool_raw, '[^A-Za-z0-9]+'), lambda x: x <> '') AS t FROM distinct_names),
ordered AS (SELECT tool_raw, k, i, lower(array_to_string(t[i + 1:i + k], '')) AS run FROM split, range(1, 5) a(k), range(0, 8) b(i) WHERE i + k <= len(t)),
runs AS (SELECT tool_raw, CAST(row_number() OVER (PARTITION BY tool_raw ORDER BY k DESC, i) - 1 AS INT) AS pos, run FROM ordered)"""
    joined = """,
m AS (SELECT d.*, t.id AS matched, b.id AS matched_db, coalesce(t.id, lower(d.tool_raw)) AS key FROM dated d LEFT JOIN tool_hits t USING (tool_raw) LEFT JOIN db_hits b USING (tool_raw)),
per AS (SELECT role, period, sum(n) AS n, min({'m': -n, 'k': key}) AS top FROM (SELECT role, period, key, count(*) AS n FROM m WHERE role <> 'custom' GROUP BY ALL) GROUP BY role, period),
full_grid AS (SELECT g.role, g.period, CAST(coalesce(n, 0) AS BIGINT) AS n, top FROM (SELECT * FROM (SELECT DISTINCT role FROM per), (SELECT DISTINCT period FROM dated)) g LEFT JOIN per USING (role, period))"""
    whole = base + runs + match + joined
    return {
        "role_consensus": whole + """
SELECT role, CASE WHEN stage IN ('acquire', 'preprocess') THEN 'reads' ELSE stage END AS stage, sub AS substitutable, CAST(n AS BIGINT) AS n, top, CAST(top_n AS DOUBLE) / n AS concentration, tools
FROM (SELECT role, sum(n) AS n, first(key ORDER BY n DESC, key) AS top, max(n) AS top_n, string_agg(key || ':' || CAST(n AS VARCHAR), '|' ORDER BY n DESC, key) AS tools
      FROM (SELECT role, key, count(*) AS n FROM m WHERE role <> 'custom' GROUP BY ALL) GROUP BY role HAVING sum(n) >= 3) JOIN role_dim USING (role)""",
        "tool_drift": whole + "\nSELECT role, period, n, top.k AS top, CAST(-top.m AS DOUBLE) / n AS top_share FROM full_grid",
        "powered_roles": whole + "\nSELECT role, CAST(sum(n) AS BIGINT) AS total, count(*) FILTER (n >= 6) >= 2 AS powered FROM full_grid GROUP BY role",
        "version_reporting": base + "\nSELECT period, count(version) AS with_version, count(*) AS total FROM dated GROUP BY period",
        "unmatched_names": whole + "\nSELECT DISTINCT tool_raw AS tool FROM m WHERE matched IS NULL AND matched_db IS NULL",
        "corpus_summary": whole + """
SELECT count(DISTINCT paper) AS papers, count(*) AS steps, count(tool_raw) AS named, CAST(count(matched) AS DOUBLE) / count(tool_raw) AS match_rate,
  count(*) FILTER (matched IS NULL AND matched_db IS NOT NULL) AS named_databases, count(DISTINCT role) AS roles FROM m""",
        "name_matches": whole + "\nSELECT tool_raw, id AS matched, hit_rank FROM tool_hits",
        "role_precedence": base + """, span AS (SELECT paper, role, min(step_pos) AS lo, max(step_pos) AS hi FROM steps GROUP BY ALL)
SELECT a.role AS a, b.role AS b, count(*) AS chains, count(*) FILTER (a.hi < b.lo) AS before FROM span a JOIN span b ON a.paper = b.paper AND a.role <> b.role GROUP BY ALL""",
        "hint_inversions": base + """, w AS (SELECT role, hint, lag(role) OVER o AS prev_role, lag(hint) OVER o AS prev_hint FROM steps JOIN role_dim USING (role) WINDOW o AS (PARTITION BY paper ORDER BY step_pos))
SELECT prev_role, role, count(*) AS n FROM w WHERE hint < prev_hint GROUP BY ALL""",
        "consensus_chains": base + """, q AS (SELECT string_agg(role, '>' ORDER BY step_pos) AS sequence FROM steps GROUP BY paper)
SELECT sequence, count(*) AS chains, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM q) AS share FROM q GROUP BY sequence""",
        "first_records": """
WITH r AS (SELECT CASE WHEN o_custkey % 5 > 0 THEN 'P' || CAST(o_custkey AS VARCHAR) END AS id, o_orderkey % 7 AS run_ord, o_orderkey AS rec_ord FROM orders)
SELECT * FROM r WHERE id IS NULL UNION ALL SELECT id, run_ord, rec_ord FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY run_ord, rec_ord) AS k FROM r WHERE id IS NOT NULL) WHERE k = 1""",
        "cleaned_pages": """
SELECT page_id, md5(t) AS digest, length(t) AS chars FROM (SELECT page_id, trim(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')) AS t FROM pages)""",
    }


SQL = _sql()
