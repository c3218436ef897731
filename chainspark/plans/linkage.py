"""Queries of record linkage: each order is a candidate record, its customer and key give DOI, repository and title."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import written
from ..operators import linkage

LANES = ["registry", "europepmc", "biorxiv", "arxiv"]
FIELDS = ["doi", "repo", "title"]


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOIs link neighbours, repositories some customers' orders; one title in 23 is the same long one, one in 5 too short."""
    n, c = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda x: x.cast("string")
    part = lambda x, k: text(F.call_function("div", x, F.lit(k)))
    lane = F.element_at(F.array(*map(F.lit, [*LANES, "other"])), (c % 5 + 1).cast("int"))
    doi = F.when(n % 4 == 1, F.concat(F.when(n % 8 == 1, "https://doi.org/10.5/A.").otherwise("10.5/a."), part(n, 40)))
    repo = F.when(n % 7 == 3, F.concat(F.when(c % 2 == 0, "https://Host.net/U/").otherwise("git@host.net:u/"), part(c, 3), F.lit("-"), text(n % 9), F.when(n % 2 == 0, ".git").otherwise("/")))
    title = F.when(n % 23 == 0, F.lit("Supplementary <i>workflow</i>, code & data")).when(n % 5 == 0, F.lit("Data 1")).when(n % 3 == 0, F.concat(F.lit("Chains of sample set no. "), part(n, 70)))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    return orders.select(n.alias("rec_id"), lane.alias("lane"), doi.alias("doi"), repo.alias("repo"), title.alias("title"))


def works(spark, sf_dir) -> DataFrame:
    rows = candidates(spark, sf_dir)
    return linkage.merged_works(rows, linkage.linked_works(rows), LANES, FIELDS)


def linked_works(spark, sf_dir):
    return linkage.linked_works(candidates(spark, sf_dir))


def shared_keys(spark, sf_dir):
    return linkage.shared_keys(candidates(spark, sf_dir))


def merged_works(spark, sf_dir):
    """Works of more than one record, with each field of the best lane."""
    return works(spark, sf_dir).where("n_records > 1").withColumn("lanes", F.array_join("lanes", "|"))


def staging_report(spark, sf_dir):
    return linkage.staging_report(written(works(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (linked_works, shared_keys, merged_works, staging_report)}


def _sql() -> dict[str, str]:
    lanes = ", ".join(f"'{x}'" for x in [*LANES, "other"])
    base = f"""
WITH RECURSIVE r AS (
  SELECT o_orderkey AS rec_id, [{lanes}][CAST(o_custkey % 5 AS INT) + 1] AS lane,
    CASE WHEN o_orderkey % 4 = 1 THEN (CASE WHEN o_orderkey % 8 = 1 THEN 'https://doi.org/10.5/A.' ELSE '10.5/a.' END) || CAST(o_orderkey // 40 AS VARCHAR) END AS doi,
    CASE WHEN o_orderkey % 7 = 3 THEN (CASE WHEN o_custkey % 2 = 0 THEN 'https://Host.net/U/' ELSE 'git@host.net:u/' END) || CAST(o_custkey // 3 AS VARCHAR) || '-' || CAST(o_orderkey % 9 AS VARCHAR) || CASE WHEN o_orderkey % 2 = 0 THEN '.git' ELSE '/' END END AS repo,
    CASE WHEN o_orderkey % 23 = 0 THEN 'Supplementary <i>workflow</i>, code & data' WHEN o_orderkey % 5 = 0 THEN 'Data 1' WHEN o_orderkey % 3 = 0 THEN 'Chains of sample set no. ' || CAST(o_orderkey // 70 AS VARCHAR) END AS title,
    CASE WHEN o_orderkey % 4 = 1 THEN '10.5/a.' || CAST(o_orderkey // 40 AS VARCHAR) END AS dk,
    CASE WHEN o_orderkey % 7 = 3 THEN 'host.net/u/' || CAST(o_custkey // 3 AS VARCHAR) || '-' || CAST(o_orderkey % 9 AS VARCHAR) END AS rk,
    CASE WHEN o_orderkey % 23 = 0 THEN 'supplementaryworkflowcodedata' WHEN o_orderkey % 5 > 0 AND o_orderkey % 3 = 0 THEN 'chainsofsamplesetno' || CAST(o_orderkey // 70 AS VARCHAR) END AS tk FROM orders
), k AS (
  SELECT rec_id, 'doi' AS kind, dk AS key FROM r WHERE dk IS NOT NULL UNION ALL SELECT rec_id, 'repo', rk FROM r WHERE rk IS NOT NULL UNION ALL SELECT rec_id, 'title', tk FROM r WHERE tk IS NOT NULL
), s AS (SELECT kind, key, min(rec_id) AS first_id, count(*) AS n FROM k GROUP BY ALL HAVING count(*) > 1)"""
    works = base + """, e AS (
  SELECT rec_id AS a, first_id AS b FROM k JOIN s USING (kind, key) WHERE rec_id <> first_id
), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e
), cc(node, root) USING KEY (node) AS (
  SELECT DISTINCT a, a FROM both_ways UNION SELECT x.a, min(c.root) FROM cc c JOIN both_ways x ON x.b = c.node JOIN recurring.cc u ON u.node = x.a WHERE c.root < u.root GROUP BY x.a
), w AS (SELECT rec_id, coalesce(root, rec_id) AS work_id FROM r LEFT JOIN cc ON node = rec_id
), p AS (SELECT *, coalesce(nullif(list_position([""" + ", ".join(f"'{x}'" for x in LANES) + f"""], lane), 0), {len(LANES) + 1}) * 1000000000000 + rec_id AS place FROM r JOIN w USING (rec_id)
), m AS (SELECT work_id, count(*) AS n_records, array_to_string(list_sort(list(DISTINCT lane)), '|') AS lanes, """ + ", ".join(f"min_by({c}, place) FILTER ({c} <> '') AS {c}" for c in FIELDS) + " FROM p GROUP BY work_id)"
    return {
        "shared_keys": base + "\nSELECT * FROM s",
        "linked_works": works + "\nSELECT * FROM w",
        "merged_works": works + "\nSELECT * FROM m WHERE n_records > 1",
        "staging_report": works + """
SELECT lane, count(*) AS works, count(repo) AS with_code, count(repo) / count(*) AS share FROM (SELECT repo, unnest(string_split(lanes, '|')) AS lane FROM m) GROUP BY lane
UNION ALL SELECT NULL, count(*), count(repo), count(repo) / count(*) FROM m""",
    }


SQL = _sql()
