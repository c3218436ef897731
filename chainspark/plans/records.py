"""Queries of the form of catalog records: each order is a raw JSON document, its customer decides what is broken in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ontology
from ..operators import conformance

DOCUMENT = (
    '{"id":"ID","name":"N","archetype":["x"],"provenance":{"sources":[{"kind":"doi","id":"10.5/a","authors":["A","B"],"fulltext_available":true}],"code":[{"url":"u","stars":3}]},'
    '"claimed":{"completeness":"partial","steps":[{"order":0,"role":"trim","params":{"k":21,"mode":null,"list":[1,"2"]}},{"order":1.0,"role":"bin","evidence":[{"source":"paper","locator":"l","quote":"q"}]}]},'
    '"observed":{"steps":[{"order":0,"role":"trim","tool":"t"},{"order":1,"role":"bin","evidence":[{"source":"repo","locator":"l"}]}]},'
    '"outputs":["mags","figures"],"applicability":{"platform":["ANY"],"read_length_min":100},"vetting":{"tier":"usable","scorecard":{"has_ci":false}},"record_meta":{"schema_version":"0.1.0","first_seen":"2024"}}'
)
LONG = "q" * 1201
#: What is replaced by what, and the issues that this makes: place, code and message. One case for each kind of rule and branch.
BROKEN = [
    ("", "", []),
    ('"name":"N",', "", [("<root>", "form_required", "name is required")]),
    ('"name":"N"', '"name":"N","zz":1,"yy":{"deep":[1]}', [("<root>", "form_closed", "unexpected keys: yy, zz")]),
    ('"id":"ID"', '"id":"Bad_Id"', [("id", "form_pattern", f'"Bad_Id" does not match {conformance.SLUG}')]),
    ('["x"]', "[]", [("archetype", "form_min_items", "[] has too few items")]),
    ('"kind":"doi"', '"kind":"blog"', [("provenance/sources/0/kind", "form_enum", '"blog" is not one of arxiv, biorxiv, medrxiv, pubmed, europepmc, doi, registry, url')]),
    ('"url":"u"', '"link":"u"', [("provenance/code/0", "form_closed", "unexpected keys: link"), ("provenance/code/0", "form_required", "url is required")]),
    ('["A","B"]', '["A",7]', [("provenance/sources/0/authors/1", "form_type", "7 is not of type string")]),
    ('available":true', 'available":"yes"', [("provenance/sources/0/fulltext_available", "form_type", '"yes" is not of type boolean')]),
    ('"steps":[{"order":0,"role":"trim","params"', '"steps":[{"order":-1,"role":"trim","params"', [("claimed/steps/0/order", "form_minimum", "-1 is less than 0")]),
    ('"order":1.0', '"order":"1"', [("claimed/steps/1/order", "form_type", '"1" is not of type integer')]),
    ('"k":21', '"k":{"a":1}', [("claimed/steps/0/params/k", "form_type", '{"a":1} is not of type string or number or boolean or array or null')]),
    ('"quote":"q"', f'"quote":"{LONG}"', [("claimed/steps/1/evidence/0/quote", "form_max_length", '"' + "q" * 199 + " …")]),
    ('"observed":{"steps":[{"order":0,"role":"trim","tool":"t"},{"order":1,"role":"bin","evidence":[{"source":"repo","locator":"l"}]}]}', '"observed":null', []),
    ('{"order":0,"role":"trim","tool":"t"},{"order":1,"role":"bin","evidence":[{"source":"repo"', '{"order":0},{"order":1,"role":"bin","evidence":[{"source":"blog"', [("observed/steps/1/evidence/0/source", "form_enum", '"blog" is not one of paper, repo, registry, readme, adjudicator')]),
    ('{"order":0,"role":"trim","tool":"t"}', '{"order":null,"role":"trim","tool":3}', [("observed/steps/0/order", "form_type", "null is not of type integer")]),
    ('"observed":{', '"observed":"none","zz":{', [("<root>", "form_closed", "unexpected keys: zz"), ("observed", "form_type", '"none" is not of type object or null')]),
    ('"tier":"usable"', '"tier":"best"', [("vetting/tier", "form_enum", '"best" is not one of ' + conformance.TIERS.replace(" ", ", "))]),
    ('"0.1.0"', '"0.2.0"', [("record_meta/schema_version", "form_const", '"0.2.0" should be 0.1.0')]),
    ('"first_seen":"2024"', '"notes":null', [("record_meta", "form_required", "first_seen is required"), ("record_meta/notes", "form_type", "null is not of type string")]),
    ('"read_length_min":100', '"read_length_min":2.5', [("applicability/read_length_min", "form_type", "2.5 is not of type integer")]),
    ('"mags","figures"', '"mags","novel","figures"', [("outputs/1", "form_enum", '"novel" is not one of ' + conformance.ENUMS["output"].replace(" ", ", "))]),
    ('"claimed":{', '"claimed":null,"summary":{', [("claimed", "form_type", "null is not of type object"), ("summary", "form_type", '{"completeness":"partial","steps":[{"order":0,"params":{"k":21,"list":[1,"2"],"mode":null},"role":"trim"},{"evidence":[{"locator":"l","quote":"q","source":"paper"}],"order":1,"role":"bin"}]} is not of type string')]),
    (DOCUMENT[:40], "[", []),
]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rec_id, raw``. A row of two numbers becomes a text of a kilobyte, so rows are dealt out before, however few files there are."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")
    own_id = F.concat(F.lit('"r-'), F.col("o_orderkey").cast("string"), F.lit('"'))
    around = [(DOCUMENT.replace(old, new) if old else DOCUMENT).split('"ID"') for old, new, _ in BROKEN]
    texts = [F.concat(F.lit(parts[0]), *[x for part in parts[1:] for x in (own_id, F.lit(part))]) for parts in around]
    kind = F.col("o_custkey") % len(BROKEN)
    return orders.select(F.col("o_orderkey").alias("rec_id"), F.coalesce(*[F.when(kind == i, text) for i, text in enumerate(texts) if i], texts[0]).alias("raw"))


def record_forms(spark, sf_dir):
    """Issues of the form of all records, counted by what they say."""
    return conformance.record_form_issues(documents(spark, sf_dir)).groupBy("where", "code", "message").agg(F.count(F.lit(1)).alias("n"), F.min("rec_id").alias("first_id"))


def ontology_checks(spark, sf_dir):
    """Parts as tools and suppliers as archetypes, some of which name roles that there are not."""
    ids = [r[1] for r in ontology.role_rows()]
    role = lambda x: F.element_at(F.array(*map(F.lit, [*ids, "unheard_of", "typo"])), (x % 50 + 1).cast("int"))
    p, s = F.col("p_partkey"), F.col("s_suppkey")
    tools = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("t"), p.cast("string")).alias("id"), F.when(p % 9 > 0, F.array(role(p), role(p * 7))).alias("roles"))
    archetypes = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("a"), s.cast("string")).alias("id"), F.array(role(s)).alias("required_roles"), F.array(role(s * 3), role(s * 3)).alias("expected_roles"), F.array().cast("array<string>").alias("red_flag_missing"))
    return conformance.ontology_issues(ontology.roles(spark), tools, archetypes)


QUERIES = {f.__name__: f for f in (record_forms, ontology_checks)}


def _sql() -> dict[str, str]:
    text = lambda x: "'" + x.replace("'", "''") + "'"
    cut = lambda m: m if len(m) < conformance.LONGEST_MESSAGE else m.removesuffix(" …")[: conformance.LONGEST_MESSAGE] + " …"
    said = ", ".join(f"({i}, {text(w)}, {text(c)}, {text(cut(m))})" for i, (_, _, issues) in enumerate(BROKEN) for w, c, m in issues)
    roles = ", ".join(text(r) for r in [*(r[1] for r in ontology.role_rows()), "unheard_of", "typo"])
    role = lambda x: f"[{roles}][CAST({x} % 50 AS INT) + 1]"
    return {
        "record_forms": f"""
WITH said(kind, "where", code, message) AS (VALUES {said})
SELECT "where", code, message, count(*) AS n, min(o_orderkey) AS first_id FROM orders JOIN said ON o_custkey % {len(BROKEN)} = kind GROUP BY ALL""",
        "ontology_checks": f"""
WITH named AS (
  SELECT 't' || CAST(p_partkey AS VARCHAR) AS entry, 'roles' AS field, unnest([{role("p_partkey")}, {role("(p_partkey * 7)")}]) AS role FROM part WHERE p_partkey % 9 > 0
  UNION SELECT 'a' || CAST(s_suppkey AS VARCHAR), 'required_roles', {role("s_suppkey")} FROM supplier UNION SELECT 'a' || CAST(s_suppkey AS VARCHAR), 'expected_roles', {role("(s_suppkey * 3)")} FROM supplier)
SELECT DISTINCT entry, field, role FROM named WHERE role IN ('unheard_of', 'typo')""",
    }


SQL = _sql()
