import json

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chainspark import ontology
from chainspark.operators import catalog, evaluate, meta, vetting
from chainspark.plans import catalog as plans
from chainspark.sources import files

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_queries_equal_sql(spark, name):
    got = plans.QUERIES[name](spark, DATA).toPandas()
    con = duckdb.connect()
    for table in ("lineitem", "orders", "customer", "nation"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{DATA}/{table}.parquet')")
    want = con.sql(plans.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) > 0
    left, right = (t[columns].astype(str).sort_values(columns).reset_index(drop=True) for t in (got, want))
    pd.testing.assert_frame_equal(left, right)


STEPS = "rec_id string, chain string, pos int, step_id string, `order` int, depends_on array<string>, alternative_of string, role string, tool string, tool_raw string, evidence int"


def test_chain_issues(spark):
    rows = [
        ("r", "claimed", 0, "a", 1, ["a", "z"], None, "trim", "fastqc", None, 0),
        ("r", "claimed", 1, "a", 2, None, "q", "nope", None, "", None),
        ("r", "observed", 0, "a", 1, [], None, "qc_raw", "fastqc", None, 0),
        ("e", "claimed", 0, None, None, None, None, None, None, None, None),
    ]
    steps = spark.createDataFrame(rows, STEPS)
    found = catalog.chain_issues(steps, ontology.roles(spark), ontology.tools(spark))
    got = sorted((r.rec_id, r["where"], r.code) for r in found.collect())
    assert got == [
        ("e", "claimed[0]", "unknown_role"), ("e", "claimed[0]", "unnamed_step"), ("r", "claimed[0]", "dependency_order"), ("r", "claimed[0]", "self_dependency"),
        ("r", "claimed[0]", "tool_at_other_role"), ("r", "claimed[0]", "unknown_dependency"), ("r", "claimed[1]", "duplicate_step"), ("r", "claimed[1]", "unknown_alternative"),
        ("r", "claimed[1]", "unknown_role"), ("r", "claimed[1]", "unnamed_step"), ("r", "observed[0]", "no_evidence"),
    ]
    assert catalog.totals(found).first().asDict() == {"errors": 7, "warnings": 4, "passed": False}


def test_divergences_only_with_observed(spark):
    rows = [("r", "claimed", 0, "trim", "x", "1"), ("r", "claimed", 1, "bin", "y", None), ("r", "observed", 1, "trim", "z", "2"), ("r", "observed", 0, "bin", "y", "3"), ("q", "claimed", 0, "trim", "x", None)]
    got = sorted(tuple(r) for r in vetting.divergences(spark.createDataFrame(rows, "rec_id string, chain string, pos int, role string, tool string, version string")).collect())
    assert got == [("r", "order_mismatch", "trim"), ("r", "tool_substitution", "trim"), ("r", "version_mismatch", "trim")]


def test_tiers(spark):
    rows = [("usable", 0, None, None), (None, 0, "usable", None), (None, 1, None, "documented")]
    got = vetting.final_tier(spark.createDataFrame(rows, "tier_override string, code int, adjudicated_tier string, scorecard_tier string"))
    assert [r.final_tier for r in got.collect()] == ["usable", "paper_only", "documented"]


def test_role_scores_and_failures(spark):
    pairs = lambda rows: spark.createDataFrame(rows, "doc int, role string")
    assert tuple(evaluate.role_scores(pairs([(1, "a"), (1, "b"), (1, "b")]), pairs([(1, "a")])).first()) == (2, 1, 0.5, 1.0)
    per = {r.role: (r.precision, r.recall) for r in evaluate.role_scores(pairs([(1, "a"), (2, "b")]), pairs([(1, "a"), (2, "a"), (3, "c")]), "role").collect()}
    assert per == {"a": (1.0, 0.5), "b": (0.0, None), "c": (None, 0.0)}
    rows = spark.createDataFrame([(1, "f", "x", False), (2, "f", "x", False), (1, "f", "y", True)], "run int, fixture_id string, label string, ok boolean")
    assert [tuple(r) for r in evaluate.failures(rows).collect()] == [("f", "x", 2)]


def test_files(spark, tmp_path):
    for i, n in enumerate((2, 1)):
        (tmp_path / f"run{i}.json").write_text(json.dumps([{"paper": {"id": f"p{i}{k}"}, "methods_chars": 900, "chain": {"steps": [{"order": 1, "role": "trim"}]}} for k in range(n)]))
    got = files.read_runs(spark, [str(tmp_path / "run1.json"), str(tmp_path / "run0.json")])
    assert sorted((r.run_ord, r.rec_ord, r.paper.id) for r in got.collect()) == [(0, 0, "p10"), (1, 0, "p00"), (1, 1, "p01")]
    files.write_records(got, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    (docs := tmp_path / "docs").mkdir()
    for name, text in (("a.json", '{"id": "a", "more": 1}'), ("b.json", "[1]"), ("c.json", '{"id": ')):
        (docs / name).write_text(text)
    good, bad = files.read_documents(spark, str(docs), "id string")
    assert [(r.stem, r.doc.id, r["keys"]) for r in good.collect()] == [("a", "a", ["id", "more"])]
    assert sorted(r.rec_id for r in bad.collect()) == ["b", "c"]


def test_candidates_rank_and_wildcards(spark):
    datasets = spark.createDataFrame([("d", "P0", None, "E0")], "dataset_id string, platform string, strategy string, environment string")
    records = spark.createDataFrame([("x", "usable", ["P0"], [], ["E0"]), ("y", "usable", None, ["ANY"], []), ("z", "reference", ["P1"], [], []), ("w", None, ["P0"], ["S1"], [])], "rec_id string, tier string, platforms array<string>, strategies array<string>, environments array<string>")
    got = vetting.ranked_candidates(datasets, records).select("rec_id", F.col("rank")).collect()
    assert [(r.rec_id, r["rank"]) for r in got] == [("x", 1), ("y", 2)]


def test_archetypes_and_stale(spark):
    steps = spark.createDataFrame([("r", "trim"), ("r", "bin"), ("q", "report")], "rec_id string, role string")
    dim = spark.createDataFrame([("a", ["trim", "bin"], None), ("b", [], ["report"]), ("c", None, None), ("d", ["trim", "report"], [])], "id string, required_roles array<string>, expected_roles array<string>")
    assert sorted(tuple(r) for r in meta.archetypes_of(steps, dim).collect()) == [("q", "b"), ("r", "a")]
    judged = spark.createDataFrame([(1, "m", "v1"), (2, "m", None), (3, "n", "v1")], "id int, model string, prompt_version string")
    assert [r.id for r in meta.stale(judged, "m", "v1").collect()] == [2, 3]


def test_effective_chain(spark):
    chain = "struct<completeness: string, steps: array<string>>"
    rows = [(None, ("c", ["x"])), ((None, None), ("c", None)), ((None, []), ("c", ["x"])), (("o", None), None), (None, (None, None))]
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, o {chain}, c {chain}").orderBy("i").select(catalog.effective_chain(F.col("o"), F.col("c")).alias("e")).collect()
    assert [r.e and tuple(r.e) for r in got] == [("c", ["x"]), ("c", None), (None, []), ("o", None), None]
