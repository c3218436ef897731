import pytest
from sqlcheck import assert_equal_to_sql

from chainspark import ontology
from chainspark.functions import tables
from chainspark.operators import corpus, survey
from chainspark.plans import vetting as plans


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_queries_equal_sql(spark, name):
    assert_equal_to_sql(spark, plans, name)


def test_steps_of_papers(spark):
    step = {"order": 1, "role": "trim", "tool_raw": "<i>FastQC</i> ", "version": "", "params": " <b>a</b>  b"}
    rows = [(0, 0, {"id": "p", "title": " A <sup>b</sup>\n", "date": "2020-01-02T03", "doi": "d"}, {"completeness": "sketch", "steps": [step, step | {"role": "nope", "tool_raw": "SILVA 138", "params": "x" * 300}, step | {"tool_raw": "<b></b>", "params": None}]}), (1, 0, {"id": "q"}, {"steps": []}), (2, 0, None, None)]
    schema = "run_ord int, rec_ord int, paper struct<id: string, title: string, date: string, doi: string>, chain struct<completeness: string, steps: array<struct<order: int, role: string, tool_raw: string, version: string, params: string>>>"
    got = corpus.paper_steps(spark.createDataFrame(rows, schema), ontology.roles(spark), ontology.tools(spark), ontology.databases(spark)).orderBy("step_pos").collect()
    told = [(r.title, r.date, r.doi, r.completeness, r.stage, r.tool, r.matched, r.matched_db, r.params) for r in got]
    assert told == [("A b", "2020-01-02", "d", "sketch", "reads", "FastQC", "fastqc", None, "a b"), ("A b", "2020-01-02", "d", "sketch", "specialty", "SILVA 138", None, "silva", "x" * 200), ("A b", "2020-01-02", "d", "sketch", "reads", None, None, None, None)]


def test_ranks_and_precedence(spark):
    steps = spark.createDataFrame([("p", "2020", 1, "a", "x"), ("p", "2020", 2, "b", "y"), ("p", "2020", 3, "a", "x"), ("q", "2021", 1, "a", "z"), ("q", "2021", 2, "b", None), ("r", None, 1, "a", "x")], "paper string, date string, step_pos int, role string, tool string").selectExpr("*", "cast(null as string) matched")
    assert sorted(tuple(r) for r in survey.ranked_drift(steps, 1).collect()) == [("a", "2019-21", 1, "x", 2, 2 / 3), ("b", "2019-21", 1, "y", 1, 1.0)]
    assert sorted(tuple(r) for r in survey.role_precedence(steps).collect()) == [("a", "b", 2, 1), ("b", "a", 2, 0)]


def test_dimensions_are_broadcast_by_size(spark):
    hint = lambda t: "hint" in t._jdf.queryExecution().logical().toString().lower()
    assert hint(tables.dimension(spark.range(10), 10)) and not hint(tables.dimension(spark.range(11), 10))
