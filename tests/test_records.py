import json

import pytest
from sqlcheck import assert_equal_to_sql

from chainspark.functions import tables
from chainspark.operators import conformance, linkage
from chainspark.plans import linkage as linkage_plans
from chainspark.plans import records as record_plans


@pytest.mark.parametrize("plan, name", [(p, n) for p in (linkage_plans, record_plans) for n in sorted(p.QUERIES)])
def test_queries_equal_sql(spark, plan, name):
    assert_equal_to_sql(spark, plan, name, "/root/testdata/sf0.001" if name == "record_forms" else "/root/testdata/sf0.01")


RECORDS = "rec_id int, lane string, doi string, repo string, title string"


def test_keys_of_many_dresses(spark):
    rows = [
        (1, "a", " https://DOI.org/10.1/X ", "https://www.Git.org/u/r.git/", "A <i>long</i> title, really"),
        (2, "a", "doi:10.1/x", "git@git.org:u/r", "a LONG title: Really"),
        (3, "a", "", " ", "short"), (4, "a", None, None, None), (None, "a", "10.1/x", None, None),
    ]
    got = {(r.rec_id, r.kind): r.key for r in linkage.keys_of(spark.createDataFrame(rows, RECORDS)).collect()}
    assert got == {(i, k): v for i in (1, 2) for k, v in (("doi", "10.1/x"), ("repo", "git.org/u/r"), ("title", "alongtitlereally"))}


def test_works_and_merged_fields(spark):
    rows = [
        (5, "late", "10.1/a", None, None), (2, "early", "10.1/A", "h.org/r", ""), (9, "other", None, "https://h.org/r", "A title of nine"), (7, "late", None, None, "a title of NINE"),
        (1, "late", "10.1/z", None, "alone in the world"), (8, "early", None, None, "short"), (3, "late", None, None, "short"), (7, "late", None, None, "a title of NINE"),
    ]
    table = spark.createDataFrame(rows, RECORDS)
    works = linkage.linked_works(table)
    assert {r.rec_id: r.work_id for r in works.collect()} == {5: 2, 2: 2, 9: 2, 7: 2, 1: 1, 8: 8, 3: 3}
    merged = linkage.merged_works(table, works, ["early", "late"], ["doi", "repo", "title"])
    first = {r.work_id: (r.n_records, r.lanes, r.doi, r.repo, r.title) for r in merged.collect()}
    assert first[2] == (4, ["early", "late", "other"], "10.1/A", "h.org/r", "a title of NINE")
    report = {r.lane: (r.works, r.with_code) for r in linkage.staging_report(merged).collect()}
    assert report == {"early": (2, 1), "late": (3, 1), "other": (1, 1), None: (4, 1)}
    assert linkage.linked_works(table.limit(0)).count() == 0


def test_title_of_most_records_is_joined_without_a_shuffle_of_its_rows(spark, monkeypatch):
    monkeypatch.setattr(tables, "FREQUENT", 50)
    rows = [(i, "a", f"10.1/{i // 3}" if i % 4 == 0 else None, None, "The title of them all" if i % 5 < 4 else f"A title of number {i // 10}") for i in range(600)]
    table = spark.createDataFrame(rows, RECORDS)
    got = {r.rec_id: r.work_id for r in linkage.linked_works(table).collect()}
    assert len(got) == 600 and {got[i] for i in range(600) if i % 5 < 4} == {0}
    joined = tables.with_facts(linkage.keys_of(table), linkage.shared_keys(table), ["kind", "key"], "n")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 2
    assert joined.count() == sum(r.n for r in linkage.shared_keys(table).collect())


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 90)] + [(200, 200), (300, 301), (301, 300)], "a int, b int")
    got = {r.node: r.root for r in tables.components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 91)}, 300: 300, 301: 300}


#: What is put where in the document of the queries, and the issues that this makes.
CHANGES = [
    ((), None, []),
    (("observed",), None, []),
    (("observed",), [1], [("observed", "form_type")]),
    (("observed",), {}, [("observed", "form_required")]),
    (("observed", "steps"), [{"order": -1, "role": "x", "evidence": [{"source": "paper", "locator": 4, "quote": 5}]}], [("observed/steps/0/evidence/0/locator", "form_type")]),
    (("claimed", "steps"), [{"order": -1, "evidence": [{"source": "web", "locator": 4}]}], [("claimed/steps/0", "form_required"), ("claimed/steps/0/evidence/0/locator", "form_type"), ("claimed/steps/0/evidence/0/source", "form_enum"), ("claimed/steps/0/order", "form_minimum")]),
    (("applicability", "reference_databases"), [{"name": "d", "approx_size_gb": 2}, {"approx_size_gb": "2", "role": None}], [("applicability/reference_databases/1", "form_required"), ("applicability/reference_databases/1/approx_size_gb", "form_type"), ("applicability/reference_databases/1/role", "form_type")]),
    (("vetting", "human_review"), {"tier_override": "bad", "deep": {"a": [1]}}, [("vetting/human_review", "form_closed"), ("vetting/human_review/tier_override", "form_enum")]),
    (("id",), "a--b", [("id", "form_pattern")]),
    (("record_meta", "schema_version"), 1, [("record_meta/schema_version", "form_const"), ("record_meta/schema_version", "form_type")]),
]


def changed(path, value):
    document = json.loads(record_plans.DOCUMENT) | {"id": "r-1"}
    at = document
    for step in path[:-1]:
        at = at[step]
    if path:
        at[path[-1]] = value
    return json.dumps(document)


def test_one_change_of_a_document(spark):
    rows = [(str(i), changed(path, value)) for i, (path, value, _) in enumerate(CHANGES)] + [("no json", "{"), ("none", None)]
    got = conformance.record_form_issues(spark.createDataFrame(rows, "rec_id string, raw string")).collect()
    for i, (_, _, issues) in enumerate(CHANGES):
        assert sorted((r["where"], r.code) for r in got if r.rec_id == str(i)) == issues
    assert not {r.rec_id for r in got} & {"no json", "none"}


def test_other_documents(spark):
    table = spark.createDataFrame([("a", "[]"), ("b", '"text"'), ("c", "{}")], "rec_id string, raw string")
    got = sorted((r.rec_id, r["where"], r.code) for r in conformance.record_form_issues(table).collect())
    assert got == [("a", "<root>", "form_type"), ("b", "<root>", "form_type")] + [("c", "<root>", "form_required")] * 8


def issues_of(spark, rows):
    got = conformance.record_form_issues(spark.createDataFrame(rows, "rec_id string, raw string")).collect()
    return sorted(((r.rec_id or "", r["where"], r.code) for r in got))


def test_records_are_dealt_out_and_judged_where_they_are(spark):
    documents = record_plans.documents(spark, "/root/testdata/sf0.001")
    assert documents.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = conformance.record_form_issues(documents)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and plan.count("ArrowEvalPython") == 1


def test_documents_of_equal_or_no_id(spark):
    raw = changed(("observed", "steps"), [{"order": -1, "role": "x"}])
    assert issues_of(spark, [("a", raw), ("a", raw), (None, raw), (None, raw)]) == [(i, "observed/steps/0/order", "form_minimum") for i in ("", "", "a", "a")]


def test_keys_that_look_like_paths(spark):
    whole = changed((), None)
    rows = [("slash", whole[:-1] + ', "claimed/steps": 5}'), ("empty", whole[:-1] + ', "": 5}'), ("half", whole[:-1] + ', "zz": 1, "\\ud800": 2}')]
    assert issues_of(spark, rows) == [(i, "<root>", "form_closed") for i in ("empty", "half", "slash")]
    items = changed(("claimed", "steps"), {"*": 5})
    assert issues_of(spark, [("star", items)]) == [("star", "claimed/steps", "form_type")]


def test_whole_numbers_however_written(spark):
    cases = [
        ("0", []), ("1.0", []), ("2E2", []), ("-0.0", []), ("10.00", []), ("-1", ["minimum"]), ("-1.0", ["minimum"]), ("-1.5", ["minimum", "type"]), ("0.5", ["type"]), ("1e400", ["type"]),
        ("true", ["type"]), ('"1"', ["type"]), ("null", ["type"]), ("[0]", ["type"]), ("{}", ["type"]),
    ]
    raw = changed(("claimed", "steps"), [{"order": "HERE", "role": "x"}])
    expected = sorted((written, "claimed/steps/0/order", f"form_{c}") for written, codes in cases for c in codes)
    assert issues_of(spark, [(written, raw.replace('"HERE"', written)) for written, _ in cases]) == expected


def test_the_look_passes_by_what_is_right_and_nothing_else():
    rules = conformance.rules_of()
    table = conformance.by_pattern(rules)
    root = conformance.places_of(table, {"claimed/steps/*/params"})
    found = lambda raw: [(table[rule][0], steps) for rule, steps in root.suspects(raw.encode())]
    assert found(changed((), None)) == [] and root.suspects(b"{") is None
    assert found(changed(("claimed", "steps"), [{"order": 0, "role": "x", "params": {"a/b": {}, "c": [{}]}}])) == [("claimed/steps/*/params/*", ["claimed", "steps", "0", "params", "a/b"])]
    assert found(changed(("outputs",), ["mags", "novel", 7])) == [("outputs/*", ["outputs", "1"]), ("outputs/*", ["outputs", "2"])]
    assert found("[]") == [("", [])] and found("7") == [("", [])]
