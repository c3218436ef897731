import pytest
from pyspark.sql import functions as F
from sqlcheck import assert_equal_to_sql

from chainspark import ontology
from chainspark.operators import catalog, meta, vetting
from chainspark.plans import meta as plans
from chainspark.sources import files


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_queries_equal_sql(spark, name):
    assert_equal_to_sql(spark, plans, name)


ROLES = ["a", "b", "c", "d", "e"]


def test_clusters_of_role_sets(spark):
    chains = [["a", "b"]] * 6 + [["a", "b", "c"]] * 2 + [["d", "e"]] * 5 + [["d"]] + [["d", "e", "x"]] + [["a", "a", "b"]]
    rows = [(i, role) for i, chain in enumerate(chains) for role in chain]
    steps = spark.createDataFrame(rows, "rec_id int, role string")
    sets = meta.role_sets(steps, ROLES)
    assert {(r.mask, r.n) for r in sets.collect()} == {(3, 7), (7, 2), (24, 6), (8, 1)}
    clustered, modes = meta.derived_archetypes(sets, 2)
    assert modes == [3, 24] and {(r.mask, r.cluster) for r in clustered.collect()} == {(3, 0), (7, 0), (24, 1), (8, 1)}
    again, same = meta.derived_archetypes(meta.role_sets(steps.repartition(5), ROLES), 2)
    assert same == modes and sorted(again.collect()) == sorted(clustered.collect())
    dim = spark.createDataFrame([("ab", ["a", "b"], None), ("anything with e", [], ["e"]), ("unlisted", ["zz"], None)], "id string, required_roles array<string>, expected_roles array<string>")
    got = {(r.archetype, r.cluster): (r.chains, r.of_archetype, r.of_cluster) for r in meta.archetype_contingency(clustered, dim, ROLES).collect()}
    assert got == {("ab", 0): (9, 1.0, 1.0), ("anything with e", 1): (6, 1.0, 6 / 7), (None, 1): (1, 1.0, 1 / 7)}
    nothing, none = meta.derived_archetypes(sets.limit(0), 3)
    assert none == [] and nothing.count() == 0
    with pytest.raises(ValueError):
        meta.role_sets(steps, [str(i) for i in range(63)])


def test_modes_move_to_the_majority(spark):
    """The most frequent set starts a cluster; roles that most of its chains have end up as the mode."""
    sets = spark.createDataFrame([(0b00111, 3), (0b01111, 2), (0b11111, 2), (0b10000, 1)], "mask bigint, n bigint")
    _, modes = meta.derived_archetypes(sets, 1)
    assert modes == [0b01111]


def test_practices(spark):
    rows = [("r", "claimed", p, role, tool) for p, role, tool in ((1, "normalize", "x"), (2, "differential_abundance", "deseq2"), (3, "denoise", None), (5, "remove_primers", "y"), (4, "remove_primers", None))]
    rows += [("q", "claimed", 1, "differential_abundance", "aldex2"), ("q", "claimed", 2, "normalize", None), ("q", "observed", 3, "normalize", None), ("q", "observed", 9, "differential_abundance", "ancombc"), ("n", "claimed", None, "denoise", None)]
    got = catalog.practice_findings(spark.createDataFrame(rows, "rec_id string, chain string, pos int, role string, tool string"))
    assert sorted(tuple(r) for r in got.collect()) == [("q", "observed", "rarefied_before_composition_test", 3, 9), ("r", "claimed", "primers_removed_after_denoising", 3, 5)]


def test_coverage_with_open_axes(spark):
    records = spark.createDataFrame([(1, ["X"], []), (2, None, ["s"]), (2, None, ["s"]), (3, ["X", "X"], ["t"])], "rec_id int, p array<string>, s array<string>")
    axes = {"p": ["X", "Y"], "s": ["s", "t"]}
    assert sorted(tuple(r) for r in meta.coverage_cells(records, axes).collect()) == [("X", "s", 2), ("X", "t", 2), ("Y", "s", 1), ("Y", "t", 0)]
    totals = {(r.p, r.s): (r.level, r.cells, r.covered, r.holes, r.most) for r in meta.coverage_totals(records, axes).collect()}
    assert totals[None, None] == (2, 4, 3, 1, 2) and totals["Y", None] == (1, 2, 1, 1, 1) and totals["Y", "t"] == (0, 1, 0, 1, 0) and len(totals) == 9


def test_spot_checks_are_stable(spark):
    table = spark.createDataFrame([(i, f"b{i % 3}", "x", "x" if i % 4 else "y") for i in range(2000)] + [(None, "b0", "x", "x")], "rec_id int, batch string, human_tier string, judged_tier string")
    one, two, more = vetting.spot_checks(table, 10), vetting.spot_checks(table.repartition(9), 10), vetting.spot_checks(table, 30)
    ids = lambda t: {r.rec_id for r in t.collect()}
    assert ids(one) == ids(two) < ids(more) and 120 < len(ids(one)) < 280 and ids(vetting.spot_checks(table, 10, seed=1)) != ids(one)
    batches = spark.createDataFrame([("1", "a", "a"), ("1", "a", "a"), ("2", None, "a"), ("3", "a", "b"), ("3", "a", "a"), ("4", "a", "a")], "batch string, human_tier string, judged_tier string")
    got = [tuple(r) for r in vetting.agreement(batches).orderBy("batch").collect()]
    assert got == [("1", 2, 1.0, 0.0), ("2", 0, None, 0.0), ("3", 2, 0.5, 0.5), ("4", 1, 1.0, 0.0)] or got[0][3] is None


def test_divergences_of_parameters_and_databases(spark):
    rows = [
        ("claimed", 0, "trim", "t", "q=20", None), ("observed", 0, "trim", "t", "q=30", None), ("claimed", 1, "bin", "b", "m=1", None), ("observed", 1, "bin", "b", None, None),
        ("claimed", 2, "assign", "s", None, "SILVA 132"), ("observed", 2, "assign", "s", None, "silva v138.1"), ("claimed", 3, "map", "m", None, "GTDB r89"), ("observed", 3, "map", "m", None, "UNITE 8"), ("observed", 4, "amr", "c", None, "CARD"), ("claimed", 4, "amr", "c", None, None),
    ]
    steps = spark.createDataFrame([("r", *r) for r in rows], "rec_id string, chain string, pos int, role string, tool string, params string, database string").withColumn("version", F.lit(None).cast("string"))
    got = sorted((r.type, r.role) for r in vetting.divergences(steps).collect())
    assert got == [("db_unspecified", "amr"), ("db_version_mismatch", "assign"), ("param_mismatch", "trim"), ("tool_substitution", "map")]


def test_tools_of_archetypes(spark):
    uses = spark.createDataFrame([("x", "p", "trim", "a")] * 3 + [("x", "p", "trim", "b")] * 3 + [("x", "q", "trim", "c"), ("x", "p", "trim", None)], "archetype string, period string, role string, key string")
    assert sorted(tuple(r) for r in meta.modal_tools(uses, "period").collect()) == [("x", "p", "trim", 6, 2, "a", 0.5), ("x", "q", "trim", 1, 1, "c", 1.0)]
    counts = spark.createDataFrame([("x", "trim", f"t{i:02}", 30 - i) for i in range(30)], "archetype string, role string, key string, n bigint")
    assert meta.substitutes(counts).count() == 30 * 29 // 2 and meta.substitutes(counts, top_n=3).count() == 3
    classes = meta.substitution_classes(spark.createDataFrame([("x", "trim", "a", 4), ("x", "trim", "b", 4), ("x", "normalize", "a", 1), ("x", "normalize", "b", 1), ("x", "normalize", "c", 2)], "archetype string, role string, key string, n bigint"), ontology.roles(spark))
    assert {r.role: (r.entropy, r.lead, r.surprising) for r in classes.collect()} == {"trim": (1.0, 0.5, False), "normalize": (1.5, 0.5, False)}


def test_release_is_sorted_by_tier_and_id(spark, tmp_path):
    rows = spark.createDataFrame([(f"r{i * 37 % 1000:04}", ["usable", None, "rejected"][i % 3], i) for i in range(1000)], "rec_id string, tier string, n int").repartition(6)
    files.write_release(rows, str(tmp_path / "release"))
    back = spark.read.schema("rec_id string, n int, tier string").json(str(tmp_path / "release"))
    assert sorted(back.select("rec_id", "n").collect()) == sorted(rows.select("rec_id", "n").collect())
    assert {r.tier: r["count"] for r in back.groupBy("tier").count().collect()} == {"usable": 334, "none": 333, "rejected": 333}
    spans = []
    for part in sorted((tmp_path / "release").rglob("*.json")):
        ids = [r.rec_id for r in spark.read.json(str(part)).collect()]
        assert ids == sorted(ids)
        spans.append((part.parent.name, ids[0], ids[-1]))
    spans.sort()
    assert all(a[0] != b[0] or a[2] < b[1] for a, b in zip(spans, spans[1:]))
    files.write_evaluation(spark.createDataFrame([(1, [True])], "run int, results array<boolean>"), str(tmp_path / "runs"))
    assert spark.read.json(str(tmp_path / "runs")).columns == ["run"]
