from pyspark.sql import functions as F

from chainspark import ontology
from chainspark.functions import text
from chainspark.operators import corpus, match, survey


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_versions_at_the_end_of_names(spark):
    """Generated from the rule: a dotted number, or any number right after a v, in every dress; nothing else is a version."""
    dresses = ["{n} {v}", "{n} v{v}", "{n} ({v})", "{n}  ( V{v} ) ", "{n} version {v}", "{n}, ver. {v}"]
    names, numbers, plain = ["Gannet", "Zed 4", "k-9", "osprey_x"], ["0.1", "10.20.30-dev", "1999.4a"], ["7", "2021", "x1", "1.", ".5"]
    rows = [(d.format(n=n, v=v), None, n, v) for d in dresses for n in names for v in numbers]
    rows += [(f"{n} {x}", None, f"{n} {x}", None) for n in names for x in plain] + [(f"{n} v30", None, n, "30") for n in names]
    rows += [("Gannet 0.1", "V2", "Gannet", "2"), (" Gannet ", "", "Gannet", None), ("\t", "", None, None), (None, "", None, None)]
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, name string, v string, t string, w string")
    got = table.orderBy("i").select(text.split_version(F.col("name"), F.col("v")).alias("x")).collect()
    assert [(r.x.tool_raw, r.x.version) for r in got] == [r[2:] for r in rows]


def test_prose(spark):
    markup = "<p>A &amp; B &#x2019;q&#x2019; <xref>1</xref>x</p><fig><p>gone</p></fig>&#x3b1;&#x110000;<title>T</title>"
    assert one(spark, text.prose(F.lit(markup))) == "A & B 'q' x\n α&#x110000;T"  # a dropped figure leaves a space


def test_matching(spark):
    names = ["Kraken2", "kraken 2 standard", "CheckM2", "MEGAHIT3", "BWA mem 0.7", "Naive Bayes", "...", "", None]
    rows = spark.createDataFrame([(n,) for n in names], "tool_raw string")
    got = {r.tool_raw: r.matched for r in match.matches(rows, match.alias_index(ontology.tools(spark))).collect()}
    assert got == {"Kraken2": "kraken2", "kraken 2 standard": "kraken2", "CheckM2": "checkm", "MEGAHIT3": "megahit", "BWA mem 0.7": "bwa"}


def test_merge_keeps_first_and_all_without_id(spark):
    rows = spark.createDataFrame([("a", 1, 0), ("a", 0, 1), (None, 0, 0), ("", 0, 2), ("", 0, 3)], "id string, run_ord int, rec_ord int")
    got = sorted((r.id or "", r.run_ord, r.rec_ord) for r in corpus.merged_runs(rows, F.col("id"), ["run_ord", "rec_ord"]).collect())
    assert got == [("", 0, 0), ("", 0, 2), ("", 0, 3), ("a", 0, 1)]


def test_floor_and_period(spark):
    label = lambda n, s: one(spark, corpus.outcome(F.lit(n).cast("int"), F.array(*map(F.lit, s)).cast("array<int>")))
    assert [label(799, [1]), label(800, []), label(None, [1])] == ["too_short", "empty", "plotted"]
    assert [one(spark, text.period(F.lit(d))) for d in ("2018-05-01", "", "bad")] == ["2016-18", None, None]


def test_consensus_skips_rare_and_custom(spark):
    rows = [("trim", "x")] * 2 + [("bin", "x")] * 2 + [("bin", "y")] + [("custom", "z")] * 5
    steps = spark.createDataFrame([(r, t, None) for r, t in rows], "role string, tool string, matched string")
    got = survey.consensus(steps, ontology.roles(spark)).collect()
    assert [(r.role, r.n, r.top, r.stage) for r in got] == [("bin", 3, "x", "assembly")]
