"""From search hits and run files to one de-duplicated corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import cache_key, clean

FLOOR = 800


def corpus_filter(papers: DataFrame, sources=None, preprints_only=False, year_from: int = 0, year_to: int = 0, preprint_source="PPR") -> DataFrame:
    """Open-access papers in the archive. ``sources`` overrides ``preprints_only``; a first year alone means that year."""
    kept = papers.where((F.col("isOpenAccess") == "Y") & (F.col("inEPMC") == "Y"))
    if sources:
        kept = kept.where(F.col("source").isin(*sources))
    elif preprints_only:
        kept = kept.where(F.col("source") == preprint_source)
    year = F.col("pubYear").try_cast("int")
    if year_from:
        kept = kept.where(year.between(year_from, year_to)) if year_to else kept.where(year == year_from)
    return kept


HIT = "id string, doi string, title string, authorString string, firstPublicationDate string, pubYear string, journalTitle string, bookOrReportDetails struct<publisher: string>, isOpenAccess string, inEPMC string, pmcid string, source string"


def hits_of(responses: DataFrame, body: str = "body") -> DataFrame:
    """Search responses (JSON text with ``resultList.result[]``) as one row per hit; one that isn't JSON has no hits."""
    found = F.from_json(body, f"resultList struct<result: array<struct<{HIT}>>>")
    return responses.select(F.explode(found["resultList"]["result"]).alias("hit")).select("hit.*", F.col("hit.bookOrReportDetails.publisher").alias("publisher"))


def papers_of(hits: DataFrame) -> DataFrame:
    """Search hits as papers: the first filled column of each choice, else empty text."""
    filled = lambda *names: F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names])
    text = lambda *names: F.coalesce(filled(*names), F.lit(""))
    return hits.select(
        text("id").alias("id"), text("doi").alias("doi"), F.trim(F.regexp_replace(text("title"), r"(?U)\s+", " ")).alias("title"),
        text("authorString").alias("authors"), text("firstPublicationDate", "pubYear").alias("date"),
        F.coalesce(filled("journalTitle", "publisher"), F.lit("preprint")).alias("journal"),
        (F.coalesce("isOpenAccess", F.lit("")) == "Y").alias("is_open_access"), text("pmcid").alias("pmcid"), text("source").alias("source"),
    )


def full_texts(papers: DataFrame, fulltext: DataFrame) -> DataFrame:
    """``papers`` with ``xml``: by ``pmcid``, else by ``id``; a missing text is null, and so is that of a paper with neither.

    Which identifiers have a text is found on narrow rows; texts meet the papers in one join. Of several texts with an
    identifier the smallest counts, so papers are never multiplied. Papers without an identifier have a key of their
    own that nothing else has: they don't meet in one task.
    """
    there = fulltext.where("ident <> ''").groupBy("ident").agg(F.min("xml").alias("xml"))
    known = there.select("ident")
    own = F.concat(F.lit("\0"), F.xxhash64(*papers.columns).cast("string"))
    key = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), own)
    found = papers.withColumns({"by_pmcid": key("pmcid"), "by_id": key("id")})
    for c in ("by_pmcid", "by_id"):
        found = found.join(known.select(F.col("ident").alias(c), F.col("ident").alias(f"has_{c}")), c, "left")
    found = found.select(*papers.columns, F.coalesce("has_by_pmcid", "has_by_id", own).alias("ident"))
    return found.join(there, "ident", "left").drop("ident")


def completeness(xml: Column, abstract: Column, stated: Column) -> Column:
    """How a chain was read: as stated, or ``abstract_only`` where there is an abstract and no full text."""
    no_text = F.coalesce(xml, F.lit("")) == ""
    return F.when(no_text & (F.coalesce(abstract, F.lit("")) != ""), "abstract_only").when(~no_text, stated)


def not_done(requests: DataFrame, results: DataFrame, column: str = "request") -> DataFrame:
    """Requests without a stored result, by their cache key."""
    return requests.withColumn("cache_key", cache_key(F.col(column))).join(results.select("cache_key"), "cache_key", "left_anti")


def merged_runs(records: DataFrame, paper_id: Column, order: list[str]) -> DataFrame:
    """The first record of each paper id in run order; records without id are all kept and never meet in a window."""
    named = paper_id.isNotNull() & (paper_id != "")
    first = W.partitionBy(paper_id).orderBy(*order)
    kept = records.where(named).withColumn("merge_rank", F.row_number().over(first)).where("merge_rank = 1").drop("merge_rank")
    return kept.unionByName(records.where(~named | paper_id.isNull()))


def outcome(methods_chars: Column, steps: Column, floor: int = FLOOR) -> Column:
    """``too_short`` before ``empty`` before ``plotted``; a missing length passes the floor."""
    return F.when(F.coalesce(methods_chars, F.lit(floor)) < floor, "too_short").when(F.coalesce(F.size(steps), F.lit(0)) <= 0, "empty").otherwise("plotted")


def step_rows(records: DataFrame) -> DataFrame:
    """Records with ``paper`` and ``chain`` structs to one row per step, cleaned for display; the paper's part of it too."""
    paper = [F.col("paper.id").alias("id"), clean(F.col("paper.title")).alias("title"), F.substring("paper.date", 1, 10).alias("date"), F.col("paper.doi").alias("doi"), F.col("chain.completeness").alias("completeness")]
    steps = records.select("run_ord", "rec_ord", *paper, F.posexplode("chain.steps").alias("step_pos", "s"))
    short = F.nullif(F.substring(clean(F.col("s.params")), 1, 200), F.lit(""))
    return steps.select("run_ord", "rec_ord", "id", "title", "date", "doi", "completeness", "step_pos", F.col("s.role").alias("role"), F.col("s.tool_raw").alias("tool_raw"), F.nullif(clean(F.col("s.tool_raw")), F.lit("")).alias("tool"), F.col("s.version").alias("version"), short.alias("params"))


def paper_steps(records: DataFrame, roles: DataFrame, tools: DataFrame, databases: DataFrame) -> DataFrame:
    """``step_rows`` with the stage of each role and the tool and database that its name matches, looked up anew.

    Matches stored in the records are never used. Names are matched once each; unknown roles are ``specialty``.
    """
    from .match import with_matches
    from .survey import with_stage

    return with_matches(with_stage(step_rows(records), roles).drop("substitutable"), tools, databases)
