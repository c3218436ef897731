"""Candidate records of several lanes that are one work: links by shared keys, merged fields, and the staging report.

``records``: ``rec_id, lane, doi, repo, title`` and more. A work is known by the smallest ``rec_id`` of its records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import components, with_facts

#: A shorter normalised title says too little to link two records.
LEAST_TITLE = 12


def doi_key(doi: Column) -> Column:
    """A DOI without resolver or prefix, in lower case; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(doi)), r"^(https?://)?(dx\.)?(doi\.org/|doi:)?\s*", ""), F.lit(""))


def repo_key(url: Column) -> Column:
    """Host and path of a repository in lower case, without scheme, ``www.``, query, ``.git`` and last slashes."""
    bare = F.regexp_replace(F.lower(F.trim(url)), r"^([a-z+]+://|git@)?(www\.)?", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"[?#].*$", ""), r"(/|\.git)+$", "")
    return F.nullif(F.regexp_replace(bare, r"^([^/:]+):", "$1/"), F.lit(""))


def title_key(title: Column, least: int = LEAST_TITLE) -> Column:
    """Letters and digits of a title in lower case, markup out; null if there are fewer than ``least``."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(title, "<[^>]+>", "")), r"[^\p{L}\p{N}]+", "")
    return F.when(F.length(bare) >= least, bare)


def keys_of(records: DataFrame) -> DataFrame:
    """``rec_id, kind, key``: the keys that each record has."""
    pair = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    found = F.array(pair("doi", doi_key(F.col("doi"))), pair("repo", repo_key(F.col("repo"))), pair("title", title_key(F.col("title"))))
    return records.where("rec_id is not null").select("rec_id", F.inline(found)).where("key is not null")


def shared_keys(records: DataFrame) -> DataFrame:
    """``kind, key, first_id, n``: keys that several records have, with the smallest of these and their number."""
    return keys_of(records).groupBy("kind", "key").agg(F.min("rec_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")


def linked_works(records: DataFrame) -> DataFrame:
    """``rec_id, work_id`` of every record. Records with a DOI, a repository or a title in common are one work, and so
    are those that such records lead to.

    Each record links to the first record of each of its keys, never to all others, so a title that very many records
    share gives as many links as it has records, and ``with_facts`` keeps them from meeting in one task. Records
    without a key are works of their own; those without id have none. Repeated ids count once.
    """
    keys = keys_of(records)
    links = with_facts(keys, shared_keys(records), ["kind", "key"], "n")
    roots = components(links.select(F.col("rec_id").alias("a"), F.col("first_id").alias("b")))
    ids = records.where("rec_id is not null").select("rec_id").distinct()
    return ids.join(roots.withColumnRenamed("node", "rec_id"), "rec_id", "left").select("rec_id", F.coalesce("root", "rec_id").alias("work_id"))


def merged_works(records: DataFrame, works: DataFrame, lanes: list[str], fields: list[str]) -> DataFrame:
    """One row a work: ``work_id, n_records, lanes`` and each field from the first lane that fills it.

    ``lanes``: best first; other lanes come last. Within a lane the smallest ``rec_id`` counts. Empty text fills nothing.
    Every field is a minimum by place, so a work of very many records is aggregated before it is shuffled.
    """
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, lanes)), F.col("lane")), F.lit(0)), F.lit(len(lanes) + 1))
    place = F.struct(rank.alias("rank"), "rec_id")
    filled = lambda c: F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    best = [F.min_by(F.col(c), F.when(filled(c), place)).alias(c) for c in fields]
    return records.join(works, "rec_id").groupBy("work_id").agg(F.countDistinct("rec_id").alias("n_records"), F.array_sort(F.collect_set("lane")).alias("lanes"), *best)  # a few lanes


def staging_report(works: DataFrame) -> DataFrame:
    """``lane, works, with_code, share``: per lane and, where ``lane`` is null, of all; a work of two lanes counts in both.

    ``works``: ``lanes, repo``, as ``merged_works`` gives them.
    """
    code = F.coalesce(F.col("repo") != "", F.lit(False))
    told = [F.count(F.lit(1)).alias("works"), F.count_if(code).alias("with_code"), F.avg(code.cast("double")).alias("share")]
    whole = works.agg(*told).select(F.lit(None).cast("string").alias("lane"), "works", "with_code", "share")
    return works.select("repo", F.explode("lanes").alias("lane")).groupBy("lane").agg(*told).unionByName(whole)
