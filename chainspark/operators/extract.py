"""From documents to prompts, and from responses of models to checked chains.

Everything is built-in columns but the walk over nested sections, which only emits where sections begin and end.
"""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_methods_heading, prose, split_version, stripped, without_reasoning

FLOOR, TITLE_WITHIN = 800, 4000
#: How fully a text describes its chain, and the keys of a step in an answer (fixed values).
COMPLETENESS = ("complete", "partial", "sketch")
STEP_KEYS = ("order", "role", "tool_raw", "version", "params", "database", "evidence")
CHAIN_KEYS = ("completeness", "steps")

_TAG = re.compile(r"<sec\b[^>]*>|</sec>")
_TITLE = re.compile(r"<title>(.*?)</title>", re.DOTALL)


def _spans(xml: str | None) -> list[tuple[str, int, int]]:
    """Title, begin and end of every section with a title near its begin, in order, by one walk with a stack.

    A section that is never closed ends with the document. ``<sec/>`` and ``<sec-meta>`` open a level.
    """
    open_at, found = [], {}
    for tag in _TAG.finditer(xml or ""):
        if tag[0] != "</sec>":
            open_at.append(tag.start())
            if title := _TITLE.search(xml, tag.start(), tag.start() + TITLE_WITHIN):
                found[tag.start()] = [title[1], len(xml)]
        elif open_at:
            begin = open_at.pop()
            if begin in found:
                found[begin][1] = tag.end()
    return [(title, begin, end) for begin, (title, end) in sorted(found.items())]


def sections(xml: Column) -> Column:
    """``title, begin, finish`` of every section of each document, in order; null documents have none."""

    def walk(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [dict(zip(("title", "begin", "finish"), s)) for s in _spans(t)])

    return F.pandas_udf(walk, "array<struct<title: string, begin: int, finish: int>>")(xml)


def with_methods(documents: DataFrame, xml: str = "xml", floor: int = FLOOR) -> DataFrame:
    """``documents`` with ``methods``: the text of the first methods section of at least ``floor`` characters, or null.

    Only documents that have a section at all are walked. Null and empty documents have no methods.
    """
    has = F.coalesce(F.contains(F.col(xml), F.lit("<sec")), F.lit(False))
    spans = sections(F.when(has, F.col(xml)))
    marked = documents.withColumn("section_spans", spans)
    wanted = F.filter("section_spans", lambda s: is_methods_heading(prose(s.title)))
    texts = F.transform(wanted, lambda s: prose(F.substring(F.col(xml), s.begin + 1, s.finish - s.begin)))
    long = F.filter(texts, lambda t: F.length(t) >= floor)
    return marked.withColumn("methods", F.try_element_at(long, F.lit(1))).drop("section_spans")


def role_block(roles: DataFrame, examples: int = 10) -> DataFrame:
    """One row, ``roles_text``: a line for each role in order with its stage, description and example tools.

    ``roles``: ``pos, id, stage, description, typical_tools``; a dimension of some dozens of rows.
    """
    tools = F.array_join(F.slice(F.coalesce("typical_tools", F.array().cast("array<string>")), 1, examples), ", ")
    described = F.trim(F.regexp_replace(F.coalesce("description", F.lit("")), r"(?U)\s+", " "))
    line = F.concat(F.lit("- `"), F.col("id"), F.lit("` ("), F.col("stage"), F.lit("): "), described, F.when(tools != "", F.concat(F.lit(" [e.g. "), tools, F.lit("]"))).otherwise(""))
    lines = roles.select(F.struct("pos", line.alias("line")).alias("x")).agg(F.array_sort(F.collect_list("x")).alias("x"))
    return lines.select(F.array_join(F.transform("x", lambda x: x.line), "\n").alias("roles_text"))


def prompts(texts: DataFrame, roles: DataFrame, system: str, user: str, methods: str = "methods") -> DataFrame:
    """``texts`` with ``system`` and ``user`` prompts; ``{methods}`` in the template stands for the text, taken literally."""
    block = role_block(roles)  # one row
    whole = F.concat(F.lit(system + "\n\n## Roles\n\n"), F.col("roles_text"))
    filled = F.replace(F.lit(user), F.lit("{methods}"), F.col(methods))
    return texts.crossJoin(F.broadcast(block)).withColumns({"system": whole, "user": filled}).drop("roles_text")


def one_value(pair: Column) -> Column:
    """The only value of an array, as a variant; null if it holds none or several."""
    return F.when(F.try_variant_get(pair, "$[1]", "variant").isNull(), F.try_variant_get(pair, "$[0]", "variant"))


def tolerant_json(rows: DataFrame, text: str, out: str = "parsed") -> DataFrame:
    """``rows`` with the variant ``out``: the whole text; else the first fenced block; else what parses from the first bracket
    on; else null. Each step is a column of its own, so a text is parsed once where it is plain JSON."""
    bracketed = lambda c: F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    steps = rows.withColumn("json_pair", bracketed(F.col(text))).withColumn("json_whole", one_value(F.col("json_pair")))
    open_ = F.col("json_whole").isNull()
    steps = steps.withColumn("json_fence", F.when(open_, F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit(""))))
    steps = steps.withColumn("json_pair", bracketed(F.col("json_fence"))).withColumn("json_whole", F.coalesce("json_whole", one_value(F.col("json_pair"))))
    first = F.when(F.col("json_whole").isNull(), F.nullif(F.regexp_extract(text, r"(?s)[{\[].*$", 0), F.lit("")))
    return steps.withColumn(out, F.coalesce("json_whole", F.try_parse_json(first))).drop("json_pair", "json_whole", "json_fence")


def outcome(parsed: Column, finish_reason: Column) -> Column:
    """``ok``, ``ok_truncated`` (usable though the token limit was reached), ``truncated`` or ``unparseable``."""
    cut = F.coalesce(finish_reason == "length", F.lit(False))
    return F.when(parsed.isNotNull() & cut, "ok_truncated").when(parsed.isNotNull(), "ok").when(cut, "truncated").otherwise("unparseable")


def read_responses(responses: DataFrame) -> DataFrame:
    """``responses`` (``text, finish_reason`` and more) with ``answer`` (a variant, or null) and ``outcome``."""
    read = tolerant_json(responses.withColumn("bare_text", without_reasoning(F.col("text"))), "bare_text", "answer").drop("bare_text")
    return read.withColumn("outcome", outcome(F.col("answer"), F.col("finish_reason")))


STEP = "struct<order int, role string, tool_raw string, version string, params string, database string, evidence string>"


def chain_of(answer: Column) -> Column:
    """An answer (variant) as a chain; steps whose names carry a version are split. What isn't an object is no chain."""

    def step(v: Column) -> Column:
        field = lambda k: F.try_variant_get(v, f"$.{k}", "int" if k == "order" else "string").alias(k)
        return normal_step(F.struct(*map(field, STEP_KEYS)))

    steps = F.transform(F.try_variant_get(answer, "$.steps", "array<variant>"), step)
    chain = F.struct(F.try_variant_get(answer, "$.completeness", "string").alias("completeness"), steps.alias("steps"))
    return F.when(F.schema_of_variant(answer).startswith("OBJECT"), chain)


def normal_step(step: Column) -> Column:
    named = split_version(step["tool_raw"], step["version"])
    return F.struct(*[(named[k] if k in ("tool_raw", "version") else step[k]).alias(k) for k in STEP_KEYS])


def conformity(answers: DataFrame, roles: DataFrame, answer: str = "answer") -> DataFrame:
    """``answers`` with ``problems``: what is against the fixed form of a chain, sorted; empty if nothing is.

    Keys may neither lack nor be more (``chain_keys, step_keys``); ``completeness`` and ``role`` are closed lists; ``order``
    is a whole number from 0 and no text; the other fields of a step are texts or null, the evidence is a text
    (``step_types``); steps are an array of objects (``steps``). ``answer`` is a variant; null has all its keys lacking.
    """
    known = roles.agg(F.collect_set("id").alias("known_roles"))  # one row of some dozens of ids
    array = lambda names: F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    keys = lambda v: F.coalesce(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")), array([]))
    differ = lambda found, names: (F.size(found) != len(names)) | (F.size(F.array_except(array(names), found)) > 0)
    kind = lambda v, k: F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")), F.lit("VOID"))
    text = lambda v, k: F.when(kind(v, k) == "STRING", F.try_variant_get(v, f"$.{k}", "string"))
    number = lambda v: F.try_variant_get(v, "$.order", "double")
    whole = lambda v: kind(v, "order").rlike("INT|DECIMAL|DOUBLE|FLOAT") & (number(v) == F.floor(number(v))) & (number(v) >= 0)
    said = lambda when, what: F.when(F.coalesce(when, F.lit(True)), F.lit(what))
    loose = lambda v: reduce(Column.__and__, [kind(v, k).isin("STRING", "VOID") for k in STEP_KEYS[2:6]]) & (kind(v, "evidence") == "STRING")
    step = lambda v: F.array(
        said(differ(keys(v), STEP_KEYS), "step_keys"), said(~F.array_contains("known_roles", text(v, "role")), "role"), said(~whole(v), "order"),
        F.when(F.size(keys(v)) > 0, said(~loose(v), "step_types")), F.when(~F.schema_of_variant(v).startswith("OBJECT"), "steps"),
    )
    v = F.col(answer)
    listed = F.try_variant_get(v, "$.steps", "array<variant>")
    top = F.array(said(differ(keys(v), CHAIN_KEYS), "chain_keys"), said(~text(v, "completeness").isin(*COMPLETENESS), "completeness"), F.when(F.array_contains(keys(v), "steps") & listed.isNull(), "steps"))
    problems = F.concat(top, F.flatten(F.transform(F.coalesce(listed, F.array().cast("array<variant>")), step)))
    return answers.crossJoin(F.broadcast(known)).withColumn("problems", F.array_sort(F.array_distinct(F.array_compact(problems)))).drop("known_roles")


def tool_lists(steps: DataFrame, key: list[str]) -> DataFrame:
    """``tools_known`` (ids) and ``tools_unknown`` (names) of each record, in order of steps, repeats kept.

    ``steps``: the key, ``step_pos, tool, matched``. A record's steps are one answer, so the lists are short.
    """
    pick = lambda when, what: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("step_pos", F.col(what).alias("x"))))), lambda s: s.x)
    known = F.col("matched").isNotNull()
    return steps.groupBy(*key).agg(pick(known, "matched").alias("tools_known"), pick(~known & F.col("tool").isNotNull(), "tool").alias("tools_unknown"))


def funnel(attempts: DataFrame, *by: str) -> DataFrame:
    """Attempts by how far they came: ``no_full_text``, ``no_methods``, ``failed`` or ``yielded``.

    ``attempts``: ``xml_chars, methods_chars, answered`` (boolean), ``steps, matched, named`` and ``elapsed_s``.
    """
    stage = F.when(F.coalesce("xml_chars", F.lit(0)) == 0, "no_full_text").when(F.coalesce("methods_chars", F.lit(0)) == 0, "no_methods").when(~F.coalesce("answered", F.lit(False)), "failed").otherwise("yielded")
    told = attempts.withColumn("stage", stage).groupBy(*by, "stage")
    return told.agg(
        F.count(F.lit(1)).alias("papers"), F.coalesce(F.sum("steps"), F.lit(0)).alias("steps"),
        F.try_divide(F.sum("matched").cast("double"), F.sum("named").cast("double")).alias("match_rate"), F.coalesce(F.sum("elapsed_s"), F.lit(0.0)).alias("seconds"),
    )


def batch_counts(records: DataFrame, run: str = "run_ord") -> DataFrame:
    """Records of each batch, those with steps, and their steps. ``records``: the batch and ``steps`` (array)."""
    n = F.greatest(F.coalesce(F.size("steps"), F.lit(0)), F.lit(0))
    return records.groupBy(run).agg(F.count(F.lit(1)).alias("records"), F.count_if(n > 0).alias("usable"), F.sum(n).cast("bigint").alias("steps"))


def evidence_found(steps: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """``steps`` with ``verbatim``: whether the quote, white space collapsed, stands in the text of its document.

    The quotes of a document are gathered first, so each text is joined once and no text travels with a step. Of several
    texts with a key the smallest counts. Empty quotes, and quotes without a text, are not found. Null keys have no text.
    """
    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))
    quotes = steps.where(F.col(key).isNotNull()).groupBy(key).agg(F.collect_set(flat(F.col("evidence"))).alias("quotes"))  # those of one document
    source = texts.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("text").alias("text"))
    read = quotes.join(source, key).withColumn("source_text", flat(F.col("text")))
    found = read.select(key, F.explode(F.filter("quotes", lambda q: (q != "") & F.contains(F.col("source_text"), q))).alias("quote"))
    marked = steps.withColumn("quote", flat(F.col("evidence"))).join(found.withColumn("there", F.lit(True)), [key, "quote"], "left")
    return marked.select(*steps.columns, F.coalesce("there", F.lit(False)).alias("verbatim"))


def step_quality(steps: DataFrame) -> DataFrame:
    """How many steps keep a version in their name, have an empty name, or lack evidence."""
    glued = F.coalesce(split_version(F.col("tool_raw"), F.lit(None).cast("string"))["version"].isNotNull(), F.lit(False))
    return steps.agg(F.count(F.lit(1)).alias("steps"), F.count_if(glued).alias("version_in_name"), F.count_if(F.col("tool_raw") == "").alias("empty_name"), F.count_if(stripped(F.coalesce("evidence", F.lit(""))) == "").alias("without_evidence"))


def numbered(papers: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` papers; a limit and its order go to one top-k, not to a sort of all."""
    return papers.orderBy(*order).limit(limit)


def look_up_papers(papers: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Papers of the wanted ids, and the wanted ids that no paper has. ``wanted``: ``id``."""
    return papers.join(wanted.select("id").distinct(), "id", "left_semi"), wanted.select("id").distinct().join(papers, "id", "left_anti")

