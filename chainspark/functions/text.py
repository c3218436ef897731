"""Text functions as columns: all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"(?U)\s+"
#: Headings that open a methods section (fixed values). Any white space may stand between their words and around them.
METHODS_TITLES = (
    r"materials?\s+and\s+methods?",
    r"methods?\s+and\s+materials?",
    r"methods?",
    r"experimental\s+procedures?",
    r"star\s*\+?\s*methods?",
    r"materials?",
    r"methodology",
)
#: Words that mark the computational parts of a methods section (fixed values).
COMPUTATIONAL = (
    "bioinformatic",
    r"sequenc\w+\s+(?:read\s+)?process",
    r"read\s+process",
    r"data\s+process",
    "assembl",
    "binning",
    "annotation",
    "taxonom",
    "amplicon",
    "metagenom",
    "statistic",
    "analys[ie]s",
    r"quality\s+control",
    r"quality\s+filter",
    "computational",
)
#: Entities with a plain form of their own, lower-case hex only (fixed values).
PLAIN = {"2019": "'", "2018": "'", "201c": '"', "201d": '"', "2013": "-", "2014": "-", "a0": " "}
#: A version at the end of a name: a number with a dot, or any number right after ``v`` (fixed format).
VERSION = r"(?iU)\s*\(?\s*(?:v(?:er(?:sion)?)?\.?\s*)?(\d+(?:\.\d+)+[a-z0-9._-]*|v\d[a-z0-9._-]*)\s*\)?\s*$"

#: Delimiters of reasoning in responses of models, as patterns (fixed values).
REASONING = (("<think>", "</think>"), (r"<\|channel>thought", r"<channel\|>"))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean(text: Column) -> Column:
    """Markup out, white space collapsed; null is empty text."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", ""), SPACES, " "))


def normalize(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def name_tokens(name: Column) -> Column:
    return F.filter(F.split(name, "[^A-Za-z0-9]+"), lambda t: t != "")


def candidates(name: Column, longest: int = 4) -> Column:
    """Normalised runs of up to four tokens: longer ones first, then from left to right."""
    tokens = name_tokens(name)
    n = F.size(tokens)

    def runs(k: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), n - k), lambda i: F.lower(F.array_join(F.slice(tokens, i + 1, k), "")))

    found = F.flatten(F.transform(F.sequence(F.least(F.lit(longest), n), F.lit(1), F.lit(-1)), runs))
    return F.when(n > 0, found).otherwise(F.array().cast("array<string>"))


def split_version(name: Column, version: Column) -> Column:
    """Struct ``tool_raw, version``: a trailing version leaves the name; a version stated apart wins.

    A whole number is no version unless a ``v`` stands right before it. A name that is nothing but a version stays
    whole. An empty or null name is null; an empty version is null.
    """
    trimmed = stripped(name)
    found = F.nullif(F.regexp_extract(trimmed, VERSION, 1), F.lit(""))
    stem = F.regexp_replace(F.regexp_replace(trimmed, VERSION, ""), r"^[ .,;(]+|[ .,;(]+$", "")
    bare = lambda v: F.regexp_replace(v, "^[vV]+", "")
    stated = F.nullif(version, F.lit(""))
    named = F.coalesce(name, F.lit("")) != ""
    use = found.isNotNull() & (stem != "")
    own = F.coalesce(F.when(named, bare(stated)).otherwise(stated), F.when(use, bare(found)))
    return F.struct(F.nullif(F.when(use, stem).otherwise(trimmed), F.lit("")).alias("tool_raw"), own.alias("version"))


def prose(markup: Column) -> Column:
    """Markup to text: tables, figures and cross references go whole, blocks end lines, entities become characters.

    A dropped table or figure leaves a space. Entities of numbers that are no characters stay as they are.
    """
    t = F.regexp_replace(markup, r"(?s)<(table-wrap|fig|supplementary-material)\b.*?</\1>", " ")
    t = F.regexp_replace(t, r"(?s)<xref\b.*?</xref>", "")
    t = F.regexp_replace(t, r"</(p|title|sec)>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", "")
    for name, plain in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        t = F.replace(t, F.lit(name), F.lit(plain))
    for code, plain in PLAIN.items():
        t = F.replace(t, F.lit(f"&#x{code};"), F.lit(plain))

    def decoded(piece: Column) -> Column:
        code = F.regexp_extract(piece, r"^&#x0*([0-9a-fA-F]{1,6});", 1)
        value = F.conv(code, 16, 10).cast("bigint")
        char = F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")
        valid = (code != "") & (value <= 0x10FFFF) & ~value.between(0xD800, 0xDFFF)
        return F.when(valid, F.concat(char, F.regexp_replace(piece, r"^&#x[0-9a-fA-F]+;", ""))).otherwise(piece)

    t = F.array_join(F.transform(F.split(t, r"(?=&#x[0-9a-fA-F]+;)"), decoded), "")
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return stripped(t)


def is_methods_heading(heading: Column) -> Column:
    return heading.rlike(rf"(?iU)^\s*(?:\d+\.?\s*)?(?:{'|'.join(METHODS_TITLES)})\s*$")


def trim_to_hints(text: Column, hints: str = rf"(?iU){'|'.join(COMPUTATIONAL)}", limit: int = 9000) -> Column:
    """Long texts keep the lines that match ``hints`` (all lines if none does), cut to the limit."""
    lines = F.filter(F.split(text, "\n"), lambda x: (stripped(x) != "") & x.rlike(hints))
    kept = F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(text)
    return F.when(F.length(text) <= limit, text).otherwise(F.substring(kept, 1, limit))


def without_reasoning(text: Column, pairs=REASONING) -> Column:
    """Blocks between the delimiters (patterns) go, then a block that was never closed; null is empty text."""
    t = F.coalesce(text, F.lit(""))
    for opening, closing in pairs:
        t = F.regexp_replace(F.regexp_replace(t, rf"(?s){opening}.*?{closing}", ""), rf"(?s){opening}.*$", "")
    return stripped(t)


def loosely_contains(text: Column, part: Column) -> Column:
    a, b = F.lower(text), F.lower(part)
    squeeze = lambda x: F.regexp_replace(x, "[, ]", "")
    return F.contains(a, b) | F.contains(squeeze(a), squeeze(b))


def cache_key(key: Column) -> Column:
    return F.concat(F.substring(F.regexp_replace(key, "[^A-Za-z0-9._-]", "_"), 1, 80), F.lit("."), F.substring(F.sha1(key), 1, 12), F.lit(".cache"))


def period(date: Column, years: int = 3) -> Column:
    """Label of the period of a date, ``2016-18``; blank or malformed dates have none."""
    year = F.substring(date, 1, 4).try_cast("int")
    start = year - F.pmod(year, F.lit(years))
    return F.concat(start.cast("string"), F.lit("-"), F.substring((start + years - 1).cast("string"), 3, 2))
