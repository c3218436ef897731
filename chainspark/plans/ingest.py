"""Queries from search hits to checked chains, over papers derived from ``pages``, ``documents`` and ``orders``.

Tables of papers and responses are derived by plain concatenation and arithmetic, which Spark and DuckDB share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ontology
from ..functions import text
from ..operators import corpus, extract

#: Names as papers write them, with versions in every form.
RAW_NAMES = ["Fennel v0.9-rc1", "Larkspur ( 7.22 )", "halyard3 ver.6.0.3b", "Pinna_X  version 11.4", "Ocelot 12", "Wren version 14", "DADA2", "kraken V8", "0.44.1", "  sorrel  ", "", "lab code v2024"]
#: Headings, some of which open a methods section.
HEADINGS = ["Methods", "2. Materials and  Methods", "STAR+ Methods", "Material and Methods", "Results", "2.1 Methods", " Methodology ", "Experimental procedures", "Methods of old"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))


def split_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and versions of all lines, as written, split and normalised, with the number of lines of each."""
    lines = table(spark, sf_dir, "lineitem")
    stated = F.when(F.col("l_linenumber") == 1, F.lit("v9.9")).when(F.col("l_linenumber") == 2, F.lit(""))
    rows = lines.select(pick(RAW_NAMES, F.col("l_partkey")).alias("raw"), stated.alias("stated"))
    kinds = rows.groupBy("raw", "stated").agg(F.count(F.lit(1)).alias("n"))
    named = kinds.withColumn("s", text.split_version(F.col("raw"), F.col("stated")))
    return named.select("raw", "stated", "n", F.col("s.tool_raw").alias("tool_raw"), F.col("s.version").alias("version"), text.normalize(F.col("s.tool_raw")).alias("key"))


def page_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as plain text; a figure and a cross reference are put before it, so that both have work to do."""
    pages = table(spark, sf_dir, "pages")
    markup = F.concat(F.lit("a<fig id='f'><p>gone</p></fig>b<xref>1</xref>c &#x2019;&#x3b1; "), F.coalesce("html", F.lit("")))
    told = text.prose(markup)
    return pages.select("page_id", F.md5(told).alias("digest"), F.length(told).cast("bigint").alias("chars"))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as search hits, and some lines of them as responses: ``resultList.result[]`` of several hits each."""
    pages, n = table(spark, sf_dir, "pages"), F.col("page_id")
    hit = F.struct(
        n.cast("string").alias("id"), F.concat(F.lit("10.1/"), n.cast("string")).alias("doi"), F.concat(F.lit(" A  title\n"), F.coalesce("url", F.lit(""))).alias("title"), F.lit("A. B.").alias("authorString"),
        F.when(n % 3 > 0, F.lit("2019-05-01")).alias("firstPublicationDate"), F.when(n % 2 > 0, F.lit("2018")).otherwise(F.lit("2020")).alias("pubYear"), F.when(n % 4 > 0, F.lit("J")).alias("journalTitle"),
        F.struct(F.when(n % 8 > 0, F.lit("P")).alias("publisher")).alias("bookOrReportDetails"), F.when(n % 5 > 0, F.lit("Y")).otherwise(F.lit("N")).alias("isOpenAccess"), F.lit("Y").alias("inEPMC"),
        F.when(n % 3 == 0, F.concat(F.lit("PMC"), n.cast("string"))).alias("pmcid"), F.when(n % 7 > 0, F.lit("PPR")).otherwise(F.lit("MED")).alias("source"),
    )
    batches = pages.groupBy(F.call_function("div", n, F.lit(20)).alias("batch")).agg(F.to_json(F.struct(F.struct(F.collect_list(hit).alias("result")).alias("resultList"))).alias("body"))
    return corpus.hits_of(batches, "body")


def fulltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full texts of two thirds of the pages, by either identifier: a short methods section of an abstract, then the page."""
    pages, n = table(spark, sf_dir, "pages"), F.col("page_id")
    ident = F.when(n % 3 == 0, F.concat(F.lit("PMC"), n.cast("string"))).when(n % 3 == 1, n.cast("string"))
    heading = pick(HEADINGS, n)
    short = F.lit("<sec><title>Methods</title><p>short</p></sec>")
    body = F.concat(F.lit("<body>"), short, F.lit("<sec id='m'><title>"), heading, F.lit("</title><p>"), F.replace(F.coalesce("html", F.lit("")), F.lit("<title>"), F.lit("<h0>")), F.lit("</p><sec><p>in</p></sec>end</sec><sec><p>after</p></sec></body>"))
    return pages.where(n % 3 < 2).select(ident.alias("ident"), body.alias("xml"))


def papers_with_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search hits of preprints from 2018 on with the methods text of each paper, trimmed to what goes to a model."""
    found = corpus.papers_of(corpus.corpus_filter(hits(spark, sf_dir), preprints_only=True, year_from=2018, year_to=2020))
    read = extract.with_methods(corpus.full_texts(found, fulltext(spark, sf_dir)))
    return read.withColumn("trimmed", text.trim_to_hints(F.col("methods")))


def paper_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = papers_with_methods(spark, sf_dir)
    chars = lambda c: F.length(c).cast("bigint")
    return papers.select("id", "doi", "title", "date", "journal", "pmcid", chars("xml").alias("xml_chars"), chars("methods").alias("methods_chars"), F.md5("methods").alias("digest"), chars("trimmed").alias("trimmed_chars"))


def first_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forty newest papers, then by id."""
    papers = corpus.papers_of(hits(spark, sf_dir))
    return extract.numbered(papers, [F.desc("date"), F.col("id").cast("bigint")], 40).select("id", "date", "journal")


def wanted_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers that customers ask for by id, and the ids that no paper has."""
    asked = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 3 % 1000).cast("string").alias("id"))
    found, missing = extract.look_up_papers(corpus.papers_of(hits(spark, sf_dir)), asked)
    return found.select("id", F.lit(True).alias("found")).unionByName(missing.select("id", F.lit(False).alias("found")))


def ingest_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the papers came, by journal; every fourth answer is missing."""
    papers = papers_with_methods(spark, sf_dir)
    n = F.col("id").cast("bigint")
    chars = lambda c: F.length(c).cast("bigint")
    attempts = papers.select("journal", chars("xml").alias("xml_chars"), chars("methods").alias("methods_chars"), (n % 4 > 0).alias("answered"), (n % 9).alias("steps"), (n % 3).alias("matched"), (n % 9).alias("named"), (n % 6).cast("double").alias("elapsed_s"))
    return extract.funnel(attempts, "journal")


def pending_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of all customers without an order of every third key, by the key of the request."""
    asked = table(spark, sf_dir, "customer").select(F.concat(F.lit("query for customer/"), F.col("c_custkey").cast("string"), F.lit(" "), F.repeat(F.lit("é"), 60)).alias("request"))
    done = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select("o_custkey").distinct().select(text.cache_key(F.concat(F.lit("query for customer/"), F.col("o_custkey").cast("string"), F.lit(" "), F.repeat(F.lit("é"), 60))).alias("cache_key"))
    return corpus.not_done(asked, done).select("cache_key", F.length("request").cast("bigint").alias("chars"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as responses of a model, in eight shapes, from plain JSON to text cut off in the middle."""
    orders, n = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    key = n.cast("string")
    role = pick([r[1] for r in ontology.role_rows()] + ["no_such_role"], F.col("o_custkey"))
    quoted = lambda when, x: F.when(when, F.concat(F.lit('"'), x, F.lit('"'))).otherwise(x)
    order = quoted(n % 13 == 0, (n % 5 - 1).cast("string"))
    step = F.concat(F.lit('{"order":'), order, F.lit(',"role":"'), role, F.lit('","tool_raw":"T v1.'), (n % 7).cast("string"), F.lit('","version":null,"params":'), F.when(n % 17 == 0, "21").otherwise("null"), F.lit(',"database":null,"evidence":"e"'), F.when(n % 11 == 0, F.lit(',"more":1')).otherwise(F.lit("")), F.lit("}"))
    answer = F.concat(F.lit('{"completeness":"'), pick(["complete", "partial", "sketch", "whole"], n), F.lit('","steps":['), step, F.lit("]}"))
    shape = F.col("o_custkey") % 8
    body = (
        F.when(shape == 0, answer).when(shape == 1, F.concat(F.lit("<think>a { b</think>\n"), answer)).when(shape == 2, F.concat(F.lit("Here:\n```json\n"), answer, F.lit("\n```\nDone.")))
        .when(shape == 3, F.concat(F.lit("The chain is "), answer, F.lit(" as asked."))).when(shape == 4, F.substring(answer, 1, 40)).when(shape == 5, F.lit("")).when(shape == 6, F.concat(F.lit("<think>never closed "), answer))
        .otherwise(F.concat(F.lit("<|channel>thought x<channel|>"), answer))
    )
    return orders.select(n.alias("response"), key.alias("key"), body.alias("text"), F.when(n % 3 == 0, F.lit("length")).otherwise(F.lit("stop")).alias("finish_reason"))


def response_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of all responses, with the outcome, the first step's name and version, and what is against the form."""
    read = extract.conformity(extract.read_responses(responses(spark, sf_dir)), ontology.roles(spark))
    chain = read.withColumn("chain", extract.chain_of(F.col("answer")))
    first = F.try_element_at(F.col("chain.steps"), F.lit(1))
    problems = F.when(F.col("answer").isNotNull(), F.array_join("problems", "|"))
    return chain.select("response", "outcome", F.col("chain.completeness").alias("completeness"), first["role"].alias("role"), first["tool_raw"].alias("tool_raw"), first["version"].alias("version"), problems.alias("problems"))


def prompt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt for every benchmark item, with the block of roles in its system part."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("methods"))
    roles = ontology.roles(spark).select("pos", "id", "stage", F.concat(F.lit("does  "), "id").alias("description"), F.array(F.concat(F.lit("t-"), "id")).alias("typical_tools"))
    made = extract.prompts(items, roles, "Read the methods.", "Text:\n{methods}\nEnd.")
    return made.select("item_id", F.md5("system").alias("system"), F.md5("user").alias("user"))


def batch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and usable records of seven batches; an order's lines are its steps, and lines of quantity under 5 don't count."""
    lines = table(spark, sf_dir, "lineitem").where("l_quantity >= 5").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("steps"))
    records = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 7).alias("run_ord"), F.col("o_orderkey").alias("l_orderkey"))
    return extract.batch_counts(records.join(lines, "l_orderkey", "left"))


def paper_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by source and by what becomes of them: too short, empty or plotted."""
    docs = table(spark, sf_dir, "documents")
    steps = F.when(F.col("doc_id") % 5 > 0, F.sequence(F.lit(1), (F.col("doc_id") % 4 + 1).cast("int")))
    label = corpus.outcome(F.when(F.col("doc_id") % 13 > 0, F.length("text")), steps)
    return docs.select("source", label.alias("label")).groupBy("source", "label").agg(F.count(F.lit(1)).alias("papers"))


QUERIES = {f.__name__: f for f in (split_names, page_prose, paper_methods, first_papers, wanted_papers, ingest_funnel, pending_requests, response_outcomes, prompt_rows, batch_counts, paper_labels)}


def _sql() -> dict[str, str]:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    array = lambda xs: "[" + ", ".join(map(quoted, xs)) + "]"
    version = r"(?i)\s*\(?\s*(?:v(?:er(?:sion)?)?\.?\s*)?(\d+(?:\.\d+)+[a-z0-9._-]*|v\d[a-z0-9._-]*)\s*\)?\s*$"
    roles = [r[1] for r in ontology.role_rows()]

    def prose(x: str) -> str:
        for tag in ("table-wrap", "fig", "supplementary-material"):
            x = rf"regexp_replace({x}, '(?s)<{tag}\b.*?</{tag}>', ' ', 'g')"
        x = rf"regexp_replace({x}, '(?s)<xref\b.*?</xref>', '', 'g')"
        x = f"regexp_replace(regexp_replace({x}, '</(p|title|sec)>', chr(10), 'g'), '<[^>]+>', '', 'g')"
        for old, new in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&#x2019;", "'"), ("&#x3b1;", "α")):
            x = f"replace({x}, {quoted(old)}, {quoted(new)})"
        x = rf"regexp_replace(regexp_replace({x}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
        return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"

    hints = "(?i)" + "|".join(text.COMPUTATIONAL)
    papers = rf"""
WITH p AS (
  SELECT page_id AS n, CAST(page_id AS VARCHAR) AS id, coalesce(html, '') AS html, coalesce(url, '') AS url FROM pages
), found AS (
  SELECT n, id, '10.1/' || id AS doi, trim(regexp_replace(' A  title ' || url, '\s+', ' ', 'g')) AS title, CASE WHEN n % 3 > 0 THEN '2019-05-01' WHEN n % 2 > 0 THEN '2018' ELSE '2020' END AS date,
    CASE WHEN n % 4 > 0 THEN 'J' WHEN n % 8 > 0 THEN 'P' ELSE 'preprint' END AS journal, CASE WHEN n % 3 = 0 THEN 'PMC' || id ELSE '' END AS pmcid, html,
    {array(HEADINGS)}[CAST(n % {len(HEADINGS)} AS INT) + 1] AS heading
  FROM p WHERE n % 5 > 0 AND n % 7 > 0
), x AS (
  SELECT *, CASE WHEN n % 3 < 2 THEN '<sec id=''m''><title>' || heading || '</title><p>' || replace(html, '<title>', '<h0>') || '</p><sec><p>in</p></sec>end</sec>' END AS sec FROM found
), y AS (
  SELECT *, length(sec) + length('<body><sec><title>Methods</title><p>short</p></sec><sec><p>after</p></sec></body>') AS xml_chars,
    CASE WHEN heading NOT IN ('Results', '2.1 Methods', 'Methods of old') THEN {prose("sec")} END AS body FROM x
), z AS (SELECT *, CASE WHEN length(body) >= 800 THEN body END AS methods FROM y),
t AS (SELECT *, list_filter(string_split(methods, chr(10)), lambda l: trim(l) <> '' AND regexp_matches(l, {quoted(hints)})) AS kept FROM z)"""
    pad = "repeat('é', 60)"
    request = lambda k: f"'query for customer/' || CAST({k} AS VARCHAR) || ' ' || {pad}"
    key = lambda k: f"substr(regexp_replace({request(k)}, '[^A-Za-z0-9._-]', '_', 'g'), 1, 80) || '.' || substr(sha1({request(k)}), 1, 12) || '.cache'"
    return {
        "split_names": rf"""
WITH k AS (
  SELECT raw, stated, count(*) AS n FROM (SELECT {array(RAW_NAMES)}[CAST(l_partkey % {len(RAW_NAMES)} AS INT) + 1] AS raw, CASE l_linenumber WHEN 1 THEN 'v9.9' WHEN 2 THEN '' END AS stated FROM lineitem) GROUP BY ALL
), v AS (
  SELECT *, trim(raw) AS name, nullif(regexp_extract(trim(raw), '{version}', 1), '') AS found, trim(regexp_replace(trim(raw), '{version}', ''), ' .,;(') AS stem FROM k
), u AS (SELECT *, found IS NOT NULL AND stem <> '' AS use FROM v)
SELECT raw, stated, n, nullif(CASE WHEN use THEN stem ELSE name END, '') AS tool_raw,
  coalesce(CASE WHEN raw <> '' THEN ltrim(nullif(stated, ''), 'vV') ELSE nullif(stated, '') END, CASE WHEN use THEN ltrim(found, 'vV') END) AS version,
  regexp_replace(lower(nullif(CASE WHEN use THEN stem ELSE name END, '')), '[^a-z0-9]', '', 'g') AS key FROM u""",
        "page_prose": f"""
SELECT page_id, md5(t) AS digest, length(t) AS chars FROM (
  SELECT page_id, {prose("'a<fig id=''f''><p>gone</p></fig>b<xref>1</xref>c &#x2019;&#x3b1; ' || coalesce(html, '')")} AS t FROM pages)""",
        "paper_methods": papers + """
SELECT id, doi, title, date, journal, pmcid, xml_chars, length(methods) AS methods_chars, md5(methods) AS digest,
  CASE WHEN methods IS NULL THEN NULL WHEN length(methods) <= 9000 THEN length(methods) WHEN len(kept) > 0 THEN least(9000, length(array_to_string(kept, chr(10)))) ELSE 9000 END AS trimmed_chars FROM t""",
        "ingest_funnel": papers + """
SELECT journal, CASE WHEN coalesce(xml_chars, 0) = 0 THEN 'no_full_text' WHEN methods IS NULL THEN 'no_methods' WHEN n % 4 = 0 THEN 'failed' ELSE 'yielded' END AS stage,
  count(*) AS papers, CAST(sum(n % 9) AS BIGINT) AS steps, CASE WHEN sum(n % 9) > 0 THEN CAST(sum(n % 3) AS DOUBLE) / CAST(sum(n % 9) AS DOUBLE) END AS match_rate, CAST(sum(n % 6) AS DOUBLE) AS seconds FROM t GROUP BY ALL""",
        "first_papers": """
SELECT CAST(page_id AS VARCHAR) AS id, CASE WHEN page_id % 3 > 0 THEN '2019-05-01' WHEN page_id % 2 > 0 THEN '2018' ELSE '2020' END AS date, CASE WHEN page_id % 4 > 0 THEN 'J' WHEN page_id % 8 > 0 THEN 'P' ELSE 'preprint' END AS journal
FROM pages ORDER BY date DESC, page_id LIMIT 40""",
        "wanted_papers": """
WITH a AS (SELECT DISTINCT c_custkey * 3 % 1000 AS n FROM customer)
SELECT CAST(n AS VARCHAR) AS id, page_id IS NOT NULL AS found FROM a LEFT JOIN pages ON page_id = n""",
        "pending_requests": f"""
SELECT {key("c_custkey")} AS cache_key, length({request("c_custkey")}) AS chars FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0)""",
        "response_outcomes": f"""
WITH r AS (
  SELECT o_orderkey AS response, o_orderkey AS n, o_custkey % 8 AS shape, o_orderkey % 3 = 0 AS cut,
    {array(["complete", "partial", "sketch", "whole"])}[CAST(o_orderkey % 4 AS INT) + 1] AS completeness, {array(roles + ["no_such_role"])}[CAST(o_custkey % {len(roles) + 1} AS INT) + 1] AS role FROM orders
), s AS (SELECT *, shape IN (0, 1, 2, 3, 7) AS parsed FROM r)
SELECT response, CASE WHEN parsed AND cut THEN 'ok_truncated' WHEN parsed THEN 'ok' WHEN cut THEN 'truncated' ELSE 'unparseable' END AS outcome,
  CASE WHEN parsed THEN completeness END AS completeness, CASE WHEN parsed THEN role END AS role, CASE WHEN parsed THEN 'T' END AS tool_raw, CASE WHEN parsed THEN '1.' || CAST(n % 7 AS VARCHAR) END AS version,
  CASE WHEN parsed THEN concat_ws('|', CASE WHEN completeness = 'whole' THEN 'completeness' END, CASE WHEN n % 5 = 0 OR n % 13 = 0 THEN 'order' END, CASE WHEN role = 'no_such_role' THEN 'role' END, CASE WHEN n % 11 = 0 THEN 'step_keys' END, CASE WHEN n % 17 = 0 THEN 'step_types' END) END AS problems FROM s""",
        "prompt_rows": f"""
WITH roles(pos, id, stage) AS (VALUES {", ".join(f"({r[0]}, {quoted(r[1])}, {quoted(r[2])})" for r in ontology.role_rows())}),
b AS (SELECT string_agg('- `' || id || '` (' || stage || '): does ' || id || ' [e.g. t-' || id || ']', chr(10) ORDER BY pos) AS block FROM roles)
SELECT item_id, md5('Read the methods.' || chr(10) || chr(10) || '## Roles' || chr(10) || chr(10) || block) AS system, md5('Text:' || chr(10) || text || chr(10) || 'End.') AS user FROM benchmark, b""",
        "batch_counts": """
WITH s AS (SELECT l_orderkey, count(*) AS k FROM lineitem WHERE l_quantity >= 5 GROUP BY l_orderkey)
SELECT o_custkey % 7 AS run_ord, count(*) AS records, count(k) AS usable, CAST(coalesce(sum(k), 0) AS BIGINT) AS steps FROM orders LEFT JOIN s ON l_orderkey = o_orderkey GROUP BY ALL""",
        "paper_labels": """
SELECT source, CASE WHEN doc_id % 13 > 0 AND length(text) < 800 THEN 'too_short' WHEN doc_id % 5 = 0 THEN 'empty' ELSE 'plotted' END AS label, count(*) AS papers FROM documents GROUP BY ALL""",
    }


SQL = _sql()
