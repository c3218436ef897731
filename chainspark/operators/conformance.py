"""Form of catalog records and of the ontology: one table of rules, applied to every value of every raw document.

Rules are ``pattern, kind, arg``. Nearly all values of a record are right, so each document is walked once by a plain look
(``Place``), which passes by what surely breaks no rule and names the places of all else. What stands there is judged
by columns, inside the row of the document: a value is a variant, and each kind of rule is a predicate. Nothing shuffles.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONGEST_MESSAGE = 200
# What the fields of a record may hold.
SLUG = "^[a-z0-9]+(-[a-z0-9]+)*$"
LONGEST_QUOTE = "1200"
SCHEMA_VERSION = "0.1.0"
TIERS = "reference usable documented paper_only rejected"
ENUMS = {
    "source_kind": "arxiv biorxiv medrxiv pubmed europepmc doi registry url",
    "host": "github gitlab bitbucket zenodo figshare workflowhub nf-core galaxy dryad other",
    "relation": "forks supersedes superseded_by variant_of benchmarks benchmarked_by cites",
    "chain_source": "methods_text abstract_only repo_code registry_metadata manual",
    "completeness": "complete partial sketch",
    "evidence_source": "paper repo registry readme adjudicator",
    "divergence": "undisclosed_step missing_step version_mismatch param_mismatch tool_substitution order_mismatch db_unspecified db_version_mismatch",
    "severity": "cosmetic minor material",
    "layout": "PAIRED SINGLE",
    "platform": "ILLUMINA OXFORD_NANOPORE PACBIO_SMRT BGISEQ ION_TORRENT ELEMENT ULTIMA CAPILLARY ANY",
    "strategy": "AMPLICON WGS WGA RNA-Seq ssRNA-seq Hi-C ATAC-seq Bisulfite-Seq Targeted-Capture OTHER ANY",
    "library_source": "METAGENOMIC GENOMIC METATRANSCRIPTOMIC TRANSCRIPTOMIC VIRAL_RNA SYNTHETIC OTHER ANY",
    "marker": "16S 18S ITS 23S rpoB gyrB cpn60 amoA nifH dsrB mcrA COI rbcL psbA other",
    "environment": "soil sediment freshwater marine hydrothermal groundwater wastewater cryosphere permafrost atmosphere built_environment bioreactor compost "
    "plant_rhizosphere plant_phyllosphere plant_endosphere human_gut human_oral human_skin human_respiratory human_urogenital animal_gut animal_other insect food_fermentation clinical mock_community any",
    "output": "asv_table otu_table taxonomy_table phylogenetic_tree representative_sequences diversity_metrics ordination differential_abundance_table correlation_network "
    "assembly_contigs mags mag_quality_report genome_taxonomy pangenome gene_catalog gene_annotations functional_profile pathway_abundance taxonomic_profile strain_profile "
    "variant_calls viral_contigs plasmid_contigs amr_profile biosynthetic_gene_clusters expression_matrix qc_report figures manuscript_ready_report",
    "engine": "nextflow snakemake cwl wdl galaxy make bash python_script r_script jupyter rmarkdown quarto gui_only none unknown",
    "container": "docker singularity apptainer podman biocontainers",
    "env_spec": "conda mamba renv requirements.txt pyproject lockfile dockerfile none",
    "pinned": "all partial none unknown",
    "docs": "good minimal none",
    "profile_source": "reported config_declared estimated",
    "tier": TIERS,
    "confidence": "high medium low",
    "lane": "arxiv biorxiv pubmed europepmc registry manual",
}
# The keys of each object, ``!`` after those that it must have, and what each holds (text, if nothing is said):
# a basic type, a name of ENUMS, ``[...]`` for an array, ``+`` for one that may not be empty, ``?`` where null is allowed too.
EVIDENCE = {"": "source!:evidence_source locator! quote:quote"}
CHAIN = {
    "": "source:chain_source extracted_from:[text] completeness:completeness steps!:[object]",
    "steps/*": "step_id order!:natural depends_on:[text] role! tool tool_raw version optional:flag alternative_of params:map database purpose evidence:[object]",
    "steps/*/evidence/*": EVIDENCE[""],
}
RECORD = {
    "": "id!:slug name! aliases:[text] summary archetype!:[text]+ provenance!:object claimed!:object observed:object? divergence:[object] applicability!:object outputs:[output] "
    "runnability:object vetting!:object record_meta!:object",
    "provenance": "sources:[object] code:[object] related:[object]",
    "provenance/sources/*": "kind!:source_kind id! title authors:[text] venue date url license fulltext_available:flag",
    "provenance/code/*": "url! host:host resolves:flag commit release license engine:engine entrypoints:[text] last_commit_date stars:whole",
    "provenance/related/*": "relation!:relation workflow_id! note",
    **{f"{side}/{path}".rstrip("/"): keys for side in ("claimed", "observed") for path, keys in CHAIN.items()},
    "divergence/*": "type!:divergence severity:severity role description! claimed_value observed_value evidence:[object]",
    "divergence/*/evidence/*": EVIDENCE[""],
    "applicability": "platform:[platform] library_strategy:[strategy] library_source:[library_source] library_layout:[layout] marker_gene:[marker] amplicon_region:[text] read_length_min:whole "
    "read_length_max:whole depth_min_reads:whole environment:[environment] host_associated:flag requires_host_reference:flag requires_multiple_samples:flag min_samples:whole "
    "requires_replication:flag reference_databases:[object] excluded:[text]",
    "applicability/reference_databases/*": "name! version role approx_size_gb:number licensed:flag",
    "runnability": "engine:engine engine_version containerized:flag container_kind:[container] env_spec:[env_spec] versions_pinned:pinned has_test_data:flag has_ci:flag install_docs:docs "
    "resource_profile:object hpc_ready:flag",
    "runnability/resource_profile": "peak_ram_gb:number cpu_hours_per_sample:number disk_gb_per_sample:number gpu_required:flag source:profile_source",
    "vetting": "tier!:tier scorecard:object adjudication:object human_review:object",
    "vetting/scorecard": "code_resolves:flag has_license:flag has_env_spec:flag has_container:flag uses_workflow_engine:flag versions_pinned:pinned has_tagged_release:flag has_ci:flag "
    "has_test_data:flag db_versions_recorded:flag months_since_last_commit:whole citation_count:whole citation_count_source fulltext_methods_available:flag",
    "vetting/adjudication": "model! prompt_version! date! confidence:confidence chain_matches_claims:flag soundness_notes:[text] caveats:[text] strengths:[text] suggested_tier:tier evidence:[object]",
    "vetting/adjudication/evidence/*": EVIDENCE[""],
    "vetting/human_review": "reviewer date tier_override:tier notes",
    "record_meta": "schema_version!:version first_seen! last_extracted extractor_version ingest_lane:[lane] needs_review:flag notes",
}
#: What a basic type stands for, as rules.
BASIC = {
    "text": [("type", "string")], "flag": [("type", "boolean")], "whole": [("type", "integer")], "number": [("type", "number")], "object": [("type", "object")], "map": [("type", "object")],
    "natural": [("type", "integer"), ("minimum", "0")], "slug": [("type", "string"), ("pattern", SLUG)], "quote": [("type", "string"), ("max_length", LONGEST_QUOTE)], "version": [("type", "string"), ("const", SCHEMA_VERSION)],
}
#: What values of an open map may be.
MAP_VALUES = "string|number|boolean|array|null"


def rules_of(form: dict[str, str] = RECORD) -> list[tuple[str, str, str]]:
    """``pattern, kind, arg`` of a form; in a pattern ``*`` stands for any index, or any key of an open map."""

    def of(pattern: str, what: str) -> Iterator[tuple[str, str, str]]:
        if what.startswith("["):
            yield pattern, "type", "array"
            if what.endswith("+"):
                yield pattern, "min_items", "1"
            yield from of(f"{pattern}/*", what.strip("[]+"))
        elif what.rstrip("?") in BASIC:
            null = "|null" if what.endswith("?") else ""
            yield from ((pattern, kind, arg + (null if kind == "type" else "")) for kind, arg in BASIC[what.rstrip("?")])
            if what == "map":
                yield f"{pattern}/*", "type", MAP_VALUES
        else:
            yield pattern, "enum", ENUMS[what].replace(" ", "|")

    out = [("", "type", "object")]
    for path, keys in form.items():
        named = [k.partition(":") for k in keys.split()]
        out.append((path, "closed", "|".join(k.rstrip("!") for k, _, _ in named)))
        out += [(path, "required", k[:-1]) for k, _, _ in named if k.endswith("!")]
        for key, _, what in named:
            out += of(f"{path}/{key.rstrip('!')}".lstrip("/"), what or "text")
    return out


def type_of(v: Column) -> Column:
    """JSON type of a variant; a number without fraction is an ``integer``, however it is written."""
    name = F.schema_of_variant(v)
    is_object, is_array = (F.try_variant_get(v, "$", kind).isNotNull() for kind in ("map<string,variant>", "array<variant>"))  # without what is inside
    whole = F.try_variant_get(v, "$", "double") == F.floor(F.try_variant_get(v, "$", "double"))
    return (
        F.when(is_object, "object").when(is_array, "array").when(name == "STRING", "string").when(name == "BOOLEAN", "boolean").when(name == "VOID", "null")
        .when(name.endswith("INT") | whole, "integer").otherwise("number")
    )


#: Kinds of rules, in the order in which failures of one value count.
KINDS = ("type", "enum", "const", "pattern", "max_length", "minimum", "min_items", "required", "closed")


def by_pattern(rules: list[tuple[str, str, str]]) -> list[tuple]:
    """``pattern`` and one list of arguments for each kind; null where there is no such rule."""
    table: dict[str, dict[str, list[str]]] = {}
    for pattern, kind, arg in rules:
        table.setdefault(pattern, {}).setdefault(kind, []).extend([arg] if kind == "pattern" else arg.split("|"))
    return [(pattern, *(own.get(k) for k in KINDS)) for pattern, own in table.items()]


JSON = json.JSONDecoder()
#: What surely matches a pattern, in Python's terms; up to EXACT, doubles tell whole numbers apart.
SURE, EXACT = {SLUG: re.compile("[a-z0-9]+(?:-[a-z0-9]+)*")}, 2**53
#: Python's types of the JSON types of scalars; a float may still be whole.
SCALARS = {"string": str, "boolean": bool, "null": type(None), "integer": int, "number": float}


@dataclass(slots=True)
class Place:
    """What surely breaks no rule of a pattern, and the places below it. Where this leaves a doubt, columns decide."""

    rule: int = -1  # number of the pattern's rules
    easy: frozenset = frozenset(SCALARS.values())  # types of scalars
    texts: frozenset = frozenset()
    form: re.Pattern | None = None  # of whole texts
    longest: int = -1  # characters of a text
    least: float = math.inf  # of whole numbers
    fewest: float = 0  # items of an array
    required: frozenset | None = frozenset()  # keys of an object; None: it may be wrong as such
    closed: frozenset | None = None  # None: any keys
    keys: dict[str, Place] = field(default_factory=dict)
    items: Place | None = None
    others: Place | None = None  # of keys that are not named

    def learn(self, rule: int, own: dict[str, list[str] | None]) -> None:
        named = [frozenset(own[k][: 1 if k == "const" else None]) for k in ("enum", "const") if own[k]]
        types = set(own["type"] or [*SCALARS, "object", "array"]) & ({"string"} if named else {*SCALARS, "object", "array"})
        easy = {t for name, t in SCALARS.items() if name in types and t is not int}
        if "number" in types:
            easy.add(int)
        if "number" in types or "integer" in types:
            self.least = float(own["minimum"][0]) if own["minimum"] else -math.inf
        if own["minimum"]:
            easy -= {int, float}
        if "string" in types and (limits := [k for k in ("pattern", "max_length") if own[k]] + named):
            easy.remove(str)
            if limits == named:
                self.texts = frozenset.intersection(*named)
            elif limits == ["max_length"]:
                self.longest = int(own["max_length"][0])
            elif limits == ["pattern"]:
                self.form = SURE.get(own["pattern"][0])
        self.rule, self.easy = rule, frozenset(easy)
        self.fewest = int((own["min_items"] or [0])[0]) if "array" in types else math.inf
        self.required = frozenset(own["required"] or ()) if "object" in types else None
        self.closed = None if own["closed"] is None else frozenset(own["closed"])

    def is_right(self, v: str | float | bool | None) -> bool:
        if type(v) is str:
            return v in self.texts or len(v) <= self.longest or (self.form is not None and self.form.fullmatch(v) is not None)
        return type(v) in (int, float) and self.least <= v and abs(v) <= EXACT and v == int(v)

    def look(self, v: dict | list, at: tuple | None, found: list[tuple]) -> None:
        """Adds ``rule, at`` of each value, from ``v`` down, that may break a rule. ``at``: the way to ``v``, its last step apart from those before."""
        if type(v) is dict:
            right = self.required is not None and self.required <= v.keys() and (self.closed is None or v.keys() <= self.closed)
            inner, keys, others = v.items(), self.keys, self.others
        else:
            right, inner, keys, others = len(v) >= self.fewest, enumerate(v), {}, self.items
        if not right:
            found.append((self.rule, at))
        for step, x in inner:
            place = keys.get(step, others)
            if place is None or (kind := type(x)) in place.easy:
                continue
            if kind is dict or kind is list:
                place.look(x, (at, step), found)
            elif not place.is_right(x):
                found.append((place.rule, (at, step)))

    def suspects(self, text: bytes) -> list[tuple[int, list[str]]] | None:
        """``rule, steps`` of the values of a JSON text that may break a rule; None if Python can't read it."""
        found: list[tuple] = []
        try:
            v = JSON.raw_decode(text.decode("utf-8", "replace").lstrip(" \t\n\r"))[0]
        except (ValueError, RecursionError):
            return None
        Place(items=self).look([v], None, found)
        return [(rule, _steps(at)) for rule, at in found]


def _steps(at: tuple | None) -> list[str]:
    """The steps of ``at`` as Spark has them, but for the first, which leads to the document."""
    steps: list[str] = []
    while at is not None:
        at, step = at
        steps.append(str(step).encode("utf-8", "replace").decode())
    return steps[-2::-1]


def places_of(table: list[tuple], maps: set[str]) -> Place:
    """The place of whole documents. ``table``: of ``by_pattern``; ``maps``: patterns of open maps."""
    root, open_maps = Place(), []
    for rule, (pattern, *own) in enumerate(table):
        place = root
        for step in pattern.split("/") if pattern else []:
            if step == "*":
                place.items = place.items or Place()
            place = place.items if step == "*" else place.keys.setdefault(step, Place())
        place.learn(rule, dict(zip(KINDS, own)))
        if pattern in maps:
            open_maps.append(place)
    for place in open_maps:
        place.keys, place.others = {}, place.items
    return root


def suspects(raw: Column, table: list[tuple], maps: set[str]) -> Column:
    """``rule, steps`` of the values of each raw document that may break a rule; null where Python can't read the text.

    Python reads all that Spark does, and some more (repeated keys, NaN): the caller asks Spark what is a document.
    """
    root = places_of(table, maps)

    @F.arrow_udf("array<struct<rule: int, steps: array<string>>>")
    def look(texts: pa.Array) -> pa.Array:
        found = [[] if t is None else root.suspects(t) for t in texts.cast(pa.large_binary()).to_pylist()]
        flat = [x for own in found if own for x in own]
        ends = [0, *accumulate(len(own or ()) for own in found)]
        rules, steps = pa.array([rule for rule, _ in flat], pa.int32()), pa.array([steps for _, steps in flat], pa.list_(pa.string()))
        begins = pa.array([None if own is None else at for own, at in zip(found, ends)] + ends[-1:], pa.int32())
        return pa.ListArray.from_arrays(begins, pa.StructArray.from_arrays([rules, steps], ["rule", "steps"]))

    return look(raw)


def value_at(v: Column, steps: Column) -> Column:
    """The value that is reached from the variant ``v`` by keys and indices."""
    keyed = lambda at, step: F.element_at(F.try_variant_get(at, "$", "map<string,variant>"), step)
    item = lambda at, step: F.get(F.try_variant_get(at, "$", "array<variant>"), step.try_cast("int"))
    return F.aggregate(steps, v, lambda at, step: F.coalesce(keyed(at, step), item(at, step)))


def broken(value: Column) -> Column:
    """``path, depth, rank, kind, message`` of the rules that a value breaks. ``value``: ``path, depth, rules, v, is_a``."""
    v, rules, is_a = value["v"], value["rules"], value["is_a"]
    rule = {k: rules[k] for k in KINDS}
    first = {k: F.get(c, 0) for k, c in rule.items()}
    text, shown = F.when(is_a == "string", F.try_variant_get(v, "$", "string")), F.to_json(v)
    keys = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
    has = lambda c: F.coalesce(c, F.lit(False))
    fits = F.array_contains(rule["type"], is_a) | ((is_a == "integer") & F.array_contains(rule["type"], "number"))
    told = {
        "type": (~fits, F.concat(shown, F.lit(" is not of type "), F.array_join(rule["type"], " or "))),
        "enum": (rule["enum"].isNotNull() & ~has(F.array_contains(rule["enum"], text)), F.concat(shown, F.lit(" is not one of "), F.array_join(rule["enum"], ", "))),
        "const": (first["const"].isNotNull() & ~has(text == first["const"]), F.concat(shown, F.lit(" should be "), first["const"])),
        "pattern": (~F.rlike(text, first["pattern"]), F.concat(shown, F.lit(" does not match "), first["pattern"])),
        "max_length": (F.length(text) > first["max_length"].try_cast("int"), F.concat(shown, F.lit(" is too long"))),
        "minimum": (is_a.isin("integer", "number") & (F.try_variant_get(v, "$", "double") < first["minimum"].try_cast("double")), F.concat(shown, F.lit(" is less than "), first["minimum"])),
        "min_items": ((is_a == "array") & (F.size(F.try_variant_get(v, "$", "array<variant>")) < first["min_items"].try_cast("int")), F.concat(shown, F.lit(" has too few items"))),
    }
    one = lambda k, message: F.struct(value["path"].alias("path"), value["depth"].alias("depth"), F.lit(KINDS.index(k)).alias("rank"), F.lit(k).alias("kind"), message.alias("message"))
    single = [F.when(has(when), one(k, message)) for k, (when, message) in told.items()]
    more = F.array_except(keys, rule["closed"])
    single.append(F.when(has(F.size(more) > 0), one("closed", F.concat(F.lit("unexpected keys: "), F.array_join(F.array_sort(more), ", ")))))
    each = F.transform(F.array_except(rule["required"], keys), lambda k: one("required", F.concat(k, F.lit(" is required"))))
    return F.concat(F.array_compact(F.array(*single)), F.coalesce(each, F.array().cast(FAILURES)))


FAILURES = "array<struct<path: string, depth: int, rank: int, kind: string, message: string>>"


def failures(documents: DataFrame, rules: list[tuple[str, str, str]] | None = None, raw: str = "raw") -> DataFrame:
    """``rec_id`` and ``failed``: an array of ``path, depth, rank, kind, message``, one for every broken rule of the document.

    ``documents``: ``rec_id`` and the raw JSON text. A rule speaks only of values of its type: a text is not too short an
    array. Text that is no JSON has no failures here (``sources.files.read_documents`` reports it).
    """
    rules = rules or rules_of()
    table = by_pattern(rules)
    patterns = {p for p, _, _ in rules}
    maps = {p for p, kind, arg in rules if kind == "type" and arg == "object" and f"{p}/*".lstrip("/") in patterns}
    given = F.from_json(F.lit(json.dumps([dict(zip(KINDS, own)) for _, *own in table])), f"array<struct<{', '.join(f'{k}: array<string>' for k in KINDS)}>>")
    looked = documents.select("rec_id", raw, suspects(F.col(raw), table, maps).alias("places"))
    read = looked.select("rec_id", "places", F.when(F.col("places").isNull() | (F.size("places") > 0), F.try_parse_json(raw)).alias("v"))
    v = F.col("v")
    places = F.when(v.isNotNull(), F.coalesce("places", F.raise_error(F.lit("Python can't read a document that Spark can")).cast("array<struct<rule: int, steps: array<string>>>")))
    values = F.transform(places, lambda s: F.struct(F.array_join(s["steps"], "/").alias("path"), F.size(s["steps"]).alias("depth"), F.get(given, s["rule"]).alias("rules"), value_at(v, s["steps"]).alias("v")))
    typed = F.transform(values, lambda s: F.struct(s["path"].alias("path"), s["depth"].alias("depth"), s["rules"].alias("rules"), s["v"].alias("v"), type_of(s["v"]).alias("is_a")))
    return read.select("rec_id", F.flatten(F.transform(typed, broken)).alias("failed"))


def record_form_issues(documents: DataFrame, rules: list[tuple[str, str, str]] | None = None, raw: str = "raw") -> DataFrame:
    """Issues ``rec_id, severity, code, where, message`` of the form of records.

    A value that may be null or an object is a choice of branches: where the object fails, only its deepest failure is
    reported, of equally deep ones that of the first path, then of the first of KINDS. Null is fine there. Documents of
    equal or no id are judged each for itself. A message is cut at LONGEST_MESSAGE characters.
    """
    rules = rules or rules_of()
    choices = [p for p, kind, arg in rules if kind == "type" and "null" in arg.split("|") and "object" in arg.split("|")]
    branch = lambda f: F.coalesce(*[F.when((f["path"] == p) | f["path"].startswith(f"{p}/"), F.lit(p)) for p in choices], F.lit(None).cast("string"))
    issue = lambda f: F.struct(*[f[c].alias(c) for c in ("path", "kind", "message")])

    def deepest(choice: str) -> Column:
        order = lambda f: F.struct((-f["depth"]).alias("up"), *[f[c].alias(c) for c in ("path", "rank", "message", "kind")])
        return F.array_min(F.transform(F.filter("failed", lambda f: branch(f) == choice), order))

    whole = F.transform(F.filter("failed", lambda f: branch(f).isNull()), issue)
    chosen = [F.transform(F.array_compact(F.array(*map(deepest, choices))), issue)] if choices else []
    found = failures(documents, rules, raw).select("rec_id", F.inline(F.concat(whole, *chosen)))
    cut = F.when(F.length("message") < LONGEST_MESSAGE, F.col("message")).otherwise(F.concat(F.substring("message", 1, LONGEST_MESSAGE), F.lit(" …")))
    return found.select("rec_id", F.lit("error").alias("severity"), F.concat(F.lit("form_"), "kind").alias("code"), F.when(F.col("path") == "", "<root>").otherwise(F.col("path")).alias("where"), cut.alias("message"))


def ontology_issues(roles: DataFrame, tools: DataFrame, archetypes: DataFrame) -> DataFrame:
    """``entry, field, role``: roles that tools claim, or that archetypes name, and that are no roles.

    ``tools``: ``id, roles``; ``archetypes``: ``id, required_roles, expected_roles, red_flag_missing``. Null and empty
    lists name nothing. A role that is named twice in one place is reported once.
    """
    places = [(tools, "roles"), *((archetypes, c) for c in ("required_roles", "expected_roles", "red_flag_missing"))]
    named = [t.select(F.col("id").alias("entry"), F.lit(c).alias("field"), F.explode(c).alias("role")) for t, c in places]
    return reduce(DataFrame.unionByName, named).distinct().join(roles.select(F.col("id").alias("role")), "role", "left_anti").select("entry", "field", "role")
