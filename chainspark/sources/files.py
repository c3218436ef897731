"""Readers and writers of run files, catalog records and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STEP = "struct<order:int,role:string,tool_raw:string,version:string,params:string,database:string,evidence:string>"
RECORD = f"""paper struct<id:string,doi:string,title:string,authors:string,date:string,journal:string,pmcid:string,source:string,is_open_access:boolean>,
methods_chars int, chain struct<completeness:string,source:string,steps:array<{STEP}>>, provenance struct<model:string,prompt_version:string>,
stats struct<completion_tokens:int,reasoning_tokens:int,elapsed_s:double>, tools_known array<string>, tools_unknown array<string>"""


def read_runs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Run files (each one JSON array) as records with ``run_ord`` (place in ``paths``) and ``rec_ord`` (place in the file)."""
    texts = [spark.read.text(path, wholetext=True).select(F.lit(i).alias("run_ord"), "value") for i, path in enumerate(paths)]
    whole = texts[0]
    for more in texts[1:]:
        whole = whole.unionByName(more)
    parsed = whole.select("run_ord", F.posexplode(F.from_json("value", f"array<struct<{_struct(RECORD)}>>")).alias("rec_ord", "r"))
    return parsed.select("run_ord", "rec_ord", "r.*")


def _struct(columns: str) -> str:
    """``name type`` pairs of a table in the form that struct types take."""
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in _parsed(columns))


def _parsed(columns: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(columns)


def read_documents(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """One JSON document per file: those that are objects, with ``stem`` and the raw text, and the others as issues."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^(.*?)(\.[^.]*)?$", 1).alias("stem"), "value")
    read = files.withColumn("doc", F.from_json("value", schema, {"mode": "PERMISSIVE"})).withColumn("keys", F.json_object_keys("value"))
    good = F.col("keys").isNotNull() & F.try_parse_json("value").isNotNull()
    bad = read.where(~good).select(F.col("stem").alias("rec_id"), F.lit("error").alias("severity"), F.lit("unreadable").alias("code"), F.lit("record").alias("where"), F.substring("value", 1, 200).alias("message"))
    return read.where(good).select("stem", F.col("value").alias("raw"), "keys", "doc"), bad


def write_records(records: DataFrame, path: str, form: str = "parquet") -> None:
    records.write.mode("overwrite").format(form).save(path)


def write_evaluation(runs: DataFrame, path: str, form: str = "json") -> None:
    """Evaluation runs without the list of single assertions, which belongs to its own table."""
    write_records(runs.drop("results"), path, form)


def write_release(records: DataFrame, path: str, form: str = "json", tier: str = "tier") -> None:
    """The catalog as one release: a folder for each tier, files sorted by ``rec_id``, and no id in two files of a tier.

    Rows are dealt by ranges of (tier, rec_id), so any number of tasks writes it and a large tier has several files.
    """
    ordered = records.withColumn(tier, F.coalesce(tier, F.lit("none"))).repartitionByRange(tier, "rec_id").sortWithinPartitions(tier, "rec_id")
    ordered.write.mode("overwrite").partitionBy(tier).format(form).save(path)


def write_payload(tables: dict[str, DataFrame], path: str) -> None:
    """One folder for each table of an analysis."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
