"""Default dimensions: roles of steps, and a small set of tools and databases for tests.

Every job takes these as tables; pass your own in the same shape.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Role, stage, order hint, and whether tools may be swapped freely.
ROLES = [
    ("retrieve", "acquire", 0, True),
    ("demultiplex", "acquire", 5, True),
    ("basecall", "acquire", 3, True),
    ("qc_raw", "acquire", 10, True),
    ("trim", "preprocess", 20, True),
    ("remove_primers", "preprocess", 22, False),
    ("filter_host", "preprocess", 30, True),
    ("merge_reads", "preprocess", 35, True),
    ("subsample", "preprocess", 38, True),
    ("error_correct", "preprocess", 40, True),
    ("dereplicate", "amplicon", 45, True),
    ("denoise", "amplicon", 50, True),
    ("cluster_otu", "amplicon", 50, True),
    ("chimera_removal", "amplicon", 55, True),
    ("filter_features", "amplicon", 60, True),
    ("decontaminate", "amplicon", 62, False),
    ("assemble", "assembly", 70, True),
    ("polish", "assembly", 75, True),
    ("map_reads", "assembly", 80, True),
    ("bin", "assembly", 85, True),
    ("bin_refine", "assembly", 90, True),
    ("bin_qc", "assembly", 95, True),
    ("dereplicate_genomes", "assembly", 100, True),
    ("scaffold", "assembly", 92, True),
    ("profile_taxonomic", "reference", 65, True),
    ("profile_functional", "reference", 68, True),
    ("taxonomy_assign", "reference", 105, True),
    ("classify_genomes", "reference", 110, True),
    ("predict_genes", "annotate", 115, True),
    ("annotate_function", "annotate", 120, True),
    ("build_gene_catalog", "annotate", 118, True),
    ("quantify", "annotate", 125, True),
    ("phylogeny", "annotate", 130, True),
    ("normalize", "ecology", 135, False),
    ("diversity", "ecology", 140, True),
    ("ordination", "ecology", 145, True),
    ("differential_abundance", "ecology", 150, False),
    ("correlate", "ecology", 155, True),
    ("model", "ecology", 158, True),
    ("detect_mge", "specialty", 160, True),
    ("detect_amr", "specialty", 162, True),
    ("detect_bgc", "specialty", 164, True),
    ("strain_resolve", "specialty", 166, True),
    ("call_variants", "specialty", 168, True),
    ("pangenome", "specialty", 170, True),
    ("visualize", "deliver", 180, True),
    ("report", "deliver", 190, True),
    ("custom", "specialty", 175, False),
]
STAGE_ORDER = ["reads", "amplicon", "assembly", "reference", "annotate", "ecology", "specialty", "deliver"]

TOOLS = [
    ("dada2", "DADA2", ["dada 2"], ["denoise"]),
    ("kraken2", "Kraken 2", ["kraken"], ["profile_taxonomic"]),
    ("bwa_mem2", "bwa-mem2", ["bwa mem 2"], ["map_reads"]),
    ("bwa", "BWA", ["bwa mem"], ["map_reads"]),
    ("megahit", "MEGAHIT", [], ["assemble"]),
    ("metabat2", "MetaBAT 2", ["metabat"], ["bin"]),
    ("checkm", "CheckM", ["checkm2"], ["bin_qc"]),
    ("fastqc", "FastQC", [], ["qc_raw"]),
]
DATABASES = [("silva", "SILVA", ["silva ssu"]), ("gtdb", "GTDB", ["gtdb release"]), ("card", "CARD", [])]


def role_rows() -> list[tuple]:
    return [(i, *row) for i, row in enumerate(ROLES)]


def roles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(role_rows(), "pos int, id string, stage string, order_hint int, substitutable boolean")


def tools(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *t) for i, t in enumerate(TOOLS)], "pos int, id string, name string, aliases array<string>, roles array<string>")


def databases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *t) for i, t in enumerate(DATABASES)], "pos int, id string, name string, aliases array<string>")
