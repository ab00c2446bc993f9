"""A corpus pipeline: quality rules, line dedup, near dedup, mixing and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as
Parquet to the cluster's shared folder and reads them again for the next one. All stages
but the last return the columns of documents, in their order; further columns pass through.

Nulls and odd texts are handled as the operators say: null and empty texts fail the quality rules; a
document without an id counts as the last one for lines and in near dedup; a null source is
a source of its own. Repeated rows stay repeated until near dedup, which keeps one of them. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import checkpoint, remove, shared
from framewright.llm.lines import drop_repeated_lines
from framewright.llm.mixing import mix_sources
from framewright.llm.near import PERCENT, near_duplicates
from framewright.llm.packing import pack_documents
from framewright.llm.quality import quality_rules


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the repetition rule reject go."""
    return quality_rules(docs).where("__kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document with a smaller doc_id has go; n_chars follows the text."""
    out = drop_repeated_lines(docs).withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest doc_id; documents
    without words stay. Rows are known by id and text, and of equal ones that stay there is one."""
    found = checkpoint(near_duplicates(docs, percent=PERCENT).where("n_shingles > 0").select("doc_id", "version", (F.col("component_id").eqNullSafe(F.col("doc_id")) & (F.col("component_version") == F.col("version"))).alias("first")), docs.count())
    times = found.groupBy("doc_id", "version", "first").agg(F.count(F.lit(1)).alias("n")).select(F.col("doc_id").alias("__id"), F.col("version").alias("__w"), "first", "n")
    own = docs.withColumn("__v", F.xxhash64("text"))
    same = docs["doc_id"].eqNullSafe(F.col("__id")) & (F.col("__v") == F.col("__w"))
    out = own.join(times.where("not first or n > 1"), same, "left_anti")
    again = own.join(times.where("first and n > 1"), same, "left_semi").dropDuplicates(["doc_id", "__v"])
    return out.unionAll(again).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mix_sources(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each document with their places in sequences."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("lines", lines), ("near", near), ("mix", mix), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's output is deleted when the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = shared(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)


#: Quality rules, near-duplicates and packing can't be stated in SQL; the tests hold run()
#: against a plain version instead.
ORACLE_SQL = None
