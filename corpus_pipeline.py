"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents:
what the rules reject goes, one document of each group of near-duplicates stays (five-word
shingles, similarity 0.8 or more), documents that hold a benchmark item go, and the mix
repeats or leaves documents to meet its sources' targets. The last writes the ids of all
that is left and reads the files back.

Defined cases, in every stage: a null or blank text goes with the rules, which find it too short;
if it came later it would be in no group, hold no item and have size 0. A null doc_id stands
for itself alone, a null source is a source. Rows equal in doc_id and text are judged alike;
of equal texts one row stays, ties going to the least doc_id and then to the least hash. Texts
of any length are taken whole. An empty table gives an empty result. Other columns pass
through all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioflow.llm import decontaminate, mixing, near_dedup, quality_rules, token_store
from folioflow.llm.common import remove_path, scratch_path, temporary


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that no rule rejects."""
    return quality_rules.kept_documents(docs)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, and all that are in none."""
    return near_dedup.first_of_each_group(docs, (80, 100))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no item of the benchmark, in full or nearly."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: never, once or twice."""
    return mixing.mixed_documents(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, read back from the files of ids."""
    return token_store.read_tokens(spark, token_store.write_tokens(docs))


STAGES = [
    ("quality rules", keep_by_rules),
    ("MinHash near-dedup", keep_one_of_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("mixing to target weights", mix_sources),
    ("token ids", write_token_ids),
]

#: Groups of near-duplicates and token ids aren't for SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over the whole table of documents. What a stage kept is
    written for the next one; its intermediate tables, and what it read, go then."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        path = scratch_path(spark, "stage")
        with temporary(spark):
            kept = stage(spark, docs, sf_dir)
            kept.write.option("compression", "zstd").parquet(path)
        if before:
            remove_path(spark, before)
        docs, before = spark.read.schema(kept.schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
