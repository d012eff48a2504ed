"""A training corpus from raw documents: language ID, near-duplicate removal, benchmark decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept;
all but the last return the columns of documents.  A null doc_id cannot be matched
across tables: such rows pass the second and third stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parlance.llm import decontamination, jaccard, language, mixing, token_files
from parlance.llm._spark import Workspace
from parlance.llm.queries import documents, id_remainder, tokenizer_path


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fits on labelled documents and drops what is in none of their languages."""
    model = language.fit(docs.where(id_remainder(4) != 2))
    return language.accepted(docs, model)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the smallest doc_id stays."""
    found = jaccard.near_duplicates(docs)
    others = found.where("doc_id <> component_id").select("doc_id")
    return docs.join(others, "doc_id", "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.contaminated(docs, benchmark).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(docs.columns)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each repetition that the mix takes."""
    return mixing.apply_mix(docs, mixing.mix(docs))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and what they say of each document."""
    return token_files.token_files(docs, str(tokenizer_path()))


STAGES = [
    ("language_id", keep_known_languages),
    ("jaccard_join", keep_one_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_to_targets),
    ("token_files", write_tokens),
]

#: SQL expresses neither the language models nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    work = Workspace(spark, "pipeline")
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs = work.table(stage(spark, docs, sf_dir), name)
        if before:
            work.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
