"""The corpus pipeline: language ID, one of each group of near copies, decontamination, mixing, token files.

Each stage takes all that its predecessor kept and returns the columns of documents; the last returns the token
files' digests. Stages are written as Parquet in the shared folder and read again in between."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from patternloom.llm import decontaminate, jaccard_join, language_id, mixing, token_files
from patternloom.llm.common import fresh, saved, workspace


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from all labelled rows; texts without letters and ambiguous texts go."""
    name = fresh("judged", docs.columns)
    judged = language_id.identify(docs, language_id.learn(docs), out_col=name)
    return judged.where(f"{name}.lang_pred <> 'und' and not {name}.ambiguous").select(*docs.columns)


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of any benchmark item go; one quoted item is a leak, clean documents hold none."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.contamination(docs, items, min_items=1, keep=docs.columns).where("not contaminated").select("kept.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document may come twice."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    manifest = token_files.write_tokens(docs, workspace(spark, "tokens"), token_files.vocabulary())
    return token_files.digests(token_files.read_tokens(spark, manifest))


STAGES = [
    ("language ID", known_language),
    ("n-gram Jaccard join", one_per_group),
    ("benchmark decontamination", without_benchmark),
    ("mixing", mixture),
    ("token files", tokens),
]

#: Classifiers, hash orders and tokenizers are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES[:-1]):
        docs = saved(stage(spark, docs, sf_dir), "stage", drop=(docs,) if n else ())
    return STAGES[-1][1](spark, docs, sf_dir)
