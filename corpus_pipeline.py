"""Training corpus from ``documents``: five stages, each written to Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from millwright.llm import decontaminate, linededup, minhash, packing, quality, simhash
from millwright.llm import queries
from millwright.llm.common import free_name
from millwright.session import new_folder, prepare


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampler draws stay; its target are documents labelled as good and not toxic."""
    return quality.sampled(queries.labelled_documents(spark, sf_dir, docs), queries.quality_mark(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go; texts and their lengths change, no document goes."""
    index = linededup.build_index(docs)
    name = free_name(docs, "lines")
    kept = linededup.drop_common_lines(docs, index, name=name)
    fresh = {"text": F.col(f"{name}.kept"), "n_chars": F.length(f"{name}.kept").cast("long")}
    return kept.select(*[fresh.get(c, F.col(c)).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays.

    Three differing bits stand for copies of a similarity near 0.99, and no radius that bands can search reaches 0.8. So
    groups are joined by pairs of similarity 0.8 or more on five-word shingles, which MinHash finds.
    """
    return simhash.keep_one(docs, also=minhash.near_duplicates(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words in a row of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every document, or of its pieces, in sequences of 512, 1,024 or 2,048 words."""
    return packing.pack(docs, packing.word_count("text"), {"doc_id": F.col("doc_id")})


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]

# No SQL: fingerprints, components and packing are iterative; tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage's rows are written to the shared folder first."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "corpus")
    for number, (_, stage) in enumerate(STAGES):
        out = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
