"""From raw documents to a training mixture: five operators, one after the other.

Every stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again as
the next stage's docs. Rows may have NULLs in any column, empty texts and repeated rows, as the operators define.

1. quality classifier: documents that the model of the graded ``labels`` rejects go
2. line dedup: lines that many documents share stay in one of them
3. near-dedup: one document of each group of near copies stays, by SimHash and then by five-word shingles (similarity 0.8)
4. benchmark decontamination: documents that hold a ``benchmark`` item go
5. mixing: documents are repeated at their source's rate; ``_copy`` numbers the copies
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.llm import decontaminate, lines, mixing, quality, resemblance, simhash
from fleetpulse.llm.common import packed, prepare, stored, table, unpacked


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what probably has good quality, toxic or not: grade 1 or more."""
    prepare(spark)
    return quality.select(docs, quality.train_on(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without common lines, ``n_chars`` counted anew; a document that loses all lines stays, empty."""
    prepare(spark)
    kept = lines.drop_lines(docs)
    n_chars = F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType)
    return unpacked(packed(kept, text=F.col("text"), n_chars=F.col("n_chars")), docs.columns, n_chars=n_chars)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: first by SimHash, as op3 does, then of those left by the shingles.

    Fingerprints link at 2 differing bits. Edited copies of a similarity of 0.8 differ in up to 21, and blocks for that have
    three bits and select nothing; so what SimHash leaves is compared by the shingles themselves.
    """
    prepare(spark)
    left = stored(simhash.drop_near_duplicates(docs), "pipeline-simhash")
    return resemblance.drop_similar(left)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return mixing.mix(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
]

# SQL can't fit the classifier; tests/llm/test_pipeline.py compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
