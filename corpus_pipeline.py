"""The corpus pipeline: documents in, packed training sequences out.

Every stage works on all rows its predecessor kept and returns them with all columns; the last one returns pieces of sequences. Rejected, doubled and
contaminated documents are found by the operators, and only their ids are joined against the documents.
"""

from labelspark.llm import contamination, exact, near, packing, quality
from labelspark.llm.shared import stored


def quality_classifier(spark, docs, sf_dir):
    """Documents whose quality score is under 0.3 go. Labels teach by the documents that are present."""
    return quality.drop_poor(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark, docs, sf_dir):
    """One document of each group of equal texts stays: the one with the largest id."""
    return exact.drop_exact(docs)


def near_dedup(spark, docs, sf_dir):
    """One document of each group linked by similar word shingles stays: the one with the smallest id."""
    return near.drop_near(docs)


def decontamination(spark, docs, sf_dir):
    """Documents that hold a benchmark question, also with other numbers or names, go."""
    return contamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark, docs, sf_dir):
    """Pieces of all remaining documents in sequences of 2048 ids."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: Fitted models, signatures and token ids are beyond SQL; tests/llm compares the stages of run() with plain versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
