"""The corpus pipeline: quality filter, near-duplicate removal, masking of personal data, mixing, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from queuelens.llm import mixing, ngram_join, packing, pii, quality
from queuelens.llm.common import ensure_checkpoint_dir

STAGES = [
    ("quality classifier", quality.stage),
    ("n-gram Jaccard join", ngram_join.stage),
    ("PII", pii.stage),
    ("mixing sources to target weights", mixing.stage),
    ("best-fit packing", packing.stage),
]

#: A discriminant, a join of near sets, checksums and tokens: DuckDB SQL has no expression for them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written as Parquet into the checkpoint folder and read again."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        at = f"{folder}/{i}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
