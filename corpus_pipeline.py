"""A corpus cleaning pipeline of five training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet into
the shared folder and reads again as the next stage's docs. All but the last keep the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilframe.llm import stages
from veilframe.llm.common import materialise, table

STAGES = [
    ("quality", stages.quality),
    ("line_dedup", stages.line_dedup),
    ("near_dedup", stages.near_dedup),
    ("decontamination", stages.decontamination),
    ("bpe", stages.bpe),
]

#: Trees, fingerprints and byte-pair merges are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, f"stage-{name}")
    return docs
