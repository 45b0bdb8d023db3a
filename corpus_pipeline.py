"""Pipeline over ``documents``: quality rules, near duplicates, benchmark decontamination, secrets, ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm import op1_quality, op2_bpe, op3_secrets, op4_jaccard, op9_decontam
from tallyspark.llm.common import query, read_table, staged

STAGES = [
    ("quality_rules", op1_quality.stage),
    ("jaccard_join", op4_jaccard.stage),
    ("decontamination", op9_decontam.stage),
    ("secret_scans", op3_secrets.stage),
    ("bpe", op2_bpe.stage),
]

#: zstandard, BM25 and BPE have no SQL form; tests/llm holds the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each result staged in the shared folder."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


query("pipeline")(run)
