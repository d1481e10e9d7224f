"""From raw documents to a training mix, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before it
kept. Its result is written as Parquet to the shared folder and read again, so a lost
executor costs a stage at most. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm.decontaminate import decontaminate_stage
from tracewell.llm.line_templates import line_stage
from tracewell.llm.mixing import mix_stage
from tracewell.llm.near_dups import near_dup_stage
from tracewell.llm.quality import quality_stage
from tracewell.scratch import cut_alone, drop

STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("near-duplicates", near_dup_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("mixing to target weights", mix_stage),
]

#: The first and fourth stage (a language model, edit distances) have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mix, with the number of words that it takes of each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before = docs
        docs = cut_alone(spark, lambda: stage(spark, before, sf_dir), "stage-" + name.replace(" ", "-"))  # noqa: B023
        drop(before)
    return docs
