"""A corpus pipeline: toxicity filter, near-duplicates, benchmark decontamination, source mix, token store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellumine.llm import stages
from vellumine.llm.common import table, written

#: (name, function of (spark, docs, sf_dir)); each works on all that the one before kept.
STAGES = [
    ("toxicity", stages.drop_toxic),
    ("near_duplicates", stages.drop_near_duplicates),
    ("decontamination", stages.drop_contaminated),
    ("source_mix", stages.mix_sources),
    ("token_store", stages.store_tokens),
]
#: SQL has neither the machine nor the components; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
