"""The corpus pipeline: five stages, each of which works on all that the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cellweave.functions.lineage import drop_folder
from cellweave.llm.common import read_table, scratch_folder
from cellweave.llm.decontaminate import decontaminate_stage
from cellweave.llm.language import language_stage
from cellweave.llm.mixing import mixing_stage
from cellweave.llm.simhash import simhash_stage
from cellweave.llm.substring import substring_stage

STAGES = [
    ("language ID", language_stage),
    ("SimHash near-dedup", simhash_stage),
    ("substring dedup", substring_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("mixing", mixing_stage),
]

#: Language ID, fingerprints and alignment have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written to the shared folder and read again.

    A stage's folder is deleted once the next one's is complete; the last stays for the reader.
    """
    folder = f"{scratch_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            drop_folder(spark, f"{folder}/{k - 1}")
    return docs
