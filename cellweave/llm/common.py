"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions.lineage import cut, scratch_folder
from cellweave.operators.graph import connected_components

__all__ = ["connected_components", "cut", "groups", "read_table", "scratch_folder", "small_batches", "without_ids"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Lower the rows per Arrow batch, so that batches of long texts stay within a task's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def without_ids(docs: DataFrame, ids: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Rows of `docs` whose doc_id is not in the first column of `ids`; rows with a null doc_id stay.

    The ids are counted first. Up to `most` of them (8 bytes each) are broadcast, so that the
    texts need no shuffle; more are joined by a shuffle.
    """
    gone = cut(ids.select(F.col(ids.columns[0]).alias("gone_id")).where("gone_id is not null").distinct())
    side = F.broadcast(gone) if gone.count() <= most else gone
    return docs.join(side, docs["doc_id"] == side["gone_id"], "left_anti")


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of the rows with equal first `keys` columns, from batches sorted by these."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy() for k in range(keys)], axis=1).astype(np.int64)
        edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1), batch.num_rows]
        for begin, end in zip(edges, edges[1:], strict=False):
            if held and (begin > 0 or not np.array_equal(last, key[0])):
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(begin, end - begin))
            last = key[begin]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
