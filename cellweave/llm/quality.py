"""A quality classifier: logistic regression over hashed word n-grams, learnt with FTRL updates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, small_batches
from .words import pieces, text_buffer, window_hashes, window_starts, word_hashes

#: Buckets of word n-grams (2**18 weights, 2 MB as doubles, are broadcast).
BITS = 18
#: The model is fitted on at most so many labelled rows, those with the smallest hashes.
SAMPLE = 40_000
REPLICAS, EPOCHS = 8, 6
ALPHA, BETA, L1, L2 = 1.0, 1.0, 1e-3, 1e-4
#: Features are shares of a text's n-grams times this.
SCALE = 16.0
THRESHOLD = 0.3

SAME_AGAIN = np.uint64(0x5A3E0A9A1B5C7D21)
#: Letters, digits and all bytes above ASCII make words of one kind, other signs of another.
KINDS = np.full(256, 2, np.uint8)
KINDS[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", *range(128, 256)]] = 1
KINDS[[0x20, *range(0x09, 0x0E)]] = 0


def ngram_buckets(batch_text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and word pairs of a string column, and the row of each.

    Pairs of a word and the same word again share one bucket, whatever the word.
    """
    body, offsets = text_buffer(batch_text)
    _, _, h, rows = word_hashes(body, offsets, KINDS)
    starts, pair_row = window_starts(rows, 2)
    pairs = np.where(h[starts] == h[starts + 1], SAME_AGAIN, window_hashes(h, starts, 2))
    hashes = np.concatenate((h, pairs))
    return (hashes >> np.uint64(64 - BITS)).astype(np.int32), np.concatenate((np.repeat(np.arange(len(rows) - 1), np.diff(rows)), pair_row))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Weights (the last is the bias) and the times each was updated, after FTRL-proximal steps over (buckets, values, label)."""
    size = (1 << BITS) + 1
    z, n, times = np.zeros(size), np.zeros(size), np.zeros(size, np.int64)

    def weights(i):
        zi = z[i]
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        return np.where(np.abs(zi) <= L1, 0.0, w)

    for _ in range(epochs):
        for buckets, values, label in rows:
            i, x = np.append(buckets, size - 1), np.append(values, 1.0)
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
            times[i] += 1
    return weights(np.arange(size)), times


def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (replica, rank, label, text) rows: replica, rank, label, buckets, values."""
    for batch in batches:
        for part in pieces(batch, 3):
            bucket, row = ngram_buckets(part.column(3))
            order = np.argsort(row, kind="stable")
            at = np.searchsorted(row[order], np.arange(part.num_rows + 1))
            buckets, values = [], []
            for i in range(part.num_rows):
                b, count = np.unique(bucket[order[at[i] : at[i + 1]]], return_counts=True)
                buckets.append(b)
                values.append(count * (SCALE / max(1, count.sum())))
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(3)), pa.array(buckets, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))], ["replica", "rank", "label", "buckets", "values"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights of the classifier, from `labels` (doc_id, label 0 or 1) on `docs` (doc_id, text).

    At most `sample` labelled rows are used. They are dealt to REPLICAS tasks, each of which makes
    EPOCHS passes of FTRL steps in the order of a hash; a bucket's weight is the mean over the
    replicas that met it. The sample and the weights are bounded whatever the tables hold.
    Without labelled rows all weights are zero.
    """
    rank = F.xxhash64(F.lit("sample"), "doc_id")
    chosen = labels.where("label in (0, 1) and doc_id is not null").select("doc_id", "label", rank.alias("rank")).orderBy("rank", "label").limit(sample)
    rows = docs.join(F.broadcast(chosen), "doc_id").select(F.pmod("rank", F.lit(REPLICAS)).cast("int").alias("replica"), "rank", F.col("label").cast("int"), "text")
    made = rows.mapInArrow(features, "replica int, rank long, label int, buckets array<int>, values array<double>")

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["rank", "label"])
        w, times = ftrl(list(zip(group["buckets"], group["values"], group["label"], strict=True)))
        met = np.flatnonzero(times)
        return pd.DataFrame({"bucket": met.astype(np.int32), "weight": w[met]})

    learnt = made.groupBy("replica").applyInPandas(learn, "bucket int, weight double").groupBy("bucket").agg(F.avg("weight").alias("weight")).toPandas()
    out = np.zeros((1 << BITS) + 1)
    out[learnt["bucket"].to_numpy()] = learnt["weight"].to_numpy()
    return out


def quality_scores(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, score), one for each row of `docs`: the probability that a whole text has label 1.

    A null text counts as empty; an empty text has the score of the bias alone. Repeated rows and
    null ids are kept; an empty table gives an empty result. Only the text enters a score.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in (p for b in batches for p in pieces(b, 1)):
            bucket, row = ngram_buckets(batch.column(1))
            n = np.bincount(row, minlength=batch.num_rows)
            dot = np.bincount(row, weights=w[bucket], minlength=batch.num_rows) * SCALE / np.maximum(n, 1) + w[-1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(dot, -35, 35))))], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(score, "doc_id long, score double")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the rows whose crc32(doc_id as text) mod 5 is not 0, and scores all."""
    small_batches(spark)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    labels = read_table(spark, sf_dir, "labels").where(~held_out).select("doc_id", F.col("quality").alias("label"))
    scored = quality_scores(docs, fit(docs, labels))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
