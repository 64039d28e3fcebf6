"""Per-base coverage of clustered fragments: expansion, sweeps, tracks, tiles and peak calls."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def expand_fragments(fragments: DataFrame) -> DataFrame:
    """One row for each base of each fragment, with pos and pos_end = pos + 1; empty fragments have none."""
    pos = F.explode(F.sequence("start", F.col("end") - 1))
    return fragments.where("end > start").withColumn("pos", pos).withColumn("pos_end", F.col("pos") + 1)


def clipped(fragments: DataFrame, start: int, end: int) -> DataFrame:
    """Fragments cut to [start, end); those outside go, before anything is expanded."""
    cut = fragments.where((F.col("start") < end) & (F.col("end") > start) & (F.col("end") > F.col("start")))
    return cut.withColumns({"start": F.greatest("start", F.lit(start)), "end": F.least("end", F.lit(end))})


def coverage(fragments: DataFrame, start: int, end: int) -> DataFrame:
    """(cluster, pos, depth) where depth > 0, by expanding each fragment of `fragments` (start, end, cluster)."""
    return expand_fragments(clipped(fragments, start, end)).groupBy("cluster", "pos").agg(F.count("*").alias("depth"))


def coverage_runs(fragments: DataFrame, start: int, end: int) -> DataFrame:
    """(cluster, start, end, depth): maximal stretches of equal depth above 0.

    Each fragment adds two events, summed by position before they are put in order, so a
    cluster's sweep sees at most one row for each position of the region, however deep it is.
    """
    cut = clipped(fragments, start, end)
    events = cut.select("cluster", F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("step")), F.struct(F.col("end").alias("pos"), F.lit(-1).alias("step")))).alias("e"))
    steps = events.groupBy("cluster", "e.pos").agg(F.sum("e.step").alias("step")).where("step <> 0")
    order = Window.partitionBy("cluster").orderBy("pos")
    runs = steps.select("cluster", F.col("pos").alias("start"), F.lead("pos").over(order).alias("end"), F.sum("step").over(order).alias("depth"))
    return runs.where("depth > 0")


def coverage_sweep(fragments: DataFrame, start: int, end: int) -> DataFrame:
    """What `coverage` gives, from the runs: work follows the region's length, not the fragments' bases."""
    return coverage_runs(fragments, start, end).select("cluster", F.explode(F.sequence("start", F.col("end") - 1)).alias("pos"), "depth")


def dense_coverage(depths: DataFrame, clusters: DataFrame, start: int, end: int) -> DataFrame:
    """(cluster, pos, depth) for every cluster and position, zeros filled."""
    if end <= start:
        return depths.limit(0)
    grid = clusters.select("cluster").distinct().withColumn("pos", F.explode(F.sequence(F.lit(start), F.lit(end - 1))))
    return grid.join(depths, ["cluster", "pos"], "left").select("cluster", "pos", F.coalesce("depth", F.lit(0)).alias("depth"))


def tracks(dense: DataFrame) -> DataFrame:
    """(cluster, track): each cluster's depths as an array, in the order of positions."""
    rows = dense.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("pos", F.col("depth").cast("double").alias("d")))).alias("r"))
    return rows.select("cluster", F.transform("r", lambda x: x["d"]).alias("track"))


def tiles(track_rows: DataFrame, interval: int, pad: int = 0) -> DataFrame:
    """(cluster, tile, values): windows of interval + 2 pad values every `interval`; what is left at the end is dropped."""
    n = F.floor((F.size("track") - 2 * pad) / interval).cast("int")
    starts = F.explode(F.sequence(F.lit(0), n - 1))
    rows = track_rows.where(n > 0).select("cluster", "track", starts.alias("tile"))
    return rows.select("cluster", "tile", F.slice("track", F.col("tile") * interval + 1, F.lit(interval + 2 * pad)).alias("values"))


def untile(tile_rows: DataFrame, pad: int = 0, value: str = "values") -> DataFrame:
    """(cluster, track): the middles of the tiles, one after the other."""
    middle = F.slice(value, pad + 1, F.size(value) - 2 * pad)
    rows = tile_rows.select("cluster", "tile", middle.alias("m")).groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("tile", "m"))).alias("r"))
    return rows.select("cluster", F.flatten(F.transform("r", lambda x: x["m"])).alias("track"))


def keyed_tiles(dense: DataFrame, start: int, end: int, interval: int, pad: int = 0) -> DataFrame:
    """`tiles` of dense rows (cluster, pos, depth) without a cluster's whole track: each position is dealt to the tiles that hold it.

    A tile is a group of interval + 2 pad rows, its neighbours' edges copied; what is left at the end is dropped.
    """
    n, offset = (end - start - 2 * pad) // interval, F.col("pos") - start
    first = F.greatest(F.lit(0), F.floor((offset - (interval + 2 * pad)) / interval) + 1)
    last = F.least(F.lit(n - 1), F.floor(offset / interval))
    dealt = dense.where(offset.between(0, n * interval + 2 * pad - 1) & (first <= last)).select("cluster", F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("tile"), "pos", F.col("depth").cast("double").alias("d"))
    rows = dealt.groupBy("cluster", "tile").agg(F.sort_array(F.collect_list(F.struct("pos", "d"))).alias("r"))
    return rows.select("cluster", "tile", F.col("r.d").alias("values"))


def tile_positions(tile_rows: DataFrame, start: int, interval: int, pad: int, *values: str) -> DataFrame:
    """(cluster, pos, ...): the middles of tiles of several kinds of values, a row a position."""
    middle = F.arrays_zip(*(F.slice(v, pad + 1, interval).alias(v) for v in values))
    rows = tile_rows.select("cluster", "tile", F.posexplode(middle).alias("k", "z"))
    return rows.select("cluster", (F.col("tile") * interval + F.col("k") + (start + pad)).cast("int").alias("pos"), *(F.col("z")[v].alias(v) for v in values))


@dataclass(frozen=True)
class Layer:
    """A one-dimensional convolution: weights (outputs, inputs, width), a bias an output, dilated; with a residual and a cut at zero if wanted."""

    weights: np.ndarray
    bias: np.ndarray
    dilation: int = 1
    residual: bool = False
    positive: bool = True

    def __call__(self, x: np.ndarray) -> np.ndarray:
        width, out = self.weights.shape[2], np.zeros((len(x), len(self.bias), x.shape[2])) + self.bias[:, None]
        for k in range(width):
            shift = (k - width // 2) * self.dilation
            if abs(shift) < x.shape[2]:
                to, of = slice(max(0, -shift), x.shape[2] - max(0, shift)), slice(max(0, shift), x.shape[2] + min(0, shift))
                out[:, :, to] += np.einsum("oi,bil->bol", self.weights[:, :, k], x[:, :, of])
        out = np.maximum(out, 0) if self.positive else out
        return out + x if self.residual else out


LAYERS = "layer int, outputs int, inputs int, width int, dilation int, residual boolean, positive boolean, weights array<double>, bias array<double>"


def write_network(spark: SparkSession, layers: list[Layer], path: str) -> None:
    rows = [(k, *x.weights.shape, x.dilation, x.residual, x.positive, x.weights.ravel().tolist(), x.bias.tolist()) for k, x in enumerate(layers)]
    spark.createDataFrame(rows, LAYERS).coalesce(1).write.parquet(path)


def read_network(spark: SparkSession, path: str) -> list[Layer]:
    """A network's layers in order, from a table of LAYERS; its weights go to the driver and from there to the tasks."""
    rows = spark.read.schema(LAYERS).parquet(path).orderBy("layer").collect()
    return [Layer(np.array(r["weights"]).reshape(r["outputs"], r["inputs"], r["width"]), np.array(r["bias"]), r["dilation"], r["residual"], r["positive"]) for r in rows]


def network_model(layers: list[Layer]) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """A model of convolutions, whose last layer has two outputs: the signal, and what a peak's chance is the logistic function of."""

    def predict(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = values[:, None, :]
        for layer in layers:
            x = layer(x)
        return x[:, 0], 1 / (1 + np.exp(-np.clip(x[:, 1], -30, 30)))

    return predict


def identity_model(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The signal itself, and 1 where there is any."""
    return values, (values > 0).astype(float)


def moving_average_model(width: int = 51) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """A smoothing stand-in for a trained denoiser; peak chances follow the local excess over the tile's mean."""

    def predict(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kernel = np.ones(width) / width
        smooth = np.apply_along_axis(lambda row: np.convolve(row, kernel, mode="same"), 1, values)
        excess = smooth - values.mean(axis=1, keepdims=True)
        return smooth, 1 / (1 + np.exp(-np.clip(excess, -30, 30)))

    return predict


def denoise(tile_rows: DataFrame, predict: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(cluster, tile, signal, peak) from a model on batches of equally long tiles, each task with its own copy of it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                signal, peak = predict(np.stack(batch["values"].to_numpy()).astype(float))
                yield pd.DataFrame({"cluster": batch["cluster"], "tile": batch["tile"], "signal": list(signal), "peak": list(peak)})

    kind = tile_rows.schema["cluster"].dataType.simpleString()
    return tile_rows.select("cluster", "tile", "values").mapInPandas(run, f"cluster {kind}, tile int, signal array<double>, peak array<double>")


def call_peaks(track_rows: DataFrame, start: int, threshold: float = 0.5) -> DataFrame:
    """(cluster, pos) where a track of peak chances is above the threshold."""
    rows = track_rows.select("cluster", F.posexplode("track").alias("k", "chance"))
    return rows.where(F.col("chance") > threshold).select("cluster", (F.col("k") + start).alias("pos"), "chance")


def cluster_fragment_sums(fragment_counts: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster, fragments): fragments of each cluster's cells."""
    return clusters.select("cell", "cluster").join(fragment_counts, "cell").groupBy("cluster").agg(F.sum("fragments").alias("fragments"))


def closest_to(sums: DataFrame, target: int, k: int = 2) -> DataFrame:
    """The k clusters whose fragments are nearest to a target depth; ties by cluster."""
    return sums.withColumn("distance", F.abs(F.col("fragments") - target)).orderBy("distance", "cluster").limit(k)
