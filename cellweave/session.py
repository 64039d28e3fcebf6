"""A headless session over a clustered data set: what a dashboard would show, as DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dashboard_frame(cells: DataFrame, positions: DataFrame, labels: DataFrame, markers: DataFrame) -> DataFrame:
    """(x, y, labels, each marker with <marker>_labels, point_index, barcode), a row a cell; labels are numbers, and each marker has a copy of them."""
    names = [c for c in markers.columns if c != "cell"]
    rows = cells.select("cell", "barcode").join(positions, "cell").join(labels, "cell").join(markers, "cell", "left")
    shown = [x for m in names for x in (F.coalesce(m, F.lit(0.0)).alias(m), F.col("community").cast("int").alias(f"{m}_labels"))]
    return rows.select("x", "y", F.col("community").cast("int").alias("labels"), *shown, F.col("cell").alias("point_index"), "barcode")


def scatter_series(frame: DataFrame, size: int = 4096) -> DataFrame:
    """(labels, part, n, x, y, point_index): a series for each label, its points in the order of point_index.

    A part of a series holds the points of `size` successive values of point_index, so that no row
    grows with the data.
    """
    points = F.sort_array(F.collect_list(F.struct("point_index", "x", "y")))
    part = F.floor(F.col("point_index") / size).alias("part")
    rows = frame.groupBy("labels", part).agg(F.count("*").alias("n"), points.alias("p"))
    return rows.select("labels", "part", "n", *(F.col("p")[c].alias(c) for c in ("x", "y", "point_index")))


def violin_counts(frame: DataFrame, marker: str) -> DataFrame:
    """(labels, value, n): how often each label has each value of a marker, to one decimal."""
    return frame.groupBy("labels", F.round(marker, 1).alias("value")).agg(F.count("*").alias("n"))


def toggle(selected: Iterable[int], clicked: Iterable[int]) -> list[int]:
    """Labels in exactly one of the two lists, in order: a click adds a label or takes it away."""
    return sorted(set(selected) ^ set(clicked))


def toggle_rows(selected: DataFrame, clicked: DataFrame) -> DataFrame:
    """`toggle` for labels in tables (labels)."""
    a, b = selected.select("labels").distinct(), clicked.select("labels").distinct()
    return a.exceptAll(b).unionAll(b.exceptAll(a))


def parse_labels(text: str | None) -> list[int]:
    """Numbers of a comma list such as a label box holds."""
    return [int(x) for x in (text or "").split(",") if x.strip()]


class Session:
    """The frame in view, the labels and points selected, and the callback that clusters a selection anew.

    The callback takes a frame of the selected cells and returns (point_index, x, y, labels).
    """

    def __init__(self, frame: DataFrame, recluster: Callable[[DataFrame], DataFrame]) -> None:
        self.base = self.frame = frame
        self.recluster = recluster
        self.selected_labels: list[int] = []
        self.selected_points: list[int] = []

    def click(self, label: int) -> list[int]:
        self.selected_labels = toggle(self.selected_labels, [label])
        return self.selected_labels

    def lasso(self, points: Iterable[int]) -> list[int]:
        """Select points; a lasso around fewer than two selects nothing."""
        points = sorted(set(points))
        self.selected_points = points if len(points) > 1 else []
        return self.selected_points

    def selection(self) -> DataFrame:
        if self.selected_points:
            points = self.frame.sparkSession.createDataFrame([(p,) for p in self.selected_points], "point_index long")
            return self.frame.join(points, "point_index", "left_semi").select(self.frame.columns)
        if self.selected_labels:
            return self.frame.where(F.col("labels").isin(self.selected_labels))
        return self.frame

    def rerun(self) -> DataFrame:
        """Cluster the selection anew; it becomes the frame in view, with new places and labels, the markers' copies of these included."""
        chosen = self.selection()
        found = self.recluster(chosen).select("point_index", "x", "y", "labels")
        copies = [c for c in self.base.columns if c.endswith("_labels") and c.removesuffix("_labels") in self.base.columns]
        rest = chosen.drop("x", "y", "labels", *copies).join(found, "point_index")
        self.frame = rest.withColumns({c: F.col("labels") for c in copies}).select(self.base.columns)
        self.selected_labels, self.selected_points = [], []
        return self.frame

    def export(self) -> DataFrame:
        return self.frame

    def reset(self) -> DataFrame:
        self.frame, self.selected_labels, self.selected_points = self.base, [], []
        return self.frame
