"""An optional data source for annotated HDF5 matrices; it needs h5py where tasks run."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from cellweave.model import CELLS, COUNTS, GENES

DATA, INDICES, INDPTR, GENE_NAMES, BARCODES = "/X/data", "/X/indices", "/X/indptr", "/var/_index", "/obs/_index"
BATCH = 50_000


def h5py():
    try:
        import h5py as module
    except ImportError as e:
        raise RuntimeError("reading h5ad files needs the package h5py; matrices in Parquet need nothing more (sources.files.read_matrix)") from e
    return module


def row_slice(indptr, start: int, end: int) -> tuple[int, int, list[int]]:
    """Where the entries of rows start..end stand, and the rows' pointers counted from there."""
    first, last = int(indptr[start]), int(indptr[end])
    return first, last, [int(p) - first for p in indptr[start : end + 1]]


class Rows(InputPartition):
    def __init__(self, start: int, end: int) -> None:
        self.start, self.end = start, end


class H5adReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.part = options["path"], options.get("table", "counts")
        self.batch, self.most = int(options.get("batch", BATCH)), options.get("max_cells")

    def partitions(self) -> list[Rows]:
        with h5py().File(self.path) as f:
            n = f[GENE_NAMES].shape[0] if self.part == "genes" else f[INDPTR].shape[0] - 1
        if self.most is not None and self.part != "genes":
            n = min(n, int(self.most))
        return [Rows(a, min(a + self.batch, n)) for a in range(0, n, self.batch)]

    def read(self, rows: Rows) -> Iterator[tuple]:
        with h5py().File(self.path) as f:
            if self.part != "counts":
                names = f[GENE_NAMES if self.part == "genes" else BARCODES][rows.start : rows.end]
                yield from ((rows.start + i, x.decode() if isinstance(x, bytes) else str(x)) for i, x in enumerate(names))
                return
            first, last, pointers = row_slice(f[INDPTR], rows.start, rows.end)
            genes, values = f[INDICES][first:last], f[DATA][first:last]
            for i, (a, b) in enumerate(zip(pointers, pointers[1:], strict=False)):
                for k in range(a, b):
                    yield rows.start + i, int(genes[k]), float(values[k])


class H5adSource(DataSource):
    """spark.dataSource.register(H5adSource); spark.read.format("h5ad").option("table", "counts" | "cells" | "genes").load(path)"""

    @classmethod
    def name(cls) -> str:
        return "h5ad"

    def schema(self) -> StructType:
        return {"counts": COUNTS, "cells": CELLS, "genes": GENES}[self.options.get("table", "counts")]

    def reader(self, schema: StructType) -> H5adReader:
        h5py()
        return H5adReader(self.options)
