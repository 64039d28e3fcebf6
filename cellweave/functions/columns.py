"""Column expressions that several operators use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Makes a median absolute deviation an estimate of a normal's standard deviation.
MAD_SCALE = 0.6744897501960817


def clip(x: Column, low: float, high: float) -> Column:
    """`x` held within bounds; nulls and NaNs stay what they are."""
    return F.when(F.isnan(x) | x.isNull(), x).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), x)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.when(b != 0, a / b)


def bin_of(x: Column, edges: list[float]) -> Column:
    """Number of edges below x: bins closed on the right, open-ended outside; equal edges are allowed."""
    return F.size(F.filter(F.array(*(F.lit(float(e)) for e in edges)), lambda e: e < x))


def log2_or_zero(x: Column) -> Column:
    return F.coalesce(F.when(x > 0, F.log2(x)), F.lit(0.0))


def peak_parts(name: Column) -> Column:
    """chrom, start and end of a name like chr1:100-200."""
    pattern = r"^(.*):(\d+)-(\d+)$"
    return F.struct(
        F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")).alias("chrom"),
        F.regexp_extract(name, pattern, 2).try_cast("int").alias("start"),
        F.regexp_extract(name, pattern, 3).try_cast("int").alias("end"),
    )


def peak_name(chrom: Column, start: Column, end: Column) -> Column:
    return F.format_string("%s:%d-%d", chrom, start, end)
