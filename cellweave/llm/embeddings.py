"""Embedding near-duplicates: random-hyperplane tables, exact cosines, connected components."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, cut, groups, read_table

THRESHOLD = 0.93
#: Chance that a pair just at the threshold shares a bucket of some table; nearer pairs have more.
RECALL = 0.997
#: Vectors of a bucket that meet in one task; a larger bucket is dealt out as pairs of such blocks.
BLOCK = 2048
SEED = 20

KEY = ["label", "dim", "bucket_table", "code", "a", "b"]


def shape(largest: int, threshold: float, recall: float) -> tuple[int, int]:
    """Bits of a table's code and number of tables, for so many vectors with one label.

    Bits grow with the logarithm of the vectors, so that a bucket of unlike vectors holds some 32 of
    them whatever their number; the tables then follow from the chance that a pair at the threshold
    agrees in all bits. Vectors are shuffled once a table, which costs more than those comparisons.
    """
    bits = min(40, max(8, math.ceil(math.log2(max(largest, 2))) - 5))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree)))


def unit_rows(column: pa.Array, dim: int) -> np.ndarray:
    """A list column as a matrix of unit vectors in double precision."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Tables:
    """Codes of unit vectors in each table, from the signs of products with random directions."""

    def __init__(self, bits: int, tables: int, seed: int = SEED) -> None:
        self.bits, self.tables, self.seed, self.planes = bits, tables, seed, {}

    def signs(self, x: np.ndarray) -> np.ndarray:
        """The signs of all tables, as packed bits."""
        dim = x.shape[1]
        if dim not in self.planes:
            self.planes[dim] = np.random.Generator(np.random.PCG64([self.seed, dim])).normal(size=(dim, self.tables * self.bits))
        return np.packbits(x @ self.planes[dim] > 0, axis=1)

    def codes(self, signs: np.ndarray, tables: int | None = None) -> np.ndarray:
        """Codes in the first tables, all by default."""
        tables = self.tables if tables is None else tables
        bits = np.unpackbits(signs, axis=1, count=tables * self.bits) if tables else np.zeros((len(signs), 0), np.uint8)
        return bits.reshape(len(signs), tables, self.bits) @ (1 << np.arange(self.bits, dtype=np.int64))


def links_in(x: np.ndarray, copies: np.ndarray, side: np.ndarray | None, earlier: Callable[[np.ndarray], np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For the vectors of one bucket: the linked vectors counted here, copies included, and a root of what these links connect.

    `earlier` gives the codes of some of them in the tables before this one: a pair that agrees in
    one of them is counted there. With `side`, only pairs between side 0 and side 1 count.
    """
    m = len(x)
    n, root = np.zeros(m, np.int64), np.arange(m)
    rows, columns = (np.arange(m), np.arange(m)) if side is None else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    for begin in range(0, len(rows), 256):
        own = rows[begin : begin + 256]
        i, j = np.nonzero(x[own] @ x[columns].T >= threshold)
        i, j = own[i], columns[j]
        if side is None:
            i, j = i[i < j], j[i < j]
        linked, at = np.unique(np.concatenate((i, j)), return_inverse=True)
        codes = earlier(linked)
        a, b = at[: len(i)], at[len(i) :]
        new = np.ones(len(i), bool)
        for t in range(codes.shape[1]):
            new &= codes[a, t] != codes[b, t]
        i, j = i[new], j[new]
        np.add.at(n, i, copies[j])
        np.add.at(n, j, copies[i])
        at = np.flatnonzero(np.diff(i, prepend=-1))
        for k, end in zip(at, np.append(at, len(i))[1:], strict=True):
            met = np.unique(root[np.append(j[k:end], i[k])])
            if len(met) > 1:
                root[np.isin(root, met)] = met[0]
    return n, root


def embedding_links(nodes: DataFrame, threshold: float, recall: float) -> DataFrame:
    """Rows (rep, hash, root, n) whose n add up to a node's linked vectors, and whose (rep, root) span the links.

    `nodes` has rep, hash (a node's key with rep), label, copies and vec. A pair is met in every
    table in which its codes agree and counted in the first. No pair leaves its task.
    """
    largest = nodes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = shape(largest, threshold, recall)
    maker = nodes.sparkSession.sparkContext.broadcast((bits, tables))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Tables(*maker.value)
        for batch in batches:
            dims = np.array([len(v) for v in batch.column(3)])
            for dim in np.unique(dims):
                some = batch.filter(pa.array(dims == dim))
                signs = made.signs(unit_rows(some.column(3), int(dim)))
                codes = made.codes(signs)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1, dtype=np.int32) * codes.shape[1]), pa.array(codes.ravel()))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), some.column(2), pa.array(np.full(len(codes), dim, np.int32)), lists, pa.array([s.tobytes() for s in signs], pa.binary())], ["rep", "hash", "label", "dim", "codes", "signs"])

    coded = cut(nodes.select("rep", "hash", "label", "vec").mapInArrow(code, "rep long, hash long, label long, dim int, codes array<bigint>, signs binary"))
    placed = coded.select("rep", "hash", "label", "dim", F.posexplode("codes").alias("bucket_table", "code"))
    full = placed.groupBy("label", "dim", "bucket_table", "code").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("m")).where("m > 1")
    own = F.pmod(F.xxhash64("rep", "hash", "bucket_table"), F.col("blocks")).cast("int")
    met = placed.join(full, ["label", "dim", "bucket_table", "code"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumn("a", F.least("own", "other")).withColumn("b", F.greatest("own", "other"))
    vectors = nodes.join(coded.select("rep", "hash", "signs"), ["rep", "hash"]).select(F.col("rep").alias("r"), F.col("hash").alias("h"), "copies", "vec", "signs")
    dealt = met.join(vectors, (F.col("rep") == F.col("r")) & (F.col("hash") == F.col("h"))).select(*KEY, "own", "rep", "hash", "copies", "vec", "signs")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Tables(*maker.value)
        for group in groups(batches, len(KEY)):
            _, dim, table, _, a, b = (group.column(k)[0].as_py() for k in range(len(KEY)))
            x = unit_rows(group.column("vec").chunk(0), dim)
            own, rep, hashes, copies = (group.column(name).to_numpy() for name in ("own", "rep", "hash", "copies"))
            signs = np.frombuffer(b"".join(group.column("signs").to_pylist()), np.uint8).reshape(len(x), -1)
            n, root = links_in(x, copies, None if a == b else (own == b).astype(int), lambda some, signs=signs, table=table: made.codes(signs[some], table), threshold)
            some = np.flatnonzero(n)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(hashes[some]), pa.array(rep[root[some]]), pa.array(n[some])], ["rep", "hash", "root", "n"])

    return dealt.repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(search, "rep long, hash long, root long, n long")


def embedding_components(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each row of `rows`.

    Two vectors are linked if their labels are equal and not null, their lengths are equal and
    their cosine is at least `threshold`. A vector that is null, empty or zero, or that holds a
    null or non-finite number, links with nothing. Labels may be of any type; others than whole
    numbers go by their XXH64. n_links counts the other rows linked directly,
    copies included; component_id is the smallest vec_id reachable. Rows with equal labels and
    vectors are one node of the search. Rows that share a vec_id are one member of a component. A
    row with a null vec_id links with nothing and has no component. Other columns play no part,
    whatever their names. An empty table gives an empty result.
    """
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    whole = rows.schema[label_col].dataType.typeName() in ("byte", "short", "integer", "long")
    label = F.col(label_col).cast("long") if whole else F.when(F.col(label_col).isNotNull(), F.xxhash64(label_col))
    usable = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & finite, F.lit(False))
    all_rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"), label.alias("label"))
    named = all_rows.withColumn("usable", usable).withColumn("h", F.xxhash64("label", "v"))
    nodes = cut(named.where("usable").groupBy("label", "v", "h").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).select("rep", F.col("h").alias("hash"), "label", "copies", F.col("v").alias("vec")))
    found = cut(embedding_links(nodes, threshold, recall))
    counts = found.groupBy("rep", "hash").agg(F.sum("n").alias("n"))
    sums = nodes.join(counts, ["rep", "hash"], "left").select("rep", F.col("label").alias("l"), F.col("hash").alias("k"), F.col("vec").alias("w"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links"))
    linked = named.join(sums, F.col("usable") & (F.col("label") == F.col("l")) & (F.col("h") == F.col("k")) & (F.col("v") == F.col("w")), "left")
    linked = linked.select("id", "rep", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))
    # A vec_id may stand for several vectors or be one of several copies; it connects what it stands for.
    edges = found.select(F.col("rep").alias("src"), F.col("root").alias("dst")).union(linked.where("id <> rep").select("id", "rep"))
    joined = connected_components(edges).withColumnRenamed("id", "member")
    out = linked.join(joined, F.col("id") == F.col("member"), "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias("vec_id"), "n_links", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(read_table(spark, sf_dir, "embeddings"))


OP3_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
links AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= {THRESHOLD}::DOUBLE),
reach(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT vec_id, (SELECT count(*) FROM links WHERE x = vec_id) AS n_links, c AS component_id, c = vec_id AS kept
FROM embeddings JOIN (SELECT x, min(y) AS c FROM reach GROUP BY 1) ON x = vec_id
"""
