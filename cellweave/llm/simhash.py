"""SimHash near-duplicates by BK-trees over shards of fingerprints, and the pipeline's near copies by shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, cut, groups, read_table, small_batches
from .words import mixed, pieces, text_buffer, window_hashes, word_hashes

SHINGLE, SEED, RADIUS = 3, 42, 2
#: About so many fingerprints share a tree; shards of more than the second number are dealt out once more.
SHARD, LARGE_SHARD = 512, 4096
#: The pipeline's stage: words in a shingle, and the Jaccard similarity of near copies.
NEAR_SHINGLE, SIMILAR = 5, 0.8
#: Pairs at similarity 0.8 agree in one of 14 bands of 4 least hashes with chance 0.9994.
BANDS, BAND = 14, 4
#: Buckets of more sets, or of more bytes of them, are dealt out as squares of their parts.
LARGE_BUCKET, BUCKET_BYTES = 2048, 16 << 20
PERMUTATIONS = np.random.Generator(np.random.PCG64(5)).integers(1, 2**63, (BANDS * BAND, 2), np.uint64) * np.uint64(2) + np.uint64(1)
BAND_BASES = np.random.Generator(np.random.PCG64(6)).integers(1, 2**63, BAND, np.uint64) | np.uint64(1)
#: Byte values with A-Z as a-z.
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a text's 3-word shingles, as a signed number; 0 without words."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b"%b %b %b".__mod__, zip(words, words[1:], words[2:], strict=False))
    n = max(1, len(words) - SHINGLE + 1)
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


class BKTree:
    """Fingerprints in a tree whose edges carry the Hamming distance of child and parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []
        #: Fingerprints compared by all searches so far.
        self.visits = 0

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        if len(self.values) == 1:
            return
        at = 0
        while (to := self.children[at].get(d := (self.values[at] ^ value).bit_count())) is not None:
            at = to
        self.children[at][d] = len(self.values) - 1

    def within(self, value: int, radius: int) -> list[int]:
        """Positions of the fingerprints at most `radius` bits away."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            self.visits += 1
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            for edge, to in self.children[at].items():
                if d - radius <= edge <= d + radius:
                    todo.append(to)
        return found


def spanning_links(values: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """Pairs of positions that connect whatever links of at most `radius` bits connect."""
    tree, parent = BKTree(), list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i, value in enumerate(values):
        for j in tree.within(value, radius):
            if (a := root(i)) != (b := root(j)):
                parent[a] = b
                yield i, j
        tree.add(value)


def bits(x: Column, low: int, width: int) -> Column:
    """Bits low .. low + width - 1 of a long."""
    return F.shiftrightunsigned(x, low).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def without_bits(x: Column, low: int, width: int, of: int) -> Column:
    """A long of `of` bits with those at low .. low + width - 1 taken out."""
    above = F.shiftleft(bits(x, low + width, of - low - width), low) if low + width < of else F.lit(0).cast("long")
    return bits(x, 0, low).bitwiseOR(above) if low else above


def deal(shards: DataFrame, free: int, apart: int, width: int, radius: int) -> DataFrame:
    """Deal each fingerprint of each shard to one smaller shard for each of radius + 1 separate blocks of its free bits.

    Block k has `width` bits from k * apart on. At most `radius` changed bits leave a block alone,
    so every link within a shard lies within a smaller one. `rest` keeps the bits still free.
    """
    ways = [
        F.struct(F.xxhash64("shard", F.lit(k), bits(F.col("rest"), k * apart, width)).alias("shard"), without_bits(F.col("rest"), k * apart, width, free).alias("rest"))
        for k in range(radius + 1)
    ]
    return shards.select("fp", "node", F.explode(F.array(*ways)).alias("s")).select("fp", "node", "s.*")


def shards_of(prints: DataFrame, radius: int) -> DataFrame:
    """Rows (fp, node, shard) such that every link of at most `radius` bits lies in some shard, of LARGE_SHARD fingerprints at most.

    The first blocks have as many bits as make shards of about SHARD fingerprints. Shards that come
    out too large are dealt out again by whole blocks of their free bits, until they are small
    enough or so few bits are free that they cannot be large. Shards of one are left out.
    """
    free, apart = 64, 64 // (radius + 1)
    width = min(apart, max(0, math.ceil(math.log2(max(1, prints.count()) / SHARD))))
    shards = prints.select("fp", "node", F.lit(0).cast("long").alias("shard"), F.col("fp").alias("rest"))
    if width:
        shards, free = deal(shards, free, apart, width, radius), free - width
    done = []
    while True:
        sizes = shards.groupBy("shard").agg(F.count("*").alias("size")).where("size > 1")
        sized = cut(shards.join(sizes, "shard"))
        last = free < LARGE_SHARD.bit_length() or free <= radius
        done.append(sized if last else sized.where(F.col("size") <= LARGE_SHARD))
        if last or (sized.agg(F.max("size")).first()[0] or 0) <= LARGE_SHARD:
            return reduce(DataFrame.unionByName, done).select("fp", "node", "shard")
        apart = free // (radius + 1)
        shards, free = deal(sized.where(F.col("size") > LARGE_SHARD), free, apart, apart, radius), free - apart


def fingerprint_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Rows (src, dst) that span the links between the fingerprints of `prints` (fp, node).

    Each shard has its BK-tree, built and searched in the task that the shard is dealt to rather than
    broadcast, as the trees of a corpus have no size bound; a search follows only the edges within
    the radius. Any radius below 8 is possible.
    """
    if not 0 <= radius < 8:
        raise ValueError("the radius must be below 8 bits")
    shards = shards_of(prints, radius).groupBy("shard").agg(F.collect_list(F.struct("fp", "node")).alias("all"))
    shards = shards.select(F.col("all.fp").alias("fps"), F.col("all.node").alias("nodes"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, dst = [], []
            for fps, nodes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for i, j in spanning_links([x & (2**64 - 1) for x in fps], radius):
                    src.append(nodes[i])
                    dst.append(nodes[j])
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    return shards.select("fps", "nodes").mapInArrow(search, "src long, dst long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id), one for each row of `docs`.

    Fingerprints that differ in at most `radius` bits are linked; component_id is the smallest
    id reachable over links, the row's own included. A null or wordless text has fingerprint
    zero and is linked like any other. Equal fingerprints are one node of the links, so copies
    are not paired. Repeated rows each get a row; rows with a null id get their fingerprint and
    a null component, and link nothing. A long text is hashed whole. Other columns play no part,
    whatever their names. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    rows = cut(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(prints, "id long, fp long"))
    nodes = rows.where("id is not null").groupBy("fp").agg(F.min("id").alias("node"))
    joined = connected_components(fingerprint_links(nodes, radius).distinct())
    labels = nodes.join(joined, nodes.node == joined.id, "left").select("fp", F.coalesce("component", "node").alias("c"))
    return rows.join(labels, "fp", "left").select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("id").isNotNull(), F.col("c")).alias("component_id"),
    )


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Each text's distinct hashes of NEAR_SHINGLE words in lower case, sorted; a shorter text is one shingle of all its words."""
    body, offsets = text_buffer(texts)
    _, _, h, rows = word_hashes(LOWER[body], offsets)
    counts = np.diff(rows)
    many = np.where(counts >= NEAR_SHINGLE, counts - NEAR_SHINGLE + 1, np.minimum(counts, 1))
    row = np.repeat(np.arange(len(counts)), many)
    first = np.cumsum(many) - many
    at = np.arange(len(row)) - first[row] + rows[:-1][row]
    hashes = window_hashes(h, at, np.minimum(counts, NEAR_SHINGLE)[row])
    for a, n in zip(first, many, strict=True):
        yield np.unique(hashes[a : a + n])


def set_print(s: np.ndarray) -> int:
    """The SimHash of a set of shingle hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(s), 1 << 16):
        ones += np.unpackbits(mixed(s[i : i + (1 << 16)]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(s), bitorder="little").view(np.int64)[0])


def print_buckets(sets: DataFrame) -> DataFrame:
    """Buckets (node, n, band, key) of the sets with equal SimHash fingerprints, and of each two sets that links within RADIUS bits connect."""
    first = cut(sets.groupBy("fp").agg(F.count("*").alias("size"), F.min(F.struct("node", "n")).alias("first")))
    same = sets.join(first.where("size > 1"), "fp").select("node", "n", F.lit(-1).alias("band"), F.col("fp").alias("key"))
    nodes = first.select("fp", "first.*")
    linked = cut(fingerprint_links(nodes.select("fp", "node")).distinct())
    ends = linked.select(F.explode(F.array("src", "dst")).alias("node"), F.lit(-2).alias("band"), F.xxhash64("src", "dst").alias("key"))
    return same.union(ends.join(nodes, "node").select("node", "n", "band", "key"))


def similar_links(sets: list[np.ndarray], side: np.ndarray | None, similarity: float) -> Iterator[tuple[int, int]]:
    """Pairs of positions that connect whatever sets of at least the Jaccard similarity connect; with `side`, of sets of side 0 and of side 1.

    A set isn't compared with what it is already connected to.
    """
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    begins, root = ends - sizes, np.arange(len(sets))
    found, at = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(found), bool)
    for i in np.arange(len(sets)) if side is None else np.flatnonzero(side == 0):
        others = np.arange(i + 1, len(sets)) if side is None else np.flatnonzero(side == 1)
        a, b = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
        others = others[(root[others] != root[i]) & (a >= similarity * b)]
        if not len(others):
            continue
        mark[at[begins[i] : ends[i]]] = True
        if 4 * len(others) > len(sets):
            common = np.add.reduceat(mark[at], begins, dtype=np.int64)[others]
        else:
            common = np.array([np.count_nonzero(mark[at[begins[j] : ends[j]]]) for j in others])
        mark[at[begins[i] : ends[i]]] = False
        for j in others[common >= similarity * (sizes[others] + sizes[i] - common)]:
            if root[j] != root[i]:
                root[root == root[j]] = root[i]
                yield int(i), int(j)


def near_links(sets: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows (src, dst) that span the links between nodes whose shingle sets have Jaccard similarity SIMILAR or more.

    `sets` has node, n (shingles), fp and keys, `texts` has node and t. Sets meet in the buckets of
    the SimHash fingerprints; as these bring few pairs down to the similarity together, also in
    those of equal bands of BAND least hashes. Of buckets with the same members one is kept. All
    sets of a bucket are compared in the task it is dealt to, a large bucket in one task for each
    two parts of it; no pair leaves its task but those that span its links.
    """
    keyed = sets.where("n > 0").select("node", "n", F.posexplode("keys").alias("band", "key")).union(print_buckets(sets.where("n > 0")))
    who = lambda k: F.bit_xor(F.xxhash64("node", F.lit(k)))
    buckets = keyed.groupBy("band", "key").agg(F.count("*").alias("size"), F.sum("n").alias("total"), who(1).alias("x"), who(2).alias("y")).where("size > 1")
    buckets = buckets.groupBy("size", "x", "y").agg(F.min(F.struct("band", "key", "total")).alias("b")).select("size", "b.*")
    parts = F.ceil(F.greatest(F.col("size") / LARGE_BUCKET, F.col("total") * 8 / BUCKET_BYTES)).cast("int")
    dealt = keyed.select("node", "band", "key").join(buckets, ["band", "key"]).select("node", "band", "key", parts.alias("parts"))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = cut(dealt.select("node", "band", "key", "part", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q")))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in pieces(b, 1)):
            found = [x.tobytes() for x in shingle_sets(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["n_", "s"])

    whole = texts.join(dealt.select("node").distinct(), "node", "left_semi").select("node", "t").mapInArrow(hashed, "n_ long, s binary")
    key = ["band", "key", "p", "q"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, len(key)):
            nodes, part = group.column("node").to_numpy(), group.column("part").to_numpy()
            p, q = group.column("p")[0].as_py(), group.column("q")[0].as_py()
            found = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("s")]
            links = list(similar_links(found, None if p == q else (part == q).astype(int), SIMILAR))
            if links:
                i, j = np.array(links).T
                yield pa.RecordBatch.from_arrays([pa.array(nodes[i]), pa.array(nodes[j])], ["src", "dst"])

    met = dealt.join(whole, F.col("node") == F.col("n_")).select(*key, "node", "part", "s")
    return met.repartition(*key).sortWithinPartitions(*key).mapInArrow(compare, "src long, dst long")


def near_copies(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text_hash) of `docs` that are near copies of a document with a smaller doc_id, directly or over others.

    Two texts are near copies where their sets of five-word shingles in lower case have Jaccard
    similarity 0.8 or more; all texts without words are copies of each other. A set is one node,
    so copies are not paired. Rows with a null doc_id link nothing and are never among the result.
    """
    small_batches(docs.sparkSession)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in pieces(b, 2)):
            nodes, sizes, prints, keys = [], [], [], []
            for s in shingle_sets(batch.column(2)):
                nodes.append(int(mixed(s).sum(dtype=np.uint64).view(np.int64)))
                sizes.append(len(s))
                prints.append(set_print(s) if len(s) else 0)
                least = np.full(len(PERMUTATIONS), 2**64 - 1, np.uint64)
                for i in range(0, len(s), 4096):
                    np.minimum(least, ((s[i : i + 4096] ^ PERMUTATIONS[:, :1]) * PERMUTATIONS[:, 1:]).min(axis=1), out=least)
                keys.append(mixed((least.reshape(-1, BAND) * BAND_BASES).sum(axis=1, dtype=np.uint64)).view(np.int64))
            columns = [batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "h", "node", "n", "fp", "keys"])

    text = F.col("text").cast("string")
    named = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("t"))
    rows = cut(named.mapInArrow(sketch, "id long, h long, node long, n long, fp long, keys array<long>"))
    nodes = cut(rows.groupBy("node").agg(F.min(F.struct("id", "h")).alias("one"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    chosen = nodes.select("node", F.col("one.id").alias("id"), F.col("one.h").alias("h"))
    texts = named.join(chosen, ["id", "h"]).select("node", "t").dropDuplicates(["node"])
    joined = connected_components(cut(near_links(nodes.select("node", "n", "fp", "keys"), texts)))
    labels = nodes.join(joined, nodes.node == joined.id, "left").select("node", F.col("one.id").alias("least"), F.coalesce("component", "node").alias("c"))
    kept = labels.groupBy("c").agg(F.min("least").alias("kept"))
    placed = rows.select("id", "h", "node").join(labels.join(kept, "c").select("node", "kept"), "node")
    return placed.where("id <> kept").select(F.col("id").alias("doc_id"), F.col("h").alias("text_hash")).distinct()


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, most: int = 1_000_000) -> DataFrame:
    """Keep of each group of near copies the document with the smallest doc_id, and rows without a doc_id.

    Fingerprints find few of the copies at a similarity of 0.8, so most candidates come from bands
    of least hashes of the same shingles; see `near_copies`. A row goes by its id and its text, so another text under the same id stays; equal rows of the
    kept one stay with it. Up to `most` rows are broadcast, so that the texts need no shuffle; more
    are joined by a shuffle. Long texts are compared whole; all columns stay as they are, whatever
    their names. An empty table gives an empty result.
    """
    gone = cut(near_copies(docs).select(F.col("doc_id").alias("gone_id"), "text_hash"))
    side = F.broadcast(gone) if gone.count() <= most else gone
    return docs.join(side, (docs["doc_id"] == side["gone_id"]) & (F.xxhash64(docs["text"].cast("string")) == side["text_hash"]), "left_anti")


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read_table(spark, sf_dir, "documents"))
