"""A Merkle manifest of a dataset: trees whose parents keep a copy of the hash state from before each child."""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions.ordered import row_numbers

from .common import cut, read_table

#: Children of a parent, levels that one task builds over a block, and the nodes below such a block.
FAN, LEVELS = 16, 3
BLOCK = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The way up from a block: the siblings left and right of it on each level, joined.
PATH = "tree string, block long, alone boolean, lefts array<string>, rights array<string>, subroot string, root string"
NODES = "tree string, ord long, digest string, alone string"


class Parent:
    """A run of digests, hashed once. Another digest in a slot costs what stands right of it only."""

    def __init__(self, children: Sequence[bytes]) -> None:
        self.children, self.states, state = children, [], sha256()
        for child in children:
            self.states.append(state.copy())
            state.update(child)
        self.digest = state.hexdigest().encode()

    def fold(self, slot: int, replacement: bytes) -> bytes:
        return resumed(self.states[slot], replacement, b"".join(self.children[slot + 1 :]))

    def siblings(self, slot: int) -> tuple[bytes, bytes]:
        return b"".join(self.children[:slot]), b"".join(self.children[slot + 1 :])


def resumed(state, replacement: bytes, right: bytes) -> bytes:
    """The digest that a kept state comes to with another child and the siblings right of it."""
    state = state.copy()
    state.update(replacement)
    state.update(right)
    return state.hexdigest().encode()


def levels(nodes: Sequence[bytes], alone: bool) -> list[list[Parent]]:
    """Parents over a block's nodes: LEVELS of them, or only until one node remains where no other block is."""
    found: list[list[Parent]] = []
    while len(nodes) > 1 if alone else len(found) < LEVELS:
        found.append([Parent(nodes[i : i + FAN]) for i in range(0, len(nodes), FAN)])
        nodes = [p.digest for p in found[-1]]
    return found


def digests(table: pa.Table, name: str) -> list[bytes]:
    return [x.encode() for x in table[name].to_pylist()]


def is_whole(key: tuple, table: pa.Table) -> bool:
    """Whether the group is all of its tree, and that one node: such a tree is built already."""
    return key[1].as_py() == 0 and table.num_rows == 1


def block_of(nodes: DataFrame):
    return nodes.groupBy("tree", F.floor(F.col("ord") / BLOCK).cast("long").alias("block"))


def rise(nodes: DataFrame) -> list[DataFrame]:
    """Tiers of nodes (tree, ord, digest, alone), each with a node for a block of the one below, until every tree has one.

    `digest` is a block's node if other blocks stand beside it, `alone` what it is without any.
    """

    def build(key: tuple, table: pa.Table) -> pa.Table:
        if is_whole(key, table):
            digest = alone = table["alone"][0].as_py()
        else:
            built = levels(digests(table.sort_by("ord"), "digest"), False)
            digest, alone = built[-1][0].digest.decode(), next(row[0].digest for row in built if len(row) == 1).decode()
        return pa.table([pa.array([x]) for x in (key[0].as_py(), key[1].as_py(), digest, alone)], ["tree", "ord", "digest", "alone"])

    tiers = [nodes]
    while tiers[-1].where("ord > 0").head(1):
        tiers.append(cut(block_of(tiers[-1]).applyInArrow(build, NODES)))
    return tiers


def ways(table: pa.Table) -> tuple[bool, list[str], list[str], str | None, str | None]:
    return tuple(table[c][0].as_py() for c in ("alone", "lefts", "rights", "subroot", "root"))


def descend(tiers: list[DataFrame], paths: DataFrame) -> DataFrame:
    """The paths of the blocks of the lowest of `tiers` that is left after their nodes' own, given the top's."""

    def step(key: tuple, table: pa.Table, above: pa.Table) -> pa.Table:
        table = table.sort_by("ord")
        alone, lefts, rights, subroot, root = ways(above)
        whole = is_whole(key, table)
        built = [] if whole else levels(digests(table, "digest"), alone)
        pairs = [[row[k // FAN ** (i + 1)].siblings(k // FAN**i % FAN) for i, row in enumerate(built)] for k in range(table.num_rows)]
        n = table.num_rows
        columns = [table["tree"], table["ord"], [whole] * n, [[a.decode() for a, _ in p] + lefts for p in pairs], [[b.decode() for _, b in p] + rights for p in pairs], [subroot] * n, [root] * n]
        types = [pa.string(), pa.int64(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.string()]
        return pa.table([c if isinstance(c, pa.ChunkedArray) else pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["tree", "block", "alone", "lefts", "rights", "subroot", "root"])

    for nodes in reversed(tiers):
        paths = cut(block_of(nodes).cogroup(paths.groupBy("tree", "block")).applyInArrow(step, PATH))
    return paths


def start(tops: DataFrame, lefts: Column, rights: Column, subroot: Column, root: Column) -> DataFrame:
    """The paths of trees' first blocks, each all of its tree."""
    return tops.select(F.col("tree").alias("tree"), F.lit(0).cast("long").alias("block"), F.lit(True).alias("alone"), lefts.alias("lefts"), rights.alias("rights"), subroot.alias("subroot"), root.alias("root"))


def leaf(row: Sequence[Column]) -> Column:
    """SHA-256 of the values, each as its UTF-8 byte count, a colon and the value, or `-` if null."""
    coded = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in row]
    return F.sha2(F.concat(*coded), 256)


def manifest(leaves: DataFrame, proofs: bool = False) -> DataFrame:
    """Rows (doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified), and proofs if wanted.

    `leaves` has doc_id, source, leaf and claim, digests as hex text. The leaves of each source, in
    the order of doc_id, are joined 16 by 16 until one is left, the subroot; the subroots, in the
    order of source, likewise give the root. folded_root is the root with the claim in the leaf's
    place (the leaf itself where it is null): each parent on the way resumes its kept state from
    before the child and takes in the other digest and the siblings right of it. `proofs` adds
    lefts and rights, the siblings on each level, of which proof_sha256 is the hash.

    A block of 4096 nodes, three levels, is built in one task, and again for the folding; its way
    to the root is one row. So a source of any size is many groups of bounded size, and a level
    holds no more than a sixteenth of the one below. A null source comes first and is not the
    empty one. Null ids come first; equal ids go by their leaves, and rows equal in both are
    leaves of their own with one result. An empty table gives an empty result. Other columns of
    `leaves` are not looked at.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))
    rows = cut(leaves.select("doc_id", "source", tree.alias("tree"), "leaf", "claim"))
    numbered = cut(row_numbers(rows, ["doc_id", "leaf"], "ord", within=("tree",)))
    tiers = rise(numbered.select("tree", "ord", F.col("leaf").alias("digest"), F.col("leaf").alias("alone")))
    tops = cut(row_numbers(tiers[-1].select("tree", F.col("alone").alias("subroot")), ["tree"], "ord"))
    over = rise(tops.select(F.lit("").alias("tree"), "ord", F.col("subroot").alias("digest"), F.col("subroot").alias("alone")))
    none = F.array().cast("array<string>")
    nothing = F.lit(None).cast("string")
    sources = descend(over[:-1], start(over[-1], none, none, nothing, F.col("alone")))
    placed = tops.join(sources.select("block", "lefts", "rights", "root"), F.col("ord") == F.col("block"))
    paths = descend(tiers[1:-1], start(placed, F.col("lefts"), F.col("rights"), F.col("subroot"), F.col("root")))

    def fold(key: tuple, table: pa.Table, above: pa.Table) -> pa.Table:
        table = table.sort_by("ord")
        alone, lefts, rights, subroot, root = ways(above)
        own = digests(table, "leaf")
        built = levels(own, alone)
        higher = [(sha256(a.encode()), b.encode()) for a, b in zip(lefts, rights, strict=True)]
        rest = "".join(a + b for a, b in zip(lefts, rights, strict=True)).encode()
        proof, folded, siblings = [], [], []
        for k, (plain, claim) in enumerate(zip(own, table["claim"].to_pylist(), strict=True)):
            digest, seen = claim.encode() if claim is not None else plain, []
            for i, row in enumerate(built):
                parent, slot = row[k // FAN ** (i + 1)], k // FAN**i % FAN
                seen.append(parent.siblings(slot))
                digest = parent.fold(slot, digest)
            for state, right in higher:
                digest = resumed(state, digest, right)
            folded.append(digest.decode())
            proof.append(sha256(b"".join(a + b for a, b in seen) + rest).hexdigest())
            if proofs:
                siblings.append(seen)
        n = table.num_rows
        columns = {c: table[c] for c in ("doc_id", "source", "leaf")} | {"subroot": [subroot] * n, "root": [root] * n, "proof_sha256": proof, "folded_root": folded, "verified": [x == root for x in folded]}
        if proofs:
            columns |= {"lefts": [[a.decode() for a, _ in s] + lefts for s in siblings], "rights": [[b.decode() for _, b in s] + rights for s in siblings]}
        return pa.table(columns)

    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = f"doc_id {kind['doc_id']}, source {kind['source']}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return block_of(numbered).cogroup(paths.groupBy("tree", "block")).applyInArrow(fold, schema + (", lefts array<string>, rights array<string>" if proofs else ""))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of documents; where 5 divides the CRC-32 of the id, the leaf of the text in lower case is claimed."""
    docs = read_table(spark, sf_dir, "documents")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    tampered = [F.translate("text", upper, upper.lower()) if c == "text" else F.col(c) for c in FIELDS]
    claim = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, leaf(tampered))
    return manifest(docs.select("doc_id", "source", leaf([F.col(c) for c in FIELDS]).alias("leaf"), claim.alias("claim"))).drop("source")


OP11_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, lang, n_chars, text,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS crc FROM documents),
e AS (
  SELECT doc_id, coalesce('=' || source, '-') AS tree, xor(crc, 4294967295) % 5 = 0 AS tampered,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail, coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') AS low FROM d),
leaves AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k FROM (
    SELECT doc_id, tree, sha256(head || tail) AS leaf, sha256(head || CASE WHEN tampered THEN low ELSE tail END) AS claim FROM e)),
up AS (
  SELECT tree, 0 AS level, k, leaf AS h FROM leaves
  UNION ALL
  SELECT tree, level + 1, k // 16, sha256(string_agg(h, '' ORDER BY k)) FROM (SELECT *, max(k) OVER (PARTITION BY tree) AS last FROM up) WHERE last > 0 GROUP BY tree, level, k // 16),
tops AS MATERIALIZED (SELECT tree, max(level) AS top, arg_max(h, level) AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place FROM up GROUP BY tree),
over_ AS (
  SELECT 0 AS level, place AS k, subroot AS h FROM tops
  UNION ALL
  SELECT level + 1, k // 16, sha256(string_agg(h, '' ORDER BY k)) FROM (SELECT *, max(k) OVER () AS last FROM over_) WHERE last > 0 GROUP BY level, k // 16),
nodes AS (SELECT * FROM up UNION ALL SELECT '' AS tree, level, k, h FROM over_),
near AS MATERIALIZED (
  SELECT tree, level, k, coalesce(string_agg(h, '') OVER (PARTITION BY tree, level, k // 16 ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(h, '') OVER (PARTITION BY tree, level, k // 16 ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM nodes),
fold(tree, row_, level, k, h, proof) AS (
  SELECT tree, k, 0, k, claim, '' FROM leaves
  UNION ALL
  SELECT f.tree, row_, f.level + 1, f.k // 16, sha256(l || h || r), proof || l || r FROM fold f JOIN near n ON n.tree = f.tree AND n.level = f.level AND n.k = f.k JOIN tops t ON t.tree = f.tree WHERE f.level < top),
final_(tree, row_, level, k, h, proof) AS (
  SELECT f.tree, row_, 0, place, h, proof FROM fold f JOIN tops t ON t.tree = f.tree AND f.level = top
  UNION ALL
  SELECT f.tree, row_, f.level + 1, f.k // 16, sha256(l || h || r), proof || l || r FROM final_ f JOIN near n ON n.tree = '' AND n.level = f.level AND n.k = f.k WHERE f.level < (SELECT max(level) FROM over_)),
root AS (SELECT arg_max(h, level) AS root FROM over_)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f.h AS folded_root, f.h = root AS verified
FROM leaves x JOIN tops t ON t.tree = x.tree JOIN final_ f ON f.tree = x.tree AND f.row_ = x.k AND f.level = (SELECT max(level) FROM over_), root
"""
