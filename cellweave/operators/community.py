"""Louvain and Leiden communities: blocks of nodes are moved in tasks, and their labels meet between the turns."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.functions.lineage import Turns, stored
from cellweave.functions.ordered import row_numbers
from cellweave.operators.graph import connected_components


def both_ways(edges: DataFrame) -> DataFrame:
    """Undirected edges (src, dst, weight), given once each, in both directions; a loop counts twice, as it does in a degree."""
    return edges.select("src", "dst", "weight").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> float:
    """Modularity of `labels` (id, c): weight within communities against what degrees alone would give."""
    arcs = both_ways(edges)
    total = arcs.agg(F.sum("weight")).first()[0]
    if not total:
        return 0.0
    a, b = labels.select(F.col("id").alias("src"), F.col("c").alias("cs")), labels.select(F.col("id").alias("dst"), F.col("c").alias("cd"))
    placed = arcs.join(a, "src").join(b, "dst")
    rows = placed.groupBy("cs").agg(F.sum(F.when(F.col("cs") == F.col("cd"), F.col("weight")).otherwise(0.0)).alias("inside"), F.sum("weight").alias("degree"))
    return rows.agg(F.sum(F.col("inside") / total - resolution * F.pow(F.col("degree") / total, 2))).first()[0]


#: Nodes, about, whose moves are worked out in one task.
BLOCK = 1 << 17
#: Arcs of a level that one task takes to the end, if it has no more than BLOCK nodes; some 150 bytes an arc.
ARCS = 1 << 22
#: Most nodes and arcs of a level that one task moves by sweeps, in arrays; some 60 bytes an arc.
SWEPT, SWEPT_ARCS = 1 << 20, 1 << 24
#: Shares of the nodes that a sweep moves one after the other.
SHARES = 64
ROWS = "block long, kind int, a long, b long, c long, p double, q double"
NODE, ARC = 0, 1


class Block:
    """Some of a graph's nodes with their communities, and their arcs to these and to nodes elsewhere."""

    def __init__(self, table: pa.Table) -> None:
        kind = table["kind"].to_numpy()
        column = lambda k, c: table[c].to_numpy()[kind == k]
        order = np.argsort(column(NODE, "a"))
        self.ids, self.of, self.k, self.whole = (column(NODE, c)[order] for c in "abpq")
        src, dst = column(ARC, "a"), column(ARC, "b")
        by = np.lexsort((dst, src))
        by = by[src[by] != dst[by]]
        there = np.minimum(np.searchsorted(self.ids, dst[by]), len(self.ids) - 1)
        self.own = np.where(self.ids[there] == dst[by], there, -1).tolist()
        self.begin = np.searchsorted(src[by], self.ids, "left").tolist()
        self.end = np.searchsorted(src[by], self.ids, "right").tolist()
        self.there, self.weight = column(ARC, "c")[by].tolist(), column(ARC, "p")[by].tolist()
        self.sizes = dict(zip(self.there, column(ARC, "q")[by].tolist(), strict=True)) | dict(zip(self.of.tolist(), self.whole.tolist(), strict=True))

    def near(self, i: int, of: list[int]) -> dict[int, float]:
        """Weight of a node's arcs by the community of their other ends."""
        found: dict[int, float] = {}
        part = slice(self.begin[i], self.end[i])
        for j, there, weight in zip(self.own[part], self.there[part], self.weight[part], strict=True):
            c = of[j] if j >= 0 else there
            found[c] = found.get(c, 0.0) + weight
        return found


def best_moves(block: Block, total: float, resolution: float) -> list[int]:
    """The nodes' communities after each has moved to the neighbouring one of most gain, until none gains; a node is looked at again when a neighbour moves."""
    of, k, sizes = block.of.tolist(), block.k.tolist(), block.sizes
    queue, waits, moved = deque(range(len(of))), [True] * len(of), False
    while queue or moved:
        if not queue:
            # Sizes have changed for nodes elsewhere too: all are looked at once more.
            queue, waits, moved = deque(range(len(of))), [True] * len(of), False
        i = queue.popleft()
        waits[i] = False
        near, own = block.near(i, of), of[i]
        share = resolution * k[i] / total
        best, most = own, near.pop(own, 0.0) - share * (sizes[own] - k[i]) + 1e-9
        for c, weight in near.items():
            gain = weight - share * sizes[c]
            # Ties go to the smaller community.
            if gain > most or gain == most and best != own and c < best:
                best, most = c, gain
        if best != own:
            sizes[own] -= k[i]
            sizes[best] += k[i]
            of[i], moved = best, True
            for j in block.own[block.begin[i] : block.end[i]]:
                if j >= 0 and not waits[j] and of[j] != best:
                    waits[j] = True
                    queue.append(j)
    return of


def block_rows(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """`nodes` (id, block, c, k, size) and the `arcs` from them (src, dst, weight, c, size) as rows of ROWS."""
    mine = nodes.select(F.col("id").alias("src"), "block")
    return nodes.select("block", F.lit(NODE).alias("kind"), F.col("id").alias("a"), F.col("c").alias("b"), F.lit(0).cast("long").alias("c"), F.col("k").alias("p"), F.col("size").alias("q")).union(
        arcs.join(mine, "src").select("block", F.lit(ARC).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "c", F.col("weight").alias("p"), F.col("size").alias("q"))
    )


def quality(arcs: DataFrame, state: DataFrame, total: float, resolution: float) -> float:
    """Modularity of a state (id, c, k)."""
    a, b = state.select(F.col("id").alias("src"), F.col("c").alias("cs")), state.select(F.col("id").alias("dst"), F.col("c").alias("cd"))
    inside = arcs.join(a, "src").join(b, "dst").where("cs = cd").agg(F.sum("weight")).first()[0] or 0.0
    squares = state.groupBy("c").agg(F.sum("k").alias("s")).agg(F.sum(F.col("s") * F.col("s"))).first()[0] or 0.0
    return inside / total - resolution * squares / total**2


def move_nodes(arcs: DataFrame, start: DataFrame, total: float, resolution: float, tolerance: float) -> DataFrame:
    """(id, c, k) after turns in which nodes move to the neighbouring community of most gain.

    `start` has id, c and degree k. A turn deals the nodes to blocks, communities together where
    they fit, and moves each block's in a task, which knows the other blocks' communities as they
    were. With several blocks only the half of the nodes that a hash picks may move, and in the
    next turn the other half, so that two blocks do not swap nodes for ever; a node that has been
    looked at is so again when a neighbour has moved. It ends when no node is left to look at, or
    when modularity grows by less than `tolerance` in a pair of turns; the result is the best there
    was.
    """
    turns, tables, fronts = Turns(), Turns(), Turns()
    now = turns.store(start.select("id", "c", "k"))
    arcs = arcs.where("src <> dst")
    best_yet, top, turn, active, waiting = now, None, 0, fronts.store(now.select("id")), now.count()
    whole = waiting <= BLOCK
    while waiting:
        blocks = -(-waiting // BLOCK)
        picked = F.pmod(F.xxhash64("id", F.lit(turn // 2)), F.lit(2)) == turn % 2 if blocks > 1 else F.lit(True)
        sizes = now.groupBy("c").agg(F.sum("k").alias("size"), F.count("*").alias("n"))
        part = F.when(F.col("n") > BLOCK, F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / BLOCK))).otherwise(0)
        nodes = now.join(active.where(picked), "id", "left_semi").join(sizes, "c").withColumn("block", F.pmod(F.xxhash64("c", part), F.lit(blocks)))
        far = arcs.join(now.join(sizes, "c").select(F.col("id").alias("dst"), "c", "size"), "dst")

        def move(key: tuple, table: pa.Table) -> pa.Table:
            block = Block(table)
            return pa.table({"id": block.ids, "to": best_moves(block, total, resolution)})

        moved = block_rows(nodes, far).groupBy("block").applyInArrow(move, "id long, to long")
        to = F.coalesce("to", "c")
        after = tables.store(now.join(moved, "id", "left").select("id", to.alias("c"), "k", (to != F.col("c")).alias("moved")))
        now = turns.store(after.select("id", "c", "k"))
        if whole:
            return now
        changed = after.where("moved").select(F.col("id").alias("src"))
        active = fronts.store(arcs.join(changed, "src", "left_semi").select(F.col("dst").alias("id")).union(active.where(~picked)).distinct())
        waiting, turn = active.count(), turn + 1
        if turn % 2 == 0 or not waiting:
            reached = quality(arcs, now, total, resolution)
            if top is not None and reached < top + tolerance:
                return now if reached >= top else best_yet
            best_yet, top = stored(now), reached
    return now


def swept(ids: np.ndarray, of: np.ndarray, k: np.ndarray, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, total: float, resolution: float, tolerance: float) -> np.ndarray:
    """The nodes' communities after sweeps in which nodes move to the neighbouring one of most gain.

    `src` and `dst` are places in `ids`, sorted by src, without loops. A sweep deals the nodes anew
    to SHARES; those of a share that are to be looked at move at once, so that few neighbours do. A
    node is looked at again when a neighbour has moved, and all are when none is left. It ends when
    modularity grows by less than `tolerance` in each of two sweeps; the result is the best there was.
    """
    names, of = np.unique(of, return_inverse=True)
    size, begin = np.bincount(of, k, len(names)), np.searchsorted(src, np.arange(len(ids) + 1))
    waits, r, top, best_yet, still = np.ones(len(ids), bool), np.random.default_rng(len(ids)), -np.inf, of, 0
    arcs_of = lambda nodes: np.repeat(begin[nodes] - np.cumsum(begin[nodes + 1] - begin[nodes]) + (begin[nodes + 1] - begin[nodes]), begin[nodes + 1] - begin[nodes]) + np.arange((begin[nodes + 1] - begin[nodes]).sum())
    while True:
        share = r.integers(0, SHARES, len(ids))
        for s in range(SHARES):
            nodes = np.flatnonzero(waits & (share == s))
            waits[nodes] = False
            nodes = nodes[begin[nodes + 1] > begin[nodes]]
            if not len(nodes):
                continue
            arcs = arcs_of(nodes)
            key = src[arcs].astype(np.int64) * len(names) + of[dst[arcs]]
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            # Pairs of a node and a neighbouring community, ties to the smaller community.
            node, there = np.divmod(key[first], len(names))
            cost = resolution * k[node] / total
            gain = np.add.reduceat(weight[arcs[order]], first) - cost * (size[there] - np.where(there == of[node], k[node], 0.0))
            begins = np.flatnonzero(np.diff(node, prepend=-1))
            most = np.maximum.reduceat(gain, begins)
            at = np.flatnonzero(gain == np.repeat(most, np.diff(begins, append=len(node))))
            to = there[at[np.searchsorted(node[at], nodes)]]
            stay = -resolution * k[nodes] / total * (size[of[nodes]] - k[nodes])
            own = there == of[node]
            stay[np.searchsorted(nodes, node[own])] = gain[own]
            moves = most > stay + 1e-9
            nodes, to = nodes[moves], to[moves]
            size += np.bincount(to, k[nodes], len(names)) - np.bincount(of[nodes], k[nodes], len(names))
            of[nodes] = to
            waits[dst[arcs_of(nodes)]] = True
        reached = weight[of[src] == of[dst]].sum() / total - resolution * (size @ size) / total**2
        still = still + 1 if reached < top + tolerance else 0
        if reached > top:
            top, best_yet = reached, of.copy()
        if still == 2:
            return names[best_yet]
        if not waits.any():
            # Sizes have changed for nodes elsewhere too: all are looked at once more.
            waits[:] = True


def sweep_nodes(arcs: DataFrame, start: DataFrame, total: float, resolution: float, tolerance: float) -> DataFrame:
    """As `move_nodes`, in one task that has room for the level's arrays."""
    every = start.select(F.lit(NODE).alias("kind"), F.col("id").alias("a"), F.col("c").alias("b"), F.col("k").alias("p")).union(arcs.where("src <> dst").select(F.lit(ARC), "src", "dst", "weight"))

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[pa.RecordBatch]] = {NODE: [], ARC: []}
        for batch in batches:
            for kind, held in parts.items():
                some = batch.filter(pc.equal(batch.column("kind"), kind))
                if some.num_rows:
                    held.append(some.drop_columns("kind"))
        if not parts[NODE]:
            return
        taken = lambda kind: (np.concatenate([b.column(c).to_numpy() for b in parts[kind]]) if parts[kind] else np.empty(0, t) for c, t in (("a", np.int64), ("b", np.int64), ("p", float)))
        ids, of, k = taken(NODE)
        order = np.argsort(ids)
        ids, of, k = ids[order], of[order], k[order]
        src, dst, weight = taken(ARC)
        parts.clear()
        src, dst = (np.searchsorted(ids, x).astype(np.int32) for x in (src, dst))
        order = np.argsort(src, kind="stable")
        to = swept(ids, of, k, src[order], dst[order], weight[order], total, resolution, tolerance)
        yield from pa.table({"id": ids, "c": to, "k": k}).to_batches(1 << 16)

    return stored(every.coalesce(1).mapInArrow(move, "id long, c long, k double"))


def well_merged(block: Block, inside: np.ndarray, whole: np.ndarray, total: float, resolution: float, seed: int, randomness: float = 0.01) -> list[int]:
    """Parts of the nodes' communities: nodes that are well connected to their community join, one by one, a part that is so too.

    `inside` is the weight between a node and its community's others, `whole` that community's
    degree. Parts that gain are drawn by their gain's exponential; only nodes still alone move.
    """
    of, k = list(range(len(block.ids))), block.k
    size, cut, alone = k.copy(), inside.copy(), np.ones(len(of), bool)
    r = np.random.default_rng([seed, int(block.ids[0]) & 0xFFFFFFFF])
    well = lambda p, home: cut[p] >= resolution * size[p] * (home - size[p]) / total
    for i in r.permutation(len(of)).tolist():
        if not alone[i] or not well(i, whole[i]):
            continue
        near: dict[int, float] = {}
        for e in range(block.begin[i], block.end[i]):
            j = block.own[e]
            if j >= 0 and j != i and block.of[j] == block.of[i]:
                near[of[j]] = near.get(of[j], 0.0) + block.weight[e]
        parts = [p for p in sorted(near) if well(p, whole[i]) and near[p] - resolution * k[i] * size[p] / total > 0]
        if parts:
            gain = np.array([near[p] - resolution * k[i] * size[p] / total for p in parts]) / (randomness * max(1e-12, float(k[i])))
            chance = np.exp(gain - gain.max())
            p = parts[int(r.choice(len(parts), p=chance / chance.sum()))]
            alone[i] = alone[p] = False
            of[i] = p
            cut[p] += cut[i] - 2 * near[p]
            size[p] += k[i]
    return of


def refine(arcs: DataFrame, moved: DataFrame, total: float, resolution: float, seed: int) -> DataFrame:
    """(id, c, home): parts of each community of `moved` (id, c, k), its home, each part well connected and found in one task.

    A community above BLOCK nodes is dealt to several tasks; parts form within each of them.
    """
    sizes = moved.groupBy("c").agg(F.sum("k").alias("size"), F.count("*").alias("n"))
    part = F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)))
    blocks = max(1, -(-moved.count() // BLOCK))
    nodes = stored(moved.join(sizes, "c").withColumn("block", F.pmod(F.xxhash64("c", part), F.lit(blocks))))
    homes = nodes.select(F.col("id").alias("dst"), F.col("c").alias("there"))
    own = nodes.select(F.col("id").alias("src"), F.col("c").alias("here"))
    far = arcs.where("src <> dst").join(homes, "dst").join(own, "src").where("here = there").select("src", "dst", "weight", F.col("there").alias("c"), F.lit(0.0).alias("size"))

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        block = Block(table)
        inside = np.array([sum(block.weight[b:e]) for b, e in zip(block.begin, block.end, strict=True)])
        of = well_merged(block, inside, block.whole, total, resolution, seed)
        return pa.table({"id": block.ids, "c": block.ids[np.array(of)], "home": block.of})

    return block_rows(nodes, far).groupBy("block").applyInArrow(merge, "id long, c long, home long")


def least_in(groups: np.ndarray, names: np.ndarray) -> np.ndarray:
    """For each place the least name of its group."""
    _, at = np.unique(groups, return_inverse=True)
    least = np.full(at.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, at, names)
    return least[at]


def finished(table: pa.Table, total: float, resolution: float, refined: bool, level: int) -> pa.Table:
    """(id, c): communities of a whole level's nodes after this level and all that follow it.

    `table` has the level's nodes and arcs as rows of ROWS, loops too. The same steps as in
    `communities`, for which one task has room by now.
    """
    kind = table["kind"].to_numpy()
    nodes, arcs = table.filter(pa.array(kind == NODE)).sort_by("a"), table.filter(pa.array(kind == ARC))
    first = ids = nodes["a"].to_numpy()
    of, member = nodes["b"].to_numpy(), np.arange(len(ids))
    src, dst = (np.searchsorted(ids, arcs[c].to_numpy()) for c in "ab")
    weight = arcs["p"].to_numpy()
    while True:
        k = np.bincount(src, weight, len(ids))
        _, at = np.unique(of, return_inverse=True)
        size = np.bincount(at, k)[at]
        block = Block(whole_rows(ids, of, k, size, src, dst, weight))
        moved = np.array(best_moves(block, total, resolution))
        labels = pa.table({"id": first, "c": moved[member]})
        parts = moved
        if refined:
            _, at = np.unique(moved, return_inverse=True)
            inner = at[src] == at[dst]
            block = Block(whole_rows(ids, moved, k, np.bincount(at, k)[at], src[inner], dst[inner], weight[inner]))
            inside = np.bincount(src[inner & (src != dst)], weight[inner & (src != dst)], len(ids))
            parts = ids[np.array(well_merged(block, inside, block.whole, total, resolution, level))]
        names = least_in(parts, ids)
        fewer, at = np.unique(names, return_inverse=True)
        if len(fewer) == len(ids):
            return labels
        of = fewer
        if refined:
            # The next level starts from the coarse communities, each named by one of its parts.
            of = np.empty(len(fewer), np.int64)
            of[at] = least_in(moved, names)
        member = at[member]
        pairs, joined = np.unique(at[src] * len(fewer) + at[dst], return_inverse=True)
        src, dst = np.divmod(pairs, len(fewer))
        weight, ids, level = np.bincount(joined, weight), fewer, level + 1


def whole_rows(ids: np.ndarray, of: np.ndarray, k: np.ndarray, size: np.ndarray, src: np.ndarray, dst: np.ndarray, weight: np.ndarray) -> pa.Table:
    """A level's nodes, and its arcs by the places of their ends, as rows of ROWS."""
    n, m = len(ids), len(src)
    join = lambda *parts: np.concatenate(parts)
    return pa.table({"kind": join(np.full(n, NODE), np.full(m, ARC)), "a": join(ids, ids[src]), "b": join(of, ids[dst]), "c": join(np.zeros(n, np.int64), of[dst]), "p": join(k, weight), "q": join(size, size[dst])})


def contract(arcs: DataFrame, labels: DataFrame) -> DataFrame:
    """Arcs between communities; arcs inside one become its loop."""
    a, b = labels.select(F.col("id").alias("src"), F.col("c").alias("cs")), labels.select(F.col("id").alias("dst"), F.col("c").alias("cd"))
    return arcs.join(a, "src").join(b, "dst").groupBy(F.col("cs").alias("src"), F.col("cd").alias("dst")).agg(F.sum("weight").alias("weight"))


def by_size(labels: DataFrame) -> DataFrame:
    """(cell, community): communities numbered as strings from the largest on; ties by the smallest cell."""
    sizes = labels.groupBy("c").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    ranked = row_numbers(sizes, [F.desc("n"), "least"], "community").withColumn("community", F.col("community").cast("string"))
    return labels.join(ranked.select("c", "community"), "c").select(F.col("id").alias("cell"), "community")


def split_disconnected(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels (id, c) with every community cut into its connected parts, each named by its smallest id."""
    a, b = labels.select(F.col("id").alias("src"), F.col("c").alias("cs")), labels.select(F.col("id").alias("dst"), F.col("c").alias("cd"))
    inside = edges.join(a, "src").join(b, "dst").where("cs = cd").select("src", "dst")
    parts = connected_components(inside)
    return labels.join(parts, "id", "left").select("id", F.coalesce("component", "id").alias("c"))


def communities(edges: DataFrame, nodes: DataFrame, resolution: float, refined: bool, tolerance: float) -> DataFrame:
    """(id, c): communities level by level; the first level that one task has room for is taken to the end in it."""
    arcs = stored(both_ways(edges))
    total = arcs.agg(F.sum("weight")).first()[0] or 1.0
    members = nodes.select(F.col("cell").alias("id"), F.col("cell").alias("node"))
    level_arcs, parts, level = arcs, None, 0
    while True:
        ids = members.select(F.col("node").alias("id")).distinct()
        degree = level_arcs.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("k"))
        start = ids.join(degree, "id", "left").na.fill(0.0, ["k"])
        start = start.join(parts, "id", "left") if parts is not None else start.withColumn("c", F.col("id"))
        start = start.select("id", F.coalesce("c", "id").alias("c"), "k")
        n, many = ids.count(), level_arcs.count()
        if n <= BLOCK and many <= ARCS:
            zero = F.lit(0.0)
            none = F.lit(0).cast("long")
            whole = start.select(F.lit(0).cast("long").alias("block"), F.lit(NODE).alias("kind"), F.col("id").alias("a"), F.col("c").alias("b"), none.alias("c"), F.col("k").alias("p"), zero.alias("q")).union(
                level_arcs.select(F.lit(0).cast("long"), F.lit(ARC), "src", "dst", none, "weight", zero)
            )

            def finish(table: pa.Table) -> pa.Table:
                return finished(table, total, resolution, refined, level)

            last = whole.groupBy("block").applyInArrow(finish, "id long, c long")
            return stored(members.join(last.select(F.col("id").alias("node"), "c"), "node").select("id", "c"))
        move = sweep_nodes if n <= SWEPT and many <= SWEPT_ARCS else move_nodes
        moved = move(level_arcs, start, total, resolution, tolerance)
        labels = stored(members.join(moved.select(F.col("id").alias("node"), "c"), "node").select("id", "c"))
        here, found = moved.agg(F.count("*"), F.countDistinct("c")).first()
        if found == here:
            return labels
        fine = refine(level_arcs, moved, total, resolution, level) if refined else moved.withColumn("home", F.col("c"))
        names = fine.groupBy("c").agg(F.min("id").alias("name"))
        fine = stored(fine.join(names, "c").select("id", F.col("name").alias("c"), "home"))
        if fine.select("c").distinct().count() == here:
            return labels
        members = stored(members.join(fine.select(F.col("id").alias("node"), "c"), "node").select("id", F.col("c").alias("node")))
        level_arcs, level = stored(contract(level_arcs, fine)), level + 1
        # The next level starts from the coarse communities, each named by one of its parts.
        homes = fine.groupBy("home").agg(F.min("c").alias("lead"))
        parts = stored(fine.select(F.col("c").alias("id"), "home").distinct().join(homes, "home").select("id", F.col("lead").alias("c"))) if refined else None


def louvain(edges: DataFrame, nodes: DataFrame, resolution: float = 1.0, tolerance: float = 1e-5) -> DataFrame:
    """(cell, community): Louvain communities of undirected weighted edges (src, dst, weight); lone cells stay alone.

    Nodes move to the neighbouring community of most gain in modularity, communities become the
    nodes of the next level, until nothing merges. A level's moves end when modularity grows by
    less than `tolerance` in a pair of turns.
    """
    return by_size(communities(edges, nodes, resolution, False, tolerance))


def leiden(edges: DataFrame, nodes: DataFrame, resolution: float = 1.0, weighted: bool = False, tolerance: float = 1e-5) -> DataFrame:
    """(cell, community): Leiden communities, by default of the edges without their weights; every community is connected.

    After the moves each community is refined: its nodes start alone and merge at random within it,
    where both node and part are well connected to the community. The refined parts are the next
    level's nodes, which start in the communities found before.
    """
    plain = edges if weighted else edges.select("src", "dst", F.lit(1.0).alias("weight"))
    found = communities(plain, nodes, resolution, True, tolerance)
    return by_size(split_disconnected(plain, found))
