"""Two-dimensional layouts by rounds of joins and grouped sums: UMAP and t-SNE."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions.lineage import Turns, stored
from cellweave.operators.graph import by_length


def curve(min_dist: float, spread: float) -> tuple[float, float]:
    """a and b for which 1 / (1 + a d^2b) comes nearest to 1 up to min_dist and an exponential fall with `spread` after it."""
    d = np.linspace(1e-3, 3 * spread, 300)
    want = np.where(d < min_dist, 1.0, np.exp(-(d - min_dist) / spread))
    a, b = 1.0, 1.0
    for _ in range(100):
        power = d ** (2 * b)
        f = 1 / (1 + a * power)
        slope = np.stack([-power * f * f, -a * power * 2 * np.log(d) * f * f], axis=1)
        step, *_ = np.linalg.lstsq(slope.T @ slope + 1e-6 * np.eye(2), slope.T @ (want - f), rcond=None)
        a, b = max(1e-3, a + step[0]), max(0.1, b + step[1])
    return float(a), float(b)


def initial_positions(vectors: DataFrame, width: float = 10.0) -> DataFrame:
    """(cell, x, y): the first two components, put in a square of the given width around 0."""
    p = vectors.select("cell", F.col("vec")[0].alias("x"), F.coalesce(F.try_element_at("vec", F.lit(2)), F.lit(0.0)).alias("y"))
    s = p.agg(*(f(c) for c in "xy" for f in (F.min, F.max))).first()
    if s[0] is None:
        return p
    scale = lambda c, lo, hi: (F.col(c) - F.lit((lo + hi) / 2)) * F.lit(width / max(hi - lo, 1e-12))
    return p.select("cell", scale("x", s[0], s[1]).alias("x"), scale("y", s[2], s[3]).alias("y"))


class Tile:
    """Points that stand close together, their arcs, and what there is of the others: the arcs' far ends and a summary."""

    def __init__(self, table: pa.Table) -> None:
        kind = table["kind"].to_numpy()
        of = lambda k, *names: np.stack([table[c].to_numpy()[kind == k] for c in names], axis=1)
        self.ids = of(POINT, "a")[:, 0]
        order = np.argsort(self.ids)
        self.ids = self.ids[order]
        self.x, self.v, self.z = of(POINT, "p", "q")[order], of(POINT, "r", "s")[order], of(POINT, "z")[order, 0]
        self.far = of(FAR, "p", "q", "r")
        ends = of(ARC, "a", "b")
        self.src = np.searchsorted(self.ids, ends[:, 0])
        place = np.minimum(np.searchsorted(self.ids, ends[:, 1]), len(self.ids) - 1)
        self.own = self.ids[place] == ends[:, 1]
        self.dst, (self.weight, *there) = place[self.own], of(ARC, "p", "q", "r").T
        self.there = np.stack(there, axis=1)

    def steps(self) -> tuple[np.ndarray, np.ndarray]:
        """From each arc's far end, as new as it is known, to its source, and the square of that length."""
        self.there[self.own] = self.x[self.dst]
        d = self.x[self.src] - self.there
        return d, np.einsum("ij,ij->i", d, d)

    def summed(self, forces: np.ndarray) -> np.ndarray:
        """The arcs' forces by their sources."""
        return np.stack([np.bincount(self.src, forces[:, c], len(self.ids)) for c in (0, 1)], axis=1)

    def table(self, tile: int) -> pa.Table:
        columns = [self.ids, *self.x.T, *self.v.T, self.z]
        return pa.table(dict(zip(("cell", "x", "y", "vx", "vy", "z"), columns, strict=True)))


#: Kinds of a tile's rows, their columns, and what becomes of its points.
POINT, ARC, FAR = 0, 1, 2
ROWS = ("tile", "kind", "a", "b", "p", "q", "r", "s", "z")
STATE = "cell long, x double, y double, vx double, vy double, z double"
#: Points of a tile, about; and the depth of the grid that the order of points is taken from.
TILE, DEPTH = 1024, 16
#: A square is opened for a tile unless it is this much narrower than it is away.
OPENING = 0.6


def rows(df: DataFrame, kind: int, **columns: Column | str) -> DataFrame:
    """Rows of ROWS of one kind; what isn't given is zero."""
    zero = {"a": F.lit(0).cast("long"), "b": F.lit(0).cast("long")}
    return df.select("tile", F.lit(kind).alias("kind"), *((F.col(columns[c]) if isinstance(columns.get(c), str) else columns.get(c, zero.get(c, F.lit(0.0)))).alias(c) for c in ROWS[2:]))


def start_state(start: DataFrame, factor: float) -> DataFrame:
    zeros = (F.lit(0.0).alias(c) for c in ("vx", "vy", "z"))
    return start.select("cell", (F.col("x") * factor).alias("x"), (F.col("y") * factor).alias("y"), *zeros)


def spread_bits(c: Column) -> Column:
    """The lower 16 bits of a number, each followed by a zero bit."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return c


def tiled(state: DataFrame, n: int, box: tuple[float, float, float]) -> DataFrame:
    """`state` with tile and the place (i, j) in the finest grid: ranges of the Morton order of about TILE points."""
    low_x, low_y, span = box
    at = lambda c, low: F.least(F.floor((F.col(c) - low) / span * 2**DEPTH), F.lit(2**DEPTH - 1)).cast("long")
    placed = state.withColumns({"i": at("x", low_x), "j": at("y", low_y)})
    tiles = -(-n // TILE)
    if tiles == 1:
        return placed.withColumn("tile", F.lit(0))
    code = F.shiftleft(spread_bits(F.col("i")), 1).bitwiseOR(spread_bits(F.col("j")))
    return stored(placed.repartitionByRange(tiles, code, "cell").withColumn("tile", F.spark_partition_id()))


#: Levels of the quadtree that a square carries with it, and that a job opens at once.
STEP = 4


def bundles(placed: DataFrame, last: int) -> DataFrame:
    """(level, i, j, squares): each square of every STEP-th level with those below it down to the next such level.

    `squares` are structs (level, i, j, m, cx, cy), made by grouped sums; empty ones are not there.
    """
    level = F.explode(F.sequence(F.lit(1), F.lit(last))).alias("level")
    at = [F.expr(f"shiftright({c}, {DEPTH} - level)").alias(c) for c in "ij"]
    sums = (F.count("*").cast("double").alias("m"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    squares = placed.select(level, "i", "j", "x", "y").select("level", *at, "x", "y").groupBy("level", "i", "j").agg(*sums)
    top = F.expr(f"level - 1 - (level - 1) % {STEP}").alias("top")
    above = squares.select(top, F.struct("level", "i", "j", "m", "cx", "cy").alias("square"))
    key = [F.expr(f"shiftright(square.{c}, square.level - top)").alias(c) for c in "ij"]
    return above.select(F.col("top").alias("level"), *key, "square").groupBy("level", "i", "j").agg(F.collect_list("square").alias("squares"))


def far_squares(placed: DataFrame, n: int, box: tuple[float, float, float], opening: float = OPENING) -> DataFrame:
    """(tile, m, cx, cy): numbers and centres of the points outside each tile, by squares the smaller the nearer.

    The quadtree is a table of the squares of each level, made by grouped sums. From the root on, a
    square that is narrow for its distance from the tile's own rectangle stands for its points, and
    another one gives way to its four parts. A job opens STEP levels for all tiles at once. Of the
    squares of the last level, which hold less than a point on average, only what isn't the tile's
    own counts.
    """
    low_x, low_y, span = box
    last = min(DEPTH, max(1, math.ceil(math.log(n, 4)) + 1))
    squares = stored(bundles(placed, last))
    part = lambda c: F.shiftright(c, DEPTH - last)
    owned = placed.groupBy(part("i").alias("i"), part("j").alias("j"), F.col("tile").alias("owner")).agg(F.count("*").cast("double").alias("m"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    edges = ("tile", "x0", "x1", "y0", "y1")
    front = placed.groupBy("tile").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).withColumns({c: F.lit(0).cast("long") for c in "ij"})
    found = []
    for top in range(0, last, STEP):
        bottom = min(last, top + STEP)

        def opened(batches: Iterator[pa.RecordBatch], top: int = top, bottom: int = bottom) -> Iterator[pa.RecordBatch]:
            for batch in (b.slice(k, 512) for b in batches for k in range(0, b.num_rows, 512)):
                given = [batch.column(c).to_numpy() for c in edges]
                ends, every = batch.column("squares").offsets.to_numpy(), batch.column("squares").values
                of = np.repeat(np.arange(batch.num_rows), np.diff(ends))
                level, i, j, m, cx, cy = (every.field(c).to_numpy()[ends[0] : ends[-1]] for c in ("level", "i", "j", "m", "cx", "cy"))
                tile, x0, x1, y0, y1 = (c[of] for c in given)
                side = span / 2.0**level
                gap = lambda c, low, a, b: np.maximum(0.0, np.maximum(low + c * side - b, a - (low + (c + 1) * side)))
                narrow = side < opening * np.hypot(gap(i, low_x, x0, x1), gap(j, low_y, y0, y1))
                # A square counts if none of those above it, within this bundle, is narrow.
                code = (of << 2 * STEP) + ((i & (1 << level - top) - 1) << STEP) + (j & (1 << level - top) - 1)
                live = np.ones(len(of), bool)
                for k in range(top + 1, bottom):
                    here = (level == k) & (narrow | ~live)
                    below = level == k + 1
                    above = (of << 2 * STEP) + ((i >> 1 & (1 << k - top) - 1) << STEP) + (j >> 1 & (1 << k - top) - 1)
                    live[below] = ~np.isin(above[below], code[here])
                done, on = live & narrow, live & ~narrow & (level == bottom)
                keep = done | on
                columns = [tile, x0, x1, y0, y1, i, j, m, cx, cy, done]
                yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], [*edges, "i", "j", "m", "cx", "cy", "done"])

        here = squares.where(F.col("level") == top).select("i", "j", "squares")
        schema = "tile int, x0 double, x1 double, y0 double, y1 double, i long, j long, m double, cx double, cy double, done boolean"
        seen = stored(front.join(F.broadcast(here) if not top else here, ["i", "j"]).mapInArrow(opened, schema))
        found.append(seen.where("done").select("tile", "m", "cx", "cy"))
        front = seen.where("not done").select(*edges, "i", "j")
    found.append(front.select("tile", "i", "j").join(owned, ["i", "j"]).where("owner <> tile").select("tile", "m", "cx", "cy"))
    return reduce(DataFrame.union, found)


def extent(state: DataFrame) -> tuple[tuple[float, float, float], float] | None:
    """Corner and width of the square around all points, and the sum of their z; nothing without points."""
    s = state.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.sum("z")).first()
    return None if s[0] is None else ((s[0], s[2], max(s[1] - s[0], s[3] - s[2], 1e-9) * (1 + 1e-9)), s[4])


def turn(placed: DataFrame, arcs: DataFrame, others: DataFrame | None, inner: Callable[[Tile], None]) -> DataFrame:
    """The points after `inner` has moved each tile's in a task of its own.

    A tile's rows are its points, the arcs (src, dst, weight) from them with the places of their
    other ends, and `others` (tile, m, cx, cy).
    """
    a = placed.select(F.col("cell").alias("src"), "tile")
    b = placed.select(F.col("cell").alias("dst"), "x", "y")
    every = rows(placed, POINT, a="cell", p="x", q="y", r="vx", s="vy", z="z").union(rows(arcs.join(a, "src").join(b, "dst"), ARC, a="src", b="dst", p="weight", q="x", r="y"))
    if others is not None:
        every = every.union(rows(others, FAR, p=F.col("m").cast("double"), q="cx", r="cy"))

    def move(key: tuple, table: pa.Table) -> pa.Table:
        tile = Tile(table)
        inner(tile)
        return tile.table(key[0].as_py())

    return every.groupBy("tile").applyInArrow(move, STATE)


def umap(edges: DataFrame, start: DataFrame, epochs: int = 200, min_dist: float = 0.3, spread: float = 1.0, negatives: int = 5, rate: float = 1.0, seed: int = 0, inner: int = 10, sample: int = 4096) -> DataFrame:
    """(cell, x, y): a UMAP layout of undirected weighted edges (src, dst, weight) from the places in `start`.

    In each epoch every cell is pulled along its edges by their weights and pushed from
    `negatives` others. Cells that stand together are a tile; a job moves each tile through
    `inner` epochs, in which it sees its own cells as they move and the other ends of its edges
    where they were at the job's start. Negatives are its own cells or, as often as chance has it
    among all cells, some of about `sample` that a hash picks anew for each job.
    """
    a, b = curve(min_dist, spread)
    top = edges.agg(F.max("weight")).first()[0] or 1.0
    arcs = stored(edges.select("src", "dst", (F.col("weight") / top).alias("weight")).union(edges.select("dst", "src", (F.col("weight") / top).alias("weight"))))
    turns = Turns()
    state = turns.store(start_state(start, 1.0))
    n = state.count()
    for first in range(0, epochs if n else 0, inner):
        box, _ = extent(state)
        picked = state.where(F.pmod(F.xxhash64("cell", F.lit(seed), F.lit(first)), F.lit(max(1, n // sample))) == 0).select("x", "y").toArrow()
        foreign = np.stack([picked[c].to_numpy() for c in "xy"], axis=1)

        def move(tile: Tile, first: int = first, foreign: np.ndarray = foreign) -> None:
            m = len(tile.ids)
            r = np.random.default_rng([seed, first, int(tile.ids[0]) & 0xFFFFFFFF])
            for epoch in range(first, min(first + inner, epochs)):
                d, d2 = tile.steps()
                d2 = np.maximum(d2, 1e-9)
                pull = tile.summed(np.clip((-2 * a * b * d2 ** (b - 1) / (1 + a * d2**b) * tile.weight)[:, None] * d, -4, 4))
                own = r.integers(0, m, (m, negatives))
                there = tile.x[own]
                if len(foreign) and m < n:
                    away = r.random((m, negatives)) >= m / n
                    there[away] = foreign[r.integers(0, len(foreign), int(away.sum()))]
                d = tile.x[:, None] - there
                d2 = np.maximum(np.einsum("ijk,ijk->ij", d, d), 1e-9)
                push = np.clip((2 * b / ((0.001 + d2) * (1 + a * d2**b)))[:, :, None] * d, -4, 4).sum(axis=1)
                tile.x += rate * (1 - epoch / epochs) * np.clip(pull + push, -4, 4)

        state = turns.store(turn(tiled(state, n, box), arcs, None, move))
    return state.select("cell", "x", "y")


def affinities(neighbours: DataFrame, perplexity: float) -> DataFrame:
    """(src, dst, weight) with src < dst: t-SNE's joint chances from nearest neighbours (src, dst, dist), each cell's at the given perplexity."""

    def weights(d: np.ndarray) -> np.ndarray:
        square = d**2
        square, target = square - square.min(axis=1)[:, None], np.log(min(perplexity, max(1.0, d.shape[1] * 0.9)))
        lo, hi, beta = np.zeros(len(d)), np.full(len(d), np.inf), 1.0 / np.maximum(square.mean(axis=1), 1e-12)
        for _ in range(64):
            p = np.exp(-square * beta[:, None])
            flat = np.log(p.sum(axis=1)) + beta * (square * p).sum(axis=1) / p.sum(axis=1) > target
            lo, hi = np.where(flat, beta, lo), np.where(flat, hi, beta)
            beta = np.where(np.isfinite(hi), (lo + hi) / 2, beta * 2)
        p = np.exp(-square * beta[:, None])
        return p / p.sum(axis=1)[:, None]

    lists = neighbours.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("dist", "dst"))).alias("edges"))
    one_way = lists.mapInArrow(by_length(weights), "src long, dst long, weight double").where("src <> dst")
    both = one_way.groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.sum("weight").alias("weight"))
    n = max(1, neighbours.select("src").distinct().count())
    return both.select(F.col("u").alias("src"), F.col("v").alias("dst"), (F.col("weight") / (2 * n)).alias("weight"))


def pushes(x: np.ndarray, m: np.ndarray, others: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Each point's push from `m` points at each of the places `others`, and the sum of its closenesses to them.

    Pairs are worked out in numbers of the given kind, around the middle of x.
    """
    force, z = np.empty_like(x), np.empty(len(x), kind)
    middle = x.mean(axis=0)
    m, x, others = m.astype(kind), (x - middle).astype(kind), (others - middle).astype(kind)
    ox, oy = others.T.copy()
    weights = np.column_stack([m, m * ox, m * oy])
    # A part's distances stay in the processor's cache.
    for i in range(0, len(x), 32):
        own = x[i : i + 32]
        q, dy = own[:, :1] - ox, own[:, 1:] - oy
        q *= q
        dy *= dy
        q += dy
        q += 1
        np.reciprocal(q, out=q)
        z[i : i + 32] = q @ m
        q *= q
        sums = q @ weights
        force[i : i + 32] = own * sums[:, :1] - sums[:, 1:]
    return force, z


def repulsion(x: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each point's push from the others of its tile and from squares (number, centre), and the sum of its closenesses.

    Single precision is enough around the tile's middle, in which places differ by little; it is far
    finer than what a square's centre makes of its points.
    """
    force, z = pushes(x, np.concatenate([np.ones(len(x)), far[:, 0]]), np.concatenate([x, far[:, 1:]]), np.float32)
    return force, (z - 1).astype(float)


def tsne(joint: DataFrame, start: DataFrame, iterations: int = 250, rate: float | None = None, exaggeration: float = 12.0, inner: int = 25) -> DataFrame:
    """(cell, x, y): a t-SNE layout of joint chances (src, dst, weight) from the places in `start`.

    Cells that stand together are a tile. A job moves each tile through `inner` iterations: its own
    cells attract and repel each other as they move, other ends of arcs and the `far_squares` of
    the quadtree stay where they were at the job's start, as does the others' share of the
    normalising sum. Momentum is 0.5, then 0.8; the first quarter exaggerates the attraction.
    """
    arcs = stored(joint.select("src", "dst", "weight").union(joint.select("dst", "src", "weight")))
    turns = Turns()
    state = turns.store(start_state(start, 1e-2))
    n = state.count()
    # A step of n / exaggeration / 4 takes a cell, while attraction is exaggerated, just to the mean of its
    # neighbours. A longer one throws it beyond, and with most neighbours in other tiles the start is lost.
    rate = rate or max(50.0, n / exaggeration / 4)

    def measured(tile: Tile) -> None:
        tile.z = repulsion(tile.x, tile.far)[1]

    for first in [None, *range(0, iterations, inner)] if n else []:
        box, total = extent(state)
        placed = tiled(state, n, box)
        far = far_squares(placed, n, box) if n > TILE else None

        def move(tile: Tile, first: int | None = first, total: float = total) -> None:
            others = total - tile.z.sum()
            for now in range(first, min(first + inner, iterations)):
                force, tile.z = repulsion(tile.x, tile.far)
                d, d2 = tile.steps()
                pull = tile.summed((tile.weight / (1 + d2))[:, None] * d)
                gain, momentum = (exaggeration, 0.5) if now < iterations // 4 else (1.0, 0.8)
                tile.v = np.clip(momentum * tile.v - rate * 4 * (gain * pull - force / max(others + tile.z.sum(), 1e-12)), -5, 5)
                tile.x += tile.v

        # The first turn moves nothing: it finds the normalising sum, for which no arcs are needed.
        state = turns.store(turn(placed, arcs.where("false"), far, measured) if first is None else turn(placed, arcs, far, move))
    return state.select("cell", "x", "y")


def layout_sums(positions: DataFrame) -> tuple[int, float, DataFrame]:
    """Number of cells, the normalising sum of a layout, and its state with each cell's push in vx, vy."""

    def push(tile: Tile) -> None:
        tile.v, tile.z = repulsion(tile.x, tile.far)

    state = stored(start_state(positions, 1.0))
    n = state.count()
    box, _ = extent(state)
    placed = tiled(state, n, box)
    none = state.select(F.col("cell").alias("src"), F.col("cell").alias("dst"), F.lit(0.0).alias("weight")).where("false")
    pushed = stored(turn(placed, none, far_squares(placed, n, box) if n > TILE else None, push))
    return n, pushed.agg(F.sum("z")).first()[0], pushed


def divergence(joint: DataFrame, positions: DataFrame, sums: tuple[int, float, DataFrame] | None = None) -> float:
    """Kullback-Leibler divergence of a layout's closenesses from the joint chances; `sums` are its `layout_sums`, if they are there."""
    _, z, _ = sums or layout_sums(positions)
    a, b = (positions.select(F.col("cell").alias(c), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}")) for k, c in enumerate(("src", "dst")))
    d2 = F.pow(F.col("x0") - F.col("x1"), 2) + F.pow(F.col("y0") - F.col("y1"), 2)
    p = F.col("weight")
    return joint.join(a, "src").join(b, "dst").agg(F.sum(2 * p * F.log(p * (1 + d2) * z))).first()[0] or 0.0


#: Most cells that a task works out the pushes on; it holds these and four times as many others.
BLOCK = 16384


def repulsion_error(positions: DataFrame, sums: tuple[int, float, DataFrame] | None = None, block: int | None = None) -> float:
    """How far the pushes on all cells are from those of all pairs, as a share of these; `sums` as for `divergence`.

    The work is quadratic. A hash deals the cells to blocks and, as what pushes, to blocks four times
    as large; each meets each in a task of its own.
    """
    n, _, pushed = sums or layout_sums(positions)
    block = block or min(BLOCK, max(1024, -(-n // 8)))
    many = max(1, -(-n // block)), max(1, -(-n // (4 * block)))
    own = lambda n: F.pmod(F.xxhash64("cell"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = pushed.select(F.lit(True).alias("asks"), "cell", "x", "y", "vx", "vy", own(many[0]).alias("a"), every(many[1]).alias("b"))
    others = positions.select(F.lit(False).alias("asks"), "cell", "x", "y", F.lit(0.0).alias("vx"), F.lit(0.0).alias("vy"), every(many[0]).alias("a"), own(many[1]).alias("b"))

    def meet(table: pa.Table) -> pa.Table:
        asks = table["asks"].to_numpy()
        places = np.column_stack([table[c].to_numpy() for c in "xy"])
        x, rest = places[asks], places[~asks]
        force = np.zeros_like(x)
        for i in range(0, len(rest) if len(x) else 0, 2048):
            force += pushes(x, np.ones(len(rest[i : i + 2048])), rest[i : i + 2048], float)[0]
        return table.filter(pa.array(asks)).select(["cell", "x", "y", "vx", "vy"]).append_column("fx", pa.array(force[:, 0])).append_column("fy", pa.array(force[:, 1]))

    # More partitions than tasks, so that few of these share one.
    dealt = asked.union(others).repartition(min(4 * many[0] * many[1], 2000), "a", "b")
    parts = dealt.groupBy("a", "b").applyInArrow(meet, "cell long, x double, y double, vx double, vy double, fx double, fy double")
    # A cell that comes more than once is pushed as often by each block.
    times = F.count("*") / many[1]
    exact = parts.groupBy("cell", "x", "y", "vx", "vy").agg((F.sum("fx") / times).alias("fx"), (F.sum("fy") / times).alias("fy"), times.alias("times"))
    off, size = exact.agg(F.sum(F.col("times") * F.hypot(F.col("vx") - F.col("fx"), F.col("vy") - F.col("fy"))), F.sum(F.col("times") * F.hypot("fx", "fy"))).first()
    return (off or 0.0) / max(size or 0.0, 1e-12)
