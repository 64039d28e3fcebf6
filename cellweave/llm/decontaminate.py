"""Benchmark leaks in training text: rare word n-grams seed candidates, Smith-Waterman scores them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, small_batches, without_ids
from .quality import KINDS
from .words import pieces, text_buffer, window_hashes, window_starts, word_hashes

#: Words in a seed unless told otherwise; of items with fewer words than SHORTEST only a whole copy is a leak.
SEED_WORDS, SHORTEST = 3, 8
#: Seeds of the search: every leak holds a number of an item's word pairs that `Items.least` gives.
PAIR = 2
#: Score of the best local alignment over that of the whole item, from which a document is a leak,
#: and the score from which it is one whatever the item's length.
SIMILARITY, LONG = 0.5, 50
MATCH, MISMATCH, GAP = 1.0, -1.0, -1.0
#: Words of test items that a task holds at once (8 bytes each and their seeds, below 200 MB); a
#: larger benchmark is searched in several blocks.
BLOCK_WORDS = 2_000_000

LETTERS = np.where(KINDS == 1, 1, 0).astype(np.uint8)


class Items:
    """The word hashes of a block of test items, and where in them each seed stands."""

    def __init__(self, ids: list[int], texts: list[str], words: int = SEED_WORDS, similarity: float = SIMILARITY) -> None:
        _, _, h, rows = word_hashes(*text_buffer(pa.array(texts, pa.string())), LETTERS)
        self.ids, self.h, self.rows = np.array(ids, np.int64), h, rows
        starts, row = window_starts(rows, words)
        seeds = window_hashes(h, starts, words)
        #: All seeds in the items' order, and each item's offsets among them.
        self.own, self.offsets = seeds, np.searchsorted(row, np.arange(len(rows)))
        # A score of s within an item of n words has m matches in k runs with k - 1 gaps or more
        # between them: m - (k - 1) >= s, so m - k >= s - 1 pairs of neighbouring words match.
        length = np.diff(rows)
        self.score = np.where(length < SHORTEST, length, np.minimum(np.ceil(similarity * length / MATCH - 1e-9), LONG)).astype(np.int64)
        self.least = np.maximum(1, self.score - 1) if words == PAIR else np.ones(len(ids), np.int64)
        order = np.argsort(seeds, kind="stable")
        self.seed, self.item, self.at = seeds[order], row[order], (starts - rows[row])[order]
        self.index()

    def index(self) -> None:
        self.seeds, self.first = np.unique(self.seed, return_index=True)
        self.many = np.diff(np.append(self.first, len(self.seed)))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in `hashes` that are seeds, and which."""
        if not len(self.seeds):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = np.minimum(np.searchsorted(self.seeds, hashes), len(self.seeds) - 1)
        hit = np.flatnonzero(self.seeds[k] == hashes)
        return hit, k[hit]

    def keep_rare(self, frequency: np.ndarray) -> None:
        """Leave out each item's most frequent seeds, one fewer than a leak holds at least, so that every leak holds a kept one."""
        f = np.repeat(frequency, self.many)
        keep = np.ones(len(self.seed), bool)
        order = np.lexsort((f, self.item))
        begin = np.flatnonzero(np.diff(self.item[order], prepend=-1))
        for a, b in zip(begin, np.append(begin, len(order))[1:], strict=True):
            own = f[order[a:b]]
            n = max(1, len(own) - int(self.least[self.item[order[a]]]) + 1)
            keep[order[a:b]] = own <= own[n - 1]
        self.seed, self.item, self.at = self.seed[keep], self.item[keep], self.at[keep]
        self.index()


def smith_waterman(a: np.ndarray, b: np.ndarray) -> tuple[float, int]:
    """Best score of a local alignment of two word sequences, and the position in b after its end."""
    best, end = 0.0, 0
    row = np.zeros(len(b) + 1)
    step = GAP * np.arange(len(b) + 1)
    for word in a:
        new = np.maximum(row + GAP, 0.0)
        np.maximum(new[1:], row[:-1] + np.where(b == word, MATCH, MISMATCH), out=new[1:])
        row = np.maximum.accumulate(new - step) + step
        at = int(row.argmax())
        if row[at] > best:
            best, end = float(row[at]), at
    return best, end


def hashed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, row offsets, and the seeds with their places and rows, of the texts in column 1."""
    _, _, h, rows = word_hashes(*text_buffer(batch.column(1)), LETTERS)
    starts, row = window_starts(rows, PAIR)
    return h, rows, window_hashes(h, starts, PAIR), starts, row


def clusters(items: Items, place: np.ndarray, row: np.ndarray, seed: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Row, item, and begin and end of the passages around seeds that agree on an item's place."""
    if not len(seed):
        return
    many = items.many[seed]
    each = np.repeat(np.arange(len(seed)), many)
    use = np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many) + items.first[seed][each]
    item, diagonal, row = items.item[use], place[each] - items.at[use], row[each]
    order = np.lexsort((diagonal, item, row))
    item, diagonal, row = item[order], diagonal[order], row[order]
    length = np.diff(items.rows)[item]
    new = np.ones(len(item), bool)
    new[1:] = (item[1:] != item[:-1]) | (row[1:] != row[:-1]) | (np.diff(diagonal) > length[1:])
    begin = np.flatnonzero(new)
    for a, b in zip(begin, np.append(begin[1:], len(item)), strict=True):
        slack = int(length[a] - items.score[item[a]]) + 2
        yield int(row[a]), int(item[a]), int(diagonal[a]) - slack, int(diagonal[b - 1]) + int(length[a]) + slack


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows (doc_id, item_id, similarity, word_end): the documents that hold an edited or whole copy of a test item.

    Words are runs of letters and digits in lower case. A leak has a local alignment of `similarity`
    of the item's own score, or of LONG; similarity is the best one's score as a part of the item's
    own (one row for a document and item, the best; of equal alignments the first). Every document
    with one of an item's rarer word pairs, and as many of its pairs around it as a leak must hold,
    is aligned with it, so none is missed. Of an item below SHORTEST words only a whole copy is a
    leak; an item of one word or none, or null, matches nothing. Frequencies of seeds are over all
    documents. Long texts are searched whole; null texts hold no words; null ids are carried on.
    Rows that repeat are each judged and give one row an id. Other columns play no part, whatever
    their names. Empty tables give an empty result.
    """
    small_batches(docs.sparkSession)
    clean = lambda df, i, t: df.select(F.col(i).cast("long").alias("id"), F.lower(F.col(t).cast("string")).alias("t"))
    rows, tests = clean(docs, id_col, text_col), clean(benchmark, item_col, item_text_col).where("t is not null")
    size = tests.agg(F.sum(F.length("t")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // (2 * block_words)))
    block = F.pmod(F.xxhash64("id", "t"), F.lit(blocks))
    found = [block_leaks(rows, tests.where(block == i), similarity) for i in range(blocks)]
    return reduce(DataFrame.unionByName, found)


def block_leaks(rows: DataFrame, tests: DataFrame, similarity: float) -> DataFrame:
    context = rows.sparkSession.sparkContext
    chosen = tests.distinct().orderBy("id", "t").collect()
    items = Items([-1 if r.id is None else r.id for r in chosen], [r.t for r in chosen], PAIR, similarity)
    nameless = [r.id is None for r in chosen]
    all_seeds = context.broadcast(items)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents of this task that hold each seed."""
        items = all_seeds.value
        n = np.zeros(len(items.seeds), np.int64)
        for batch in (p for b in batches for p in pieces(b, 1)):
            _, _, seeds, _, row = hashed(batch)
            hit, k = items.find(seeds)
            n += np.bincount(np.unique(row[hit] * len(n) + k) % max(1, len(n)), minlength=len(n))
        k = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(n[k])], ["seed", "n"])

    counted = rows.mapInArrow(frequencies, "seed int, n long").groupBy("seed").agg(F.sum("n").alias("n")).toPandas()
    frequency = np.zeros(len(items.seeds), np.int64)
    frequency[counted["seed"].to_numpy()] = counted["n"].to_numpy()
    items.keep_rare(frequency)
    rare = context.broadcast(items)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = rare.value
        for batch in (p for b in batches for p in pieces(b, 1)):
            h, rows, seeds, starts, row = hashed(batch)
            hit, k = items.find(seeds)
            best: dict[tuple[int, int], tuple[float, int]] = {}
            for i, item, begin, end in clusters(items, starts[hit] - rows[row[hit]], row[hit], k):
                text = h[rows[i] : rows[i + 1]]
                begin = max(0, begin)
                near = seeds[np.searchsorted(starts, rows[i] + begin) : np.searchsorted(starts, min(rows[i] + end, rows[i + 1]))]
                if np.isin(items.own[items.offsets[item] : items.offsets[item + 1]], near).sum() < items.least[item]:
                    continue
                words = items.h[items.rows[item] : items.rows[item + 1]]
                score, at = smith_waterman(words, text[begin:end])
                leak = score >= items.score[item] * MATCH
                score /= MATCH * len(words)
                if leak and score > best.get((i, item), (0.0, 0))[0]:
                    best[i, item] = score, begin + at
            ids = batch.column(0).take(pa.array([i for i, _ in best], pa.int64()))
            names = pa.array([None if nameless[j] else int(items.ids[j]) for _, j in best], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, names, pa.array([s for s, _ in best.values()], pa.float64()), pa.array([e for _, e in best.values()], pa.int64())], ["doc_id", "item_id", "similarity", "word_end"])

    found = rows.mapInArrow(align, "doc_id long, item_id long, similarity double, word_end long")
    return found.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"), F.max_by("word_end", "similarity").alias("word_end"))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out the documents that hold a copy of a benchmark item; rows without a doc_id stay.

    A repeated id goes with all its rows. All columns stay as they are, whatever their names.
    """
    return without_ids(docs, leaks(docs, read_table(spark, sf_dir, "benchmark")))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
