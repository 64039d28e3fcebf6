"""Removal of long passages that also stand in an earlier document, found by difference-cover anchors."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, small_batches
from .words import pieces, text_buffer, window_hashes, window_starts, word_hashes

WINDOW = 50
#: A perfect difference cover: for any two positions, some shift below PERIOD puts both on it.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)
#: Words in an anchor. A shared window holds an aligned pair of anchors at one of PERIOD shifts.
ANCHOR = WINDOW - PERIOD + 1


def hashed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of the texts in column 1, each row's offsets among them, and each text's own hash."""
    import xxhash

    body, offsets = text_buffer(batch.column(1))
    _, _, h, rows = word_hashes(body, offsets)
    own = [xxhash.xxh3_64_intdigest(body[a:b]) >> 33 for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return h, rows, np.array(own, np.int32)


def window_digests(text: str, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BLAKE2b digests, as 64 and 32 bits, of the words of the windows at the given word positions of a text."""
    words = text.encode().split()
    body = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    bounds = zip(begins[starts].tolist(), ends[starts + WINDOW - 1].tolist(), strict=True)
    found = np.frombuffer(b"".join([blake2b(body[a:b], digest_size=12).digest() for a, b in bounds]), np.uint8).reshape(-1, 12)
    return found[:, :8].copy().view(np.uint64)[:, 0], found[:, 8:].copy().view(np.int32)[:, 0]


FOUND = "h long, doc long, own int, pos int, known boolean"


def table(h, more, doc, own, pos, known) -> pa.RecordBatch:
    columns = {"h": h.view(np.int64), "doc": doc, "own": own, "pos": pos.astype(np.int32), "known": known}
    if more is not None:
        columns["more"] = more
    return pa.RecordBatch.from_pydict({name: pa.array(x) for name, x in columns.items()})


class Gathered:
    """Occurrences from several batches of a task, let go in portions of bounded size."""

    def __init__(self, anchors: bool, most: int = 1 << 19) -> None:
        self.anchors, self.most, self.parts, self.size = anchors, most, [], 0

    def add(self, *part: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(part)
        self.size += len(part[0])
        if self.size >= self.most:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        """One occurrence of each hash in one document, and apart those whose answer is known already.

        Of a hash that several documents of the portion hold, only the smallest document goes
        on to the shuffle, so a passage of any number of documents has few rows there. Where a
        text repeats a window, its first stands for all; `everywhere` finds the others again.
        """
        if not self.size:
            return
        h, *more, doc, own, pos = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        more = more[0] if more else None
        self.parts, self.size = [], 0
        order = np.argsort(h, kind="stable")
        hs, ds, texts = h[order], doc[order], own[order]
        new = np.concatenate(([True], hs[1:] != hs[:-1]))
        if more is not None:
            new[1:] |= more[order[1:]] != more[order[:-1]]
        begin, group = np.flatnonzero(new), np.cumsum(new) - 1
        least, most = np.minimum.reduceat(ds, begin)[group], np.maximum.reduceat(ds, begin)[group]
        # A text's occurrences follow each other, and the sort leaves them in order.
        new[1:] |= (ds[1:] != ds[:-1]) | (texts[1:] != texts[:-1])
        known = new & (most > least if self.anchors else ds > least)
        for rows, told in ((np.sort(order[known]), True), (np.sort(order[new & (ds == least)]), False)):
            if len(rows):
                yield table(h[rows], None if more is None else more[rows], doc[rows], own[rows], pos[rows], np.full(len(rows), told))


def everywhere(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """All positions in a text of word hashes h whose n-word window is like one at the positions `at`."""
    every = window_hashes(h, np.arange(len(h) - n + 1), n)
    return np.flatnonzero(np.isin(every, every[at]))


def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the ANCHOR-word windows that start at cover positions of (id, text) rows."""
    on_cover = np.isin(np.arange(PERIOD), COVER)
    kept = Gathered(anchors=True)
    for batch in (p for b in batches for p in pieces(b, 1)):
        h, rows, own = hashed(batch)
        starts, row = window_starts(rows, ANCHOR)
        pos = starts - rows[row]
        on = on_cover[pos % PERIOD]
        doc = batch.column(0).to_numpy(zero_copy_only=False)
        yield from kept.add(window_hashes(h, starts[on], ANCHOR), doc[row[on]], own[row[on]], pos[on])
    yield from kept.flush()


def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the words of the windows around the given anchors of (id, text, own, anchor positions) rows.

    Of rows that share an id, only those whose text has the hash own are meant.
    """
    kept = Gathered(anchors=False)
    for batch in (p for b in batches for p in pieces(b, 1)):
        h, rows, own = hashed(batch)
        doc = batch.column(0).to_numpy(zero_copy_only=False)
        named = batch.column(2).to_numpy(zero_copy_only=False) == own
        near = np.zeros(len(h) + 1, np.int32)
        for i in np.flatnonzero(named):
            at = everywhere(h[rows[i] : rows[i + 1]], np.array(batch.column(3)[i].values, np.int64), ANCHOR)
            begin = rows[i] + np.maximum(at - PERIOD + 1, 0)
            np.add.at(near, begin, 1)
            np.add.at(near, rows[i] + at + 1, -1)
        starts, row = window_starts(rows, WINDOW)
        on = np.cumsum(near)[starts] > 0
        starts, row = starts[on], row[on]
        pos = starts - rows[row]
        edges = np.searchsorted(row, np.arange(batch.num_rows + 1))
        for i in np.unique(row):
            at = pos[edges[i] : edges[i + 1]]
            n = len(at)
            yield from kept.add(*window_digests(batch.column(1)[i].as_py(), at), np.full(n, doc[i]), np.full(n, own[i]), at)
    yield from kept.flush()


def by_document(positions: DataFrame) -> DataFrame:
    return positions.groupBy("doc", "own").agg(F.collect_set("pos").alias("at"))


def removable_windows(docs: DataFrame) -> DataFrame:
    """Rows (doc, own, at): start positions of the windows of `docs` (doc, words) that also start in a smaller doc.

    own is a hash of the text; with doc it names a text even where ids repeat. Anchors are
    candidates, by 64-bit hashes; windows are equal where BLAKE2b says that their words are.
    """
    found = docs.mapInArrow(anchors, FOUND)
    same_hash, same_words = Window.partitionBy("h"), Window.partitionBy("h", "more")
    shared = (
        found.where("not known")
        .withColumn("several", F.min("doc").over(same_hash) < F.max("doc").over(same_hash))
        .where("several")
        .select("doc", "own", "pos")
        .union(found.where("known").select("doc", "own", "pos"))
    )
    with_anchors = docs.join(by_document(shared).withColumnRenamed("doc", "d"), F.col("doc") == F.col("d")).select("doc", "words", "own", "at")
    around = with_anchors.mapInArrow(windows, f"{FOUND}, more int")
    later = (
        around.where("not known")
        .withColumn("first", F.min("doc").over(same_words))
        .where("doc > first")
        .select("doc", "own", "pos")
        .union(around.where("known").select("doc", "own", "pos"))
    )
    return by_document(later)


def kept_words(text: str | None, at: np.ndarray | None) -> tuple[list[bytes], int]:
    """The words of a text that no window at the given starts covers, and the number of all words."""
    words = (text or "").encode().split()
    if at is None:
        return words, len(words)
    cover = np.zeros(len(words) + 1, np.int32)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    return list(compress(words, np.cumsum(cover)[:-1] == 0)), len(words)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), tidy: bool = True) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, text), one for each row of `docs`, text being the words kept, one space between.

    Columns named in `carry` follow. Without `tidy`, texts that lose nothing stay as they are.

    A word goes if it lies in a window of WINDOW words whose words also start in a document
    with a smaller id; all windows are judged on the input. A null text counts as empty. A row
    with a null id, or a text below WINDOW words, neither loses words nor takes any. Rows that
    repeat an id are judged against smaller ids only, so repeated rows do not remove each other.
    A text of any length is judged whole, in one task. Names of carried columns may be any, save
    that two equal names make two equal columns. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    carried = F.struct(F.lit(0).alias("c"), *(F.col(c).alias(f"c{k}") for k, c in enumerate(carry)))
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("words"), carried.alias("carried"))
    named, nameless = rows.where("doc is not null"), rows.where("doc is null")
    found = removable_windows(named).withColumnRenamed("doc", "d")
    per_text = found.groupBy("d").agg(F.collect_list(F.struct("own", "at")).alias("cuts"))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in pieces(b, 1)):
            h, rows, own = hashed(batch)
            words, removed, texts = [], [], []
            for i, (text, mine, cuts) in enumerate(zip(batch.column(1), own, batch.column(2).to_pylist(), strict=True)):
                at = next((c["at"] for c in cuts or [] if c["own"] == mine), None)
                at = everywhere(h[rows[i] : rows[i + 1]], np.array(at), WINDOW) if at else None
                kept, n = kept_words(text.as_py(), at)
                words.append(n)
                removed.append(n - len(kept))
                texts.append(b" ".join(kept).decode() if tidy or removed[-1] else text.as_py())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string()), batch.column(3)], ["doc_id", "n_words", "n_removed", "text", "carried"])

    # Both joins read one shuffle of the texts; Spark sees that only while the plans of `named` are
    # the same in each, so its columns have names of their own and no further filters.
    joined = named.join(per_text, named.doc == per_text.d, "left").select("doc", "words", "cuts", "carried")
    joined = joined.union(nameless.select("doc", "words", F.lit(None).cast(joined.schema["cuts"].dataType), "carried"))
    kept = joined.mapInArrow(cut_out, f"doc_id long, n_words long, n_removed long, text string, carried {joined.schema['carried'].dataType.simpleString()}")
    return kept.select("doc_id", "n_words", "n_removed", "text", *(F.col("carried")[f"c{k}"].alias(c) for k, c in enumerate(carry)))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with what remains of their texts; those of which nothing remains go.

    Other columns stay as they are, whatever their names, but that n_chars, if there is one, is
    that of the new text. Rows that repeat an id, null ids and long texts are as in `substring_dedup`.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select("doc_id", "text", F.struct(F.lit(0).alias("_only"), *(F.col(c).alias(f"c{k}") for k, c in enumerate(others))).alias("others"))
    kept = substring_dedup(rows, carry=("others",), tidy=False).where("n_removed = 0 or text <> ''")
    length = F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in others else None
    found = {"doc_id": F.col("doc_id"), "text": F.col("text")} | {c: F.col("others")[f"c{k}"] for k, c in enumerate(others)}
    if length is not None:
        found["n_chars"] = F.when(F.col("n_removed") > 0, length).otherwise(found["n_chars"])
    return kept.select(*(found[c].alias(c) for c in docs.columns))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup(read_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP6_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> '') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW} + 2)) AS i FROM d WHERE len(ws) >= {WINDOW}),
windows AS MATERIALIZED (SELECT doc_id, i, array_to_string(ws[i : i + {WINDOW - 1}], ' ') AS t FROM starts),
firsts AS (SELECT t, min(doc_id) AS m FROM windows GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS k FROM windows JOIN firsts USING (t) WHERE doc_id > m),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS t FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
