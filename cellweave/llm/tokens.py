"""Token counts under a unigram vocabulary, with forward scores shared over a trie of pre-tokens."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, small_batches
from .words import pieces

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Added to the score of the unlikeliest piece for a character that no piece covers.
UNKNOWN_PENALTY = -10.0
SPACE_MARK = "▁"
#: Words of more characters don't go into the trie.
LONG_WORD = 256


def unigram_scores(path: str = VOCABULARY) -> dict[str, float]:
    """Pieces of a sentencepiece file with log probabilities.

    The file ranks its pieces and has no probabilities; a piece of rank r gets a share in
    proportion to 1/r. Control and byte pieces, and pieces of spaces alone, are left out.
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    ranks = {}
    for i in range(model.get_piece_size()):
        special = model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i)
        if not special and model.id_to_piece(i).strip(SPACE_MARK):
            ranks[model.id_to_piece(i)] = max(1.0, -model.get_score(i))
    total = math.log(sum(1 / r for r in ranks.values()))
    return {p: -math.log(r) - total for p, r in ranks.items()}


class TokenTrie:
    """Distinct pre-tokens in a trie; each node has the best forward score of its prefix and its token count.

    Of segmentations with equal scores the one with fewer tokens counts. A character that no
    piece covers takes one token for each of its UTF-8 bytes.
    """

    def __init__(self, scores: dict[str, float], most_nodes: int = 400_000) -> None:
        self.most_nodes = most_nodes
        #: Scores of pieces, and minus infinity for what only ends a piece.
        self.ends = {piece[i:]: -math.inf for piece in scores for i in range(len(piece))} | scores
        self.single = {piece for piece in scores if len(piece) == 1}
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) + UNKNOWN_PENALTY
        self.clear()

    def clear(self) -> None:
        self.children: list[dict[str, int] | None] = [None]
        self.forward: list[tuple[float, int]] = [(0.0, 0)]
        self.terminal: dict[bytes, int] = {}

    def step(self, text: str, end: int, path, first: int) -> tuple[float, int]:
        """Forward score and token count of text[:end], from those of text[:k] at path[k - first]."""
        best, count = -math.inf, 0
        begin = end - 1
        while begin >= first and (s := self.ends.get(text[begin:end])) is not None:
            total, n = path[begin - first]
            if total + s > best or total + s == best and n + 1 < count:
                best, count = total + s, n + 1
            begin -= 1
        if text[end - 1] not in self.single:
            total, n = path[end - 1 - first]
            if total + self.unknown > best:
                best, count = total + self.unknown, n + len(text[end - 1].encode())
        return best, count

    def insert(self, word: bytes) -> int:
        """Tokens of a word, with the mark of a space before it."""
        text = SPACE_MARK + word.decode(errors="replace")
        node, children, ends = 0, self.children, self.ends
        path = [self.forward[0]]
        for end, char in enumerate(text, 1):
            below = children[node]
            to = below.get(char) if below else None
            if to is None:
                # As in `step`, without a call for each node: nearly all time goes here.
                best, count = -math.inf, 0
                begin = end - 1
                while begin >= 0 and (s := ends.get(text[begin:end])) is not None:
                    total, n = path[begin]
                    if total + s > best or total + s == best and n + 1 < count:
                        best, count = total + s, n + 1
                    begin -= 1
                if char not in self.single:
                    total, n = path[-1]
                    if total + self.unknown > best:
                        best, count = total + self.unknown, n + len(char.encode())
                to = len(children)
                if below is None:
                    children[node] = {char: to}
                else:
                    below[char] = to
                children.append(None)
                self.forward.append((best, count))
            node = to
            path.append(self.forward[to])
        self.terminal[word] = path[-1][1]
        return path[-1][1]

    def long_word(self, word: bytes) -> int:
        """Tokens of a word of any length, of whose prefixes only the last few are remembered."""
        text = SPACE_MARK + word.decode(errors="replace")
        path, first = [(0.0, 0)], 0
        for end in range(1, len(text) + 1):
            path.append(self.step(text, end, path, first))
            if len(path) > 16 * self.longest:
                first += len(path) - self.longest - 1
                path = path[-self.longest - 1 :]
        return path[-1][1]

    def count(self, words: list[bytes]) -> int:
        """Tokens of a list of words. Words new to the trie go in once; a full trie is begun anew."""
        long = [word for word in words if len(word) > LONG_WORD]
        if long:
            words = [word for word in words if len(word) <= LONG_WORD]
        for word in set(words).difference(self.terminal):
            self.insert(word)
        n = sum(map(self.terminal.__getitem__, words))
        if len(self.children) > self.most_nodes:
            self.clear()
        return n + sum(map(self.long_word, long))


def texts_in(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from pieces(batch, 1)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Rows (doc_id, n_words, n_tokens), one for each row of `docs`, over whole texts.

    Pre-tokens are runs of bytes other than space and 0x09-0x0D. A null or wordless text has no
    tokens; repeated rows and null ids are kept as they are; an empty table gives an empty
    result. Each task keeps its own trie of bounded size, so no text is shuffled. A word of more
    than LONG_WORD bytes is scored by itself with a window of forward scores. Texts are counted
    whole; other columns play no part, whatever their names.
    """
    small_batches(docs.sparkSession)
    scores = docs.sparkSession.sparkContext.broadcast(unigram_scores(vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = TokenTrie(scores.value)
        for batch in texts_in(batches):
            n_words, n_tokens = [], []
            for text in batch.column(1):
                words = (text.as_py() or "").encode().split()
                n_words.append(len(words))
                n_tokens.append(trie.count(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_words long, n_tokens long")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"))
