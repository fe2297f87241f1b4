"""Language of texts by unigram models over all segmentations into pieces of a fixed vocabulary (operator 12).

A language gives every piece of a public byte-level vocabulary a probability.  A word's probability is the sum
over all ways to cut it (with the space before it) into pieces, which the forward algorithm adds up; a text's is the product over its
words.  The probabilities are learnt by expectation-maximisation: forward and backward sums give the expected
number of times each piece is used.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.llm.words import Words, pieces
from wattline.session import stored

SAMPLE = 4_000  # labelled texts a language that the models are learnt from, about
PASSES = 5
POOLED = 50.0  # expected pieces that all languages together lend to each
GRID = 1 << 18  # bytes of words whose segmentations are summed at once
KEPT = 100_000  # words whose sums a worker keeps
UNKNOWN = "und"


# ---------------------------------------------------------------- the vocabulary as a trie


class Pieces:
    """Pieces of a .tiktoken file (every byte is one) in a trie whose edges are an open hash table."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            ranked = [line.split() for line in file if line.strip()]
        self.pieces = [base64.b64decode(token) for token, _ in ranked]
        edges: dict[int, int] = {}
        ends = [-1]
        for number, piece in enumerate(self.pieces):
            node = 0
            for byte in piece:
                child = edges.setdefault(node << 8 | byte, len(ends))
                if child == len(ends):
                    ends.append(-1)
                node = child
            ends[node] = number
        if any(edges.get(byte, 0) == 0 or ends[edges[byte]] < 0 for byte in range(256)):
            raise ValueError(f"{path} has no piece for some byte")
        self.ends = np.array(ends)
        self.bits = (4 * len(edges)).bit_length()
        self.key = np.full(1 << self.bits, -1, dtype=np.int64)
        self.child = np.zeros(1 << self.bits, dtype=np.int64)
        keys, children = np.array(list(edges)), np.array(list(edges.values()))
        slot = self.slot(keys)
        while len(keys):  # of those that want one slot the first gets it, the others move on
            _, first = np.unique(slot, return_index=True)
            first = first[self.key[slot[first]] < 0]
            self.key[slot[first]], self.child[slot[first]] = keys[first], children[first]
            rest = np.ones(len(keys), dtype=bool)
            rest[first] = False
            keys, children, slot = keys[rest], children[rest], (slot[rest] + 1) & (len(self.key) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, nodes: np.ndarray, data: np.ndarray) -> np.ndarray:
        """The child of each node by a byte, -1 where it has none."""
        keys = nodes << 8 | data
        slot = self.slot(keys)
        out = np.full(len(keys), -1)
        open_ = np.arange(len(keys))
        while len(open_):
            here = self.key[slot[open_]]
            hit = here == keys[open_]
            out[open_[hit]] = self.child[slot[open_[hit]]]
            open_ = open_[~hit & (here >= 0)]
            slot[open_] = (slot[open_] + 1) & (len(self.key) - 1)
        return out

    def edges(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, start, end and piece of every piece in a matrix of words of one length."""
        n, size = words.shape
        row, start = np.divmod(np.arange(n * size), size)
        node = np.zeros(n * size, dtype=np.int64)
        found = []
        end = start.copy()
        while len(row):
            inside = end < size
            row, start, end, node = row[inside], start[inside], end[inside], node[inside]
            node = self.step(node, words[row, end].astype(np.int64))
            lives = node >= 0
            row, start, end, node = row[lives], start[lives], end[lives] + 1, node[lives]
            piece = self.ends[node]
            whole = piece >= 0
            found.append((row[whole], start[whole], end[whole], piece[whole]))
        return tuple(np.concatenate([f[i] for f in found]) for i in range(4))


_OPEN: dict[str, Pieces] = {}


def open_pieces(path: str) -> Pieces:
    """One trie for each worker process."""
    if path not in _OPEN:
        _OPEN[path] = Pieces(path)
    return _OPEN[path]


# ---------------------------------------------------------------- sums over all segmentations


def forward(n: int, size: int, row: np.ndarray, start: np.ndarray, end: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logarithms of the sums over all paths from place 0 to each place, for ``n`` words of ``size`` bytes: an array
    (size + 1, n, columns of ``weight``); ``weight`` holds the log-probabilities of the edges."""
    out = np.full((size + 1, n, weight.shape[1]), -np.inf)
    out[0] = 0
    order = np.argsort(end * n + row, kind="stable")
    row, start, end, weight = row[order], start[order], end[order], weight[order]
    cuts = np.searchsorted(end, np.arange(1, size + 2))
    for at in range(1, size + 1):
        here = slice(cuts[at - 1], cuts[at])
        rows = row[here]
        first = np.flatnonzero(np.diff(rows, prepend=-1))
        out[at][rows[first]] = np.logaddexp.reduceat(out[start[here], rows] + weight[here], first, axis=0)
    return out


def by_length(start: np.ndarray, end: np.ndarray, data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of words and their bytes, a space before each, as matrices of one length; some words at a time."""
    sizes = end - start
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        step = max(1, GRID // (size + 1))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            words = np.full((len(part), size + 1), 32, dtype=np.uint8)
            words[:, 1:] = data[start[part][:, None] + np.arange(size)]
            yield part, words


def word_sums(trie: Pieces, words: np.ndarray, chances: np.ndarray) -> np.ndarray:
    """Log-probability of each word under each row of ``chances`` (log-probabilities of pieces)."""
    row, start, end, piece = trie.edges(words)
    return forward(len(words), words.shape[1], row, start, end, chances.T[piece])[-1]


def expected_pieces(trie: Pieces, words: np.ndarray, language: np.ndarray, times: np.ndarray, chances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected number of uses of each piece in each language, as a flat index (language x pieces) and numbers."""
    n, size = words.shape
    row, start, end, piece = trie.edges(words)
    at = language[row] * chances.shape[1] + piece
    weight = chances.ravel()[at][:, None]
    left = forward(n, size, row, start, end, weight)[:, :, 0]
    right = forward(n, size, row, size - end, size - start, weight)[:, :, 0]
    used = np.exp(left[start, row] + weight[:, 0] + right[size - end, row] - left[size, row]) * times[row]
    kinds, of = np.unique(at, return_inverse=True)
    return kinds, np.bincount(of, weights=used, minlength=len(kinds))


# ---------------------------------------------------------------- learning


@dataclass(frozen=True)
class Languages:
    """Names, log-probabilities of pieces (a row a language) and of the languages themselves."""

    path: str
    names: tuple[str, ...]
    chances: np.ndarray
    shares: np.ndarray


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        words = Words(pc.utf8_lower(batch.column(1)))
        language = batch.column(0).to_numpy()[words.doc].astype(np.uint64)
        _, first, times = np.unique(words.hashes() ^ language * np.uint64(0x9E3779B97F4A7C15), return_index=True, return_counts=True)
        data = words.data.tobytes()
        yield pa.RecordBatch.from_arrays(
            [pa.array(language[first].astype(np.int32)), pa.array([data[s:e] for s, e in zip(words.start[first].tolist(), words.end[first].tolist())], pa.binary()),
             pa.array(times, pa.int64())],
            ["language", "word", "times"],
        )


def _expect(batches: Iterable[pa.RecordBatch], path: str, chances: np.ndarray) -> Iterator[pa.RecordBatch]:
    trie = open_pieces(path)
    total = np.zeros(chances.size)
    for batch in batches:
        language, times = batch.column(0).to_numpy().astype(np.int64), batch.column(2).to_numpy()
        column = batch.column(1).cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
        for rows, words in by_length(offsets[:-1], offsets[1:], data):
            at, used = expected_pieces(trie, words, language[rows], times[rows], chances)
            total[at] += used
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "used"])


def smoothed(used: np.ndarray) -> np.ndarray:
    """Log-probabilities from expected uses; what all languages use is lent to each, and nothing is impossible."""
    pool = used.sum(axis=0) + 0.1
    lent = used + POOLED * pool / pool.sum()
    return np.log(lent / lent.sum(axis=1, keepdims=True))


def fit_languages(docs: DataFrame, path: str, language: str = "lang", text: str = "text", sample: int = SAMPLE) -> Languages:
    """Piece probabilities of each language that labels some text of ``docs``, by ``PASSES`` rounds of expectation
    and maximisation, each one a Spark job over the counted words of the sample.

    The sample has about ``sample`` texts a language, chosen by a hash of the text (all of them where there are no
    more); copies count once, whole texts are read.  Rows without a text or a label teach nothing.  The driver
    sees languages times pieces of the vocabulary numbers, nothing that grows with the rows; there may be at most 1000 languages.
    """
    marked = docs.where(F.col(language).isNotNull() & F.col(text).isNotNull()).select(F.col(language).cast("string").alias("name"), F.col(text).cast("string").alias("text"))
    counted = sorted((r["name"], r["rows"]) for r in marked.groupBy("name").agg(F.count("*").alias("rows")).limit(1001).collect())
    if len(counted) > 1000:
        raise ValueError("more than 1000 languages")
    names = tuple(name for name, _ in counted)
    if not names:
        return Languages(path, (), np.zeros((0, 0)), np.zeros(0))
    number = F.array_position(F.array(*map(F.lit, names)), F.col("name")) - 1
    rates = F.array(*[F.lit(min(1.0, sample / rows)) for _, rows in counted])
    h = F.xxhash64("text")
    drawn = (F.shiftrightunsigned(h, 11) / float(1 << 53)) < F.get(rates, F.col("language"))
    chosen = marked.select(number.cast("int").alias("language"), "text").where(drawn).groupBy("language", h.alias("h")).agg(F.first("text").alias("text"))
    words = stored(
        chosen.select("language", "text").mapInArrow(_count_words, "language int, word binary, times long")
        .groupBy("language", "word").agg(F.sum("times").alias("times"))
    )
    size = len(open_pieces(path).pieces)
    chances = np.full((len(names), size), -np.log(size))
    for _ in range(PASSES):
        passed = words.mapInArrow(lambda b, c=chances: _expect(b, path, c), "at long, used double")
        sums = passed.groupBy("at").agg(F.sum("used").alias("used")).toArrow()
        used = np.zeros(chances.size)
        used[sums.column("at").to_numpy()] = sums.column("used").to_numpy()
        chances = smoothed(used.reshape(chances.shape))
    shares = np.log(np.array([rows for _, rows in counted], dtype=float) / sum(rows for _, rows in counted))
    return Languages(path, names, chances, shares)


# ---------------------------------------------------------------- scoring


class Sums:
    """Log-probabilities of words under every language, kept by the words' hashes in two generations."""

    def __init__(self, model: Languages):
        self.trie, self.chances = open_pieces(model.path), model.chances
        none = np.zeros(0, dtype=np.uint64), np.zeros((0, len(model.names)))
        self.young, self.old = none, none

    @staticmethod
    def look_up(kept: tuple[np.ndarray, np.ndarray], h: np.ndarray, out: np.ndarray) -> np.ndarray:
        keys, sums = kept
        if not len(keys):
            return np.ones(len(h), dtype=bool)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        known = keys[at] == h
        out[known] = sums[at[known]]
        return ~known

    def of(self, h: np.ndarray, start: np.ndarray, end: np.ndarray, data: np.ndarray) -> np.ndarray:
        """One row per hash (sorted, distinct); the word of each lies at ``start`` to ``end`` in ``data``."""
        out = np.empty((len(h), self.chances.shape[0]))
        new = self.look_up(self.young, h, out)
        from_old = np.flatnonzero(new)
        rest = self.look_up(self.old, h[from_old], older := np.empty((len(from_old), out.shape[1])))
        out[from_old[~rest]] = older[~rest]
        missing = from_old[rest]
        for rows, words in by_length(start[missing], end[missing], data):
            out[missing[rows]] = word_sums(self.trie, words, self.chances)
        keys = np.concatenate([self.young[0], h[from_old]])
        order = np.argsort(keys, kind="stable")
        self.young = keys[order], np.concatenate([self.young[1], out[from_old]])[order]
        if len(keys) > KEPT:
            self.old, self.young = self.young, (keys[:0], out[:0])
        return out


def text_sums(texts: pa.Array, sums: Sums) -> np.ndarray:
    """Log-probability of each whole text under each language (0 for a text without words)."""
    words = Words(pc.utf8_lower(texts))
    h, first, back = np.unique(words.hashes(), return_index=True, return_inverse=True)
    per_word = sums.of(h, words.start[first], words.end[first], words.data)[back]
    out = np.zeros((words.n, per_word.shape[1]))
    some = np.flatnonzero(np.diff(words.first))
    if len(some):
        out[some] = np.add.reduceat(per_word, words.first[some], axis=0)
    return out


def _judge(batches: Iterable[pa.RecordBatch], model: Languages) -> Iterator[pa.RecordBatch]:
    sums, names = Sums(model), np.array(model.names, dtype=object)
    for batch in pieces(batches, "text"):
        level = text_sums(batch.column(1), sums) + model.shares
        best = level.argmax(axis=1)
        chance = 1 / np.exp(level - level.max(axis=1, keepdims=True)).sum(axis=1)
        silent = ~batch.column(2).to_numpy(zero_copy_only=False)
        best_names = names[best]
        best_names[silent] = UNKNOWN
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(best_names, pa.string()), pa.array(np.where(silent, 0.0, chance))], ["id", "lang_pred", "score"]
        )


def predict_languages(docs: DataFrame, model: Languages, key: str = "doc_id", text: str = "text", **also: Column) -> DataFrame:
    """One row per row: ``key``, the columns ``also``, lang_pred, score.

    score is the probability of the predicted language given the text, among the learnt ones.  A text that is null
    or has no letter, or any text where nothing was learnt, is ``und`` with a score of 0.  Equal probabilities go to the name that sorts first.
    Whole texts count; a very long word costs time and memory in proportion to its length.  Rows that share a key are
    separate rows; an empty table gives none.
    """
    if also:
        named = docs.select(F.struct(F.col(key), *[c.alias(n) for n, c in also.items()]).alias("id"), F.col(text).cast("string").alias("text"))
    else:
        named = docs.select(F.struct(F.col(key)).alias("id"), F.col(text).cast("string").alias("text"))
    source = named.select("id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    if not model.names:
        done = source.select("id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    else:
        kind = source.schema["id"].dataType.simpleString()
        done = source.mapInArrow(lambda b: _judge(b, model), f"id {kind}, lang_pred string, score double")
    return done.select("id.*", "lang_pred", "score")
