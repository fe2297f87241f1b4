"""Text quality by Bradley-Terry ranking of preference pairs (operator 4)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm.rows import spread, with_text
from wattline.llm.words import Words, pieces, run_hashes

SAMPLE, PAIRS = 20_000, 20_000
KNOTS = (0.02, 0.1, 0.25, 0.5, 0.75, 0.9, 0.98)
_CLASS = np.zeros(256, dtype=np.int64)  # 0 lower-case letters and the rest of ASCII
for _n, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;'\"-", b"!?", b"#$%&*+/<=>@\\^_`{}~", b"|", b"\n", b" \t\r:()[]"), 1):
    _CLASS[list(_chars)] = _n
_CLASS[128:] = 9
CLASSES = 10


def features(texts: pa.Array) -> np.ndarray:
    """One row of numbers for each whole text: sizes, character classes, repetition.  Empty text: zeros."""
    words = Words(texts)
    n, data = words.n, words.data
    sizes = np.diff(words.offsets)
    counts = np.diff(words.first)
    some = np.maximum(counts, 1)
    doc = np.repeat(np.arange(n, dtype=np.int64), sizes)
    shares = np.bincount(doc * CLASSES + _CLASS[data], minlength=n * CLASSES).reshape(n, CLASSES) / np.maximum(sizes, 1)[:, None]
    h = words.hashes()

    def distinct(values: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((values, of))
        v, d = values[order], of[order]
        new = np.ones(len(v), dtype=bool)
        new[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
        first = np.flatnonzero(new)
        most = np.zeros(n)
        np.maximum.at(most, d[first], np.diff(np.append(first, len(v))))
        return np.bincount(d[first], minlength=n), most

    kinds, most = distinct(h, words.doc)
    same = np.bincount(words.doc[1:][(h[1:] == h[:-1]) & (words.doc[1:] == words.doc[:-1])], minlength=n)
    threes = np.flatnonzero(words.doc[: max(0, len(h) - 2)] == words.doc[2:])
    three_kinds, _ = distinct(run_hashes(h, 3)[threes], words.doc[threes])
    three_all = np.bincount(words.doc[threes], minlength=n)
    length = (words.end - words.start).astype(np.float64)
    first_byte, last_byte = data[words.start], data[words.end - 1]
    odd_end = np.isin(_CLASS[last_byte], (4, 5, 6))
    upper = (_CLASS[first_byte] == 1) & (np.add.reduceat(_CLASS[data] == 1, words.start) * 2 > length if len(length) else False)
    per_word = [
        np.bincount(words.doc, weights=w, minlength=n) / some
        for w in (length, length * length, odd_end.astype(float), upper.astype(float), (length <= 2).astype(float), (length >= 14).astype(float))
    ]
    lines = np.bincount(doc[data == 10], minlength=n) + 1
    columns = [
        np.log1p(counts), np.log1p(sizes), kinds / some, np.log1p(kinds), most / some, same / some,
        three_kinds / np.maximum(three_all, 1), per_word[0], np.sqrt(np.maximum(per_word[1] - per_word[0] ** 2, 0)), *per_word[2:],
        np.log1p(counts / lines), *shares.T,
    ]
    out = np.stack(columns, axis=1).astype(np.float64)
    out[counts == 0] = 0
    return out


@dataclass(frozen=True)
class Ranker:
    """Bradley-Terry strengths: score = expanded features x weights; ``slope`` and ``shift`` turn a score into
    the chance of label 1 (``level`` is that before the logistic curve); ``good`` and ``bad`` hold the sorted levels
    of the labelled texts."""

    mean: np.ndarray
    scale: np.ndarray
    knots: np.ndarray
    weights: np.ndarray
    slope: float
    shift: float
    good: np.ndarray
    bad: np.ndarray

    def level(self, x: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(x), self.shift)
        return self.slope * (expanded(x, self.mean, self.scale, self.knots) @ self.weights) + self.shift

    def chances(self, x: np.ndarray) -> np.ndarray:
        return chance(self.level(x))

    def threshold(self, share: float) -> float:
        """Least chance to keep: below it lie at most ``share`` of the labelled good texts (a quantile of their scores).

        Where that quantile lies above all but ``share`` of the bad ones, half way between the two, so that good
        texts unlike the sample have room.  Without good texts 0.
        """
        if not len(self.good):
            return 0.0
        low = float(np.quantile(self.good, share))
        if len(self.bad):
            high = float(np.quantile(self.bad, 1 - share))
            low = min(low, (low + high) / 2) if high < low else low
        else:
            low = float("-inf")
        return float(chance(np.array([low]))[0]) if np.isfinite(low) else 0.0


def chance(level: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(level, -40, 40)))


def expanded(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """Standardised features and their hinges at the knots."""
    z = np.clip((x - mean) / scale, -8, 8)
    return np.concatenate([z] + [np.maximum(z - k, 0) for k in knots], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 12, bias: bool = False) -> np.ndarray:
    """Newton steps on the logistic loss with a ridge; ``bias`` leaves the last weight free of it."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    if bias:
        penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        gradient = x.T @ (p - y) + penalty * w
        curve = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, gradient)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_pairs(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = 4) -> Ranker:
    """Strengths from ``pairs`` preferences, each a good text over a bad one, drawn evenly from both."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):  # nothing to prefer: the share of good ones is all there is to say
        rate = (len(good) + 1) / (len(good) + len(bad) + 2)
        none = np.zeros(0)
        return Ranker(none, none, none, none, 0.0, float(np.log(rate / (1 - rate))), none, none)
    mean, scale = x.mean(axis=0), np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1.0)
    z = np.clip((x - mean) / scale, -8, 8)
    knots = np.quantile(z, KNOTS, axis=0)
    rng = np.random.default_rng(seed)
    n = min(pairs, len(good) * len(bad))
    wide = expanded(x, mean, scale, knots)
    gap = wide[rng.permutation(np.resize(good, n))] - wide[rng.permutation(np.resize(bad, n))]
    weights = logistic(gap, np.ones(n), ridge=1.0)
    score = wide @ weights
    slope, shift = logistic(np.stack([score, np.ones(len(score))], axis=1), y.astype(float), ridge=1e-3, bias=True)
    level = slope * score + shift
    return Ranker(mean, scale, knots, weights, float(slope), float(shift), np.sort(level[good]), np.sort(level[bad]))


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        x = features(batch.column(1))
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), flat], ["id", "x"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def text_features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(_features, f"id {kind}, x array<double>")


def labelled_sample(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", sample: int = SAMPLE,
) -> DataFrame:
    """The rows of ``docs`` that :func:`fit_ranker` could learn from: those of the ``sample`` labelled keys that come first
    by a hash.  Only keys are compared with the labels; at most ``sample`` keys are sent to the rows."""
    marked = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(key).distinct()
    first = marked.join(docs.select(key), key, "left_semi").orderBy(F.xxhash64(key), key).limit(sample)
    return docs.join(F.broadcast(first), key, "left_semi")


def fit_ranker(measured: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> Ranker:
    """Strengths learnt from at most ``sample`` labelled rows, first by a hash of their key.

    ``measured`` comes from :func:`text_features`; labels other than 0 and 1 are no labels, of several the
    largest counts.  Only the sample's numbers reach the driver.
    """
    marked = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("id")).agg(F.max(label).cast("int").alias("y"))
    rows = measured.join(marked, "id").orderBy(F.xxhash64("id"), "id", "x").limit(sample).select("x", "y").toArrow()
    if not rows.num_rows:
        return fit_pairs(np.zeros((0, 1)), np.zeros(0))
    x = _matrix(rows.column("x").combine_chunks())
    return fit_pairs(x, rows.column("y").to_numpy())


def score_measured(measured: DataFrame, ranker: Ranker) -> DataFrame:
    """``measured`` rows as (id, score): the chance of label 1."""
    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ranker.chances(_matrix(batch.column(1))))], ["id", "score"])

    kind = measured.schema["id"].dataType.simpleString()
    return measured.mapInArrow(judge, f"id {kind}, score double")


def score_texts(docs: DataFrame, ranker: Ranker, text: str = "text") -> DataFrame:
    """``docs`` with a column score (0 to 1) for every row; null and empty texts have the features of no words."""
    from pyspark.sql import types as T

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(with_text(batches, text), "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ranker.chances(features(batch.column(1))))], ["row", "score"])

    kind = T.StructType([T.StructField("row", docs.schema)]).add("score", "double")
    return spread(docs.select(F.struct("*").alias("row")).mapInArrow(judge, kind), docs.columns, ["score"])
