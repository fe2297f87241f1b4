"""Packing of documents into fixed-length token sequences along a space-filling curve (operator 3)."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm.tokens import word_tokens
from wattline.llm.words import Words, pieces

FEATURES, DIMENSIONS, BITS = 256, 4, 15
RANGE_BYTES, MOST_RANGES = 16 << 20, 1 << 17
SAMPLE, SAMPLE_SHARE = 1 << 14, 1 / 64  # rows whose places bound the ranges: so many, or that share, at most MOST_RANGES * 16
_PROJECT = np.random.default_rng(3).standard_normal((FEATURES, DIMENSIONS))


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``points`` (integers below 2^bits)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the turns of each level
        p = q - 1
        for i in range(n):
            turned = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & p
            x[0] = np.where(turned, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = np.where(turned, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], dtype=np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_places(texts: pa.Array) -> np.ndarray:
    """Signed hashed word counts, scaled to length one, projected to four dimensions, as curve places."""
    words = Words(texts)
    h = words.hashes()
    cell = words.doc * FEATURES + (h & np.uint64(FEATURES - 1)).astype(np.int64)
    sign = 1.0 - 2.0 * ((h >> np.uint64(20)) & np.uint64(1)).astype(np.float64)
    vectors = np.bincount(cell, weights=sign, minlength=words.n * FEATURES).reshape(words.n, FEATURES)
    norm = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    flat = vectors @ _PROJECT / np.where(norm > 0, norm, 1)
    return hilbert_keys(np.clip((flat + 4) / 8, 0, 1) * ((1 << BITS) - 1))


def _place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of (turn, text): (place, turn, bytes)."""
    for batch in pieces(batches, "text"):
        size = pc.binary_length(batch.column(1)).fill_null(0).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(curve_places(batch.column(1))), batch.column(0), size], ["place", "turn", "size"])


def range_bounds(sample: DataFrame, share: float) -> np.ndarray:
    """Least (place, turn) of every range but the first, from a sample of (place, turn, size): equal bytes in each.

    The bounds only decide how evenly tasks are loaded, never which rows there are.
    """
    rows = sample.toArrow()
    place, turn, size = (rows.column(c).to_numpy() for c in ("place", "turn", "size"))
    order = np.lexsort((turn, place))
    place, turn, ends = place[order], turn[order], np.cumsum(size[order] + 64)
    ranges = int(min(MOST_RANGES, max(1, ends[-1] / share / RANGE_BYTES), max(1, len(order) // 8))) if len(order) else 1
    cut = np.searchsorted(ends, ends[-1] * np.arange(1, ranges) / ranges) if ranges > 1 else np.zeros(0, dtype=np.int64)
    return np.unique(np.stack([place[cut], turn[cut]], axis=1), axis=0) if len(cut) else np.zeros((0, 2), dtype=np.int64)


def range_of(place: np.ndarray, turn: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The number of bounds that are not above (place, turn)."""
    low = np.searchsorted(bounds[:, 0], place, "left")
    high = np.searchsorted(bounds[:, 0], place, "right")
    out = low
    for p in np.unique(place[low < high]):  # a place of many copies may hold several bounds
        at = np.flatnonzero(place == p)
        part = slice(low[at[0]], high[at[0]])
        out[at] += np.searchsorted(bounds[part, 1], turn[at], "right")
    return out


def _deal(batches: Iterable[pa.RecordBatch], bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        place, turn = curve_places(batch.column(2)), batch.column(0).to_numpy()
        yield pa.RecordBatch.from_arrays(
            [pa.array(range_of(place, turn, bounds).astype(np.int32)), pa.array(place), *batch.columns], ["range", "place", "turn", "id", "text"]
        )


class Packer:
    """Takes documents in order and gives the pieces of every sequence that is finished."""

    def __init__(self, length: int, first: int):
        self.length, self.sequence = length, first
        self.open: list[tuple] = []
        self.filled = 0

    def add(self, key, ids: bytes) -> Iterator[tuple]:
        total, at = len(ids) // 4, 0
        while at < total:
            take = min(self.length - self.filled, total - at)
            self.open.append((key, at, ids[4 * at : 4 * (at + take)], total))
            self.filled += take
            at += take
            if self.filled == self.length:
                yield from self.close(self.length)

    def close(self, size: int) -> Iterator[tuple]:
        """One sequence of the first ``size`` ids that are held."""
        offset, rest = 0, []
        for key, start, ids, total in self.open:
            n = min(len(ids) // 4, size - offset)
            if n:
                part = ids[: 4 * n]
                yield key, start, n, zlib.crc32(part), total, self.sequence, offset, part
                offset += n
            if 4 * n < len(ids):
                rest.append((key, start + n, ids[4 * n :], total))
        self.open, self.filled = rest, self.filled - size
        self.sequence += 1

    def finish(self) -> Iterator[tuple]:
        """What is left, as sequences whose lengths are powers of two, so that none needs padding."""
        while self.filled:
            yield from self.close(1 << (self.filled.bit_length() - 1))


def _pack(batches: Iterable[pa.RecordBatch], path: str, end: int, length: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    cache = word_tokens(path, True)
    last = np.array([end], dtype="<u4").tobytes()
    packer = Packer(length, TaskContext.get().partitionId() << 40)
    kind = None

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * 8
        arrays = [pa.array(columns[0], kind)] + [pa.array(c, pa.int64()) for c in columns[1:7]]
        if with_ids:
            arrays.append(pa.array([np.frombuffer(p, dtype="<u4").astype(np.int32) for p in columns[7]], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(arrays, ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: len(arrays)])

    for batch in pieces(batches, "text"):
        kind = batch.column(1).type
        split = [cache.parts(t) if t else [] for t in batch.column(2).to_pylist()]
        found = cache.values([w for words in split for w in words])
        rows, at = [], 0
        for key, words in zip(batch.column(1).to_pylist(), split):
            ids = b"".join(found[at : at + len(words)]) + last
            at += len(words)
            rows += packer.add(key, ids)
        yield batch_of(rows)
    if packer.filled:
        yield batch_of(list(packer.finish()))


def pack_documents(
    docs: DataFrame, path: str, end: int = 2, length: int = 4096, key: str = "doc_id", text: str = "text", with_ids: bool = False,
) -> DataFrame:
    """Pieces of sequences: ``key``, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    Documents are range-sorted by Hilbert key and laid end to end in that order; every ``length`` ids make a
    sequence.  The bounds of the ranges come from the places of a bounded sample of rows; then each text is
    placed once.  Each range packs on its own and cuts its last, partial sequence into powers of two, so nothing
    is padded and no range waits for another.  A task holds one open sequence.  The ids are made after the sort,
    so each text is encoded once and only texts are shuffled.

    A document is the tokenizer's ids of its text (null: empty) and the id ``end``.  Rows that share a key are
    separate documents, equal rows as well; copies have one curve place and are dealt out by a hash of the row's
    place in the table, so no number of them must meet in one range.  Rows in one range are in an order that their contents
    fix.  Texts of any length are cut freely; columns other than ``key`` and ``text`` are not looked at.  An empty table gives no rows.
    """
    kind = docs.schema[key].dataType.simpleString()
    turn = F.xxhash64(F.monotonically_increasing_id()).alias("turn")
    source = docs.select(turn, F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    rows = docs.count()
    share = min(1.0, max(SAMPLE / max(rows, 1), min(SAMPLE_SHARE, 16 * MOST_RANGES / max(rows, 1))))
    drawn = source.select("turn", "text")
    if share < 1:
        drawn = drawn.where(F.pmod(F.col("turn"), F.lit(1 << 30)) < int(share * (1 << 30)))
    bounds = range_bounds(drawn.mapInArrow(_place, "place long, turn long, size long"), share)
    dealt = source.mapInArrow(lambda b: _deal(b, bounds), f"range int, place long, turn long, id {kind}, text string")
    ranged = dealt.repartitionById(len(bounds) + 1, F.col("range")).select("place", "id", "text")
    ranged = ranged.sortWithinPartitions("place", "id", F.xxhash64("text"))
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    packed = ranged.mapInArrow(lambda b: _pack(b, path, end, length, with_ids), schema + (", ids array<int>" if with_ids else ""))
    return packed.withColumnRenamed("id", key)
