"""Removal of word windows that occur more than once in a corpus (operator 2)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.llm.rows import carried, spread, text_bytes
from wattline.llm.words import Words, give_back, run_hashes

KEY_BYTES = 10
BATCH, BUCKET_BYTES = 2 << 20, 8 << 20


def window_keys(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, 64-bit hash and 16 more bits of every window that lies in one text."""
    at = np.flatnonzero(words.doc[: max(0, len(words.doc) - window + 1)] == words.doc[window - 1 :])
    values = words.hashes()
    return at, run_hashes(values, window)[at], run_hashes(values, window, 7)[at].astype(np.uint16)


def distinct_keys(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, whether each occurs again, and every window's place among them."""
    order = np.lexsort((low, high))
    h, lo = high[order], low[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (lo[1:] != lo[:-1])
    place = np.empty(len(h), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return h[first], lo[first], np.diff(np.append(first, len(h))) > 1, place


def covered(starts: np.ndarray, window: int, n: int) -> np.ndarray:
    """Which of n words lie in a window beginning at one of ``starts``."""
    step = np.bincount(starts, minlength=n + 1) - np.bincount(starts + window, minlength=n + 1)
    return np.cumsum(step[:n]) > 0


def kept_texts(words: Words, removed: np.ndarray) -> pa.Array:
    """The words that stay, joined by one space, as one string for each text."""
    stay = ~removed
    start, end = words.start[stay], words.end[stay]
    sizes = end - start + 1
    offsets = np.zeros(len(start) + 1, dtype=np.int64)
    np.cumsum(sizes, out=offsets[1:])
    out = np.full(offsets[-1], 32, dtype=np.uint8)
    cells = np.zeros(len(words.data) + 1, dtype=np.int8)
    cells[start] += 1
    cells[end] -= 1
    inside = np.cumsum(cells[:-1], dtype=np.int8).astype(bool)
    target = np.ones(offsets[-1], dtype=bool)
    target[offsets[1:] - 1] = False
    out[target] = words.data[inside]
    counts = np.bincount(words.doc[stay], minlength=words.n)
    ends = offsets[np.cumsum(counts)]
    begins = offsets[np.cumsum(counts) - counts]
    # drop the space behind each text's last word
    solid = np.ones(offsets[-1], dtype=bool)
    solid[ends[counts > 0] - 1] = False
    lengths = np.where(counts > 0, ends - begins - 1, 0)
    bounds = np.zeros(words.n + 1, dtype=np.int64)
    np.cumsum(lengths, out=bounds[1:])
    return pa.LargeStringArray.from_buffers(words.n, pa.py_buffer(bounds), pa.py_buffer(out[solid].tobytes()))


def intervals(words: Words, removed: np.ndarray) -> pa.Array:
    """Maximal runs of removed words of each text: [start, end) in words of that text."""
    n = len(removed)
    edge = np.zeros(n + 1, dtype=bool)
    edge[words.first] = True
    before = np.append(False, removed[:-1])
    after = np.append(removed[1:], False)
    start = np.flatnonzero(removed & (~before | edge[:n]))
    end = np.flatnonzero(removed & (~after | edge[1:])) + 1
    doc = words.doc[start]
    counts = np.zeros(words.n + 1, dtype=np.int32)
    np.cumsum(np.bincount(doc, minlength=words.n), out=counts[1:])
    spans = pa.StructArray.from_arrays([pa.array(start - words.first[doc]), pa.array(end - words.first[doc])], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(counts), spans)


def _text(table: pa.Table, text: str) -> pa.Array:
    rows = table.column("row").chunks
    found = [pc.struct_field(x, [text]).cast(pa.large_string()) for x in rows]
    return pa.concat_arrays(found) if found else pa.array([], pa.large_string())


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 35) -> DataFrame:
    """All rows and columns of ``docs`` with n_words, n_removed, spans (removed word intervals) and kept_text.

    A window is ``window`` consecutive words of one text; each word in a window whose words also begin
    anywhere else is removed, judged on the input.  The texts are dealt into chunks of about 2 MB by a
    hash of the row's place in the table, so no number of equal rows meets in one chunk.
    A chunk sends each distinct window key (80 bits) once, packed by key range; each range counts its keys
    over all chunks, and one bit a key goes back to the chunk, where repeated windows merge into maximal
    intervals.  A window that fills a third of the corpus is still one key a chunk.  Both numbers of groups
    grow with the bytes, so a group stays small.

    A null or empty text has no words (0, 0, no spans, empty kept_text); a text shorter than the window is
    kept; equal rows repeat each other.  Results replace input columns of the same name.  ``docs`` must give its rows
    in the same partitions whenever it is read (as files and stored tables do): a chunk that finds other windows than it sent is an error.
    """
    names = docs.columns
    size = text_bytes(docs, text)
    chunks = max(1, -(-size // BATCH))
    ranges = 1
    while ranges * BUCKET_BYTES < size * 2:
        ranges *= 2
    bits = ranges.bit_length() - 1
    dealt = carried(docs, chunk=F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(chunks)))

    def bucket_of(high: np.ndarray) -> np.ndarray:
        return (high >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(high), dtype=np.int64)

    def send(key: tuple, table: pa.Table) -> pa.Table:
        words = Words(_text(table, text))
        _, high, low = window_keys(words, window)
        high, low, again, _ = distinct_keys(high, low)
        bounds = np.searchsorted(bucket_of(high), np.arange(ranges + 1))
        full = np.flatnonzero(np.diff(bounds))
        part = [(bounds[b], bounds[b + 1]) for b in full]
        return pa.table({
            "bucket": pa.array(full, pa.int64()),
            "chunk": pa.array([key[0].as_py()] * len(full), pa.int64()),
            "high": pa.array([high[s:e].tobytes() for s, e in part], pa.binary()),
            "low": pa.array([low[s:e].tobytes() for s, e in part], pa.binary()),
            "again": pa.array([np.packbits(again[s:e]).tobytes() for s, e in part], pa.binary()),
        })

    def count(table: pa.Table) -> pa.Table:
        rows = table.select(["high", "low", "again"]).to_pydict()
        high = [np.frombuffer(x, dtype=np.uint64) for x in rows["high"]]
        sizes = [len(x) for x in high]
        again = np.concatenate([np.unpackbits(np.frombuffer(x, dtype=np.uint8), count=n) for x, n in zip(rows["again"], sizes)])
        _, _, several, place = distinct_keys(np.concatenate(high), np.frombuffer(b"".join(rows["low"]), dtype=np.uint16))
        several[place[again.astype(bool)]] = True
        flags = np.split(several[place], np.cumsum(sizes)[:-1])
        return pa.table({
            "chunk": table.column("chunk"), "bucket": table.column("bucket"),
            "flags": pa.array([np.packbits(x).tobytes() for x in flags], pa.binary()),
            "mark": pa.array([int(np.bitwise_xor.reduce(x).view(np.int64)) for x in high], pa.int64()),
        })

    def cut(texts: pa.Table, flags: pa.Table) -> pa.Table:
        words = Words(_text(texts, text))
        at, high, low = window_keys(words, window)
        high, low, _, place = distinct_keys(high, low)
        buckets = bucket_of(high)
        sizes = np.bincount(buckets, minlength=ranges)
        first = np.cumsum(sizes) - sizes
        known = sorted(zip(*(flags.column(c).to_pylist() for c in ("bucket", "flags"))))
        sent = dict(zip(flags.column("bucket").to_pylist(), flags.column("mark").to_pylist()))
        if {b: int(np.bitwise_xor.reduce(high[first[b] : first[b] + sizes[b]]).view(np.int64)) for b in np.unique(buckets).tolist()} != sent:
            raise RuntimeError("the rows of a chunk changed between two readings of the table: store it first")
        repeated = np.concatenate(
            [np.zeros(0, dtype=bool)]
            + [np.unpackbits(np.frombuffer(x, dtype=np.uint8), count=sizes[b]).astype(bool) for b, x in known]
        )
        removed = covered(at[repeated[place]], window, len(words.doc))
        give_back()
        return pa.table({
            "row": texts.column("row"),
            "n_words": pa.array(np.diff(words.first), pa.int64()),
            "n_removed": pa.array(np.bincount(words.doc[removed], minlength=words.n), pa.int64()),
            "spans": intervals(words, removed),
            "kept_text": kept_texts(words, removed).cast(pa.string()),
        })

    sent = dealt.groupBy("chunk").applyInArrow(send, "bucket long, chunk long, high binary, low binary, again binary")
    told = sent.groupBy("bucket").applyInArrow(count, "chunk long, bucket long, flags binary, mark long")
    kind = T.StructType([
        T.StructField("row", docs.schema), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("kept_text", T.StringType()),
    ])
    out = dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(cut, kind)
    return spread(out, names, ["n_words", "n_removed", "spans", "kept_text"])
