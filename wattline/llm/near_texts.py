"""Near-duplicate texts by an inverted join of MinHash signature coordinates (operator 7)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm.rows import Joined, components, runs
from wattline.llm.words import Words, mix, pieces, run_hashes
from wattline.session import stored

POSTED, SIGNATURE = 32, 128
BLOCK, BLOCK_SHINGLES = 256, 4_000_000
_RNG = np.random.default_rng(7)
_XOR = _RNG.integers(0, 1 << 63, SIGNATURE, dtype=np.uint64)
_MUL = _RNG.integers(0, 1 << 63, SIGNATURE, dtype=np.uint64) | np.uint64(1)


def shingle_sets(texts: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and where each text's begin: text i has ``first[i]:first[i + 1]``."""
    words = Words(texts, lower=True)
    values = words.hashes()
    last = max(0, len(values) - width + 1)
    at = np.flatnonzero(words.doc[:last] == words.doc[width - 1 :]) if last else np.zeros(0, dtype=np.int64)
    hashes, docs = [run_hashes(values, width)[at]], [words.doc[at]]
    counts = np.diff(words.first)
    for n in range(1, width):
        short = np.flatnonzero(counts == n)
        if len(short):
            hashes.append(run_hashes(values, n, 11 + n)[words.first[short]])
            docs.append(short)
    h, d = np.concatenate(hashes), np.concatenate(docs)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[new], d[new]
    return h, np.searchsorted(d, np.arange(words.n + 1))


def signatures(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the texts with shingles: their numbers, 128-bit fingerprints of the sets, minima (texts x SIGNATURE)."""
    full = np.flatnonzero(np.diff(first))
    at = first[full]
    if not len(full):
        return full, np.zeros((0, 2), dtype=np.uint64), np.zeros((0, SIGNATURE), dtype=np.uint64)
    marks = np.stack([np.add.reduceat(mix(h, 1), at), np.add.reduceat(mix(h, 2), at)], axis=1)
    minima = np.empty((len(full), SIGNATURE), dtype=np.uint64)
    for k in range(SIGNATURE):
        minima[:, k] = np.minimum.reduceat((h ^ _XOR[k]) * _MUL[k], at)
    return full, marks, minima


def _sign(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    coordinate = np.arange(POSTED, dtype=np.int64) << 32
    for batch in pieces(batches, "text"):
        h, first = shingle_sets(batch.column(1), width)
        full, marks, minima = signatures(h, first)
        posted = (minima[:, :POSTED] >> np.uint64(32)).astype(np.int64) | coordinate
        small = (minima >> np.uint64(56)).astype(np.uint8)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1, dtype=np.int32) * POSTED), pa.array(posted.ravel()))
        at = np.full(batch.num_rows, -1, dtype=np.int64)
        at[full] = np.arange(len(full))
        take = pa.array(at, mask=at < 0)  # texts without words have none of the three
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.diff(first), pa.int64()), _packed(marks.view(np.uint8)).take(take), lists.take(take),
             _packed(small).take(take), batch.column(2)],
            ["id", "n", "mark", "keys", "sig", "place"],
        )


def _packed(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def _sets(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        h, first = shingle_sets(batch.column(0), width)
        full, marks, _ = signatures(h, first)
        wanted = batch.column(1).to_pylist()
        rows = [(m.tobytes(), h[first[i] : first[i + 1]].tobytes()) for i, m in zip(full.tolist(), marks) if m.tobytes() == wanted[i]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["mark", "shingles"]
        )


def _bytes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -1)


def _alike(batches: Iterable[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures agree in at least ``least`` coordinates."""
    for batch in batches:
        if batch.num_rows:
            same = (_bytes(batch.column(2)) == _bytes(batch.column(3))).sum(axis=1) >= least
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(same))


def _confirm(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        linked = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            linked.append(100 * both >= percent * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(linked, pa.bool_()))


def _candidates(table: pa.Table, least: int, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each member of a block pair the later ones it must be compared with: of another component, alike in size
    and signature, and with this hub as their first common one."""
    mark, hub = table.column("mark").to_pylist(), table.column("hub").to_pylist()
    component = np.unique(table.column("component").to_pylist(), return_inverse=True)[1]
    group = np.unique(hub, return_inverse=True)[1]
    sig = _bytes(table.column("sig"))
    n, block, low, high = (table.column(c).to_numpy() for c in ("n", "block", "low", "high"))
    hubs = [set(x) for x in table.column("hubs").to_pylist()]
    for i in range(len(mark) - 1):
        j = np.arange(i + 1, len(mark))
        ok = (component[j] != component[i]) & (group[j] == group[i])
        ok &= (low[i] == high[i]) | (block[j] != block[i])
        ok &= 100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i])
        j = j[ok]
        if len(j):
            j = j[(sig[j] == sig[i]).sum(axis=1) >= least]
        j = np.array([x for x in j.tolist() if min(hubs[i] & hubs[x]) == hub[i]], dtype=np.int64)
        if len(j):
            yield i, j


def _doubtful(batches: Iterable[pa.RecordBatch], least: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Members of a hub's group with at least one candidate: (hub, mark), once for a block pair."""
    for table in runs(batches, "slot"):
        some = np.zeros(table.num_rows, dtype=bool)
        for i, j in _candidates(table, least, percent):
            some[i] = True
            some[j] = True
        if some.any():
            yield from table.select(["hub", "mark"]).filter(pa.array(some)).combine_chunks().to_batches()


def _links(batches: Iterable[pa.RecordBatch], least: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Candidates confirmed on their full sets; of the links of a block pair, those that are needed to connect the same."""
    for table in runs(batches, "slot"):
        mark = table.column("mark").to_pylist()
        sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in table.column("shingles")]
        size = np.array([len(s) for s in sets])
        joined = Joined()
        for i, j in _candidates(table, least, percent):
            every = np.concatenate([sets[x] for x in j])
            at = np.minimum(np.searchsorted(sets[i], every), size[i] - 1)
            both = np.add.reduceat((sets[i][at] == every).astype(np.int64), np.cumsum(size[j]) - size[j])
            for x in j[100 * both >= percent * (size[i] + size[j] - both)].tolist():
                joined.add(mark[i], mark[x])
        if joined.links:
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in joined.links], pa.binary()) for k in (0, 1)], ["a", "b"])


def near_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85, width: int = 5) -> DataFrame:
    """One row per row of ``docs``: ``key``, n_shingles, component_id, kept.

    Texts with one shingle set are one node.  A node posts its 32 signature values; a node that agrees with
    another in at least ``t`` of them shares one of its 33 - t rarest (the prefix), so only those stay in the
    inverted lists.  Values that occur once need no list, which empties most prefixes.  Pairs of a list are
    then judged by all 128 coordinates (the skip: no other list is read) and confirmed on the full sets.
    Both thresholds lie over four standard deviations below the expected matches at ``percent``.

    A list may be very long, so not all its pairs are looked at: every node is first compared with the list's
    hub, its most central node (largest sum of list lengths), and the links are contracted to components.  Then
    only pairs of different components that share a hub are compared, inside tasks: in blocks of 256 nodes first
    by signature, then, for the nodes with candidates left, on their full sets.  Nodes that share a list share
    its hub, so no link between components is lost; what is written grows with the nodes of a family, not
    with its pairs.

    No words or null text: n_shingles 0, component of its own.  A null key has a null component and is kept
    unless a row with a key is in its component.  Rows that share a key are separate rows.
    """
    def threshold(total: int, deviations: float) -> int:
        p = percent / 100
        return max(1, ceil(total * p - deviations * sqrt(total * p * (1 - p))))

    few, most = threshold(POSTED, 4.6), threshold(SIGNATURE, 4.3)
    free = POSTED - few  # matches may be missing in so many coordinates
    column = F.col(text).cast("string")
    source = docs.select(F.col(key).alias("id"), column.alias("text"), F.xxhash64(column).alias("place"))
    kind = docs.schema[key].dataType.simpleString()
    rows = stored(source.mapInArrow(lambda b: _sign(b, width), f"id {kind}, n long, mark binary, keys array<long>, sig binary, place long"))

    nodes = (
        rows.where("mark IS NOT NULL").groupBy("mark")
        .agg(F.first(F.struct("n", "keys", "sig", "place")).alias("x")).select("mark", "x.*")
    )
    nodes = stored(nodes)
    posts = nodes.select("mark", F.explode("keys").alias("key"))
    lengths = posts.groupBy("key").agg(F.count("*").alias("length")).where("length > 1")
    shared = posts.join(lengths, "key").groupBy("mark").agg(
        F.sort_array(F.collect_list(F.struct("length", "key"))).alias("lists"), F.sum("length").alias("weight")
    )
    take = F.size("lists") - (POSTED - (free + 1))
    active = stored(
        shared.where(take > 0).select("mark", "weight", F.slice("lists", 1, take)["key"].alias("prefix"))
        .join(nodes.select("mark", "n", "sig", "place"), "mark")
    )
    lists = active.select("mark", "weight", F.explode("prefix").alias("key"))

    wanted = active.groupBy("place").agg(F.first("mark").alias("mark"))
    sets = stored(
        source.select("text", "place").join(wanted, "place").select("text", "mark")
        .mapInArrow(lambda b: _sets(b, width), "mark binary, shingles binary")
        .groupBy("mark").agg(F.first("shingles").alias("shingles"))
    )

    def confirmed(pairs: DataFrame) -> DataFrame:
        return (
            pairs.join(sets.select(F.col("mark").alias("a"), F.col("shingles").alias("x")), "a")
            .join(sets.select(F.col("mark").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")
            .mapInArrow(lambda b: _confirm(b, percent), "a binary, b binary")
        )

    hubs = lists.groupBy("key").agg(F.max(F.struct("weight", "mark"))["mark"].alias("hub"))
    groups = stored(lists.join(hubs, "key").select("mark", "hub").distinct())
    stars = groups.where("mark != hub").select(F.least("mark", "hub").alias("a"), F.greatest("mark", "hub").alias("b")).distinct()
    left = active.select(F.col("mark").alias("a"), F.col("n").alias("n1"), F.col("sig").alias("s1"))
    right = active.select(F.col("mark").alias("b"), F.col("n").alias("n2"), F.col("sig").alias("s2"))
    stars = (
        stars.join(left, "a").join(right, "b").where(F.lit(100) * F.least("n1", "n2") >= F.lit(percent) * F.greatest("n1", "n2"))
        .select("a", "b", "s1", "s2").mapInArrow(lambda b: _alike(b, most), "a binary, b binary")
    )
    links = stored(confirmed(stars))
    found = components(links)

    member = stored(
        active.select("mark", "n", "sig").join(groups.groupBy("mark").agg(F.sort_array(F.collect_list("hub")).alias("hubs")), "mark")
        .join(found.withColumnRenamed("node", "mark"), "mark", "left")
        .select("mark", "n", "sig", "hubs", F.coalesce("component", "mark").alias("component"))
    )

    def in_blocks(pairs: DataFrame, info: DataFrame) -> DataFrame:
        """Rows (mark, hub) with their node's columns, for every pair of blocks of a hub whose components differ."""
        mixed = pairs.join(info.select("mark", "n", "component"), "mark").groupBy("hub").agg(
            F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"),
            F.min("component").alias("p"), F.max("component").alias("q"),
        )
        dealt = (
            pairs.join(mixed.where("p != q").select("hub", "blocks"), "hub").join(info, "mark")
            .withColumn("block", F.pmod(F.xxhash64("mark"), F.col("blocks")))
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
            .withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
            .withColumn("slot", F.xxhash64("hub", "low", "high"))
        )
        return dealt.select("slot", "hub", "mark", "n", "sig", "hubs", "component", "block", "low", "high")

    near = in_blocks(groups, member).repartition("slot").sortWithinPartitions("slot")
    doubtful = stored(near.mapInArrow(lambda b: _doubtful(b, most, percent), "hub binary, mark binary").distinct())
    rest = in_blocks(doubtful, member).join(sets, "mark").repartition("slot").sortWithinPartitions("slot")
    more = stored(rest.mapInArrow(lambda b: _links(b, most, percent), "a binary, b binary"))
    if not more.isEmpty():
        found = components(links.union(more))

    named = rows.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "mark").join(
        found.withColumnRenamed("node", "mark"), "mark", "left"
    ).withColumn("component", F.coalesce("component", "mark"))
    smallest = named.where("component IS NOT NULL").groupBy("component").agg(F.min(key).alias("component_id"))
    out = named.join(smallest, "component", "left")
    component = F.when(F.col("component").isNull(), F.col(key)).otherwise(F.col("component_id"))
    return out.select(key, "n_shingles", component.alias("component_id"), F.col(key).eqNullSafe(component).alias("kept"))
