"""N best segmentations of texts over the pieces of a SentencePiece model, and decoding (operator 9).

The score of a segmentation is the sum of its pieces' scores in the model file.  A forward Viterbi pass gives
the best score of every prefix; it is the exact remaining cost of a search that walks back from the end, so
A-star pops complete segmentations best first and never has to reconsider one.

No piece crosses from the end of a word into white space, so the lattice of a text falls apart into units
between such places.  A unit's best score and the gap to its second (forward and backward scores give both at once)
are kept for the distinct units met last, and found for many new ones of like length at once; the N best of a text
differ from its best one only in the N - 1 units with the smallest gaps, so only those are searched for N, and their
lists are merged.  A batch's units are cut, told apart, looked up and put together as arrays.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from heapq import heappop, heappush, nsmallest
from itertools import chain, product
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm.words import pieces

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
KEPT_UNITS = 800_000
KEPT_LENGTH = 1000  # longer units are not kept
ONLY_PREFIX = float("inf")
# units of at most LONG code points are searched together, FEW or more of lengths within STEP, as many as a table of GRID entries holds
LONG, STEP, FEW, GRID = 64, 4, 8, 1 << 18
SPELLED = 1 << 18  # ids spelled at once


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all spans, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class Trie:
    """Pieces by their code points; the edges are an open hash table."""

    def __init__(self, scores: dict[str, float], ids: dict[str, int]):
        edges: dict[int, int] = {}
        ends: list[str | None] = [None]
        for piece in scores:
            node = 0
            for c in map(ord, piece):
                child = edges.setdefault(node << 21 | c, len(ends))
                if child == len(ends):
                    ends.append(None)
                node = child
            ends[node] = piece
        self.whole = np.array([p is not None for p in ends])
        self.score = np.array([scores.get(p, 0.0) for p in ends])
        self.id = np.array([ids.get(p, -1) for p in ends], dtype=np.int32)
        self.first = np.full(0x110000, -1, dtype=np.int32)  # children of the root
        for edge, child in edges.items():
            if edge < 1 << 21:
                self.first[edge] = child
        self.inner = np.zeros(len(ends), dtype=bool)
        self.inner[[edge >> 21 for edge in edges]] = True
        self.bits = (2 * len(edges) + 4).bit_length()
        self.key = np.full(1 << self.bits, -1, dtype=np.int64)
        self.child = np.full(1 << self.bits, -1, dtype=np.int32)
        keys, children = np.array(list(edges), dtype=np.int64), np.array(list(edges.values()), dtype=np.int32)
        slot = self.slot(keys)
        while len(keys):  # of those that want one slot the first gets it, the others move on
            _, first = np.unique(slot, return_index=True)
            first = first[self.key[slot[first]] < 0]
            self.key[slot[first]], self.child[slot[first]] = keys[first], children[first]
            rest = np.ones(len(keys), dtype=bool)
            rest[first] = False
            keys, children, slot = keys[rest], children[rest], (slot[rest] + 1) & (len(self.key) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, nodes: np.ndarray, points: np.ndarray) -> np.ndarray:
        """The child of each node by a code point, -1 where it has none."""
        keys = nodes.astype(np.int64) << 21 | points
        slot = self.slot(keys)
        here = self.key[slot]
        out = np.where(here == keys, self.child[slot], -1)
        open_ = np.flatnonzero((here != keys) & (here >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.key) - 1)
            here = self.key[slot[open_]]
            hit = here == keys[open_]
            out[open_[hit]] = self.child[slot[open_[hit]]]
            open_ = open_[~hit & (here >= 0)]
        return out


class Found:
    """Best score, gap and ids of units, by number; the number of a kept unit is in ``row``."""

    def __init__(self, units: int = 1 << 12):
        self.row: dict[str, int] = {}
        self.n = self.used = 0
        self.best, self.gap = np.empty(units), np.empty(units)
        self.start, self.size = np.empty(units, dtype=np.int64), np.empty(units, dtype=np.int32)
        self.ids = np.empty(4 * units, dtype="<u4")

    @staticmethod
    def _grown(kept: np.ndarray, size: int) -> np.ndarray:
        out = np.empty(max(size, len(kept) * 3 // 2), dtype=kept.dtype)
        out[: len(kept)] = kept
        return out

    def add(self, best: np.ndarray, gap: np.ndarray, size: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The numbers of units whose ids stand one after the other."""
        n, used = self.n + len(best), self.used + len(ids)
        if n > len(self.best):
            self.best, self.gap, self.start, self.size = (self._grown(c, n) for c in (self.best, self.gap, self.start, self.size))
        if used > len(self.ids):
            self.ids = self._grown(self.ids, used)
        self.best[self.n : n], self.gap[self.n : n], self.size[self.n : n] = best, gap, size
        self.start[self.n : n] = self.used + np.cumsum(size) - size
        self.ids[self.used : used] = ids
        numbers = np.arange(self.n, n)
        self.n, self.used = n, used
        return numbers

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        size = self.size[rows].astype(np.int64)
        return self.best[rows], self.gap[rows], size, self.ids[spans(self.start[rows], size)]

    def rows(self, units: Sequence[str]) -> np.ndarray:
        get = self.row.get
        return np.fromiter([get(u, -1) for u in units], dtype=np.int64, count=len(units))


class Lattice:
    """Pieces and scores of one vocabulary.  A character without a piece is spelled by its bytes, at the lowest
    score minus ten, as unknown characters are."""

    def __init__(self, scores: dict[str, float], ids: dict[str, int], byte_ids: list[int], dummy: bool = True):
        self.scores, self.ids, self.byte_ids, self.dummy = scores, ids, byte_ids, dummy
        self.longest = max(map(len, scores), default=1)
        self.unknown = min((s for s in scores.values() if s > -1e8), default=0.0) - UNKNOWN_PENALTY
        self.units = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
        if any(re.search(f"[^{SPACE}]{SPACE}|.\n|\n.", p, re.S) for p in scores):
            raise ValueError("a piece crosses from a word into white space")
        # scores of pieces, and a mark for texts with which only longer pieces begin
        self.known = {p[:i]: ONLY_PREFIX for p in scores for i in range(1, len(p))} | scores
        self.id_bytes = {p: int(i).to_bytes(4, "little") for p, i in ids.items()}
        # pure values of the units met last, most of them in two generations
        self.trie = Trie(scores, ids)
        self.rooms: dict[str, np.ndarray] = {}
        self.young, self.old = Found(), Found()
        self.top = lru_cache(KEPT_UNITS // 20)(self._top)
        self.listed = lru_cache(KEPT_UNITS // 20)(self.best)
        self.spelling: list[bytes] | None = None
        self.spelled: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    @classmethod
    def load(cls, path: str) -> Lattice:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        scores, ids, byte_ids = {}, {}, [0] * 256
        spelling = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                spelling.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                spelling.append(b"")
            else:
                scores[piece], ids[piece] = model.get_score(i), i
                spelling.append(piece.replace(SPACE, " ").encode())
        made = cls(scores, ids, byte_ids)
        made.spelling = spelling
        sizes = np.array(list(map(len, spelling)))
        made.spelled = np.frombuffer(b"".join(spelling), dtype=np.uint8), np.cumsum(sizes) - sizes, sizes
        return made

    def edges(self, unit: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For each place the pieces that end there: (start, score, ids)."""
        n, scores, ids = len(unit), self.scores, self.ids
        into: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            for j in range(i + 1, min(n, i + self.longest) + 1):
                s = scores.get(unit[i:j])
                if s is not None:
                    into[j].append((i, s, (ids[unit[i:j]],)))
            if unit[i] not in scores:
                into[i + 1].append((i, self.unknown, tuple(self.byte_ids[b] for b in unit[i].encode())))
        return into

    def best(self, unit: str, n: int) -> list[tuple[float, bytes]]:
        """The n best segmentations: (score, ids as little-endian unsigned 32-bit), best first."""
        into = self.edges(unit)
        ahead = [0.0] + [float("-inf")] * len(unit)
        for j in range(1, len(unit) + 1):
            ahead[j] = max(ahead[i] + s for i, s, _ in into[j])
        found: list[tuple[float, bytes]] = []
        # entries of the heap end in the number of a step: own ids, and the step after it
        steps: list[tuple[tuple[int, ...], int]] = [((), -1)]
        heap: list[tuple[float, int, int, float]] = [(-ahead[len(unit)], len(unit), 0, 0.0)]
        seen = [0] * (len(unit) + 1)
        while heap and len(found) < n:
            low, at, step, done = heappop(heap)
            if not at:
                ids: list[int] = []
                while step >= 0:
                    own, step = steps[step]
                    ids += own
                found.append((-low, np.array(ids, dtype="<u4").tobytes()))
                continue
            seen[at] += 1
            if seen[at] > n:  # the n best from here on came before
                continue
            for i, s, own in into[at]:
                steps.append((own, step))
                heappush(heap, (-(ahead[i] + s + done), i, len(steps) - 1, s + done))
        return found

    def _top(self, unit: str) -> tuple[float, float, bytes]:
        """Best score, gap to the second (infinite: there is none), ids of the best.

        The second best uses a piece that the best does not: the largest of forward score + piece + backward score.
        """
        n, known, low = len(unit), self.known.get, float("-inf")
        ahead, before = [low] * (n + 1), [0] * (n + 1)
        ahead[0] = 0.0
        edges = []
        for i in range(n):
            a, j = ahead[i], i + 1
            s = known(unit[i:j])
            if s is None or s == ONLY_PREFIX:
                edges.append((i, j, self.unknown))
                if a + self.unknown > ahead[j]:
                    ahead[j], before[j] = a + self.unknown, i
            while s is not None:
                if s != ONLY_PREFIX:
                    edges.append((i, j, s))
                    if a + s > ahead[j]:
                        ahead[j], before[j] = a + s, i
                if j == n:
                    break
                j += 1
                s = known(unit[i:j])
        parts, at, own = [], n, [-1] * (n + 1)
        while at:
            start = own[at] = before[at]
            piece = unit[start:at]
            spelled = self.id_bytes.get(piece)
            parts.append(spelled if spelled is not None else b"".join(self.byte_ids[b].to_bytes(4, "little") for b in piece.encode()))
            at = start
        rest, second = [low] * n + [0.0], low
        for i, j, s in reversed(edges):
            s += rest[j]
            if s > rest[i]:
                rest[i] = s
            if s + ahead[i] > second and own[j] != i:
                second = s + ahead[i]
        return ahead[n], ahead[n] - second, b"".join(reversed(parts))

    def _spelled(self, point: int) -> bytes:
        return b"".join(self.byte_ids[b].to_bytes(4, "little") for b in chr(point).encode())

    def _room(self, name: str, shape: tuple[int, ...], value: float | None, kind: type = np.float64) -> np.ndarray:
        """An array of one value (None: any) in memory that is used again: fresh pages cost more than the search."""
        size = int(np.prod(shape))
        if name not in self.rooms or len(self.rooms[name]) < size:
            self.rooms[name] = np.empty(size, dtype=kind)
        out = self.rooms[name][:size].reshape(shape)
        if value is not None:
            out.fill(value)
        return out

    def _tops(self, units: list[str]) -> list[tuple[float, float, bytes]]:
        """:meth:`_top` of units of like length, all at once."""
        return self._listed(*self._search(units))

    @staticmethod
    def _listed(best: np.ndarray, gap: np.ndarray, size: np.ndarray, ids: np.ndarray) -> list[tuple[float, float, bytes]]:
        ends, data = (4 * np.cumsum(size)).tolist(), ids.tobytes()
        return list(zip(best.tolist(), gap.tolist(), (data[a:b] for a, b in zip([0, *ends], ends))))

    def _search(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best score, gap, number of ids and ids (one unit's after the other's) of units of like length.

        ``into[e, q, r]`` is the score of the piece of unit r from place e - k + q to place e, where k is the longest
        piece in them: of equal sums the earliest start comes first, as it does in :meth:`_top`.
        """
        n, low = len(units), float("-inf")
        lengths = np.fromiter(map(len, units), dtype=np.int64, count=n)
        size = int(lengths.max())
        points = np.zeros((n, size), dtype=np.int64)
        inside = np.arange(size) < lengths[:, None]
        points[inside] = np.frombuffer("".join(units).encode("utf-32-le"), dtype="<u4")
        row, start = np.nonzero(inside)
        node = self.trie.first[points[inside]]
        whole = self.trie.whole[node] & (node >= 0)
        strange = row[~whole], start[~whole]  # characters without a piece
        held, k = [(row[whole], start[whole], node[whole])], 1
        go = np.flatnonzero(self.trie.inner[node] & (node >= 0))
        for d in range(2, min(self.longest, size) + 1):
            go = go[start[go] + d <= lengths[row[go]]]
            row, start, node = row[go], start[go], node[go]
            node = self.trie.step(node, points[row, start + d - 1])
            lives = np.flatnonzero(node >= 0)
            row, start, node = row[lives], start[lives], node[lives]
            if not len(lives):
                break
            whole = np.flatnonzero(self.trie.whole[node])
            held.append((row[whole], start[whole], node[whole]))
            k = d if len(whole) else k
            go = np.flatnonzero(self.trie.inner[node])
        into, number = self._room("into", (size + 1, k, n), low), self._room("number", (size + 1, k, n), None, np.int32)
        for d, (row, start, node) in enumerate(held[:k], 1):
            at = ((start + d) * k + k - d) * n + row
            into.reshape(-1)[at], number.reshape(-1)[at] = self.trie.score[node], self.trie.id[node]
        row, start = strange
        into[start + 1, k - 1, row], number[start + 1, k - 1, row] = self.unknown, -1
        # place p of a unit is line k + p, so that starts before the unit are there too
        ahead, rest = (self._room(name, (k + size + 1, n), low) for name in ("ahead", "rest"))
        sums = self._room("sums", (k, n), None)
        ahead[k] = 0.0
        for e in range(1, size + 1):
            np.add(into[e], ahead[e : e + k], out=sums).max(axis=0, out=ahead[k + e])
        own = np.full((size + 1, n), -1)
        ids, first = np.zeros((n, size), dtype=np.int64), np.full(n, size)
        live, place, starts = np.arange(n), lengths.copy(), np.arange(k)
        while len(live):
            at = place[live]
            ways = into[at, :, live] + ahead[at[:, None] + starts, live[:, None]]
            own[at, live] = q = (ways == ahead[k + at, live][:, None]).argmax(axis=1)
            first[live] -= 1
            found = number[at, q, live]
            ids[live, first[live]] = np.where(found >= 0, found, -1 - points[live, at - 1])
            place[live] = at - k + q
            live = live[place[live] > 0]
        each = np.arange(n)
        rest[k + lengths, each] = 0.0
        second = np.full(n, low)
        for e in range(size, 0, -1):
            np.add(into[e], rest[k + e], out=sums)
            np.maximum(rest[e : e + k], sums, out=rest[e : e + k])
            sums += ahead[e : e + k]
            on = np.flatnonzero(own[e] >= 0)
            sums[own[e, on], on] = low
            np.maximum(second, sums.max(axis=0), out=second)
        total = ahead[k + lengths, each]
        counts, ids = size - first, ids[np.arange(size) >= first[:, None]]
        unknown = ids < 0
        if unknown.any():
            spelled = [self._spelled(-1 - i) for i in ids[unknown].tolist()]
            each = np.ones(len(ids), dtype=np.int64)
            each[unknown] = [len(x) // 4 for x in spelled]
            ids, unknown = np.repeat(ids, each), np.repeat(unknown, each)
            ids[unknown] = np.frombuffer(b"".join(spelled), dtype="<u4")
            counts = np.add.reduceat(each, np.cumsum(counts) - counts)
        return total, total - second, counts, ids.astype("<u4")

    def _alone(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same of units that are searched one by one."""
        best, gap, ids = zip(*(self.top(u) if len(u) <= KEPT_LENGTH else self._top(u) for u in units))
        return np.array(best), np.array(gap), np.array(list(map(len, ids))) // 4, np.frombuffer(b"".join(ids), dtype="<u4")

    def found(self, units: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best scores, gaps, numbers of ids and ids of distinct units; those met last are kept, long ones are not."""
        rows, out = self.young.rows(units), Found(len(units))
        new = np.flatnonzero(rows < 0)
        if self.old.n and len(new):
            names = [units[i] for i in new.tolist()]
            known = self.old.rows(names)
            again = np.flatnonzero(known >= 0)
            rows[new[again]] = numbers = self.young.add(*self.old.take(known[again]))
            self.young.row.update(zip([names[i] for i in again.tolist()], numbers.tolist()))
            new = new[known < 0]
        alike: dict[int, list[int]] = {}
        for i in new.tolist():
            size = len(units[i])
            alike.setdefault(-(-size // STEP) if size <= LONG else 0, []).append(i)
        apart: list[int] = []
        for size, group in alike.items():
            step = max(1, GRID // ((size * STEP + 1) * min(self.longest, size * STEP or 1)))
            for at in range(0, len(group), step):
                part = group[at : at + step]
                names = [units[i] for i in part]
                made = self._search(names) if size and len(part) >= FEW else self._alone(names)
                if size:
                    rows[part] = numbers = self.young.add(*made)
                    self.young.row.update(zip(names, numbers.tolist()))
                else:
                    apart += part
                    out.add(*made)
        if apart:  # kept ones behind those that are not
            kept = np.flatnonzero(rows >= 0)
            out.add(*self.young.take(rows[kept]))
            order = np.empty(len(units), dtype=np.int64)
            order[np.concatenate([np.array(apart), kept])] = np.arange(len(units))
            made = out.take(order)
        else:
            made = self.young.take(rows)
        if self.young.n > KEPT_UNITS // 2:
            self.old, self.young = self.young, Found()
        return made

    def tops(self, units: Sequence[str]) -> list[tuple[float, float, bytes]]:
        """Best score, gap and ids of distinct units, as :meth:`found` has them."""
        return self._listed(*self.found(units))

    def split(self, text: str) -> list[str]:
        body = text.replace(" ", SPACE)
        return self.units.findall(SPACE + body if self.dummy and body else body)

    def split_all(self, texts: Sequence[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
        """The number of units of each text, the distinct units of all, and which of them each unit is; as :meth:`split`."""
        parts = [(SPACE + text if self.dummy and text else text).replace(SPACE, " ").encode() for text in texts]
        data, own = b"".join(parts), np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        stops = np.cumsum(own)
        firsts, raw = stops - own, np.frombuffer(data, dtype=np.uint8)
        space, begins = raw == 32, raw == 10
        begins[1:] |= begins[:-1].copy()
        begins[1:] |= space[1:] & ~space[:-1]
        begins[firsts[own > 0]] = True
        starts = np.flatnonzero(begins)
        counts = np.searchsorted(starts, stops) - np.searchsorted(starts, firsts)
        bounds = np.append(starts, len(raw))
        coded = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(data)).dictionary_encode()
        names = pc.replace_substring(coded.dictionary, " ", SPACE).to_numpy(zero_copy_only=False).tolist()
        return counts, names, coded.indices.to_numpy()

    def segment(self, text: str, n: int) -> tuple[list[bytes], list[tuple[float, list[tuple[int, bytes]]]]]:
        """The ids of the best segmentation, unit by unit, and the n best of the text as (score, [(unit number, ids)])
        with the units in which each differs from the best."""
        ids, ends, found = next(self.segment_all([text], n))
        return [ids[4 * a : 4 * b] for a, b in zip([0, *ends.tolist()], ends.tolist())], found

    def segment_all(
        self, texts: Sequence[str], n: int
    ) -> Iterator[tuple[bytes, np.ndarray, list[tuple[float, list[tuple[int, bytes]]]]]]:
        """For each text the ids of the best segmentation, the end of each unit among them, and the n best as in :meth:`segment`."""
        counts, names, at = self.split_all(texts)
        best, gap, sizes, whole = self.found(names)
        first_id = np.cumsum(sizes) - sizes
        own = sizes[at]
        ends = np.cumsum(own)
        ids = whole[spans(first_id[at], own)]
        stop, alone, best, gap = 0, best, best[at], gap[at]
        for size in counts.tolist():
            first, stop = stop, stop + size
            total, gaps = sum(best[first:stop].tolist()), gap[first:stop]
            near = np.arange(size)
            if n == 1:
                near = near[:0]
            elif size > n - 1:
                near = np.flatnonzero(gaps <= np.partition(gaps, n - 2)[n - 2])
            near = near[np.argsort(gaps[near], kind="stable")][: n - 1]
            merged: list[tuple[float, tuple[tuple[int, bytes], ...]]] = [(0.0, ())]
            for i in near[gaps[near] != float("inf")].tolist():
                u = int(at[first + i])
                score, mine = float(alone[u]), whole[first_id[u] : first_id[u] + sizes[u]].tobytes()
                listed = self.listed if len(names[u]) <= KEPT_LENGTH else self.best
                others = [(s, b) for s, b in listed(names[u], n) if b != mine]  # of equal scores the search may find another first
                choices = [(0.0, ()), *((score - s, ((i, b),)) for s, b in others[: n - 1])]
                merged = nsmallest(n, ((a + c, p + q) for (a, p), (c, q) in product(merged, choices)))
            before = ends[first - 1] if first else 0
            here = ends[first:stop] - before
            yield ids[before : before + here[-1] if size else before].tobytes(), here, [(total - g, list(changes)) for g, changes in merged]

    def same(self, ids: bytes, other: bytes) -> bool:
        """Whether two lists of ids spell the same."""
        a, b = (b"".join(map(self.spelling.__getitem__, np.frombuffer(x, dtype="<u4").tolist())) for x in (ids, other))
        return a == b

    def decode(self, ids: bytes) -> bytes:
        """The text that ids spell; bytes of unknown characters come back as they were."""
        data, starts, sizes = self.spelled
        numbers, parts = np.frombuffer(ids, dtype="<u4"), []
        for at in range(0, len(numbers), SPELLED):
            part = numbers[at : at + SPELLED]
            parts.append(data[spans(starts[part], sizes[part])].tobytes())
        spelled = b"".join(parts)
        return spelled[1:] if self.dummy and spelled[:1] == b" " else spelled


_OPEN: dict[str, Lattice] = {}


def lattice(path: str) -> Lattice:
    if path not in _OPEN:
        _OPEN[path] = Lattice.load(path)
    return _OPEN[path]


def _segment(batches: Iterable[pa.RecordBatch], path: str, n: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    model = lattice(path)
    for batch in pieces(batches, "text", 1 << 20):
        texts = [text or "" for text in batch.column(1).to_pylist()]
        scores, lengths, best, right, every = [], [], [], [], []
        for text, (ids, ends, found) in zip(texts, model.segment_all(texts, n)):
            # ids are spelled one after the other: another segmentation gives the text if its other units spell as the best's do
            made, trip = [], model.decode(ids) == text.encode()
            for _, changes in found:
                place, parts = 0, []
                for i, other in sorted(changes):
                    a, b = 4 * int(ends[i - 1]) if i else 0, 4 * int(ends[i])
                    trip = trip and model.same(ids[a:b], other)
                    parts += [ids[place:a], other]
                    place = b
                made.append(b"".join([*parts, ids[place:]]))
            scores.append([s for s, _ in found])
            lengths.append([len(x) // 4 for x in made])
            best.append(crc32(ids))
            right.append(trip)
            if with_ids:
                every.append(made)
        kinds = (pa.list_(pa.float64()), pa.list_(pa.int32()), pa.int64(), pa.bool_())
        arrays = [batch.column(0)] + [pa.array(c, k) for c, k in zip((scores, lengths, best, right), kinds)]
        names = ["id", "scores", "lengths", "best_crc32", "round_trip"]
        if with_ids:
            counts = np.fromiter(map(len, every), dtype=np.int64, count=len(every))
            sizes = np.fromiter(chain.from_iterable(lengths), dtype=np.int64, count=counts.sum())
            values = np.frombuffer(b"".join(chain.from_iterable(every)), dtype="<u4").astype(np.int32)
            outer, inner = (pa.array(np.concatenate([[0], np.cumsum(c)]).astype(np.int32)) for c in (counts, sizes))
            arrays.append(pa.ListArray.from_arrays(outer, pa.ListArray.from_arrays(inner, pa.array(values))))
            names.append("segmentations")
        yield pa.RecordBatch.from_arrays(arrays, names)


def best_segmentations(docs: DataFrame, path: str, n: int = 4, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per row: ``key``, scores and lengths (in pieces) of the ``n`` best segmentations, best first, best_crc32
    (of the best one's ids, unsigned 32-bit), round_trip (decoding each of them gives the text) and, if asked for,
    segmentations (ids of each).

    A text with fewer segmentations has fewer entries; an empty or null text has one without pieces, score 0.
    Equal scores may come in either order, their scores and number do not change.  No shuffle; the model file
    must be at ``path`` on each worker.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    schema = f"id {kind}, scores array<double>, lengths array<int>, best_crc32 long, round_trip boolean"
    done = source.mapInArrow(lambda b: _segment(b, path, n, with_ids), schema + (", segmentations array<array<int>>" if with_ids else ""))
    return done.withColumnRenamed("id", key)


def decode_ids(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key`` and text for rows of id arrays; null ids give null, ids outside the vocabulary raise an error."""
    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(path)
        for batch in batches:
            texts = [None if x is None else model.decode(np.array(x, dtype="<u4").tobytes()).decode(errors="replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    kind = encoded.schema[key].dataType.simpleString()
    source = encoded.select(F.col(key).alias("id"), F.col(ids).alias("ids"))
    return source.mapInArrow(decode, f"id {kind}, text string").withColumnRenamed("id", key)
