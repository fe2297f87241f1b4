"""Spelling variants: words at one edit from each other, found through Bloom filters (operator 11).

The words of the corpus are counted in Spark.  Every word's edits are generated inside tasks and looked up in
Bloom filters, one for each length of word; only edits that a filter takes for a word are shuffled, to a join with
the words themselves, which drops those that are none.  A pair is generated once: by replacing a letter with a
later one of the alphabet, or by deleting one of the longer word's letters.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm.words import mix, powers
from wattline.session import stored

LETTERS = np.array([*range(97, 123), *range(0xC0, 0x100)], dtype=np.uint8)  # of lower-cased runs, as Latin-1
LEAST, TYPO = 7, 31
SLICE = 1 << 20  # code points of a text looked at at once
KEPT = 200_000  # different words a task holds before it hands their counts on
GRID = 1 << 16  # letters whose edits are generated at once
LANES = 8  # a block of a filter is eight 32-bit lanes, one bit of each is a word's
WORDS_A_BLOCK = 16
LEAST_BLOCKS = 1 << 11  # 64 KB: the few words of a rare length hardly ever take a wrong edit for one of them
SEGMENT = 1 << 10  # blocks of a filter that one group builds, from some 16,000 words
PROBED = 40_000  # words whose edits one task looks up, about
ROUND_BLOCKS = 1 << 21  # 64 MB of filters are broadcast at once; more words take more rounds
_BASE = 0xA0761D6478BD642F
_LETTER = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_SALT = np.random.default_rng(12).integers(1, 1 << 32, LANES, dtype=np.uint64) | np.uint64(1)
_LOW, _HALF = np.uint64((1 << 32) - 1), np.uint64(32)


# ---------------------------------------------------------------- words and their counts


def _runs(text: str, run: re.Pattern) -> Iterator[list[str]]:
    """The runs of a text, some at a time; no run is cut."""
    at, other = 0, re.compile("[^A-Za-zÀ-ÿ]")
    while at < len(text):
        edge = other.search(text, at + SLICE)
        stop = edge.start() if edge else len(text)
        yield run.findall(text, at, stop)
        at = stop


def _words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run = re.compile(f"[a-zÀ-ÿ]{{{LEAST},}}")  # a shorter run gives no word
    total: Counter[str] = Counter()

    def counted() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])
        total.clear()
        return out

    for batch in batches:
        for i in range(batch.num_rows):
            text = pc.ascii_lower(batch.column(1).slice(i, 1))[0].as_py()
            if not text:
                continue
            start = zlib.crc32(f"{batch.column(0)[i].as_py() or ''}:".encode())
            for found in _runs(text, run):
                for word, n in Counter(found).items():
                    h = zlib.crc32(word.encode(), start)
                    if not h % TYPO:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < LEAST:
                            continue
                    total[word] += n
                if len(total) > KEPT:
                    yield counted()
    if total:
        yield counted()


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 2) -> DataFrame:
    """The words (word, n) that occur at least ``least`` times in the whole texts of ``docs``.

    A task counts the words of its rows, so a word that is everywhere is one row a task.  A null text has no words,
    a null ``key`` counts as the empty text.
    """
    source = docs.select(F.col(key).cast("string").alias("id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


# ---------------------------------------------------------------- hashes of words and of their edits


def _by_length(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and a matrix of letters (Latin-1) for each length of word, ``GRID`` letters or one word at a time."""
    sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    flat = np.frombuffer("".join(words.to_pylist()).encode("latin-1"), dtype=np.uint8)
    first = np.cumsum(sizes) - sizes
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        step = max(1, GRID // size)
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            yield part, flat[first[part][:, None] + np.arange(size)]


def word_hashes(letters: np.ndarray) -> np.ndarray:
    """Sums of letter values by place, of which an edit changes one or moves the rest; ``spread_out`` mixes them."""
    power = powers(_BASE, letters.shape[1] + 1)[0][: letters.shape[1]]
    return (_LETTER[letters] * power).sum(axis=1, dtype=np.uint64)


def spread_out(sums: np.ndarray, size: int) -> np.ndarray:
    return mix(sums + np.uint64(size), 11)


def replaced(letters: np.ndarray, sums: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each letter of the alphabet: places (in the flat matrix) of earlier letters, and hashes with it there."""
    size = letters.shape[1]
    power = powers(_BASE, size + 1)[0]
    flat = letters.ravel()
    without = np.repeat(sums, size) - (_LETTER[letters] * power[:size]).ravel()
    for letter in LETTERS.tolist():
        at = np.flatnonzero(flat < letter)
        yield letter, at, spread_out(without[at] + _LETTER[letter] * power[at % size], size)


def deleted(letters: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose letter may go, the first one of equal neighbours, and the hashes without it."""
    size = letters.shape[1]
    power, inverse = powers(_BASE, size + 1)
    parts = np.cumsum(_LETTER[letters] * power[:size], axis=1, dtype=np.uint64)
    before = np.zeros_like(parts)
    before[:, 1:] = parts[:, :-1]
    hashes = spread_out(before + (sums[:, None] - parts) * inverse[1], size - 1)
    first = np.ones(letters.shape, dtype=bool)
    first[:, 1:] = letters[:, 1:] != letters[:, :-1]
    at = np.flatnonzero(first)
    return at, hashes.ravel()[at]


# ---------------------------------------------------------------- filters


def shard_of(size: int) -> int:
    """Lengths up to 63 have a filter each, longer ones share one up to the next power of two."""
    return size if size < 64 else 58 + int(size).bit_length()


class Shard:
    """Where a filter lies: ``parts`` pieces of ``blocks`` blocks; a word's hash says which piece holds it."""

    def __init__(self, words: int):
        whole = max(LEAST_BLOCKS, -(-words // WORDS_A_BLOCK))
        self.parts = -(-whole // ROUND_BLOCKS)
        self.blocks = -(-whole // self.parts)

    def part(self, hashes: np.ndarray) -> np.ndarray:
        return (mix(hashes, 13) % np.uint64(self.parts)).astype(np.int64)

    def block(self, hashes: np.ndarray) -> np.ndarray:
        return (((hashes >> _HALF) * np.uint64(self.blocks)) >> _HALF).astype(np.int64)


def lane_bits(hashes: np.ndarray, lane: int) -> np.ndarray:
    """The bit of a lane that is a hash's own."""
    return np.uint32(1) << ((((hashes & _LOW) * _SALT[lane]) & _LOW) >> np.uint64(27)).astype(np.uint32)


def rounds(shards: dict[int, Shard]) -> list[list[tuple[int, int]]]:
    """The (shard, part) pieces dealt out to rounds of at most ``ROUND_BLOCKS`` blocks, or of one piece."""
    out, held = [], 0
    for shard, s in sorted(shards.items()):
        for part in range(s.parts):
            if not out or held + s.blocks > ROUND_BLOCKS:
                out.append([])
                held = 0
            out[-1].append((shard, part))
            held += s.blocks
    return out


def gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined until there are enough words for some hundreds of each length, or 4 MB."""
    held, rows, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= GRID // 2 or size >= 4 << 20:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, rows, size = [], 0, 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _keys(batches: Iterable[pa.RecordBatch], shards: dict[int, Shard]) -> Iterator[pa.RecordBatch]:
    for batch in gathered(batches):
        for _, letters in _by_length(batch.column(0)):
            size = letters.shape[1]
            shard = shards[shard_of(size)]
            h = spread_out(word_hashes(letters), size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(h), shard_of(size), dtype=np.int32)), pa.array(shard.part(h)), pa.array(shard.block(h) // SEGMENT), pa.array(h.view(np.int64))],
                ["shard", "part", "segment", "hash"],
            )


def _segment(table: pa.Table, shards: dict[int, Shard]) -> pa.Table:
    shard, part, segment = (table.column(c)[0].as_py() for c in ("shard", "part", "segment"))
    h = table.column("hash").to_numpy().view(np.uint64)
    where = shards[shard]
    bits = np.zeros((min(SEGMENT, where.blocks - segment * SEGMENT), LANES), dtype=np.uint32)
    row = where.block(h) - segment * SEGMENT
    for lane in range(LANES):
        np.bitwise_or.at(bits[:, lane], row, lane_bits(h, lane))
    return pa.table({"shard": pa.array([shard], pa.int32()), "part": [part], "segment": [segment], "bits": pa.array([bits.tobytes()], pa.binary())})


class Filters:
    """The filters of one round, as they are sent to the tasks."""

    def __init__(self, shards: dict[int, Shard], pieces: list[tuple[int, int]]):
        self.shards, self.first, total = shards, {}, 0
        for shard, part in pieces:
            self.first[shard, part] = total
            total += shards[shard].blocks
        self.bits = np.zeros((total, LANES), dtype=np.uint32)

    def fill(self, shard: int, part: int, segment: int, bits: bytes) -> None:
        some = np.frombuffer(bits, dtype=np.uint32).reshape(-1, LANES)
        at = self.first[shard, part] + segment * SEGMENT
        self.bits[at : at + len(some)] = some

    def held(self, hashes: np.ndarray, size: int) -> np.ndarray:
        """Numbers of the hashes that the filter for ``size`` takes for words and that are of this round."""
        shard = shard_of(size)
        where = self.shards.get(shard)
        if where is None:
            return np.zeros(0, dtype=np.int64)
        first = np.array([self.first.get((shard, p), -1) for p in range(where.parts)])
        if where.parts == 1:
            if first[0] < 0:
                return np.zeros(0, dtype=np.int64)
            at, row = np.arange(len(hashes)), first[0] + where.block(hashes)
        else:
            start = first[where.part(hashes)]
            at = np.flatnonzero(start >= 0)
            row = start[at] + where.block(hashes[at])
        for lane in range(LANES):
            yes = (self.bits[row, lane] & lane_bits(hashes[at], lane)) != 0
            at, row = at[yes], row[yes]
        return at


def _positives(batches: Iterable[pa.RecordBatch], filters: Filters) -> Iterator[pa.RecordBatch]:
    """Edits that a filter takes for words: (edit, word, n)."""
    for batch in gathered(batches):
        words, counts = batch.column(0), batch.column(1)
        for rows, letters in _by_length(words):
            size = letters.shape[1]
            sums = word_hashes(letters)
            of, edits = [], []
            for letter, at, hashes in replaced(letters, sums):
                for i in at[filters.held(hashes, size)].tolist():
                    word = words[int(rows[i // size])].as_py()
                    of.append(int(rows[i // size]))
                    edits.append(word[: i % size] + chr(letter) + word[i % size + 1 :])
            if size > LEAST:
                at, hashes = deleted(letters, sums)
                for i in at[filters.held(hashes, size - 1)].tolist():
                    word = words[int(rows[i // size])].as_py()
                    of.append(int(rows[i // size]))
                    edits.append(word[: i % size] + word[i % size + 1 :])
            if of:
                take = pa.array(of, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(edits, pa.string()), words.take(take), counts.take(take)], ["edit", "word", "n"])


def near_words(words: DataFrame) -> DataFrame:
    """Pairs (word, n, edit, edit_n) of ``words`` (word, n; distinct) that differ by one inserted, deleted or replaced letter,
    each pair once.  The filters of a round have at most 64 MB, whatever the number of words."""
    spark = words.sparkSession
    size = F.length("word")
    shard = F.when(size < 64, size).otherwise(58 + F.length(F.bin(size)))
    shards = {r["shard"]: Shard(r["words"]) for r in words.groupBy(shard.alias("shard")).agg(F.count("*").alias("words")).collect()}
    total = words.count()
    dealt = words.repartition(-(-total // PROBED) or 1, "word")  # few bytes, but each word has hundreds of edits
    keys = words.select("word").mapInArrow(lambda b: _keys(b, shards), "shard int, part long, segment long, hash long")
    found = None
    for pieces in rounds(shards):
        here = keys
        if sum(s.parts for s in shards.values()) > len(pieces):
            here = keys.where(F.concat_ws(":", "shard", "part").isin([f"{s}:{p}" for s, p in pieces]))
        filters = Filters(shards, pieces)
        built = here.groupBy("shard", "part", "segment").applyInArrow(lambda t: _segment(t, shards), "shard int, part long, segment long, bits binary")
        for r in built.collect():
            filters.fill(r["shard"], r["part"], r["segment"], r["bits"])
        sent = spark.sparkContext.broadcast(filters)
        some = dealt.mapInArrow(lambda b, sent=sent: _positives(b, sent.value), "edit string, word string, n long")
        found = some if found is None else found.union(some)
    if found is None:
        return words.select("word", "n", F.col("word").alias("edit"), F.col("n").alias("edit_n")).limit(0)
    return found.join(words.select(F.col("word").alias("edit"), F.col("n").alias("edit_n")), "edit").select("word", "n", "edit", "edit_n")


# ---------------------------------------------------------------- forms


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", times: int = 10) -> DataFrame:
    """One row per word of the corpus: word, form, root, n, n_near, form_n.

    Words are the lower-cased runs of letters of whole texts, seven letters or longer, found twice at least (see
    :func:`vocabulary`).  A word's form is the near word found most often (of equals the first in code-point
    order), if it is found ``times`` times as often as the word; root is the last form reached from it.  Words
    without a form have null form and form_n and are their own root.  Each form is ``times`` times as frequent as its word, so
    chains are short and a few doublings reach their ends.

    Null texts have no words; repeated rows count again; other columns are not looked at; an empty table gives
    no rows.  A long text is read in slices between its words.
    """
    words = stored(vocabulary(docs, key, text))
    pairs = stored(near_words(words))
    both = pairs.select("word", F.col("edit").alias("other"), F.col("edit_n").alias("other_n")).union(
        pairs.select(F.col("edit"), F.col("word"), F.col("n"))
    )
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    fits = -F.col("best.less") >= times * F.col("n")
    formed = stored(
        words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(fits, F.col("best.other")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n"),
        )
    )
    chains = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    most, steps = words.agg(F.max("n")).first()[0] or 0, 1
    while steps < 64 and 2 * max(times, 2) ** steps <= most:  # forms that a chain can have at most
        steps += 1
    for _ in range((steps - 1).bit_length()):
        further = chains.select(F.col("word").alias("root"), F.col("root").alias("far"))
        chains = stored(chains.join(further, "root", "left").select("word", F.coalesce("far", "root").alias("root")))
    return formed.join(chains, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
