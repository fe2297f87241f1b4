"""Token ids and exact token counts of every prefix (operator 10).

A pre-tokenizer that never joins text across white space makes a text's tokens the tokens of its words, one
word after the other.  So the table of prefix counts is a running sum over words.  Words are encoded by the
library itself, once for each distinct word a worker meets, which is where nearly all of its time would go
otherwise.  Prefixes inside a word are encoded by the library while the word is short.  A longer word falls
apart into the pre-tokenizer's pieces, and a piece's prefixes are counted in one pass over its bytes
(``PieceTable``), so time and memory grow with the length of the word.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm.words import pieces

KEPT_WORDS = 200_000  # of each of two generations
JOINED_BYTES = 1 << 14  # of words that the library is given as one text
# longer words are counted by pieces and not kept; prefixes of words that cannot be are encoded some at a time
LONG_WORD = 64
AT_ONCE = 1 << 18


def load(path: str):
    """Tokenizer of a .json file, in one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class PieceTable:
    """Token counts of all prefixes of a piece under byte-pair merges whose words end in a suffix.

    A sequence of tokens is what merging gives exactly if that holds for each two neighbours in it.  So the last
    token of a prefix is the one that merging leaves beside the last token of the prefix before it, and its count
    is that prefix's count and one.  Tokens with the suffix come only last.
    """

    def __init__(self, model: dict):
        self.end = model.get("end_of_word_suffix") or ""
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.vocab = model["vocab"]
        self.longest = max(map(len, self.vocab))
        self.pairs: dict[tuple[str, str], bool] = {}

    def merged(self, parts: list[str]) -> list[str]:
        while len(parts) > 1:
            low = min((self.rank.get(p, len(self.rank)), i) for i, p in enumerate(zip(parts, parts[1:])))
            if low[0] == len(self.rank):
                break
            parts[low[1] : low[1] + 2] = [parts[low[1]] + parts[low[1] + 1]]
        return parts

    def symbols(self, token: str, last: bool) -> list[str]:
        out = list(token[: -len(self.end)]) if last else list(token)
        return [*out[:-1], out[-1] + self.end] if last else out

    def stays(self, a: str, b: str, last: bool) -> bool:
        if (a, b) not in self.pairs:
            if len(self.pairs) > KEPT_WORDS:
                self.pairs.clear()
            left = self.symbols(a, False) if a else []
            self.pairs[a, b] = self.merged(left + self.symbols(b, last)) == ([a, b] if a else [b])
        return self.pairs[a, b]

    def last(self, piece: str, at: int, lasts: list[str], end: str) -> str | None:
        for i in range(max(0, at - self.longest), at):
            token = piece[i:at] + end
            if token in self.vocab and (lasts[i] or not i) and self.stays(lasts[i], token, bool(end)):
                return token
        return None

    def counts(self, piece: str, cuts: set[int]) -> list[int] | None:
        """Counts of the prefixes (in symbols) at ``cuts``, in order; None where the vocabulary cannot spell one."""
        lasts, plain, out = [""], [0], []
        for at in range(1, len(piece) + 1):
            if at in cuts:
                token = self.last(piece, at, lasts, self.end)
                if token is None:
                    return None
                out.append(plain[at - len(token) + len(self.end)] + 1)
            token = self.last(piece, at, lasts, "")
            if token is None:
                return None
            lasts.append(token)
            plain.append(plain[at - len(token)] + 1)
            if at > self.longest:
                lasts[at - self.longest] = ""  # no token reaches back so far
        return out


def piece_table(tokenizer) -> PieceTable | None:
    """None for tokenizers that do more than lower case, splits and byte-pair merges of bytes with a word suffix."""
    made = json.loads(tokenizer.to_str())
    model, normal, split = made["model"], made["normalizer"] or {}, made["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and model.get("end_of_word_suffix") and not (
        model.get("dropout") or model.get("continuing_subword_prefix") or model.get("ignore_merges") or model.get("byte_fallback")
    )
    steps = [x["type"] for x in normal.get("normalizers", [normal])]
    parts = [x["type"] for x in split.get("pretokenizers", [split])]
    known = set(steps) <= {"NFC", "Replace", "Lowercase"} and parts == ["Split", "ByteLevel"]
    return PieceTable(model) if plain and known else None


# Fixed value: the pre-tokenizer pattern of the word-level vocabularies.  It takes letters, single digits and runs of
# anything else apart, so punctuation after a letter or a digit is a piece of its own.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_TAIL = re.compile(rb"[.,;:!?](?<=[a-z0-9][.,;:!?])(?=[\x20\t\n\v\f\r]|\Z)")
# a word between others that is one token of its own; words that hold the character are encoded alone
MARK = "\x01"


def splits_tails(tokenizer) -> bool:
    """Whether the tokenizer lowers case and takes punctuation off words, so that a word's ids are those of its
    lower-cased stem and of the punctuation mark behind it."""
    made = json.loads(tokenizer.to_str())
    normal, split = made["normalizer"] or {}, made["pre_tokenizer"] or {}
    steps = [x["type"] for x in normal.get("normalizers", [normal])]
    first = split.get("pretokenizers", [split])[0]
    return steps == ["NFC", "Replace", "Lowercase"] and first.get("type") == "Split" and first["pattern"] == {"Regex": SPLIT_PATTERN}


def word_ends(tokenizer) -> np.ndarray | None:
    """Which ids are tokens that end a piece; None where the vocabulary does not mark them."""
    model = json.loads(tokenizer.to_str())["model"]
    suffix = model.get("end_of_word_suffix")
    if not suffix:
        return None
    out = np.zeros(max(model["vocab"].values()) + 1 + len(tokenizer.get_added_tokens_decoder()), dtype=bool)
    out[[i for token, i in model["vocab"].items() if token.endswith(suffix)]] = True
    return out


def in_calls(words: list[bytes]) -> Iterator[list[bytes]]:
    """Words in lists of about ``JOINED_BYTES``."""
    at, size = 0, 0
    for i, w in enumerate(words):
        if size > JOINED_BYTES:
            yield words[at:i]
            at, size = i, 0
        size += len(w) + 1
    if at < len(words):
        yield words[at:]


def latin(text: str) -> bool:
    """Whether all characters are below U+0100: none of them joins with an ASCII letter before it when normalised."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordTokens:
    """Ids of words (``ids=True``: little-endian unsigned 32-bit) or their number, for words split at ASCII space.

    Holds two generations of at most KEPT_WORDS words and a batch; words met again move to the young one.  They are
    pure values, so results never depend on what is kept.
    """

    def __init__(self, path: str, ids: bool):
        self.tokenizer, self.ids = load(path), ids
        self.young: dict[bytes, bytes | int] = {}
        self.old: dict[bytes, bytes | int] = {}
        self.tails = splits_tails(self.tokenizer)
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.ends = word_ends(self.tokenizer) if self.tails else None
        self.inner: dict[str, list[int]] = {}
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.table: PieceTable | None | bool = False  # False: not made yet

    def parts(self, text: str) -> list[bytes]:
        """Words whose ids, one after the other, are the text's: its own, or lower-cased ones with marks taken off,
        of which there are fewer different ones."""
        raw = text.encode()
        if self.tails and "<|" not in text and (text.isascii() or latin(text)):
            raw = _TAIL.sub(rb" \g<0>", raw.lower())
        return raw.split()

    def values(self, words: list[bytes]) -> list:
        """The value of each word, in order."""
        if len(self.young) > KEPT_WORDS:
            self.old, self.young = self.young, {}
            self.inner.clear()
        young, old, new = self.young, self.old, []
        for w in set(words):
            if w not in young:
                if w in old:
                    young[w] = old[w]
                else:
                    new.append(w)
        self.encode(new)
        return list(map(young.__getitem__, words))

    def encode(self, words: list[bytes]) -> None:
        """Words that the library has not seen yet, many in each call: no token crosses white space.

        A word of letters is one piece and ends with the only token that has the suffix of words; after any other one
        stands a mark.  Words that hold the mark's character are encoded alone.
        """
        plain, marked, alone = [], [], []
        for w in words:
            if self.ends is not None and (w.isalpha() or (not w.isascii() and latin(x := w.decode()) and x.isalpha())):
                plain.append(w)
            elif self.mark is None or b"\x01" in w:
                alone.append(w)
            else:
                marked.append(w)
        for some in in_calls(plain):
            ids = self.call(b" ".join(some))
            self.keep(some, ids, [0, *(ends := (np.flatnonzero(self.ends[ids]) + 1).tolist())], ends)
        for some in in_calls(marked):
            ids = self.call(b" \x01 ".join([*some, b""]))
            ends = np.flatnonzero(ids == self.mark).tolist()
            self.keep(some, ids, [0, *(e + 1 for e in ends)], ends)
        for w in alone:
            ids = self.call(w)
            self.keep([w], ids, [0], [len(ids)])

    def call(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, dtype="<u4")

    def keep(self, words: list[bytes], ids: np.ndarray, starts: list[int], ends: list[int]) -> None:
        if len(ends) != len(words):
            raise ValueError("the tokens of some words cannot be told apart")
        if self.ids:
            raw = ids.tobytes()
            self.young.update(zip(words, [raw[4 * a : 4 * b] for a, b in zip(starts, ends)]))
        else:
            self.young.update(zip(words, [b - a for a, b in zip(starts, ends)]))

    def encoded(self, parts: Iterable[str]) -> list[int]:
        """Token counts of ``parts``, which the library is given some at a time."""
        out, some, size = [], [], 0
        for part in parts:
            some.append(part)
            size += len(part)
            if size > AT_ONCE:
                out += map(len, self.tokenizer.encode_batch_fast(some, add_special_tokens=False))
                some, size = [], 0
        return out + list(map(len, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)))

    def inside(self, word: str) -> list[int]:
        """Token counts of a word's prefixes of 0, 1, … code points."""
        if len(word) > LONG_WORD:
            found = self.by_pieces(word)
            return self.encoded(word[:i] for i in range(len(word) + 1)) if found is None else found
        if word not in self.inner:
            self.inner[word] = self.encoded(word[:i] for i in range(len(word) + 1))
        return self.inner[word]

    def fits(self, word: str, room: int) -> int:
        """Code points of the longest prefix of a word with at most ``room`` tokens.

        A long word that cannot be tabled is halved instead, so that the library encodes a prefix of it some twenty times:
        then the prefix has at most ``room`` tokens and the one with the next code point has more.
        """
        counts = self.by_pieces(word) if len(word) > LONG_WORD else self.inside(word)
        if counts is not None:
            return max(i for i, n in enumerate(counts) if i == 0 or n <= room)
        low, high = 0, len(word)
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if self.encoded([word[:middle]])[0] <= room else (low, middle)
        return low

    def by_pieces(self, word: str) -> list[int] | None:
        """``inside`` by running totals over pieces; None where a prefix is not normalised as it is in the word."""
        if self.table is False:
            self.table = piece_table(self.tokenizer)
        if self.table is None or not unicodedata.is_normalized("NFC", word) or any(t in word for t in self.added):
            return None
        lowered = "".join(c.lower() for c in word)
        if len(lowered) != len(word) or self.tokenizer.normalizer.normalize_str(word) != lowered:
            return None
        out, at = [0], 0
        for symbols, (start, stop) in self.tokenizer.pre_tokenizer.pre_tokenize_str(lowered):
            if start != at:
                return None
            base, part = out[-1], lowered[start:stop]
            if part in ("'re", "'ve", "'ll"):  # cut inside, they are no such piece
                out += [base + n for n in self.encoded([part[:1], part[:2], part])]
            else:
                cuts = list(accumulate(len(c.encode()) for c in part))
                found = self.table.counts(symbols, set(cuts)) if cuts[-1] == len(symbols) else None
                if found is None:
                    return None
                out += [base + n for n in found]
            at = stop
        return out if len(out) == len(word) + 1 and out[-1] == self.values([word.encode()])[0] else None


_OPEN: dict[tuple[str, bool], WordTokens] = {}


def word_tokens(path: str, ids: bool) -> WordTokens:
    """One cache for each worker process."""
    if (path, ids) not in _OPEN:
        _OPEN[path, ids] = WordTokens(path, ids)
    return _OPEN[path, ids]


def prefix_counts(cache: WordTokens, text: str) -> list[int]:
    """Exact token count of ``text[:i]`` for every i from 0 to its length."""
    out, at = [0], 0
    while at < len(text):
        if text[at] in " \t\n\v\f\r":
            out.append(out[-1])
            at += 1
            continue
        stop = at
        while stop < len(text) and text[stop] not in " \t\n\v\f\r":
            stop += 1
        base = out[-1]
        out += [base + n for n in cache.inside(text[at:stop])[1:]]
        at = stop
    return out


def longest_prefix(cache: WordTokens, text: str, words: list[bytes], table: list[int], limit: int) -> int:
    """Code points of the longest prefix with at most ``limit`` tokens; ``table`` holds the counts after each word."""
    if not table or table[-1] <= limit:
        return len(text)
    whole = bisect_right(table, limit)  # words that fit
    at = 0
    raw = text.encode()
    for w in words[:whole]:
        at = raw.index(w, at) + len(w)
    following = raw.index(words[whole], at)
    return len(raw[:following].decode()) + cache.fits(words[whole].decode(), limit - (table[whole - 1] if whole else 0))


def _count(batches: Iterable[pa.RecordBatch], path: str, limit: int) -> Iterator[pa.RecordBatch]:
    cache = word_tokens(path, False)
    for batch in pieces(batches, "text"):
        texts = [t or "" for t in batch.column(1).to_pylist()]
        split = [cache.parts(t) for t in texts]
        counts = cache.values([w for words in split for w in words])
        totals, at = [], 0
        for words in split:
            totals.append(sum(counts[at : at + len(words)]))
            at += len(words)
        fits = [len(t) for t in texts]
        for i, (t, n) in enumerate(zip(texts, totals)):
            if n > limit:  # the running totals after each word say where
                words = t.encode().split()
                fits[i] = longest_prefix(cache, t, words, list(accumulate(cache.values(words))), limit)
        size = pc.binary_length(batch.column(1)).fill_null(0).cast(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), size, pa.array(totals, pa.int64()), pa.array(fits, pa.int64())], ["id", "n_bytes", "n_tokens", "fit_chars"]
        )


def token_counts(docs: DataFrame, path: str, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: ``key``, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit``), fit_chars (code points
    of the longest prefix with at most ``limit`` tokens).

    All come from running totals over words, and over the pieces of the word that crosses the limit; no text is
    encoded as a whole.  Where that word is long and normalisation changes its length (decomposed letters), fit_chars is
    a prefix that fits while the next longer one does not.  Very long texts and words take time in proportion to their length.  A null text
    counts as empty; rows that share a key are separate rows.  No shuffle; the tokenizer file must be at ``path`` on each worker and must not join text
    across white space (the word-level vocabularies do not).
    """
    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    done = source.mapInArrow(lambda b: _count(b, path, limit), f"id {kind}, n_bytes long, n_tokens long, fit_chars long")
    return done.select(F.col("id").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "fit_chars")


def _prefixes(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    cache = word_tokens(path, False)
    for batch in pieces(batches, "text", 1 << 18):
        found = [prefix_counts(cache, t or "") for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["id", "counts"])


def token_prefixes(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored table itself: ``key`` and counts, an array whose element i is the token count of the first i
    code points (null text: [0]).  Answers any later truncation or budget question without encoding again."""
    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(lambda b: _prefixes(b, path), f"id {kind}, counts array<int>").withColumnRenamed("id", key)
