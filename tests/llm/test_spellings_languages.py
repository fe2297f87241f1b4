"""Spelling variants and languages against plain Python on small corpora with nulls, ties, copies, odd words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wattline.llm import languages, spellings
from wattline.llm.languages import Languages, Sums, expected_pieces, fit_languages, forward, open_pieces, predict_languages, text_sums, word_sums
from wattline.llm.queries import MULTI_BPE, QUERIES, tokenizer
from wattline.llm.spellings import Shard, near_words, rounds, shard_of, spelling_variants, vocabulary

RUN = re.compile("[A-Za-zÀ-ÿ]+")
CAPITALS = {c: c + 32 for c in range(65, 91)}


def texts_of_variants():
    rng = random.Random(5)
    base = ["settlement", "Settlement", "garconne", "garçonne", "ÉCRITURE", "écriture", "nineteen", "ninetee", "aabbccdd", "aabccdd", "×÷àààà×", "shortly"]
    long = "".join(rng.choices("abcdefghij", k=90))
    texts = ["settlement " * 900 + "garçonne " * 70 + "nineteen " * 40]
    for w in base + [long, long[:40] + "z" + long[41:], long[:70], long + long[:50]]:
        variants = [w] * 3
        for _ in range(4):
            i = rng.randrange(len(w))
            variants += rng.choice([[w[:i] + w[i + 1 :]] * 2, [w[:i] + "e" + w[i:]] * 2, [w[:i] + "ö" + w[i + 1 :]] * 4])
        rng.shuffle(variants)
        texts += [" ".join(variants), "1".join(variants) + ".", "|".join(variants).upper()]
    return [*texts, None, "", " \n", "9 8 7", "tiny", texts[3]]


def crc(doc, run):
    return zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())


def vocabulary_by_hand(rows):
    count = Counter()
    for doc, text in rows:
        for run in RUN.findall(text or ""):
            w = run.translate(CAPITALS)
            h = crc(doc, w)
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_hand(rows):
    n = vocabulary_by_hand(rows)
    near = {w: [o for o in n if one_edit(w, o)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


@pytest.fixture(scope="module")
def variant_rows():
    return [*enumerate(texts_of_variants()), (2, "settlement garçonn"), (None, "settlement ninetean"), (None, "ninetean")]


@pytest.fixture(scope="module")
def variant_docs(spark, variant_rows):
    rows = [(d, t, "word", 1, "form") for d, t in variant_rows]
    return spark.createDataFrame(rows, "doc_id long, text string, word string, n long, form string").repartition(4).cache()


def test_vocabulary(variant_docs, variant_rows, monkeypatch):
    assert {r["word"]: r["n"] for r in vocabulary(variant_docs).collect()} == vocabulary_by_hand(variant_rows)
    assert any(crc(d, r.translate(CAPITALS)) % 31 == 0 for d, t in variant_rows for r in RUN.findall(t or "") if len(r) > 7)


def test_slices_never_cut_a_run(monkeypatch):
    monkeypatch.setattr(spellings, "SLICE", 5)
    monkeypatch.setattr(spellings, "KEPT", 3)
    texts = ["abcdefgh ijklmnop; éééééééé x " * 3, "abcdefgh", "x" * 40, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(["1", "2", None, "4"]), pa.array(texts)], ["id", "text"])
    got = Counter()
    for part in spellings._words([batch]):
        got.update(dict(zip(part.column(0).to_pylist(), part.column(1).to_pylist())))
    want = Counter()
    for d, t in zip(["1", "2", None, "4"], texts):
        for w in RUN.findall(t):
            h = crc(d, w)
            w = w if h % 31 else w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                want[w] += 1
    assert got == want


@pytest.mark.parametrize("blocks", [1 << 21, 1500, 4500])
def test_spelling_variants(variant_docs, variant_rows, monkeypatch, blocks):
    monkeypatch.setattr(spellings, "ROUND_BLOCKS", blocks)
    want = variants_by_hand(variant_rows)
    got = sorted(tuple(r) for r in spelling_variants(variant_docs).collect())
    assert got == want
    assert any(form for _, form, *_ in want) and any(n_near > 3 for *_, n_near, _ in want) and any(len(w) > 64 for w, *_ in want)


def test_roots_follow_forms(spark):
    chain = {"aaaaaaaa": 2, "aaaaaaab": 20, "aaaaaabb": 200, "aaaaabbb": 2000, "aaaabbbb": 20000}
    text = " ".join(w for w, n in chain.items() for _ in range(n))
    doc = next(i for i in range(10_000) if all(crc(i, w) % 31 for w in chain))
    got = {r["word"]: (r["form"], r["root"]) for r in spelling_variants(spark.createDataFrame([(doc, text)], "doc_id int, text string")).collect()}
    assert {root for _, root in got.values()} == {"aaaabbbb"} and got["aaaaaaaa"][0] == "aaaaaaab" and got["aaaabbbb"][0] is None


def test_no_words(spark, variant_docs):
    assert spelling_variants(variant_docs.limit(0)).collect() == []
    assert spelling_variants(spark.createDataFrame([(1, None), (2, "seldom once")], "doc_id int, text string")).collect() == []
    assert near_words(spark.createDataFrame([], "word string, n long")).collect() == []


def test_filters_take_few_wrong_edits():
    rng = np.random.default_rng(6)
    words = pa.array(sorted({"".join(rng.choice(list("abcdefghijklmnop"), 9)) for _ in range(60_000)}))
    shards = {9: Shard(len(words))}
    filters = spellings.Filters(shards, rounds(shards)[0])
    for part in spellings._keys([pa.RecordBatch.from_arrays([words], ["word"])], shards):
        table = pa.Table.from_batches([part])
        segment = table.column("segment").to_numpy()
        for s in np.unique(segment).tolist():
            built = spellings._segment(table.filter(pa.array(segment == s)), shards)
            filters.bits |= 0
            some = np.frombuffer(built.column("bits")[0].as_py(), dtype=np.uint32).reshape(-1, spellings.LANES)
            filters.bits[s * spellings.SEGMENT :][: len(some)] |= some
    h = np.concatenate([spellings.spread_out(spellings.word_hashes(x), 9) for _, x in spellings._by_length(words)])
    assert len(filters.held(h, 9)) == len(h)
    other = rng.integers(0, 1 << 63, 200_000, dtype=np.uint64) * np.uint64(2)
    assert len(filters.held(other, 9)) < 0.005 * len(other)
    assert [shard_of(n) for n in (7, 63, 64, 127, 128)] == [7, 63, 65, 65, 66]


# ---------------------------------------------------------------- languages


@pytest.fixture(scope="module")
def trie():
    return open_pieces(tokenizer(MULTI_BPE))


def segmentations(trie, word):
    number = {p: i for i, p in enumerate(trie.pieces)}
    if not word:
        return [[]]
    return [[number[word[:i]], *rest] for i in range(1, len(word) + 1) if word[:i] in number for rest in segmentations(trie, word[i:])]


def test_edges_are_all_pieces(trie):
    number = {p: i for i, p in enumerate(trie.pieces)}
    words = np.array([list(b" winter"), list(b" \xc3\xa9t\xc3\xa9x")], dtype=np.uint8)
    got = sorted(zip(*(x.tolist() for x in trie.edges(words))))
    want = sorted((r, i, j, number[w[i:j]]) for r, w in enumerate(x.tobytes() for x in words) for i in range(7) for j in range(i + 1, 8) if w[i:j] in number)
    assert got == want


def test_sums_over_all_segmentations(trie):
    rng = np.random.default_rng(1)
    chances = np.log(rng.dirichlet(np.ones(len(trie.pieces)), 3))
    for word in (b" the", b" stra\xc3\x9fe", b" a"):
        ways = segmentations(trie, word)
        matrix = np.frombuffer(word, dtype=np.uint8)[None]
        want = [np.log(sum(np.exp(chances[k, w].sum()) for w in ways)) for k in range(3)]
        assert np.allclose(word_sums(trie, matrix, chances)[0], want, rtol=1e-12)
        used = np.zeros(len(trie.pieces))
        for w in ways:
            np.add.at(used, w, np.exp(chances[1, w].sum() - want[1]) * 3)
        at, got = expected_pieces(trie, matrix, np.array([1]), np.array([3]), chances)
        assert (at // len(used) == 1).all()
        flat = np.zeros(len(used))
        flat[at % len(used)] = got
        assert np.allclose(flat, used, atol=1e-12)


def test_whole_texts_and_kept_words(trie, monkeypatch):
    """Texts are the sums over their words, whatever is kept; a giant word is one word."""
    rng = np.random.default_rng(2)
    model = Languages(tokenizer(MULTI_BPE), ("a", "b"), np.log(rng.dirichlet(np.ones(len(trie.pieces)), 2)), np.log([0.5, 0.5]))
    texts = ["The winter\tis LONG", None, "", "été été", "x" * 3000 + " y", "is the winter été", "Ⅳ İ ß"]
    want = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", pa.compute.utf8_lower(pa.scalar(t or "")).as_py())
        want.append(sum((word_sums(trie, np.frombuffer(b" " + w.encode(), dtype=np.uint8)[None], model.chances)[0] for w in words), np.zeros(2)))
    for kept in (100_000, 2, 0):
        monkeypatch.setattr(languages, "KEPT", kept)
        sums = Sums(model)
        for _ in range(3):
            assert np.allclose(text_sums(pa.array(texts), sums), want, rtol=1e-12)


def spoken(seed=3, n=240):
    rng = random.Random(seed)
    words = {"nord": ["wald", "haus", "schnee", "über"], "sur": ["casa", "niño", "mañana", "sol"], "ost": ["лес", "дом", "снег", "зима"]}
    rows = []
    for i in range(n):
        name = rng.choice(list(words))
        rows.append((i, " ".join("".join(rng.choices(words[name], k=rng.choice([1, 2]))) for _ in range(rng.choice([2, 5, 40]))), name))
    return rows


@pytest.fixture(scope="module")
def speech(spark):
    rows = spoken()
    rows += [(1000, None, "nord"), (1001, "", "sur"), (1002, "12 .. 34", "ost"), (None, "schnee wald haus", None), (1, rows[1][1], rows[1][2]), (1003, "Niño " * 5000, None)]
    rows = [(*r, "lang_pred", 0.5) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, id string, score double").repartition(3).cache()


def test_languages(spark, speech):
    path = tokenizer(MULTI_BPE)
    held = F.col("doc_id") % 4 == 2
    model = fit_languages(speech.where(~held | F.col("doc_id").isNull()), path)
    assert model.names == ("nord", "ost", "sur") and np.allclose(np.exp(model.chances).sum(axis=1), 1)
    done = predict_languages(speech, model, held=held)
    assert done.columns == ["doc_id", "held", "lang_pred", "score"]
    got = done.collect()
    assert len(got) == speech.count() and all(0 <= r["score"] <= 1 for r in got)
    by_id = {r["doc_id"]: r for r in got}
    for i, _, name in spoken():
        assert by_id[i]["lang_pred"] == name and by_id[i]["score"] > 0.5
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (1000, 1001, 1002))
    assert by_id[None]["lang_pred"] == "nord" and by_id[1003]["lang_pred"] == "sur"
    assert predict_languages(speech.limit(0), model).collect() == []


def test_copies_teach_once_and_samples_are_drawn_by_text(spark):
    path = tokenizer(MULTI_BPE)
    rows = spoken(n=60)
    once = fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), path)
    again = fit_languages(spark.createDataFrame([*rows, *rows[:1] * 500], "doc_id long, text string, lang string"), path)
    assert np.allclose(once.chances, again.chances) and not np.allclose(once.shares, again.shares)
    few = fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), path, sample=5)
    assert few.names == once.names


def test_nothing_learnt(spark, speech):
    none = fit_languages(speech.where("lang = 'no such'"), tokenizer(MULTI_BPE))
    assert {(r["lang_pred"], r["score"]) for r in predict_languages(speech, none).collect()} == {("und", 0.0)}


def test_query_learns_nothing_from_held_out_rows(spark, tmp_path):
    """Labels and texts of held-out rows may change: no other prediction does."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    docs.write.parquet(str(tmp_path / "a" / "documents.parquet"))
    docs.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("s")).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    a, b = (sorted(map(tuple, QUERIES["op12_languages"](spark, str(tmp_path / p)).collect())) for p in "ab")
    assert [r[:3] for r in a] == [r[:3] for r in b] and np.allclose([r[3] for r in a], [r[3] for r in b])
    named = {r["doc_id"]: r["lang"] for r in docs.collect()}
    tested = [r for r in a if r[1]]
    assert sum(named[r[0]] == r[2] for r in tested) >= 0.97 * len(tested) and len(a) == docs.count()


def test_forward_of_a_long_word():
    """One piece of one byte: the only segmentation."""
    n = 50_000
    at = np.arange(n)
    assert np.isclose(forward(1, n, np.zeros(n, dtype=int), at, at + 1, np.full((n, 1), -1.0))[-1][0, 0], -n)
