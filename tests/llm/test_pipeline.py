"""The corpus pipeline stage by stage against plain Python, on the smallest tables and on odd ones."""


import pytest

import corpus_pipeline
from .test_texts import components_by_hand, removed_by_hand, shingles
from wattline.llm.queries import WORD_BPE, tokenizer
from wattline.llm.secrets import masked, secret_spans
from wattline.llm.tokens import load

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """Rows after each stage."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    out.append({r["doc_id"]: r.asDict() for r in docs.collect()})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.append({r["doc_id"]: r.asDict() for r in docs.collect()})
    return out, corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()


def test_quality_stage(spark, kept):
    before, after = kept[0][0], kept[0][1]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in after for i in good) >= 0.95 * len(good)
    bad = [i for i, q in labels.items() if q == 0]
    assert sum(i not in after for i in bad) >= 0.5 * len(bad)
    assert all(after[i] == before[i] for i in after)


@pytest.mark.parametrize("percent", [80, 85])
def test_near_stage(spark, kept, percent):
    """The stage takes a similarity of 0.8; its argument may ask for another."""
    before, after = kept[0][1], kept[0][2]
    if percent != corpus_pipeline.NEAR_PERCENT:
        rows = spark.createDataFrame([tuple(r.values()) for r in before.values()], "doc_id long, text string, lang string, source string, n_chars long")
        after = {r["doc_id"]: r.asDict() for r in corpus_pipeline.near_duplicates(spark, rows, FOLDER, percent=percent).collect()}
    ids = sorted(before)
    smallest = components_by_hand(ids, [shingles(before[i]["text"]) for i in ids], lambda a, b: 100 * len(a & b) >= percent * len(a | b))
    assert set(after) == set(smallest.values()) and all(after[i] == before[i] for i in after)


def test_passage_stage(kept):
    before, after = kept[0][2], kept[0][3]
    ids = sorted(before)
    for i, (_, n, text, _) in zip(ids, removed_by_hand([before[i]["text"] for i in ids], 35)):
        assert after[i]["text"] == (text if n else before[i]["text"])
        assert not n or after[i]["n_chars"] == len(text)


def test_secret_stage(kept):
    before, after = kept[0][3], kept[0][4]
    for i, row in before.items():
        spans = secret_spans(row["text"], 8.0, 8)
        want = masked(row["text"], [(s, e) for s, _, e, _ in spans], "<secret>") if spans else row["text"]
        assert after[i]["text"] == want
        assert spans or after[i] == row


def test_packing_stage(kept):
    library = load(tokenizer(WORD_BPE))
    total = sum(len(library.encode(r["text"], add_special_tokens=False).ids) + 1 for r in kept[0][4].values())
    assert sum(p["length"] for p in kept[1]) == total and {p["doc_id"] for p in kept[1]} == set(kept[0][4])


def test_run(spark, kept):
    got = corpus_pipeline.run(spark, FOLDER)
    assert sorted((p["doc_id"], p["start"], p["ids_crc32"]) for p in got.collect()) == sorted((p["doc_id"], p["start"], p["ids_crc32"]) for p in kept[1])


def test_odd_rows(spark):
    rows = [(None, "null id " * 9, "a"), (None, None, "b"), (1, None, "c"), (2, "", "d"), (3, "same words here and there again", "e"), (3, "same words here and there again", "f"),
            (4, "same words here and there again", "g"), (5, "long " * 30_000, "h"), (6, 'token = "abcdefghijklmnop"', "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string").selectExpr("*", "1 AS score")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns, name
        n = out.count()
        assert n == (7 if name == "near_duplicates" else 9), name
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
    assert corpus_pipeline.STAGES[4][1](spark, docs, FOLDER).count() >= 9
    out = corpus_pipeline.STAGES[0][1](spark, docs, FOLDER)
    assert out.columns == docs.columns and out.count() <= 9
