"""The ranker against the definition of its loss, and what its scores may depend on."""

import numpy as np
from pyspark.sql import functions as F

from wattline.llm.quality import KNOTS, chance, expanded, fit_pairs, fit_ranker, labelled_sample, text_features
from wattline.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def labelled(seed=1, n=300):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 4)) * [1, 5, 0.1, 0] + [0, 3, 1, 7]
    y = (x[:, 0] + 0.3 * x[:, 1] + rng.standard_normal(n) > 0.8).astype(int)
    return x, y


def test_weights_minimise_the_pairwise_loss():
    """The slope of the loss, taken by differences, is nothing at the weights; nearby weights are worse."""
    x, y = labelled()
    pairs = 2000
    ranker = fit_pairs(x, y, pairs, seed=4)
    wide = expanded(x, ranker.mean, ranker.scale, ranker.knots)
    z = np.clip((x - x.mean(axis=0)) / np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1), -8, 8)
    assert np.allclose(ranker.knots, np.quantile(z, KNOTS, axis=0))
    rng = np.random.default_rng(4)  # the pairs that were drawn
    good, bad = (np.flatnonzero(y == v) for v in (1, 0))
    better, worse = rng.permutation(np.resize(good, pairs)), rng.permutation(np.resize(bad, pairs))
    assert (y[better] == 1).all() and (y[worse] == 0).all()

    def loss(w):
        return np.logaddexp(0, -(wide[better] - wide[worse]) @ w).sum() + 0.5 * (w @ w)

    least = loss(ranker.weights)
    for i in range(len(ranker.weights)):
        step = np.zeros(len(ranker.weights))
        step[i] = 1e-4
        up, down = loss(ranker.weights + step), loss(ranker.weights - step)
        assert abs(up - down) / 2e-4 < 1e-2 and min(up, down) >= least - 1e-6
    for _ in range(20):
        assert loss(ranker.weights + 0.05 * rng.standard_normal(len(step))) > least


def test_chances_minimise_their_own_loss():
    x, y = labelled(2)
    ranker = fit_pairs(x, y, 2000)
    score = expanded(x, ranker.mean, ranker.scale, ranker.knots) @ ranker.weights

    def loss(slope, shift):
        level = slope * score + shift
        return (np.logaddexp(0, level) - y * level).sum()

    least = loss(ranker.slope, ranker.shift)
    for a, b in ((0.02, 0), (-0.02, 0), (0, 0.05), (0, -0.05)):
        assert loss(ranker.slope + a, ranker.shift + b) > least - 0.02
    assert np.allclose(ranker.chances(x), chance(ranker.slope * score + ranker.shift)) and ranker.slope > 0


def test_scores_rank_texts_of_label_one_higher():
    x, y = labelled(3, 600)
    p = fit_pairs(x[:300], y[:300]).chances(x[300:])
    good, bad = p[y[300:] == 1], p[y[300:] == 0]
    assert (good[:, None] > bad[None, :]).mean() > 0.8


def test_held_out_labels_and_other_columns_move_no_score(spark, tmp_path):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    docs.write.parquet(str(tmp_path / "a" / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "a" / "labels.parquet"))
    docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("s")).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality"))).write.parquet(str(tmp_path / "b" / "labels.parquet"))
    a, b = (sorted(map(tuple, QUERIES["op4_quality"](spark, str(tmp_path / p)).collect())) for p in "ab")
    assert a == b and len(a) == docs.count()
    assert all(r[3] == int(r[2] >= 0.7) and r[1] == (r[0] is not None and bool(spark_crc(r[0]) % 4 == 2)) for r in a)
    labels.withColumn("quality", 1 - F.col("quality")).write.parquet(str(tmp_path / "c" / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "c" / "documents.parquet"))
    c = sorted(map(tuple, QUERIES["op4_quality"](spark, str(tmp_path / "c")).collect()))
    assert [r[2] for r in c] != [r[2] for r in a]


def spark_crc(doc):
    import zlib

    return zlib.crc32(str(doc).encode())


def test_a_sample_taken_first_fits_the_same(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    labels = labels.unionAll(labels.limit(3)).unionAll(spark.createDataFrame([(None, 1, 0), (10**9, 0, 0), (5, 7, 0)], labels.schema))
    for sample in (10**6, 40):
        some = labelled_sample(docs, labels, sample=sample)
        whole, first = (fit_ranker(text_features(d), labels, sample=sample) for d in (docs, some))
        assert np.allclose(whole.weights, first.weights) and np.isclose(whole.threshold(0.01), first.threshold(0.01))
        assert some.count() <= sample and some.columns == docs.columns
    assert labelled_sample(docs.limit(0), labels).count() == 0
