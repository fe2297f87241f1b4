"""Whitening against a dense eigendecomposition."""

import numpy as np
import pytest

from wattline.llm.queries import QUERIES
from wattline.llm.whitening import Centre, bidiagonal, whiten_vectors, whole

KIND = "vec_id long, embedding array<float>, component string, n int, id string"


def by_hand(vectors, components=16):
    x = np.floor(64 * np.asarray(vectors, dtype=np.float64)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), [int(v) for v in fit.sum(axis=0)]
    mean = np.array([v / n for v in s])
    centred = fit - mean
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    k = int((e[:components] > 1e-10 * e[0]).sum())
    dev = [sum((n * int(a) - b) ** 2 for a, b in zip(row, s)) for row in x]
    return n, dev, (x - mean) @ (v[:, :k] / np.sqrt(e[:k])), e[:k] / e.sum()


def check(got, ids, vectors, components=16):
    n, dev, whitened, shares = by_hand(vectors, components)
    rows = sorted(map(tuple, got))
    k = len(shares)
    assert len(rows) == len(ids) * k
    table = {}
    for r in rows:
        table.setdefault(r[0], []).append(r)
    signs = None
    for i, key in enumerate(ids):
        mine = table[key]
        assert [r[1] for r in mine] == list(range(1, k + 1)) and {r[2] for r in mine} == {n} and {r[3] for r in mine} == {dev[i]}
        assert np.allclose([r[5] for r in mine], shares, rtol=1e-9)
        values = np.array([r[4] for r in mine])
        signs = np.sign(values * whitened[i]) if signs is None else signs
        assert np.allclose(values * signs, whitened[i], atol=1e-8)
    assert len({r[6] for r in rows}) <= 1 and all(r[6] < 1e-9 for r in rows)


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(3)
    x = (rng.standard_normal((400, 24)) * rng.uniform(0.05, 2, 24) + rng.uniform(-3, 3, 24)).astype(np.float32)
    x[::3] = x[1]  # a third of the rows are copies
    x[5:9] = x[4] + 1e-4  # the same whole vectors but for a border
    return x


def test_whitening(spark, cloud):
    rows = [(i, v.tolist(), "c", i, "x") for i, v in enumerate(cloud)]
    bad = [(900 + i, v, None, None, None) for i, v in enumerate([None, [], [float("nan")] * 24, [float("inf")] + [0.0] * 23, [None] + [0.0] * 23])]
    df = spark.createDataFrame(rows + bad, KIND).repartition(5)
    done = whiten_vectors(df)
    assert done.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(done.collect(), list(range(len(rows))), cloud)
    check(whiten_vectors(df, components=3).collect(), list(range(len(rows))), cloud, 3)
    assert whiten_vectors(df.limit(0)).collect() == []


def test_fewer_steps_settle_on_the_leading_components(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((500, 40)) * np.r_[np.full(3, 0) + [50.0, 20.0, 9.0], np.full(37, 0.5)]
    df = spark.createDataFrame([(i, v.tolist(), None, None, None) for i, v in enumerate(x)], KIND)
    check(whiten_vectors(df, components=3, steps=39).collect(), list(range(500)), x.astype(np.float32), 3)


def test_little_variance(spark):
    """Equal vectors and a single one have no components; fewer dimensions than components give as many as vary."""
    same = spark.createDataFrame([(i, [1.0, 2.0], None, None, None) for i in range(9)], KIND)
    assert whiten_vectors(same).collect() == [] and whiten_vectors(same.limit(1)).collect() == []
    rng = np.random.default_rng(5)
    x = np.zeros((50, 6))
    x[:, 1:3] = rng.standard_normal((50, 2))
    x[:, 4] = x[:, 1] * 0 + 7
    df = spark.createDataFrame([(i, v.tolist(), None, None, None) for i, v in enumerate(x)], KIND)
    check(whiten_vectors(df).collect(), list(range(50)), x.astype(np.float32))


def test_equal_eigenvalues(spark):
    """Corners of a simplex: any basis will do, but whitened vectors must have the identity as covariance."""
    x = np.eye(7)
    df = spark.createDataFrame([(i, v.tolist(), None, None, None) for i, v in enumerate(x)], KIND)
    rows = whiten_vectors(df).collect()
    assert len(rows) == 7 * 6 and all(abs(r["explained"] - 1 / 6) < 1e-12 and r["identity_error"] < 1e-12 for r in rows)
    y = np.zeros((7, 6))
    for r in rows:
        y[r["vec_id"], r["component"] - 1] = r["whitened"]
    assert np.allclose(y.T @ y / 7, np.eye(6)) and np.allclose(y.sum(axis=0), 0)


def test_lengths_are_separate_fits_and_huge_entries_have_no_deviation(spark):
    rng = np.random.default_rng(6)
    a, b = rng.standard_normal((30, 3)).astype(np.float32), rng.standard_normal((20, 2)).astype(np.float32)
    b[0] = 3e38
    rows = [(i, v.tolist(), None, None, None) for i, v in enumerate(a)] + [(100 + i, v.tolist(), None, None, None) for i, v in enumerate(b)]
    got = whiten_vectors(spark.createDataFrame(rows, KIND)).collect()
    check([r for r in got if r["vec_id"] < 100], list(range(30)), a)
    other = [r for r in got if r["vec_id"] >= 100]
    assert {r["n"] for r in other} == {20} and all(r["deviation"] is None for r in other) and all(np.isfinite(r["whitened"]) for r in other)


def test_exact_sums():
    x = np.array([[5, -3], [2, 1], [0, 1]], dtype=np.int64)
    made = Centre.of(3, [int(v) for v in x.sum(axis=0)])
    assert np.allclose(made(x), x - x.mean(axis=0)) and made.deviations(x) == [((3 * r - x.sum(axis=0)) ** 2).sum() for r in x]
    big = Centre.of(3, [3 << 50, 0])
    assert big.deviations(np.array([[0, 0], [(1 << 50) + 1, 0]])) == [None, 9]
    assert whole(np.array([-0.001, 0.0, 1e300])).tolist() == [999_999, 1_000_000, (1 << 52) + 1_000_000]


@pytest.mark.parametrize("spread", [1.0, 1e-4])
def test_bidiagonalisation(spread):
    rng = np.random.default_rng(7)
    a = rng.standard_normal((60, 20)) * np.geomspace(1, spread, 20)
    values, right = bidiagonal(lambda w, v: ((a @ w).T @ (a @ v), float((a @ v) @ (a @ v)), a.T @ (a @ v)), 20, 20, 16)
    _, s, v = np.linalg.svd(a)
    assert np.allclose(values, s, rtol=1e-9) and np.allclose(right.T @ right, np.eye(20), atol=1e-10)
    assert np.allclose(np.abs((right * v.T).sum(axis=0)), 1, atol=1e-8)


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    check(QUERIES["op13_whitening"](spark, folder).collect(), [r["vec_id"] for r in rows], [r["embedding"] for r in rows])
