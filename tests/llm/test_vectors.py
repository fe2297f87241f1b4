"""Vector operators against brute force, and cells against the definition of the lattice."""

import numpy as np
import pytest

from wattline.llm.lattice_pairs import SHORTEST, lattice_point, met_before, near_vectors
from wattline.llm.probing import Hashes, nearest_vectors
from wattline.llm.queries import QUERIES
from wattline.llm.rows import components

BAD = [None, [], [0.0, 0.0], [None, 1.0], [float("nan"), 1.0], [float("inf"), 1.0]]
KIND = "vec_id long, embedding array<float>, label int, node string"


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def some_vectors(seed=0, n=300, d=64):
    rng = np.random.default_rng(seed)
    x = unit(rng.standard_normal((n, d)))
    for i in range(0, n, 3):  # pairs at all angles near the threshold
        away = rng.standard_normal(d)
        away = unit(away - (away @ x[i]) * x[i])
        c = rng.uniform(0.9, 1.0)
        x[i + 1] = c * x[i] + np.sqrt(1 - c * c) * away
    x[n // 2 :: 10] = x[5]
    return x * rng.uniform(0.5, 2, (n, 1)).round(1)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    x = some_vectors()
    rows = [(i, v.tolist(), int(rng.integers(0, 2)) if i % 3 == 2 else (i // 3) % 2, "x") for i, v in enumerate(x)]
    rows += [(1000 + i, v, 0, None) for i, v in enumerate(BAD)] + [(2000, x[5].tolist(), None, "n"), (2001, [1.0, 2.0], 0, "n"), (2002, [1.0, 2.0], 0, "n"), rows[5]]
    return spark.createDataFrame(rows, KIND).repartition(4).cache()


def valid(v):
    return v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)


def test_lattice():
    x = np.random.default_rng(2).normal(scale=2, size=(500, 8))
    z = lattice_point(x)
    whole = z % 1 == 0
    assert (whole.all(axis=1) | (z % 1 == 0.5).all(axis=1)).all() and (z.sum(axis=1) % 2 == 0).all()
    gap = ((x - z) ** 2).sum(axis=1)
    assert (gap[:, None] <= ((x[:, None, :] - z[:, None, :] - SHORTEST[None]) ** 2).sum(axis=2) + 1e-9).all()
    assert len(SHORTEST) == 240 and np.allclose((SHORTEST**2).sum(axis=1), 2)


def test_met_before():
    slots = [np.array(s) for s in ([1, 5, 9], [5, 9], [9, 11], [1, 9])]
    want = np.array([[True, True, False, True], [True, True, False, False], [False, False, False, False], [True, False, False, True]])
    got = met_before(slots, 9)
    off = ~np.eye(4, dtype=bool)
    assert (got[off] == want[off]).all()


@pytest.mark.parametrize("block", [256, 8])
def test_near_vectors(vectors, monkeypatch, block):
    from wattline.llm import lattice_pairs

    monkeypatch.setattr(lattice_pairs, "BLOCK", block)
    rows = vectors.collect()
    n = len(rows)
    ok = [bool(valid(r["embedding"])) and r["label"] is not None for r in rows]
    link = np.zeros((n, n), dtype=bool)
    for a in range(n):
        for b in range(n):
            if a != b and ok[a] and ok[b] and rows[a]["label"] == rows[b]["label"] and len(rows[a]["embedding"]) == len(rows[b]["embedding"]):
                x, y = np.array(rows[a]["embedding"]), np.array(rows[b]["embedding"])
                link[a, b] = x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93
    reach = link | np.eye(n, dtype=bool)
    while True:
        more = reach @ reach
        if (more == reach).all():
            break
        reach = more
    ids = np.array([r["vec_id"] for r in rows])
    want = sorted((int(ids[i]), int(link[i].sum()), int(ids[reach[i]].min()), bool(ids[i] == ids[reach[i]].min())) for i in range(n))
    assert sorted(map(tuple, near_vectors(vectors).collect())) == want
    assert near_vectors(vectors.limit(0)).count() == 0


def test_a_dense_group(spark):
    """Two thousand vectors all close to each other: every one links with all others."""
    rng = np.random.default_rng(4)
    x = unit(unit(rng.standard_normal(64)) + 0.005 * rng.standard_normal((2000, 64)))
    df = spark.createDataFrame([(i, v.tolist(), 1, None) for i, v in enumerate(x)], KIND)
    got = near_vectors(df).toPandas()
    assert (got.n_links == 1999).all() and (got.component_id == 0).all()


def nearest_by_hand(rows, n):
    ok = [r for r in rows if valid(r["embedding"])]
    ok = list({(r["vec_id"], tuple(r["embedding"])): r for r in ok}.values())
    out = {}
    for q in ok:
        if q["vec_id"] % 20 == 0:
            found = [
                (-float((np.array(r["embedding"]) * np.array(q["embedding"])).sum()), r["vec_id"])
                for r in ok if r["vec_id"] != q["vec_id"] and len(r["embedding"]) == len(q["embedding"])
            ]
            out[q["vec_id"]] = sorted(found)[:n]
    return out


def test_nearest_vectors(vectors, monkeypatch):
    from wattline.llm import probing

    rows = vectors.collect()
    asked = vectors.where("vec_id % 20 = 0")
    for block in (10_000, 20):
        monkeypatch.setattr(probing, "BLOCK", block)
        want = nearest_by_hand(rows, 20)
        got = {}
        for r in nearest_vectors(vectors, asked).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
        met = total = 0
        for q, best in want.items():
            found = sorted(got.get(q, []))
            assert [f[0] for f in found] == list(range(1, len(found) + 1)) and len(found) <= 20
            assert [(-f[1], f[2]) for f in found] == sorted((-f[1], f[2]) for f in found)
            exact = dict((i, -s) for s, i in nearest_by_hand(rows, 10**6)[q])
            assert all(abs(exact[f[2]] - f[1]) < 1e-12 for f in found)
            met += len({i for _, i in best} & {f[2] for f in found})
            total += len(best)
        assert met / total >= 0.95
        assert set(got) <= set(want)
    assert nearest_vectors(vectors.limit(0), asked).count() == 0
    assert nearest_vectors(vectors, asked.limit(0)).count() == 0


def test_every_cell_probed_finds_all(vectors, monkeypatch):
    """With all steps probed in cells wider than all projections the search is exact, ties and copies included."""
    from wattline.llm import probing

    monkeypatch.setattr(probing, "WIDTHS", (50.0,))
    rows = vectors.collect()
    got = {}
    for r in nearest_vectors(vectors, vectors.where("vec_id % 20 = 0"), tables=2, size=3, probes=27).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert {q: [i for _, i in sorted(found)] for q, found in got.items()} == {q: [i for _, i in best] for q, best in nearest_by_hand(rows, 20).items()}


def test_probes_come_in_order_of_cost():
    h = Hashes(1, 3, 27, 1.0, 1.0)
    q = np.random.default_rng(3).standard_normal((5, 10))
    codes = h.query(q, 0)
    own = h.data(q / np.linalg.norm(q, axis=1, keepdims=True))
    assert (codes[:, 0] == own[:, 0]).all() and all(len(set(c)) == 27 for c in codes.tolist())


def test_components(spark):
    rng = np.random.default_rng(6)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(int(a), int(b)) for a, b in rng.integers(0, 100, (60, 2))] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    low = {}
    for a, b in pairs:
        if a != b:
            low.setdefault(a, a), low.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if a != b:
                m = min(low[a], low[b])
                changed |= low[a] != m or low[b] != m
                low[a] = low[b] = m
    assert got == low


def test_queries_run(spark):
    folder = "/root/testdata/sf0.001"
    assert QUERIES["op8_near_vectors"](spark, folder).count() == spark.read.parquet(f"{folder}/embeddings.parquet").count()
    found = QUERIES["op6_neighbours"](spark, folder).toPandas()
    rows = [r for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want = nearest_by_hand(rows, 20)
    met = sum(len({i for _, i in want[q]} & set(g.vec_id)) for q, g in found.groupby("query_id"))
    assert met >= 0.9 * sum(map(len, want.values()))


def test_isolated_queries_have_all_their_neighbours(spark):
    """Most vectors lie in tight clusters, which fix a narrow width; a few lie far from everything, one has no like."""
    rng = np.random.default_rng(8)
    centres = unit(rng.standard_normal((40, 64)))
    x = np.concatenate([unit(centres[np.arange(5000) % 40] + 0.02 * rng.standard_normal((5000, 64))), unit(rng.standard_normal((75, 64)))])
    rows = [(i, v.tolist(), 0, None) for i, v in enumerate(x)] + [(9000, [1.0, 2.0], 0, None), (9001, [2.0, 2.0], 0, None)]
    df = spark.createDataFrame(rows, KIND)
    got = {}
    for r in nearest_vectors(df, df.where("vec_id % 50 = 0 OR vec_id >= 5000")).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    asked = [*range(0, 5000, 50), *range(5000, 5075)]
    assert sorted(got) == [*asked, 9000, 9001] and all(len(got[q]) == 20 for q in asked) and got[9000] == [9001]
    x = np.array([r[1] for r in rows[: len(x)]], dtype=np.float32).astype(float)
    shares = []
    for q in asked:
        score = x @ x[q]
        score[q] = -9
        shares.append(len(set(np.argsort(-score)[:20].tolist()) & set(got[q])) / 20)
    assert min(shares[100:]) == 1.0 and np.mean(shares) >= 0.98


def test_chance_to_meet_is_that_of_random_projections():
    rng = np.random.default_rng(9)
    q = unit(rng.standard_normal((400, 32)))
    away = rng.standard_normal((400, 32))
    away = unit(away - (away * q).sum(axis=1, keepdims=True) * q)
    for cosine in (0.9, 0.5):
        y = cosine * q + np.sqrt(1 - cosine**2) * away
        h = Hashes(2, 4, 30, 0.8, 1.0)
        codes = h.data(y)
        seen = np.mean([any(codes[i, t] in h.query(q[i : i + 1], t)[0] for t in range(2)) for i in range(400)])
        assert abs(seen - h.met(q, np.full(400, cosine)).mean()) < 0.08


@pytest.mark.parametrize("cells,sharing", [(1, 1), (7, 7), (60, 40), (600, 5)])
def test_a_block_answers_from_the_probed_cells(cells, sharing):
    """Few or many candidates, in any order of the cells: the best of the probed cells and nothing else."""
    import pyarrow as pa

    from wattline.llm.probing import Block

    rng = np.random.default_rng(cells)
    x, codes = rng.standard_normal((600, 8)), rng.integers(0, cells, 600)
    parts = [pa.RecordBatch.from_arrays(
        [pa.array([[i] for i in range(600)], pa.list_(pa.int64())), pa.array([[int(c)] for c in codes], pa.list_(pa.int64())),
         pa.array(list(x), pa.list_(pa.float64()))], ["ids", "codes", "vector"])]
    own, probed = list(range(0, 600, 6)), [rng.permutation(cells)[:sharing].tolist() for _ in range(100)]
    got = Block(parts).nearest(own, x[own], probed, 5)
    for i, cell, found in zip(own, probed, got):
        score = (x * x[i]).sum(axis=1)
        allowed = [j for j in np.flatnonzero(np.isin(codes, cell)).tolist() if j != i]
        assert [f["id"] for f in found] == sorted(allowed, key=lambda j: (-score[j], j))[:5]
        assert [-f["less"] for f in found] == [score[f["id"]] for f in found]


@pytest.mark.parametrize("n,scale", [(3, 1.0), (20, 1.0), (600, 1.0), (5000, 1.0), (5000, 1e25)])
def test_a_scan_of_a_block_compares_all_its_vectors(n, scale):
    """Near ties, equal scores and vectors of very different lengths included, with a bound and without."""
    from wattline.llm.probing import Block

    rng = np.random.default_rng(n)
    x = rng.standard_normal((n, 8)).round(1)
    x[0] *= scale
    x[1::7] = x[1] * (1 + 1e-9 * np.arange(len(x[1::7])))[:, None]
    keys = rng.permutation(2 * n).reshape(n, 2)
    keys.sort(axis=1)
    part = {"size": 8, "many": np.full(n, 2, dtype=np.int32), "ids": keys.ravel(), "codes": None, "x": x}
    block, q = Block.of_packed([part]), x[rng.integers(0, n, 70)]
    score = (x * q[:, None, :]).sum(axis=2)
    every = [sorted((-s, int(k)) for s, two in zip(own, keys) for k in two) for own in score]
    for least in (np.full(70, -np.inf), np.array([-e[4][0] for e in every])):
        of, less, ids = block.scanned(q, least, 5)
        for i, want in enumerate(every):
            assert list(zip(less[of == i].tolist(), ids[of == i].tolist())) == want[:5]


def test_candidates_grow_less_than_the_vectors():
    """A hundred times the vectors: more projections and narrower cells, in which neighbours are met all the same."""
    from wattline.llm.probing import fit_hashes

    rng = np.random.default_rng(10)
    x = unit(np.tanh(rng.standard_normal((6000, 6)) @ rng.standard_normal((6, 32))) + 0.05 * rng.standard_normal((6000, 32)))
    q, x = x[:60], x[60:]
    near = np.linspace(0.975, 0.95, 20)[None].repeat(60, axis=0)
    pairs = []
    for total in (10**5, 10**7):
        h = fit_hashes(q, near, x, total, total // 20, 4, 6, 200, 0.98, 1.0)
        codes = h.data(x)
        share = np.mean([[np.isin(codes[:, t], probed).mean() for probed in h.query(q, t)] for t in range(h.tables)])
        pairs.append(share * h.tables * total)
        assert (h.met(q, near[:, -1]) >= 0.9).mean() >= 0.95
    assert pairs[1] < 30 * pairs[0]


@pytest.mark.parametrize("little", [30e9, 0.0])
def test_vectors_without_structure_asked_several_times(spark, monkeypatch, little):
    """Nothing is near to anything: all the same, every query has its neighbours, equal ones and repeated keys included."""
    from wattline.llm import probing

    monkeypatch.setattr(probing, "LITTLE", little)
    rng = np.random.default_rng(11)
    x = unit(rng.standard_normal((1500, 64))).astype(np.float32)
    rows = [(i, v.tolist(), 0, None) for i, v in enumerate(x)]
    rows += [(20 * i, v.tolist(), 0, None) for i, v in enumerate(x[1000:1005])] + [(2000 + 20 * i, x[0].tolist(), 0, None) for i in range(30)]
    df = spark.createDataFrame(rows, KIND)
    got = {}
    for r in nearest_vectors(df, df.where("vec_id % 20 = 0 AND vec_id >= 100")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    want = {q: [i for _, i in best] for q, best in nearest_by_hand(df.collect(), 20).items() if q >= 100}
    assert sorted(got) == sorted(want) and all(len(found) == 20 for found in got.values())
    share = [len(set(want[q]) & {i for _, i in found}) / 20 for q, found in got.items()]
    assert np.mean(share) >= 0.95
