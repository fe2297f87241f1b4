"""Cutoffs, splits, samples and assignments: exact sizes, boundaries, coverage."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wattline.operators import clients as K
from wattline.operators import splits as D


def times(spark, hours, node=1):
    rows = [(node, i, (pd.Timestamp("2024-01-01") + pd.Timedelta(hours=h)).to_pydatetime(), i % 2, float(i)) for i, h in enumerate(hours)]
    return spark.createDataFrame(rows, "node int, key long, ts timestamp, y int, v double")


def test_cutoff_ties(spark):
    """Place int(10 * 0.8) lies among four equal times: all four rows are train."""
    df = times(spark, [0, 1, 2, 3, 4, 5, 6, 6, 6, 6])
    cut = D.time_cutoffs(df, "ts", 0.8).first()["cutoff"]
    assert cut == pd.Timestamp("2024-01-01 06:00")
    assert D.temporal_split(df, "ts", 0.8).where("split = 'train'").count() == 10


@pytest.mark.parametrize("ratio", [0.0, 0.37, 1.0 - 0.2, 0.999])
def test_cutoff_equals_sorted_place(spark, ratio):
    rng = np.random.default_rng(5)
    micros = np.sort(rng.integers(-10**13, 10**15, 977))
    df = spark.createDataFrame([(int(m), int(m) % 3) for m in micros], "m long, c int").select(
        F.timestamp_micros("m").alias("ts"), "c"
    )
    got = D.time_cutoffs(df, "ts", ratio).select(F.unix_micros("cutoff")).first()[0]
    assert got == micros[int(len(micros) * ratio)]
    for r in D.time_cutoffs(df, "ts", ratio, ["c"]).select("c", F.unix_micros("cutoff").alias("m")).collect():
        own = micros[micros % 3 == r["c"]]
        assert r["m"] == own[int(len(own) * ratio)]


def test_crowded_hour_needs_the_second_pass(spark, monkeypatch):
    monkeypatch.setattr(D, "FEW_ROWS", 3)
    df = times(spark, [i / 7200 for i in range(40)])
    got = D.time_cutoffs(df, "ts", 0.5).first()["cutoff"]
    assert got == pd.Timestamp("2024-01-01") + pd.Timedelta(hours=20 / 7200)


def test_gap_rows(spark):
    """At the cutoff: train; at cutoff + gap: neither; one hour later: validation."""
    df = times(spark, [0, 1, 2, 3, 5, 6])
    got = {r["key"]: r["split"] for r in D.temporal_split(df, "ts", 0.5, 2).collect()}
    assert got == {0: "train", 1: "train", 2: "train", 3: "train", 5: "val"}


def test_windows_stay_on_their_side(spark):
    df = times(spark, range(40))
    out = D.split_windows(df, "node", ["ts", "key"], ["v"], "y", 0.5, 3, 6, 3).collect()
    for r in out:
        place = [int(v[0]) for v in r["x"]]
        assert place == list(range(place[0], place[0] + 6))
        assert max(place) < 20 if r["split"] == "train" else min(place) > 23
    assert {r["split"] for r in out} == {"train", "val"}


def test_each_client_has_its_own_cutoff(spark):
    df = times(spark, range(10)).withColumn("client_id", F.lit(0)).unionAll(
        times(spark, range(100, 110), 2).withColumn("client_id", F.lit(1))
    )
    got = D.temporal_split(df, "ts", 0.8, 0, ["client_id"]).groupBy("client_id", "split").count().collect()
    assert {(r[0], r[1], r[2]) for r in got} == {(c, s, n) for c in (0, 1) for s, n in (("train", 9), ("val", 1))}


def test_exact_split(spark):
    df = spark.range(7)
    got = D.random_split(df, "id", 0.2).groupBy("split").count().collect()
    assert {r[0]: r[1] for r in got} == {"test": 1, "train": 6}
    with pytest.raises(ValueError):
        D.random_split(spark.range(3), "id", 0.2)
    with pytest.raises(ValueError):
        D.random_split(spark.range(0), "id", 0.2)


def test_run_sizes_and_coverage(spark):
    df = spark.range(11).withColumnRenamed("id", "node")
    rows = K.assign_nodes_random(df.unionAll(df), "node", 4)
    sizes = sorted(r["n_nodes"] for r in K.partition_stats(rows, "node").collect())
    assert sizes == [2, 3, 3, 3]
    K.check_no_overlap(rows, "node")
    assert K.assign_nodes_random(df, "node", 20).select("client_id").distinct().count() == 11
    with pytest.raises(ValueError):
        K.assign_nodes_random(df, "node", 0)


@pytest.mark.parametrize("n,k", [(5000, 7), (3, 5), (64, 64)])
def test_rows_in_near_equal_runs(spark, n, k):
    got = K.assign_rows_random(spark.range(n), "id", k).groupBy("client_id").count().collect()
    want = [len(p) for p in np.array_split(np.arange(n), k) if len(p)]
    assert [r[1] for r in sorted(got)] == want
    assert K.assign_rows_random(spark.range(9), "id", 3, mode="local").select("client_id").distinct().count() == 1
    with pytest.raises(ValueError):
        K.assign_rows_random(spark.range(9), "id", 3, mode="other")


def test_null_node_is_kept(spark):
    df = spark.createDataFrame([(1,), (2,), (None,), (None,)], "node int")
    assert K.assign_nodes_random(df, "node", 2).count() == 4


def greedy(counts, k):
    loads = [0] * k
    for n in sorted(counts, reverse=True):
        loads[loads.index(min(loads))] += n
    return loads


@pytest.mark.parametrize("counts,k", [([5, 4, 3, 3, 1], 2), ([1] * 17, 5), ([100, 7, 7, 7, 7, 7, 2, 2, 2], 3)])
def test_balanced_parts(spark, counts, k):
    df = spark.createDataFrame([(i,) for i, n in enumerate(counts) for _ in range(n)], "node int")
    table = K.assign_nodes_balanced(df, "node", k)
    loads = {r[0]: r[1] for r in table.groupBy("client_id").agg(F.sum("n_rows")).collect()}
    assert [loads.get(i, 0) for i in range(k)] == greedy(counts, k)
    assert table.count() == len(counts)


def test_equal_items_like_one_by_one():
    rng = np.random.default_rng(0)
    for _ in range(300):
        k, size, items = int(rng.integers(1, 9)), int(rng.integers(1, 12)), int(rng.integers(0, 40))
        start = rng.integers(0, 60, k)
        loads, took = start.copy(), np.zeros(k, dtype=int)
        for _ in range(items):
            i = int(np.argmin(loads))
            loads[i] += size
            took[i] += 1
        assert K.place_equal_items(start, size, items).tolist() == took.tolist()


def test_client_rows_and_overlap(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "node int, v string")
    table = spark.createDataFrame([(1, 0), (2, 1)], "node int, client_id int")
    assert sorted(r["v"] for r in K.client_rows(df, table, "node", 0).collect()) == ["a", "b"]
    torn = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "node int, client_id int")
    with pytest.raises(ValueError, match="node 1"):
        K.check_no_overlap(torn, "node")


def sample_of(labels, n):
    seen, prefix = set(), []
    for i, y in enumerate(labels):
        prefix.append(i)
        seen.add(y)
        if len(seen) >= 2 and len(prefix) >= n:
            break
    queues = {y: [i for i in prefix if labels[i] == y] for y in sorted(seen)}
    out = []
    while len(out) < n and any(queues.values()):
        for q in queues.values():
            if q and len(out) < n:
                out.append(q.pop(0))
    return out


@pytest.mark.parametrize("labels,n", [([0] * 30 + [1, 0, 1, 1], 8), ([0, 1] * 10, 7), ([2, 0, 1, 1, 1, 0, 2], 5), ([0, 0, 1], 10)])
def test_balanced_sample(spark, labels, n):
    df = spark.createDataFrame(list(enumerate(labels)), "pos long, y int").repartition(4)
    got = D.balanced_sample(df, "y", ["pos"], n).orderBy("turn", "y").collect()
    assert [r["pos"] for r in got] == sample_of(labels, n)


def test_balanced_sample_needs_two_classes(spark):
    with pytest.raises(ValueError):
        D.balanced_sample(spark.createDataFrame([(1, 0), (2, 0)], "pos long, y int"), "y", ["pos"], 2)


def test_select_clients(spark):
    table = spark.range(20).select(F.col("id").alias("c"), (F.col("id") % 2).alias("round"))
    got = D.select_clients(table, "c", 0.35, 2).groupBy("round").count().collect()
    assert {r[0]: r[1] for r in got} == {0: 3, 1: 3}
    assert D.select_clients(table, "c", 0.0, 50).count() == 20
