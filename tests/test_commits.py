"""Stores that survive two writers, repeated appends and a stop between any two steps."""

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattline.plans.search import search
from wattline.sources import readings as S
from wattline.sources import stores as ST
from wattline.sources.commits import Folder, append_part, read_parts, take_numbers

SCHEMA = "study string, v int"


def test_numbers_are_given_out_once(spark, tmp_path):
    path = str(tmp_path / "t")
    with ThreadPoolExecutor(8) as pool:
        found = list(pool.map(lambda _: take_numbers(spark, path, "a study", 5), range(8)))
    assert sorted(n for some in found for n in some) == list(range(40))
    assert take_numbers(spark, path, "a study", 2) == [40, 41] and take_numbers(spark, path, "other/1", 1, 7) == [7]
    assert take_numbers(spark, path, "", 1) == [0]


def test_a_repeated_append_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("1", 1), ("b", 2)], SCHEMA)
    assert read_parts(spark, path, SCHEMA).count() == 0
    assert append_part(rows, path, "study", "first") and not append_part(rows, path, "study", "first")
    assert sorted(map(tuple, read_parts(spark, path, SCHEMA).collect())) == [("1", 1), ("b", 2)]
    with ThreadPoolExecutor(4) as pool:
        told = list(pool.map(lambda _: append_part(rows, path, "study", "second"), range(4)))
    assert read_parts(spark, path, SCHEMA).count() == 4 and any(told)
    append_part(rows, path, "study")
    append_part(rows, path, "study")
    assert read_parts(spark, path, SCHEMA).count() == 8


def test_what_is_not_committed_is_not_read(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("a", 1)], SCHEMA)
    append_part(rows, path, "study", "first")
    monkeypatch.setattr(Folder, "move", lambda self, old, new: (_ for _ in ()).throw(RuntimeError("stopped")))
    with pytest.raises(RuntimeError, match="stopped"):
        append_part(rows, path, "study", "second")
    assert read_parts(spark, path, SCHEMA).count() == 1
    monkeypatch.undo()
    assert append_part(rows, path, "study", "second") and read_parts(spark, path, SCHEMA).count() == 2


def test_two_searches_at_once(spark, tmp_path):
    rng = np.random.default_rng(1)
    table = [([float(v) for v in x], int(x[0] > 0)) for x in rng.normal(size=(60, 3))]
    rows = spark.createDataFrame(table, "x array<double>, y int").cache()
    path = str(tmp_path / "trials")
    with ThreadPoolExecutor(2) as pool:
        done = list(pool.map(lambda _: search(rows, rows, 2, 2, study="s", store=path, hidden=[4], layers=(0, 1)), range(2)))
    told = ST.trial_store(spark, path, "s")
    assert told.groupBy("trial").count().where("count = 2").count() == 4 and told.count() == 8
    assert sorted(r[0] for r in told.select("trial").distinct().collect()) == [0, 1, 2, 3]
    params = {str(sorted(r["params"].items())) for r in told.collect()}
    assert len(params) == 4 and sum(d.count() for d in done) == 8
    more = search(rows, rows, 1, 1, study="s", store=path, hidden=[4], layers=(0, 1))
    assert more.first()["trial"] == 4


def test_a_save_that_stops_leaves_the_one_before(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "ck")
    ST.save_checkpoint(spark, path, "a", 1, [np.ones(2)])
    monkeypatch.setattr(Folder, "move", lambda self, old, new: (_ for _ in ()).throw(RuntimeError("stopped")))
    with pytest.raises(RuntimeError):
        ST.save_checkpoint(spark, path, "a", 2, [np.zeros(2)])
    monkeypatch.undo()
    assert ST.load_checkpoint(spark, path, "a")["round"] == 1
    ST.save_checkpoint(spark, path, "a", 3, [np.zeros(2)])
    assert ST.load_checkpoint(spark, path, "a")["round"] == 3


READINGS = "building_id bigint, timestamp timestamp, meter_reading double, anomaly int"


def parts_of(spark, low, clients):
    return spark.range(12).select(
        (F.col("id") % clients).cast("int").alias("client_id"), F.col("id").alias("building_id"), F.timestamp_micros(F.col("id") * 1_000_000).alias("timestamp"),
        (F.col("id") + low).cast("double").alias("meter_reading"), F.lit(0).alias("anomaly"),
    )


@pytest.mark.parametrize("stop", range(12))
def test_client_files_are_old_or_new(spark, tmp_path, monkeypatch, stop):
    """The driver stops at the ``stop``-th change of the folder: a reader sees the old files or the new ones, all of them."""
    folder = str(tmp_path / "parts")
    S.write_client_parts(parts_of(spark, 0, 3), folder, ["timestamp"])
    left, real = [stop], {n: getattr(Folder, n) for n in ("move", "delete")}

    def counted(name):
        def change(self, *names):
            if not left[0]:
                raise RuntimeError("stopped")
            left[0] -= 1
            return real[name](self, *names)
        return change

    for n in real:
        monkeypatch.setattr(Folder, n, counted(n))
    stopped = False
    try:
        S.write_client_parts(parts_of(spark, 100, 2), folder, ["timestamp"])
    except RuntimeError:
        stopped = True
    monkeypatch.undo()
    found = {(r["client_id"], r["meter_reading"]) for r in S.read_client_files(spark, folder, READINGS).collect()}
    old = {(i % 3, float(i)) for i in range(12)}
    new = {(i % 2, float(i + 100)) for i in range(12)}
    assert found == (old if stop == 0 else new)
    assert stopped == (stop < 8)
    S.write_client_parts(parts_of(spark, 0, 3), folder, ["timestamp"])
    assert {(r["client_id"], r["meter_reading"]) for r in S.read_client_files(spark, folder, READINGS).collect()} == old
    assert sorted(p.name for p in (tmp_path / "parts").iterdir() if p.name[0] not in "._") == [f"file=data{n}.csv" for n in (1, 2, 3)]


BAD_CSV = "building_id,timestamp,meter_reading,anomaly\n1,2016-01-01 00:00:00,1.5,0\n2,abc,1.5,0\n3,2016-01-01 00:00:00,1.5\n4,2016-01-01 00:00:00,,1\n5,2016-01-01 00:00:00,1.5,0,9\n"


def test_malformed_lines_are_kept_apart(spark, tmp_path):
    (tmp_path / "a.csv").write_text(BAD_CSV)
    path, rejects = str(tmp_path / "a.csv"), str(tmp_path / "rejects")
    with pytest.raises(ValueError, match="3 of 5 lines"):
        S.read_readings(spark, path, READINGS, rejects=rejects)
    assert S.rejected_lines(spark, rejects).count() == 0
    for _ in range(2):  # reading again adds nothing
        good = S.read_readings(spark, path, READINGS, "anomaly", rejects=rejects, most=0.7)
        assert sorted((r["building_id"], r["meter_reading"]) for r in good.collect()) == [(1, 1.5), (4, None)]
        assert good.select("building_id").count() == 2 and good.where("anomaly = 1").count() == 1
        told = S.rejected_lines(spark, rejects).collect()
        assert sorted(r["line"] for r in told) == sorted(BAD_CSV.splitlines()[i] for i in (2, 3, 5)) and all(r["file"].endswith("a.csv") for r in told)
    plain = S.read_readings(spark, path, READINGS)
    assert plain.count() == 5 and plain.columns == good.columns


def test_malformed_lines_of_client_files(spark, tmp_path):
    for n in (1, 2):
        (tmp_path / f"data{n}.csv").write_text(BAD_CSV)
    rejects = str(tmp_path / "rejects")
    good = S.load_clients(spark, str(tmp_path), READINGS, "local", "anomaly", 2, rejects=rejects, most=0.7)
    assert sorted((r["client_id"], r["building_id"]) for r in good.collect()) == [(0, 1), (0, 4), (1, 1), (1, 4)]
    assert S.rejected_lines(spark, rejects).count() == 6
    clean = tmp_path / "clean.csv"
    clean.write_text("building_id,timestamp,meter_reading,anomaly\n1,2016-01-01 00:00:00,1.5,0\n")
    assert S.read_readings(spark, str(clean), READINGS, rejects=str(tmp_path / "none")).count() == 1 and not (tmp_path / "none").exists()


def test_reading_a_client_opens_its_files_only(spark, tmp_path):
    from wattline.operators import clients as K

    rows = spark.range(200).select(F.when(F.col("id") % 5 > 0, F.col("id") % 5).alias("node"), "id")
    nodes = spark.createDataFrame([(None, 0), (1, 0), (2, 1), (3, 2), (4, 3)], "node long, client_id int")
    path = str(tmp_path / "clients")
    K.save_client_rows(rows, nodes, "node", path)
    one = K.stored_client_rows(spark, path, 0)
    assert one.count() == 80 and one.where("node IS NULL").count() == 40
    assert "PartitionFilters: [isnotnull(client_id" in one._jdf.queryExecution().executedPlan().toString()
    chosen = nodes.where("client_id > 1")
    some = K.stored_client_rows(spark, path, chosen)
    assert some.count() == 80
    assert "dynamicpruning" in some._jdf.queryExecution().executedPlan().toString().lower()
    with pytest.raises(ValueError):
        K.stored_client_rows(spark, path, -1)
