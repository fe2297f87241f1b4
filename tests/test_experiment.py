"""Whole runs from settings over small files."""

import numpy as np
import pandas as pd
import pytest

from wattline.config import DATASETS, DataSettings, EvaluationSettings, Experiment, FederationSettings, ModelSettings, TrainingSettings, grid_settings
from wattline.plans.experiment import evaluate_experiment, run_experiment
from wattline.sources.readings import building_schema
from wattline.sources.stores import load_checkpoint


def buildings(ids, hours, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for b in ids:
        for h in range(hours):
            row = {c.strip().split(" ")[0]: float(rng.normal()) for c in building_schema().split(",")}
            odd = int(rng.random() < 0.2)
            row |= {"building_id": b, "timestamp": pd.Timestamp("2016-01-01") + pd.Timedelta(hours=h), "anomaly": odd,
                    "primary_use": "Office", "site_id": 1, "is_holiday": 0}
            rows.append(row)
    return pd.DataFrame(rows)


def test_buildings(spark, tmp_path):
    for n in (1, 2):
        buildings([10 * n, 10 * n + 1], 120, n).to_csv(tmp_path / f"data{n}.csv", index=False)
    buildings([5], 90, 9).to_csv(tmp_path / "test.csv", index=False)
    settings = Experiment(
        data=DataSettings(path=str(tmp_path), test_path=str(tmp_path / "test.csv"), window=6, stride=3, gap_hours=4),
        model=ModelSettings("mlp", hidden_size=4, num_layers=1),
        training=TrainingSettings(learning_rate=0.01, local_epochs=1),
        federation=FederationSettings(clients=2),
        evaluation=EvaluationSettings(str(tmp_path / "ck")),
    )
    done = run_experiment(spark, settings)
    assert done.eval_results.count() == 4 and done.metrics["input_dim"] == pytest.approx(6 * 46)
    assert load_checkpoint(spark, str(tmp_path / "ck"), "run")["config"]["data"]["window"] == 6
    final = evaluate_experiment(spark, settings)
    assert sum(r["n"] for r in final["matrix"].collect()) == len(range(0, 90 - 24 - 6, 3))
    assert final["threshold"] == 0.5 and final["report"].count() == 5


def test_grid_log(spark, tmp_path):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 200)
    table = pd.DataFrame({"f1": rng.normal(size=200) + y, "f2": [np.inf, np.nan, *rng.normal(size=198)],
                          " marker": np.where(y == 1, " Attack", "Natural ")})
    path = str(tmp_path / "log.csv")
    table.to_csv(path, index=False)
    settings = Experiment(
        data=grid_settings(path), federation=FederationSettings("shared", clients=3),
        training=TrainingSettings(learning_rate=1.0, local_epochs=5),
        evaluation=EvaluationSettings(str(tmp_path / "ck")),
    )
    done = run_experiment(spark, settings)
    rows = {(r["round"], r["client_id"]): r["num_examples"] for r in done.fit_results.collect()}
    assert sorted(rows.values()) == sorted(2 * [67 - 13, 67 - 13, 66 - 13])
    assert done.history.where("metric = 'pr_auc' and round = 2").first()["value"] > 0.6
    with pytest.raises(ValueError):
        evaluate_experiment(spark, settings)


def test_unknown_names():
    with pytest.raises(ValueError, match="building_readings"):
        DATASETS["nothing"]
    with pytest.raises(ValueError):
        Experiment(task="other")


def test_a_building_run_learns(spark, tmp_path):
    """A reading far above the others is followed by an anomaly: the run must find that, whatever the columns' scales."""
    for n in (1, 2):
        rows = buildings([10 * n, 10 * n + 1], 260, n)
        rng = np.random.default_rng(n)
        spike = rng.random(len(rows)) < 0.25
        rows["meter_reading"] = 50 + 40 * spike + rng.normal(size=len(rows))
        rows["square_feet"], rows["year_built"] = 120_000.0, 1987.0
        rows["anomaly"] = np.roll(spike, 1).astype(int)
        rows.to_csv(tmp_path / f"data{n}.csv", index=False)
    settings = Experiment(
        data=DataSettings(path=str(tmp_path), window=6, stride=2, gap_hours=4),
        training=TrainingSettings(learning_rate=0.3, local_epochs=10),
        federation=FederationSettings(clients=2, rounds=2), evaluation=EvaluationSettings(str(tmp_path / "ck")),
    )
    area = run_experiment(spark, settings).history.where("metric = 'pr_auc' and round = 2").first()["value"]
    assert area > 0.25 + 0.35
