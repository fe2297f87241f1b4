"""A whole run from settings: read, prepare, fit over rounds, evaluate, save."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.config import DATASETS, HELD_OUT, LOSSES, MODELS, Experiment
from wattline.functions import columns as C
from wattline.operators import metrics as M
from wattline.operators.clients import assign_rows_random
from wattline.operators.splits import random_split
from wattline.plans.fitting import init_weights, input_width, score
from wattline.plans.preparation import as_vectors, building_strips, building_test_windows, prepare_grid_log
from wattline.plans.rounds import Federated, evaluate_final, federated_rounds
from wattline.session import stored
from wattline.sources.readings import building_schema, load_clients, read_readings
from wattline.sources.stores import load_checkpoint


@dataclass
class Prepared:
    """Training rows (client_id, x, y) of both sides, or strips of windows."""

    train: DataFrame
    val: DataFrame


@DATASETS.add("building_readings")
def building_readings(spark: SparkSession, settings: Experiment) -> Prepared:
    data, federation = settings.data, settings.federation
    schema = building_schema()
    rows = load_clients(
        spark, data.path, schema, federation.mode, data.target, federation.clients, data.node,
        pattern=data.pattern, seed=data.seed,
    )
    strips = stored(building_strips(
        rows, "client_id", 1.0 - data.test_share, data.gap_hours, data.window, data.stride, node=data.node or "building_id",
        time=data.time, narrow=data.narrow, normalize=data.normalize,
    ))
    return Prepared(strips.where("split = 'train'"), strips.where("split = 'val'"))


@HELD_OUT.add("building_readings")
def building_held_out(spark: SparkSession, settings: Experiment) -> DataFrame:
    """Rows (x, y) of the held-out file; the training files are not touched."""
    data = settings.data
    if not data.test_path:
        raise ValueError("data.test_path names no held-out table")
    test = read_readings(spark, data.test_path, building_schema(), data.target)
    windows = building_test_windows(
        test, data.window, data.stride, node=data.node or "building_id", time=data.time, narrow=data.narrow
    )
    return as_vectors(windows, [], data.normalize)


@DATASETS.add("grid_log")
def grid_log(spark: SparkSession, settings: Experiment) -> Prepared:
    """Rows stand alone: clients by rows, exact random split in each client."""
    data, federation = settings.data, settings.federation
    names = spark.read.option("header", True).csv(data.path).columns
    kinds = ", ".join(f"`{n.strip()}` {'string' if n.strip() == data.target else 'double'}" for n in names)
    clean = prepare_grid_log(read_readings(spark, data.path, kinds, data.target), data.target, data.normalize)
    features = [c for c in clean.columns if c != "y"]
    # rows have no key of their own: their content is one, and equal rows are told apart by the split itself
    content = F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in clean.columns])))
    keyed = stored(clean.select(C.assemble(features).alias("x"), "y", content.alias("key")))
    dealt = assign_rows_random(keyed, "key", federation.clients, data.seed, federation.mode)
    rows = stored(random_split(dealt, "key", data.test_share, data.seed, ["client_id"]))
    return Prepared(rows.where("split = 'train'"), rows.where("split = 'test'"))


@MODELS.add("logistic")
def logistic(settings: Experiment, input_dim: int):
    return init_weights(input_dim)


@MODELS.add("mlp")
def mlp(settings: Experiment, input_dim: int):
    return init_weights(input_dim, [settings.model.hidden_size] * settings.model.num_layers, settings.data.seed)


LOSSES.add("bce")(M.bce_loss)
LOSSES.add("cross_entropy")(M.cross_entropy)
# losses that gradient passes know
TRAINED = ("bce",)


def check_settings(settings: Experiment) -> None:
    """Fail early on settings that no fit honours, instead of training something else."""
    model = settings.model
    LOSSES[model.loss]
    if model.loss not in TRAINED:
        raise ValueError(f"loss {model.loss!r} can be evaluated but not trained: expected one of {TRAINED}")
    if settings.task == "multi_class_classification" or model.num_classes != 1:
        raise ValueError("fits have one output: task must be binary_classification or anomaly_detection, num_classes 1")


def run_experiment(spark: SparkSession, settings: Experiment, run: str = "run") -> Federated:
    """Prepare the named dataset, fit the named model over the rounds, save the checkpoint of the last one."""
    check_settings(settings)
    ready = DATASETS[settings.data.name](spark, settings)
    model, training, federation = settings.model, settings.training, settings.federation
    width = input_width(ready.train)
    return federated_rounds(
        ready.train, ready.val, federation.rounds, training.local_epochs, training.learning_rate,
        training.weight_decay, federation.mu, model.pos_weight_cap, start=MODELS[model.name](settings, width),
        fraction=federation.fraction_fit, fraction_evaluate=federation.fraction_evaluate,
        min_clients=federation.clients, seed=settings.data.seed, patience=training.patience, run=run,
        checkpoint=settings.evaluation.checkpoint, config=settings.as_dict(),
    )


def evaluate_experiment(spark: SparkSession, settings: Experiment, run: str = "run") -> dict:
    """Score the held-out file with the saved weights: summary, report, matrix."""
    saved = load_checkpoint(spark, settings.evaluation.checkpoint, run)
    held = HELD_OUT[settings.data.name](spark, settings)
    scores = score(held, saved["weights"], ["y"])
    return evaluate_final(scores, settings.evaluation.threshold, settings.model.pos_weight_cap)
