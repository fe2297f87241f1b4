"""Settings of an experiment, and the named choices they may refer to."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from wattline.functions.fixed_values import DEFAULT_THRESHOLD

# Names of the tasks.
TASKS = ("binary_classification", "anomaly_detection", "multi_class_classification")


@dataclass
class DataSettings:
    """Where readings come from and how they are split; defaults of the building readings."""

    name: str = "building_readings"
    path: str = ""
    test_path: str = ""
    pattern: str | None = "data{n}.csv"
    target: str = "anomaly"
    node: str | None = "building_id"
    time: str = "timestamp"
    # Share held out for validation, seed, window, stride, gap.
    test_share: float = 0.2
    seed: int = 42
    window: int = 168
    stride: int = 24
    gap_hours: float = 73
    normalize: bool = True
    # 32-bit numbers where they hold the same values
    narrow: bool = False


def grid_settings(path: str, **more: Any) -> DataSettings:
    """Defaults of the power-grid log: rows stand alone, there is no node and no gap."""
    return DataSettings(**{"name": "grid_log", "path": path, "pattern": None, "target": "marker", "node": None,
                           "gap_hours": 0, **more})


@dataclass
class ModelSettings:
    name: str = "logistic"
    # Width and depth of hidden layers, cap of the class weight.
    hidden_size: int = 128
    num_layers: int = 2
    pos_weight_cap: float = 10.0
    num_classes: int = 1
    loss: str = "bce"


@dataclass
class TrainingSettings:
    # Rates and passes of a local fit.
    learning_rate: float = 1e-4
    weight_decay: float = 1e-4
    local_epochs: int = 2
    patience: int = 10


@dataclass
class FederationSettings:
    # One client with its own file, two rounds, everyone takes part.
    mode: str = "local"
    rounds: int = 2
    clients: int = 1
    fraction_fit: float = 1.0
    fraction_evaluate: float = 1.0
    # pull towards the global weights; 0 leaves the loss as it is
    mu: float = 0.0


@dataclass
class EvaluationSettings:
    checkpoint: str = "checkpoints"
    threshold: float | None = DEFAULT_THRESHOLD


@dataclass
class Experiment:
    task: str = "binary_classification"
    data: DataSettings = field(default_factory=DataSettings)
    model: ModelSettings = field(default_factory=ModelSettings)
    training: TrainingSettings = field(default_factory=TrainingSettings)
    federation: FederationSettings = field(default_factory=FederationSettings)
    evaluation: EvaluationSettings = field(default_factory=EvaluationSettings)

    def __post_init__(self) -> None:
        if self.task not in TASKS:
            raise ValueError(f"unknown task {self.task!r}: expected one of {TASKS}")

    def as_dict(self) -> dict:
        return asdict(self)

    def with_trial(self, params: Mapping[str, Any]) -> Experiment:
        """These settings with those of a trial (as text or numbers) in their place, such as the best one's."""
        training = {k: float(params[p]) for k, p in (("learning_rate", "lr"), ("weight_decay", "weight_decay")) if p in params}
        model: dict[str, Any] = {k: int(float(params[k])) for k in ("hidden_size", "num_layers") if k in params}
        if "pos_weight_cap" in params:
            model["pos_weight_cap"] = float(params["pos_weight_cap"])
        if model.get("num_layers", 0) > 0 and model.get("hidden_size", 0) > 0:
            model["name"] = "mlp"
        return replace(self, training=replace(self.training, **training), model=replace(self.model, **model))


class Registry:
    """Names to functions; an unknown name lists the known ones."""

    def __init__(self, kind: str) -> None:
        self.kind, self._known = kind, {}

    def add(self, name: str) -> Callable[[Callable], Callable]:
        def put(fn: Callable) -> Callable:
            self._known[name] = fn
            return fn

        return put

    def __getitem__(self, name: str) -> Callable:
        if name not in self._known:
            raise ValueError(f"unknown {self.kind} {name!r}: expected one of {sorted(self._known)}")
        return self._known[name]

    def names(self) -> list[str]:
        return sorted(self._known)


DATASETS = Registry("dataset")
HELD_OUT = Registry("dataset with a held-out table")
MODELS = Registry("model")
LOSSES = Registry("loss")
