"""Classifiers by name, their parameters and search spaces.

Parameters carry the names users know from the published configuration; those without a
counterpart in Spark ML are ignored (see README).
"""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.ml import Estimator
from pyspark.ml.classification import MultilayerPerceptronClassifier

from lodgewise.operators.encode import FEATURES
from lodgewise.plans.boosting import BoostedClassifier
from lodgewise.plans.forest import ForestClassifier
from lodgewise.schema import ROLES, SEED, ModelDefaults

WEIGHT = "weight"
_MAX_DEPTH = 30  # the deepest tree Spark ML grows

# How each model weighs its classes: a scheme of split.class_weights, or none.
WEIGHTS = {
    "random_forest": "balanced",
    "xgboost": "neg_over_pos",
    "lightgbm": "balanced",
    "neural_network": None,
}


def _subset(value) -> str:
    return str(value)


def _depth(p: dict) -> int:
    if p["max_depth"] > _MAX_DEPTH:
        raise ValueError(f"max_depth {p['max_depth']} is beyond {_MAX_DEPTH}, the deepest tree that can be grown")
    return p["max_depth"]


def _random_forest(p: dict, n_inputs: int) -> Estimator:
    return ForestClassifier(
        featuresCol=FEATURES,
        labelCol=ROLES.target,
        weightCol=WEIGHT,
        seed=SEED,
        numTrees=p["n_estimators"],
        maxDepth=_depth(p),
        minInstancesPerNode=p.get("min_samples_leaf", 1),
        featureSubsetStrategy=_subset(p.get("max_features", "sqrt")),
    )


# What a boosted model takes where its parameters don't say.
_BOOSTED = {
    "xgboost": {"learning_rate": 0.3, "max_depth": 6, "min_child_weight": 1.0, "reg_lambda": 1.0},
    "lightgbm": {"num_leaves": 31, "min_child_weight": 0.001, "min_child_samples": 20},
}


def _boosted(name: str, p: dict) -> BoostedClassifier:
    return BoostedClassifier({**_BOOSTED[name], **p, "max_depth": _depth(p)}, FEATURES, ROLES.target, WEIGHT, SEED)


def hidden_layers(p: dict) -> list[int]:
    """Hidden layer widths: the searched ones by layer number, the first ``n_layers`` of them, else ``hidden_layers``."""
    prefix = "n_units_l"
    searched = sorted((int(key.removeprefix(prefix)), width) for key, width in p.items() if key.startswith(prefix))
    return [width for _, width in searched[: p.get("n_layers")]] or list(p["hidden_layers"])


def _perceptron(p: dict, n_inputs: int) -> Estimator:
    return MultilayerPerceptronClassifier(
        featuresCol=FEATURES,
        labelCol=ROLES.target,
        seed=SEED,
        layers=[n_inputs, *hidden_layers(p), 2],
        maxIter=p.get("epochs", 300),
        stepSize=p.get("learning_rate", 0.03),
        blockSize=p.get("batch_size", 128),
    )


BUILDERS: dict[str, Callable[[dict, int], Estimator | BoostedClassifier]] = {
    "random_forest": _random_forest,
    "xgboost": lambda p, n: _boosted("xgboost", p),
    "lightgbm": lambda p, n: _boosted("lightgbm", p),
    "neural_network": _perceptron,
}


def defaults(name: str) -> dict:
    _known(name)
    return dict(getattr(ModelDefaults(), name))


def _known(name: str) -> None:
    if name not in BUILDERS:
        raise ValueError(f"no model is called {name!r}; there are {', '.join(BUILDERS)}")


def build(name: str, params: dict | None = None, n_inputs: int = 0) -> Estimator | BoostedClassifier:
    """An unfitted classifier; ``n_inputs`` is the vector length, which only the network needs."""
    _known(name)
    return BUILDERS[name]({**defaults(name), **(params or {})}, n_inputs)


def _log_uniform(rng: random.Random, low: float, high: float) -> float:
    from math import exp, log

    return exp(rng.uniform(log(low), log(high)))


# The ranges searched per model.
SPACES: dict[str, dict[str, tuple]] = {
    "random_forest": {
        "n_estimators": ("int", 100, 1000),
        "max_depth": ("int", 10, 30),
        "min_samples_split": ("int", 2, 20),
        "min_samples_leaf": ("int", 1, 10),
        "max_features": ("choice", ["sqrt", "log2", 0.8]),
        "class_weight": ("choice", ["balanced", "balanced_subsample"]),
    },
    "xgboost": {
        "n_estimators": ("int", 100, 1500),
        "max_depth": ("int", 3, 12),
        "learning_rate": ("log", 0.005, 0.3),
        "subsample": ("float", 0.5, 1.0),
        "colsample_bytree": ("float", 0.5, 1.0),
        "min_child_weight": ("int", 1, 15),
        "gamma": ("float", 0.0, 0.5),
        "reg_alpha": ("log", 1e-8, 100.0),
        "reg_lambda": ("log", 1e-8, 100.0),
        "scale_pos_weight": ("float", 1.0, 10.0),
    },
    "lightgbm": {
        "n_estimators": ("int", 100, 1500),
        "max_depth": ("int", 5, 15),
        "learning_rate": ("log", 0.005, 0.3),
        "num_leaves": ("int", 20, 300),
        "subsample": ("float", 0.5, 1.0),
        "colsample_bytree": ("float", 0.5, 1.0),
        "min_child_samples": ("int", 5, 100),
        "reg_alpha": ("log", 1e-8, 10.0),
        "reg_lambda": ("log", 1e-8, 10.0),
    },
    "neural_network": {
        "n_layers": ("int", 1, 4),
        "units": ("int", 32, 512),
        "learning_rate": ("log", 1e-4, 1e-2),
        "batch_size": ("choice", [32, 64, 128, 256]),
    },
}


def draw(name: str, rng: random.Random, space: dict[str, tuple] | None = None) -> dict:
    """One random point of a model's search space."""
    _known(name)
    point = {}
    for key, (kind, *bounds) in (space or SPACES[name]).items():
        if kind == "int":
            point[key] = rng.randint(*bounds)
        elif kind == "float":
            point[key] = rng.uniform(*bounds)
        elif kind == "log":
            point[key] = _log_uniform(rng, *bounds)
        else:
            point[key] = rng.choice(bounds[0])
    if "units" in point:
        low, high = (space or SPACES[name])["units"][1:]
        point.pop("units")
        point.update({f"n_units_l{i}": rng.randint(low, high) for i in range(point["n_layers"])})
    return point
