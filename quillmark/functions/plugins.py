"""Plug-in callables: `module:factory` named by a string, checked when loaded, run as a vectorised UDF."""

from __future__ import annotations

import importlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from quillmark.functions.labels import GROUPS


def load_plugin(name: str, classes: tuple[str, ...] = tuple(GROUPS)) -> Callable:
    """Calls the factory; what it returns must be callable and have `classes`, a permutation of ours."""
    module, _, factory = name.partition(":")
    if not factory:
        raise ValueError("a plug-in is named module:factory")
    plugin = getattr(importlib.import_module(module), factory)()
    if not callable(plugin) or sorted(getattr(plugin, "classes", ())) != sorted(classes):
        raise ValueError(f"{name} must be callable, with a permutation of {classes} as its classes")
    return plugin


def fusion_udf(name: str, classes: tuple[str, ...] = tuple(GROUPS)):
    """(semantic, image, text) vectors -> probabilities in the order of `classes`. Labels and paths never reach the plug-in."""
    order = [list(load_plugin(name, classes).classes).index(c) for c in classes]

    @F.pandas_udf(ArrayType(DoubleType()))
    def run(semantic: pd.Series, image: pd.Series, text: pd.Series) -> pd.Series:
        plugin = load_plugin(name, classes)
        stack = lambda s: np.stack(s.to_numpy()) if len(s) else np.zeros((0, 0))
        return pd.Series(list(np.asarray(plugin(stack(semantic), stack(image), stack(text)), float)[:, order])) if len(text) else text

    return run


def register(spark: SparkSession, sql_name: str, plugin: str) -> None:
    """Makes the plug-in a SQL function."""
    spark.udf.register(sql_name, fusion_udf(plugin))
