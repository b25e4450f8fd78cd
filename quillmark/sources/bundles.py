"""A linear classifier as a bundle: its parameters in one file, and beside them what it is for and their hash."""

from __future__ import annotations

import hashlib
import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions.arrays import dot, sigmoid, softmax
from quillmark.sources.sinks import read_json, write_json


def _hash(parameters: dict) -> str:
    return hashlib.sha256(json.dumps(parameters, sort_keys=True).encode()).hexdigest()


def write_bundle(spark: SparkSession, path: str, coefficients: np.ndarray, intercepts: np.ndarray, classes: tuple[str, ...], threshold: float, about: dict | None = None) -> dict:
    """Writes the classifier, then the bundle that names its hash, so that no bundle stands without its classifier. Returns the bundle."""
    rows = np.atleast_2d(np.asarray(coefficients, float))
    if len(rows) != len(np.atleast_1d(intercepts)) or len(rows) != (1 if len(classes) == 2 else len(classes)):
        raise ValueError("a row of coefficients and an intercept for each class, or one for two classes")
    parameters = {"coefficients": rows.tolist(), "intercepts": np.atleast_1d(np.asarray(intercepts, float)).tolist()}
    bundle = {"classes": list(classes), "threshold": float(threshold), "features": rows.shape[1], "classifier_sha256": _hash(parameters), "about": about or {}}
    write_json(spark, parameters, f"{path}/classifier")
    write_json(spark, bundle, f"{path}/bundle")
    return bundle


def read_bundle(spark: SparkSession, path: str) -> dict:
    """The bundle with its parameters; another classifier than the one it was written with is an error."""
    bundle, parameters = read_json(spark, f"{path}/bundle"), read_json(spark, f"{path}/classifier")
    if _hash(parameters) != bundle["classifier_sha256"]:
        raise OSError(f"{path}: the classifier isn't the bundle's")
    return bundle | parameters


def class_probabilities(features: Column, bundle: dict) -> Column:
    """The classes' probabilities, in their order, by array arithmetic."""
    v = features.cast("array<double>")
    scores = [dot(v, F.array(*(F.lit(x) for x in row))) + F.lit(b) for row, b in zip(bundle["coefficients"], bundle["intercepts"], strict=True)]
    if len(scores) == 1:
        p = sigmoid(scores[0])
        return F.array(1.0 - p, p)
    return softmax(F.array(*scores))


def predicted(df: DataFrame, features: str, bundle: dict) -> DataFrame:
    """Adds `probabilities`, `prob` (of any class but the first) and `pred` (1 from the bundle's threshold on). Vectors of another length, and missing ones, get nulls."""
    fits = F.size(features) == bundle["features"]
    scored = df.withColumn("probabilities", F.when(fits, class_probabilities(F.col(features), bundle)))
    return scored.withColumn("prob", 1.0 - F.col("probabilities")[0]).withColumn("pred", (F.col("prob") >= bundle["threshold"]).cast("int"))
