"""Encoders and heads as vectorised functions: they see the columns they are given, and no others."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from quillmark.functions import arrays

#: Columns that tell the answer, or where it came from.
NEVER_INPUT = frozenset("label label_binary label_index scenario group raw_label subcategory source split image_path rule".split())


def resolve_layer(states: int, wanted: int) -> int:
    """Index of a hidden state, from the end if negative; `states` counts the embedding too."""
    at = wanted if wanted >= 0 else states + wanted
    if not 0 <= at < states:
        raise IndexError(f"layer {wanted} of {states - 1} layers")
    return at


def encoded(rows: DataFrame, make: Callable[[], Callable[..., np.ndarray]], inputs: list[str], name: str = "features", batch: int = 64, shapes: list[list[int] | None] | None = None) -> DataFrame:
    """Adds the vectors of an encoder. `make` runs once in each worker and returns a function of batches of `inputs`; array inputs need their shapes."""
    leaked = NEVER_INPUT & set(inputs)
    if leaked:
        raise ValueError(f"{sorted(leaked)} must not reach a model")
    return rows.withColumn(name, predict_batch_udf(make, return_type=ArrayType(FloatType()), batch_size=batch, input_tensor_shapes=shapes)(*inputs))


def _layer(vectors: Column, units: list[tuple[Column, float]]) -> Column:
    return F.transform(F.array(arrays.doubles(vectors)), lambda v: F.array(*(arrays.dot(v, w) + b for w, b in units)))[0]


def layered_scores(vectors: Column, layers: list[tuple[np.ndarray, np.ndarray]]) -> Column:
    """Scores of layers of (weights, bias), one after another, rectified in between; for layers small enough for a plan."""
    for k, (weights, bias) in enumerate(layers):
        if k:
            vectors = F.transform(vectors, lambda x: F.greatest(x, F.lit(0.0)))
        rows = zip(np.asarray(weights, float), np.asarray(bias, float), strict=True)
        # held in a variable, so that a layer is computed once and not once for each unit of the next
        units = [(F.array(*(F.lit(float(x)) for x in row)), float(b)) for row, b in rows]
        vectors = _layer(vectors, units)
    return vectors


def residual_head(parameters: dict[str, np.ndarray]) -> Callable[[Column | str], Column]:
    """Vectors -> class probabilities of the sum of two heads: a linear one ("skip") and one with a hidden layer ("hidden", "output")."""
    layer = lambda name: (parameters[f"{name}.weight"], parameters[f"{name}.bias"])

    def probabilities(vectors: Column | str) -> Column:
        x = F.col(vectors) if isinstance(vectors, str) else vectors
        heads = F.zip_with(layered_scores(x, [layer("skip")]), layered_scores(x, [layer("hidden"), layer("output")]), lambda a, b: a + b)
        return F.transform(F.array(heads), arrays.softmax)[0]

    return probabilities


def analysis(semantic_fake: Column, mismatch: Column, image_probability: Column, image_threshold: float, fusion: Column | None, classes: tuple[str, ...]) -> Column:
    """The verdict record of one pair: modules, branches and, with a fusion, the winning class. Without one the verdict is pending."""
    four = lambda c: F.round(c, 4)
    none = F.lit(None)
    top = F.array_max(fusion) if fusion is not None else none.cast("double")
    at = (F.array_position(fusion, top) - 1).cast("int") if fusion is not None else none.cast("int")
    overall = 1 - fusion[classes.index("genuine")] if fusion is not None else semantic_fake
    return F.struct(
        F.lit(fusion is not None).alias("final_available"),
        F.struct(four(image_probability).alias("image_manip"), four(mismatch).alias("cross_modal"), four(overall).alias("overall"), F.lit("fusion" if fusion is not None else "semantic_branch").alias("overall_source")).alias("modules"),
        F.when(image_probability >= image_threshold, "fake").otherwise("real").alias("image_prediction"),
        (F.element_at(F.array(*map(F.lit, classes)), at + 1) if fusion is not None else F.lit("pending")).alias("verdict"),
        at.alias("label_index"),
        F.round(top * 100, 1).alias("confidence"),
    )
