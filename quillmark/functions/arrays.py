"""Vector columns (array<double>): products, norms, decisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column, least: float = 1e-12) -> Column:
    n = F.greatest(norm(v), F.lit(least))
    return F.transform(doubles(v), lambda x: x / n)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def pair_features(image: Column, text: Column) -> Column:
    """[image, text, product, absolute difference, their dot product], for vectors of unit length the cosine."""
    a, b = doubles(image), doubles(text)
    product = F.zip_with(a, b, lambda x, y: x * y)
    return F.concat(a, b, product, F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.array(total(product)))


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def log_sum_exp(v: Column) -> Column:
    top = F.array_max(v)
    return top + F.log(total(F.transform(v, lambda x: F.exp(x - top))))


def softmax(v: Column) -> Column:
    all_ = log_sum_exp(v)
    return F.transform(v, lambda x: F.exp(x - all_))


def fake_margin(z: Column) -> Column:
    """Log-odds of any class but the first: rank by this, for probabilities saturate."""
    return log_sum_exp(F.slice(z, 2, F.size(z) - 1)) - z[0]


def argmax(p: Column) -> Column:
    """First class of the largest value, from 0."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def all_finite(v: Column) -> Column:
    return F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def masked_mean(tokens: Column, mask: Column) -> Column:
    """Mean of the token vectors whose mask is set; null where none is."""
    kept = F.filter(F.zip_with(tokens, mask, lambda t, m: F.when(m != 0, t)), lambda t: t.isNotNull())
    n = F.size(kept)
    sums = F.aggregate(F.slice(kept, 2, F.greatest(n - 1, F.lit(0))), F.get(kept, F.lit(0)), lambda s, t: F.zip_with(s, t, lambda x, y: x + y))
    return F.transform(sums, lambda x: x / n)


def sign_bits(v: Column) -> Column:
    """A long whose bits are the signs of up to 64 values, the first one highest."""
    return F.aggregate(v, F.lit(0).cast("long"), lambda s, x: F.shiftleft(s, 1).bitwiseOR(F.when(x > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))))


def box_area_share(box: Column, width: Column, height: Column) -> Column:
    """Share of the image that a box [left, top, right, bottom] covers; 0 without a box."""
    return F.coalesce(F.try_divide(((box[2] - box[0]) * (box[3] - box[1])).cast("double"), (width * height).cast("double")), F.lit(0.0))


def overlap_area(a: Column, b: Column) -> Column:
    wide = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    high = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    return wide * high


def crop_box(box: Column, width: Column, height: Column, context: float) -> Column:
    """The box grown by `context` about its middle, inside the image."""
    cx, cy = (box[0] + box[2]) / 2, (box[1] + box[3]) / 2
    half = F.greatest(box[2] - box[0], box[3] - box[1]) * (context / 2)
    return F.array(F.greatest(F.lit(0.0), cx - half), F.greatest(F.lit(0.0), cy - half), F.least(width.cast("double"), cx + half), F.least(height.cast("double"), cy + half))
