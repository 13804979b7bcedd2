"""Score algebra as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Clipping, and the scores of a transferred decision.
CLIP = 1e-6
SURE = 1e-5
OCR_WINDOW = 0.15


def logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(CLIP)), F.lit(1.0 - CLIP))
    return F.ln(p / (F.lit(1.0) - p))


def rounded(x: Column, digits: int) -> Column:
    """x, not negative, rounded half up as doubles are in C: the scaled double decides, not its decimal digits as in F.round()."""
    scaled = x * F.lit(10.0**digits)
    whole = F.floor(scaled).cast("double")
    return (whole + F.when(scaled - whole >= 0.5, 1.0).otherwise(0.0)) / F.lit(10.0**digits)


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def override_prob(decision: Column) -> Column:
    """The score that goes with a transferred decision."""
    return F.when(decision == 1, F.lit(1.0 - SURE)).when(decision == 0, F.lit(SURE))


def blend(text: Column, other: Column, brand: Column | None, weight: Column, brand_weight: Column | None = None) -> Column:
    """Weighted mean in logit space of two or three channels; weight is the other channel's share."""
    extra = F.lit(0.0) if brand is None or brand_weight is None else brand_weight
    mixed = (F.lit(1.0) - weight - extra) * logit(text) + weight * logit(other)
    if brand is not None and brand_weight is not None:
        mixed = mixed + F.when(brand_weight > 0, brand_weight * logit(brand)).otherwise(0.0)
    return sigmoid(mixed)


def yes_probability(yes: Column, no: Column) -> Column:
    """P(yes) from arrays of yes and no token logits: the softmax over both sets."""
    top = F.greatest(F.array_max(yes), F.array_max(no))
    total = lambda a: F.aggregate(F.transform(a, lambda x: F.exp(x - top)), F.lit(0.0), lambda s, x: s + x)
    return total(yes) / (total(yes) + total(no))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column, floor: float = 1e-9) -> Column:
    n = F.greatest(norm(a), F.lit(floor))
    return F.transform(a.cast("array<double>"), lambda x: x / n)


def dense_head(vector: Column, weights: list[float], bias: float, normalize: bool = True) -> Column:
    """Sigmoid of a linear head; a vector that is null, of another width or not finite scores 0."""
    v = vector.cast("array<double>")
    bad = v.isNull() | (F.size(v) != len(weights)) | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    w = F.array(*[F.lit(float(x)) for x in weights])
    return F.when(~F.coalesce(bad, F.lit(True)), sigmoid(dot(l2_normalize(v, 1e-12) if normalize else v, w) + F.lit(float(bias)))).otherwise(0.0)


def is_ocr_candidate(category: Column, prob: Column, threshold: Column, n_images: Column, flammable: str) -> Column:
    """Cards worth reading the images of: all flammable ones, and those near their threshold, if they have images."""
    return ((category == flammable) | (F.abs(prob - threshold) <= OCR_WINDOW)) & (n_images > 0)


def resized(width: Column, height: Column, max_pixels: int, grid: int = 28) -> tuple[Column, Column]:
    """Size of an image brought under max_pixels on the grid; smaller images stay."""
    scale = F.sqrt(F.lit(float(max_pixels)) / (width * height))
    side = lambda x: F.greatest(F.lit(grid), (F.floor(F.floor(x * scale) / grid) * grid)).cast("int")
    fits = width * height <= max_pixels
    return F.when(fits, width).otherwise(side(width)).cast("int"), F.when(fits, height).otherwise(side(height)).cast("int")


def linear_blend(text: Column, other: Column, text_weight: Column) -> Column:
    """Weighted mean of two scores; here the weight is the text's share."""
    return text_weight * text + (F.lit(1.0) - text_weight) * other
