"""Vector columns (``ARRAY<FLOAT>``/``ARRAY<DOUBLE>``); arithmetic always in double."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NORM_FLOOR = 1e-12


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(v: Column) -> Column:
    """Unit vector; a zero vector stays zero."""
    length = F.greatest(norm(v), F.lit(NORM_FLOOR))
    return F.transform(as_double(v), lambda x: x / length)


def cosine_similarity(a: Column, b: Column) -> Column:
    floor = F.lit(NORM_FLOOR)
    return dot(a, b) / (F.greatest(norm(a), floor) * F.greatest(norm(b), floor))


def euclidean_distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y))
    return F.sqrt(total(squares))


def embedding_digest(v: Column) -> Column:
    """Short stable digest by which logs may name a vector without showing it."""
    text = F.array_join(F.transform(as_double(v), lambda x: F.format_string("%.6f", x)), ",")
    return F.substring(F.sha2(text, 256), 1, 12)


def redacted(v: Column, preview: int = 4) -> Column:
    """What may leave the store in place of a vector: dimension, digest and a short preview."""
    head = F.transform(F.slice(as_double(v), 1, preview), lambda x: F.round(x, 4))
    return F.struct(F.size(v).alias("dim"), embedding_digest(v).alias("digest"), head.alias("preview"))


def fuse_embeddings(*parts: Column) -> Column:
    """Concatenate unit parts so that the fused cosine is the mean of the parts' cosines."""
    if len(parts) < 2:
        raise ValueError("an ensemble needs at least two embeddings")
    scale = 1.0 / len(parts) ** 0.5
    scaled = [F.transform(l2_normalize(p), lambda x: x * F.lit(scale)) for p in parts]
    return F.concat(*scaled)


def flip_average(a: Column, b: Column) -> Column:
    """Average of a face and its mirror image, renormalised."""
    return l2_normalize(F.zip_with(as_double(a), as_double(b), lambda x, y: (x + y) / 2.0))


def histogram_intersection(a: Column, b: Column) -> Column:
    """Overlap of two histograms; a missing one is permissive (1.0)."""
    return F.coalesce(total(F.zip_with(as_double(a), as_double(b), lambda x, y: F.least(x, y))), F.lit(1.0))


def logistic_score(features: Column, mean: list[float], scale: list[float],
                   weights: list[float], bias: float) -> Column:
    """Probability of a standardised logistic model with constant coefficients."""
    terms = [
        (F.element_at(features, i + 1) - F.lit(float(m))) / F.lit(max(float(s), 1e-6)) * F.lit(float(w))
        for i, (m, s, w) in enumerate(zip(mean, scale, weights))
    ]
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(reduce(lambda x, y: x + y, terms) + F.lit(float(bias)))))


def aggregate_similarity(similarities: Column, strategy: str = "max", k: int = 3) -> Column:
    """Reduce the similarities to one identity's references; an empty array gives NULL."""
    nonempty = F.size(similarities) > 0
    if strategy == "max":
        value = F.array_max(similarities)
    elif strategy == "mean":
        value = total(similarities) / F.size(similarities)
    elif strategy == "topk_mean":
        best = F.slice(F.sort_array(similarities, asc=False), 1, k)
        value = total(best) / F.size(best)
    else:
        raise ValueError(f"unknown aggregation strategy: {strategy}")
    return F.when(nonempty, value)
