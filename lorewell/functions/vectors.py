"""Vector functions as columns, and the packing of vectors for numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def l2_normalise(v: Column) -> Column:
    """The unit vector; a zero vector stays zero."""
    norm = F.sqrt(dot(v, v))
    return F.transform(doubles(v), lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)))


def min_max(score: Column, low: Column, high: Column) -> Column:
    """(x - min) / (max - min); 1 if all are equal."""
    return F.when(high == low, F.lit(1.0)).otherwise((score - low) / (high - low))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column as a float64 matrix; null vectors aren't allowed."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def unit_rows(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True) if m.size else np.ones((len(m), 1))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def mean_pooling(token_vectors: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean over the tokens that the mask keeps; (n, tokens, d) and (n, tokens)."""
    kept = np.where(mask[..., None].astype(bool), token_vectors, 0.0)
    return kept.sum(axis=1) / np.maximum(mask.sum(axis=1), 1)[..., None]
