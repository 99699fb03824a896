"""Vector algebra on array<double> columns, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _once(value: Column, f) -> Column:
    """f(value) with the value computed once a row; a lambda over an array would compute it again for each entry."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def l2_normalize(v: Column) -> Column:
    """Zero vectors stay as they are."""
    return _once(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v))


def cosine_distance(a: Column, b: Column) -> Column:
    """Null where a vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, 1 - dot(a, b) / n)


def shares(v: Column, eps: float = 0.0) -> Column:
    """v clipped at 0 and divided by its sum plus ``eps``; null for a zero vector without ``eps``."""
    w = F.transform(v, lambda x: F.greatest(x, F.lit(0.0)))
    return _once(total(w) + F.lit(eps), lambda s: F.when(s > 0, F.transform(w, lambda x: x / s)))


def jensen_shannon(a: Column, b: Column) -> Column:
    """Divergence in nats of two non-negative vectors; null where one sums to zero."""
    plogp = lambda x: F.when(x > 0, x * F.ln(x)).otherwise(F.lit(0.0))
    p, q = shares(a), shares(b)
    terms = F.zip_with(p, q, lambda x, y: 0.5 * plogp(x) + 0.5 * plogp(y) - plogp((x + y) / 2))
    return F.greatest(total(terms), F.lit(0.0))


def cross_entropy(a: Column, b: Column, eps: float = 1e-9) -> Column:
    return -total(F.zip_with(shares(a, eps), shares(b, eps), lambda x, y: x * F.ln(y + F.lit(eps))))


def standardize(v: Column) -> Column:
    """z-scores of a vector's own entries, then L2 normalisation; a constant vector gives zeros."""
    n = F.size(v).cast("double")
    spread = lambda mean: F.sqrt(total(F.transform(v, lambda x: (x - mean) * (x - mean))) / n)
    return l2_normalize(_once(total(v) / n, lambda mean: _once(spread(mean), lambda sd: F.transform(v, lambda x: F.when(sd > 0, (x - mean) / sd).otherwise(F.lit(0.0))))))


def edge_weight(a: Column, b: Column, sigma: float = 15.0) -> Column:
    """Weight of a link between two strengths: exp(-a * b / (2 sigma^2))."""
    return F.exp(-a * b / F.lit(2.0 * sigma * sigma))


def masked_mean(tokens: Column, mask: Column) -> Column:
    """Mean of the vectors of an array of arrays where ``mask`` (array of booleans) is true; null where it is nowhere."""
    kept = F.transform(F.filter(F.arrays_zip(tokens.alias("t"), mask.alias("m")), lambda e: e["m"]), lambda e: e["t"])
    total = F.aggregate(kept, F.transform(F.get(kept, F.lit(0)), lambda x: x * 0.0), lambda a, t: F.zip_with(a, t, lambda x, y: x + y))
    return F.when(F.size(kept) > 0, F.transform(total, lambda x: x / F.size(kept)))
