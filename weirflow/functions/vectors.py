"""Array arithmetic as Column functions: norms, gates, rotation, quantisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the largest number of the 8-bit float format e4m3.
FP8_MAX = 448.0


def as_doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def total(v: Column) -> Column:
    return F.aggregate(as_doubles(v), F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y))


def l2_norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def sigmoid(v: Column) -> Column:
    return F.transform(as_doubles(v), lambda x: 1 / (1 + F.exp(-x)))


def softplus(v: Column) -> Column:
    return F.transform(as_doubles(v), lambda x: F.when(x > 20, x).otherwise(F.log1p(F.exp(x))))


def silu(v: Column) -> Column:
    return F.transform(as_doubles(v), lambda x: x / (1 + F.exp(-x)))


def softmax(v: Column) -> Column:
    top = F.array_max(as_doubles(v))
    e = F.transform(as_doubles(v), lambda x: F.exp(x - top))
    all_ = total(e)
    return F.transform(e, lambda x: x / all_)


def rms_norm(v: Column, eps: float = 1e-6) -> Column:
    scale = F.sqrt(dot(v, v) / F.size(v) + F.lit(eps))
    return F.transform(as_doubles(v), lambda x: x / scale)


def fp8_scale(v: Column) -> Column:
    """Largest absolute value by the format's largest number; 1 for a vector of zeros."""
    top = F.array_max(F.transform(as_doubles(v), lambda x: F.abs(x)))
    return F.when(top < 1e-12, F.lit(1.0)).otherwise(top / FP8_MAX)


def fp8_round_trip(v: Column) -> Column:
    """Scaled, clipped to the format's range, scaled back."""
    s = fp8_scale(v)
    return F.transform(as_doubles(v), lambda x: F.greatest(F.least(x / s, F.lit(FP8_MAX)), F.lit(-FP8_MAX)) * s)


def rope_angles(position: Column, dim: int, base: float = 10_000.0) -> Column:
    """The rotation angle of each pair of a vector at a position."""
    return F.transform(F.sequence(F.lit(0), F.lit(dim // 2 - 1)), lambda i: position / F.pow(F.lit(base), 2 * i / F.lit(float(dim))))


def rotate(v: Column, angles: Column, inverse: bool = False) -> Column:
    """Neighbouring pairs of the vector turned by their angles."""
    x, sign = as_doubles(v), -1.0 if inverse else 1.0
    def turned(i: Column) -> Column:
        a, b, t = F.element_at(x, 2 * i + 1), F.element_at(x, 2 * i + 2), sign * F.element_at(angles, i + 1)
        return F.array(a * F.cos(t) - b * F.sin(t), a * F.sin(t) + b * F.cos(t))

    return F.flatten(F.transform(F.sequence(F.lit(0), (F.size(v) / 2 - 1).cast("int")), turned))


def top_k_gate(scores: Column, k: int, func: str = "sqrtsoftplus", scale: float = 1.0, bias: Column | None = None) -> Column:
    """The k best experts of a score vector: ``array<struct<expert, weight>>``, best first;
    ties go to the smaller index. All but softmax weights are made to sum to ``scale``."""
    s = F.transform(softplus(scores), lambda x: F.sqrt(x)) if func == "sqrtsoftplus" else softmax(scores) if func == "softmax" else sigmoid(scores)
    if bias is not None:
        s = F.zip_with(s, as_doubles(bias), lambda a, b: a + b)
    ranked = F.slice(F.array_sort(F.transform(s, lambda x, i: F.struct((-x).alias("neg"), i.cast("int").alias("expert")))), 1, k)
    kept = F.aggregate(ranked, F.lit(0.0), lambda a, r: a - r["neg"])
    return F.transform(ranked, lambda r: F.struct(r["expert"].alias("expert"), (-r["neg"] * scale / (F.lit(1.0) if func == "softmax" else kept)).alias("weight")))


def hash_route(token: Column, experts: int) -> Column:
    return F.pmod(token, F.lit(experts))


def cross_entropy(logits: Column, target: Column) -> Column:
    """log-sum-exp of the logits less the target's; ``target`` counts from 0."""
    x = as_doubles(logits)
    top = F.array_max(x)
    return F.log(total(F.transform(x, lambda v: F.exp(v - top)))) + top - F.element_at(x, target + 1)


def row_normalised(v: Column, eps: float = 1e-6) -> Column:
    """Sigmoid plus eps, made to sum to 1."""
    s = F.transform(sigmoid(v), lambda x: x + F.lit(eps))
    all_ = total(s)
    return F.transform(s, lambda x: x / all_)


def mixing_weights(mixes: Column, n: int, scale: float = 1.0, base: Column | None = None, eps: float = 1e-6) -> Column:
    """``struct<pre, post, comb>`` of a vector of (2 + n) n mixing scores; rows of ``comb`` sum to 1."""
    x = F.transform(as_doubles(mixes), lambda v: v * F.lit(scale))
    if base is not None:
        x = F.zip_with(x, as_doubles(base), lambda a, b: a + b)
    part = lambda at, size: row_normalised(F.slice(x, at, size), eps)
    return F.struct(part(1, n).alias("pre"), part(n + 1, n).alias("post"), F.array(*[part(2 * n + 1 + i * n, n) for i in range(n)]).alias("comb"))


def weighted_sum(weights: Column, rows: Column) -> Column:
    """One vector from parallel vectors (``array<array<double>>``) and their weights."""
    terms = F.zip_with(weights, rows, lambda w, r: F.transform(r, lambda x: x.cast("double") * w))
    zero = F.transform(F.element_at(terms, 1), lambda _: F.lit(0.0))
    return F.aggregate(terms, zero, lambda a, r: F.zip_with(a, r, lambda x, y: x + y))


def expand_streams(x: Column, residual: Column, post: Column, comb: Column) -> Column:
    """One vector spread over parallel streams, plus the streams mixed by ``comb``:
    ``y[j] = post[j] * x + sum_i comb[i][j] * residual[i]``."""
    def stream(p: Column, j: Column) -> Column:
        column = F.transform(comb, lambda row: F.element_at(row, j + 1))
        mixed = weighted_sum(column, residual)
        return F.zip_with(F.transform(as_doubles(x), lambda v: v * p), mixed, lambda a, b: a + b)

    return F.transform(post, stream)
