"""Numeric Column helpers: logistic pieces, losses and vector distances."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from cuelake.functions.let import bound


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def ratio(num: Column, den: Column) -> Column:
    """num/den, 0 where the denominator is not positive."""
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def logistic_loss(x: Column, y: Column, pos_weight: float | None = None) -> Column:
    """Numerically stable binary cross entropy on logits."""
    soft = F.log1p(F.exp(-F.abs(x)))
    if pos_weight is None:
        return F.greatest(x, F.lit(0.0)) - x * y + soft
    scale = F.lit(1.0) + y * F.lit(pos_weight - 1.0)
    return (F.lit(1.0) - y) * x + scale * (soft + F.greatest(-x, F.lit(0.0)))


def focal_loss(x: Column, y: Column, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    bce = logistic_loss(x, y)
    balance = y * F.lit(alpha) + (F.lit(1.0) - y) * F.lit(1.0 - alpha)
    return balance * F.pow(F.lit(1.0) - F.exp(-bce), F.lit(gamma)) * bce


def soft_target_divergence(x: Column, t: Column, temperature: float, eps: float = 1e-7) -> Column:
    """Bernoulli KL of softened teacher ``t`` from softened student ``x``."""
    q, s = sigmoid(t / F.lit(temperature)), sigmoid(x / F.lit(temperature))
    e, one = F.lit(eps), F.lit(1.0)
    return q * (F.ln(q + e) - F.ln(s + e)) + (one - q) * (
        F.ln(one - q + e) - F.ln(one - s + e)
    )


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    """(1 - cos)/2 in [0, 1]; 0 where a vector has no length."""

    def distance(v: Column) -> Column:
        cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v["ab"] / v["norm"]))
        return F.when(v["norm"] == 0, F.lit(0.0)).otherwise((F.lit(1.0) - cos) / 2)

    def parts(v: Column) -> Column:
        norm = F.sqrt(dot(v["a"], v["a"])) * F.sqrt(dot(v["b"], v["b"]))
        return F.struct(dot(v["a"], v["b"]).alias("ab"), norm.alias("norm"))

    return bound(bound(F.struct(a.alias("a"), b.alias("b")), parts), distance)


def chi_squared(a: Column, b: Column) -> Column:
    """Sum of (a-b)^2/(a+b) over bins with a positive sum."""
    return array_sum(
        F.zip_with(
            a,
            b,
            lambda x, y: F.when(x + y > 0, (x - y) * (x - y) / (x + y)).otherwise(F.lit(0.0)),
        )
    )
