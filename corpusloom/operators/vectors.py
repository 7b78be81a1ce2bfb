"""Vectors as arrays: pooling, norms, products, layer arithmetic."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, where ``body`` uses it for every element of an array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column, eps: float = 1e-12) -> Column:
    """L2-normalised; the zero vector stays."""
    return let(F.greatest(norm(v), F.lit(eps)), lambda n: F.transform(doubles(v), lambda x: x / n))


def rounded(v: Column, digits: int = 6) -> Column:
    return F.transform(v, lambda x: F.round(x, digits))


def pool_mean(hidden: DataFrame, dim: int, seq: str = "seq_id", vec: str = "vec", mask: str = "mask") -> DataFrame:
    """Mean of the vectors whose mask is 1; a sequence without any gives zeros.

    One sum for each component, combined before the shuffle.
    """
    n = F.greatest(F.sum(mask).cast("double"), F.lit(1e-9))
    parts = [(F.sum(F.when(F.col(mask) == 1, F.get(doubles(F.col(vec)), F.lit(i))).otherwise(0.0)) / n) for i in range(dim)]
    return hidden.groupBy(seq).agg(F.array(*parts).alias("pooled"))


def pool_last(hidden: DataFrame, seq: str = "seq_id", pos: str = "pos", vec: str = "vec", mask: str = "mask") -> DataFrame:
    """Vector at the number of unmasked positions less one (the first if there is none)."""
    n = hidden.groupBy(seq).agg(F.greatest(F.sum(mask) - 1, F.lit(0)).alias("at"))
    d = hidden.join(n, seq).filter(F.col(pos) == F.col("at"))
    return d.select(seq, doubles(F.col(vec)).alias("pooled"))


def pool(hidden: DataFrame, how: str, dim: int) -> DataFrame:
    if how not in ("last", "mean"):
        raise ValueError("pooling is 'last' or 'mean'")
    return pool_last(hidden) if how == "last" else pool_mean(hidden, dim)


def layer_norm(v: Column, eps: float = 1e-5) -> Column:
    """(x - mean) / sqrt(var + eps) with the population variance."""
    d = doubles(v)
    n = F.size(d)
    mean = F.aggregate(d, F.lit(0.0), lambda s, x: s + x) / n

    def around(m: Column) -> Column:
        var = F.aggregate(d, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / n
        return let(F.sqrt(var + eps), lambda root: F.transform(d, lambda x: (x - m) / root))

    return let(mean, around)


def gelu(x: Column) -> Column:
    return 0.5 * x * (1 + F.tanh(math.sqrt(2 / math.pi) * (x + 0.044715 * x * x * x)))


def rotate(v: Column, pos: Column, base: float = 10000.0, legacy: bool = False) -> Column:
    """Rotary position encoding by halves: (a, b) to (a cos - b sin, a sin + b cos)."""
    d = doubles(v)
    half = (F.size(d) / 2).cast("int")
    a, b = F.slice(d, F.lit(1), half), F.slice(d, half + 1, half)

    def angle(i: Column) -> Column:
        return pos * F.pow(F.lit(base), -(i * (1.0 if legacy else 2.0)) / F.size(d))

    turned = F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    first = F.transform(turned, lambda p, i: p["x"] * F.cos(angle(i)) - p["y"] * F.sin(angle(i)))
    second = F.transform(turned, lambda p, i: p["x"] * F.sin(angle(i)) + p["y"] * F.cos(angle(i)))
    return F.concat(first, second)


def keep_left(ids: Column, n: int) -> Column:
    """The first n ids (embedding input); an empty sequence is for the caller to fill."""
    return F.slice(ids, 1, n)


def keep_right(ids: Column, n: int) -> Column:
    """The last n ids (generation input)."""
    return F.slice(ids, F.greatest(F.size(ids) - n, F.lit(0)) + 1, F.lit(n))


def pad_batch(df: DataFrame, batch: str, ids: str = "ids", pad_id: int = 1, ctx: int | None = None) -> DataFrame:
    """Ids padded to the longest of their batch, and a mask; no ids become one padding id, which is not masked."""
    c = F.when(F.size(ids) == 0, F.array(F.lit(pad_id))).otherwise(F.col(ids))
    d = df.withColumn("__i", keep_left(c, ctx) if ctx else c)
    longest = d.groupBy(batch).agg(F.max(F.size("__i")).alias("__n"))
    d = d.join(longest, batch)
    gap = F.col("__n") - F.size("__i")
    return d.withColumns({"padded": F.concat("__i", F.array_repeat(F.lit(pad_id), gap)), "mask": F.concat(F.transform("__i", lambda x: F.lit(1)), F.array_repeat(F.lit(0), gap))}).drop("__i", "__n")
