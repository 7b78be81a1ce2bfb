"""Shuffled order of an epoch by arithmetic: a keyed permutation of 0 .. n - 1 that needs no sort.

Numbers below n are pairs (l, r) with l < a and r < b, where a * b is at least n
and less than n + a.  Rounds add a hash of one half to the other, modulo its size,
which is a bijection of the pairs; a result of n or more goes through it again
until it is below n (the pairs above n are fewer than a, so this is rare and ends).
The way back takes the rounds in reverse order.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
#: Turns after which a number that is still not below n is an error: certain for n <= 256, else of a chance below n^-8.
WALK = 17
_MULTIPLIER = 1540483477


def round_keys(seed: int, epoch: int) -> list[int]:
    """Odd numbers below 2^31; those of rounds that change the right half are negative."""
    raw = [int(hashlib.md5(f"{seed}:{epoch}:{i}".encode()).hexdigest()[:8], 16) >> 1 | 1 for i in range(ROUNDS)]
    return [-k if i % 2 else k for i, k in enumerate(raw)]


def halves(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def _hash(v: Column, key: Column) -> Column:
    """Of a number below 2^31, without overflow."""
    h = v * key + key
    h = h.bitwiseXOR(F.shiftright(h, 29))
    return F.shiftright(h.bitwiseAND(F.lit(0x7FFFFFFF)) * _MULTIPLIER, 13)


def _rounds(x: Column, n: int, keys: list[int], back: bool) -> Column:
    a, b = halves(n)

    def one(x: Column, key: Column) -> Column:
        right = x % b
        left = ((x - right) / b).cast("long")  # exact below 2^53
        of_right, of_left = _hash(right, key), _hash(left, -key)
        new_left = F.pmod(left - of_right if back else left + of_right, F.lit(a))
        new_right = F.pmod(right - of_left if back else right + of_left, F.lit(b))
        return F.when(key > 0, new_left * b + right).otherwise(left * b + new_right).cast("long")

    order = keys[::-1] if back else keys
    return F.aggregate(F.array(*[F.lit(k).cast("long") for k in order]), x, one)


def permuted(x: Column, n: int, seed: int, epoch: int, back: bool = False) -> Column:
    """Where number ``x`` of 0 .. n - 1 goes; with ``back``, where it comes from.  n is below 2^53."""
    if not 0 < n < 1 << 53:
        raise ValueError("a permutation needs 1 to 2^53 numbers")
    keys = round_keys(seed, epoch)
    once = _rounds(x.cast("long"), n, keys, back)
    out = F.aggregate(F.sequence(F.lit(2), F.lit(WALK)), once, lambda y, _: F.when(y >= n, _rounds(y, n, keys, back)).otherwise(y))
    return F.get(F.transform(F.array(out), lambda y: F.when(y < n, y).otherwise(F.raise_error(F.lit("a number has not come back below n")).cast("long"))), F.lit(0))


def samples(spark: SparkSession, n: int, seed: int, epoch: int, skip: int = 0, replicas: int = 1, replica: int = 0, drop_last: bool = True) -> DataFrame:
    """``(rank, win)``: the windows of one replica in the order of an epoch, from its sample ``skip`` on.

    Sample i of replica r is number ``i * replicas + r`` of the epoch.  All replicas
    have equally many: with ``drop_last`` the rest of the windows is left out, else
    the first ones come again.  Ranks are made where they are used: nothing is
    sorted, shuffled or skipped over.
    """
    if not 0 <= replica < replicas:
        raise ValueError("no such replica")
    per = n // replicas if drop_last else -(-n // replicas)
    ranks = spark.range(min(max(0, skip), per), per)
    if n == 0:
        return ranks.select(F.col("id").alias("rank"), F.col("id").alias("win"))
    number = F.col("id") * replicas + replica
    return ranks.select(F.col("id").alias("rank"), permuted(number % n, n, seed, epoch).alias("win"))


def ranked(windows: DataFrame, n: int, seed: int, epoch: int, key: str = "win") -> DataFrame:
    """Add ``rank`` in the epoch's order to windows numbered by ``key``; null for numbers that are no window's."""
    x = F.col(key)
    return windows.withColumn("rank", F.when((x >= 0) & (x < n), permuted(x, n, seed, epoch, back=True)) if n else F.lit(None).cast("long"))


def permutation_sql(x: str, n: str, seed: int, epoch: int) -> str:
    """The same permutation in DuckDB's SQL, for tests of results; ``n`` is an expression."""
    a = f"(case when {n} <= 1 then 1 else floor(sqrt({n} - 1))::bigint + 1 end)"
    b = f"(({n} + {a} - 1) // {a})"

    def mixed(v: str, k: str) -> str:
        h = f"({v} * {k} + {k})"
        return f"(((xor({h}, {h} >> 29) & 2147483647) * {_MULTIPLIER}) >> 13)"

    body = f"case when k > 0 then (y // b + {mixed('(y % b)', 'k')}) % a * b + y % b else y // b * b + (y % b + {mixed('(y // b)', '(-k)')}) % b end"
    # one more turn for what is still not below n: numbers of a round, then a mark, WALK times
    keys = ", ".join(f"{k}::bigint" for k in round_keys(seed, epoch))
    return f"""(with recursive h as (select {a} as a, {b} as b, {n} as n), walk as (
        select i, {x} as y, 0 as turn from w
        union all select i, list_reduce(list_prepend(y, [{keys}]), lambda y, k: {body}), turn + 1 from walk, h where turn = 0 or (y >= n and turn < {WALK}))
      select i, arg_max(y, turn) as y from walk group by i)"""
