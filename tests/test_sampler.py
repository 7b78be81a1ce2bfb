"""The order of an epoch as arithmetic."""

import pytest

from corpusloom.operators import sampler


def pairs(df):
    return [(r["rank"], r["win"]) for r in df.collect()]


def test_permutations(spark):
    for n in (0, 1, 2, 3, 4, 5, 7, 16, 17, 63, 255, 256, 257, 1000, 10_000):
        got = pairs(sampler.samples(spark, n, 7, 3))
        assert [r for r, _ in got] == list(range(n)) and sorted(w for _, w in got) == list(range(n))
        back = pairs(sampler.ranked(spark.range(n).withColumnRenamed("id", "win"), n, 7, 3))
        assert sorted(back) == sorted(got)
    assert pairs(sampler.samples(spark, 50, 7, 3)) == pairs(sampler.samples(spark, 50, 7, 3)) != pairs(sampler.samples(spark, 50, 7, 4))


def permuted(x, n, seed, epoch):
    """The rule once more, with Python's integers."""
    a, b = sampler.halves(n)
    first = True
    while first or x >= n:
        first = False
        for k in sampler.round_keys(seed, epoch):
            left, right = divmod(x, b)
            h = (right if k > 0 else left) * abs(k) + abs(k)
            h = ((h ^ h >> 29) & 0x7FFFFFFF) * 1540483477 >> 13
            x = (left + h) % a * b + right if k > 0 else left * b + (right + h) % b
    return x


def test_all_small_sizes_by_the_rule(spark):
    for n in range(1, 300):
        assert sorted(permuted(x, n, 1, 0) for x in range(n)) == list(range(n))
    big = 10**12 + 39
    some = spark.range(big - 50, big).select(sampler.permuted(sampler.F.col("id"), big, 1, 0).alias("y")).collect()
    assert [r["y"] for r in some] == [permuted(x, big, 1, 0) for x in range(big - 50, big)]


def test_order_is_mixed(spark):
    w = [w for _, w in pairs(sampler.samples(spark, 4096, 5, 0))]
    assert sum(abs(x - y) for x, y in zip(w, w[1:])) / 4095 > 4096 / 4  # a third of n if uniform
    assert sum(i == x for i, x in enumerate(w)) < 10


def test_resume_and_replicas(spark):
    full = pairs(sampler.samples(spark, 20, 1, 0))
    assert pairs(sampler.samples(spark, 20, 1, 0, skip=7)) == full[7:] and not pairs(sampler.samples(spark, 20, 1, 0, skip=99))
    shares = [pairs(sampler.samples(spark, 20, 1, 0, replicas=3, replica=i)) for i in range(3)]
    assert [len(s) for s in shares] == [6] * 3 and {w for s in shares for _, w in s} == {w for _, w in full[:18]}
    padded = [pairs(sampler.samples(spark, 20, 1, 0, replicas=3, replica=i, drop_last=False)) for i in range(3)]
    assert [len(s) for s in padded] == [7] * 3 and sorted(w for s in padded for _, w in s) == sorted([*range(20), full[0][1]])
    rest = [pairs(sampler.samples(spark, 20, 1, 0, skip=2, replicas=3, replica=i)) for i in range(3)]
    assert rest == [s[2:] for s in shares]
    with pytest.raises(ValueError):
        sampler.samples(spark, 20, 1, 0, replicas=3, replica=3)


def test_nothing_is_shuffled(spark):
    plan = sampler.samples(spark, 10**9, 1, 0, skip=5, replicas=8, replica=1)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
