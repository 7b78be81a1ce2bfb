"""Components within large buckets, against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import buckets
from corpusloom.llm.stages import Stages


def components(sets, threshold):
    top = list(range(len(sets)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if c >= threshold * (len(sets[i]) + len(sets[j]) - c) - 1e-9:
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def family(seed):
    """Templates with parts of their own: neither too far apart nor all alike."""
    r, out = random.Random(seed), []
    for t in range(3):
        base = [1000 * t + k for k in range(r.choice([8, 20, 40]))]
        for _ in range(30):
            gone = r.choice([0, 1, 2])
            s = set(r.sample(base, len(base) - gone)) | {r.randrange(10**6) for _ in range(r.choice([0, 2, 4, 8]))} | {5000 + t * 10 + r.randrange(6) for _ in range(2)}
            out.append(s)
            if r.random() < 0.3:
                out.append(s | {r.randrange(10**6)})
    return out


@pytest.mark.parametrize("seed,rare,threshold", [(1, 3, 0.8), (2, 3, 0.8), (3, 32, 0.8), (4, 2, 0.7), (5, 5, 0.9)])
def test_large_buckets_are_compared_whole(spark, monkeypatch, seed, rare, threshold):
    monkeypatch.setattr(buckets, "RARE", rare)
    monkeypatch.setattr(buckets, "SMALL_BUCKET", 4)
    monkeypatch.setattr(buckets, "ROUNDS", 0)  # pivots would find most links: here they are left to the last step
    monkeypatch.setattr(buckets, "BLOCK", 16)
    sets = family(seed)
    stages = Stages(spark, "t")
    table = stages.write(spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "vertex long, tokens array<bigint>"))
    members = stages.write(table.select(F.lit(7).alias("bucket"), "vertex", F.lit(len(sets)).alias("n"), F.lit(len(sets) - 1).alias("mass")))

    def links_of(pairs):
        for v in "ab":
            pairs = pairs.join(table.select(F.col("vertex").alias(v), F.col("tokens").alias(f"t_{v}")), v)
        common = F.size(F.array_intersect("t_a", "t_b"))
        return stages.write(pairs.filter(common >= threshold * (F.size("t_a") + F.size("t_b") - common) - 1e-9).select("a", "b"))

    compared = []

    def alike(cells):
        x, y = (cells.filter(side).select("bucket", "i", "j", F.col("vertex").alias(v), F.col("component").alias(f"c_{v}")) for side, v in (("left", "a"), ("right", "b")))
        out = stages.write(x.join(y, ["bucket", "i", "j"]).filter("(i < j or a < b) and c_a <> c_b").select("a", "b").distinct())
        compared.append(out.count())
        return out

    got = buckets.components_of(members, links_of, alike, lambda v: table.join(v.select("vertex"), "vertex", "left_semi"), threshold, stages)
    found = {r["id"]: r["component"] for r in got.collect()}
    assert [found.get(i, i) for i in range(len(sets))] == components(sets, threshold)
    assert sum(compared) < len(sets) * (len(sets) - 1) / 2
    monkeypatch.setattr(buckets, "BROADCAST", 0)
    again = {r["id"]: r["component"] for r in buckets.components_of(members, links_of, alike, lambda v: table.join(v.select("vertex"), "vertex", "left_semi"), threshold, stages, full=(0, 1000)[seed % 2]).collect()}
    assert again == found
