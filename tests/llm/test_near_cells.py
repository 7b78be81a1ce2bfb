"""op1: near copies that come near in most pairs and link in few are compared where they stand."""

import random

import numpy as np
import pandas as pd
import pytest

from corpusloom.llm import buckets, near_dedup
from corpusloom.llm.stages import Stages


def components(n, linked):
    top = list(range(n))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def jaccard(x, y):
    common = sum(min(x[k], y[k]) for k in x.keys() & y.keys())
    return common / (sum(x.values()) + sum(y.values()) - common)


@pytest.mark.parametrize("counted", [False, True])
@pytest.mark.parametrize("two", [False, True])
def test_a_cell_gives_the_links_that_connect(counted, two):
    r = random.Random(5)
    base = r.sample(range(1, 10**9), 60)
    sets = []
    for _ in range(80):
        s = {x: 1 + (x % 3 + (r.random() < 0.1)) * counted for x in r.sample(base, 52 + 2 * counted)}
        sets.append(s | {r.randrange(10**9, 10**10): 1 for _ in range(r.choice([0, 1, 3]))})
    n = len(sets)
    keys = [sorted(s) for s in sets]
    left = [not two or i % 2 == 0 for i in range(n)]
    right = [not two or i % 2 == 1 for i in range(n)]
    component = [0 if i in (3, 4) else 1000 + i for i in range(n)]  # two are linked already
    cell = pd.DataFrame({
        "bucket": 1, "i": 0, "j": int(two), "left": left, "right": right, "vertex": np.arange(n), "component": component,
        "items": [np.array(k, np.uint64).tobytes() for k in keys], "counts": [np.array([s[x] for x in k], np.int32).tobytes() for k, s in zip(keys, sets, strict=True)],
    })
    got = near_dedup._linked(0.8, counted)(cell)
    meets = lambda i, j: (left[i] and right[j] or left[j] and right[i]) and jaccard(sets[i], sets[j]) >= 0.8
    assert all(meets(a, b) for a, b in zip(got.a, got.b, strict=True))
    pairs = {(a, b) for a, b in zip(got.a, got.b, strict=True)}
    want = components(n, lambda i, j: meets(i, j) or {i, j} == {3, 4})
    assert components(n, lambda i, j: (i, j) in pairs or (j, i) in pairs or {i, j} == {3, 4}) == want
    assert len(got) == n - 1 - len(set(want)) and 10 < len(got) < n


@pytest.mark.parametrize("few,width", [(1, 2048), (8, 16), (100, 4)])
def test_common_tokens_are_counted_by_pairs_and_by_columns(monkeypatch, few, width):
    monkeypatch.setattr(near_dedup, "FEW", few)
    monkeypatch.setattr(near_dedup, "WIDTH", width)
    r = random.Random(few)
    sets = [np.array(r.sample(range(2**63, 2**63 + 100), r.choice([1, 10, 40])), np.uint64) for _ in range(30)]
    got = near_dedup._common(sets, [(np.arange(5), np.arange(30)), (np.arange(5, 30), np.arange(5))])
    for i in range(30):
        for j in range(30):
            if i != j and (i < 5 or j < 5):
                assert got[i, j] == len(np.intersect1d(sets[i], sets[j]))


def test_a_large_group_between_linked_and_apart(spark, monkeypatch):
    """Three blocks of documents of one text: all come near, some link; no pair is a row but the links."""
    r = random.Random(8)
    base = [f"w{r.randrange(10**6)}" for _ in range(120)]
    texts = []
    for i in range(90):
        t = list(base)
        for at in r.sample(range(120), 2):
            t[at] = f"n{i}x{at}"
        texts.append(" ".join(t))
    monkeypatch.setattr(buckets, "ROUNDS", 0)
    monkeypatch.setattr(near_dedup, "CELL", 32)
    sets = [dict.fromkeys((tuple(t.split()[k : k + 5]) for k in range(116)), 1) for t in texts]
    rows, write = [], Stages.write

    def counted_write(self, df, batch_rows=None):
        out = write(self, df, batch_rows)
        if df.columns == ["a", "b"]:
            rows.append(out.count())
        return out

    monkeypatch.setattr(Stages, "write", counted_write)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["class_id"] for x in near_dedup.near_duplicates(d, Stages(spark, "t")).collect()}
    assert [got[i] for i in range(90)] == components(90, lambda i, j: jaccard(sets[i], sets[j]) >= 0.8)
    assert max(rows) < 90 * 89 / 8
