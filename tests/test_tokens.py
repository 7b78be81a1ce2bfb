"""Token streams, windows, samples and numeric tables against loops."""

import math

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import analysis, corpus, sampling, tokens, vectors


def placed(spark, lengths):
    docs, at = [], 1
    for i, n in enumerate(lengths):
        docs.append((i, list(range(at, at + n))))
        at += n
    return tokens.offsets(spark.createDataFrame(docs, "doc_id long, tokens array<int>"))


@pytest.mark.parametrize("lengths,ctx,stride", [([0], 4, 2), ([3], 4, 2), ([4], 4, 2), ([5], 4, 2), ([3, 0, 9, 1, 7], 4, 2), ([20], 4, 7), ([1] * 17, 5, 3), ([2, 30], 3, 3)])
def test_windows(spark, lengths, ctx, stride):
    flat = list(range(1, sum(lengths) + 1))
    got = {r["win"]: (r["x"], r["y"]) for r in tokens.windows(placed(spark, lengths), ctx, stride).collect()}
    want = {}
    for w in range(tokens.window_count(len(flat), ctx, stride)):
        s = w * stride
        x, y = flat[s : s + ctx], flat[s + 1 : s + ctx + 1]
        want[w] = (x + [0] * (ctx - len(x)), y + [0] * (ctx - len(y)))
    assert got == want


def test_window_counts():
    assert [tokens.window_count(n, 32, 8) for n in (0, 32, 33, 40, 41, 49)] == [1, 1, 1, 1, 2, 3]


def test_slices_and_parts(spark):
    a, b = placed(spark, [3, 4]), placed(spark, [5])
    both = tokens.concat_streams([a, b])
    flat = [1, 2, 3, 4, 5, 6, 7, 1, 2, 3, 4, 5]
    for start, stop in ((0, 12), (2, 9), (-4, 99), (5, 5)):
        rows = tokens.stream_slice(both, start, stop).orderBy("off").collect()
        assert [t for r in rows for t in r["tokens"]] == flat[slice(start, stop)]


def test_offsets_join_narrow_rows(spark):
    d = placed(spark, [3, 0, 9])
    plan = d.select("doc_id", "off")._jdf.queryExecution().optimizedPlan().toString()
    window = plan[plan.index("Window"):]
    assert "tokens" not in window.split("Join")[0].split("Project")[0]
    with pytest.raises(Exception, match="name a document"):
        tokens.offsets(spark.createDataFrame([(1, [1]), (1, [2])], "doc_id long, tokens array<int>")).collect()


def test_prefix(spark):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(["aé", "b", None, "cc"])], "doc_id long, text string")
    for limit in range(0, 18):
        data = b"".join(t.encode() + b"\n\n" for t in ["aé", "b", "", "cc"])
        kept = [r["doc_id"] for r in corpus.prefix_sample(d, limit).orderBy("doc_id").collect()]
        want, at = [], 0
        for i, t in enumerate(["aé", "b", "", "cc"]):
            at += len(t.encode()) + 2
            if at <= limit:
                want.append(i)
        assert kept == want and len(data) == 14
    assert corpus.prefix_cut(b"ab\n\ncd", 100) == 2
    assert corpus.prefix_cut("aé".encode(), 2) == 1 and corpus.prefix_cut(b"ab\r\n\r\ncd", 100) == 2
    assert "é😀".encode()[: corpus.prefix_cut("é😀".encode(), 4)].decode() == "é"


def test_sampling_rules(spark):
    d = spark.createDataFrame([(0, i, x) for i, x in enumerate([3.0, 2.0, 2.0, 1.0])], "step_id long, token_id int, logit double")
    assert sampling.top_k(d, 2).count() == 3
    h = spark.createDataFrame([(0, 0), (0, 0), (0, 3)], "step_id long, token_id int")
    e = spark.createDataFrame([(0, 0, 2.0), (0, 3, -2.0), (0, 5, 2.0)], "step_id long, token_id int, logit double")
    got = {r["token_id"]: r["logit"] for r in sampling.repetition_penalty(e, h, 1.3).collect()}
    assert got == {0: 2 / 1.3, 3: -2.6, 5: 2.0}
    p = spark.createDataFrame([(0, 0, 0.99), (0, 1, 0.01)], "step_id long, token_id int, p double")
    assert [(r["token_id"], r["p"]) for r in sampling.top_p(p, 0.9).collect()] == [(0, 1.0)]
    assert sampling.draw(p, 3).count() == 1
    with pytest.raises(Exception, match="outside the vocabulary"):
        sampling.checked_ids(e, 5).collect()


def test_vectors(spark):
    d = spark.createDataFrame([(0, 0, [1.0, 2.0], 0), (0, 1, [3.0, 4.0], 0), (1, 0, [1.0, 2.0], 1), (1, 1, [3.0, 6.0], 1), (1, 2, [9.0, 9.0], 0)], "seq_id int, pos int, vec array<double>, mask int")
    assert {r["seq_id"]: r["pooled"] for r in vectors.pool(d, "mean", 2).collect()} == {0: [0.0, 0.0], 1: [2.0, 4.0]}
    assert {r["seq_id"]: r["pooled"] for r in vectors.pool(d, "last", 2).collect()} == {0: [1.0, 2.0], 1: [3.0, 6.0]}
    with pytest.raises(ValueError):
        vectors.pool(d, "max", 2)
    r = spark.range(1).select(vectors.normalised(F.array(F.lit(3.0), F.lit(4.0))).alias("n"), vectors.normalised(F.array(F.lit(0.0))).alias("z"), vectors.layer_norm(F.array(F.lit(1.0), F.lit(3.0))).alias("l")).first()
    assert r["n"] == [0.6, 0.8] and r["z"] == [0.0] and r["l"][1] == pytest.approx(1 / math.sqrt(1 + 1e-5))
    b = spark.createDataFrame([(0, [5, 6, 7]), (0, [])], "batch int, ids array<int>")
    assert sorted((r["padded"], r["mask"]) for r in vectors.pad_batch(b, "batch", pad_id=1, ctx=2).collect()) == [([1, 1], [1, 0]), ([5, 6], [1, 1])]


def test_numbers(spark):
    for old in range(2, 7):
        for new in range(old, 12):
            want = [round(i * (new - 1) / (old - 1)) for i in range(old)]
            for i in range(1, old):
                want[i] = max(want[i], want[i - 1] + 1)
            got = analysis.layer_placement(spark, old, new).filter("source >= 0").orderBy("source").collect() if new in (old, 11) else None
            assert got is None or [r["layer"] for r in got] == want
    assert analysis.steps(10, 4, 3) == (3, 9) and analysis.resume_position(7, 3, 4, 8) == (2, 1, 32)
    lr = {r["step"]: r["mult"] for r in analysis.lr_schedule(spark, 10, 0.2, 0.1).collect()}
    assert lr[0] == 0.5 and lr[1] == 1.0 and lr[2] == 1.0
