"""K-d tree sharding at distributed weighted medians (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .stages import Stages

BINS = 1024
TIE_BITS = 12
SLOT_BUCKETS = 4096


def log_bins(value: Column) -> Column:
    """A nonnegative number on a logarithmic scale of 1,024 steps, 32 to a doubling."""
    return F.least(F.lit(BINS - 1), F.floor(F.log2(F.greatest(value, F.lit(0)).cast("double") + 1) * 32)).cast("int")


def _splits(rows: DataFrame, nodes: dict[int, list[float]], n_dims: int) -> dict[int, tuple[int, int, int]]:
    """For every node to be split: dimension, bin and tie bucket of the weighted median (of its shards' quotas)."""
    active = rows.filter(F.col("__node").isin(list(nodes)))
    hist = active.select("__node", "__weight", F.posexplode("__dims").alias("dim", "bin")).groupBy("__node", "dim", "bin").agg(F.sum("__weight").alias("w")).collect()  # at most nodes x dimensions x 1,024 rows
    by: dict[tuple[int, int], dict[int, float]] = {}
    for r in hist:
        by.setdefault((r["__node"], r["dim"]), {})[r["bin"]] = r["w"]
    out, ties = {}, {}
    for node, quotas in nodes.items():
        spread = {d: (max(h) - min(h)) for d in range(n_dims) if (h := by.get((node, d)))}
        if not spread:
            continue
        dim = max(spread, key=lambda d: (spread[d], -d))
        h = by[node, dim]
        want = sum(h.values()) * sum(quotas[: len(quotas) // 2]) / (sum(quotas) or 1)
        seen = 0.0
        for b in sorted(h):
            if seen + h[b] > want or b == max(h):
                break
            seen += h[b]
        ties[node] = (dim, b, want - seen)
    if ties:
        at = F.create_map(*[F.lit(x) for n, (d, _, _) in ties.items() for x in (n, d)])
        cut = F.create_map(*[F.lit(x) for n, (_, b, _) in ties.items() for x in (n, b)])
        inside = active.filter(F.col("__node").isin(list(ties))).filter(F.get("__dims", F.element_at(at, F.col("__node"))) == F.element_at(cut, F.col("__node")))
        fine = inside.groupBy("__node", F.shiftrightunsigned("__tie", 64 - TIE_BITS).cast("int").alias("t")).agg(F.sum("__weight").alias("w")).collect()  # at most nodes x 4,096 rows
        weights: dict[int, dict[int, float]] = {}
        for r in fine:
            weights.setdefault(r["__node"], {})[r["t"]] = r["w"]
        for node, (dim, b, room) in ties.items():
            t_cut, seen = 0, 0.0
            for t in sorted(weights.get(node, {})):
                if seen + weights[node][t] / 2 > room:
                    break
                seen, t_cut = seen + weights[node][t], t + 1
            out[node] = (dim, b, t_cut)
    return out


def kd_shards(df: DataFrame, stages: Stages, dims: Mapping[str, Column], weight: Column, group: Column, n_shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """Add ``shard`` (0 to n-1) to the rows of ``df``; shards have nearly equal weight and no group is cut.

    ``dims`` are metadata dimensions as bins (``log_bins``) and must be equal for
    the rows of one ``group``, whose 64-bit hash orders rows of equal bins.  A
    node with several shards is split along its widest dimension (most bins from
    end to end), at the weighted median, or at the fraction that the shards on its
    left are to hold; splitting ends when the leaves have the target weight, one
    shard each.  Medians come from histograms of at most 1,024 bins a dimension
    and 4,096 tie buckets, combined before the shuffle; only those reach the
    driver, rows never move.

    Groups of over 1/64 of a shard's weight (at most 64 a shard, a proven bound)
    are dealt first, heaviest to the emptiest shard, and the tree fills the rest
    of every shard with the others.  A group heavier than a shard has a shard to
    itself and the rest is shared by the other shards.

    Null values must be mapped by the caller's expressions; repeated rows are of
    one group; an empty table has no rows.
    """
    names = set(map(str.lower, df.columns))
    if "shard" in names:
        df = df.drop("shard")
    d = df.withColumns({"__node": F.lit(1), "__weight": weight.cast("double"), "__tie": group, "__dims": F.array(*[c.cast("int") for c in dims.values()])})
    total = d.agg(F.sum("__weight")).first()[0] or 0.0
    n = n_shards or max(1, -(-int(total) // int(target_bytes)))
    heavy = d.groupBy("__tie").agg(F.sum("__weight").alias("w")).filter(F.col("w") > total / n / 64).collect()  # fewer than 64 n rows
    load, place = [0.0] * n, {}
    for r in sorted(heavy, key=lambda r: (-r["w"], r["__tie"])):
        s = min(range(n), key=lambda i: (load[i], i))
        load[s] += r["w"]
        place[r["__tie"]] = s
    # what the tree adds to each shard: the level at which the lighter ones meet
    rest, open_ = total - sum(load), sorted(load)
    level = next((lv for i in range(n, 0, -1) if (lv := (rest + sum(open_[:i])) / i) >= open_[i - 1]), 0.0)
    quota = [max(0.0, level - x) for x in load]
    leaves = {1: [i for i in range(n) if quota[i] > 0] or [0]}
    if place:
        spark = df.sparkSession
        big = spark.createDataFrame([(int(t), int(s)) for t, s in place.items()], "__b_tie long, __b_shard int")
        d = d.join(F.broadcast(big), F.col("__tie") == F.col("__b_tie"), "left").drop("__b_tie")  # fewer than 64 n rows
        d = d.withColumn("__node", F.when(F.col("__b_shard").isNotNull(), 0).otherwise(1))
    else:
        d = d.withColumn("__b_shard", F.lit(None).cast("int"))
    while True:
        split = {k: v for k, v in leaves.items() if len(v) > 1}
        if not split:
            break
        d_old, d = d, stages.write(d)
        cuts = _splits(d, {k: [quota[i] for i in v] for k, v in split.items()}, len(dims))
        nxt = {k: v for k, v in leaves.items() if k not in split}
        node = F.col("__node")
        for k, v in split.items():
            nxt[2 * k], nxt[2 * k + 1] = v[: len(v) // 2], v[len(v) // 2 :]
            dim, b, t = cuts.get(k, (0, 0, 0))
            at = F.get("__dims", F.lit(dim))
            right = (at > b) | ((at == b) & (F.shiftrightunsigned("__tie", 64 - TIE_BITS) >= t))
            node = F.when(F.col("__node") == k, F.when(right, 2 * k + 1).otherwise(2 * k)).otherwise(node)
        d, leaves = d.withColumn("__node", node), nxt
    shard = F.element_at(F.create_map(*[F.lit(x) for k, v in leaves.items() for x in (k, v[0])]), F.col("__node"))
    return d.withColumn("shard", F.coalesce("__b_shard", shard)).drop("__node", "__weight", "__tie", "__dims", "__b_shard")


def with_slots(df: DataFrame, order: list[str]) -> DataFrame:
    """Add ``slot``, gapless from 0 in each ``shard``.

    Rows are numbered in hash buckets (4,096 a shard), after the counts of the
    buckets before: no task needs a whole shard.
    """
    d = df.withColumn("__b", F.pmod(F.xxhash64(*order), F.lit(SLOT_BUCKETS)).cast("int"))
    counts = d.groupBy("shard", "__b").agg(F.count("*").alias("__n"))
    before = W.partitionBy("shard").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    d = d.withColumn("__r", F.row_number().over(W.partitionBy("shard", "__b").orderBy(*order)))
    return d.join(counts, ["shard", "__b"]).withColumn("slot", F.col("__start") + F.col("__r") - 1).drop("__b", "__r", "__start")
