"""The trie of conversations' prefixes, folded along heavy paths."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .stages import Stages

#: Conversations c and c - c % GROUP share a beginning of up to CYCLE - 1 turns.
GROUP, CYCLE = 5, 9
#: Turns, or nodes of a path, that are worked on together.
BLOCK = 256
#: Conversations' ids in one piece of a node's list.
PIECE = 4096
#: A node's name: two numbers.
KEY = ["k1", "k2"]
_LANES = ["s0", "s1", "s2", "s3"]


def _lane(x: Column, high: bool) -> Column:
    return F.shiftrightunsigned(x, 32) if high else x.bitwiseAND(F.lit(0xFFFFFFFF))


def _joined(high: Column, low: Column) -> Column:
    return F.call_function("shiftleft", high.bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(32)).bitwiseOR(low.bitwiseAND(F.lit(0xFFFFFFFF)))


def ranked_turns(conversations: DataFrame, stages: Stages, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``(conv_id, r, bytes, c1, c2)``: every turn's number from 0, the bytes of its text, and two hashes of its content.

    Turns are put in order by ranges, which may cut a long conversation; a number
    is the place in the range and what lies before it.
    """
    d = conversations.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("at"))
    order = ["conv_id", "turn", "role", "text", "at"]
    d = d.filter("conv_id is not null").repartitionByRange(*order).sortWithinPartitions(*order)
    d = stages.write(d.select("conv_id", F.octet_length("text").cast("long").alias("bytes"), F.xxhash64("role", "text").alias("c1"), F.xxhash64(F.lit(7), "text", "role").alias("c2"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    parts = d.groupBy("conv_id", "part").agg(F.min("at").alias("lo"), F.count("*").alias("n"))
    before = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = stages.write(parts.select("conv_id", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("lo")).alias("shift")))
    return stages.write(d.join(parts, ["conv_id", "part"]).select("conv_id", (F.col("at") + F.col("shift")).alias("r"), "bytes", "c1", "c2"))


def rebuilt_turns(turns: DataFrame, stages: Stages, group: int, cycle: int) -> tuple[DataFrame, DataFrame]:
    """``(conv_id)`` of all conversations, and the turns ``(conv_id, pos, bytes, c1, c2)`` that they are rebuilt of."""
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = sizes.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(cycle)).alias("h"))
    convs = stages.write(convs)
    of_base = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = stages.write(convs.join(of_base, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("n_head")))
    heads = turns.filter(F.col("r") < cycle - 1).withColumnRenamed("conv_id", "base").join(convs, "base").filter("r < h")
    tails = turns.join(convs, "conv_id").filter("r >= h")
    columns = ["bytes", "c1", "c2"]
    both = heads.select("conv_id", F.col("r").alias("pos"), *columns).union(tails.select("conv_id", (F.col("n_head") + F.col("r") - F.col("h")).alias("pos"), *columns))
    return convs.select("conv_id"), stages.write(both)


def steps_of(rebuilt: DataFrame, stages: Stages) -> DataFrame:
    """``(conv_id, d, k1, k2, p1, p2, bytes)``: the node at every depth of a conversation, and its parent.

    A node's name has 128 bits: four sums of hashes of turns with their places.
    Sums run in blocks, so that a conversation of any length is no task's own.
    """
    a, b = F.xxhash64("c1", "pos"), F.xxhash64("c2", "pos")
    d = rebuilt.select("conv_id", "pos", "bytes", F.floor(F.col("pos") / BLOCK).alias("block"), *[_lane(x, high).alias(n) for n, (x, high) in zip(_LANES, ((a, True), (a, False), (b, True), (b, False)), strict=True)])
    sums = d.groupBy("conv_id", "block").agg(*[F.sum(n).alias(n) for n in _LANES])
    before = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sums = stages.write(sums.select("conv_id", "block", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"b_{n}") for n in _LANES]))
    inside = W.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumns({f"i_{n}": F.sum(n).over(inside) for n in _LANES}).join(sums, ["conv_id", "block"])
    s = [F.col(f"b_{n}") + F.col(f"i_{n}") for n in _LANES]
    p = [x - F.col(n) for x, n in zip(s, _LANES, strict=True)]
    return stages.write(d.select("conv_id", (F.col("pos") + 1).alias("d"), _joined(s[0], s[1]).alias("k1"), _joined(s[2], s[3]).alias("k2"), _joined(p[0], p[1]).alias("p1"), _joined(p[2], p[3]).alias("p2"), "bytes"))


def nodes_of(convs: DataFrame, steps: DataFrame, stages: Stages) -> DataFrame:
    """Nodes ``(k1, k2, p1, p2, d, conv_id, n_convs, saved, parent_conv_id, n_children, light)``; the largest child of a node is not light."""
    nodes = steps.groupBy(*KEY).agg(F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("d").alias("d"), F.min("bytes").alias("bytes"), F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = root.select(zero.alias("k1"), zero.alias("k2"), none.alias("p1"), none.alias("p2"), zero.alias("d"), zero.alias("bytes"), "n_convs", "conv_id")
    nodes = stages.write(nodes.unionByName(root))
    # ties go to the child with the smallest conversation, which no other child has
    largest = F.min(F.struct((-F.col("n_convs")).alias("n"), "conv_id", *KEY)).alias("largest")
    below = nodes.filter("d > 0").groupBy("p1", "p2").agg(F.count("*").alias("n_children"), largest)
    below = stages.write(below.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), "n_children", F.col("largest.k1").alias("h1"), F.col("largest.k2").alias("h2")))
    nodes = stages.write(nodes.join(below, KEY, "left"))
    above = stages.write(nodes.filter("n_children > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("h1").alias("of1"), F.col("h2").alias("of2")))
    light = (F.col("k1") != F.col("of1")) | (F.col("k2") != F.col("of2"))
    d = nodes.join(above, ["p1", "p2"], "left")
    return stages.write(d.select(*KEY, "p1", "p2", "d", "conv_id", "n_convs", ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"), "parent_conv_id", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.coalesce(light, F.lit(False)).alias("light")))


def ends_of(convs: DataFrame, steps: DataFrame, stages: Stages) -> DataFrame:
    """``(conv_id, k1, k2)``: the node that each conversation ends at."""
    last = steps.groupBy("conv_id").agg(F.max(F.struct("d", *KEY)).alias("last"))
    return stages.write(convs.join(last, "conv_id", "left").select("conv_id", *[F.coalesce(F.col(f"last.{k}"), F.lit(0)).cast("long").alias(k) for k in KEY]))


def heavy_paths(nodes: DataFrame, steps: DataFrame, ends: DataFrame, stages: Stages) -> DataFrame:
    """Nodes with ``h1, h2`` (the head of the heavy path that each lies on) and ``level`` (light edges above it).

    A node's conversation passes all its ancestors, so that the head is the last
    light node on that conversation's own way: a running maximum, in blocks.  Only
    the first of equal conversations is followed.
    """
    first = nodes.select(*KEY, F.col("conv_id").alias("owner"))
    followed = stages.write(ends.join(first, KEY).filter("owner = conv_id").select("conv_id"))
    own = nodes.filter("d > 0").select(*KEY, F.col("conv_id").alias("owner"), "light")
    way = steps.select("conv_id", "d", *KEY).join(followed, "conv_id", "left_semi").join(own, KEY)
    way = stages.write(way.withColumn("block", F.floor((F.col("d") - 1) / BLOCK)))
    head = F.when(F.col("light"), F.struct("d", *KEY))
    tops = way.groupBy("conv_id", "block").agg(F.max(head).alias("top"), F.count_if("light").alias("n"))
    before = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    tops = stages.write(tops.select("conv_id", "block", F.max("top").over(before).alias("b_top"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("b_n")))
    inside = W.partitionBy("conv_id", "block").orderBy("d").rowsBetween(W.unboundedPreceding, 0)
    way = way.withColumns({"i_top": F.max(head).over(inside), "i_n": F.sum(F.col("light").cast("long")).over(inside)}).join(tops, ["conv_id", "block"])
    top = F.coalesce("i_top", "b_top")
    placed = way.filter("owner = conv_id").select(*KEY, *[F.coalesce(top[k], F.lit(0)).cast("long").alias(h) for k, h in (("k1", "h1"), ("k2", "h2"))], (F.col("i_n") + F.col("b_n")).alias("level"))
    return stages.write(nodes.join(placed, KEY, "left").na.fill(0, ["h1", "h2", "level"]))  # the root heads its own path


_CARRIED = ["d", "conv_id", "n_convs", "parent_conv_id", "n_children"]
#: Sums from a block's last node up to its first, over what its deeper blocks hold.
_SUFFIX = """
aggregate(block_nodes, named_struct('s', after_saved, 'l', after_leaves, 'out', cast(array() as array<struct<{fields}, saved_tokens: bigint, n_leaves: bigint>>)),
  (acc, x) -> named_struct('s', acc.s + x.saved, 'l', acc.l + x.leaves,
    'out', concat(acc.out, array(named_struct({values}, 'saved_tokens', acc.s + x.saved, 'n_leaves', acc.l + x.leaves)))),
  acc -> acc.out)"""


def subtree_sums(paths: DataFrame, stages: Stages) -> DataFrame:
    """Nodes with ``saved_tokens`` and ``n_leaves``, summed over their subtrees.

    From the deepest level of light edges up: what hangs on a node by light edges
    is added to its own, then sums run along each path from its leaf to its head,
    and the head's sum goes to the node that the path hangs on.  A light child has
    at most half of its parent's conversations, so levels are at most the binary
    logarithm of their number.  A path stands in arrays of at most ``BLOCK`` nodes.
    """
    top = paths.agg(F.max("level")).first()[0]
    out, hung = [], None
    kept = [*KEY, "p1", "p2", "light", *_CARRIED]
    for level in range(top if top is not None else -1, -1, -1):
        d = paths.filter(F.col("level") == level).withColumn("leaves", (F.col("n_children") == 0).cast("long"))
        if hung is not None:
            d = d.join(hung, KEY, "left").withColumns({"saved": F.col("saved") + F.coalesce("add_saved", F.lit(0)), "leaves": F.col("leaves") + F.coalesce("add_leaves", F.lit(0))})
        node = F.struct((-F.col("d")).alias("up"), *kept, "saved", "leaves")
        d = d.withColumn("block", F.floor(F.col("d") / BLOCK)).groupBy("h1", "h2", "block").agg(F.array_sort(F.collect_list(node)).alias("block_nodes"), F.sum("saved").alias("sum_saved"), F.sum("leaves").alias("sum_leaves"))
        deeper = W.partitionBy("h1", "h2").orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
        d = d.withColumns({f"after_{x}": F.coalesce(F.sum(f"sum_{x}").over(deeper), F.lit(0)) for x in ("saved", "leaves")})
        kinds = {f.name: f.dataType.simpleString() for f in paths.schema.fields}
        suffix = _SUFFIX.format(fields=", ".join(f"{c}: {kinds[c]}" for c in kept), values=", ".join(f"'{c}', x.{c}" for c in kept))
        d = stages.write(d.select(F.inline(F.expr(suffix))))
        out.append(d.drop("p1", "p2", "light"))
        heads = d.filter("light").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.sum("saved_tokens").alias("add_saved"), F.sum("n_leaves").alias("add_leaves"))
        hung = stages.write(heads)
    if not out:
        return paths.select(*KEY, *_CARRIED, F.col("saved").alias("saved_tokens"), F.col("n_children").alias("n_leaves"))
    whole = out[0]
    for d in out[1:]:
        whole = whole.unionByName(d)
    return whole


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(k1, k2, first, ids)``: sorted ids of a node, comma-joined, a few thousand at a time."""
    for batch in batches:
        k1, k2, ids = (batch.column(i).to_numpy() for i in range(3))
        if not len(ids):
            continue
        cuts = np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1
        cuts = np.unique(np.concatenate([[0], cuts, np.arange(0, len(ids), PIECE), [len(ids)]]))
        text = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        at = cuts[:-1]
        yield pa.RecordBatch.from_arrays([pa.array(k1[at]), pa.array(k2[at]), pa.array(ids[at]), pa.array(text)], ["k1", "k2", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(k1, k2, ends_sha256)`` out of the sorted pieces of the nodes, one after the other."""
    now, state = None, None
    for batch in batches:
        rows: list[tuple[int, int, str]] = []
        for k1, k2, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
            if (k1, k2) != now:
                if state:
                    rows.append((*now, state.hexdigest()))
                now, state = (k1, k2), hashlib.sha256(ids.as_py().encode())
            else:
                state.update(b"," + ids.as_py().encode())
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], ["k1", "k2", "ends_sha256"])
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int64()), pa.array([state.hexdigest()])], ["k1", "k2", "ends_sha256"])


def end_digests(ends: DataFrame, stages: Stages) -> DataFrame:
    """SHA-256 of the ids of the conversations that end at a node; a node at which most end is joined by many tasks and hashed in a stream."""
    order = [*KEY, "conv_id"]
    ids = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = stages.write(ids.mapInArrow(_pieces, "k1 long, k2 long, first long, ids string"))
    return stages.write(pieces.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(_digests, "k1 long, k2 long, ends_sha256 string"))


def prefix_trie(conversations: DataFrame, stages: Stages, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", group: int = GROUP, cycle: int = CYCLE) -> DataFrame:
    """The trie of all beginnings of conversations, with what sharing them saves.

    Turns are ordered by ``turn`` (null first), equal ones by role, then text; null
    roles and texts are empty.  A conversation c is rebuilt: the first h turns of
    conversation c - c % ``group`` (as many as it has), then its own turns after its
    first h, where h is the CRC-32 of its decimal id modulo ``cycle``.  A node is a
    distinct beginning of d turns (role, text); its members are the conversations
    that begin with it.

    Returns a row for each node: ``conv_id`` (smallest member), ``depth``,
    ``parent_conv_id``, ``n_convs``, ``n_children``, and over its subtree
    ``n_leaves`` and ``saved_tokens`` (bytes of last texts times members but one),
    and ``ends_sha256`` of the members that end at it.

    Rows without an id belong to no conversation; repeated rows are turns of their
    own; texts are hashed whole (a node's name has 128 bits); a conversation without
    turns is a member of the root; an empty table has no nodes.
    """
    turns = ranked_turns(conversations, stages, id_col, turn_col, role_col, text_col)
    convs, rebuilt = rebuilt_turns(turns, stages, group, cycle)
    steps = steps_of(rebuilt, stages)
    nodes = nodes_of(convs, steps, stages)
    ends = ends_of(convs, steps, stages)
    sums = subtree_sums(heavy_paths(nodes, steps, ends, stages), stages)
    out = sums.join(end_digests(ends, stages), KEY, "left")
    return out.select("conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
