"""Near-duplicate embeddings: a neighbour graph by NN-descent, then exact links within its components."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .components import connected_components
from .stages import Stages

#: Similarities are kept as millionths, so that equal pairs found in two ways are equal.
SCALE = 1_000_000
LEAF, LEAF_MOST = 64, 256
BLOCK = 512
#: Vectors in a block of saturated ones.
FULL_BLOCK = 1024


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    """A binary column of equally long vectors as a matrix."""
    if not len(column):
        return np.zeros((0, 1), kind)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], kind, (offsets[-1] - offsets[0]) // np.dtype(kind).itemsize, int(offsets[0])).reshape(len(column), -1)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors as bytes, in single precision for the search and as they are for the verdict."""
    for b in batches:
        rows = np.array(b.column(1).to_pylist(), np.float64).reshape(b.num_rows, -1)
        size = np.abs(rows).max(axis=1, keepdims=True, initial=0)
        unit = rows / np.where(size > 0, size, 1)  # first by the largest component: squares then neither overflow nor vanish
        unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-300)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in unit.astype(np.float32)], pa.binary()), pa.array([x.tobytes() for x in unit], pa.binary()), b.column(2)], ["id", "vec", "exact", "copies"])


def _leaves(trees: int, bits: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            m = _matrix(b.column(1), np.float32)
            planes = np.random.default_rng(seed).normal(size=(m.shape[1], trees * bits)).astype(np.float32)
            codes = ((m @ planes) > 0).reshape(len(m), trees, bits).astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))
            for t in range(trees):
                yield pa.RecordBatch.from_arrays([pa.array(codes[:, t] * trees + t), b.column(0), b.column(1)], ["leaf", "id", "vec"])

    return run


def _within_leaf(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.frombuffer(b"".join(pdf.vec), np.float32).reshape(len(pdf), -1)
        ids, s = pdf.id.to_numpy(), m @ m.T
        np.fill_diagonal(s, -2)
        k_now = min(k, len(m) - 1)
        if k_now < 1:
            return pd.DataFrame({"u": [], "v": [], "s": []}).astype({"u": "int64", "v": "int64", "s": "int32"})
        best = np.argpartition(-s, k_now - 1, axis=1)[:, :k_now]
        sims = np.take_along_axis(s, best, 1)
        return pd.DataFrame({"u": np.repeat(ids, k_now), "v": ids[best.ravel()], "s": np.rint(sims.ravel() * SCALE).astype(np.int32)})

    return run


def _local_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare all members of each vertex's neighbourhood; rows come sorted by vertex.

    A pair comes out, in the direction in which it does, if it beats the last
    entry of a member's list.
    """
    rest: list[tuple] = []

    def groups():
        nonlocal rest
        for b in batches:
            u, v, least = (b.column(i).to_numpy() for i in range(3))
            if not len(u):
                continue
            m = _matrix(b.column(3), np.float32)
            cuts = np.flatnonzero(np.diff(u)) + 1
            bounds = [0, *cuts.tolist(), len(u)]
            for a, z in zip(bounds[:-1], bounds[1:], strict=True):
                piece = (u[a], v[a:z], least[a:z], m[a:z])
                if rest and rest[0][0] != piece[0]:
                    yield rest
                    rest = []
                rest.append(piece)
        if rest:
            yield rest

    out: list[np.ndarray] = []
    held = 0
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("s", pa.int32())])

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out])) for i in range(2)] + [pa.array(np.concatenate([o[2] for o in out]).astype(np.int32))], schema=schema)

    for g in groups():
        v, least, m = (np.concatenate([p[i] for p in g]) if len(g) > 1 else g[0][i] for i in (1, 2, 3))
        s = np.rint(m @ m.T * SCALE)
        np.fill_diagonal(s, -2 * SCALE)
        i, j = np.nonzero(s > least[:, None])
        if len(i):
            out.append((v[i], v[j], s[i, j]))
            held += len(i)
            if held > 100_000:
                yield flush()
                out, held = [], 0
    if out:
        yield flush()


def _merge(pairs: DataFrame, k: int) -> DataFrame:
    """Lists of the k best: ``(u, nb array<struct<s, v>>, least)``; at most a few lists meet for a vertex."""
    lists = pairs.groupBy("u").agg(F.collect_set(F.struct("s", "v")).alias("all"))
    nb = F.slice(F.sort_array("all", asc=False), 1, k)
    return lists.select("u", nb.alias("nb")).withColumn("least", F.when(F.size("nb") < k, -SCALE).otherwise(F.element_at("nb", -1)["s"]))


def _flat(lists: DataFrame) -> DataFrame:
    return lists.select("u", F.explode("nb").alias("e")).select("u", F.col("e.v").alias("v"), F.col("e.s").alias("s"))


def _blocks(threshold: float):
    """Links of vectors within a component: sums over the block pairs that a group holds."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, links = [], []
        for _, part in pdf.groupby("component", sort=False):
            m = np.frombuffer(b"".join(part.exact), np.float64).reshape(len(part), -1)
            left, right = part.left.to_numpy(), part.right.to_numpy()
            a, b = np.flatnonzero(left), np.flatnonzero(right)
            number, copies = part.id.to_numpy(), part.copies.to_numpy()
            near = (m[a] @ m[b].T >= threshold) & (number[a][:, None] != number[b][None])
            ids.append(number[a])
            links.append(near @ copies[b])
        return pd.DataFrame({"id": np.concatenate(ids), "links": np.concatenate(links).astype(np.int64)})

    return run


def _bridges(threshold: float):
    """Links across components in a cell of two blocks, one for each two components."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.frombuffer(b"".join(pdf.exact), np.float64).reshape(len(pdf), -1)
        number, component = pdf.id.to_numpy(), pdf.component.to_numpy()
        a, b = np.flatnonzero(pdf.left.to_numpy()), np.flatnonzero(pdf.right.to_numpy())
        i, j = np.nonzero((m[a] @ m[b].T >= threshold) & (component[a][:, None] != component[b][None]))
        out = pd.DataFrame({"a": number[a[i]], "b": number[b[j]], "ca": component[a[i]], "cb": component[b[j]]})
        return out.drop_duplicates(["ca", "cb"])[["a", "b"]]

    return run


def _audit(queries: np.ndarray, ids: np.ndarray, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids), np.int64)
        for b in batches:
            if b.num_rows:
                m = _matrix(b.column(1), np.float64)
                near = (m @ queries.T >= threshold) & (b.column(0).to_numpy()[:, None] != ids[None])
                total += near.T @ b.column(2).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["id", "links"])

    return run


def near_duplicate_vectors(df: DataFrame, stages: Stages, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, k: int = 10, trees: int = 10, rounds: int = 2, audit: int = 1000, least_recall: float = 0.99, tries: int = 3, seed: int = 1) -> DataFrame:
    """Links of cosine ``threshold`` or more (double precision), and what they connect.

    Returns for every row: ``uid``, the id, ``n_links`` (other rows linked with it),
    ``component_id`` (smallest id that links reach) and ``kept`` (id = component_id).

    1. Equal vectors are one vertex with a number of copies.
    2. A random-projection forest gives each vertex a first list of ``k``
       neighbours; leaves over 256 vectors are dealt into smaller ones.
    3. NN-descent: members of a vertex's neighbourhood (its list and the lists that
       hold it) are compared with one another and lists keep the best.  Lists with
       only near duplicates are saturated: they grow fourfold, from the neighbours
       of their neighbours.
    4. List entries at or above the threshold (checked in double precision) become
       components, within which links are counted exactly, in blocks of 512 vectors
       whose pairs are never rows.  A link that lists lose lies between two vectors
       whose lists of ``k`` are saturated: before the count, all of these are
       compared across components, in blocks of 1,024.
    5. ``audit`` vectors, those with the smallest hashes, are held against all
       others.  If less than ``least_recall`` of their links is found, another
       forest and another descent add to the lists, up to ``tries`` times; a last
       try that is still below gives a warning with the share found.

    Vectors that are null, empty or zero, or hold null or non-finite components
    link with nothing: no links, their own component.  Vectors of different
    lengths have no cosine: each length is searched by itself.  Rows of equal ids
    are rows of their own; an empty table gives none.
    """
    raw = stages.write(df.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vec")))
    good = stages.write(raw.filter((F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)))
    lengths = [r["n"] for r in good.select(F.size("vec").alias("n")).distinct().orderBy("n").collect()]  # a row for each length
    parts = [_of_length(good.filter(F.size("vec") == n), stages, threshold, k, trees, rounds, audit, least_recall, tries, seed) for n in lengths or [0]]
    vertex, of_row, component, counted = (reduce(DataFrame.unionByName, tables) for tables in zip(*parts, strict=True))
    rows = raw.select("uid", "id").join(of_row, "uid", "left").join(vertex.select("vertex", "copies"), "vertex", "left")
    rows = rows.join(component.select(F.col("id").alias("vertex"), "component"), "vertex", "left").join(counted.select(F.col("id").alias("vertex"), "links"), "vertex", "left")
    rows = rows.select("uid", "id", F.when(F.col("vertex").isNull(), F.struct(F.lit(1).alias("alone"), F.col("uid").alias("c"))).otherwise(F.struct(F.lit(0).alias("alone"), F.coalesce("component", "vertex").alias("c"))).alias("class"), (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links"))
    rows = stages.write(rows)
    least = stages.write(rows.groupBy("class").agg(F.min("id").alias("component_id")))
    return rows.join(least, "class").select("uid", F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def _of_length(good: DataFrame, stages: Stages, threshold: float, k: int, trees: int, rounds: int, audit: int, least_recall: float, tries: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The search among sound vectors ``(uid, id, vec)`` of one length: distinct vectors, the vector of each row, components, and links of each vector."""
    spark = good.sparkSession
    plus = F.transform("vec", lambda x: x + F.lit(0.0))  # -0.0 equals 0.0
    vertex = stages.write(good.groupBy(plus.alias("vec")).agg(F.min("uid").alias("vertex"), F.count("*").alias("copies")))
    of_row = stages.write(good.select("uid", plus.alias("vec")).join(vertex, "vec").select("uid", "vertex"))
    vectors = stages.write(vertex.select("vertex", "vec", "copies").mapInArrow(_pack, "id long, vec binary, exact binary, copies long"))
    n = vectors.count()
    low = int(np.ceil(threshold * SCALE))
    lists = spark.createDataFrame([], "u long, nb array<struct<s:int,v:long>>, least int")
    search = vectors.select("id", "vec")

    def descend(lists: DataFrame, turn: int) -> DataFrame:
        bits = int(np.clip(np.ceil(np.log2(max(2, n) / LEAF)), 1, 40))
        leaves = stages.write(search.mapInArrow(_leaves(trees, bits, seed + 1000 * turn), "leaf long, id long, vec binary"))
        sizes = stages.write(leaves.groupBy("leaf").agg(F.count("*").alias("n")))
        parts = leaves.join(sizes, "leaf").withColumn("part", F.pmod(F.xxhash64("id", "leaf"), F.ceil(F.col("n") / LEAF_MOST)))
        found = parts.select("leaf", "part", "id", "vec").groupBy("leaf", "part").applyInPandas(_within_leaf(k), "u long, v long, s int")
        lists = stages.write(_merge(_flat(lists).union(found), k))
        for _ in range(rounds):
            lists = stages.write(_merge(_flat(lists).union(_joined(lists, neighbourhoods(lists))), k))
        return lists

    def neighbourhoods(lists: DataFrame) -> DataFrame:
        ahead = _flat(lists)
        back = ahead.select(F.col("v").alias("u"), F.col("u").alias("v"), "s").withColumn("r", F.row_number().over(W.partitionBy("u").orderBy(F.desc("s"), "v"))).filter(F.col("r") <= k)
        return ahead.select("u", "v").union(back.select("u", "v")).union(lists.select("u", F.col("u").alias("v"))).distinct()

    def _joined(lists: DataFrame, hoods: DataFrame) -> DataFrame:
        members = hoods.join(search.join(lists.select(F.col("u").alias("id"), "least"), "id", "left").select(F.col("id").alias("v"), F.coalesce("least", F.lit(-SCALE)).alias("least"), "vec"), "v")
        return members.select("u", "v", "least", "vec").repartition("u").sortWithinPartitions("u").mapInArrow(_local_join, "u long, v long, s int")

    def bridges(full: DataFrame, component: DataFrame) -> DataFrame:
        """Links between components of vectors with saturated lists: any two blocks of them meet in one cell."""
        some = full.select(F.col("u").alias("id")).join(component, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
        if some.select("component").distinct().limit(2).count() < 2:
            return spark.createDataFrame([], "a long, b long")
        blocks = -(-some.count() // FULL_BLOCK)
        some = some.join(vectors.select("id", "exact"), "id").withColumn("own", F.pmod(F.xxhash64("id"), F.lit(blocks)))
        some = some.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        cells = some.select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("left"), (F.col("own") >= F.col("other")).alias("right"), "id", "exact", "component")
        return stages.write(cells.groupBy("i", "j").applyInPandas(_bridges(threshold), "a long, b long"))

    def links_of(lists: DataFrame) -> DataFrame:
        likely = _flat(lists).filter(F.col("s") >= low - 20).select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct()
        for side in ("a", "b"):
            likely = likely.join(vectors.select(F.col("id").alias(side), F.col("exact").alias(f"exact_{side}")), side)
        return stages.write(likely.select("a", "b", "exact_a", "exact_b").mapInArrow(_linked(threshold), "a long, b long"))

    links = spark.createDataFrame([], "a long, b long")
    component = counted = None
    saturated = spark.createDataFrame([], "u long")
    for turn in range(tries):
        lists = descend(lists, turn)
        links = links.union(links_of(lists))
        grown, size = lists, k
        for _ in range(2):  # saturated lists: k, 4 k, 16 k
            full = stages.write(grown.filter((F.size("nb") >= size) & (F.element_at("nb", -1)["s"] >= low)))
            if not full.limit(1).count():
                break
            if size == k:
                saturated = saturated.union(full.select("u")).distinct()
            size *= 4
            one = _flat(full).select("u", "v")
            two = one.join(lists.select(F.col("u").alias("v"), F.expr("transform(nb, e -> e.v)").alias("next")), "v").select("u", F.explode("next").alias("v"))
            hoods = one.union(two).union(full.select("u", F.col("u").alias("v"))).distinct()
            pairs = _joined(full.select("u", "nb", F.lit(low - 20).alias("least")), hoods.join(full.select("u"), "u", "left_semi"))
            grown = stages.write(_merge(_flat(full).union(pairs.join(full.select("u"), "u", "left_semi")), size))
            links = links.union(links_of(grown))
        links = stages.write(links.distinct())
        component = stages.write(connected_components(links, stages))
        across = bridges(saturated, component)
        if across.limit(1).count():
            links = stages.write(links.union(across))
            component = stages.write(connected_components(links, stages))
        members = component.join(vectors.select("id", "exact", "copies"), "id")
        sizes = component.groupBy("component").agg(F.count("*").alias("n"))
        members = members.join(sizes, "component").withColumn("blocks", F.ceil(F.col("n") / BLOCK)).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
        # a block meets every block of its component: members stand left in their own row of pairs, and right in their own column
        pairs = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        both = F.array(F.struct(F.col("own").alias("i"), F.col("other").alias("j"), F.lit(True).alias("left"), (F.col("own") == F.col("other")).alias("right")), F.when(F.col("own") != F.col("other"), F.struct(F.col("other").alias("i"), F.col("own").alias("j"), F.lit(False).alias("left"), F.lit(True).alias("right"))))
        pairs = pairs.select("component", "id", "exact", "copies", "blocks", F.explode(F.filter(both, lambda x: x.isNotNull())).alias("p")).select("component", "id", "exact", "copies", "blocks", "p.*")
        n_groups = max(16, n // 4096)
        pairs = pairs.withColumn("g", F.when(F.col("blocks") > 1, F.xxhash64("component", "i", "j")).otherwise(F.pmod(F.xxhash64("component"), F.lit(n_groups))))
        counted = stages.write(pairs.select("g", "component", "id", "exact", "copies", "left", "right").groupBy("g").applyInPandas(_blocks(threshold), "id long, links long").groupBy("id").agg(F.sum("links").alias("links")))
        sample = vectors.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(audit).select("id", "exact").toArrow().combine_chunks().to_batches()
        if not sample:
            break
        truth = vectors.select("id", "exact", "copies").mapInArrow(_audit(_matrix(sample[0].column(1), np.float64).copy(), sample[0].column(0).to_numpy().copy(), threshold), "id long, links long").groupBy("id").agg(F.sum("links").alias("truth"))
        held = truth.join(counted, "id", "left").agg(F.sum("truth").alias("truth"), F.sum("links").alias("links")).first()
        if (held["links"] or 0) >= least_recall * (held["truth"] or 0):
            break
        if turn == tries - 1:
            warnings.warn(f"{held['links'] or 0} of {held['truth']} audited links found, less than {least_recall}", stacklevel=2)
    return vertex, of_row, component, counted


def _linked(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near = np.einsum("ij,ij->i", _matrix(b.column(2), np.float64), _matrix(b.column(3), np.float64)) >= threshold
                yield b.select(["a", "b"]).filter(pa.array(near))

    return run
