"""Near-duplicate documents: DartMinHash signatures, banded joins, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .buckets import cells_of, components_of, shared_buckets
from .dartminhash import band_keys, signatures
from .stages import Stages
from .wordhash import distinct_per_text, mix64, shingle_hashes, word_hashes

#: Members of a block of a large bucket, and bytes of their sets: two blocks are one task's group.
CELL = 1024
CELL_BYTES = 1 << 24
#: Tokens of up to so many sets of a cell add to pairs, others are columns of a matrix, so many at a time.
FEW = 8
WIDTH = 2048


def _sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Distinct shingles, their counts and bounds for groups of texts, with the name of each set (0 for none)."""
    for first, hashes, bounds in word_hashes(column):
        values, counts, cuts = distinct_per_text(*shingle_hashes(hashes, bounds, size), len(bounds) - 1)
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(mix64(values ^ np.uint64(0x94D049BB133111EB)), out=total[1:])
        name = mix64(total[cuts[1:]] - total[cuts[:-1]] + np.diff(cuts).astype(np.uint64)) | np.uint64(1)
        yield first, values, counts, cuts, np.where(np.diff(cuts) > 0, name, 0).astype(np.uint64)


def _binary(parts: np.ndarray, width: int) -> pa.Array:
    """Rows of a contiguous array as one binary column."""
    n = len(parts)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1, dtype=np.int32) * width).tobytes()), pa.py_buffer(np.ascontiguousarray(parts).tobytes())])


def _sketch(size: int, k: int, bands: int, counted: bool):
    rows = k // bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid = batch.column(0)
            for first, values, counts, cuts, name in _sets(batch.column(1), size):
                some = np.flatnonzero(name)
                if not len(some):
                    continue
                weights = counts.astype(np.float64) if counted else np.ones(len(values))
                sig = signatures(values, weights, np.append(cuts[some], cuts[-1]), k)
                keys = band_keys(sig, bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([uid.take(pa.array(some + first)), pa.array(name[some].view(np.int64)), lists, _binary((sig >> np.uint64(17)).astype(np.uint8), k)], ["uid", "vertex", "bands", "sig"])

    return run


def _set_bytes(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, values, counts, cuts, name in _sets(batch.column(0), size):
                some = np.flatnonzero(name)
                at = cuts[:-1][some]
                end = cuts[1:][some]
                yield pa.RecordBatch.from_arrays([pa.array(name[some].view(np.int64)), pa.array([values[a:b].tobytes() for a, b in zip(at, end, strict=True)], pa.binary()), pa.array([counts[a:b].astype(np.int32).tobytes() for a, b in zip(at, end, strict=True)], pa.binary())], ["vertex", "items", "counts"])

    return run


def _promising(least: float):
    """Pairs whose signatures agree in a share of bytes that a similarity of ``least`` would give."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.array([np.frombuffer(v, np.uint8) for v in b.column(c).to_pylist()]) for c in ("sig_a", "sig_b"))
            agree = ((x == y).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
            yield b.select(["a", "b"]).filter(pa.array(agree >= least))

    return run


def jaccard(x: np.ndarray, cx: np.ndarray, y: np.ndarray, cy: np.ndarray, counted: bool) -> float:
    common, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not counted:
        return len(common) / (len(x) + len(y) - len(common))
    least = np.minimum(cx[i], cy[j]).sum()
    return float(least) / float(cx.sum() + cy.sum() - least)


def _verified(threshold: float, counted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [jaccard(np.frombuffer(xa, np.uint64), np.frombuffer(ca, np.int32), np.frombuffer(xb, np.uint64), np.frombuffer(cb, np.int32), counted) >= threshold for xa, ca, xb, cb in zip(*(b.column(c).to_pylist() for c in ("items_a", "counts_a", "items_b", "counts_b")), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _common(sets: list[np.ndarray], parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Sizes of intersections, a matrix of which the ``parts`` (rows, columns) are filled in.

    A token of few sets adds to each pair of these, others are columns of a matrix
    of zeros and ones, whose product with itself counts them, ``WIDTH`` at a time.
    """
    n = len(sets)
    _, at, holders = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, h = np.repeat(np.arange(n), [len(s) for s in sets]), holders[at]
    order = np.lexsort((at, h))
    row, at, h = row[order], at[order], h[order]
    out = np.zeros((n, n), np.float32)
    for k in range(2, FEW + 1):  # tokens of k sets stand k by k
        held = row[slice(*np.searchsorted(h, [k, k + 1]))].reshape(-1, k)
        for x in range(k):
            for y in range(k):
                if x != y:
                    np.add.at(out.reshape(-1), held[:, x] * n + held[:, y], np.float32(1))
    many = h > FEW
    row, number = row[many], np.cumsum(np.diff(at[many], prepend=-1) != 0) - 1
    ends = np.searchsorted(number, np.arange(0, (number[-1] if len(number) else -1) + WIDTH + 1, WIDTH))
    for first, last in zip(ends[:-1], ends[1:], strict=True):
        x = np.zeros((n, WIDTH), np.float32)
        x[row[first:last], number[first:last] % WIDTH] = 1
        for a, b in parts:
            out[np.ix_(a, b)] += x[a] @ x[b].T
    return out


def _forest(a: np.ndarray, b: np.ndarray, own: np.ndarray) -> list[int]:
    """Numbers of the links ``(a, b)`` that connect the components ``own`` as all links do: fewer than components."""
    own, kept, left = own.copy(), [], np.arange(len(a))
    top = list(range(own.max() + 1))

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    while len(left := left[own[a[left]] != own[b[left]]]):
        # a link of every component at once
        for k in np.unique(np.unique(np.concatenate([own[a[left]], own[b[left]]]), return_index=True)[1] % len(left)):
            x, y = find(own[a[left[k]]]), find(own[b[left[k]]])
            if x != y:
                top[x] = y
                kept.append(int(left[k]))
        own = np.array([find(x) for x in range(len(top))])[own]
    return kept


def _linked(threshold: float, counted: bool):
    """Verified links in a cell of two blocks, as many as connect what is linked there: a forest over components.

    All pairs across components are compared on their whole sets, in matrices: none
    of them is a row, however many come near.  Members of the cell's largest
    component are compared with the others only.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        number, (_, own) = pdf.vertex.to_numpy(), np.unique(pdf.component.to_numpy(), return_inverse=True)
        left, right, rest = pdf.left.to_numpy(), pdf.right.to_numpy(), own != np.bincount(own).argmax()
        sides = [(rest, right)] if left.all() and right.all() else [(left & rest, right), (left & ~rest, right & rest)]
        parts = [(x, y) for x, y in ((np.flatnonzero(x), np.flatnonzero(y)) for x, y in sides) if len(x) and len(y)]
        links = []
        if parts:
            sets = [np.frombuffer(x, np.uint64) for x in pdf["items"]]
            if counted:  # the i-th of a shingle's occurrences is a token of its own, which makes the weighted similarity that of sets
                counts = [np.frombuffer(x, np.int32) for x in pdf["counts"]]
                nth = [np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) for c in counts]
                sets = [mix64(np.repeat(x, c) + i.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for x, c, i in zip(sets, counts, nth, strict=True)]
            size = np.array([len(x) for x in sets], np.float64)
            common = _common(sets, parts)
            for x, y in parts:
                c = common[np.ix_(x, y)].astype(np.float64)
                i, j = np.nonzero((c / (size[x][:, None] + size[y] - c) >= threshold) & (own[x][:, None] != own[y]))
                links.append(np.stack([x[i], y[j]]))
        a, b = np.concatenate(links, axis=1) if links else np.zeros((2, 0), np.int64)
        kept = _forest(a, b, own)
        return pd.DataFrame({"a": number[a[kept]], "b": number[b[kept]]}, dtype=np.int64)

    return run


def _two(pairs: DataFrame, of: DataFrame, columns: list[str]) -> DataFrame:
    for side in ("b", "a"):
        pairs = pairs.join(of.select(F.col("vertex").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]), side)
    return pairs


def near_duplicates(docs: DataFrame, stages: Stages, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, shingle: int = 5, k: int = 216, bands: int = 36, counted: bool = False) -> DataFrame:
    """Classes of documents linked by a Jaccard similarity of ``threshold`` or more.

    Sets hold the runs of ``shingle`` words (split at ASCII white space, ASCII
    letters in lower case); a shorter text has one, of all its words.  With
    ``counted``, shingles weigh as often as they occur (weighted Jaccard), else 1.

    Returns for every row of ``docs``: ``uid``, the id, ``class_id`` (smallest id
    of its class), ``class_size`` (rows) and ``kept`` (one row of each class).

    1. Texts of equal sets are one vertex: copies are never paired.
    2. Vertices that agree in all rows of a band share a bucket.  With 36 bands of
       6 rows, a pair at 0.8 shares none with a chance of 2e-5.
    3. Each vertex is paired with the one of greatest mass that it meets in its
       buckets (a copy with its original), never with all.  Pairs whose signatures
       promise enough are verified on their whole shingle sets; links become
       components.
    4. Buckets that still hold several components: small ones are compared in full
       across components; members of large ones with pivots of other components,
       anew until a round brings no link, then block by block on their whole sets,
       where no pair becomes a row but the links that connect (see ``_linked``).

    Vertex names have 64 bits (a false merge has a chance of n^2 / 2^65).
    Null and empty texts (no words) are in no class but their own, null ids are
    kept as rows, repeated rows are in one class, an empty table gives no rows.
    """
    base = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    wide = base.mapInArrow(_with_id(_sketch(shingle, k, bands, counted)), _sketch_schema(base))
    rows = stages.write(wide, batch_rows=1000)
    sketches = stages.write(rows.filter("vertex is not null").select("vertex", "bands", "sig").dropDuplicates(["vertex"]))
    members = shared_buckets(sketches.select("vertex", F.explode("bands").alias("bucket")), stages)
    first_ids = stages.write(rows.filter("vertex is not null").groupBy("vertex").agg(F.min("id").alias("id")))
    least = threshold - 0.16

    def whole_sets(needed: DataFrame) -> DataFrame:
        ids = first_ids.join(needed, "vertex", "left_semi").select("id")
        n_blocks = bloom.n_blocks_for(needed.count())
        some = bloom.probe(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", bloom.build(ids, "id", n_blocks), n_blocks, "maybe").filter("maybe")
        return stages.write(some.select("text").mapInArrow(_set_bytes(shingle), "vertex long, items binary, counts binary").join(needed, "vertex", "left_semi").dropDuplicates(["vertex"]), batch_rows=1000)

    def links_of(pairs: DataFrame) -> DataFrame:
        likely = _two(pairs.distinct(), sketches, ["sig"]).mapInArrow(_promising(least), "a long, b long")
        likely = stages.write(likely, batch_rows=4000)
        needed = stages.write(likely.select(F.col("a").alias("vertex")).union(likely.select("b")).distinct())
        sets = whole_sets(needed)
        links = stages.write(_two(likely, sets, ["items", "counts"]).mapInArrow(_verified(threshold, counted), "a long, b long"), batch_rows=500)
        stages.drop(likely, needed, sets)
        return links

    def linked(large: DataFrame) -> DataFrame:
        needed = stages.write(large.select("vertex").distinct())
        sets = whole_sets(needed)
        sets = sets if counted else sets.drop("counts")
        sizes = sets.select("vertex", F.octet_length("items").alias("size"))
        cells = stages.write(cells_of(large.join(sizes, "vertex"), CELL, CELL_BYTES))
        links = stages.write(cells.join(sets, "vertex").groupBy("bucket", "i", "j").applyInPandas(_linked(threshold, counted), "a long, b long"))
        stages.drop(needed, cells)
        return links

    labels = components_of(members, links_of, None, None, threshold, stages, linked=linked)
    with_class = rows.drop("bands", "sig").join(labels.select(F.col("id").alias("vertex"), "component"), "vertex", "left")
    # a row without words has a class of its own: the name of its row, apart from all vertices (which are odd)
    with_class = stages.write(with_class.withColumn("component", F.coalesce("component", "vertex", F.col("uid") * 2)))
    best = stages.write(with_class.groupBy("component").agg(F.min(F.struct("id", "uid")).alias("best"), F.count("*").alias("class_size")))
    out = with_class.join(best, "component")
    return out.select("uid", F.col("id").alias(id_col), F.col("best.id").alias("class_id"), "class_size", (F.col("uid") == F.col("best.uid")).alias("kept"))


def _sketch_schema(base: DataFrame) -> str:
    return f"uid long, id {dict(base.dtypes)['id']}, vertex long, bands array<bigint>, sig binary"


def _with_id(sketch):
    """Every row of the input with the sketch of its text, or nulls where the text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = pa.array(np.arange(batch.num_rows))
            got = list(sketch(iter([pa.RecordBatch.from_arrays([at, batch.column(2)], ["uid", "text"])])))
            found = np.concatenate([g.column(0).to_numpy() for g in got]) if got else np.zeros(0, np.int64)
            for g in got:
                here = g.column(0)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(here), batch.column(1).take(here), *(g.column(c) for c in (1, 2, 3))], ["uid", "id", "vertex", "bands", "sig"])
            rest = np.setdiff1d(np.arange(batch.num_rows), found)
            if len(rest):
                n = len(rest)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rest)), batch.column(1).take(pa.array(rest)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.binary())], ["uid", "id", "vertex", "bands", "sig"])

    return run
