"""Exact dedup by an exchange of Golomb-coded fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .stages import Stages

SPACE = "[\\x20\\x09-\\x0D]"
#: Fingerprints that an owner decodes at once, on average.
PER_OWNER = 400_000
FP_BITS = 48


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def rice_encode(values: np.ndarray, span: int) -> tuple[int, bytes, bytes]:
    """Sorted distinct integers as Golomb codes with a power of two for divisor: (bits, quotients in unary, remainders)."""
    gaps = np.diff(values.astype(np.int64), prepend=np.int64(-1)) - 1
    bits = max(0, int(np.floor(np.log2(max(1.0, span / max(1, len(values)) * 0.69)))))
    q = gaps >> bits
    ends = np.cumsum(q + 1)
    unary = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    unary[ends - 1] = 1
    rest = ((gaps[:, None] >> np.arange(bits - 1, -1, -1)) & 1).astype(np.uint8) if bits else np.zeros((len(gaps), 0), np.uint8)
    return bits, np.packbits(unary).tobytes(), np.packbits(rest.ravel()).tobytes()


def rice_decode(n: int, bits: int, unary: bytes, rest: bytes) -> np.ndarray:
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    q = np.diff(ends, prepend=-1) - 1
    r = np.zeros(n, np.int64)
    if bits:
        b = np.unpackbits(np.frombuffer(rest, np.uint8), count=n * bits).reshape(n, bits)
        for k in range(bits):
            r = (r << 1) | b[:, k]
    return np.cumsum(((q.astype(np.int64) << bits) | r) + 1) - 1


def _send(n_owners: int, fp_bits: int):
    span = -(-(1 << fp_bits) // n_owners)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sender = TaskContext.get().partitionId()
        got = [np.array(b.column(0).to_numpy(zero_copy_only=False), np.int64) for b in batches]
        fps, counts = np.unique(np.concatenate(got) if got else np.zeros(0, np.int64), return_counts=True)
        owner = fps // span
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        rows = {k: [] for k in ("owner", "sender", "n", "bits", "unary", "rest", "again")}
        for i, at in enumerate(starts):
            end = starts[i + 1] if i + 1 < len(starts) else len(fps)
            bits, unary, rest = rice_encode(fps[at:end] - owner[at] * span, span)
            for k, v in zip(rows, (int(owner[at]), sender, int(end - at), bits, unary, rest, np.packbits(counts[at:end] > 1).tobytes()), strict=True):
                rows[k].append(v)
        yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("owner", pa.int32()), ("sender", pa.int32()), ("n", pa.int32()), ("bits", pa.int32()), ("unary", pa.binary()), ("rest", pa.binary()), ("again", pa.binary())]))

    return run


def _own(pdf: pd.DataFrame) -> pd.DataFrame:
    """All lists of one owner: a bitmap for each sender, set where the fingerprint came twice or more."""
    lists = [rice_decode(int(r.n), int(r.bits), r.unary, r.rest) for r in pdf.itertuples()]
    again = np.concatenate([np.unpackbits(np.frombuffer(a, np.uint8), count=int(n)) for a, n in zip(pdf.again, pdf.n, strict=True)]).astype(np.int64)
    _, inverse, times = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    more = np.bincount(inverse, weights=again, minlength=len(times))
    twice = ((times > 1) | (more > 0))[inverse]
    cuts = np.cumsum([len(x) for x in lists])[:-1]
    return pd.DataFrame({"owner": pdf.owner.to_numpy(), "sender": pdf.sender.to_numpy(), "bitmap": [np.packbits(x).tobytes() for x in np.split(twice, cuts)]})


def _suspects(n_owners: int, fp_bits: int):
    """A sender reads the bitmaps of its blocks: the fingerprints that are set."""
    span = -(-(1 << fp_bits) // n_owners)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                fps = rice_decode(r["n"], r["bits"], r["unary"], r["rest"]) + r["owner"] * span
                marked = fps[np.unpackbits(np.frombuffer(r["bitmap"], np.uint8), count=r["n"]).astype(bool)]
                yield pa.RecordBatch.from_pydict({"fp": pa.array(marked, pa.int64())})

    return run


def duplicate_fingerprints(rows: DataFrame, stages: Stages, fp_bits: int = FP_BITS, per_owner: int = PER_OWNER) -> DataFrame:
    """Fingerprints ``fp`` (nonnegative, below 2**fp_bits) that occur in more than one row, once or more each.

    Every partition sorts its fingerprints, drops its own repeats (so that a hot
    one goes out once a partition) and sends each owner of a range a Golomb-coded
    block.  An owner decodes about ``per_owner`` numbers, whatever the table's
    size, and answers every block with a bitmap; the blocks' senders read off the
    suspects.
    """
    n_owners = max(1, min(1 << 20, -(-rows.count() // per_owner)))
    blocks = stages.write(rows.select("fp").mapInArrow(_send(n_owners, fp_bits), "owner int, sender int, n int, bits int, unary binary, rest binary, again binary"))
    maps = blocks.groupBy("owner").applyInPandas(_own, "owner int, sender int, bitmap binary")
    return blocks.drop("again").join(maps, ["owner", "sender"]).mapInArrow(_suspects(n_owners, fp_bits), "fp long")


def exact_dedup(docs: DataFrame, stages: Stages, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of equal texts, where white space ([\\x20\\x09-\\x0D]) does not count.

    Returns a row for each row of ``docs``: ``uid`` (of the row, from 0), the id,
    ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.  Of a group the row
    with the most code points stays, then the one with the smallest id, then any
    one of fully equal rows.

    Only fingerprints take part in the exchange.  Rows whose fingerprints came
    twice are suspects; only they (and what a bounded Bloom filter of their
    fingerprints lets through) are shuffled with their texts, which are grouped
    by their whole bytes to verify what the digests say.

    Null texts count as empty, empty texts equal each other; null ids are allowed
    and sort first; an empty table gives no rows; a text of any length is one
    value and is never cut.
    """
    d = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    d = d.select("uid", "id", F.length(F.coalesce("text", F.lit(""))).alias("len"), F.sha2(normalised(F.col("text")), 256).alias("sha"))
    t = stages.write(d)
    fp = F.conv(F.substring("sha", 1, FP_BITS // 4), 16, 10).cast("long")
    marked = stages.write(duplicate_fingerprints(t.select(fp.alias("fp")), stages).distinct())
    judged = t.withColumn("fp", fp).join(marked.withColumn("marked", F.lit(True)), "fp", "left").drop("fp")
    judged = stages.write(judged)
    suspects = judged.filter("marked")
    # the suspects' texts, by whole bytes: a digest stands for a text only if all its rows have the same bytes
    n_blocks = bloom.n_blocks_for(marked.count())
    texts = docs.select(normalised(F.col(text_col)).alias("norm")).withColumn("sha", F.sha2("norm", 256)).withColumn("fp", fp)
    texts = bloom.probe(texts, "fp", bloom.build(marked, "fp", n_blocks), n_blocks, "maybe").filter("maybe")
    bad = texts.groupBy("sha", "norm").agg(F.count("*").alias("rows")).groupBy("sha").agg(F.count("*").alias("texts")).filter("texts > 1").limit(1).collect()
    if bad:
        raise RuntimeError(f"texts of different bytes share the SHA-256 digest {bad[0]['sha']}")
    best = suspects.groupBy("sha").agg(F.min(F.struct(-F.col("len"), F.col("id"), F.col("uid"))).alias("best"), F.count("*").alias("n"))
    best = stages.write(best.select("sha", F.col("best.id").alias("keep_id"), F.col("best.uid").alias("keep_uid"), "n"))  # so that the join below can split a hot group
    groups = suspects.select("uid", "id", "sha").join(best, "sha")
    alone = judged.filter("marked is null").select("uid", "id", "sha", F.col("id").alias("keep_id"), F.col("uid").alias("keep_uid"), F.lit(1).cast("long").alias("n"))
    out = alone.unionByName(groups)
    return out.select("uid", F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"), (F.col("uid") == F.col("keep_uid")).alias("kept"), F.col("sha").alias("text_sha256"))
