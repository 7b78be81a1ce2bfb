"""Mixing sources to target weights by capped water-filling (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .stages import Stages

#: A word is a run of characters other than these of ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
BUCKET_BITS = 12


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def water_fill(sources: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """Add ``target`` to ``sources(source, source_size, weight)``: one row per source.

    Sources take ``share`` of all sizes by weight; one that would pass
    ``max_epochs`` of itself is clamped there and its excess goes to the others
    by weight, until none is above.  Ordered by cap per weight, the clamped
    sources are a prefix, so the fixed point of that loop is found with running
    sums over the source table (a row per source) instead of rounds.
    """
    s = sources.withColumn("__cap", F.col("source_size") * F.lit(float(max_epochs)))
    everything = W.partitionBy()
    order = W.orderBy((F.col("__cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(0, W.unboundedFollowing)
    s = s.withColumns({
        "__need": F.sum("source_size").over(everything) * F.lit(float(share)),
        "__capped": F.coalesce(F.sum("__cap").over(before), F.lit(0.0)),
        "__left": F.sum("weight").over(after),
    })
    s = s.withColumn("__level", (F.col("__need") - F.col("__capped")) / F.col("__left"))
    s = s.withColumn("__full", F.col("__level") * F.col("weight") >= F.col("__cap"))
    # the first source that is not clamped has the level of all the others; theirs, computed as if it were clamped, are lower
    s = s.withColumn("__final", F.max(F.when(~F.col("__full"), F.col("__level"))).over(everything))
    target = F.when(F.col("__full"), F.col("__cap")).otherwise(F.least(F.col("__cap"), F.col("__final") * F.col("weight")))
    return s.withColumn("target", target).drop("__cap", "__need", "__capped", "__left", "__level", "__full", "__final")


def _keyed(docs: DataFrame, seed: int, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with the columns that the mix goes by: ``__row`` (a number), ``__id``, ``__source``, ``__hash``, ``__key`` and ``__bucket``."""
    d = docs.withColumns({"__row": F.monotonically_increasing_id(), "__id": F.col(id_col), "__source": F.col("source").cast("string"), "__hash": F.xxhash64(text_col)})
    d = d.withColumn("__key", F.xxhash64(F.lit(seed), "__id", "__hash"))
    return d.withColumn("__bucket", F.shiftrightunsigned("__key", 64 - BUCKET_BITS).cast("int"))


def plan_mix(docs: DataFrame, stages: Stages, weights: Sequence[float], share: float, max_epochs: float, seed: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The decisions: a row for each source; how many of a group of equal rows get a copy more, where a target is reached; and all rows' sizes."""
    d = _keyed(docs, seed, id_col, text_col)
    d = stages.write(d.select("__row", "__id", "__source", "__hash", "__key", "__bucket", word_count(F.col(text_col)).alias("size")))
    sums = d.groupBy("__source", "__bucket").agg(F.sum("size").alias("b_size"))
    src = d.groupBy(F.col("__source").alias("source")).agg(F.sum("size").cast("double").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    src = src.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int")))
    src = water_fill(src, share, max_epochs)
    src = src.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("long"))
    src = src.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))).withColumn("source_size", F.col("source_size").cast("long"))
    src = stages.write(src.withColumnRenamed("source", "p_source"))

    # the bucket in which the fractional part of the target is used up
    of_source = F.col("__source").eqNullSafe(F.col("p_source"))
    run = W.partitionBy("__source").orderBy("__bucket").rowsBetween(W.unboundedPreceding, 0)
    cut = sums.withColumn("cum", F.sum("b_size").over(run)).join(src.select("p_source", "rest"), of_source).filter("cum > rest")
    cut = cut.groupBy("__source").agg(F.min_by(F.struct("__bucket", (F.col("rest") - (F.col("cum") - F.col("b_size"))).alias("room")), "__bucket").alias("c"))
    plan = src.join(cut.select("__source", F.col("c.__bucket").alias("cut"), "c.room"), of_source, "left").drop("__source")
    plan = stages.write(plan.withColumns({"cut": F.coalesce("cut", F.lit(1 << BUCKET_BITS)), "room": F.coalesce("room", F.lit(0.0))}))

    m = d.join(plan.select("p_source", "cut", "room"), of_source).drop("p_source")
    group = ["__source", "__key", "__id", "__hash", "size"]
    inside = m.filter("__bucket = cut").groupBy(*group).agg(F.count("*").alias("n"), F.first("room").alias("room"))
    of_group = F.sum(F.col("n") * F.col("size")).over(W.partitionBy("__source").orderBy("__key", "__id", "__hash").rowsBetween(W.unboundedPreceding, -1))
    left = F.col("room") - F.coalesce(of_group, F.lit(0))
    fit = F.when(F.col("size") > 0, F.floor(left / F.greatest(F.lit(1), F.col("size")))).otherwise(F.when(left >= 0, F.col("n")).otherwise(0))
    inside = inside.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("n"), fit)).cast("long"))
    inside = stages.write(inside.withColumn("gap", F.col("room") - F.sum(F.col("extra") * F.col("size")).over(W.partitionBy("__source"))))
    # one more document closes the gap: the one whose size comes nearest, if it brings the mix nearer to its target
    gap = inside.groupBy(F.col("__source").alias("p_source")).agg(F.first("gap").alias("gap"))
    beyond = m.filter("__bucket > cut")
    free = inside.filter("extra < n").select(*group).union(beyond.select(*group))
    free = free.filter("size > 0").join(gap, of_source).filter(F.col("size") <= 2 * F.col("gap"))
    pick = free.groupBy("__source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "__key", "__id", "__hash")).alias("pick"))
    plan = stages.write(plan.join(pick.select("__source", F.col("pick.__key").alias("f_key"), F.col("pick.__id").alias("f_id"), F.col("pick.__hash").alias("f_hash")), of_source, "left").drop("__source"))
    picks = plan.select("p_source", "f_key", "f_id", "f_hash")
    alone = beyond.join(picks, of_source & _picked()).groupBy("__source", "__id", "__hash").agg(F.count("*").alias("n")).withColumn("take", F.lit(1).cast("long"))
    takes = inside.join(picks, of_source, "left").withColumn("take", F.col("extra") + F.coalesce(_picked(), F.lit(False)).cast("long")).filter("take > 0")
    takes = takes.select("__source", "__id", "__hash", "n", "take").union(alone)
    return plan, stages.write(takes.toDF("i_source", "i_id", "i_hash", "i_n", "take")), d


def _picked() -> Column:
    return (F.col("__key") == F.col("f_key")) & F.col("__id").eqNullSafe(F.col("f_id")) & (F.col("__hash") == F.col("f_hash"))


def assign(rows: DataFrame, plan: DataFrame, takes: DataFrame, stages: Stages) -> DataFrame:
    """Add ``repeats`` and the source's numbers to keyed rows; only rows of the buckets at the targets are joined by row.

    Of equal rows of which some get a copy more, those do that come first: they are
    numbered within the part of the table that each stands in, behind the counts of
    the parts before, so that no group is one task's.
    """
    r = rows.join(plan, F.col("__source").eqNullSafe(F.col("p_source"))).drop("p_source")
    near = F.coalesce((F.col("__bucket") == F.col("cut")) | ((F.col("__bucket") > F.col("cut")) & _picked()), F.lit(False))
    apart = r.filter(~near).withColumn("extra", (F.col("__bucket") < F.col("cut")).cast("int"))
    same = F.col("__id").eqNullSafe(F.col("i_id")) & (F.col("__hash") == F.col("i_hash")) & F.col("__source").eqNullSafe(F.col("i_source"))
    at = r.filter(near).join(takes, same, "left").withColumns({"take": F.coalesce("take", F.lit(0)), "i_n": F.coalesce("i_n", F.lit(1))})
    whole = at.filter("take = 0 or take >= i_n").withColumn("extra", (F.col("take") > 0).cast("int"))
    split = at.filter("take > 0 and take < i_n").withColumn("__part", F.shiftright("__row", 33))
    parts = split.groupBy("__source", "__id", "__hash", "__part").agg(F.count("*").alias("n"))
    earlier = W.partitionBy("__source", "__id", "__hash").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    parts = stages.write(parts.select(F.col("__source").alias("q_source"), F.col("__id").alias("q_id"), F.col("__hash").alias("q_hash"), F.col("__part").alias("q_part"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")))
    same = F.col("__id").eqNullSafe(F.col("q_id")) & (F.col("__hash") == F.col("q_hash")) & F.col("__source").eqNullSafe(F.col("q_source")) & (F.col("__part") == F.col("q_part"))
    nth = F.col("before") + F.row_number().over(W.partitionBy("__source", "__id", "__hash", "__part").orderBy("__row"))
    split = split.join(parts, same).withColumn("extra", (nth <= F.col("take")).cast("int"))
    out = apart.unionByName(whole.select(*apart.columns)).unionByName(split.select(*apart.columns))
    return out.withColumn("repeats", (F.col("whole") + F.col("extra")).cast("long"))


def mix(docs: DataFrame, stages: Stages, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How many words of every document the mix takes.

    Returns per row of ``docs``: the id, ``source``, ``size``, ``source_size``,
    ``target``, ``repeats`` (whole copies) and ``taken`` (their words).  Sources
    sorted by code point, null last, have ``weights`` in turn.

    A source's target divided by its size gives whole repetitions for each of its
    documents and a fractional one, which goes to documents in the order of a
    seeded hash until the rest of the target is used up; the one document that
    best fills what then is left gets a copy too.  So the words taken differ from
    the target by less than a document, and every rerun agrees (of equal rows, on
    how many get a copy more).

    No source's rows meet in one task: hash order is cut into 4,096 buckets per
    source whose sums are combined before the shuffle, and only the bucket in which
    the target is reached is sorted, with equal rows as one.

    Null texts count as empty and have size 0; null sources form a source; equal
    rows are documents of their own; an empty table gives no rows.
    """
    plan, takes, sized = plan_mix(docs, stages, weights, share, max_epochs, seed, id_col, text_col)
    out = assign(sized, plan, takes, stages)
    return out.select(F.col("__id").alias(id_col), F.col("__source").alias("source"), "size", "source_size", "target", "repeats", (F.col("repeats") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, stages: Stages, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as ``mix`` says; texts are not shuffled."""
    plan, takes, _ = plan_mix(docs, stages, weights, share, max_epochs, seed, id_col, text_col)
    # columns of any name travel in a struct, apart from those of the plan
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), F.col(id_col), F.col("source"), F.col(text_col))
    out = assign(_keyed(whole, seed, id_col, text_col).drop(id_col, "source", text_col), plan, takes, stages).filter("repeats > 0")
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats")))).select("__doc.*")
