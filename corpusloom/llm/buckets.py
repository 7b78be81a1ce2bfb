"""From shared buckets to components, without all pairs of a group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .components import connected_components
from .stages import Stages

#: Buckets of up to so many vertices are compared in full at once, larger ones first with pivots.
SMALL_BUCKET = 16
PIVOTS = 2
ROUNDS = 4
#: Members of a block, of which two at a time are compared in full.
BLOCK = 256
#: Tokens that more sets than these hold are frequent.
RARE = 32
#: Numbers of tokens that are broadcast, 16 bytes each; more are joined by a shuffle.
BROADCAST = 500_000


def shared_buckets(keyed: DataFrame, stages: Stages) -> DataFrame:
    """``(bucket, vertex, n, mass)`` of the buckets that hold more than one vertex.

    ``mass`` is the number of others that a vertex meets in all its buckets: the
    text that others are copies of has more than its copies.  A bounded Bloom filter
    of the shared buckets keeps most others out of the second shuffle.  Their table
    is written before the join, so that AQE can split a hot bucket's members.
    """
    shared = stages.write(keyed.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"))
    return with_mass(stages.write(bloom.keep(keyed, shared, "bucket").join(shared, "bucket")), stages)


def with_mass(members: DataFrame, stages: Stages) -> DataFrame:
    """``(bucket, vertex, n)`` with the number of others that a vertex meets in these buckets."""
    mass = stages.write(members.groupBy("vertex").agg(F.sum(F.col("n") - 1).alias("mass")))
    return stages.write(members.join(mass, "vertex"))


def cells_of(mixed: DataFrame, block: int | None = None, block_bytes: int = 0) -> DataFrame:
    """``(bucket, i, j, left, right, vertex, component)``: blocks of a bucket's members, any two in one cell.

    In the cell (i, i) members stand on both sides.  With ``block_bytes``, members
    have a ``size``, and blocks hold about so many bytes at most.
    """
    blocks = F.ceil(F.count("*") / (block or BLOCK))
    if block_bytes:
        blocks = F.greatest(blocks, F.ceil(F.sum("size") / block_bytes))
    size = mixed.groupBy("bucket").agg(blocks.alias("blocks"))
    m = mixed.join(size, "bucket").withColumn("own", F.pmod(F.xxhash64("vertex", "bucket"), F.col("blocks")))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return m.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("left"), (F.col("own") >= F.col("other")).alias("right"), "vertex", "component")


def links_apart(m: DataFrame, sets_of: Callable[[DataFrame], DataFrame], links_of: Callable[[DataFrame], DataFrame], alike: Callable[[DataFrame], DataFrame], threshold: float, stages: Stages) -> DataFrame:
    """Verified links that connect all similar vertices of large buckets ``(bucket, vertex, component)``, across components.

    ``sets_of`` gives ``(vertex, tokens)``, whose Jaccard similarity decides.  Of two
    sets that are similar, either

    * a token in common is rare (in at most ``RARE`` sets).  Then the rarest tokens
      of both, as many as a similar set may lack and one more, share a rare one: a
      join on these, within the bounds on sizes, finds the pair;
    * or all that they share is frequent.  Then whatever has the same frequent tokens
      and as many of all is as similar: sets are put into classes by these two, one of
      a class stands for it, and members are linked to it, or, if the class's
      frequent tokens do not make its own members similar, to the one that stands for
      a class that it is similar to.

    So lines of a template meet those that share a part which is not the template's,
    and templates meet as classes, not as pairs of all their lines.
    """
    u = stages.write(m.select("vertex", "component").distinct())
    sets = stages.write(sets_of(u))
    freq = stages.write(sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).filter("n > 1"))
    few = freq.count() <= BROADCAST
    # dealt by vertex once: what follows explodes and gathers a set's tokens where it stands, unless their numbers are too many to broadcast
    own = sets.join(u, "vertex").withColumn("size", F.size("tokens")).repartition("vertex").select("vertex", "component", "size", F.explode("tokens").alias("token"))
    own = own.join(F.broadcast(freq) if few else freq, "token", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    ranked = own.groupBy("vertex").agg(F.first("component").alias("component"), F.first("size").alias("size"), F.count_if(F.col("n") == 1).alias("alone"), F.array_sort(F.collect_list(F.when(F.col("n") > 1, F.struct("n", "token")))).alias("t"))  # a set's own tokens
    least = F.ceil(F.lit(threshold) * F.col("size") - 1e-9)
    room = (F.col("size") - least + 1 - F.col("alone")).cast("int")  # tokens that no other set has come first in the order
    rare = F.transform(F.filter(F.slice("t", F.lit(1), F.greatest(room, F.lit(0))), lambda x: x["n"] <= RARE), lambda x: x["token"])
    seen = stages.write(ranked.select("vertex", "component", "size", rare.alias("rare"), F.array_sort(F.transform(F.filter("t", lambda x: x["n"] > RARE), lambda x: x["token"])).alias("often")))
    stages.drop(sets, freq, u)
    fits = F.col("size_a") >= F.lit(threshold) * F.col("size_b") - 1e-9
    occ = seen.select("vertex", "component", "size", F.explode("rare").alias("token"))
    a, b = (occ.select("token", F.col("vertex").alias(v), F.col("component").alias(f"c_{v}"), F.col("size").alias(f"size_{v}")) for v in "ab")
    rare = a.join(b, "token").filter("a > b and c_a <> c_b").filter(fits & (F.col("size_b") >= F.lit(threshold) * F.col("size_a") - 1e-9)).select("a", "b").distinct()  # at most RARE a token

    name = F.md5(F.array_join(F.transform("often", lambda x: x.cast("string")), ","))
    some = seen.filter(F.size("often") >= least).withColumn("name", name)
    classes = some.groupBy("name", "size").agg(F.min("vertex").alias("rep"), F.any_value("often").alias("often"))
    classes = stages.write(classes)
    reps = classes.select(F.col("rep").alias("vertex"))
    met = alike(cells_of(stages.write(m.join(reps, "vertex", "left_semi"))))
    met = stages.write(links_of(stages.write(met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())))

    def similar(common: Column, size_a: Column, size_b: Column) -> Column:
        return common >= F.lit(threshold) * (size_a + size_b - common) - 1e-9

    both = met.union(met.select("b", "a"))
    x, y = (classes.select(F.col("rep").alias(v), F.col("often").alias(f"o_{v}"), F.col("size").alias(f"s_{v}")) for v in "ab")
    near = both.join(x, "a").join(y, "b").filter(similar(F.size(F.array_intersect("o_a", "o_b")), F.col("s_a"), F.col("s_b")))
    near = near.groupBy("a").agg(F.min("b").alias("b"))
    own = similar(F.size("often"), F.col("size"), F.col("size"))
    to = classes.join(near, F.col("rep") == F.col("a"), "left").select("name", "size", "rep", F.when(own, F.col("rep")).otherwise(F.col("b")).alias("to")).filter("to is not null")
    held = some.join(stages.write(to), ["name", "size"]).filter("vertex <> to").select(F.greatest("vertex", "to").alias("a"), F.least("vertex", "to").alias("b"))
    out = stages.write(met.union(links_of(stages.write(rare.union(held).distinct()))))
    stages.drop(seen, classes)
    return out


def components_of(members: DataFrame, links_of: Callable[[DataFrame], DataFrame], alike: Callable[[DataFrame], DataFrame] | None, sets_of: Callable[[DataFrame], DataFrame] | None, threshold: float, stages: Stages, full: int = 0, linked: Callable[[DataFrame], DataFrame] | None = None, links: DataFrame | None = None) -> DataFrame:
    """Components ``(id, component)`` of the verified links within buckets.

    ``links_of`` verifies a table of pairs ``(a, b)``.  First each vertex is paired
    with the one of greatest mass that it meets, once: a copy with its original.
    Buckets that then still hold several components get a second look: members are
    paired with the bucket's vertex of greatest mass, small buckets are compared in
    full, and members of large ones with pseudo-random pivots, always across
    components only; for large buckets anew until a round brings no link (at most
    ``ROUNDS`` times).  What is still apart then is linked by ``linked``, which gets
    ``(bucket, vertex, n, component)``, or by ``links_apart``.  Buckets of up to
    ``full`` are compared in full after the first round.  ``links`` are known before.
    """
    heavy = F.struct("mass", "vertex")
    hubs = stages.write(members.groupBy("bucket").agg(F.max(heavy).alias("hub")))
    best = members.select("bucket", "vertex").join(hubs, "bucket").groupBy("vertex").agg(F.max("hub").alias("hub"))
    found = links_of(best.select(F.col("vertex").alias("a"), F.col("hub.vertex").alias("b")).filter("a <> b"))
    links = stages.write(links.union(found)) if links else found
    labels = stages.write(connected_components(links, stages))
    for turn in range(ROUNDS):
        m = members.join(labels.withColumnRenamed("id", "vertex"), "vertex", "left").withColumn("component", F.coalesce("component", "vertex"))
        if turn:
            m = m.filter(F.col("n") > max(full, SMALL_BUCKET))
        pivot = F.struct("vertex", "component")
        seeds = [(F.min_by(pivot, F.xxhash64("vertex", F.lit(turn * PIVOTS + i))) if turn or i else F.max_by(pivot, heavy)).alias(f"p{i}") for i in range(PIVOTS)]
        mixed = m.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), *seeds).filter("lo <> hi")
        mixed = stages.write(mixed.select("bucket", F.array_distinct(F.array(*[f"p{i}" for i in range(PIVOTS)])).alias("pivots")))
        m = stages.write(m.join(mixed, "bucket"))
        pairs = m.filter(F.col("n") > SMALL_BUCKET).select(F.col("vertex").alias("a"), "component", F.explode("pivots").alias("p")).filter("component <> p.component").select("a", F.col("p.vertex").alias("b"))
        if not turn:
            small = m.filter(F.col("n") <= SMALL_BUCKET).select("bucket", "vertex", "component")
            other = small.select("bucket", F.col("vertex").alias("b"), F.col("component").alias("c"))
            pairs = small.join(other, "bucket").filter("vertex < b and component <> c").select(F.col("vertex").alias("a"), "b").union(pairs)  # at most 16 a bucket
        pairs = stages.write(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        if not pairs.limit(1).count():
            break
        more = links_of(pairs)
        new = more.join(labels.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left").join(labels.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left")
        new = new.select(F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")).filter("ca <> cb").limit(1).count()
        stages.drop(m, pairs)
        if not new:
            break
        links = stages.write(links.union(more))
        labels = stages.write(connected_components(links, stages))
    m = members.filter(F.col("n") > SMALL_BUCKET).join(labels.withColumnRenamed("id", "vertex"), "vertex", "left").select("bucket", "vertex", "n", F.coalesce("component", "vertex").alias("component"))
    mixed = m.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("bucket")
    m = stages.write(m.join(mixed, "bucket"))
    if not m.limit(1).count():
        return labels
    if linked:
        links = links.union(linked(m))
        stages.drop(m)
        return stages.write(connected_components(links, stages))
    large = m
    if full:
        large = stages.write(m.filter(F.col("n") > full))
        pairs = stages.write(alike(cells_of(m.filter(F.col("n") <= full))).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        links = links.union(links_of(pairs))
        stages.drop(m, pairs)
    if large.limit(1).count():
        links = links.union(links_apart(large, sets_of, links_of, alike, threshold, stages))
    stages.drop(large)
    return stages.write(connected_components(links, stages))
