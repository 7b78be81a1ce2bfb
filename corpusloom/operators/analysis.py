"""Small numeric tables: cost of a vocabulary, learning rates, layer placement, resume arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def block_parameters(dim: Column) -> Column:
    """4 d^2 (attention) + 3 d int(8 d / 3) (gated unit) + 4 d (norms)."""
    return 4 * dim * dim + 3 * dim * F.floor(8 * dim / 3) + 4 * dim


def vocab_cost(vocabs: DataFrame, dim: int, layers: int, chars: int, words: int, ctx: int = 512) -> DataFrame:
    """Cost of each vocabulary of ``(ord, vocab, actual, tokens)``: parameters, shares, tokens per character and word.

    ``extra_tokens_pct`` compares with the vocabulary listed last.
    """
    d = F.lit(dim)
    v = vocabs.withColumns({"embed_params": F.col("actual") * d, "body_params": F.lit(layers) * block_parameters(d) + 2 * d})
    v = v.withColumns({
        "total_params": F.col("embed_params") + F.col("body_params"),
        "full": F.col("actual") >= 0.99 * F.col("vocab"),
        "tok_per_char": F.col("tokens") / F.lit(max(1, chars)),
        "tok_per_word": F.col("tokens") / F.lit(max(1, words)),
    })
    last = F.last("tokens").over(W.partitionBy().orderBy("ord").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))  # a row for each vocabulary
    head = 2 * F.col("embed_params")  # operations a token in the output layer; the body's follow below
    return v.select(
        "ord", "vocab", "actual", "full", "embed_params", "body_params", "total_params",
        F.round(F.col("embed_params") / F.col("total_params") * 100, 6).alias("embed_pct"),
        F.round(head / (head + 2 * F.col("body_params") + F.lit(4 * layers * ctx * dim)) * 100, 6).alias("head_flop_pct"),
        F.round("tok_per_char", 6).alias("tok_per_char"), F.round("tok_per_word", 6).alias("tok_per_word"),
        F.floor(F.try_divide(F.lit(512.0), F.col("tok_per_char"))).cast("long").alias("context_chars"),
        F.round((F.try_divide(F.col("tokens"), last) - 1) * 100, 6).alias("extra_tokens_pct"),
    )


def lr_schedule(spark: SparkSession, total: int, warmup: float, floor: float) -> DataFrame:
    """Multiplier of the learning rate for each step: linear warm-up, then a cosine down to ``floor``."""
    w = max(1, int(warmup * total))
    s = F.col("step")
    progress = F.least(F.lit(1.0), (s - w) / F.lit(max(1, total - w)))
    m = F.when(s < w, (s + 1) / F.lit(w)).otherwise(floor + (1 - floor) * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * progress)))
    return spark.range(total).select(F.col("id").alias("step"), F.round(m, 6).alias("mult"))


def layer_placements(models: DataFrame) -> DataFrame:
    """For models ``(model, old, new)``: where each old layer goes among the new ones, and the places that stay new, ``(model, layer, source)`` with source -1.

    Layers are spread evenly and pushed right where two would meet: i plus the
    running maximum of round(i) - i.  A model without old layers has new ones only;
    one with fewer new than old layers is an error.
    """
    fits = F.assert_true(F.col("old") <= F.col("new"), F.lit("fewer new layers than old ones"))
    m = models.select("model", F.col("old").cast("long").alias("old"), F.col("new").cast("long").alias("new")).filter(fits.isNull())
    i = m.filter("old > 0").select("model", "old", "new", F.explode(F.sequence(F.lit(0).cast("long"), F.col("old") - 1)).alias("source"))
    want = F.bround(F.col("source") * (F.col("new") - 1) / F.greatest(F.lit(1), F.col("old") - 1)).cast("long")
    push = F.max(want - F.col("source")).over(W.partitionBy("model").orderBy("source").rowsBetween(W.unboundedPreceding, 0))  # a row for each layer of a model
    placed = i.select("model", (F.col("source") + push).alias("layer"), "source")
    every = m.filter("new > 0").select("model", F.explode(F.sequence(F.lit(0).cast("long"), F.col("new") - 1)).alias("layer"))
    return every.join(placed, ["model", "layer"], "left").select("model", "layer", F.coalesce("source", F.lit(-1)).cast("long").alias("source"))


def layer_placement(spark: SparkSession, old: int, new: int) -> DataFrame:
    """``(layer, source)`` of one model."""
    return layer_placements(spark.createDataFrame([(0, old, new)], "model int, old long, new long")).drop("model")


def steps(batches: int, accumulate: int, epochs: int) -> tuple[int, int]:
    """Optimizer steps in an epoch, and in all."""
    per = max(1, -(-batches // accumulate))
    return per, per * epochs


def resume_position(done_steps: int, per_epoch: int, accumulate: int, batch: int) -> tuple[int, int, int]:
    """Epochs done, steps of the next one done, and the samples to skip in it."""
    epoch, rest = divmod(done_steps, per_epoch)
    return epoch, rest, rest * accumulate * batch


def rope_table(spark: SparkSession, length: int, dim: int, base: float = 10000.0, legacy: bool = False) -> DataFrame:
    """Rotary angles ``(pos, i, cos, sin)`` with frequencies base^(-2i/d), or base^(-i/d) in the legacy form."""
    t = spark.range(length * (dim // 2)).select(F.floor(F.col("id") / (dim // 2)).alias("pos"), (F.col("id") % (dim // 2)).alias("i"))
    angle = F.col("pos") * F.pow(F.lit(float(base)), -(F.col("i") * (1.0 if legacy else 2.0)) / dim)
    return t.select("pos", "i", F.round(F.cos(angle), 6).alias("cos"), F.round(F.sin(angle), 6).alias("sin"))


def running_best(evals: DataFrame, order: str = "step", loss: str = "loss") -> DataFrame:
    """Add ``best`` so far and ``improved``; evaluations are a short table, one row each."""
    before = F.min(loss).over(W.partitionBy().orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    return evals.withColumns({"improved": F.coalesce(F.col(loss) < before, F.lit(True)), "best": F.least(loss, before)})


def sources_table(spark: SparkSession, plans: Sequence[dict]) -> DataFrame:
    return spark.createDataFrame([(p["source_id"], p["label"], p["weight"], p["quota"], p["target"], p["workers"], p["worker_limit"]) for p in plans], "source_id int, label string, weight double, quota int, target long, workers int, worker_limit long")


def shards_table(spark: SparkSession, plans: Sequence[dict]) -> DataFrame:
    return spark.createDataFrame([(p["source_id"], j, s) for p in plans for j, shards in enumerate(p["shards"]) for s in shards], "source_id int, worker int, shard int")
