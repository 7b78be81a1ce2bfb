"""Next-token distributions over long-form logits ``(step_id, token_id, logit)``.

Windows run within a step: a row for each token of the vocabulary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

def _step():
    return W.partitionBy("step_id")


def repetition_penalty(logits: DataFrame, history: DataFrame, penalty: float) -> DataFrame:
    """Tokens of ``history(step_id, token_id)``, however often they occur, are made less likely: l / r above zero, else l r."""
    if penalty == 1.0:
        return logits
    seen = history.select("step_id", "token_id").distinct().withColumn("seen", F.lit(True))
    d = logits.join(seen, ["step_id", "token_id"], "left")
    changed = F.when(F.col("logit") > 0, F.col("logit") / penalty).otherwise(F.col("logit") * penalty)
    return d.withColumn("logit", F.when(F.col("seen"), changed).otherwise(F.col("logit"))).drop("seen")


def temperature(logits: DataFrame, t: float) -> DataFrame:
    return logits.withColumn("logit", F.col("logit") / max(t, 1e-6))


def top_k(logits: DataFrame, k: int) -> DataFrame:
    """The k greatest logits and all that equal the least of them."""
    return logits.withColumn("__r", F.rank().over(_step().orderBy(F.desc("logit")))).filter(F.col("__r") <= k).drop("__r")


def softmax(logits: DataFrame) -> DataFrame:
    """Add ``p``."""
    d = logits.withColumn("__e", F.exp(F.col("logit") - F.max("logit").over(_step())))
    return d.withColumn("p", F.col("__e") / F.sum("__e").over(_step())).drop("__e")


def top_p(probs: DataFrame, limit: float) -> DataFrame:
    """Tokens by falling probability while those before them hold no more than ``limit``; probabilities sum to 1 again."""
    before = F.coalesce(F.sum("p").over(_step().orderBy(F.desc("p"), "token_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    d = probs.withColumn("__b", before).filter(F.col("__b") <= limit).drop("__b")
    return d.withColumn("p", F.col("p") / F.sum("p").over(_step()))


def next_token(logits: DataFrame, history: DataFrame, penalty: float = 1.3, t: float = 0.8, k: int | None = 50, limit: float | None = 0.9) -> DataFrame:
    """The distribution that a token is drawn from: penalty, temperature, top k, softmax, top p."""
    d = temperature(repetition_penalty(logits, history, penalty), t)
    if k is not None:
        d = top_k(d, k)
    d = softmax(d)
    return d if limit is None else top_p(d, limit)


def draw(probs: DataFrame, seed: int) -> DataFrame:
    """A token for each step, by inverting the cumulative probability at a seeded number in [0, 1)."""
    u = F.pmod(F.xxhash64(F.lit(seed), "step_id"), F.lit(1 << 40)) / float(1 << 40)
    upto = F.sum("p").over(_step().orderBy(F.desc("p"), "token_id").rowsBetween(W.unboundedPreceding, 0))
    d = probs.withColumns({"__c": upto, "__u": u}).filter((F.col("__c") > F.col("__u")))
    return d.groupBy("step_id").agg(F.min_by("token_id", "__c").alias("token_id"))


def step_losses(logits: DataFrame, targets: DataFrame, pad_id: int = 1) -> DataFrame:
    """``(step_id, loss)``: -log softmax at ``targets(step_id, target)``; targets that are padding have no row."""
    top = logits.groupBy("step_id").agg(F.max("logit").alias("m"))
    d = logits.join(top, "step_id").join(targets.filter(F.col("target") != pad_id), "step_id")
    return d.groupBy("step_id").agg((F.log(F.sum(F.exp(F.col("logit") - F.col("m")))) + F.first("m") - F.max(F.when(F.col("token_id") == F.col("target"), F.col("logit")))).alias("loss"))


def cross_entropy(logits: DataFrame, targets: DataFrame, pad_id: int = 1) -> DataFrame:
    """Mean of the losses of all steps."""
    return step_losses(logits, targets, pad_id).agg(F.count("*").alias("n"), F.round(F.avg("loss"), 6).alias("loss"))


def evaluation_loss(losses: DataFrame, batch_size: int, max_batches: int = 0) -> DataFrame:
    """``(batches, loss)``: the mean of the batches' mean losses; 0 without a batch.

    ``losses(step_id, loss)`` are dealt to batches by their step; with ``max_batches``
    only the batches of the lowest numbers that have a loss count.
    """
    batches = losses.groupBy(F.floor(F.col("step_id") / batch_size).alias("batch")).agg(F.avg("loss").alias("loss"))
    if max_batches:
        batches = batches.orderBy("batch").limit(max_batches)
    return batches.agg(F.count("*").alias("batches"), F.round(F.coalesce(F.sum("loss"), F.lit(0.0)) / F.greatest(F.lit(1), F.count("*")), 6).alias("loss"))


def checked_ids(tokens: DataFrame, vocab: int, column: str = "token_id") -> DataFrame:
    """The rows themselves; an id outside the vocabulary is an error when the plan runs."""
    bad = F.assert_true((F.col(column) >= 0) & (F.col(column) < vocab), F.lit("token id outside the vocabulary"))
    return tokens.filter(bad.isNull())
