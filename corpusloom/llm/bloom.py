"""Blocked Bloom filter out of DataFrame functions.

A block has 8 words of 32 bits and every key sets one bit in each word of one
block, so a look-up reads one row.  The number of blocks has a fixed bound,
which bounds the size of the filter's table: too many keys make more false
positives, never false negatives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 8
#: 65,536 blocks of 72 bytes are 4.7 MB: small enough to broadcast, whatever the number of keys.
MAX_BLOCKS = 1 << 16


def _word_bit(key: Column, k: int) -> Column:
    """The bit that a key sets in word k: five bits of a hash that is independent of the block's."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftrightunsigned(F.xxhash64(key, F.lit(0x5BD1E995)), 5 * k), F.lit(32)).cast("int"))


def n_blocks_for(n_keys: int, bits_per_key: int = 16, max_blocks: int = MAX_BLOCKS) -> int:
    return max(1, min(max_blocks, -(-n_keys * bits_per_key // (32 * WORDS))))


def build(keys: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """``(__block, __w0..__w7)`` of the blocks that have bits set."""
    block = F.pmod(F.xxhash64(key), F.lit(n_blocks)).alias("__block")
    bits = keys.select(block, *[_word_bit(F.col(key), k).alias(f"__w{k}") for k in range(WORDS)])
    return bits.groupBy("__block").agg(*[F.bit_or(f"__w{k}").alias(f"__w{k}") for k in range(WORDS)])


def probe(df: DataFrame, key: str, blocks: DataFrame, n_blocks: int, name: str) -> DataFrame:
    """Add the boolean ``name``: false only for rows whose key is in no case among the filter's keys."""
    d = df.withColumn("__block", F.pmod(F.xxhash64(key), F.lit(n_blocks))).join(F.broadcast(blocks), "__block", "left")
    hit = F.lit(True)
    for k in range(WORDS):
        hit = hit & (F.col(f"__w{k}").bitwiseAND(_word_bit(F.col(key), k)) != 0)
    return d.withColumn(name, F.coalesce(hit, F.lit(False))).drop("__block", *[f"__w{k}" for k in range(WORDS)])


def keep(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be among ``keys``, a table that has been written."""
    n_blocks = n_blocks_for(keys.count())
    return probe(df, key, build(keys, key, n_blocks), n_blocks, "__maybe").filter("__maybe").drop("__maybe")
