"""Blocked Bloom filter as a table: one row of eight 64-bit words per block.

A key picks one block and sets one bit in each of the block's words, so a probe
touches a single row. The number of blocks is bounded by ``max_blocks``
(64 bytes of bits each), which bounds what is broadcast; with more keys than
that serves well the filter passes more false hits, and the exact join behind
it does more work, but no key is ever missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 16
MAX_BLOCKS = 1 << 17  # 8 MiB of bits
WORDS = 8


def block_count(keys: int, bits_per_key: int = BITS_PER_KEY, max_blocks: int = MAX_BLOCKS) -> int:
    return max(1, min(max_blocks, -(-keys * bits_per_key // (64 * WORDS))))


def _block(h: Column, blocks: int) -> Column:
    return F.pmod(h, F.lit(blocks))


def _masks(h: Column) -> list[Column]:
    """One bit in each word, from six bits each of a second hash."""
    second = F.xxhash64(h, F.lit(7))
    return [
        F.call_function("shiftleft", F.lit(1).cast("bigint"),
                        F.shiftrightunsigned(second, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
        for i in range(WORDS)
    ]


def build(members: DataFrame, key: Column, blocks: int) -> DataFrame:
    """``(block, w0 .. w7)``: at most ``blocks`` rows, from a partially aggregated bit-or."""
    hashed = members.select(F.xxhash64(key).alias("h"))
    masks = _masks(F.col("h"))
    return (
        hashed.select(_block(F.col("h"), blocks).alias("_block"), *[m.alias(f"_w{i}") for i, m in enumerate(masks)])
        .groupBy("_block").agg(*[F.bit_or(f"_w{i}").alias(f"_w{i}") for i in range(WORDS)]))


def possible(df: DataFrame, key: Column, members: DataFrame, member_key: Column, keys: int,
             bits_per_key: int = BITS_PER_KEY, max_blocks: int = MAX_BLOCKS, flag: str = "_possible") -> DataFrame:
    """``df`` with a boolean ``flag``: false only for keys that are surely not among ``members``.

    ``keys`` is the counted number of members. The filter is broadcast: it has at
    most ``max_blocks`` rows whatever the number of members.
    """
    blocks = block_count(keys, bits_per_key, max_blocks)
    table = F.broadcast(build(members, member_key, blocks))
    probed = df.withColumn("_bloom_h", F.xxhash64(key))
    masks = _masks(F.col("_bloom_h"))
    hit = F.lit(True)
    for i, mask in enumerate(masks):
        hit = hit & (F.col(f"_w{i}").bitwiseAND(mask) == mask)
    return (
        probed.join(table, _block(F.col("_bloom_h"), blocks) == F.col("_block"), "left")
        .withColumn(flag, F.coalesce(hit, F.lit(False)))
        .drop("_bloom_h", "_block", *[f"_w{i}" for i in range(WORDS)]))
