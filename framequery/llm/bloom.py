"""Bloom filters as small tables of bit maps, built and tested with DataFrame functions only.

A filter has PROBES bit maps of ``bits`` bits, in blocks of BLOCK bits. Bits hit are counted with a combine before
the shuffle, so a key that a third of all rows have costs one row a task. ``at_least=2`` keeps only the bits that two
rows or more hit: a key failing that test is certainly unique. The broadcast has a fixed greatest size (MAX_BITS / 8
bytes a probe, 64 MB); a fuller filter lets more rows through, which costs shuffle, never rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 1 << 15  # bits of one bitmap_construct_agg value
PROBES = 2
MAX_BITS = 1 << 29


def filter_bits(rows: int, max_bits: int = MAX_BITS) -> int:
    """Sixteen bits a row, as a power of two, within bounds."""
    return min(max_bits, max(BLOCK, 1 << (16 * max(rows, 1) - 1).bit_length()))


def _bit(key: str, probe: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key), F.lit(probe)), F.lit(bits))


def bit_map(keys: DataFrame, key: str, probe: int, bits: int, at_least: int = 1) -> DataFrame:
    hit = keys.groupBy(_bit(key, probe, bits).alias("bit")).count().where(F.col("count") >= at_least)
    return hit.groupBy(F.floor(F.col("bit") / BLOCK).alias(f"__block{probe}")).agg(F.bitmap_construct_agg(F.col("bit") % BLOCK).alias(f"__map{probe}"))


def tested(df: DataFrame, key: str, keys: DataFrame, bits: int, at_least: int = 1, out: str = "maybe") -> DataFrame:
    """df with ``out``: false only if fewer than ``at_least`` rows of ``keys`` have this key."""
    columns, passed = df.columns, F.lit(True)
    for probe in range(PROBES):
        bit = _bit(key, probe, bits)
        df = df.withColumn(f"__block{probe}", F.floor(bit / BLOCK)).join(F.broadcast(bit_map(keys, key, probe, bits, at_least)), f"__block{probe}", "left")
        at = bit % BLOCK
        byte = F.conv(F.hex(F.substring(F.col(f"__map{probe}"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        passed = passed & F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) != 0, F.lit(False))
    return df.select(*columns, passed.alias(out))
