"""Shared storage, bounded bit filters and connected components for the operators."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import new_folder, shared_dir, stored

#: White space and word pattern that all contracts share: space and the characters from tab to carriage return.
WHITE = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"

#: Bits of a broadcast filter at most (64 MiB); beyond it the filter lets more rows through, results stay exact.
MAX_FILTER_BITS = 1 << 29

#: Groups of more than a HOT-th of all rows are joined by broadcast: HOT of them at most.
HOT = 1000

_BUCKET_BITS = 15  # bits of one bitmap of bitmap_construct_agg


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder: later reads survive lost executors and the lineage ends here."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that nothing refers to any more; it does so when garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Return what a Python worker has freed to the system: workers are kept for later tasks, and so would be the memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not the GNU C library
        pass


def free_name(taken: list[str], wanted: str) -> str:
    """A column name that clashes with none of ``taken`` (Spark compares without case)."""
    used = {t.lower() for t in taken}
    while wanted.lower() in used:
        wanted = f"_{wanted}"
    return wanted


def filter_bits(n: int, per_key: int = 16) -> int:
    """Size of a filter for n keys: a power of two, bounded by MAX_FILTER_BITS."""
    bits = 1 << 15
    while bits < per_key * n and bits < MAX_FILTER_BITS:
        bits <<= 1
    return bits


def bit_filter(keys: DataFrame, key: str, n: int) -> np.ndarray:
    """A bitmap in which the cell of every key (a long) is set; built by map-side combined bitmap aggregation.

    What comes to the driver is the bitmap alone: MAX_FILTER_BITS / 8 bytes at most.
    """
    bits = filter_bits(n)
    cell = F.col(key).bitwiseAND(F.lit(bits - 1))
    rows = (
        keys.select(F.shiftright(cell, _BUCKET_BITS).alias("bucket"), cell.bitwiseAND(F.lit((1 << _BUCKET_BITS) - 1)).alias("bit"))
        .groupBy("bucket")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
    )
    out = np.zeros(bits // 8, np.uint8)
    size = (1 << _BUCKET_BITS) // 8
    for row in rows.toLocalIterator():
        part = np.frombuffer(bytes(row["bits"]), np.uint8)
        out[row["bucket"] * size : row["bucket"] * size + len(part)] = part
    return out


def in_filter(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys (uint64) have their cell set."""
    cell = keys & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 > 0


def components(edges: DataFrame, left: str = "a", right: str = "b", rounds: int = 50) -> DataFrame:
    """(node, component) of every node of an edge list; component is the smallest node that can be reached.

    Alternating large-star and small-star steps: each is one map-side combined minimum and one join, so a vertex with
    very many edges is never gathered, and the number of steps is logarithmic in practice. Self-loops are allowed.
    """
    e = cut(edges.select(F.least(left, right).alias("lo"), F.greatest(left, right).alias("hi")).where("lo < hi").distinct())
    before = None
    for _ in range(rounds):
        both = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(e.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo < hi").distinct()
        down = large.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("m").alias("lo"), F.explode(F.array("u", "v")).alias("hi")).where("lo < hi").distinct()
        e = cut(small)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError("connected components did not settle")
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(e.select(F.col("lo").alias("node"), F.col("lo").alias("component"))).distinct()


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` joined with the row of their group; ``size``: the column of ``groups`` with the number of rows of a group.

    Both are read twice and should be stored. Groups that hold more than a ``HOT``-th of all rows (``HOT`` of them at
    most, so that they can be broadcast) never meet in one task; the others are joined by key.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = groups.where(F.col(size) * HOT > total)
    first = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups.where(F.col(size) * HOT <= total), key)
    return first.unionByName(rest)


def text_bytes(text: Column) -> Column:
    """Null texts count as empty."""
    return F.coalesce(text, F.lit(""))
