"""Exact deduplication by two-pass Bloom filtering.

Pass one folds the hash of every normalised text into a saturating two-bit Bloom filter: each cell knows whether it was
hit never, once or more often. Filters of tasks merge cell by cell (sum, saturating at two), in any order. Pass two
lets a row through as certainly unique when one of its cells was hit once only; just the others are shuffled and
grouped by the SHA-256 of the whole normalised text, so the result is exact whatever the filter says.

The filter has ``CELLS_PER_KEY`` cells a row, at most ``MAX_CELLS`` (two planes of 16 MiB): beyond about 15 million rows
its error grows and more rows take the shuffle, up to all of them; nothing else changes.

Defined cases: null text counts as empty; texts that differ in white space alone are equal; of equal texts the longest
original stays, then the smallest id (null ids last), then one of the identical rows; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, cut, free_name, join_groups, text_bytes
from .textscan import mix

CELLS_PER_KEY = 16
MAX_CELLS = 1 << 27
_PROBES = 3
_PIECE = 1 << 16  # cells in one row of a filter on its way to be merged


def normalised(text: Column) -> Column:
    """The text without white space."""
    return F.translate(text_bytes(text), WHITE, "")


def _cells(keys: np.ndarray, size: int) -> list[np.ndarray]:
    return [(mix(keys + np.uint64(0x9E3779B97F4A7C15 * (i + 1) % 2**64)) & np.uint64(size - 1)).astype(np.int64) for i in range(_PROBES)]


def _add(counts: np.ndarray, keys: np.ndarray) -> None:
    """Every probe has cells of its own third of the hash space in effect; a key hits a cell once."""
    cells = np.sort(np.stack(_cells(keys, len(counts))), axis=0)
    cells = cells.T[np.concatenate([np.ones((1, cells.shape[1]), bool), cells[1:] != cells[:-1]]).T]
    at, n = np.unique(cells, return_counts=True)
    counts[at] = np.minimum(2, counts[at] + np.minimum(n, 2).astype(np.uint8))


def repeated_filter(rows: DataFrame, key: str, n: int) -> np.ndarray:
    """Bits of the cells hit twice or more; ``key`` is a long column, ``n`` the number of rows."""
    size = _PIECE
    while size < n * CELLS_PER_KEY and size < MAX_CELLS:
        size <<= 1

    def build(batches):
        counts = np.zeros(size, np.uint8)
        for b in batches:
            _add(counts, b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        for at in range(0, size, _PIECE):
            piece = counts[at : at + _PIECE]
            if piece.any():
                yield _piece(at // _PIECE, piece)

    def merge(batches):
        found: dict[int, np.ndarray] = {}
        for b in batches:
            for at, once, twice in zip(*(b.column(i).to_pylist() for i in range(3))):
                counts = _bits(once) + _bits(twice)
                found[at] = np.minimum(2, found[at] + counts) if at in found else counts
        for at, counts in found.items():
            yield _piece(at, counts)

    schema = "piece int, once binary, twice binary"
    pieces = rows.select(key).mapInArrow(build, schema)
    merged = pieces.repartition(max(1, min(size // _PIECE, 64)), "piece").mapInArrow(merge, schema)
    out = np.zeros(size // 8, np.uint8)
    for row in merged.select("piece", "twice").toLocalIterator():
        out[row["piece"] * _PIECE // 8 : (row["piece"] + 1) * _PIECE // 8] = np.frombuffer(bytes(row["twice"]), np.uint8)
    return out


def _piece(at: int, counts: np.ndarray) -> pa.RecordBatch:
    planes = [np.packbits(counts >= k, bitorder="little").tobytes() for k in (1, 2)]
    return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), *(pa.array([p], pa.binary()) for p in planes)], ["piece", "once", "twice"])


def _bits(packed: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little")


def maybe_repeated(rows: DataFrame, key: str, flag: str) -> DataFrame:
    """``rows`` with a boolean: false only if no other row has its key. ``key`` is computed in both passes."""
    spark = rows.sparkSession
    n = rows.select(F.lit(1)).count()
    bits = spark.sparkContext.broadcast(repeated_filter(rows, key, n))

    @F.pandas_udf("boolean")
    def hit(keys: pd.Series) -> pd.Series:
        k, out = keys.to_numpy().view(np.uint64), np.ones(len(keys), bool)
        for cell in _cells(k, len(bits.value) * 8):
            out &= ((bits.value[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1).astype(bool)
        return pd.Series(out)

    return rows.withColumn(flag, hit(F.col(key)))


def duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256 (see the module's docstring)."""
    norm = normalised(F.col(text))
    rows = docs.select(
        F.col(id).cast("long").alias("id"), F.length(text_bytes(F.col(text))).cast("long").alias("len"), F.sha2(norm, 256).alias("sha"), F.xxhash64(norm).alias("key")
    )
    flagged = maybe_repeated(rows, "key", "again")
    lone = flagged.where(~F.col("again")).select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    some = cut(flagged.where("again").select("id", "len", "sha").withColumn("tag", F.monotonically_increasing_id()))
    best = F.min(F.struct((-F.col("len")).alias("len"), F.col("id").isNull().alias("void"), "id", "tag"))
    groups = cut(some.groupBy("sha").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")))
    many = join_groups(some, groups, "sha", "group_size").select("id", F.col("best.id").alias("keep_id"), "group_size", (F.col("tag") == F.col("best.tag")).alias("kept"), F.col("sha").alias("text_sha256"))
    return lone.union(many).withColumnRenamed("id", id)


def deduplicate(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns; a hot group is reduced on the map side before it is shuffled."""
    key, again, sha = (free_name(docs.columns, x) for x in ("key", "again", "sha"))
    norm = normalised(F.col(text))
    flagged = maybe_repeated(docs.withColumn(key, F.xxhash64(norm)), key, again)
    order = F.struct((-F.length(text_bytes(F.col(text)))).alias("len"), F.col(id).isNull().alias("void"), F.col(id).alias("id"))
    best = flagged.where(again).groupBy(F.sha2(norm, 256).alias(sha)).agg(F.min_by(F.struct(*docs.columns), order).alias("row"))
    return flagged.where(~F.col(again)).select(*docs.columns).union(best.select("row.*"))
