"""Near-duplicate detection with SetSketch registers, banding, joint likelihood and exact verification.

Sketch: every shingle yields an ascending sequence of points, the t-th one drawn from the t-th of M exponentially
distributed slices (so that all M are independent exponentials), dealt to the registers in the order of a permutation
of its own; a register keeps the minimum and stores it on an exponentially spaced scale, floor(1 - log_b x), truncated.
Registers merge by maximum. Points above the largest current minimum of a document change nothing, so a document of n
shingles needs about n + M ln M points, not n * M.

Search: ``BANDS`` bands of ``ROWS`` registers are bucket keys. At a similarity of 0.8 a pair misses all of the 32 bands
with a probability below 1e-7. Documents with equal shingle sets are one class and are searched once.

1. In each bucket the smallest class is a star's centre; every other member keeps its likeliest centre (estimated from
   the registers by maximum likelihood), at most one pair per class, and the pair is verified. Components are formed.
2. Buckets that still hold several components are compared in pairs of blocks (``BLOCK`` classes each). First on registers: a
   class is named if its likelihood estimate with a class of another component reaches the threshold less ``SLACK``; a pair
   counts in the first band that it shares. Then the whole sets of the named classes are sent to their blocks, every pair is
   verified there, and each block gives a spanning forest of its links: pairs that it has joined already need none. So what
   leaves a task is at most one row for each class of a block, and no list of pairs is ever made.
3. Components are formed again from all links.

Verification compares whole shingle sets, as sets of 64-bit hashes of the shingles. Nothing is capped.

Defined cases: null, empty and wordless texts have no shingles and are linked with nothing; texts with fewer words than
a shingle are one shingle; rows that repeat an id are judged one by one, links count if any text of an id has them; null ids
are reported alone; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, components, cut, give_back, in_filter, release, stored
from .textscan import _span_hash, distinct_by_doc, mix, scan, signed

M = 128
ROWS = 4
BANDS = M // ROWS
#: Base of the register scale: its collision probability is within a thousandth of plain MinHash's.
BASE = 1.02
TOP = 2000
#: Standard error of the estimate at 0.8 is 0.035; pairs down to four of them below the threshold are verified.
SLACK = 0.14
#: Classes, and shingles, in a block of a bucket that is compared pair by pair (a task holds two at a time).
BLOCK = 2048
BLOCK_SHINGLES = 1 << 22


def shingle_sets(column: pa.Array, k: int):
    """(index of the first text, shingle counts, document and hash of every distinct shingle) in runs of texts."""
    for w in scan(column, lower=True):
        n = w.counts()
        h, inside = w.sequence(k)
        doc, h = w.doc[: len(h)][inside], h[inside]
        few = np.flatnonzero((n > 0) & (n < k))
        if len(few):
            to = np.cumsum(n)
            doc = np.concatenate([doc, few])
            h = np.concatenate([h, _span_hash(w.hash, to[few] - n[few], to[few])])
        doc, h = distinct_by_doc(doc, h)
        yield w.first, np.bincount(doc, minlength=w.n_docs), doc, h


@lru_cache
def _slices() -> np.ndarray:
    """Bounds of the M slices of the standard exponential that hold equal mass."""
    return np.array([-math.log1p(-t / M) if t < M else np.inf for t in range(M + 1)])


def _unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1) from hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def sketches(n_docs: int, doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Registers (n_docs x M, uint16; 0: no shingle) of sets given by distinct (document, hash) pairs."""
    low = np.full(n_docs * M, np.inf)
    bounds = _slices()
    seed = mix(h ^ np.uint64(0x5851F42D4C957F2D))
    first, step = (seed & np.uint64(M - 1)).astype(np.int64), ((seed >> np.uint64(20)) | np.uint64(1)) & np.uint64(M - 1)
    step = step.astype(np.int64)
    for t in range(M):
        mass = (t + _unit(mix(h + np.uint64(0x9E3779B97F4A7C15 * (t + 1) % 2**64)))) / M
        np.minimum.at(low, doc * M + ((first + step * t) & (M - 1)), -np.log1p(-mass))
        most = low.reshape(n_docs, M).max(axis=1)
        live = most[doc] > bounds[t + 1]
        if not live.any():
            break
        if not live.all():
            doc, h, first, step = doc[live], h[live], first[live], step[live]
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(low) / math.log(BASE)) + TOP // 2
    return np.where(np.isinf(low), 0, np.clip(k, 1, TOP)).astype(np.uint16).reshape(n_docs, M)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A 64-bit key of every band (n x BANDS), different bands apart."""
    parts = registers.reshape(len(registers), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), parts.shape[:2])
    for r in range(ROWS):
        key = mix(key + parts[:, :, r] * np.uint64(0xD1342543DE82EF95))
    return key


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard similarity by maximum likelihood from the numbers of smaller, larger and equal registers and set sizes."""
    up, down = (a > b).sum(axis=-1).astype(float), (a < b).sum(axis=-1).astype(float)
    same = a.shape[-1] - up - down
    u = na / (na + nb)
    v = 1 - u
    most = np.minimum(u / v, v / u)
    grid = np.linspace(0, 1, 101)

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)

    best, out = np.full(up.shape, -np.inf), np.zeros(up.shape)
    for g in grid:
        j = g * most
        plus, minus = np.clip(p(u - v * j), 1e-12, 1), np.clip(p(v - u * j), 1e-12, 1)
        like = up * np.log(plus) + down * np.log(minus) + same * np.log(np.clip(1 - plus - minus, 1e-12, 1))
        better = like > best
        best[better], out[better] = like[better], j[better]
    return out


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), M)


def _pair_estimates(batch: pa.RecordBatch) -> np.ndarray:
    """Estimates for rows with regs_a, regs_b, n_a, n_b."""
    if not batch.num_rows:
        return np.zeros(0)
    return estimate(_registers(batch.column("regs_a")), _registers(batch.column("regs_b")), batch.column("n_a").to_numpy().astype(float), batch.column("n_b").to_numpy().astype(float))


def set_digests(n: np.ndarray, h: np.ndarray) -> pa.Array:
    """128 bits of each set: two wrapping sums of mixed hashes, whatever the order."""
    to = np.cumsum(n)
    parts = []
    for salt in (0x8CB92BA72F3D8DD7, 0xAEF17502108EF2D9):
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix(h ^ np.uint64(salt)), out=sums[1:])
        parts.append(sums[to] - sums[to - n])
    return pa.array([r.tobytes() for r in np.stack(parts, axis=1)], pa.binary())


def sketch(docs: DataFrame, k: int, id: str, text: str) -> DataFrame:
    """id, n (set size), set_hash (of the whole set) and registers of every document."""

    def run(batches):
        for b in batches:
            for first, n, doc, h in shingle_sets(b.column(1), k):
                regs = sketches(len(n), doc, h)
                digest = set_digests(n, h)
                packed = pa.array([r.tobytes() for r in regs], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(n)), pa.array(n.astype(np.int64)), digest, packed], ["id", "n", "set_hash", "regs"])

    return docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, n long, set_hash binary, regs binary")


def _of_ids(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``texts`` with one of the distinct ``ids``, and a few others.

    Texts that are not named are kept from the shuffle by a bitmap of bounded size; what it lets through finds no partner.
    """
    bits = ids.sparkSession.sparkContext.broadcast(bit_filter(ids.select(F.xxhash64("id").alias("key")), "key", ids.count()))

    @F.pandas_udf("boolean")
    def named(keys: pd.Series) -> pd.Series:
        return pd.Series(in_filter(bits.value, keys.to_numpy().view(np.uint64)))

    return texts.where(F.col("id").isNotNull() & named(F.xxhash64("id")))


def _linked(pairs: DataFrame, texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets are similar enough; ``texts``: (id, text), one row for each id."""
    some = _of_ids(texts, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    left = pairs.join(some.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    both = left.join(some.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")
    per_cent = round(threshold * 100)

    def run(batches):
        for b in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            sets = []
            for name in ("text_a", "text_b"):
                parts = [np.split(h, np.cumsum(n)[:-1]) for _, n, _, h in shingle_sets(b.column(name), k)]
                sets.append([s for p in parts for s in p])
            good = []
            for x, y in zip(*sets):
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * common >= per_cent * (len(x) + len(y) - common) and common > 0)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _blocks(held: DataFrame, part: DataFrame) -> DataFrame:
    """(key, x, y, own, c, component, band) of the buckets that hold several components, dealt to pairs of blocks (x, y).

    ``own`` is the block of the class itself. A block holds about ``BLOCK`` classes and ``BLOCK_SHINGLES`` shingles at most.
    """
    placed = held.join(part.select(F.col("node").alias("c"), "component"), "c", "left").select("key", "band", "c", "n", F.coalesce("component", "c").alias("component"))
    open_ = placed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    dealt = placed.join(open_.select("key", blocks.alias("blocks")), "key").withColumn("own", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    dealt = dealt.select("key", "band", "c", "component", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return dealt.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "c", "component", "band")


def _by_block(rows: DataFrame, each, schema: str) -> DataFrame:
    """``each`` on runs of whole blocks: Arrow tables ordered by (key, x, y)."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column("key").to_numpy()
            other = key != key[-1]
            last = len(key) - int(np.argmax(other[::-1])) if other.any() else 0
            if last:
                yield from each(pa.Table.from_batches([*held, b.slice(0, last)]))
                held = []
            held.append(b.slice(last))
        if held:
            yield from each(pa.Table.from_batches(held))
        held.clear()
        give_back()

    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(spread, "key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(run, schema)


def _runs(t: pa.Table) -> np.ndarray:
    """The number of the block that each row is in."""
    key, x, y = (t.column(k).to_numpy() for k in ("key", "x", "y"))
    return np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))


def _named(blocks: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """The rows of ``blocks`` whose class looks similar enough to one of another component in its block.

    A pair counts in the first band that both share, so that it is verified in one bucket. One row for each row at most.
    """
    need = threshold - SLACK

    def each(t: pa.Table):
        run = _runs(t)
        own, c, comp, n, band = (t.column(k).to_numpy() for k in ("own", "c", "component", "n", "band"))
        regs = _registers(t.column("regs").combine_chunks())
        inner = t.column("x").to_numpy() == t.column("y").to_numpy()
        named = np.zeros(len(c), bool)
        left, right, pending = [], [], 0

        def judge() -> None:
            i, j = np.concatenate(left), np.concatenate(right)
            left.clear()
            right.clear()
            unsure = ~(named[i] & named[j])
            i, j = i[unsure], j[unsure]
            if len(i):
                alike = (regs[i] == regs[j]).reshape(len(i), BANDS, ROWS).all(axis=2)
                first = alike.argmax(axis=1) == band[i]
                i, j = i[first], j[first]
            if len(i):
                ok = estimate(regs[i], regs[j], n[i].astype(float), n[j].astype(float)) >= need
                named[i[ok]] = named[j[ok]] = True

        for d in range(1, int(np.bincount(run).max()) if len(run) else 0):  # partners d rows apart, over all blocks at once
            i = np.flatnonzero(run[d:] == run[:-d])
            j = i + d
            ok = (comp[i] != comp[j]) & (inner[i] | (own[i] != own[j])) & (np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]) - 1e-9) & ~(named[i] & named[j])
            i, j = i[ok], j[ok]
            ok = (regs[i] == regs[j]).sum(axis=1) >= M * (need - SLACK)
            if ok.any():
                left.append(i[ok])
                right.append(j[ok])
                pending += int(ok.sum())
                if pending >= 1 << 14:
                    judge()
                    pending = 0
        if left:
            judge()
        yield from t.select(["key", "x", "y", "own", "c", "component"]).filter(pa.array(named)).to_batches()

    full = blocks.join(reps.select("c", "n", "regs"), "c").select("key", "x", "y", "own", "c", "component", "band", "n", "regs")
    return _by_block(full, each, "key long, x int, y int, own int, c long, component long")


def spanning_links(c: np.ndarray, comp: np.ndarray, own: np.ndarray | None, regs: np.ndarray, sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Verified pairs of one block that join its components: a spanning forest, as many links as components less one at most.

    Every pair that may be similar is verified on the whole sets, but for pairs that earlier links of the block have
    joined already. ``own``: of pairs in the same half nothing is asked (they meet elsewhere); None: all pairs.
    """
    per_cent, rows = round(threshold * 100), len(c)
    size = np.array([len(s) for s in sets], np.int64)
    ends = np.cumsum(size)
    _, word = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(int(word.max()) + 1 if len(word) else 0, np.int32)
    _, label = np.unique(comp, return_inverse=True)
    parts, out = len(np.unique(label)), []
    for i in range(rows - 1):
        if parts < 2:
            break
        small, large = np.minimum(size[i], size[i + 1 :]), np.maximum(size[i], size[i + 1 :])
        ok = (label[i + 1 :] != label[i]) & (100 * small >= per_cent * large)
        if own is not None:
            ok &= own[i + 1 :] != own[i]
        j = i + 1 + np.flatnonzero(ok)
        j = j[(regs[j] == regs[i]).sum(axis=1) >= M * (threshold - 2 * SLACK)] if len(j) else j
        if not len(j):
            continue
        mine = word[ends[i] - size[i] : ends[i]]
        mark[mine] = 1
        first = np.cumsum(size[j]) - size[j]
        common = np.add.reduceat(mark[np.concatenate([word[ends[k] - size[k] : ends[k]] for k in j.tolist()])], first)
        mark[mine] = 0
        for k in j[(100 * common >= per_cent * (size[i] + size[j] - common)) & (common > 0)].tolist():
            if label[k] != label[i]:
                label[label == label[k]] = label[i]
                parts -= 1
                out.append((int(c[i]), int(c[k])))
    return out


def _forests(named: DataFrame, reps: DataFrame, texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """Verified links (a, b) between components, a spanning forest of each block; ``named``: rows of ``_named``, stored."""
    ids = named.select(F.col("c").alias("id")).distinct()
    some = stored(_of_ids(texts, ids), "texts")  # apart from the next step: one Python worker for each task at a time

    def sets(batches):
        for b in batches:
            for first, n, _, h in shingle_sets(b.column("text"), k):
                found = pa.array([x.tobytes() for x in np.split(h, np.cumsum(n)[:-1])], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("id").slice(first, len(n)), found], ["c", "set"])

    whole = some.select("id", "text").mapInArrow(sets, "c long, set binary")

    def each(t: pa.Table):
        run = _runs(t)
        own, c, comp = (t.column(x).to_numpy() for x in ("own", "c", "component"))
        inner = t.column("x").to_numpy() == t.column("y").to_numpy()
        regs = _registers(t.column("regs").combine_chunks())
        held = t.column("set").combine_chunks()
        opens = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        out: list[tuple[int, int]] = []
        for a, b in zip(opens.tolist(), [*opens[1:].tolist(), len(run)]):
            found = [np.frombuffer(s.as_buffer(), np.uint64) for s in held.slice(a, b - a)]
            out += spanning_links(c[a:b], comp[a:b], None if inner[a] else own[a:b], regs[a:b], found, threshold)
        x, y = zip(*out) if out else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    full = named.join(reps.select("c", "regs"), "c").join(whole, "c").select("key", "x", "y", "own", "c", "component", "regs", "set")
    return _by_block(full, each, "a long, b long")


def link_classes(docs: DataFrame, k: int = 5, threshold: float = 0.8, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_shingles, component_id of every row (see the module's docstring)."""
    whole = stored(sketch(docs, k, id, text), "sketches")
    sets = whole.where("n > 0 AND id IS NOT NULL")
    # a class: documents with equal sets; its number is the smallest id
    least = sets.groupBy("set_hash", "n").agg(F.min(F.struct("id", "regs")).alias("least"))
    reps = stored(least.select(F.col("least.id").alias("c"), "n", "set_hash", F.col("least.regs").alias("regs")), "classes")
    member = sets.select("id", "n", "set_hash").distinct().join(reps.select("set_hash", "n", F.col("c").alias("class")), ["set_hash", "n"])

    def buckets(batches):
        for b in batches:
            if not b.num_rows:
                continue
            keys = band_keys(_registers(b.column("regs")))
            c, n = (np.repeat(b.column(x).to_numpy(), BANDS) for x in ("c", "n"))
            band = np.tile(np.arange(BANDS, dtype=np.int32), b.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(n), signed(keys.ravel()), pa.array(band)], ["c", "n", "key", "band"])

    rows = reps.mapInArrow(buckets, "c long, n long, key long, band int").distinct()
    shared = rows.groupBy("key").agg(F.min("c").alias("centre"), F.count(F.lit(1)).alias("size")).where("size > 1")
    held = cut(rows.join(shared, "key").select("key", "band", "c", "n", "centre"))

    def with_registers(pairs: DataFrame) -> DataFrame:
        a = reps.select(F.col("c").alias("a"), F.col("regs").alias("regs_a"), F.col("n").alias("n_a"))
        b = reps.select(F.col("c").alias("b"), F.col("regs").alias("regs_b"), F.col("n").alias("n_b"))
        return pairs.join(b, "b").join(a, "a").select("a", "b", "regs_a", "regs_b", "n_a", "n_b")

    def estimated(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(_pair_estimates(b))], ["a", "b", "est"])

    texts = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    stars = held.where("c <> centre").select(F.col("centre").alias("a"), F.col("c").alias("b")).distinct()
    near = with_registers(stars).mapInArrow(estimated, "a long, b long, est double").where(F.col("est") >= threshold - SLACK)
    chosen = cut(near.groupBy("b").agg(F.max_by("a", F.struct("est", (-F.col("a")).alias("low"))).alias("a")).select("a", "b"))
    links = cut(_linked(chosen, texts, k, threshold))
    del stars, near, chosen
    release(docs.sparkSession)
    part = components(links)
    named = stored(_named(_blocks(held, part), reps, threshold), "named")
    if named.limit(1).count():
        more = cut(_forests(named, reps, texts, k, threshold))
        if more.limit(1).count():
            part = components(links.union(more))
    done = member.join(part.withColumnRenamed("node", "class"), "class", "left").select("id", "n", "set_hash", F.coalesce("component", "class").alias("component_id"))
    out = whole.select("id", "n", "set_hash").join(done, ["id", "n", "set_hash"], "left")
    return out.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
