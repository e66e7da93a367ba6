"""Best-fit packing into sequences of several permitted lengths.

Every task packs the documents of its partition in windows of ``window`` documents: nothing is shuffled, no key can be
hot, and a retried task makes the same sequences. Inside a window the lengths form a histogram. The longest piece left
opens a sequence; each length that may be opened and can hold it is filled on trial by best fit (always the longest piece
that still fits), its cost per used unit (capacity after downsizing plus ``overhead``) is compared, and the cheapest is kept.
Every sequence shrinks to the smallest permitted length that holds its contents. The whole window is packed in this way with all
lengths and with each length alone to open, and the plan of the least total cost is kept.

Documents longer than the largest capacity are cut into pieces; every unit of every document is in exactly one sequence.

Defined cases: null or wordless texts have length 0 and ride in the first sequence of their window (which has the
smallest capacity if nothing else is there); null ids stay null in the lists; an empty table gives no sequences.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textscan import count_words

CAPACITIES = (1024, 2048, 4096, 8192)
OVERHEAD = 16
WINDOW = 16384

SCHEMA = "bin_id long, capacity int, n_used int, doc_ids array<long>, starts array<long>, lengths array<long>"
_ARROW = pa.schema(
    [("bin_id", pa.int64()), ("capacity", pa.int32()), ("n_used", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))]
)


class _Lengths:
    """A multiset of lengths that gives the longest one up to a bound."""

    def __init__(self, lengths: list[int]):
        self.count: dict[int, int] = {}
        for x in lengths:
            self.count[x] = self.count.get(x, 0) + 1
        self.order = sorted(self.count)

    def longest(self) -> int:
        return self.order[-1] if self.order else 0

    def fill(self, room: int) -> list[tuple[int, int]]:
        """(length, how many) by best fit into ``room``, without taking them."""
        out, at = [], len(self.order)
        while room and (at := bisect_right(self.order, room, 0, at)):
            x = self.order[at - 1]
            n = min(self.count[x], room // x)
            out.append((x, n))
            room -= n * x
            at -= 1
        return out

    def take(self, taken: list[tuple[int, int]]) -> None:
        for x, n in taken:
            self.count[x] -= n
            if not self.count[x]:
                del self.count[x]
                del self.order[bisect_right(self.order, x) - 1]


def cost(bins: list[tuple[int, list[int]]], overhead: int) -> int:
    """What sequences take: their capacities and the overhead of each."""
    return sum(capacity + overhead for capacity, _ in bins)


def pack_lengths(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> list[tuple[int, list[int]]]:
    """(capacity, lengths) of each sequence for positive lengths up to the largest capacity: the cheapest of several plans."""
    sizes = sorted(capacities)
    plans = [_plan(lengths, sizes, opens, overhead) for opens in (sizes, *([c] for c in sizes[:-1]), sizes[-1:])]
    return min(plans, key=lambda bins: cost(bins, overhead))


def _plan(lengths: list[int], sizes: list[int], opens: list[int], overhead: int) -> list[tuple[int, list[int]]]:
    """Best fit with the lengths ``opens`` to open; a piece that fits into none of them opens the smallest that holds it."""
    left, out = _Lengths(lengths), []
    while first := left.longest():
        best = None
        for c in [c for c in opens if c >= first] or [next(c for c in sizes if c >= first)]:
            trial = left.fill(c)  # starts with the longest, which fits
            used = sum(x * n for x, n in trial)
            final = next(s for s in sizes if s >= used)
            price = (final + overhead) / used
            if best is None or price < best[0]:
                best = (price, final, trial)
        left.take(best[2])
        out.append((best[1], [x for x, n in best[2] for _ in range(n)]))
    return out


def _pieces(ids: list, lengths: np.ndarray, most: int) -> tuple[dict[int, list[tuple]], list]:
    """By length the (id, start) of each piece; ids of empty documents."""
    by: dict[int, list[tuple]] = {}
    empty = []
    for i, n in zip(ids, lengths.tolist()):
        if not n:
            empty.append(i)
        for at in range(0, n, most):
            by.setdefault(min(most, n - at), []).append((i, at))
    return by, empty


def pack_window(ids: list, lengths: np.ndarray, capacities: tuple[int, ...], overhead: int) -> Iterator[tuple]:
    by, empty = _pieces(ids, lengths, max(capacities))
    bins = pack_lengths([x for x, items in by.items() for _ in items], capacities, overhead) or ([(min(capacities), [])] if empty else [])
    for capacity, held in bins:
        items = [(*by[x].pop(), x) for x in held] + [(i, 0, 0) for i in empty]
        empty = []
        yield capacity, sum(held), [x[0] for x in items], [x[1] for x in items], [x[2] for x in items]


def pack(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    capacities: tuple[int, ...] = CAPACITIES,
    overhead: int = OVERHEAD,
    window: int = WINDOW,
    units: Callable[[pa.Array], np.ndarray] = count_words,
) -> DataFrame:
    """One row per sequence: bin_id, capacity, n_used and, in order, doc_ids, starts and lengths of its pieces.

    ``units`` gives the number of units (words by default) of every text of an Arrow column.
    """

    def run(batches):
        base = TaskContext.get().partitionId() << 32
        made = 0
        ids: list = []
        lengths: list[np.ndarray] = []

        def flush(n: int):
            nonlocal made, ids, lengths
            every = np.concatenate(lengths)
            rows = list(pack_window(ids[:n], every[:n], capacities, overhead))
            ids, lengths = ids[n:], [every[n:]]
            columns = [list(range(base + made, base + made + len(rows))), *map(list, zip(*rows))]
            made += len(rows)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)

        for b in batches:
            ids += b.column(0).to_pylist()
            lengths.append(units(b.column(1)))
            while len(ids) >= window:
                yield flush(window)
        if ids:
            yield flush(len(ids))

    return docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)
