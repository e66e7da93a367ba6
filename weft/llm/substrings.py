"""Substring deduplication with repeated-phrase automata.

A phrase is a window of ``WINDOW`` consecutive words of one document. A phrase recurs if it also starts in another
document; a document loses every word that a phrase covers which also starts in a document with a smaller id.

1. Anchors. A window is represented by its anchor, the least hash of its ``ANCHOR``-word sequences; neighbouring windows mostly
   share it, so anchors are few. Anchors of two documents or more are counted (hash and a flag for each batch, summed with
   map-side combination) and kept as a bitmap.
2. Candidates. The windows with such an anchor are counted in the same way by the hash of all their words: a second bitmap.
   Bitmaps are bounded (``common.MAX_FILTER_BITS``) and one-sided: what they let through too much costs time, not results.
3. Segments. Each document is cut into runs of candidate windows that have one anchor: an exact filter, as no window outside
   them recurs. Equal segments collapse to one row with the smallest document id (again map-side combined), so a passage that
   a third of all documents share is streamed once. Anchors of more than ``SHARD`` different segments are cut anew, into single
   windows that have the hash of the whole window as their anchor, so that no anchor's segments outgrow a task.
4. Automata. Segments are sharded by anchor; windows that are equal have equal anchors and meet in one shard. A shard confirms
   word by word which phrases two segments or more share (ranks of 1, 2, 4, 8 and 13 words, without hashes), compiles
   these with the smallest id of each into an Aho-Corasick automaton over word numbers, and streams its segments of all
   documents through it to locate every occurrence. What only one segment holds has that segment's smallest id.
5. The result goes back along the passages to the documents' runs, and the covered words are removed. Only documents that may
   lose something are joined with their runs; the others (as a third bitmap tells) are written straight.

Defined cases: null texts count as empty; texts shorter than a window lose nothing; a phrase that repeats inside one
document alone does not recur; rows with a null id neither give nor lose phrases; rows that repeat an id are one document as
to what recurs, and each loses its own words; an empty table gives an empty one.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, cut, give_back, in_filter, release, stored, text_bytes
from .textscan import Words, joined, scan, signed, slices, sliding_min, strings

WINDOW = 13
ANCHOR = 5
#: Segments that a shard holds on average, and of one anchor at most.
SHARD = 2000
#: Shards that a task works off, one after the other.
TASK_SHARDS = 16


def _windows(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Anchor of every window (by its first word) and whether it lies in one text."""
    h, _ = w.sequence(ANCHOR)
    n = max(0, len(w.hash) - WINDOW + 1)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    return sliding_min(h, WINDOW - ANCHOR + 1)[:n], w.doc[WINDOW - 1 :] == w.doc[:n]


def _by_document(ids: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
    """Each hash once, with 1 if it is in one document of this batch and 2 if in several."""
    order = np.argsort(hashes, kind="stable")
    h, d = hashes[order], ids[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    many = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first) if len(h) else np.zeros(0, bool)
    return pa.RecordBatch.from_arrays([signed(h[first]), pa.array(1 + many.astype(np.int8))], ["h", "n"])


def _recurring(hashes: DataFrame) -> DataFrame:
    return hashes.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")


def _ids(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def passages(docs: DataFrame) -> DataFrame:
    """Runs of windows that may recur: id, row, start word, anchor, passage.

    ``docs``: id (not null), text, and row (a hash of the text).
    """
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast

    def anchors(batches):
        for b in batches:
            ids = _ids(b.column(0))
            for w in scan(b.column(1)):
                a, ok = _windows(w)
                doc = w.doc[: len(a)]
                new = ok.copy()
                new[1:] &= ~(ok[:-1] & (a[1:] == a[:-1]) & (doc[1:] == doc[:-1]))
                yield _by_document(ids[w.first + doc[new]], a[new])
        give_back()

    def bitmap(hashes: DataFrame):
        found = cut(_recurring(hashes))
        bits = share(bit_filter(found, "h", found.count()))
        del found, hashes
        release(spark)
        return bits

    first = bitmap(docs.mapInArrow(anchors, "h long, n byte"))

    def candidates(batches):
        for b in batches:
            ids = _ids(b.column(0))
            for w in scan(b.column(1)):
                a, ok = _windows(w)
                at = np.flatnonzero(ok)
                at = at[in_filter(first.value, a[at])]
                h, _ = w.sequence(WINDOW)
                yield _by_document(ids[w.first + w.doc[at]], h[at] if len(at) else np.zeros(0, np.uint64))
        give_back()

    second = bitmap(docs.mapInArrow(candidates, "h long, n byte"))

    def runs(batches):
        for b in batches:
            ids, hashes = _ids(b.column(0)), _ids(b.column(2))
            for w in scan(b.column(1)):
                d, start, anchor, i, j = _runs(w, first.value, second.value)
                data, _, at = joined(w)
                texts = slices(data, at[i], at[j - 1] + w.end[j - 1] - w.start[j - 1])
                yield pa.RecordBatch.from_arrays([pa.array(ids[w.first + d]), pa.array(hashes[w.first + d]), pa.array(start.astype(np.int32)), signed(anchor), texts], ["id", "row", "start", "anchor", "passage"])
        give_back()

    return docs.mapInArrow(runs, "id long, row long, start int, anchor long, passage string")


def _runs(w: Words, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each run of candidate windows: text, first word in the text, anchor, first word and the one after the last."""
    a, ok = _windows(w)
    at = np.flatnonzero(ok)
    at = at[in_filter(first, a[at])]
    if len(at):
        at = at[in_filter(second, w.sequence(WINDOW)[0][at])]
    doc = w.doc[at]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (a[at[1:]] != a[at[:-1]]) | (doc[1:] != doc[:-1])
    opens = np.flatnonzero(new)
    closes = np.append(opens[1:], len(at))[: len(opens)] - 1
    d, i, j = doc[opens], at[opens], at[closes] + WINDOW
    base = np.searchsorted(w.doc, np.arange(w.n_docs))
    return d, i - base[d], a[i], i, j


def _ranks(numbers: np.ndarray) -> np.ndarray:
    """A number for the WINDOW words from each position on: equal if and only if the words are."""
    rank, have = numbers, 1
    while have < WINDOW:
        step = min(have, WINDOW - have)  # two runs of ``have`` words, ``step`` apart, are one of have + step
        _, rank = np.unique(rank[:-step].astype(np.int64) * (int(rank.max()) + 1) + rank[step:], return_inverse=True)
        have += step
    return rank


def least_ids(texts: list[str], ids: list[int]) -> list[list[int]]:
    """For each window of each segment the smallest id of a segment that holds its words; equal anchors throughout.

    Phrases that segments share are compiled into an automaton with the smallest id, and the segments are streamed.
    """
    number: dict[str, int] = {}
    words = [tuple(number.setdefault(x, len(number) + 1) for x in t.split(" ")) for t in texts]
    out = [[i] * max(0, len(seq) - WINDOW + 1) for seq, i in zip(words, ids)]
    flat = np.array([x for seq in words for x in seq], np.int64)
    if len(flat) < WINDOW:
        return out
    segment = np.repeat(np.arange(len(words)), [len(seq) for seq in words])
    at = np.flatnonzero(segment[WINDOW - 1 :] == segment[: len(flat) - WINDOW + 1])
    phrase, segment = _ranks(flat)[at], segment[at]
    order = np.lexsort((np.array(ids, np.int64)[segment], phrase))
    p, q = phrase[order], segment[order]
    first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])) if len(p) else np.zeros(0, np.int64)
    shared = np.minimum.reduceat(q, first) != np.maximum.reduceat(q, first) if len(p) else np.zeros(0, bool)
    if not shared.any():
        return out
    machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for k in first[shared].tolist():
        start = int(at[order[k]])
        machine.add_word(tuple(flat[start : start + WINDOW].tolist()), ids[q[k]])
    machine.make_automaton()
    held = np.zeros(int(phrase.max()) + 1, bool)
    held[p[first[shared]]] = True
    for s in np.unique(segment[held[phrase]]).tolist():  # the others hold none of them
        row = out[s]
        for end, i in machine.iter(words[s]):
            row[end - WINDOW + 1] = i
    return out


def single_windows(runs: DataFrame, bits) -> DataFrame:
    """Every window of the runs with an anchor in a broadcast bitmap as a run of its own, with the hash of all its words as its anchor."""

    def cut_up(batches):
        for b in batches:
            b = b.filter(pa.array(in_filter(bits.value, _ids(b.column("anchor")).view(np.uint64))))
            ids, rows, starts = (_ids(b.column(c)) for c in ("id", "row", "start"))
            for w in scan(b.column("passage")):
                n = len(w.hash) - WINDOW + 1
                if n < 1:
                    continue
                h, inside = w.sequence(WINDOW)
                at = np.flatnonzero(inside)
                of = w.first + w.doc[at]
                base = np.searchsorted(w.doc, np.arange(w.n_docs))
                data, _, begin = joined(w)
                texts = slices(data, begin[at], begin[at + WINDOW - 1] + w.end[at + WINDOW - 1] - w.start[at + WINDOW - 1])
                columns = (pa.array(ids[of]), pa.array(rows[of]), pa.array((starts[of] + at - base[w.doc[at]]).astype(np.int32)), signed(h[at]), texts)
                yield pa.RecordBatch.from_arrays(list(columns), ["id", "row", "start", "anchor", "passage"])

    return runs.select("id", "row", "start", "anchor", "passage").mapInArrow(cut_up, "id long, row long, start int, anchor long, passage string")


def distinct_segments(found: DataFrame) -> DataFrame:
    """(anchor, passage, id) of the different segments with the smallest id of each, stored."""
    return stored(found.groupBy("anchor", "passage").agg(F.min("id").alias("id")), "segments")


def split_anchors(found: DataFrame, distinct: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs and their different segments, after those of anchors with more than ``SHARD`` segments are cut into single windows."""
    hot = cut(distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHARD).select("anchor"))
    n = hot.count()
    if not n:
        return found, distinct
    bits = found.sparkSession.sparkContext.broadcast(bit_filter(hot, "anchor", n))

    @F.pandas_udf("boolean")
    def many(keys: pd.Series) -> pd.Series:
        return pd.Series(in_filter(bits.value, keys.to_numpy().view(np.uint64)))

    # a few others share a cell of the bitmap; they are cut as well, an anchor's segments always alike
    single = stored(single_windows(found, bits), "windows")
    rest, others = found.where(~many("anchor")), distinct.where(~many("anchor"))
    return rest.union(single), others.union(distinct_segments(single))


def sourced(distinct: DataFrame) -> DataFrame:
    """The different segments (anchor, key) with ``least``: for each of their windows the smallest id of its phrase."""
    tasks = max(1, -(-distinct.count() // (SHARD * TASK_SHARDS)))

    def locate(batches):
        last = None

        def flush():
            got = least_ids(held[1], held[2])
            return pa.RecordBatch.from_arrays([pa.array(held[0], pa.int64()), pa.array(held[3], pa.int64()), pa.array(got, pa.list_(pa.int64()))], ["anchor", "key", "least"])

        held = [[], [], [], []]
        for b in batches:
            for a, t, i, k in zip(*(b.column(c).to_pylist() for c in ("anchor", "passage", "id", "key"))):
                if a != last and len(held[0]) >= SHARD:  # sorted by anchor: one anchor's passages stay together
                    yield flush()
                    held = [[], [], [], []]
                last = a
                for column, x in zip(held, (a, t, i, k)):
                    column.append(x)
        if held[0]:
            yield flush()
        give_back()

    dealt = distinct.withColumn("key", F.xxhash64("passage")).repartition(min(tasks, 100_000), "anchor").sortWithinPartitions("anchor")
    return dealt.select("anchor", "passage", "id", "key").mapInArrow(locate, "anchor long, key long, least array<long>")


def _covered(w: Words, runs: pa.Array) -> np.ndarray:
    """Which words a window covers that is marked in the texts' runs (lists of start and marks; null: none)."""
    n = w.counts()
    sums = np.zeros(len(w.hash) + 1, np.int64)
    if runs.null_count < len(runs):
        text = np.repeat(np.arange(w.n_docs), pc.fill_null(pc.list_value_length(runs), 0).to_numpy(zero_copy_only=False))
        flat = runs.flatten()
        marks = pc.struct_field(flat, "hit")
        size = pc.list_value_length(marks).to_numpy(zero_copy_only=False)
        run = np.repeat(np.arange(len(size)), size)
        first = (np.cumsum(n) - n)[text] + pc.struct_field(flat, "start").to_numpy(zero_copy_only=False)
        at = (first[run] + np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size))[marks.flatten().to_numpy(zero_copy_only=False)]
        np.add.at(sums, at, 1)
        np.add.at(sums, at + WINDOW, -1)
    return np.cumsum(sums[:-1]) > 0


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_words, n_removed, kept (the words that stay, joined by one space) and spans (removed word ranges)."""
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text_bytes(F.col(text))).alias("row"))
    found = stored(passages(rows.where("id IS NOT NULL")), "runs")
    found, distinct = split_anchors(found, distinct_segments(found))
    release(docs.sparkSession)
    sources = sourced(distinct)
    runs = found.select("id", "row", "start", "anchor", F.xxhash64("passage").alias("key")).join(sources, ["anchor", "key"])
    runs = runs.select("id", "row", F.struct("start", F.transform("least", lambda i: i < F.col("id")).alias("hit")).alias("run")).where(F.exists("run.hit", lambda x: x))
    per = stored(runs.groupBy("id", "row").agg(F.collect_set("run").alias("runs")), "covered")
    del runs, sources
    release(docs.sparkSession)

    def strip(batches):
        for b in batches:
            for w in scan(b.column(1)):
                gone = _covered(w, b.column(2).slice(w.first, w.n_docs))
                data, offsets, _ = joined(w, ~gone)
                n, n_gone = w.counts(), np.bincount(w.doc[gone], minlength=w.n_docs)
                # removed ranges: from the first word that is gone to the one after the last, in one text
                edge = np.flatnonzero(np.concatenate([[False], gone]) != np.concatenate([gone, [False]]))
                turn = np.flatnonzero(gone[1:] & gone[:-1] & (w.doc[1:] != w.doc[:-1])) + 1
                edge = np.sort(np.concatenate([edge, turn, turn]))
                doc = np.repeat(w.doc[edge[::2]], 2) if len(edge) else edge
                base = np.cumsum(n) - n
                lists = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=w.n_docs))]).astype(np.int32)
                spans = pa.ListArray.from_arrays(pa.array(lists), pa.array(edge - base[doc], pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(w.first, w.n_docs), pa.array(n.astype(np.int64)), pa.array(n_gone.astype(np.int64)), strings(data, offsets), spans], ["id", "n_words", "n_removed", "kept", "spans"])
        give_back()

    schema = "id long, n_words long, n_removed long, kept string, spans array<long>"
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(per, "row", per.count()))

    @F.pandas_udf("boolean")
    def covered(keys: pd.Series) -> pd.Series:
        return pd.Series(in_filter(bits.value, keys.to_numpy().view(np.uint64)))

    def untouched(batches):
        """Rows that lose nothing; one step, so that a task has one Python worker."""

        def rest():
            for b in batches:
                stay = pa.array(~in_filter(bits.value, _ids(b.column("row")).view(np.uint64)))
                yield b.drop_columns(["row"]).filter(stay)

        yield from strip(rest())

    # with the hash of the text, rows that repeat an id find their own runs
    whole = rows.select("id", "text", F.lit(None).cast(per.schema["runs"].dataType).alias("runs"), "row").mapInArrow(untouched, schema)
    parts = rows.where(covered("row")).join(per, ["id", "row"], "left").select("id", "text", "runs").mapInArrow(strip, schema)
    return whole.union(parts).withColumnRenamed("id", id)
