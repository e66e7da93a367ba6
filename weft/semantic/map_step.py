"""The map step on a DataFrame: one answer for every tuple.

Tuples are numbered along a total order of all columns joined so far: a range sort, then the row number within each range
plus the sizes of the ranges before it. The numbering is stored, and batches are runs of it, so the step is distributed, a
retried task asks for the same batches, and the answers do not depend on the partitioning. The answers are stored as well
before the rest of the rule is joined, so no later step asks again; a task that is lost asks its ``REQUESTS`` requests or less again.

Names of the step's own columns begin with ``#``, which no variable can.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.storage import stored
from .config import BATCH, MapConfig
from .formats import build_tree, flat_columns
from .prompt import build_prompt
from .providers import Provider, Usage, create

#: Requests of one task, unless there are fewer than cores.
REQUESTS = 64

log = logging.getLogger(__name__)


def numbered(df: DataFrame, column: str) -> DataFrame:
    """``df`` with consecutive numbers from 0 in the order of its columns (nulls first); stored."""
    order = [F.col(f"`{c}`").asc_nulls_first() for c in df.columns]
    part, place = f"{column}_part", f"{column}_place"
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(part, F.spark_partition_id())
    ranged = stored(ranged.withColumn(place, F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)), "tuples")
    sizes = ranged.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select(part, (F.sum("n").over(Window.orderBy(part)) - F.col("n")).alias("before"))  # a row for each range
    return ranged.join(F.broadcast(before), part).withColumn(column, F.col("before") + F.col(place)).drop("before", part, place)


def batches(rows: list[dict], config: MapConfig, parents: dict[str, str | None]) -> Iterator[list[dict]]:
    """Runs of tuples of one request. FTREE: as long as no attribute has more distinct values than its capacity."""
    if config.tuple_format != "FTREE":
        for at in range(0, len(rows), config.batch_size):
            yield rows[at : at + config.batch_size]
        return
    held: list[dict] = []
    seen: dict[str, set] = {a: set() for a in parents}
    for r in rows:
        if held and any(len(seen[a] | {r[a]}) > config.capacities.get(a, BATCH) for a in parents):
            yield held
            held, seen = [], {a: set() for a in parents}
        held.append(r)
        for a in parents:
            seen[a].add(r[a])
    if held:
        yield held


def answer_text(item) -> str | None:
    if item is None:
        return None
    return item if isinstance(item, str) else json.dumps(item, ensure_ascii=False)


def ask(provider: Provider, rows: list[dict], first: int, config: MapConfig, parents: dict[str, str | None]) -> tuple[list[str | None], Usage]:
    """One answer for each tuple; what the model leaves out is null."""
    tree = config.tuple_format == "FTREE"
    data = build_tree(rows, parents) if tree else flat_columns(rows, config.columns)
    prompt = build_prompt(config.prompt, data, len(rows), config.tuple_format)
    items, usage = provider.complete(prompt, len(rows), config, first)
    if len(items) < len(rows):
        log.warning("%s answered %d of %d tuples", config.provider, len(items), len(rows))
    out = [answer_text(x) for x in items[: len(rows)]]
    return out + [None] * (len(rows) - len(out)), usage


def llm_map(df: DataFrame, output: str, config: MapConfig, parents: dict[str, str | None], provider: Provider | None = None) -> tuple[DataFrame, Usage]:
    """``df`` with the answers as column ``output``, and the usage. ``parents``: the tree of the attributes, for FTREE."""
    provider = provider or create(config.provider)
    number, span_name = "#n", "#span"
    rows = numbered(df, number)
    # a task's rows are a whole number of requests; FTREE windows end with their span at the latest
    span = config.batch_size if config.tuple_format != "FTREE" else BATCH
    requests = -(-rows.count() // span)
    spread = max(1, min(requests, max(rows.sparkSession.sparkContext.defaultParallelism, -(-requests // REQUESTS))))
    dealt = rows.withColumn(span_name, F.floor(F.col(number) / span)).repartition(spread, span_name).sortWithinPartitions(span_name, number)
    names = df.columns

    def run(parts):
        def flush(held: list[dict]):
            out: list[str | None] = []
            use = []
            for batch in batches(held, config, parents):
                got, u = ask(provider, batch, batch[0][number], config, parents)
                out += got
                use += [json.dumps(vars(u))] + [None] * (len(batch) - 1)
            return pa.RecordBatch.from_arrays([pa.array([r[number] for r in held], pa.int64()), pa.array(out, pa.string()), pa.array(use, pa.string())], ["n", "answer", "usage"])

        held: list[dict] = []
        last = None
        for b in parts:
            for r in b.to_pylist():
                if held and r[span_name] != last:
                    yield flush(held)
                    held = []
                last = r[span_name]
                held.append(r)
        if held:
            yield flush(held)

    answers = stored(dealt.mapInArrow(run, "n long, answer string, usage string"), "answers")
    usage = Usage()
    keys = list(vars(usage))
    parsed = F.from_json("usage", T.StructType([T.StructField(k, T.LongType()) for k in keys])).alias("u")
    total = answers.where("usage IS NOT NULL").select(parsed).agg(*[F.sum(f"u.{k}").alias(k) for k in keys]).first()
    usage.add(Usage(**{k: int(total[k] or 0) for k in keys}))
    out = rows.join(answers.select(F.col("n").alias(number), F.col("answer").alias(output)), number)
    return out.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{output}`")), usage


def llm_filter(df: DataFrame, config: MapConfig, parents: dict[str, str | None], provider: Provider | None = None) -> tuple[DataFrame, Usage]:
    """The rows of ``df`` for which the model answers true, and the usage. As in a WHERE clause, a missing answer is no match."""
    answer = "#match"
    yes_or_no = {**config.parameters, "response_format": {"schema": {"type": "boolean"}}}
    asked = replace(config, prompt=f"{config.prompt}\nAnswer true for a row that fits and false for one that does not.", parameters=yes_or_no)
    out, usage = llm_map(df, answer, asked, parents, provider)
    return out.where(F.lower(F.trim(F.col(f"`{answer}`"))) == "true").drop(answer), usage
