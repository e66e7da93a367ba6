"""Where results go: counters, minima, nothing, or CSV, JSON and Markdown files.

Export files are single files, written by streaming partitions through the driver one by one. For results that no one
file should hold, write the DataFrame with Spark's own writers.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
from collections.abc import Iterable
from dataclasses import dataclass
from typing import TextIO

from pyspark.sql import DataFrame

from ..errors import AnalysisError
from ..semantic.providers import Usage

SINKS = ("packed", "unpacked", "min", "pnoop", "upnoop", "sink_csv", "sink_json", "sink_markdown")
#: Path of exports whose sink names none.
PATH_VARIABLE = "WEFT_OUTPUT"
#: Rows that a preview prints.
PREVIEW = 20


@dataclass(frozen=True)
class Sink:
    kind: str
    path: str | None = None

    @property
    def exports(self) -> bool:
        return self.kind.startswith("sink_")

    @staticmethod
    def parse(text: str) -> Sink:
        kind, _, path = text.partition(":")
        if kind not in SINKS:
            raise AnalysisError(f"unknown sink {kind!r}; one of {', '.join(SINKS)}")
        sink = Sink(kind, path or None)
        if path and not sink.exports:
            raise AnalysisError(f"sink {kind!r} takes no path")
        return sink

    def check(self, head: str) -> None:
        """``min`` goes with a MIN head and the other way round."""
        if (self.kind == "min") != (head == "min"):
            raise AnalysisError("a MIN head needs the sink 'min', and only it" if head == "min" else "the sink 'min' needs a MIN head")

    def target(self) -> str | None:
        return self.path or os.environ.get(PATH_VARIABLE) or None


def csv_cell(value) -> str:
    text = "" if value is None else str(value)
    if any(c in text for c in '",\n\r'):
        return '"' + text.replace('"', '""') + '"'
    return text


def write_csv(out: TextIO, names: list[str], rows: Iterable[tuple]) -> int:
    n = 0
    out.write(",".join(map(csv_cell, names)) + "\n")
    for n, row in enumerate(rows, 1):
        out.write(",".join(map(csv_cell, row)) + "\n")
    return n


def write_json(out: TextIO, names: list[str], rows: Iterable[tuple]) -> int:
    """An array of objects; strings quoted, numbers bare."""
    n = 0
    out.write("[")
    for n, row in enumerate(rows, 1):
        out.write((",\n" if n > 1 else "\n") + "  " + json.dumps(dict(zip(names, row)), ensure_ascii=False, default=str))
    out.write("\n]\n")
    return n


def write_markdown(out: TextIO, names: list[str], rows: Iterable[tuple]) -> int:
    """A padded table; the widths are known after the last row, so rows wait in a temporary file of the driver."""
    widths = [len(n) for n in names]

    def line(values) -> str:
        return "|" + "".join(f" {v.ljust(w)} |" for v, w in zip(values, widths)) + "\n"

    n = 0
    with tempfile.TemporaryFile("w+", encoding="utf-8") as held:
        for n, row in enumerate(rows, 1):
            cells = ["" if v is None else str(v) for v in row]
            widths = [max(w, len(c)) for w, c in zip(widths, cells)]
            held.write(json.dumps(cells) + "\n")
        held.seek(0)
        out.write(line(names) + "|" + "".join(f"{'-' * (w + 2)}|" for w in widths) + "\n")
        for text in held:
            out.write(line(json.loads(text)))
    return n


_WRITERS = {"sink_csv": write_csv, "sink_json": write_json, "sink_markdown": write_markdown}


def export(df: DataFrame, sink: Sink, usage: Usage | None = None, preview: TextIO | None = None) -> int:
    """Write the result; returns its rows. Without a path a preview is printed. ``metrics.json`` goes beside the file."""
    path = sink.target()
    if path is None:
        rows = [tuple(r) for r in df.limit(PREVIEW).collect()]
        return write_markdown(preview or sys.stdout, df.columns, rows)
    folder = os.path.dirname(path) or "."
    os.makedirs(folder, exist_ok=True)
    part = f"{path}.part"
    with open(part, "w", encoding="utf-8", newline="") as out:
        n = _WRITERS[sink.kind](out, df.columns, (tuple(r) for r in df.toLocalIterator()))
    os.replace(part, path)
    with open(os.path.join(folder, "metrics.json"), "w") as out:
        json.dump((usage or Usage()).as_dict(), out, indent=2)
    return n
