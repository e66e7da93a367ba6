"""Delimited text to Parquet tables with a small catalog file.

    python -m weft.sources.ingest <text> <folder> <config>

The configuration has lines ``COLUMN,<name>,<index>,<type>`` and ``PROJECTION,<relation>,<source>,<target>[,<cardinality>]``;
kinds are read without regard to case, blank lines and ``#`` comments are skipped.

Lines of the text are skipped when empty, comments, or short of a configured column. The delimiter is the first of comma,
tab and bar that the first data line has, unless it is given. Quotes open at the start of a field, ``""`` and a backslash
escape inside them, and they close before a delimiter or the end; any other quote is literal. Fields are trimmed. A
text field that is empty, ``NULL`` or ``null`` is NULL; a number that cannot be read is 0 (NULL in strict mode).
"""

from __future__ import annotations

import sys

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import AnalysisError
from .catalog import Column, Projection, TableMeta, cardinality

_TYPES = {"uint64_t": "uint64", "uint64": "uint64", "int": "uint64", "string": "string", "str": "string"}
NULLS = ("", "NULL", "null")


def parse_config(text: str, name: str) -> TableMeta:
    columns: list[Column] = []
    projections: list[Projection] = []
    for n, line in enumerate(text.splitlines(), 1):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        parts = [p.strip() for p in line.split(",")]
        kind = parts[0].upper()
        try:
            if kind == "COLUMN":
                _, column, index, type_ = parts
                if type_ not in _TYPES:
                    raise AnalysisError(f"line {n}: unknown type {type_!r}")
                columns.append(Column(column, int(index), _TYPES[type_]))
            elif kind == "PROJECTION":
                _, relation, source, target, *card = parts
                projections.append(Projection(relation, int(source), int(target), cardinality(card[0]) if card else "m:n"))
            else:
                raise AnalysisError(f"line {n}: unknown record {parts[0]!r}")
        except (ValueError, IndexError) as e:
            if isinstance(e, AnalysisError):
                raise
            raise AnalysisError(f"line {n}: cannot read {line!r}") from None
    if not columns:
        raise AnalysisError("the configuration has no COLUMN line")
    return TableMeta(name, columns, projections or [Projection("default", 0, 1)])


def split_fields(line: str, delimiter: str) -> list[str]:
    """Fields of one line (see the module's docstring for quotes)."""
    out, field, quoted, at, n = [], [], False, 0, len(line)
    start = True
    while at < n:
        c = line[at]
        if quoted:
            if c == "\\" and at + 1 < n:
                field.append(line[at + 1])
                at += 1
            elif c == '"' and at + 1 < n and line[at + 1] == '"':
                field.append('"')
                at += 1
            elif c == '"' and (at + 1 == n or line[at + 1] == delimiter):
                quoted = False
            else:
                field.append(c)
        elif c == delimiter:
            out.append("".join(field).strip())
            field, start = [], True
            at += 1
            continue
        elif c == '"' and start:
            quoted = True
        else:
            field.append(c)
        start = False
        at += 1
    out.append("".join(field).strip())
    return out


def sniff(line: str) -> str:
    return next((d for d in (",", "\t") if d in line), "|")


def read_text(spark: SparkSession, path: str, meta: TableMeta, delimiter: str | None = None, strict: bool = False) -> DataFrame:
    """The configured columns and a count of what could not be read in each row (``_fallbacks``; -1: the row is short)."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    if delimiter is None:
        first = lines.limit(1).collect()
        delimiter = sniff(first[0]["value"]) if first else ","
    if len(delimiter) != 1:
        raise AnalysisError("the delimiter is one character")
    need = max(c.index for c in meta.columns) + 1

    @F.pandas_udf("array<string>")
    def fields(values: pd.Series) -> pd.Series:
        return values.map(lambda v: split_fields(v.rstrip("\r"), delimiter))

    # a line without quotes needs no Python: both branches give the same fields
    plain = F.transform(F.split(F.rtrim("value"), f"\\Q{delimiter}\\E", -1), lambda x: F.trim(x))
    quoted = lines.where(F.col("value").contains('"')).select(fields("value").alias("f"))
    rows = lines.where(~F.col("value").contains('"')).select(plain.alias("f")).union(quoted)
    long_enough = F.size("f") >= need
    out, bad = [], []
    for c in meta.columns:
        raw = F.get("f", F.lit(c.index))
        if c.type == "string":
            out.append(F.when(~raw.isin(*NULLS), raw).alias(c.name))
        else:
            number = F.when(raw.rlike(r"^[+-]?\d+"), F.regexp_extract(raw, r"^[+-]?\d+", 0)).try_cast("long")
            out.append((number if strict else F.coalesce(number, F.lit(0))).alias(c.name))
            bad.append(number.isNull().cast("int"))
    fallbacks = F.when(long_enough, sum(bad, F.lit(0))).otherwise(F.lit(-1))
    return rows.select(*out, fallbacks.alias("_fallbacks"))


def ingest(spark: SparkSession, path: str, folder: str, config: str, delimiter: str | None = None, strict: bool = False) -> TableMeta:
    """Write ``<folder>/data`` (Parquet) and ``<folder>/_catalog.json``; returns what was found. ``config`` is its text."""
    meta = parse_config(config, folder.rstrip("/").rsplit("/", 1)[-1])
    rows = read_text(spark, path, meta, delimiter, strict)
    names = [c.name for c in sorted(meta.columns, key=lambda c: c.index)]
    seen = rows.agg(F.sum((F.col("_fallbacks") >= 0).cast("long")).alias("n"), F.sum((F.col("_fallbacks") < 0).cast("long")).alias("short"), F.sum(F.greatest("_fallbacks", F.lit(0))).alias("bad")).first()
    rows.where("_fallbacks >= 0").select(*names).write.mode("overwrite").parquet(f"{folder}/data")
    meta.rows, meta.skipped, meta.fallbacks = (int(seen[k] or 0) for k in ("n", "short", "bad"))
    target = spark._jvm.org.apache.hadoop.fs.Path(folder, "_catalog.json")
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(meta.to_json().encode()))
    finally:
        out.close()
    return meta


def main(args: list[str]) -> int:
    if len(args) != 3:
        print(__doc__.split("\n\n")[1].strip(), file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("weft-ingest").getOrCreate()
    config = "\n".join(r["value"] for r in spark.read.text(args[2], wholetext=True).collect())
    meta = ingest(spark, args[0], args[1], config)
    print(f"{meta.rows} rows, {meta.skipped} skipped, {meta.fallbacks} numbers read as 0")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
