"""A catalog of named binary relations over tables.

A table is anything Spark reads; a relation (projection) names two of its columns and a cardinality. The cardinality is a
hint for the order of joins; no result depends on it.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import AnalysisError

CARDINALITIES = ("1:1", "1:n", "n:1", "m:n")


def cardinality(text: str) -> str:
    """One of the four cardinalities; ``n:n`` is ``m:n``."""
    c = text.strip().lower()
    c = "m:n" if c == "n:n" else c
    if c not in CARDINALITIES:
        raise AnalysisError(f"unknown cardinality {text!r}")
    return c


@dataclass(frozen=True)
class Column:
    name: str
    index: int
    type: str  # uint64 or string


@dataclass(frozen=True)
class Projection:
    relation: str
    source: int
    target: int
    cardinality: str = "m:n"


@dataclass
class TableMeta:
    """What is known of an ingested table; kept as ``_catalog.json`` beside its Parquet files."""

    name: str
    columns: list[Column]
    projections: list[Projection]
    rows: int = 0
    skipped: int = 0
    fallbacks: int = 0

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2)

    @staticmethod
    def from_json(text: str) -> TableMeta:
        d = json.loads(text)
        return TableMeta(d["name"], [Column(**c) for c in d["columns"]], [Projection(**p) for p in d["projections"]], d["rows"], d["skipped"], d["fallbacks"])


@dataclass(frozen=True)
class Relation:
    name: str
    load: Callable[[], DataFrame] = field(compare=False)
    source: str
    target: str
    cardinality: str = "m:n"

    def edges(self) -> DataFrame:
        """The relation with columns src and dst; integers are longs."""
        df = self.load()
        out = []
        for column, alias in ((self.source, "src"), (self.target, "dst")):
            c = F.col(f"`{column}`")
            out.append((c.cast("long") if isinstance(df.schema[column].dataType, T.IntegralType) else c).alias(alias))
        return df.select(*out)


class Catalog:
    """Relations by name."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._relations: dict[str, Relation] = {}
        self._tables: dict[str, DataFrame] = {}
        self._fan_outs: dict[tuple[str, bool], float] = {}

    def refresh(self) -> None:
        """Forget opened tables, so files written since then are seen."""
        self._tables.clear()
        self._fan_outs.clear()

    def fan_out(self, relation: Relation, from_source: bool) -> float:
        """Edges for each value of one side, on average: one map-side combined pass over that column, once a relation."""
        key = relation.name, from_source
        if key not in self._fan_outs:
            side = F.col("src" if from_source else "dst")
            row = relation.edges().agg(F.count(side).alias("n"), F.approx_count_distinct(side).alias("values")).first()
            self._fan_outs[key] = row["n"] / max(1, row["values"])
        return self._fan_outs[key]

    def names(self) -> list[str]:
        return list(self._relations)

    def relation(self, name: str) -> Relation:
        try:
            return self._relations[name]
        except KeyError:
            raise AnalysisError(f"unknown relation {name!r}; the catalog has {sorted(self._relations)}") from None

    def add(self, name: str, table: DataFrame | Callable[[], DataFrame], source: str, target: str, card: str = "m:n") -> Catalog:
        """Name two columns of a table. The first relation of a name stays."""
        load = table if callable(table) else lambda: table
        self._relations.setdefault(name, Relation(name, load, source, target, cardinality(card)))
        return self

    def add_parquet(self, path: str, **relations: tuple) -> Catalog:
        """``Name=(source, target[, cardinality])`` over a Parquet table."""
        def load() -> DataFrame:
            # a table is opened once, however many relations and atoms name it
            if path not in self._tables:
                self._tables[path] = self.spark.read.parquet(path)
            return self._tables[path]

        for name, (source, target, *card) in relations.items():
            self.add(name, load, source, target, *card)
        return self

    def add_ingested(self, root: str) -> Catalog:
        """Every table below ``root`` that the ingestion wrote, in the order of their names."""
        fs_root = self.spark._jvm.org.apache.hadoop.fs.Path(root)
        fs = fs_root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(fs_root):
            raise AnalysisError(f"no such folder: {root}")
        found = sorted(str(s.getPath()) for s in fs.listStatus(fs_root) if s.isDirectory())
        for folder in [root, *found]:
            meta = self.spark._jvm.org.apache.hadoop.fs.Path(folder, "_catalog.json")
            if fs.exists(meta):
                stream = fs.open(meta)  # Spark's readers skip names that start with "_"
                try:
                    text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
                finally:
                    stream.close()
                self._register(TableMeta.from_json(text), f"{folder}/data")
        return self

    def _register(self, meta: TableMeta, path: str) -> None:
        names = [c.name for c in sorted(meta.columns, key=lambda c: c.index)]
        by_index = {c.index: c.name for c in meta.columns}
        for p in meta.projections:
            if p.source not in by_index or p.target not in by_index:
                raise AnalysisError(f"relation {p.relation!r} names a column that table {meta.name!r} ({', '.join(names)}) does not have")
            self.add_parquet(path, **{p.relation: (by_index[p.source], by_index[p.target], p.cardinality)})

    def add_text(self, path: str, name: str, card: str = "m:n") -> Catalog:
        """A text file of ``src dst`` integers, separated by white space."""
        def load() -> DataFrame:
            parts = F.split(F.trim("value"), r"\s+")
            lines = self.spark.read.text(path).where(F.trim("value").rlike(r"^-?\d+\s+-?\d+"))
            return lines.select(parts[0].cast("long").alias("src"), parts[1].cast("long").alias("dst"))

        return self.add(name, load, "src", "dst", card)

    def add_line(self, line: str) -> Catalog:
        """``/path,Name(v1,_,v2)[,n:1]``: a text file or a Parquet table with its columns 0 and 1 or the named places."""
        path, _, rest = line.partition(",")
        name, _, tail = rest.partition("(")
        inner, closed, after = tail.partition(")")
        if not closed or not name.strip():
            raise AnalysisError(f"not a relation line: {line!r}")
        variables = [v.strip() for v in inner.split(",")]
        named = [i for i, v in enumerate(variables) if v != "_"]
        if len(named) != 2:
            raise AnalysisError(f"a relation line names two variables: {line!r}")
        card = after.strip().lstrip(",").strip() or "m:n"
        path = path.strip()
        if not Path(path).suffix == ".parquet":
            return self.add_text(path, name.strip(), card)
        columns = self.spark.read.parquet(path).columns
        return self.add_parquet(path, **{name.strip(): (columns[named[0]], columns[named[1]], card)})
