"""The engine: a rule in, a DataFrame out."""

from __future__ import annotations

import sys
import time
from dataclasses import dataclass
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import AnalysisError
from .operators.sinks import Sink, export
from .plans import differences, factorized
from .plans.analyzer import BoundRule, analyze, orderings
from .plans.parser import parse_rule
from .plans.translate import Translator, _column
from .plans.tree import attributes
from .semantic.map_step import llm_map
from .semantic.providers import Provider, Usage
from .sources.catalog import Catalog


@dataclass
class Report:
    """What running a rule found."""

    kind: str
    rows: int
    value: tuple | None
    seconds: float
    usage: Usage


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Settings that suit join-heavy rules: adaptive plans, skew joins, Bloom filters on shuffled joins."""
    for k, v in {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }.items():
        builder = builder.config(k, v)
    return builder


class Engine:
    """Runs rules over a catalog.

    ``ordering`` of the methods is the column ordering: the order of the joins, of the result's columns, and the choice of
    variables: those it omits only have to exist. Without one every variable is enumerated.
    """

    def __init__(self, catalog: Catalog, provider: Provider | None = None):
        self.catalog = catalog
        self.provider = provider
        self.usage = Usage()

    def bind(self, rule: str, ordering: str | list[str] | None = None, allow_cross: bool = False) -> BoundRule:
        return analyze(parse_rule(rule), self.catalog, ordering, allow_cross)

    def orderings(self, rule: str) -> list[list[str]]:
        return orderings(parse_rule(rule))

    def query(self, rule: str, ordering: str | list[str] | None = None, *, columns: str = "head", rewrite: bool = True, wide: bool = False, allow_cross: bool = False) -> DataFrame:
        """The result of a rule.

        count: one row ``count``. min: one row ``min_<attribute>``. noop: no columns of interest, the tuples. project: the
        head's attributes, or with ``columns="ordering"`` all of the ordering. ``rewrite`` allows the factorized plans.
        """
        bound = self.bind(rule, ordering, allow_cross)
        translator = Translator(bound, self.catalog)
        kind = bound.rule.head.kind
        if rewrite and kind == "count" and (found := differences.count(bound, self.catalog, wide)) is not None:
            return found
        if rewrite and kind == "min" and (edges := factorized.tree_of(translator)):
            return factorized.minima(edges, bound.rule.head.attributes)
        df = self._mapped(bound, translator) if bound.config else translator.tuples()
        if kind == "count":
            return df.agg(F.count(F.lit(1)).alias("count"))
        if kind == "min":
            return df.agg(*[F.min(_column(a)).alias(f"min_{a}") for a in bound.rule.head.attributes])
        if kind == "project":
            names = (bound.ordering or [*bound.kept, *([bound.rule.llm.output] if bound.rule.llm else [])]) if columns == "ordering" else bound.rule.head.attributes
            return df.select(*map(_column, names))
        return df

    def explain(self, rule: str, ordering: str | list[str] | None = None, **options) -> str:
        """The physical plan of a rule, as Spark formats it."""
        df = self.query(rule, ordering, **options)
        return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")

    def _mapped(self, bound: BoundRule, translator: Translator) -> DataFrame:
        """Join what comes before the LLM output, map, join the rest."""
        before, output = set(bound.llm_after), bound.rule.llm.output
        kept, hidden = translator.split()
        first = [a for a in kept if set(a.atom.variables) <= before]
        later = [a for a in kept if a not in first]
        pending = list(translator.rest)
        ranks = bound.kept
        df = translator.join(None, first, ranks, pending) if first else translator.domain(bound.llm_after[0])
        for v in bound.llm_after:
            if v not in df.columns:
                df = df.crossJoin(translator.domain(v)) if not first else df
        missing = [v for v in bound.llm_after if v not in df.columns]
        if missing:
            raise AnalysisError(f"{', '.join(missing)}: no relation joins what comes before {output!r}")
        if not later:  # nothing follows: existential and remaining predicates first, so fewer tuples are asked about
            df = translator.finish(df, hidden, pending)
            pending, hidden = [], []
        df, usage = llm_map(df.select(*map(_column, bound.llm_after)), output, bound.config, self.parents(bound), self.provider)
        self.usage.add(usage)
        if not later and not hidden:
            return df
        df = translator.join(df, later, ranks, pending)
        if hidden or any(attributes(p) & set(bound.omitted) for p in pending):
            df = translator.semi_joins(df, hidden, pending)
        for p in pending:
            df = translator.apply(df, p)
        return df

    @staticmethod
    def parents(bound: BoundRule) -> dict[str, str | None]:
        """The tree of the variables before the LLM step: each hangs below an earlier one that it shares an atom with."""
        out: dict[str, str | None] = {}
        for v in bound.llm_after:
            near = [u for a in bound.atoms if v in a.atom.variables for u in a.atom.variables if u in out]
            out[v] = (near[-1] if near else next(iter(out))) if out else None
        return out

    def run(self, rule: str, ordering: str | list[str] | None = None, sink: str = "packed", preview: TextIO | None = None, **options) -> Report:
        """Run a rule into a sink."""
        target = Sink.parse(sink)
        kind = parse_rule(rule).head.kind
        target.check(kind)
        began = time.monotonic()
        self.usage = Usage()
        value, rows = None, 0
        if target.exports:
            df = self.query(rule, ordering, columns=options.pop("columns", "ordering" if ordering else "head"), **options)
            rows = export(df, target, self.usage, preview)
        elif kind == "noop" or target.kind in ("pnoop", "upnoop"):
            self.query(rule, ordering, **options).write.format("noop").mode("overwrite").save()
        elif kind in ("count", "min"):
            value = tuple(self.query(rule, ordering, **options).first())
            rows = value[0] if kind == "count" else 1
        else:
            rows = self.query(rule, ordering, **options).count()
        return Report(kind, rows, value, time.monotonic() - began, self.usage)


def print_report(report: Report, out: TextIO | None = None) -> None:
    out = out or sys.stdout
    print("== what the rule found ==", file=out)
    if report.kind == "min":
        print("min: " + ", ".join("NULL" if v is None else str(v) for v in report.value or ()), file=out)
    else:
        print(f"tuples: {report.rows}", file=out)
    print(f"seconds: {report.seconds:.3f}", file=out)
    for k, v in report.usage.as_dict().items():
        if v:
            print(f"{k}: {v}", file=out)
