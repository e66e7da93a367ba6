"""Counts and minima of acyclic rules without expanding their tuples.

A rule whose atoms form a tree is counted from the leaves to a root: each subtree is one (key, weight) table, which is the
relation joined with its child's table and summed by the parent's key. Every intermediate result is at most as large as a
relation, and sums are combined before they are shuffled, so a hub with millions of neighbours costs what its edges cost.
A minimum is found in the same tree with semi-joins in the place of sums.

What does not fit (cycles, omitted variables, predicates that link different atoms, an LLM step) is left to the plain plan.
Sums are 64-bit and overflow is an error, unless ``wide`` asks for DECIMAL(38).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import to_column
from .translate import Translator, _column, _has_anti
from .tree import Predicate, attributes


@dataclass
class Edge:
    ends: tuple[str, str]
    data: DataFrame  # the two variables


def tree_of(t: Translator) -> list[Edge] | None:
    """Filtered relations of an acyclic rule by pairs of variables; None if it is not acyclic or has other predicates."""
    bound = t.bound
    if bound.omitted or bound.config:
        return None
    loops = [a for a in bound.atoms if a.atom.source == a.atom.target]
    plain = [a for a in bound.atoms if a.atom.source != a.atom.target]
    pairs = [frozenset(a.atom.variables) for a in plain]
    if loops or not plain or len(set(pairs)) < len(pairs):
        return None
    group = {v: v for v in bound.rule.variables}

    def root(v: str) -> str:
        while group[v] != v:
            v = group[v]
        return v

    for a in plain:
        x, y = root(a.atom.source), root(a.atom.target)
        if x == y:
            return None
        group[x] = y
    if len({root(v) for v in group}) > 1:
        return None
    own: dict[frozenset, list[Predicate]] = {}
    for p in t.rest:
        at = frozenset(attributes(p))
        if at not in pairs or _has_anti(p):
            return None
        own.setdefault(at, []).append(p)
    edges = []
    for a, at in zip(plain, pairs):
        df = t.relation(a)
        for p in own.get(at, ()):
            df = df.where(to_column(p, _column))
        edges.append(Edge((a.atom.source, a.atom.target), df))
    return edges


def number(wide: bool) -> str:
    return "decimal(38,0)" if wide else "bigint"


def branches(edges: list[Edge], v: str, come: Edge | None) -> list[tuple[Edge, str]]:
    """The edges at ``v`` but the one that was come by, and their other ends."""
    return [(e, e.ends[1] if e.ends[0] == v else e.ends[0]) for e in edges if e is not come and v in e.ends]


def weighted(df: DataFrame, below: list[DataFrame], key: str, out: str, wide: bool, own: str | None = None) -> DataFrame:
    """``df`` with the product of the weights that ``below`` has for its keys (and of its column ``own``)."""
    factors = [F.col(own)] if own else []
    for i, b in enumerate(below):
        df = df.join(b.withColumnRenamed("#w", f"#w{i}"), key)
        factors.append(F.col(f"#w{i}"))
    product = factors[0] if factors else F.lit(1)
    for x in factors[1:]:
        product = (product * x).cast(number(wide))
    return df.withColumn(out, product.cast(number(wide)))


def branch(edges: list[Edge], v: str, e: Edge, child: str, wide: bool) -> DataFrame:
    """(v, #w) of what hangs below ``v`` by the edge ``e``."""
    below = weights(edges, child, e, wide)
    if not below:
        return e.data.groupBy(v).agg(F.count(F.lit(1)).cast(number(wide)).alias("#w"))
    return weighted(e.data, below, child, "#p", wide).groupBy(v).agg(F.sum("#p").cast(number(wide)).alias("#w"))


def weights(edges: list[Edge], v: str, come: Edge | None, wide: bool) -> list[DataFrame]:
    """Of each branch below ``v``: (v, #w)."""
    return [branch(edges, v, e, child, wide) for e, child in branches(edges, v, come)]


def count(edges: list[Edge], wide: bool = False) -> DataFrame:
    """One row, ``count``: the number of tuples."""
    # the root: the variable with the most relations, so that the tree is flat
    names = dict.fromkeys(x for e in edges for x in e.ends)
    root = max(names, key=lambda v: sum(v in e.ends for e in edges))
    first, *rest = weights(edges, root, None, wide)
    df = weighted(first, rest, root, "#total", wide, "#w")
    return df.agg(F.coalesce(F.sum("#total"), F.lit(0)).cast(number(wide)).alias("count"))


def minima(edges: list[Edge], names: tuple[str, ...]) -> DataFrame:
    """One row with ``min_<name>`` for every name; all NULL if there is no tuple."""

    def values(v: str, come: Edge | None) -> list[DataFrame]:
        """Of each branch below ``v``: the values of ``v`` that have a tuple there."""
        out = []
        for e, child in branches(edges, v, come):
            df = e.data
            for b in values(child, e):
                df = df.join(b, child, "left_semi")
            out.append(df.select(_column(v)))
        return out

    result = None
    for name in names:
        first, *rest = values(name, None)
        for b in rest:
            first = first.join(b, name, "left_semi")
        one = first.agg(F.min(_column(name)).alias(f"min_{name}"))
        result = one if result is None else result.crossJoin(one)  # one row each
    return result
