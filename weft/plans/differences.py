"""Counts of acyclic rules with predicates between atoms, as sums and differences of counts that need no expansion.

A predicate that links variables of different atoms would force the plain plan to build every tuple before it can judge it:
all pairs of the members of a hub. For a count that is not needed:

- an OR is counted by inclusion and exclusion of its parts;
- NOTEXISTS(a,b,R) is the count without it less the count with the distinct edges of R as one more atom, which closes a
  cycle and is joined on two keys;
- ``a <> b`` is the count of tuples in which neither is NULL less the count with ``a = b``;
- ``a = b`` makes both one variable;
- ``a < b`` of two neighbours of one variable x is a sum over b of the weight of smaller a at the same x: running sums over
  ranges of (x, value), so that a hub is dealt to as many tasks as it needs.

The ranges of a comparison by size are stored in the shared folder when the count is built, so that a retried task finds them as
they were. What fits none of these (two comparisons by size, other paths, more than ``MOST`` terms) is left to the plain plan.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.catalog import Catalog
from ..sources.storage import stored
from . import factorized
from .analyzer import BoundAtom, BoundRule
from .translate import Translator, _column, _has_anti
from .tree import And, Atom, Compare, Name, NotExists, Null, Or, Predicate, attributes, conjuncts

MOST = 16

Terms = list[tuple[int, DataFrame]]


def count(bound: BoundRule, catalog: Catalog, wide: bool = False) -> DataFrame | None:
    """One row, ``count``; None if the rule does not fit."""
    if bound.omitted or bound.config:
        return None
    terms = _terms(bound, catalog, wide, False)
    if terms is None or len(terms) > MOST:
        return None
    if len(terms) == 1:
        return terms[0][1]
    signed = [df.select((F.col("count") * F.lit(sign)).alias("count")) for sign, df in terms]
    return reduce(DataFrame.union, signed).agg(F.sum("count").cast(factorized.number(wide)).alias("count"))


def _where(bound: BoundRule, parts: list[Predicate], atoms: list[BoundAtom] | None = None) -> BoundRule:
    """The rule with other predicates, and other atoms."""
    atoms = bound.atoms if atoms is None else atoms
    where = And(tuple(parts)) if parts else None
    rule = replace(bound.rule, atoms=tuple(a.atom for a in atoms), where=where)
    types = {v: t for a in atoms for v, t in zip((a.atom.source, a.atom.target), (a.source_type, a.target_type))}
    return replace(bound, rule=rule, atoms=atoms, types=types, where=where, ordering=None, kept=rule.variables)


def _terms(bound: BoundRule, catalog: Catalog, wide: bool, closed: bool) -> Terms | None:
    """Signed counts; ``closed``: a step before may have closed a cycle, the plain plan of which is meant."""
    t = Translator(bound, catalog)
    pairs = {frozenset(a.atom.variables) for a in bound.atoms}
    others = [p for p in t.rest if _has_anti(p) or frozenset(attributes(p)) not in pairs]
    every = conjuncts(bound.where)
    edges = factorized.tree_of(Translator(_where(bound, [p for p in every if p not in others]), catalog))
    if edges is None:
        return [(1, t.tuples().agg(F.count(F.lit(1)).cast(factorized.number(wide)).alias("count")))] if closed else None
    if not others:
        return [(1, factorized.count(edges, wide))]
    p = min(others, key=_rank)
    rest = [q for q in every if q != p]

    def added(sign: int, parts: list[Predicate], atoms: list[BoundAtom] | None = None, closes: bool = False) -> Terms | None:
        found = _terms(_where(bound, parts, atoms), catalog, wide, closed or closes)
        return None if found is None else [(sign * s, df) for s, df in found]

    match p:
        case Or(parts):
            if 2 ** len(parts) > MOST:
                return None
            return _all(added(-1 if n % 2 == 0 else 1, [*rest, *(c for x in some for c in conjuncts(x))]) for n in range(1, len(parts) + 1) for some in combinations(parts, n))
        case NotExists(source, target, name):
            relation = catalog.relation(name)
            once = replace(relation, name=f"#{name}", load=lambda: relation.edges().distinct(), source="src", target="dst")
            atom = BoundAtom(Atom(once.name, source, target), once, bound.types[source], bound.types[target])
            return _all([added(1, rest), added(-1, rest, [*bound.atoms, atom], True)])
        case Compare("!=", left, Name(right)):
            return _all([added(1, [*rest, Null(left, True), Null(right, True)]), added(-1, [*rest, Compare("=", left, Name(right))], None, True)])
        case Compare("=", left, Name(right)) if bound.types[left] == bound.types[right]:
            swap = lambda v: left if v == right else v
            atoms = [replace(a, atom=Atom(a.atom.relation, swap(a.atom.source), swap(a.atom.target))) for a in bound.atoms]
            return added(1, [_renamed(q, swap) for q in rest], atoms, True)
        case Compare("<" | "<=" | ">" | ">=" as op, left, Name(right)) if len(others) == 1:
            low, high = (left, right) if op[0] == "<" else (right, left)
            found = _ranked(edges, low, high, len(op) == 1, wide)
            return None if found is None else [(1, found)]
    return None


def _rank(p: Predicate) -> int:
    if isinstance(p, Or):
        return 0
    return 1 if isinstance(p, NotExists) else {"!=": 2, "=": 3}.get(getattr(p, "op", ""), 4)


def _all(found) -> Terms | None:
    out: Terms = []
    for terms in found:
        if terms is None or len(out) + len(terms) > MOST:
            return None
        out += terms
    return out


def _renamed(p: Predicate, name) -> Predicate:
    match p:
        case And(parts):
            return And(tuple(_renamed(x, name) for x in parts))
        case Or(parts):
            return Or(tuple(_renamed(x, name) for x in parts))
        case Compare(op, left, Name(right)):
            return Compare(op, name(left), Name(name(right)))
        case Compare(op, left, right):
            return Compare(op, name(left), right)
        case NotExists(source, target, relation):
            return NotExists(name(source), name(target), relation)
        case _:
            return replace(p, attribute=name(p.attribute))


def _ranked(edges: list[factorized.Edge], low: str, high: str, strict: bool, wide: bool) -> DataFrame | None:
    """The count with ``low`` < ``high`` (<= if not strict) for two neighbours of one variable."""
    found = [(e, f, (set(e.ends) & set(f.ends)).pop()) for e in edges for f in edges if e is not f and low in e.ends and high in f.ends and set(e.ends) - {low} == set(f.ends) - {high}]
    if not found:
        return None
    below, above, at = found[0]
    number = factorized.number(wide)

    def side(e: factorized.Edge, v: str) -> DataFrame:
        df = factorized.weighted(e.data.where(_column(v).isNotNull() & _column(at).isNotNull()), factorized.weights(edges, v, e, wide), v, "#v", wide)
        return df.select(_column(at).alias("#x"), _column(v).alias("#value"), F.col("#v").alias("#w"))

    zero = F.lit(0).cast(number)
    rows = side(below, low).select("#x", "#value", F.col("#w").alias("#a"), zero.alias("#b")).union(side(above, high).select("#x", "#value", zero, "#w"))
    rows = rows.groupBy("#x", "#value").agg(F.sum("#a").cast(number).alias("#a"), F.sum("#b").cast(number).alias("#b"))
    # stored, so that the numbers of the ranges stay what they are
    rows = stored(rows.repartitionByRange("#x", "#value").withColumn("#part", F.spark_partition_id()), "ranks")
    # a variable that goes on over several ranges brings the sum of those before
    sums = rows.groupBy("#part", "#x").agg(F.sum("#a").cast(number).alias("#sum"))
    before = Window.partitionBy("#x").orderBy("#part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("#part", "#x", F.coalesce(F.sum("#sum").over(before), zero).cast(number).alias("#before"))
    inside = Window.partitionBy("#part", "#x").orderBy("#value").rowsBetween(Window.unboundedPreceding, -1 if strict else Window.currentRow)
    smaller = (F.coalesce(F.sum("#a").over(inside), zero) + F.col("#before")).cast(number)
    pairs = rows.join(sums, ["#part", "#x"]).select("#x", (F.col("#b") * smaller).cast(number).alias("#w")).where("`#w` <> 0")
    others = [b for e, child in factorized.branches(edges, at, None) if e is not below and e is not above for b in [factorized.branch(edges, at, e, child, wide)]]
    total = factorized.weighted(pairs.withColumnRenamed("#x", at), others, at, "#total", wide, "#w")
    return total.agg(F.coalesce(F.sum("#total"), zero).cast(number).alias("count"))
