"""Bound rules as DataFrames.

Atoms become inner equi-joins on every variable they share with what is joined so far: an atom that closes a cycle joins on two
keys. Predicates of one variable filter the relations before they are joined (and so reach the scan); the others are
applied as soon as their variables are bound, where Catalyst makes them part of the join. Omitted variables become
semi-joins, NOTEXISTS anti-joins. Which side is broadcast is left to Spark's size estimates and adaptive execution.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import to_column
from ..sources.catalog import Catalog
from .analyzer import BoundAtom, BoundRule
from .tree import And, NotExists, Or, Predicate, attributes, conjuncts


def _has_anti(p: Predicate) -> bool:
    return isinstance(p, NotExists) or (isinstance(p, And | Or) and any(map(_has_anti, p.parts)))


def _column(name: str) -> Column:
    return F.col(f"`{name}`")


class Translator:
    def __init__(self, bound: BoundRule, catalog: Catalog):
        self.bound = bound
        self.catalog = catalog
        self.rest = conjuncts(bound.where)
        # filters of one variable go to every relation that binds it
        self.scalar: dict[str, list[Predicate]] = {}
        for p in [p for p in self.rest if len(attributes(p)) == 1 and not _has_anti(p)]:
            self.scalar.setdefault(next(iter(attributes(p))), []).append(p)
            self.rest.remove(p)

    # -- relations

    def relation(self, a: BoundAtom) -> DataFrame:
        """An atom's relation with its variables as columns, filtered."""
        edges = a.relation.edges()
        if a.atom.source == a.atom.target:
            df = edges.where(F.col("src") == F.col("dst")).select(F.col("src").alias(a.atom.source))
        else:
            df = edges.select(F.col("src").alias(a.atom.source), F.col("dst").alias(a.atom.target))
        return self.filtered(df)

    def filtered(self, df: DataFrame) -> DataFrame:
        for v in df.columns:
            for p in self.scalar.get(v, ()):
                df = df.where(to_column(p, _column))
        return df

    # -- joins

    def order(self, atoms: list[BoundAtom], ranks: list[str], bound: set[str] = frozenset()) -> list[BoundAtom]:
        """Atoms in the order of their joins; each shares a variable with earlier ones as long as there is one that does.

        A column ordering decides alone. Without one, atoms of which both variables are bound come first, as they only filter,
        then those that add at most one partner by their cardinality. If several of a cyclic rule are left, the one that
        adds the fewest partners on average is next, so that a cycle is closed before a hub is expanded.
        """
        rank = {v: i for i, v in enumerate(ranks)}
        left, out, seen = list(atoms), [], set(bound)
        cyclic = len(self.bound.atoms) >= len(self.bound.rule.variables)

        def place(a: BoundAtom) -> int:
            return max(rank.get(v, len(rank)) for v in a.atom.variables)

        while left:
            near = [a for a in left if seen & set(a.atom.variables)] or left
            if seen and self.bound.ordering is None:
                near = [a for a in near if set(a.atom.variables) <= seen] or [a for a in near if self._lookup(a, seen)] or near
                if cyclic and len(near) > 1 and not set(near[0].atom.variables) <= seen and not self._lookup(near[0], seen):
                    fan = {id(a): self.catalog.fan_out(a.relation, a.atom.source in seen) for a in near}
                    near = [a for a in near if fan[id(a)] == min(fan.values())]
            best = min(near, key=place)
            left.remove(best)
            out.append(best)
            seen |= set(best.atom.variables)
        return out

    @staticmethod
    def _lookup(a: BoundAtom, seen: set[str]) -> bool:
        """Whether each bound value has one partner at most, by the relation's cardinality."""
        one, many = a.relation.cardinality.split(":")
        return (a.atom.source in seen and many == "1") or (a.atom.target in seen and one == "1")

    def join(self, df: DataFrame | None, atoms: list[BoundAtom], ranks: list[str], pending: list[Predicate]) -> DataFrame:
        """``df`` joined with the atoms; pending predicates are applied, and taken from the list, once they are bound."""
        for a in self.order(atoms, ranks, set(df.columns) if df is not None else frozenset()):
            right = self.relation(a)
            if df is None:
                df = right
            else:
                keys = [v for v in a.atom.variables if v in df.columns]
                df = df.join(right, keys, "inner") if keys else df.crossJoin(right)
            for p in [p for p in pending if attributes(p) <= set(df.columns)]:
                df = self.apply(df, p)
                pending.remove(p)
        return df

    # -- predicates

    def apply(self, df: DataFrame, p: Predicate) -> DataFrame:
        if isinstance(p, NotExists):
            edges = self.catalog.relation(p.relation).edges().select(F.col("src").alias("#s"), F.col("dst").alias("#d"))
            return df.join(edges, (_column(p.source) == F.col("#s")) & (_column(p.target) == F.col("#d")), "left_anti")
        if not _has_anti(p):
            return df.where(to_column(p, _column))
        # inside a disjunction an anti-join is a flag from a left join with the distinct edges
        flags: dict[NotExists, str] = {}
        columns = df.columns
        for i, n in enumerate(_anti_parts(p)):
            flag, s, d = f"#flag{i}", f"#s{i}", f"#d{i}"
            edges = self.catalog.relation(n.relation).edges().distinct().select(F.col("src").alias(s), F.col("dst").alias(d), F.lit(True).alias(flag))
            df = df.join(edges, (_column(n.source) == F.col(s)) & (_column(n.target) == F.col(d)), "left")
            flags[n] = flag
        return df.where(to_column(p, _column, lambda n: F.col(flags[n]).isNull())).select(*map(_column, columns))

    # -- omitted variables

    def semi_joins(self, df: DataFrame, atoms: list[BoundAtom], pending: list[Predicate]) -> DataFrame:
        """Keep the tuples for which the omitted variables have values: one semi-join for each connected group of them."""
        hidden = set(self.bound.omitted)
        groups: list[tuple[set[str], list[BoundAtom], list[Predicate]]] = []

        def take(names: set[str], atom: BoundAtom | None, p: Predicate | None) -> None:
            touching = [g for g in groups if g[0] & names]
            merged = (set(names).union(*(g[0] for g in touching)), [a for g in touching for a in g[1]] + ([atom] if atom else []), [q for g in touching for q in g[2]] + ([p] if p else []))
            groups[:] = [g for g in groups if g not in touching] + [merged]

        for a in atoms:
            take(hidden & set(a.atom.variables), a, None)
        for p in [p for p in pending if attributes(p) & hidden]:
            pending.remove(p)
            take(attributes(p) & hidden, None, p)
        for names, group, predicates in groups:
            if any(map(_has_anti, predicates)):
                # the predicate needs the tuple and the omitted values side by side
                tagged = df.withColumn("#tuple", F.monotonically_increasing_id())
                wide = self.join(tagged, group, [], predicates)
                df = tagged.join(wide.select("#tuple"), "#tuple", "left_semi").drop("#tuple")
                continue
            side = self.join(None, group, [], predicates)
            keys = [c for c in side.columns if c not in names]
            side = side.withColumnsRenamed({c: f"#x_{c}" for c in side.columns})
            own = set(side.columns)
            condition = [_column(k) == _column(f"#x_{k}") for k in keys]
            condition += [to_column(p, lambda v: _column(f"#x_{v}" if f"#x_{v}" in own else v)) for p in predicates]
            df = df.join(side, reduce(lambda a, b: a & b, condition, F.lit(True)), "left_semi")
        return df

    # -- tuples

    def split(self) -> tuple[list[BoundAtom], list[BoundAtom]]:
        """Atoms of kept variables alone, and atoms with omitted ones."""
        hidden = set(self.bound.omitted)
        return [a for a in self.bound.atoms if not hidden & set(a.atom.variables)], [a for a in self.bound.atoms if hidden & set(a.atom.variables)]

    def tuples(self) -> DataFrame:
        """One row for every tuple of the kept variables."""
        kept, hidden = self.split()
        pending = list(self.rest)
        ranks = self.bound.kept
        if kept:
            df = self.join(None, kept, ranks, pending)
        else:
            # every atom has an omitted variable: the domain is what the first kept variable takes anywhere
            df = self.domain(ranks[0])
        for v in ranks:
            if v not in df.columns:
                df = df.crossJoin(self.domain(v))
        return self.finish(df, hidden, pending)

    def domain(self, v: str) -> DataFrame:
        """Distinct values of a variable that no kept atom binds."""
        found = [self.relation(a).select(_column(v)) for a in self.bound.atoms if v in a.atom.variables]
        return reduce(lambda a, b: a.join(b, v, "left_semi"), found).distinct()

    def finish(self, df: DataFrame, hidden: list[BoundAtom], pending: list[Predicate]) -> DataFrame:
        if hidden or any(attributes(p) & set(self.bound.omitted) for p in pending):
            df = self.semi_joins(df, hidden, pending)
        for p in pending:
            df = self.apply(df, p)
        return df.select(*map(_column, self.bound.kept))


def _anti_parts(p: Predicate) -> list[NotExists]:
    if isinstance(p, NotExists):
        return [p]
    if isinstance(p, And | Or):
        return list(dict.fromkeys(n for x in p.parts for n in _anti_parts(x)))
    return []
