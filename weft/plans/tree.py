"""Syntax tree of a rule."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Atom:
    """``relation(source, target)``: a binary relation with a variable for each side."""

    relation: str
    source: str
    target: str

    @property
    def variables(self) -> tuple[str, ...]:
        return (self.source,) if self.source == self.target else (self.source, self.target)


@dataclass(frozen=True)
class Literal:
    value: int | str
    #: The digits of a number with a fraction: no integer column can equal it.
    decimal: str | None = None

    @property
    def is_text(self) -> bool:
        return isinstance(self.value, str) and self.decimal is None


@dataclass(frozen=True)
class Name:
    """An attribute as the right operand of a comparison."""

    name: str


@dataclass(frozen=True)
class Compare:
    op: str  # = != < > <= >=
    left: str
    right: Literal | Name


@dataclass(frozen=True)
class In:
    attribute: str
    values: tuple[Literal, ...]
    negated: bool = False


@dataclass(frozen=True)
class Between:
    attribute: str
    low: Literal
    high: Literal


@dataclass(frozen=True)
class Null:
    attribute: str
    negated: bool = False


@dataclass(frozen=True)
class Like:
    attribute: str
    pattern: str
    negated: bool = False


@dataclass(frozen=True)
class NotExists:
    """No edge from ``source`` to ``target`` in ``relation`` (found by the analyzer if not named)."""

    source: str
    target: str
    relation: str | None = None


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


Predicate = Compare | In | Between | Null | Like | NotExists | And | Or


def attributes(p: Predicate | None) -> set[str]:
    """Variables that a predicate mentions."""
    match p:
        case None:
            return set()
        case And(parts) | Or(parts):
            return set().union(*map(attributes, parts))
        case Compare(_, left, right):
            return {left} | ({right.name} if isinstance(right, Name) else set())
        case NotExists(source, target, _):
            return {source, target}
        case _:
            return {p.attribute}


def conjuncts(p: Predicate | None) -> list[Predicate]:
    if p is None:
        return []
    if isinstance(p, And):
        return [c for part in p.parts for c in conjuncts(part)]
    return [p]


@dataclass(frozen=True)
class Head:
    """kind: project, count, min or noop."""

    kind: str
    attributes: tuple[str, ...] = ()


@dataclass(frozen=True)
class LlmMap:
    output: str
    config: dict = field(hash=False)


@dataclass(frozen=True)
class Rule:
    head: Head
    atoms: tuple[Atom, ...]
    where: Predicate | None = None
    llm: LlmMap | None = None

    @property
    def variables(self) -> list[str]:
        """Variables of the body in order of appearance."""
        return list(dict.fromkeys(v for a in self.atoms for v in a.variables))
