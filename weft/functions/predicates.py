"""Predicates as Spark columns; three-valued logic as in SQL, so a filter drops what is not true."""

from __future__ import annotations

import operator
from collections.abc import Callable
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.tree import And, Between, Compare, In, Like, Literal, Name, NotExists, Null, Or, Predicate

_OPS = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge}


def literal(value: Literal) -> Column:
    return F.lit(Decimal(value.decimal) if value.decimal else value.value)


def like(column: Column, pattern: str) -> Column:
    """% and _ are wildcards, everything else is literal; there is no escape character."""
    return column.like(pattern.replace("\\", "\\\\"))


def to_column(p: Predicate, attribute: Callable[[str], Column], missing: Callable[[NotExists], Column] | None = None) -> Column:
    """``attribute`` gives the column of a variable, ``missing`` a boolean for an anti-join inside a disjunction."""
    match p:
        case And(parts):
            return reduce(operator.and_, (to_column(x, attribute, missing) for x in parts))
        case Or(parts):
            return reduce(operator.or_, (to_column(x, attribute, missing) for x in parts))
        case Compare(op, left, Name(right)):
            return _OPS[op](attribute(left), attribute(right))
        case Compare(op, left, right):
            return _OPS[op](attribute(left), literal(right))
        case In(a, (), negated):
            # nothing is in an empty list; NOT_IN keeps what is not null
            return attribute(a).isNotNull() if negated else F.lit(False)
        case In(a, values, negated):
            found = attribute(a).isin(*[v.value if not v.decimal else Decimal(v.decimal) for v in values])
            return ~found if negated else found
        case Between(a, low, high):
            return attribute(a).between(literal(low), literal(high))
        case Null(a, negated):
            return attribute(a).isNotNull() if negated else attribute(a).isNull()
        case Like(a, pattern, negated):
            found = like(attribute(a), pattern)
            return ~found if negated else found
        case NotExists():
            if missing is None:
                raise TypeError("an anti-join is no column here")
            return missing(p)
    raise TypeError(p)
