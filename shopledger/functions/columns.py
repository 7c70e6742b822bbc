"""Column expressions shared by the operators; all stay inside code generation."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, functions as F

MONEY = "decimal(18,4)"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c: str | Column) -> Column:
    """Exact money, so that sums do not depend on the order of rows."""
    return col(c).cast(MONEY)


def moment(at: datetime) -> Column:
    """A wall-clock literal that does not depend on the session's time zone."""
    return F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")


def zero_if_null(c: str | Column) -> Column:
    return F.coalesce(col(c), F.lit(0))


def ratio(part: str | Column, whole: str | Column) -> Column:
    """Quotient as double; null when the base is null or zero."""
    return F.try_divide(col(part).cast("double"), col(whole).cast("double"))


def first_match(rules: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """Value of the first rule whose condition holds."""
    (condition, value), *rest = rules
    expression = F.when(condition, value)
    for condition, value in rest:
        expression = expression.when(condition, value)
    return expression.otherwise(default)


def sum_when(condition: Column, value: str | Column) -> Column:
    """Conditional sum; null when no row qualifies."""
    return F.sum(F.when(condition, col(value)))


def matches_any(c: str | Column, patterns: Sequence[str]) -> Column:
    """True when the text is LIKE one of the patterns; null text is no match."""
    found = F.lit(False)
    for pattern in patterns:
        found = found | F.coalesce(col(c).like(pattern), F.lit(False))
    return found


def total_order(order: Sequence[str | tuple[str, str]]) -> list[Column]:
    """Sort columns from names or (name, 'asc'|'desc') pairs, nulls always last."""
    columns = []
    for item in order:
        name, direction = (item, "asc") if isinstance(item, str) else item
        c = F.col(name)
        columns.append(c.desc_nulls_last() if direction == "desc" else c.asc_nulls_last())
    return columns


def order_names(order: Sequence[str | tuple[str, str]]) -> list[str]:
    return [item if isinstance(item, str) else item[0] for item in order]
