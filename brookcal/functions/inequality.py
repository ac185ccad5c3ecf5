"""One-sided observations: which groups are bounds and what they contribute."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Group-name prefixes that mark one-sided observations.
LESS_THAN_PREFIXES = ("l_", "less", ">@")
GREATER_THAN_PREFIXES = ("g_", "greater", "<@")


def _starts(group: Column, prefixes: tuple[str, ...]) -> Column:
    low = F.lower(group)
    return reduce(lambda a, b: a | b, [low.startswith(p) for p in prefixes])


def is_less_than(group: Column) -> Column:
    return _starts(group, LESS_THAN_PREFIXES)


def is_greater_than(group: Column) -> Column:
    return _starts(group, GREATER_THAN_PREFIXES)


def sense(group: Column, weight: Column | None = None) -> Column:
    """``less_than`` / ``greater_than`` / ``two_sided``; zero-weighted rows are inactive."""
    kind = (
        F.when(is_greater_than(group), "greater_than")
        .when(is_less_than(group), "less_than")
        .otherwise("two_sided")
    )
    return kind if weight is None else F.when(weight != 0, kind).otherwise("inactive")


def one_sided_residual(group: Column, measured: Column, modelled: Column) -> Column:
    """measured - modelled, 0 where a bound is honoured."""
    honoured = (is_greater_than(group) & (modelled >= measured)) | (
        ~is_greater_than(group) & is_less_than(group) & (modelled <= measured)
    )
    return F.when(honoured, F.lit(0.0)).otherwise(measured - modelled)


def one_sided_equation_residual(group: Column, residual: Column) -> Column:
    """Equation rows use the opposite sign test: greater drops residuals >= 0, less <= 0."""
    honoured = (is_greater_than(group) & (residual >= 0)) | (
        ~is_greater_than(group) & is_less_than(group) & (residual <= 0)
    )
    return F.when(honoured, F.lit(0.0)).otherwise(residual)
