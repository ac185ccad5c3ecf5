"""Registry of the sixteen fit metrics as expressions over one set of moments.

Every metric is a formula over sums that combine map-side; only the
interquartile range needs order statistics, which are supplied as columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

Moments = dict[str, Column]


def moment_aggregates(obs: str = "measured", mod: str = "modelled") -> list[Column]:
    o, m = F.col(obs), F.col(mod)
    return [
        F.count(F.lit(1)).alias("n"),
        F.sum(o).alias("so"), F.sum(m).alias("sm"), F.sum(m - o).alias("sd"),
        F.sum(F.abs(m - o)).alias("sad"), F.sum((m - o) * (m - o)).alias("sse"),
        F.var_pop(o).alias("vo"), F.var_pop(m).alias("vm"), F.corr(o, m).alias("r"),
        F.min(o).alias("omin"), F.max(o).alias("omax"),
    ]


def _div(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def _c(name: str) -> Column:
    return F.col(name)


def _rmse() -> Column:
    return F.sqrt(_c("sse") / _c("n"))


def _nse(compat: bool) -> Column:
    # compat: the variance of the model takes the place of the observed one
    spread = _c("vm") if compat else _c("vo")
    return 1.0 - _div(_c("sse"), spread * _c("n"))


def _standard_error() -> Column:
    return F.sqrt(_div(_c("sse"), _c("n") - 1.0))


def _bias() -> Column:
    return _div(_c("sd"), _c("so")) / _c("n")


METRICS: dict[str, Callable[[bool], Column]] = {
    "pbias": lambda k: 100.0 * _div(_c("sd"), _c("so")),
    "bias": lambda k: _bias(),
    "relative_bias": lambda k: _div(_bias(), _c("so") / _c("n")),
    "rmse": lambda k: _rmse(),
    "mse": lambda k: _c("sse") / _c("n"),
    "nse": _nse,
    "nnse": lambda k: _div(F.lit(1.0), 2.0 - _nse(k)),
    "mae": lambda k: _c("sad") / _c("n"),
    "kge": lambda k: 1.0 - F.sqrt(
        F.pow(_c("r") - 1.0, F.lit(2.0))
        + F.pow(_div(F.sqrt(_c("vm")), F.sqrt(_c("vo"))) - 1.0, F.lit(2.0))
        + F.pow(_div(_c("sm"), _c("so")) - 1.0, F.lit(2.0))
    ),
    "nrmse_sd": lambda k: _div(_rmse(), F.sqrt(_c("vo"))),
    "nrmse_mean": lambda k: _div(_rmse(), _c("so") / _c("n")),
    "nrmse_iq": lambda k: _div(_rmse(), _c("q75") - _c("q25")),
    "nrmse_maxmin": lambda k: _div(_rmse(), _c("omax") - _c("omin")),
    "standard_error": lambda k: _standard_error(),
    "volumetric_efficiency": lambda k: 1.0 - _div(_c("sad"), _c("so")),
    "relative_standard_error": lambda k: _div(
        _standard_error(), F.sqrt(_div(_c("vo") * _c("n"), _c("n") - 1.0))
    ),
}
NEEDS_QUARTILES = {"nrmse_iq"}


def resolve(metrics: str | Iterable[str]) -> list[str]:
    """Lower-cased metric names; ``"all"`` means every one, unknown names raise."""
    if isinstance(metrics, str):
        metrics = list(METRICS) if metrics.lower() == "all" else [metrics]
    wanted = [m.lower() for m in metrics]
    unknown = [m for m in wanted if m not in METRICS]
    if unknown:
        raise ValueError("unknown metrics: " + ", ".join(unknown))
    return wanted


def register(name: str, formula: Callable[[bool], Column]) -> None:
    """Add a metric: a function of the compat flag returning a column over the moments."""
    METRICS[name.lower()] = formula
