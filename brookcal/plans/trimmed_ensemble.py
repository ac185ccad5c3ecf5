"""Result files of a run to a scored, trimmed and renumbered ensemble."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from brookcal.operators import ensembles, scoring


class Trimmed(NamedTuple):
    survivors: DataFrame
    envelope: DataFrame
    parameter_envelope: DataFrame
    metrics: DataFrame
    restart_observations: DataFrame
    restart_parameters: DataFrame


def trim(
    phi: DataFrame, cutoffs: DataFrame, keys: list[str], sim: DataFrame, pars_ens: DataFrame, obs: DataFrame, pars: DataFrame
) -> Trimmed:
    """Reject realizations above the cutoff and rebuild everything from the survivors."""
    kept = scoring.reject_by_phi(phi, cutoffs, keys).select("real").distinct()
    keep = lambda df: df.join(kept, "real", "left_semi")
    numbers = ensembles.renumber(kept)
    sim_kept, par_kept = keep(sim), keep(pars_ens)
    return Trimmed(
        survivors=numbers,
        envelope=ensembles.envelope(sim_kept),
        parameter_envelope=ensembles.parameter_envelope(par_kept, pars),
        metrics=scoring.ensemble_fit_metrics(sim_kept, obs),
        restart_observations=ensembles.apply_renumber(sim_kept, numbers),
        restart_parameters=ensembles.apply_renumber(par_kept, numbers),
    )
