"""A spread of registered queries against their SQL twins at the smallest scale."""

import pytest

import __spark_entry__ as entry
from compare import compare, open_db

SF = "/root/testdata/sf0.001"
NAMES = [
    "entry_range_target_phi", "P11_name_parser", "P14_observation_groups", "P17_parameter_expansion", "A1_monthly_mean", "A6_snow_cover_bounds",
    "A10_reweight_restart", "A14_fit_metrics", "A16_conflict_summary", "W5_flow_class", "N15_enforce_scale", "N19_quantile_realizations",
    "N21_pair_conflict", "J10_cell_multipliers", "J12_near_time_match", "J19_site_series", "S13_matrix_round_trip", "S16_record_phi", "S17_point_scan",
    "G2_point_covariance", "plan_model_output", "S20_result_listing", "A25_change_histograms", "W8_time_differences_with_zeros",
    "N7_ties_from_ensemble", "N23_strong_competition", "N14_noise_draw_pairs", "G7_zone_draw_pairs",
]


@pytest.fixture(scope="module")
def con():
    return open_db(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    result = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert result.startswith("ok"), result


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 2


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
