"""Registered queries beside their DuckDB check query.

A selection runs by default; ALL_QUERIES=1 runs every registered query.
"""

import os

import pytest
from sf_tables import DATA

import __spark_entry__ as entry
from stockloom.registry import QUERIES
from tools.check import compare

SELECTION = """scan_pruned scan_csv_encoded sink_partitioned profile_columns surrogate_id read_trials_json parse_date zip5 valid_lengths drop_sign_combo repair_category
melt_months broadcast_groups eav_to_map widen_horizons resolve_region weather_or_join weather_key_resolve star_enrich map_two_pass override_values asof_backward resolve_cluster siblings
join_fanout_counts null_ratio product_master latest_master weekly_purchases volume_percentile_top20 classification_accuracy stratified_sample mart_weekly_demand inventory_estimate
adi_expanding cv2_expanding category_fallback run_length encoder_windows horizon_targets expanding_folds walkforward_folds hier_median_fit_apply metrics threshold_sweep qcut_quartiles
select_trial select_family oof_frame grid_trials seed_trials per_series_fit seasonal_fit threshold_by_group instability zero_demand vocab_encode union_sheets q_daily_summary_head acf periodogram spearman rolling_origin_eval q_summary q_daily_summary q_inventory_shortage q_sales_surge""".split()
NAMES = [q.name for q in QUERIES.values() if q.sql] if os.environ.get("ALL_QUERIES") else SELECTION


@pytest.mark.parametrize("name", NAMES)
def test_rows_match(name, spark, duck):
    message, _, _, ok = compare(spark, duck, QUERIES[name], DATA, entry.oracle_sql())
    assert ok, message


def test_every_query_has_a_check_except_fitted_models():
    unchecked = {q.name for q in QUERIES.values() if not q.sql}
    assert unchecked == {"forest_regression", "boosted_regression", "hurdle", "tweedie", "grid_trials_forest", "seed_trials_forest", "importance"}


def test_entry(spark):
    df = entry.entry(spark)
    assert {"center_id", "sku_id", "week_st", "qty", "lag1", "adi"} <= set(df.columns)
    assert not df.isEmpty()
