"""A spread of registered queries against their SQL checks at the smallest scale (all of them: tests/harness.py)."""

from __future__ import annotations

import pytest
from harness import compare, duck

NAMES = ["agg_02_otsu", "agg_03_percentile_level", "agg_06_is_blank", "agg_08_content_bounds", "agg_10_detect_skew", "win_01_local_stats", "win_05_unsharp",
         "win_10_document_groups", "win_12_unique_names", "win_13_neighbor", "win_15_move_page", "win_16_trial_countdown", "sca_18_crop_plan", "sca_20_homography",
         "sca_33_build_name", "sca_40_fold", "fil_03_needs_render", "fil_06_home_listing", "join_09_warp", "join_14_guarded_update", "join_19_stroke_raster",
         "img_02_flatten_background", "img_12_export_plan", "edt_03_rotate", "str_04_debounce", "str_07_export_gates", "agg_13_hough_votes", "set_06_restore_page"]


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, sf, name):
    from folio import checks
    queries, oracles = checks.load()
    result, _, _ = compare(spark, con, name, queries[name], oracles[name], sf)
    assert result.startswith("ok"), result


def test_every_query_has_a_name_from_the_inventory():
    from folio import checks
    queries, oracles = checks.load()
    kinds = {"src", "sca", "fil", "join", "agg", "win", "top", "set", "img", "edt", "str"}
    assert all(n.split("_")[0] in kinds for n in queries)
    assert set(oracles) <= set(queries)


def test_entry(spark):
    import __spark_entry__ as e
    rows = e.entry(spark).collect()
    assert rows and {"image_id", "ink_percent", "is_blank"} == set(rows[0].asDict())
