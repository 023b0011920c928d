"""What a row costs is paid once."""

from __future__ import annotations

from folio import checks


def plan(spark, sf, name) -> str:
    return checks.load()[0][name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_words_are_composed_once(spark, sf):
    p = plan(spark, sf, "sca_48_ocr_text_clean")
    assert p.count("ArrowEvalPython") == 1 and "BatchEvalPython" not in p


def test_outline_of_a_frame_is_computed_once(spark, sf):
    p = plan(spark, sf, "fil_09_all_gates")
    assert "Generate explode(array(" in p and "transform(" not in p


def test_words_of_a_page_are_gathered_where_they_are(spark, sf):
    p = plan(spark, sf, "src_08_ocr_words")
    assert p.count("Exchange hashpartitioning") == 1
