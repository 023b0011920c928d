"""Headline timings: prints one JSON line. ``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = ["agg_01_histogram", "agg_02_otsu", "agg_06_is_blank", "agg_08_content_bounds", "agg_10_detect_skew", "win_01_local_stats", "win_02_sauvola",
             "img_04_look_grid", "agg_13_hough_votes", "join_09_warp", "sca_18_crop_plan", "fil_05_search",
             "fil_03_needs_render", "win_10_document_groups", "win_12_unique_names", "win_14_latest_page", "win_16_trial_countdown", "join_14_guarded_update",
             "edt_02_set_filter", "agg_22_import_status", "img_12_export_plan", "str_01_capture_cues"]


def main() -> None:
    from folio import checks
    from folio.session import local_session
    from folio.sources import tables as T

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "folio-bench")
    queries, _ = checks.load()
    T.text_images(spark, sf).count()  # start-up is not timed
    times = {}
    for name in HEADLINES:
        t = time.time()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    pages = T.text_images(spark, sf).count()
    n = int(cpus) if cpus.isdigit() else os.cpu_count()
    rate = {q: round(pages / times[q] / n, 2) for q in ("agg_06_is_blank", "agg_02_otsu", "win_02_sauvola", "agg_10_detect_skew")}
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf.rstrip("/").split("sf")[-1], "pages": pages, "pages_per_sec_per_core": rate}))


if __name__ == "__main__":
    main()
