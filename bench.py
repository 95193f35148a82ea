"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "plr_kinetics", "velocity", "session_summary", "report_notes", "triage_urgency", "triage_cube", "waveform_align", "asof_latest_b",
    "agreement_stats", "stability_window", "rolling_stats60", "throttle100", "throttle_hot", "ema_stabilised", "component_geometry", "component_geometry_640", "region_grow",
    "resize_bilinear", "blur3x3", "dhash", "leak_perceptual", "leak_review", "area_percentiles", "softmax_ce_dice", "exact_duplicates",
    "landmark_eyes", "stimulus_trains", "stream_fps", "stream_ema", "stream_phases", "image_hashes64", "audit_from_images", "delete_then_reinsert",
]


def main() -> None:
    from reflexgrid.plans.catalog import QUERIES
    from reflexgrid.session import build

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build(f"local[{os.environ.get('BENCH_CPUS', '8')}]", "bench")
    spark.read.parquet(f"{sf}/events.parquet").count()  # start the engine before the clock
    only = sys.argv[1:]
    seconds = {}
    for name in HEADLINE:
        if only and name not in only:
            continue
        start = time.perf_counter()
        # `noop` computes every row and column without moving them to the driver
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
