"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from waymark.plans import load  # noqa: E402
from waymark.session import local_session  # noqa: E402

HEADLINE = [
    "vpr_topk", "mutual_nn", "consensus_verify", "localize_batch", "region_vote", "pose_fusion",
    "frame_assembly", "nn_lift", "pose_pairs",
    "height_band", "percentile_band", "occupancy_grid", "grid_morphology", "masked_points", "progressive_cloud",
    "depth_to_points", "depth_metrics", "depth_mesh", "raster_gather",
    "shape_nodes", "floor_graph", "unified_graph", "snap_waypoint", "door_events",
    "sssp_floor", "route_trips", "route_commands", "label_merge", "last5_frames", "tts_sanitize",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    queries, _ = load()
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    # Warm the session and the Python workers, so the first query does not pay for them.
    queries["two_level_topk"](spark, folder).write.format("noop").mode("overwrite").save()
    queries["batch_infer"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        runs = []
        for _ in range(repeats):
            start = time.time()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - start)
        times[name] = round(sorted(runs)[len(runs) // 2], 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
