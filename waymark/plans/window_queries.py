"""Frame histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions.geometry import clean
from waymark.operators import frames
from waymark.plans import recipes as rec
from waymark.plans.registry import query

c = F.col


@query(
    "last5_frames",
    f"""WITH {rec.TRAJ_SQL} SELECT session, map_key, event_id, count(*) OVER w AS n_frames, round(avg(inliers) OVER w,6)+0.0 AS mean_value, array_to_string(list(event_id) OVER w,',') AS history FROM traj
    WINDOW w AS (PARTITION BY session, map_key ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
)
def last5_frames(t):
    out = frames.last_frames(rec.trajectory(t), ["session", "map_key"], "inliers")
    return out.select(
        "session", "map_key", "event_id", "n_frames", clean(c("mean_value")).alias("mean_value"), F.array_join("history", ",").alias("history")
    )


@query(
    "camera_trail",
    f"""WITH {rec.TRAJ_SQL}, p AS (SELECT session, event_id, ts, sum(dx) OVER w AS x, sum(dy) OVER w AS z, row_number() OVER w - 1 AS segment FROM traj WINDOW w AS (PARTITION BY session ORDER BY ts, event_id))
    SELECT * FROM (SELECT session, event_id, segment, lag(x) OVER w AS from_x, lag(z) OVER w AS from_z, x, z FROM p WINDOW w AS (PARTITION BY session ORDER BY segment)) WHERE from_x IS NOT NULL""",
)
def camera_trail(t):
    return frames.camera_trail(frames.positions(rec.trajectory(t)), ["session"])
