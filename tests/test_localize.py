"""Two-view geometry, verification in bands, and pose histories as batch, table and stream state."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.operators import history as windows
from waymark.operators import localize as loc
from waymark.operators import two_view
from waymark.streaming import history, jobs

c = F.col


def views(rng, n, share, noise=0.0):
    """Matches of two cameras, of which ``share`` are true, and which these are."""
    x = np.stack([rng.uniform(-4, 4, n), rng.uniform(-3, 3, n), rng.uniform(6, 14, n)], 1)
    a = 0.15
    r = np.array([[np.cos(a), 0, np.sin(a)], [0, 1, 0], [-np.sin(a), 0, np.cos(a)]])
    y = x @ r.T + [0.8, 0.1, 0.2]
    p, q = 500 * x[:, :2] / x[:, 2:] + 320, 500 * y[:, :2] / y[:, 2:] + 240
    good = rng.random(n) < share
    q = np.where(good[:, None], q + rng.normal(0, noise, q.shape) if noise else q, rng.uniform(0, 640, (n, 2)))
    return p, q, good


@pytest.mark.parametrize("share, noise", [(0.3, 0.0), (0.5, 0.3), (0.9, 0.5)])
def test_planted_geometry_is_recovered(share, noise):
    p, q, good = views(np.random.default_rng(4), 300, share, noise)
    f, mask, tried = two_view.fit_two_view(p, q, 2.0)
    assert (mask & good).sum() >= 0.97 * good.sum() and (mask & ~good).sum() <= 0.1 * (~good).sum()
    assert abs(np.linalg.det(f / np.linalg.norm(f))) < 1e-9
    assert tried <= max(two_view.BATCH, 1.2 * two_view.needed(int(good.sum()), 300, 0.99) + two_view.BATCH)


def test_hypotheses_follow_the_inliers():
    assert two_view.needed(10, 10, 0.99) == 0 and two_view.needed(0, 10, 0.99) == np.inf
    assert 60_000 < two_view.needed(3, 10, 0.99) < 80_000 and two_view.needed(9, 10, 0.99) < 10


def test_a_batch_is_solved_in_arrays(monkeypatch):
    rng = np.random.default_rng(1)
    f, m = rng.normal(size=(9, 200)), rng.normal(size=(9, 8, 200))
    null, volume = two_view.null_vectors(m.copy())
    assert np.abs(np.einsum("irb,ib->rb", m, null)).max() < 1e-12 and np.allclose((null * null).sum(axis=0), 1)
    assert np.allclose(volume, np.sqrt(np.abs(np.linalg.det(np.einsum("irb,isb->brs", m, m)))))
    flat = two_view.rank_two(f.T.reshape(-1, 3, 3))
    assert np.quantile(np.abs(two_view.nearly_rank_two(f) - flat.reshape(-1, 9).T).max(axis=0), 0.98) < 1e-9
    p, q = (np.concatenate([rng.uniform(0, 640, (60, 2)), np.ones((60, 1))], axis=1) for _ in range(2))
    got = two_view.losses(flat.reshape(-1, 9).T, two_view.rows_of(p, q).T, np.concatenate([two_view.quadratic(p), two_view.quadratic(q)]), 2.0)
    assert np.allclose(got, np.minimum(two_view.sampson(flat, p, q), 2.0).sum(axis=1))
    for n in (9, 64, 300):
        x = rng.random((2000, n))
        assert (np.sort(two_view.smallest_eight(x), axis=1) == np.sort(x.argpartition(7, axis=1)[:, :8], axis=1)).all()
    assert (np.sort(two_view.smallest_eight(1 - x / 8), axis=1) == np.sort((1 - x).argpartition(7, axis=1)[:, :8], axis=1)).all()
    # Only the best of a batch is decomposed one by one.
    matrices, svd = [], np.linalg.svd
    monkeypatch.setattr(np.linalg, "svd", lambda a, *rest, **more: (matrices.append(a.size // np.prod(a.shape[-2:])), svd(a, *rest, **more))[1])
    x, y, good = views(rng, 200, 0.3)
    _, mask, tried = two_view.fit_two_view(x, y, 1.0)
    assert (mask & good).sum() >= 0.97 * good.sum() and tried > 10_000 and sum(matrices) < tried / 20
    assert two_view.fit_two_view(np.where(good[:, None], x, np.nan), y, 1.0) is None


def test_pairs_are_spread_over_all_tasks(spark):
    # Few bytes and much work.
    df = spark.createDataFrame([(i, i + 10, k, k, 1.0, 1.0, 1.0, 1.0) for i in range(3) for k in range(7)], "img1 long, img2 long, kp1 long, kp2 long, x1 double, y1 double, x2 double, y2 double")
    assert two_view.two_view(df).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_pairs_of_a_table(spark):
    rows = []
    for pair, share in ((1, 0.4), (2, 0.0), (3, 0.9)):
        p, q, _ = views(np.random.default_rng(pair), 120, share)
        rows += [(pair, pair + 10, k, k, *map(float, (*a, *b))) for k, (a, b) in enumerate(zip(p, q, strict=True))]
    rows += [(4, 14, k, k, 1.0, 1.0, 1.0, 1.0) for k in range(30)] + [(5, 15, k, k, float(k), 0.0, 0.0, float(k)) for k in range(7)]
    df = spark.createDataFrame(rows, "img1 long, img2 long, kp1 long, kp2 long, x1 double, y1 double, x2 double, y2 double")
    got = two_view.two_view(df.repartition(7), tol=0.5, least=25)
    again = two_view.two_view(df.coalesce(1), tol=0.5, least=25)
    assert sorted(map(str, got.collect())) == sorted(map(str, again.collect()))
    assert {1, 3} <= {r.img1 for r in got.collect()} <= {1, 3, 4}
    geometry = got.filter("img1 IN (1, 3)").select("img1", "img2", "f").distinct()
    scored = {r.img1: r.inliers for r in two_view.score_geometry(df, geometry, 0.5).collect()}
    assert scored == {r.img1: r.inliers for r in got.filter("img1 IN (1, 3)").collect()}
    assert two_view.two_view(df.limit(0)).count() == 0


def scene(spark, frames=12):
    """A map of images whose keypoints a frame sees under two-view geometry; frame f sees images f and f + 1."""
    rng = np.random.default_rng(8)
    feats, points, local = [], [], []
    p, q, _ = views(rng, 40, 1.0)
    desc = rng.normal(size=(frames + 1, 40, 16))
    for i in range(frames + 1):
        v = np.zeros(frames + 1)
        v[i] = 1.0
        feats.append((1, i, v.tolist()))
        points += [(i, k, *map(float, q[k]), 1.0, desc[i, k].tolist()) for k in range(40)]
    for f in range(frames):
        v = np.zeros(frames + 1)
        v[f], v[f + 1] = 1.0, 0.9
        # Half of the descriptors are those of one image, half those of the other.
        local.append((f, v.tolist(), [(k, *map(float, p[k]), 1.0, desc[f + k % 2, k].tolist()) for k in range(40)]))
    frame = spark.createDataFrame(local, "query long, vec array<double>, local array<struct<kp_idx: int, x: double, y: double, score: double, desc: array<double>>>")
    tables = loc.prepare_map(
        spark.createDataFrame(feats, "map_key long, image long, vec array<double>"), spark.createDataFrame(points, "image long, kp_idx int, x double, y double, score double, desc array<double>"),
        spark.createDataFrame([(i, float(i), 2.0 * i, 10.0) for i in range(frames + 1)], "image long, x double, y double, heading double"),
    )
    return frame, tables


def test_epipolar_localization_and_bands(spark):
    frames, tables = scene(spark)
    options = {"k": 6, "least": 2, "least_matches": 8, "tol": 2.0, "least_inliers": 16, "target": 1000, "model": "epipolar"}
    got = {r["query"]: (r.success, r.x, r.images) for r in loc.localize(frames, tables, **options).collect()}
    assert len(got) == 12 and all(ok and abs(x - f - 0.5) < 0.1 and n == 2 for f, (ok, x, n) in got.items())  # a chance match may weigh in
    assert not any(r.success for r in loc.localize(frames, tables, **{**options, "tol": 0.01, "model": "similarity"}).collect())
    hits = loc.retrieve_topk(frames.select("query", "vec"), None, 6, index=tables.images)
    early = loc.verified_candidates(hits, frames, tables, 30, 8, 2.0, 16, "epipolar", (2,))
    assert early.agg(F.max("rank")).first()[0] == 2 and early.count() == 24  # nobody needs the second band
    assert loc.verified_candidates(hits, frames, tables, 1000, 8, 2.0, 16, "epipolar", (2,)).count() == hits.count()


COLUMNS = "session long, ts timestamp, event_id long, map_key string, x double, y double, heading double, weight double"


def poses(spark, rows):
    """rows: (session, second, id, map, x, heading, weight)."""
    df = spark.createDataFrame(rows, "session long, s long, event_id long, map_key string, x double, heading double, weight double")
    return df.select("session", F.timestamp_seconds("s").alias("ts"), "event_id", "map_key", "x", (2 * c("x")).alias("y"), "heading", "weight")


def tracks(rng, n=300):
    # A third of all frames belong to one session.
    return [(0 if i % 3 == 0 else int(rng.integers(1, 6)), 1000 + i // 2 + 500 * (i // 90), i, f"m{i // 40 % 2}", float(rng.normal()), float(rng.uniform(0, 360)), float(rng.integers(1, 30))) for i in range(n)]


def plain(rows, n=5, idle=400):
    """Windows by hand; the fusion of one window is tested against the column version below."""
    out, seen = {}, {}
    for s, t, i, m, x, h, w in sorted(rows, key=lambda r: (r[1], r[2])):
        held = seen.setdefault(s, [])
        if held and (held[-1][3] != m or t - held[-1][1] > idle):
            held.clear()
        held.append((s, t, i, m, x, h, w))
        last = held[-n:]
        out[i] = (len(last), int(sum(r[6] for r in last)), round(sum(r[6] * r[4] for r in last) / sum(r[6] for r in last), 9))
    return out


def answers(df):
    return {r.event_id: (r.n_frames, r.pairs, round(r.est_x, 9)) for r in df.collect()}


def test_history_against_windows_by_hand(spark):
    rows = tracks(np.random.default_rng(2))
    assert answers(windows.pose_history(poses(spark, rows), idle=400, size=20)) == plain(rows)


def test_fusion_equals_the_grouped_one(spark):
    rng = np.random.default_rng(6)
    rows = [(q, "m", float(rng.normal()), float(rng.normal()), float(rng.uniform(0, 360)), float(rng.integers(1, 9)), k) for q in range(60) for k in range(rng.integers(1, 6))]
    df = spark.createDataFrame(rows, "query long, map_key string, x double, y double, heading double, weight double, event_id long")
    want = {r["query"]: (r.n, r.x, r.y, r.heading) for r in loc.fuse_poses(df).collect()}
    cells = np.full((4, 60, 5), np.nan)
    for q, _, *v, k in rows:
        cells[:, q, k] = v
    got = list(zip(*windows.fuse_windows(*cells), strict=True))
    for q in range(60):
        assert got[q][0] == want[q][0] and np.allclose(got[q][1:], want[q][1:])


def test_history_by_steps_and_late_frames(spark):
    rows = tracks(np.random.default_rng(5), 120)
    held, got = poses(spark, rows).limit(0), {}
    for lo in range(0, 120, 40):
        # The last frames of the step before are sent again; they are not answered twice.
        out, held = windows.history_step(held, poses(spark, rows[max(0, lo - 4):lo + 40]), idle=400)
        part = answers(out)
        assert not set(part) & set(got)
        got |= part
    assert got == plain(rows)
    late = poses(spark, [(9, 10, 1, "m", 1.0, 0.0, 1.0), (9, 30, 3, "m", 3.0, 0.0, 1.0)])
    _, held = windows.history_step(late.limit(0), late)
    out, held = windows.history_step(held, poses(spark, [(9, 20, 2, "m", 2.0, 0.0, 1.0)]))
    assert answers(out) == {2: (2, 2, 1.5)}  # itself and the frame before it
    out, _ = windows.history_step(held, poses(spark, [(9, 40, 4, "m", 6.0, 0.0, 1.0)]))
    assert answers(out) == {4: (4, 4, 3.0)}  # the late frame stands in its place


def streamed(spark, path, parts):
    for rows in parts:
        poses(spark, rows).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def test_stream_state_equals_batch(spark, tmp_path):
    rows = tracks(np.random.default_rng(3), 200)
    stream = streamed(spark, tmp_path, [rows[:70], rows[70:130], rows[130:]])
    out = jobs.stream_to_table(history.pose_history_stream(stream, idle_s=400, late="100 days"), str(tmp_path / "out"))
    assert answers(out) == plain(rows) and out.filter("late").isEmpty()


def test_stream_late_frames_and_idle_sessions(spark, tmp_path):
    late = [(9, 1000, 2, "m", 2.0, 0.0, 1.0)]
    stream = streamed(spark, tmp_path, [[(9, 990, 1, "m", 1.0, 0.0, 1.0), (9, 1010, 3, "m", 3.0, 0.0, 1.0)], late, [(9, 1020, 4, "m", 6.0, 0.0, 1.0)], [(8, 90_000, 5, "m", 7.0, 0.0, 1.0)], [(8, 90_500, 8, "m", 8.0, 0.0, 1.0)], [(9, 500, 6, "m", 0.0, 0.0, 1.0)], [(9, 90_100, 7, "m", 9.0, 0.0, 1.0)]])
    out = jobs.stream_to_table(history.pose_history_stream(stream, idle_s=60, late="1 hour"), str(tmp_path / "out"))
    got = {r.event_id: (r.late, r.n_frames, r.est_x) for r in out.collect()}
    # Frame 2 is late but answered; frame 6 is behind the watermark and dropped; the idle session begins anew.
    assert got == {1: (False, 1, 1.0), 3: (False, 2, 2.0), 2: (True, 2, 1.5), 4: (False, 4, 3.0), 5: (False, 1, 7.0), 8: (False, 1, 8.0), 7: (False, 1, 9.0)}


def test_localization_with_history_after_a_restart(spark, tmp_path):
    frames, tables = scene(spark)
    frames = frames.withColumns({"session": c("query") % 2, "ts": F.timestamp_seconds(c("query"))})
    options = {"k": 3, "least": 2, "least_matches": 8, "tol": 2.0, "least_inliers": 16, "model": "epipolar"}
    found = loc.localize(frames.select("query", "vec", "local"), tables, **options).join(frames.select("query", "session", "ts"), "query")
    want = jobs.with_history(found, windows.pose_history(jobs.found_frames(found)))
    key = lambda df: sorted((r["query"], r.success, r.n_frames, r.pairs, round(r.est_x, 9)) for r in df.collect())

    def send(rows):
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        return jobs.localize_history_stream(stream, tables, str(tmp_path / "out"), **options)

    first = send(frames.filter("query < 5"))
    assert first().count() == 5
    again = send(frames.filter("query >= 5 OR query = 3"))  # a new query over the same folders; one frame is sent twice
    assert key(again()) == key(want) and max(r[2] for r in key(want)) == 5
