"""Operators against brute force on small inputs, with one group holding a third of all rows."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from waymark.operators import cells, clouds, lookups, overlay, ranks, relax, routes, sight, vectors
from waymark.operators.blocks import block_pairs

c = F.col
RNG = np.random.default_rng(7)


def skewed(n=3000, groups=40):
    key = np.where(RNG.random(n) < 1 / 3, 0, RNG.integers(1, groups, n))
    v = np.round(RNG.normal(0, 50, n), 1)
    v[RNG.random(n) < 0.05] = 0.0
    return pd.DataFrame({"k": key, "id": np.arange(n), "v": v})


def test_quantiles(spark):
    pdf = skewed()
    got = ranks.quantiles(spark.createDataFrame(pdf), ["k"], "v", {"a": 0.05, "b": 0.5, "d": 0.999}).toPandas().set_index("k")
    for k, part in pdf.groupby("k"):
        assert got.loc[k].tolist() == pytest.approx(np.quantile(part.v, [0.05, 0.5, 0.999]).tolist())
    whole = ranks.quantiles(spark.createDataFrame(pdf), [], "v", {"m": 0.5}).first()
    assert whole.m == pytest.approx(np.median(pdf.v))


def test_group_index(spark):
    pdf = skewed()
    got = ranks.group_index(spark.createDataFrame(pdf), ["k"], ["v", "id"], "i").toPandas()
    want = pdf.sort_values(["k", "v", "id"]).assign(i=lambda d: d.groupby("k").cumcount())
    assert dict(zip(got.id, got.i)) == dict(zip(want.id, want.i))


def test_overlapped_windows(spark):
    df = spark.createDataFrame(skewed())
    rows = ranks.overlapped(df, ["k"], ["v", "id"], back=3, ahead=1, size=50)
    w = Window.partitionBy("k", "_chunk").orderBy("v", "id")
    got = rows.withColumns({"s": F.sum("v").over(w.rowsBetween(-3, 0)), "n": F.lead("id").over(w)}).filter(~c("_carry"))
    plain = Window.partitionBy("k").orderBy("v", "id")
    want = df.withColumns({"s": F.sum("v").over(plain.rowsBetween(-3, 0)), "n": F.lead("id").over(plain)})
    fix = lambda d: sorted((r.id, round(r.s, 6), r.n) for r in d.collect())
    assert fix(got) == fix(want)


def test_block_pairs(spark):
    df = spark.createDataFrame(skewed(300, 10))
    a, b = df.select("k", c("id").alias("x")), df.select("k", c("id").alias("y"))
    got = block_pairs(a, b, ["k"], "x", "y", size=8)
    want = a.join(b, "k")
    assert sorted(map(tuple, got.select("k", "x", "y").collect())) == sorted(map(tuple, want.collect()))


def test_near_join_and_components(spark):
    pts = pd.DataFrame({"id": range(250), "x": RNG.random(250) * 15, "z": RNG.random(250) * 15})
    pts.loc[:80, ["x", "z"]] = pts.loc[:80, ["x", "z"]].to_numpy() * 0.1
    df = spark.createDataFrame(pts)
    left, right = df.toDF("a", "ax", "az"), df.toDF("b", "bx", "bz")
    got = {(r.a, r.b) for r in cells.near_join(left, right, [], ["ax", "az"], ["bx", "bz"], 1.0).filter("_d < 1").collect()}
    xy = pts[["x", "z"]].to_numpy()
    d = np.linalg.norm(xy[:, None] - xy[None], axis=2)
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(d < 1))}
    label = list(range(250))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in zip(*np.nonzero(d <= 1.0)):
        a, b = root(i), root(j)
        label[max(a, b)] = min(a, b)
    clusters = cells.components(df, "id", ["x", "z"], 1.0).collect()
    assert {r.id: r.cluster for r in clusters} == {i: root(i) for i in range(250)}


def test_shortest_paths(spark):
    random.seed(3)
    edges = [(random.randrange(12), random.randrange(12), float(random.choice([0, 0, 1, 2, 5]))) for _ in range(30)]
    tree = relax.shortest_paths(spark.createDataFrame(edges, "src long, dst long, weight double"), spark.createDataFrame([(0,), (5,)], "source long"))
    got = {(r.source, r.node): r.cost for r in tree.collect()}
    for s in (0, 5):
        dist = {s: 0.0}
        for _ in range(12):
            for a, b, w in edges:
                if a in dist and dist[a] + w < dist.get(b, 1e9):
                    dist[b] = dist[a] + w
        assert {n: v for (src, n), v in got.items() if src == s} == dist
    pairs = tree.select("source", c("node").alias("dest"))
    cost = {}
    for a, b, w in edges:
        cost[a, b] = min(w, cost.get((a, b), w))
    paths = {}
    for r in relax.path_nodes(tree, pairs).collect():
        paths.setdefault((r.source, r.dest), []).append((r.hops, r.node))
    assert set(paths) == set(got)
    for (a, b), path in paths.items():
        nodes = [n for _, n in sorted(path)]
        assert [h for h, _ in sorted(path)] == list(range(len(path)))
        assert nodes[0] == a and nodes[-1] == b and sum(cost[p] for p in zip(nodes, nodes[1:])) == got[a, b]


def test_asked_paths_bound_the_search(spark):
    line = spark.range(400).select(c("id").alias("src"), (c("id") + 1).alias("dst"), F.lit(1).alias("weight"))
    asked = spark.createDataFrame([(0, 3), (100, 101)], "source long, node long")
    tree = relax.shortest_paths(line, asked.select("source"), asked)
    got = {(r.source, r.node): r.cost for r in tree.collect()}
    assert got[0, 3] == 3 and got[100, 101] == 1 and len(got) <= 2 * 25  # a few rounds beyond what is asked, not 400


def test_long_paths_by_doubling(spark):
    n = 10_000
    tree = spark.range(n).select(F.lit(0).cast("long").alias("source"), c("id").alias("node"), c("id").cast("int").alias("hops"), F.when(c("id") > 0, c("id") - 1).alias("pred"))
    out = relax.path_nodes(tree, spark.createDataFrame([(0, n - 1)], "source long, dest long"))
    assert out.count() == n and out.agg(F.sum("node")).first()[0] == n * (n - 1) // 2


def test_negative_weights_are_refused(spark):
    with pytest.raises(ValueError):
        relax.shortest_paths(spark.createDataFrame([(1, 2, -1.0)], "src long, dst long, weight double"), spark.createDataFrame([(1,)], "source long"))


def test_route_errors(spark):
    found = spark.createDataFrame([(1, 0, 1), (2, 4, 1)], "trip_id long, cost long, hops int")
    trips = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 9), (5, None)], "trip_id long, dest long")
    ends = spark.createDataFrame([(1,), (2,), (3,)], "dest long")
    got = {r.trip_id: (r.cost, r.error) for r in routes.trip_results(trips, ends, found).collect()}
    assert got == {1: (0, None), 2: (4, None), 3: (None, "No path found"), 4: (None, "Destination must be terminal"), 5: (None, "Destination must be terminal")}


@pytest.mark.parametrize("seed", range(3))
def test_overlay_equals_the_whole_graph(spark, seed):
    rng = random.Random(seed)
    floors = {n: n // 9 for n in range(45)}
    edges, jumps = {}, {}
    for _ in range(130):
        a, b = rng.sample(range(45), 2)
        if floors[a] == floors[b] and a % 9 != 8:  # the ninth node of a floor is a destination
            edges[a, b] = rng.randrange(1, 9)
    gates = [n for n in range(45) if n % 9 in (0, 1)]
    for _ in range(9):
        a, b = rng.sample(gates, 2)
        jumps[a, b] = jumps[b, a] = rng.choice([0, 3, 50])
    links = {t: {rng.randrange(9) + 9 * (t % 5): rng.randrange(1, 20) for _ in range(2)} for t in range(40)}
    dest = {t: 9 * rng.randrange(5) + 8 for t in links}
    every = dict(edges)
    for e, w in jumps.items():
        every[e] = min(w, every.get(e, w))

    def best(t):
        label = {n: (w, 1) for n, w in links[t].items()}
        for _ in range(60):
            for (a, b), w in every.items():
                if a in label and (label[a][0] + w, label[a][1] + 1) < label.get(b, (10**9, 0)):
                    label[b] = (label[a][0] + w, label[a][1] + 1)
        return label.get(dest[t])

    table = lambda d: spark.createDataFrame([(a, b, w) for (a, b), w in d.items()], "src long, dst long, weight long")
    ends = spark.createDataFrame([(d,) for d in set(dest.values())], "node long")
    o = overlay.Overlay(table(edges), table(jumps), ends)
    trips = spark.createDataFrame(list(dest.items()), "trip_id long, dest long")
    see = spark.createDataFrame([(t, n, w) for t, x in links.items() for n, w in x.items()], "trip_id long, node long, weight long")
    found = overlay.route(trips, see, o)
    got = {r.trip_id: (r.cost, r.hops) for r in found.found.collect()}
    assert got == {t: best(t) for t in links if best(t)}
    paths = {}
    for r in overlay.route_nodes(found).collect():
        paths.setdefault(r.trip_id, []).append((r.seq, r.node))
    assert set(paths) == set(got)
    for t, path in paths.items():
        nodes = [n for _, n in sorted(path)]
        assert [s for s, _ in sorted(path)] == list(range(1, got[t][1] + 1)) and nodes[-1] == dest[t]
        assert links[t][nodes[0]] + sum(every[e] for e in zip(nodes, nodes[1:])) == got[t][0]


def test_routes_from_places_equal_routes_over_links(spark):
    """Starts see nodes of their floor; a trip comes twice, one has no destination, one asks for a waypoint, one floor has no polygons, nodes see no goal."""
    rng = random.Random(5)
    key = ["place", "building", "floor"]
    spot = lambda: (float(rng.randrange(0, 40)), float(rng.randrange(0, 40)))
    wall = lambda x0, y0, x1, y1: [{"ax": a, "ay": b, "bx": c_, "by": d} for a, b, c_, d in ((x0, y0, x0, y1), (x0, y1, x1, y1), (x1, y1, x1, y0), (x1, y0, x0, y0))]
    polys = [{"group_id": g, "edges": wall(*map(float, box))} for g, box in ((0, (-1, -1, 41, 41)), (1, (10, 10, 30, 13)), (1, (18, 20, 21, 38)))]
    floors = spark.createDataFrame([("P", "B", f"F{f}", polys, s) for f, s in enumerate((1.0, 0.07, 0.5))], "place string, building string, floor string, polys array<struct<group_id:int,edges:array<struct<ax:double,ay:double,bx:double,by:double>>>>, m_per_px double")
    nodes = [("P", "B", f"F{n // 9}", n, *spot()) for n in range(36)]
    edges = [(("P", "B", f"F{f}"), f * 9 + a, f * 9 + b, rng.randrange(1, 9) * 10**6) for f in range(4) for a in range(7) for b in range(9) if a != b and rng.random() < 0.3]
    jumps = [(a, b, w) for x, y, w in ((0, 9, 3), (1, 18, 50), (10, 19, 0), (9, 27, 3)) for a, b in ((x, y), (y, x))]
    trips = [(t, f"F{t % 4}", *spot(), rng.choice([7, 8, 16, 17, 25, 26, 34])) for t in range(80)]
    trips += [trips[3], (90, "F0", 1.0, 1.0, None), (91, "F0", 1.0, 1.0, 2), (92, "F0", 11.0, 11.0, 8), (93, "F0", 1.0, 1.0, 8), (93, "F1", 2.0, 2.0, 17)]
    nodes = spark.createDataFrame(nodes, "place string, building string, floor string, node long, x double, y double")
    edges = spark.createDataFrame([(*k, a, b, w) for k, a, b, w in edges], "place string, building string, floor string, src long, dst long, weight long")
    jumps = spark.createDataFrame([(a, b, w * 10**6) for a, b, w in jumps], "src long, dst long, weight long")
    at = spark.createDataFrame([(t, "P", "B", f, x, y) for t, f, x, y, _ in trips], "trip_id long, place string, building string, floor string, x double, y double")
    asked = spark.createDataFrame([(t, d) for t, _, _, _, d in trips], "trip_id long, dest long")
    o = overlay.Overlay(edges, jumps, spark.createDataFrame([(n,) for n in (7, 8, 16, 17, 25, 26, 34)], "node long"), key)
    seen = sight.seen_pairs(at, nodes, floors, "trip_id", "node").join(floors, key)
    links = seen.select(c("a").alias("trip_id"), c("b").alias("node"), overlay.micrometres(c("weight") * c("m_per_px")).alias("weight"))
    want = overlay.route(asked, links, o)
    got = overlay.route_from(at.join(asked.distinct(), "trip_id"), nodes, floors, o, key)
    rows = lambda d: sorted(map(str, d.distinct().collect()))
    assert rows(got.found) == rows(want.found) and got.found.filter("gate_in IS NULL").count() and got.found.filter("gate_in IS NOT NULL").count()
    assert rows(overlay.route_nodes(got)) == rows(overlay.route_nodes(want))


@pytest.mark.parametrize("most", [0, 40, 1 << 20])
def test_grouped_paths_equal_relaxation(spark, most):
    """In arrays, as rows, and mixed; with parallel edges, weights of zero, a node in two groups and sources without edges."""
    rng = random.Random(7)
    rows = [(g, g * 20 + rng.randrange(12), g * 20 + rng.randrange(12), rng.randrange(4)) for g in range(6) for _ in range(25 + 8 * g)] + [(2, 40, 61, 1), (3, 61, 62, 2)]
    edges = spark.createDataFrame(rows, "g long, src long, dst long, weight long")
    sources = spark.createDataFrame([(n,) for n in [*range(0, 120, 3), 61, 999, 999]], "source long")
    cols = ["source", "node", "cost", "hops", "pred"]
    got = relax.grouped_paths(edges, sources, ["g"], most=most)
    want = relax.shortest_paths(edges.drop("g"), sources)
    assert dict(got.dtypes) == dict(want.dtypes)
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))


def test_retrieval(spark):
    vec = RNG.normal(size=(90, 8)).astype("float32")
    rows = [(i, int(i < 30), v.tolist()) for i, v in enumerate(vec)]
    db = spark.createDataFrame(rows, "image long, map_key long, vec array<float>")
    q = db.select(c("image").alias("query"), "vec")
    got = vectors.retrieve_topk(q, db, 6, skip_self=True, block=16).toPandas()
    u = vec / np.linalg.norm(vec, axis=1, keepdims=True)
    s = (u @ u.T).astype(float)
    np.fill_diagonal(s, -9)
    for i in range(90):
        assert got[got["query"] == i].sort_values("rank")["image"].tolist() == np.argsort(-s[i])[:6].tolist()


def test_pruned_retrieval(spark):
    """Clustered images: the same rows as all pairs, from a few of the cell pairs."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(24, 12))
    vec = (centres[rng.integers(24, size=700)] + rng.normal(size=(700, 12)) * 0.03).astype("float32")
    vec[5] = vec[6]
    db = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(vec)], "image long, map_key long, vec array<float>")
    q = db.filter("image % 2 = 0").select(c("image").alias("query"), "vec")
    index = vectors.index_images(db, block=32, pivots=24)
    got = vectors.retrieve_topk(q, None, 4, skip_self=True, block=32, index=index).toPandas()
    u = vec.astype(float) / np.linalg.norm(vec.astype(float), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    for i in range(0, 700, 2):
        assert got[got["query"] == i].sort_values("rank")["image"].tolist() == np.lexsort((np.arange(700), -s[i]))[:4].tolist()
    q_blocks, first, rest = vectors.search_plan(q, index, 4, True, 32)
    found = vectors._visit(q_blocks, index, first, 4, True)
    more = vectors.needed_visits(q_blocks, found, rest, 4)
    cells = index.cells.count()
    visited = q_blocks.join(first, "q_cell").count() + more.count()
    assert cells >= 20 and visited < q_blocks.count() * cells / 4


def test_retrieval_of_few_and_none(spark):
    db = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [1.0, 0.1])], "image long, map_key long, vec array<float>")
    q = db.select(c("image").alias("query"), "vec")
    assert vectors.retrieve_topk(q, db, 5).count() == 4 and vectors.retrieve_topk(q, db, 5, skip_self=True).count() == 2
    assert vectors.retrieve_topk(q, db.limit(0), 5).count() == 0 and vectors.retrieve_topk(q.limit(0), db, 5).count() == 0


def test_custom_matcher_is_one_to_one(spark):
    from waymark.plans.vector_queries import cosine_above

    vec = RNG.normal(size=(60, 6)).astype("float32")
    rows = [(i // 30, i % 30, v.tolist(), 1.0) for i, v in enumerate(vec)]
    kp = spark.createDataFrame(rows, "image long, kp_idx long, desc array<float>, score double")
    pairs = spark.createDataFrame([(0, 1)], "img1 long, img2 long")
    got = vectors.custom_matches(pairs, kp, cosine_above(0.1), block=7).toPandas()
    assert len(got) and got.kp1.is_unique and got.kp2.is_unique
    whole = vectors.custom_matches(pairs, kp, cosine_above(0.1), block=2048).toPandas()
    assert sorted(map(tuple, got[["kp1", "kp2"]].values)) == sorted(map(tuple, whole[["kp1", "kp2"]].values))


def test_running_band(spark):
    pdf = skewed(1500, 30).rename(columns={"k": "f"})
    pdf.loc[:400, "f"] = 11
    got = clouds.running_band(spark.createDataFrame(pdf), "f", "v", fan=5, size=4).toPandas().set_index("f")
    assert sorted(got.index) == sorted(pdf.f.unique())
    for f in sorted(pdf.f.unique()):
        assert got.loc[f, "n"] == (pdf.f <= f).sum()
        v = pdf[pdf.f <= f].v
        assert got.loc[f, "median"] == pytest.approx(np.median(v))
        assert got.loc[f, "band_hi"] == pytest.approx(np.median(v) + 2 * v.std(ddof=0))


def test_search_names_sorts_no_substrings(spark):
    """Substrings and hits go through hash aggregates; names repeat an ord or have none, and the smallest name of the first ord is given."""
    names = spark.createDataFrame([(None, "Zed hall"), (2, "Hall b"), (2, "hall A"), (1, "other"), (3, "zed room"), (4, None)], "ord long, name string")
    terms = spark.createDataFrame([(1, "all"), (2, "hall "), (3, "LL b"), (4, "none"), (5, "ZED ROOM"), (6, "ed")], "term_id long, term string")
    out = lookups.search_names(terms, names)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate(key=[_g" not in plan and "HashAggregate(keys=[_g" in plan
    want = {1: (None, "Zed hall"), 2: (2, "Hall b"), 3: (2, "Hall b"), 4: (None, None), 5: (3, "zed room"), 6: (None, "Zed hall")}
    assert {r.term_id: (r.ord, r.name) for r in out.collect()} == want


def test_search_names_with_a_common_substring(spark):
    rnd = random.Random(5)
    names = [(i, "Customer " + "".join(rnd.choice("abC1") for _ in range(5))) for i in range(300)]
    terms = [(j, t) for j, t in enumerate(["customer", "CUSTOMER", "mer", "a", "er c", "zzz", "stomerx", *["".join(rnd.choice("abc1 ") for _ in range(rnd.randint(2, 5))) + "1" for _ in range(60)]])]
    got = lookups.search_names(spark.createDataFrame(terms, "term_id long, term string"), spark.createDataFrame(names, "ord long, name string"), size=20)
    want = {j: next((o for o, n in names if t.lower() in n.lower()), None) for j, t in terms}
    assert {r.term_id: r.ord for r in got.collect()} == want


def test_crowded_cell(spark):
    """A third of all points in one cell: same pairs and clusters as all pairs, and no key of the join holds a share of the rows."""
    xy = np.vstack([RNG.random((150, 2)) * 0.4 + 5, RNG.random((300, 2)) * 20])
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id long, x double, z double")
    left = points.select(F.col("id").alias("a"), F.col("x").alias("ax"), F.col("z").alias("az"))
    right = points.select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("z").alias("bz"))
    near = cells.near_join(left, right, [], ["ax", "az"], ["bx", "bz"], 1.0, size=10).filter("_d < 1").select("a", "b").collect()
    gaps = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
    assert sorted((r.a, r.b) for r in near) == sorted(zip(*map(list, np.nonzero(gaps < 1))))
    keyed = points.withColumn("k", F.floor("x"))
    n = keyed.groupBy("k").agg(F.count("*").alias("n"))
    for side in cells.deal(keyed, keyed, ["k"], (n, n), 10):
        assert side.groupBy("k", "_lb", "_rb").count().agg(F.max("count")).first()[0] <= 30
    got = {r.id: r.cluster for r in cells.components(points, "id", ["x", "z"], 1.0, size=10).collect()}
    label = np.arange(len(xy))
    while True:
        new = np.where(gaps <= 1, label[None], len(xy)).min(axis=1)
        if (new == label).all():
            break
        label = new
    assert got == dict(enumerate(label.tolist()))


def test_feature_partitions_are_pruned(spark, tmp_path):
    from waymark.sources import features

    rows = spark.range(4000).select(
        F.lit("p").alias("place"), F.lit("b").alias("building"), F.when(F.col("id") % 3 == 0, "0").otherwise((F.col("id") % 40).cast("string")).alias("floor"),
        F.col("id").alias("vec_id"),
    )
    features.write_features(rows, str(tmp_path / "f"))
    maps = rows.filter("floor in ('7', '12')")
    read = features.read_features(spark, str(tmp_path / "f"), maps, ["floor", "vec_id"])
    assert sorted(r.vec_id for r in read.collect()) == [i for i in range(4000) if i % 3 and i % 40 in (7, 12)]
    assert "dynamicpruning" in read._jdf.queryExecution().executedPlan().toString()
    folders = {f.parent.name for f in (tmp_path / "f").rglob("*.parquet")}
    assert folders == {f"floor={r.floor}" for r in rows.select("floor").distinct().collect()}


def test_running_scan(spark):
    from waymark.operators.ranks import running

    pdf = pd.DataFrame({"g": np.where(RNG.random(600) < 0.7, "hot", "rest"), "t": RNG.permutation(600), "v": RNG.integers(-9, 9, 600)})
    pdf["m"] = pdf.v.where(pdf.v > 5)
    got = running(spark.createDataFrame(pdf).withColumn("m", F.nanvl("m", F.lit(None))), ["g"], ["t"], sums=("v",), maxima=("m",))
    want = pdf.sort_values("t")
    want = want.assign(v=want.groupby("g").v.cumsum(), m=want.groupby("g").m.cummax().groupby(want.g).ffill())
    assert sorted((r.g, r.t, r.v, r.m) for r in got.collect()) == sorted(
        (g, t, v, None if np.isnan(m) else m) for g, t, v, m in want[["g", "t", "v", "m"]].values.tolist()
    )
    whole = running(spark.createDataFrame(pdf[["t", "v"]]), [], ["t"], sums=("v",))
    assert [r.v for r in whole.orderBy("t").collect()] == pdf.sort_values("t").v.cumsum().tolist()
    assert running(spark.createDataFrame([], "t long, v long"), [], ["t"], sums=("v",)).collect() == []


def test_plane_normal(spark):
    xz = RNG.random((400, 2)) * 10
    y = 0.1 * xz[:, 0] - 0.2 * xz[:, 1] + RNG.normal(0, 0.001, 400)
    df = spark.createDataFrame(pd.DataFrame({"x": xz[:, 0], "y": y, "z": xz[:, 1]}))
    r = clouds.plane_normal(df).first()
    n = np.array([-0.1, 1.0, 0.2]) / np.linalg.norm([-0.1, 1.0, 0.2])
    assert [r.nx, r.ny, r.nz] == pytest.approx(n.tolist(), abs=1e-3)
    rot = np.array([r[f"r{i}"] for i in range(9)]).reshape(3, 3)
    assert (rot @ [r.nx, r.ny, r.nz]).tolist() == pytest.approx([0, 1, 0], abs=1e-9)


def test_search_names(spark):
    names = spark.createDataFrame([(0, "Main Hall"), (1, "hall B"), (2, "Exit")], "ord long, name string")
    terms = spark.createDataFrame([(1, "HALL"), (2, "x"), (3, "zz"), (4, "b")], "term_id long, term string")
    got = {r.term_id: r.ord for r in lookups.search_names(terms, names).collect()}
    assert got == {1: 0, 2: 2, 3: None, 4: 1}


def test_alias_edits(spark):
    base = spark.createDataFrame([("en", "a", "X"), ("en", "b", "Y")], "lang string, alias string, canonical string")
    edits = spark.createDataFrame(
        [("en", "a", "Z", False, 1), ("en", "b", None, True, 2), ("zh", "c", "W", False, 3), ("en", "a", "", False, 4)],
        "lang string, alias string, canonical string, delete boolean, t long",
    )
    got = sorted(map(tuple, lookups.merge_aliases(base, edits, ["t"]).collect()))
    assert got == [("en", "a", "Z"), ("zh", "c", "W")]


def test_row_numbers_of_a_large_group_and_a_shared_value(spark):
    """A third of the rows in one group, and a third of those with one value of the first order column."""
    rows = [(0 if i % 3 == 0 else 1 + i % 40, 5.0 if i % 9 < 3 else float(RNG.integers(50)), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, v double, i long")
    got = {r.i: r.n for r in ranks.group_index(df, ["k"], ["v", "i"], "n").collect()}
    pdf = pd.DataFrame(rows, columns=["k", "v", "i"]).sort_values(["k", "v", "i"])
    want = dict(zip(pdf.i, pdf.groupby("k").cumcount(), strict=True))
    assert got == want


def test_mask_pixels_are_never_broadcast(spark):
    """An exploded range looks as small as the rows it came from; the pixels of all masks must not go through the driver for that."""
    kf = spark.range(40).select(c("id").alias("kf"))
    frames = kf.select("kf", *[F.lit(float(i % 4 == 0)).alias(f"r{i}") for i in range(9)], *[F.lit(0.0).alias(n) for n in ("tx", "ty", "tz")])
    masks = kf.select("kf", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("u")).select("kf", "u", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("v"))
    points = kf.select("kf", (c("kf") % 7 - 3.0).alias("x"), F.lit(0.5).alias("y"), F.lit(2.0).alias("z"))
    out = clouds.masked_points(points, frames, masks.filter("kf % 2 = 0"), (32, 16))
    got = out.groupBy("status").count().collect()
    assert {r.status: r["count"] for r in got} == {"floor": 20, "no_mask": 20}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert any("SortMergeJoin [kf" in line and ", u#" in line and ", v#" in line for line in plan.splitlines())


def test_retrieval_sends_images_once_a_team(spark, monkeypatch):
    """Many small query blocks: the images go to a team of blocks, k rows a query come back, and slices and null map keys change nothing."""
    rng = np.random.default_rng(3)
    vec = rng.normal(size=(600, 8)).astype("float32")
    vec[50:60] = vec[40]
    db = spark.createDataFrame([(i, None if i % 5 == 0 else i % 3, v.tolist()) for i, v in enumerate(vec)], "image long, map_key long, vec array<float>")
    q = db.select(c("image").alias("query"), "vec")
    index = vectors.index_images(db, block=16, pivots=2)
    q_blocks, first, rest = vectors.search_plan(q, index, 7, block=16)
    assert q_blocks.count() > 30
    every = first.unionByName(rest.select("q_cell", "cell"))
    assert vectors._visit(q_blocks, index, every, 7, False, 16).count() == 7 * 600
    u = vec.astype(float) / np.linalg.norm(vec.astype(float), axis=1, keepdims=True)
    s = (u @ u.T).round(12)
    for size in (1 << 18, 100):
        monkeypatch.setattr(vectors, "SLICE", size)
        got = vectors.retrieve_topk(q, None, 7, block=16, index=index).toPandas()
        for i in range(0, 600, 7):
            top = got[got["query"] == i].sort_values("rank")
            assert np.allclose(top["score"], -np.sort(-s[i])[:7])
            assert all((np.isnan(m) if j % 5 == 0 else m == j % 3) for j, m in zip(top["image"], top["map_key"], strict=True))


def test_nearest_of_all_in_a_crowd(spark):
    """A crowd in one cell, equal distances and many left rows: the same as all pairs, and cells that cannot win are not opened."""
    rng = np.random.default_rng(5)
    spots = np.concatenate([rng.uniform(0, 0.4, (4000, 3)), rng.uniform(-3, 3, (500, 3)), np.round(rng.uniform(-3, 3, (500, 3)) * 2) / 2])
    left = np.concatenate([rng.uniform(-0.2, 0.6, (300, 3)), np.round(rng.uniform(-3, 3, (300, 3)) * 2) / 2])
    right = spark.createDataFrame([(float(x), float(y), float(z)) for x, y, z in spots] + [(float("nan"), 0.0, 0.0), (None, 0.0, 0.0)], "x double, y double, z double").distinct()
    rows = spark.createDataFrame([(i % 200, i, float(x), float(y), float(z)) for i, (x, y, z) in enumerate(left)], "kf long, step long, sx double, sy double, sz double")
    got = {r.kf: tuple(r.m) for r in cells.nearest_of_all(rows, right, "kf", ["sx", "sy", "sz"], ["x", "y", "z"], 0.5, ["step", "x", "y", "z"], leaf=4).collect()}
    want = {}
    for i, p in enumerate(left):
        q = p - spots
        d = np.sqrt(q[:, 0] * q[:, 0] + q[:, 1] * q[:, 1] + q[:, 2] * q[:, 2])
        for j in np.flatnonzero(d < 0.5):
            found = (float(d[j]), i, *map(float, spots[j]))
            want[i % 200] = min(want.get(i % 200, found), found)
    assert got == want


def test_cluster_labels_are_not_broadcast(spark):
    """Labels grow with the points, so no join with them may send them through the driver, small as they are here."""
    rows = spark.createDataFrame([(i, float(i % 50), float(i // 50) * 0.4) for i in range(200)], "id long, x double, z double")
    out = cells.components(rows, "id", ["x", "z"], 0.5)
    assert {r["count"] for r in out.groupBy("cluster").count().collect()} == {4}
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
