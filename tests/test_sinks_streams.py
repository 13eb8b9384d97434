"""Sinks and streams on small folders."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from waymark.operators import lookups
from waymark.sources import clouds, features
from waymark.streaming import history, jobs

c = F.col


def test_cloud_round_trip(spark, tmp_path):
    pts = spark.createDataFrame([(1.5, -2.0, 3.25, 10, 20, 30)], "x double, y double, z double, r int, g int, b int")
    clouds.write_cloud(pts, str(tmp_path / "cloud"))
    assert tuple(clouds.read_cloud(spark, str(tmp_path / "cloud")).first()) == (1.5, -2.0, 3.25, 10, 20, 30)
    head = spark.createDataFrame([(s,) for s in clouds.cloud_header(3).splitlines()], "value string")
    assert clouds.parse_point_lines(head).count() == 0


def test_feature_and_pair_sinks(spark, tmp_path):
    rows = spark.createDataFrame(
        [("p", "b", f"f{i % 2}", f"v{i}", [1.0, 2.0]) for i in range(6)], "place string, building string, floor string, image string, vec array<float>"
    )
    features.write_features(rows, str(tmp_path / "feats"))
    one = spark.createDataFrame([("p", "b", "f1")], "place string, building string, floor string")
    got = features.read_features(spark, str(tmp_path / "feats"), one, ["image"])
    assert sorted(r.image for r in got.collect()) == ["v1", "v3", "v5"]
    pairs = spark.createDataFrame([("b", "a"), ("a", "b"), ("c", "c"), ("c", "a")], "img1 string, img2 string")
    features.write_pairs(pairs, str(tmp_path / "pairs"))
    assert [r.value for r in spark.read.text(str(tmp_path / "pairs")).collect()] == ["a b", "a c"]


def test_history_survives_micro_batches(spark, tmp_path):
    schema = "session long, map_key string, event_id long, ts timestamp, value double"
    for part in range(3):
        rows = spark.range(part * 4, part * 4 + 4).select(
            (c("id") % 2).alias("session"), F.lit("m").alias("map_key"), c("id").alias("event_id"),
            F.timestamp_seconds(c("id")).alias("ts"), c("id").cast("double").alias("value"),
        )
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = jobs.stream_to_table(history.last_frames_stream(stream, n=3), str(tmp_path / "out"))
    got = {r.event_id: (r.n_frames, r.history) for r in out.collect()}
    assert got[0] == (1, "0") and got[5] == (3, "1,3,5") and got[11] == (3, "7,9,11") and len(got) == 12


def test_history_folds_rows_without_a_data_frame_per_key(spark, tmp_path, monkeypatch):
    """Frames out of order, without a value, an id or a time; a data frame per key cost more than its rows."""
    from types import SimpleNamespace

    held = []
    state = SimpleNamespace(get=lambda: list(held), put=lambda rows: held.__setitem__(slice(None), rows))
    keeper = history.LastFrames(2)
    keeper.init(SimpleNamespace(getListState=lambda *_: state))
    monkeypatch.setattr(history.pd, "concat", None)
    monkeypatch.setattr(history.pd, "DataFrame", None)
    frame = Row("micros", "event_id", "value")
    out = list(keeper.handleInputRows((7, "m"), iter([frame(3, 2, 4.0), frame(None, 9, 1.0), frame(1, 5, 2.0), frame(1, 4, 1.0)]), None))
    assert [tuple(r) for r in out] == [(7, "m", 4, 1, 1.0, "4"), (7, "m", 5, 2, 1.5, "4,5"), (7, "m", 2, 2, 3.0, "5,2"), (7, "m", 9, 2, 2.5, "2,9")]
    assert held == [(2, 4.0), (9, 1.0)]
    out = list(keeper.handleInputRows((7, "m"), iter([frame(8, 10, None), frame(7, None, 3.0)]), None))
    assert [tuple(r)[2:5] for r in out] == [(history.NO_ID, 2, 2.0), (10, 2, None)]


def test_label_stream_equals_batch(spark, tmp_path):
    base = spark.createDataFrame([("places", "a", "en", "A"), ("places", "b", "en", "B")], "section string, key string, lang string, text string")
    schema = "section string, key string, lang string, text string, t long"
    log = [("places", "a", "en", " ", 1), ("places", "a", "zh", "甲", 2), ("rooms", "x", "en", "no", 3), ("places", "b", "en", "B2", 4), ("places", "b", "en", "B3", 5)]
    for row in log:
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    latest = jobs.label_stream(stream, base, str(tmp_path / "labels"), ["t"])
    want = lookups.merge_labels(base, spark.createDataFrame(log, schema), ["t"])
    assert sorted(map(tuple, latest().collect())) == sorted(map(tuple, want.select("section", "key", "lang", "text").collect()))

    # A restart without new input keeps all edits; new edits go on from them.
    again = jobs.label_stream(stream, base, str(tmp_path / "labels"), ["t"])
    assert sorted(map(tuple, again().collect())) == sorted(map(tuple, latest().collect()))
    spark.createDataFrame([("places", "c", "en", "C", 6)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    more = jobs.label_stream(stream, base, str(tmp_path / "labels"), ["t"])
    assert sorted(map(tuple, more().collect())) == sorted([*map(tuple, latest().collect())])
    assert ("places", "c", "en", "C") in set(map(tuple, more().collect()))


def test_streams_read_folder_tables(spark, folder, tmp_path):
    from waymark.plans import load
    from waymark.session import read_table

    read_table(spark, folder, "events").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    assert load()[0]["stream_last5"](spark, str(tmp_path)).count() == read_table(spark, folder, "events").count()


def test_late_frames_are_kept(spark, tmp_path):
    schema = "query long, ts timestamp"
    for rows in ([(1, 9000), (2, 9000)], [(2, 9001), (3, 10)]):
        spark.createDataFrame(rows, "query long, t long").select("query", F.timestamp_seconds("t").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = jobs.stream_to_table(jobs.unique_frames(stream), str(tmp_path / "out"))
    assert sorted(r["query"] for r in out.collect()) == [1, 2, 3]
