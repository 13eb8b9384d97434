"""Streams replayed over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions.geometry import clean
from waymark.operators import history as windows
from waymark.operators import localize as loc
from waymark.operators.ranks import with_row
from waymark.plans import recipes as rec
from waymark.plans.localize_queries import LOCALIZE_SQL, OPTIONS, frame_inputs, fuse_sql, rounded
from waymark.plans.lookup_queries import LABEL_MERGE_SQL, label_changes
from waymark.plans.source_queries import label_rows
from waymark.plans.registry import query
from waymark.session import cut_lineage, filesystem, shared_folder
from waymark.streaming import history, jobs

c = F.col


def replayed(t, name):
    """A table as a stream: from its own folder of part files, or its one file among the others of the scale folder."""
    path = f"{t.folder.rstrip('/')}/{name}.parquet"
    fs, at = filesystem(t.spark, path)
    reader = t.spark.readStream.schema(getattr(t, name).schema)
    if fs.getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(t.folder)


@query(
    "stream_last5",
    f"""WITH {rec.TRAJ_SQL} SELECT session, map_key, event_id, count(*) OVER w AS n_frames, round(avg(inliers) OVER w,6)+0.0 AS mean_value, array_to_string(list(event_id) OVER w,',') AS history FROM traj
    WINDOW w AS (PARTITION BY session, map_key ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
)
def stream_last5(t):
    """The frame history kept as stream state; equals the batch window."""
    frames = replayed(t, "events").select(
        c("user_id").alias("session"), c("event_type").alias("map_key"), "event_id", c("ts").cast("timestamp").alias("ts"), "value"
    )
    table = jobs.stream_to_table(history.last_frames_stream(frames), shared_folder(t.spark, "last5"))
    return table.withColumn("mean_value", clean(c("mean_value")))


# Frames with a pose: the map changes every few frames of a session, and a gap of over two days ends a history.
POSES_SQL = """ps AS (SELECT user_id AS session, ts, event_id, 'm'||(event_id//400 % 3) AS map_key, CAST((event_id*37) % 101 AS DOUBLE) AS x, CAST((event_id*53) % 97 AS DOUBLE) AS y, (user_id*31) % 360 + value*1.3 AS heading, CAST(1+event_id%9 AS DOUBLE) AS weight FROM events)"""
IDLE_S = 172_800


def history_sql(ps, idle):
    """Windows of up to five rows within a run of one map without a long gap, fused as in ``fuse_sql``; one row a frame."""
    return f"""ch AS (SELECT *, row_number() OVER w AS rn, CASE WHEN lag(map_key) OVER w <> map_key OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > {idle}::BIGINT * 1000000 THEN 1 ELSE 0 END AS new FROM {ps} WINDOW w AS (PARTITION BY session ORDER BY ts, event_id)),
ru AS (SELECT *, sum(new) OVER (PARTITION BY session ORDER BY rn) AS run FROM ch),
wi AS (SELECT a.event_id AS query, b.map_key, b.x, b.y, b.heading, b.weight, b.rn AS ord FROM ru a JOIN ru b ON a.session=b.session AND a.run=b.run AND b.rn BETWEEN a.rn-4 AND a.rn),
{fuse_sql('wi', 'query')},
es AS (SELECT f.query AS event_id, f.n AS n_frames, CAST(p.pairs AS BIGINT) AS pairs, round(f.x,5)+0.0 AS est_x, round(f.y,5)+0.0 AS est_y, round(f.heading,4)+0.0 AS est_heading FROM fused f JOIN (SELECT query, sum(weight) AS pairs FROM wi GROUP BY 1) p USING (query))"""


def posed_frames(t, events):
    e = c("event_id")
    return events.select(
        c("user_id").alias("session"), c("ts").cast("timestamp").alias("ts"), "event_id", F.concat(F.lit("m"), F.floor(e / 400) % 3).alias("map_key"), ((e * 37) % 101).cast("double").alias("x"),
        ((e * 53) % 97).cast("double").alias("y"), ((c("user_id") * 31) % 360 + c("value") * 1.3).alias("heading"), (e % 9 + 1).cast("double").alias("weight"),
    )


def estimates(out):
    return out.withColumns({"est_x": clean(c("est_x"), 5), "est_y": clean(c("est_y"), 5), "est_heading": clean(c("est_heading"), 4)})


POSE_SQL = f"WITH {POSES_SQL}, {history_sql('ps', IDLE_S)} SELECT session, ps.event_id, map_key, n_frames, pairs, est_x, est_y, est_heading FROM ps JOIN es USING (event_id)"


@query("pose_history", POSE_SQL)
def pose_history(t):
    """The pose of each frame fused over its session's last five frames on that map, as a batch."""
    out = windows.pose_history(posed_frames(t, t.events), idle=IDLE_S)
    return estimates(out).select("session", "event_id", "map_key", "n_frames", "pairs", "est_x", "est_y", "est_heading")


@query("stream_pose", POSE_SQL)
def stream_pose(t):
    """The same as stream state, reset when the map changes or the session was idle."""
    frames = posed_frames(t, replayed(t, "events"))
    table = jobs.stream_to_table(history.pose_history_stream(frames, idle_s=IDLE_S, late="400 days"), shared_folder(t.spark, "poses"))
    return estimates(table).select("session", "event_id", "map_key", "n_frames", "pairs", "est_x", "est_y", "est_heading")


HISTORY_SQL = LOCALIZE_SQL.replace("SELECT query, stage IS NULL AS success", ", lo AS (SELECT query, stage IS NULL AS success", 1)
for _n, _d in (("x", 5), ("y", 5), ("heading", 4)):
    HISTORY_SQL = HISTORY_SQL.replace(f"round({_n},{_d})+0.0 END AS {_n}", f"{_n} END AS {_n}")  # rounded at the end only
HISTORY_SQL = f"""{HISTORY_SQL}), pf AS (SELECT query % 7 AS session, to_timestamp(1700000000 + query) AS ts, query AS event_id, map_key::VARCHAR AS map_key, x, y, heading, total::DOUBLE AS weight FROM lo WHERE success),
{history_sql('pf', 10**9).replace('fa AS', 'fa2 AS').replace('FROM fa ', 'FROM fa2 ').replace('JOIN fa ON fa.', 'JOIN fa2 fa ON fa.').replace('fk AS', 'fk2 AS').replace('fm AS', 'fm2 AS').replace('fused AS (SELECT fa.', 'fused2 AS (SELECT fa2.').replace('FROM fa2 LEFT JOIN fk USING', 'FROM fa2 LEFT JOIN fk2 USING').replace('JOIN fm USING', 'JOIN fm2 USING').replace('FROM fused f', 'FROM fused2 f')}
SELECT lo.query, success, stage, reason, map_key, total, images, round(x,5)+0.0 AS x, round(y,5)+0.0 AS y, round(heading,4)+0.0 AS heading, lo.query % 7 AS session, n_frames, pairs, est_x, est_y, est_heading FROM lo LEFT JOIN es ON es.event_id=lo.query"""


def sessions(frames):
    """Frames of seven sessions in the order of their number."""
    return frames.withColumns({"session": (c("query") % 7).cast("long"), "ts": F.timestamp_seconds(c("query") + 1_700_000_000)})


@query("localize_history", HISTORY_SQL)
def localize_history(t):
    """Localization with the pose refined over each session's last frames, as a batch."""
    frames, tables = frame_inputs(t)
    frames = cut_lineage(sessions(frames))
    found = cut_lineage(loc.localize(frames.select("query", "vec", "local"), tables, **OPTIONS).join(frames.select("query", "session", "ts"), "query"))
    out = jobs.with_history(found, windows.pose_history(jobs.found_frames(found)))
    return estimates(rounded(out)).drop("ts")


@query("localize_history_stream", HISTORY_SQL)
def localize_history_stream(t):
    """The same over a stream in two micro-batches, some frames sent twice."""
    frames, tables = frame_inputs(t)
    frames = cut_lineage(sessions(frames))
    half = frames.agg(F.max("query")).first()[0] // 2
    inbox = shared_folder(t.spark, "frames")
    for part in (frames.filter(c("query") <= half), frames.filter((c("query") > half) | (c("query") % 5 == 0))):
        part.coalesce(1).write.mode("append").parquet(inbox)  # one file a micro-batch, in the order of writing
    stream = t.spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(inbox)
    read = jobs.localize_history_stream(stream, tables, shared_folder(t.spark, "history"), **OPTIONS)
    return estimates(rounded(read())).drop("ts")


@query("localize_stream", LOCALIZE_SQL)
def localize_stream(t):
    """Frames arrive as a stream, every third one twice; results equal the batch job."""
    frames, tables = frame_inputs(t)
    stamped = frames.withColumn("ts", F.timestamp_seconds(c("query") + 1_700_000_000))
    twice = stamped.unionByName(stamped.filter(c("query") % 3 == 0))
    inbox = shared_folder(t.spark, "frames")
    twice.repartition(2, "query").write.parquet(inbox)
    stream = t.spark.readStream.schema(twice.schema).option("maxFilesPerTrigger", 1).parquet(inbox)
    out = shared_folder(t.spark, "poses")
    jobs.localize_stream(stream, tables, out, **OPTIONS)
    return rounded(t.spark.read.parquet(out).drop("batch"))


def streamed(t, rows, name, parts=4):
    """Rows written as ``parts`` files and read back one file a micro-batch, in whatever order they were finished."""
    inbox = shared_folder(t.spark, name)
    rows.repartitionByRange(parts, "ts", "event_id").write.parquet(inbox)
    return t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(inbox)


@query("label_edits", LABEL_MERGE_SQL)
def label_edits(t):
    """Label edits as a stream of several micro-batches; equals the merge of the whole log."""
    latest = jobs.label_stream(streamed(t, label_changes(t), "edits"), label_rows(t), shared_folder(t.spark, "labels"), ["ts", "event_id"])
    return latest()


ALIAS_SQL = """WITH base AS (SELECT ['en','zh','th'][CAST(c_custkey % 3 AS INT)+1] AS lang, 'a'||c_custkey AS alias, 'r/'||c_custkey AS canonical FROM customer),
ch AS (SELECT event_id, ts, ['en','zh','th'][CAST(event_id % 3 AS INT)+1] AS lang, 'a'||((event_id*11) % (SELECT 2*count(*) FROM customer)) AS alias, CASE WHEN event_id % 7 = 0 THEN '' ELSE 'e/'||event_id END AS canonical, event_id % 5 = 0 AS del FROM events),
la AS (SELECT lang, alias, max_by(canonical,(ts,event_id)) AS canonical, max_by(del,(ts,event_id)) AS del FROM ch WHERE del OR canonical<>'' GROUP BY ALL)
SELECT coalesce(b.lang,a.lang) AS lang, coalesce(b.alias,a.alias) AS alias, coalesce(a.canonical,b.canonical) AS canonical FROM base b FULL JOIN la a ON a.lang=b.lang AND a.alias=b.alias WHERE coalesce(del,false)=false"""


@query("alias_edits", ALIAS_SQL)
def alias_edits(t):
    """Alias edits and deletions as a stream of several micro-batches."""
    langs = F.array(*[F.lit(x) for x in ("en", "zh", "th")])
    k, e = c("c_custkey"), c("event_id")
    base = t.customer.select(langs[(k % 3).cast("int")].alias("lang"), F.concat(F.lit("a"), k).alias("alias"), F.concat(F.lit("r/"), k).alias("canonical"))
    edits = with_row(t.events, t.customer.agg((2 * F.count("*")).alias("_n"))).select(
        "event_id", "ts", langs[(e % 3).cast("int")].alias("lang"), F.concat(F.lit(" a"), (e * 11) % c("_n")).alias("alias"),
        F.when(e % 7 == 0, " ").otherwise(F.concat(F.lit("e/"), e)).alias("canonical"), (e % 5 == 0).alias("delete"),
    )
    latest = jobs.alias_stream(streamed(t, edits, "alias-edits"), base, shared_folder(t.spark, "aliases"), ["ts", "event_id"])
    return latest()
