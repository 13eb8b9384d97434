"""Streaming jobs: frame localization and label edits per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from waymark.operators.history import FRAMES, history_step
from waymark.operators.localize import MapTables, localize
from waymark.operators.lookups import last_changes, merge_aliases, merge_labels, usable_aliases, usable_labels
from waymark.session import cut_lineage, filesystem


def run_available(writer, path: str) -> StreamingQuery:
    """Process everything that is there, then stop."""
    q = writer.option("checkpointLocation", f"{path}-progress").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return q


def stream_to_table(stream: DataFrame, path: str) -> DataFrame:
    """Run an append-mode stream into a Parquet table and return that table."""
    run_available(stream.writeStream.format("parquet").outputMode("append").option("path", path), path)
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def unique_frames(frames: DataFrame) -> DataFrame:
    """Drop frames sent twice, however late; no frame is lost, so the state holds each query id once."""
    return frames.dropDuplicates(["query"])


def localize_stream(
    frames: DataFrame, tables: MapTables, path: str, **options
) -> None:
    """Localize each micro-batch against a map that was prepared once; one result file set per batch id.

    Writing to a folder named by the batch id makes a replayed batch overwrite itself.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        # The job reads its frames several times: materialize the batch once.
        localize(cut_lineage(batch.select("query", "vec", "local")), tables, **options).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    run_available(unique_frames(frames).writeStream.foreachBatch(each), path)


def localize_history_stream(frames: DataFrame, tables: MapTables, path: str, n: int = FRAMES, idle: int | None = None, **options) -> Callable[[], DataFrame]:
    """Localize each micro-batch and refine each pose over its session's last frames; returns a reader of the results.

    ``frames``: query, session, ts, vec, local. Two stateful steps follow each other in one query: frames sent twice are dropped, and what verification finds
    goes into the sessions' histories, kept as a table per version: batch ``b`` reads version ``b`` and writes ``b + 1``, so a replayed batch
    overwrites itself and a restart goes on from what storage holds. A failed frame has its status and no estimate, and leaves the history alone.
    """
    spark = frames.sparkSession

    def each(batch: DataFrame, batch_id: int) -> None:
        rows = cut_lineage(batch.select("query", "session", "ts", "vec", "local"))
        found = cut_lineage(localize(rows.select("query", "vec", "local"), tables, **options).join(rows.select("query", "session", "ts"), "query"))
        new = found_frames(found)
        before = newest_version(spark, path, batch_id + 1)
        held = new.limit(0) if before is None else spark.read.schema(new.schema).parquet(f"{path}/v{before}")
        estimates, keep = history_step(held, new, n=n, idle=idle)
        with_history(found, estimates).write.mode("overwrite").parquet(f"{path}/out/batch={batch_id}")
        keep.write.mode("overwrite").parquet(f"{path}/v{batch_id + 1}")

    run_available(unique_frames(frames).writeStream.foreachBatch(each), path)
    return lambda: spark.read.parquet(f"{path}/out").drop("batch")


def found_frames(found: DataFrame) -> DataFrame:
    """The successful frames of a localization (with session and ts) as a history takes them."""
    return found.filter("success").select(
        "session", "ts", F.col("query").alias("event_id"), F.col("map_key").cast("string").alias("map_key"), "x", "y", "heading", F.col("total").cast("double").alias("weight")
    )


def with_history(found: DataFrame, estimates: DataFrame) -> DataFrame:
    """Localization rows with the estimate over their history; failed frames have none."""
    refined = estimates.select(F.col("event_id").alias("query"), "n_frames", "pairs", "est_x", "est_y", "est_heading")
    return found.join(refined, "query", "left")


def newest_version(spark: SparkSession, path: str, below: int | None = None) -> int | None:
    """The largest ``b`` with a complete table ``path/v<b>``, below ``below`` if that is given."""
    fs, at = filesystem(spark, path)
    if not fs.exists(at):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    whole = [int(n[1:]) for n in names if n[0] == "v" and n[1:].isdigit() and fs.exists(filesystem(spark, f"{path}/{n}/_SUCCESS")[1])]
    return max((v for v in whole if below is None or v < below), default=None)


def edit_stream(
    changes: DataFrame, base: DataFrame, path: str, keys: list[str], order: list[str],
    usable: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame, DataFrame, list[str]], DataFrame],
) -> Callable[[], DataFrame]:
    """Fold change batches into compacted change tables below ``path``; returns a reader that merges the newest one into the base.

    The base is written once and never again. Version ``b + 1`` holds the last change per key, by ``order``, of all batches up to ``b``:
    a late change never undoes a newer one, a replayed batch overwrites itself, and a restart, with or without new
    input, goes on from what storage holds.
    """
    spark = changes.sparkSession
    fs, at = filesystem(spark, f"{path}/base/_SUCCESS")
    if not fs.exists(at):
        base.write.mode("overwrite").parquet(f"{path}/base")

    def each(batch: DataFrame, batch_id: int) -> None:
        new = usable(cut_lineage(batch))
        before = newest_version(spark, path, batch_id + 1)
        if before is not None:
            new = spark.read.schema(new.schema).parquet(f"{path}/v{before}").unionByName(new)
        last_changes(new, keys, order).select(*new.columns).write.mode("overwrite").parquet(f"{path}/v{batch_id + 1}")

    run_available(changes.writeStream.foreachBatch(each), path)

    def latest() -> DataFrame:
        old, version = spark.read.parquet(f"{path}/base"), newest_version(spark, path)
        return old if version is None else merge(old, spark.read.parquet(f"{path}/v{version}"), order)

    return latest


def label_stream(changes: DataFrame, base: DataFrame, path: str, order: list[str]) -> Callable[[], DataFrame]:
    """Label edits (section, key, lang, text and the order columns) as a stream."""
    return edit_stream(changes, base.select("section", "key", "lang", "text"), path, ["section", "key", "lang"], order, usable_labels, merge_labels)


def alias_stream(changes: DataFrame, base: DataFrame, path: str, order: list[str]) -> Callable[[], DataFrame]:
    """Alias edits (lang, alias, canonical, delete and the order columns) as a stream."""
    return edit_stream(changes, base.select("lang", "alias", "canonical"), path, ["lang", "alias"], order, usable_aliases, merge_aliases)
