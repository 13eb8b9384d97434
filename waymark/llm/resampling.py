"""Importance resampling towards a target text, with ranks from a distributed radix sort.

A text's features are its runs of one to three words, hashed into buckets. An array holds each bucket's gain, the log ratio of
target and corpus shares; a text's weight is the sum of gains over its features. A Gumbel draw seeded by the row's id is added,
so the highest scores are a weighted sample without replacement. The scores are ordered by a least-significant-digit radix
sort: each pass counts digits per block of rows, turns the counts into global offsets, and so gives every row its destination.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.crc import run_crcs
from waymark.llm.session import fresh
from waymark.llm.words import Words, words
from waymark.session import filesystem, parallelism, shared_folder

BUCKETS = 10_000
LONGEST = 3
#: Percent of the texts with at least LEAST_WORDS words that are drawn.
PERCENT, LEAST_WORDS = 5, 20
SEED = 42
#: Bits of a radix digit, at most; so a pass has at most 1,024 different digits.
DIGIT = 10
#: Rows of one block of a pass, at most: the most rows that are ordered together.
BLOCK = 1 << 16
#: Blocks whose counts are added up before a running sum goes over them.
SPAN = 32
#: Words whose runs are worked on at once.
PIECE = 1 << 18


def _pieces(w: Words):
    """(first word, buckets of the runs from each word on, whether each run stays in its row), PIECE words at a time."""
    n = len(w.starts)
    ends = np.repeat(w.at[1:], np.diff(w.at))
    for lo in range(0, n, PIECE):
        hi = min(lo + PIECE, n)
        more = min(hi + LONGEST - 1, n)
        part = Words(0, 1, w.hashes[lo:more], w.starts[lo:more], w.ends[lo:more], None, w.raw, w.base)
        index = np.arange(lo, hi)
        yield lo, [(c[:hi - lo] % np.uint32(BUCKETS), index + k < ends[lo:hi]) for k, c in enumerate(run_crcs(part, LONGEST))]


def bucket_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """(bucket, n): how many features of all ``texts`` fall into each bucket; each task sends at most BUCKETS sums."""

    def run(batches):
        n = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for w in words(b.column(0)):
                for _, runs in _pieces(w):
                    for bucket, inside in runs:
                        n += np.bincount(bucket[inside], minlength=BUCKETS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(n[at])], names=["bucket", "n"])

    return texts.select(F.col(text).cast("string")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text") -> np.ndarray:
    """Gain of each bucket: floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))). The driver holds two counts a bucket."""

    def counts(df, column):
        out = np.zeros(BUCKETS, np.int64)
        for r in bucket_counts(df, column).collect():  # at most BUCKETS rows
            out[r["bucket"]] = r["n"]
        return out

    s, t = counts(corpus, text), counts(target, target_text)
    ratio = (t + 1).astype(float) * float(s.sum() + BUCKETS) / ((s + 1).astype(float) * float(t.sum() + BUCKETS))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default) with ``n_words``, ``n_features`` and ``weight``, the sum of gains over a text's features."""
    names = list(keep if keep is not None else docs.columns)
    names = [c for c in names if c not in ("n_words", "n_features", "weight")]
    (own,) = fresh(names, "_text")
    rows = docs.select(*names, F.col(text).cast("string").alias(own))
    send = docs.sparkSession.sparkContext.broadcast(gains)

    def run(batches):
        gain = send.value
        for b in batches:
            n, weight = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for w in words(b.column(len(names))):
                total = np.zeros(len(w.starts) + 1, np.int64)
                for lo, runs in _pieces(w):
                    for bucket, inside in runs:
                        total[lo + 1:lo + 1 + len(bucket)] += np.where(inside, gain[bucket], 0)
                total = np.cumsum(total)
                weight[w.lo:w.hi] = total[w.at[1:]] - total[w.at[:-1]]
                n[w.lo:w.hi] = np.diff(w.at)
            features = sum(np.maximum(n - k, 0) for k in range(LONGEST))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(n), pa.array(features), pa.array(weight)], names=[*names, "n_words", "n_features", "weight"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kept}{', ' if kept else ''}n_words long, n_features long, weight long")


class _Turns:
    """A table in the shared folder, rewritten pass by pass; the one before goes when the next is there."""

    def __init__(self, spark):
        self.spark, self.path = spark, None

    def write(self, df: DataFrame) -> DataFrame:
        path = shared_folder(self.spark, "pass")
        df.write.parquet(path)
        if self.path:
            fs, at = filesystem(self.spark, self.path)
            fs.delete(at, True)
        self.path = path
        return self.spark.read.schema(df.schema).parquet(path)


def radix_rank(df: DataFrame, keys: Sequence[tuple[str, bool]], name: str = "rank", digit: int = DIGIT, block: int | None = None) -> DataFrame:
    """``df`` with ``name``: its row's place (from 1) by ``keys``, pairs of a long column and whether it descends.

    Nulls come first, rows with equal keys keep some order. Passes follow the bits in which the keys of two rows can differ. A pass shuffles every row
    once, by (digit, block of its present place), so a digit that all rows share is spread over as many groups as there are blocks.
    """
    spark = df.sparkSession
    p, blk, d, before, ahead, local, sup, far = fresh([*df.columns, name], "_place", "_block", "_digit", "_before", "_ahead", "_local", "_span", "_far")
    turns = _Turns(spark)
    rows = turns.write(df.select("*", F.monotonically_increasing_id().alias(p)))
    ends = rows.agg(F.count("*").alias("n"), *(f(F.col(k)).alias(f"{s}{i}") for i, (k, _) in enumerate(keys) for s, f in (("lo", F.min), ("hi", F.max)))).first()
    n = ends["n"]
    block = block or min(BLOCK, -(-max(n, 1) // (8 * parallelism(spark))))
    digits = []  # from the least significant: (column expression of the key, first bit, bits)
    for i, (k, down) in reversed(list(enumerate(keys))):
        lo, hi = ends[f"lo{i}"], ends[f"hi{i}"]
        if lo is None:
            continue
        if hi - lo < (1 << 62):
            value = F.when(F.col(k).isNull(), F.lit(0)).otherwise((F.lit(hi) - F.col(k) if down else F.col(k) - F.lit(lo)) + 1)
            bits = (hi - lo + 1).bit_length()
        else:  # so wide that a difference could overflow: order by the bits themselves, after one digit for nulls
            value = F.col(k).bitwiseXOR(F.lit(-(1 << 63)))
            value, bits = F.coalesce(F.bitwise_not(value) if down else value, F.lit(0)), 64
        passes = -(-bits // digit)
        width = -(-bits // passes)
        digits += [(value, j * width, min(width, bits - j * width)) for j in range(passes)]
        if bits == 64:
            digits.append((F.col(k).isNotNull().cast("long"), 0, 1))
    # The first places are numbers within a task's share; block boundaries are at multiples, as within the dense places of later passes.
    for value, shift, bits in digits:
        now = F.shiftrightunsigned(value, shift).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
        dealt = rows.select("*", now.alias(d), F.floor(F.col(p) / F.lit(block)).alias(blk))
        counts = dealt.groupBy(d, blk).agg(F.count("*").alias(ahead))
        counts = counts.withColumn(sup, F.floor(F.col(blk) / SPAN))
        # Rows before a block: those of the digit's earlier spans of blocks, and of the earlier blocks of its span.
        spans = counts.groupBy(d, sup).agg(F.sum(ahead).alias(far))
        spans = spans.select(d, sup, F.coalesce(F.sum(far).over(Window.partitionBy(d).orderBy(sup).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(far))
        inner = Window.partitionBy(d, sup).orderBy(blk).rowsBetween(Window.unboundedPreceding, -1)
        # At most 2^digit totals, whatever the input.
        totals = counts.groupBy(d).agg(F.sum(ahead).alias(before))
        totals = totals.select(d, F.coalesce(F.sum(before).over(Window.orderBy(d).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))
        offsets = counts.select(d, sup, blk, F.coalesce(F.sum(ahead).over(inner), F.lit(0)).alias(ahead)).join(spans, [d, sup]).join(F.broadcast(totals), d)
        offsets = offsets.select(d, blk, before, (F.col(ahead) + F.col(far)).alias(ahead))
        own = F.row_number().over(Window.partitionBy(d, blk).orderBy(p))
        placed = dealt.withColumn(local, own).join(offsets, [d, blk])
        place = (F.col(before) + F.col(ahead) + F.col(local) - 1).cast("long")
        rows = turns.write(placed.select(*df.columns, place.alias(p)))
    if not digits:
        rows = turns.write(rows.withColumn(p, (F.row_number().over(Window.orderBy(p)) - 1).cast("long"))) if n <= 1 else _dense(rows, p, turns, block)
    return rows.select(*[c for c in df.columns if c != name], (F.col(p) + 1).alias(name))


def _dense(rows: DataFrame, place: str, turns: _Turns, block: int) -> DataFrame:
    """Places 0, 1, 2... for rows that no key tells apart: one pass whose only digit is 0."""
    (blk, ahead) = fresh(rows.columns, "_block", "_ahead")
    dealt = rows.select("*", F.floor(F.col(place) / F.lit(block)).alias(blk))
    counts = dealt.groupBy(blk).agg(F.count("*").alias(ahead))
    sums = counts.select(blk, F.coalesce(F.sum(ahead).over(Window.orderBy(blk).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(ahead))
    local = F.row_number().over(Window.partitionBy(blk).orderBy(place))
    names = [c for c in rows.columns if c != place]
    return turns.write(dealt.withColumn(f"{place}_", local).join(sums, blk).select(*names, (F.col(ahead) + F.col(f"{place}_") - 1).cast("long").alias(place)))


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", keep: Sequence[str] | None = None, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """``keep`` columns (all but the text by default) of every row with ``n_features``, ``weight``, ``score`` and ``rank`` (longs).

    ``rank`` is 1, 2, 3... over the floor(percent N / 100) highest scores of the N texts with ``least_words`` words or more, ties to smaller
    ids (null ids first, then fewer features); other rows have none. Null and empty texts have no features and weight 0. A null id draws as an empty one;
    rows with one id draw alike. An empty ``target`` only smooths; an empty table gives no rows. Columns with these names are replaced.
    """
    names = [c for c in (keep if keep is not None else [c for c in docs.columns if c != text]) if c not in ("n_features", "weight", "score", "rank")]
    held = list(dict.fromkeys([*names, doc_id]))
    gains = bucket_gains(docs, target, text, target_text)
    rows = weigh(docs, gains, text, held)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    draw = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    turns = _Turns(docs.sparkSession)
    rows = turns.write(rows.withColumn("score", F.col("weight") + draw))
    (key,) = fresh(rows.columns, "_id")
    fit = rows.where(F.col("n_words") >= least_words).withColumn(key, F.col(doc_id).cast("long"))
    ranked = radix_rank(fit, [("score", True), (key, False), ("n_features", False)]).drop(key)
    n = ranked.count()
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= percent * n // 100, F.col("rank")))
    rest = rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select(*names, "n_features", "weight", "score", "rank")
