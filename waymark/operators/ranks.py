"""Row numbers and quantiles that never send one whole group to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.session import cut_lineage, parallelism


def sort_number(df: DataFrame, name: str) -> Column:
    """A number that grows with the column: used to cut it into value ranges."""
    kind = df.schema[name].dataType.typeName()
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return F.unix_micros(F.col(name).cast("timestamp")).cast("double")
    if kind == "string":
        return F.ascii(F.substring(name, 1, 1)).cast("double")
    return F.col(name).cast("double")


def _spread_keys(df: DataFrame, value: str, pieces: int) -> list[float]:
    """Cut points between ``pieces`` value ranges of about equal size, from a distributed sketch."""
    numbers = df.select(sort_number(df, value).alias("_v"))
    bounds = numbers.stat.approxQuantile("_v", [i / pieces for i in range(1, pieces)], 0.001)
    return sorted({b for b in bounds if b is not None})


def group_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Zero-based index of each row within its group in ``order``.

    Rows are dealt into ranges of (keys, order), which Spark cuts by sampling all these columns: a large group, and a value that many
    of its rows share, are spread over as many tasks as their share of the rows. Ranks inside a (group, range) are a window
    over that part only; the offsets of the ranges come from pre-aggregated counts. The dealt rows are written once, so
    both uses see the same ranges.
    """
    keys, order = list(keys), list(order)
    dealt = df.repartitionByRange(parallelism(df.sparkSession), *keys, *order)
    rows = cut_lineage(dealt.select("*", F.spark_partition_id().alias("_part")))
    local = Window.partitionBy(*keys, "_part").orderBy(*order)
    sizes = rows.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    ranked = rows.withColumn("_local", F.row_number().over(local))
    return (
        ranked.join(offsets, [*keys, "_part"])
        .withColumn(name, (F.col("_offset") + F.col("_local") - 1).cast("long"))
        .drop("_part", "_offset", "_local")
    )


def running(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Sequence[str] = (), maxima: Sequence[str] = ()
) -> DataFrame:
    """``sums`` and ``maxima`` replaced by their running values up to and with each row of its group in ``order``.

    A prefix scan in three steps: rows are dealt into ranges of (keys, order) and written once, each range is scanned by
    itself, and the totals of the ranges before it are added. The only window over a whole group (or, without keys, over
    the whole table) reads one row per range. Rows that tie in ``order`` come in any order among themselves.
    Nulls add nothing; the value is null (for sums too) until a first one is seen.
    """
    keys, order = list(keys), list(order)
    kinds = {**{c: F.sum for c in sums}, **{c: F.max for c in maxima}}
    dealt = df.repartitionByRange(parallelism(df.sparkSession), *keys, *order)
    rows = cut_lineage(dealt.select("*", F.spark_partition_id().alias("_part")))
    local = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "_part").agg(*[f(c).alias(f"_t_{c}") for c, f in kinds.items()])
    offsets = totals.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_at"),
        *[f(f"_t_{c}").over(before).alias(f"_t_{c}") for c, f in kinds.items()],
    )
    scanned = rows.withColumns({c: f(c).over(local) for c, f in kinds.items()})
    # Null keys are groups too.
    same = F.col("_part") == F.col("_at")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))

    def joined(c: str, f) -> Column:
        both = F.col(c) + F.col(f"_t_{c}") if f is F.sum else F.greatest(c, f"_t_{c}")
        return F.coalesce(both, F.col(c), F.col(f"_t_{c}")).alias(c)

    return scanned.join(offsets, same).select(*[joined(c, kinds[c]) if c in kinds else F.col(c) for c in df.columns])


def range_of(value: Column, cuts: Sequence[float]) -> Column:
    """Number of cut points below or at ``value`` (a balanced decision tree, so log2 comparisons)."""
    if not cuts:
        return F.lit(0)

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value < F.lit(cuts[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return F.coalesce(tree(0, len(cuts)), F.lit(-1))


def value_bin(value: Column, steps: int = 1 << 14) -> Column:
    """Monotone bin of a number from its magnitude alone: ``steps`` bins per doubling.

    The formula is continuous at powers of two, so a rounded logarithm cannot reorder bins.
    """
    size = F.abs(value)
    e = F.floor(F.log2(size))
    key = F.floor((e - 1 + size / F.pow(F.lit(2.0), e)) * steps).cast("long")
    # Shifted so that every non-zero magnitude has a positive key (doubles go down to 2^-1074).
    key = key + 1100 * steps
    return F.when(value == 0, F.lit(0).cast("long")).when(value < 0, -key).otherwise(key)


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles per group, as ``keys`` plus one column per entry of ``probs``.

    Equal values are counted together, the counts are summed into magnitude bins, and a
    running sum over a group's bins tells which bins hold the wanted ranks. Only the
    values of those bins are then ranked. Nulls are ignored.
    """
    keys = list(keys)
    v = F.col(value).cast("double")
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, v.alias("_v"))
        .agg(F.count("*").alias("_c"))
        .withColumn("_bin", value_bin(F.col("_v")))
    )
    whole = Window.partitionBy(*keys)
    running = whole.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    hist = counts.groupBy(*keys, "_bin").agg(F.sum("_c").alias("_m")).select(
        *keys, "_bin", "_m", F.sum("_m").over(running).alias("_upto"), F.sum("_m").over(whole).alias("_n")
    )
    # Floor and ceiling rank of every quantile.
    wants = F.array(*[
        F.struct(F.lit(q).alias("q"), F.lit(side).alias("side"), f((F.col("_n") - 1) * F.lit(float(p))).cast("long").alias("rank"))
        for q, p in probs.items()
        for side, f in enumerate((F.floor, F.ceil))
    ])
    here = F.filter(wants, lambda w: (w["rank"] < F.col("_upto")) & (w["rank"] >= F.col("_upto") - F.col("_m")))
    targets = hist.select(*keys, "_bin", "_n", (F.col("_upto") - F.col("_m")).alias("_skip"), here.alias("_wants")).filter(
        F.size("_wants") > 0
    )
    inside = Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.join(targets, [*keys, "_bin"]).withColumn("_to", F.col("_skip") + F.sum("_c").over(inside))
    hit = ranked.select(*keys, "_n", "_v", "_c", "_to", F.explode("_wants").alias("_w")).filter(
        (F.col("_w.rank") < F.col("_to")) & (F.col("_w.rank") >= F.col("_to") - F.col("_c"))
    )
    found = hit.groupBy(*keys).agg(
        F.max("_n").alias("_n"),
        *[
            F.max(F.when((F.col("_w.q") == q) & (F.col("_w.side") == side), F.col("_v"))).alias(f"_{q}_{side}")
            for q in probs
            for side in (0, 1)
        ],
    )
    out = []
    for q, p in probs.items():
        at = (F.col("_n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_{q}_0"), F.col(f"_{q}_1")
        out.append((lo + (hi - lo) * (at - F.floor(at))).alias(q))
    return found.select(*keys, *out)


def with_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Put the columns of a one-row table on every row as a scalar subquery (more rows are an error)."""
    row = one.select(F.struct(*one.columns).alias("_s")).scalar()
    return df.withColumn("_one", row).select(*df.columns, *[F.col("_one")[n].alias(n) for n in one.columns])


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank"
) -> DataFrame:
    """Rows ranked 1..k per group; Spark prunes each partition to k rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def overlapped(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], back: int = 0, ahead: int = 0, size: int = 50_000
) -> DataFrame:
    """Cut long groups into chunks whose windows may still look ``back`` and ``ahead`` rows.

    Adds ``_chunk`` (to put after ``keys`` in a window's partitioning) and ``_carry``: rows
    copied from a neighbouring chunk, to be dropped after the window.
    """
    rows = group_index(df, keys, order, "_idx")
    at = F.floor(F.col("_idx") / size)
    spot = F.col("_idx") % size
    copies = F.array_compact(F.array(
        F.struct(at.alias("_chunk"), F.lit(False).alias("_carry")),
        F.when(spot >= size - back, F.struct((at + 1).alias("_chunk"), F.lit(True).alias("_carry"))),
        F.when((spot < ahead) & (at > 0), F.struct((at - 1).alias("_chunk"), F.lit(True).alias("_carry"))),
    ))
    return rows.select("*", F.explode(copies).alias("_c")).select("*", "_c._chunk", "_c._carry").drop("_c")
