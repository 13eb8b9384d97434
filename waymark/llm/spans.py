"""Places of regular-expression matches as columns, in code points, without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 256


def let(value: Column, body) -> Column:
    """``body`` of ``value`` evaluated once; lambdas would evaluate it again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sums(values: Column) -> Column:
    """0 and the running sums of a short array."""
    return F.aggregate(values, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))


def running(values: Column) -> Column:
    """0 and the running sums of an array of any size: blocks first, so that long texts cost no square."""

    def by_block(v):
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _BLOCK)), lambda b: F.slice(v, b.cast("int") * _BLOCK + 1, F.lit(_BLOCK)))

    def shifted(blocks, before):
        inner = F.transform(blocks, lambda b, i: let(F.element_at(before, i + 1), lambda o: F.transform(F.slice(_sums(b), 1, F.size(b)), lambda x: x + o)))
        return F.concat(F.flatten(inner), F.array(F.element_at(before, -1)))

    def whole(blocks):
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x))
        return let(_sums(totals), lambda before: shifted(blocks, before))

    return let(values, lambda v: F.when(F.size(v) <= _BLOCK, _sums(v)).otherwise(let(by_block(v), whole)))


def match_spans(text: Column, pattern: str, groups: tuple[int, ...] = (0,)) -> Column:
    """Array of (start, end, text, g1, g2 ...) of the leftmost non-overlapping matches of ``pattern``.

    The pattern must not match the empty text. Null texts give an empty array. The gaps between the
    matches come from ``split``, so a match starts where the gaps and matches before it end.
    """
    extra = [k for k in groups if k]
    take = lambda k: F.regexp_extract_all(text, F.lit(pattern), F.lit(k))
    parts = F.struct(F.transform(F.split(text, pattern, -1), F.length).alias("gaps"), take(0).alias("hits"), *(take(k).alias(f"g{k}") for k in extra))

    def row(p, at, h, i):
        start = F.element_at(at, i * 2 + 2)
        return F.struct(start.alias("start"), (start + F.length(h)).cast("int").alias("end"), h.alias("text"), *(F.element_at(p[f"g{k}"], i + 1).alias(f"g{k}") for k in extra))

    def placed(p):
        both = F.flatten(F.zip_with(p["gaps"], F.transform(p["hits"], F.length), lambda g, h: F.array(g, F.coalesce(h, F.lit(0)))))
        return let(running(both), lambda at: F.transform(p["hits"], lambda h, i: row(p, at, h, i)))

    fields = ["start:int", "end:int", "text:string", *(f"g{k}:string" for k in extra)]
    return F.when(text.rlike(pattern), let(parts, placed)).otherwise(F.array().cast(f"array<struct<{','.join(fields)}>>"))


def digest(spans: Column, kinds: tuple[str, ...], by_kind: bool) -> Column:
    """``kind:start:end`` comma-joined; by kind as listed then start, or by start then kind."""

    def key(s):
        k = F.array_position(F.array(*map(F.lit, kinds)), s["kind"]).cast("int")
        parts = [k.alias("k"), s["start"].alias("s")] if by_kind else [s["start"].alias("s"), k.alias("k")]
        return F.struct(*parts, s["end"].alias("e"), s["kind"].alias("n"))

    ordered = F.array_sort(F.transform(spans, key))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["n"], x["s"], x["e"])), ",")
