"""URL filters with a Bloom filter cascade.

A rule is a key (host, path prefix). The keys a URL can fit are its host and each parent domain,
with each prefix of its path as long as some rule's. Over all distinct keys of the corpus, level 0 encodes
the listed keys, level 1 the others that level 0 lets through, level 2 the listed ones that level 1 lets
through, and so on until none is wrong. The cascade then answers membership of every
key of the corpus exactly, by bit tests alone.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.session import fresh
from waymark.session import cut_lineage

#: Bits of one filter that may travel with every task (8 MB); a longer list is refused, to be split by host.
MOST_BITS = 1 << 26
HASHES = 4


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str = "/"


# The rules of the registered query.
RULES = (
    UrlRule("allow", "com", "/"),
    UrlRule("block", "example.com", "/en/"),
    UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"),
    UrlRule("block", "net", "/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://`` or for null."""
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    tail = F.substr(rest, F.length(host) + 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), F.regexp_extract(tail, r"^([^?#]*)", 1)


def keys_of(host: Column, path: Column, lengths: Sequence[int], widths: Sequence[int]) -> Column:
    """All keys a URL can fit: (host suffix, path prefix, key). Only suffixes of as many labels (``widths``) as some rule's host can match."""
    labels = F.size(F.split(host, r"\.", -1))
    hosts = F.array_compact(F.array(*(F.when(labels >= n, F.substring_index(host, ".", -n)) for n in sorted(widths))))
    sizes = F.filter(F.array(*(F.lit(n) for n in sorted(lengths, reverse=True))), lambda n: n <= F.length(path))
    pairs = F.flatten(F.transform(hosts, lambda h: F.transform(sizes, lambda n: F.struct(h.alias("host"), F.substr(path, F.lit(1), n).alias("path")))))
    return F.transform(pairs, lambda p: F.struct(p["host"], p["path"], F.concat(p["host"], p["path"]).alias("key")))


def _bits(key: Column, level: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level * HASHES + k)), F.lit(bits)) for k in range(HASHES)]


def _filter(keys: DataFrame, level: int, n: int) -> tuple[int, str]:
    """Bits and words (as text) of a Bloom filter over column ``key``; only the bounded words reach the driver."""
    bits = max(64, 64 * math.ceil(n * HASHES / math.log(2) / 64))
    if bits > MOST_BITS:
        raise ValueError(f"{n} keys need {bits} bits at level {level}; split the list by host and use one cascade for each part")
    at = keys.select(F.explode(F.array(*_bits(F.col("key"), level, bits))).alias("bit"))
    rows = at.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("value")).collect()
    words = [0] * (bits // 64)
    for r in rows:
        words[r["word"]] = r["value"]
    return bits, ",".join(map(str, words))


def build_cascade(listed: DataFrame, universe: DataFrame, most_levels: int = 64) -> list[tuple[int, str]]:
    """Levels of the cascade for column ``key``: exact for every key of ``universe`` (which is taken to include ``listed``)."""
    inside = cut_lineage(listed.select("key").distinct())
    outside = cut_lineage(universe.select("key").distinct().join(inside, "key", "left_anti"))
    levels: list[tuple[int, str]] = []
    encode, other = inside, outside
    while len(levels) < most_levels:
        n = encode.count()
        if n == 0:
            return levels or [(64, "0")]
        levels.append(_filter(encode, len(levels), n))
        wrong = cut_lineage(other.where(_passes(F.col("key"), len(levels) - 1, levels[-1])))
        encode, other = wrong, encode
    raise ValueError("the cascade does not end; its hashes collide")


def _passes(key: Column, level: int, filt: tuple[int, str]) -> Column:
    bits, words = filt
    table = F.split(F.lit(words), ",").cast("array<bigint>")  # folded into one literal by the optimizer
    out = F.lit(True)
    for b in _bits(key, level, bits):
        word = F.element_at(table, (F.shiftright(b, 6) + 1).cast("int"))
        out = out & (F.getbit(word, F.pmod(b, F.lit(64))) == 1)
    return out


def member(key: Column, levels: Sequence[tuple[int, str]]) -> Column:
    """Whether ``key`` is listed: the first level that does not hold it decides by its parity."""
    out = F.lit(len(levels) % 2 == 1)
    for i in range(len(levels) - 1, -1, -1):
        out = F.when(~_passes(key, i, levels[i]), F.lit(i % 2 == 1)).otherwise(out)
    return out


def judge_urls(pages: DataFrame, rules: Sequence[UrlRule] = RULES, default: str = "allow", url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    The cascades hold the rules' keys, one for each verdict, over all keys of the corpus. The longest member
    (of two equally long ones, that with the longer host) among a URL's keys is its rule; a URL without one is on no list and gets ``default``.
    Null, empty or scheme-less URLs have empty host and path, fit nothing and get ``default``. Columns of
    ``pages`` called host, path, rule or verdict are replaced. Two rules with one key: the first stands.
    """
    spark = pages.sparkSession
    pages = pages.drop("host", "path", "rule", "verdict")
    host, path = host_and_path(F.col(url))
    rows = pages.select("*", host.alias("host"), path.alias("path"))
    lengths = sorted({len(r.path) for r in rules})
    keys = keys_of(F.col("host"), F.col("path"), lengths, sorted({r.host.count(".") + 1 for r in rules}))
    if not rules:
        return rows.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    universe = cut_lineage(rows.select("host", "path").distinct().select(F.explode(keys).alias("k")).select("k.key").distinct())
    cascades = {}
    seen: set[str] = set()
    for verdict in dict.fromkeys(r.verdict for r in rules):
        own = [(r.host + r.path,) for r in rules if r.verdict == verdict and r.host + r.path not in seen]
        seen |= {k for k, in own}
        cascades[verdict] = build_cascade(spark.createDataFrame(own, "key string").join(universe, "key", "left_semi"), universe)

    def tried(k):
        said = F.lit(None).cast("string")
        for verdict, levels in cascades.items():
            said = F.when(member(k["key"], levels), F.lit(verdict)).otherwise(said)
        return F.struct(F.length(k["key"]).alias("long"), F.length(k["host"]).alias("wide"), k["key"].alias("rule"), said.alias("verdict"))

    hit = F.array_max(F.filter(F.transform(keys, tried), lambda t: t["verdict"].isNotNull()))
    (name,) = fresh(rows.columns, "_hit")
    rows = rows.select("*", hit.alias(name))
    return rows.select(*pages.columns, "host", "path", F.col(f"{name}.rule").alias("rule"), F.coalesce(f"{name}.verdict", F.lit(default)).alias("verdict"))
