"""Spelling variants by pivotal grams.

Two words are near if one inserted, deleted or replaced character makes them equal. A word's bigrams are ordered from rare to frequent over
the vocabulary; its prefix is the three rarest, its pivots are the two disjoint ones of these with the least cost, chosen by dynamic
programming. One edit leaves a pivot untouched, and the word whose prefix ends earlier in that order finds its untouched
pivot in the other one's prefix. Its position tells more: if the edit lies behind the first pivot, both words begin alike up to that pivot's end;
else they end alike from the second pivot on. So the index holds, for each prefix gram, the beginning up to it and the rest from it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.session import cut_lineage

LEAST_LENGTH, LEAST_COUNT = 5, 3
#: One word in DROPPED (by checksum) loses a character where it stands, which plants variants.
DROPPED = 97
#: A form stands at least this many times as often as the word it replaces.
RATIO = 2
GRAM, PREFIX, PIVOTS = 2, 3, 2
#: Different words that a task counts before it sends them on.
HELD = 200_000


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, dropped: int = DROPPED) -> DataFrame:
    """(word, n): words of at least ``least_length`` characters that stand ``least_count`` times or more in all texts, as written after the drops.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased. Where ``dropped`` divides the crc32 of
    ``<doc_id>:<word>``, the character at that number modulo the length goes. Null texts have no words, null ids count as empty.
    """
    pattern = re.compile(f"[a-zÀ-ÿ]{{{least_length},}}")

    def run(batches):
        total: Counter = Counter()

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for b in batches:
            for key, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                seed = zlib.crc32(f"{key}:".encode())
                own = Counter(pattern.findall(t.as_buffer().to_pybytes().lower().decode()))
                for word, n in own.items():
                    h = zlib.crc32(word.encode(), seed)
                    if h % dropped == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < least_length:
                            continue
                    total[word] += n
                if len(total) >= HELD:
                    yield rows()
        yield rows()

    rows = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit("")))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def pivots(places: Sequence[int], costs: Sequence[int], k: int = PIVOTS, width: int = GRAM) -> list[int]:
    """Indexes of ``k`` of the grams (``places`` ascending) that do not overlap and cost least together."""
    none = (float("inf"), ())
    best = [[(0, ())] * (len(places) + 1)] + [[none] * (len(places) + 1) for _ in range(k)]
    for m in range(1, k + 1):
        for j in range(1, len(places) + 1):
            last = j - 1  # grams that end before gram j - 1 begins
            while last and places[last - 1] + width > places[j - 1]:
                last -= 1
            cost, chosen = best[m - 1][last]
            best[m][j] = min(best[m][j - 1], (cost + costs[j - 1], (*chosen, j - 1)))
    return list(best[k][-1][1])


def gram_index(vocabulary: DataFrame) -> DataFrame:
    """Entries (probe, side, part, word, n, last, head) of every word: what it looks for and where it is found.

    ``side`` is whether ``part`` is a beginning or a rest; ``last`` the order of the word's last prefix gram. ``head`` of a probe for a
    rest is the word up to the end of its first pivot: a word that begins so was found by the other probe.
    """
    # Bigrams of 90 letters: at most 8,100 rows, whatever the corpus.
    grams = vocabulary.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))).alias("gram"))
    found = grams.groupBy("gram").agg(F.count("*").alias("n")).collect()
    order = {r["gram"]: (k, r["n"]) for k, r in enumerate(sorted(found, key=lambda r: (r["n"], r["gram"])))}
    send = vocabulary.sparkSession.sparkContext.broadcast(order)

    def run(batches):
        order = send.value
        for b in batches:
            out: list[tuple] = []
            for word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rank = [order[word[i:i + GRAM]] for i in range(len(word) - 1)]
                prefix = sorted(sorted(range(len(rank)), key=lambda i: (rank[i][0], i))[:PREFIX])
                last = max(rank[i][0] for i in prefix)
                first, second = (prefix[i] for i in pivots(prefix, [rank[i][1] for i in prefix]))
                out.append((True, "begin", word[:first + GRAM], word, n, last, None))
                out.append((True, "end", word[second:], word, n, last, word[:first + GRAM]))
                for i, (r, _) in enumerate(rank):
                    if r <= last:  # a gram that stands again counts wherever it stands
                        out.append((False, "begin", word[:i + GRAM], word, n, last, None))
                        out.append((False, "end", word[i:], word, n, last, None))
            cols = list(zip(*out, strict=True)) or [()] * 7
            types = (pa.bool_(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=["probe", "side", "part", "word", "n", "last", "head"])

    return vocabulary.select("word", "n").mapInArrow(run, "probe boolean, side string, part string, word string, n long, last int, head string")


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(a, na, b, nb): every two words (each pair once) that one inserted, deleted or replaced character makes equal."""
    entries = cut_lineage(gram_index(vocabulary))
    size = F.length("word")
    probes = entries.where("probe").select("side", "part", F.explode(F.sequence(size - 1, size + 1)).alias("size"), F.col("word").alias("a"), F.col("n").alias("na"), F.col("last").alias("la"), "head")
    index = entries.where("NOT probe").select("side", "part", size.alias("size"), F.col("word").alias("b"), F.col("n").alias("nb"), F.col("last").alias("lb"))
    a, b = F.col("a"), F.col("b")
    later = (F.col("lb") > F.col("la")) | ((F.col("lb") == F.col("la")) & (b > a))
    fits = later & (F.col("head").isNull() | ~F.startswith(b, F.col("head")))
    return probes.join(index, ["side", "part", "size"]).where(fits & (F.levenshtein(a, b, 1) == 1)).select("a", "na", "b", "nb")


def spelling_forms(vocabulary: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, form, form_n, root, n_near) of each word of ``vocabulary`` (word, n: distinct words of at least five characters).

    ``form`` is the near word with the largest ``n`` (ties: the smallest in code-point order) if that is ``ratio`` times the word's own, ``root``
    the end of the chain of forms (the word itself without one). Counts grow along a chain, so it ends; rounds follow the logarithm of its length.
    """
    vocabulary = cut_lineage(vocabulary.select("word", "n"))
    pairs = near_words(vocabulary)
    sides = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.struct((-F.col("nb")).alias("less"), F.col("b").alias("form")).alias("best")),
        F.struct(F.col("b").alias("word"), F.struct((-F.col("na")).alias("less"), F.col("a").alias("form")).alias("best")),
    )).alias("s")).select("s.*")
    best = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min("best").alias("best"))
    strong = -F.col("best.less") >= ratio * F.col("n")
    rows = vocabulary.join(best, "word", "left").select(
        "word", "n", F.when(strong, F.col("best.form")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )
    rows = cut_lineage(rows)
    # Each round a word's root becomes its root's root; only words whose root has a form go on.
    jumps = rows.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        ahead = jumps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = cut_lineage(jumps.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        jumps = jumped.select("word", "root")
        if jumped.where("moved").isEmpty():
            break
    return rows.join(jumps, "word", "left").select("word", "n", "form", "form_n", F.coalesce("root", "word").alias("root"), "n_near")


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``spelling_forms`` of all words of ``docs``; no words, no rows. Repeated rows count again; further columns are not read."""
    return spelling_forms(word_counts(docs, doc_id, text))
