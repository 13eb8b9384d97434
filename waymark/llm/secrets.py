"""Secret scans over a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over the trigrams every match must
hold. The index maps each trigram of those queries to the documents that hold it; postings are
intersected as a count per (document, clause), and only the surviving candidates are verified by the
regular expression. Rules without mandatory trigrams scan every text.
"""

from __future__ import annotations

import re._constants as rc
import re._parser as rp
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.session import fresh
from waymark.llm.spans import digest, match_spans
from waymark.session import cut_lineage


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds leftmost non-overlapping matches; ``group`` must have ``least`` characters."""

    name: str
    pattern: str
    group: int = 0
    least: int = 0


# The base rules.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}+"),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{16,}+"),
)
# Formats of widely used credentials.
MORE = (
    Rule("private_key", r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}+"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}+"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}+"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]++"),
    Rule("bearer", r"(?i)bearer\x20{1,4}[A-Za-z0-9._~+/=-]{20,}+"),
    Rule("login_url", r"://[A-Za-z0-9._~%-]{1,64}:[^\s:@/]{3,64}@"),
)
#: Most exact strings or clauses kept while deriving a query; beyond it the query only gets weaker.
MOST = 32

Clauses = frozenset  # of frozensets of trigrams: any clause, all of its trigrams; an empty clause holds always
ALWAYS: Clauses = frozenset([frozenset()])


def _grams(s: str) -> frozenset[str]:
    s = s.lower()
    return frozenset(s[i:i + 3] for i in range(len(s) - 2))


def _and(a: Clauses, b: Clauses) -> Clauses:
    return frozenset(x | y for x, y in product(a, b)) if len(a) * len(b) <= MOST else max(a, b, key=lambda c: min(map(len, c)))


def _or(parts: Sequence[Clauses]) -> Clauses:
    got = frozenset().union(*parts)
    return got if len(got) <= MOST else ALWAYS


def _node(op, arg):
    """(exact strings or None, clauses) of one parsed node."""
    if op is rc.LITERAL and arg < 128:
        return {chr(arg)}, ALWAYS
    if op is rc.IN and all(k is rc.LITERAL and v < 128 for k, v in arg) and len(arg) <= 8:
        return {chr(v) for _, v in arg}, ALWAYS
    if op is rc.AT or op in (rc.ASSERT, rc.ASSERT_NOT):
        return {""}, ALWAYS
    if op is rc.SUBPATTERN:
        return _sequence(arg[-1])
    if op is getattr(rc, "ATOMIC_GROUP", None):
        return _sequence(arg)
    if op is rc.BRANCH:
        parts = [_sequence(p) for p in arg[1]]
        if all(e is not None for e, _ in parts) and sum(len(e) for e, _ in parts) <= MOST:
            return set().union(*(e for e, _ in parts)), ALWAYS
        return None, _or([c if e is None else _flush(e) for e, c in parts])
    if op in (rc.MAX_REPEAT, rc.MIN_REPEAT, getattr(rc, "POSSESSIVE_REPEAT", None)):
        least, most, body = arg
        e, c = _sequence(body)
        if e is not None and most == 1:
            return e | {""} if least == 0 else e, ALWAYS
        if e is not None and least == most and len(e) ** least <= MOST:
            return {"".join(p) for p in product(e, repeat=least)}, ALWAYS
        return None, ALWAYS if least == 0 else (c if e is None else _flush(e))
    return None, ALWAYS


def _flush(exact: set[str]) -> Clauses:
    return _or([frozenset([_grams(s)]) for s in exact])


def _sequence(nodes):
    exact, clauses, whole = {""}, ALWAYS, True
    for op, arg in nodes:
        e, c = _node(op, arg)
        if e is not None and len(exact) * len(e) <= MOST:
            exact = {a + b for a, b in product(exact, e)}
            continue
        clauses, whole = _and(clauses, _flush(exact)), False
        exact = e if e is not None else {""}
        clauses = _and(clauses, c)
    return (exact, ALWAYS) if whole else (None, _and(clauses, _flush(exact)))


def trigram_query(pattern: str) -> Clauses:
    """Clauses of lower-case trigrams: each match of ``pattern`` holds all trigrams of some clause.

    ALWAYS (one empty clause) where no trigram is mandatory.
    """
    exact, clauses = _sequence(rp.parse(pattern))
    got = _flush(exact) if exact is not None else clauses
    return ALWAYS if frozenset() in got else frozenset(c for c in got if not any(o < c for o in got))


def postings(docs: DataFrame, trigrams: Sequence[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The inverted index: (trigram, doc) for each of ``trigrams`` that a text holds, letters in either case."""
    rows = docs.select(F.col(doc_id).alias("doc"), F.lower(F.col(text)).alias("_low")).where(F.col("_low").isNotNull())
    all_of = F.array(*map(F.lit, sorted(trigrams)))
    return rows.select("doc", F.explode(F.filter(all_of, lambda t: F.contains(F.col("_low"), t))).alias("trigram"))


def candidates(index: DataFrame, queries: dict[str, Clauses]) -> DataFrame:
    """(doc, rules): the rules of which some clause has all its trigrams among the document's postings.

    Postings are counted per (doc, clause), first within each task, so a trigram that nearly all
    documents hold makes no large group.
    """
    clauses = [(rule, i, t, len(c)) for rule, q in sorted(queries.items()) for i, c in enumerate(sorted(q, key=sorted)) for t in sorted(c)]
    table = index.sparkSession.createDataFrame(clauses, "rule string, clause int, trigram string, size int")
    hits = index.join(F.broadcast(table), "trigram")  # as many rows as the rules have trigrams
    met = hits.groupBy("doc", "rule", "clause", "size").agg(F.count_distinct("trigram").alias("n")).where("n = size")
    return met.groupBy("doc").agg(F.collect_set("rule").alias("rules"))


def find_secrets(docs: DataFrame, rules: Sequence[Rule] = (*BASE, *MORE), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` and ``secrets``: array of (kind, start, end, text), code points.

    Null texts count as empty and get an empty array. Repeated or null ids are kept, one result per
    row: an id's postings only choose which rules verify its rows. A column of ``docs`` that is called
    ``secrets`` is replaced.
    """
    rules = [r for r in rules]
    queries = {r.name: trigram_query(r.pattern) for r in rules}
    indexed = {n: q for n, q in queries.items() if q != ALWAYS}
    docs = docs.drop("secrets")
    doc, held = fresh(docs.columns, "_doc", "_rules")
    body = F.coalesce(F.col(text), F.lit(""))
    if indexed:
        found = candidates(postings(docs, {t for q in indexed.values() for c in q for t in c}, doc_id, text), indexed)
        found = cut_lineage(found.select(F.col("doc").alias(doc), F.col("rules").alias(held)))
        rows = docs.join(found, F.col(doc_id).eqNullSafe(F.col(doc)), "left")
    else:
        rows = docs.withColumn(doc, F.lit(None)).withColumn(held, F.lit(None).cast("array<string>"))

    def spans(rule: Rule) -> Column:
        hit = match_spans(body, rule.pattern, (0, rule.group) if rule.group else (0,))
        if rule.least:
            hit = F.filter(hit, lambda s: F.length(s[f"g{rule.group}"] if rule.group else s["text"]) >= rule.least)
        hit = F.transform(hit, lambda s: F.struct(F.lit(rule.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text")))
        wanted = F.array_contains(held, rule.name) if rule.name in indexed else body.rlike(rule.pattern)
        none = F.array().cast("array<struct<kind:string,start:int,end:int,text:string>>")
        return F.when(wanted, hit).otherwise(none)

    return rows.withColumn("secrets", F.concat(*(spans(r) for r in rules))).drop(doc, held)


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of ``secrets`` in ``text`` replaced by ``mark`` (overlapping spans by one), without ``secrets``."""
    spans = F.array_sort(F.transform("secrets", lambda s: F.struct(s["start"].alias("s"), s["end"].alias("e"))))
    merged = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["e"]).alias("at"),
            F.when(s["s"] >= a["at"], F.concat(a["out"], F.array(F.substr(F.col(text), a["at"] + 1, s["s"] - a["at"]), F.lit(mark)))).otherwise(a["out"]).alias("out"),
        ),
        lambda a: F.concat(F.array_join(a["out"], ""), F.substr(F.col(text), a["at"] + 1)),
    )
    return docs.withColumn(text, F.when(F.size("secrets") > 0, merged).otherwise(F.col(text))).drop("secrets")


def secret_report(found: DataFrame, rules: Sequence[Rule] = (*BASE, *MORE), doc_id: str = "doc_id") -> DataFrame:
    """One row per document: base counts, the digest of base spans, all spans and the number of added ones."""
    base, names = tuple(r.name for r in BASE), tuple(r.name for r in rules)
    own = F.filter("secrets", lambda s: s["kind"].isin(*base))
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        F.col(doc_id).alias("doc_id"),
        *(count(k).alias(f"n_{k}") for k in base),
        F.sha2(digest(own, names, by_kind=False), 256).alias("base_sha256"),
        digest(F.col("secrets"), names, by_kind=False).alias("spans"),
        (F.size("secrets") - F.size(own)).cast("long").alias("n_added"),
    )
