"""Personal data by bootstrapped contextual extraction.

Seeds are the entities that strict patterns find (addresses, numbers). The words around a seed and
its written shape induce lexical patterns; every token run of a seed's shape is a possible instance, and
so is every run of another shape that passes the kind's loose check beside a word.
Patterns and instances form a graph whose scores are iterated: a pattern is as good as the instances
it extracts, an instance as good as its best pattern, seeds stay at 1. A word alone is as good as the share
of one kind among all that stands beside it. Instances above the
threshold that the strict patterns missed are added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.spans import digest, let, match_spans, running
from waymark.session import cut_lineage

# Kinds in the order of the digest, and their strict patterns. Possessive repeats and
# the look-behinds change no match; they keep the search linear in the text.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Tokens that hold a digit or @, and runs of them with single spaces between.
RUN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?: [^\s0-9@]*+[0-9@]\S*+)*+"
SPAN = "array<struct<kind:string,start:int,end:int,text:string>>"
MENTION = "array<struct<kind:string,start:int,end:int,text:string,shape:string,left:string,right:string>>"
#: Most tokens of an instance, or as many as the longest seed has.
TOKENS = 4
#: Characters beside a mention in which its context word is looked for.
NEAR = 48


def valid(kind: str, text: Column) -> Column:
    """Whether a match of the strict pattern, or an instance of the same shape, can be of its kind."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    if kind == "ip":
        return text.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})){3}$")
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def loose(kind: str, text: Column) -> Column:
    """Whether an instance of any written form can be of its kind, if its context says so."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    bare = ~text.rlike(r"[\p{L}@]")
    if kind == "ip":
        octet = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
        return text.rlike(rf"^[^\p{{L}}0-9]*{octet}(?:[^\p{{L}}0-9]{{1,3}}{octet}){{3}}[^\p{{L}}0-9]*$")
    if kind == "card":
        return bare & F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return bare & F.length(digits).between(7, 15)
    return text.rlike(r"^[^\s@]+@[^\s@]+$")


def base_spans(text: Column) -> Column:
    """Strict spans of all kinds, by kind as listed."""

    def of(kind):
        hits = F.filter(match_spans(text, PATTERNS[kind]), lambda s: valid(kind, s["text"]))
        return F.transform(hits, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text")))

    return F.concat(*map(of, KINDS)).cast(SPAN)


def shape(text: Column) -> Column:
    """Letters as ``a``, up to three digits as ``d``, longer digit runs by their length."""
    nines = F.translate(text, "012345678", "999999999")
    return F.regexp_replace(F.regexp_replace(nines, r"(?<!9)9{1,3}(?!9)", "d"), r"\p{L}{2,}|(?<![\p{L}d9])\p{L}(?![\p{L}])", "a")


def context(text: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """The word before and after a span, lower-cased and without outer marks; words with digits as their shape."""
    from_ = F.greatest(start - NEAR, F.lit(0))
    before = F.regexp_extract(F.substr(text, from_ + 1, start - from_), r"(\S+)\s*$", 1)
    after = F.regexp_extract(F.substr(text, end + 1, F.lit(NEAR)), r"^\S?\s*(\S+)", 1)

    def word(w):
        w = F.regexp_replace(F.lower(w), r"^[^\p{L}0-9+]+|[^\p{L}0-9]+$", "")
        return F.when(w.rlike("[0-9]"), shape(w)).otherwise(w)

    return word(before), word(after)


def _windows(text: Column, most: int) -> Column:
    """Every run of up to ``most`` identifier-like tokens: (start, end, text), outer marks stripped."""
    runs = match_spans(text, RUN)

    def window(run, tokens, ends, i, k):
        return F.struct((run["start"] + F.element_at(ends, i) + i - 1).alias("start"), F.array_join(F.slice(tokens, i, k + 1), " ").alias("text"))

    def of_tokens(run, tokens, ends):
        return F.flatten(F.transform(
            F.sequence(F.lit(1), F.size(tokens)),
            lambda i: F.transform(F.sequence(F.lit(0), F.least(F.lit(most - 1), F.size(tokens) - i)), lambda k: window(run, tokens, ends, i, k)),
        ))

    def of_run(run):
        return let(F.split(run["text"], " "), lambda tokens: let(running(F.transform(tokens, F.length)), lambda ends: of_tokens(run, tokens, ends)))

    def stripped(w):
        lead = F.length(F.regexp_extract(w["text"], r"^[\"'<\[({]*", 0))
        core = F.regexp_extract(w["text"], r"^[\"'<\[({]*(.*?)[.,;:!?\"'>\])}]*$", 1)
        return F.struct((w["start"] + lead).cast("int").alias("start"), (w["start"] + lead + F.length(core)).cast("int").alias("end"), core.alias("text"))

    return F.filter(F.transform(F.flatten(F.transform(runs, of_run)), stripped), lambda w: F.length(w["text"]) >= 6)


def mentions(docs: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """Each row's strict spans (``base``) and possible instances (``maybe``), written once; ``_row`` numbers the rows."""
    body = F.col("_body")
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_body"))
    rows = rows.select("*", F.when(body.rlike("[0-9@]"), base_spans(body)).otherwise(F.array().cast(SPAN)).alias("base"))
    longest = rows.select(F.max(F.array_max(F.transform("base", lambda s: F.size(F.split(s["text"], " "))))).alias("n")).first()["n"]
    rows = rows.select("*", F.when(body.rlike("[0-9@]"), _windows(body, max(TOKENS, longest or 0))).otherwise(F.array().cast("array<struct<start:int,end:int,text:string>>")).alias("_win"))

    def mention(s, kind):
        left, right = context(body, s["start"], s["end"])
        return F.struct(kind.alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), shape(s["text"]).alias("shape"), left.alias("left"), right.alias("right"))

    free = F.filter("_win", lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    seeds = F.transform("base", lambda s: mention(s, s["kind"]))
    rows = rows.select(*keep, "base", F.concat(seeds, F.transform(free, lambda w: mention(w, F.lit(None).cast("string")))).cast(MENTION).alias("maybe"), F.monotonically_increasing_id().alias("_row"))
    return cut_lineage(rows)


def scored(found: DataFrame, rounds: int) -> DataFrame:
    """(kind, text, seed, score, beside) of every instance that has the shape of a seed or passes a loose check.

    ``beside`` is the best score of a word alone. Words that hold digits are no such patterns: they are part of the same run.
    """
    m = found.select(F.explode("maybe").alias("m")).select("m.*")
    seeds, free = m.where("kind IS NOT NULL"), m.where("kind IS NULL").drop("kind")
    columns = ["kind", "shape", "text", "left", "right"]
    shapes = seeds.select("kind", "shape").distinct()
    both = seeds.select(*columns, F.lit(1).alias("seed")).unionByName(free.join(shapes, "shape").select(*columns, F.lit(0).alias("seed")))
    kinds = F.array_compact(F.array(*[F.when(loose(k, F.col("text")), k) for k in KINDS]))
    wide = seeds.select(*columns, F.lit(1).alias("seed")).unionByName(free.withColumn("kind", F.explode(kinds)).select(*columns, F.lit(0).alias("seed")))
    patterns = F.array(F.concat_ws("|", F.lit("L"), "shape", "left"), F.concat_ws("|", F.lit("R"), "shape", "right"), F.concat(F.lit("S|"), "shape"))
    word = lambda c: F.when(F.col(c).rlike(r"\p{L}") & ~F.col(c).rlike(r"[0-9]|^d$"), F.concat(F.lit(f"{c}|"), c))
    alone = F.array_compact(F.array(word("left"), word("right")))

    def linked(rows, by):
        return rows.select("kind", "text", "seed", F.explode(by).alias("pattern")).groupBy("kind", "pattern", "text").agg(F.max("seed").alias("seed"))

    shaped, words = cut_lineage(linked(both, patterns)), cut_lineage(linked(wide, alone))
    shaped = shaped.join(shaped.groupBy("kind", "pattern").agg(F.count("*").alias("n")), ["kind", "pattern"])
    words = words.join(words.select("pattern", "text").distinct().groupBy("pattern").agg(F.count("*").alias("n")), "pattern")
    edges = cut_lineage(shaped.withColumn("word", F.lit(False)).unionByName(words.withColumn("word", F.lit(True))))
    inst = edges.groupBy("kind", "text").agg(F.max("seed").alias("seed")).withColumn("score", F.col("seed").cast("double")).withColumn("beside", F.lit(0.0))
    for _ in range(rounds):
        pat = edges.drop("seed").join(inst, ["kind", "text"]).groupBy("kind", "pattern").agg((F.sum("score") / (F.max("n") + 1)).alias("good"))
        inst = edges.join(pat, ["kind", "pattern"]).groupBy("kind", "text").agg(F.max("seed").alias("seed"), F.max("good").alias("best"), F.max(F.when(F.col("word"), F.col("good"))).alias("beside"))
        inst = inst.select("kind", "text", "seed", F.greatest(F.col("seed").cast("double"), "best").alias("score"), F.coalesce("beside", F.lit(0.0)).alias("beside"))
    return inst


def find_pii(docs: DataFrame, text: str = "text", keep: Sequence[str] | None = None, rounds: int = 3, least: float = 0.6) -> DataFrame:
    """Rows of ``docs`` (columns ``keep``, all by default), ``base`` and ``added`` spans: (kind, start, end, text).

    Null texts count as empty. Rows with equal or null ids each keep their own result. Columns of
    ``docs`` called ``base``, ``added`` or ``maybe`` are left out. Added spans overlap no base span, and none
    lies within another added one.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("base", "added", "maybe", "_row", "_body", "_win")]
    found = mentions(docs, text, keep)
    good, body = F.lit(False), F.col("text")
    for kind in KINDS:
        good = good | ((F.col("kind") == kind) & ((F.col("score") >= least) & valid(kind, body) | (F.col("beside") >= least) & loose(kind, body)))
    new = scored(found, rounds).where(good).groupBy("text").agg(F.max_by("kind", F.struct("score", "beside", "kind")).alias("kind"))
    free = found.select("_row", F.explode("maybe").alias("m")).where("m.kind IS NULL").select("_row", "m.start", "m.end", "m.text")
    hits = free.join(new, "text").groupBy("_row").agg(F.collect_set(F.struct("kind", "start", "end", "text")).alias("_hits"))
    outer = F.filter("_hits", lambda s: ~F.exists("_hits", lambda o: (o["start"] <= s["start"]) & (o["end"] >= s["end"]) & (o["end"] - o["start"] > s["end"] - s["start"])))
    hits = hits.select("_row", outer.cast(SPAN).alias("added"))
    none = F.array().cast(SPAN)
    return found.drop("maybe").join(hits, "_row", "left").select(*keep, "base", F.coalesce("added", none).alias("added"))


def pii_report(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row per document: base counts, the digest of base spans, all spans and the number of added ones."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        F.col(doc_id).alias("doc_id"),
        *(count(k).alias(f"n_{k}") for k in KINDS),
        F.sha2(digest(F.col("base"), KINDS, by_kind=True), 256).alias("base_sha256"),
        digest(F.concat("base", "added"), KINDS, by_kind=True).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
