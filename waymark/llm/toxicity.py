"""Toxicity by class-conditional Kneser-Ney models.

Two language models of words after words, one of toxic and one of ordinary labelled texts. Pairs of both classes are
counted alike. A word's class level counts its distinct left neighbours in the class (its continuations), discounted and
interpolated with a lowest level that both classes share; a pair's count is discounted and interpolated with that level.
N-grams whose documents do not differ between the classes beyond chance are pruned from both models by the same test; what they
held goes to the back-off weights, so each model still sums to one, and rare expressions keep the ratio of their back-off.
A text's score compares both log-likelihoods per word, over the whole text and over its worst stretch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.session import fresh
from waymark.llm.words import mix, words
from waymark.session import cut_lineage

#: Folds by crc32 of the id: 0 is never learned from, CALIBRATION only fits the two weights of the score.
FOLDS, CALIBRATION = 5, 4
DISCOUNT = 0.75
#: Likelihood-ratio statistic (G squared) by which class counts must differ from their shares.
CHANCE = 18.0
STRETCH = 32
#: Labels sent to every task at once; a longer list is joined by a shuffle instead (same result).
MOST_LABELS = 1_000_000
#: N-grams of the model held by a task at once; a larger model is applied in parts whose sums are added (same result).
MOST_NGRAMS = 2_000_000
#: Labelled rows that the score's weights are fitted on, at most.
MOST_FITTED = 50_000
#: Stands before the first word of a text.
BEGIN = np.uint64(0x5BD1E995C3A5C85C)
#: Rows of a model: log ratios of words, of contexts' back-off weights and of pairs, and of a word that is not listed.
WORD, CONTEXT, PAIR, REST = range(4)


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)).cast("int")


def labelled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str) -> DataFrame:
    """(text, toxic, fold) of labelled documents outside fold 0; a document with any toxic label is toxic."""
    lab = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).cast("int").alias("toxic"))
    lab = cut_lineage(lab.where(fold(F.col("_id")) != 0))
    if lab.count() <= MOST_LABELS:
        lab = F.broadcast(lab)
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).where(fold(F.col("_id")) != 0)
    return rows.join(lab, "_id").select("text", "toxic", fold(F.col("_id")).alias("fold"))


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort order (last key first) and where each run of equal keys begins."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    return order, np.flatnonzero(new)


def _before(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The left neighbour of each word; ``first`` are the places where a text begins."""
    left = np.concatenate([h[:1], h[:-1]])
    left[first] = BEGIN
    return left


def pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(v * np.uint64(0x9E3779B97F4A7C15) + w)


def _per_key(key: np.ndarray, rows: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where each key stands first, and its documents and places in toxic and in ordinary texts."""
    order, at = _runs(rows, key)
    k, t = key[order], toxic[rows[order]]
    begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    docs = np.zeros(len(k), np.int64)
    docs[at] = 1
    return order[begin], [np.add.reduceat(x, begin) for x in (docs * t, docs * (1 - t), t, 1 - t)]


def _counted(batches):
    """Counts of a batch: its words (``b`` is 0) and its pairs of neighbouring words, of both classes alike."""
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        hs, rows = [], []
        for w in words(batch.column(0)):
            hs.append(w.hashes)
            rows.append(w.rows() + w.lo)
        h, r = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (hs, rows))
        if not len(h):
            continue
        left = _before(h, np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]])))
        one, n1 = _per_key(h, r, toxic)
        two, n2 = _per_key(pair_key(left, h), r, toxic)
        a = np.concatenate([h[one], left[two]])
        b = np.concatenate([np.zeros(len(one), np.uint64), h[two]])
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), *(pa.array(np.concatenate(x)) for x in zip(n1, n2, strict=True))], names=["a", "b", "dt", "do", "ct", "co"])


_COUNTS = "a long, b long, dt long, do long, ct long, co long"


def _sum(counts: DataFrame) -> DataFrame:
    return counts.groupBy("a", "b").agg(*(F.sum(c).alias(c) for c in ("dt", "do", "ct", "co")))


def _beyond_chance(t: Column, o: Column, share: float) -> Column:
    part = lambda x, p: F.when(x > 0, x * F.log(x / ((t + o) * p))).otherwise(0.0)
    return 2 * (part(t, share) + part(o, 1 - share)) >= CHANCE


def model(train: DataFrame) -> DataFrame | None:
    """(kind, a, b, llr): what words, contexts and pairs add to the log-likelihood ratio of a word after another.

    None unless both classes have words. Kind REST is the ratio of a word that is not listed, the others add to it.
    """
    counts = cut_lineage(_sum(train.select("text", "toxic").mapInArrow(_counted, _COUNTS)))
    two = counts.where("b <> 0")
    left = two.groupBy(F.col("b").alias("w")).agg(*(F.sum(F.expr(f"int({n} > 0)")).alias(m) for n, m in (("ct", "nt"), ("co", "no"))))
    one = cut_lineage(left.join(counts.where("b = 0").select(F.col("a").alias("w"), "dt", "do"), "w"))
    tot = one.agg(*(F.sum(n) for n in ("nt", "no", "dt", "do"))).first()
    if not tot[0] or not tot[1]:
        return None
    nt, no, dt, do = map(float, tot)
    cut = lambda c: F.greatest(F.col(c) - DISCOUNT, F.lit(0.0))

    # Words: continuations over what pruning and discounts leave to the shared level.
    kept = _beyond_chance(F.col("dt"), F.col("do"), dt / (dt + do))
    one = one.withColumns({"xt": F.when(kept, cut("nt") / nt).otherwise(0.0), "xo": F.when(kept, cut("no") / no).otherwise(0.0), "kept": kept})
    used = one.agg(F.sum("xt"), F.sum("xo")).first()
    bt, bo = 1 - used[0], 1 - used[1]
    shared = (F.col("nt") + F.col("no")) / (nt + no)
    one = one.select("w", "kept", (F.col("xt") + bt * shared).alias("pt"), (F.col("xo") + bo * shared).alias("po"))
    rest = float(np.log(bt / bo))
    zero = F.lit(0).cast("long")
    listed = one.where("kept").select(F.lit(WORD).alias("kind"), F.col("w").alias("a"), zero.alias("b"), (F.log(F.col("pt") / F.col("po")) - rest).alias("llr"))

    # Pairs: their counts over those of their contexts, the rest by the words.
    held = two.agg(F.sum("dt"), F.sum("do")).first()
    g = cut_lineage(two.where(_beyond_chance(F.col("dt"), F.col("do"), held[0] / (held[0] + held[1]))).select("a", "b", "ct", "co"))
    seen = two.join(g.select("a").distinct(), "a", "left_semi").groupBy("a").agg(F.sum("ct").alias("vt"), F.sum("co").alias("vo"))
    room = lambda u, v: 1 - F.col(u) / F.greatest(F.col(v), F.lit(1))
    back = g.groupBy("a").agg(F.sum(cut("ct")).alias("ut"), F.sum(cut("co")).alias("uo")).join(seen, "a")
    back = cut_lineage(back.select("a", "vt", "vo", room("ut", "vt").alias("bt"), room("uo", "vo").alias("bo")))
    change = F.log(F.col("bt") / F.col("bo"))
    contexts = back.select(F.lit(CONTEXT).alias("kind"), "a", zero.alias("b"), change.alias("llr"))
    p = lambda n, v, b, low: cut(n) / F.greatest(F.col(v), F.lit(1)) + F.col(b) * F.col(low)
    full = F.log(p("ct", "vt", "bt", "pt") / p("co", "vo", "bo", "po"))
    pairs = g.join(back, "a").join(one.select(F.col("w").alias("b"), "pt", "po"), "b").select(
        F.lit(PAIR).alias("kind"), "a", "b", (full - change - F.log(F.col("pt") / F.col("po"))).alias("llr"))
    last = train.sparkSession.range(1).select(F.lit(REST).alias("kind"), zero.alias("a"), zero.alias("b"), F.lit(rest).alias("llr"))
    return cut_lineage(listed.unionAll(contexts).unionAll(pairs).unionAll(last))


def _parts(fitted: DataFrame) -> list:
    """The model in broadcast parts of at most MOST_NGRAMS n-grams."""
    n = fitted.count()
    k = -(-n // MOST_NGRAMS) or 1
    out = []
    for i in range(k):
        t = fitted.where(F.pmod(F.xxhash64("kind", "a", "b"), F.lit(k)) == i).toPandas()
        kind, a, b = t["kind"].to_numpy(), t["a"].to_numpy(np.int64).view(np.uint64), t["b"].to_numpy(np.int64).view(np.uint64)
        value = t["llr"].to_numpy(np.float64)
        tables = []
        for keep, key in ((kind == WORD, a), (kind == CONTEXT, a), (kind == PAIR, pair_key(a, b))):
            order = np.argsort(key[keep])
            tables.append((key[keep][order], value[keep][order].astype(np.float32)))
        out.append(fitted.sparkSession.sparkContext.broadcast((*tables, value[kind == REST].sum())))
    return out


def _look_up(table, keys):
    have, values = table
    if not len(have):
        return np.zeros(len(keys), np.float32)
    at = np.searchsorted(have, keys)
    at[at == len(have)] = 0
    return np.where(have[at] == keys, values[at], np.float32(0))


def _stretches(part, text: int, drop: bool, size_name: str, sums_name: str):
    """Appends (n words, sum of log ratios of each STRETCH words) to each row; drops text column ``text`` if told so."""

    def score(batches):
        one, back, two, rest = part.value
        for batch in batches:
            n, sums = np.zeros(batch.num_rows, np.int64), []
            for w in words(batch.column(text)):
                size = np.diff(w.at)
                n[w.lo:w.hi] = size
                rows = w.rows()
                left = _before(w.hashes, w.at[:-1][size > 0])
                value = rest + _look_up(one, w.hashes) + _look_up(back, left) + _look_up(two, pair_key(left, w.hashes))
                k = -(-size // STRETCH)
                at = np.concatenate([[0], np.cumsum(k)])
                sums.append(np.bincount(at[rows] + (np.arange(len(rows)) - w.at[rows]) // STRETCH, value, at[-1]))
            at = np.concatenate([[0], np.cumsum(-(-n // STRETCH))]).astype(np.int32)
            flat = np.concatenate(sums) if sums else np.zeros(0)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(flat, pa.float64()))
            keep = [k for k in range(batch.num_columns) if k != text or not drop]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(n), lists], names=[*(batch.schema.names[k] for k in keep), size_name, sums_name])

    return score


def _features(rows: DataFrame, parts: list, text: str, keep: list[str]) -> tuple[DataFrame, Column, Column]:
    """(columns ``keep`` of ``rows`` and more, mean log ratio per word of ``text``, that of its worst stretch)."""
    rows = rows.select(*keep, *([] if text in keep else [text]))
    size, sums, row, all_ = fresh(rows.columns, "_n", "_sums", "_row", "_all")
    if len(parts) > 1:
        rows = cut_lineage(rows.withColumn(row, F.monotonically_increasing_id()))
    at, drop = rows.columns.index(text), text not in keep
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != text or not drop] + [f"`{size}` long", f"`{sums}` array<double>"]
    done = [rows.mapInArrow(_stretches(p, at, drop, size, sums), ", ".join(schema)) for p in parts]
    out = done[0]
    if len(parts) > 1:
        for o in done[1:]:
            out = out.unionAll(o)
        add = F.aggregate(F.slice(all_, 2, len(parts)), F.element_at(all_, 1), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
        out = out.groupBy(*keep, row, size).agg(F.collect_list(sums).alias(all_)).select(*keep, size, add.alias(sums))
    n = F.greatest(size, F.lit(1))
    means = F.transform(sums, lambda s, i: s / F.greatest(F.least(n - i * STRETCH, F.lit(STRETCH)), F.lit(STRETCH // 2)))
    return out, F.aggregate(sums, F.lit(0.0), lambda a, s: a + s) / n, F.coalesce(F.array_max(means), F.lit(0.0))


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (bias last) of a ridge logistic regression, by Newton steps. Features are scaled, so the ridge does not depend on their size."""
    scale = x.std(axis=0)
    scale = np.append(np.where(scale > 0, scale, 1.0), 1.0)
    x = np.column_stack([x, np.ones(len(x))]) / scale
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + 1e-2 * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w / scale


def score_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all by default), held_out, score and predicted for every row.

    Learns only from labels whose document's crc32 mod 5 is not 0. Null and empty texts have ratio 0 and so the score
    of the fitted bias; without labels of both classes every score is 0. A null id counts as the id of an empty text and
    is never learned from. Rows are scored one by one, so repeated ids and rows stay. Columns of ``docs``
    called held_out, score or predicted are left out.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("held_out", "score", "predicted")]
    held = (fold(docs[doc_id]) == 0).alias("held_out")
    train = labelled(docs, labels, doc_id, text, label)
    fitted = model(train.where(F.col("fold") != CALIBRATION))
    nothing = docs.select(*keep, held, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    if fitted is None:
        return nothing
    parts = _parts(fitted)
    seen, x1, x2 = _features(train.where(F.col("fold") == CALIBRATION), parts, "text", ["toxic"])
    got = seen.select("toxic", x1.alias("x1"), x2.alias("x2")).limit(MOST_FITTED).toPandas()
    y = got["toxic"].to_numpy(np.float64)
    if len(set(y)) < 2:
        return nothing
    w = _fit(got[["x1", "x2"]].to_numpy(np.float64), y)
    rows, x1, x2 = _features(docs.select(*dict.fromkeys([*keep, text]), held), parts, text, [*keep, "held_out"])
    score = 1 / (1 + F.exp(-(F.lit(float(w[0])) * x1 + F.lit(float(w[1])) * x2 + F.lit(float(w[2])))))
    return rows.select(*keep, "held_out", score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
