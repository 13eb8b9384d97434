"""SentencePiece encoding and decoding as a relational lattice.

Texts fall into islands: runs that no piece reaches across, found from the character pairs that the piece table
knows. Each block of texts lists its distinct islands; for every distinct island of the corpus the lattice is built relationally: its
substrings of bounded length are exploded and equi-joined to the piece table, the matching edges are grouped by island,
and a higher-order fold picks the path. Merge (BPE) models fold by best merge first, as their library does,
because the best-scoring path of Viterbi differs from it; unigram models fold by Viterbi. The ids go
back to the blocks that hold the island.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from waymark.llm.words import _POWERS, _powers, buffers, mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Bytes of text in a block, at most (a longer text is one alone).
BLOCK = 16 << 20
STEP = 1 << 20
#: Islands longer than this many characters are folded one by one in the task that unpacks them (same merges).
LONG = 48
#: Islands of a block are dealt into so many buckets by hash; a bucket's are one row.
BUCKETS = 4096
_ROWS = 256
_END = "\0"  # between the islands of a row; one that holds it counts as long
#: Ids decoded at once.
_TOKENS = 1 << 18
_ROW = 64  # a span's key in an island is start * _ROW + end
_OTHER = 129


@dataclass(frozen=True)
class Pieces:
    """A model's table: ``pieces`` (text, id, rank) by falling score, byte ids, unknown id, and its kind."""

    pieces: tuple[tuple[str, int, float], ...]
    bytes_: tuple[int, ...]
    unknown: int
    kind: str
    text_of: tuple[bytes, ...]

    @property
    def longest(self) -> int:
        return max(len(p) for p, _, _ in self.pieces)

    @cached_property
    def bytes_of(self) -> tuple[np.ndarray, np.ndarray]:
        """The texts of all ids behind one another, and where each begins and the last ends."""
        return np.frombuffer(b"".join(self.text_of), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in self.text_of], dtype=np.int64)])


def load_pieces(path: str = MODEL) -> Pieces:
    """Read a SentencePiece model whose normaliser is the identity with a leading space."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    with open(path, "rb") as f:
        model = pb.ModelProto.FromString(f.read())
    spec = model.normalizer_spec
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
        raise ValueError("only identity normalisation with a leading space")
    kind = {1: "unigram", 2: "bpe"}[model.trainer_spec.model_type]
    normal = [(p.piece, i, p.score) for i, p in enumerate(model.pieces) if p.type == 1]
    byte = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 6}
    text = []
    for p in model.pieces:
        text.append(p.piece.replace(SPACE, " ").encode() if p.type == 1 else bytes([int(p.piece[3:5], 16)]) if p.type == 6 else b"")
    unknown = next(i for i, p in enumerate(model.pieces) if p.type == 2)
    return Pieces(tuple(sorted(normal, key=lambda x: (-x[2], x[1]))), tuple(byte[f"<0x{i:02X}>"] for i in range(256)) if byte else (), unknown, kind, tuple(text))


# --- islands ---------------------------------------------------------------------------------------------------------


class Reach:
    """Which neighbouring characters can stand inside one piece."""

    def __init__(self, pieces: Pieces):
        pairs = {(ord(a) << 21) | ord(b) for p, _, _ in pieces.pieces for a, b in zip(p, p[1:], strict=False)}
        self.pairs = np.array(sorted(pairs), np.int64)
        # ASCII and SPACE have a table; _OTHER stands for the rest, which is looked up.
        self.low = np.zeros((_OTHER + 1, _OTHER + 1), bool)
        for p in pairs:
            a, b = (min(x, _OTHER) if x != ord(SPACE) else _OTHER - 1 for x in (p >> 21, p & 0x1FFFFF))
            if a < _OTHER and b < _OTHER:
                self.low[a, b] = True

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = (np.where(c < 128, c, np.where(c == ord(SPACE), _OTHER - 1, _OTHER)) for c in (a, b))
        out = self.low.ravel()[x * (_OTHER + 1) + y]
        rest = np.flatnonzero((x == _OTHER) | (y == _OTHER))
        key = (a[rest].astype(np.int64) << 21) | b[rest]
        at = np.searchsorted(self.pairs, key)
        at[at == len(self.pairs)] = 0
        out[rest] = len(self.pairs) > 0 and self.pairs[at] == key
        return out


def code_points(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte of each character, its code point; a space is SPACE)."""
    at = np.flatnonzero((raw & 0xC0) != 0x80)
    padded = np.concatenate([raw, np.zeros(3, np.uint8)]).astype(np.int32)
    b0 = padded[at]
    cp = b0.copy()
    for least, size, mask in ((0xC0, 2, 0x1F), (0xE0, 3, 0x0F), (0xF0, 4, 0x07)):
        k = np.flatnonzero(b0 >= least)
        v = b0[k] & mask
        for j in range(1, size):
            v = (v << 6) | (padded[at[k] + j] & 0x3F)
        cp[k] = v
    cp[cp == 32] = ord(SPACE)
    return at, cp


def _hash_runs(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit hash of each run of bytes between ``starts`` (the first is 0)."""
    size = np.diff(np.append(starts, len(raw)))
    place = np.arange(len(raw)) - np.repeat(starts, size)
    table = _POWERS if size.max(initial=0) <= len(_POWERS) else _powers(int(size.max()))
    with np.errstate(over="ignore"):
        h = np.add.reduceat((raw.astype(np.uint64) + np.uint64(1)) * table[place], starts)
        return mix(h + size.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def hash_texts(column: pa.Array) -> np.ndarray:
    """A 64-bit hash of each row, 0 for empty ones; long columns in steps of bounded bytes."""
    raw, at = buffers(column)
    out = np.zeros(len(column), np.uint64)
    lo = 0
    while lo < len(column):
        hi = min(max(lo + 1, int(np.searchsorted(at, at[lo] + STEP, "right")) - 1), len(column))
        full = lo + np.flatnonzero(at[lo + 1:hi + 1] > at[lo:hi])
        if len(full):
            out[full] = _hash_runs(raw[at[lo]:at[hi]], at[full] - at[lo])
        lo = hi
    return out


@dataclass(frozen=True)
class Islands:
    """Islands of some rows: ``index`` has the number of each in order, ``counts`` how many each row has.

    Distinct islands are numbered by falling frequency; ``short`` has the texts of those numbered ``short_at`` and ``bucket`` their buckets,
    ``long`` maps the others.
    ``tag`` is a 31-bit hash of all of them in order.
    """

    index: np.ndarray
    counts: np.ndarray
    short_at: np.ndarray
    short: pa.Array
    bucket: np.ndarray
    long: dict[int, str]
    tag: int


def _cut(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The texts between ``begin`` and ``end``."""
    size = end - begin
    stop = np.cumsum(size)
    body = raw[np.arange(int(size.sum())) + np.repeat(begin - (stop - size), size)]
    offsets = np.concatenate([[0], stop]).astype(np.int32)
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(body))


def islands(column: pa.Array, reach: Reach) -> Islands:
    """The islands of the rows of ``column`` (spaces stay spaces)."""
    raw, at = buffers(column)
    steps, heads, counts = [], [], np.zeros(len(column), np.int64)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + STEP, "right")) - 1)
        hi = min(hi, len(column))
        text, cuts = raw[at[lo]:at[hi]], at[lo:hi] - at[lo]
        if len(text):
            first, cp = code_points(text)
            begin = np.ones(len(cp), bool)
            begin[1:] = ~reach(cp[:-1], cp[1:])
            begin[np.searchsorted(first, cuts[cuts < len(text)])] = True
            starts = first[begin]
            counts[lo:hi] = np.diff(np.searchsorted(starts, np.append(cuts, len(text))))
            u, k, own, n = np.unique(_hash_runs(text, starts), return_index=True, return_inverse=True, return_counts=True)
            steps.append(own.astype(np.uint32))
            heads.append((u, (starts[k] + at[lo]).astype(np.uint32), (np.append(starts, len(text))[k + 1] - starts[k]).astype(np.uint32), n.astype(np.uint32)))
        lo = hi
    if not steps:
        return Islands(np.zeros(0, np.uint32), counts, np.zeros(0, np.int64), pa.array([], pa.string()), np.zeros(0, np.uint16), {}, 0)
    sizes = [len(x[0]) for x in heads]
    every, begin, size, n = (np.concatenate(x) for x in zip(*heads, strict=True))
    heads.clear()
    u, k, own = np.unique(every, return_index=True, return_inverse=True)
    begin, size = begin[k].astype(np.int64), size[k].astype(np.int64)
    order = np.lexsort((u, -np.bincount(own, n)))
    place = np.empty(len(u), np.uint32)
    place[order] = np.arange(len(u), dtype=np.uint32)
    number, done, index = place[own], 0, np.empty(int(n.sum()), np.uint32)
    del every, n, own, place
    at = np.cumsum(sizes) - sizes
    for lo, step in zip(at, steps, strict=True):
        index[done:done + len(step)] = number[lo:][step]
        done += len(step)
    steps.clear()
    begin, end = begin[order], (begin + size)[order]
    # A character has at most four bytes, so what has more bytes than this is longer than LONG.
    small = np.flatnonzero(end - begin <= 4 * LONG)
    texts = _cut(raw, begin[small], end[small])
    fits = pc.and_not(pc.less_equal(pc.utf8_length(texts), LONG), pc.match_substring(texts, _END)).to_numpy(zero_copy_only=False)
    short = np.zeros(len(u), bool)
    short[small[fits]] = True
    body = memoryview(raw)
    long = {int(x): bytes(body[begin[x]:end[x]]).decode() for x in np.flatnonzero(~short)}
    with np.errstate(over="ignore"):
        tag = int((u[order] * (np.arange(len(u), dtype=np.uint64) * np.uint64(2) + np.uint64(1))).sum() >> np.uint64(33))
    at = np.flatnonzero(short)
    return Islands(index, counts, at, texts.filter(pa.array(fits)), (u[order[at]] % np.uint64(BUCKETS)).astype(np.uint16), long, tag)


# --- the lattice -----------------------------------------------------------------------------------------------------


def lattices(words: DataFrame, pieces: DataFrame, longest: int, by: Sequence[str] = ()) -> DataFrame:
    """(word, blocks, lattice) for each row (word, blocks) of ``words``: a map from span key to the rank of the piece there.

    Substrings of up to ``longest`` characters are exploded and equi-joined to the piece table, which is of fixed size; its
    empty piece keeps the word itself. ``words`` is dealt by word, or by the columns ``by`` that follow from it, so grouping the edges
    again moves nothing; the hash is there to sort by.
    """
    n = F.length("word")
    starts = words.select(F.xxhash64("word").alias("x"), *by, "word", "blocks", F.explode(F.sequence(F.lit(-1), n - 1)).alias("s"))
    own = F.col("s") < 0
    ends = F.when(own, F.array(F.lit(-1))).otherwise(F.sequence(F.col("s") + 1, F.least(n, F.col("s") + longest)))
    spans = starts.select("x", *by, "word", "blocks", "s", F.explode(ends).alias("e"))
    piece = F.when(own, F.lit("")).otherwise(F.substr("word", F.col("s") + 1, F.col("e") - F.col("s")))
    spans = spans.select("x", *by, "word", F.when(own, F.col("blocks")).alias("blocks"), (F.col("s") * _ROW + F.col("e")).alias("k"), piece.alias("piece"))
    hits = spans.join(F.broadcast(pieces), "piece")
    edge = F.when(F.col("k") >= 0, F.struct("k", "rank"))
    grouped = hits.groupBy("x", *by, "word").agg(F.first("blocks", True).alias("blocks"), F.collect_list(edge).alias("edges"))
    return grouped.select("word", "blocks", F.map_from_entries("edges").alias("lattice"))


def merge_fold(word: Column, lattice: Column) -> Column:
    """Ends of characters that stay borders (0 first) when the best-ranked mergeable neighbours merge first, leftmost on ties.

    Beside the borders stands the rank of the piece that taking each one away would give, so a merge looks up two ranks.
    """
    none = F.lit(1 << 30)

    def rank(start, end):
        return F.coalesce(F.try_element_at(lattice, start * _ROW + end), none)

    def merge(state, _):
        b, r = state["b"], state["r"]

        def without(i):  # the border at i, from 0, goes
            beside = F.array(rank(F.get(b, i - 2), F.get(b, i + 1)), rank(F.get(b, i - 1), F.get(b, i + 2)))
            return F.struct(
                F.concat(F.slice(b, F.lit(1), i), F.slice(b, i + 2, F.size(b))).alias("b"),
                F.concat(F.slice(r, F.lit(1), i - 1), beside, F.slice(r, i + 3, F.size(r))).alias("r"),
            )

        at = F.array((F.array_position(r, F.array_min(r)) - 1).cast("int"))
        # Nothing left to merge: the borders stay and later steps pass.
        return F.when(F.array_min(r) < none, F.get(F.transform(at, without), 0)).otherwise(state)

    start = F.struct(
        F.sequence(F.lit(0), F.length(word)).alias("b"),
        F.transform(F.sequence(F.lit(0), F.length(word)), lambda i: F.when((i > 0) & (i < F.length(word)), rank(i - 1, i + 1)).otherwise(none)).alias("r"),
    )
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(word) - 1, F.lit(1))), start, merge, lambda s: s["b"])


def viterbi_fold(word: Column, lattice: Column, score: Column, unknown: float, longest: int) -> Column:
    """Borders of the best-scoring path; ``score`` has the score of each rank, unknown characters cost ``unknown``."""

    def step(best, e):
        def edge(s):
            rank = F.try_element_at(lattice, s * _ROW + e)
            cost = F.when(rank.isNotNull(), F.element_at(score, rank + 1)).when(s == e - 1, F.lit(unknown)).otherwise(F.lit(-1e30))
            return F.struct((F.element_at(best, s + 1)["v"] + cost).alias("v"), s.alias("s"))

        return F.concat(best, F.array(F.array_max(F.transform(F.sequence(F.greatest(e - longest, F.lit(0)), e - 1), edge))))

    path = F.aggregate(F.sequence(F.lit(1), F.length(word)), F.array(F.struct(F.lit(0.0).alias("v"), F.lit(0).alias("s"))), step)

    def back(found, _):
        at = F.element_at(found, 1)
        return F.when(at > 0, F.concat(F.array(F.element_at(path, at + 1)["s"]), found)).otherwise(found)

    return F.aggregate(F.sequence(F.lit(1), F.length(word)), F.array(F.length(word)), back)


def _literal(values: Sequence, kind: str) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")  # folded into one literal


def encode_words(words: DataFrame, model: Pieces, by: Sequence[str] = ()) -> DataFrame:
    """(word, blocks, ids) for the rows (word, block) of ``words``: islands of up to LONG characters (SPACE for spaces).

    ``by`` names columns that follow from the word and by which the rows are dealt already.
    """
    spark = words.sparkSession
    table = spark.createDataFrame([("", -1), *((p, r) for r, (p, _, _) in enumerate(model.pieces))], "piece string, rank int")
    dealt = words if by else words.select("word", "block").repartition("word")
    distinct = dealt.groupBy(*by, "word").agg(F.collect_set("block").alias("blocks"))
    rows = lattices(distinct, table, model.longest, by)
    word, lattice = F.col("word"), F.col("lattice")
    if model.kind == "bpe":
        borders = merge_fold(word, lattice)
    else:
        scores = [s for _, _, s in model.pieces]
        borders = viterbi_fold(word, lattice, _literal(scores, "double"), min(scores) - 10.0, model.longest)
    rows = rows.select("word", "blocks", "lattice", borders.alias("b"))
    id_of, byte_of = _literal([i for _, i, _ in model.pieces], "int"), _literal(model.bytes_ or [model.unknown], "int")

    def ids(end, i):
        start = F.get(F.col("b"), i)
        rank = F.try_element_at(lattice, start * _ROW + end)
        raw = F.hex(F.encode(F.substr(word, start + 1, end - start), "utf-8"))
        fallback = F.transform(F.sequence(F.lit(0), (F.length(raw) / 2 - 1).cast("int")), lambda j: F.element_at(byte_of, F.conv(F.substr(raw, j * 2 + 1, F.lit(2)), 16, 10).cast("int") + 1))
        return F.when(rank.isNotNull(), F.array(F.element_at(id_of, rank + 1))).otherwise(fallback if model.bytes_ else F.array(F.lit(model.unknown)))

    return rows.select("word", "blocks", F.flatten(F.transform(F.slice("b", F.lit(2), F.size("b")), ids)).alias("ids"))


def merge_long(word: str, rank: dict[str, int]) -> list[str]:
    """The pieces of one long island by the same merges, with a queue of candidates instead of a fold."""
    import heapq

    n = len(word)
    part, left, right = list(word), [i - 1 for i in range(n)], [i + 1 for i in range(n)]
    queue: list[tuple[int, int, int, int]] = []

    def offer(i):
        j = right[i]
        if j < n and (r := rank.get(part[i] + part[j])) is not None:
            heapq.heappush(queue, (r, i, len(part[i]), len(part[j])))

    for i in range(n - 1):
        offer(i)
    while queue:
        _, i, a, b = heapq.heappop(queue)
        j = right[i]
        if len(part[i]) != a or j >= n or len(part[j]) != b:
            continue
        part[i] += part[j]
        part[j] = ""
        right[i] = right[j]
        if right[j] < n:
            left[right[j]] = i
        if left[i] >= 0:
            offer(left[i])
        offer(i)
    return [p for p in part if p]


# --- texts -----------------------------------------------------------------------------------------------------------


def _gathered(batches):
    """The rows of all batches in tables of about BLOCK bytes of text (column 1); one row is never split."""
    held, size = [], 0
    for b in batches:
        _, at = buffers(b.column(1))
        lo = 0
        while lo < b.num_rows:
            hi = min(max(lo + 1, int(np.searchsorted(at, at[lo] + BLOCK - size, "right")) - 1), b.num_rows)
            held.append(b.slice(lo, hi - lo))
            size += int(at[hi] - at[lo])
            lo = hi
            if size >= BLOCK or lo < b.num_rows:
                whole, held, size = pa.Table.from_batches(held).combine_chunks(), [], 0
                yield whole
                del whole  # before the next is gathered
    if held:
        whole, held = pa.Table.from_batches(held).combine_chunks(), []
        yield whole


def _blocks(model: Pieces):
    reach = Reach(model)

    def run(batches):
        part, no = TaskContext.get().partitionId(), 0
        for rows in _gathered(batches):
            found = islands(rows.column(1), reach)
            # A block's key holds what its islands are, so rows of another reading of it find no partner.
            yield int(mix(mix(np.array([(part << 32) + no], np.uint64)) + np.uint64(found.tag))[0] >> np.uint64(1)), rows, found
            no += 1
            del rows, found
            pa.default_memory_pool().release_unused()

    return run


def _distinct(model: Pieces):
    def run(batches):
        for block, _, found in _blocks(model)(batches):
            order = np.argsort(found.bucket, kind="stable")
            bucket, word = found.bucket[order], found.short.take(pa.array(order))
            first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(first, len(word)).astype(np.int32)), word), _END)
            for lo in range(0, len(first), _ROWS):
                at = first[lo:lo + _ROWS]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), block)), pa.array(bucket[at].astype(np.int32)), pa.array(at), joined.slice(lo, _ROWS)], names=["block", "bucket", "first", "words"])
            del found, word, joined

    return run


def _packed(model: Pieces):
    def run(batches):
        for block, rows, found in _blocks(model)(batches):
            # Numbers fall with frequency, so their bytes compress best place by place.
            planes = np.ascontiguousarray(found.index.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4).T)
            row = {
                "block": block, "buckets": zstandard.ZstdCompressor(1).compress(found.bucket.astype("<u2", copy=False)), "ids": rows.column(0).to_pylist(), "counts": found.counts.tolist(),
                "checks": hash_texts(rows.column(1)).view(np.int64).tolist(), "long_at": list(found.long), "long": list(found.long.values()),
                "body": zstandard.ZstdCompressor(1).compress(planes),
            }
            del rows, found, planes
            yield pa.RecordBatch.from_pylist([row], _PACKED)
            del row

    return run


_PACKED = pa.schema([
    ("block", pa.int64()), ("buckets", pa.binary()), ("ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("checks", pa.list_(pa.int64())),
    ("long_at", pa.list_(pa.int64())), ("long", pa.list_(pa.string())), ("body", pa.binary()),
])
_PACKED_SQL = "block long, buckets binary, ids array<long>, counts array<long>, checks array<long>, long_at array<long>, long array<string>, body binary"


def _wide(model: Pieces) -> int:
    """Bytes of an id."""
    return 2 if max(model.unknown, *model.bytes_, *(i for _, i, _ in model.pieces)) < 1 << 16 else 4


def _assembled(model: Pieces):
    rank = {p: r for r, (p, _, _) in enumerate(model.pieces)}
    id_of = {p: i for p, i, _ in model.pieces}
    wide = _wide(model)

    def long_ids(text):
        out = []
        for p in merge_long(text.replace(" ", SPACE), rank):
            out += [id_of[p]] if p in id_of else [model.bytes_[x] for x in p.encode()] if model.bytes_ else [model.unknown]
        return np.array(out, np.int32)

    def one(packed: pa.Table, words: pa.Table):
        """(id, ids, check) of the rows of one block, from its packed texts and the ids of its islands."""
        row = {n: packed.column(n)[0] for n in packed.column_names}
        words = words.combine_chunks()
        bucket = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["buckets"].as_py()), "<u2")
        if len(words) != len(bucket):
            raise ValueError("a block's islands changed between two readings of the input; give a table, not an unordered plan")
        coded, ends = buffers(words.column("ids"))
        flat, size = np.frombuffer(coded[ends[0]:ends[-1]], f">u{wide}").astype(np.int32), np.diff(ends) // wide
        n = len(words) + len(row["long_at"])
        begin, count = np.zeros(n, np.int64), np.zeros(n, np.int64)
        long_at = np.array(row["long_at"].as_py(), np.int64)
        short = np.ones(n, bool)
        short[long_at] = False
        at = np.flatnonzero(short)[np.argsort(bucket, kind="stable")][words.column("at").to_numpy()]
        begin[at], count[at] = np.cumsum(size) - size, size
        extra = [long_ids(t) for t in row["long"].as_py()]
        count[long_at] = [len(x) for x in extra]
        begin[long_at] = len(flat) + np.cumsum(count[long_at]) - count[long_at]
        flat = np.concatenate([flat, *extra])
        index = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["body"].as_py()), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()
        counts, checks, ids = row["counts"].values.to_numpy(zero_copy_only=False), row["checks"].values, row["ids"].values
        at = np.concatenate([[0], np.cumsum(counts)])
        lo = 0
        while lo < len(counts):
            hi = min(max(lo + 1, int(np.searchsorted(at, at[lo] + (1 << 18), "right")) - 1), len(counts))
            mine = index[at[lo]:at[hi]]
            c = count[mine]
            place = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c) + np.repeat(begin[mine], c)
            ends = np.concatenate([[0], np.cumsum(c)])[at[lo:hi + 1] - at[lo]]
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat[place])), checks.slice(lo, hi - lo)], names=["id", "ids", "check"])
            lo = hi

    return one


def encode(docs: DataFrame, model: Pieces, doc_id: str = "doc_id", text: str = "text", then=None) -> DataFrame:
    """One row (id, ids, check) for each row of ``docs``; ``check`` is a hash of the text with its leading space, for round trips.

    A text's own SPACE marks count as spaces, which the model cannot tell from them. Ids equal those of the model's library. Null and empty texts have no ids. Rows with equal or null ids each keep
    their own result; other columns do not matter. ``docs`` must give its rows in the same order each
    time it is read, as a table does; a change of that order is noticed and fails the job. ``then`` may be (function of
    the result's Arrow batches, its schema), which then runs in the same worker.
    """
    from waymark.session import parallelism, ship_package

    ship_package(docs.sparkSession)
    body = F.replace(F.coalesce(F.col(text), F.lit("")), F.lit(SPACE), F.lit(" "))
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.when(body != "", F.concat(F.lit(" "), body)).otherwise("").alias("t"))
    # Few bytes become many edges: by their size, tasks would be merged until they spill.
    held = rows.mapInArrow(_distinct(model), "block long, bucket int, first long, words string").repartition(parallelism(docs.sparkSession), "bucket")
    held = held.select("block", "bucket", "first", F.posexplode(F.split("words", _END)).alias("i", "word"))
    held = held.select("bucket", F.replace("word", F.lit(" "), F.lit(SPACE)).alias("word"), F.struct("block", (F.col("first") + F.col("i")).alias("at")).alias("block"))
    back = encode_words(held, model, ["bucket"])
    # Ids go back as fixed-width bytes, which takes half of what an array does.
    coded = F.unhex(F.array_join(F.transform("ids", lambda x: F.lpad(F.hex(x), 2 * _wide(model), "0")), ""))
    back = back.select(F.explode("blocks").alias("b"), coded.alias("ids")).select("b.block", "b.at", "ids")
    packed = rows.mapInArrow(_packed(model), _PACKED_SQL)
    one = _assembled(model)
    run, schema = then or (lambda batches: batches, "id long, ids array<int>, check long")

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        if len(left) != 1:
            raise ValueError("islands of a block that is not there; give a table, not an unordered plan")
        out = pa.Table.from_batches(list(run(one(left, right))))
        pa.default_memory_pool().release_unused()
        return out

    return packed.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(block, schema)


def decode_batch(ids: pa.Array, model: Pieces) -> list[bytes]:
    """The text of each list of ids, leading space dropped; a list that is no whole UTF-8 text stays as its bytes."""
    body, first = model.bytes_of
    flat, at = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(np.diff(ids.offsets.to_numpy()))])
    text = []
    for lo in range(0, len(flat), _TOKENS):
        mine = flat[lo:lo + _TOKENS]
        size = first[mine + 1] - first[mine]
        text.append(body[np.arange(int(size.sum())) + np.repeat(first[mine] - (np.cumsum(size) - size), size)])
    text = np.concatenate([np.zeros(0, np.uint8), *text]).tobytes()
    ends = np.concatenate([[0], np.cumsum(first[flat + 1] - first[flat])])[at].tolist()
    out = []
    for lo, hi in zip(ends[:-1], ends[1:], strict=True):
        out.append(text[lo + text.startswith(b" ", lo, hi):hi])
    return out


def decode(rows: DataFrame, model: Pieces, ids: str = "ids") -> DataFrame:
    """``rows`` with column ``text`` decoded from ``ids``; null ids give a null text."""
    keep = [c for c in rows.columns if c != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields)

    def run(batches):
        for b in batches:
            col = b.column(b.schema.get_field_index(ids))
            got = decode_batch(col.fill_null([]) if col.null_count else col, model)
            text = [None if n else t.decode("utf-8", "replace") for n, t in zip(col.is_null().to_pylist(), got, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string())], names=[*b.schema.names, "text"])

    return rows.select(*keep).mapInArrow(run, f"{schema}, text string")


def piece_report(docs: DataFrame, model: Pieces, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256 of the ids as 32-bit little-endian integers, round_trip: decoding gives the text again)."""
    import hashlib

    def run(batches):
        for b in batches:
            ids = b.column(1)
            at = ids.offsets.to_numpy()
            flat = ids.flatten().to_numpy(zero_copy_only=False).astype("<i4")
            at = at - at[0]
            sha = [hashlib.sha256(flat[x:y].tobytes()).hexdigest() for x, y in zip(at[:-1], at[1:], strict=True)]
            texts = [b" " + t if t or y > x else b"" for t, x, y in zip(decode_batch(ids, model), at[:-1], at[1:], strict=True)]
            same = hash_texts(pa.array(texts, pa.binary())).view(np.int64) == b.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(at).astype(np.int64)), pa.array(sha), pa.array(same)], names=["doc_id", "n_tokens", "ids_sha256", "round_trip"])

    return encode(docs, model, doc_id, text, (run, "doc_id long, n_tokens long, ids_sha256 string, round_trip boolean"))
