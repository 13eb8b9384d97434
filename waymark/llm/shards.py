"""Token ids in training order, as fixed-stride binary shards.

Texts are tokenized and packed into sequences of equal length. A keyed Feistel permutation with cycle-walking maps each
sequence's running number to its global slot, so the training order needs no sort key to be stored and can be
inverted. Shard s holds slots s * per_shard onwards, one after the other, each as wide as the stride; a reader that
stops after any slot goes on at a byte offset it can compute.
"""

from __future__ import annotations

import base64
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from waymark.llm.words import mix
from waymark.session import shared_folder

# Fixed value: how the rank files' vocabulary splits a text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
LENGTH = 2048
PER_SHARD = 8192
KEY = 20_240_607
#: Ends each record, so the stride is 2 * length + 2 bytes.
TAIL = "\n\n"
ROUNDS = 4


def permute(index: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """A bijection of 0..n-1: a Feistel network on the next power of four, walked until it falls below ``n``."""
    half = max(1, math.ceil(max(n - 1, 1).bit_length() / 2))
    low = np.uint64((1 << half) - 1)
    shift = np.uint64(half)
    keys = mix(np.arange(ROUNDS, dtype=np.uint64) + np.uint64(key))

    def once(x):
        left, right = x >> shift, x & low
        for k in (keys[::-1] if inverse else keys):
            if inverse:
                left, right = right ^ (mix(left + k) & low), left
            else:
                left, right = right, left ^ (mix(right + k) & low)
        return (left << shift) | right

    with np.errstate(over="ignore"):
        out = once(np.asarray(index, np.uint64))
        while (far := out >= np.uint64(n)).any():
            out[far] = once(out[far])
    return out.astype(np.int64)


def _encoder(raw: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), len(ranks)


def sequences(docs: DataFrame, tokenizer: str = TOKENIZER, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, no, n_tokens, doc_ids, packed): each task's texts, an end token (the first free id) after each, cut into ``length`` ids.

    The last sequence of a task is filled up with end tokens. Null texts count as empty and are an end token alone.
    """
    spark = docs.sparkSession
    with open(tokenizer, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())

    def run(batches):
        encode, end = _encoder(ranks.value)
        if end > 0xFFFF:
            raise ValueError("ids must fit into 16 bits")
        part, no = TaskContext.get().partitionId(), 0
        zip_ = zstandard.ZstdCompressor(3)
        held, ids, size = [], [], 0
        done: list[tuple] = []

        def cut(last):
            nonlocal held, ids, size, no
            flat = np.concatenate(held)
            ends = np.cumsum([len(x) for x in held])
            whole = len(flat) // length if not last else -(-len(flat) // length)
            starts = ends - [len(x) for x in held]
            for k in range(whole):
                body = flat[k * length:(k + 1) * length]
                n = len(body)
                if n < length:
                    body = np.concatenate([body, np.full(length - n, end, np.uint16)])
                inside = range(int(np.searchsorted(ends, k * length, "right")), int(np.searchsorted(starts, (k + 1) * length, "left")))
                done.append((part, no, n, [ids[i] for i in inside], zip_.compress(body.astype("<u2").tobytes())))
                no += 1
            left = [i for i in range(len(ids)) if ends[i] > whole * length]
            held = [flat[max(starts[i], whole * length):ends[i]] for i in left]
            ids, size = [ids[i] for i in left], max(0, len(flat) - whole * length)

        def rows():
            cols = list(zip(*done, strict=True))
            done.clear()
            types = (pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=["part", "no", "n_tokens", "doc_ids", "packed"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = encode.encode_ordinary(t.as_py())
                x.append(end)
                held.append(np.array(x, np.uint16))
                ids.append(i)
                size += len(x)
                if size >= 512 * length:
                    cut(False)
                    if done:
                        yield rows()
        if size:
            cut(True)
            yield rows()

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return rows.mapInArrow(run, "part int, no long, n_tokens int, doc_ids array<long>, packed binary")


def write_shards(docs: DataFrame, folder: str | None = None, tokenizer: str = TOKENIZER, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, doc_id: str = "doc_id", text: str = "text") -> tuple[str, DataFrame]:
    """Write the shards below ``folder`` (a fresh shared one by default); returns it and the index of slots.

    The index has one row (slot, shard, offset, n_tokens, doc_ids, check) for each sequence: ``offset`` is its first byte in file
    ``part-<shard>``, ``check`` the crc32 of its ids as 16-bit little-endian integers. An empty table writes nothing. Every row's
    tokens are written, whatever its id; null ids are null in ``doc_ids``.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "shards")
    held = shared_folder(spark, "sequences")
    sequences(docs, tokenizer, length, doc_id, text).write.option("compression", "zstd").parquet(held)
    table = spark.read.schema("part int, no long, n_tokens int, doc_ids array<long>, packed binary").parquet(held)
    counts = {r["part"]: r["n"] for r in table.groupBy("part").agg(F.count("*").alias("n")).toLocalIterator()}  # one number a task
    first, n = {}, 0
    for p in sorted(counts):
        first[p] = n
        n += counts[p]
    first = spark.sparkContext.broadcast(first)

    def slots(batches):
        zip_ = zstandard.ZstdDecompressor()
        for b in batches:
            part, no = b.column(0).to_numpy(), b.column(1).to_numpy()
            slot = permute(np.array([first.value[p] for p in part.tolist()], np.int64) + no, n, key)
            check = [zlib.crc32(zip_.decompress(x.as_py())) for x in b.column(4)]
            shard = slot // per_shard
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(shard), pa.array((slot % per_shard) * (2 * length + len(TAIL))), b.column(2), b.column(3), pa.array(check, pa.int64())], names=["slot", "shard", "offset", "n_tokens", "doc_ids", "check"])

    index = table.mapInArrow(slots, "slot long, shard long, offset long, n_tokens int, doc_ids array<long>, check long")
    if n == 0:
        return folder, index

    def keyed(batches):
        for b in batches:
            part, no = b.column(0).to_numpy(), b.column(1).to_numpy()
            slot = permute(np.array([first.value[p] for p in part.tolist()], np.int64) + no, n, key)
            yield pa.RecordBatch.from_arrays([pa.array(slot), b.column(2)], names=["slot", "packed"])

    def unpacked(batches):
        zip_ = zstandard.ZstdDecompressor()
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                yield pa.RecordBatch.from_arrays([pa.array([zip_.decompress(x.as_py()) for x in b.column(1).slice(lo, 1024)], pa.binary())], names=["record"])

    rows = table.select("part", "no", "packed").mapInArrow(keyed, "slot long, packed binary")
    rows = rows.repartitionById(-(-n // per_shard), F.expr(f"int(slot div {per_shard})")).sortWithinPartitions("slot")
    rows.mapInArrow(unpacked, "record binary").select(F.col("record").cast("string").alias("value")).write.option("lineSep", TAIL).option("compression", "none").text(folder)
    return folder, index


def read_shards(spark: SparkSession, folder: str, length: int = LENGTH, per_shard: int = PER_SHARD) -> DataFrame:
    """(slot, ids): every stored sequence, one file a task."""
    stride = 2 * length + len(TAIL)

    def run(batches):
        for b in batches:
            for shard, body in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = np.frombuffer(body.as_py(), np.uint8)
                if len(raw) % stride:
                    raise ValueError(f"shard {shard} is cut off")
                m = raw.reshape(-1, stride)
                for lo in range(0, len(m), 1024):
                    part = np.ascontiguousarray(m[lo:lo + 1024, :2 * length])
                    yield pa.RecordBatch.from_arrays([pa.array(shard * per_shard + lo + np.arange(len(part))), pa.array([x.tobytes() for x in part], pa.binary())], names=["slot", "ids"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    files = files.select(F.regexp_extract("path", r"part-(\d+)-[^/]*$", 1).cast("long").alias("shard"), "content")
    return files.mapInArrow(run, "slot long, ids binary")


def slots_from(folder: str, slot: int, length: int = LENGTH, per_shard: int = PER_SHARD) -> Iterator[np.ndarray]:
    """Sequences from ``slot`` on, of a folder that this machine can open: a seek, then sequential reads."""
    import glob

    stride = 2 * length + len(TAIL)
    files = {int(p.rsplit("part-", 1)[1].split("-")[0]): p for p in glob.glob(f"{folder.removeprefix('file:').replace('///', '/')}/part-*")}
    for shard in sorted(files):
        if (shard + 1) * per_shard <= slot:
            continue
        with open(files[shard], "rb") as f:
            f.seek(max(0, slot - shard * per_shard) * stride)
            while len(raw := f.read(stride)) == stride:
                yield np.frombuffer(raw[:2 * length], "<u2")


def shard_report(docs: DataFrame, **options) -> DataFrame:
    """The index of a fresh set of shards, and ``stored``: whether the file read back holds the same ids at that slot."""
    folder, index = write_shards(docs, **options)
    some = {k: v for k, v in options.items() if k in ("length", "per_shard")}

    def checks(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([zlib.crc32(x.as_py()) for x in b.column(1)], pa.int64())], names=["slot", "read"])

    try:
        back = read_shards(docs.sparkSession, folder, **some).mapInArrow(checks, "slot long, read long")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        back = docs.sparkSession.createDataFrame([], "slot long, read long")
    return index.join(back, "slot", "left").withColumn("stored", F.col("read").eqNullSafe(F.col("check"))).drop("read")
