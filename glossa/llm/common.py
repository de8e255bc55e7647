"""Shared parts of the corpus operators: column guards, shared-folder tables, hashed
word arithmetic over whole Arrow batches, and distributed connected components.

A batch of texts becomes one byte buffer; word borders come from a mask, a batch's distinct words are found by Arrow's
dictionary and hashed once each by xxh3, and windows of words are Rabin-Karp hashes modulo the prime 2**61 - 1.  (A modulus that is a
power of two has texts of two letters that collide for every base, Thue and Morse's; a prime has none.)
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import inspect
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_P = (1 << 61) - 1
_BASES = 0x1E3779B97F4A7C15 % _P, 0x0D6E8FEB86659FD9 % _P
#: Bytes that part words: space and \x09-\x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on an array of unsigned 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_POWERS = np.cumprod(np.full(1 << 12, 0x9E3779B97F4A7C15, U64))


def powers(at: np.ndarray) -> np.ndarray:
    """A fixed odd 64-bit number for each place in a string; places far out are mixed anew."""
    return _POWERS[at & 0xFFF] ^ mix((at >> 12).astype(U64) << U64(1)) if len(at) and at.max() >> 12 else _POWERS[at]


def _below(x: np.ndarray) -> np.ndarray:
    """x modulo 2**61 - 1."""
    x = (x & U64(_P)) + (x >> U64(61))
    return np.where(x >= U64(_P), x - U64(_P), x)


def _times(x: np.ndarray, by: int) -> np.ndarray:
    """x * by, of values below 2**61 - 1: less than 2**63, congruent, not reduced."""
    half, low = U64(32), U64(0xFFFFFFFF)
    b1, b0 = U64(by >> 32), U64(by & 0xFFFFFFFF)
    x1, x0 = x >> half, x & low
    middle, last = x1 * b0 + x0 * b1, x0 * b0
    # 2**64 is 8 and 2**61 is 1 modulo 2**61 - 1
    return x1 * b1 * U64(8) + (middle >> U64(29)) + ((middle & U64((1 << 29) - 1)) << half) + (last & U64(_P)) + (last >> U64(61))


def rolling(values: np.ndarray, width: int, base: int = _BASES[0]) -> np.ndarray:
    """Rabin-Karp hashes modulo 2**61 - 1 of all windows of `width` neighbours of `values`, mixed; empty if there is none.

    A window's hash is put together from those of its two parts, so `width` costs its logarithm.
    """
    n = len(values)
    if n < width:
        return np.empty(0, U64)
    part, size, out, have = _below(values), 1, None, 0
    while True:
        if width & size:
            if out is None:
                out, have = part, size
            else:
                out = _below(_times(out[: n - have - size + 1], pow(base, size, _P)) + part[have:])
                have += size
        if 2 * size > width:
            return mix(out)
        part = _below(_times(part[:-size], pow(base, size, _P)) + part[size:])
        size *= 2


def string_hashes(x: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string (no nulls)."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, x.cast(pa.large_binary()).to_pylist()), U64, len(x))


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of a batch of texts (null: empty).

    buf: all bytes, a space after each text; start, end: byte borders of words;
    hash: one 64-bit value a word (xxh3; if `wide`, the first half of 128 bits, `other` the second); doc: word offsets of texts (length texts + 1).
    """

    other: np.ndarray | None = None

    def __init__(self, texts: pa.Array, lower: bool = False, wide: bool = False):
        texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
        if texts.null_count:
            texts = texts.fill_null("")
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
        first, last = (int(offsets[0]), int(offsets[-1])) if n else (0, 0)
        data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[first:last] if last > first else np.empty(0, np.uint8)
        ends = (offsets - first)[1:]
        # a space after each text keeps words of neighbours apart
        buf = np.insert(data, ends, np.uint8(0x20)) if n else data
        self.buf = _LOWER[buf] if lower else buf
        self.text_end = ends + np.arange(1, n + 1)  # after the added space
        inside = ~_SPACE[self.buf]
        edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.doc = np.concatenate([[0], np.searchsorted(self.start, self.text_end)]).astype(np.int64)
        at = np.concatenate([[0], np.cumsum(self.end - self.start)]).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.start), [None, pa.py_buffer(at), pa.py_buffer(self.buf[inside])]).dictionary_encode()
        number = words.indices.to_numpy()
        if wide:
            both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words.dictionary.to_pylist())), U64).reshape(-1, 2)
            self.hash, self.other = both[number, 0], both[number, 1]
        else:
            self.hash = string_hashes(words.dictionary)[number]

    def windows(self, width: int) -> tuple[np.ndarray, ...]:
        """Hashes of all word windows that lie within one text, a second, independent hash if the words are `wide`, and their first words' numbers."""
        count = np.diff(self.doc)
        at = np.arange(max(0, len(self.hash) - width + 1))
        at = at[at + width <= np.repeat(self.doc[1:], count)[: len(at)]]
        if self.other is None:
            return rolling(self.hash, width)[at], at
        return rolling(self.hash, width)[at], rolling(self.other, width, _BASES[1])[at], at


def trim() -> None:
    """Gives memory that a Python worker no longer uses back to the system: workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def trimmed(f):
    """A function over batches that gives back what it held when it ends."""

    @functools.wraps(f)
    def run(batches):
        try:
            yield from f(batches)
        finally:
            trim()

    return run


def trimmed_group(f):
    """The same for a function over one group."""

    @functools.wraps(f)
    def run(*args):
        try:
            return f(*args)
        finally:
            trim()

    run.__signature__ = inspect.signature(f)
    return run


def need(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that further columns can't clash with working names."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*(F.col(f"`{c}`") for c in columns))


def shared_dir(spark: SparkSession) -> str:
    """A new folder's name below spark.checkpoint.dir; local sessions without that setting get one in /tmp."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "/tmp/checkpoints"
    return f"{base}/glossa-{uuid.uuid4().hex}"


#: Folders of tables that this process wrote and has not deleted yet.
_written: list[str] = []


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: cuts lineage and outlives executors.  It is deleted by `finished`, or when the process ends."""
    path = shared_dir(df.sparkSession)
    if not _written:
        atexit.register(_sweep, df.sparkSession)
    _written.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def finished(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """The result of `make`, written once; tables written on the way are deleted."""
    before = len(_written)
    out = written(make())
    for path in _written[before:-1]:
        _delete(spark, path)
    del _written[before:-1]
    return out


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _sweep(spark: SparkSession) -> None:
    """At the end of the process: what is left; a session that is gone already leaves its folders to whoever owns the shared one."""
    with contextlib.suppress(Exception):
        for path in _written:
            _delete(spark, path)


def stable(df: DataFrame) -> DataFrame:
    """df if it is files under projections and filters alone, so that every pass has the same rows in the same order; else df written once."""
    plan = df._jdf.queryExecution().optimizedPlan()
    fixed = plan.deterministic()
    while fixed and plan.children().length() == 1:
        fixed = plan.nodeName() in ("Project", "Filter")
        plan = plan.children().apply(0)
    return df if fixed and plan.nodeName() == "LogicalRelation" else written(df)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of df; for a scan the bytes of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame, least: int = 1, per: int = 16 << 20, grows: float = 1.0) -> int:
    """Partitions for a shuffle of about `grows` times df, at `per` bytes each; grows with the input, no upper bound."""
    return max(least, math.ceil(plan_bytes(df) * grows / per))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of `column`; a longer text stands alone."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        total, begin = np.concatenate([[0], np.cumsum(sizes)]), 0
        while begin < len(sizes):
            stop = max(begin + 1, int(np.searchsorted(total, total[begin] + most, side="right")) - 1)
            yield batch.slice(begin, stop - begin)
            begin = stop


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 8 << 20) -> Iterator[tuple[int, pa.Table]]:
    """A task's rows in runs of about `most` bytes of `column`, each with a name made from its ids and texts.

    Where a run ends hangs on its texts alone, not on Arrow's batches or on other columns, so a second pass over a stable input forms the same
    blocks under the same names, whatever columns it reads and in whatever order tasks run or are run again.
    """
    held, size = [], 0

    def close():
        table = pa.Table.from_batches(held).combine_chunks()
        h = xxhash.xxh64(seed=7)
        for values in (table.column(c).chunk(0) for c in ("doc_id", column)):
            h.update(values.is_null().cast(pa.uint8()).to_numpy(zero_copy_only=False).tobytes())
            if pa.types.is_string(values.type):
                values = values.fill_null("")
                h.update(pa.compute.binary_length(values).to_numpy().tobytes())
            elif values.null_count:
                values = values.fill_null(pa.scalar(0).cast(values.type))
            for b in values.buffers()[1 + pa.types.is_string(values.type) :]:
                h.update(b or b"")
        return int(np.uint64(h.intdigest()).astype(np.int64)), table

    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 16
        total, begin = np.concatenate([[0], np.cumsum(sizes)]), 0
        while begin < len(sizes):
            stop = int(np.searchsorted(total, total[begin] + most - size))  # rows before it fill the block
            part = batch.slice(begin, min(stop, len(sizes)) - begin)
            held.append(pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in part.columns], schema=batch.schema))
            if stop > len(sizes):
                size += int(total[-1] - total[begin])
                break
            yield close()
            held, size, begin = [], 0, stop
    if held:
        yield close()


def grown(block: int, bits: int) -> int:
    """Bytes of a block where values are dealt to 2**bits ranges: from 2**15 on blocks grow with the ranges, up to eight times, so that a block's share of one does not shrink to a few values."""
    return block << min(3, max(0, (bits - 13) // 2))


_ZSTD = pa.Codec("zstd", 1)


def planes(x: np.ndarray, keep: int | None = None) -> bytes:
    """An unsigned array byte plane by byte plane, most significant first, under zstd: leading bytes of sorted or small values cost little."""
    width = x.dtype.itemsize
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(-1, width)[:, ::-1]
    raw = np.ascontiguousarray(raw[:, : keep or width].T)
    return raw.size.to_bytes(8, "little") + _ZSTD.compress(raw.tobytes(), asbytes=True)


def squeezed(b: bytes) -> bytes:
    return len(b).to_bytes(8, "little") + _ZSTD.compress(b, asbytes=True)


def unsqueezed(b: bytes) -> bytes:
    return _ZSTD.decompress(b[8:], int.from_bytes(b[:8], "little"), asbytes=True)


def unplaned(b: bytes, width: int, keep: int | None = None) -> np.ndarray:
    keep = keep or width
    raw = np.frombuffer(_ZSTD.decompress(b[8:], int.from_bytes(b[:8], "little")), np.uint8).reshape(keep, -1)
    out = np.zeros((raw.shape[1], width), np.uint8)
    out[:, width - keep :] = raw[::-1].T
    return out.view(f"<u{width}").reshape(-1)


class Forest:
    """Union-find over integer ids within one task; roots are the smallest ids."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.setdefault(x, x)) != x:
            up[x] = up[p]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a task as stars: each id with the smallest id that the task's links reach; at most one row an id."""
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
        if len(forest.up) > 1 << 20:  # bounded memory: hand on what is known and start anew
            yield from _stars(forest, False)
            forest = Forest()
    yield from _stars(forest, False)


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All links in one task: each id with its root, roots included."""
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
    yield from _stars(forest, True)


def _stars(forest: Forest, roots: bool) -> Iterator[pa.RecordBatch]:
    pairs = [(forest.root(x), x) for x in list(forest.up)]
    pairs = [p for p in pairs if roots or p[0] != p[1]]
    for k in range(0, len(pairs), 1 << 16):
        part = pairs[k : k + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in part], pa.int64()), pa.array([p[1] for p in part], pa.int64())], ["a", "b"])


#: So many links fit into one task's union-find, which ends the rounds; more go on in rounds until so few are left or none changes.
_FEW_LINKS = 1 << 18


def components(links: DataFrame, parts: int) -> DataFrame:
    """(id, component_id): the smallest id that `links` (a, b) reach from id, for ids with a link.

    Each task first contracts its links to stars, then large-star and small-star steps alternate
    until no link changes.  Every round is one table in the shared folder; nothing but
    two sums reaches the driver; a fixed number of links or fewer is settled by one task.  Null ends are left out; an empty table gives an empty table.
    """
    links = need(links, "a", "b").where("a is not null and b is not null and a <> b")
    schema = "a long, b long"
    now = written(links.mapInArrow(trimmed(_contract), schema))
    signature = None
    for _ in range(60):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == signature or not mark[0]:
            break
        if mark[0] <= _FEW_LINKS:
            settled = written(now.coalesce(1).mapInArrow(trimmed(_settle), schema))
            return settled.select(F.col("b").alias("id"), F.col("a").alias("component_id"))
        signature = mark
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: each neighbour larger than u gets the smallest id near u
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b")
        # small star: u and its smaller neighbours get the smallest of them
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").union(low.select(F.col("m").alias("a"), F.col("u").alias("b")))
        now = written(small.mapInArrow(trimmed(_contract), schema).distinct().coalesce(parts))
    else:
        raise RuntimeError("components: no fixed point in 60 rounds")
    roots = now.groupBy("b").agg(F.min("a").alias("component_id")).select(F.col("b").alias("id"), "component_id")
    return roots.union(now.select(F.col("a").alias("id"), F.col("a").alias("component_id")).distinct())
