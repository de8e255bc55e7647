"""Token-ID output in training order: a keyed Feistel permutation gives every sequence its global slot.

Documents are encoded and cut into sequences of at most `length` ids; each task numbers its own sequences, and a running sum over tasks
(one row a task) makes the numbers global: 0 .. N-1.  A balanced Feistel network over the next even power of two, walked
along its cycle until it falls below N, is a bijection of 0 .. N-1, so every sequence finds its slot alone: no sort by random
numbers, no driver, and the same key gives the same order.  Range partitions then hold whole shards of `per_shard` neighbouring
slots; a shard is one buffer of fixed stride, so slot s lies at byte (s % per_shard) * stride of shard s // per_shard, and a
reader that stopped at slot s goes on there.

Shards are rows of a table (one row a shard, sorted), written by Spark's committer: a task that is run again writes the same rows.
`write` and `read` give that table and resumable reads from it; `export_file` puts shards into one flat file where one is wanted.

Defined results: null text is empty and makes one sequence, the end id; repeated rows make their own sequences; a text longer than a
sequence makes several; ids outside the chosen width raise; an empty table makes no shards; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossa.llm.common import U64, mix, need, slices, spread, trimmed, written
from glossa.llm.packing import Coder

LENGTH, PER_SHARD, KEY, ROUNDS = 1024, 256, 0x5EED, 6


def _half(n: int) -> int:
    """Bits of half a block, so that 2**(2 * half) is at least n."""
    return max(1, (max(1, n - 1).bit_length() + 1) // 2)


def _network(x: np.ndarray, half: int, key: int, forward: bool) -> np.ndarray:
    low = U64((1 << half) - 1)
    left, right = x >> U64(half), x & low
    for r in range(ROUNDS) if forward else range(ROUNDS - 1, -1, -1):
        secret = mix(np.array([key * 1_000_003 + r], U64))[0]
        if forward:
            left, right = right, left ^ (mix(right ^ secret) & low)
        else:
            left, right = right ^ (mix(left ^ secret) & low), left
    return left << U64(half) | right


def permute(x: np.ndarray, n: int, key: int = KEY, forward: bool = True) -> np.ndarray:
    """Numbers below n to their slots below n (or back): the network is walked until it falls below n."""
    half = _half(n)
    out = _network(x.astype(U64), half, key, forward)
    while (far := out >= U64(n)).any():
        out[far] = _network(out[far], half, key, forward)
    return out.astype(np.int64)


def sequences(df: DataFrame, path: str, ranks: str, source: str, length: int = LENGTH, end: int = 0) -> DataFrame:
    """(doc_id, piece, n_tokens, ids, task, place): ids as little-endian unsigned 16-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, place, task = Coder(path, ranks, source), 0, TaskContext.get().partitionId()
        for batch in slices(batches, "text"):
            if not batch.num_rows:
                continue
            ids, *_ = coder.shard(batch.column("text"))
            doc, piece, data = [], [], []
            for d, x in enumerate(ids):
                x = np.append(x, end)
                if x.max() > 65_535:
                    raise ValueError("an id does not fit into 16 bits")
                x = x.astype("<u2")
                for p in range(0, len(x), length):
                    doc.append(d)
                    piece.append(p // length)
                    data.append(x[p : p + length].tobytes())
            n = len(doc)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int64()), pa.array([len(b) // 2 for b in data], pa.int64()), pa.array(data, pa.binary()), pa.array(np.full(n, task, np.int64)), pa.array(np.arange(place, place + n))],
                ["doc_id", "piece", "n_tokens", "ids", "task", "place"],
            )
            place += n

    base = need(df, "doc_id", "text")
    return base.mapInArrow(trimmed(run), f"doc_id {base.schema['doc_id'].dataType.simpleString()}, piece long, n_tokens long, ids binary, task long, place long")


def _slots(n: int, key: int):
    def run(batches):
        for batch in batches:
            index = batch.column("before").to_numpy() + batch.column("place").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(permute(index, n, key)), *(batch.column(c) for c in ("doc_id", "piece", "n_tokens", "ids"))], ["slot", "doc_id", "piece", "n_tokens", "ids"])

    return run


def _shards(length: int, per_shard: int, kind: pa.DataType):
    """Sorted slots to shards; a shard may run over batches."""

    def run(batches):
        held = []

        def close(table: pa.Table) -> pa.RecordBatch:
            rows = [table.column(c).to_pylist() for c in ("slot", "doc_id", "piece", "n_tokens", "ids")]
            n, first = table.num_rows, rows[0][0]
            out = np.zeros((n, length), "<u2")
            size = np.array(rows[3])
            at = np.repeat(np.arange(n) * length - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            out.reshape(-1)[at] = np.frombuffer(b"".join(rows[4]), "<u2")
            payload = out.tobytes()
            return pa.RecordBatch.from_arrays(
                [pa.array([first // per_shard]), pa.array([first]), pa.array([n]), pa.array([2 * length]), pa.array([per_shard]), pa.array([rows[1]], pa.list_(kind)), pa.array([rows[2]], pa.list_(pa.int64())), pa.array([rows[3]], pa.list_(pa.int64())), pa.array([zlib.crc32(payload)], pa.int64()), pa.array([payload], pa.binary())],
                ["shard_id", "first_slot", "n_sequences", "stride", "per_shard", "doc_ids", "pieces", "n_tokens", "crc32", "payload"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            shard = table.column("slot").to_numpy() // per_shard
            cut = np.flatnonzero(np.diff(shard, prepend=shard[0] - 1))
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                yield close(table.slice(a, b - a))
            held = table.slice(int(cut[-1])).to_batches()
        if held:
            yield close(pa.Table.from_batches(held))

    return run


def shards(df: DataFrame, path: str, ranks: str, source: str, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY) -> DataFrame:
    """One row a shard, in slot order within range partitions: shard_id, first_slot, n_sequences, stride, per_shard, doc_ids, pieces, n_tokens, crc32, payload."""
    made = written(sequences(df, path, ranks, source, length))
    counts = made.groupBy("task").agg(F.count("*").alias("n"))  # one row a task of the scan
    before = counts.select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("before"))
    n = int(counts.agg(F.sum("n")).first()[0] or 0)
    kind = made.schema["doc_id"].dataType.simpleString()
    # one row a scan task, 16 bytes each: far below any input, so it is sent to all tasks rather than all sequences dealt by task
    placed = made.join(F.broadcast(before), "task").mapInArrow(trimmed(_slots(n, key)), f"slot long, doc_id {kind}, piece long, n_tokens long, ids binary")
    parts = spread(made, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # slots are 0 .. n - 1, so even ranges of shards are known beforehand and nothing need be sampled
    ranges = F.floor(F.floor(F.col("slot") / per_shard) * parts / max(1, -(-n // per_shard))).cast("int")
    ranged = placed.withColumn("range", ranges).repartitionById(parts, "range").sortWithinPartitions("slot").drop("range")
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    return ranged.mapInArrow(trimmed(_shards(length, per_shard, arrow)), f"shard_id long, first_slot long, n_sequences long, stride long, per_shard long, doc_ids array<{kind}>, pieces array<long>, n_tokens array<long>, crc32 long, payload binary")


def write(df: DataFrame, folder: str) -> None:
    """Shards as a table; files hold neighbouring shards, so a read from a slot on skips files by their statistics."""
    df.write.mode("errorifexists").parquet(folder)


def unpack(df: DataFrame) -> DataFrame:
    """(slot, shard_id, offset, doc_id, piece, n_tokens, ids) for each sequence of shards, read back from their payloads."""
    kind = df.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                if zlib.crc32(r["payload"]) != r["crc32"]:
                    raise ValueError(f"shard {r['shard_id']} is damaged")
                n, stride = r["n_sequences"], r["stride"]
                at = np.arange(n) * stride
                ids = [r["payload"][a : a + 2 * k] for a, k in zip(at.tolist(), r["n_tokens"], strict=True)]
                yield pa.RecordBatch.from_pydict(
                    {"slot": pa.array(r["first_slot"] + np.arange(n)), "shard_id": pa.array(np.full(n, r["shard_id"])), "offset": pa.array(at), "doc_id": pa.array(r["doc_ids"], batch.schema.field("doc_ids").type.value_type), "piece": pa.array(r["pieces"], pa.int64()), "n_tokens": pa.array(r["n_tokens"], pa.int64()), "ids": pa.array(ids, pa.binary())}
                )

    return df.mapInArrow(trimmed(run), f"slot long, shard_id long, offset long, doc_id {kind}, piece long, n_tokens long, ids binary")


def read(spark: SparkSession, folder: str, start: int = 0, stop: int | None = None) -> DataFrame:
    """Sequences of slots start <= slot < stop; only shards that hold them are read.  The table itself says how many slots a shard has."""
    table = spark.read.parquet(folder)
    one = table.select("per_shard").first()
    table = table.where(F.col("first_slot") > start - (one[0] if one else 1))
    rows = unpack(table if stop is None else table.where(F.col("first_slot") < stop)).where(F.col("slot") >= start)
    return rows if stop is None else rows.where(F.col("slot") < stop)


def export_file(df: DataFrame, file: str) -> int:
    """Payloads in shard order as one flat file on the caller's machine, shard by shard; bytes written."""
    total = 0
    with open(file, "wb") as f:
        for r in df.orderBy("shard_id").select("payload").toLocalIterator():
            total += f.write(r[0])
    return total


def digest(df: DataFrame, path: str, ranks: str, source: str) -> DataFrame:
    rows = unpack(shards(df, path, ranks, source))
    return rows.select("slot", "shard_id", "offset", "doc_id", "piece", "n_tokens", F.crc32("ids").alias("ids_crc32"))
