"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

Each task forms blocks of documents, hashes their windows by two independent Rabin-Karp hashes (61 and 40 bits of them are
kept), and sends each value once, whatever the number of its occurrences there: one row a (block, range of values) with the sorted values packed.
So no row is made per window, and a passage that a third of all documents share is one entry a block.  A range's task finds the values
that more than one block sent and answers each block with one bit a value.  The answers meet the block's texts (the one shuffle of texts), the
windows are hashed again, and those that are repeated merge into maximal removal intervals.

The number of ranges follows the input's size, so a range stays near `bucket_mb` at any scale.  Both passes must form the same
blocks, so an input that is more than files under projections and filters is first written once; a block that still came
out otherwise fails the job instead of cutting wrong words.

Two different windows count as equal with a chance of about n**2 / 2**102 for n windows (4e-5 for 10**13).

Defined results: null or empty texts have no words and keep nothing; texts shorter than a window are kept;
rows with equal doc_id are documents of their own; two rows equal in all hold the same windows and so
remove each other's words, as copies do; an empty table gives an empty table; a text of any length is one document, in a block of its own if it is
longer than a block; doc_id may be of any simple type; further columns of the input are ignored by `remove` and passed through by `apply`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from glossa.llm.common import U64, Words, blocks, grown, need, plan_bytes, planes, squeezed, stable, trimmed, trimmed_group, unplaned, unsqueezed

WINDOW = 35
_CHECK = 5  # bytes kept of the second hash
_BLOCK_BYTES = 4 << 20


def _windows(texts: pa.Array, width: int):
    """Words of a block, its windows' first words, its distinct values in order (two arrays), and for each window its value's number."""
    words = Words(texts, wide=True)
    one, two, at = words.windows(width)
    two = two >> U64(64 - 8 * _CHECK)
    order = np.argsort(one, kind="stable")
    one, two = one[order], two[order]
    if len(one) > 1 and ((one[1:] == one[:-1]) & (two[1:] != two[:-1])).any():  # equal in the first hash alone
        again = np.lexsort((two, one))
        order, one, two = order[again], one[again], two[again]
    new = np.ones(len(one), bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    number = np.empty(len(one), np.int64)
    number[order] = np.cumsum(new) - 1
    return words, at, one[new], two[new], number


def _deal(bits: int, width: int, most: int):
    """(bucket, block, one, two): a block's distinct values dealt by their leading bits, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, table in blocks(batches, most=most):
            _, _, one, two, _ = _windows(table.column("text").chunk(0), width)
            if not len(one):
                continue
            bucket = (one >> U64(64 - bits)).astype(np.int64)
            cut = np.flatnonzero(np.diff(bucket, prepend=-1))
            two = two << U64(64 - 8 * _CHECK)
            rows = [(int(bucket[a]), name, planes(one[a:b]), planes(two[a:b], _CHECK)) for a, b in zip(cut, [*cut[1:], len(one)], strict=True)]
            for k in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 64], strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["bucket", "block", "one", "two"])

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """Of a bucket: for each row, one bit a value, set if another row has the value too."""
    parts = [unplaned(x, 8) for x in table.column("one").to_pylist()]
    one = np.concatenate(parts)
    two = np.concatenate([unplaned(x, 8, _CHECK) for x in table.column("two").to_pylist()])
    order = np.argsort(one, kind="stable")
    s, t = one[order], two[order]
    same = s[1:] == s[:-1]
    differ = same & (t[1:] != t[:-1])
    if differ.any():  # values equal in the first hash alone: order by both
        order = np.lexsort((two, one))
        s, t = one[order], two[order]
        same = (s[1:] == s[:-1]) & (t[1:] == t[:-1])
    hit = np.zeros(len(one), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    cut = np.cumsum([0, *map(len, parts)])
    bits = [squeezed(np.packbits(hit[a:b]).tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "n": pa.array(np.diff(cut)), "bits": pa.array(bits, pa.binary())})


def _blocked(most: int):
    def run(batches):
        for name, table in blocks(batches, most=most):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(table.num_rows, name)), *(c.chunk(0) for c in table.columns)], ["block", *table.schema.names])

    return run


def covered(words: Words, at: np.ndarray, width: int) -> np.ndarray:
    """Which words lie in a window that starts at one of `at`."""
    step = np.zeros(len(words.hash) + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + width, -1)
    return np.cumsum(step[:-1]) > 0


def _cut(width: int, names: list[str]):
    def run(key, docs: pa.Table, answers: pa.Table) -> pa.Table:
        """Texts of a block with the answers for its values: words counted, words removed, what is kept."""
        if not docs.num_rows:
            raise RuntimeError("a block has no texts: the input is not stable")
        docs = docs.combine_chunks()
        words, at, one, _, number = _windows(docs.column("text").chunk(0), width)
        seen = {}
        for bucket, n, bits in sorted(zip(*(answers.column(c).to_pylist() for c in ("bucket", "n", "bits")), strict=True)):
            mask = np.unpackbits(np.frombuffer(unsqueezed(bits), np.uint8), count=n).astype(bool)
            seen[bucket] = seen[bucket] | mask if bucket in seen else mask  # two equal blocks are answered alike
        hit = np.concatenate([np.zeros(0, bool), *seen.values()])
        if len(hit) != len(one):
            raise RuntimeError("a block changed between passes: the input is not stable")
        hit |= np.bincount(number, minlength=len(one)) > 1
        gone = covered(words, at[hit[number]], width)
        n = np.diff(words.doc)
        total = np.concatenate([[0], np.cumsum(gone)])
        removed = total[words.doc[1:]] - total[words.doc[:-1]]
        buf, texts, left = words.buf.tobytes(), [], ~gone
        for i, (a, b) in enumerate(zip(words.doc[:-1].tolist(), words.doc[1:].tolist(), strict=True)):
            pieces = buf[words.start[a] : words.end[b - 1]].split() if b > a else []
            if removed[i]:
                pieces = [pieces[k] for k in np.flatnonzero(left[a:b]).tolist()]
            texts.append(b" ".join(pieces))
        return pa.table(
            [*(docs.column(c) for c in names), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array([x.decode() for x in texts], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())],
            names=[*names, "n_words", "n_removed", "kept_text", "kept_sha256"],
        )

    return run


def _removed(base: DataFrame, width: int, bucket_mb: int, block: int) -> DataFrame:
    """base (doc_id, text, ...) with n_words, n_removed, kept_text, kept_sha256."""
    base = stable(base)
    names = base.columns
    size = plan_bytes(base)
    bits = max(4, (size * 3 // (bucket_mb << 20)).bit_length())
    block = grown(block, bits)
    more = [StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_text", StringType()), StructField("kept_sha256", StringType())]
    dealt = base.select("doc_id", "text").mapInArrow(trimmed(_deal(bits, width, block)), "bucket long, block long, one binary, two binary")
    answers = dealt.groupBy("bucket").applyInArrow(trimmed_group(_repeated), "block long, bucket long, n long, bits binary")
    docs = base.mapInArrow(trimmed(_blocked(block)), StructType([StructField("block", LongType()), *base.schema.fields]))
    return docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(trimmed_group(_cut(width, names)), StructType([*base.schema.fields, *more]))


def remove(df: DataFrame, width: int = WINDOW, bucket_mb: int = 12, block: int = _BLOCK_BYTES) -> DataFrame:
    """(doc_id, text, n_words, n_removed, kept_text, kept_sha256) for each row of df."""
    return _removed(need(df, "doc_id", "text"), width, bucket_mb, block)


def apply(df: DataFrame, width: int = WINDOW) -> DataFrame:
    """df with repeated passages cut from `text`; a text that loses nothing stays as it was.  `n_chars` follows the text."""
    names = df.columns
    base = df.select(F.col("doc_id"), F.col("text"), F.struct(*(F.col(f"`{c}`") for c in names if c != "text")).alias("_row"))
    out = _removed(base, width, 12, _BLOCK_BYTES)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return out.select(*(text.alias("text") if c == "text" else F.length(text).cast("long").alias(c) if c == "n_chars" else F.col(f"_row.`{c}`").alias(c) for c in names))


def digest(df: DataFrame, width: int = WINDOW) -> DataFrame:
    return remove(df, width).select("doc_id", "n_words", "n_removed", "kept_sha256")
