"""Lexical retrieval packing: neighbours found by BM25 fill the window that a seed document opened.

1. One pass counts, over all documents, the documents, their terms and bytes, and in how many documents terms occur: exactly for one term in `SAMPLED` (by
   hash), and for all terms by `CELLS` hash values.  Cells are exact enough for BM25, where a rare term that shares its cell loses weight by the logarithm alone;
   their size is fixed, so they can be sent to all tasks.
2. The index is sharded by content.  Of the exactly counted terms the `TOPICS` whose frequency is nearest to a quarter of a shard's documents (or to four times the
   documents a topic must hold for all to have one) are the topics.  A document goes by its three nearest topics, so documents that share them
   stand together wherever they come from.  Range bounds come from a sample of documents, as Spark's own do, and end in a number that
   differs for every row, so a third of all documents being copies is parted evenly.  This is the one shuffle of texts.
3. A shard is a run of about `shard_bytes` of a task's sorted documents.  It has its own inverted index: a term's postings with BM25 weights from the
   corpus' document frequencies and mean length.  Terms found in one document of the shard can rank no other there and are not indexed; all others are.

A window is opened by a seed (a document not
used yet, or the rest of one that was cut); when the seed ends before the window does, the
index is asked with the seed's terms, and unused neighbours follow by falling score until the window is full.
Without a neighbour the next unused document follows.  The last document of a window is cut at its end
and its rest opens the next one, so all windows are full but a shard's last, which is
cut into powers of two; hence there is no padding at all.

Ids are those of the `tokenizers` library for the vocabulary, found once a distinct chunk of
a shard through the same vocabulary as ranks; texts that hold a special token's string go through the library itself.

Defined results: null text is empty, so the document is its end id alone; repeated rows are packed one by
one; ties in score go to the earlier document of the shard, ties between topics to the smaller hash; an empty table gives an empty table; texts are used
whole, a long one alone may exceed a shard's size; doc_id may be of any simple type, null too; further columns are ignored.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from glossa.llm.bpe import chunks_of, edges, encoder, joined, per_chunk, term_hashes, token_bytes
from glossa.llm.common import U64, mix, need, planes, slices, spread, stable, trimmed, trimmed_group, unplaned, written

SHARD_BYTES = 4 << 20
LENGTH = 1024
K1, B = 1.2, 0.75
#: Counted hash values of terms, and the parts in which counts travel.
CELLS, _PARTS = 1 << 20, 64
#: One term in so many is counted exactly; at most so many topics, which go to all tasks (2 MB).
SAMPLED, TOPICS = 16, 1 << 17
#: Documents looked at for range bounds: so many a partition, and never more than so many in all.
_BOUNDS, _MOST_BOUNDS = 40, 1_000_000


@functools.cache
def library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def special_tokens(path: str) -> list[str]:
    """Strings that the library takes for special tokens; read from the file, so the library is loaded only where a text holds one."""
    with open(path) as f:
        return [t["content"] for t in json.load(f)["added_tokens"]]


def _cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U64(64 - CELLS.bit_length() + 1)).astype(np.int64)


class Coder:
    """Ids of whole texts, by chunks between single spaces, which stand alone unless white space is at their edges."""

    def __init__(self, path: str, ranks: str, source: str):
        self.path, self.special = path, special_tokens(path)
        self.one = encoder(ranks, source).encode_ordinary
        self.width = np.fromiter(map(len, token_bytes(ranks)), np.int64)

    def text(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(library(self.path).encode(text, add_special_tokens=False).ids, np.int32)
        return np.array(self.one(text), np.int32)

    def _each(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of " " + chunk for chunks that stand alone, all in one text: flat ids and their number for each chunk."""
        if not len(chunks):
            return np.empty(0, np.int32), np.empty(0, np.int64)
        flat = np.array(self.one(joined(chunks)), np.int32)
        return flat, per_chunk(chunks, self.width[flat])

    def shard(self, texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, pa.Array]:
        """Each text's ids; chunk numbers in order; the chunk offsets of texts; the distinct chunks."""
        chunk, values, offsets = chunks_of(texts)
        edge = edges(values)
        for special in self.special:
            edge |= pc.match_substring(values, special).to_numpy(zero_copy_only=False)
        flat, some = self._each(values.filter(pa.array(~edge)))
        count = np.zeros(len(values), np.int64)
        count[~edge] = some
        begin = np.cumsum(count) - count
        spaced = any(" " in s for s in self.special)
        odd_at = edge[chunk]
        odd = np.concatenate([[0], np.cumsum(odd_at)])
        n = count[chunk]
        n[offsets[:-1]] = 0  # a text's first chunk has no space before it
        at = np.repeat(begin[chunk] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        every, place = flat[at], np.concatenate([[0], np.cumsum(n)])
        out = []
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            alone = b - a == 1
            if spaced or (odd[b] > odd[a] and not alone) or (alone and odd_at[a]):
                out.append(self.text(texts[i].as_py() or ""))
            else:
                out.append(np.concatenate([np.array(self.one(values[int(chunk[a])].as_py()), np.int32), every[place[a] : place[b]]]))
        return out, chunk, offsets, values


class Corpus:
    """What all documents say of terms: documents, mean terms, mean bytes, for each hash value the documents that hold it, and the topics."""

    def __init__(self, documents: int, terms: int, size: int, cells: np.ndarray, topics: np.ndarray | None = None, often: np.ndarray | None = None):
        """topics: hashes in rising order; often: the documents that hold each."""
        self.documents, self.mean, self.size = documents, terms / max(1, documents), size / max(1, documents)
        self._packed = planes(cells.astype("<u8"))  # travels packed, is read once a worker
        self._cells: np.ndarray | None = None
        self.topics = np.empty(0, U64) if topics is None else topics
        self.often = np.empty(0) if often is None else often.astype(np.float64)

    def __getstate__(self):
        return self.__dict__ | {"_cells": None}

    def frequency(self, hashes: np.ndarray) -> np.ndarray:
        if self._cells is None:
            self._cells = unplaned(self._packed, 8).astype(np.float64)
        return self._cells[_cell(hashes)]


_COUNTS = "task long, part long, documents long, terms long, size long, cells binary, hashes binary, often binary"


def _rows(task: int, sums: tuple[int, int, int], cells: np.ndarray, hashes: np.ndarray, often: np.ndarray) -> pa.RecordBatch:
    """A task's counts by part: cells and exactly counted terms by the leading bits of their hashes; the sums stand in the first part alone."""
    cut = np.searchsorted(hashes, np.arange(1, _PARTS, dtype=U64) << U64(64 - _PARTS.bit_length() + 1))
    columns = [[task] * _PARTS, list(range(_PARTS)), *([x, *[0] * (_PARTS - 1)] for x in sums), *([planes(x) for x in parts] for parts in (np.split(cells, _PARTS), np.split(hashes, cut), np.split(often, cut)))]
    kinds = [*[pa.int64()] * 5, *[pa.binary()] * 3]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [c.split()[0] for c in _COUNTS.split(", ")])


def _added(hashes: list[np.ndarray], often: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of equal hashes as one, in the order of the hashes."""
    every, at = np.unique(np.concatenate([np.empty(0, U64), *hashes]), return_inverse=True)
    return every, np.bincount(at, np.concatenate([np.empty(0), *often]), len(every)).astype("<u8")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cells, sums, task = np.zeros(CELLS, "<u8"), np.zeros(3, np.int64), TaskContext.get().partitionId()
    hashes, often, held = [], [], 0
    for batch in slices(batches, "text"):
        texts = batch.column("text")
        chunk, values, offsets = chunks_of(texts)
        width = max(1, len(values))
        pairs = np.unique(np.repeat(np.arange(len(texts)), np.diff(offsets)) * width + chunk) % width
        df, h = np.bincount(pairs, minlength=len(values)), term_hashes(values)
        np.add.at(cells, _cell(h), df.astype("<u8"))  # a slice has few of them
        exact = h % U64(SAMPLED) == 0
        hashes.append(h[exact])
        often.append(df[exact])
        held += int(exact.sum())
        if held > 1 << 19:
            h, n = _added(hashes, often)
            hashes, often, held = [h], [n], 0
        sums += (len(texts), len(chunk), texts.nbytes)
    if sums[0]:
        yield _rows(task, tuple(map(int, sums)), cells, *_added(hashes, often))


def _summed(table: pa.Table) -> pa.Table:
    cells = np.zeros(CELLS // _PARTS, "<u8")
    for b in table.column("cells").to_pylist():
        cells += unplaned(b, 8)
    hashes, often = _added(*([unplaned(b, 8) for b in table.column(c).to_pylist()] for c in ("hashes", "often")))
    row = [[table.column("task")[0].as_py()], [table.column("part")[0].as_py()], *([pc.sum(table.column(c)).as_py()] for c in ("documents", "terms", "size"))]
    return pa.table([*(pa.array(x, pa.int64()) for x in row), *(pa.array([planes(x)], pa.binary()) for x in (cells, hashes, often))], names=table.column_names)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for h, n in zip(batch.column("hashes").to_pylist(), batch.column("often").to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(unplaned(x, 8).astype(np.uint64).view(np.int64)) for x in (h, n)], ["hash", "often"])


def corpus(df: DataFrame, shard_bytes: int = SHARD_BYTES) -> Corpus:
    """Counts over all documents of df (text).  Summed in two steps by parts; what reaches the driver is `CELLS` counts and `TOPICS` topics, whatever the input."""
    rows = df.select("text").mapInArrow(trimmed(_counts), _COUNTS)
    first = rows.withColumn("task", F.floor(F.col("task") / 64)).groupBy("task", "part").applyInArrow(trimmed_group(_summed), _COUNTS)
    found = written(first.groupBy("part").applyInArrow(trimmed_group(_summed), _COUNTS))
    parts = found.select("part", "documents", "terms", "size", "cells").orderBy("part").collect()
    cells = np.concatenate([unplaned(bytes(r["cells"]), 8) for r in parts]) if parts else np.zeros(CELLS, "<u8")
    documents, terms, size = (sum(r[c] for r in parts) for c in ("documents", "terms", "size"))
    aim = max(1.0, shard_bytes * documents / max(1, size) / 4, 4 * documents / TOPICS)
    near = found.select("hashes", "often").mapInArrow(trimmed(_unpacked), "hash long, often long").where("often > 1")
    chosen = near.orderBy(F.abs(F.log2(F.col("often") / F.lit(aim))), "hash").limit(TOPICS).collect()
    chosen = sorted((r["hash"] & 0xFFFFFFFFFFFFFFFF, r["often"]) for r in chosen)
    return Corpus(documents, terms, size, cells, np.array([h for h, _ in chosen], U64), np.array([n for _, n in chosen], np.float64))


_NO_TOPIC = np.uint64(0xFFFFFFFFFFFFFFFF)


def topics(texts: pa.Array, about: Corpus, aim: float, depth: int = 3) -> list[np.ndarray]:
    """Each text's nearest topics by falling fit: hashes of those whose frequency is nearest to `aim`, ties to the smaller hash; all ones where there is none."""
    chunk, values, offsets = chunks_of(texts)
    if not len(texts):
        return [np.empty(0, U64)] * depth
    hashes = term_hashes(values)
    rank = np.full(len(hashes), _NO_TOPIC)
    if len(about.topics):
        at = np.minimum(np.searchsorted(about.topics, hashes), len(about.topics) - 1)
        known = about.topics[at] == hashes
        far = np.minimum(np.abs(np.log2(about.often[at] / aim)) * 1024, 65_534).astype(U64)
        rank[known] = (far << U64(48) | hashes >> U64(16))[known]
    rank, begin, size, out = rank[chunk], offsets[:-1], np.diff(offsets), []
    for _ in range(depth):
        best = np.minimum.reduceat(rank, begin)
        out.append(np.where(best == _NO_TOPIC, best, mix(best)))
        rank = np.where(rank == np.repeat(best, size), _NO_TOPIC, rank)
    return out


class Index:
    """BM25 weights of a shard's terms: postings, or a row over all documents where a term is in more than an eighth of them.

    `often`: the documents of the corpus that hold each chunk; without it and `about` the shard is the corpus.
    """

    def __init__(self, chunk: np.ndarray, offsets: np.ndarray, about: Corpus | None = None, often: np.ndarray | None = None):
        n = len(offsets) - 1
        words = np.diff(offsets)
        width = int(chunk.max()) + 1 if len(chunk) else 1
        pairs, tf = np.unique(np.repeat(np.arange(n), words) * width + chunk, return_counts=True)
        doc, term = np.divmod(pairs, width)
        df = np.bincount(term, minlength=width)
        keep = df[term] > 1
        doc, term, tf = doc[keep], term[keep], tf[keep]
        every, often, mean = (about.documents, np.maximum(often, df), about.mean) if about else (n, df, words.mean())
        idf = np.log1p((np.maximum(every - often, 0) + 0.5) / (often + 0.5))
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * words[doc] / max(mean, 1e-9)))
        self.n, self.terms = n, term
        self.of_doc = np.searchsorted(doc, np.arange(n + 1))
        wide = df > max(8, n // 8)
        self.row = np.where(wide, np.cumsum(wide) - 1, -1)
        full = wide[term]
        self.rows = np.zeros((int(wide.sum()), n))
        self.rows[self.row[term[full]], doc[full]] = weight[full]
        doc, term, weight = doc[~full], term[~full], weight[~full]
        order = np.argsort(term, kind="stable")
        self.docs, self.weights = doc[order], weight[order]
        size = np.bincount(term, minlength=width)
        self.begin, self.size = np.cumsum(size) - size, size

    def scores(self, doc: int, unused: np.ndarray) -> np.ndarray:
        """Of each document the score with doc's terms, 0 for those that are used or share none."""
        terms = self.terms[self.of_doc[doc] : self.of_doc[doc + 1]]
        n = self.size[terms]
        at = np.repeat(self.begin[terms] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        rows = self.row[terms]
        score = self.rows[rows[rows >= 0]].sum(axis=0) + np.bincount(self.docs[at], self.weights[at], self.n)
        score[~unused] = 0
        return score

    def ask(self, doc: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share a term with doc, best first."""
        return _falling(self.scores(doc, unused))

    def near(self, doc: int, unused: np.ndarray, first: int = 32) -> Iterator[int]:
        """The same one by one; the `first` are put in order without the others, which are seldom asked for."""
        score = self.scores(doc, unused)
        if np.count_nonzero(score) > first:
            top = score >= np.partition(score, len(score) - first)[len(score) - first]
            yield from _falling(np.where(top, score, 0)).tolist()
            score[top] = 0
        yield from _falling(score).tolist()


def _falling(score: np.ndarray) -> np.ndarray:
    found = np.flatnonzero(score)
    return found[np.argsort(-score[found], kind="stable")]


def fill(tokens: np.ndarray, index: Index, length: int = LENGTH) -> list[list[tuple[int, int, int]]]:
    """Windows of (document, start, length) pieces; all but the last are full, and what would be short is cut into powers of two."""
    n = len(tokens)
    unused = np.ones(n, bool)
    windows, now, room = [], [], length
    following, seed, near = 0, -1, None
    doc, start = -1, 0
    while True:
        if doc < 0:
            if seed >= 0 and near is None:
                near = index.near(seed, unused)
            doc = next((d for d in near if unused[d]), -1) if near is not None else -1
            if doc < 0:
                while following < n and not unused[following]:
                    following += 1
                if following == n:
                    break
                doc = following
            unused[doc], start = False, 0
        if seed < 0:
            seed, near = doc, None
        take = min(room, int(tokens[doc]) - start)
        now.append((doc, start, take))
        start, room = start + take, room - take
        if start == tokens[doc]:
            doc = -1
        if not room:
            windows.append(now)
            now, room, seed, near = [], length, -1, None
    while now:
        left = sum(p[2] for p in now)
        size, part = 1 << (left.bit_length() - 1), []
        while size:
            d, s, k = now.pop(0)
            if k > size:
                now.insert(0, (d, s + size, k - size))
                k = size
            part.append((d, s, k))
            size -= k
        windows.append(part)
    return windows


def _keyed(batches: Iterator[pa.RecordBatch], about: Corpus, aim: float) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of a task's rows with their keys: topics by fit, then a number that differs for every row; 32 bytes that sort as they read."""
    row = TaskContext.get().partitionId() << 40
    for batch in slices(batches, "text"):
        tie = mix(np.arange(row, row + batch.num_rows).astype(U64))
        row += batch.num_rows
        yield batch, np.stack([*topics(batch.column("text"), about, aim), tie], 1).astype(">u8")


def grouped(df: DataFrame, about: Corpus, shard_bytes: int) -> DataFrame:
    """df (doc_id, text), dealt to ranges and sorted by topics."""
    aim = max(1.0, shard_bytes / max(1.0, about.size) / 4, 4 * about.documents / TOPICS)
    parts = spread(df, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def sampled(batches):
        for batch, keys in _keyed(batches, about, aim):
            sizes = pc.binary_length(batch.column("text")).fill_null(0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([k.tobytes() for k in keys], pa.binary()), sizes], ["key", "size"])

    share = min(1.0, min(_BOUNDS * parts, _MOST_BOUNDS) / max(1, about.documents))
    some = df.sample(False, share, 17) if share < 1 else df
    seen = sorted((bytes(r["key"]), r["size"] + 16) for r in some.mapInArrow(trimmed(sampled), "key binary, size long").collect())  # at most about _MOST_BOUNDS rows of 40 bytes
    total = np.cumsum([n for _, n in seen]) if seen else np.zeros(0)
    cut = np.searchsorted(total, np.arange(1, parts) * (total[-1] / parts)) if seen else np.zeros(0, np.int64)
    bounds = np.array(sorted({seen[min(int(i), len(seen) - 1)][0].ljust(32, b"\0") for i in cut}), "S32")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, keys in _keyed(batches, about, aim):
            whole = np.ascontiguousarray(keys).view("S32").ravel()
            place = np.searchsorted(bounds, whole, side="right").astype(np.int32) if len(bounds) else np.zeros(len(whole), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array([k.tobytes() for k in keys], pa.binary()), *batch.columns], ["_range", "_key", *batch.schema.names])

    more = [StructField("_range", IntegerType()), StructField("_key", BinaryType())]
    dealt = df.mapInArrow(trimmed(run), StructType([*more, *df.schema.fields])).repartitionById(parts, "_range")
    return dealt.sortWithinPartitions("_key").select(*df.columns)


_SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(df: DataFrame, path: str, ranks: str, source: str, length: int = LENGTH, shard_bytes: int = SHARD_BYTES, with_ids: bool = True) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids (little-endian unsigned 32-bit)."""
    base = stable(need(df, "doc_id", "text"))
    about = corpus(base, shard_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(path, ranks, source)
        first = TaskContext.get().partitionId() << 40
        held, size = [], 0

        def close():
            nonlocal first
            table = pa.Table.from_batches(held).combine_chunks()
            texts = table.column("text").chunk(0)
            ids, chunk, offsets, terms = coder.shard(texts)
            ids = [np.append(x, 0).astype("<u4") for x in ids]
            tokens = np.array([len(x) for x in ids], np.int64)
            windows = fill(tokens, Index(chunk, offsets, about, about.frequency(term_hashes(terms))), length)
            rows, at, crc, sequence, data = [], [], [], [], []
            for w in windows:
                offset = 0
                for d, s, k in w:
                    b = ids[d][s : s + k].tobytes()
                    rows.append((d, s, k))
                    crc.append(zlib.crc32(b))
                    at.append(offset)
                    sequence.append(first)
                    offset += k
                    if with_ids:
                        data.append(b)
                first += 1
            r = np.array(rows, np.int64).reshape(-1, 3)
            columns = [table.column("doc_id").chunk(0).take(pa.array(r[:, 0])), *(pa.array(x, pa.int64()) for x in (r[:, 1], r[:, 2], crc, tokens[r[:, 0]], sequence, at))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns, names = [*columns, pa.array(data, pa.binary())], [*names, "ids"]
            out = pa.RecordBatch.from_arrays(columns, names)
            for k in range(0, out.num_rows, 4096):
                yield out.slice(k, 4096)

        for batch in slices(batches, "text"):
            held.append(pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in batch.columns], schema=batch.schema))
            size += batch.nbytes
            if size >= shard_bytes:
                yield from close()
                held, size = [], 0
        if held:
            yield from close()

    kind = base.schema["doc_id"].dataType.simpleString()
    return grouped(base, about, shard_bytes).mapInArrow(trimmed(run), f"doc_id {kind}, {_SCHEMA}" + ", ids binary" * with_ids)


def digest(df: DataFrame, path: str, ranks: str, source: str) -> DataFrame:
    return pack(df, path, ranks, source, with_ids=False)
