"""Byte-level BPE by a global distinct-word shuffle.

Texts are cut at the public pattern's matches.  Within a block of documents the pre-tokens become local
numbers in order (the positions); only a block's distinct words are shuffled.  Each word is
encoded once in the whole corpus, by the task its hash leads to, and its ids go back to the blocks
that hold it.  There they meet the blocks' positions and the documents are
put together.  A frequent word has one row a block, not one an occurrence.  Decoding joins ids with
the token-byte table, whose size the vocabulary bounds.

Blocks are formed from scan batches, and both passes over the input form them again; a block's name is a
hash of its contents, so blocks that do not come out alike find no partner and the job fails instead
of returning wrong ids.  An input that is more than files under projections and filters is first written once.

Defined results: null text is an empty text, with no ids; rows with equal ids or texts are encoded one by one;
a text that starts or ends with white space, or has runs of it, takes the plain path over the whole text;
an empty table gives an empty table; only doc_id and text are read.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import U64, blocks, grown, mix, need, plan_bytes, planes, powers, slices, squeezed, stable, trimmed, trimmed_group, unplaned, unsqueezed

#: White space as the vocabularies' pattern means it (Unicode White_Space), in place of a library's own \s.
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


@functools.cache
def pattern(source: str) -> regex.Pattern:
    inside = source.replace(r"[^\s", "[^" + _WS).replace(r"(?!\S)", f"(?![^{_WS}])").replace(r"\s", f"[{_WS}]")
    return regex.compile(inside)


@functools.cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.cache
def encoder(path: str, source: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=source, mergeable_ranks=ranks(path), special_tokens={})


@functools.cache
def token_bytes(path: str) -> list[bytes]:
    """The token-byte table by id; ids without a token have no bytes."""
    table = ranks(path)
    out = [b""] * (max(table.values()) + 1)
    for token, i in table.items():
        out[i] = token
    return out


def chunks_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Texts cut at single spaces: chunk numbers in order, the distinct chunks, and the chunk offsets of texts."""
    split = pc.split_pattern(texts.fill_null("").cast(pa.large_string()), " ")
    offsets = np.asarray(split.offsets)
    coded = split.flatten().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, offsets - offsets[0]


def bytes_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of strings, and the places where they begin and the last ends."""
    at = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1] if len(strings) else np.zeros(1, np.int64)
    data = strings.buffers()[2] if len(strings) else None
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.empty(0, np.uint8), at - at[0]


def term_hashes(terms: pa.Array) -> np.ndarray:
    """A 64-bit hash of each term, by array arithmetic; good for counting and dealing, not for telling terms apart."""
    data, at = bytes_of(terms)
    size = np.diff(at)
    weighted = mix(data.astype(U64) + U64(1)) * powers(np.arange(len(data)) - np.repeat(at[:-1], size))
    total = np.concatenate([np.zeros(1, U64), np.cumsum(weighted)])
    return mix(total[at[1:]] - total[at[:-1]] + size.astype(U64) * U64(0x9E3779B97F4A7C15))


#: First bytes of white space in UTF-8, and the last but one of what has several bytes.
_SPACE_FIRST, _SPACE_BEFORE_LAST = np.zeros(256, bool), np.zeros(256, bool)
for _c in filter(str.isspace, map(chr, range(0x3100))):
    _SPACE_FIRST[_c.encode()[0]] = True
    if len(_c.encode()) > 1:
        _SPACE_BEFORE_LAST[_c.encode()[-2]] = True


def edges(chunks: pa.Array) -> np.ndarray:
    """Chunks that are empty, or start or end with white space."""
    data, at = bytes_of(chunks)
    edge = np.diff(at) == 0
    some = np.flatnonzero(~edge)
    first, last, before = data[at[:-1][some]], data[at[1:][some] - 1], data[np.maximum(at[1:][some] - 2, 0)]
    # only what begins or ends with bytes that white space may have there is looked at one by one
    for i in some[_SPACE_FIRST[first] | (last < 0x21) | (last > 0x7E) & _SPACE_BEFORE_LAST[before]].tolist():
        v = chunks[i].as_py()
        edge[i] = v[0].isspace() or v[-1].isspace()
    return edge


def joined(chunks: pa.Array) -> str:
    """Chunks in a row, each with a space before it."""
    return " " + pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(chunks)], pa.int32()), chunks), pa.scalar(" ", pa.large_string()))[0].as_py()


def per_chunk(chunks: pa.Array, sizes: np.ndarray) -> np.ndarray:
    """How many of the pieces of `joined` chunks, whose bytes are `sizes`, make up each chunk."""
    end, border = np.cumsum(sizes), np.cumsum(np.diff(bytes_of(chunks)[1]) + 1)
    stop = np.searchsorted(end, border)
    if (end[stop] != border).any():
        raise RuntimeError("a piece runs over a space between chunks: the pattern does not cut there")
    return np.diff(stop + 1, prepend=0)


class Block:
    """Distinct words of a batch (`words`) and each document's words as numbers among them (`docs`).

    A chunk between two single spaces stands alone if it neither starts nor ends with white space, so distinct chunks are cut once, all in one text.
    A text's first chunk has no space before it and is cut by itself; a text with other white space is cut as a whole.
    """

    def __init__(self, texts: pa.Array, pat: regex.Pattern):
        find = pat.findall
        chunk, values, offsets = chunks_of(texts)
        edge = edges(values)
        good = values.filter(pa.array(~edge))
        pieces = find(joined(good)) if len(good) else []
        count = np.zeros(len(values), np.int64)
        if pieces:
            count[~edge] = per_chunk(good, np.diff(bytes_of(pa.array(pieces, pa.large_string()))[1]))
        begin = np.cumsum(count) - count
        odd_at = edge[chunk]
        odd = np.concatenate([[0], np.cumsum(odd_at)])
        n = count[chunk]
        n[offsets[:-1]] = 0
        at = np.repeat(begin[chunk] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        place = np.concatenate([[0], np.cumsum(n)])
        own, parts = len(pieces), []
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            whole = odd[b] > odd[a] and b - a > 1
            more = find((texts[i].as_py() or "") if whole else values[int(chunk[a])].as_py())
            pieces += more
            head = np.arange(own, own + len(more))
            own += len(more)
            parts.append(head if whole else np.concatenate([head, at[place[a] : place[b]]]))
        coded = pa.array(pieces, pa.large_string()).dictionary_encode()
        number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.words: pa.Array = coded.dictionary
        self.docs = [number[p] for p in parts]


def _ordered(words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """A block's words by hash, their hashes, and each word's rank in that order; both passes find the same."""
    hashes = term_hashes(words)
    order = np.argsort(hashes, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return words.take(pa.array(order)), hashes[order], rank


_BLOCK_BYTES = 8 << 20


def _words(source: str, bits: int, most: int):
    """(bucket, block, sizes, data): a block's distinct words dealt by the leading bits of their hashes, packed."""

    def run(batches):
        pat = pattern(source)
        for name, table in blocks(batches, most=most):
            words, hashes, _ = _ordered(Block(table.column("text").chunk(0), pat).words)
            offsets = np.frombuffer(words.buffers()[1], np.int64)[: len(words) + 1] if len(words) else np.zeros(1, np.int64)
            data = words.buffers()[2].to_pybytes() if len(words) else b""
            bucket = (hashes >> U64(64 - bits)).astype(np.int64)
            cut = np.flatnonzero(np.diff(bucket, prepend=-1))
            rows = [(int(bucket[a]), name, planes(np.diff(offsets[a : b + 1]).astype("<u4")), squeezed(data[offsets[a] : offsets[b]])) for a, b in zip(cut, [*cut[1:], len(words)], strict=True)]
            for k in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 64], strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["bucket", "block", "sizes", "data"])

    return run


def _positions(source: str, most: int):
    """(block, doc_id, seq): each document's words as ranks among the block's words."""

    def run(batches):
        pat = pattern(source)
        for name, table in blocks(batches, most=most):
            block = Block(table.column("text").chunk(0), pat)
            rank = _ordered(block.words)[2]
            seq = [planes(rank[d].astype("<u4")) for d in block.docs]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seq), name)), table.column("doc_id").chunk(0), pa.array(seq, pa.binary())], ["block", "doc_id", "seq"])

    return run


def _encode(path: str, source: str):
    """Of a bucket: each distinct word is encoded once; each block gets its words' ids in the order it sent them."""

    def run(table: pa.Table) -> pa.Table:
        one, known = encoder(path, source)._core_bpe.encode_single_piece, ranks(path)
        sizes = [unplaned(b, 4).astype(np.int64) for b in table.column("sizes").to_pylist()]
        data = b"".join(map(unsqueezed, table.column("data").to_pylist()))
        size = np.concatenate(sizes)
        offsets = np.concatenate([[0], np.cumsum(size)])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)]).dictionary_encode()
        at = words.indices.to_numpy()
        ids = [(known[w],) if w in known else one(w) for w in words.dictionary.to_pylist()]
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(count.sum()))
        begin = np.cumsum(count) - count
        counts, packed, pos = [], [], 0
        for s in sizes:
            here = at[pos : pos + len(s)]
            pos += len(s)
            n = count[here]
            gather = np.repeat(begin[here] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            counts.append(planes(n.astype("<u4")))
            packed.append(planes(flat[gather].astype("<u4")))
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "counts": pa.array(counts, pa.binary()), "ids": pa.array(packed, pa.binary())})

    return run


def _assemble(key, docs: pa.Table, words: pa.Table) -> pa.Table:
    """Ranks and word ids of a block to its documents' ids (little-endian unsigned 32-bit)."""
    sequences = [unplaned(b, 4) for b in docs.column("seq").to_pylist()]
    if not docs.num_rows or not words.num_rows and any(map(len, sequences)):
        raise RuntimeError("a block has no partner in the other pass: the input is not stable")
    seen = {}
    for b, c, i in sorted(zip(*(words.column(c).to_pylist() for c in ("bucket", "counts", "ids")), strict=True)):
        seen.setdefault(b, (unplaned(c, 4).astype(np.int64), unplaned(i, 4)))  # equal blocks are answered alike
    count = np.concatenate([np.empty(0, np.int64), *(v[0] for v in seen.values())])
    flat = np.concatenate([np.empty(0, np.uint32), *(v[1] for v in seen.values())])
    begin = np.cumsum(count) - count
    out = []
    for s in sequences:
        n = count[s]
        gather = np.repeat(begin[s] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        out.append(flat[gather].astype("<u4").tobytes())
    return pa.table({"doc_id": docs.column("doc_id"), "ids": pa.array(out, pa.binary())})


def encode(df: DataFrame, path: str, source: str) -> DataFrame:
    """(doc_id, ids): ids as little-endian unsigned 32-bit integers, one row a row of df."""
    base = stable(need(df, "doc_id", "text"))
    bits = max(4, (plan_bytes(base) // (4 << 20)).bit_length())
    most = grown(_BLOCK_BYTES, bits)
    words = base.mapInArrow(trimmed(_words(source, bits, most)), "bucket long, block long, sizes binary, data binary")
    coded = words.groupBy("bucket").applyInArrow(trimmed_group(_encode(path, source)), "block long, bucket long, counts binary, ids binary")
    kind = base.schema["doc_id"].dataType.simpleString()
    docs = base.mapInArrow(trimmed(_positions(source, most)), f"block long, doc_id {kind}, seq binary")
    return docs.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(trimmed_group(_assemble), f"doc_id {kind}, ids binary")


def decode(df: DataFrame, path: str) -> DataFrame:
    """df with the column `bytes`: ids joined with the token-byte table, in order."""

    def run(batches):
        table = np.array(token_bytes(path), object)
        for batch in slices(batches, "ids"):
            out = [b"".join(table[np.frombuffer(b, "<u4")].tolist()) if b else b"" for b in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "bytes"])

    return df.mapInArrow(trimmed(run), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", bytes binary")


def digest(df: DataFrame, path: str, source: str) -> DataFrame:
    out = decode(encode(df, path, source), path)
    return out.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
