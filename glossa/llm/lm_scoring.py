"""LM scoring: per-token cross-entropy difference of matched target and background bigram models.

Both models have the same order, smoothing and vocabulary: p(w | v) = (c(v w) + L) / (c(v) + L * V), V the distinct words of the whole
corpus and the end mark.  The background model counts all documents, the target model all those that are labelled good; background counts are scaled by the ratio of the two models' tokens, so that both weigh their smoothing alike and a pair neither has
seen tells nothing.  A document's own counts are taken out of both models before it is scored, so no document is scored by itself.

Counting: a block of documents first sums its own keys (63-bit hashes of words and of word pairs), so the most frequent word is one
entry a block.  Entries are dealt by the key's leading bits, summed over blocks, and the totals go back to
the blocks that asked, in the order of their keys.  There they meet the block's texts and score them.  All counts cover all documents.
Both passes must form the same blocks, so an input that is more than files under projections and filters is first written once.
Ids of good rows are sent to all tasks while they are few; more are joined by a shuffle, and the joined documents are written once.

Defined results: null or empty texts are scored on the end mark alone (n_tokens 1); repeated rows count and are scored one by one;
a missing label or a null id or quality is no target row; without target rows the target model is uniform; an empty table gives
an empty table; texts are used whole; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import U64, Words, blocks, grown, mix, need, plan_bytes, planes, stable, trimmed, trimmed_group, unplaned, written

LAMBDA = 0.05
#: So many ids of good rows are sent to all tasks; more are dealt with the documents.
FEW_IDS = 1 << 20
_START, _END = U64(0x5851F42D4C957F2D), U64(0x14057B7EF767814F)
#: Text of a block; counting and scoring hold some 40 times as much for a moment.
_BLOCK_BYTES = 2 << 20


def _keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all predicted tokens of a batch: the history's key, the pair's key, and the text they belong to."""
    words = Words(texts, lower=True)
    n = np.diff(words.doc) + 1
    doc = np.repeat(np.arange(len(n)), n)
    last = np.cumsum(n) - 1
    first = last - n + 1
    now = np.empty(int(n.sum()), U64)
    inner = np.ones(len(now), bool)
    inner[last] = False
    now[inner], now[last] = words.hash, _END
    before = np.empty_like(now)
    before[1:] = now[:-1]
    before[first] = _START
    one = mix(before + U64(11)) & ~U64(1)
    two = mix(before * U64(0x9E3779B97F4A7C15) + mix(now)) | U64(1)
    return one, two, doc  # the last bit tells histories from pairs


def _count(bits: int, most: int):
    def run(batches):
        for name, table in blocks(batches, most=most):
            one, two, doc = _keys(table.column("text").chunk(0))
            target = table.column("target").chunk(0).to_numpy(zero_copy_only=False).astype(bool)[doc]
            keys, at = np.unique(np.concatenate([one, two]), return_inverse=True)
            every = np.bincount(at, minlength=len(keys)).astype("<u4")
            good = np.bincount(at, np.concatenate([target, target]), len(keys)).astype("<u4")
            bucket = (keys >> U64(64 - bits)).astype(np.int64)
            cut = np.flatnonzero(np.diff(bucket, prepend=-1))
            rows = [(int(bucket[a]), name, planes(keys[a:b]), planes(every[a:b]), planes(good[a:b])) for a, b in zip(cut, [*cut[1:], len(keys)], strict=True)]
            for k in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 64], strict=True), (pa.int64(), pa.int64(), *[pa.binary()] * 3), strict=True)], ["bucket", "block", "keys", "every", "good"])

    return run


def _total(table: pa.Table) -> pa.Table:
    """Of a bucket: each block's keys with their corpus counts; the first row also has the bucket's distinct histories and the tokens of both models."""
    parts = [unplaned(b, 8) for b in table.column("keys").to_pylist()]
    keys, at = np.unique(np.concatenate(parts), return_inverse=True)
    every, good = (np.bincount(at, np.concatenate([unplaned(b, 4) for b in table.column(c).to_pylist()]), len(keys)).astype("<u8") for c in ("every", "good"))
    cut = np.cumsum([0, *map(len, parts)])
    history = keys & U64(1) == 0
    sums = int(history.sum()), int(every[history].sum()), int(good[history].sum())
    own = [at[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return pa.table({"bucket": table.column("bucket"), "block": table.column("block"), "every": pa.array([planes(every[x]) for x in own], pa.binary()), "good": pa.array([planes(good[x]) for x in own], pa.binary()), **{c: pa.array([v, *[0] * (len(own) - 1)], pa.int64()) for c, v in zip(("words", "tokens", "good_tokens"), sums, strict=True)}})


def _texts(most: int):
    def run(batches):
        for name, table in blocks(batches, most=most):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(table.num_rows, name)), *(c.chunk(0) for c in table.columns)], ["block", *table.schema.names])

    return run


def _score(vocabulary: int, smooth: float, ratio: float):
    def run(key, docs: pa.Table, totals: pa.Table) -> pa.Table:
        if not docs.num_rows or not totals.num_rows:
            raise RuntimeError("a block has no partner: the input is not stable")
        docs = docs.combine_chunks()
        seen, out = {}, []
        for b, e, g in sorted(zip(*(totals.column(c).to_pylist() for c in ("bucket", "every", "good")), strict=True), key=lambda r: r[0]):
            seen.setdefault(b, (e, g))  # equal blocks return equal totals
        one, two, doc = _keys(docs.column("text").chunk(0))
        n = docs.num_rows
        keys, at = np.unique(np.concatenate([one, two]), return_inverse=True)
        # a block that occurs twice stands here twice over; its keys are the same
        every, good = (np.concatenate([unplaned(v[k], 8) for v in seen.values()]).astype(np.float64) for k in (0, 1))
        if len(every) != len(keys):
            raise RuntimeError("a block changed between passes: the input is not stable")
        both = np.concatenate([doc, doc])
        cell, where, own = np.unique(both * len(keys) + at, return_inverse=True, return_counts=True)
        own = own[where].astype(np.float64)
        target = docs.column("target").chunk(0).to_numpy(zero_copy_only=False).astype(np.float64)[both]
        sign = np.repeat([-1.0, 1.0], len(doc))
        add = np.repeat([smooth * vocabulary, smooth], len(doc))
        scores = []
        for count, mine, scale in ((good[at], own * target, 1.0), (every[at], own, ratio)):
            scores.append(-np.bincount(both, sign * np.log(np.maximum(count - mine, 0) * scale + add), n))
        tokens = np.bincount(doc, minlength=n)
        t, b = (x / tokens for x in scores)
        return pa.table({"doc_id": docs.column("doc_id"), "n_tokens": pa.array(tokens, pa.int64()), "target_xent": t, "background_xent": b, "xent_diff": t - b})

    return run


def score(docs: DataFrame, labels: DataFrame, smooth: float = LAMBDA, few: int = FEW_IDS) -> DataFrame:
    """(doc_id, n_tokens, target_xent, background_xent, xent_diff) in nats a token; a lower xent_diff is closer to the target."""
    good = written(need(labels, "doc_id", "quality").where("quality = 1 and doc_id is not null").select("doc_id").distinct().withColumn("hit", F.lit(1)))
    sent = good.count() <= few
    docs = stable(need(docs, "doc_id", "text")) if sent else need(docs, "doc_id", "text")
    base = docs.join(F.broadcast(good) if sent else good.hint("merge"), "doc_id", "left").select("doc_id", "text", F.coalesce("hit", F.lit(0)).cast("int").alias("target"))
    base = base if sent else written(base)
    bits = max(4, (plan_bytes(docs if sent else base) * 4 // (16 << 20)).bit_length())
    most = grown(_BLOCK_BYTES, bits)
    counted = base.mapInArrow(trimmed(_count(bits, most)), "bucket long, block long, keys binary, every binary, good binary")
    totals = written(counted.groupBy("bucket").applyInArrow(trimmed_group(_total), "bucket long, block long, every binary, good binary, words long, tokens long, good_tokens long"))
    words, tokens, good_tokens = (int(x or 0) for x in totals.agg(F.sum("words"), F.sum("tokens"), F.sum("good_tokens")).first())
    vocabulary = max(1, words)  # the end mark stands in for the start mark
    ratio = good_tokens / max(1, tokens)
    kind = base.schema["doc_id"].dataType.simpleString()
    rows = base.mapInArrow(trimmed(_texts(most)), f"block long, doc_id {kind}, text string, target int")
    return rows.groupBy("block").cogroup(totals.select("bucket", "block", "every", "good").groupBy("block")).applyInArrow(trimmed_group(_score(vocabulary, smooth, ratio)), f"doc_id {kind}, n_tokens long, target_xent double, background_xent double, xent_diff double")
