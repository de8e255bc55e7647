"""MinHash near-dedup on bottom-k sketches from one hash function.

1. A document's set is its distinct word shingles as 64-bit hashes; equal sets form one class, whose smallest
   doc_id stands for it from here on, so thousands of copies are one row.
2. The k smallest hashes are the sketch.  Inverted lists are kept by runs of three neighbouring retained values: two sets
   at the threshold share such a run with a probability that falls as 0.63**k (0.85) or 0.70**k (0.80), and sets
   smaller than k always do, whereas a passage that unrelated texts share rarely fills a whole run.
3. Lists of up to `FEW` members generate overlaps: pairs with the number of runs they share.  A longer list gives each
   member one pair, with the list's smallest member, and is marked hot.
4. The union-sketch estimate drops pairs far below the threshold; exact Jaccard on the full sets decides.  First each class's best
   pair is decided; then only pairs whose ends are not yet connected.
5. A pair that meets in hot lists alone belongs to classes many of whose runs are hot.  Those classes form groups by the hot lists they
   share; in groups that are not yet one component, blocks of classes are compared with each other inside tasks, exactly and each
   pair of blocks once, and a task emits only stars over what links, at most one row a member.

So no list is expanded into all its pairs beyond the fixed `FEW`, each task's memory is bounded, and no link
between different texts is left out but by the chance given above.

Defined results: null or empty texts and texts without words have n_shingles 0, link with nothing and are kept;
repeated rows link as copies, and of rows equal in doc_id all stay or go together; a null doc_id links with nothing and is kept; pairs at the threshold
link; which of several equally good pairs is looked at first changes no class; very long texts are used whole; an empty table gives an empty table; further columns
are ignored by `classes` and passed through by `keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import U64, Words, components, mix, need, plan_bytes, rolling, slices, trimmed, trimmed_group, written

K = 64
RUN = 3
FEW = 64
_CELL, _CELL_VALUES = 512, 1 << 19  # members of a block in step 5, and their shingles, on average


def shingle_sets(words: Words, width: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes; a text with fewer words than a shingle has its word sequence as one."""
    every = rolling(words.hash, width)
    for a, b in zip(words.doc[:-1].tolist(), words.doc[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(every[a : b - width + 1])
        elif b > a:
            yield mix(rolling(words.hash[a:b], b - a) + U64(b - a))
        else:
            yield np.empty(0, U64)


def _sketch(width: int, k: int):
    def run(batches):
        for batch in slices(batches, "text"):
            n, key, sketch = [], [], []
            words = Words(batch.column("text"), lower=True)
            for i, s in enumerate(shingle_sets(words, width)):
                n.append(len(s))
                # a set of one shingle is known by its words themselves, so that short texts have 128 bits too
                a = int(words.doc[i])
                one = words.buf[words.start[a] : words.end[min(a + width, int(words.doc[i + 1])) - 1]].tobytes() if len(s) == 1 else None
                key.append(xxhash.xxh128_digest(s.tobytes() if one is None else b" ".join(one.split()), seed=len(s)))
                sketch.append(s[:k].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sketch, pa.binary())], ["doc_id", "n", "set_key", "sketch"])

    return run


def run_keys(sketch: np.ndarray) -> np.ndarray:
    """Keys of all runs of RUN neighbouring values; of shorter runs as well for small sets, where fewer values are common."""
    out = [rolling(sketch, RUN)] if len(sketch) >= RUN else []
    if len(sketch) <= 10:
        out += [rolling(sketch, 2), mix(sketch + U64(1))] if len(sketch) >= 2 else [mix(sketch + U64(1))]
    return np.concatenate(out)


def _lists(reps: DataFrame, parts_bits: int, few: int) -> DataFrame:
    """(bucket, keys, ids): run keys of sketches dealt by their leading bits, one row a task and bucket."""

    def run(batches):
        keys, ids, size = [], [], 0

        def flush():
            k, i = np.concatenate(keys), np.concatenate(ids)
            order = np.lexsort((i, k))
            k, i = k[order], i[order]
            # of a key with more than `few` members in this task, few + 1 go on: enough to mark it hot; the rest follow its smallest member
            begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            count = np.diff(np.append(begin, len(k)))
            rank = np.arange(len(k)) - np.repeat(begin, count)
            far = rank > few
            low = np.repeat(i[begin], count)
            bucket = (k >> U64(64 - parts_bits)).astype(np.int64)
            k2, i2, b2 = k[~far], i[~far], bucket[~far]
            cut = np.flatnonzero(np.diff(b2, prepend=-1))
            rows = [(int(b2[x]), k2[x:y].tobytes(), i2[x:y].tobytes(), b"") for x, y in zip(cut, [*cut[1:], len(k2)], strict=True)]
            if far.any():
                rows.append((-1, k[far].tobytes(), i[far].tobytes(), low[far].tobytes()))
            for x in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[x : x + 64], strict=True), (pa.int64(), *[pa.binary()] * 3), strict=True)], ["bucket", "keys", "ids", "low"])

        for batch in batches:
            for i, s in zip(batch.column("id").to_pylist(), batch.column("sketch").to_pylist(), strict=True):
                k = np.unique(run_keys(np.frombuffer(s, U64)))
                keys.append(k)
                ids.append(np.full(len(k), i, np.int64))
                size += len(k)
            if size > 1 << 20:
                yield from flush()
                keys, ids, size = [], [], 0
        if size:
            yield from flush()

    return reps.select("id", "sketch").mapInArrow(trimmed(run), "bucket long, keys binary, ids binary, low binary")


def _pairs_of(few: int):
    def run(table: pa.Table) -> pa.Table:
        """Of a bucket: pairs (a < b) with the runs they share here; `hot` rows (a: the list's smallest member, b) with their key."""
        keys = np.concatenate([np.frombuffer(x, U64) for x in table.column("keys").to_pylist()])
        ids = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("ids").to_pylist()])
        lows = [np.frombuffer(x, np.int64) for x in table.column("low").to_pylist()]
        out_a, out_b, out_key = [], [], []
        if sum(map(len, lows)):  # what tasks kept back of hot lists
            low = np.concatenate(lows)
            out_a, out_b, out_key = [low], [ids], [keys.view(np.int64)]
            hot_from = 0
        else:
            order = np.lexsort((ids, keys))
            keys, ids = keys[order], ids[order]
            begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            count = np.diff(np.append(begin, len(keys)))
            small = (count > 1) & (count <= few)
            pa_, pb_ = [], []
            for step in range(1, int(count[small].max()) if small.any() else 1):  # pairs at distance `step` within all small lists at once
                use = small & (count > step)
                n = count[use] - step
                at = np.repeat(begin[use] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                pa_.append(ids[at])
                pb_.append(ids[at + step])
            hot_from = 0
            if pa_:
                a, b = np.concatenate(pa_), np.concatenate(pb_)
                order = np.lexsort((b, a))
                a, b = a[order], b[order]
                new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
                out_a, out_b, out_key = [a[new]], [b[new]], [np.diff(np.append(new, len(a))).astype(np.int64)]
                hot_from = len(new)
            for x, n in zip(begin[count > few].tolist(), count[count > few].tolist(), strict=True):
                out_a.append(np.full(n, ids[x]))
                out_b.append(ids[x : x + n])
                out_key.append(np.full(n, keys[x]).view(np.int64))
        a, b, k = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (out_a, out_b, out_key))
        hot = np.arange(len(a)) >= hot_from
        return pa.table({"a": a, "b": b, "c": k, "hot": hot})

    return run


def _estimate(threshold: float, k: int):
    """Keeps pairs whose union-sketch estimate is within six standard errors of the threshold, or whose sketches are whole sets at it."""

    def run(batches):
        for batch in batches:
            good = []
            for x, y, n, m in zip(*(batch.column(c).to_pylist() for c in ("sa", "sb", "na", "nb")), strict=True):
                whole = max(n, m) <= k
                good.append(min(n, m) >= threshold * max(n, m) - 1e-9 and sketch_overlap(np.frombuffer(x, U64), np.frombuffer(y, U64), k, whole) >= floor_of(threshold, k, whole))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def sketch_overlap(x: np.ndarray, y: np.ndarray, k: int, whole: bool) -> float:
    """Share of the union's k smallest values that both sets have; of the whole union where the sketches are whole sets."""
    both = np.concatenate([x, y])
    both.sort()
    same = np.append(both[1:] == both[:-1], False)
    first = np.append(True, ~same[:-1])  # of each value
    common = same[first] if whole else same[first][:k]
    return common.sum() / max(1, len(common))


def floor_of(threshold: float, k: int, whole: bool) -> float:
    return threshold - (1e-9 if whole else 6 * (threshold * (1 - threshold) / k) ** 0.5)


def _verify(width: int, percent: int):
    """Exact Jaccard of two texts' sets in integers: 100 * common >= percent * union."""

    def run(batches):
        for batch in slices(batches, "ta"):
            good = []
            one, two = batch.column("ta"), Words(batch.column("tb"), lower=True)
            a_sets = list(shingle_sets(Words(one, lower=True), width))
            for s, t in zip(a_sets, shingle_sets(two, width), strict=True):
                both = np.concatenate([s, t])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                good.append(common > 0 and 100 * common >= percent * (len(both) - common))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _confirmed(pairs: DataFrame, reps: DataFrame, docs: DataFrame, width: int, percent: int, k: int) -> DataFrame:
    """Of pairs (a, b) those that link: estimate, then exact check on whole texts."""
    s = reps.select("id", "n", "sketch")
    with_a = pairs.join(s.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
    with_b = with_a.join(s.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
    close = with_b.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(trimmed(_estimate(percent / 100, k)), "a long, b long")
    texts_a = close.join(docs.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    texts = texts_a.join(docs.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    return written(texts.mapInArrow(trimmed(_verify(width, percent)), "a long, b long"))


def _sets(width: int):
    def run(batches):
        for batch in slices(batches, "text"):
            sets = [x.tobytes() for x in shingle_sets(Words(batch.column("text"), lower=True), width)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], ["id", "members"])

    return run


def _cells(percent: int):
    """Of a cell (two blocks of a group, or one with itself): exact Jaccard of all its pairs by one sparse product; stars over what links."""

    def run(table: pa.Table) -> pa.Table:
        ids, comp = table.column("id").to_numpy(), table.column("comp").to_numpy()
        order = np.argsort(ids)
        ids, comp = ids[order], comp[order]
        sets = [np.frombuffer(b, U64) for b in table.column("members").to_pylist()]
        sets = [sets[i] for i in order.tolist()]
        n = np.array([len(x) for x in sets], np.float64)
        overlap = np.zeros((len(ids), len(ids)), np.float32)
        if len(set(comp.tolist())) > 1:
            _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            row = np.repeat(np.arange(len(sets)), n.astype(np.int64))
            use = count[column] > 1
            row, column = row[use], (np.cumsum(count > 1) - 1)[column[use]]
            for at in range(0, int(column.max()) + 1 if len(column) else 0, 4096):
                here = (column >= at) & (column < at + 4096)
                x = np.zeros((len(sets), 4096), np.float32)
                x[row[here], column[here] - at] = 1
                overlap += x @ x.T
        near = (overlap > 0) & (100 * overlap.astype(np.float64) >= percent * (n[:, None] + n[None, :] - overlap))
        root = np.arange(len(ids))
        while True:
            least = np.minimum(root, np.where(near, root[None, :], len(ids)).min(1, initial=len(ids)))
            if (least == root).all():
                break
            root = least
        far = root != np.arange(len(ids))
        return pa.table({"a": ids[root[far]], "b": ids[far]})

    return run


def classes(df: DataFrame, width: int = 5, percent: int = 80, k: int = K, few: int = FEW) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of df (doc_id long, text)."""
    docs = need(df, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sketched = written(docs.mapInArrow(trimmed(_sketch(width, k)), "doc_id long, n long, set_key binary, sketch binary"))
    reps = written(sketched.where("n > 0 and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("id"), F.max("n").alias("n"), F.min("sketch").alias("sketch")))
    bits = max(4, (plan_bytes(reps) * 2 // (8 << 20)).bit_length())
    # a class's number of run keys, as run_keys makes them
    keys_of = F.expr(f"case when n <= 10 then greatest(0, n - 2) + greatest(0, n - 1) + n else least(n, {k}) - 2 end")
    # dealt once by bucket; what tasks kept back of hot lists is spread by chance
    dealt = _lists(reps, bits, few).withColumn("salt", F.when(F.col("bucket") < 0, F.xxhash64("ids") % 1024).otherwise(F.lit(0)))
    found = written(dealt.groupBy("bucket", "salt").applyInArrow(trimmed_group(_pairs_of(few)), "a long, b long, c long, hot boolean"))
    hot = found.where("hot").select(F.col("c").alias("key"), F.col("a").alias("low"), F.col("b").alias("id"))
    hot_of = hot.groupBy("id").agg(F.count_distinct("key").alias("h"))
    star = hot.where("low <> id").select(F.col("low").alias("a"), F.col("id").alias("b")).distinct().withColumn("c", F.lit(1 << 20).cast("long"))
    shared = found.where("not hot").groupBy("a", "b").agg(F.sum("c").alias("c"))
    info = written(reps.select("id", "n", keys_of.alias("keys")).join(hot_of, "id", "left").select("id", "n", "keys", F.coalesce("h", F.lit(0)).alias("h")))
    pairs = (
        shared.union(star)
        .join(info.toDF("a", "na", "ka", "ha"), "a")
        .join(info.toDF("b", "nb", "kb", "hb"), "b")
        .where(f"100 * least(na, nb) >= {percent} * greatest(na, nb) and c + least(ha, hb) >= greatest(1, floor(least(ka, kb) / 12))")
        .select("a", "b", "c")
    )
    pairs = written(pairs)
    best = pairs.where(f"c < {1 << 20}").groupBy("b").agg(F.max_by("a", "c").alias("a")).select("a", "b").union(pairs.where(f"c >= {1 << 20}").select("a", "b"))
    links = _confirmed(best, reps, docs, width, percent, k)
    first = components(links, parts)

    def with_component(x: DataFrame, at: str, name: str) -> DataFrame:
        return x.join(first.toDF(at, name), at, "left").withColumn(name, F.coalesce(name, at))

    rest = with_component(with_component(pairs, "a", "ca"), "b", "cb").where("ca <> cb").select("a", "b")
    second = _confirmed(rest, reps, docs, width, percent, k)
    if not hot.isEmpty():
        # classes most of whose runs are hot: groups that share hot lists, each pair of blocks compared once
        dense = info.where("h >= greatest(1, floor(keys / 12))").select("id", "n")
        ends = star.select("a", "b").join(dense.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b")
        group = components(ends, parts).withColumnRenamed("component_id", "group")
        members = with_component(group.join(dense, "id"), "id", "comp")
        many = members.groupBy("group").agg(F.greatest(F.count("*") / F.lit(_CELL), F.sum("n") / F.lit(_CELL_VALUES)).alias("m"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("group", F.ceil("m").cast("int").alias("blocks"))
        chosen = members.join(many, "group")
        sets = docs.join(chosen.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").mapInArrow(trimmed(_sets(width)), "id long, members binary").groupBy("id").agg(F.min("members").alias("members"))
        cells = (
            chosen.join(sets, "id")
            .withColumn("i", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
            .withColumn("j", F.explode(F.expr("sequence(0, blocks - 1)")))
            .select("group", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"), "id", "comp", "members")
        )
        late = cells.groupBy("group", "x", "y").applyInArrow(trimmed_group(_cells(percent)), "a long, b long")
        second = second.union(late)
    every = second.union(first.where("id <> component_id").select(F.col("component_id").alias("a"), F.col("id").alias("b")))
    final = components(every, parts)
    of_class = reps.select("set_key", "id").join(final, "id", "left").select("set_key", F.coalesce("component_id", "id").alias("root"))
    out = sketched.select("doc_id", "n", "set_key").join(of_class, "set_key", "left")
    root = F.when(F.col("n") > 0, F.coalesce("root", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), root.alias("component_id"), F.coalesce(root == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(df: DataFrame, width: int = 5, percent: int = 80, k: int = K) -> DataFrame:
    """The rows of df whose document is kept: one document of each group, and all that link with nothing.  Rows equal in doc_id stay together."""
    kept = classes(df, width, percent, k).where("kept").select(F.col("doc_id").alias("_id")).distinct()
    names = df.columns
    inner = df.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), F.col("doc_id").cast("long").alias("_id"))
    return inner.join(kept, inner["_id"].eqNullSafe(kept["_id"]), "left_semi").select(*(F.col(f"_row.`{c}`").alias(c) for c in names))
