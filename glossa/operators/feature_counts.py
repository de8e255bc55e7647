"""Counts of feature templates (features.TEMPLATES) without a row a feature: tables of distinct windows, packed, dealt by hash, spelled out last.

A block of sentences becomes one array of word codes with padding between sentences.  Templates that look at the same columns at the same
places share a key (so do neighbours seen from either side: `c.tok p.tok` and `c.tok n.tok` are one pair), and a block's distinct keys are
counted by sorting integers.  One row goes to each bucket of hashes for a block: its keys, sorted, as strings with their counts under zstd.
A bucket's rows are added up and only then written as features, so nothing else is shuffled.
"""

from __future__ import annotations

import contextlib
import ctypes
import math
import pickle
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.operators.features import _REFERENCE, WORDS, templates

#: Tokens of a block, and bytes of input a bucket.
BLOCK, BUCKET = 1 << 21, 4 << 20
_CODEC = pa.Codec("zstd", 3)
_U64 = np.uint64

Piece = str | int  # text, or a place in the key
Key = tuple[tuple[str, int], ...]


def _keys(groups: tuple[str, ...]) -> dict[Key, list[tuple[int | None, list[Piece]]]]:
    """Keys (column, place) with their templates: the place in the key that must be a token (None: the key's middle is one anyway), and the pieces."""
    out, endings = defaultdict(list), set()
    for _, clique, pieces in templates(*groups):
        if (ending := (pieces[-1], clique)) in endings:
            raise ValueError(f"two templates end in {ending}: a token may have one feature by both")
        endings.add(ending)
        refs = [(m[3], {"c": 0, "p": -1, "n": 1}[m[1]] * int(m[2] or 1)) if (m := _REFERENCE.match(p)) else p for p in pieces]
        key = tuple(sorted({r for r in refs if isinstance(r, tuple)}, key=lambda r: (r[1], r[0])))
        made = [key.index(r) if isinstance(r, tuple) else r for r in refs] + [f"|{clique}"]
        if ("tok", 0) in key and all(c == "tok" for c, _ in key):
            center, first = key.index(("tok", 0)), key[0][1]
            out[tuple((c, k - first) for c, k in key)].append((center, made))
        else:
            out[key].append((None, made))
    return dict(out)


def _trim() -> None:
    """Gives memory that a Python worker no longer uses back to the system: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max())) if len(x) else np.uint8)


def _hashes(strings: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(s.encode()) for s in strings), _U64, len(strings))


def _packed(strings: pa.Array, codes: np.ndarray) -> tuple:
    """Strings of `codes`, each run of one once: run lengths, byte lengths, bytes."""
    begin = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    runs = np.diff(np.append(begin, len(codes)))
    part = strings.take(pa.array(codes[begin]))
    offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
    data = part.buffers()[2]
    return _narrow(runs), _narrow(np.diff(offsets)), data.to_pybytes()[offsets[0] : offsets[-1]] if data else b""


def _unpacked(runs: np.ndarray, sizes: np.ndarray, data: bytes) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    part = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(data))
    return part if len(runs) == runs.sum() else part.take(pa.array(np.repeat(np.arange(len(runs)), runs)))


def _dealt(held: list[pa.Array], keys: list[Key], centers: list[list[int]], derived: dict[str, Callable[[str], str]], buckets: int) -> Iterator[pa.RecordBatch]:
    """A block's sentences (arrays of tokens) as rows (bucket, keys)."""
    sizes = np.concatenate([pc.list_value_length(a).fill_null(0).to_numpy(zero_copy_only=False) for a in held]).astype(np.int64)
    words = pa.concat_arrays([a.flatten().cast(pa.large_string()) for a in held]).dictionary_encode()
    if not len(words):
        return
    order = pc.array_sort_indices(words.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    far = max((abs(k) for key in keys for _, k in key), default=0) + 1
    at = np.arange(len(words)) + far * (np.repeat(np.arange(len(sizes)), sizes) + 1)
    tok = np.zeros(len(words) + far * (len(sizes) + 1), np.int64)
    tok[at] = rank[words.indices.to_numpy()]
    spelled = ["", *words.dictionary.take(pa.array(order)).to_pylist()]
    values, columns = {"tok": spelled}, {"tok": tok}
    for name, f in derived.items():
        forms = ["" if name in WORDS else "null", *map(f, spelled[1:])]
        number = {v: i for i, v in enumerate(sorted(set(forms)))}
        values[name], columns[name] = list(number), np.array([number[v] for v in forms])[tok]
    used = {c for key in keys for c, _ in key}
    strings, hashes = {c: pa.array(values[c], pa.large_string()) for c in used}, {c: _hashes(values[c]) for c in used}
    rows: dict[int, list] = defaultdict(list)
    for number, key in enumerate(keys):
        begin = at
        if centers[number]:
            real = np.zeros(len(tok), bool)
            for c in centers[number]:
                real[at - key[c][1]] = True
            begin = np.flatnonzero(real)
        if not key:
            rows[0].append((number, [], np.array([len(begin)])))
            continue
        code, past = np.zeros(len(begin), np.int64), []
        for c, k in key:  # codes of all places in one integer; where it would grow too large, numbered anew
            span = len(values[c])
            top = math.prod(s for s in past) if past else 1
            if top * span >= 1 << 62:
                raise OverflowError("a key of too many forms")
            past.append(span)
            code = code * span + columns[c][begin + k]
        code, n = np.unique(code, return_counts=True)
        places = []
        for span in reversed(past):
            code, place = np.divmod(code, span)
            places.insert(0, place)
        h = np.zeros(len(n), _U64)
        for (c, _), place in zip(key, places, strict=True):
            h = (h ^ hashes[c][place]) * _U64(0x9E3779B97F4A7C15)
            h ^= h >> _U64(29)
        bucket = (h % _U64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        bucket, n, places = bucket[by], n[by], [p[by] for p in places]
        cuts = np.concatenate([np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), [len(bucket)]])
        for x, y in zip(cuts, cuts[1:], strict=False):
            rows[int(bucket[x])].append((number, [_packed(strings[c], p[x:y]) for (c, _), p in zip(key, places, strict=True)], _narrow(n[x:y])))
    for bucket, entries in rows.items():
        raw = pickle.dumps(entries, protocol=5)
        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([len(raw)], pa.int64()), pa.array([_CODEC.compress(raw, asbytes=True)], pa.binary())], ["bucket", "size", "keys"])


def _opened(packed: bytes, size: int) -> list:
    return pickle.loads(_CODEC.decompress(packed, size, asbytes=True))


def _spelled(entries: list, made: list[list[tuple[int | None, list[Piece]]]]) -> Iterator[pa.RecordBatch]:
    """A bucket's keys of all blocks, added up, as features."""
    of = defaultdict(list)
    for number, places, n in entries:
        of[number].append(([_unpacked(*p) for p in places], n))
    for number, parts in of.items():
        n = pa.array(np.concatenate([n.astype(np.int64) for _, n in parts]))
        names = [f"p{i}" for i in range(len(parts[0][0]))]
        if names:
            table = pa.table([pa.chunked_array([p[i] for p, _ in parts]) for i in range(len(names))] + [n], [*names, "n"])
            table = table.group_by(names, use_threads=False).aggregate([("n", "sum")])
        else:
            table = pa.table({"n_sum": [pc.sum(n).as_py()]})
        for center, pieces in made[number]:
            for b in (table if center is None else table.filter(pc.not_equal(table[f"p{center}"], ""))).combine_chunks().to_batches(max_chunksize=1 << 15):
                cells = [b.column(f"p{p}") if isinstance(p, int) else pa.scalar(p, pa.large_string()) for p in pieces]
                feature = pc.binary_join_element_wise(*cells, pa.scalar("", pa.large_string()))
                feature = feature if isinstance(feature, pa.Array) else pa.array([feature.as_py()])
                yield pa.RecordBatch.from_arrays([feature.cast(pa.string()), b.column("n_sum")], ["feature", "n"])


def counted(sentences: DataFrame, groups: tuple[str, ...], derived: dict[str, Callable[[str], str]]) -> DataFrame:
    """(feature, n): what `features.extract` of the tokens of `sentences` (toks), counted, would give.

    Templates may look at `tok` and at columns whose value hangs on the word's form alone; `derived` gives those by a function of the word.
    Tokens must be of text.TOKEN's kind, where `-` and `...` stand alone, so that different keys of a template are different features.
    """
    keys = _keys(groups)
    names, made = list(keys), list(keys.values())
    centers = [sorted({c for c, _ in m if c is not None}) for m in made]
    if unknown := {c for key in names for c, _ in key} - {"tok", *derived}:
        raise ValueError(f"columns that are neither tok nor derived: {sorted(unknown)}")
    derived = {c: f for c, f in derived.items() if any(c == k for key in names for k, _ in key)}
    size = int(str(sentences._jdf.queryExecution().optimizedPlan().collectLeaves().head().stats().sizeInBytes()))
    size = size if size < 1 << 50 else 0  # rows that are no files: Spark's mark for an unknown size
    buckets = max(int(sentences.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / BUCKET))
    block = BLOCK

    def deal(batches):
        held, n = [], 0
        for b in batches:
            held.append(b.column(0))
            n += len(b.column(0).flatten())
            if n >= block:
                yield from _dealt(held, names, centers, derived, buckets)
                held, n = [], 0
                _trim()
        if held:
            yield from _dealt(held, names, centers, derived, buckets)
        _trim()

    def spell(batches):
        now, entries = None, []
        for b in batches:
            for bucket, raw, packed in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bucket != now:
                    yield from _spelled(entries, made)
                    now, entries = bucket, []
                entries += _opened(packed, raw)
        yield from _spelled(entries, made)
        _trim()

    rows = sentences.select("toks").mapInArrow(deal, "bucket int, size long, keys binary")
    return rows.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(spell, "feature string, n long")


def dan2(spark: SparkSession) -> Callable[[str], str]:
    """text.shape_dan2 as a function of a word; the classes of characters are Spark's own, asked for once."""
    # no letter with case and no digit stands beyond; surrogates are no characters
    every = [chr(c) for c in range(1, 0x20000) if not 0xD800 <= c < 0xE000]
    cased = spark.range(1).select(T._cased(F.lit("".join(every)))).first()[0]
    classes = {ord(a): b for a, b in zip(every, cased, strict=True) if a != b}

    def shape(word: str) -> str:
        runs = re.sub(r"(?s)(.)\1+", r"\1", word.translate(classes)).removeprefix("~")
        return f"WT-{runs}:{len(word)}" if len(word) <= 3 else f"WT-{runs}"

    return shape
