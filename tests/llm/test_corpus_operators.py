"""Corpus operators against brute force, on whole small tables and on hand-made cases: nulls, empty and long texts, ties, copies, empty
tables, further columns with clashing names."""

import hashlib
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glossa.llm import bpe, chat_format, common, embedding_cells, embedding_dedup, html_extract, lm_scoring, minhash_dedup, packing, quality_rules, queries, substring_dedup, token_output
from tests.oracle import same

PATH, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(f"{WORDS[i]}{j}" for i, j in zip(rng.integers(0, len(WORDS), n), rng.integers(0, 500, n), strict=True))


ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "two words"), (6, "Größe çà  double  spaces\n\nand\tlines "), (7, "a" * 3000), (8, "emoji 👩‍👩‍👧 and ​ zero width nbsp"),
    (9, prose(1, 400)), (10, prose(1, 400)), (11, prose(1, 399) + " end"), (12, prose(2, 60)), (13, "x " * 300), (14, prose(3, 50) + " " + prose(2, 60)), (15, "<|endoftext|> inside"), (16, "\x1cfield\x1d separators\x85next"), (17, "tail newline\n"), (18, prose(5, 9000)),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Documents of all odd kinds, with columns whose names clash with working names; doc 4 twice."""
    rows = [(i, t, "k", "h", 1, "c") for i, t in [*ODD, (4, "one")]]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, hash string, n int, component_id string").repartition(3)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


def words_of(text, lower=False):
    b = (text or "").encode()
    return (b.lower() if lower else b).split()


# --- shared parts ---------------------------------------------------------------------------------------------------------------


def test_words_are_split_and_hashed_alike():
    texts = [t for _, t in ODD]
    w = common.Words(pa.array(texts))
    got = [[w.buf[w.start[k] : w.end[k]].tobytes() for k in range(a, b)] for a, b in zip(w.doc[:-1], w.doc[1:], strict=True)]
    assert got == [words_of(t) for t in texts]
    flat = [x for g in got for x in g]
    by = defaultdict(set)
    for word, h in zip(flat, w.hash.tolist(), strict=True):
        by[word].add(h)
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)


def test_windows_stay_within_texts():
    w = common.Words(pa.array(["a b c", "d e", "a b c d"]))
    hashes, at = w.windows(3)
    assert at.tolist() == [0, 5, 6] and hashes[0] == hashes[1] != hashes[2]


def test_planes_round_trip():
    x = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 1000).astype(np.uint64))
    assert (common.unplaned(common.planes(x), 8) == x).all()
    assert (common.unplaned(common.planes(x, 7), 8, 7) == x & np.uint64(0xFFFFFFFFFFFFFF00)).all()


@pytest.mark.parametrize("few", [0, 1 << 18])
def test_components_of_chains_and_stars(spark, monkeypatch, few):
    monkeypatch.setattr(common, "_FEW_LINKS", few)
    links = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3)]
    df = spark.createDataFrame(links, "a long, b long").repartition(5)
    got = {r["id"]: r["component_id"] for r in common.components(df, 4).collect()}
    assert got == {i: 0 for i in range(31)} | {k: 100 for k in range(100, 140)}
    assert common.components(df.where("false"), 4).count() == 0


# --- 4 --------------------------------------------------------------------------------------------------------------------------


def quality_by_hand(text):
    t = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    c = Counter(wins)
    covered = {i + k for i, x in enumerate(wins) if c[x] > 1 for k in range(8)}
    return len(w), sum(map(len, w)), sum(t.count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def test_quality_counts(odd):
    got = defaultdict(list)
    for r in quality_rules.digest(odd).collect():
        got[r[0]].append(tuple(r)[1:7])
    want = dict(ODD)
    assert all(v == quality_by_hand(want[k]) for k, vs in got.items() for v in vs) and len(got[4]) == 2


def test_quality_same_rows_as_sql(spark, sf):
    same(spark, sf, queries.QUERIES["op4_quality_rules"], queries.ORACLE["op4_quality_rules"])


def test_quality_filter_keeps_columns(odd, empty):
    kept = quality_rules.apply(odd)
    assert kept.columns == odd.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in quality_rules.digest(odd).where("kept").collect()}
    assert quality_rules.apply(empty).count() == 0 and quality_rules.digest(empty).count() == 0


def test_quality_has_no_python(odd):
    plan = quality_rules.digest(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_quality_finds_labelled_junk(spark):
    sf = "/root/testdata/sf0.01"
    j = quality_rules.digest(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("n_words >= 20")
    good, bad = j.where("quality = 1"), j.where("quality = 0")
    assert good.where("kept").count() >= 0.98 * good.count() and bad.where("not kept").count() >= 0.9 * bad.count()


# --- 5 --------------------------------------------------------------------------------------------------------------------------


def removed_by_hand(docs, width):
    at = defaultdict(list)
    for d, w in enumerate(docs):
        for i in range(len(w) - width + 1):
            at[tuple(w[i : i + width])].append((d, i))
    gone = defaultdict(set)
    for places in at.values():
        if len(places) > 1:
            for d, i in places:
                gone[d].update(range(i, i + width))
    return [(len(w), len(gone[d]), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone[d])).hexdigest()) for d, w in enumerate(docs)]


@pytest.mark.parametrize("width", [5, 35])
def test_substrings(odd, width):
    rows = [(i, t) for i, t in [*ODD, (4, "one")]]
    want = sorted(zip([i for i, _ in rows], removed_by_hand([words_of(t) for _, t in rows], width), strict=True))
    assert sorted((r[0], tuple(r)[1:]) for r in substring_dedup.digest(odd, width).collect()) == want


def test_substrings_over_block_borders(odd):
    rows = [sorted(map(tuple, substring_dedup.remove(odd, 35, block=n).collect()), key=repr) for n in (300, 4 << 20)]
    assert rows[0] == rows[1]


def morse(n):
    """Words of n letters that collide under every polynomial modulo a power of two."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 2048])
def test_words_that_collide_modulo_powers_of_two(spark, n):
    a, b = morse(n)
    same_34 = " ".join(f"w{i}" for i in range(34))
    texts = [a, b, f"{same_34} {a}", f"{same_34} {b}", " ".join(a), " ".join(b)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["n_removed"] for r in sorted(substring_dedup.digest(df.where("doc_id < 4")).collect())] == [0, 0, 0, 0]
    assert sorted((r[0], tuple(r)[1:]) for r in substring_dedup.digest(df).collect()) == list(enumerate(removed_by_hand([words_of(t) for t in texts], 35)))
    got = {r[0]: tuple(r)[1:] for r in minhash_dedup.classes(df, 3, 85).collect()}
    assert got == classes_by_hand(list(enumerate(texts)), 3, 85) and got[0][1] != got[1][1]


def test_substrings_keep_the_kind_of_ids(spark):
    df = spark.createDataFrame([("a", prose(1, 80)), (None, prose(1, 80)), ("b", None)], "doc_id string, text string")
    assert {(r["doc_id"], r["n_removed"]) for r in substring_dedup.digest(df).collect()} == {("a", 80), (None, 80), ("b", 0)}


def test_blocks_hang_on_texts_alone():
    """The same blocks from any batches and with any further columns, and none much larger than asked."""
    texts = [prose(k, 5 + k % 40) if k % 7 else None for k in range(200)] + ["x" * 5000]
    ids = pa.array(range(201))
    def made(step, extra):
        columns = {"doc_id": ids, "text": pa.array(texts)} | ({"more": pa.array([{"a": i, "b": "y" * 300} for i in range(201)])} if extra else {})
        t = pa.table(columns).combine_chunks()
        return [(n, b.column("doc_id").to_pylist()) for n, b in common.blocks(iter(t.to_batches(max_chunksize=step)), most=2000)]

    want = made(201, False)
    assert all(made(s, e) == want for s in (1, 7, 64, 201) for e in (False, True)) and len(want) > 10
    assert [i for _, b in want for i in b] == list(range(201))


def test_substrings_of_many_blocks_keep_columns(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "_BLOCK_BYTES", 2000)
    shared = prose(99, 50)
    rows = [(k, prose(k, 30 + k % 50) + (" " + shared if k % 3 == 0 else ""), "s" * (k % 9), k) for k in range(120)]
    df = common.written(spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").repartition(3))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        got = {r["doc_id"]: r for r in substring_dedup.apply(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = removed_by_hand([words_of(t) for _, t, _, _ in rows], 35)
    for (k, _, source, _), (_, n, sha) in zip(rows, want, strict=True):
        assert hashlib.sha256(b" ".join(words_of(got[k]["text"]))).hexdigest() == sha and got[k]["source"] == source and (n > 0) == (k % 3 == 0)


def test_substrings_same_rows_as_sql(spark, sf):
    same(spark, sf, queries.QUERIES["op5_substring_dedup"], queries.ORACLE["op5_substring_dedup"])


def test_substrings_leave_clean_texts_alone(odd, empty):
    out = substring_dedup.apply(odd)
    assert out.columns == odd.columns
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[6] == ODD[5][1] and texts[1] is None and texts[10] == ""
    assert substring_dedup.apply(empty).count() == 0 and substring_dedup.digest(empty).count() == 0


# --- 7 --------------------------------------------------------------------------------------------------------------------------


def classes_by_hand(docs, width, percent):
    sets = {}
    for d, t in docs:
        w = words_of(t, True)
        sets[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common_ = len(sets[a] & sets[b])
            if common_ and 100 * common_ >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def near_copies(seed, n_docs, n_words, changes):
    rng = np.random.default_rng(seed)
    base = prose(seed, n_words).split()
    out = []
    for k in range(n_docs):
        w = list(base)
        for i in rng.integers(0, n_words, rng.integers(0, changes + 1)):
            w[i] = f"new{k}x{i}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, odd, width, percent):
    got = {r[0]: tuple(r)[1:] for r in minhash_dedup.classes(odd, width, percent).collect()}
    assert got == classes_by_hand(ODD, width, percent)


def test_hot_families(spark):
    """Families larger than the list limit, a passage that unrelated texts share, sets around the sketch's size."""
    texts = near_copies(1, 40, 120, 8) + near_copies(2, 30, 40, 3) + [prose(50 + k, 30) + " " + prose(9, 60) for k in range(25)] + near_copies(3, 20, 9, 1)
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r[0]: tuple(r)[1:] for r in minhash_dedup.classes(df, 3, 85, few=6).collect()}
    assert got == classes_by_hand(docs, 3, 85)


def test_one_of_each_group_stays(spark, odd, empty):
    kept = minhash_dedup.keep_one(odd)
    assert kept.columns == odd.columns
    want = {d for d, v in classes_by_hand(ODD, 5, 80).items() if v[2]}
    assert {r["doc_id"] for r in kept.collect()} == want
    assert minhash_dedup.classes(empty).count() == 0


# --- 8, 9, 10 ---------------------------------------------------------------------------------------------------------------------


def test_bpe_as_the_library(odd, empty):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks(path), special_tokens={})
    want = dict(ODD)
    n = 0
    for r in bpe.decode(bpe.encode(odd, path, P.PATTERN), path).collect():
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert ids == enc.encode_ordinary(want[r["doc_id"]] or ""), r["doc_id"]
        assert bytes(r["bytes"]).decode() == (want[r["doc_id"]] or "")
        n += 1
    assert n == len(ODD) + 1 and bpe.encode(empty, path, P.PATTERN).count() == 0


def ids_by_library(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [0]


def test_packing_covers_every_id_once(odd, empty):
    want = {d: ids_by_library(t) for d, t in ODD}
    rows = packing.pack(odd, PATH, RANKS, P.PATTERN).toPandas()
    assert packing.pack(empty, PATH, RANKS, P.PATTERN).count() == 0
    for d, g in rows.groupby("doc_id"):
        if d == 4:  # two rows of one id; either may be cut
            assert g.length.sum() == 2 * len(want[4])
            continue
        assert g.start.is_unique
        g = g.sort_values("start")
        assert np.frombuffer(b"".join(g.ids), "<u4").tolist() == want[d]
        assert [zlib.crc32(b) for b in g.ids] == g.ids_crc32.tolist() and (g.doc_tokens == len(want[d])).all()
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert (g.offset == g.length.cumsum() - g.length).all()
        total = g.length.sum()
        assert total == 1024 or total & (total - 1) == 0


def shard_of(texts):
    """A shard's index with the counts of a corpus, and its texts' chunks."""
    chunk, offsets, terms = packing.Coder(PATH, RANKS, P.PATTERN).shard(pa.array(texts))[1:]
    return chunk, offsets, bpe.term_hashes(terms)


def test_packing_puts_neighbours_together():
    topic = lambda k, n: " ".join(f"t{k}w{i % 17}" for i in range(n))
    index = packing.Index(*shard_of([topic(k % 3, 40 + k) for k in range(12)])[:2])
    order = index.ask(0, np.array([i != 0 for i in range(12)]))
    assert {int(i) % 3 for i in order[:3]} == {0}


def bm25_by_hand(shard, seed, corpus):
    """Scores of a shard's texts for a seed, with document frequencies, number and mean length of `corpus` (lists of words)."""
    df = Counter(w for ws in corpus for w in set(ws))
    n, mean, local = len(corpus), np.mean(list(map(len, corpus))), Counter(w for ws in shard for w in set(ws))
    out = np.zeros(len(shard))
    for d, ws in enumerate(shard):
        for w in set(ws) & set(shard[seed]) if d != seed else ():
            tf = ws.count(w)
            if local[w] > 1:
                out[d] += np.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(ws) / mean))
    return out


def words_for_packing():
    copies = [f"one template that many share number {k % 5}" for k in range(20)]
    shard = [t.split(" ") for t in copies + [f"a{k} b{k % 7} c{k % 9} many" for k in range(40)]]
    return shard, shard + [f"one a{k} z{k} many others".split(" ") for k in range(50)]


def test_packing_ranks_by_the_whole_corpus():
    """All terms rank, those of copies that fill a third of a shard too, with the frequencies of all documents."""
    shard, every = words_for_packing()
    chunk, offsets, hashes = shard_of(list(map(" ".join, shard)))
    cells = np.zeros(packing.CELLS, np.int64)
    for ws in every:
        np.add.at(cells, packing._cell(bpe.term_hashes(pa.array(sorted(set(ws)), pa.large_string()))), 1)
    about = packing.Corpus(len(every), sum(map(len, every)), 1, cells)
    index = packing.Index(chunk, offsets, about, about.frequency(hashes))
    for seed in (0, 7, 25):
        want = bm25_by_hand(shard, seed, every)
        order = index.ask(seed, np.arange(len(shard)) != seed)
        assert sorted(order.tolist()) == np.flatnonzero(want).tolist()
        assert np.allclose(want[order], np.sort(want)[::-1][: len(order)])
    assert set(index.ask(0, np.arange(len(shard)) != 0)[:19].tolist()) == set(range(1, 20))


def fill_by_hand(tokens, shard, length):
    """Windows of (document, start, length), greedily: the rest of a cut document or the next unused one is the seed, its best unused neighbours follow."""
    left, windows, rest = list(range(len(tokens))), [], None
    while left or rest:
        window, room, seed, near = [], length, None, None
        while room and (left or rest):
            if rest:
                (d, at), rest = rest, None
            else:
                if seed is not None and near is None:
                    score = bm25_by_hand(shard, seed, shard)
                    near = sorted((x for x in left if score[x] > 0), key=lambda x: (-score[x], x))
                d = next((x for x in near or [] if x in left), left[0])
                left.remove(d)
                at = 0
            if seed is None:
                seed, near = d, None
            take = min(room, tokens[d] - at)
            window.append((d, at, take))
            room -= take
            if at + take < tokens[d]:
                rest = (d, at + take)
        windows.append(window)
    return windows


def test_packing_fills_greedily():
    shard, _ = words_for_packing()
    chunk, offsets, _ = shard_of(list(map(" ".join, shard)))
    tokens = np.array([len(ws) * 3 + k % 4 for k, ws in enumerate(shard)])
    got, want = packing.fill(tokens, packing.Index(chunk, offsets), 32), fill_by_hand(tokens.tolist(), shard, 32)
    assert got[: len(want) - 1] == want[:-1] and sum(k for w in got for _, _, k in w) == tokens.sum()


def test_packing_counts_all_documents(odd):
    about = packing.corpus(odd)
    words = [(t or "").split(" ") for t in [t for _, t in ODD] + ["one"]]
    df = Counter(w for ws in words for w in set(ws))
    assert about.documents == len(words) and about.mean == np.mean(list(map(len, words)))
    some = pa.array(sorted(df), pa.large_string())
    assert (about.frequency(bpe.term_hashes(some)) >= [df[w] for w in sorted(df)]).all() and about.frequency(bpe.term_hashes(pa.array(["one"], pa.large_string())))[0] == df["one"]


def test_packing_finds_neighbours_in_other_partitions(spark):
    """Documents of a topic lie in as many partitions as there are; they meet in one shard, and a group larger than a shard is dealt over several."""
    rows = [(k, " ".join([f"topic{k % 40}"] * 3 + [f"own{k}x{i}" for i in range(30)] + ["all"])) for k in range(800)] + [(1000 + k, "the same text again and again") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    about = packing.corpus(df, 20 * 280)
    where = packing.grouped(common.written(df), about, 20 * 280).withColumn("p", F.spark_partition_id()).toPandas()
    topical = where[where.doc_id < 800].assign(topic=lambda x: x.doc_id % 40)
    known = {int(h): n for h, n in zip(about.topics, about.often, strict=True)}
    hashes = bpe.term_hashes(pa.array([f"topic{k}" for k in range(40)], pa.large_string()))
    counted = [k for k, h in enumerate(hashes.tolist()) if h in known]  # one term in so many is counted
    assert all(known[int(hashes[k])] == 20 for k in counted) and len(counted) == sum(int(h) % packing.SAMPLED == 0 for h in hashes)
    for k in counted:  # its documents meet, next to each other
        g = topical[topical.topic == k]
        assert g.p.value_counts().max() >= 19 and (np.diff(g.index) == 1).sum() >= 18
    assert where[where.doc_id >= 1000].p.nunique() > 1 and len(where) == len(rows)
    sizes = where.groupby("p").text.agg(lambda t: t.str.len().sum())
    assert sizes.max() < 3 * sizes.mean()


def test_packing_groups_by_topics_in_order():
    texts = pa.array(["a b c", "c b", "x", None, "a a a"])
    hashes = {w: int(bpe.term_hashes(pa.array([w], pa.large_string()))[0]) for w in "abc"}
    often = {"a": 8.0, "b": 4.0, "c": 100.0}
    order = sorted("abc", key=hashes.get)
    about = packing.Corpus(5, 9, 9, np.zeros(packing.CELLS), np.array([hashes[w] for w in order], np.uint64), np.array([often[w] for w in order]))
    one, two, three = packing.topics(texts, about, 4.0)
    none = 2**64 - 1
    assert one[0] == one[1] and two[0] == one[4] and three[0] == two[1] and [int(one[2]), int(one[3]), int(two[4])] == [none] * 3


def test_ids_may_be_null_or_strings(spark):
    """Encoding, packing and shards keep ids of any kind, null ones and repeated ones."""
    rows = [(None, "a b"), (None, None), ("x", "c"), ("x", "c"), ("y", "")]
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(2)
    want = sorted(rows, key=repr)
    path = P.path("byte_bpe_multi_50k.tiktoken")
    got = [(r["doc_id"], bytes(r["bytes"]).decode()) for r in bpe.decode(bpe.encode(df, path, P.PATTERN), path).collect()]
    assert sorted(got, key=repr) == sorted([(i, t or "") for i, t in want], key=repr)
    packed = packing.pack(df, PATH, RANKS, P.PATTERN).collect()
    assert Counter(r["doc_id"] for r in packed) >= Counter({None: 2, "x": 2, "y": 1}) and sum(r["length"] for r in packed) == sum(len(ids_by_library(t)) for _, t in rows)
    cut = token_output.unpack(token_output.shards(df, PATH, RANKS, P.PATTERN, length=8, per_shard=2)).collect()
    assert Counter(r["doc_id"] for r in cut) == Counter(i for i, _ in rows) and sorted(r["slot"] for r in cut) == list(range(5))


def test_feistel_is_a_bijection():
    for n in (1, 2, 3, 17, 256, 1000):
        s = token_output.permute(np.arange(n), n)
        assert sorted(s.tolist()) == list(range(n))
        assert (token_output.permute(s, n, forward=False) == np.arange(n)).all()
    assert (token_output.permute(np.arange(1000), 1000, 1) != token_output.permute(np.arange(1000), 1000, 2)).any()


def test_token_shards_round_trip(spark, odd, empty, tmp_path):
    made = token_output.shards(odd, PATH, RANKS, P.PATTERN, length=64, per_shard=8)
    token_output.write(made, str(tmp_path / "shards"))
    rows = token_output.read(spark, str(tmp_path / "shards")).toPandas().sort_values("slot")
    n = len(rows)
    assert rows.slot.tolist() == list(range(n)) and (rows.shard_id == rows.slot // 8).all() and (rows.offset == rows.slot % 8 * 128).all()
    want = {d: ids_by_library(t) for d, t in ODD}
    for d, g in rows[rows.doc_id != 4].groupby("doc_id"):
        assert np.frombuffer(b"".join(g.sort_values("piece").ids), "<u2").tolist() == want[d]
    resumed = token_output.read(spark, str(tmp_path / "shards"), 11, 40).toPandas().sort_values("slot")
    assert resumed.slot.tolist() == list(range(11, min(40, n)))
    wide = tmp_path / "wide"  # more sequences a shard than the default
    token_output.write(token_output.shards(odd, PATH, RANKS, P.PATTERN, length=8, per_shard=1000), str(wide))
    many = token_output.read(spark, str(wide)).count()
    assert many > 1500 and sorted(r["slot"] for r in token_output.read(spark, str(wide), 999).collect()) == list(range(999, many))
    file = tmp_path / "flat.bin"
    assert token_output.export_file(spark.read.parquet(str(tmp_path / "shards")), str(file)) == file.stat().st_size == n * 128
    assert token_output.shards(empty, PATH, RANKS, P.PATTERN).count() == 0


def test_packing_takes_neighbours_and_edges_as_in_full():
    """Neighbours one by one come in the order of all of them, ties too; edges are white space of any kind."""
    import sys

    rng = np.random.default_rng(3)
    offsets = np.concatenate([[0], np.cumsum(rng.integers(1, 9, 300))])
    index = packing.Index(rng.integers(0, 40, offsets[-1]), offsets)
    for seed in range(0, 300, 7):
        unused = rng.random(300) < 0.7
        for first in (1, 5, 32, 400):
            assert list(index.near(seed, unused.copy(), min(first, 300))) == index.ask(seed, unused.copy()).tolist()
    kinds = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace()] + list("ažя语😀\x7f\x00«”")
    chunks = ["", *kinds, *(f"{c}b" for c in kinds), *(f"я{c}" for c in kinds), *(f"a{c}z" for c in kinds)]
    assert bpe.edges(pa.array(chunks, pa.large_string())).tolist() == [not c or c[0].isspace() or c[-1].isspace() for c in chunks]


# --- 1 --------------------------------------------------------------------------------------------------------------------------


def test_lm_scores_by_hand(spark, odd, empty):
    labels = spark.createDataFrame([(9, 1, 0), (12, 1, 0), (13, 0, 0), (None, 1, 0), (14, None, 0)], "doc_id long, quality int, toxic int")
    docs = [*ODD, (4, "one")]
    good = {9, 12}
    seqs = [(d, [b"<s>", *words_of(t, True), b"</s>"]) for d, t in docs]
    b1, b2, t1, t2 = Counter(), Counter(), Counter(), Counter()
    for d, w in seqs:
        for one, two in [(b1, b2)] + [(t1, t2)] * (d in good):
            one.update(w[:-1])
            two.update(zip(w, w[1:], strict=False))
    v, ratio, lam = len(b1), sum(t1.values()) / sum(b1.values()), lm_scoring.LAMBDA
    want = []
    for d, w in seqs:
        o1, o2 = Counter(w[:-1]), Counter(zip(w, w[1:], strict=False))
        xs = []
        for one, two, mine, scale in ((t1, t2, d in good, 1), (b1, b2, True, ratio)):
            xs.append(-sum(np.log(((two[a, b] - mine * o2[a, b]) * scale + lam) / ((one[a] - mine * o1[a]) * scale + lam * v)) for a, b in zip(w, w[1:], strict=False)) / (len(w) - 1))
        want.append((d, len(w) - 1, *xs, xs[0] - xs[1]))
    got = sorted(tuple(r) for r in lm_scoring.score(odd, labels).collect())
    assert len(got) == len(want)
    for g, w in zip(got, sorted(want), strict=True):
        assert g[:2] == w[:2] and np.allclose(g[2:], w[2:], atol=1e-9)
    assert lm_scoring.score(empty, labels).count() == 0
    assert lm_scoring.score(odd, labels.where("false")).count() == len(want)
    joined = sorted(tuple(r) for r in lm_scoring.score(odd, labels, few=0).collect())
    assert [g[:2] for g in joined] == [g[:2] for g in got] and np.allclose([g[2:] for g in joined], [g[2:] for g in got], atol=1e-12)


def test_lm_target_model_counts_all_good_rows(spark):
    """Where all of many documents are good, both models are the same, so no document is nearer to one of them."""
    docs = spark.range(21_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("a"), F.concat(F.lit("w"), F.col("id") % 7), F.concat(F.lit("v"), F.col("id") % 9_001)).alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    for few in (lm_scoring.FEW_IDS, 20_000):
        most, n = lm_scoring.score(docs, labels, few=few).agg(F.max(F.abs("xent_diff")), F.count("*")).first()
        assert n == 21_000 and most < 1e-9


# --- 2, 3 -------------------------------------------------------------------------------------------------------------------------


PAGES = [
    ("<html><body><nav><a href=1>Home</a></nav><article><h1>Title&amp;</h1><p>One <b>two</b>&nbsp;three.<br><p>Four\n five.</article><footer>&copy; x</footer></body></html>", "Title& One two three. Four five."),
    ("<div id=menu><a>a</a><a>b</a></div><div class=post><p>Long enough text of the page itself.</p><p>And some more of it here.</p></div><div class='comments'><p>First! I liked this very much indeed, thank you all.</p></div>", "Long enough text of the page itself. And some more of it here."),
    ("<article><p>a &lt;b&gt; &#233; &#x41; &am</p><script>var t='</p>'</script><aside>no</aside><form><p>no</p></form></article>", "a <b> é A &am"),
    (None, ""), ("", ""), ("<html></html>", ""), ("plain words only", "plain words only"), ("<article><p>unclosed <i>text", "unclosed text"), ("<!-- only a comment", ""),
    ("<div class=cookie-notice>We use cookies and tell you so at length.</div><main><p>Body text.</p></main>", "Body text."),
]


def test_main_text(spark):
    df = spark.createDataFrame([(i, "u", h, "x") for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extract.main_text(df).collect()}
    assert got == {i: (t, len(t)) for i, (_, t) in enumerate(PAGES)}
    assert html_extract.main_text(df.where("false")).count() == 0


BODY = "<p>Long enough text of the page itself.</p><p>And some more of it here.</p>"
HINTED = [f"<div class='{c}'>{BODY}</div>" for c in ("content has-sidebar", "no-sidebar", "page header-fixed", "widget")] + [
    f"<form action=x><nav><a>menu</a></nav><div>{BODY}</div></form>",
    f"<form><div class=related><article>{BODY}</article></div></form>",
    "<article><p>Long enough text of the page itself.</p><section id='side-effects'><p>And some more of it here.</p></section></article>",
    f"<article>{BODY}<div class='site-footer'>no</div><div class='post-comments'><p>{'I liked this very much indeed. ' * 9}</p></div></article>",
    f"<div class='related-posts'>{'<article>teaser</article>' * 20}</div><article>{BODY}</article>",
]


@pytest.mark.parametrize("page", HINTED)
def test_main_text_inside_hinted_wrappers(page):
    assert html_extract.extract(f"<html><body>{page}</body></html>") == "Long enough text of the page itself. And some more of it here."


MORE = "<p>Long enough text of the page itself, which goes on for some time.</p><p>And some more of it here, so that there is a body.</p><p>Short.</p>"
PLAIN = "Long enough text of the page itself, which goes on for some time. And some more of it here, so that there is a body. Short."
SHAPES = [
    (f"<article><header><h1>The Title</h1></header>{MORE}</article>", f"The Title {PLAIN}"),
    (f"<article>{MORE}<p>Let <math><mi>x</mi></math> be. <label>Fig</label> 1</p></article>", f"{PLAIN} Let x be. Fig 1"),
    (f"<div class='naval-history'>{MORE}</div>", PLAIN),
    (f"<div class=promontory>{MORE}</div>", PLAIN),
    (f"<nav><a>x</a></nav><div><h1>Title</h1>{MORE}</div><div>Copyright 2020 Foo</div>", f"Title {PLAIN}"),
    (f"{MORE}<div>Copyright 2020</div>", PLAIN),
    (f"<article><h1>Title here</h1><div>{MORE}</div><p>End.</p></article>", f"Title here {PLAIN} End."),
    (f"<article><section>{MORE}</section><section>{MORE}</section></article>", f"{PLAIN} {PLAIN}"),
    (f"<div><h1>Title</h1>{MORE}<ul><li><a href=1>One</a><li><a href=2>Two</a><li><a href=3>Three</a></ul></div>", f"Title {PLAIN}"),
    (f"<main><h1>T</h1><div class=body>{MORE}</div><div class=sidebar><p>Other stories you may like that are long.</p></div></main>", f"T {PLAIN}"),
    (f"<div class=post>{MORE}</div><div class=comments>{'<p>First! I liked this very much indeed, thank you all.</p>' * 5}</div>", PLAIN),
]


@pytest.mark.parametrize(("page", "text"), SHAPES)
def test_main_text_of_shapes(page, text):
    assert html_extract.extract(f"<html><body>{page}</body></html>") == text


def random_page(rng, depth=0):
    """A well-formed tree of sections, paragraphs and links: (tag, [text or tree])."""
    if depth == 3 or depth and rng.random() < 0.4:
        words = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 999, n))
        parts = [words(rng.integers(1, 40))]
        if rng.random() < 0.4:
            parts += [("a", [words(rng.integers(1, 6))]), words(rng.integers(1, 9))]
        return "p", parts
    return "div", [random_page(rng, depth + 1) for _ in range(rng.integers(1, 5))]


def best_by_hand(page):
    """The node of the greatest density sum, written out from the definition on trees."""
    def size(t, linked=False):
        if isinstance(t, str):
            k = len("".join(t.split()))
            return np.array([k, k * linked, 0, 0])
        linked = linked or t[0] == "a"
        return sum((size(c, linked) for c in t[1]), np.array([0, 0, 1, int(t[0] == "a")]))

    whole = size(page)

    def density(t):
        c, lc, tags, lt = map(int, size(t, False))
        lc = c if t[0] == "a" else lc
        base = np.log(c / max(1, c - lc) * lc + whole[1] / whole[0] * c + np.e)
        return c / tags * np.log(max(1, c / max(1, lc) * tags / max(1, lt))) / np.log(base + 1)

    def score(t):
        own = sum(len("".join(c.split())) for c in t[1] if isinstance(c, str))
        return sum(density(c) for c in t[1] if not isinstance(c, str)) + (min(density(t), own) if own else 0)

    def nodes(t):
        yield t
        for c in t[1]:
            if not isinstance(c, str):
                yield from nodes(c)

    return max(nodes(page), key=score)


def test_densities_by_hand():
    rng = np.random.default_rng(3)
    show = lambda t: t if isinstance(t, str) else f"<{t[0]}>{' '.join(map(show, t[1]))}</{t[0]}>"
    text = lambda t: t if isinstance(t, str) else " ".join(map(text, t[1]))
    for _ in range(200):
        page = ("body", [random_page(rng) for _ in range(rng.integers(1, 4))])
        got, want = html_extract.extract(f"<html>{show(page)}</html>"), text(best_by_hand(page))
        assert want in got or html_extract.extract(f"<html><body>{show(best_by_hand(page))}</body></html>") in got, show(page)


@pytest.mark.parametrize("page", ["<span>" * 40_000 + "</div>" * 40_000, "<ul><article>" + "<span>" * 60_000 + "</ul>" * 60_000, "<b>" * 100_000 + "</i>" * 100_000, "<li><p>" * 100_000, '<a "' * 200_000])
def test_hostile_markup_takes_linear_time(page):
    start = time.perf_counter()
    html_extract.extract(page)
    assert time.perf_counter() - start < 5  # well below a second on a free machine; a walk over open elements took minutes


def test_main_text_without_tags_that_name_the_article(spark, sf):
    import html

    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        page = r["html"].replace("<article>", "<div>").replace("</article>", "</div>")
        assert html_extract.extract(page) == " ".join(html.unescape(re.sub("<[^>]*>", "", re.sub(r"</?(p|h1|br)\b[^>]*>", " ", body))).split())


def test_main_text_of_repeated_pages(spark):
    df = spark.createDataFrame([(1, "u", MORE), (1, "u", MORE), (None, None, MORE)], "page_id long, url string, html string")
    assert [r["text"] for r in html_extract.main_text(df).collect()] == [PLAIN] * 3


def test_main_text_of_deep_pages():
    assert html_extract.extract("<div>" * 5000 + "deep text" + "</div>" * 5000) == "deep text"


def test_main_text_of_all_pages(spark, sf):
    import html

    for r in html_extract.main_text(spark.read.parquet(f"{sf}/pages.parquet")).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        assert r["text"] == " ".join(html.unescape(re.sub("<[^>]*>", "", re.sub(r"</?(p|h1|br)\b[^>]*>", " ", body))).split())


def test_chat_round_trip(spark):
    turns = [(1, 1, "assistant", "second"), (1, 0, "user", "first <turn x> \\ </turn>\n"), (2, 0, "assistant", None), (3, 0, None, ""), (1, 2, "assistant", "x" * 5000), (4, 0, "us>er", "é👩‍👩‍👧"), (4, 0, "us>er", "é👩‍👩‍👧"), *chat_format.PROBE]
    df = spark.createDataFrame([(*t, "z") for t in turns], "conv_id long, turn long, role string, text string, formatted string")
    parts = chat_format.format_turns(df).collect()
    by = defaultdict(list)
    for c, k, role, text in turns:
        by[c].append((k, role or "", text or ""))
    for r in parts:
        assert chat_format.read_turns(r["formatted"]) == [(a, b) for _, a, b in sorted(by[r["conv_id"]])]
    got = {r[0]: tuple(r)[1:5] for r in chat_format.digest(df).collect()}
    for c, rows in by.items():
        rows = sorted(rows)
        loss = "".join(t for _, r, t in rows if r == "assistant")
        assert got[c] == (len(rows), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in rows).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.digest(df.where("false")).count() == 0


def test_chat_longer_than_a_batch(spark, monkeypatch):
    n = 3000
    df = spark.range(n).select(F.lit(5).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), F.col("id").cast("string"), F.repeat(F.lit("y"), 1000)).alias("text"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        parts = chat_format.format_turns(df).count()
        r = chat_format.digest(df).first()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    loss = "".join(f"t{i}{'y' * 1000}" for i in range(1, n, 2))
    assert parts > 1 and r["n_turns"] == n and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


# --- 6 --------------------------------------------------------------------------------------------------------------------------


def links_by_hand(ids, vectors, labels, cosine):
    ok = [v is not None and y is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for v, y in zip(vectors, labels, strict=True)]
    n, root = len(ids), list(range(len(ids)))
    count = [0] * n

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i + 1, n):
            if ok[i] and ok[j] and labels[i] == labels[j] and len(vectors[i]) == len(vectors[j]):
                a, b = np.array(vectors[i], float), np.array(vectors[j], float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine:
                    count[i] += 1
                    count[j] += 1
                    x, y = find(i), find(j)
                    if x != y:
                        hi, lo = (x, y) if ids[x] > ids[y] else (y, x)
                        root[hi] = lo
    return {ids[i]: (count[i], ids[find(i)], ids[find(i)] == ids[i]) for i in range(n)}


@pytest.mark.parametrize("leaf", [8, 1024])
def test_embeddings(spark, leaf):
    rng = np.random.default_rng(4)
    vectors, labels = [], []
    for y in (0, 1):
        for _ in range(12):
            c = rng.normal(size=16)
            vectors += [(c + rng.normal(size=16) * s).astype(np.float32).tolist() for s in (0, 0, 0.1, 0.2, 0.3)]
            labels += [y] * 5
    vectors += [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] * 16, vectors[0], vectors[0][:8], vectors[0][:8], []]
    labels += [0, 0, 0, 0, 0, None, 0, 0, 0]
    ids = list(range(100, 100 + len(vectors)))
    df = spark.createDataFrame([(i, v, y, 1, "d") for i, v, y in zip(ids, vectors, labels, strict=True)], "vec_id long, embedding array<float>, label int, n_links int, dims string").repartition(3)
    got = {r[0]: tuple(r)[1:] for r in embedding_dedup.classes(df, leaf=leaf).collect()}
    assert got == links_by_hand(ids, vectors, labels, 0.93)
    assert embedding_dedup.classes(df.where("false")).count() == 0


def planted(n, dims, pairs, seed):
    """n random directions, of which `pairs` have a partner at a cosine just over the threshold, and a cluster of 300 that all link."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = unit(rng.normal(size=(n - pairs - 300, dims)))
    turn = rng.normal(size=(pairs, dims))
    base = x[:pairs]
    turn = unit(turn - (turn * base).sum(1, keepdims=True) * base)
    return np.concatenate([x, 0.931 * base + (1 - 0.931**2) ** 0.5 * turn, unit(x[-1] + 0.02 * rng.normal(size=(300, dims)))])


@pytest.mark.parametrize(("n", "rounds"), [(5_000, 8), (20_000, 8), (20_000, 3)])
def test_embedding_recall_and_pairs_compared(spark, monkeypatch, n, rounds):
    monkeypatch.setattr(embedding_dedup, "STEP", rounds)
    x = planted(n, 64, 1000, n)
    df = spark.createDataFrame([(i, v.tolist(), 7_000_000_000) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label long").repartition(4)
    want = np.concatenate([(x[k : k + 2000] @ x.T >= 0.93).sum(1) - 1 for k in range(0, n, 2000)])
    got = embedding_dedup.classes(df).toPandas().sort_values("vec_id")
    assert (got.n_links.to_numpy() <= want).all() and got.n_links.sum() >= 0.995 * want.sum()
    leaves = embedding_dedup.routed(df.select("label", F.lit(64).alias("dims"), "embedding", "vec_id", F.lit(1).cast("long").alias("weight"))).groupBy("leaf").count().toPandas()["count"]
    share = (leaves * (leaves - 1)).sum() / (n * (n - 1))
    assert share < (0.5 if n == 5_000 else 0.3), share


@pytest.mark.parametrize("chunk", [1 << 18, 700])
def test_embedding_cells_of_a_large_label(spark, monkeypatch, chunk):
    """Labels beyond FOREST: recall at the threshold, exact counts in a cluster, copies, a second label, and cells in chunks."""
    monkeypatch.setattr(embedding_dedup, "FOREST", 3000)
    monkeypatch.setattr(embedding_cells, "HOME", 300)
    monkeypatch.setattr(embedding_cells, "CHUNK", chunk)
    monkeypatch.setattr(embedding_dedup, "routed", lambda reps, *a, f=embedding_dedup.routed: f(reps.where("label < 9"), *a))  # the large one must not come here
    x = planted(6000, 64, 1500, 5)
    edge = np.zeros((2, 64))  # a cosine of 0.93 to within a few units of the last place
    edge[0, 0], edge[1, :2] = 1, (0.93, (1 - 0.93**2) ** 0.5)
    x = np.concatenate([x, edge, x[:50], x[:50], x[-5:]])
    rows = [(i, v.tolist(), 9) for i, v in enumerate(x)] + [(100_000 + i, v.tolist(), 1) for i, v in enumerate(x[-400:])] + [(200_000, None, 9), (200_001, [0.0] * 64, 9), (200_002, [1.0, 2.0], 9)]
    got = embedding_dedup.classes(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)).toPandas().set_index("vec_id")
    assert len(got) == len(rows) and got.n_links[[200_000, 200_001, 200_002]].tolist() == [0, 0, 0]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.93
    mine = got.sort_index().loc[: len(x) - 1]
    want = near.sum(1) - 1
    assert (mine.n_links.to_numpy() <= want).all() and mine.n_links.sum() >= 0.9995 * want.sum()
    right = mine.n_links.to_numpy() == want
    assert right.mean() > 0.999
    root = np.arange(len(x))
    while (root != (root := np.minimum(root, np.where(near, root[None], len(x)).min(1)))).any():
        pass
    assert (mine.component_id.to_numpy() == root).mean() > 0.999 and (mine.component_id == mine.index).eq(mine.kept).all()


# --- pipeline ----------------------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as C

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    kept = {r["doc_id"] for r in quality_rules.digest(docs).where("kept").collect()}
    rows = [r for r in rows if r[0] in kept]
    near = classes_by_hand(rows, 5, 80)
    rows = [r for r in rows if near[r[0]][2]]
    cut = {d: c for (d, _), c in zip(rows, removed_by_hand([words_of(t) for _, t in rows], 35), strict=True)}
    names = docs.columns
    for k, (name, stage) in enumerate(C.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 3:
            assert docs.columns == names, name
        if k == 1:
            assert {r["doc_id"] for r in docs.collect()} == {d for d, _ in rows}
        if k == 2:
            texts = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert all(hashlib.sha256(b" ".join(words_of(texts[d]))).hexdigest() == c[2] for d, c in cut.items())
            assert all(texts[d] == t for d, t in rows if cut[d][1] == 0)
    got = docs.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert {r["doc_id"] for r in got} == {d for d, _ in rows} and all(r["n"] == r["t"] for r in got)
    assert C.run(spark, sf).count() == docs.count()


@pytest.mark.parametrize("name", ["quality_rules", "minhash_near_dedup", "substring_dedup", "packing"])
def test_pipeline_stages_take_any_rows(odd, empty, name):
    """Nulls in any column, empty and long texts, repeated rows, clashing names, no rows."""
    import corpus_pipeline as C

    spark, stage = odd.sparkSession, dict(C.STAGES)[name]
    rows = odd.union(odd.sparkSession.createDataFrame([(None, prose(7, 90), None, None, None, None), (None, None, None, None, None, None)], odd.schema)).withColumn("n_chars", F.length("text").cast("long"))
    out = stage(spark, rows, "")
    if name == "packing":
        assert out.agg(F.sum("length")).first()[0] == sum(len(ids_by_library(t)) for t in [*(t for _, t in ODD), "one", prose(7, 90), None])
    else:
        assert out.columns == rows.columns and {r["doc_id"] for r in out.collect()} <= {r["doc_id"] for r in rows.collect()}
        assert name == "quality_rules" or None in {r["doc_id"] for r in out.collect()}
    assert stage(spark, rows.where("false"), "").count() == 0


def test_pipeline_scans_documents_once_a_pass(spark):
    """Stages are written between each other: the quality rules stand in the plan of their own table alone."""
    import corpus_pipeline as C

    before = list(common._written)
    out = C.run(spark, "/root/testdata/sf0.001")
    assert "_keys" not in out._jdf.queryExecution().optimizedPlan().toString() and out.count() > 0
    assert len(common._written) == len(before) + len(C.STAGES)
