"""Taggers, features, tree patterns, plug-ins, vectors, optimisers: small cases with results from other ways of computing them."""

import itertools
import socket

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.operators import aggregates, context, distributions, evaluate, feature_counts, features, gazetteer, merge, models, patterns, plugins, sets, spans, tagger, trees
from glossa.operators import vectors as V
from glossa.plans import catalogue
from glossa.streaming.server import Server

LABELS = ["NAME", "O"]


def sentences(n, seed):
    rng = np.random.default_rng(seed)
    low, names = "the a of to saw met with and in near".split(), "Ann Bo Cy Dee Eli Flo".split()
    return [[str(rng.choice(names if rng.random() < 0.3 else low)) for _ in range(rng.integers(1, 9))] for _ in range(n)]


def rows_of(spark, many):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(many)], "doc_id long, toks array<string>")
    gold = F.transform("toks", lambda t: F.when(t.rlike("^[A-Z]"), "NAME").otherwise("O"))
    return df.select("doc_id", tagger.word_features(F.col("toks")).alias("features"), gold.alias("gold"))


def test_tagger_from_training_to_tags(spark, tmp_path):
    train, test = rows_of(spark, sentences(40, 1)), rows_of(spark, [*sentences(30, 2), []])
    model = tagger.train(train, LABELS, buckets=512, rounds=15)
    tagger.save(spark, model, str(tmp_path / "model"))
    again = tagger.load(spark, str(tmp_path / "model"))
    assert again.labels == model.labels and np.allclose(again.weights, model.weights) and np.allclose(again.move, model.move)
    done = tagger.tag(test, again).collect()
    assert len(done) == 31 and all(r["path"] == r["gold"] for r in done)
    p = {r["doc_id"]: r["p"] for r in tagger.probabilities(test, again).collect()}
    assert all(abs(sum(x) - 1) < 1e-9 for ps in p.values() for x in ps)
    assert tagger.log_likelihood(test, model) > tagger.log_likelihood(test, tagger.CrfModel(LABELS, np.zeros((512, 2)), np.zeros((2, 2))))


def test_gradient_of_the_tagger(spark):
    data = rows_of(spark, sentences(4, 3))
    rng = np.random.default_rng(0)
    w, m = rng.normal(size=(16, 2)) * 0.1, rng.normal(size=(2, 2)) * 0.1
    ll, gw, gm = tagger._gradients(data, LABELS, 16, m, w)
    for grad, x, k in ((gw, w, (3, 1)), (gm, m, (0, 1))):
        y = x.copy()
        y[k] += 1e-5
        args = (m, y) if x is w else (y, w)
        assert abs((tagger._gradients(data, LABELS, 16, *args)[0] - ll) / 1e-5 - grad[k]) < 1e-3


def test_named_entity_pipe_in_order(spark):
    toks = [(1, i, t, t.lower()) for i, t in enumerate("Mr Bo Smith of Acme Corp met Ann".split())]
    df = spark.createDataFrame(toks, "doc_id long, pos int, tok string, lemma string")
    gaz = lambda *r: spark.createDataFrame([(t, p, 1.0) for t, p in r], "type string, phrase string, priority double")
    model = tagger.train(rows_of(spark, sentences(40, 1)), LABELS, buckets=512, rounds=10)
    rx = spark.createDataFrame([(1, "ORG", "acme corp")], "order int, type string, pattern string")
    steps = merge.entity_steps(gaz(("PERSON", "Bo Smith")), gaz(("ORG", "acme")), gaz(("PERSON", "Ann")), [1, 2], tagger.step(model), rx)
    got = {r["pos"]: r["label"] for r in merge.pipe(df, steps).collect()}
    assert [got[i] for i in (1, 2)] == ["PERSON", "PERSON"] and got[4] == got[5] == "ORG" and got[3] == got[6] == "O"


def test_patterns_overwrite_only_what_they_may(spark):
    toks = [(1, i, w, l) for i, (w, l) in enumerate([("a", "O"), ("b", "X"), ("c", "Y"), ("b", "N")])]
    df = spark.createDataFrame(toks, "doc_id long, pos int, lemma string, now string")
    rx = spark.createDataFrame([(1, "N", "a|c", None), (2, "N", "b", ["X"])], "order int, type string, pattern string, overwritable array<string>")
    got = [r["label"] for r in gazetteer.regex_labels(df, rx, current="now").orderBy("pos").collect()]
    assert got == ["N", "N", "Y", "N"]


def test_feature_table_is_well_formed():
    rows = features.templates()
    assert len({(q, p) for _, q, p in rows}) >= len(rows) - 8 and {q for _, q, _ in rows} == {"C", "CpC", "Cp2C", "CpCp2C", "CpCp2Cp3C", "CpCp2Cp3Cp4C", "CnC", "CpCnC"}
    with pytest.raises(ValueError, match="no such groups"):
        features.templates("nothing")


def test_features_of_a_sentence(spark):
    toks = [(1, 0, i, t, g) for i, (t, g) in enumerate([("(", "("), ("Twenty-first", "JJ"), ("men", "NN"), ("ran", "VBD"), (")", ")")])]
    s = spark.createDataFrame(toks, "doc_id long, sent_id int, pos int, tok string, tag string").withColumn("shape", T.shape_dan2(F.col("tok")))
    s = s.select("*", features.ordinal_features().alias("o"), features.verb_features(None).alias("v"), features.paren_match(4).alias("m"), features.begin_features().alias("b"), features.neighbour_ngrams(2).alias("n"), features.disjunctive_features(2, 3, True, True).alias("d"))
    got = {}
    out = features.extract(s, ("word", "neighbours", "shape_pairs", "taggy_long"), [("C", F.col("o")), ("C", F.col("v")), ("Cp4C", F.col("m")), ("C", F.col("b")), ("CpC", F.col("n")), ("C", F.col("d"))])
    for r in out.collect():
        got.setdefault(r["pos"], set()).add(r["feature"])
    assert {"(-WORD|C", "-PW|C", "BEGIN-SENT|C", "X-PVB|C", "ran-NVB|C", "null-null-null-(-TTTS|CpCp2Cp3C"} <= got[0]
    assert {"C_ORDINAL|C", "(...WT-Xx-x-PW_CTYPE|C", "men-DISJN|C", "ran-DISJWE|C", "T-CURRENT-PREFIX|CpC"} <= got[1]
    assert {"P_ORDINAL|C", "X-ran-PNVB|C", "Twenty-first-DISJP|C", "me-CURRENT-PREFIX|CpC", "st-PREVIOUS-SUFFIX|CpC"} <= got[2]
    assert "PAREN-MATCH|Cp4C" in got[4] and not any("PAREN" in x for k in range(4) for x in got[k])


def test_domains_repeat_features(spark):
    s = spark.createDataFrame([(1, 0, 0, "a", "x")], "doc_id long, sent_id int, pos int, tok string, shape string")
    assert {r["feature"] for r in features.extract(s, ("word",), domain="d").collect()} == {"a-WORD|C", "d-a-WORD|C"}


# --- trees ----------------------------------------------------------------------------------------------------------------------


def random_tree(rng, depth=0):
    kids = [] if depth > 3 or rng.random() < 0.25 and depth else [random_tree(rng, depth + 1) for _ in range(rng.integers(1, 4))]
    return trees.Node(str(rng.choice(["NP", "VP", "S", "X", "NN"])), kids)


@pytest.mark.parametrize("op", ["<<", ">>", "<", ">", "..", ",,", ".", ",", "$", "$..", "$,,", "$.", "$,", "<,", ">,", "<-", ">-", "<:", ">:", "<<,", ">>,", "<<-", ">>-", "<2", "<-1"])
def test_text_patterns_as_table_joins(spark, op):
    """Relations in memory against those by node numbers."""
    rng = np.random.default_rng(5)
    forest = spark.createDataFrame([(i, str(random_tree(rng))) for i in range(12)], "tree_id long, tree string").where("tree like '(%'")
    joined = trees.search(trees.from_brackets(forest), "__", (op, "NP", "b")).groupBy("tree_id").count()
    found = patterns.find(forest, f"__ {op} NP=b", "b").groupBy("tree_id").count()
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, found.collect()))


def test_patterns_that_cannot_be_read():
    for bad in ("NP <", "(NP", "NP [< A", "NP ~ B", ""):
        with pytest.raises(ValueError, match="expected"):
            patterns.read(bad)


def test_pattern_strings_and_known_nodes():
    t = trees.build("(S (A x1) (B x1) (A x2))")
    found = lambda p: [b for _, b in patterns.matches(t, patterns.read(p))]
    assert len(found("/^x(.)$/#1%n=a .. /^x(.)$/#1%n=b")) == 1
    assert len(found("A=a $ (A=b !== =a)")) == 2 and not found("S < (A=a $ (B < =a))")
    assert len(found("S < A=a ?< C=c")) == 2 and len(found("S [< B | < C] < A")) == 2
    assert len(found("@N")) == 0 and patterns.basic("NP-SBJ-1") == "NP" and patterns.basic("-NONE-") == "-NONE-"
    assert [str(n) for n, _ in patterns.matches(t, patterns.read("BRANCH < /^x/", {"BRANCH": "A|B"}))] == ["(A x1)", "(B x1)", "(A x2)"]


EDITS = [
    ("NP < DT=d", ["prune d"], "(S (NP (DT a)) (VP (V v)))", "(S (VP (V v)))"),
    ("VP=v < NP=n", ["excise v n"], "(S (VP (V v) (NP (N n))))", "(S (N n))"),
    ("NP=n !< X", ["insert (X x) >-1 n"], "(S (NP (N n)))", "(S (NP (N n) (X x)))"),
    ("NP=n !$- X", ["insert (X x) $+ n"], "(S (NP n))", "(S (X x) (NP n))"),
    ("A=a $.. B=b", ["move b $+ a"], "(S (A a) (C c) (B b))", "(S (B b) (A a) (C c))"),
    ("A=a $ B=b", ["replace a b"], "(S (A a) (B b))", "(S (B b) (B b))"),
    ("A=a !< B", ["adjoin (A (B B@)) a"], "(S (A a))", "(S (A (B (B a))))"),
    ("A=a !< /-/ $ B=b !== /-1/", ["coindex a b"], "(S (A a) (B b))", "(S (A-1 a) (B-1 b))"),
    ("/^A/=a !< /Z/", ["relabel a /^A(.*)$/B$1/"], "(S (A1 x) (A2 y))", "(S (B1 x) (B2 y))"),
    ("A=a", ["delete a"], "(A x)", None),
]


@pytest.mark.parametrize(("pattern", "ops", "before", "after"), EDITS)
def test_edits(pattern, ops, before, after):
    out = patterns.operate(trees.build(before), patterns.read(pattern), ops)
    assert (str(out) if out else None) == after


def test_edits_without_end_raise():
    with pytest.raises(RuntimeError, match="without end"):
        patterns.operate(trees.build("(A x)"), patterns.read("A=a"), ["insert (B y) >1 a"])


def test_transforms(spark):
    t = trees.build("(S (S (A a) (S (B b))) (C c))")
    assert str(patterns.flattened(t)) == "(S (A a) (B b) (C c))"
    assert [str(x) for x in patterns.spliced(t, lambda n: n.label != "S")] == ["(A a)", "(B b)", "(C c)"]
    assert str(patterns.pruned(t, lambda n: n.label != "b")) == "(S (S (A a)) (C c))"
    assert patterns.dependency_path(patterns.edges(trees.build("(S (NP (DT a) (NN b)) (VP (VB c) (NP (NN d))))")), 0, 3) == ["<det", "<nsubj", "dobj>"]


def test_heads_in_tables_and_in_memory(spark):
    rng = np.random.default_rng(8)
    labels = "S NP VP PP NN NNS DT VB VBD IN JJ CC , . QP CD".split()
    def grow(d=0):
        kids = [] if d > 3 else [grow(d + 1) for _ in range(rng.integers(1, 5))]
        return trees.Node(str(rng.choice(labels)), kids)

    forest = [grow() for _ in range(8)]
    df = spark.createDataFrame([(i, str(t)) for i, t in enumerate(forest)], "tree_id long, tree string")
    got = {(r["tree_id"], r["node_id"]): r["head"] for r in trees.heads(trees.from_brackets(df)).collect()}
    for i, t in enumerate(forest):
        nodes = patterns.Numbered(trees.build(str(t))).nodes
        at = {id(n): k for k, n in enumerate(nodes)}
        assert all(got[i, at[id(n)]] == at[id(trees.head_child(n))] for n in nodes if n.kids)


# --- the rest -------------------------------------------------------------------------------------------------------------------


def test_dual_numbers():
    f = lambda x: (x * x + 3 / x).exp() / (2 - x**3) - (x + 5).log()
    g = lambda x: np.exp(x * x + 3 / x) / (2 - x**3) - np.log(x + 5)
    assert abs(V.derivative(f, 0.7) - (g(0.7 + 1e-6) - g(0.7 - 1e-6)) / 2e-6) < 1e-4


def test_vectors_of_odd_sizes(spark):
    df = spark.createDataFrame([([],), ([1.0],), ([2.0, -2.0],)], "a array<double>")
    a = F.col("a")
    rows = df.select(V.mean(a), V.argmax(a), V.normalised(a), V.variance(a), V.log_sum(a), V.cosine(a, a), V.compare(a, F.reverse(a)), V.to_2d(a, 2), V.remove_at(a, 9)).collect()
    assert tuple(rows[0])[:4] == (None, -1, None, None) and rows[0][4] == float("-inf") and rows[0][7] == []
    assert rows[1][0] == 1.0 and rows[1][2] == [1.0] and rows[2][2] is None and rows[2][3] == 8.0 and rows[2][6] == 1 and rows[2][8] == [2.0, -2.0]


def test_vector_elements_keep_the_sign_of_zero_and_take_odd_vectors(spark, tmp_path):
    """Elements that round to -0.0, a zero vector and null elements, against the query's SQL, told apart by their text."""
    rows = [(1, [-1e-7, 0.25, -0.0]), (2, [0.0, 0.0]), (3, [None, -3.0, 4.0]), (4, [2e-7, -2e-7]), (5, []), (6, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    columns = ["vec_id", "added", "multiplied", "exps", "unit"]
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({catalogue.ORACLE['vector_elements']}) ORDER BY vec_id").fetchall()
    got = sorted(tuple(r[c] for c in columns) for r in catalogue.QUERIES["vector_elements"](spark, str(tmp_path)).collect())
    text = lambda rows: [[None if x is None else repr(x) for c in r[1:] for x in c] for r in rows]
    assert text(got) == text(want) and "-0.0" in text(got)[0]


def test_optimisers_find_the_least():
    rng = np.random.default_rng(0)
    x, want = rng.normal(size=(200, 3)), np.array([1.0, -2.0, 0.5])
    y = x @ want
    some = lambda w, r: (((x[r] @ w - y[r]) ** 2).mean(), 2 * x[r].T @ (x[r] @ w - y[r]) / len(r))
    every = lambda w: some(w, np.arange(200))
    zero = np.zeros(3)
    for got in (models.lbfgs(every, zero), models.conjugate_gradient(every, zero), models.sgd(some, 200, zero, 40), models.sgd(some, 200, zero, 60, rate=0.5, scaled=True), models.meta_descent(some, 200, zero, 40), models.hybrid(some, every, 200, zero)):
        assert np.allclose(got, want, atol=0.02)


def test_priors_reach_beyond_neighbours():
    words = "Bo ran . Bo fell".split()
    emit = np.array([[2.0, 0.0], [0.0, 2.0], [0.0, 2.0], [0.0, 0.3], [0.0, 2.0]])
    move = np.zeros((2, 2))
    free, _ = models.gibbs_path(emit, move, prior=models.uniform_prior)
    bound, _ = models.gibbs_path(emit, move, sweeps=80, prior=lambda y: models.consistency_penalty(words, y, 5.0))
    assert free.tolist() == [0, 1, 1, 1, 1] and bound.tolist() == [0, 1, 1, 0, 1]
    path = np.array([0, 1, 1, 0, 0])
    assert models.entities_of(words, path, 1) == [(("Bo",), 0), (("Bo", "fell"), 0)]
    assert models.entity_prior(words, 1, np.full((2, 2), 3.0), np.full((2, 2), 0.5))(path) == -0.5
    assert models.slot_prior(words, {0: 2.0})(path) == -2.0


def test_plugins(spark):
    plugins.register("tokenizer", "commas", lambda c: F.split(c, ","))
    try:
        df = spark.createDataFrame([(1, "a,b")], "doc_id long, text string")
        assert [tuple(r["tok"]) for r in plugins.tokenise(df, "commas", "indexed").orderBy("pos").collect()] == [(1, "a"), (2, "b")]
        with pytest.raises(ValueError, match="there is a"):
            plugins.register("tokenizer", "commas", None)
    finally:
        del plugins.KINDS["tokenizer"]["commas"]
    assert plugins.named("reader", "glossa.sources.readers:conll") is plugins.named("reader", "conll")
    with pytest.raises(ValueError, match="no reader"):
        plugins.named("reader", "nothing")


def test_one_request_a_connection():
    def ask(port, text):
        with socket.create_connection(("127.0.0.1", port), timeout=5) as c:
            c.sendall(text.encode() + b"\n")
            return b"".join(iter(lambda: c.recv(4096), b"")).decode()

    def answer(line):
        if not line:
            raise ValueError("nothing asked")
        return line.upper()

    with Server(answer) as s:
        assert [ask(s.port, x) for x in ("a b", "ü", "", "c")] == ["A B", "Ü", "ERROR nothing asked", "C"]


def test_sentences_in_regions(spark):
    rows = [(1, i, t) for i, t in enumerate("x <t> a . b <br> c </t> d <t> e </t>".split())]
    s = context.split_sentences(spark.createDataFrame(rows, "doc_id long, pos int, tok string"), forced=["<br>"], region=("<t>", "</t>"))
    assert [(r["sent_id"], r["pos"], r["tok"]) for r in s.orderBy("sent_id", "pos").collect()] == [(0, 0, "a"), (0, 1, "."), (1, 0, "b"), (2, 0, "c"), (2, 1, "e")]


def test_capped_documents_by_hand(spark):
    sizes = [3, 4, 2, 9, 1, 1, 12, 5]
    df = spark.createDataFrame([(1, i, n) for i, n in enumerate(sizes)], "doc_id long, sent_id int, n int")
    assert [r["part"] for r in context.cap_documents(df, 9).orderBy("sent_id").collect()] == [0, 0, 0, 1, 2, 2, 3, 4]


def test_templates_merge_where_they_agree(spark):
    df = spark.createDataFrame([(1, "a", None), (1, None, "x"), (2, "a", "x"), (2, "b", None)], "k int, f string, g string")
    assert [tuple(r) for r in aggregates.merge_templates(df, ["k"], ["f", "g"]).collect()] == [(1, "a", "x")]


def test_rule_errors(spark):
    g = spark.createDataFrame([(1, "S", "A B"), (1, "A", "a")], "tree_id long, label string, children string")
    h = spark.createDataFrame([(1, "S", "A C"), (1, "A", "a")], "tree_id long, label string, children string")
    assert sorted(map(tuple, evaluate.rule_errors(g, h).collect())) == [("S -> A B", 1, 0), ("S -> A C", 0, 1)]
    n, speed = evaluate.words_per_second(lambda: g.withColumnRenamed("label", "tok"))
    assert n == 2 and speed > 0


def test_chunk_records(spark):
    t = context.with_offsets(spark.createDataFrame([(1, "Ann  Lee, met Bo.")], "doc_id long, text string"))
    s = spark.createDataFrame([(1, "P", 0, 8), (1, "Q", 14, 16)], "doc_id long, type string, begin long, end long")
    got = {r["type"]: (r["tokens"], r["text"], r["begin_pos"], r["end_pos"]) for r in spans.chunk_records(s, t).collect()}
    assert got == {"P": (["Ann", "Lee"], "Ann  Lee", 0, 2), "Q": (["Bo"], "Bo", 4, 5)}
    m = spans.merged_chunks(s, s.withColumn("end", F.col("end") + 1))
    assert {(r["type"], r["begin"], r["end"]) for r in m.collect()} == {("P", 0, 9), ("Q", 14, 17)}


def test_hyphenation_weights():
    p = T.hyphenation_patterns(["a1b", "1b2c", ".x3y"])
    assert p["ab"] == [0, 1, 0] and p["bc"] == [1, 2, 0] and p[".xy"] == [0, 0, 3, 0]
    for w in map("".join, itertools.product("abcx", repeat=6)):
        assert all(2 <= k <= 3 for k in T.hyphenate(w, p))


def test_simple_good_turing_by_hand(spark):
    """Against the estimate written out with numpy: averaged counts of counts, a line in logarithms, the switch to it, and scaling."""
    counts = [1] * 120 + [2] * 40 + [3] * 24 + [4] * 13 + [5] * 15 + [6] * 5 + [7] * 11 + [8] * 2 + [9] * 2 + [10] * 1 + [12] * 3 + [26] * 1
    df = spark.createDataFrame([(f"k{i}", n) for i, n in enumerate(counts)], "key string, n long")
    r = np.array(sorted(set(counts)), float)
    n = np.array([counts.count(int(x)) for x in r], float)
    q, t = np.concatenate([[0], r[:-1]]), np.concatenate([r[1:], [2 * r[-1] - r[-2]]])
    b, a = np.polyfit(np.log(r), np.log(n / (0.5 * (t - q))), 1)
    s = lambda x: np.exp(a + b * np.log(x))
    adjusted, line = [], False
    for i, x in enumerate(r):
        y = (x + 1) * s(x + 1) / s(x)
        if not line and x + 1 in r:
            m = n[list(r).index(x + 1)]
            turing, sd = (x + 1) * m / n[i], np.sqrt((x + 1) ** 2 * m / n[i] ** 2 * (1 + m / n[i]))
            line = abs(turing - y) <= 1.96 * sd
            adjusted.append(y if line else turing)
        else:
            line = True
            adjusted.append(y)
    adjusted = np.array(adjusted)
    want = (1 - n[0] / (n * r).sum()) * adjusted / (n * adjusted).sum()
    got = distributions.simple_good_turing(df).orderBy("value").collect()
    assert [x["value"] for x in got] == r.tolist() and np.allclose([x["adjusted"] for x in got], adjusted) and np.allclose([x["p"] for x in got], want)
    assert abs((want * n).sum() + n[0] / (n * r).sum() - 1) < 1e-9


def test_edits_by_label(spark):
    df = spark.createDataFrame([(1, "(DOC (LINE walking talked) (LINE a ended))"), (2, "(DOC (LINE b))")], "tree_id long, tree string")
    out = trees.rewrite(df, [("[a-z]*ing", "relabel", "ING"), ("[a-z]*ed", "delete")])
    assert {r["tree_id"]: r["tree"] for r in out.collect()} == {1: "(DOC (LINE ING) (LINE a))", 2: "(DOC (LINE b))"}


def test_samples_and_shuffles_are_stable(spark):
    df = spark.range(1000).withColumnRenamed("id", "doc_id")
    one = [r[0] for r in sets.sample(df.repartition(3), 0.1, 7, "doc_id").orderBy("doc_id").collect()]
    assert one == [r[0] for r in sets.sample(df.repartition(7), 0.1, 7, "doc_id").orderBy("doc_id").collect()] and 60 < len(one) < 140
    a, b = ([r[0] for r in sets.shuffled(df.repartition(k), "doc_id", 7).collect()] for k in (2, 5))
    assert a == b != sorted(a) and sorted(a) == list(range(1000))


def test_counted_templates_are_the_extracted_ones(spark, monkeypatch):
    """Windows counted by blocks give what a row a feature gives: neighbours seen from both sides, sentence ends, forms beyond ASCII, several blocks and buckets."""
    monkeypatch.setattr(feature_counts, "BLOCK", 40)
    texts = ["Ab ab - -. Don't -- stop... 1.50 12 a-b! ÄÖ äx ١٢ 中中 ǅ ⅷ 𝔸𝕓 ~~ ~x. Ab ab", None, "", " . ", "a", "a a a a. a a", *(f"w{i % 7} x{i % 3} W{i}. Ab ab." for i in range(60))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    groups = ("word", "neighbours", "word_pairs", "sym_words", "shape", "shape_neighbours", "shape_pairs", "types2", "sequence", "types_long", "next_sequence", "long")
    by_row = context.tokenise_sentences(docs).withColumn("shape", T.shape_dan2(F.col("tok")))
    want = {r[0]: r[1] for r in features.extract(by_row, groups).groupBy("feature").count().collect()}
    rows = [tuple(r) for r in feature_counts.counted(context.sentence_arrays(docs), groups, {"shape": feature_counts.dan2(spark)}).collect()]
    assert len(rows) == len(want) and dict(rows) == want
    with pytest.raises(ValueError):
        feature_counts.counted(context.sentence_arrays(docs), ("either_side",), {})
    with pytest.raises(ValueError):
        feature_counts.counted(context.sentence_arrays(docs), ("tag",), {})


def test_feature_templates_shuffles_no_row_a_token(spark, sf):
    plan = catalogue.QUERIES["feature_templates"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") == 1
