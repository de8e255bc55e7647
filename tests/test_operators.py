"""Small fixtures for operators whose rules the queries do not reach."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.operators import context, counters, distributions, evaluate, gazetteer, merge, models, morphology, sets, spans, trees
from glossa.sources import readers, writers


def one(spark, expression, *columns):
    return spark.createDataFrame([columns], [f"c{i}" for i in range(len(columns))]).select(expression).first()[0]


@pytest.mark.parametrize(
    ("function", "value", "want"),
    [
        (T.capitalise_pieces, "jānis o'neil", "Jānis O'Neil"),
        (T.americanise, "colour", "color"),
        (T.americanise, "organisation", "organization"),
        (T.to_ascii, "žurnāls", "zurnals"),
        (T.strip_markup, "a<b>c</b>", "ac"),
        (T.file_name, "a b/c", "a_b_c"),
        (T.shape_digits, "a12", "a99"),
    ],
)
def test_string_functions(spark, function, value, want):
    assert one(spark, function(F.col("c0")), value) == want


#: Shapes worked out by hand from the rules, character by character.
SHAPES = [
    ("dan1", "123", "ALL-DIGITS"), ("dan1", "ABC", "ALL-UPPER"), ("dan1", "A", "ALL-UPPER"), ("dan1", "abc", "ALL-LOWER"), ("dan1", "Abc", "MIXED-CASE"), ("dan1", "aB", "OTHER"), ("dan1", "A1", "OTHER"), ("dan1", "", "ALL-DIGITS"), ("dan1", "...", "OTHER"),
    ("dan2", "McDonald's-42", "WT-XxXx'x-d"), ("dan2", "...", "WT-.:3"), ("dan2", "a_b", "WT-x:3"), ("dan2", "~~a", "WT-x:3"), ("dan2", "IBM5000", "WT-Xd"), ("dan2", "٣٤٥٦", "WT-d"),
    ("dan2bio", "TNFalpha", "WT-Xx-GREEK"), ("dan2bio", "Beta", "WT-Xx-GREEK"), ("dan2bio", "Best", "WT-Xx"),
    ("jenny1", "TNFalphaB", "WT-XgX"), ("jenny1", "rho", "WT-g:3"), ("jenny1", "a_b", "WT-x_x:3"), ("jenny1", "betau", "WT-gx"), ("jenny1", "Alpha", "WT-Xx"),
    ("chris1", "12", "CARDINAL13"), ("chris1", "1999", "CARDINAL4"), ("chris1", "19999", "CARDINAL5PLUS"), ("chris1", "-1,200.5", "NUMBER"), ("chris1", "A.", "ACRONYM1"), ("chris1", "U.S.", "ACRONYM"), ("chris1", "12-34", "DIGIT-DASH"),
    ("chris1", "Mid-90s", "CAPITALIZED-DIGIT-DASH"), ("chris1", "Win95", "CAPITALIZED-DIGIT"), ("chris1", "Jean-Luc", "CAPITALIZED-DASH"), ("chris1", "Hello", "CAPITALIZED"), ("chris1", "F-16", "ALLCAPS-DIGIT-DASH"), ("chris1", "B2", "ALLCAPS-DIGIT"), ("chris1", "X-Y", "ALLCAPS"), ("chris1", "IBM", "ALLCAPS"),
    ("chris1", "mid-90", "LOWERCASE-DIGIT-DASH"), ("chris1", "a1", "LOWERCASE-DIGIT"), ("chris1", "x-ray", "LOWERCASE-DASH"), ("chris1", "ray", "LOWERCASE"), ("chris1", "iPad2", "MIXEDCASE-DIGIT"), ("chris1", "iPhone", "MIXEDCASE"), ("chris1", "$5", "SYMBOL-DIGIT"), ("chris1", "...", "SYMBOL"), ("chris1", "", "SYMBOL"),
    ("chris2", "Abc", "Xxx"), ("chris2", "Abcdef", "Xxxxx"), ("chris2", "A1b2cd", "Xddxxx"), ("chris2", "xalphay", "xgx"), ("chris2", "a-b.c-d", "x-.x-x"),
    ("chris3", "Abcdef", "Xxxx"), ("chris3", "A1b2cd", "Xdxx"), ("chris3", "a-b.c-d", "x-.-x"),
    ("chris4", "Ab1", "Xxd"), ("chris4", "a%b€c!d", "x%$x.x"), ("chris4", "|", "+"), ("chris4", "日本", "Dc"), ("chris4", "«a»", "`x'"), ("chris4", "二一", "dc"),
    ("digits", "a12", "a99"),
]


def test_shapes(spark):
    for name, f in T.SHAPES.items():
        cases = [(w, want) for n, w, want in SHAPES if n == name]
        got = spark.createDataFrame([(i, w) for i, (w, _) in enumerate(cases)], "i int, w string").select("i", f(F.col("w"))).collect()
        assert cases and [r[1] for r in sorted(got)] == [want for _, want in cases], name


def test_known_words_are_marked(spark):
    assert one(spark, T.shape_dan2(F.col("c0"), F.lit(True)), "Word") == "WT-Xxk"
    assert one(spark, T.shape_dan2(F.col("c0"), F.lit(True)), "Wo1") == "WT-Xxd:3"
    assert one(spark, T.shape_chris2(F.col("c0"), F.lit(True)), "Wo") == "Xxk"


def test_occurrence_patterns(spark):
    text = "then Smith said that so and John Smith came . Mr Smith , Smith Jones left . The Smith was".split()
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(text)], "doc_id long, pos int, tok string")
    got = {}
    for r in context.occurrence_patterns(df).collect():
        got.setdefault(r["pos"], set()).add(r["pattern"])
    none = {"NO-OCCURRENCE-PATTERN"}
    # 1: after a small word; then met after John (YX), after Mr (YX), before Jones (XY), after The (YX)
    assert got[1] == {"X-NEXT-OCCURRENCE-YX", "X-NEXT-OCCURRENCE-XY"}
    # 7: John Smith; ahead at 11 (Mr), 13 (","), 18 (The): the word alone; behind at 1: alone
    assert got[7] == {"XY-NEXT-OCCURRENCE-Y", "XY-PREV-OCCURRENCE-Y"}
    assert got[18] == {"XY-PREV-OCCURRENCE-Y"}
    assert got[11] == got[13] == got[0] == got[19] == none and 14 not in got  # Jones: nothing else to meet
    assert got[6] == none  # John stands before a capital


def test_occurrences_met_as_a_pair(spark):
    text = "see Ann Lee now or a x b Ann Lee again".split()
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(text)], "doc_id long, pos int, tok string")
    got = {(r["pos"], r["pattern"]) for r in context.occurrence_patterns(df).collect() if not r["pattern"].startswith("NO")}
    assert got == {(2, "XY-NEXT-OCCURRENCE-XY"), (9, "XY-PREV-OCCURRENCE-XY")}


def test_naive_bayes_by_hand(spark):
    f = spark.createDataFrame([(1, "a"), (1, "*"), (2, "a"), (2, "b"), (2, "*"), (3, "b"), (3, "*")], "example_id long, feature string")
    y = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "example_id long, label string")
    got = {(r["feature"], r["label"]): r["w"] for r in models.naive_bayes(f, y).collect()}
    # 7 active features, 5 with x; a: 2 of 2 with x; b: 1 of 2 each; * is always on
    want = {("a", "x"): np.log(3 / 4 / (5 / 7)), ("a", "y"): np.log(1 / 4 / (2 / 7)), ("b", "x"): np.log(2 / 4 / (5 / 7)), ("b", "y"): np.log(2 / 4 / (2 / 7)), ("*", "x"): np.log(2 / 3), ("*", "y"): np.log(1 / 3)}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-12 for k, v in want.items())
    plain = {(r["feature"], r["label"]): r["w"] for r in models.naive_bayes(f, y, always_on_is_prior=False).collect()}
    assert abs(plain["*", "x"] - np.log(3 / 5 / (5 / 7))) < 1e-12


def test_words_one_edit_apart(spark):
    words = ["cat", "cut", "cats", "at", "dog", "act", "coat", "é", "ê", "ab", "ba", "", "x"]
    got = {(r["x"], r["y"]): r["distance"] for r in sets.one_edit_pairs(spark.createDataFrame([(w,) for w in words], "w string").where("w <> ''"), "w").collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, z in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != z))
        return row[-1]

    words = [w for w in words if w]
    assert got == {(a, b): 1 for a in words for b in words if a < b and distance(a, b) == 1}


def test_batched_viterbi_as_one_by_one(spark):
    rng = np.random.default_rng(1)
    move = np.round(rng.normal(size=(3, 3)), 1)
    rows = [(i, np.round(rng.normal(size=(n, 3)), 1).tolist()) for i, n in enumerate([1, 7, 3, 0, 7, 20, 2, 1])]
    df = spark.createDataFrame(rows, "i long, emit array<array<double>>").repartition(2)
    got = {r["i"]: (r["path"], r["path_score"]) for r in models.decode_arrays(df, ["a", "b", "c"], move, cells=30).collect()}
    for i, emit in rows:
        path, score = models.viterbi_path(np.array(emit), move) if emit else (np.array([], int), 0.0)
        assert got[i][0] == ["abc"[k] for k in path] and abs(got[i][1] - score) < 1e-9


def test_running_numbers_and_sums(spark):
    df = spark.createDataFrame([(k * 7 % 100, k % 3) for k in range(100)], "k long, v long").repartition(5)
    got = sorted(map(tuple, sets.indexed(df, "k", sums={"s": F.col("v")}).select("k", "v", "ix", "s").collect()))
    assert [r[2] for r in got] == list(range(100)) and [r[3] for r in got] == np.cumsum([r[1] for r in got]).tolist()
    assert sets.indexed(df.where("false"), "k").count() == 0


def test_relations_without_pairs(spark):
    rng = np.random.default_rng(2)
    make = lambda n: [(int(d), "T", int(b), int(b + w)) for d, b, w in zip(rng.integers(0, 3, n), rng.integers(0, 300, n), rng.integers(1, 90, n), strict=True)]
    a, b = (spark.createDataFrame(make(60), "doc_id long, type string, begin_pos long, end_pos long") for _ in range(2))
    want = {r["relation"]: r["n"] for r in spans.related(a, b).groupBy("relation").agg(F.count("*").alias("n")).collect()}
    assert {r["relation"]: r["n"] for r in spans.relation_counts(a, b).collect()} == want and {"BEFORE", "AFTER", "OVERLAP"} <= set(want)


def test_split_quoted_and_values(spark):
    assert one(spark, T.split_quoted(F.col("c0")), 'a,"b,c",d') == ["a", "b,c", "d"]
    assert one(spark, T.value_split(F.col("c0"), "[0-9]+", ";"), "1;22;3") == ["1", "22", "3"]
    assert one(spark, T.value_split(F.col("c0"), "[0-9]+", ";"), "1;;3") is None
    assert one(spark, T.nth_index(F.col("c0"), ".", 2), "a.b.c") == 3
    assert one(spark, T.nth_index(F.col("c0"), ".", 3), "a.b.c") == -1


def test_lcs(spark):
    df = spark.createDataFrame([("abcbdab", "bdcaba"), ("", "x")], "a string, b string")
    assert [r[0] for r in df.select(T.common_subsequence_udf()("a", "b")).collect()] == [4, 0]
    assert [r[0] for r in df.select(T.common_substring_udf()("a", "b")).collect()] == [2, 0]


def test_gap_codes_round_trip(spark):
    xs = [3, 7, 8, 20]
    df = spark.createDataFrame([(xs,)], "x array<long>")
    assert df.select(T.gap_decode(T.gap_encode(F.col("x")))).first()[0] == xs


def test_counter_divergences(spark):
    a = spark.createDataFrame([("x", 3), ("y", 1)], "k string, n long")
    b = spark.createDataFrame([("x", 1), ("y", 1)], "k string, n long")
    kl = counters.kl(a, b).first()[0]
    assert abs(kl - (0.75 * np.log2(1.5) + 0.25 * np.log2(0.5))) < 1e-12
    assert counters.kl(a, b.where("k = 'x'")).first()[0] == float("inf")
    assert counters.equal(a, a).first()[0] and not counters.equal(a, b).first()[0]
    empty = a.where("false")
    assert counters.jaccard(empty, empty).first()[0] is None
    assert counters.cosine(a, empty).first()[0] == 0


def test_smoothing_sums_to_one(spark):
    c = spark.createDataFrame([(f"w{i}", n) for i, n in enumerate([1] * 20 + [2] * 8 + [3] * 4 + [10])], "k string, n long")
    for d in (distributions.absolute_discount(c, 0.5), distributions.good_turing(c, 1000), distributions.lidstone(c, 1000, 0.1), distributions.relative(c, 0.2)):
        p, r = d.agg(F.sum("p"), F.max("reserved")).first()
        assert abs(p + r - 1) < 1e-9


LABELS = ["O", "B-PER", "I-PER", "B-PER", "O", "B-LOC", "I-LOC", "I-LOC"]


def labelled(spark, labels):
    return spark.createDataFrame([(1, i, f"t{i}", y) for i, y in enumerate(labels)], "doc_id long, pos int, tok string, label string")


def test_encodings_round_trip(spark):
    df = labelled(spark, LABELS)
    for scheme in ("IOB1", "IOB2", "IOE1", "IOE2", "SBIEO"):
        coded = spans.encode(df, scheme).select("doc_id", "pos", "tok", F.col("coded").alias("label"))
        back = spans.encode(coded, "IOB2").orderBy("pos")
        assert [r["coded"] for r in back.collect()] == LABELS, scheme


def test_chunks_keep_neighbours_apart(spark):
    got = [(r["type"], r["begin_pos"], r["end_pos"]) for r in spans.chunks(labelled(spark, LABELS)).orderBy("begin_pos").collect()]
    assert got == [("PER", 1, 3), ("PER", 3, 4), ("LOC", 5, 8)]


def test_last_run_is_flushed(spark):
    assert spans.chunks(labelled(spark, ["O", "PER"])).count() == 1


def test_merge_rules():
    o = "O"
    assert merge.longest(list("AAOO"), [o, "B", "B", o]) == list("AAOO")
    assert merge.longest(["A", "A", o, o], ["B", "B", "B", o]) == ["B", "B", "B", o]
    assert merge.longest([o, o, "A", "A"], ["B", o, o, o]) == ["B", o, "A", "A"]
    assert merge.longest([], []) == []
    assert merge.longest([o, o], ["B", "B"]) == ["B", "B"]


def test_list_priority(spark):
    toks = spark.createDataFrame([(1, i, w) for i, w in enumerate("New York City hall".split())], "doc_id long, pos int, tok string")
    gaz = spark.createDataFrame([("CITY", "New York", 2.0), ("PLACE", "New York City", 2.0), ("HALL", "City hall", 1.0)], "type string, phrase string, priority double")
    got = {r["pos"]: r["label"] for r in gazetteer.list_labels(toks, gaz, [2, 3]).collect()}
    assert got == {0: "PLACE", 1: "PLACE", 2: "HALL", 3: "HALL"}


def test_quotes_inside_a_match(spark):
    toks = spark.createDataFrame([(1, i, w) for i, w in enumerate(["firm", '"', "Big", '"', "Ltd"])], "doc_id long, pos int, tok string")
    gaz = spark.createDataFrame([("ORG", "firm Big Ltd", 1.0)], "type string, phrase string, priority double")
    got = {r["pos"]: r["label"] for r in gazetteer.list_labels(toks, gaz, [3]).collect()}
    assert set(got.values()) == {"ORG"}


def test_scores_without_entities(spark):
    df = labelled(spark, ["O", "O"]).select("doc_id", "pos", "tok", F.col("label").alias("gold"), F.col("label").alias("guess"))
    assert evaluate.entity_scores(df).where("type <> 'Totals'").count() == 0


def brute_paths(emit, move):
    import itertools

    n, k = emit.shape
    return sorted(((sum(emit[t, p[t]] for t in range(n)) + sum(move[p[t], p[t + 1]] for t in range(n - 1)), p) for p in itertools.product(range(k), repeat=n)), key=lambda x: (-x[0], x[1]))


def test_decoders_against_all_paths():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5):
        emit, move = rng.normal(size=(n, 3)), rng.normal(size=(3, 3))
        every = brute_paths(emit, move)
        assert abs(models.viterbi_path(emit, move)[1] - every[0][0]) < 1e-9
        assert abs(models.beam_path(emit, move, 100)[1] - every[0][0]) < 1e-9
        assert [round(s, 9) for _, s in models.k_best_paths(emit, move, 3)] == [round(s, 9) for s, _ in every[:3]]
        z = np.log(sum(np.exp(s) for s, _ in every))
        want = np.zeros((n, 3))
        for s, p in every:
            want[np.arange(n), list(p)] += np.exp(s - z)
        assert np.allclose(models.marginals(emit, move), want)


def test_viterbi_takes_the_earliest_predecessor():
    assert models.viterbi_path(np.zeros((3, 2)), np.zeros((2, 2)))[0].tolist() == [0, 0, 0]


def test_crf_gradient_is_the_derivative():
    rng = np.random.default_rng(1)
    emit, move, gold = rng.normal(size=(4, 3)), rng.normal(size=(3, 3)), np.array([0, 2, 1, 1])
    _, g, h = models.crf_gradient(emit, move, gold)
    for i in (0, 2):
        e = emit.copy()
        e[i, 1] += 1e-5
        assert abs((models.crf_gradient(e, move, gold)[0] - models.crf_gradient(emit, move, gold)[0]) / 1e-5 - g[i, 1]) < 1e-3
    m = move.copy()
    m[0, 2] += 1e-5
    assert abs((models.crf_gradient(emit, m, gold)[0] - models.crf_gradient(emit, move, gold)[0]) / 1e-5 - h[0, 2]) < 1e-3


def test_lbfgs_and_golden_section():
    assert np.allclose(models.lbfgs(lambda x: (((x - 3) ** 2).sum(), 2 * (x - 3)), np.zeros(4)), 3, atol=1e-5)
    assert abs(models.golden_section(lambda x: (x - 1.5) ** 2, 0, 4) - 1.5) < 1e-4


def test_maxent_learns(spark):
    f = spark.createDataFrame([(i, "a" if i % 2 else "b") for i in range(20)], "example_id long, feature string")
    y = spark.createDataFrame([(i, "1" if i % 2 else "0") for i in range(20)], "example_id long, label string")
    w = {(r["feature"], r["label"]): r["w"] for r in models.train_maxent(f, y, rounds=4).collect()}
    assert w["a", "1"] > w["a", "0"] and w["b", "0"] > w["b", "1"]


TREE = "(S (NP (D the) (N cat)) (VP (V saw) (NP (D a) (N dog))))"


def test_tree_round_trip_and_relations(spark):
    nodes = trees.from_brackets(spark.createDataFrame([(1, TREE)], "tree_id long, tree string"))
    assert trees.to_brackets(nodes).first()["tree"] == TREE
    count = lambda head, *terms: trees.search(nodes, head, *terms).count()
    assert count("NP", ("<<", "dog", "x")) == 1
    assert count("S", ("<<", "NP", "x")) == 2
    assert count("NP", ("$..", "VP", "x")) == 1
    assert count("NP", ("!>", "S", "x")) == 1
    assert count("NP", ("<1", "D", "x")) == 2
    assert count("NP", ("<-1", "N", "x")) == 2
    assert count("VP", (",", "NP", "x")) == 1
    assert trees.constituents(nodes).count() == 9


def test_tree_edits():
    n = trees.build(TREE)
    assert str(trees.edit(n, "D", "prune")) == "(S (NP (N cat)) (VP (V saw) (NP (N dog))))"
    assert str(trees.edit(trees.build(TREE), "VP", "excise")) == "(S (NP (D the) (N cat)) (V saw) (NP (D a) (N dog)))"
    assert str(trees.edit(trees.build("(A (B c))"), "B", "relabel", "X")) == "(A (X c))"
    assert trees.edit(trees.build("(A b)"), "A", "delete") is None


def test_column_readers(spark):
    text = "﻿A\tO\r\nB\tPER\r\n\r\n\r\nC\tO\n"
    df = spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string")
    got = [(r["doc_id"], r["sent_id"], r["pos"], r["word"], r["answer"]) for r in readers.conll(df).orderBy("doc_id", "sent_id", "pos").collect()]
    assert got == [(1, 0, 0, "A", "O"), (1, 0, 1, "B", "PER"), (1, 1, 0, "C", "O")]


def test_conllx_reads_what_it_should(spark):
    line = "1\tRīga\tRīga\tn\tnpfsn\tcase=n|number=s\t0\troot\tlocation"
    df = spark.createDataFrame([(1, line)], "doc_id long, text string")
    r = readers.conllx(df).withColumn("m", T.feature_map(F.col("feats"))).first()
    assert (r["idx"], r["word"], r["tag"], r["gold"], r["m"]) == (1, "Rīga", "n", "location", {"case": "n", "number": "s"})
    with pytest.raises(Exception, match="too few"):
        readers.conllx(spark.createDataFrame([(1, "1\ta\tb")], "doc_id long, text string")).collect()


def test_vertical_markup(spark):
    text = "<doc>\n<s>\na\tx\ta\n<g />\n.\tz\t.\n</s>\n<\tz\t<\n</s>"
    rows = readers.vertical(spark.createDataFrame([(1, text)], "doc_id long, text string")).where("not markup").orderBy("line_no").collect()
    assert [(r["sent_id"], r["tok"], r["glue"]) for r in rows] == [(0, "a", False), (0, ".", True), (1, "<", False)]


def test_rule_lines(spark):
    df = spark.createDataFrame([("ORG\tBig Ltd",), ("LOC\tRiga\tO,MISC\t2.5",), ("PER\tAnn\t3",)], "value string")
    got = {r["type"]: (r["overwritable"], r["priority"]) for r in readers.rules(df).collect()}
    assert got == {"ORG": (None, 1.0), "LOC": (["O", "MISC"], 2.5), "PER": (None, 3.0)}


def test_ordered_writer_skips_nulls(spark):
    df = spark.createDataFrame([(2, "b"), (1, None), (0, "a")], "line_no int, line string")
    assert [r["line"] for r in writers.in_order(df).collect()] == ["a", "b"]


def test_folds_and_index(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    sizes = [r["count"] for r in sets.folds(df, "k", 4).groupBy("fold").count().orderBy("fold").collect()]
    assert sizes == [3, 3, 2, 2]
    assert [r["ix"] for r in sets.indexed(df, "k").orderBy("k").collect()] == list(range(10))


def test_power_set_and_sub_list(spark):
    df = spark.createDataFrame([(["a", "b"], ["x", "a", "b"])], "s array<string>, b array<string>")
    r = df.select(sets.power_set(F.col("s")), sets.is_sub_list(F.col("s"), F.col("b")), sets.is_sub_list(F.col("b"), F.col("s"))).first()
    assert sorted(map(tuple, r[0])) == [(), ("a",), ("a", "b"), ("b",)] and r[1] and not r[2]


def test_readings_and_inflection(spark):
    lex = spark.createDataFrame([("roku", "n", "roka", 0.4), ("roku", "v", "rakt", 0.6)], "form string, tag string, lemma string, estimate double")
    t = spark.createDataFrame([("roku",), ("zz",)], ["tok"])
    got = {r["tok"]: r["best"] for r in morphology.best_reading(morphology.readings(t, lex)).collect()}
    assert got["roku"]["lemma"] == "rakt" and got["zz"] is None
    p = spark.createDataFrame([("Jānis", "genitive", "Jāņa"), ("Bērziņš", "genitive", "Bērziņa")], "lemma string, slot string, form string")
    f = morphology.inflect(spark.createDataFrame([(1, "Jānis Bērziņš", "person")], "phrase_id long, phrase string, category string"), p).first()["forms"]
    assert f["genitive"] == "Jāņa Bērziņa" and f["dative"] == "Jānis Bērziņš"


def test_sentence_assembly(spark, tmp_path):
    from glossa.streaming import streams

    spark.createDataFrame([(1, 0, "a"), (1, 1, "</s>"), (1, 2, "b")], "doc_id long, line_no long, line string").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("doc_id long, line_no long, line string").parquet(str(tmp_path / "in"))
    got = streams.drain(streams.sentences(s), "append").collect()
    assert [(r["sentence"], r["lines"]) for r in got] == [(0, "a\n</s>")]


def test_results_do_not_hang_on_partitioning(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    count = lambda d: sorted(map(tuple, context.occurrence_patterns(context.tokenise(d)).groupBy("pattern").count().collect()))
    assert count(docs.repartition(1)) == count(docs.repartition(17))


def test_lcs_of_whole_texts(spark, tmp_path):
    import random

    from glossa.plans import catalogue

    def by_hand(x, y):
        row, run, best = [0] * (len(y) + 1), [0] * (len(y) + 1), 0
        for c in x:
            row, old, run, last = [0] * (len(y) + 1), row, [0] * (len(y) + 1), run
            for j, d in enumerate(y, 1):
                row[j] = old[j - 1] + 1 if c == d else max(old[j], row[j - 1])
                run[j] = last[j - 1] + 1 if c == d else 0
            best = max(best, *run)
        return row[-1], best

    r = random.Random(5)
    texts = ["".join(r.choice("abé😀 ") for _ in range(n)) for n in (300, 700, 1, 90)]
    texts += ["", "x" * 70 + "tail", "y" * 70 + "tail", *("".join(r.choice("abcd") for _ in range(n)) for n in (150, 4500))]  # the last has more than one block
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {x[0]: tuple(x[1:]) for x in catalogue.QUERIES["lcs_lengths"](spark, str(tmp_path)).collect()}
    assert got == {k: by_hand(texts[k], texts[k + 1]) for k in range(len(texts) - 1)} and got[5] == (4, 4)


def test_sentences_are_written_in_place_as_from_token_tables(spark, sf):
    """Writers over rows of sentences give the lines they give over tokens; sentence_formats shuffles nothing."""
    from glossa.plans import catalogue

    rows = [(1, 0, [("a & b", "x", None), ("<c>", None, 'l"')]), (1, 1, [("D", "y", "d")]), (None, 0, [("é", "z", "e")])]
    s = spark.createDataFrame(rows, "doc_id long, sent_id int, w array<struct<tok:string,tag:string,lemma:string>>")
    s = s.select("doc_id", "sent_id", F.transform("w", lambda x, i: F.struct(i.alias("pos"), x["tok"].alias("tok"), x["tag"].alias("tag"), x["lemma"].alias("lemma"))).alias("words"))
    tokens = s.select("doc_id", "sent_id", F.inline("words"))
    for write in (writers.xml_words, writers.lower, writers.tf_json, lambda d: writers.wi_xml(d, label="tag")):
        lines = [sorted(map(repr, (tuple(r) for r in write(d).select("doc_id", "sent_id", "line").collect()))) for d in (s, tokens)]
        assert lines[0] == lines[1] and len(lines[0]) == 3
    plan = catalogue.QUERIES["sentence_formats"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_trees_searched_in_place_as_by_joins(spark, sf):
    """search_texts gives the matches of search for every relation; tree_sisters shuffles only its counts."""
    from glossa.plans import catalogue

    texts = ["(ROOT (S (NP (DT The) (JJ old) (NN man)) (VP (MD will) (VP (VB give) (NP (PRP her)) (PP (IN in) (NP June)))) (. .)))", "(A (B b) (B (A b) c)) (A x)", "(A", "", "(A a a a)"]
    df = spark.createDataFrame([*enumerate(texts), (9, None), (None, "(A a a)")], "tree_id long, tree string").coalesce(1)
    nodes = trees.from_brackets(df.where("tree_id is not null")).cache()
    for op in trees.RELATIONS:
        for head, pattern in (("__", "__"), ("@NP|A|B", "/^[A-Nb]/")):
            term = (op, pattern, "x")
            lists = [sorted(tuple(r) for r in d.select("tree_id", "r", "x").collect()) for d in (trees.search_texts(df, head, term), trees.search(nodes, head, term))]
            assert lists[0] == lists[1], op
    got = trees.search_texts(df, "NP", ("<", "__", "x"), ("$.", "NN", "y", "x")).select("tree_id", "r_label", "x_label", "y_label").collect()
    assert [tuple(r) for r in got] == [(0, "NP", "JJ", "NN")]
    with pytest.raises(ValueError):
        trees.search_texts(df, "A", ("!<", "__", "x"))
    plan = catalogue.QUERIES["tree_sisters"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
