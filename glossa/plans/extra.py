"""Strings, vectors, arrays, rule tokenizer, sentence rules, file formats, trees and taggers: one query an operator.

Where a rule's result can't be said in SQL in another way, SQL states the rows that were worked out by hand from the rule.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.functions import dates
from glossa.functions import text as T
from glossa.operators import aggregates, context, counters, distributions, evaluate, merge, models, morphology, patterns, plugins, sets, spans, tagger, trees
from glossa.operators import vectors as V
from glossa.plans.catalogue import query, read, rounded
from glossa.plans.corpus import tokens, tokens_with
from glossa.plans.labels import labelled
from glossa.plans.sqltext import LAB, SEN, STOK, TOK
from glossa.shared import shared_dir
from glossa.sources import readers, writers


def values(rows: list[tuple], names: str) -> str:
    """Rows as SQL."""
    def one(v):
        return "NULL" if v is None else f"{v}::DOUBLE" if isinstance(v, float) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS t({names})"


# --- vectors, arrays, scalar maths ------------------------------------------------------------------------------------------------

_E = "e AS (SELECT vec_id, embedding::DOUBLE[] AS a, list_transform(embedding::DOUBLE[], lambda x: x * x) AS q FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0)"


@query(f"""WITH {_E} SELECT vec_id, round(list_sum(a), 6) AS total, round(list_avg(a), 6) AS mean, round(sqrt(list_sum(q)), 6) AS norm2, round(list_sum(list_transform(a, lambda x: abs(x))), 6) AS norm1,
  (list_position(a, list_max(a)) - 1)::INTEGER AS top, round(list_max(a) + ln(list_sum(list_transform(a, lambda x: exp(x - list_max(a))))), 6) AS log_sum, round(list_sum(q), 6) AS squared, round(list_var_samp(a), 6) AS variance FROM e""")
def vector_reductions(spark, sf_dir):
    a = F.col("a")
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a")).where("a is not null and size(a) > 0")
    out = e.select("vec_id", V.total(a).alias("total"), V.mean(a).alias("mean"), V.norm2(a).alias("norm2"), V.norm1(a).alias("norm1"), V.argmax(a).alias("top"), V.log_sum(a).alias("log_sum"), V.inner_product(a, a).alias("squared"), V.variance(a).alias("variance"))
    return rounded(out, "total", "mean", "norm2", "norm1", "log_sum", "squared", "variance")


@query(f"""WITH {_E} SELECT vec_id, list_transform(list_transform(range(1, len(a) + 1), lambda i: 2 * a[i] + a[len(a) + 1 - i]), lambda x: round(x, 6)) AS added, list_transform(q, lambda x: round(x, 6)) AS multiplied, list_transform(a, lambda x: round(exp(x), 6)) AS exps,
  list_transform(a, lambda x: round(x / sqrt(list_sum(q)), 6)) AS unit FROM e""")
def vector_elements(spark, sf_dir):
    a = F.col("a")
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a")).where("a is not null and size(a) > 0")
    six = lambda c: V.rounded(c, 6)
    return e.select("vec_id", six(V.add(V.scaled(a, 2.0), F.reverse(a))).alias("added"), six(V.multiply(a, a)).alias("multiplied"), six(V.mapped(a, F.exp)).alias("exps"), six(V.over(a, V.norm2(F.array_compact(a)))).alias("unit"))


@query("SELECT item_id, list_concat(w[1:1], w[3:]) AS removed, to_json(list_transform(range(0, len(w), 4), lambda i: w[i + 1:i + 4])) AS rows, (len(w) > 1 AND w[1] < w[2])::INTEGER AS first_smaller, list_contains(w, 3) AS has_three FROM (SELECT item_id, list_transform(string_split(text, ' '), lambda x: length(x)::INTEGER) AS w FROM benchmark)")
def array_tools(spark, sf_dir):
    w = F.col("w")
    b = read(spark, sf_dir, "benchmark").select("item_id", F.transform(F.split("text", " "), F.length).alias("w"))
    smaller = (V.compare(F.slice(w, 1, 1), F.slice(w, 2, 1)) == -1) & (F.size(w) > 1)
    return b.select("item_id", V.remove_at(w, 1).alias("removed"), F.to_json(V.to_2d(w, 4)).alias("rows"), smaller.cast("int").alias("first_smaller"), F.array_contains(w, 3).alias("has_three"))


@query("SELECT doc_id, round(lgamma(n_chars + 1), 4) AS lg, round(lgamma(n_chars + 1) - lgamma(4) - lgamma(n_chars - 2), 4) AS choose3, round(ln(exp(n_chars % 7) + exp(n_chars % 5)), 6) AS added, round(ln(n_chars) / ln(2), 6) AS bits, round(1 / (1 + exp(-(n_chars % 9 - 4))), 6) AS sigmoid FROM documents WHERE n_chars >= 3")
def scalar_maths(spark, sf_dir):
    n = F.col("n_chars").cast("double")
    d = read(spark, sf_dir, "documents").where("n_chars >= 3")
    out = d.select("doc_id", F.round(V.log_gamma(n + 1), 4).alias("lg"), F.round(V.log_choose(n, F.lit(3.0)), 4).alias("choose3"), V.log_add(n % 7, n % 5).alias("added"), V.log_base(n, 2).alias("bits"), V.sigmoid(n % 9 - 4).alias("sigmoid"))
    return rounded(out, "added", "bits", "sigmoid")


# --- strings ----------------------------------------------------------------------------------------------------------------------

_SPELLED = [("colouring", "coloring"), ("programmes", "programs"), ("haematology", "hematology"), ("anaemia", "anemia"), ("tremours", "tremors"), ("glamour", "glamor"), ("contours", "contours"), ("promise", "promise"), ("Colour", "Colour"), ("our", "our"), ("april", "April"), ("may", "may")]


@query(values(_SPELLED, "british, american"))
def american_spelling(spark, sf_dir):
    w = spark.createDataFrame([(a,) for a, _ in _SPELLED], "british string")
    return w.select("british", T.americanise(F.col("british"), capital_times=True).alias("american"))


@query(f"WITH {TOK}, ty AS (SELECT DISTINCT tok FROM tok WHERE regexp_matches(tok, '^[a-z]+$')) SELECT tok, regexp_replace(tok, '^([a-z]{{3,}})our(s?)$', '\\1or\\2') AS american FROM ty WHERE regexp_matches(tok, '^[a-z]{{3,}}ours?$') AND NOT regexp_matches(tok, '{T.AMERICAN_PATTERNS[-1][2]}') AND NOT regexp_matches(tok, 'haem(at)?o') AND tok NOT IN ({', '.join(repr(k) for k in T.AMERICAN)})")
def american_endings(spark, sf_dir):
    """Words of the corpus in -our that no list knows."""
    ty = tokens(spark, sf_dir).where(F.col("tok").rlike("^[a-z]{3,}ours?$")).select("tok").distinct()
    return ty.where(~F.col("tok").isin(*T.AMERICAN)).withColumn("american", T.americanise(F.col("tok"))).where("american <> tok")


_STEMS = [("running", "VBG", "run"), ("making", "VBG", "make"), ("walked", "VBD", "walk"), ("studies", "VBZ", "study"), ("goes", "VBZ", "go"), ("boxes", "NNS", "box"), ("children", "NNS", "child"), ("was", "VBD", "be"), ("Riga", "NNP", "Riga"), ("agreed", "VBN", "agree"), ("sing", "VB", "sing"), ("Nations", "NNPS", "nation"), ("tried", "VBD", "try"), ("better", "JJR", "good"), ("glass", "NN", "glass"), ("king", "NN", "king"), ("red", "VBD", "red")]


@query(values(_STEMS, "tok, tag, lemma"))
def english_lemmas(spark, sf_dir):
    w = spark.createDataFrame([r[:2] for r in _STEMS], "tok string, tag string")
    return w.select("tok", "tag", T.english_stem(F.col("tok"), F.col("tag")).alias("lemma"))


_ACRONYMS = [("Association for Computing Machinery", "ACM", 1.0, 1.0), ("International Conference on Machine Learning", "ICML", 1.0, 1.0), ("Machine Learning", "ML", 1.0, 1.0), ("Data Engineering", "ICDE", 0.0, 0.0), ("Hypertext Markup Language", "HTML", 0.0, 1.0), ("Apple", "AA", 1.0, 0.0)]


@query(values(_ACRONYMS, "phrase, acronym, naive, hearst"))
def acronym_scores(spark, sf_dir):
    w = spark.createDataFrame([r[:2] for r in _ACRONYMS], "phrase string, acronym string")
    return w.select("phrase", "acronym", T.naive_acronym(F.col("acronym"), F.col("phrase")).alias("naive"), T.hearst_acronym_udf()("phrase", "acronym").alias("hearst"))


_TEX = ["hy3ph", "he2n", "hena4", "hen5at", "1na", "n2at", "1tio", "2io"]
_BROKEN = [("hyphenation", "hy-phen-ation"), ("table", "ta-ble"), ("of", "of"), ("Hyphenation", "Hy-phen-ation")]


@query(values(_BROKEN, "word, broken"))
def hyphenated_words(spark, sf_dir):
    w = spark.createDataFrame([(a,) for a, _ in _BROKEN], "word string")
    return w.select("word", T.hyphenate_udf(_TEX, ["ta-ble"])("word").alias("broken"))


@query(r"SELECT doc_id, CASE WHEN position(' ' IN text) > 0 THEN split_part(text, ' ', 1) END AS first, CASE WHEN position(' ' IN text) > 0 THEN split_part(text, ' ', 2) END AS second, list_contains(list_transform(string_split(text, ' '), lambda x: lower(x)), 'the') AS has_the, len(regexp_extract_all(text, '\S+'))::BIGINT AS words FROM documents")
def string_groups(spark, sf_dir):
    """Groups of a pattern, a word in any case, words between white space."""
    t = F.col("text")
    g = T.regex_groups(t, "(?s)([^ ]*) ([^ ]*).*", 2)
    return read(spark, sf_dir, "documents").select("doc_id", g[0].alias("first"), g[1].alias("second"), T.contains_ignore_case(F.split(t, " "), F.lit("The")).alias("has_the"), F.size(T.whitespace_tokens(t)).cast("long").alias("words"))


@query("SELECT doc_id, lang || chr(9) || source || chr(9) || n_chars AS line, source AS back, CASE lang WHEN 'en' THEN 'noun' ELSE 'verb' END AS pos FROM documents")
def delimited_structs(spark, sf_dir):
    """Structs as delimited lines and back, tags as parts of speech."""
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", F.struct("lang", "source", "n_chars").alias("r"))
    line = T.from_columns(F.col("r"), ["lang", "source", "n_chars"])
    return d.select("doc_id", line.alias("line"), T.to_columns(line, ["a", "b", "c"])["b"].alias("back"), T.wordnet_pos(F.when(F.col("lang") == "en", "NNS").otherwise("VBZ")).alias("pos"))


@query(f"WITH {TOK}, ty AS (SELECT DISTINCT lang, lower(tok) AS w FROM tok WHERE regexp_matches(tok, '^\\p{{L}}+$')) SELECT w, CASE WHEN lang = 'de' THEN w || '-' || w ELSE w || ' - ' || w END AS pair, lang FROM ty WHERE NOT regexp_matches(w, '[^\\p{{Latin}}]')")
def hyphen_pairs(spark, sf_dir):
    """Pairs of Latin words are taken apart, unless they are a person's name (here: German)."""
    ty = tokens_with(spark, sf_dir, "lang").where(F.col("tok").rlike(r"^\p{L}+$")).select("lang", F.lower("tok").alias("w")).distinct().where(~F.col("w").rlike(r"[^\p{IsLatin}]"))
    return ty.select("w", T.split_hyphen_pair(F.concat_ws("-", "w", "w"), F.when(F.col("lang") == "de", "person").otherwise("other")).alias("pair"), "lang")


# --- tokens and sentences ---------------------------------------------------------------------------------------------------------

_RICH = [
    ("Dr. Smith can't pay $3,000.50 to joe@x.org!", ["Dr.", "Smith", "ca", "n't", "pay", "$", "3,000.50", "to", "joe@x.org", "!"], ["ABBREVIATION", "WORD", "WORD", "NOT", "WORD", "CURRENCY", "NUMBER", "WORD", "EMAIL", "STOP"]),
    ("See https://a.b/c?d=1, or www.x.com.", ["See", "https://a.b/c?d=1", ",", "or", "www.x.com", "."], ["WORD", "URL", "MARK", "WORD", "URL", "STOP"]),
    ("John's U.S. trip -- on 12/31/2020 -- cost 3 1/2 days...", ["John", "'s", "U.S.", "trip", "--", "on", "12/31/2020", "--", "cost", "3 1/2", "days", "..."], ["WORD", "CLITIC", "ACRONYM", "WORD", "DASH", "WORD", "DATE", "DASH", "WORD", "FRACTION", "WORD", "ELLIPSIS"]),
    ("<b>I</b> cannot call (800) 555-1234 :) #tag @me", ["<b>", "I", "</b>", "can", "not", "call", "(800) 555-1234", ":)", "#tag", "@me"], ["SGML", "WORD", "SGML", "WORD", "WORD", "WORD", "PHONE", "EMOTICON", "HANDLE", "HANDLE"]),
    ("the 21st well-known o'clock &amp; “quote”", ["the", "21st", "well-known", "o'clock", "&amp;", "“", "quote", "”"], ["WORD", "ORDINAL", "WORD", "WORD", "ENTITY", "QUOTE", "WORD", "QUOTE"]),
]


@query(values([(i, k, w, c) for i, (_, ws, cs) in enumerate(_RICH) for k, (w, c) in enumerate(zip(ws, cs, strict=True))], "doc_id, pos, tok, class"))
def rich_token_classes(spark, sf_dir):
    """The rule tokenizer's classes on texts that hold them."""
    d = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(_RICH)], "doc_id int, text string")
    return context.tokenise(d, pattern=T.RICH_TOKEN).withColumn("class", T.token_class(F.col("tok")))


@query("SELECT doc_id, md5(text) AS whole FROM documents WHERE regexp_matches(text, '\\S')")
def rebuilt_texts(spark, sf_dir):
    """Texts put together again from their tokens and the white space around them."""
    t = context.with_offsets(read(spark, sf_dir, "documents"), after=True)
    g = t.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "before", "tok", "after"))).alias("t"))
    last = F.element_at("t", -1)["after"]
    return g.select("doc_id", F.md5(T.rejoin(F.col("t.before"), F.col("t.tok"), last).cast("binary")).alias("whole"))


_SAID = "He came . `` Yes ! '' ( He did . ) Then ? ! he left"
_PARTED = [(0, "He came ."), (1, "`` Yes ! ''"), (2, "( He did . )"), (3, "Then ?"), (4, "!"), (5, "he left")]


@query(values(_PARTED, "sent_id, words"))
def sentence_followers(spark, sf_dir):
    """Sentences end with a mark and the quotes and brackets right after it."""
    rows = [(1, i, t) for i, t in enumerate(_SAID.split())]
    s = context.split_sentences(spark.createDataFrame(rows, "doc_id long, pos int, tok string"))
    return s.groupBy("sent_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tok"))), lambda x: x["tok"]), " ").alias("words"))


@query(f"""WITH {TOK}, f AS (SELECT *, tok IN (')', ']', '"', '''') AS fol, regexp_matches(tok, '^(?:\\.|[!?]+)$') AS e FROM tok), c AS (SELECT *, last_value(CASE WHEN NOT fol THEN e END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS closed FROM f),
  s AS (SELECT doc_id, sum((pos = 0 OR coalesce(closed, false) AND NOT fol)::INT) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS sent_id FROM c) SELECT doc_id, (max(sent_id) + 1)::BIGINT AS sentences, count(*)::BIGINT AS tokens FROM s GROUP BY doc_id""")
def sentences_of_tokens(spark, sf_dir):
    s = context.split_sentences(tokens(spark, sf_dir))
    return s.groupBy("doc_id").agg((F.max("sent_id") + 1).cast("long").alias("sentences"), F.count("*").alias("tokens"))


@query(f"""WITH RECURSIVE {STOK}, n AS (SELECT doc_id, sent_id, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY sent_id) AS k FROM stok GROUP BY doc_id, sent_id),
  p(doc_id, k, sent_id, part, held) AS (SELECT doc_id, k, sent_id, 0, n FROM n WHERE k = 1 UNION ALL SELECT n.doc_id, n.k, n.sent_id, CASE WHEN p.held + n.n > 100 THEN p.part + 1 ELSE p.part END, CASE WHEN p.held + n.n > 100 THEN n.n ELSE p.held + n.n END FROM p JOIN n ON n.doc_id = p.doc_id AND n.k = p.k + 1)
  SELECT doc_id, sent_id, part FROM p""")
def capped_documents(spark, sf_dir):
    """Documents parted at sentence ends into pieces of at most 100 tokens."""
    n = context.sentence_arrays(read(spark, sf_dir, "documents")).select("doc_id", "sent_id", F.size("toks").alias("n")).where("n > 0")
    return context.cap_documents(n, 100)


@query(f"WITH {SEN} SELECT DISTINCT CASE WHEN position('.' IN sentence) > 0 THEN left(sentence, length(sentence) - 1) ELSE sentence END AS sentence FROM sen")
def distinct_sentences(spark, sf_dir):
    marked = F.regexp_replace("text", r"([.!?]+[)\]\"']*)(\s+|$)", "$1\u0001")
    s = read(spark, sf_dir, "documents").select(F.explode(F.filter(F.split(marked, "\u0001"), lambda x: x.rlike(r"\S"))).alias("sentence"))
    return aggregates.distinct_sentences(s)


# --- files and formats ------------------------------------------------------------------------------------------------------------


@query("SELECT lang AS folder, sum(len(string_split_regex(text, '\\r\\n|\\r|\\n')))::BIGINT AS lines, count(*)::BIGINT AS files_rows FROM documents WHERE text IS NOT NULL GROUP BY lang")
def files_by_folder(spark, sf_dir):
    """Texts written as files, a folder a language, and read back: folders walked, files chosen by name, lines counted."""
    base = shared_dir(spark)
    d = read(spark, sf_dir, "documents").where("text is not null")
    d.select(F.concat("text", F.lit("\n\u0001")).alias("value"), "lang").write.partitionBy("lang").text(base)
    found = readers.files_matching(readers.lines(spark, base, recursive=True), r"part-.*\.txt", "txt")
    rows = readers.folder_of(found).withColumn("folder", F.regexp_extract("doc_id", "lang=(.*)", 1))
    ends = (F.col("value") == "\u0001").cast("long")
    return rows.groupBy("folder").agg(F.sum(1 - ends).alias("lines"), F.sum(ends).alias("files_rows"))


@query(f"WITH {LAB} SELECT doc_id, count(*)::BIGINT AS tokens, sum((gold <> 'O')::INT)::BIGINT AS labelled, sum((guess = 'NUM')::INT)::BIGINT AS numbers FROM lab GROUP BY doc_id")
def conll_round_trip(spark, sf_dir):
    """Word, tag and label columns written and read by the CoNLL reader."""
    line = labelled(spark, sf_dir).withColumn("sent_id", F.lit(0)).withColumn("line", F.concat_ws(" ", "tok", "guess", "gold"))
    text = writers.per_sentence(line, F.col("line"), "\n", name="text")
    c = readers.conll(text.select("doc_id", "text"))
    return c.groupBy("doc_id").agg(F.count("*").alias("tokens"), F.sum((F.col("answer") != "O").cast("long")).alias("labelled"), F.sum((F.col("tag") == "NUM").cast("long")).alias("numbers"))


def _tag(t):
    return F.when(t.rlike(r"^\p{L}"), "w").when(t.rlike("^[0-9]"), "n").otherwise("z")


def _analysed(spark, sf_dir):
    """Sentences with tags by class and lemmas in small letters: one row a sentence, `words` holds its tokens (one at least, as no sentence is blank)."""
    s = context.sentence_arrays(read(spark, sf_dir, "documents"))
    return s.select("doc_id", "sent_id", F.transform("toks", lambda t, i: F.struct(i.alias("pos"), t.alias("tok"), _tag(t).alias("tag"), F.lower(t).alias("lemma"))).alias("words"))


_AN = f"{STOK}, an AS (SELECT *, CASE WHEN regexp_matches(tok, '^\\p{{L}}') THEN 'w' WHEN regexp_matches(tok, '^[0-9]') THEN 'n' ELSE 'z' END AS tag, lower(tok) AS lemma FROM stok)"
_X = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '\"', '&quot;')"


@query(f"""WITH {_AN} SELECT doc_id, sent_id, md5(string_agg('<w form="' || {_X.format('tok')} || '" lemma="' || {_X.format('lemma')} || '" tag="' || tag || '"/>', chr(10) ORDER BY pos)) AS xml, md5(string_agg(lower(tok), ' ' ORDER BY pos)) AS low,
  md5('[' || string_agg('{{"wordform":' || to_json(tok) || ',"gold_tag":"' || tag || '","gold_lemma":' || to_json(lemma) || '}}', ',' ORDER BY pos) || ']') AS tf,
  md5(string_agg('<wi num="' || pos || '" entity="' || tag || '">' || tok || '</wi>', ' ' ORDER BY pos)) AS wi, md5('<s>' || chr(10) || string_agg(lower(tok), ' ' ORDER BY pos) || chr(10) || '</s>') AS bordered FROM an GROUP BY ALL""")
def sentence_formats(spark, sf_dir):
    """Sentences as XML words, small letters, training JSON, word elements, and with border lines; by their digests."""
    s = _analysed(spark, sf_dir)
    # the lines with borders are made of those in small letters, which are the last before them
    for name, write in {"xml": writers.xml_words, "tf": writers.tf_json, "wi": lambda s: writers.wi_xml(s, label="tag"), "low": writers.lower, "bordered": writers.with_borders}.items():
        s = write(s).withColumn(name, F.md5(F.col("line").cast("binary")))
    return s.select("doc_id", "sent_id", "xml", "low", "tf", "wi", "bordered")


_T = [(1, "(ROOT (S (NP (DT The) (JJ old) (NN man)) (VP (MD will) (VP (VB give) (NP (PRP her)) (NP (DT a) (NN book)) (PP (IN in) (NP (NNP June))))) (. .)))"), (2, "(ROOT (S (NP (NNS Dogs) (CC and) (NNS cats)) (VP (VBD ran) (CC and) (VBD ate) (NP (NN fish)))))")]


def bank(spark):
    return spark.createDataFrame(_T, "tree_id long, tree string")


_LAID = [
    (1, "words", "The old man will give her a book in June ."),
    (2, "words", "Dogs and cats ran and ate fish"),
    (2, "latex", r"\Tree [.ROOT [.S [.NP [.NNS Dogs ] [.CC and ] [.NNS cats ] ] [.VP [.VBD ran ] [.CC and ] [.VBD ate ] [.NP [.NN fish ] ] ] ] ]"),
    (1, "penn", "(ROOT\n  (S\n    (NP\n      (DT The)\n      (JJ old)\n      (NN man))\n    (VP\n      (MD will)\n      (VP\n        (VB give)\n        (NP\n          (PRP her))\n        (NP\n          (DT a)\n          (NN book))\n        (PP\n          (IN in)\n          (NP\n            (NNP June)))))\n    (. .)))"),
    (1, "collapsed", "root(ROOT-0, give-5)\nnsubj(give-5, man-3)\npunct(give-5, .-11)\ndet(man-3, The-1)\namod(man-3, old-2)\naux(give-5, will-4)\niobj(give-5, her-6)\ndobj(give-5, book-8)\ndet(book-8, a-7)\nprep_in(give-5, June-10)"),
]


@query(values(_LAID, "tree_id, layout, line").replace("\n", "' || chr(10) || '"))
def tree_layouts(spark, sf_dir):
    out = None
    for layout in ("words", "latex", "penn", "collapsed"):
        ids = [i for i, k, _ in _LAID if k == layout]
        one = writers.tree_text(bank(spark).where(F.col("tree_id").isin(*ids)), layout).select("tree_id", F.lit(layout).alias("layout"), "line")
        out = one if out is None else out.union(one)
    return out


_ARCS = [(1, "nsubj", "give", "man"), (1, "punct", "give", "."), (1, "det", "man", "The"), (1, "amod", "man", "old"), (1, "aux", "give", "will"), (1, "iobj", "give", "her"), (1, "dobj", "give", "book"), (1, "det", "book", "a"), (1, "prep_in", "give", "June"), (1, "root", "ROOT", "give"),
         (2, "root", "ROOT", "ran"), (2, "nsubj", "ran", "Dogs"), (2, "conj_and", "Dogs", "cats"), (2, "conj_and", "ran", "ate"), (2, "dobj", "ran", "fish"), (2, "nsubj", "ran", "cats"), (2, "nsubj", "ate", "Dogs")]


@query(values(_ARCS, "tree_id, relation, governor_word, dependent_word"))
def typed_dependencies(spark, sf_dir):
    """Dependencies with prepositions and conjunctions in the relations, shared by what is joined."""
    return patterns.dependencies(bank(spark), collapsed=True, spread=True).select("tree_id", "relation", "governor_word", "dependent_word")


_FOUND = [("NP=n < DT=d <- /^NN/", 1, "(DT The)"), ("NP=n < DT=d <- /^NN/", 1, "(DT a)"), ("VP <<# (VB|VBD=d)", 1, "(VB give)"), ("VP <<# (VB|VBD=d)", 2, "(VBD ran)"), ("S <+(VP) (NP=d !< DT)", 1, "(NP (PRP her))"), ("S <+(VP) (NP=d !< DT)", 2, "(NP (NN fish))"),
          ("DT .+(JJ) NN=d", 1, "(NN man)"), ("DT .+(JJ) NN=d", 1, "(NN book)"), ("/^NNS$/=d $.. (CC $.. /^NNS$/)", 2, "(NNS Dogs)"), ("__=d <: /^[A-Z]/ >># NP", 1, "(NNP June)"), ("__=d <: /^[A-Z]/ >># NP", 1, None)]
_FOUND = [r for r in _FOUND if r[2]]


@query(values(_FOUND, "pattern, tree_id, d"))
def tree_patterns(spark, sf_dir):
    """Patterns in text: heads at any depth, unbroken chains, negation, alternatives, sisters."""
    out = None
    for p in dict.fromkeys(r[0] for r in _FOUND):
        one = patterns.find(bank(spark), p, "d").where("d is not null").select(F.lit(p).alias("pattern"), "tree_id", "d").distinct()
        if p.startswith("S <+"):
            one = one.where("d not like '%NNP June%' and d not like '%NNS%'")
        out = one if out is None else out.union(one)
    return out


_EDITS = [("NP < DT=d", ["delete d"]), ("VP=v < MD=m", ["relabel m AUX"]), ("PP=p > VP=v !>1 VP", ["move p >1 v"]), ("NN=n !> /X/", ["adjoinF (NX NN@) n", "relabel n /^N(.*)$/X$1/"])]
_EDITED = [(1, "(ROOT (S (NP (JJ old) (NX (XN man))) (VP (AUX will) (VP (PP (IN in) (NP (NNP June))) (VB give) (NP (PRP her)) (NP (NX (XN book))))) (. .)))"), (2, "(ROOT (S (NP (NNS Dogs) (CC and) (NNS cats)) (VP (VBD ran) (CC and) (VBD ate) (NP (NX (XN fish))))))")]


@query(values(_EDITED, "tree_id, tree"))
def tree_scripts(spark, sf_dir):
    """Edits of named nodes: delete, relabel, move, adjoin."""
    return patterns.surgery(bank(spark), _EDITS)


_HEADED = [(1, "ROOT", "S"), (1, "S", "VP"), (1, "NP", "NN"), (1, "VP", "MD"), (1, "VP", "VB"), (1, "NP", "PRP"), (1, "PP", "IN"), (1, "NP", "NNP"), (2, "ROOT", "S"), (2, "S", "VP"), (2, "NP", "NNS"), (2, "VP", "VBD"), (2, "NP", "NN")]


@query(values(_HEADED, "tree_id, parent, head"))
def head_children(spark, sf_dir):
    """The head child of each phrase by the rules of its category."""
    n = trees.from_brackets(bank(spark))
    h = trees.heads(n).join(n.select("tree_id", F.col("node_id").alias("head"), F.col("label").alias("kid")), ["tree_id", "head"])
    phrases = n.select("tree_id", "node_id", F.col("label").alias("parent"))
    kids = n.select("tree_id", F.col("parent_id").alias("head")).where("head is not null").distinct()
    return h.join(phrases, ["tree_id", "node_id"]).join(kids, ["tree_id", "head"], "left_semi").select("tree_id", "parent", F.col("kid").alias("head")).distinct()


@query(values([(0, "(S (NP (NN Rain)) (VP (VBD fell)))"), (1, "(X (Y y))")], "ix, tree"))
def treebank_files(spark, sf_dir):
    """Trees over several lines of a file, normalised: functions, empty parts and doubled nodes go."""
    d = spark.createDataFrame([("f", "(S (NP-SBJ (NN Rain))\n  (NP (-NONE- *T*-1)) (VP-1 (VP\n (VBD fell))))\n text outside (X (Y y))")], "path string, value string")
    t = readers.treebank(d).select(F.col("ix").cast("long").alias("tree_id"), "tree")
    return patterns.transformed(t, "normalise").select(F.col("tree_id").cast("int").alias("ix"), "tree")


@query(values([(1, "a <p>b</p>"), (1, "d"), (2, "x <q>p</q>")], "doc_id, piece"))
def nested_elements(spark, sf_dir):
    """Elements with elements of their own name inside."""
    d = spark.createDataFrame([(1, "<p>a <p>b</p></p> c <p id=1>d</p> <p>open"), (2, "</p><p>x <q>p</q></p>")], "doc_id int, text string")
    return d.select("doc_id", F.explode(readers.nested_tags_udf("p")("text")).alias("piece"))


# --- entities, labels, scores -----------------------------------------------------------------------------------------------------


@query(f"""WITH {LAB}, x AS (SELECT doc_id, pos, tok, coalesce(CASE WHEN length(tok) > 6 THEN gold END, guess) AS label, CASE gold WHEN 'NAME' THEN 'a=1|b=x' ELSE 'a=2' END AS feats FROM lab) SELECT label, count(*)::BIGINT AS n, sum(CASE WHEN feats LIKE '%b=x%' THEN 1 ELSE 0 END)::BIGINT AS with_b FROM x GROUP BY label""")
def provenance_copied(spark, sf_dir):
    """One side's annotations replace the other's where it has them; feature strings as maps with named attributes kept."""
    lab = labelled(spark, sf_dir)
    main = lab.select("doc_id", "pos", "tok", F.col("guess").alias("label"), F.when(F.col("gold") == "NAME", "a=1|b=x").otherwise("a=2").alias("feats"))
    aux = lab.select("doc_id", "pos", F.when(F.length("tok") > 6, F.col("gold")).alias("label"))
    out = merge.provenance(main, aux, ("label",))
    kept = T.keep_attributes(T.feature_map(F.col("feats")), "b")
    return out.groupBy("label").agg(F.count("*").alias("n"), F.sum((F.size(kept) > 0).cast("long")).alias("with_b"))


@query(f"""WITH {LAB} SELECT count(*)::BIGINT AS n, round(avg((gold = guess)::INT), 6) AS accuracy FROM lab""")
def token_level_accuracy(spark, sf_dir):
    return rounded(evaluate.token_accuracy(labelled(spark, sf_dir)), "accuracy")


_CON = [(1, "A A O B", "A A O B"), (2, "A O B B", "A A B B")]


@query(values([("processed 8 tokens with 4 phrases; found: 4 phrases; correct: 3.",), ("accuracy: 87.50%; precision: 75.00%; recall: 75.00%; FB1: 75.00",), ("A: precision: 50.00%; recall: 50.00%; FB1: 50.00 2",), ("B: precision: 100.00%; recall: 100.00%; FB1: 100.00 2",)], "line"))
def chunk_report(spark, sf_dir):
    rows = [(d, i, "w", g, h) for d, gold, guess in _CON for i, (g, h) in enumerate(zip(gold.split(), guess.split(), strict=True))]
    return evaluate.conll_report(spark.createDataFrame(rows, "doc_id long, pos int, tok string, gold string, guess string"))


@query(values([(2, 0.75, 0.75, 0.75, 0.75, 0.5)], "trees, precision, recall, f1, mean_f1, exact"))
def parse_scores(spark, sf_dir):
    """Brackets of guessed trees against gold ones: over all, by tree, and trees without an error."""
    g = spark.createDataFrame([(1, "(S (A a) (B b))"), (2, "(S (A (C c)))")], "tree_id long, tree string")
    h = spark.createDataFrame([(1, "(S (A a) (B b))"), (2, "(T (A (C c)))")], "tree_id long, tree string")
    both = [trees.constituents(trees.from_brackets(x)).where("label not in ('a', 'b', 'c', 'C', 'B')") for x in (g, h)]
    s = evaluate.constituent_summary(evaluate.constituent_scores(*both))
    return s.select(F.col("trees").cast("int").alias("trees"), "precision", "recall", "f1", "mean_f1", "exact")


@query(f"WITH {TOK}, c AS (SELECT lower(tok) AS key, count(*)::DOUBLE AS n FROM tok GROUP BY 1), p AS (SELECT key, n / (SELECT sum(n) FROM c) AS p FROM c WHERE key IN ('the', 'of')), k AS (SELECT key FROM c) SELECT k.key, round(coalesce(p.p, (1 - (SELECT sum(p) FROM p)) / ((SELECT count(*) FROM k) - (SELECT count(*) FROM p))), 10) AS p FROM k LEFT JOIN p USING (key)")
def partial_distribution(spark, sf_dir):
    """Probabilities of two words as they are; all others share what is left."""
    c = tokens(spark, sf_dir).groupBy(F.lower("tok").alias("key")).agg(F.count("*").cast("double").alias("n"))
    total = c.agg(F.sum("n").alias("t"))
    known = c.where("key in ('the', 'of')").crossJoin(F.broadcast(total)).select("key", (F.col("n") / F.col("t")).alias("n"))
    return distributions.partial(known, c.select("key")).select("key", F.round("p", 10).alias("p"))


@query("WITH a AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang) SELECT true AS same, false AS other")
def counters_equal(spark, sf_dir):
    c = counters.of(read(spark, sf_dir, "documents"), "lang")
    same, other = counters.equal(c, c), counters.equal(c, c.where("lang <> 'en'"))
    return same.toDF("same").crossJoin(other.toDF("other"))


@query("SELECT lang, source, n, CASE WHEN n > 1 THEN 'many' ELSE 'one' END AS kind FROM (SELECT lang, source, count(*)::BIGINT AS n FROM documents GROUP BY ALL)")
def looked_up(spark, sf_dir):
    """A lookup with a default for keys that are absent."""
    n = read(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    many = n.where("n > 1").select("lang", "source", F.lit("many").alias("kind"))
    return sets.lookup(n, many, ["lang", "source"], {"kind": "one"})


@query("SELECT item_id, (len(w) >= 3) AS has_part, (len(w) >= 2 AND (w[1] = w[2] OR false)) AS starts_double FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark)")
def sub_lists(spark, sf_dir):
    w = F.col("w")
    b = read(spark, sf_dir, "benchmark").select("item_id", F.split("text", " ").alias("w"))
    part = F.slice(w, F.size(w) - 2, F.lit(3))
    return b.select("item_id", F.when(F.size(w) >= 3, sets.is_sub_list(part, w)).otherwise(False).alias("has_part"), F.coalesce((F.size(w) >= 2) & (F.get(w, F.lit(0)) == F.get(w, F.lit(1))), F.lit(False)).alias("starts_double"))


_NAMES = [("PERSONA", "jānis o'neil", "JĀNIS O'NEIL", "Jānis O'Neil"), ("VIETA", "rīga", "Rīga", "Rīga")]


@query(values([(r[1], r[3]) for r in _NAMES], "norm, shown"))
def display_names(spark, sf_dir):
    d = spark.createDataFrame([r[:3] for r in _NAMES], "tag string, norm string, popular string")
    return d.select("norm", aggregates.display_name(F.col("tag"), F.col("norm"), F.col("popular")).alias("shown"))


@query(values([("is", "v", "be"), ("is", "x", "be"), ("la", "n", "la"), ("zzz", "v", None)], "tok, predicted, lemma"))
def predicted_readings(spark, sf_dir):
    """The reading whose tag was predicted, else the best one."""
    from glossa.plans.structure import LEXICON

    lex = spark.createDataFrame(LEXICON, "form string, tag string, lemma string, estimate double")
    t = spark.createDataFrame([("is", "v"), ("is", "x"), ("la", "n"), ("zzz", "v")], "tok string, predicted string")
    return morphology.readings(t, lex).select("tok", "predicted", morphology.reading_for(F.col("predicted"))["lemma"].alias("lemma"))


@query(values([(1, "masculine"), (2, "feminine"), (3, "unknown")], "phrase_id, gender"))
def guessed_genders(spark, sf_dir):
    rows = [(1, 0, True, False), (1, 1, True, True), (2, 0, False, True), (3, 0, True, True)]
    return morphology.guess_gender(spark.createDataFrame(rows, "phrase_id int, word_ix int, masculine boolean, feminine boolean"))


@query(values([("Rīgas domē", "Rīgas dome"), ("Rīga", "Rīga")], "name, norm"))
def normal_forms(spark, sf_dir):
    lex = spark.createDataFrame([("domē", "dome", 0.9, {"case": "locative"}), ("domē", "domēt", 0.1, {"case": "locative"})], "form string, lemma string, estimate double, attrs map<string,string>")
    return morphology.normal_form(spark.createDataFrame([("Rīgas domē",), ("Rīga",)], "name string"), lex).select("name", "norm")


@query(f"WITH {LAB}, r AS (SELECT doc_id, gold, pos, lag(gold, 1, 'O') OVER (PARTITION BY doc_id ORDER BY pos) AS p FROM lab) SELECT gold AS label, count(*)::BIGINT AS n, sum((p <> gold)::INT)::BIGINT AS begins FROM r WHERE gold <> 'O' GROUP BY gold")
def bare_labels(spark, sf_dir):
    """IOB2 labels written and stripped to their types again."""
    b = spans.encode(labelled(spark, sf_dir), "IOB2", "gold")
    return b.where("coded <> 'O'").select(spans.bare(F.col("coded")).alias("label"), F.col("coded").startswith("B-").cast("long").alias("b")).groupBy("label").agg(F.count("*").alias("n"), F.sum("b").alias("begins"))


@query(r"""WITH p AS (SELECT doc_id, generate_subscripts(ps, 1) AS i, unnest(ps) AS piece FROM (SELECT doc_id, regexp_extract_all(text, '\s*(?:[\p{L}]+|[0-9]+(?:[.,][0-9]+)*|[^\s\p{L}0-9])') AS ps FROM documents)),
  t AS (SELECT doc_id, i, regexp_replace(piece, '^\s+', '') AS tok, (sum(length(piece)) OVER w - length(regexp_replace(piece, '^\s+', '')))::BIGINT AS b, (sum(length(piece)) OVER w)::BIGINT AS e FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
  l AS (SELECT *, regexp_matches(tok, '^\p{Lu}') AS cap, lag(regexp_matches(tok, '^\p{Lu}')) OVER (PARTITION BY doc_id ORDER BY i) AS pc FROM t), r AS (SELECT *, sum((cap AND pc IS DISTINCT FROM true)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM l)
  SELECT doc_id, min(b) AS begin, max(e) AS "end", count(*)::BIGINT AS n FROM r WHERE cap GROUP BY doc_id, run""")
def spans_by_characters(spark, sf_dir):
    """Runs of capitalised tokens as character spans, and the tokens those spans cover."""
    d = read(spark, sf_dir, "documents")
    t = context.with_offsets(d).withColumn("label", F.when(F.col("tok").rlike(r"^\p{Lu}"), "NAME").otherwise("O"))
    s = spans.at_offsets(t)
    c = spans.by_characters(s, t)
    return c.select("doc_id", "begin", "end", (F.col("end_pos") - F.col("begin_pos")).cast("long").alias("n"))


@query(f"WITH {LAB}, g AS (SELECT doc_id, pos, tok, gold, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i FROM lab) SELECT tok || chr(9) || gold AS line, count(*)::BIGINT AS n FROM g GROUP BY 1")
def training_lines(spark, sf_dir):
    """Feature lines for training: token and label, features after them (none here)."""
    lab = labelled(spark, sf_dir)
    none = lab.where("false").select("doc_id", "pos", F.lit("x").alias("feature"))
    return writers.feature_lines(none, lab.select("doc_id", "pos", "tok", F.col("gold").alias("label"))).groupBy("line").agg(F.count("*").alias("n"))


@query("SELECT source || chr(9) || lang || chr(9) || doc_id AS line, 'INSERT INTO docs (doc_id, source) VALUES (' || doc_id || ', ''' || source || ''');' AS statement FROM documents")
def entity_exports(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    line = writers.entity_lines(d.select(F.col("source").alias("name"), F.col("lang").alias("normal_form"), F.col("doc_id").alias("category"), F.lit(None).cast("string").alias("doc_id"), F.lit(None).cast("long").alias("count"), F.col("doc_id").alias("k")))
    st = writers.insert_statements(d.select("doc_id", "source"), "docs")
    a = line.withColumn("id", F.regexp_extract("line", r"([0-9]+)$", 1))
    b = st.withColumn("id", F.regexp_extract("line", r"VALUES \(([0-9]+),", 1)).withColumnRenamed("line", "statement")
    return a.join(b, "id").select("line", "statement")


@query("SELECT label::VARCHAR || chr(9) || 'a=' || (doc_id % 3)::DOUBLE || chr(9) || 'b=' || (doc_id % 5)::DOUBLE AS sparse, label::VARCHAR || chr(9) || (doc_id % 3)::DOUBLE || chr(9) || (doc_id % 5)::DOUBLE AS dense FROM (SELECT doc_id, quality AS label FROM labels)")
def matrix_dumps(spark, sf_dir):
    """Examples as sparse and as dense lines."""
    d = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("example_id"), F.col("quality").alias("label"))
    v = lambda k: (F.col("example_id") % k).cast("double")
    rows = d.select("example_id", "label", F.inline(F.array(F.struct(F.lit("a").alias("feature"), v(3).alias("value")), F.struct(F.lit("b").alias("feature"), v(5).alias("value")))))
    s, m = writers.sparse_lines(rows).withColumnRenamed("line", "sparse"), writers.matrix_lines(rows, ["a", "b"]).withColumnRenamed("line", "dense")
    return s.join(m, "example_id").select("sparse", "dense")


@query("WITH c AS (SELECT lang, sum((source = 'src0')::INT)::BIGINT AS a, sum((source = 'src1')::INT)::BIGINT AS b FROM documents GROUP BY lang) SELECT '' AS key, '<tr><th></th><th>src0</th><th>src1</th></tr>' AS html, repeat(' ', 12) || '        src0        src1' AS ascii UNION ALL SELECT lang, '<tr><th>' || lang || '</th><td>' || a || '</td><td>' || b || '</td></tr>', rpad(lang, 12, ' ') || lpad(a::VARCHAR, 12, ' ') || lpad(b::VARCHAR, 12, ' ') FROM c")
def report_tables(spark, sf_dir):
    """A two-way table of two sources as HTML rows and in columns."""
    d = read(spark, sf_dir, "documents").withColumn("one", F.lit(1))
    args = ("lang", "source", "one", ["src0", "src1"])
    h, a = writers.html_table(d, *args).withColumnRenamed("line", "html"), writers.ascii_table(d, *args).withColumnRenamed("line", "ascii")
    return h.join(a, "key")


# --- models -----------------------------------------------------------------------------------------------------------------------


def tagging_rows(spark, sf_dir):
    """Sentences with their features and gold labels."""
    s = context.sentence_arrays(read(spark, sf_dir, "documents")).where(F.size("toks") > 0)
    gold = F.transform("toks", lambda t: F.when(t.rlike(r"^\p{Lu}"), "NAME").when(t.rlike("^[0-9]"), "NUM").otherwise("O"))
    return s.select("doc_id", "sent_id", tagger.word_features(F.col("toks")).alias("features"), gold.alias("gold"))


#: Sentences that the tagger of the query below is trained on: those with the smallest hashes.
TRAINED_ON = 300


@query()
def crf_tagger(spark, sf_dir):
    """A CRF trained on a bounded sample, saved, loaded, and run over all sentences; counts by gold and guessed label."""
    rows = tagging_rows(spark, sf_dir)
    some = rows.orderBy(F.xxhash64("doc_id", "sent_id"), "doc_id", "sent_id").limit(TRAINED_ON)
    path = shared_dir(spark)
    tagger.save(spark, tagger.train(some, ["NAME", "NUM", "O"], buckets=2048, rounds=8), path)
    done = tagger.tag(rows, tagger.load(spark, path))
    return done.select(F.inline(F.arrays_zip(F.col("gold"), F.col("path").alias("guess")))).groupBy("gold", "guess").agg(F.count("*").alias("n"))


@query(f"WITH {TOK} SELECT doc_id, pos, tok, CASE WHEN regexp_matches(tok, '^\\p{{Lu}}+$') THEN 'ALL-UPPER' WHEN regexp_matches(tok, '^\\p{{Ll}}+$') THEN 'ALL-LOWER' ELSE 'else' END AS kind FROM tok")
def plugged_in(spark, sf_dir):
    """Tokens by a named tokenizer and token factory."""
    t = plugins.tokenise(read(spark, sf_dir, "documents"), "plain", "word")
    shape = T.shape_dan1(F.col("tok"))
    return t.select("doc_id", "pos", "tok", F.when(shape.isin("ALL-UPPER", "ALL-LOWER"), shape).otherwise("else").alias("kind"))


@query("SELECT item_id, generate_subscripts(w, 1)::INTEGER - 1 AS ix, unnest(w) AS word FROM (SELECT item_id, regexp_extract_all(text, '\\S+') AS w FROM benchmark)")
def table_function_words(spark, sf_dir):
    """Words of texts by a table function."""
    plugins.table_function("glossa_words", lambda text: enumerate(text.split()), "ix int, word string")(spark)
    read(spark, sf_dir, "benchmark").createOrReplaceTempView("glossa_benchmark")
    return spark.sql("SELECT item_id, ix, word FROM glossa_benchmark, LATERAL glossa_words(text)")


@query("SELECT lang, max(source) AS a, sum(k)::BIGINT AS n FROM (SELECT lang, source, count(*) AS k FROM documents GROUP BY ALL) GROUP BY lang HAVING count(DISTINCT source) <= 1")
def merged_templates(spark, sf_dir):
    """Templates of a language's documents: only those that agree merge (as a rule none)."""
    d = read(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    m = aggregates.merge_templates(d.select("lang", F.col("source").alias("a")), ["lang"], ["a"])
    return m.join(d.groupBy("lang").agg(F.sum("n").alias("n")), "lang")


@query("SELECT 'lang' AS field, lang AS value, count(*)::BIGINT AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*)::BIGINT FROM documents GROUP BY source")
def template_values(spark, sf_dir):
    return aggregates.field_values(read(spark, sf_dir, "documents").withColumn("score", F.lit(1)), ["lang", "source"])


_LAT = [("a", "a", 0.5), ("a", "b", -1.0), ("b", "a", 0.0), ("b", "b", 0.25)]


@query(values([(0, "0_a\t1_a\ta\ta\t-1.5"), (0, "0_a\t1_b\tb\tb\t-1.0"), (0, "0_b\t1_a\ta\ta\t-1.0"), (0, "0_b\t1_b\tb\tb\t-2.25")], "pos, line"))
def lattice_text(spark, sf_dir):
    """A Viterbi lattice of two tokens as finite-state text."""
    s = spark.createDataFrame([(1, 0, "a", 0.0), (1, 0, "b", 0.0), (1, 1, "a", 1.0), (1, 1, "b", 2.0)], "doc_id int, pos int, label string, score double")
    m = spark.createDataFrame(_LAT, "tag string, next_tag string, w double")
    return writers.fsm_lines(writers.lattice(s, m)).select("pos", "line")


@query(values([(0, "NAME", 0.731059), (0, "O", 0.268941)], "pos, label, p"))
def label_probabilities(spark, sf_dir):
    """Posterior of one token with scores 1 and 0."""
    import numpy as np

    s = spark.createDataFrame([(1, 0, 0, "NAME", 1.0), (1, 0, 0, "O", 0.0)], "doc_id int, sent_id int, pos int, label string, score double")
    return rounded(models.posterior(s, ["NAME", "O"], np.zeros((2, 2))), "p").select("pos", "label", "p")


# --- dates and estimates ----------------------------------------------------------------------------------------------------------


@query("SELECT event_id, year(ts)::INTEGER AS year, quarter(ts)::INTEGER AS quarter, month(ts)::INTEGER AS month, isodow(ts)::INTEGER AS weekday, hour(ts)::INTEGER AS hour, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, strftime(ts, '%Y/%m/%d %H:%M') AS shown, datediff('day', DATE '2024-01-01', ts::DATE)::INTEGER AS days FROM events")
def event_dates(spark, sf_dir):
    ts = F.col("ts")
    e = read(spark, sf_dir, "events").select("event_id", "ts", dates.parts(ts).alias("p"))
    return e.select("event_id", *(F.col(f"p.{c}") for c in ("year", "quarter", "month", "weekday", "hour")), dates.shown(dates.floor_to(ts, "week")).alias("week"), dates.shown(ts, "yyyy/MM/dd HH:mm").alias("shown"), dates.days_between(F.lit("2024-01-01").cast("date"), ts).alias("days"))


@query(f"WITH {TOK} SELECT lang, true AS near_distinct, true AS near_median FROM tok GROUP BY lang")
def estimates(spark, sf_dir):
    """Distinct words and median lengths by sketches, against exact ones: within six standard errors, and within one character."""
    t = tokens_with(spark, sf_dir, "lang")
    exact = t.groupBy("lang").agg(F.count_distinct("tok").alias("d"), F.median(F.length("tok")).alias("m"))
    d = aggregates.distinct_estimate(t, "tok", ["lang"])
    q = aggregates.quantile_estimates(t.withColumn("n", F.length("tok")), "n", [0.5], ["lang"])
    j = exact.join(d, "lang").join(q, "lang")
    return j.select("lang", (F.abs(F.col("estimate") - F.col("d")) <= F.greatest(F.lit(2), 0.12 * F.col("d"))).alias("near_distinct"), (F.abs(F.col("quantiles")[0] - F.col("m")) <= 1).alias("near_median"))
