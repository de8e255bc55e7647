"""Trees, morphology and streams over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.operators import morphology, sets, trees
from glossa.plans.catalogue import query, read
from glossa.plans.corpus import tokens
from glossa.plans.sqltext import TOK
from glossa.shared import written
from glossa.streaming import streams

#: A document as a tree: the document, its lines, and each line's words.
_N = r"""WITH l AS (SELECT doc_id AS tree_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
  w AS (SELECT tree_id, i, generate_subscripts(ws, 1) AS j, unnest(ws) AS word FROM (SELECT tree_id, i, regexp_extract_all(line, '[\p{L}]+') AS ws FROM l)),"""


def document_trees(spark, sf_dir):
    """Bracketed trees (DOC (LINE w w w) ...) of documents."""
    lines = F.split("text", "\n")
    words = F.transform(lines, lambda x: F.array_join(F.regexp_extract_all(x, F.lit(r"[\p{L}]+"), F.lit(0)), " "))
    kept = F.filter(words, lambda x: x != "")
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("tree_id"), kept.alias("k")).where(F.size("k") > 0)
    return d.select("tree_id", F.concat(F.lit("(DOC "), F.array_join(F.transform("k", lambda x: F.concat(F.lit("(LINE "), x, F.lit(")"))), " "), F.lit(")")).alias("tree"))


def nodes(spark, sf_dir):
    """Nodes of documents' trees, written once: relations read them several times over."""
    return written(trees.from_brackets(document_trees(spark, sf_dir)))


@query(f"{_N} n AS (SELECT tree_id, count(*) AS words, count(DISTINCT i) AS lines FROM w GROUP BY tree_id) SELECT tree_id, (1 + lines + words)::BIGINT AS size, 2::BIGINT AS depth FROM n")
def tree_sizes(spark, sf_dir):
    return trees.sizes(nodes(spark, sf_dir))


@query(f"{_N} x AS (SELECT * FROM w) SELECT tree_id, count(*)::BIGINT AS n FROM w WHERE starts_with(lower(word), 'th') GROUP BY tree_id")
def tree_dominates(spark, sf_dir):
    """DOC << a word that starts with th."""
    m = trees.search(nodes(spark, sf_dir), "DOC", ("<<", "/^[Tt][Hh]/", "x"))
    return m.groupBy("tree_id").agg(F.count("*").alias("n"))


@query(f"{_N} p AS (SELECT a.tree_id, a.i, a.word AS x, b.word AS y FROM w a JOIN w b ON a.tree_id = b.tree_id AND a.i = b.i AND b.j = a.j + 1) SELECT x, y, count(*)::BIGINT AS n FROM p GROUP BY ALL HAVING count(*) > 1")
def tree_sisters(spark, sf_dir):
    """Words that follow each other under one line: LINE < x and x $. y."""
    m = trees.search_texts(document_trees(spark, sf_dir), "LINE", ("<", "__", "x"), ("$.", "__", "y", "x"))
    # labels hold no white space; a pair as one string is shuffled in fewer bytes
    pairs = m.groupBy(F.concat("x_label", F.lit(" "), "y_label").alias("p")).agg(F.count("*").alias("n")).where("n > 1")
    return pairs.select(F.substring_index("p", " ", 1).alias("x"), F.substring_index("p", " ", -1).alias("y"), "n")


@query(f"{_N} h AS (SELECT DISTINCT tree_id, i FROM w WHERE starts_with(word, 'T')) SELECT tree_id, count(*)::BIGINT AS n FROM (SELECT DISTINCT tree_id, i FROM w EXCEPT SELECT tree_id, i FROM h) GROUP BY tree_id")
def tree_negation(spark, sf_dir):
    """Lines without a word that starts with T."""
    return trees.search(nodes(spark, sf_dir), "LINE", ("!<", "/^T/", "x")).groupBy("tree_id").agg(F.count("*").alias("n"))


@query(f"{_N} o AS (SELECT tree_id, i, string_agg(word, ' ' ORDER BY j) AS children FROM w GROUP BY ALL) SELECT children, count(*)::BIGINT AS n FROM o GROUP BY children HAVING count(*) > 1")
def local_trees(spark, sf_dir):
    t = trees.local_trees(nodes(spark, sf_dir)).where("label = 'LINE'")
    return t.groupBy("children").agg(F.count("*").alias("n")).where("n > 1")


@query(f"{_N} y AS (SELECT tree_id, (row_number() OVER (PARTITION BY tree_id ORDER BY i, j) - 1)::INTEGER AS position, word FROM w) SELECT tree_id, position, word, 'LINE' AS tag FROM y WHERE (tree_id, 1) IN (SELECT tree_id, 1 FROM w) AND (tree_id, position) IN (SELECT tree_id, position FROM (SELECT tree_id, (row_number() OVER (PARTITION BY tree_id ORDER BY i, j) - 1)::INTEGER AS position, count(*) OVER (PARTITION BY tree_id, i) AS k FROM w) WHERE k = 1)")
def tagged_yield(spark, sf_dir):
    """Words alone in their line, with their preterminal."""
    return trees.tagged_yield(nodes(spark, sf_dir)).select("tree_id", "position", "word", "tag")


@query()
def tree_surgery(spark, sf_dir):
    """Lines with a word in -ing are marked, words in -ed deleted, empty lines pruned."""
    return trees.rewrite(document_trees(spark, sf_dir), [("[A-Za-z]*ing", "relabel", "ING"), ("[A-Za-z]*ed", "delete"), ("nothing", "prune")])


@query(f"{_N} k AS (SELECT tree_id, i, min(j) AS j FROM w GROUP BY ALL) SELECT tree_id, count(*)::BIGINT AS edges FROM w JOIN k USING (tree_id, i) WHERE w.j <> k.j GROUP BY tree_id")
def tree_dependencies(spark, sf_dir):
    """Edges from a line's first word to its others."""
    n = nodes(spark, sf_dir)
    e = trees.dependencies(n).join(n.where("depth = 2").select("tree_id", F.col("node_id").alias("dependent")), ["tree_id", "dependent"])
    return e.groupBy("tree_id").agg(F.count("*").alias("edges"))


@query(f"{_N} n AS (SELECT DISTINCT tree_id FROM w) SELECT tree_id, 'DOC/LINE/' || word AS path, count(*)::BIGINT AS n FROM w WHERE length(word) >= 12 GROUP BY ALL")
def domination_paths(spark, sf_dir):
    p = trees.domination_path(nodes(spark, sf_dir)).where(F.col("path").rlike(r"^DOC/LINE/.{12,}$"))
    return p.groupBy("tree_id", "path").agg(F.count("*").alias("n"))


# --- morphology -----------------------------------------------------------------------------------------------------------------

#: Inline lexicon: form, tag, lemma, estimate.
LEXICON = [("the", "d", "the", 0.9), ("of", "p", "of", 0.8), ("and", "c", "and", 0.8), ("is", "v", "be", 0.7), ("is", "n", "is", 0.1), ("was", "v", "be", 0.6), ("are", "v", "be", 0.6), ("are", "n", "are", 0.2), ("la", "d", "la", 0.7), ("la", "n", "la", 0.2)]
_L = "lx(form, tag, lemma, estimate) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', {d}::DOUBLE)" for a, b, c, d in LEXICON) + ")"


@query(f"WITH {TOK}, {_L}, b AS (SELECT form, arg_max(tag, estimate) AS tag, arg_max(lemma, estimate) AS lemma, count(*) AS k FROM lx GROUP BY form) SELECT tok, tag, lemma, k::INTEGER AS readings, count(*)::BIGINT AS n FROM tok JOIN b ON tok = form GROUP BY ALL")
def best_readings(spark, sf_dir):
    lex = spark.createDataFrame(LEXICON, "form string, tag string, lemma string, estimate double")
    t = tokens(spark, sf_dir).groupBy("tok").agg(F.count("*").alias("n"))
    r = morphology.best_reading(morphology.readings(t, lex)).where("readings is not null")
    return r.select("tok", "best.tag", "best.lemma", F.size("readings").alias("readings"), "n")


@query(f"WITH {TOK}, {_L} SELECT CASE WHEN regexp_matches(tok, '^[0-9][0-9.,]*$') THEN regexp_replace(tok, '[0-9]', '0', 'g') WHEN lower(tok) IN (SELECT form FROM lx WHERE tag = 'v') THEN '_verb_' WHEN lower(tok) IN (SELECT form FROM lx) THEN lower(tok) ELSE '_rare_' END AS class, count(*)::BIGINT AS n FROM tok GROUP BY 1")
def word_classes(spark, sf_dir):
    lex = spark.createDataFrame(LEXICON, "form string, tag string, lemma string, estimate double")
    t = tokens(spark, sf_dir).groupBy("tok").agg(F.count("*").alias("n")).withColumn("lemma", F.lower("tok"))
    return sets.word_class(t, {"verb": lex.where("tag = 'v'").select("form"), "common": lex.select("form")}).groupBy("class").agg(F.sum("n").alias("n"))


@query()
def phrase_inflection(spark, sf_dir):
    """Country and customer names through a small paradigm table."""
    p = spark.createDataFrame([("FRANCE", "genitive", "FRANCES"), ("GERMANY", "genitive", "GERMANYS"), ("GERMANY", "dative", "GERMANYAI")], "lemma string, slot string, form string")
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("phrase_id"), F.col("n_name").alias("phrase"), F.lit("loc").alias("category"))
    return morphology.entity_json(morphology.inflect(n, p))


# --- streams, run to the end of what is there ---------------------------------------------------------------------------------------


@query("SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY event_type")
def running_counts(spark, sf_dir):
    return streams.drain(streams.running_counts(streams.source(spark, sf_dir, "events"), "event_type"), "complete")


_CLOSED = "(SELECT max(ts) - INTERVAL '10 minutes' FROM events)"


@query(f"SELECT * FROM (SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2) WHERE start + INTERVAL '1 hour' <= {_CLOSED}")
def tumbling_windows(spark, sf_dir):
    out = streams.drain(streams.tumbling(streams.source(spark, sf_dir, "events"), "1 hour", "10 minutes"), "append")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT conv_id, turn, upper(role) AS role, length(text)::BIGINT AS n FROM conversations")
def stateless_stream(spark, sf_dir):
    s = streams.source(spark, sf_dir, "conversations")
    return streams.drain(s.select("conv_id", "turn", F.upper("role").alias("role"), F.length("text").cast("long").alias("n")), "append")


@query(f"SELECT * FROM (SELECT time_bucket(INTERVAL '1 hour', ts) - k * INTERVAL '1 hour' AS start, event_type, count(*)::BIGINT AS n FROM events, range(0, 2) AS r(k) GROUP BY 1, 2) WHERE start + INTERVAL '2 hours' <= {_CLOSED}")
def sliding_windows(spark, sf_dir):
    out = streams.drain(streams.sliding(streams.source(spark, sf_dir, "events"), "2 hours", "1 hour", "10 minutes"), "append")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query(f"""SELECT user_id, start, n FROM (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS stop, count(*)::BIGINT AS n FROM (
    SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events))
  GROUP BY user_id, s) WHERE stop <= {_CLOSED}""")
def session_windows(spark, sf_dir):
    out = streams.drain(streams.sessions(streams.source(spark, sf_dir, "events"), "30 minutes", "10 minutes"), "append")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")
