"""Labels, spans, gazetteers, entities, scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.operators import aggregates, evaluate, gazetteer, merge, sets, spans
from glossa.plans import sqltext
from glossa.plans.catalogue import query, read, rounded
from glossa.plans.corpus import tokens
from glossa.plans.sqltext import LAB, TOK


def labelled(spark, sf_dir):
    """Two labellings of the same tokens (see sqltext.LAB)."""
    t = F.col("tok")
    cap, num = t.rlike(r"^\p{Lu}"), t.rlike("^[0-9]")
    gold = F.when(cap, "NAME").when(num, "NUM").otherwise("O")
    guess = F.when(cap & (F.length(t) >= 4), "NAME").when(num & (F.length(t) < 4), "NUM").otherwise("O")
    return tokens(spark, sf_dir).select("doc_id", "pos", "tok", gold.alias("gold"), guess.alias("guess"))


def gold_spans(spark, sf_dir):
    return spans.chunks(labelled(spark, sf_dir), "gold")


_G = sqltext.spans("gold", "g")
_H = sqltext.spans("guess", "h")


@query(f"WITH {LAB}, {_G} SELECT text, count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS n_docs FROM g WHERE type = 'NAME' GROUP BY text HAVING count(*) > 1")
def top_entities(spark, sf_dir):
    s = gold_spans(spark, sf_dir).where("type = 'NAME'")
    c = s.groupBy("text", "doc_id").agg(F.count("*").alias("k")).groupBy("text").agg(F.sum("k").alias("n"), F.count("*").alias("n_docs"))
    return c.where("n > 1")


@query(f"WITH {LAB}, {_G} SELECT doc_id, type, begin_pos, end_pos, n_tok::BIGINT AS n_tok, text FROM g")
def chunk_spans(spark, sf_dir):
    return gold_spans(spark, sf_dir)


@query(f"""WITH {LAB}, b AS (SELECT doc_id, pos, gold, lag(gold, 1, 'O') OVER w AS p, lead(gold, 1, 'O') OVER w AS n FROM lab WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
  SELECT doc_id, pos, CASE WHEN gold = 'O' THEN 'O' WHEN p <> gold THEN 'B-' || gold ELSE 'I-' || gold END AS iob2,
    CASE WHEN gold = 'O' THEN 'O' WHEN p <> gold AND n <> gold THEN 'S-' || gold WHEN p <> gold THEN 'B-' || gold WHEN n <> gold THEN 'E-' || gold ELSE 'I-' || gold END AS sbieo,
    CASE WHEN gold = 'O' THEN 'O' ELSE 'I-' || gold END AS iob1 FROM b""")
def bio_reencode(spark, sf_dir):
    lab = labelled(spark, sf_dir).select("doc_id", "pos", F.col("gold").alias("label"))
    a = spans.encode(lab, "IOB2").withColumnRenamed("coded", "iob2")
    b = spans.encode(a, "SBIEO").withColumnRenamed("coded", "sbieo")
    return spans.encode(b, "IOB1").withColumnRenamed("coded", "iob1").select("doc_id", "pos", "iob2", "sbieo", "iob1")


@query(f"""WITH {LAB}, {_G}, {_H}, m AS (SELECT coalesce(g.type, h.type) AS type, (g.type IS NOT NULL AND h.type IS NOT NULL)::INT AS tp, (g.type IS NULL)::INT AS fp, (h.type IS NULL)::INT AS fn
    FROM g FULL JOIN h ON g.doc_id = h.doc_id AND g.type = h.type AND g.begin_pos = h.begin_pos AND g.end_pos = h.end_pos),
  s AS (SELECT coalesce(type, 'Totals') AS type, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM m GROUP BY ROLLUP (type)),
  q AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM s)
  SELECT type, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p > 0 AND r > 0 THEN 2 / (1 / p + 1 / r) ELSE 0 END, 6) AS f1 FROM q""")
def entity_prf(spark, sf_dir):
    return rounded(evaluate.entity_scores(labelled(spark, sf_dir)), "precision", "recall", "f1")


@query(f"WITH {LAB} SELECT gold, guess, count(*)::BIGINT AS n FROM lab GROUP BY ALL")
def confusion_matrix(spark, sf_dir):
    return evaluate.confusion(labelled(spark, sf_dir))


@query(f"WITH {LAB} SELECT gold, sum((gold = guess)::INT)::BIGINT AS correct, count(*)::BIGINT AS total, round(avg((gold = guess)::INT), 6) AS accuracy FROM lab GROUP BY gold")
def label_accuracy(spark, sf_dir):
    return rounded(evaluate.label_accuracy(evaluate.confusion(labelled(spark, sf_dir))), "accuracy")


@query(f"""WITH {LAB}, x AS (SELECT gold AS label, (gold = guess)::INT AS tp, 0 AS fp, (gold <> guess)::INT AS fn FROM lab UNION ALL SELECT guess, 0, 1, 0 FROM lab WHERE gold <> guess),
  s AS (SELECT coalesce(label, 'micro') AS label, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM x WHERE label <> 'O' GROUP BY ROLLUP (label)),
  q AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM s)
  SELECT label, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p > 0 AND r > 0 THEN 2 / (1 / p + 1 / r) ELSE 0 END, 6) AS f1 FROM q""")
def label_prf(spark, sf_dir):
    return rounded(evaluate.label_scores(labelled(spark, sf_dir), background="O"), "precision", "recall", "f1")


@query(f"WITH {LAB}, {_G}, {_H} SELECT g.doc_id, g.type, g.begin_pos AS a0, g.end_pos AS a1, h.begin_pos AS b0, h.end_pos AS b1 FROM g JOIN h ON g.doc_id = h.doc_id AND g.type = h.type AND g.begin_pos < h.end_pos AND h.begin_pos < g.end_pos WHERE g.begin_pos <> h.begin_pos OR g.end_pos <> h.end_pos")
def border_errors(spark, sf_dir):
    lab = labelled(spark, sf_dir)
    g, h = spans.chunks(lab, "gold"), spans.chunks(lab, "guess")
    return evaluate.border_errors(g, h, spans.overlapping(g, h)).select("doc_id", F.col("a_type").alias("type"), "a0", "a1", "b0", "b1")


@query(f"""WITH {LAB}, {_G}, {_H}, j AS (SELECT g.begin_pos AS a0, g.end_pos AS a1, h.begin_pos AS b0, h.end_pos AS b1 FROM g JOIN h ON g.doc_id = h.doc_id)
  SELECT CASE WHEN a0 = b0 AND a1 = b1 THEN 'EQUAL' WHEN a1 = b0 THEN 'END_MEET_BEGIN' WHEN a0 = b1 THEN 'BEGIN_MEET_END' WHEN a1 < b0 THEN 'BEFORE' WHEN a0 > b1 THEN 'AFTER'
    WHEN a0 <= b0 AND a1 >= b1 THEN 'CONTAIN' WHEN a0 >= b0 AND a1 <= b1 THEN 'INSIDE' WHEN a0 < b1 AND b0 < a1 THEN 'OVERLAP' ELSE 'UNKNOWN' END AS relation, count(*)::BIGINT AS n FROM j GROUP BY 1""")
def interval_relations(spark, sf_dir):
    """Relations among all spans of two labellings of a document."""
    lab = labelled(spark, sf_dir)
    return spans.relation_counts(spans.chunks(lab, "gold"), spans.chunks(lab, "guess"))


@query(f"WITH {LAB}, {_G}, x AS (SELECT type, CASE WHEN n_tok = 1 THEN 'single' WHEN n_tok = 2 THEN 'pair' ELSE 'longer' END AS kind FROM g) SELECT kind, count(*)::BIGINT AS n, round(count(*) / (SELECT count(*) FROM x), 6) AS impact FROM x GROUP BY kind")
def error_shares(spark, sf_dir):
    kind = F.when(F.col("n_tok") == 1, "single").when(F.col("n_tok") == 2, "pair").otherwise("longer")
    return rounded(evaluate.error_shares(gold_spans(spark, sf_dir).withColumn("kind", kind), "kind"), "impact")


_SCORES = "s AS (SELECT l.doc_id, quality AS gold, round(1.0 / (1 + exp(-(d.n_chars % 1000) / 1000.0)), 4) AS score FROM labels l JOIN documents d USING (doc_id))"


def scored(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return read(spark, sf_dir, "labels").join(d, "doc_id").select("doc_id", F.col("quality").alias("gold"), F.round(1.0 / (1 + F.exp(-(F.col("n_chars") % 1000) / 1000.0)), 4).alias("score"))


@query(f"""WITH {_SCORES}, g AS (SELECT score, sum(gold) AS p, count(*) AS m FROM s GROUP BY score), c AS (SELECT score, sum(p) OVER w AS tp, sum(m) OVER w AS seen, sum(p) OVER () AS total FROM g WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)), q AS (SELECT *, tp / seen AS p, tp / total AS r FROM c)
  SELECT score, tp::BIGINT AS tp, (seen - tp)::BIGINT AS fp, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM q""")
def pr_curve(spark, sf_dir):
    return rounded(evaluate.pr_curve(scored(spark, sf_dir)), "precision", "recall", "f1")


@query(f"WITH {_SCORES} SELECT round(avg(a), 6) AS cwa, count(*)::BIGINT AS n FROM (SELECT avg(gold) OVER (ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING) AS a FROM s)")
def confidence_weighted_accuracy(spark, sf_dir):
    return rounded(evaluate.confidence_weighted_accuracy(scored(spark, sf_dir), "score", "gold"), "cwa")


@query(f"WITH {_SCORES} SELECT round(sum(ln(CASE WHEN gold = 1 THEN score ELSE 1 - score END)), 4) AS log_likelihood FROM s")
def data_log_likelihood(spark, sf_dir):
    return evaluate.log_likelihood(scored(spark, sf_dir), "score").select(F.round("log_likelihood", 4).alias("log_likelihood"))


# --- gazetteers ----------------------------------------------------------------------------------------------------------------

#: Inline gazetteer: type, phrase, priority.
GAZ = [("FUNC", "of the", 1.0), ("FUNC", "in the", 1.0), ("ART", "the", 2.0), ("CONJ", "and the", 1.0), ("DE", "in den", 1.0), ("FR", "de la", 1.0), ("FR", "la", 2.0), ("ES", "de los", 1.0), ("LIST", "of", 3.0)]
_GAZ = "gaz(type, phrase, priority) AS (VALUES " + ", ".join(f"('{t}', '{p}', {q})" for t, p, q in GAZ) + "), gz AS (SELECT *, len(string_split(phrase, ' ')) AS n_tok FROM gaz)"
_WIN = f"WITH {TOK}, {_GAZ}, win AS (SELECT doc_id, pos, 1 AS n, tok AS key FROM tok UNION ALL SELECT * FROM (SELECT doc_id, pos, 2, tok || ' ' || lead(tok) OVER (PARTITION BY doc_id ORDER BY pos) AS key FROM tok) WHERE key IS NOT NULL), m AS (SELECT doc_id, pos, n, type, priority FROM win JOIN gz ON key = phrase AND n = n_tok)"


def gaz(spark):
    return spark.createDataFrame(GAZ, "type string, phrase string, priority double")


@query(f"{_WIN} SELECT type, n::INTEGER AS n, count(*)::BIGINT AS matches FROM m GROUP BY ALL")
def gazetteer_matches(spark, sf_dir):
    return gazetteer.phrase_matches(tokens(spark, sf_dir), gaz(spark), [1, 2]).groupBy("type", "n").agg(F.count("*").alias("matches"))


@query(f"WITH {TOK}, {_GAZ}, w AS (SELECT DISTINCT type, n_tok, unnest(string_split(phrase, ' ')) AS word FROM gz) SELECT doc_id, pos, list_sort(list(DISTINCT type || '-GAZS' || n_tok)) AS features FROM tok JOIN w ON tok = word GROUP BY doc_id, pos")
def gazetteer_sloppy(spark, sf_dir):
    return gazetteer.sloppy_features(tokens(spark, sf_dir), gaz(spark))


@query(f"{_WIN} SELECT doc_id, (pos + j)::INTEGER AS pos, list_sort(list(DISTINCT type || '-GAZC' || n)) AS features FROM m, range(0, 2) AS r(j) WHERE j < n GROUP BY 1, 2")
def gazetteer_clean(spark, sf_dir):
    return gazetteer.clean_features(tokens(spark, sf_dir), gaz(spark), [1, 2])


@query(f"{_WIN}, c AS (SELECT doc_id, pos + j AS pos, type, row_number() OVER (PARTITION BY doc_id, pos + j ORDER BY priority, n DESC, pos DESC, type) AS r FROM m, range(0, 2) AS r(j) WHERE j < n) SELECT coalesce(type, 'O') AS label, count(*)::BIGINT AS n FROM tok LEFT JOIN c ON c.doc_id = tok.doc_id AND c.pos = tok.pos AND r = 1 GROUP BY 1")
def list_ner_longest(spark, sf_dir):
    return gazetteer.list_labels(tokens(spark, sf_dir), gaz(spark), [1, 2], quotes=False).groupBy("label").agg(F.count("*").alias("n"))


@query(rf"""WITH {TOK}, t AS (SELECT doc_id, pos, tok, lead(tok) OVER (PARTITION BY doc_id ORDER BY pos) AS nx FROM tok),
  m AS (SELECT doc_id, pos AS start, 2 AS n, 2 AS ord, 'PHRASE' AS type FROM t WHERE regexp_matches(tok, '^(?:th.*)$') AND regexp_matches(nx, '^(?:.*ing)$') UNION ALL SELECT doc_id, pos, 1, 1, 'ING' FROM t WHERE regexp_matches(tok, '^(?:.*ing)$')),
  c AS (SELECT doc_id, start + j AS pos, type, row_number() OVER (PARTITION BY doc_id, start + j ORDER BY ord DESC, start DESC) AS r FROM m, range(0, 2) AS r(j) WHERE j < n)
  SELECT coalesce(type, 'O') AS label, count(*)::BIGINT AS n FROM tok LEFT JOIN c ON c.doc_id = tok.doc_id AND c.pos = tok.pos AND r = 1 GROUP BY 1""")
def regex_ner(spark, sf_dir):
    p = spark.createDataFrame([(1, "ING", ".*ing"), (2, "PHRASE", "th.* .*ing")], "order int, type string, pattern string")
    return gazetteer.regex_labels(tokens(spark, sf_dir), p, "tok").groupBy("label").agg(F.count("*").alias("n"))


@query(f"WITH {TOK} SELECT tok, CASE WHEN length(tok) < 4 THEN 'short' ELSE 'null' END AS class, count(*)::BIGINT AS n FROM tok GROUP BY ALL")
def dist_sim_join(spark, sf_dir):
    types = tokens(spark, sf_dir).groupBy("tok").agg(F.count("*").alias("n"))
    lexicon = types.where(F.length("tok") < 4).select(F.col("tok").alias("word"), F.lit("short").alias("class"))
    return gazetteer.dist_sim(types, lexicon).select("tok", "class", "n")


@query(f"WITH {TOK} SELECT lang, count(*)::BIGINT AS n FROM tok WHERE tok IN (SELECT unnest(string_split(text, ' ')) FROM benchmark) GROUP BY lang")
def dict_semi_join(spark, sf_dir):
    from glossa.plans.corpus import tokens_with

    d = read(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("word"))
    return sets.members(tokens_with(spark, sf_dir, "lang"), d, "tok").groupBy("lang").agg(F.count("*").alias("n"))


@query(f"WITH {TOK} SELECT lang, count(*)::BIGINT AS n FROM tok WHERE tok NOT IN (SELECT unnest(string_split(text, ' ')) FROM benchmark) GROUP BY lang")
def blacklist_anti_join(spark, sf_dir):
    from glossa.plans.corpus import tokens_with

    d = read(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("word"))
    return sets.strangers(tokens_with(spark, sf_dir, "lang"), d, "tok").groupBy("lang").agg(F.count("*").alias("n"))


# --- entities -------------------------------------------------------------------------------------------------------------------

_M = f"WITH {LAB}, {_G}, mentions AS (SELECT doc_id, type AS tag, lower(text) AS norm, text AS form FROM g)"


def mentions(spark, sf_dir):
    s = gold_spans(spark, sf_dir)
    return s.select("doc_id", F.col("type").alias("tag"), F.lower("text").alias("norm"), F.col("text").alias("form"))


@query(f"{_M} SELECT doc_id, tag, norm, count(*)::BIGINT AS n FROM mentions GROUP BY ALL")
def entity_counts_per_doc(spark, sf_dir):
    return aggregates.entity_counts(mentions(spark, sf_dir), True)


@query(f"{_M}, f AS (SELECT tag, norm, form, count(*) AS k FROM mentions GROUP BY ALL), o AS (SELECT tag, norm, sum(k)::BIGINT AS n, list(form ORDER BY k DESC, form) AS fs FROM f GROUP BY ALL) SELECT tag, norm, n, n_docs, fs[1] AS popular, CASE WHEN len(fs) > 1 THEN array_to_string(fs, '|') END AS alternatives FROM o JOIN (SELECT tag, norm, count(DISTINCT doc_id)::BIGINT AS n_docs FROM mentions GROUP BY ALL) USING (tag, norm)")
def popular_form(spark, sf_dir):
    return aggregates.entities(mentions(spark, sf_dir))


@query(f"{_M} SELECT tag, norm, count(*)::BIGINT AS n FROM mentions GROUP BY ALL HAVING count(*) >= 10")
def entity_merge_threshold(spark, sf_dir):
    counts = aggregates.entity_counts(mentions(spark, sf_dir))
    return counts.where("n >= 10")


@query(f"{_M}, q AS (SELECT form AS name, norm, CASE tag WHEN 'NAME' THEN 1 ELSE 23 END AS category, doc_id, count(*) AS n FROM mentions GROUP BY ALL), k AS (SELECT category, norm, name, sum(n) AS k FROM q WHERE length(name) >= 3 AND length(norm) <= 50 GROUP BY ALL) SELECT category::INTEGER AS category, norm, sum(k)::BIGINT AS total, arg_max(name, (k, name)) AS best_form FROM k GROUP BY category, norm HAVING sum(k) >= 10")
def corpus_entity_merge(spark, sf_dir):
    m = mentions(spark, sf_dir).groupBy(F.col("form").alias("name"), "norm", F.when(F.col("tag") == "NAME", 1).otherwise(23).alias("category"), "doc_id").agg(F.count("*").alias("n"))
    blacklist = spark.createDataFrame([("zzz",)], "word string")
    return aggregates.merge_entities(m, blacklist, [], 10)


@query(f"""WITH {LAB}, {_G}, {_H}, c AS (SELECT DISTINCT h.doc_id, h.begin_pos, h.end_pos FROM h JOIN g ON g.doc_id = h.doc_id AND h.begin_pos < g.end_pos AND g.begin_pos < h.end_pos)
  SELECT count(*)::BIGINT AS free FROM h WHERE (doc_id, begin_pos, end_pos) NOT IN (SELECT doc_id, begin_pos, end_pos FROM c)""")
def fill_in_spans(spark, sf_dir):
    lab = labelled(spark, sf_dir)
    g, h = spans.chunks(lab, "gold"), spans.chunks(lab, "guess")
    clash = spans.overlapping(h, g).select("doc_id", F.col("a0").alias("begin_pos"), F.col("a1").alias("end_pos")).distinct()
    return h.join(clash, ["doc_id", "begin_pos", "end_pos"], "left_anti").agg(F.count("*").alias("free"))


@query()
def merge_longest(spark, sf_dir):
    return merge.merge_longest(labelled(spark, sf_dir), ["gold", "guess"]).groupBy("label").agg(F.count("*").alias("n"))


@query(f"WITH {LAB}, x AS (SELECT lag(gold) OVER w AS l1, gold AS l0 FROM lab WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) SELECT DISTINCT l1, l0 FROM x WHERE l1 IS NOT NULL")
def label_sequences(spark, sf_dir):
    return aggregates.label_sequences(labelled(spark, sf_dir), 2, "gold")


@query(f"WITH {LAB}, {_G}, {_H} SELECT lower(coalesce(g.text, h.text)) AS phrase, g.type AS gold, h.type AS guess, count(*)::BIGINT AS n FROM g FULL JOIN h ON g.doc_id = h.doc_id AND g.begin_pos = h.begin_pos AND g.end_pos = h.end_pos GROUP BY ALL")
def classifier_comparison(spark, sf_dir):
    return merge.entity_table(labelled(spark, sf_dir), "gold", "guess")


@query(f"WITH {LAB}, x AS (SELECT doc_id, pos, sum(CASE WHEN gold <> 'O' AND gold IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run, tok, gold, guess FROM (SELECT *, lag(gold) OVER (PARTITION BY doc_id ORDER BY pos) AS p FROM lab)) SELECT doc_id, min(pos) AS begin_pos, string_agg(tok || '\\' || guess, ' ' ORDER BY pos) AS text, CASE WHEN min(guess) = max(guess) THEN min(guess) ELSE 'MISC' END AS category FROM x WHERE gold <> 'O' GROUP BY doc_id, run")
def markables(spark, sf_dir):
    return spans.markable_text(labelled(spark, sf_dir), "gold", "guess").select("doc_id", "begin_pos", "text", "category")


