"""Feature templates, weights, classification, decoding."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from glossa.functions.text import shape_dan2
from glossa.operators import context, feature_counts, features, models
from glossa.plans.catalogue import query, read, rounded
from glossa.plans.counts import labelled_features
from glossa.plans.corpus import tokens
from glossa.plans.labels import labelled
from glossa.plans.sqltext import LAB, STOK, TOK, dan2

@query(rf"""WITH {STOK}, ty AS (SELECT DISTINCT tok FROM stok), sh AS (SELECT tok, {dan2('tok')} AS shape FROM ty), s AS (SELECT stok.*, shape FROM stok JOIN sh USING (tok)),
  w AS (SELECT tok, shape, lag(tok, 1, '') OVER o AS p, lead(tok, 1, '') OVER o AS n, lag(shape, 1, 'null') OVER o AS ps, lead(shape, 1, 'null') OVER o AS ns, lag(shape, 2, 'null') OVER o AS p2s FROM s WINDOW o AS (PARTITION BY doc_id, sent_id ORDER BY pos)),
  f AS (SELECT unnest([tok || '-WORD|C', p || '-PW|C', n || '-NW|C', tok || '-' || p || '-W-PW|C', tok || '-' || n || '-W-NW|C', shape || '-TYPE|C', ps || '-PTYPE|C', ns || '-NTYPE|C', p || '...' || shape || '-PW_CTYPE|C', shape || '...' || n || '-NW_CTYPE|C',
    ps || '...' || shape || '-PCTYPE|C', shape || '...' || ns || '-CNTYPE|C', ps || '...' || shape || '...' || ns || '-PCNTYPE|C', ps || '-' || shape || '-TYPES|CpC', 'PSEQ|CpC', tok || '-PSEQW|CpC', p || '-' || tok || '-PSEQW2|CpC', p || '-PSEQpW|CpC',
    p2s || '-' || ps || '-' || shape || '-TTPS|CpCp2C', p2s || '-' || ps || '-' || shape || '-TYPETYPES|CpCp2C', 'NSEQ|CnC', tok || '-NSEQW|CnC']) AS feature FROM w)
  SELECT feature, count(*)::BIGINT AS n FROM f GROUP BY feature""")
def feature_templates(spark, sf_dir):
    """Word, neighbour, shape and sequence templates of all tokens, counted."""
    groups = ("word", "neighbours", "word_pairs", "shape", "shape_neighbours", "shape_pairs", "types2", "sequence", "types_long", "next_sequence")
    return feature_counts.counted(context.sentence_arrays(read(spark, sf_dir, "documents")), groups, {"shape": feature_counts.dan2(spark)})


_CLASS = "CASE WHEN regexp_matches({0}, '^\\p{{Lu}}') THEN 'VB' WHEN regexp_matches({0}, '^[0-9]') THEN 'CD' ELSE 'NN' END"


@query(f"""WITH {STOK}, t AS (SELECT *, {_CLASS.format('tok')} AS g FROM stok), w AS (SELECT tok, g, lag(g, 1, 'null') OVER o AS p, lag(g, 2, 'null') OVER o AS p2, lag(g, 3, 'null') OVER o AS p3, lead(g, 1, 'null') OVER o AS n, lag(tok, 1, '') OVER o AS pw FROM t WINDOW o AS (PARTITION BY doc_id, sent_id ORDER BY pos)),
  f AS (SELECT unnest([g || '-TAG|C', p || '-PTAG|C', n || '-NTAG|C', p || '-' || g || '-' || n || '-PCNTAGS|C', g || '-' || n || '-CNTAGS|C', p || '-' || g || '-PCTAGS|C', tok || '-' || g || '-W-T|C', tok || '-' || p || '-W-PT|C', tok || '-' || n || '-W-NT|C', p || '-' || tok || '-PTAG-CWORD|C',
    p2 || '-' || p || '-' || g || '-TTS|C', p3 || '-' || p2 || '-' || p || '-' || g || '-TTTS|C', p || '-' || g || '-TS|CpC', p2 || '-' || p || '-' || g || '-TTS|CpCp2C', p3 || '-' || p2 || '-' || p || '-' || g || '-TTTS|CpCp2Cp3C']) AS feature FROM w)
  SELECT feature, count(*)::BIGINT AS n FROM f GROUP BY feature""")
def tag_templates(spark, sf_dir):
    """Tag templates of all tokens (words by class as tags), counted."""
    t = F.col("tok")
    s = context.tokenise_sentences(read(spark, sf_dir, "documents")).withColumn("tag", F.when(t.rlike(r"^\p{Lu}"), "VB").when(t.rlike("^[0-9]"), "CD").otherwise("NN"))
    return features.extract(s, ("tag", "tag_neighbours", "sym_tags", "word_tag", "more_tags", "extra_tags", "taggy", "taggy_long")).groupBy("feature").agg(F.count("*").alias("n"))


@query(f"""WITH {STOK}, w AS (SELECT *, lag(tok) OVER o AS p, lead(tok) OVER o AS n, lag(tok, 2) OVER o AS p2 FROM stok WINDOW o AS (PARTITION BY doc_id, sent_id ORDER BY pos)),
  f AS (SELECT unnest([CASE WHEN p IS NULL THEN 'BEGIN-SENT|C' ELSE 'IN-SENT|C' END, CASE WHEN length(tok) < 3 THEN 'Len-1-3|C' WHEN length(tok) < 6 THEN 'Len-3-6|C' WHEN length(tok) < 10 THEN 'Len-6-10|C' ELSE 'Len-10-Inf|C' END,
    CASE WHEN regexp_matches(tok, '^[0-9]{{1,18}}$') AND tok::BIGINT > 0 THEN 'POSITIVE_INTEGER|C' END, CASE WHEN tok = ')' AND p = '(' OR tok = ']' AND p = '[' THEN 'PAREN-MATCH|CpC' END, CASE WHEN tok = ')' AND p2 = '(' AND p <> ')' OR tok = ']' AND p2 = '[' AND p <> ']' THEN 'PAREN-MATCH|Cp2C' END]) AS feature FROM w)
  SELECT feature, count(*)::BIGINT AS n FROM f WHERE feature IS NOT NULL GROUP BY feature""")
def token_marks(spark, sf_dir):
    """Sentence starts, length bins, numbers and closing brackets."""
    s = context.tokenise_sentences(read(spark, sf_dir, "documents"))
    marks = [("C", F.slice(features.begin_features(), 1, 1)), ("C", F.array(features.binned_length())), ("C", features.number_features()), ("CpC", features.paren_match(1)), ("Cp2C", features.paren_match(2))]
    named = [(q, f"_x{i}") for i, (q, _) in enumerate(marks)]
    wide = s.withColumn("shape", F.lit("")).select("*", *(c.alias(f"_x{i}") for i, (_, c) in enumerate(marks)))
    rows = wide.select(F.explode(F.concat(*(features._with(F.col(c), f"|{q}") for q, c in named))).alias("feature"))
    return rows.groupBy("feature").agg(F.count("*").alias("n"))


@query()
def feature_extraction(spark, sf_dir):
    """Templates with ordinals and neighbour prefixes and suffixes, counted by clique."""
    s = context.tokenise_sentences(read(spark, sf_dir, "documents")).withColumn("shape", shape_dan2(F.col("tok")))
    s = s.select("*", features.ordinal_features().alias("_o"), features.neighbour_ngrams(4).alias("_n"))
    return features.extract(s, ("word", "shape"), [("C", F.col("_o")), ("CpC", F.col("_n"))]).groupBy("clique").agg(F.count("*").alias("n"))


#: Inline weights over token classes.
WEIGHTS = [("cap", "NAME", 1.5), ("cap", "O", -0.5), ("num", "NUM", 2.0), ("num", "O", -0.3), ("low", "O", 1.2), ("low", "NAME", -0.4), ("long", "NAME", 0.3), ("long", "NUM", -0.2)]
_W = "w(feature, label, w) AS (VALUES " + ", ".join(f"('{a}', '{b}', {c}::DOUBLE)" for a, b, c in WEIGHTS) + ")"
_FE = rf"WITH {TOK}, {_W}, fe AS (SELECT doc_id, pos, unnest([CASE WHEN regexp_matches(tok, '^\p{{Lu}}') THEN 'cap' WHEN regexp_matches(tok, '^[0-9]') THEN 'num' ELSE 'low' END, CASE WHEN length(tok) >= 8 THEN 'long' ELSE 'none' END]) AS feature FROM tok), sc AS (SELECT doc_id, pos, label, sum(w) AS score FROM fe JOIN w USING (feature) GROUP BY ALL)"


def token_features(spark, sf_dir):
    t = F.col("tok")
    kind = F.when(t.rlike(r"^\p{Lu}"), "cap").when(t.rlike("^[0-9]"), "num").otherwise("low")
    return tokens(spark, sf_dir).select("doc_id", "pos", F.explode(F.array(kind, F.when(F.length(t) >= 8, "long").otherwise("none"))).alias("feature"))


def weight_table(spark):
    return spark.createDataFrame(WEIGHTS, "feature string, label string, w double")


@query(f"{_FE} SELECT doc_id, pos, label, round(score - m - ln(sum(exp(score - m)) OVER (PARTITION BY doc_id, pos)), 6) AS logp FROM (SELECT *, max(score) OVER (PARTITION BY doc_id, pos) AS m FROM sc)")
def maxent_score(spark, sf_dir):
    s = models.scores(token_features(spark, sf_dir), weight_table(spark))
    return rounded(models.log_probabilities(s), "logp").select("doc_id", "pos", "label", "logp")


@query(f"{_FE}, r AS (SELECT doc_id, pos, label, row_number() OVER (PARTITION BY doc_id, pos ORDER BY score DESC, label) AS r FROM sc) SELECT label, count(*)::BIGINT AS n FROM r WHERE r = 1 GROUP BY label")
def maxent_classify(spark, sf_dir):
    s = models.scores(token_features(spark, sf_dir), weight_table(spark))
    return models.classify(s).groupBy("label").agg(F.count("*").alias("n"))


@query(f"{_FE}, b AS (SELECT doc_id, pos, label, score + CASE label WHEN 'NAME' THEN -1.5 ELSE 0 END AS score FROM sc), r AS (SELECT label, row_number() OVER (PARTITION BY doc_id, pos ORDER BY score DESC, label) AS r FROM b) SELECT label, count(*)::BIGINT AS n FROM r WHERE r = 1 GROUP BY label")
def biased_classify(spark, sf_dir):
    s = models.scores(token_features(spark, sf_dir), weight_table(spark), bias={"NAME": -1.5})
    return models.classify(s).groupBy("label").agg(F.count("*").alias("n"))


@query(f"WITH {_W}, u AS (SELECT feature, label, w * 0.75 AS w FROM w UNION ALL SELECT upper(feature), label, w * 0.25 FROM w UNION ALL SELECT feature, label, w * 0.25 FROM w) SELECT feature, label, round(sum(w), 6) AS w FROM u GROUP BY ALL HAVING feature IN (SELECT feature FROM u GROUP BY feature HAVING max(w) - min(w) > 0.4)")
def combined_weights(spark, sf_dir):
    w = weight_table(spark)
    other = w.union(w.select(F.upper("feature").alias("feature"), "label", "w"))
    raw = w.select("feature", "label", (F.col("w") * 0.75).alias("w")).union(other.select("feature", "label", (F.col("w") * 0.25).alias("w")))
    keep = models.prune_by_range(raw, 0.4).select("feature").distinct()
    return rounded(models.combine(w, 0.75, other, 0.25).join(keep, "feature", "left_semi"), "w")


@query(f"WITH {_W} SELECT feature, label, w FROM w ORDER BY abs(w) DESC, feature, label LIMIT 5")
def top_weights(spark, sf_dir):
    return models.top_weights(weight_table(spark), 5)


@query(f"{_FE} SELECT feature, label, round(sum(w), 4) AS w, count(*)::BIGINT AS n FROM fe JOIN w USING (feature) GROUP BY ALL")
def justification(spark, sf_dir):
    j = models.justification(token_features(spark, sf_dir), weight_table(spark))
    return j.groupBy("feature", "label").agg(F.round(F.sum("w"), 4).alias("w"), F.count("*").alias("n"))


@query(f"""{_FE.replace('WITH tok', 'WITH tok')}, lp AS (SELECT doc_id, pos, label, score - m - ln(sum(exp(score - m)) OVER (PARTITION BY doc_id, pos)) AS logp FROM (SELECT *, max(score) OVER (PARTITION BY doc_id, pos) AS m FROM sc)),
  gold AS (SELECT doc_id, pos, CASE WHEN regexp_matches(tok, '^\\p{{Lu}}') THEN 'NAME' WHEN regexp_matches(tok, '^[0-9]') THEN 'NUM' ELSE 'O' END AS label FROM tok)
  SELECT round(sum(logp), 2) AS ll FROM lp JOIN gold USING (doc_id, pos, label)""")
def model_log_likelihood(spark, sf_dir):
    s = models.scores(token_features(spark, sf_dir), weight_table(spark))
    gold = labelled(spark, sf_dir).select("doc_id", "pos", F.col("gold").alias("label"))
    return models.data_log_likelihood(s, gold).select(F.round("ll", 2).alias("ll"))


_NB = f"WITH {TOK}, f AS (SELECT DISTINCT t.doc_id, lower(tok) AS feature FROM tok t JOIN labels l ON l.doc_id = t.doc_id WHERE regexp_matches(tok, '^\\p{{L}}+$')), lab AS (SELECT doc_id, quality AS label FROM labels WHERE doc_id IN (SELECT doc_id FROM f))"


@query(f"""{_NB}, g AS (SELECT doc_id, feature FROM f UNION ALL SELECT doc_id, '*' FROM lab), e AS (SELECT label, count(*)::DOUBLE AS numc FROM lab GROUP BY label),
  fc AS (SELECT feature, label, count(*)::DOUBLE AS nfc FROM g JOIN lab USING (doc_id) GROUP BY ALL), nc AS (SELECT label, sum(nfc) AS nc FROM fc GROUP BY label), nf AS (SELECT feature, sum(nfc) AS nf FROM fc GROUP BY feature),
  k AS (SELECT count(*)::DOUBLE AS k, sum(nc) AS n, (SELECT sum(numc) FROM e) AS d FROM nc),
  w AS (SELECT nf.feature, nc.label, CASE WHEN nf = d THEN ln(numc / d) ELSE ln(((coalesce(nfc, 0) + 1) / (nf + k)) / (nc / n)) END AS w FROM nf CROSS JOIN nc CROSS JOIN k JOIN e USING (label) LEFT JOIN fc ON fc.feature = nf.feature AND fc.label = nc.label),
  s AS (SELECT doc_id, label, sum(w) AS score FROM g JOIN w USING (feature) GROUP BY ALL)
  SELECT doc_id AS example_id, label FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) AS r FROM s) WHERE r = 1""")
def nb_classify(spark, sf_dir):
    """Words and a feature that all examples have, which is the prior."""
    f, labels = labelled_features(spark, sf_dir)
    every = f.union(labels.select("example_id", F.lit("*").alias("feature")))
    w = models.naive_bayes(every, labels)
    return models.classify(models.scores(every, w, ("example_id",)), ("example_id",)).select("example_id", "label")


#: Label order and transition scores of the decoding queries.
ORDER = ["NAME", "NUM", "O"]
MOVE = np.array([[0.5, -1.0, 0.0], [-1.0, 0.25, 0.0], [0.0, 0.0, 0.25]])


def _emissions(spark, sf_dir):
    """A row a sentence with its scores by position and label."""
    t = context.sentence_arrays(read(spark, sf_dir, "documents"))
    score = lambda w: F.array(F.when(w.rlike(r"^\p{Lu}"), 1.0).otherwise(-0.5), F.when(w.rlike("^[0-9]"), 2.0).otherwise(-1.0), F.lit(0.25))
    return t.where(F.size("toks") > 0).select("doc_id", "sent_id", F.transform("toks", score).alias("emit"))


def _count(state: str) -> str:
    """Labels on the best way to a state, one column a label: those of its best predecessor, the earliest of equals."""
    move = dict(zip("abc", MOVE[:, "abc".index(state)].tolist(), strict=True))
    a, b, c = (f"(v.{s} + {w})" for s, w in move.items())
    return ", ".join(f"CASE WHEN {a} >= {b} AND {a} >= {c} THEN v.a{k} WHEN {b} >= {c} THEN v.b{k} ELSE v.c{k} END + {int(k == 'abc'.index(state))}" for k in range(3))


@query(rf"""WITH RECURSIVE {STOK}, e AS (SELECT doc_id, sent_id, pos, CASE WHEN regexp_matches(tok, '^\p{{Lu}}') THEN 1.0 ELSE -0.5 END::DOUBLE AS a, CASE WHEN regexp_matches(tok, '^[0-9]') THEN 2.0 ELSE -1.0 END::DOUBLE AS b, 0.25::DOUBLE AS c FROM stok),
  v(doc_id, sent_id, pos, a, b, c, a0, a1, a2, b0, b1, b2, c0, c1, c2) AS (SELECT doc_id, sent_id, pos, a, b, c, 1, 0, 0, 0, 1, 0, 0, 0, 1 FROM e WHERE pos = 0 UNION ALL
    SELECT e.doc_id, e.sent_id, e.pos, greatest(v.a + 0.5, v.b - 1.0, v.c) + e.a, greatest(v.a - 1.0, v.b + 0.25, v.c) + e.b, greatest(v.a, v.b, v.c + 0.25) + e.c, {_count("a")}, {_count("b")}, {_count("c")} FROM v JOIN e ON e.doc_id = v.doc_id AND e.sent_id = v.sent_id AND e.pos = v.pos + 1),
  l AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_id ORDER BY pos DESC) AS r FROM v), w AS (SELECT CASE WHEN a >= b AND a >= c THEN [a0, a1, a2] WHEN b >= c THEN [b0, b1, b2] ELSE [c0, c1, c2] END AS n FROM l WHERE r = 1),
  s AS (SELECT sum(n[1])::BIGINT AS x, sum(n[2])::BIGINT AS y, sum(n[3])::BIGINT AS z FROM w) SELECT label, n FROM (SELECT 'NAME' AS label, x AS n FROM s UNION ALL SELECT 'NUM', y FROM s UNION ALL SELECT 'O', z FROM s) WHERE n > 0""")
def viterbi_path(spark, sf_dir):
    d = models.decode_arrays(_emissions(spark, sf_dir), ORDER, MOVE)
    return d.select(F.explode("path").alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query(rf"""WITH RECURSIVE {STOK}, e AS (SELECT doc_id, sent_id, pos, CASE WHEN regexp_matches(tok, '^\p{{Lu}}') THEN 1.0 ELSE -0.5 END::DOUBLE AS a, CASE WHEN regexp_matches(tok, '^[0-9]') THEN 2.0 ELSE -1.0 END::DOUBLE AS b, 0.25::DOUBLE AS c FROM stok),
  v(doc_id, sent_id, pos, a, b, c) AS (SELECT doc_id, sent_id, pos, a, b, c FROM e WHERE pos = 0 UNION ALL
    SELECT e.doc_id, e.sent_id, e.pos, greatest(v.a + 0.5, v.b - 1.0, v.c) + e.a, greatest(v.a - 1.0, v.b + 0.25, v.c) + e.b, greatest(v.a, v.b, v.c + 0.25) + e.c FROM v JOIN e ON e.doc_id = v.doc_id AND e.sent_id = v.sent_id AND e.pos = v.pos + 1)
  SELECT doc_id, sent_id, round(max_by(greatest(a, b, c), pos), 6) AS path_score FROM v GROUP BY ALL""")
def viterbi_score(spark, sf_dir):
    return models.decode_arrays(_emissions(spark, sf_dir), ORDER, MOVE).select("doc_id", "sent_id", F.round("path_score", 6).alias("path_score"))


@query(f"WITH {LAB} SELECT gold AS label, row_number() OVER (ORDER BY gold <> 'O', gold) - 1 AS id FROM (SELECT DISTINCT gold FROM lab)")
def label_index(spark, sf_dir):
    return models.index_of(labelled(spark, sf_dir).select(F.col("gold").alias("label")), "label", "O")


@query(f"WITH {LAB} SELECT tok AS feature FROM lab GROUP BY tok HAVING count(*) = 1 AND min(gold) = 'O'")
def background_once(spark, sf_dir):
    from glossa.operators import aggregates

    return aggregates.observed_features_once_on_background(labelled(spark, sf_dir).select(F.col("tok").alias("feature"), F.col("gold").alias("label")))
