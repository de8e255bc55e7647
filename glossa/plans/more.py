"""Further operators of each group, one query each."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.operators import aggregates, context, counters, distributions, evaluate, gazetteer, models, sets, spans
from glossa.plans.catalogue import query, read, rounded
from glossa.plans.corpus import tokens, tokens_with
from glossa.plans.counts import counter, two
from glossa.plans.labels import GAZ, gaz, labelled
from glossa.plans.models import WEIGHTS, weight_table
from glossa.plans.sqltext import LAB, TOK
from glossa.sources import readers

_C = f"WITH {TOK}, c AS (SELECT tok, count(*)::BIGINT AS n FROM tok GROUP BY tok)"


@query(f"{_C}, r AS (SELECT *, row_number() OVER (ORDER BY n DESC, tok) - 1 AS rank, count(*) OVER () AS size FROM c) SELECT tok, n FROM r WHERE rank >= 100 AND rank < size - 500")
def ranks_dropped(spark, sf_dir):
    return counters.drop_ranks(counter(spark, sf_dir), 100, 500)


@query(f"{_C} SELECT tok, n FROM c ORDER BY n, tok LIMIT 50")
def bottom_retained(spark, sf_dir):
    return counters.retain_top(counter(spark, sf_dir), 50, True)


@query(f"{_C} SELECT sum(n)::BIGINT AS total FROM c WHERE tok IN (SELECT unnest(string_split(text, ' ')) FROM benchmark)")
def entries_summed(spark, sf_dir):
    keys = read(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("tok")).distinct()
    return counters.sum_of(counter(spark, sf_dir), keys)


@query(f"{_C} SELECT tok, round(n / sqrt(sum(n * n) OVER ()), 9) AS n FROM c")
def l2_normalised(spark, sf_dir):
    return counters.l2_normalise(counter(spark, sf_dir)).select("tok", F.round("n", 9).alias("n"))


@query(f"{_C} SELECT tok, round(sqrt(n) / sum(sqrt(n)) OVER (), 9) AS n FROM c")
def pow_normalised(spark, sf_dir):
    return counters.pow_normalised(counter(spark, sf_dir), 0.5).select("tok", F.round("n", 9).alias("n"))


@query(f"WITH {TOK}, a AS (SELECT tok, count(*)::BIGINT AS n FROM tok WHERE lang = 'en' GROUP BY tok), b AS (SELECT tok, count(*)::BIGINT AS n FROM tok WHERE lang = 'fr' GROUP BY tok) SELECT tok, a.n * b.n AS product, round(a.n / b.n, 6) AS quotient FROM a JOIN b USING (tok)")
def counter_products(spark, sf_dir):
    a, b = two(spark, sf_dir)
    p = counters.combine(a, b, "product").withColumnRenamed("n", "product")
    return rounded(p.join(counters.combine(a, b, "division").withColumnRenamed("n", "quotient"), "tok"), "quotient")


@query(f"WITH {TOK}, a AS (SELECT tok, count(*)::DOUBLE AS n FROM tok WHERE lang = 'en' GROUP BY tok), b AS (SELECT tok, count(*)::DOUBLE AS n FROM tok WHERE lang = 'fr' GROUP BY tok) SELECT coalesce(a.tok, b.tok) AS tok, round(0.25 * coalesce(a.n, 0) + 0.75 * coalesce(b.n, 0), 6) AS n FROM a FULL JOIN b ON a.tok = b.tok")
def linear_combination(spark, sf_dir):
    a, b = two(spark, sf_dir)
    return rounded(counters.linear(a, 0.25, b, 0.75), "n")


@query("SELECT lang AS k, source AS v, count(*)::BIGINT AS n FROM documents GROUP BY ALL")
def two_keys_reversed(spark, sf_dir):
    return counters.reverse_order(counters.of(read(spark, sf_dir, "documents").select(F.col("source").alias("k"), F.col("lang").alias("v")), "k", "v"))


@query("SELECT lang || chr(9) || source AS key, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def flattened_keys(spark, sf_dir):
    return counters.flatten(counters.of(read(spark, sf_dir, "documents"), "lang", "source"))


@query(f"{_C} SELECT tok, round(0.9 * n / sum(n) OVER (), 12) AS p FROM c")
def relative_with_reserve(spark, sf_dir):
    return distributions.relative(counter(spark, sf_dir), 0.1).select("tok", F.round("p", 12).alias("p"))


@query("SELECT source, round(1.0 / (SELECT count(DISTINCT source) FROM documents), 9) AS p FROM documents GROUP BY source")
def uniform_distribution(spark, sf_dir):
    return distributions.uniform(read(spark, sf_dir, "documents").select("source")).select("source", F.round("p", 9).alias("p"))


@query(f"{_C}, t AS (SELECT sum(n)::DOUBLE + 0.5 * (count(*) - 1) AS bottom FROM c) SELECT tok, round(CASE WHEN tok = 'the' THEN n ELSE n + 0.5 END / bottom, 12) AS p FROM c, t")
def laplace_unknown(spark, sf_dir):
    return distributions.laplace_unknown(counter(spark, sf_dir), "the", 0.5).select("tok", F.round("p", 12).alias("p"))


@query("SELECT source, round(1 / (1 + exp(-n)) / sum(1 / (1 + exp(-n))) OVER (), 9) AS p FROM (SELECT source, count(*) / 100.0 AS n FROM documents GROUP BY source)")
def logistic_distribution(spark, sf_dir):
    c = counters.mapped(counters.of(read(spark, sf_dir, "documents"), "source"), lambda n: n / 100.0)
    return distributions.logistic(c).select("source", F.round("p", 9).alias("p"))


@query("SELECT a.source AS k, b.n_regionkey::BIGINT AS v FROM (SELECT DISTINCT source, (length(source) % 25)::INTEGER AS m FROM documents) a JOIN nation b ON a.m = b.n_nationkey")
def composed_map(spark, sf_dir):
    f = read(spark, sf_dir, "documents").select(F.col("source").alias("k"), (F.length("source") % 25).alias("v")).distinct()
    return sets.compose(f, read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").cast("long").alias("v")))


@query("SELECT r_name AS x, n_name AS y FROM region, nation")
def cross_product(spark, sf_dir):
    return sets.product(read(spark, sf_dir, "region").select(F.col("r_name").alias("x")), read(spark, sf_dir, "nation").select(F.col("n_name").alias("y")))


@query(f"WITH {TOK.replace('tok AS (', 'tok AS MATERIALIZED (', 1)}, p AS MATERIALIZED (SELECT doc_id, pos + 1 AS parent, tok AS parent_tok FROM tok WHERE pos < 4) SELECT t.doc_id, t.pos, t.tok, parent_tok FROM (SELECT *, pos % 5 AS parent FROM tok) t LEFT JOIN p USING (doc_id, parent)")
def parent_lookup(spark, sf_dir):
    t = tokens(spark, sf_dir).select("doc_id", F.lit(0).alias("sent_id"), "pos", (F.col("pos") + 1).alias("idx"), (F.col("pos") % 5).alias("parent"), "tok")
    return sets.parent_token(t).select("doc_id", "pos", "tok", "parent_tok")


@query(f"WITH {TOK}, m AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, tok, lead(tok) OVER (PARTITION BY doc_id ORDER BY pos) AS nx FROM tok) WHERE tok = 'of' AND nx = 'the') SELECT tok, count(*)::BIGINT AS n FROM (SELECT tok.tok FROM tok LEFT JOIN m a ON a.doc_id = tok.doc_id AND a.pos = tok.pos LEFT JOIN m b ON b.doc_id = tok.doc_id AND b.pos + 1 = tok.pos WHERE a.pos IS NULL AND b.pos IS NULL UNION ALL SELECT 'of_the' FROM m) GROUP BY tok")
def merged_intervals(spark, sf_dir):
    t = tokens(spark, sf_dir)
    g = spark.createDataFrame([("X", "of the", 1.0)], "type string, phrase string, priority double")
    m = gazetteer.phrase_matches(t, g, [2]).select("doc_id", F.col("pos").alias("begin_pos"), (F.col("pos") + F.col("n")).alias("end_pos"), F.lit("of_the").alias("text"))
    return spans.replace_intervals(t, m).groupBy("tok").agg(F.count("*").alias("n"))


@query(f"WITH {LAB}, m AS (SELECT (gold = guess)::INT AS t, (lower(tok) = lower(regexp_replace(tok, 's$', '')))::INT AS l FROM lab) SELECT round(avg(t), 6) AS tag, round(avg(l), 6) AS lemma, round(avg(t * l), 6) AS both, count(*)::BIGINT AS n FROM m")
def morph_accuracy(spark, sf_dir):
    """Words as gold lemmas against words without a last s."""
    df = labelled(spark, sf_dir).select(F.col("gold").alias("gold_tag"), F.col("guess").alias("tag"), F.col("tok").alias("gold_lemma"), F.regexp_replace("tok", "s$", "").alias("lemma"))
    return rounded(evaluate.morph_accuracy(df), "tag", "lemma", "both")


@query(f"WITH {LAB}, x AS (SELECT unnest(['label', 'short']) AS attribute, unnest([gold, (length(tok) < 4)::VARCHAR]) AS g, unnest([guess, (length(tok) < 5)::VARCHAR]) AS v FROM lab) SELECT attribute, count(*)::BIGINT AS total, sum((g = v)::INT)::BIGINT AS ok, round(100 - sum((g = v)::INT) * 100 / count(*), 6) AS error FROM x GROUP BY attribute")
def attribute_error_rates(spark, sf_dir):
    df = labelled(spark, sf_dir).select(F.create_map(F.lit("label"), "gold", F.lit("short"), (F.length("tok") < 4).cast("string")).alias("gold_attrs"), F.create_map(F.lit("label"), "guess", F.lit("short"), (F.length("tok") < 5).cast("string")).alias("attrs"))
    return rounded(evaluate.attribute_errors(df), "error")


@query("WITH w(feature, label, w) AS (VALUES " + ", ".join(f"('{a}', '{b}', {c}::DOUBLE)" for a, b, c in WEIGHTS) + ") SELECT (CASE WHEN w < -1 THEN 0 WHEN w >= 2 THEN 7 ELSE floor((w + 1) / 0.5) + 1 END)::BIGINT AS bin, count(*)::BIGINT AS n FROM w GROUP BY 1")
def weight_histogram(spark, sf_dir):
    return models.weight_histogram(weight_table(spark), -1.0, 2.0, 6)


@query(f"WITH {TOK} SELECT doc_id, pos, pos::VARCHAR AS position FROM tok")
def token_positions(spark, sf_dir):
    return context.position(tokens(spark, sf_dir)).select("doc_id", "pos", "position")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{p}', {q}::DOUBLE)" for t, p, q in GAZ) + ") AS g(type, phrase, priority)")
def rule_lines(spark, sf_dir):
    """A rule list written as tab lines and read."""
    lines = gaz(spark).select(F.concat_ws("\t", "type", "phrase", F.format_string("%.1f", F.col("priority"))).alias("value"))
    return readers.rules(lines).select("type", "phrase", "priority")


@query("SELECT lang AS key, count(*)::DOUBLE AS n FROM documents GROUP BY lang")
def counter_round_trip(spark, sf_dir):
    c = counters.of(read(spark, sf_dir, "documents"), "lang")
    return readers.counter(c.select(F.concat_ws("\t", "lang", F.col("n").cast("string")).alias("value")))


@query("SELECT n_nationkey, array_to_string(list_transform(string_split(lower(n_name), ' '), lambda x: upper(left(x, 1)) || substr(x, 2)), ' ') AS name, replace(n_name, ' ', '_') AS file FROM nation")
def piece_capitals(spark, sf_dir):
    """Names with each piece capitalised, and as file names."""
    return read(spark, sf_dir, "nation").select("n_nationkey", T.capitalise_pieces(F.col("n_name")).alias("name"), T.file_name(F.col("n_name")).alias("file"))


@query(f"WITH {TOK}, f AS (SELECT DISTINCT lang, tok FROM tok) SELECT lang, tok[1] AS letter, count(*)::BIGINT AS n, md5(string_agg(tok, ' ' ORDER BY tok)) AS values FROM f GROUP BY ALL")
def multimap(spark, sf_dir):
    """Words of each language by their first character, as sorted sets."""
    t = tokens_with(spark, sf_dir, "lang").select(F.concat_ws(" ", "lang", F.left("tok", F.lit(1))).alias("k"), "tok")
    m = sets.multimap(t, "k", "tok")
    return m.select(F.split("k", " ")[0].alias("lang"), F.split("k", " ")[1].alias("letter"), F.size("values").cast("long").alias("n"), F.md5(F.array_join("values", " ").cast("binary")).alias("values"))


@query(f"WITH {TOK}, s AS (SELECT DISTINCT doc_id, tok FROM tok) SELECT count(*)::BIGINT AS tokens, count(DISTINCT tok)::BIGINT AS types FROM s")
def feature_totals(spark, sf_dir):
    return aggregates.totals(tokens(spark, sf_dir).select(F.col("doc_id").alias("example_id"), F.col("tok").alias("feature")).distinct())


@query()
def sampled_documents(spark, sf_dir):
    """A tenth of documents, stable by the hash of their id."""
    return sets.sample(read(spark, sf_dir, "documents").select("doc_id", "lang"), 0.1, 7, "doc_id")


@query("SELECT doc_id FROM documents")
def shuffled_documents(spark, sf_dir):
    return sets.shuffled(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", 7)


@query()
def word_shapes_all(spark, sf_dir):
    """Every shape function on every distinct word."""
    w = tokens(spark, sf_dir).select("tok").distinct()
    return w.select("tok", *(f(F.col("tok")).alias(n) for n, f in T.SHAPES.items()))


@query()
def rich_tokens(spark, sf_dir):
    """Rule tokenizer with addresses, dates and abbreviations, quotes and ellipses normalised."""
    t = context.tokenise(read(spark, sf_dir, "documents"), pattern=T.RICH_TOKEN)
    return t.groupBy(T.normalise_token(F.col("tok"), "ascii_quotes", "ptb3_ellipsis", "ptb3_dashes", "ptb3_parentheses").alias("tok")).agg(F.count("*").alias("n"))
