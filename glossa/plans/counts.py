"""Counter algebra, smoothing, selection: queries over token counts by language and source."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.operators import aggregates, counters, distributions
from glossa.plans.catalogue import query, read, rounded
from glossa.plans.corpus import tokens, tokens_with
from glossa.plans.sqltext import TOK

_C = f"WITH {TOK}, c AS (SELECT tok, count(*)::BIGINT AS n FROM tok GROUP BY tok)"
_EN = f"WITH {TOK}, a AS (SELECT tok, count(*)::BIGINT AS n FROM tok WHERE lang = 'en' GROUP BY tok), b AS (SELECT tok, count(*)::BIGINT AS n FROM tok WHERE lang = 'fr' GROUP BY tok), j AS (SELECT coalesce(a.tok, b.tok) AS tok, coalesce(a.n, 0) AS x, coalesce(b.n, 0) AS y FROM a FULL JOIN b ON a.tok = b.tok)"


def counter(spark, sf_dir):
    return counters.of(tokens(spark, sf_dir), "tok")


def two(spark, sf_dir):
    t = tokens_with(spark, sf_dir, "lang")
    return tuple(counters.of(t.where(F.col("lang") == x), "tok") for x in ("en", "fr"))


@query(f"{_C} SELECT max(n)::BIGINT AS max, min(n)::BIGINT AS min, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std FROM c")
def counter_summary(spark, sf_dir):
    return rounded(counters.summary(counter(spark, sf_dir)), "mean", "std")


@query(f"{_C} SELECT tok, n FROM c ORDER BY n DESC, tok LIMIT 1")
def counter_argmax(spark, sf_dir):
    return counters.argmax(counter(spark, sf_dir))


@query(f"{_C} SELECT round(max(m) + ln(sum(exp(n - m))), 6) AS log_sum FROM (SELECT ln(n) AS n, max(ln(n)) OVER () AS m FROM c)")
def counter_log_sum(spark, sf_dir):
    return rounded(counters.log_sum(counters.mapped(counter(spark, sf_dir), F.log)), "log_sum")


@query(f"{_C} SELECT tok, round(n / sum(n) OVER (), 9) AS share, round(1 + ln(n), 6) AS tf FROM c")
def counter_normalised(spark, sf_dir):
    c = counter(spark, sf_dir)
    return counters.normalise(c).join(counters.tf_log_scale(c).withColumnRenamed("n", "tf"), "tok").select("tok", F.round("n", 9).alias("share"), F.round("tf", 6).alias("tf"))


@query(f"{_EN} SELECT tok, (x + y)::BIGINT AS added, (x - y)::BIGINT AS subtracted, abs(x - y)::BIGINT AS absolute, least(x, y)::BIGINT AS shared FROM j")
def counter_arithmetic(spark, sf_dir):
    a, b = two(spark, sf_dir)
    x, y = F.col("x"), F.col("y")
    return counters.joined(a, b).select("tok", (x + y).alias("added"), (x - y).alias("subtracted"), F.abs(x - y).alias("absolute"), F.least(x, y).alias("shared"))


@query(f"{_EN} SELECT round(sum(least(x, y)) / sum(greatest(x, y)), 6) AS jaccard FROM j")
def counter_jaccard(spark, sf_dir):
    return rounded(counters.jaccard(*two(spark, sf_dir)), "jaccard")


@query(f"{_EN} SELECT round(sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))), 6) AS cosine FROM (SELECT x::DOUBLE AS x, y::DOUBLE AS y FROM j)")
def counter_cosine(spark, sf_dir):
    return rounded(counters.cosine(*two(spark, sf_dir)), "cosine")


@query(f"WITH {TOK}, c AS (SELECT lang, tok, count(*)::DOUBLE AS n FROM tok GROUP BY ALL), m AS (SELECT lang, sqrt(sum(n * n)) AS l2 FROM c GROUP BY lang) SELECT a.lang AS x, b.lang AS y, round(sum(a.n * b.n) / (any_value(p.l2) * any_value(q.l2)), 6) AS cosine FROM c a JOIN c b ON a.tok = b.tok AND a.lang < b.lang JOIN m p ON p.lang = a.lang JOIN m q ON q.lang = b.lang GROUP BY 1, 2")
def counter_cosine_lang_pairs(spark, sf_dir):
    c = counters.of(tokens_with(spark, sf_dir, "lang"), "lang", "tok")
    # languages are few: their counts meet in one row a word
    rows = c.groupBy("tok").agg(F.collect_list(F.struct("lang", F.col("n").cast("double").alias("n"))).alias("r"))
    pairs = rows.select(F.explode(F.flatten(F.transform("r", lambda a: F.transform(F.filter("r", lambda b: b["lang"] > a["lang"]), lambda b: F.struct(a["lang"].alias("x"), b["lang"].alias("y"), (a["n"] * b["n"]).alias("d")))))).alias("p")).groupBy("p.x", "p.y").agg(F.sum("p.d").alias("d"))
    m = c.groupBy("lang").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("l2"))
    out = pairs.join(m.toDF("x", "l"), "x").join(m.toDF("y", "r"), "y").select("x", "y", (F.col("d") / (F.col("l") * F.col("r"))).alias("cosine"))
    return rounded(out, "cosine")


@query(f"{_C} SELECT sum(n)::BIGINT AS l1, round(sqrt(sum(n * n)), 6) AS l2 FROM c")
def counter_norms(spark, sf_dir):
    return rounded(counters.norms(counter(spark, sf_dir)), "l2")


@query(f"WITH {TOK}, c AS (SELECT source, tok, count(*) AS n FROM tok GROUP BY ALL), t AS (SELECT source, sum(n) AS t FROM c GROUP BY source) SELECT source, round(-sum(n / t * log2(n / t)), 6) AS entropy FROM c JOIN t USING (source) GROUP BY source")
def entropy_by_source(spark, sf_dir):
    c = counters.of(tokens_with(spark, sf_dir, "source"), "source", "tok")
    # H = log2 T - sum n log2 n / T, so one aggregate is enough
    out = c.groupBy("source").agg((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("entropy"))
    return rounded(out, "entropy")


@query(f"{_EN}, k AS (SELECT x / sum(x) OVER () AS p, y / sum(y) OVER () AS q, ((x + y) / 2) / sum((x + y) / 2) OVER () AS m FROM j) SELECT round((sum(CASE WHEN p > 0 THEN p * log2(p / m) ELSE 0 END) + sum(CASE WHEN q > 0 THEN q * log2(q / m) ELSE 0 END)) / 2, 6) AS jensen_shannon FROM k")
def js_divergence(spark, sf_dir):
    return rounded(counters.jensen_shannon(*two(spark, sf_dir)), "jensen_shannon")


@query(f"{_EN}, k AS (SELECT x / sum(x) OVER () AS p, (0.7 * y + 0.3 * x) / sum(0.7 * y + 0.3 * x) OVER () AS q FROM j) SELECT round(sum(CASE WHEN p > 0 THEN p * log2(p / q) ELSE 0 END), 6) AS skew_divergence FROM k")
def skew_divergence(spark, sf_dir):
    return rounded(counters.skew_divergence(*two(spark, sf_dir), 0.7), "skew_divergence")


@query(f"{_EN} SELECT round(sum(x * log2((x + y) / t)), 4) AS cross_entropy FROM j, (SELECT sum(x + y) AS t FROM j) WHERE x > 0")
def cross_entropy(spark, sf_dir):
    a, b = two(spark, sf_dir)
    return counters.cross_entropy(a, counters.combine(a, b, "union")).select(F.round("cross_entropy", 4).alias("cross_entropy"))


@query(f"WITH {TOK}, b AS (SELECT tok AS l, lead(tok) OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM tok), p AS (SELECT l, r, count(*) AS n FROM b WHERE r IS NOT NULL GROUP BY ALL), t AS (SELECT sum(n) AS t FROM p), a AS (SELECT l, sum(n) AS na FROM p GROUP BY l), z AS (SELECT r, sum(n) AS nb FROM p GROUP BY r) SELECT l, r, n::BIGINT AS n, round(log2(n * t / (na * nb)), 6) AS pmi FROM p JOIN a USING (l) JOIN z USING (r), t WHERE n >= 5")
def pmi_bigrams(spark, sf_dir):
    from glossa.operators.context import ordered

    b = tokens(spark, sf_dir).select(F.col("tok").alias("l"), F.lead("tok").over(ordered("doc_id")).alias("r")).where("r is not null")
    return rounded(counters.pmi(counters.of(b, "l", "r"), "l", "r").where("n >= 5"), "pmi")


@query(f"{_C} SELECT max(least(value, above))::BIGINT AS h_index FROM (SELECT n AS value, sum(count(*)) OVER (ORDER BY n DESC) AS above FROM c GROUP BY n)")
def hindex_tokens(spark, sf_dir):
    return counters.h_index(counter(spark, sf_dir))


@query(f"{_C} SELECT n AS value, count(*)::BIGINT AS n FROM c GROUP BY c.n")
def count_of_counts(spark, sf_dir):
    return counters.count_counts(counter(spark, sf_dir))


@query(f"{_C} SELECT tok, n, row_number() OVER (ORDER BY n DESC, tok)::INTEGER - 1 AS rank FROM c ORDER BY n DESC, tok LIMIT 100")
def rank_counter(spark, sf_dir):
    return counters.ranked(counters.retain_top(counter(spark, sf_dir), 100))


@query(f"{_C} SELECT lower(tok) AS tok, sum(n)::BIGINT AS n FROM c GROUP BY 1 HAVING sum(n) >= 10 AND regexp_matches(lower(tok), '^th')")
def counter_retained(spark, sf_dir):
    return counters.retain(counters.transform_keys(counter(spark, sf_dir), F.lower), (F.col("n") >= 10) & F.col("tok").rlike("^th"))


@query(f"WITH {TOK}, c AS (SELECT lang, source, lower(tok) AS w FROM tok) SELECT lang, source, w, count(*)::BIGINT AS n, (grouping(lang) * 4 + grouping(source) * 2 + grouping(w))::BIGINT AS level FROM c GROUP BY ROLLUP (lang, source, w)")
def rollup_counts(spark, sf_dir):
    t = tokens_with(spark, sf_dir, "lang", "source")
    return counters.level_totals(counters.of(t.select("lang", "source", F.lower("tok").alias("w")), "lang", "source", "w"))


@query("PIVOT (SELECT lang, source FROM documents) ON source USING count(*)::BIGINT GROUP BY lang")
def counter_matrix(spark, sf_dir):
    """Documents by language and source; a column a source, of which there are few."""
    d = read(spark, sf_dir, "documents")
    return counters.matrix(counters.of(d, "lang", "source"), "lang", "source", sorted(r[0] for r in d.select("source").distinct().collect()))


@query(f"{_EN} SELECT count(*)::BIGINT AS differing FROM j WHERE x <> y")
def counter_comparison(spark, sf_dir):
    return counters.compare(*two(spark, sf_dir)).agg(F.count("*").alias("differing"))


# --- smoothing ---------------------------------------------------------------------------------------------------------------


@query(f"{_C}, t AS (SELECT sum(n)::DOUBLE AS t, count(*)::DOUBLE AS v FROM c) SELECT tok, round((n + 0.5) / (t + 0.5 * 1000000), 12) AS p, round((1000000 - v) * 0.5 / (t + 0.5 * 1000000), 9) AS reserved FROM c, t")
def lidstone_probs(spark, sf_dir):
    return distributions.lidstone(counter(spark, sf_dir), 1_000_000, 0.5).select("tok", F.round("p", 12).alias("p"), F.round("reserved", 9).alias("reserved"))


@query(f"{_C}, t AS (SELECT sum(n)::DOUBLE AS t, sum(least(n, 1.5))::DOUBLE AS low FROM c) SELECT tok, round((n - 1.5) / t, 12) AS p, round(low / t, 9) AS reserved FROM c, t WHERE n > 1.5")
def absolute_discount(spark, sf_dir):
    return distributions.absolute_discount(counter(spark, sf_dir), 1.5).select("tok", F.round("p", 12).alias("p"), F.round("reserved", 9).alias("reserved"))


@query(f"""{_C}, t AS (SELECT sum(n)::DOUBLE AS t, sum((n = 1)::INT)::DOUBLE AS n1 FROM c), cc AS (SELECT n, count(*)::DOUBLE AS m FROM c GROUP BY n),
  s AS (SELECT tok, CASE WHEN c.n < 10 THEN (c.n + 1) * b.m / a.m ELSE c.n::DOUBLE END AS star FROM c JOIN cc a ON a.n = c.n LEFT JOIN cc b ON b.n = c.n + 1)
  SELECT tok, round(star / sum(star) OVER () * (1 - n1 / t), 10) AS p, round(n1 / t, 9) AS reserved FROM s, t""")
def good_turing(spark, sf_dir):
    return distributions.good_turing(counter(spark, sf_dir), 1e6).select("tok", F.round("p", 10).alias("p"), F.round("reserved", 9).alias("reserved"))


@query(f"""{_C}, cc AS (SELECT n AS r, count(*)::DOUBLE AS m FROM c GROUP BY n), z AS (SELECT r, m, coalesce(lag(r) OVER o, 0) AS q, lead(r) OVER o AS t FROM cc WINDOW o AS (ORDER BY r)),
  y AS (SELECT r, m, m / (0.5 * (coalesce(t, 2 * r - q) - q)) AS zr FROM z), f AS (SELECT regr_slope(ln(zr), ln(r)) AS b FROM y)
  SELECT round(b, 6) AS slope, (SELECT count(*) FROM y)::BIGINT AS rows FROM f""")
def good_turing_line(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.orderBy("value")
    cc = counters.count_counts(counter(spark, sf_dir)).withColumn("q", F.coalesce(F.lag("value").over(w), F.lit(0))).withColumn("t", F.lead("value").over(w))
    z = cc.withColumn("z", F.col("n") / (0.5 * (F.coalesce("t", 2 * F.col("value") - F.col("q")) - F.col("q"))))
    return z.agg(F.round(F.regr_slope(F.log("z"), F.log("value")), 6).alias("slope"), F.count("*").alias("rows"))


@query()
def simple_good_turing(spark, sf_dir):
    return distributions.simple_good_turing(counter(spark, sf_dir))


@query(f"{_EN}, p AS (SELECT tok, (x + y) / sum(x + y) OVER () AS p0 FROM j) SELECT j.tok, round((x + 100 * p0) / ((SELECT sum(x) FROM j) + 100), 10) AS p FROM j JOIN p USING (tok)")
def dirichlet_prior(spark, sf_dir):
    a, b = two(spark, sf_dir)
    prior = counters.normalise(counters.combine(a, b, "union")).withColumnRenamed("n", "p")
    return distributions.dirichlet(a, prior, 100.0).select("tok", F.round("p", 10).alias("p"))


@query("SELECT source AS key, round(exp(x - m) / sum(exp(x - m)) OVER (), 9) AS p FROM (SELECT source, x, max(x) OVER () AS m FROM (SELECT source, count(*) / 10.0 AS x FROM documents GROUP BY source))")
def from_log_values(spark, sf_dir):
    c = counters.of(read(spark, sf_dir, "documents").select(F.col("source").alias("key")), "key")
    return distributions.from_logs(counters.mapped(c, lambda n: n / 10.0)).select("key", F.round("p", 9).alias("p"))


@query()
def sampled_keys(spark, sf_dir):
    return counters.sample_keys(counter(spark, sf_dir), 5, 11)


# --- features ----------------------------------------------------------------------------------------------------------------

_F = f"WITH {TOK}, f AS (SELECT DISTINCT t.doc_id, lower(tok) AS feature FROM tok t JOIN labels l ON l.doc_id = t.doc_id WHERE regexp_matches(tok, '^\\p{{L}}+$')), lab AS (SELECT doc_id, quality AS label FROM labels WHERE doc_id IN (SELECT doc_id FROM f))"


def labelled_features(spark, sf_dir):
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("example_id"), F.col("quality").alias("label"))
    t = tokens(spark, sf_dir).where(F.col("tok").rlike(r"^\p{L}+$")).select(F.col("doc_id").alias("example_id"), F.lower("tok").alias("feature")).distinct()
    f = t.join(labels.select("example_id"), "example_id", "left_semi")
    return f, labels.join(f.select("example_id").distinct(), "example_id", "left_semi")


@query(f"""{_F}, n AS (SELECT count(*)::DOUBLE AS t FROM lab), nl AS (SELECT label, count(*)::DOUBLE AS nl FROM lab GROUP BY label), nf AS (SELECT feature, count(*)::DOUBLE AS nf FROM f GROUP BY feature),
  nfl AS (SELECT feature, label, count(*)::DOUBLE AS k FROM f JOIN lab USING (doc_id) GROUP BY ALL), g AS (SELECT nf.feature, nf, nl, t, coalesce(k, 0) AS k FROM nf CROSS JOIN nl CROSS JOIN n LEFT JOIN nfl ON nfl.feature = nf.feature AND nfl.label = nl.label WHERE nf >= 5)
  SELECT feature, round(sum(-(nl / t) * log2(nl / t) + CASE WHEN k > 0 THEN nf / t * (k / nf) * log2(k / nf) ELSE 0 END + CASE WHEN nl - k > 0 THEN (1 - nf / t) * ((nl - k) / (t - nf)) * log2((nl - k) / (t - nf)) ELSE 0 END), 6) AS ig FROM g WHERE nf < t GROUP BY feature""")
def info_gain_labels(spark, sf_dir):
    f, labels = labelled_features(spark, sf_dir)
    n = labels.agg(F.count("*").alias("t"))
    frequent = aggregates.cutoff(f, 5)
    every = aggregates.feature_counts(f).crossJoin(F.broadcast(n)).where("n = t").select("feature")
    return rounded(aggregates.information_gain(frequent, labels).join(every, "feature", "left_anti"), "ig")


@query(f"WITH {TOK}, f AS (SELECT doc_id AS example_id, tok AS feature FROM tok), k AS (SELECT feature FROM f GROUP BY feature HAVING count(*) >= 3 AND count(*) <= 200) SELECT count(*)::BIGINT AS rows, count(DISTINCT feature)::BIGINT AS features FROM f WHERE feature IN (SELECT feature FROM k)")
def feature_cutoff(spark, sf_dir):
    f = tokens(spark, sf_dir).select(F.col("doc_id").alias("example_id"), F.col("tok").alias("feature"))
    return aggregates.totals(aggregates.cutoff(f, 3, 200)).select(F.col("tokens").alias("rows"), F.col("types").alias("features"))


@query(f"WITH {TOK}, tf AS (SELECT doc_id, tok, count(*) AS tf FROM tok GROUP BY ALL), n AS (SELECT count(DISTINCT doc_id) AS n FROM tok), df AS (SELECT tok, count(*) AS df FROM tf GROUP BY tok), w AS (SELECT doc_id, tok, tf * ln((n + 1) / (df + 0.5)) AS w FROM tf JOIN df USING (tok), n) SELECT doc_id AS example_id, tok AS feature, round(w / sum(w) OVER (PARTITION BY doc_id), 6) AS w FROM w")
def tfidf_l1(spark, sf_dir):
    return rounded(aggregates.tf_idf(tokens(spark, sf_dir).select(F.col("doc_id").alias("example_id"), F.col("tok").alias("feature"))), "w")


@query("SELECT doc_id AS example_id, lang AS feature, round(CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0 END, 6) AS value FROM (SELECT doc_id, lang, n_chars::DOUBLE AS v, min(n_chars) OVER (PARTITION BY lang)::DOUBLE AS lo, max(n_chars) OVER (PARTITION BY lang)::DOUBLE AS hi FROM documents)")
def min_max_scaled(spark, sf_dir):
    f = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("example_id"), F.col("lang").alias("feature"), F.col("n_chars").cast("double").alias("value"))
    return rounded(aggregates.scale_min_max(f), "value")


@query("SELECT doc_id AS example_id, lang AS feature, round((v - m) / s, 6) AS value FROM (SELECT doc_id, lang, n_chars::DOUBLE AS v, avg(n_chars) OVER (PARTITION BY lang) AS m, stddev_pop(n_chars) OVER (PARTITION BY lang) AS s FROM documents)")
def gaussian_scaled(spark, sf_dir):
    f = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("example_id"), F.col("lang").alias("feature"), F.col("n_chars").cast("double").alias("value"))
    return rounded(aggregates.scale_gaussian(f), "value")


@query("SELECT conv_id, min_by(text, turn) AS first, max_by(role, turn) AS last, count(*)::BIGINT AS n, min(length(text))::INTEGER AS shortest, max(length(text))::INTEGER AS longest, string_agg(role, '+' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def aggregators(spark, sf_dir):
    a = aggregates.aggregator
    c = read(spark, sf_dir, "conversations").withColumn("len", F.length("text"))
    return c.groupBy("conv_id").agg(a("FIRST", "text", "turn").alias("first"), a("LAST", "role", "turn").alias("last"), a("COUNT", "turn").alias("n"), a("MIN", "len", "turn").alias("shortest"), a("MAX", "len", "turn").alias("longest"), a("CONCAT", "role", "turn", "+").alias("roles"))


@query(f"WITH {TOK}, c AS (SELECT length(tok)::INTEGER AS len, count(*)::BIGINT AS n FROM tok GROUP BY 1) SELECT len, n FROM c WHERE n = (SELECT max(n) FROM c)")
def modes(spark, sf_dir):
    return aggregates.modes(tokens(spark, sf_dir).select(F.length("tok").alias("len")), "len")
