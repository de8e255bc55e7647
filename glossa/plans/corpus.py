"""Tokens, shapes, windows, strings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.operators import context, sets
from glossa.plans.catalogue import query, read, rounded
from glossa.plans.sqltext import SEN, STOK, TOK, dan2


def tokens(spark, sf_dir):
    return context.tokenise(read(spark, sf_dir, "documents"))


def tokens_with(spark, sf_dir, *extra):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", *extra, F.posexplode(T.tokens("text")).alias("pos", "tok"))


@query(f"WITH {TOK} SELECT lang, count(*)::BIGINT AS tokens, count(DISTINCT tok)::BIGINT AS types FROM tok GROUP BY lang")
def token_counts_by_lang(spark, sf_dir):
    c = tokens_with(spark, sf_dir, "lang").groupBy("lang", "tok").agg(F.count("*").alias("k"))
    return c.groupBy("lang").agg(F.sum("k").alias("tokens"), F.count("*").alias("types"))


@query(f"WITH {SEN} SELECT doc_id, count(*)::BIGINT AS n_sentences, max(length(sentence))::BIGINT AS longest FROM sen GROUP BY doc_id")
def sentence_stats(spark, sf_dir):
    marked = F.regexp_replace("text", r"([.!?]+[)\]\"']*)(\s+|$)", "$1\u0001")
    s = F.filter(F.split(marked, "\u0001"), lambda x: x.rlike(r"\S"))
    d = read(spark, sf_dir, "documents").select("doc_id", s.alias("s")).where(F.size("s") > 0)
    return d.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.array_max(F.transform("s", F.length)).cast("long").alias("longest"))


@query(f"WITH {TOK}, ty AS (SELECT tok, count(*)::BIGINT AS k FROM tok GROUP BY tok) SELECT {dan2('tok')} AS shape, sum(k)::BIGINT AS n FROM ty GROUP BY 1")
def word_shape_hist(spark, sf_dir):
    types = tokens(spark, sf_dir).groupBy("tok").agg(F.count("*").alias("k"))  # shapes once a type, not once a token
    return types.groupBy(T.shape_dan2(F.col("tok")).alias("shape")).agg(F.sum("k").alias("n"))


@query(rf"""WITH {TOK} SELECT CASE WHEN regexp_matches(tok, '^[0-9]*$') THEN 'ALL-DIGITS' WHEN regexp_matches(tok, '^\p{{Lu}}+$') THEN 'ALL-UPPER' WHEN regexp_matches(tok, '^\p{{Ll}}+$') THEN 'ALL-LOWER'
  WHEN regexp_matches(tok, '^\p{{Lu}}\p{{Ll}}+$') THEN 'MIXED-CASE' ELSE 'OTHER' END AS shape, count(*)::BIGINT AS n FROM tok GROUP BY 1""")
def word_shape_dan1(spark, sf_dir):
    types = tokens(spark, sf_dir).groupBy("tok").agg(F.count("*").alias("k"))
    return types.groupBy(T.shape_dan1(F.col("tok")).alias("shape")).agg(F.sum("k").alias("n"))


@query(f"WITH {TOK}, ty AS (SELECT DISTINCT lower(tok) AS w FROM tok WHERE regexp_matches(tok, '^\\p{{L}}+$')), s AS (SELECT '<' || w || '>' AS w FROM ty), g AS (SELECT DISTINCT w, '#' || substr(w, i::INT, k::INT) || '#' AS gram FROM s, range(1, 200) AS a(i), range(2, 5) AS b(k) WHERE i + k - 1 <= length(w)) SELECT gram, count(*)::BIGINT AS n FROM g GROUP BY gram")
def char_ngram_counts(spark, sf_dir):
    types = tokens(spark, sf_dir).where(F.col("tok").rlike(r"^\p{L}+$")).select(F.lower("tok").alias("w")).distinct()
    return types.select(F.explode(T.char_ngrams(F.col("w"), 2, 4)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query(f"WITH {STOK}, w AS (SELECT tok, coalesce(lag(tok) OVER o, '<pad>') AS prev, coalesce(lead(tok) OVER o, '<pad>') AS next FROM stok WINDOW o AS (PARTITION BY doc_id, sent_id ORDER BY pos)) SELECT tok, prev, next, count(*)::BIGINT AS n FROM w GROUP BY ALL HAVING count(*) > 1")
def prev_next_context(spark, sf_dir):
    s = context.tokenise_sentences(read(spark, sf_dir, "documents"))
    c = s.select("tok", context.neighbour("tok", -1).alias("prev"), context.neighbour("tok", 1).alias("next"))
    return c.groupBy("tok", "prev", "next").agg(F.count("*").alias("n")).where("n > 1")


@query(f"WITH {STOK}, x AS (SELECT s.tok, t.tok AS near FROM stok s JOIN stok t ON s.doc_id = t.doc_id AND s.sent_id = t.sent_id AND t.pos BETWEEN s.pos + 1 AND s.pos + 4), d AS (SELECT DISTINCT s.doc_id, s.sent_id, s.pos, s.tok, t.tok AS near FROM stok s JOIN stok t ON s.doc_id = t.doc_id AND s.sent_id = t.sent_id AND t.pos BETWEEN s.pos + 1 AND s.pos + 4) SELECT tok, near || '-DISJN' AS feature, count(*)::BIGINT AS n FROM d GROUP BY 1, 2 HAVING count(*) > 2")
def disjunctive_context(spark, sf_dir):
    s = context.tokenise_sentences(read(spark, sf_dir, "documents"))
    near = s.select("tok", context.disjunction("tok", 4).alias("near"))
    rows = near.select("tok", F.explode(F.transform("near", lambda x: F.concat(x, F.lit("-DISJN")))).alias("feature"))
    return rows.groupBy("tok", "feature").agg(F.count("*").alias("n")).where("n > 2")


_NAMED = r"regexp_matches({0}, '^\p{{Lu}}[^\p{{Lu}}]+$')"


@query(rf"""WITH {TOK}, t AS (SELECT doc_id, pos, tok, lag(tok, 1, '') OVER w AS prev, lead(tok, 1, '') OVER w AS next FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
  r AS (SELECT *, {_NAMED.format("tok")} AND NOT regexp_matches(next, '\p{{Lu}}') AND regexp_matches(next, '\p{{L}}') AND regexp_matches(prev, '\p{{L}}') AS ok FROM t),
  m AS (SELECT h.doc_id, h.pos, h.tok, h.prev, a.pos > h.pos AS forward, a.prev = h.prev AS pair, {_NAMED.format("a.prev")} AS l, {_NAMED.format("a.next")} AS o
    FROM r h JOIN r a ON a.doc_id = h.doc_id AND a.tok = h.tok AND abs(a.pos - h.pos) BETWEEN 3 AND 149 WHERE h.ok)
  SELECT DISTINCT doc_id, pos, tok, CASE WHEN {_NAMED.format("prev")} THEN 'XY-' || CASE WHEN forward THEN 'NEXT' ELSE 'PREV' END || '-OCCURRENCE-' || CASE WHEN pair THEN 'XY' ELSE 'Y' END
    WHEN forward THEN 'X-NEXT-OCCURRENCE-' || CASE WHEN l THEN 'YX' WHEN o THEN 'XY' ELSE 'X' END ELSE 'X-PREV-OCCURRENCE-' || CASE WHEN o THEN 'YX' WHEN l THEN 'XY' ELSE 'X' END END AS pattern FROM m
  UNION ALL SELECT doc_id, pos, tok, 'NO-OCCURRENCE-PATTERN' FROM r WHERE NOT ok""")
def occurrence_patterns(spark, sf_dir):
    return context.occurrence_patterns(tokens(spark, sf_dir))


@query(f"WITH {STOK} SELECT doc_id, sent_id, pos, coalesce(last_value(CASE WHEN length(tok) >= 10 THEN tok END IGNORE NULLS) OVER (PARTITION BY doc_id, sent_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'X') AS before FROM stok")
def nearest_long_word(spark, sf_dir):
    s = context.tokenise_sentences(read(spark, sf_dir, "documents"))
    return s.select("doc_id", "sent_id", "pos", context.nearest(s, "tok", F.length("tok") >= 10).alias("before"))


@query(f"WITH {TOK}, b AS (SELECT tok || ' ' || lead(tok) OVER (PARTITION BY doc_id ORDER BY pos) AS gram, tok || ' ' || lead(tok) OVER (PARTITION BY doc_id ORDER BY pos) || ' ' || lead(tok, 2) OVER (PARTITION BY doc_id ORDER BY pos) AS g3 FROM tok), u AS (SELECT gram FROM b WHERE gram IS NOT NULL UNION ALL SELECT g3 FROM b WHERE g3 IS NOT NULL) SELECT gram, count(*)::BIGINT AS n FROM u GROUP BY gram HAVING count(*) > 2")
def word_ngrams(spark, sf_dir):
    w = Window.partitionBy("doc_id").orderBy("pos")
    t = tokens(spark, sf_dir).select("tok", F.lead("tok").over(w).alias("a"), F.lead("tok", 2).over(w).alias("b"))
    grams = t.select(F.explode(F.array_compact(F.array(F.when(F.col("a").isNotNull(), F.concat_ws(" ", "tok", "a")), F.when(F.col("b").isNotNull(), F.concat_ws(" ", "tok", "a", "b"))))).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("n")).where("n > 2")


@query("SELECT doc_id, tok, before, begin, \"end\" FROM (SELECT doc_id, regexp_replace(piece, '^\\s+', '') AS tok, regexp_extract(piece, '^\\s*') AS before, (sum(length(piece)) OVER w - length(regexp_replace(piece, '^\\s+', '')))::BIGINT AS begin, (sum(length(piece)) OVER w)::BIGINT AS \"end\" FROM (SELECT doc_id, generate_subscripts(ps, 1) AS i, unnest(ps) AS piece FROM (SELECT doc_id, regexp_extract_all(text, '\\s*(?:[\\p{L}]+|[0-9]+(?:[.,][0-9]+)*|[^\\s\\p{L}0-9])') AS ps FROM documents)) WINDOW w AS (PARTITION BY doc_id ORDER BY i))")
def token_offsets(spark, sf_dir):
    return context.with_offsets(read(spark, sf_dir, "documents")).select("doc_id", "tok", "before", "begin", "end")


_STRINGS = r"""SELECT doc_id, upper(left(source, 1)) || substr(source, 2) AS capital, rpad(source, greatest(8, length(source))::INTEGER, '.') AS padded, lpad(source, greatest(8, length(source))::INTEGER, '.') AS padded_left,
  levenshtein(lang, source)::INTEGER AS distance, translate(text, 'éèêçñóíäöü', 'eeecnoiaou') AS ascii, regexp_replace(text, '[^\p{L}\p{N}]', '', 'g') AS alnum, regexp_matches(text, '^\p{Lu}') AS capitalised,
  replace(text, 'e', 'E') AS replaced, list_distinct(string_split(lang || ',' || source || ',' || lang, ',')) IS NOT NULL AS is_set FROM documents"""


@query(_STRINGS)
def string_functions(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(
        "doc_id", T.capitalise(F.col("source")).alias("capital"), T.pad(F.col("source"), 8, ".").alias("padded"), T.pad_left(F.col("source"), 8, ".").alias("padded_left"),
        F.levenshtein("lang", "source").alias("distance"), F.translate("text", "éèêçñóíäöü", "eeecnoiaou").alias("ascii"), T.strip_non_alnum(F.col("text")).alias("alnum"), T.is_capitalised(F.col("text")).alias("capitalised"),
        F.replace("text", F.lit("e"), F.lit("E")).alias("replaced"), F.array_distinct(F.split(F.concat_ws(",", "lang", "source", "lang"), ",")).isNotNull().alias("is_set"),
    )


@query()
def edit_distance_near_tokens(spark, sf_dir):
    """All pairs of distinct lettered words one edit apart."""
    words = tokens(spark, sf_dir).where(F.col("tok").rlike(r"^\p{L}+$")).select(F.lower("tok").alias("w")).distinct()
    return sets.one_edit_pairs(words, "w")


@query(rf"WITH {TOK} SELECT tok, regexp_matches(tok, '^\p{{Lu}}[^\p{{Lu}}]+$') AS name_case, NOT regexp_matches(tok, '\p{{Lu}}') AS no_upper, regexp_matches(tok, '\p{{L}}') AS letter, regexp_matches(lower(tok), '^([0-9]+(st|nd|rd|th)|([a-z]+-)?(first|second|third))$') AS ordinal, regexp_matches(tok, '^(Mr|Ms|Mrs|Dr|Miss|Sen|Judge|Sir)\.?$') AS title FROM tok GROUP BY tok")
def token_predicates(spark, sf_dir):
    w = F.col("tok")
    return tokens(spark, sf_dir).select("tok").distinct().select("tok", T.is_name_case(w).alias("name_case"), T.no_upper_case(w).alias("no_upper"), T.has_letter(w).alias("letter"), F.lower(w).rlike(r"^([0-9]+(st|nd|rd|th)|([a-z]+-)?(first|second|third))$").alias("ordinal"), T.is_title(w).alias("title"))


@query("SELECT doc_id, (i * 5) // n AS fold FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents) WHERE false UNION ALL SELECT doc_id, CASE WHEN i < (n % 7) * (n // 7 + 1) THEN i // (n // 7 + 1) ELSE n % 7 + (i - (n % 7) * (n // 7 + 1)) // (n // 7) END::BIGINT AS fold FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)")
def kfold_assign(spark, sf_dir):
    return sets.folds(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", 7)


@query("SELECT doc_id, ((i + 1) * 5 - 1) // n AS fold FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)")
def cross_validation_folds(spark, sf_dir):
    return sets.cross_validation(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", 5)


@query("SELECT doc_id, CASE WHEN i >= 100 AND i < 150 THEN 'dev' ELSE 'train' END AS part FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents)")
def train_dev_split(spark, sf_dir):
    return sets.train_dev(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", 100, 150)


@query(f"WITH {TOK}, a AS (SELECT DISTINCT lower(tok) AS w FROM tok WHERE lang = 'en'), b AS (SELECT DISTINCT lower(tok) AS w FROM tok WHERE lang = 'de') SELECT 'union' AS op, count(*)::BIGINT AS n FROM (SELECT w FROM a UNION SELECT w FROM b) UNION ALL SELECT 'intersection', count(*)::BIGINT FROM (SELECT w FROM a INTERSECT SELECT w FROM b) UNION ALL SELECT 'difference', count(*)::BIGINT FROM (SELECT w FROM a EXCEPT SELECT w FROM b) UNION ALL SELECT 'symmetric', count(*)::BIGINT FROM ((SELECT w FROM a EXCEPT SELECT w FROM b) UNION ALL (SELECT w FROM b EXCEPT SELECT w FROM a))")
def set_operations(spark, sf_dir):
    t = tokens_with(spark, sf_dir, "lang")
    a, b = (t.where(F.col("lang") == x).select(F.lower("tok").alias("w")).distinct() for x in ("en", "de"))
    parts = {"union": sets.union(a, b), "intersection": sets.intersection(a, b), "difference": sets.difference(a, b), "symmetric": sets.symmetric(a, b)}
    rows = [v.agg(F.count("*").alias("n")).select(F.lit(k).alias("op"), "n") for k, v in parts.items()]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


@query("SELECT k, list_sort(list(DISTINCT v)) AS keys FROM (SELECT source AS k, lang AS v FROM documents) GROUP BY k")
def inverted_map(spark, sf_dir):
    return sets.invert_sets(read(spark, sf_dir, "documents").select(F.col("lang").alias("k"), F.col("source").alias("v")))


@query(f"WITH {TOK}, c AS (SELECT doc_id, tok, count(*) AS n FROM tok GROUP BY ALL) SELECT doc_id, tok, n::BIGINT AS n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, tok) AS r FROM c) WHERE r <= 3")
def beam_topk(spark, sf_dir):
    return sets.beam(tokens(spark, sf_dir).groupBy("doc_id", "tok").agg(F.count("*").alias("n")), ["doc_id"], "n", 3)


@query("SELECT doc_id, list_transform(range(1, len(xs) + 1), lambda i: xs[i] - coalesce(xs[i - 1], 0)) AS gaps FROM (SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(text, '[\\p{L}]+'), lambda w: length(w)::BIGINT))) AS xs FROM documents)")
def gap_codes(spark, sf_dir):
    words = F.regexp_extract_all("text", F.lit(r"[\p{L}]+"), F.lit(0))
    d = read(spark, sf_dir, "documents").select("doc_id", F.sort_array(F.array_distinct(F.transform(words, lambda w: F.length(w).cast("long")))).alias("xs"))
    return d.select("doc_id", T.gap_encode(F.col("xs")).alias("gaps"))


@query(rf"WITH {TOK}, lows AS (SELECT DISTINCT tok AS w FROM tok WHERE regexp_matches(tok, '^\p{{Ll}}+$')), ty AS (SELECT tok, count(*)::BIGINT AS n FROM tok GROUP BY tok) SELECT t.tok, {dan2('t.tok')} || CASE WHEN regexp_matches(t.tok, '^[\p{{Lu}}\p{{Ll}}_]+$') AND l.w IS NOT NULL THEN 'k' ELSE '' END AS shape, n FROM ty t LEFT JOIN lows l ON lower(t.tok) = l.w")
def word_shape_known(spark, sf_dir):
    types = tokens(spark, sf_dir).groupBy("tok").agg(F.count("*").alias("n"))
    low = types.where(F.col("tok").rlike(r"^\p{Ll}+$")).select(F.col("tok").alias("w"))
    j = types.join(low, F.lower("tok") == F.col("w"), "left")
    return j.select("tok", T.shape_dan2(F.col("tok"), F.col("w").isNotNull()).alias("shape"), "n")


@query()
def lcs_lengths(spark, sf_dir):
    """Common subsequence and substring lengths of the whole texts with the next document's."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("a"))
    p = d.join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b")), "doc_id")
    return p.select("doc_id", T.common_subsequence_udf()("a", "b").alias("lcs"), T.common_substring_udf()("a", "b").alias("contiguous"))


@query(r"SELECT lang, round(ln(sum(exp(x - m))) + max(m), 6) AS log_sum, round(max(sig), 6) AS sigmoid FROM (SELECT lang, n_chars / 10000.0 AS x, max(n_chars / 10000.0) OVER (PARTITION BY lang) AS m, 1 / (1 + exp(-n_chars / 10000.0)) AS sig FROM documents) GROUP BY lang")
def math_functions(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("lang", (F.col("n_chars") / 10000.0).alias("x"))
    m = d.groupBy("lang").agg(F.max("x").alias("m"))
    j = d.join(m, "lang")
    out = j.groupBy("lang").agg((F.log(F.sum(F.exp(F.col("x") - F.col("m")))) + F.max("m")).alias("log_sum"), F.max(1 / (1 + F.exp(-F.col("x")))).alias("sigmoid"))
    return rounded(out, "log_sum", "sigmoid")
