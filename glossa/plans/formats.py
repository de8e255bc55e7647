"""Sources and sinks: what a format makes of the tables, as text columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.operators import context
from glossa.plans.catalogue import query, read
from glossa.plans.labels import labelled
from glossa.plans.sqltext import LAB, STOK
from glossa.sources import readers, writers


def tagged(spark, sf_dir):
    """Sentence tokens with a letter tag and a lemma: x for words of letters, n for numbers, z for marks; lemma in small letters, none for marks."""
    s = context.tokenise_sentences(read(spark, sf_dir, "documents"))
    tag = F.when(F.col("tok").rlike(r"^\p{L}"), "x").when(F.col("tok").rlike("^[0-9]"), "n")
    return s.withColumn("tag", tag).withColumn("lemma", F.when(tag.isNotNull(), F.lower("tok")))


_T = rf"WITH {STOK}, t AS (SELECT *, CASE WHEN regexp_matches(tok, '^\p{{L}}') THEN 'x' WHEN regexp_matches(tok, '^[0-9]') THEN 'n' END AS tag FROM stok), w AS (SELECT doc_id, sent_id, pos, tok, tag, CASE WHEN tag IS NOT NULL THEN lower(tok) END AS lemma FROM t)"


@query(f"""{_T} SELECT doc_id, sent_id, '[' || string_agg('{{"Word":' || to_json(tok)::VARCHAR || ',"Tag":' || to_json(coalesce(tag, '-'))::VARCHAR || ',"Lemma":' || to_json(coalesce(lemma, tok))::VARCHAR || '}}', ', ' ORDER BY pos) || ']' AS line FROM w GROUP BY ALL""")
def json_export(spark, sf_dir):
    return writers.json(tagged(spark, sf_dir))


@query(f"""{_T} SELECT doc_id, sent_id, string_agg(CASE WHEN tag IS NULL THEN (pos + 1) || chr(9) || tok || chr(9) || '_' || chr(9) || '_' || chr(9) || '_' || chr(9)
   ELSE concat_ws(chr(9), pos + 1, tok, lemma, '_', tag, '_', '_', '_', '_', '_') END, chr(10) ORDER BY pos) AS line FROM w GROUP BY ALL""")
def conll_export(spark, sf_dir):
    t = tagged(spark, sf_dir).select("*", F.lit(None).cast("string").alias("answer"), F.lit(None).cast("string").alias("feats"), F.lit("_\t_\t_\t_").alias("syntax"))
    return writers.conllx(t)


@query(f"{_T} SELECT doc_id, sent_id, string_agg(tok || '|' || coalesce(tag, '-') || '|' || coalesce(lemma, tok), ' ' ORDER BY pos) AS line FROM w GROUP BY ALL")
def moses_export(spark, sf_dir):
    return writers.moses(tagged(spark, sf_dir))


@query(f"{_T} SELECT doc_id, sent_id, string_agg(tok || chr(9) || coalesce(tag, '-') || chr(9) || coalesce(lemma, tok), chr(10) ORDER BY pos) AS line FROM w GROUP BY ALL")
def vertical_export(spark, sf_dir):
    return writers.vertical(tagged(spark, sf_dir))


@query(f"{_T} SELECT doc_id, sent_id, string_agg(tok || chr(9) || coalesce(tag, '-') || chr(9) || coalesce(lemma, tok), chr(9) ORDER BY pos) AS line FROM w GROUP BY ALL")
def tab_export(spark, sf_dir):
    return writers.tab(tagged(spark, sf_dir))


@query(f"{_T} SELECT doc_id, sent_id, string_agg(lower(coalesce(lemma, tok)), ' ' ORDER BY pos) AS line FROM w GROUP BY ALL")
def lemma_export(spark, sf_dir):
    return writers.lemmas(tagged(spark, sf_dir))


@query(f"""WITH {LAB}, b AS (SELECT doc_id, pos, tok, gold, lag(gold, 1, 'O') OVER w AS p, lead(gold, 1, 'O') OVER w AS n FROM lab WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
  SELECT doc_id, string_agg(CASE WHEN gold <> 'O' AND gold <> p THEN '<' || gold || '>' ELSE '' END || tok || CASE WHEN gold <> 'O' AND gold <> n THEN '</' || gold || '>' ELSE '' END, ' ' ORDER BY pos) AS line FROM b GROUP BY doc_id""")
def inline_xml(spark, sf_dir):
    return writers.inline_xml(labelled(spark, sf_dir), ("doc_id",), "gold")


@query(f"WITH {LAB} SELECT doc_id, string_agg(tok || '/' || gold, ' ' ORDER BY pos) AS line FROM lab GROUP BY doc_id")
def slash_tags(spark, sf_dir):
    return writers.slash_tags(labelled(spark, sf_dir), ("doc_id",), "gold")


@query(f"WITH {LAB} SELECT doc_id, string_agg(tok || chr(9) || gold || chr(9) || guess, chr(10) ORDER BY pos) AS line FROM lab GROUP BY doc_id")
def comparison_export(spark, sf_dir):
    return writers.comparison(labelled(spark, sf_dir), ("guess",), ("doc_id",))


@query(f"WITH {LAB} SELECT doc_id, 0 AS sent_id, pos, tok, gold, guess FROM lab")
def evaluation_round_trip(spark, sf_dir):
    """Written in the evaluation format and read again."""
    text = writers.comparison(labelled(spark, sf_dir), ("guess",), ("doc_id",)).withColumnRenamed("line", "text")
    return readers.evaluation(text).withColumn("sent_id", F.col("sent_id").cast("int"))


@query(f"{_T} SELECT doc_id, sent_id, pos, tok, coalesce(tag, '-') AS tag, coalesce(lemma, tok) AS lemma FROM w WHERE NOT starts_with(tok, '<')")
def vertical_round_trip(spark, sf_dir):
    """Sentences written as vertical text with `</s>` lines and read again."""
    lines = writers.vertical(tagged(spark, sf_dir).where(~F.col("tok").startswith("<")))
    text = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sent_id", "line"))), lambda x: F.concat(F.lit("<s>\n"), x["line"], F.lit("\n</s>"))), "\n").alias("text"), F.sort_array(F.collect_set("sent_id")).alias("ids"))
    from pyspark.sql import Window

    v = readers.vertical(text).where("not markup").withColumn("pos", F.row_number().over(Window.partitionBy("doc_id", "sent_id").orderBy("line_no")) - 1)
    # sentences without a token have no lines: their numbers come from the written list
    ids = text.select("doc_id", F.posexplode("ids").alias("sent_id", "real"))
    return v.join(ids, ["doc_id", "sent_id"]).select("doc_id", F.col("real").alias("sent_id"), "pos", "tok", "tag", "lemma")


@query("SELECT page_id, (i - 1)::INTEGER AS ix, x AS record FROM (SELECT page_id, generate_subscripts(xs, 1) AS i, unnest(xs) AS x FROM (SELECT page_id, list_transform(regexp_extract_all(html, '(?s)<li(?: [^>]*)?>.*?</li>'), lambda e: regexp_replace(regexp_replace(e, '^<li(?: [^>]*)?>', ''), '</li>$', '')) AS xs FROM pages))")
def xml_begin_end_pages(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    return p.select("page_id", F.posexplode(readers.between_tags(F.col("html"), "li")).alias("ix", "record"))


@query("SELECT doc_id, (i - 1)::INTEGER AS ix, x AS record FROM (SELECT doc_id, generate_subscripts(xs, 1) AS i, unnest(xs) AS x FROM (SELECT doc_id, regexp_split_to_array(text, '[.!?]\\s') AS xs FROM documents))")
def delimited_records(spark, sf_dir):
    return readers.records(read(spark, sf_dir, "documents").select("doc_id", "text"), r"[.!?]\s")


@query("SELECT doc_id, count(*)::BIGINT AS n_lines, sum(length(trim(l)))::BIGINT AS chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY doc_id")
def line_source(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("l"))
    return d.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length(F.trim("l"))).alias("chars"))


@query("SELECT source || chr(9) || n AS line FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)")
def counter_lines(spark, sf_dir):
    return writers.counter_lines(read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")))


@query("SELECT doc_id AS example_id, quality || ' ' || '1:' || (n_chars % 7)::VARCHAR || '.0 2:' || (n_chars % 11)::VARCHAR || '.0' AS line FROM labels JOIN documents USING (doc_id)")
def svm_light_export(spark, sf_dir):
    d = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    rows = d.select(F.col("doc_id").alias("example_id"), F.col("quality").cast("string").alias("label"), F.explode(F.array(F.struct(F.lit(1).alias("feature"), (F.col("n_chars") % 7).cast("double").alias("value")), F.struct(F.lit(2).alias("feature"), (F.col("n_chars") % 11).cast("double").alias("value")))).alias("r"))
    return writers.svm_light(rows.select("example_id", "label", "r.*"))


@query("SELECT doc_id AS example_id, quality::VARCHAR AS label, k AS feature, v AS value FROM (SELECT doc_id, quality, unnest(['1', '2']) AS k, unnest([(n_chars % 7)::DOUBLE, (n_chars % 11)::DOUBLE]) AS v FROM labels JOIN documents USING (doc_id))")
def svm_light_round_trip(spark, sf_dir):
    return readers.svm_light(svm_light_export(spark, sf_dir).withColumnRenamed("line", "value")).select("example_id", "label", "feature", "value")


@query("SELECT lang || chr(9) || src0 || chr(9) || src1 AS line FROM (SELECT lang, sum((source = 'src0')::INT)::BIGINT AS src0, sum((source = 'src1')::INT)::BIGINT AS src1 FROM documents GROUP BY lang)")
def table_lines(spark, sf_dir):
    d = read(spark, sf_dir, "documents").withColumn("one", F.lit(1))
    return writers.table_text(d, "lang", "source", "one", ["src0", "src1"])
