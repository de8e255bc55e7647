"""Morphology over a lexicon table (form, tag, lemma, estimate, attrs map) and a paradigm table (lemma, slot, form): providers are data.

Readings, best readings and lookups are joins on distinct word forms; only phrase inflection, whose rules look along a phrase, runs per phrase.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.functions.text import drop_attributes

NON_LEXICAL = ("source", "ending_id", "lexeme_id", "guess")


def readings(tokens: DataFrame, lexicon: DataFrame, key: str = "tok") -> DataFrame:
    """tokens with `readings`: array of (tag, lemma, estimate) in falling order of estimate; null for unknown words.  The lexicon is joined per distinct form."""
    forms = lexicon.groupBy(F.col("form").alias(key)).agg(F.array_sort(F.collect_list(F.struct((-F.col("estimate")).alias("r"), "tag", "lemma", "estimate"))).alias("_r"))
    return tokens.join(forms, key, "left").withColumn("readings", F.transform("_r", lambda x: F.struct(x["tag"].alias("tag"), x["lemma"].alias("lemma"), x["estimate"].alias("estimate")))).drop("_r")


def best_reading(df: DataFrame) -> DataFrame:
    """First reading with the highest estimate."""
    return df.withColumn("best", F.get("readings", F.lit(0)))


def reading_for(predicted: Column, readings_column: str = "readings") -> Column:
    """The reading whose tag is the predicted one; else the best."""
    r = F.col(readings_column)
    return F.coalesce(F.get(F.filter(r, lambda x: x["tag"] == predicted), F.lit(0)), F.get(r, F.lit(0)))


def lexical_only(attrs: Column) -> Column:
    return drop_attributes(attrs, *NON_LEXICAL)


def guess_by_suffix(words: DataFrame, lexicon: DataFrame, longest: int = 4) -> DataFrame:
    """Tag of unknown words from the longest known ending, by its most frequent tag."""
    lex = lexicon.select("form", "tag", F.explode(F.sequence(F.lit(1), F.lit(longest))).alias("n")).where("length(form) > n")
    ends = lex.groupBy(F.expr("right(form, n)").alias("suffix"), "tag").agg(F.count("*").alias("k")).groupBy("suffix").agg(F.max_by("tag", F.struct("k", "tag")).alias("tag"))
    w = words.select("tok").distinct().select("tok", F.explode(F.sequence(F.lit(1), F.lit(longest))).alias("n")).where("length(tok) > n").withColumn("suffix", F.expr("right(tok, n)"))
    return w.join(ends, "suffix").groupBy("tok").agg(F.max_by("tag", "n").alias("tag"))


def guess_gender(options: DataFrame) -> DataFrame:
    """(phrase_id, gender); options: phrase_id, word_ix, masculine, feminine (whether any reading has it)."""
    lacks = lambda c: F.max((~F.col(c)).cast("int")) == 1
    m, f = lacks("feminine") & ~lacks("masculine"), lacks("masculine") & ~lacks("feminine")
    return options.groupBy("phrase_id").agg(F.when(m, "masculine").when(f, "feminine").otherwise("unknown").alias("gender"))


CASES = ("nominative", "genitive", "dative", "accusative", "locative")


def inflect(phrases: DataFrame, paradigms: DataFrame, cases: tuple[str, ...] = CASES) -> DataFrame:
    """(phrase_id, forms map<case, phrase>); phrases: phrase_id, phrase, category.

    Words inflect if the paradigm table has them; in names of organisations and places words inside quotes, and words before a genitive
    modifier's head, stay as they are; a person's words all inflect.  One join on words, one small grouping a phrase.
    """
    clean = F.regexp_replace("phrase", " - ", "-")
    quoted = F.regexp_replace(clean, r'("[^"]*"|“[^”]*”|«[^»]*»)', "")
    words = phrases.select("phrase_id", "category", quoted.alias("_free"), F.posexplode(F.split(clean, " ")).alias("ix", "word"))
    n = F.size(F.split("_free", " "))
    words = words.withColumn("static", (F.instr("_free", F.col("word")) == 0) | ((F.col("category") != "person") & (F.col("ix") < n - 1) & F.col("word").rlike("(u|a|as|es|is)$") & ~F.col("word").rlike(r"^\p{Lu}\p{Ll}*(ais|ā)$")))
    grid = words.withColumn("slot", F.explode(F.array(*map(F.lit, cases))))
    p = paradigms.select(F.col("lemma").alias("word"), "slot", F.col("form"))
    out = grid.join(p, ["word", "slot"], "left").withColumn("form", F.when(F.col("static"), F.col("word")).otherwise(F.coalesce("form", "word")))
    per = out.groupBy("phrase_id", "slot").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ix", "form"))), lambda x: x["form"]), " ").alias("text"))
    return per.groupBy("phrase_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("slot", "text")))).alias("forms"))


def normal_form(df: DataFrame, lexicon: DataFrame) -> DataFrame:
    """The last word in genitive or locative gives way to its lemma, its case of letters kept."""
    last = F.regexp_extract("name", r"(\S+)$", 1)
    lex = lexicon.where(F.col("attrs")["case"].isin("genitive", "locative")).groupBy(F.col("form").alias("_last")).agg(F.max_by("lemma", "estimate").alias("_lemma"))
    out = df.withColumn("_last", F.lower(last)).join(lex, "_last", "left")
    cased = F.when(last.rlike(r"^\p{Lu}"), F.concat(F.upper(F.left("_lemma", F.lit(1))), F.substring("_lemma", 2, 1 << 20))).otherwise(F.col("_lemma"))
    return out.withColumn("norm", F.when(F.col("_lemma").isNotNull(), F.concat(F.expr("left(name, length(name) - length(_last))"), cased)).otherwise(F.col("name"))).drop("_last", "_lemma")


def entity_json(inflected: DataFrame) -> DataFrame:
    return inflected.select("phrase_id", F.to_json("forms").alias("json"))


def with_provider(df: DataFrame, column: str, provider) -> DataFrame:
    """Readings from a Python provider (word -> list of (tag, lemma, estimate)), called once a distinct word."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({column: pdf[column], "readings": [[{"tag": t, "lemma": m, "estimate": float(e)} for t, m, e in provider(w)] for w in pdf[column]]})

    kind = "array<struct<tag: string, lemma: string, estimate: double>>"
    found = df.select(column).distinct().mapInPandas(run, f"{column} string, readings {kind}")
    return df.join(found, column, "left")
