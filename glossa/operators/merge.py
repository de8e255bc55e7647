"""Merging label columns of several classifiers (main, aux) over the same tokens."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.operators.gazetteer import cased_key, list_labels, regex_labels
from glossa.operators.spans import chunks, overlapping


def runs(labels: list[str]) -> list[tuple[int, int, str]]:
    """(begin, end, label) of equal non-background labels in a row."""
    out, k = [], 0
    while k < len(labels):
        j = k
        while j < len(labels) and labels[j] == labels[k]:
            j += 1
        if labels[k] != "O":
            out.append((k, j, labels[k]))
        k = j
    return out


def longest(main: list[str], aux: list[str]) -> list[str]:
    """Greedy from the left: aux is taken where it ends before main starts, or overlaps it and is strictly longer; else main."""
    a, b, out, at = runs(main), runs(aux), ["O"] * len(main), 0
    i = j = 0
    while i < len(a) or j < len(b):
        while i < len(a) and a[i][0] < at:
            i += 1
        while j < len(b) and b[j][0] < at:
            j += 1
        x, y = a[i] if i < len(a) else None, b[j] if j < len(b) else None
        if x is None and y is None:
            break
        if x is None or y is not None and (y[1] <= x[0] or y[0] < x[1] and y[1] - y[0] > x[1] - x[0]):
            take = y
        else:
            take = x
        out[take[0] : take[1]] = [take[2]] * (take[1] - take[0])
        at = take[1]
    return out


def merge_longest(df: DataFrame, columns: list[str], by: str = "doc_id") -> DataFrame:
    """(by, pos, label): later columns are folded into the first in order; one document a call, bounded by its tokens."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        label = pdf[columns[0]].tolist()
        for c in columns[1:]:
            label = longest(label, pdf[c].tolist())
        return pd.DataFrame({by: pdf[by], "pos": pdf["pos"], "label": label})

    return df.select(by, "pos", *columns).groupBy(by).applyInPandas(one, f"{by} {df.schema[by].dataType.simpleString()}, pos {df.schema['pos'].dataType.simpleString()}, label string")


def fill_in(df: DataFrame, main: str, aux: str) -> DataFrame:
    """Aux chunks go in where no main label stands inside them; df has doc_id, pos, tok."""
    a, m = chunks(df, aux), chunks(df, main)
    clash = overlapping(a, m).select("doc_id", F.col("a0").alias("begin_pos"), F.col("a1").alias("end_pos")).distinct()
    free = a.join(clash, ["doc_id", "begin_pos", "end_pos"], "left_anti").select("doc_id", F.explode(F.sequence("begin_pos", F.col("end_pos") - 1)).alias("pos"), F.col("type").alias("_new"))
    return df.join(free, ["doc_id", "pos"], "left").withColumn("label", F.coalesce("_new", main)).drop("_new")


def provenance(main: DataFrame, aux: DataFrame, columns: tuple[str, ...] = ("distsim", "gaz", "gaz_file")) -> DataFrame:
    """Aux annotations replace main's where they are not null."""
    a = aux.select("doc_id", "pos", *(F.col(c).alias(f"_{c}") for c in columns))
    return main.join(a, ["doc_id", "pos"], "left").select(*(F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in main.columns))


def pipe(tokens: DataFrame, steps: list, by: str = "doc_id") -> DataFrame:
    """Named-entity pipe: each step makes (by, pos, label); labels are put side by side and folded longest-first."""
    out = tokens
    for k, step in enumerate(steps):
        out = out.join(step(tokens).select(by, "pos", F.col("label").alias(f"l{k}")), [by, "pos"])
    return merge_longest(out, [f"l{k}" for k in range(len(steps))], by)


def entity_steps(cased_lemmas: DataFrame, uncased_words: DataFrame, cased_words: DataFrame, lengths: list[int], crf, patterns: DataFrame) -> list:
    """Steps in the pipe's order: list of lemmas by case, list of words in any case, list of words by case, CRF tagger, regexes over lemmas.

    Tokens carry tok and lemma; `crf` is a step, as `tagger.step` makes one.
    """
    lemma = lambda t: list_labels(t.withColumn("_cased", cased_key(F.col("tok"), F.col("lemma"))), cased_lemmas, lengths, key="_cased")
    return [lemma, lambda t: list_labels(t, uncased_words, lengths, lower=True), lambda t: list_labels(t, cased_words, lengths), crf, lambda t: regex_labels(t, patterns)]


def compare(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumn("answers", F.array(*columns))


def entity_table(df: DataFrame, gold: str, guess: str, key: str = "text") -> DataFrame:
    """(phrase, gold type, guess type, n): chunks of both sides met by their borders, the unmatched with null."""
    a = chunks(df, gold).select("doc_id", "begin_pos", "end_pos", F.col("type").alias("gold"), F.lower(key).alias("g_text"))
    b = chunks(df, guess).select("doc_id", "begin_pos", "end_pos", F.col("type").alias("guess"), F.lower(key).alias("h_text"))
    return a.join(b, ["doc_id", "begin_pos", "end_pos"], "full").groupBy(F.coalesce("g_text", "h_text").alias("phrase"), "gold", "guess").agg(F.count("*").alias("n"))
