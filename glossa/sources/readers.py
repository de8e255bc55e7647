"""Line, column, vertical and markup formats to token tables.

All readers are narrow projections over `spark.read.text` or a column of texts; sentence numbers come from a running count within a
document's array of lines, so a file is never pulled into one Python call.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.operators import context, morphology


def lines(spark: SparkSession, *paths: str, recursive: bool = False, glob: str | None = None, encoding: str = "UTF-8") -> DataFrame:
    """(path, value): one row a line of any number of files and folders."""
    r = spark.read.option("recursiveFileLookup", recursive).option("encoding", encoding)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.text(list(paths)).select(F.col("_metadata.file_path").alias("path"), "value")


def whole(spark: SparkSession, *paths: str, recursive: bool = False) -> DataFrame:
    return spark.read.option("recursiveFileLookup", recursive).text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def records(df: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """Pieces between matches of a regex."""
    return df.select(*[c for c in df.columns if c != text], F.posexplode(F.split(text, pattern)).alias("ix", "record"))


def between_tags(text: Column, tag: str, keep_tags: bool = False, keep_inner: bool = True) -> Column:
    """Array of what stands between <tag> and </tag>."""
    out = F.regexp_extract_all(text, F.lit(rf"(?s)<{tag}(?: [^>]*)?>.*?</{tag}>"), F.lit(0))
    if not keep_tags:
        out = F.transform(out, lambda x: F.regexp_replace(F.regexp_replace(x, rf"^<{tag}(?: [^>]*)?>", ""), rf"</{tag}>$", ""))
    return out if keep_inner else F.transform(out, lambda x: F.regexp_replace(x, r"<[^>]*>", ""))


def nested_tags_udf(tag: str, keep_tags: bool = False, keep_inner: bool = True):
    """Array of what stands between <tag> and its own </tag>: an element of the same name inside does not end it.  An element that is not closed is left out."""
    either = re.compile(rf"<(/?){re.escape(tag)}(?:\s[^>]*)?>")

    def pieces(text: str) -> list[str]:
        out, depth, begin, inner = [], 0, 0, 0
        for m in either.finditer(text):
            if not m[1]:
                if not depth:
                    begin, inner = m.start(), m.end()
                depth += 1
            elif depth:
                depth -= 1
                if not depth:
                    piece = text[begin : m.end()] if keep_tags else text[inner : m.start()]
                    out.append(piece if keep_inner else re.sub(r"<[^>]*>", "", piece))
        return out

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else pieces(t))

    return run


def files_matching(df: DataFrame, pattern: str | None = None, extension: str | None = None, numbers: tuple[int, int] | None = None) -> DataFrame:
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    out = df
    if pattern:
        out = out.where(name.rlike(f"^(?:{pattern})$"))
    if extension:
        out = out.where(name.endswith(f".{extension.lstrip('.')}"))
    if numbers:
        n = F.regexp_extract(name, r"([0-9]+)", 1)
        out = out.where((n != "") & n.cast("long").between(*numbers))
    return out


def folder_of(df: DataFrame) -> DataFrame:
    """Folder name as doc_id; files whose name starts with a dot are left out."""
    return df.where(~F.col("path").rlike(r"/\.[^/]*$")).withColumn("doc_id", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))


def _split_lines(text: str) -> Column:
    """Lines without carriage return, byte-order mark dropped."""
    return F.split(F.regexp_replace(F.regexp_replace(F.col(text), "^﻿", ""), "\r", ""), "\n")


def _numbered(df: DataFrame, text: str, is_border) -> DataFrame:
    """(doc_id, line_no, line, sent_id): sentence numbers by counting borders that end a sentence; one sort a document."""
    rows = df.select("doc_id", F.posexplode(_split_lines(text)).alias("line_no", "line"))
    w = Window.partitionBy("doc_id").orderBy("line_no")
    border = is_border(F.col("line"))
    starts = (~border) & F.coalesce(F.lag(border).over(w), F.lit(True))
    rows = rows.withColumn("_b", border).withColumn("_s", starts)
    return rows.withColumn("sent_id", F.sum(F.col("_s").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).where("not _b").drop("_b", "_s")


def _positions(rows: DataFrame) -> DataFrame:
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id", "sent_id").orderBy("line_no")) - 1)


def columns(df: DataFrame, names: dict[str, int], text: str = "text", sep: str = r"\s+") -> DataFrame:
    """Column format: blank lines part sentences, names give ordinals."""
    rows = _positions(_numbered(df, text, lambda x: ~x.rlike(r"\S")))
    parts = F.split(F.trim("line"), sep)
    return rows.select("doc_id", "sent_id", "pos", *(F.get(parts, F.lit(i)).alias(n) for n, i in names.items()))


def conll(df: DataFrame, text: str = "text") -> DataFrame:
    """2 to 5 columns by their number: word ans; word tag ans; word tag chunk ans; word lemma tag chunk ans.  More raise."""
    rows = _positions(_numbered(df, text, lambda x: F.size(F.split(F.trim(x), r"\s+")) < 2))
    p = F.split(F.trim("line"), r"\s+")
    n = F.size(p)
    at = lambda i: F.get(p, F.lit(i))
    bad = F.raise_error(F.concat(F.lit("too many columns: "), F.col("line")))
    return rows.select(
        "doc_id", "sent_id", "pos",
        F.when(n > 5, bad.cast("string")).otherwise(at(0)).alias("word"),
        F.when(n == 5, at(1)).alias("lemma"),
        F.when(n.isin(3, 4), at(1)).when(n == 5, at(2)).alias("tag"),
        F.when(n == 4, at(2)).when(n == 5, at(3)).alias("chunk"),
        F.get(p, n - 1).alias("answer"),
    )


def conllx(df: DataFrame, text: str = "text", stop_after_blank: int | None = None) -> DataFrame:
    """Tab columns idx, word, lemma, _, full tag, feats[, parent, label, gold]: fewer than 2 part sentences, 2 to 5 raise.  Coarse tag: first letter."""
    rows = _numbered(df, text, lambda x: F.size(F.split(F.trim(x), "\t")) < 2)
    if stop_after_blank is not None:
        w = Window.partitionBy("doc_id").orderBy("line_no")
        gap = F.col("line_no") - F.lag("line_no", 1, -1).over(w) - 1
        rows = rows.withColumn("_g", F.max(gap).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_g") <= stop_after_blank).drop("_g")
    rows = _positions(rows)
    p = F.split(F.trim("line"), "\t")
    at = lambda i: F.get(p, F.lit(i))
    bad = F.raise_error(F.concat(F.lit("too few columns: "), F.col("line"))).cast("string")
    return rows.select(
        "doc_id", "sent_id", "pos", at(0).cast("int").alias("idx"),
        F.when(F.size(p) < 6, bad).otherwise(at(1)).alias("word"),
        at(2).alias("lemma"), F.left(at(4), F.lit(1)).alias("tag"), at(4).alias("full_tag"), at(5).alias("feats"),
        at(6).cast("int").alias("parent"), at(7).alias("deprel"), at(8).alias("gold"),
    )


def tagger_lines(df: DataFrame, text: str = "text", keep: bool = False) -> DataFrame:
    """CoNLL input of the tagger: the token in column 1, `_` for a space unless it is the whole token; columns from 6 on kept if asked."""
    rows = _positions(_numbered(df, text, lambda x: ~x.rlike(r"\S")))
    p = F.split("line", "\t")
    word = F.get(p, F.lit(1))
    extra = F.array_join(F.slice(p, 7, F.greatest(F.size(p) - 6, F.lit(0))), "\t") if keep else F.lit(None).cast("string")
    return rows.select("doc_id", "sent_id", "pos", F.when(word == "_", word).otherwise(F.replace(word, F.lit("_"), F.lit(" "))).alias("tok"), F.array_join(F.slice(p, 7, 4), "\t").alias("syntax"), extra.alias("extra"))


def vertical(df: DataFrame, text: str = "text") -> DataFrame:
    """One token a line; `</s>` ends a sentence, other `<...>` lines are markup, `<` before a tab is a word; glue marks the token after `<g />`."""
    rows = df.select("doc_id", F.posexplode(_split_lines(text)).alias("line_no", "line")).where(F.col("line") != "")
    w = Window.partitionBy("doc_id").orderBy("line_no")
    markup = F.col("line").startswith("<") & ~F.col("line").startswith("<\t") & (F.col("line") != "<")
    ended = F.sum((F.col("line").startswith("</s>")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = rows.withColumn("markup", markup).withColumn("sent_id", F.coalesce(ended, F.lit(0))).withColumn("glue", F.coalesce(F.lag("line").over(w) == "<g />", F.lit(False)))
    p = F.split("line", "\t")
    return out.select("doc_id", "line_no", "sent_id", "markup", "glue", F.when(~F.col("markup"), F.get(p, F.lit(0))).alias("tok"), F.when(~F.col("markup"), F.get(p, F.lit(1))).alias("tag"), F.when(~F.col("markup"), F.get(p, F.lit(2))).alias("lemma"), F.when(~F.col("markup"), F.get(p, F.lit(3))).alias("extra"), "line")


def json_sentences(df: DataFrame, text: str = "text") -> DataFrame:
    return df.select("doc_id", F.posexplode(F.from_json(text, "array<string>")).alias("sent_id", "sentence"))


def gazetteer(df: DataFrame, value: str = "value") -> DataFrame:
    """`type phrase` lines."""
    return df.select(F.regexp_extract(value, r"^(\S+)\s+(.+)$", 1).alias("type"), F.regexp_extract(value, r"^(\S+)\s+(.+)$", 2).alias("phrase")).where("type <> ''")


def rules(df: DataFrame, value: str = "value") -> DataFrame:
    """`type<tab>phrase[<tab>overwritable,...][<tab>priority]`: the last field is a priority if it is a number."""
    p = F.split(value, "\t")
    n = F.size(p)
    last = F.get(p, n - 1)
    number = last.rlike(r"^-?[0-9.]+$") & (n > 2)
    bad = F.raise_error(F.concat(F.lit("2 to 4 fields: "), F.col(value))).cast("string")
    return df.select(F.when((n < 2) | (n > 4), bad).otherwise(F.get(p, F.lit(0))).alias("type"), F.get(p, F.lit(1)).alias("phrase"), F.when((n > 2) & ~(number & (n == 3)), F.split(F.get(p, F.lit(2)), ",")).alias("overwritable"), F.when(number, last.cast("double")).otherwise(1.0).alias("priority"))


def ordered_rules(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("priority"), F.desc(F.size(F.split("phrase", r"\s+"))))


def dictionary(df: DataFrame, value: str = "value") -> DataFrame:
    return df.select(F.trim(F.regexp_replace(value, "^﻿", "")).alias("word")).where("word <> ''").distinct()


def dist_sim(df: DataFrame, style: str = "word_class", bits: int | None = None, value: str = "value") -> DataFrame:
    """`word class` or `class<tab>word`, the class cut to its first bits."""
    p = F.split(value, r"\s+" if style == "word_class" else "\t")
    w, c = (F.get(p, F.lit(0)), F.get(p, F.lit(1))) if style == "word_class" else (F.get(p, F.lit(1)), F.get(p, F.lit(0)))
    return df.select(w.alias("word"), (F.left(c, F.lit(bits)) if bits else c).alias("class"))


def evaluation(df: DataFrame, text: str = "text") -> DataFrame:
    return columns(df, {"tok": 0, "gold": 1, "guess": 2}, text, "\t")


def svm_light(df: DataFrame, value: str = "value") -> DataFrame:
    """(example_id, label, feature, value) of `label idx:val ...`; comments after # go."""
    p = F.split(F.trim(F.regexp_replace(value, "#.*$", "")), r"\s+")
    rows = df.select("example_id", F.get(p, F.lit(0)).alias("label"), F.explode(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(1)))).alias("f"))
    return rows.select("example_id", "label", F.split("f", ":")[0].alias("feature"), F.split("f", ":")[1].cast("double").alias("value"))


def counter(df: DataFrame, keys: int = 1, value: str = "value") -> DataFrame:
    p = F.split(value, "\t")
    names = ["key"] if keys == 1 else [f"k{i + 1}" for i in range(keys)]
    return df.select(*(F.get(p, F.lit(i)).alias(n) for i, n in enumerate(names)), F.get(p, F.lit(keys)).cast("double").alias("n"))


def slash_tagged(text: Column, sep: str = "/") -> Column:
    """`word/TAG` tokens as structs; the last separator counts."""
    return F.transform(F.filter(F.split(text, r"\s+"), lambda x: x != ""), lambda x: F.struct(F.regexp_extract(x, rf"^(.*){sep}([^{sep}]*)$", 1).alias("tok"), F.regexp_extract(x, rf"^(.*){sep}([^{sep}]*)$", 2).alias("tag")))


def morphology_columns(df: DataFrame, lexicon: DataFrame, names: dict[str, int], text: str = "text") -> DataFrame:
    """Tab columns with `<g />` lines left out, each token with its readings from the lexicon and the best of them."""
    rows = columns(df.withColumn(text, F.regexp_replace(text, r"(?m)^<g ?/>\r?\n?", "")), names, text, r"\t+")
    return morphology.best_reading(morphology.readings(rows, lexicon))


def markup_text(df: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, pos, tok, before, begin, end): tokens of running text; markup and white space stand in `before` of the token they lead, those at the end in no token's."""
    return context.with_offsets(df, text, space=r"(?:\s|<!--(?s:.*?)-->|<[/!?]?[A-Za-z][^<>]*>)*")


def preprocessed(df: DataFrame, element: str | None = None, delimiter: str | None = None, tag_separator: str | None = None, text: str = "text", ends: str = r"^(?:\.|[!?]+)$") -> DataFrame:
    """(doc_id, sent_id, pos, tok, tag): plain text or the content of an element, parted into sentences by a delimiter (a regex) or by its tokens; words may carry tags."""
    parts = F.explode(nested_tags_udf(element)(F.col(text))) if element else F.col(text)
    docs = df.select("doc_id", parts.alias("_part"))
    if delimiter is not None:
        docs = docs.select("doc_id", F.explode(F.split("_part", delimiter)).alias("_part")).where(F.col("_part").rlike(r"\S"))
    docs = docs.groupBy("doc_id").agg(F.collect_list("_part").alias("_p")) if element or delimiter is not None else docs.select("doc_id", F.array("_part").alias("_p"))
    rows = docs.select("doc_id", F.posexplode("_p").alias("_k", "_part"))
    pieces = T.whitespace_tokens(F.col("_part")) if tag_separator else T.tokens("_part", T.RICH_TOKEN)
    t = rows.select("doc_id", "_k", F.posexplode(pieces).alias("_i", "_w"))
    cut = rf"^(.*){re.escape(tag_separator)}([^{re.escape(tag_separator)}]*)$" if tag_separator else None
    tok = F.coalesce(F.nullif(F.regexp_extract("_w", cut, 1), F.lit("")), F.col("_w")) if cut else F.col("_w")
    tag = F.nullif(F.regexp_extract("_w", cut, 2), F.lit("")) if cut else F.lit(None).cast("string")
    flat = t.select("doc_id", "_k", "_i", tok.alias("tok"), tag.alias("tag"))
    if delimiter is not None:
        return flat.select("doc_id", F.col("_k").alias("sent_id"), F.col("_i").alias("pos"), "tok", "tag")
    w = Window.partitionBy("doc_id").orderBy("_k", "_i")
    return context.split_sentences(flat.withColumn("pos", F.row_number().over(w) - 1).drop("_k", "_i"), ends)


def treebank(df: DataFrame, text: str = "value") -> DataFrame:
    """(path, ix, tree): all bracketed trees of files, each on one line; a tree may run over lines, text outside brackets is left out.

    Treebanks are put together by `union`, changed by `patterns.transformed`, and kept on disk as any table: all lazily.
    """

    def cut(s: str) -> list[str]:
        out, depth, begin = [], 0, 0
        for m in re.finditer(r"[()]", s):
            if m[0] == "(":
                begin = m.start() if not depth else begin
                depth += 1
            elif depth:
                depth -= 1
                if not depth:
                    out.append(" ".join(s[begin : m.end()].split()))
        return out

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: cut(t or ""))

    return df.select("path", F.posexplode(run(F.col(text))).alias("ix", "tree"))


#: Readers by name, for configurations that name one.
READERS = {"columns": columns, "conll": conll, "conllx": conllx, "tagger": tagger_lines, "vertical": vertical, "json": json_sentences, "evaluation": evaluation, "markup": markup_text, "preprocessed": preprocessed}
