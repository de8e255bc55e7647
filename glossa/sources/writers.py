"""Formatters: token tables (doc_id, sent_id, pos, tok, tag, lemma, ...) to text columns, one row a sentence unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.operators import patterns
from glossa.operators.trees import build

BY = ("doc_id", "sent_id")


def per_sentence(df: DataFrame, token_text: Column | Callable[[Callable[[str], Column]], Column], glue: str, by=BY, name: str = "line") -> DataFrame:
    """Token texts in order, joined; a sentence is a bounded group.

    A token text is a column, or a function that makes it of a token's columns.  With the latter df may hold sentences as rows
    instead, with their tokens in order as structs in an array `words`: they are written in place, nothing is shuffled, and all columns stay.
    """
    if "words" in df.columns:
        return df.withColumn(name, F.array_join(F.transform("words", lambda x: F.coalesce(token_text(lambda c: x[c]), F.lit(""))), glue))
    token_text = token_text if isinstance(token_text, Column) else token_text(F.col)
    rows = df.select(*by, "pos", token_text.alias("_t")).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", "_t"))).alias("_a"))
    return rows.select(*by, F.array_join(F.transform("_a", lambda x: F.coalesce(x["_t"], F.lit(""))), glue).alias(name))


def _token_columns(df: DataFrame) -> list[str]:
    return df.schema["words"].dataType.elementType.names if "words" in df.columns else df.columns


def underscored(c) -> Column:
    return F.replace(F.col(c) if isinstance(c, str) else c, F.lit(" "), F.lit("_"))


def json(df: DataFrame, by=BY) -> DataFrame:
    """`[{"Word":..,"Tag":..,"Lemma":..}, ...]`; without a reading the tag is - and the lemma the token."""
    row = F.to_json(F.struct(F.col("tok").alias("Word"), F.coalesce("tag", F.lit("-")).alias("Tag"), F.coalesce("lemma", "tok").alias("Lemma")))
    out = per_sentence(df, row, ", ", by)
    return out.withColumn("line", F.concat(F.lit("["), "line", F.lit("]")))


def conllx_line() -> Column:
    """idx, token, lemma, answer, tag, feats, syntax; no reading leaves blanks."""
    idx = (F.col("pos") + 1).cast("string")
    full = F.concat_ws("\t", idx, underscored("tok"), underscored("lemma"), F.when(F.coalesce("answer", F.lit("")) == "", "_").otherwise(F.col("answer")), "tag", F.coalesce("feats", F.lit("_")), F.coalesce("syntax", F.lit("_\t_\t_\t_")))
    return F.when(F.col("tag").isNull(), F.concat(idx, F.lit("\t"), underscored("tok"), F.lit("\t_\t_\t_\t"))).otherwise(full)


def conllx(df: DataFrame, by=BY) -> DataFrame:
    return per_sentence(df, conllx_line(), "\n", by)


def tab(df: DataFrame, by=BY) -> DataFrame:
    return per_sentence(df, F.concat_ws("\t", "tok", F.coalesce("tag", F.lit("-")), F.coalesce("lemma", "tok")), "\t", by)


def vertical(df: DataFrame, by=BY) -> DataFrame:
    """One token a line, `<g />` before a token that had no space before it (not at the start)."""
    row = F.concat_ws("\t", "tok", F.coalesce("tag", F.lit("-")), F.coalesce("lemma", "tok"))
    if "before" in df.columns:
        row = F.concat(F.when((F.col("before") == "") & (F.col("begin") > 0), F.lit("<g />\n")).otherwise(""), row)
    return per_sentence(df, row, "\n", by)


def moses(df: DataFrame, by=BY) -> DataFrame:
    return per_sentence(df, F.concat_ws("|", underscored("tok"), F.coalesce("tag", F.lit("-")), underscored(F.coalesce("lemma", "tok"))), " ", by)


def xml_words(df: DataFrame, by=BY) -> DataFrame:
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    return per_sentence(df, lambda c: F.concat(F.lit('<w form="'), esc(c("tok")), F.lit('" lemma="'), F.coalesce(esc(c("lemma")), esc(c("tok"))), F.lit('" tag="'), F.coalesce(esc(c("tag")), F.lit("-")), F.lit('"/>')), "\n", by)


def visl(df: DataFrame, by=BY) -> DataFrame:
    """Constraint-grammar cohorts: the token, then each reading."""
    r = F.array_join(F.transform(F.coalesce("readings", F.array().cast("array<struct<tag:string,lemma:string,estimate:double>>")), lambda x: F.concat(F.lit('\t"'), x["lemma"], F.lit('" '), x["tag"])), "\n")
    out = per_sentence(df, F.concat(F.lit('"<'), "tok", F.lit('>"\n'), r), "\n", by)
    return out.withColumn("line", F.concat("line", F.lit('\n"<<s>>"')))


def lemmas(df: DataFrame, save_case: bool = False, by=BY) -> DataFrame:
    m = underscored(F.coalesce("lemma", "tok"))
    return per_sentence(df, m if save_case else F.lower(m), " ", by)


def lower(df: DataFrame, by=BY) -> DataFrame:
    return per_sentence(df, lambda c: F.lower(underscored(c("tok"))), " ", by)


def all_tags(df: DataFrame, by=BY) -> DataFrame:
    tags = F.array_join(F.transform("readings", lambda x: x["tag"]), " ")
    return per_sentence(df, F.concat_ws(" ", "tok", tags), " ", by)


def with_borders(sentences: DataFrame, tag: str = "s") -> DataFrame:
    return sentences.withColumn("line", F.concat(F.lit(f"<{tag}>\n"), "line", F.lit(f"\n</{tag}>")))


def comparison(df: DataFrame, answers: tuple[str, ...], by=BY) -> DataFrame:
    return per_sentence(df, F.concat_ws("\t", "tok", "gold", *answers), "\n", by)


def in_features(df: DataFrame) -> DataFrame:
    """Features with the label appended, and where it came from if known."""
    out = F.concat("feats", F.lit("|ner="), "label")
    for column, name in (("distsim", "Distsim"), ("gaz", "Gaz"), ("gaz_file", "GazFile")):
        if column in df.columns:
            out = F.concat(out, F.when(F.col(column).isNotNull(), F.concat(F.lit(f"|{name}="), column)).otherwise(""))
    return df.withColumn("feats", out)


def slash_tags(df: DataFrame, by=BY, label: str = "label") -> DataFrame:
    return per_sentence(df, F.concat("tok", F.lit("/"), label), " ", by)


def inline_xml(df: DataFrame, by=BY, label: str = "label", keep_spacing: bool = False) -> DataFrame:
    """`<PER>a b</PER>`: neighbours of one label share an element."""
    w = Window.partitionBy(*by).orderBy("pos")
    l, p, n = F.col(label), F.lag(label, 1, "O").over(w), F.lead(label, 1, "O").over(w)
    t = df.withColumn("_o", F.when((l != "O") & (l != p), F.concat(F.lit("<"), l, F.lit(">"))).otherwise("")).withColumn("_c", F.when((l != "O") & (l != n), F.concat(F.lit("</"), l, F.lit(">"))).otherwise(""))
    lead = F.col("before") if keep_spacing else F.lit("")
    return per_sentence(t, F.concat(lead, "_o", "tok", "_c"), "" if keep_spacing else " ", by)


def wi_xml(df: DataFrame, by=BY, label: str = "label") -> DataFrame:
    return per_sentence(df, lambda c: F.concat(F.lit('<wi num="'), c("pos").cast("string"), F.lit('" entity="'), c(label), F.lit('">'), c("tok"), F.lit("</wi>")), " ", by)


def tf_json(df: DataFrame, by=BY, limit: int | None = None) -> DataFrame:
    """Sentences of {wordform, gold_tag, gold_lemma, attributes, options}, the last two if they are there."""
    more = [c for c in ("attributes", "options") if c in _token_columns(df)]
    row = lambda c: F.struct(c("tok").alias("wordform"), c("tag").alias("gold_tag"), c("lemma").alias("gold_lemma"), *(c(m).alias(m) for m in more))
    if "words" in df.columns:
        out = df.withColumn("line", F.to_json(F.transform("words", lambda x: row(lambda c: x[c]))))
    else:
        out = per_sentence(df, F.to_json(row(F.col)), ",", by).withColumn("line", F.concat(F.lit("["), "line", F.lit("]")))
    return out.orderBy(*by).limit(limit) if limit else out


def svm_light(df: DataFrame) -> DataFrame:
    """(example_id, line) of (example_id, label, feature, value), features in numeric order."""
    rows = df.groupBy("example_id", "label").agg(F.array_sort(F.collect_list(F.struct(F.col("feature").cast("long").alias("f"), "value"))).alias("_a"))
    return rows.select("example_id", F.concat_ws(" ", "label", F.array_join(F.transform("_a", lambda x: F.concat_ws(":", x["f"].cast("string"), x["value"].cast("string"))), " ")).alias("line"))


def counter_lines(df: DataFrame) -> DataFrame:
    return df.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in df.columns)).alias("line"))


def feature_lines(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Training export: token, answer, its features in order."""
    f = features.groupBy("doc_id", "pos").agg(F.array_join(F.sort_array(F.collect_set("feature")), "\t").alias("f"))
    return labels.join(f, ["doc_id", "pos"], "left").select("doc_id", "pos", F.concat_ws("\t", "tok", "label", "f").alias("line"))


def lattice(scores: DataFrame, moves: DataFrame) -> DataFrame:
    """Viterbi lattice arcs (doc_id, pos, tag, next_tag, score) of emission and move scores."""
    a = scores.select("doc_id", "pos", F.col("label").alias("tag"))
    b = scores.select("doc_id", (F.col("pos") - 1).alias("pos"), F.col("label").alias("next_tag"), "score")
    return a.join(b, ["doc_id", "pos"]).join(moves, ["tag", "next_tag"]).select("doc_id", "pos", "tag", "next_tag", (F.col("score") + F.col("w")).alias("score"))


def table_text(df: DataFrame, row: str, column: str, value: str, columns: list) -> DataFrame:
    """A two-way table as tab-parted lines, a header first."""
    m = df.groupBy(row).pivot(column, columns).agg(F.sum(value)).na.fill(0)
    return m.select(F.concat_ws("\t", F.col(row).cast("string"), *(F.col(f"`{c}`").cast("string") for c in columns)).alias("line"))


def entity_lines(entities: DataFrame) -> DataFrame:
    """Tab lines of name, normal_form, category, doc_id, count."""
    return entities.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in ("name", "normal_form", "category", "doc_id", "count"))).alias("line"))


def insert_statements(df: DataFrame, table: str) -> DataFrame:
    """One INSERT a row; quotes inside values are doubled, nulls are NULL.  Names are checked, so nothing but values comes from the data."""
    if not all(n.isidentifier() for n in (table, *df.columns)):
        raise ValueError("table and columns must be plain names")
    def value(f):
        c = F.col(f.name)
        text = c.cast("string") if f.dataType.typeName() in ("long", "integer", "short", "byte", "double", "float", "boolean", "decimal") else F.concat(F.lit("'"), F.replace(c.cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))
        return F.coalesce(text, F.lit("NULL"))

    return df.select(F.concat(F.lit(f"INSERT INTO {table} ({', '.join(df.columns)}) VALUES ("), F.concat_ws(", ", *map(value, df.schema.fields)), F.lit(");")).alias("line"))


def sparse_lines(df: DataFrame) -> DataFrame:
    """(example_id, line): label, then feature=value in the features' order, of (example_id, label, feature, value)."""
    rows = df.groupBy("example_id", "label").agg(F.array_sort(F.collect_list(F.struct("feature", "value"))).alias("_a"))
    return rows.select("example_id", F.concat_ws("\t", F.col("label").cast("string"), F.array_join(F.transform("_a", lambda x: F.concat_ws("=", x["feature"], x["value"].cast("string"))), "\t")).alias("line"))


def matrix_lines(df: DataFrame, features: list[str]) -> DataFrame:
    """(example_id, line): label and the value of each feature in the order given, 0 where there is none.  Features are the columns of a dense dump, so they are few."""
    m = df.groupBy("example_id", "label").pivot("feature", features).agg(F.sum("value")).na.fill(0.0)
    return m.select("example_id", F.concat_ws("\t", F.col("label").cast("string"), *(F.col(f"`{f}`").cast("string") for f in features)).alias("line"))


def _cells(df: DataFrame, row: str, column: str, value: str, columns: list) -> DataFrame:
    return df.groupBy(row).pivot(column, columns).agg(F.sum(value)).na.fill(0).select(F.col(row).cast("string").alias("_row"), F.array(*(F.col(f"`{c}`").cast("string") for c in columns)).alias("_v"))


def html_table(df: DataFrame, row: str, column: str, value: str, columns: list) -> DataFrame:
    """(key, line): a two-way table as HTML rows; the first, with an empty key, has the columns' names."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    def line(head, cells, tag):
        return F.concat(F.lit("<tr><th>"), safe(head), F.lit("</th>"), F.array_join(F.transform(cells, lambda c: F.concat(F.lit(f"<{tag}>"), safe(c), F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))

    body = _cells(df, row, column, value, columns)
    head = df.sparkSession.range(1).select(F.lit("").alias("key"), line(F.lit(""), F.array(*(F.lit(str(c)) for c in columns)), "th").alias("line"))
    return head.union(body.select("_row", line(F.col("_row"), F.col("_v"), "td")))


def ascii_table(df: DataFrame, row: str, column: str, value: str, columns: list, width: int = 12) -> DataFrame:
    """(key, line): the same in columns of `width` characters, keys to the left, numbers to the right."""
    right = lambda c: F.when(F.length(c) < width, F.lpad(c, width, " ")).otherwise(c)
    left = lambda c: F.when(F.length(c) < width, F.rpad(c, width, " ")).otherwise(c)
    line = lambda head, cells: F.concat(left(head), F.array_join(F.transform(cells, right), ""))
    body = _cells(df, row, column, value, columns)
    head = df.sparkSession.range(1).select(F.lit("").alias("key"), line(F.lit(""), F.array(*(F.lit(str(c)) for c in columns))).alias("line"))
    return head.union(body.select("_row", line(F.col("_row"), F.col("_v"))))


def fsm_lines(arcs: DataFrame) -> DataFrame:
    """A Viterbi lattice (doc_id, pos, tag, next_tag, score) as finite-state text: from, to, in, out, cost; states are places and tags."""
    state = lambda pos, tag: F.concat_ws("_", pos.cast("string"), tag)
    return arcs.select("doc_id", "pos", F.concat_ws("\t", state(F.col("pos"), F.col("tag")), state(F.col("pos") + 1, F.col("next_tag")), "next_tag", "next_tag", (-F.col("score")).cast("string")).alias("line"))


def _penn(n, depth: int) -> str:
    if not n.kids:
        return n.label
    if all(not k.kids for k in n.kids):
        return f"({n.label} {' '.join(k.label for k in n.kids)})"
    return f"({n.label}" + "".join(("\n" + "  " * (depth + 1) if k.kids else " ") + _penn(k, depth + 1) for k in n.kids) + ")"


def _latex(n) -> str:
    return f"[.{n.label} {' '.join(map(_latex, n.kids))} ]" if n.kids else n.label


def _xml(n, depth: int) -> str:
    label = escape(n.label, {'"': "&quot;"})
    pad = "  " * depth
    return f'{pad}<node value="{label}">\n' + "\n".join(_xml(k, depth + 1) for k in n.kids) + f"\n{pad}</node>" if n.kids else f'{pad}<leaf value="{label}"/>'


#: Layouts of a tree by name.
LAYOUTS = {"oneline": str, "penn": lambda n: _penn(n, 0), "latex": lambda n: f"\\Tree {_latex(n)}", "xml": lambda n: _xml(n, 0), "words": lambda n: " ".join(x.label for x in patterns.Numbered(n).nodes if not x.kids), "dependencies": lambda n: "\n".join(_edge(n, e) for e in patterns.edges(n)), "collapsed": lambda n: "\n".join(_edge(n, e) for e in patterns.edges(n, collapsed=True))}


def _edge(n, edge: tuple[str, int, int]) -> str:
    words = ["ROOT", *(x.label for x in patterns.Numbered(n).nodes if not x.kids)]
    r, g, d = edge
    return f"{r}({words[g + 1]}-{g + 1}, {words[d + 1]}-{d + 1})"


def tree_text(df: DataFrame, layout: str, text: str = "tree") -> DataFrame:
    """(tree_id, line): bracketed trees in a layout: oneline, penn, latex, xml, words, dependencies, collapsed."""
    show = LAYOUTS[layout]

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"tree_id": pdf["tree_id"], "line": [show(n) if (n := build(t)) else None for t in pdf[text]]})

    return df.select("tree_id", text).mapInPandas(run, "tree_id long, line string")


def in_order(df: DataFrame, line_no: str = "line_no", line: str = "line") -> DataFrame:
    """Output in input order; null lines are left out."""
    return df.where(F.col(line).isNotNull()).orderBy(line_no)


def write(df: DataFrame, path: str, column: str = "line", mode: str = "errorifexists") -> None:
    df.select(column).write.mode(mode).text(path)


#: Writers by name, for configurations that name one.
WRITERS = {"json": json, "conllx": conllx, "tab": tab, "vertical": vertical, "moses": moses, "xml": xml_words, "visl": visl, "lemmas": lemmas, "lower": lower, "slash_tags": slash_tags, "inline_xml": inline_xml, "wi_xml": wi_xml, "tf_json": tf_json}
