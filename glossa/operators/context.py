"""Context windows over token tables (doc_id, sent_id, pos, tok, ...): neighbours, disjunctions, patterns, nearest matches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.functions.text import TOKEN, tokens as token_array

SENTENCE = ("doc_id", "sent_id")


def tokenise(docs: DataFrame, text: str = "text", pattern: str = TOKEN) -> DataFrame:
    """(doc_id, pos, tok): one row a token, 0-based; narrow."""
    return docs.select("doc_id", F.posexplode(token_array(text, pattern)).alias("pos", "tok"))


def sentence_arrays(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, sent_id, toks): one row a sentence; sentences end at `.`, `!` or `?`, closing marks stay with them.  Within a row, so nothing is shuffled."""
    marked = F.regexp_replace(F.col(text), r"([.!?]+[)\]\"']*)(\s+|$)", "$1\u0001")
    parts = F.filter(F.split(marked, "\u0001"), lambda s: s.rlike(r"\S"))
    return docs.select("doc_id", F.posexplode(parts).alias("sent_id", "sentence")).select("doc_id", "sent_id", token_array("sentence").alias("toks"))


def tokenise_sentences(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, sent_id, pos, tok): the tokens of `sentence_arrays`, one row each."""
    return sentence_arrays(docs, text).select("doc_id", "sent_id", F.posexplode("toks").alias("pos", "tok"))


def with_offsets(docs: DataFrame, text: str = "text", pattern: str = TOKEN, space: str = r"\s*", after: bool = False) -> DataFrame:
    """Tokens with their character borders and what stands before them (white space, or what `space` matches); with `after` also what follows, so that texts can be rebuilt."""
    pieces = F.regexp_extract_all(F.col(text), F.lit(rf"({space})({pattern})"), F.lit(0))
    if after:  # what follows the last token is a piece of its own, so that it is found once a text and not once a token
        pieces = F.concat(pieces, F.array(F.regexp_extract(text, rf"({space})$", 1)))
    out = docs.select("doc_id", F.posexplode(pieces).alias("pos", "piece"))
    tok = F.regexp_replace("piece", rf"^{space}", "")
    by = Window.partitionBy("doc_id").orderBy("pos")
    end = F.sum(F.length("piece")).over(by.rowsBetween(Window.unboundedPreceding, 0)).cast("long")
    before = F.substring("piece", F.lit(1), F.length("piece") - F.length(tok))
    rows = out.select("doc_id", "pos", tok.alias("tok"), before.alias("before"), (end - F.length(tok)).alias("begin"), end.alias("end"))
    return rows.withColumn("after", F.lead("before").over(by)).where("after is not null") if after else rows


#: Tokens that end a sentence, and those that may follow its end and still belong to it.
SENTENCE_END, FOLLOWERS = r"^(?:\.|[!?]+)$", [")", "]", '"', "'", "''", "-RRB-", "-RSB-", "-RCB-"]


def split_sentences(df: DataFrame, ends: str = SENTENCE_END, followers: list[str] = FOLLOWERS, discard: list[str] = ("\n",), forced: list[str] = (), region: tuple[str, str] | None = None) -> DataFrame:
    """Tokens (doc_id, pos, tok, ...) with sent_id, and pos counted within sentences.

    A sentence ends with a token that `ends` matches and the followers right after it; tokens to discard go, those in `forced` go too and end a sentence.
    With a region (two regexes) only tokens between a begin and an end mark are kept, the marks not.
    """
    w = Window.partitionBy("doc_id").orderBy("pos")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    out = df
    if region:
        mark = F.when(F.col("tok").rlike(f"^(?:{region[0]})$"), 1).when(F.col("tok").rlike(f"^(?:{region[1]})$"), 0)
        out = out.withColumn("_in", mark).withColumn("_open", F.coalesce(F.last("_in", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))).where("_in is null and _open = 1").drop("_in", "_open")
    cut = F.col("tok").isin(*forced) if forced else F.lit(False)
    out = out.withColumn("_cut", F.sum(cut.cast("int")).over(w))
    out = out.where(~cut & (~F.col("tok").isin(*discard) if discard else F.lit(True)))
    follows = F.col("tok").isin(*followers) if followers else F.lit(False)
    # a token closes if it ends a sentence, or follows a token that does through followers alone
    closed = F.last(F.when(~follows, F.col("tok").rlike(ends)), True).over(before)
    starts = F.lag("_cut").over(w).isNull() | (F.lag("_cut").over(w) != F.col("_cut")) | F.coalesce(closed, F.lit(False)) & ~follows
    out = out.withColumn("_s", starts.cast("int")).withColumn("sent_id", (F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"))
    inner = F.row_number().over(Window.partitionBy("doc_id", "sent_id").orderBy("pos")) - 1
    rest = [x for x in df.columns if x not in ("doc_id", "pos")]
    return out.withColumn("_pos", inner).select("doc_id", "sent_id", F.col("_pos").alias("pos"), *rest)


def cap_documents(sizes: DataFrame, most: int) -> DataFrame:
    """(doc_id, sent_id, part): documents (doc_id, sent_id, n tokens) parted at sentence ends into pieces of at most `most` tokens; a longer sentence is a piece alone.

    A document's sentence sizes are one array, filled from the left in one pass.
    """

    @F.pandas_udf("array<int>")
    def parts(ns: pd.Series) -> pd.Series:
        def one(xs):
            out, part, held = [], 0, 0
            for x in xs:
                if held and held + x > most:
                    part, held = part + 1, 0
                held += x
                out.append(part)
            return out

        return ns.map(one)

    g = sizes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sent_id", "n"))).alias("_s"))
    return g.select("doc_id", F.inline(F.arrays_zip(F.col("_s.sent_id").alias("sent_id"), parts(F.col("_s.n")).alias("part"))))


def cap_sentences(df: DataFrame, cap: int = 250) -> DataFrame:
    """Sentences longer than `cap` tokens are cut into pieces of it."""
    return df.withColumn("part", F.floor(F.col("pos") / cap)).withColumn("pos", F.col("pos") % cap)


def ordered(*by: str):
    return Window.partitionBy(*(by or SENTENCE)).orderBy("pos")


def neighbour(column: str, k: int, fill: str = "<pad>", by: tuple[str, ...] = SENTENCE) -> Column:
    """The value k tokens away (before if negative), or the fill beyond the ends."""
    w = ordered(*by)
    return F.lag(column, -k, fill).over(w) if k < 0 else F.lead(column, k, fill).over(w)


def disjunction(column: str, width: int = 4, after: bool = True, by: tuple[str, ...] = SENTENCE) -> Column:
    """Sorted distinct values within `width` tokens on one side."""
    w = ordered(*by).rowsBetween(1, width) if after else ordered(*by).rowsBetween(-width, -1)
    return F.sort_array(F.collect_set(column).over(w))


def disjunction_features(df: DataFrame, column: str = "tok", width: int = 4, wide: int | None = None, shape: Column | None = None) -> DataFrame:
    out = df.withColumn("n", disjunction(column, width)).withColumn("p", disjunction(column, width, False))
    arrays = [F.transform("n", lambda x: F.concat(x, F.lit("-DISJN"))), F.transform("p", lambda x: F.concat(x, F.lit("-DISJP"))), F.transform(F.array_union("n", "p"), lambda x: F.concat(x, F.lit("-DISJE")))]
    if wide:
        out = out.withColumn("wn", disjunction(column, wide)).withColumn("wp", disjunction(column, wide, False))
        arrays += [F.transform("wn", lambda x: F.concat(x, F.lit("-DISJWN"))), F.transform("wp", lambda x: F.concat(x, F.lit("-DISJWP")))]
    if shape is not None:
        out = out.withColumn("_s", shape).withColumn("sn", disjunction("_s", width))
        arrays.append(F.transform("sn", lambda x: F.concat(x, F.lit("-DISJS"))))
    return out.withColumn("features", F.concat(*arrays)).select(*df.columns, "features")


def occurrence_patterns(df: DataFrame, low: int = 3, high: int = 149) -> DataFrame:
    """(doc_id, pos, tok, pattern): where else a name-case word before a small one stands, `low`..`high` tokens away in either direction.

    After another name-case word (X Y): XY-NEXT-OCCURRENCE-XY or XY-PREV-OCCURRENCE-XY if the word before is met with it, -Y if the word alone is.  Otherwise
    X-NEXT-OCCURRENCE- and YX, XY or X: a name-case word stands before it there, after it, or neither; looking back the two sides are tried the other way round.
    A token that is no such word, or has no lettered neighbours, gets NO-OCCURRENCE-PATTERN; one that is not met again gets no row.

    An equi-join on document, word and a distance bucket, so a frequent word is compared with its own surroundings only.
    """
    w = Window.partitionBy("doc_id").orderBy("pos")
    around = df.select("doc_id", "pos", "tok", F.lag("tok", 1, "").over(w).alias("prev"), F.lead("tok", 1, "").over(w).alias("next"))
    named = T.is_name_case
    right = named(F.col("tok")) & T.no_upper_case(F.col("next")) & T.has_letter(F.col("next")) & T.has_letter(F.col("prev"))
    bucket = F.floor(F.col("pos") / (high + 1))
    heads = around.where(right).withColumn("near", F.explode(F.array(bucket - 1, bucket, bucket + 1))).drop("next")
    again = around.where(named(F.col("tok"))).select("doc_id", F.col("pos").alias("at"), "tok", F.col("prev").alias("before"), F.col("next").alias("after"), bucket.alias("near"))
    gap = F.col("at") - F.col("pos")
    met = heads.join(again, ["doc_id", "near", "tok"]).where(F.abs(gap).between(low, high))
    pair = F.when(F.col("before") == F.col("prev"), "XY").otherwise("Y")
    left, other = named(F.col("before")), named(F.col("after"))
    forward, back = F.when(left, "YX").when(other, "XY").otherwise("X"), F.when(other, "YX").when(left, "XY").otherwise("X")
    side = F.when(gap > 0, "NEXT").otherwise("PREV")
    pattern = F.when(named(F.col("prev")), F.concat(F.lit("XY-"), side, F.lit("-OCCURRENCE-"), pair)).otherwise(F.concat(F.lit("X-"), side, F.lit("-OCCURRENCE-"), F.when(gap > 0, forward).otherwise(back)))
    found = met.select("doc_id", "pos", "tok", pattern.alias("pattern")).distinct()
    return found.union(around.where(~right).select("doc_id", "pos", "tok", F.lit("NO-OCCURRENCE-PATTERN")))


def nearest(df: DataFrame, column: str, condition: Column, before: bool = True, fill: str = "X") -> Column:
    """Value of the closest earlier (later) token that meets the condition."""
    w = ordered()
    value = F.when(condition, F.col(column))
    if before:
        return F.coalesce(F.last(value, True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(fill))
    return F.coalesce(F.first(value, True).over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(fill))


def position(df: DataFrame) -> DataFrame:
    return df.withColumn("position", (F.row_number().over(ordered("doc_id")) - 1).cast("string"))
