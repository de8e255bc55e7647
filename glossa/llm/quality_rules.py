"""Quality rules: a threshold table compiled into one Spark projection (no user functions).

`measures` turns a text into a struct of counts, `verdict` compiles a table of
(name, numerator, denominator, low, high) rows into one boolean.  A ratio is kept as two integers, so
every comparison is exact: low * denominator <= scale * numerator <= high * denominator.

Defined results: a null or empty text has all counts 0 and fails the base rule; texts of any length are
measured whole; repeated rows are judged one by one; a ratio that equals its limit passes; an empty table gives an empty
table; a null doc_id is a document like any other; further columns are passed through untouched by `apply`, whatever their
names, and ignored by `digest`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import need

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8
#: Frequent function words of the four languages of the corpus.
STOP_WORDS = "the of and to in is that for with this der die und das den von zu mit nicht ist le la les de des et en un une que el los las y por se con del una"
#: Ratios in thousandths: (measure, base measure, lowest, highest); None: no limit.
THRESHOLDS = [
    ("word_chars", "n_words", 2_000, 15_000),  # mean word length
    ("n_symbols", "n_words", None, 400),  # symbols a word
    ("n_stop_words", "n_words", 20, None),  # function words a word
    ("n_dup_lines", "n_lines", None, 500),  # repeated lines a line
    ("n_shouted", "n_words", None, 500),  # words without a small letter
    ("n_bangs", "n_words", None, 500),  # exclamation marks a word
]


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the column `_m`, a struct of the counts of each text."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    words = F.filter(F.split(t, SPACE), lambda w: w != "")
    df = df.withColumn("_words", words).withColumn("_lines", F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n = F.size("_words")
    # one 64-bit key a window: hash above, place below; texts of n words need ceil(log2(n + 1)) bits for it
    bits = F.ceil(F.log2(n + F.lit(2))).cast("int")
    df = df.withColumn("_bits", bits).withColumn(
        "_keys",
        F.expr(
            f"""case when size(_words) >= {WINDOW} then
            transform(sequence(1, size(_words) - {WINDOW - 1}), i -> shiftright(xxhash64(slice(_words, i, {WINDOW})), _bits))
            else cast(array() as array<bigint>) end"""
        ),
    )
    # only texts with a repeated window pay for sorting
    df = df.withColumn(
        "_sorted",
        F.expr(
            """case when size(array_distinct(_keys)) < size(_keys) then
            sort_array(transform(_keys, (k, i) -> shiftleft(k, _bits) | i))
            else cast(null as array<bigint>) end"""
        ),
    )
    df = df.withColumn(
        "_at",
        F.expr(
            """case when _sorted is null then cast(array() as array<bigint>) else
            sort_array(transform(filter(_sorted, (k, i) ->
                (i > 0 and shiftright(get(_sorted, i - 1), _bits) = shiftright(k, _bits))
                or (i + 1 < size(_sorted) and shiftright(get(_sorted, i + 1), _bits) = shiftright(k, _bits))),
                k -> k & (shiftleft(1L, _bits) - 1))) end"""
        ),
    )
    stop = "array(" + ",".join(f"'{w}'" for w in STOP_WORDS.split()) + ")"
    repeat = F.expr(f"aggregate(transform(_at, (p, i) -> if(i = 0, {WINDOW}L, least({WINDOW}L, p - get(_at, i - 1)))), 0L, (a, x) -> a + x)")
    # a filter over the counts would be pushed below the projections and spell their expressions out anew for each use, without end;
    # a part that Spark takes for not deterministic (always 0) keeps filters above
    still = F.monotonically_increasing_id().bitwiseAND(F.lit(0))
    struct = F.struct(
        (n.cast("long") + still).alias("n_words"),
        F.length(F.regexp_replace(t, SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeat.alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.expr(f"size(filter(_words, w -> array_contains({stop}, lower(w))))").cast("long").alias("n_stop_words"),
        F.expr(r"size(filter(_words, w -> rlike(w, '\\p{Lu}') and not rlike(w, '\\p{Ll}')))").cast("long").alias("n_shouted"),
        F.length(F.regexp_replace(t, r"[^!]+", "")).cast("long").alias("n_bangs"),
    )
    return df.withColumn("_m", struct).drop("_words", "_lines", "_bits", "_keys", "_sorted", "_at")


def base_failed(m: str = "_m") -> Column:
    return (F.col(f"{m}.n_words") < 20) | (100 * F.col(f"{m}.n_repeat_words") > 30 * F.col(f"{m}.n_words"))


def verdict(m: str = "_m", table=THRESHOLDS) -> Column:
    """All rows of the table at once, as one expression."""
    good = F.lit(True)
    for top, base, low, high in table:
        a, b = F.col(f"{m}.{top}") * 1000, F.col(f"{m}.{base}")
        if low is not None:
            good = good & (a >= low * b)
        if high is not None:
            good = good & (a <= high * b)
    return good


def apply(df: DataFrame, text: str = "text", table=THRESHOLDS) -> DataFrame:
    """The rows of df that pass the base rule and the table, all columns as they were."""
    names = df.columns
    inner = df.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), F.col(f"`{text}`").alias("_text"))
    kept = measures(inner, "_text").where(~base_failed() & verdict(table=table))
    return kept.select(*(F.col(f"_row.`{c}`") for c in names))


def digest(df: DataFrame, table=THRESHOLDS) -> DataFrame:
    """The contract's columns for `documents`."""
    out = measures(need(df, "doc_id", "text"))
    return out.select("doc_id", *(f"_m.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), base_failed().alias("base_failed"), (~base_failed() & verdict(table=table)).alias("kept"))
