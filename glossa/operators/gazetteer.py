"""Gazetteer, list and pattern matching as joins on token n-grams; gazetteers are tables (type, phrase, ...) of any size.

A match never walks a trie in Python: token windows that begin with an entry's first word, of each phrase length that occurs, are joined on their
text, so both sides are hashed on the phrase, and Spark broadcasts the gazetteer only where it is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BY = ("doc_id",)


def entries(gaz: DataFrame, lower: bool = False) -> DataFrame:
    """Adds the phrase's key and its length in tokens; phrase tokens are parted by single spaces."""
    key = F.lower("phrase") if lower else F.col("phrase")
    return gaz.withColumn("key", key).withColumn("n_tok", F.size(F.split("phrase", " ")))


def windows(tokens: DataFrame, lengths: list[int], key: str = "tok", by=BY, firsts: DataFrame | None = None) -> DataFrame:
    """(by, pos, n, key): the text of n tokens from pos on, for the given lengths; one sort a document.

    With `firsts` (one column, the words that entries begin with) only windows that begin with one of them are made.
    """
    w = Window.partitionBy(*by).orderBy("pos")
    wide = tokens.select(*by, "pos", F.col(key).alias("_k0"), *(F.lead(key, i).over(w).alias(f"_k{i}") for i in range(1, max(lengths))))
    if firsts is not None:
        wide = wide.join(firsts.select(F.col(firsts.columns[0]).alias("_k0")).distinct(), "_k0", "left_semi")
    each = [F.when(F.col(f"_k{n - 1}").isNotNull(), F.struct(F.lit(n).alias("n"), F.concat_ws(" ", *(f"_k{i}" for i in range(n))).alias("key"))) for n in lengths]
    return wide.select(*by, "pos", F.inline(F.array_compact(F.array(*each))))


def cased_key(token: Column, lemma: Column) -> Column:
    """Lemma with its first letter's case taken from the token."""
    return F.when(token.rlike(r"^\p{Lu}"), F.concat(F.upper(F.left(lemma, F.lit(1))), F.substring(lemma, 2, 1 << 20))).otherwise(lemma)


def phrase_matches(tokens: DataFrame, gaz: DataFrame, lengths: list[int], lower: bool = False, key: str = "tok", by=BY) -> DataFrame:
    """(by, pos, n, type, phrase, priority): every place where all tokens of an entry stand in a row."""
    t = tokens.withColumn("_k", F.lower(key)) if lower else tokens.withColumn("_k", F.col(key))
    g = entries(gaz, lower)
    win = windows(t, lengths, "_k", by, g.select(F.split("key", " ")[0]))
    extra = [c for c in ("priority", "overwritable") if c in gaz.columns]
    return win.join(g.select("key", "type", "phrase", "n_tok", *extra), (win.key == g.key) & (win.n == g.n_tok)).select(*(win[c] for c in by), "pos", "n", "type", "phrase", *extra)


def sloppy_features(tokens: DataFrame, gaz: DataFrame, lower: bool = False, by=BY) -> DataFrame:
    """(by, pos, features): a token that is part of an entry gets TYPE-GAZS<tokens of the entry>, as a set."""
    g = entries(gaz, lower).select("type", "n_tok", F.explode(F.split("key", " ")).alias("word")).distinct()
    t = tokens.withColumn("word", F.lower("tok") if lower else F.col("tok"))
    return t.join(g, "word").groupBy(*by, "pos").agg(F.sort_array(F.collect_set(F.concat("type", F.lit("-GAZS"), F.col("n_tok").cast("string")))).alias("features"))


def clean_features(tokens: DataFrame, gaz: DataFrame, lengths: list[int], lower: bool = False, by=BY) -> DataFrame:
    """(by, pos, features): every token of a whole match gets TYPE-GAZC<tokens of the entry>."""
    m = phrase_matches(tokens, gaz, lengths, lower, by=by)
    covered = m.withColumn("pos", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("n") - 1)))
    return covered.groupBy(*by, "pos").agg(F.sort_array(F.collect_set(F.concat("type", F.lit("-GAZC"), F.col("n").cast("string")))).alias("features"))


def list_labels(tokens: DataFrame, gaz: DataFrame, lengths: list[int], lower: bool = False, quotes: bool = True, by=BY, key: str = "tok") -> DataFrame:
    """(tokens..., label): list NER.  Of the matches over a token the one with the lowest priority number wins, then the longest, then the last to start.

    One pair of quotes inside a match may be left out, at priority + 1.
    """
    g = gaz if "priority" in gaz.columns else gaz.withColumn("priority", F.lit(1.0))
    m = phrase_matches(tokens, g, lengths, lower, key, by).select(*by, F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("n") - 1)).alias("pos"), F.col("pos").alias("start"), "n", "type", "priority")
    if quotes:
        w = Window.partitionBy(*by).orderBy("pos")
        plain = tokens.where(~F.col("tok").isin('"', "“", "”", "«", "»")).withColumn("_p", F.col("pos")).withColumn("pos", F.row_number().over(w) - 1)
        p2 = phrase_matches(plain, g, lengths, lower, key, by)
        a, b = plain.select(*by, F.col("pos"), F.col("_p").alias("start")), plain.select(*by, (F.col("pos")).alias("_last"), F.col("_p").alias("stop"))
        j = p2.join(a, [*by, "pos"]).withColumn("_last", F.col("pos") + F.col("n") - 1).join(b, [*by, "_last"]).where(F.col("stop") - F.col("start") + 1 > F.col("n"))
        j = j.where(F.col("stop") - F.col("start") + 1 <= F.col("n") + 2)
        m = m.union(j.select(*by, F.explode(F.sequence(F.col("start"), F.col("stop"))).alias("pos"), "start", (F.col("stop") - F.col("start") + 1).alias("n"), "type", F.col("priority") + 1))
    best = m.groupBy(*by, "pos").agg(F.min_by("type", F.struct("priority", -F.col("n"), -F.col("start"), "type")).alias("label"))
    return tokens.join(best, [*by, "pos"], "left").withColumn("label", F.coalesce("label", F.lit("O")))


def regex_labels(tokens: DataFrame, patterns: DataFrame, key: str = "lemma", by=BY, current: str | None = None) -> DataFrame:
    """(tokens..., label): each token of an entry (order, type, pattern: regexes parted by spaces) must match in full; the last entry in `order` wins.

    With `current`, a column of labels, an entry counts only where all its tokens are background, of a type of the patterns, or of one of the entry's
    `overwritable` types; other tokens keep their labels.

    Patterns are matched against distinct words once, then their places are joined; entries are few, words are not.
    """
    p = patterns.select("order", "type", F.posexplode(F.split("pattern", r"\s+")).alias("i", "rx"), F.size(F.split("pattern", r"\s+")).alias("n"))
    words = tokens.select(F.col(key).alias("_w")).distinct()
    # rules are a hand-written list; the join's other side is one row a distinct word
    hit = words.join(F.broadcast(p), F.expr("_w rlike concat('^(?:', rx, ')$')")).select("_w", "order", "type", "i", "n")
    at = tokens.join(hit, tokens[key] == hit["_w"]).select(*by, (F.col("pos") - F.col("i")).alias("start"), "order", "type", "i", "n")
    if current:
        rules = patterns.select("order", (F.coalesce("overwritable", F.array().cast("array<string>")) if "overwritable" in patterns.columns else F.array().cast("array<string>")).alias("_ok"))
        ours = patterns.select(F.col("type").alias("_own")).distinct()
        labels = tokens.select(*by, F.col("pos").alias("_pos"), F.col(current).alias("_now"))
        at = at.withColumn("_pos", F.col("start") + F.col("i")).join(labels, [*by, "_pos"]).join(F.broadcast(rules), "order").join(F.broadcast(ours), F.col("_now") == F.col("_own"), "left")
        at = at.where((F.col("_now") == "O") | F.col("_own").isNotNull() | F.array_contains("_ok", F.col("_now"))).select(*by, "start", "order", "type", "i", "n")
    whole = at.groupBy(*by, "start", "order", "type", "n").agg(F.count_distinct("i").alias("k")).where("k = n")
    cover = whole.select(*by, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("pos"), "type", "order", "start")
    best = cover.groupBy(*by, "pos").agg(F.max_by("type", F.struct("order", "start")).alias("label"))
    best = best.withColumnRenamed("label", "_label")
    return tokens.join(best, [*by, "pos"], "left").withColumn("label", F.coalesce("_label", F.col(current) if current else F.lit("O"))).drop("_label")


def dist_sim(tokens: DataFrame, lexicon: DataFrame, key: str = "tok") -> DataFrame:
    """Class of each word; unknown words get `null` as text."""
    return tokens.join(lexicon.select(F.col("word").alias(key), "class"), key, "left").withColumn("class", F.coalesce("class", F.lit("null")))


def collocations(tokens: DataFrame, lexicon: DataFrame, lengths: list[int], by=BY) -> DataFrame:
    """Multi-word entries of a lexicon (phrase) found in the text, with their numbers."""
    return phrase_matches(tokens, lexicon.withColumn("type", F.lit("COLL")), [n for n in lengths if n > 1], by=by).groupBy("phrase").agg(F.count("*").alias("n"))
