"""Scoring: spans, labels, probabilities.  Inputs are gold and guess tables; every score is one aggregation over a join."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.operators.sets import indexed
from glossa.operators.spans import chunks


def prf(tp, fp, fn):
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    return p, r, F.when((p > 0) & (r > 0), 2 / (1 / p + 1 / r)).otherwise(0.0)


def entity_scores(df: DataFrame, gold: str = "gold", guess: str = "guess", totals: bool = True) -> DataFrame:
    """Exact span and type: tp, fp, fn, precision, recall, f1 by type, and `Totals`.  Any chunk encoding."""
    keys = ["doc_id", "type", "begin_pos", "end_pos"]
    g = chunks(df, gold).select(*keys).withColumn("x", F.lit(1))
    h = chunks(df, guess).select(*keys).withColumn("y", F.lit(1))
    m = g.join(h, keys, "full")
    counts = [F.count(F.expr(c)).alias(n) for c, n in (("case when x = 1 and y = 1 then 1 end", "tp"), ("case when x is null then 1 end", "fp"), ("case when y is null then 1 end", "fn"))]
    out = (m.rollup("type") if totals else m.groupBy("type")).agg(*counts).withColumn("type", F.coalesce("type", F.lit("Totals")))
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return out.select("type", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f.alias("f1"))


def shown(scores: DataFrame) -> DataFrame:
    """Rows worth printing."""
    return scores.where("not (tp = 0 and (fp = 0 or fn = 0))")


def confusion(df: DataFrame, gold: str = "gold", guess: str = "guess", default: str | None = None) -> DataFrame:
    g = (lambda c: F.coalesce(F.col(c), F.lit(default))) if default else F.col
    return df.groupBy(g(gold).alias("gold"), g(guess).alias("guess")).agg(F.count("*").alias("n"))


def label_accuracy(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("gold").agg(F.sum(F.when(F.col("gold") == F.col("guess"), F.col("n")).otherwise(0)).alias("correct"), F.sum("n").alias("total")).withColumn("accuracy", F.col("correct") / F.col("total"))


def label_scores(df: DataFrame, gold: str = "gold", guess: str = "guess", background: str | None = None) -> DataFrame:
    """Per label and micro-averaged precision, recall, f1; the background is left out of both."""
    m = confusion(df, gold, guess)
    rows = m.select(F.explode(F.array(F.struct(F.col("gold").alias("label"), F.when(F.col("gold") == F.col("guess"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("fp"), F.when(F.col("gold") != F.col("guess"), F.col("n")).otherwise(0).alias("fn")), F.struct(F.col("guess").alias("label"), F.lit(0).cast("long").alias("tp"), F.when(F.col("gold") != F.col("guess"), F.col("n")).otherwise(0).alias("fp"), F.lit(0).cast("long").alias("fn")))).alias("r")).select("r.*")
    if background is not None:
        rows = rows.where(F.col("label") != background)
    out = rows.rollup("label").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn"))).withColumn("label", F.coalesce("label", F.lit("micro")))
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return out.select("label", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f.alias("f1"))


def token_accuracy(df: DataFrame, gold: str = "gold", guess: str = "guess") -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.avg((F.col(gold) == F.col(guess)).cast("double")).alias("accuracy"))


def border_errors(gold: DataFrame, guess: DataFrame, overlaps: DataFrame) -> DataFrame:
    """Overlapping pairs of one type whose borders differ."""
    return overlaps.where("a_type = b_type and (a0 <> b0 or a1 <> b1)")


def error_shares(errors: DataFrame, category: str) -> DataFrame:
    total = errors.agg(F.count("*").alias("total"))
    return errors.groupBy(category).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).withColumn("impact", F.col("n") / F.col("total")).drop("total")


def morph_accuracy(df: DataFrame) -> DataFrame:
    """Shares of right tags, right lemmas (letter case aside), both; df: gold_tag, gold_lemma, tag, lemma."""
    t, m = F.col("gold_tag") == F.col("tag"), F.lower("gold_lemma") == F.lower("lemma")
    return df.agg(F.avg(t.cast("double")).alias("tag"), F.avg(m.cast("double")).alias("lemma"), F.avg((t & m).cast("double")).alias("both"), F.count("*").alias("n"))


def attribute_errors(df: DataFrame) -> DataFrame:
    """Percent wrong by attribute, over tokens where both maps have it; df: gold_attrs, attrs."""
    rows = df.select(F.explode("gold_attrs").alias("attribute", "g"), "attrs").withColumn("v", F.col("attrs")[F.col("attribute")]).where("v is not null")
    return rows.groupBy("attribute").agg(F.count("*").alias("total"), F.sum((F.col("g") == F.col("v")).cast("long")).alias("ok")).withColumn("error", 100 - F.col("ok") * 100 / F.col("total"))


def pr_curve(df: DataFrame, score: str = "score", gold: str = "gold") -> DataFrame:
    """One row a distinct score, falling: tp, fp, precision, recall, f1 for all at or above it."""
    g = df.groupBy(score).agg(F.sum(gold).alias("p"), F.count("*").alias("m"))
    total = g.agg(F.sum("p").alias("total"))
    c = indexed(g, -F.col(score), sums={"tp": F.col("p"), "seen": F.col("m")}).select(score, "tp", "seen").crossJoin(F.broadcast(total))
    p, r = F.col("tp") / F.col("seen"), F.col("tp") / F.col("total")
    return c.select(score, "tp", (F.col("seen") - F.col("tp")).alias("fp"), p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def best_f1(curve: DataFrame, score: str = "score") -> DataFrame:
    return curve.agg(F.max("f1").alias("f1"), F.max_by(score, F.struct("f1", score)).alias("threshold"))


def confidence_weighted_accuracy(df: DataFrame, confidence: str = "score", right: str = "right") -> DataFrame:
    """Mean over ranks of accuracy among the more confident; ties by doc_id."""
    r = indexed(df, -F.col(confidence), "doc_id", sums={"ok": F.col(right)}).select((F.col("ok") / (F.col("ix") + 1)).alias("a"))
    return r.agg(F.avg("a").alias("cwa"), F.count("*").alias("n"))


def accuracy_coverage(df: DataFrame, confidence: str = "score", right: str = "right", bins: int = 10) -> DataFrame:
    b = df.groupBy(F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).cast("long").alias("bin")).agg(F.sum(right).alias("ok"), F.count("*").alias("m"))
    w = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    total = b.agg(F.sum("m").alias("total"))
    return b.select("bin", F.sum("ok").over(w).alias("ok"), F.sum("m").over(w).alias("m")).crossJoin(F.broadcast(total)).select("bin", (F.col("ok") / F.col("m")).alias("accuracy"), (F.col("m") / F.col("total")).alias("coverage"))


def log_likelihood(df: DataFrame, p: str = "p", gold: str = "gold") -> DataFrame:
    return df.agg(F.sum(F.log(F.when(F.col(gold) == 1, F.col(p)).otherwise(1 - F.col(p)))).alias("log_likelihood"))


def constituent_scores(gold: DataFrame, guess: DataFrame) -> DataFrame:
    """Bracket overlap by tree; constituents (tree_id, label, begin, end) counted with their number."""
    keys = ["tree_id", "label", "begin", "end"]
    a, b = gold.groupBy(*keys).agg(F.count("*").alias("x")), guess.groupBy(*keys).agg(F.count("*").alias("y"))
    m = a.join(b, keys, "full").na.fill(0, ["x", "y"])
    s = m.groupBy("tree_id").agg(F.sum(F.least("x", "y")).alias("tp"), F.sum("y").alias("guessed"), F.sum("x").alias("gold"))
    p, r = F.when(F.col("guessed") > 0, F.col("tp") / F.col("guessed")).otherwise(0.0), F.when(F.col("gold") > 0, F.col("tp") / F.col("gold")).otherwise(0.0)
    return s.select("tree_id", "tp", "guessed", "gold", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"), ((F.col("tp") == F.col("gold")) & (F.col("tp") == F.col("guessed"))).alias("exact"))


def constituent_summary(by_tree: DataFrame) -> DataFrame:
    """One row of `constituent_scores`: f1 over all brackets, its mean over trees, and the share of trees without an error."""
    total = by_tree.agg(*(F.sum(c).alias(c) for c in ("tp", "guessed", "gold")), F.avg("f1").alias("mean_f1"), F.avg(F.col("exact").cast("double")).alias("exact"), F.count("*").alias("trees"))
    p, r = F.col("tp") / F.col("guessed"), F.col("tp") / F.col("gold")
    return total.select("trees", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"), "mean_f1", "exact")


def rule_errors(gold: DataFrame, guess: DataFrame) -> DataFrame:
    """(rule, missing, extra): local trees (tree_id, label, children) that one side has more often than the other, summed over trees."""
    count = lambda d, n: d.groupBy("tree_id", F.concat_ws(" -> ", "label", "children").alias("rule")).agg(F.count("*").alias(n))
    m = count(gold, "x").join(count(guess, "y"), ["tree_id", "rule"], "full").na.fill(0, ["x", "y"])
    out = m.groupBy("rule").agg(F.sum(F.greatest(F.col("x") - F.col("y"), F.lit(0))).alias("missing"), F.sum(F.greatest(F.col("y") - F.col("x"), F.lit(0))).alias("extra"))
    return out.where("missing + extra > 0")


def conll_report(df: DataFrame, gold: str = "gold", guess: str = "guess") -> DataFrame:
    """(line): the usual report of chunk scores: tokens, phrases and accuracy, then precision, recall and f1 over all and by type, in per cent."""
    s = entity_scores(df, gold, guess)
    acc = token_accuracy(df, gold, guess)
    pc = lambda c: F.format_string("%.2f%%", 100 * F.col(c))
    f1 = F.format_string("%.2f", 100 * F.col("f1"))
    t = s.where("type = 'Totals'").crossJoin(F.broadcast(acc))
    first = t.select(F.lit(0).alias("k"), F.lit("").alias("type"), F.format_string("processed %d tokens with %d phrases; found: %d phrases; correct: %d.", "n", F.col("tp") + F.col("fn"), F.col("tp") + F.col("fp"), "tp").alias("line"))
    second = t.select(F.lit(1), F.lit(""), F.concat(F.lit("accuracy: "), pc("accuracy"), F.lit("; precision: "), pc("precision"), F.lit("; recall: "), pc("recall"), F.lit("; FB1: "), f1))
    rest = s.where("type <> 'Totals'").select(F.lit(2), "type", F.concat(F.col("type"), F.lit(": precision: "), pc("precision"), F.lit("; recall: "), pc("recall"), F.lit("; FB1: "), f1, F.lit(" "), (F.col("tp") + F.col("fp")).cast("string")))
    return first.union(second).union(rest).orderBy("k", "type").select("line")


def words_per_second(make: Callable[[], DataFrame], column: str = "tok") -> tuple[int, float]:
    """Number of words that a table holds, and how many of them a second it took to make them; nothing is kept."""
    begin = time.perf_counter()
    n = make().where(F.col(column).isNotNull()).count()
    return n, n / max(time.perf_counter() - begin, 1e-9)
