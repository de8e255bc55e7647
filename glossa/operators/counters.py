"""Algebra of count tables.  A counter is a DataFrame (key, n); a key that is absent counts 0.

Every function takes and returns DataFrames, needs no driver state and aggregates before it joins; two counters meet in one full outer
join on the key.  `key` may be any name or list of names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.operators.sets import indexed


def _keys(c: DataFrame) -> list[str]:
    return [x for x in c.columns if x != "n"]


def of(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def summed(df: DataFrame, value: str, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(value).alias("n"))


def add_to(c: DataFrame, changes: DataFrame) -> DataFrame:
    """Increments (or decrements, if negative) of a counter."""
    return c.unionByName(changes).groupBy(*_keys(c)).agg(F.sum("n").alias("n"))


def set_count(c: DataFrame, values: DataFrame) -> DataFrame:
    return c.join(values, _keys(c), "left_anti").unionByName(values)


def remove_keys(c: DataFrame, keys: DataFrame) -> DataFrame:
    return c.join(keys, keys.columns, "left_anti")


def total(c: DataFrame) -> DataFrame:
    return c.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


def summary(c: DataFrame) -> DataFrame:
    return c.agg(F.max("n").alias("max"), F.min("n").alias("min"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("std"))


def argmax(c: DataFrame, smallest: bool = False) -> DataFrame:
    """The key with the largest (or smallest) value; ties go to the smaller key."""
    key = _keys(c)[0]
    # order by value, then by key: one aggregate, no sort of the table
    best = c.agg((F.min if smallest else F.max)("n").alias("n"))
    return c.join(F.broadcast(best), "n").groupBy("n").agg(F.min(key).alias(key)).select(key, "n")


def log_sum(c: DataFrame) -> DataFrame:
    top = c.agg(F.max("n").alias("top"))
    return c.crossJoin(F.broadcast(top)).agg((F.max("top") + F.log(F.sum(F.exp(F.col("n") - F.col("top"))))).alias("log_sum"))


def _with_totals(c: DataFrame, **totals: Column) -> DataFrame:
    """c with totals of the whole table: one row, so a broadcast of fixed size, instead of a window over one partition."""
    return c.crossJoin(F.broadcast(c.agg(*(v.alias(k) for k, v in totals.items()))))


def log_normalise(c: DataFrame) -> DataFrame:
    return c.crossJoin(F.broadcast(log_sum(c))).withColumn("n", F.col("n") - F.col("log_sum")).drop("log_sum")


def normalise(c: DataFrame) -> DataFrame:
    return _with_totals(c, t=F.sum("n")).withColumn("n", F.col("n") / F.col("t")).drop("t")


def mapped(c: DataFrame, f) -> DataFrame:
    """log, exp, pow, scale, tf-log-scale and the like: f of the value."""
    return c.withColumn("n", f(F.col("n")))


def pow_normalised(c: DataFrame, t: float) -> DataFrame:
    return normalise(mapped(c, lambda n: F.pow(n, F.lit(t))))


def tf_log_scale(c: DataFrame, base: float = 2.718281828459045) -> DataFrame:
    return mapped(c, lambda n: F.when(n > 0, 1 + F.log(n) / F.log(F.lit(base))).otherwise(n))


def joined(a: DataFrame, b: DataFrame, how: str = "full") -> DataFrame:
    """(keys, x, y), absent values 0."""
    keys = _keys(a)
    out = a.withColumnRenamed("n", "x").join(b.withColumnRenamed("n", "y"), keys, how)
    return out.select(*keys, F.coalesce("x", F.lit(0)).alias("x"), F.coalesce("y", F.lit(0)).alias("y"))


COMBINE = {
    "union": lambda x, y: x + y,
    "add": lambda x, y: x + y,
    "subtract": lambda x, y: x - y,
    "product": lambda x, y: x * y,
    "division": lambda x, y: F.when(y != 0, x / y),
    "absolute_difference": lambda x, y: F.abs(x - y),
    "intersection": lambda x, y: F.least(x, y),
}


def combine(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    how = "inner" if op in ("intersection", "product", "division") else "full"
    out = joined(a, b, how).withColumn("n", COMBINE[op](F.col("x"), F.col("y"))).drop("x", "y")
    return out


def linear(a: DataFrame, wa: float, b: DataFrame, wb: float) -> DataFrame:
    return joined(a, b).withColumn("n", F.col("x") * wa + F.col("y") * wb).drop("x", "y")


def average(a: DataFrame, b: DataFrame) -> DataFrame:
    return linear(a, 0.5, b, 0.5)


def jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    return joined(a, b).agg((F.sum(F.least("x", "y")) / F.sum(F.greatest("x", "y"))).alias("jaccard"))


def dot(a: DataFrame, b: DataFrame) -> DataFrame:
    return joined(a, b, "inner").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))


def cosine(a: DataFrame, b: DataFrame) -> DataFrame:
    """0 where a norm is 0."""
    x, y = F.col("x"), F.col("y")
    norm = F.sqrt(F.sum(x * x)) * F.sqrt(F.sum(y * y))
    return joined(a, b).agg(F.when(norm > 0, F.sum(x * y) / norm).otherwise(0.0).alias("cosine"))


def norms(c: DataFrame) -> DataFrame:
    return c.agg(F.sum(F.abs("n")).alias("l1"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("l2"))


def l2_normalise(c: DataFrame) -> DataFrame:
    return _with_totals(c, t=F.sqrt(F.sum(F.col("n") * F.col("n")))).withColumn("n", F.col("n") / F.col("t")).drop("t")


def entropy(c: DataFrame) -> DataFrame:
    p = F.col("n") / F.col("t")
    return _with_totals(c, t=F.sum("n")).where("n > 0").agg((-F.sum(p * F.log2(p))).alias("entropy"))


def cross_entropy(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sum of a's raw values times log2 of b's share: no leading minus, and minus infinity if b lacks a key."""
    t = b.agg(F.sum("n").alias("t"))
    q = F.col("y") / F.col("t")
    return joined(a, b, "left").crossJoin(F.broadcast(t)).agg(F.sum(F.when(q > 0, F.col("x") * F.log2(q)).otherwise(F.lit(float("-inf")))).alias("cross_entropy"))


def kl(a: DataFrame, b: DataFrame) -> DataFrame:
    """Bits; both normalised; infinite if b lacks a key of a."""
    out = joined(a, b)
    p, q = F.col("x") / F.col("tx"), F.col("y") / F.col("ty")
    return _with_totals(out, tx=F.sum("x"), ty=F.sum("y")).agg(F.sum(F.when(F.col("x") == 0, 0.0).when(F.col("y") == 0, float("inf")).otherwise(p * F.log2(p / q))).alias("kl"))


def jensen_shannon(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean divergence to the average of the raw counts."""
    mid = average(a, b)
    return kl(a, mid).crossJoin(F.broadcast(kl(b, mid).withColumnRenamed("kl", "other"))).select(((F.col("kl") + F.col("other")) / 2).alias("jensen_shannon"))


def skew_divergence(a: DataFrame, b: DataFrame, alpha: float) -> DataFrame:
    return kl(a, linear(b, alpha, a, 1 - alpha)).withColumnRenamed("kl", "skew_divergence")


def pmi(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """(left, right, n, pmi) of a pair counter, in bits."""
    a = pairs.groupBy(left).agg(F.sum("n").alias("na"))
    b = pairs.groupBy(right).agg(F.sum("n").alias("nb"))
    out = _with_totals(pairs, t=F.sum("n")).join(a, left).join(b, right)
    return out.select(left, right, "n", F.log2(F.col("n") * F.col("t") / (F.col("na") * F.col("nb"))).alias("pmi"))


def count_counts(c: DataFrame) -> DataFrame:
    return c.groupBy(F.col("n").alias("value")).agg(F.count("*").alias("n"))


def h_index(c: DataFrame) -> DataFrame:
    """Largest h with at least h values of h or more; works on counts of counts, which are few."""
    cc = count_counts(c)
    above = cc.select("value", F.sum("n").over(Window.orderBy(F.desc("value"))).alias("above"))
    return above.agg(F.coalesce(F.max(F.least(F.col("value"), F.col("above"))), F.lit(0)).cast("long").alias("h_index"))


def ranked(c: DataFrame, by: Column | None = None) -> DataFrame:
    """0-based rank by falling value (or rising `by`), ties by key."""
    return indexed(c, -F.col("n") if by is None else by, *_keys(c), name="rank").withColumn("rank", F.col("rank").cast("int"))


def retain_top(c: DataFrame, k: int, smallest: bool = False) -> DataFrame:
    return c.orderBy(F.asc("n") if smallest else F.desc("n"), *_keys(c)).limit(k)


def drop_ranks(c: DataFrame, top: int, bottom: int) -> DataFrame:
    """Without the `top` largest and the `bottom` smallest."""
    size = c.agg(F.count("*").alias("size"))
    return ranked(c).crossJoin(F.broadcast(size)).where(f"rank >= {top} and rank < size - {bottom}").drop("rank", "size")


def retain(c: DataFrame, condition: str | Column) -> DataFrame:
    return c.where(condition)


def keys_where(c: DataFrame, condition: str | Column) -> DataFrame:
    return c.where(condition).select(*_keys(c))


def transform_keys(c: DataFrame, f) -> DataFrame:
    key = _keys(c)[0]
    return c.groupBy(f(F.col(key)).alias(key)).agg(F.sum("n").alias("n"))


def sum_of(c: DataFrame, keys: DataFrame) -> DataFrame:
    return c.join(keys, keys.columns, "left_semi").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


def equal(a: DataFrame, b: DataFrame) -> DataFrame:
    differs = joined(a, b).where("x <> y").agg(F.count("*").alias("d"))
    return differs.select((F.col("d") == 0).alias("equal"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    return joined(a, b).where("x <> y").withColumn("difference", F.col("x") - F.col("y"))


def perturb(c: DataFrame, seed: int, scale: float = 1.0) -> DataFrame:
    return c.withColumn("n", F.col("n") - F.log(1 - F.rand(seed)) * scale)


def sample_keys(c: DataFrame, draws: int, seed: int) -> DataFrame:
    """Keys drawn in proportion to their counts, with replacement: exponential races, one an entry and draw."""
    key = _keys(c)[0]
    race = c.where("n > 0").withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("t", -F.log(1 - F.rand(seed)) / F.col("n"))
    return race.groupBy("draw").agg(F.min_by(key, "t").alias(key))


# --- two and more keys ------------------------------------------------------------------------------------------------------


def inner_totals(c: DataFrame, first: str) -> DataFrame:
    return c.groupBy(first).agg(F.sum("n").alias("n"))


def reverse_order(c: DataFrame) -> DataFrame:
    a, b = _keys(c)
    return c.select(F.col(b).alias(a), F.col(a).alias(b), "n")


def flatten(c: DataFrame, sep: str = "\t") -> DataFrame:
    return c.select(F.concat_ws(sep, *_keys(c)).alias("key"), "n")


def matrix(c: DataFrame, row: str, column: str, columns: list) -> DataFrame:
    return c.groupBy(row).pivot(column, columns).agg(F.sum("n")).na.fill(0)


def level_totals(c: DataFrame) -> DataFrame:
    """Totals at each prefix of the keys."""
    return c.rollup(*_keys(c)).agg(F.sum("n").alias("n"), F.grouping_id().cast("long").alias("level"))


def conditioned(c: DataFrame, first: str, value) -> DataFrame:
    return c.where(F.col(first) == value).drop(first)


def sorted_text(c: DataFrame, k: int, item: str = "%s:%s") -> DataFrame:
    """The k largest as one line."""
    key = _keys(c)[0]
    top = retain_top(c, k)
    row = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("r"), F.col(key).alias("k"), F.col("n"))))
    return top.agg(F.array_join(F.transform(row, lambda x: F.format_string(item, x["k"], x["n"])), " ").alias("line"))
