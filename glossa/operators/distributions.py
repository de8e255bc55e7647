"""Smoothed distributions over count tables: (key, n) to (key, p) with the mass reserved for unseen keys in `reserved`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.operators.counters import _with_totals, count_counts


def _totals(c: DataFrame) -> DataFrame:
    return _with_totals(c, total=F.sum("n").cast("double"), seen=F.count("*").cast("double"))


def _out(df: DataFrame, p, reserved) -> DataFrame:
    keys = [x for x in df.columns if x not in ("n", "total", "seen", "n1", "low")]
    return df.select(*keys, p.alias("p"), reserved.alias("reserved"))


def relative(c: DataFrame, reserved: float = 0.0) -> DataFrame:
    return _out(_totals(c), (1 - reserved) * F.col("n") / F.col("total"), F.lit(reserved))


def uniform(keys: DataFrame) -> DataFrame:
    return _with_totals(keys.distinct(), seen=F.count("*").cast("double")).select(*keys.columns, (1 / F.col("seen")).alias("p"), F.lit(0.0).alias("reserved"))


def partial(c: DataFrame, keys: DataFrame) -> DataFrame:
    """Given probabilities stay; the other keys share what is left alike."""
    name = keys.columns
    known = c.agg(F.coalesce(F.sum("n"), F.lit(0.0)).alias("used"), F.count("*").alias("k"))
    every = keys.distinct()
    size = every.agg(F.count("*").alias("size"))
    out = every.join(c, name, "left").crossJoin(F.broadcast(known)).crossJoin(F.broadcast(size))
    return out.select(*name, F.coalesce("n", (1 - F.col("used")) / (F.col("size") - F.col("k"))).alias("p"), F.lit(0.0).alias("reserved"))


def perturbed(keys: DataFrame, seed: int) -> DataFrame:
    w = keys.distinct().withColumn("n", 1 + F.rand(seed))
    return relative(w)


def from_logs(c: DataFrame) -> DataFrame:
    top = c.agg(F.max("n").alias("top"))
    e = c.crossJoin(F.broadcast(top)).withColumn("n", F.exp(F.col("n") - F.col("top"))).drop("top")
    return relative(e)


def absolute_discount(c: DataFrame, delta: float) -> DataFrame:
    """Values above delta lose it; keys at or below it become unseen."""
    low = _with_totals(c, total=F.sum("n").cast("double"), low=F.sum(F.least(F.col("n").cast("double"), F.lit(delta))))
    return _out(low.where(F.col("n") > delta), (F.col("n") - delta) / F.col("total"), F.col("low") / F.col("total"))


def lidstone(c: DataFrame, keys: float, lam: float = 1.0) -> DataFrame:
    """`keys` is the number of keys that could be seen; lam 1 is Laplace's rule."""
    bottom = F.col("total") + lam * keys
    return _out(_totals(c), (F.col("n") + lam) / bottom, (keys - F.col("seen")) * lam / bottom)


def laplace_unknown(c: DataFrame, unknown: str, lam: float) -> DataFrame:
    """The unknown key keeps its raw share."""
    key = [x for x in c.columns if x != "n"][0]
    bottom = F.col("total") + lam * (F.col("seen") - 1)
    return _out(_totals(c), F.when(F.col(key) == unknown, F.col("n") / bottom).otherwise((F.col("n") + lam) / bottom), F.lit(0.0))


def good_turing(c: DataFrame, keys: float) -> DataFrame:
    """Adjusted counts below 10, scaled to 1 - N1/N; Lidstone 0.5 where one of N1..N10 is under 3."""
    cc = count_counts(c).where("value between 1 and 10").withColumnRenamed("n", "m")
    sparse = cc.agg(((F.count("*") < 10) | (F.min("m") < 3)).alias("sparse"), F.coalesce(F.sum(F.when(F.col("value") == 1, F.col("m"))), F.lit(0)).cast("double").alias("n1"))
    here, above = cc.select(F.col("value").alias("n"), F.col("m").alias("m0")), cc.select((F.col("value") - 1).alias("n"), F.col("m").alias("m1"))
    star = _totals(c).join(F.broadcast(here), "n", "left").join(F.broadcast(above), "n", "left").crossJoin(F.broadcast(sparse))
    star = star.withColumn("star", F.when(F.col("n") < 10, (F.col("n") + 1) * F.col("m1") / F.col("m0")).otherwise(F.col("n").cast("double")))
    star = star.crossJoin(F.broadcast(star.agg(F.sum("star").alias("stars"))))
    bottom = F.col("total") + 0.5 * keys
    p = F.when(F.col("sparse"), (F.col("n") + 0.5) / bottom).otherwise(F.col("star") / F.col("stars") * (1 - F.col("n1") / F.col("total")))
    r = F.when(F.col("sparse"), (keys - F.col("seen")) * 0.5 / bottom).otherwise(F.col("n1") / F.col("total"))
    names = [x for x in c.columns if x != "n"]
    return star.select(*names, p.alias("p"), r.alias("reserved"))


def simple_good_turing(c: DataFrame) -> DataFrame:
    """Counts of counts smoothed by a log-log line; the raw estimate holds until it differs by less than 1.96 deviations from the line.

    (value, adjusted, p): one row a distinct count; needs five of them.  The table is counts of counts, which grow with the logarithm of a corpus.
    """
    from pyspark.sql import Window

    w = Window.orderBy("value")
    cc = count_counts(c).where("value > 0")
    z = cc.withColumn("q", F.coalesce(F.lag("value").over(w), F.lit(0))).withColumn("t", F.lead("value").over(w))
    z = z.withColumn("z", F.col("n") / (0.5 * (F.coalesce("t", 2 * F.col("value") - F.col("q")) - F.col("q"))))
    fit = z.agg(F.regr_slope(F.log("z"), F.log("value")).alias("b"), F.regr_intercept(F.log("z"), F.log("value")).alias("a"))
    s = lambda r: F.exp(F.col("a") + F.col("b") * F.log(r))
    r = F.col("value")
    both = z.crossJoin(F.broadcast(fit)).withColumn("y", (r + 1) * s(r + 1) / s(r)).withColumn("m1", F.when(F.lead("value").over(w) == r + 1, F.lead("n").over(w)))
    both = both.withColumn("x", (r + 1) * F.col("m1") / F.col("n")).withColumn("sd", F.sqrt((r + 1) * (r + 1) * F.col("m1") / (F.col("n") * F.col("n")) * (1 + F.col("m1") / F.col("n"))))
    stop = F.max(F.when(F.col("m1").isNull() | (F.abs(F.col("x") - F.col("y")) <= 1.96 * F.col("sd")), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("adjusted", F.when(stop == 1, F.col("y")).otherwise(F.col("x")))
    sums = both.agg(F.sum(F.col("n") * F.col("adjusted")).alias("np"), F.sum(F.col("n") * r).alias("total"), F.sum(F.when(r == 1, F.col("n")).otherwise(0)).alias("n1"), F.count("*").alias("rows"))
    return both.crossJoin(F.broadcast(sums)).where("rows >= 5").select("value", "adjusted", ((1 - F.col("n1") / F.col("total")) * F.col("adjusted") / F.col("np")).alias("p"))


def dirichlet(c: DataFrame, prior: DataFrame, weight: float) -> DataFrame:
    """prior: (key, p); (n + weight * p0) / (N + weight)."""
    keys = [x for x in c.columns if x != "n"]
    out = prior.withColumnRenamed("p", "p0").join(c, keys, "left").crossJoin(F.broadcast(c.agg(F.sum("n").cast("double").alias("total"))))
    return out.select(*keys, ((F.coalesce("n", F.lit(0)) + weight * F.col("p0")) / (F.col("total") + weight)).alias("p"), F.lit(0.0).alias("reserved"))


def logistic(c: DataFrame) -> DataFrame:
    return relative(c.withColumn("n", 1 / (1 + F.exp(-F.col("n")))))


def probability_of(d: DataFrame, keys: DataFrame, unseen: float) -> DataFrame:
    """p of each key; keys without one share the reserved mass among `unseen` keys."""
    name = keys.columns
    mass = d.agg(F.coalesce(F.max("reserved"), F.lit(0.0)).alias("mass"))
    return keys.join(d.drop("reserved"), name, "left").crossJoin(F.broadcast(mass)).select(*name, F.coalesce("p", F.col("mass") / unseen).alias("p"), F.log(F.coalesce("p", F.col("mass") / unseen)).alias("log_p"))
