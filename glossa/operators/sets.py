"""Joins by role, set algebra, order, sampling and splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.shared import written


def lookup(df: DataFrame, table: DataFrame, on: str | list[str], default: dict | None = None) -> DataFrame:
    out = df.join(table, on, "left")
    return out.na.fill(default) if default else out


def member_flag(df: DataFrame, dictionary: DataFrame, column: str, name: str) -> DataFrame:
    d = dictionary.select(F.col(dictionary.columns[0]).alias(column)).distinct().withColumn(name, F.lit(True))
    return df.join(d, column, "left").na.fill(False, [name])


def members(df: DataFrame, dictionary: DataFrame, column: str) -> DataFrame:
    return df.join(dictionary.select(F.col(dictionary.columns[0]).alias(column)).distinct(), column, "left_semi")


def strangers(df: DataFrame, dictionary: DataFrame, column: str) -> DataFrame:
    return df.join(dictionary.select(F.col(dictionary.columns[0]).alias(column)).distinct(), column, "left_anti")


def word_class(df: DataFrame, lists: dict[str, DataFrame], token: str = "tok", lemma: str = "lemma") -> DataFrame:
    """Class label of a word: numbers with digits as 0, names, listed classes in order, common lemmas as they are, else `_rare_`.

    lists: class name to a table of one column of lemmas; `common` keeps the lemma.
    """
    out = df
    for name, table in lists.items():
        out = member_flag(out, table, lemma, f"_in_{name}")
    label: Column = F.when(F.col(token).rlike(r"^[0-9][0-9.,]*$"), F.regexp_replace(token, "[0-9]", "0"))
    for name in lists:
        hit = F.col(f"_in_{name}") & (F.col(token).rlike(r"^\p{Lu}") if name == "surname" else F.lit(True))
        label = label.when(hit, F.col(lemma) if name == "common" else F.lit(f"_{name}_"))
    return out.withColumn("class", label.otherwise("_rare_")).drop(*(f"_in_{n}" for n in lists))


def compose(f: DataFrame, g: DataFrame) -> DataFrame:
    """(k, v) after (k, v): g of f."""
    return f.withColumnRenamed("v", "m").join(g.select(F.col("k").alias("m"), "v"), "m").select("k", "v")


def invert(f: DataFrame) -> DataFrame:
    return f.select(F.col("v").alias("k"), F.col("k").alias("v"))


def invert_sets(f: DataFrame) -> DataFrame:
    return f.groupBy(F.col("v").alias("k")).agg(F.sort_array(F.collect_set("k")).alias("keys"))


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """All pairs, as asked for; the only product in the library."""
    return a.crossJoin(b)


def zipped(a: DataFrame, b: DataFrame, on: tuple[str, ...] = ("doc_id", "pos")) -> DataFrame:
    return a.join(b, list(on))


def parent_token(df: DataFrame, offset: str = "parent") -> DataFrame:
    """Adds the token that a token's parent index names; index is 1-based, 0 the root."""
    p = df.select("doc_id", "sent_id", F.col("idx").alias(offset), F.col("tok").alias("parent_tok"))
    return df.join(p, ["doc_id", "sent_id", offset], "left")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b)


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b).distinct() if a.columns else a


def symmetric(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in one table only: one union and one aggregate instead of four set operations."""
    cols = a.columns
    both = a.distinct().withColumn("_s", F.lit(1)).union(b.distinct().withColumn("_s", F.lit(2)))
    return both.groupBy(*cols).agg(F.sum("_s").alias("_s")).where("_s < 3").drop("_s")


def intersects(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, a.columns, "left_semi").limit(1).agg((F.count("*") > 0).alias("intersects"))


def power_set(items: Column) -> Column:
    """All subsets of an array of at most 20 items, by bit pattern."""
    return F.transform(F.sequence(F.lit(0), F.shiftleft(F.lit(1), 20) * 0 + F.pow(F.lit(2), F.size(items)).cast("int") - 1), lambda m: F.filter(items, lambda x, i: F.call_function("shiftright", m, i).bitwiseAND(F.lit(1)) == 1))


def is_sub_list(small: Column, big: Column) -> Column:
    """Whether an array stands in another in a row."""
    n = F.size(small)
    return (n == 0) | F.exists(F.sequence(F.lit(1), F.greatest(F.size(big), F.lit(1))), lambda i: F.slice(big, i, n) == small)


def unique_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.dropDuplicates(list(keys))


def multimap(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.sort_array(F.collect_set(value)).alias("values"))


def one_edit_pairs(words: DataFrame, column: str) -> DataFrame:
    """(x, y, distance): pairs of distinct words at most one insertion, deletion or change apart, x before y.

    Two such words share a word with one character left out (or one is it), and that key with the place of the gap tells how: an equi-join, no all pairs.
    """
    words, w = words.select(F.col(column).alias("_word")), F.col("_word")
    gaps = F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    keyed = words.select("_word", F.explode(F.array_distinct(F.concat(F.array(w), gaps))).alias("_key"))
    # of words of equal length both have lost a character, at the same place if one change parts them; a shorter word is the key itself
    pairs = keyed.toDF("x", "_key").join(keyed.toDF("y", "_key"), "_key").where("x < y").select("x", "y").distinct()
    return pairs.withColumn("distance", F.levenshtein("x", "y", 1)).where("distance between 0 and 1")


def beam(df: DataFrame, by: list[str], score: str, k: int) -> DataFrame:
    """At most k best rows a group; ties by all columns, so the result does not hang on partitioning."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), *[c for c in df.columns if c not in by and c != score])
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def sample(df: DataFrame, fraction: float, seed: int, key: str) -> DataFrame:
    """A stable share of rows by the hash of their key: the same rows however data are partitioned."""
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) < int(fraction * 1_000_000))


def sample_with_replacement(df: DataFrame, fraction: float, seed: int) -> DataFrame:
    return df.sample(True, fraction, seed)


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)


def indexed(df: DataFrame, *order: str | Column, name: str = "ix", sums: dict[str, Column] | None = None) -> DataFrame:
    """0-based running number in rising order, and running sums: per range partition, plus what the partitions before hold, so no task sees all rows.

    The sorted ranges are written once and numbered from there, so totals and rows come from the same partitioning.
    """
    keys = {f"__o{i}": (F.col(c) if isinstance(c, str) else c) for i, c in enumerate(order)}
    values = {f"__s{i}": c for i, c in enumerate((sums or {}).values())}
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wide = df.select("*", *(c.alias(k) for k, c in (keys | values).items()))
    ranges = wide.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop(*keys)
    placed = written(ranges.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    totals = placed.groupBy("__p").agg(F.count("*").alias("__n"), *(F.sum(k).alias(f"{k}n") for k in values))
    over = Window.orderBy("__p")  # one row a partition
    before = totals.select("__p", (F.sum("__n").over(over) - F.col("__n")).alias("__b"), *((F.sum(f"{k}n").over(over) - F.col(f"{k}n")).alias(f"{k}b") for k in values))
    out = placed.join(F.broadcast(before), "__p").withColumn(name, F.col("__b") + F.col("__i"))
    here = Window.partitionBy("__p").orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)
    for target, k in zip(sums or {}, values, strict=True):
        out = out.withColumn(target, F.col(f"{k}b") + F.sum(k).over(here))
    return out.drop("__p", "__i", "__b", *values, *(f"{k}b" for k in values))


def folds(df: DataFrame, order: str, k: int) -> DataFrame:
    """Contiguous folds; the first N mod k have one row more."""
    n = df.agg(F.count("*").alias("_n"))
    size, extra = F.floor(F.col("_n") / k), F.col("_n") % k
    out = indexed(df, order, name="_i").crossJoin(F.broadcast(n))
    first = extra * (size + 1)
    return out.withColumn("fold", F.when(F.col("_i") < first, F.floor(F.col("_i") / (size + 1))).otherwise(extra + F.floor((F.col("_i") - first) / F.greatest(size, F.lit(1)))).cast("long")).drop("_i", "_n")


def cross_validation(df: DataFrame, order: str, k: int) -> DataFrame:
    """Fold i holds rows N*i/k up to N*(i+1)/k."""
    n = df.agg(F.count("*").alias("_n"))
    return indexed(df, order, name="_i").crossJoin(F.broadcast(n)).withColumn("fold", F.floor(((F.col("_i") + 1) * k - 1) / F.col("_n")).cast("long")).drop("_i", "_n")


def train_dev(df: DataFrame, order: str, start: int, end: int) -> DataFrame:
    """Rows start <= i < end in order are dev, the others train."""
    return indexed(df, order, name="_i").withColumn("part", F.when((F.col("_i") >= start) & (F.col("_i") < end), "dev").otherwise("train")).drop("_i")
