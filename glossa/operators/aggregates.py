"""Entity counts, multi-column aggregators, feature statistics, selection, scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def entity_counts(mentions: DataFrame, per_doc: bool = False) -> DataFrame:
    """mentions: doc_id, tag, norm, form."""
    return mentions.groupBy(*(["doc_id"] if per_doc else []), "tag", "norm").agg(F.count("*").alias("n"))


def entities(mentions: DataFrame) -> DataFrame:
    """One row a (tag, norm): count, most popular form, other forms by falling count, number of documents.

    Forms are counted first, so the arrays hold distinct forms and not mentions.
    """
    forms = mentions.groupBy("tag", "norm", "form").agg(F.count("*").alias("k"))
    docs = mentions.groupBy("tag", "norm").agg(F.count_distinct("doc_id").alias("n_docs"))
    f = forms.groupBy("tag", "norm").agg(F.sum("k").alias("n"), F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("r"), "form"))).alias("_f"))
    out = f.join(docs, ["tag", "norm"])
    return out.select("tag", "norm", "n", "n_docs", F.col("_f")[0]["form"].alias("popular"), F.when(F.size("_f") > 1, F.array_join(F.col("_f.form"), "|")).alias("alternatives"))


def category_code(tag: Column) -> Column:
    #: Category numbers of the entity store.
    return F.when(tag == "PERSONA", 1).when(tag == "LOKACIJA", 4).when(tag == "ORGANIZACIJA", 13).otherwise(23)


def display_name(tag: Column, norm: Column, popular: Column) -> Column:
    from glossa.functions.text import capitalise_pieces

    return F.when(tag == "PERSONA", capitalise_pieces(norm)).otherwise(popular)


def at_least(counts: DataFrame, per_doc: DataFrame, limit: int, keys=("tag", "norm")) -> tuple[DataFrame, DataFrame]:
    """Totals of `limit` or more, and the per-document rows of those."""
    kept = counts.where(F.col("n") >= limit)
    return kept, per_doc.join(kept.select(*keys), list(keys), "left_semi")


def split_names(df: DataFrame) -> DataFrame:
    """Rows whose name and normal form list several entities (by `,` or ` .`) become one row each; unequal lists stay whole."""
    a, b = F.split("name", r",\s*| \.\s*"), F.split("norm", r",\s*| \.\s*")
    z = F.when(F.size(a) == F.size(b), F.arrays_zip(a.alias("name"), b.alias("norm"))).otherwise(F.array(F.struct(F.col("name"), F.col("norm"))))
    rest = [c for c in df.columns if c not in ("name", "norm")]
    return df.withColumn("_z", F.explode(z)).select(F.trim("_z.name").alias("name"), F.trim("_z.norm").alias("norm"), *rest).where("name <> ''")


def clean_names(df: DataFrame, fixes: list[tuple[str, str]]) -> DataFrame:
    """Ordered literal replacements, then the ending rules for names in -ijas and -ijā."""
    n = F.col("norm")
    for a, b in fixes:
        n = F.replace(n, F.lit(a), F.lit(b))
    n = F.regexp_replace(n, "(ijas|ijā)$", "ija")
    return df.withColumn("norm", n)


def blacklisted(df: DataFrame, blacklist: DataFrame) -> DataFrame:
    """Without short names, long normal forms, listed names, and pairs joined by ` un ` unless an opera."""
    keep = (F.length("name") >= 3) & (F.length("norm") <= 50) & ~(F.instr("norm", " un ") > 0) | (F.instr("norm", "opera") > 0) & (F.length("name") >= 3) & (F.length("norm") <= 50)
    return df.where(keep).join(blacklist, df["name"] == blacklist["word"], "left_anti")


def merge_entities(df: DataFrame, blacklist: DataFrame, fixes: list[tuple[str, str]], limit: int = 10) -> DataFrame:
    """Corpus merge: (category, norm, total, best_form) of entities counted at least `limit` times; df: name, norm, category, doc_id, n."""
    rows = blacklisted(clean_names(split_names(df), fixes), blacklist)
    forms = rows.groupBy("category", "norm", "name").agg(F.sum("n").alias("k"))
    return forms.groupBy("category", "norm").agg(F.sum("k").alias("total"), F.max_by("name", F.struct("k", "name")).alias("best_form")).where(F.col("total") >= limit)


def aggregator(name: str, column: str, order: str = "pos", sep: str = " ") -> Column:
    """A named aggregate over rows in order.  CONCAT and LIST gather one group's rows; the others keep constant state."""
    c, o = F.col(column), F.col(order)
    return {
        "FIRST": lambda: F.min_by(c, o),
        "FIRST_NON_NIL": lambda: F.min_by(c, F.when(c.isNotNull(), o)),
        "LAST": lambda: F.max_by(c, o),
        "LAST_NON_NIL": lambda: F.max_by(c, F.when(c.isNotNull(), o)),
        "COUNT": lambda: F.count("*"),
        "SUM": lambda: F.sum(c.cast("double")),
        "MIN": lambda: F.min(c),
        "MAX": lambda: F.max(c),
        "CONCAT": lambda: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(o.alias("o"), c.alias("c")))), lambda x: x["c"]), sep),
        "LIST": lambda: F.transform(F.array_sort(F.collect_list(F.struct(o.alias("o"), c.alias("c")))), lambda x: x["c"]),
        "MOST_FREQ": lambda: F.mode(c, True),
    }[name]()


def modes(df: DataFrame, column: str) -> DataFrame:
    c = df.groupBy(column).agg(F.count("*").alias("n"))
    top = c.agg(F.max("n").alias("n"))
    return c.join(F.broadcast(top), "n").select(column, "n")


# --- features: (example_id, feature) or (example_id, feature, value), labels (example_id, label) -----------------------------------------


def feature_counts(f: DataFrame) -> DataFrame:
    return f.groupBy("feature").agg(F.count("*").alias("n"))


def totals(f: DataFrame) -> DataFrame:
    """Tokens and types; the types are counted from partial counts."""
    c = feature_counts(f)
    return c.agg(F.sum("n").alias("tokens"), F.count("*").alias("types"))


def cutoff(f: DataFrame, low: int = 1, high: int | None = None, thresholds: list[tuple[str, int]] = ()) -> DataFrame:
    """Without features outside the limits; of (pattern, least) thresholds the first that matches a feature replaces `low`."""
    c = feature_counts(f)
    need = F.lit(low)
    for pattern, least in reversed(list(thresholds)):
        need = F.when(F.col("feature").rlike(f"^(?:{pattern})$"), least).otherwise(need)
    keep = c.where((F.col("n") >= need) & (F.lit(True) if high is None else F.col("n") <= high))
    return f.join(keep, "feature", "left_semi")


def information_gain(f: DataFrame, labels: DataFrame, compat: bool = False) -> DataFrame:
    """(feature, ig) in bits for binary features; with `compat` the absent side counts N - n(f, l)."""
    n = labels.agg(F.count("*").cast("double").alias("total"))
    by_label = labels.groupBy("label").agg(F.count("*").cast("double").alias("nl"))
    seen = f.select("example_id", "feature").distinct().join(labels, "example_id")
    nf = seen.groupBy("feature").agg(F.count("*").cast("double").alias("nf"))
    nfl = seen.groupBy("feature", "label").agg(F.count("*").cast("double").alias("nfl"))
    # one row a label, few by nature
    grid = nf.crossJoin(F.broadcast(by_label)).join(nfl, ["feature", "label"], "left").na.fill(0, ["nfl"]).crossJoin(F.broadcast(n))
    xlog = lambda p: F.when(p > 0, p * F.log2(p)).otherwise(0.0)
    pf = F.col("nf") / F.col("total")
    absent = (F.col("total") if compat else F.col("nl")) - F.col("nfl")
    inside = F.sum(-xlog(F.col("nl") / F.col("total")) + pf * xlog(F.col("nfl") / F.col("nf")) + (1 - pf) * xlog(absent / (F.col("total") - F.col("nf"))))
    return grid.groupBy("feature", "nf", "total").agg(inside.alias("g")).select("feature", F.when((F.col("nf") == 0) | (F.col("nf") == F.col("total")), 0.0).otherwise(F.col("g")).alias("ig"))


def top_features(scores: DataFrame, k: int, by: str = "ig") -> DataFrame:
    return scores.orderBy(F.desc(by), "feature").limit(k)


def tf_idf(f: DataFrame) -> DataFrame:
    """(example_id, feature, w): tf * ln((N + 1) / (df + 0.5)), divided by its sum in the example."""
    tf = f.groupBy("example_id", "feature").agg(F.count("*").alias("tf"))
    n = f.agg(F.count_distinct("example_id").alias("n"))
    df = tf.groupBy("feature").agg(F.count("*").alias("df"))
    w = tf.join(df, "feature").crossJoin(F.broadcast(n)).select("example_id", "feature", (F.col("tf") * F.log((F.col("n") + 1) / (F.col("df") + 0.5))).alias("w"))
    return w.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("example_id")))


def scale_min_max(f: DataFrame) -> DataFrame:
    s = f.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return f.join(s, "feature").select("example_id", "feature", F.when(F.col("hi") > F.col("lo"), (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0).alias("value"))


def scale_gaussian(f: DataFrame) -> DataFrame:
    s = f.groupBy("feature").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return f.join(s, "feature").select("example_id", "feature", F.when(F.col("s") > 0, (F.col("value") - F.col("m")) / F.col("s")).otherwise(0.0).alias("value"))


def label_sequences(df: DataFrame, n: int, label: str = "label") -> DataFrame:
    """Distinct label n-grams that occur."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    cols = [F.lag(label, k).over(w).alias(f"l{k}") for k in range(n - 1, 0, -1)] + [F.col(label).alias("l0")]
    out = df.select(*cols)
    return out.where(" and ".join(f"l{k} is not null" for k in range(n))).distinct()


def distinct_sentences(df: DataFrame, column: str = "sentence") -> DataFrame:
    s = F.when(F.instr(column, ".") > 0, F.expr(f"substring({column}, 1, length({column}) - 1)")).otherwise(F.col(column))
    return df.select(s.alias(column)).distinct()


def observed_features_once_on_background(f: DataFrame, background: str = "O") -> DataFrame:
    """Features whose only occurrence is on a background token; f: feature, label."""
    c = f.groupBy("feature").agg(F.count("*").alias("n"), F.min("label").alias("label"))
    return c.where((F.col("n") == 1) & (F.col("label") == background)).select("feature")


# --- templates: one struct of fields a clique or document ---------------------------------------------------------------------------


def merge_templates(df: DataFrame, by: list[str], fields: list[str]) -> DataFrame:
    """(by, fields): templates of a group filled together; groups whose templates have different values for a field do not merge and are left out."""
    agree = [F.count_distinct(f) <= 1 for f in fields]
    merged = df.groupBy(*by).agg(*(F.max(f).alias(f) for f in fields), *(a.alias(f"_{f}") for a, f in zip(agree, fields, strict=True)))
    return merged.where(" and ".join(f"`_{f}`" for f in fields)).select(*by, *fields)


def field_values(df: DataFrame, fields: list[str], score: str = "score") -> DataFrame:
    """(field, value, n): the score of all templates that give a field a value."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))).alias("_f")
    return df.select(score, each).where("_f.value is not null").groupBy("_f.field", "_f.value").agg(F.sum(score).alias("n"))


# --- estimates ------------------------------------------------------------------------------------------------------------------


def distinct_estimate(df: DataFrame, column: str, by: list[str] = (), error: float = 0.02) -> DataFrame:
    """(by, estimate): number of distinct values within a relative standard error, by sketches that are merged before the shuffle."""
    return df.groupBy(*by).agg(F.approx_count_distinct(column, error).alias("estimate"))


def quantile_estimates(df: DataFrame, column: str, shares: list[float], by: list[str] = (), accuracy: int = 10_000) -> DataFrame:
    """(by, quantiles): values at shares of the order, each within 1 / accuracy of its share."""
    return df.groupBy(*by).agg(F.percentile_approx(column, shares, accuracy).alias("quantiles"))
