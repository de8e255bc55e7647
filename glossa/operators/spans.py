"""Label runs, chunk encodings and spans over (doc_id, pos, label) tables.  All are gaps-and-islands over one window a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BACKGROUND = "O"
SCHEMES = ("IO", "IOB1", "IOB2", "IOE1", "IOE2", "SBIEO")


def _w(by):
    return Window.partitionBy(*by).orderBy("pos")


def tag_of(label: Column) -> Column:
    """Prefix of a tagged label (B, I, O, E, S, L, U, `[`, `]`); a bare label counts as I, a unit tag U as S and a last tag L as E."""
    p = F.regexp_extract(label, r"^([BIESLU\[\]])-", 1)
    return F.when(label == BACKGROUND, "O").when(p == "", "I").when(p == "U", "S").when(p == "L", "E").otherwise(p)


def type_of(label: Column) -> Column:
    return F.regexp_replace(label, r"^[BIESLU\[\]]-", "")


def with_borders(df: DataFrame, label: str = "label", by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds `starts` and `ends`: whether a chunk starts or ends at the token, for any of the encodings."""
    w = _w(by)
    out = df.withColumn("_g", tag_of(F.col(label))).withColumn("_t", type_of(F.col(label)))
    pg, pt, ng, nt = F.lag("_g", 1, "O").over(w), F.lag("_t", 1, "O").over(w), F.lead("_g", 1, "O").over(w), F.lead("_t", 1, "O").over(w)
    inside = F.col("_g") != "O"
    starts = inside & (F.col("_g").isin("B", "S", "[") | pg.isin("O", "E", "S", "]") | (pt != F.col("_t")))
    ends = inside & (F.col("_g").isin("E", "S", "]") | ng.isin("O", "B", "S", "[") | (nt != F.col("_t")))
    return out.withColumn("starts", starts).withColumn("ends", ends).withColumn("type", F.col("_t")).drop("_g", "_t")


def chunks(df: DataFrame, label: str = "label", by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(by, type, begin_pos, end_pos, n_tok, text): one row a chunk; end exclusive."""
    b = with_borders(df, label, by).withColumn("run", F.sum(F.col("starts").cast("int")).over(_w(by).rowsBetween(Window.unboundedPreceding, 0)))
    inside = b.where(F.col(label) != BACKGROUND)
    out = inside.groupBy(*by, "run").agg(F.min("type").alias("type"), F.min("pos").alias("begin_pos"), (F.max("pos") + 1).alias("end_pos"), F.count("*").alias("n_tok"), F.array_sort(F.collect_list(F.struct("pos", "tok"))).alias("_t"))
    return out.select(*by, "type", "begin_pos", "end_pos", "n_tok", F.array_join(F.col("_t.tok"), " ").alias("text"))


def encode(df: DataFrame, scheme: str, label: str = "label", by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Labels of any encoding in another; a chunk's neighbour of the same type keeps them apart where the scheme can say so."""
    b = with_borders(df, label, by)
    w = _w(by)
    before_same = F.coalesce(F.lag("ends").over(w) & (F.lag("type").over(w) == F.col("type")), F.lit(False))
    after_same = F.coalesce(F.lead("starts").over(w) & (F.lead("type").over(w) == F.col("type")), F.lit(False))
    s, e, t = F.col("starts"), F.col("ends"), F.col("type")
    prefix = {
        "IO": F.lit("I"),
        "IOB1": F.when(s & before_same, "B").otherwise("I"),
        "IOB2": F.when(s, "B").otherwise("I"),
        "IOE1": F.when(e & after_same, "E").otherwise("I"),
        "IOE2": F.when(e, "E").otherwise("I"),
        "SBIEO": F.when(s & e, "S").when(s, "B").when(e, "E").otherwise("I"),
    }[scheme]
    coded = F.when(F.col(label) == BACKGROUND, BACKGROUND).otherwise(t if scheme == "IO" else F.concat(prefix, F.lit("-"), t))
    return b.withColumn("coded", coded).drop("starts", "ends", "type")


def bare(label: Column) -> Column:
    return F.regexp_replace(label, r"^[BI]-", "")


def at_offsets(tokens: DataFrame, label: str = "label") -> DataFrame:
    """(doc_id, type, begin, end): character spans of label runs; tokens carry begin and end."""
    b = with_borders(tokens, label).withColumn("run", F.sum(F.col("starts").cast("int")).over(_w(("doc_id",)).rowsBetween(Window.unboundedPreceding, 0)))
    return b.where(F.col(label) != BACKGROUND).groupBy("doc_id", "run").agg(F.min("type").alias("type"), F.min("begin").alias("begin"), F.max("end").alias("end")).drop("run")


def by_characters(spans: DataFrame, tokens: DataFrame, width: int = 256) -> DataFrame:
    """Token borders of character spans: the tokens that overlap them, found in buckets of characters."""
    def bucketed(df, begin, end, *rest):
        lo, hi = F.floor(F.col(begin) / width), F.floor((F.greatest(F.col(end) - 1, F.col(begin))) / width)
        return df.select("doc_id", *rest, begin, end, F.explode(F.sequence(lo, hi)).alias("_b"))

    t = bucketed(tokens.select("doc_id", "pos", F.col("begin").alias("t0"), F.col("end").alias("t1")), "t0", "t1", "pos")
    j = bucketed(spans, "begin", "end", "type").join(t, ["doc_id", "_b"]).where("t0 < end and t1 > begin")
    return j.groupBy("doc_id", "type", "begin", "end").agg(F.min("pos").alias("begin_pos"), (F.max("pos") + 1).alias("end_pos"))


def chunk_records(spans: DataFrame, tokens: DataFrame) -> DataFrame:
    """Character spans (doc_id, type, begin, end) with their token range, tokens and text; neighbours keep the white space between them."""
    at = by_characters(spans, tokens)
    one = at.select("doc_id", "type", "begin", "end", "begin_pos", "end_pos", F.explode(F.sequence("begin_pos", F.col("end_pos") - 1)).alias("pos"))
    t = tokens.select("doc_id", "pos", "tok", "before")
    rows = one.join(t, ["doc_id", "pos"]).groupBy("doc_id", "type", "begin", "end", "begin_pos", "end_pos").agg(F.array_sort(F.collect_list(F.struct("pos", "tok", "before"))).alias("_t"))
    text = F.array_join(F.transform("_t", lambda x, i: F.when(i == 0, x["tok"]).otherwise(F.concat(x["before"], x["tok"]))), "")
    return rows.select("doc_id", "type", "begin", "end", "begin_pos", "end_pos", F.col("_t.tok").alias("tokens"), text.alias("text"))


def merged_chunks(a: DataFrame, b: DataFrame) -> DataFrame:
    """Spans of two tables as one from the first begin to the last end, for each document and type."""
    return a.union(b.select(a.columns)).groupBy("doc_id", "type").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))


def realign(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """Tokens cut where a span's border falls inside them: one row a piece."""
    cuts = spans.select("doc_id", F.explode(F.array("begin", "end")).alias("cut")).distinct()
    inside = tokens.join(cuts, "doc_id").where("cut > begin and cut < end").groupBy("doc_id", "pos").agg(F.sort_array(F.collect_set("cut")).alias("cuts"))
    t = tokens.join(inside, ["doc_id", "pos"], "left").withColumn("edges", F.concat(F.array("begin"), F.coalesce("cuts", F.expr("array()").cast("array<long>")), F.array("end")))
    p = t.select("doc_id", "pos", "tok", "begin", "edges", F.posexplode(F.slice("edges", 1, F.size("edges") - 1)).alias("piece", "a"))
    b = F.element_at("edges", F.col("piece") + 2)
    return p.select("doc_id", "pos", "piece", F.expr("substring(tok, cast(a - begin as int) + 1, cast(element_at(edges, piece + 2) - a as int))").alias("tok"), F.col("a").alias("begin"), b.alias("end"))


def replace_intervals(tokens: DataFrame, matches: DataFrame) -> DataFrame:
    """Tokens with sorted non-overlapping matches (doc_id, begin_pos, end_pos, text) put in their place."""
    m = matches.select("doc_id", "begin_pos", "end_pos", F.col("text").alias("merged"))
    covered = tokens.join(m, (tokens.doc_id == m.doc_id) & (tokens.pos >= m.begin_pos) & (tokens.pos < m.end_pos), "left_anti").select("doc_id", "pos", "tok")
    return covered.union(m.select("doc_id", F.col("begin_pos").alias("pos"), F.col("merged").alias("tok")))


def markable_text(df: DataFrame, gold: str, guess: str) -> DataFrame:
    """Chunk text with each token's guess, and one category for the chunk (MISC where guesses differ)."""
    b = with_borders(df, gold).withColumn("run", F.sum(F.col("starts").cast("int")).over(_w(("doc_id",)).rowsBetween(Window.unboundedPreceding, 0)))
    g = b.where(F.col(gold) != BACKGROUND).groupBy("doc_id", "run").agg(F.array_sort(F.collect_list(F.struct("pos", "tok", F.col(guess).alias("g")))).alias("t"), F.min(guess).alias("lo"), F.max(guess).alias("hi"), F.min("pos").alias("begin_pos"))
    return g.select("doc_id", "begin_pos", F.array_join(F.transform("t", lambda x: F.concat(x["tok"], F.lit("\\"), x["g"])), " ").alias("text"), F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("MISC").alias("category"))


#: Interval relations in order of test.
def relation(a0, a1, b0, b1) -> Column:
    """How [a0, a1) stands to [b0, b1)."""
    return (
        F.when((a0 == b0) & (a1 == b1), "EQUAL")
        .when(a1 == b0, "END_MEET_BEGIN")
        .when(a0 == b1, "BEGIN_MEET_END")
        .when(a1 < b0, "BEFORE")
        .when(a0 > b1, "AFTER")
        .when((a0 <= b0) & (a1 >= b1), "CONTAIN")
        .when((a0 >= b0) & (a1 <= b1), "INSIDE")
        .when((a0 < b1) & (b0 < a1), "OVERLAP")
        .otherwise("UNKNOWN")
    )


def related(a: DataFrame, b: DataFrame) -> DataFrame:
    """All pairs of a document's intervals in two tables with their relation; equi-join on the document."""
    x, y = a.select("doc_id", F.col("begin_pos").alias("a0"), F.col("end_pos").alias("a1")), b.select("doc_id", F.col("begin_pos").alias("b0"), F.col("end_pos").alias("b1"))
    return x.join(y, "doc_id").withColumn("relation", relation(F.col("a0"), F.col("a1"), F.col("b0"), F.col("b1")))


def relation_counts(a: DataFrame, b: DataFrame, width: int = 64) -> DataFrame:
    """(relation, n) over all pairs of a document's intervals in two tables, without making the pairs that are apart.

    Pairs that overlap or meet come from position buckets; those with b behind or before a are counted by running sums over the document's borders.
    """
    near = overlapping(a, b, width, meet=True).withColumn("relation", relation(F.col("a0"), F.col("a1"), F.col("b0"), F.col("b1"))).groupBy("relation").agg(F.count("*").alias("n"))

    def apart(name: str, x: DataFrame, end: str, y: DataFrame, start: str) -> DataFrame:
        """Pairs of an x whose `end` comes before a y's `start`: at each start, the ends seen so far."""
        ends, starts = x.select("doc_id", F.col(end).alias("at"), F.lit(1).alias("e"), F.lit(0).alias("s")), y.select("doc_id", F.col(start).alias("at"), F.lit(0).alias("e"), F.lit(1).alias("s"))
        c = ends.union(starts).groupBy("doc_id", "at").agg(F.sum("e").alias("e"), F.sum("s").alias("s"))
        seen = F.sum("e").over(Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
        return c.select((F.col("s") * F.coalesce(seen, F.lit(0))).alias("k")).agg(F.sum("k").alias("n")).where("n > 0").select(F.lit(name).alias("relation"), "n")

    return near.union(apart("BEFORE", a, "end_pos", b, "begin_pos")).union(apart("AFTER", b, "end_pos", a, "begin_pos"))


def overlapping(a: DataFrame, b: DataFrame, width: int = 64, meet: bool = False) -> DataFrame:
    """Pairs of overlapping spans by position buckets (`meet`: and of those where one begins as the other ends): no product of a document's spans."""
    def bucketed(df, p):
        lo, hi = F.floor(F.col("begin_pos") / width), F.floor((F.col("end_pos") - F.lit(0 if meet else 1)) / width)
        return df.select("doc_id", F.col("type").alias(f"{p}_type"), F.col("begin_pos").alias(f"{p}0"), F.col("end_pos").alias(f"{p}1"), F.explode(F.sequence(lo, hi)).alias("bucket"))

    j = bucketed(a, "a").join(bucketed(b, "b"), ["doc_id", "bucket"]).where("a0 <= b1 and b0 <= a1" if meet else "a0 < b1 and b0 < a1")
    # a pair that shares several buckets is kept in the first of them
    return j.where(F.col("bucket") == F.floor(F.greatest("a0", "b0") / width)).drop("bucket")
