"""Token feature templates as columns, exploded to (doc_id, sent_id, pos, clique, feature).

A template is a line of the table below: its group, the clique of labels it looks at (C the token's own, CpC the one before too, and so on further back
and ahead) and its pieces.  A piece `p2.tag` is the column `tag` of the token two before (c this token, p, p2 ... before, n, n2 ahead);
other pieces are text.  Beyond a sentence's ends words are empty and annotations read `null`; so do annotations that a token lacks.
Groups are switched by name, and a group may be used if its columns are there.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.operators.context import SENTENCE, disjunction, nearest, neighbour

#: The names that features end in, by group and clique.
TEMPLATES = """
word C c.tok -WORD
word2 C p2.tok -P2W
word2 C n2.tok -N2W
lower C c.lower -CL
lower C p.lower -PL
lower C n.lower -NL
unknown C c.unknown -UNKNOWN
unknown C p.unknown -PUNKNOWN
unknown C n.unknown -NUNKNOWN
lemma C c.lemma -LEM
lemma_neighbours C p.lemma -PLEM
lemma_neighbours C n.lemma -NLEM
abgene C c.abgene -ABGENE
abgene C p.abgene -PABGENE
abgene C n.abgene -NABGENE
abstract C c.abstract -ABSTRACT
abstract C p.abstract -PABSTRACT
abstract C n.abstract -NABSTRACT
abstract_freq C c.abstract -ABSTRACT c.freq -FREQ
abstract_dict C c.abstract -ABSTRACT c.freq -FREQ c.tag -TAG
abstract_dict C c.abstract -ABSTRACT c.dict -DICT c.tag -TAG
abstract_dict C c.abstract -ABSTRACT c.dict -DICT c.freq -FREQ c.tag -TAG
genia C c.genia -GENIA
genia C p.genia -PGENIA
genia C n.genia -NGENIA
web C c.web -WEB
web C p.web -PWEB
web C n.web -NWEB
web_dict C c.web -WEB c.freq -FREQ c.tag -TAG
web_dict C c.web -WEB c.dict -DICT c.tag -TAG
web_dict C c.web -WEB c.dict -DICT c.freq -FREQ c.tag -TAG
freq C c.freq -FREQ
url C c.url -ISURL
url_neighbours C p.url -PISURL
url_neighbours C n.url -NISURL
entity_rule C c.entity_rule -ENTITYRULE
entity_type C c.entity_type -ENTITYTYPE
entity_type_neighbours C p.entity_type -PENTITYTYPE
entity_type_neighbours C n.entity_type -NENTITYTYPE
date_range C c.date_range -ISDATERANGE
more_tags C p.tag - c.tok -PTAG-CWORD
more_distsim C p.distsim - c.tok -PDISTSIM-CWORD
position C c.position -POSITION
tag C c.tag -TAG
tag_neighbours C p.tag -PTAG
tag_neighbours C n.tag -NTAG
distsim C c.distsim -DISTSIM
distsim_neighbours C p.distsim -PDISTSIM
distsim_neighbours C n.distsim -NDISTSIM
neighbours C p.tok -PW
neighbours C n.tok -NW
either_side C p.tok -EW
either_side C n.tok -EW
word_pairs C c.tok - p.tok -W-PW
word_pairs C c.tok - n.tok -W-NW
sym_tags C p.tag - c.tag - n.tag -PCNTAGS
sym_tags C c.tag - n.tag -CNTAGS
sym_tags C p.tag - c.tag -PCTAGS
sym_distsim C p.distsim - c.distsim - n.distsim -PCNDISTSIM
sym_distsim C c.distsim - n.distsim -CNDISTSIM
sym_distsim C p.distsim - c.distsim -PCDISTSIM
sym_words C p.tok - n.tok -SWORDS
gaz C c.gaz -GAZ
gaz C n.gaz -NGAZ
gaz C p.gaz -PGAZ
more_gaz C c.gaz - c.tok -CG-CW-GAZ
more_gaz C c.gaz - n.gaz -CNGAZ
more_gaz C p.gaz - c.gaz -PCGAZ
abbr_here C c.abbr -ABBR
abbr C p.abbr - c.abbr -PCABBR
abbr C c.abbr - n.abbr -CNABBR
abbr C p.abbr - c.abbr - n.abbr -PCNABBR
abbr_word C c.tok - c.abbr -CWABB
chunk C p.chunk - c.chunk -PCCHUNK
chunk C c.chunk - n.chunk -CNCHUNK
chunk C p.chunk - c.chunk - n.chunk -PCNCHUNK
shape_conjunctions C c.position c.shape -POS-SH
shape_tag C c.tag c.shape -TAG-SH
shape_distsim C c.distsim c.shape -DISTSIM-SH
word_tag C c.tok - c.tag -W-T
word_tag C c.tok - p.tag -W-PT
word_tag C c.tok - n.tag -W-NT
head C c.head -HW
head_tag C c.head - c.tag -HW-T
head_distsim C c.head - c.distsim -HW-DISTSIM
governor C c.governor -GW
governor_tag C c.governor - c.tag -GW-T
governor_distsim C c.governor - c.distsim -DISTSIM-T1
head_governor C c.head - c.governor -HW_GW
shape C c.shape -TYPE
shape_neighbours C p.shape -PTYPE
shape_neighbours C n.shape -NTYPE
shape_pairs C p.tok ... c.shape -PW_CTYPE
shape_pairs C c.shape ... n.tok -NW_CTYPE
shape_pairs C p.shape ... c.shape -PCTYPE
shape_pairs C c.shape ... n.shape -CNTYPE
shape_pairs C p.shape ... c.shape ... n.shape -PCNTYPE
real_word C p2.tok ... c.shape -PPW_CTYPE
real_word C n2.tok ... c.shape -NNW_CTYPE
extra_tags C p2.tag - p.tag - c.tag -TTS
extra_tags C p3.tag - p2.tag - p.tag - c.tag -TTTS
extra_distsim C p2.distsim - p.distsim - c.distsim -DISTSIM_TTS1
extra_distsim C p3.distsim - p2.distsim - p.distsim - c.distsim -DISTSIM_TTTS1
section C c.section -SECTION
section C c.word_position -WORD_POSITION
section C c.sent_position -SENT_POSITION
section C c.para_position -PARA_POSITION
section C c.word_position - c.shape -WORD_POSITION_SHAPE
topic C c.topic -TopicID
topic C p.topic -PTopicID
topic C n.topic -NTopicID
stacked C c.stacked -CStackedNERTag
stacked C c.tok - c.stacked -WCStackedNERTag
stacked_next C c.stacked - n.stacked -CNStackedNERTag
stacked_next C c.tok - c.stacked - n.stacked -WCNStackedNERTag
stacked_prev C p.stacked - c.stacked -PCStackedNERTag
stacked_both C p.stacked - c.stacked - n.stacked -PCNStackedNERTag
synset C c.synset -WordnetSyn
proto C c.proto -Proto
phrase C c.phrase -PhraseTag
bins C c.bin1 -BIN1
bins C c.bin2 -BIN2
bins C c.bin3 -BIN3
bins C c.bin4 -BIN4
bins C c.bin5 -BIN5
bins C c.bin6 -BIN6
sequence CpC PSEQ
sequence CpC c.tok -PSEQW
sequence CpC p.tok - c.tok -PSEQW2
sequence CpC p.tok -PSEQpW
sequence_distsim CpC p.distsim -PSEQpDS
sequence_distsim CpC c.distsim -PSEQcDS
sequence_distsim CpC p.distsim - c.distsim -PSEQpcDS
sequence_shape CpC p.shape -PSEQpS
sequence_shape CpC c.shape -PSEQcS
sequence_shape CpC p.shape - c.shape -PSEQpcS
types3 CpC p.shape - c.shape - n.shape -PCNSHAPES
types2 CpC p.shape - c.shape -TYPES
more_types CpC p2.shape - p.shape - c.shape -YMS
more_types CpC p.shape - c.shape - n.shape -YMSPCN
typey CpC c.shape -TPS2
typey CpC n.shape -TNS1
taggy CpC p.tag - c.tag -TS
taggy_distsim CpC p.distsim - c.distsim -DISTSIM_TS1
abbr_sequence CpC p.abbr - c.abbr -PABBRANS
chunk_sequence CpC p.chunk - c.chunk - n.chunk -PCNCHUNK
entity_sequence CpC p.entity_type - c.entity_type -ETSEQ
url_sequence CpC p.url - c.url -URLSEQ
abbr2 Cp2C p2.abbr - c.abbr -P2ABBRANS
abbr2 Cp2C p2.abbr - c.abbr -P2AP2CABB
types_long CpCp2C p2.shape - p.shape - c.shape -TTPS
types_long CpCp2C p2.shape - p.shape - c.shape -TYPETYPES
abbr_long CpCp2C p2.abbr - p.abbr - c.abbr -2PABBRANS
chunk_long CpCp2C p2.chunk - p.chunk - c.chunk -2PCHUNKS
long CpCp2C PPSEQ
taggy_long CpCp2C p2.tag - p.tag - c.tag -TTS
taggy_shape CpCp2C p2.tag - p.tag - c.tag - c.shape -TTS-CS
taggy_distsim_long CpCp2C p2.distsim - p.distsim - c.distsim -DISTSIM_TTS1
taggy_distsim_shape CpCp2C p2.distsim - p.distsim - c.distsim - c.shape -DISTSIM_TTS1-CS
taggy_long CpCp2Cp3C p3.tag - p2.tag - p.tag - c.tag -TTTS
taggy_shape CpCp2Cp3C p3.tag - p2.tag - p.tag - c.tag - c.shape -TTTS-CS
taggy_distsim_long CpCp2Cp3C p3.distsim - p2.distsim - p.distsim - c.distsim -DISTSIM_TTTS1
taggy_distsim_shape CpCp2Cp3C p3.distsim - p2.distsim - p.distsim - c.distsim - c.shape -DISTSIM_TTTS1-CS
long CpCp2Cp3C PPPSEQ
long CpCp2Cp3Cp4C PPPPSEQ
next_sequence CnC NSEQ
next_sequence CnC c.tok -NSEQW
both_sequence CpCnC PNSEQ
both_sequence CpCnC c.tok -PNSEQW
"""

Template = tuple[str, str, tuple[str, ...]]
_REFERENCE = re.compile(r"([cpn])([2-4]?)\.(\w+)$")
#: Columns that read as empty beyond a sentence's ends; all others read `null`.
WORDS = ("tok", "lower")


def templates(*groups: str) -> list[Template]:
    """Lines of the table as (group, clique, pieces); all, or those of some groups."""
    lines = [(g, q, tuple(pieces)) for g, q, *pieces in map(str.split, TEMPLATES.strip().splitlines())]
    if unknown := set(groups) - {g for g, _, _ in lines}:
        raise ValueError(f"no such groups of templates: {sorted(unknown)}")
    return [t for t in lines if not groups or t[0] in groups]


def _references(rows: list[Template]) -> set[tuple[str, int]]:
    out = set()
    for _, _, pieces in rows:
        for side, far, column in (m.groups() for p in pieces if (m := _REFERENCE.match(p))):
            out.add((column, {"c": 0, "p": -1, "n": 1}[side] * int(far or 1)))
    return out


def _name(column: str, k: int) -> str:
    return f"__{column}_{k}".replace("-", "m")


def _with(items: Column, ending: str) -> Column:
    return F.transform(items, lambda x: F.concat(x, F.lit(ending)))


def extract(df: DataFrame, groups: tuple[str, ...] = ("word", "neighbours", "shape"), extra: list[tuple[str, Column]] = (), by=SENTENCE, domain: str | None = None) -> DataFrame:
    """(by, pos, clique, feature `...|CLIQUE`); `extra` are (clique, array column) pairs; with a domain each feature is repeated with the domain's prefix."""
    rows = templates(*groups)
    if any(r[0] == "lower" for r in rows) and "lower" not in df.columns:
        df = df.withColumn("lower", F.lower("tok"))
    wide = df.select("*", *(F.coalesce((neighbour(c, k, None, by) if k else F.col(c)).cast("string"), F.lit("" if c in WORDS else "null")).alias(_name(c, k)) for c, k in sorted(_references(rows))))

    def made(t: Template) -> Column:
        parts = []
        for piece in t[2]:
            m = _REFERENCE.match(piece)
            parts.append(F.col(_name(m[3], {"c": 0, "p": -1, "n": 1}[m[1]] * int(m[2] or 1))) if m else F.lit(piece))
        return F.concat(*parts, F.lit(f"|{t[1]}"))

    feats = F.array(*map(made, rows))
    for clique, column in extra:
        feats = F.concat(feats, _with(column, f"|{clique}"))
    if domain:
        feats = F.concat(feats, F.transform(feats, lambda x: F.concat(F.lit(f"{domain}-"), x)))
    out = wide.select(*by, "pos", F.explode(F.array_distinct(feats)).alias("feature"))
    return out.select(*by, "pos", F.regexp_extract("feature", r"\|([A-Za-z0-9]+)$", 1).alias("clique"), "feature")


# --- features that are no plain strings of columns; each is an array column for `extra` ---------------------------------------------


def begin_features(by=SENTENCE) -> Column:
    """Whether the token begins its sentence, alone and with its shape."""
    mark = F.when(neighbour("pos", -1, None, by).isNull(), "BEGIN-SENT").otherwise("IN-SENT")
    return F.array(mark, F.concat(F.coalesce("shape", F.lit("null")), F.lit("-"), mark))


#: Number words that make up ordinals.
ORDINAL_WORDS = "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth twenty twentieth thirty thirtieth forty fortieth fifty fiftieth sixty sixtieth seventy seventieth eighty eightieth ninety ninetieth one two three four five six seven eight nine hundred hundredth".split()


def ordinal_features(column: str = "tok", by=SENTENCE) -> Column:
    """C_ORDINAL for an ordinal, PC_ORDINAL if one stands before too, P_ORDINAL if one stands before alone.

    An ordinal is made of number words or of digits with an ending; digits count too where an ending stands next.
    """
    pattern = rf"(?i)^(?:(?:(?:{'|'.join(ORDINAL_WORDS)})-?)+|[0-9]+(?:st|nd|rd|th))$"
    split = F.col(column).rlike("^[0-9]+$") & F.coalesce(neighbour(column, 1, None, by).rlike("(?i)^(?:st|nd|rd|th)$"), F.lit(False))
    here = F.col(column).rlike(pattern) | split
    before = F.coalesce(neighbour(column, -1, None, by).rlike(pattern), F.lit(False))
    return F.array_compact(F.array(F.when(here, "C_ORDINAL"), F.when(here & before, "PC_ORDINAL"), F.when(before & ~here, "P_ORDINAL")))


def verb_features(df: DataFrame, tag: str = "tag") -> Column:
    """The nearest verb before and after, and the pair; X where there is none."""
    verb = F.col(tag).startswith("VB")
    before, after = nearest(df, "tok", verb), nearest(df, "tok", verb, before=False)
    return F.array(F.concat(before, F.lit("-PVB")), F.concat(after, F.lit("-NVB")), F.concat(before, F.lit("-"), after, F.lit("-PNVB")))


def disjunctive_features(width: int = 4, wide: int | None = None, shapes: bool = False, either: bool = False, by=SENTENCE) -> Column:
    """Words within `width` on each side; with the token's shape; within a wider reach; on either side alike; and shapes ahead."""
    ahead, behind = disjunction("tok", width, by=by), disjunction("tok", width, False, by)
    out = [_with(ahead, "-DISJN"), _with(behind, "-DISJP")]
    if shapes:
        out += [F.transform(ahead, lambda x: F.concat(x, F.lit("-"), F.col("shape"), F.lit("-DISJN-CS"))), F.transform(behind, lambda x: F.concat(x, F.lit("-"), F.col("shape"), F.lit("-DISJP-CS")))]
        near = disjunction("shape", width, by=by)
        out += [_with(near, "-NDISJSHAPE"), F.transform(near, lambda x: F.concat(F.col("shape"), F.lit("-"), x, F.lit("-CNDISJSHAPE")))]
    if wide:
        out += [_with(disjunction("tok", wide, by=by), "-DISJWN"), _with(disjunction("tok", wide, False, by), "-DISJWP")]
        if either:
            out.append(_with(F.array_union(disjunction("tok", wide, by=by), disjunction("tok", wide, False, by)), "-DISJWE"))
    return F.concat(*out)


def ngram_features(low: int = 2, high: int = 6, middle: bool = True) -> Column:
    return T.char_ngrams(F.col("tok"), low, high, middle)


def neighbour_ngrams(longest: int = 6, by=SENTENCE) -> Column:
    """Prefixes and suffixes of this word and of the one before, for the pair clique."""
    def edges(w: Column, name: str) -> Column:
        lengths = F.sequence(F.lit(0), F.least(F.length(w), F.lit(longest)))
        return F.concat(F.transform(lengths, lambda k: F.concat(F.left(w, k), F.lit(f"-{name}-PREFIX"))), F.transform(lengths, lambda k: F.concat(F.right(w, k), F.lit(f"-{name}-SUFFIX"))))

    return F.array_distinct(F.concat(edges(F.coalesce(neighbour("tok", -1, None, by), F.lit("")), "PREVIOUS"), edges(F.col("tok"), "CURRENT")))


def binned_length(column: str = "tok", bins: tuple[int, ...] = (1, 3, 6, 10)) -> Column:
    out = F.lit(f"Len-{bins[-1]}-Inf")
    for lo, hi in reversed(list(zip(bins, bins[1:], strict=False))):
        out = F.when(F.length(column) < hi, f"Len-{lo}-{hi}").otherwise(out)
    return out


def name_list_features(last: list[str], male: list[str], female: list[str], column: str = "tok") -> Column:
    """Membership in lists of names, which are small enough to stand in the plan; larger lists are joined (sets.member_flag)."""
    w = F.col(column)
    return F.array_compact(F.array(*(F.when(w.isin(*names), mark) for names, mark in ((last, "LAST_NAME"), (male, "MALE_NAME"), (female, "FEMALE_NAME")) if names)))


def number_features(column: str = "tok") -> Column:
    """Whether the token is a whole number above or below zero."""
    v = F.when(F.col(column).rlike(r"^[+-]?[0-9]{1,18}$"), F.col(column).cast("long"))
    return F.array_compact(F.array(F.when(v > 0, "POSITIVE_INTEGER"), F.when(v < 0, "NEGATIVE_INTEGER")))


def morphology_features(attrs: str = "attrs", names: tuple[str, ...] = ("CASE", "NUMBER", "POS", "LETA-LEMMA"), by=SENTENCE) -> Column:
    """MORPHO-NAME-C-value of the token's attribute map, and -P- and -N- of its neighbours'."""
    sides = (("C", F.col(attrs)), ("P", neighbour(attrs, -1, None, by)), ("N", neighbour(attrs, 1, None, by)))
    return F.array(*(F.concat(F.lit(f"MORPHO-{n}-{s}-"), F.coalesce(m[n.lower()], F.lit("null"))) for n in names for s, m in sides))


def reading_features(readings: str = "readings", best: str | None = None, ids: bool = False, suffix: str = "") -> Column:
    """Tags and part-of-speech letters of all readings and of the best one; with `ids` the ending's number, which stands for the lexeme's too."""
    r = F.col(readings)
    out = [F.transform(r, lambda x: F.concat(F.left(x["tag"], F.lit(1)), F.lit(f"-LV-POS{suffix}"))), F.transform(r, lambda x: F.concat(x["tag"], F.lit(f"-LV-TAG{suffix}")))]
    if ids:
        out.append(F.flatten(F.transform(r, lambda x: F.array(F.concat(x["ending"].cast("string"), F.lit("-LV-ENDID")), F.concat(x["ending"].cast("string"), F.lit("-LV-LEXID"))))))
    if best:
        t = F.col(best)["tag"]
        out.append(F.when(t.isNull(), F.array(F.lit(f"x-LV-BEST-POS{suffix}"), F.lit(f"xx-LV-BEST-TAG{suffix}"))).otherwise(F.array(F.concat(F.left(t, F.lit(1)), F.lit(f"-LV-BEST-POS{suffix}")), F.concat(t, F.lit(f"-LV-BEST-TAG{suffix}")))))
    return F.array_distinct(F.concat(*(F.coalesce(c, F.array().cast("array<string>")) for c in out)))


#: The clique of a bracket k tokens back.
PAREN_CLIQUES = {1: "CpC", 2: "Cp2C", 3: "Cp3C", 4: "Cp4C", 5: "Cp5C"}


def paren_match(k: int, by=SENTENCE) -> Column:
    """PAREN-MATCH where the token closes a bracket that opened k tokens before, with nothing closed between."""
    def closes(opening: str, closing: str) -> Column:
        found = (F.col("tok") == closing) & (neighbour("tok", -k, "", by) == opening)
        for j in range(1, k):
            found = found & (neighbour("tok", -j, "", by) != closing)
        return found

    return F.array_compact(F.array(F.when(closes("(", ")") | closes("[", "]") | closes("-LRB-", "-RRB-") | closes("-LSB-", "-RSB-"), "PAREN-MATCH")))


def boundary_features(mark: str = "*BOUNDARY*", by=SENTENCE) -> list[tuple[str, Column]]:
    """Features of label spans that reach over a boundary token."""
    at = neighbour("tok", -1, "", by) == mark
    return [(q, F.array_compact(F.array(F.when(at, f"BNDRY-SPAN-{n}")))) for q, n in (("CpCp2C", "PPSEQ"), ("CpCp2Cp3C", "PPPSEQ"), ("CpCp2Cp3Cp4C", "PPPPSEQ"))]


def with_previous_classes(features: DataFrame, labels: DataFrame, k: int = 1, by=SENTENCE) -> DataFrame:
    """CMM conditioning: features of more than the token's own label get the classes before it."""
    prev = labels.select(*by, "pos", F.concat_ws("-", *(neighbour("label", -i, "O", by) for i in range(k, 0, -1))).alias("before"))
    return features.join(prev, [*by, "pos"]).withColumn("feature", F.when(F.col("clique") != "C", F.concat("feature", F.lit("-"), "before")).otherwise(F.col("feature"))).drop("before")


#: Feature factories by name; `glossa.operators.plugins` adds to them.
REGISTRY: dict[str, Callable[[DataFrame], DataFrame]] = {"word": lambda d: extract(d, ("word",)), "word_shape": lambda d: extract(d, ("word", "neighbours", "shape")), "pairs": lambda d: extract(d, ("sequence", "types2"))}
