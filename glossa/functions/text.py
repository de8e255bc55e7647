"""Column functions over strings: tokens, shapes, n-grams, predicates and clean-up.  All are JVM expressions unless named `*_udf`."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters, numbers with inner separators, or single marks; the form both Java and RE2 read alike.
TOKEN = r"[\p{L}]+|[0-9]+(?:[.,][0-9]+)*|[^\s\p{L}0-9]"
#: Classes of the rule tokenizer in order of trial, each with its pattern.
_WORD_PART = r"[\p{L}\p{M}\p{Nd}]"
_URL_END = r"[^\s<>\"|.,;:!?')\]}]"
TOKEN_CLASSES = [
    ("SGML", r"<!--(?s:.*?)-->|<[/!?]?[A-Za-z][^<>]*>"),
    ("ENTITY", r"&(?:[A-Za-z]+|#[0-9]+|#x[0-9A-Fa-f]+);"),
    ("URL", rf"(?:https?|ftp)://[^\s<>\"|]*{_URL_END}|www\.[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?:/[^\s<>\"|]*{_URL_END})?"),
    ("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("DOMAIN", rf"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.(?:com|net|org|edu|gov|mil|info)(?![A-Za-z0-9])(?:/[^\s<>\"|]*{_URL_END})?"),
    ("HANDLE", r"[@#][A-Za-z_][A-Za-z0-9_]*"),
    ("EMOTICON", r"[<>]?[:;=][-o*']?[()\[\]DPp](?![A-Za-z0-9])|<3(?![0-9])|\^_+\^"),
    ("DATE", r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9])|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}(?![0-9])|[0-9]{1,2}-[0-9]{1,2}-[0-9]{2,4}(?![0-9])"),
    ("PHONE", r"\(?[0-9]{3}\)?[-. ][0-9]{3}[-.][0-9]{4}(?![0-9])|\+[0-9]{1,3}(?:[- ][0-9]{2,4}){2,4}(?![0-9])"),
    ("FRACTION", r"(?:[0-9]+[- ])?[0-9]+/[0-9]+(?![0-9])|[½¼¾⅓⅔]"),
    ("ORDINAL", r"[0-9]+(?:st|nd|rd|th)(?!\p{L})"),
    ("NUMBER", r"(?<![\p{L}\p{Nd}])[-+]?[0-9]+(?:[.,:][0-9]+)*|[0-9]+(?:[.,:][0-9]+)*"),
    ("CURRENCY", r"(?:US|HK|A|C|NZ|R)?\$|[£€¥¢₤]"),
    ("ACRONYM", r"(?:[A-Za-z]\.){2,}|[A-Z]&[A-Z](?!\p{L})"),
    ("ABBREVIATION", r"(?:Mr|Mrs|Ms|Dr|Prof|Rev|Gen|Sen|Rep|Gov|Lt|Col|Capt|Sgt|St|Jr|Sr|Inc|Corp|Co|Ltd|Bros|Mt|Ft|Ave|Blvd|Rd|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept?|Oct|Nov|Dec|Mon|Tues?|Wed|Thurs?|Fri|vs|etc|al|No|Fig|ca|cf|approx|dept|est)\.(?=\s|[,;:)]|$)"),
    ("SPLIT_WORD", r"(?i:can(?=not(?!\p{L}))|gon(?=na(?!\p{L}))|got(?=ta(?!\p{L}))|wan(?=na(?!\p{L}))|gim(?=me(?!\p{L}))|lem(?=me(?!\p{L})))"),
    ("BEFORE_NOT", rf"{_WORD_PART}+?(?=n['’]t(?!\p{{L}}))"),
    ("NOT", r"n['’]t(?!\p{L})"),
    ("CLITIC", r"['’](?:s|S|re|RE|ve|VE|ll|LL|d|D|m|M)(?!\p{L})"),
    ("WORD", rf"\p{{L}}{_WORD_PART}*(?:(?:-|_|['’](?!(?:s|S|re|RE|ve|VE|ll|LL|d|D|m|M)(?!\p{{L}}))(?=\p{{L}})){_WORD_PART}+)*"),
    ("ELLIPSIS", r"\.{2,}|…|\. \. \."),
    ("DASH", r"-{2,}|[–—]+"),
    ("QUOTE", r"``|''|[\"“”„«»‘’'`]"),
    ("STOP", r"[!?]+|\."),
    ("MARK", r"[^\s]"),
]
RICH_TOKEN = "|".join(p for _, p in TOKEN_CLASSES)


def token_class(w: Column) -> Column:
    """The first class whose pattern a token fills, to be asked once a distinct token; none for the empty string."""
    out = F.when(w.rlike(f"^(?:{TOKEN_CLASSES[0][1]})$"), TOKEN_CLASSES[0][0])
    for name, pattern in TOKEN_CLASSES[1:]:
        plain = pattern if name not in ("SPLIT_WORD", "BEFORE_NOT", "ABBREVIATION") else {"SPLIT_WORD": "(?!)", "BEFORE_NOT": "(?!)", "ABBREVIATION": pattern.replace(r"(?=\s|[,;:)]|$)", "")}[name]
        out = out.when(w.rlike(f"^(?:{plain})$"), name)
    return out


def tokens(text, pattern: str = TOKEN) -> Column:
    return F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(pattern), F.lit(0))


def whitespace_tokens(text: Column, newlines: bool = False) -> Column:
    """Split on white space; with `newlines` each line end is a token of its own."""
    return F.regexp_extract_all(text, F.lit(r"\n|[^\s]+" if newlines else r"[^\s]+"), F.lit(0))


def detokenise(words: Column) -> Column:
    """Tokens to running text by English spacing."""
    out = F.array_join(words, " ")
    for pattern, to in ((r" ([.,;:!?%)\]}]|'s|n't|'re|'ve|'ll|'d|'m)", "$1"), (r"([(\[{$#]) ", "$1"), (r"`` ?", '"'), (r" ?''", '"')):
        out = F.regexp_replace(out, pattern, to)
    return out


def rejoin(before: Column, words: Column, after: Column | None = None) -> Column:
    """The original text from each token's white space before it, and what follows the last one."""
    out = F.array_join(F.zip_with(before, words, lambda b, w: F.concat(b, w)), "")
    return out if after is None else F.concat(out, after)


OPTIONS = {
    "ptb3_parentheses": [("(", "-LRB-"), (")", "-RRB-")],
    "ptb3_brackets": [("[", "-LSB-"), ("]", "-RSB-"), ("{", "-LCB-"), ("}", "-RCB-")],
    "ascii_quotes": [("“", '"'), ("”", '"'), ("‘", "'"), ("’", "'")],
    "latex_quotes": [("“", "``"), ("”", "''"), ("‘", "`"), ("’", "'")],
    "unicode_quotes": [("``", "“"), ("''", "”"), ("`", "‘"), ("'", "’")],
    "ptb3_ellipsis": [("…", "...")],
    "unicode_ellipsis": [("...", "…")],
    "ptb3_dashes": [("—", "--"), ("–", "--")],
    "normalize_ampersand": [("&amp;", "&")],
    "normalize_currency": [("€", "$"), ("£", "#"), ("¢", "cents")],
    "normalize_fractions": [("½", "1/2"), ("¼", "1/4"), ("¾", "3/4"), ("⅓", "1/3"), ("⅔", "2/3")],
    "normalize_space": [(" ", " ")],
    "escape_slash_asterisk": [("/", "\\/"), ("*", "\\*")],
}


def normalise_token(token: Column, *options: str) -> Column:
    """Tokenizer options after the fact, each an ordered list of literal replacements."""
    for name in options:
        for a, b in OPTIONS[name]:
            token = F.replace(token, F.lit(a), F.lit(b))
    return token


# --- shapes ---------------------------------------------------------------------------------------------------------------

#: Names of Greek letters that shapes know.
GREEK = "alpha beta gamma delta epsilon zeta theta iota kappa lambda omicron rho sigma tau upsilon omega".split()
#: Numerals of ideographs that count as digits, less the first, and those of dates.
IDEOGRAPH_NUMBERS, IDEOGRAPH_DATES = "二三四五六七八九十零〇百千万亿兩○◯", "年月日"


def shape_dan1(w: Column) -> Column:
    """One of five classes for the whole word; an empty word has nothing but digits."""
    return (
        F.when(w.rlike(r"^\p{Nd}*$"), "ALL-DIGITS")
        .when(w.rlike(r"^\p{IsUppercase}+$"), "ALL-UPPER")
        .when(w.rlike(r"^\p{IsLowercase}+$"), "ALL-LOWER")
        .when(w.rlike(r"^\p{IsUppercase}\p{IsLowercase}+$"), "MIXED-CASE")
        .otherwise("OTHER")
    )


def _cased(w: Column, upper: str = r"\p{IsUppercase}", lower: str = r"\p{IsLowercase}") -> Column:
    """Capitals, small letters and digits as X, x and d, character by character; others stay."""
    for pattern, to in ((upper, "X"), (lower, "x"), (r"\p{Nd}", "d")):
        w = F.regexp_replace(w, pattern, to)
    return w


def _greek_marked(w: Column) -> Column:
    """Names of Greek letters as \u0001 and as many \u0002 as fill their place, the leftmost first."""
    out = F.regexp_replace(w, f"({'|'.join(GREEK)})", "\u0001$1")
    for n in sorted({len(g) for g in GREEK}):
        out = F.regexp_replace(out, f"\u0001(?:{'|'.join(g for g in GREEK if len(g) == n)})", "\u0001" + "\u0002" * (n - 1))
    return out


def _runs(body: Column) -> Column:
    """Each run of one class once; a tilde at the start is taken for a repeated one."""
    return F.regexp_replace(F.regexp_replace(body, r"(?s)(.)\1+", "$1"), "^~", "")


def _known(body: Column, known: Column | None) -> Column:
    return F.lit("") if known is None else F.when(body.rlike("^[xX]*$") & known, "k").otherwise("")


def _short(w: Column) -> Column:
    return F.when(F.length(w) <= 3, F.concat(F.lit(":"), F.length(w).cast("string"))).otherwise("")


def shape_dan2(w: Column, known: Column | None = None) -> Column:
    """`WT-` and the classes with each run once, `:n` for words of up to three characters, `k` if the word is known in small letters."""
    body = _cased(w, lower=r"[\p{IsLowercase}_]")
    return F.concat(F.lit("WT-"), _runs(body), _short(w), _known(body, known))


def shape_bio(w: Column, known: Column | None = None) -> Column:
    """dan2, and `-GREEK` if the name of a Greek letter is in the word, in any case."""
    return F.concat(shape_dan2(w, known), F.when(F.lower(w).rlike("|".join(GREEK)), "-GREEK").otherwise(""))


def shape_jenny(w: Column, known: Column | None = None) -> Column:
    """As dan2, with names of Greek letters as g and underscores as they are."""
    body = F.translate(_cased(_greek_marked(w)), "\u0001\u0002", "g")
    return F.concat(F.lit("WT-"), _runs(body), _short(w), _known(body, known))


def shape_chris1(w: Column) -> Column:
    """One of 24 classes after number, acronym, capitals, digits and dashes."""
    low, up, digit, dash, period = r"[\p{L}&&[^\p{IsUppercase}]]", r"[\p{IsUppercase}\p{Lt}]", r"\p{Nd}", "-", r"\."
    has = {k: w.rlike(v) for k, v in (("low", low), ("up", up), ("digit", digit), ("dash", dash), ("period", period))}
    initial = w.rlike(rf"(?s)^{up}")
    caps, small = has["up"] & ~has["low"], has["low"] & ~has["up"]
    tail = lambda name, condition, dashed: [(f"{name}-DIGIT-DASH", condition & has["digit"] & has["dash"]), (f"{name}-DIGIT", condition & has["digit"]), (dashed, condition & has["dash"]), (name, condition)]
    rules = [
        ("CARDINAL13", w.rlike(rf"^{digit}{{1,3}}$")),
        ("CARDINAL4", w.rlike(rf"^{digit}{{4}}$")),
        ("CARDINAL5PLUS", w.rlike(rf"^{digit}{{5,}}$")),
        ("NUMBER", w.rlike(rf"^[-+]?[\p{{Nd}}.,]+$") & has["digit"]),
        ("ACRONYM1", (F.length(w) == 2) & initial & has["period"]),
        ("ACRONYM", caps & ~has["digit"] & has["period"]),
        ("DIGIT-DASH", has["digit"] & has["dash"] & ~has["up"] & ~has["low"]),
        *tail("CAPITALIZED", initial & has["low"], "CAPITALIZED-DASH"),
        *tail("ALLCAPS", caps, "ALLCAPS"),
        *tail("LOWERCASE", small, "LOWERCASE-DASH"),
        ("MIXEDCASE-DIGIT", has["low"] & has["digit"]),
        ("MIXEDCASE", has["low"]),
        ("SYMBOL-DIGIT", has["digit"]),
    ]
    out = F.when(rules[0][1], rules[0][0])
    for name, condition in rules[1:]:
        out = out.when(condition, name)
    return out.otherwise("SYMBOL")


def _edges(w: Column, classes: Column, known: Column | None, omit: bool) -> Column:
    """Classes of the first and last two characters in order, and between them those of the others, sorted, each once (if `omit`, only those the edges lack).

    `classes` has one entry a character; \u0002 is the rest of a name that the character before it began.
    """
    n = F.size(classes)
    real = lambda a: F.filter(a, lambda c: c != "\u0002")
    begin, end = real(F.slice(classes, 1, 2)), real(F.slice(classes, F.greatest(n - 1, F.lit(1)), 2))
    between = F.array_sort(F.array_distinct(real(F.slice(classes, 3, F.greatest(n - 4, F.lit(0))))))
    if omit:
        between = F.array_except(between, F.concat(begin, end))
    body = F.array_join(real(classes), "")
    return F.concat(F.when(n <= 4, body).otherwise(F.array_join(F.concat(begin, between, end), "")), _known(body, known))


def shape_chris2(w: Column, known: Column | None = None, omit: bool = False) -> Column:
    """Edges and sorted middle of X, x, d, g (names of Greek letters) and other characters."""
    return _edges(w, _characters(F.translate(_cased(_greek_marked(w), upper=r"[\p{IsUppercase}\p{Lt}]"), "\u0001", "g")), known, omit)


def _characters(w: Column) -> Column:
    return F.filter(F.split(w, ""), lambda c: c != "")


def shape_chris4(w: Column, known: Column | None = None) -> Column:
    """As chris2, over more classes: numbers of all kinds, dates, scripts without case, space, money, marks by kind."""
    classes = [
        ("\u0002", "\u0002"), ("g", "\u0001"), ("d", rf"[\p{{Nd}}\p{{Nl}}\p{{No}}{IDEOGRAPH_NUMBERS}]"), ("o", "第"), ("D", f"[{IDEOGRAPH_DATES}]"), ("x", r"\p{IsLowercase}"), ("X", r"[\p{IsUppercase}\p{Lt}]"),
        ("s", r"[\t-\r\x1c-\x1f\p{Z}]"), ("c", r"\p{Lo}"), ("$", r"\p{Sc}"), ("+", r"\p{Sm}"), ("|", r"\p{So}"), ("(", r"\p{Ps}"), (")", r"\p{Pe}"), ("`", r"\p{Pi}"), ("'", r"[\p{Pf}']"), ("%", "%"), (".", r"\p{Po}"), ("_", r"\p{Pc}"), ("-", r"\p{Pd}"),
    ]

    def of(c: Column) -> Column:
        out = F.when(c.rlike(classes[0][1]), classes[0][0])
        for name, pattern in classes[1:]:
            out = out.when(c.rlike(pattern), name)
        return out.otherwise("q")

    return _edges(w, F.transform(_characters(_greek_marked(w)), of), known, False)


def shape_digits(w: Column) -> Column:
    return F.regexp_replace(w, r"\p{Nd}", "9")


SHAPES = {"dan1": shape_dan1, "dan2": shape_dan2, "dan2bio": shape_bio, "jenny1": shape_jenny, "chris1": shape_chris1, "chris2": shape_chris2, "chris3": lambda w: shape_chris2(w, omit=True), "chris4": shape_chris4, "digits": shape_digits}

# --- predicates -----------------------------------------------------------------------------------------------------------


def is_name_case(w: Column) -> Column:
    return w.rlike(r"^\p{Lu}[^\p{Lu}]+$")


def no_upper_case(w: Column) -> Column:
    return ~w.rlike(r"\p{Lu}")


def has_letter(w: Column) -> Column:
    return w.rlike(r"\p{L}")


def is_capitalised(w: Column) -> Column:
    return w.rlike(r"^\p{Lu}")


def is_title(w: Column) -> Column:
    return w.rlike(r"^(Mr|Ms|Mrs|Dr|Miss|Sen|Judge|Sir)\.?$")


def is_ordinal(w: Column) -> Column:
    """Number words and digits with an ordinal ending; hyphenated forms by their last part."""
    words = "first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth|eleventh|twelfth|thirteenth|twentieth|thirtieth|hundredth|thousandth"
    return F.lower(w).rlike(rf"^([0-9]+(st|nd|rd|th)|([a-z]+-)?({words}))$")


def find(text: Column, pattern: str) -> Column:
    return text.rlike(pattern)


def looking_at(text: Column, pattern: str) -> Column:
    return text.rlike(f"^(?:{pattern})")


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(f"^(?:{pattern})$")


def regex_groups(text: Column, pattern: str, n: int) -> Column:
    """Array of the n groups of a full match, or null."""
    return F.when(matches(text, pattern), F.array(*(F.regexp_extract(text, f"^(?:{pattern})$", k) for k in range(1, n + 1))))


def contains_ignore_case(items: Column, value: Column) -> Column:
    return F.exists(items, lambda x: F.lower(x) == F.lower(value))


# --- strings --------------------------------------------------------------------------------------------------------------


def pad(s: Column, n: int, fill: str = " ") -> Column:
    """Fills on the right to n characters; never cuts."""
    return F.when(F.length(s) < n, F.rpad(s, n, fill)).otherwise(s)


def pad_left(s: Column, n: int, fill: str = " ") -> Column:
    return F.when(F.length(s) < n, F.lpad(s, n, fill)).otherwise(s)


def pad_or_trim(s: Column, n: int) -> Column:
    return F.rpad(s, n, " ")


def trim_to(s: Column, n: int) -> Column:
    return F.left(s, F.lit(n))


def capitalise(s: Column) -> Column:
    return F.concat(F.upper(F.left(s, F.lit(1))), F.substring(s, 2, 1 << 30))


def capitalise_pieces(s: Column) -> Column:
    """All small, then a capital after the start, white space, a full stop or an apostrophe."""
    out = F.lower(s)
    for mark in (" ", ".", "'"):
        out = F.array_join(F.transform(F.split(out, "\\" + mark if mark == "." else mark), capitalise), mark)
    return out


def nth_index(s: Column, char: str, n: int) -> Column:
    """0-based place of the n-th `char`, or -1."""
    return F.when(F.size(F.split(s, f"\\Q{char}\\E")) > n, F.length(F.substring_index(s, char, n))).otherwise(F.lit(-1))


def truncate_number(x: Column, digits: int) -> Column:
    return F.regexp_replace(x.cast("string"), rf"(\.[0-9]{{{digits}}})[0-9]*$", "$1")


def escape_chars(s: Column, chars: str) -> Column:
    return F.regexp_replace(s, "([" + "".join("\\" + c for c in chars) + "])", r"\\$1")


def file_name(s: Column) -> Column:
    return F.regexp_replace(s, r"[^A-Za-z0-9._-]", "_")


def split_quoted(s: Column, sep: str = ",", quote: str = '"') -> Column:
    """Split at `sep` outside quotes; quotes are taken off."""
    parts = F.regexp_extract_all(F.concat(s, F.lit(sep)), F.lit(rf'((?:{quote}[^{quote}]*{quote}|[^{quote}{sep}])*){sep}'), F.lit(1))
    return F.transform(parts, lambda p: F.replace(p, F.lit(quote), F.lit("")))


def value_split(s: Column, value: str, separator: str) -> Column:
    """Values between separators; anything else between them is an error and gives null."""
    ok = s.rlike(f"^(?:{value})(?:(?:{separator})(?:{value}))*$")
    return F.when(ok, F.regexp_extract_all(s, F.lit(value), F.lit(0)))


def to_ascii(s: Column) -> Column:
    #: Letters with marks and their plain letters.
    a = "āáàâäãåčçćēéèêëģīíìîïķļņñōóòôöõšśūúùûüžźżĀÁÀÂÄÃÅČÇĒÉÈÊËĢĪÍÌÎÏĶĻŅÑŌÓÒÔÖÕŠŪÚÙÛÜŽ"
    b = "aaaaaaaccceeeeegiiiiiklnnoooooossuuuuuzzzAAAAAAACCEEEEEGIIIIIKLNNOOOOOOSUUUUUZ"
    return F.translate(F.replace(s, F.lit("ß"), F.lit("ss")), a, b)


def strip_markup(s: Column) -> Column:
    return F.regexp_replace(s, r"<[^>]*>", "")


def strip_non_alnum(s: Column) -> Column:
    return F.regexp_replace(s, r"[^\p{L}\p{N}]", "")


def wordnet_pos(tag: Column) -> Column:
    return F.when(tag.rlike("^NN"), "noun").when(tag.rlike("^(VB|MD)"), "verb").when(tag.rlike("^(JJ|CD)"), "adjective").when(tag.rlike("^(RB|RP|WRB)"), "adverb")


#: Spellings by word.
AMERICAN = dict(
    p.split(":")
    for p in """
anaesthetic:anesthetic analogue:analog analogues:analogs analyse:analyze analysed:analyzed analysing:analyzing armoured:armored cancelled:canceled cancelling:canceling candour:candor capitalise:capitalize capitalised:capitalized capitalisation:capitalization centre:center chimaeric:chimeric clamour:clamor coloured:colored colouring:coloring colourful:colorful defence:defense Defence:Defense discolour:discolor discolours:discolors discoloured:discolored discolouring:discoloring encyclopaedia:encyclopedia endeavour:endeavor endeavours:endeavors endeavoured:endeavored endeavouring:endeavoring fervour:fervor favour:favor favours:favors favoured:favored favouring:favoring favourite:favorite favourites:favorites fibre:fiber fibres:fibers finalise:finalize finalised:finalized finalising:finalizing flavour:flavor flavours:flavors flavoured:flavored flavouring:flavoring glamour:glamor grey:gray harbour:harbor harbours:harbors homologue:homolog homologues:homologs honour:honor honours:honors honoured:honored honouring:honoring honourable:honorable humour:humor humours:humors humoured:humored humouring:humoring kerb:curb labelled:labeled labelling:labeling labour:labor Labour:Labor labours:labors laboured:labored labouring:laboring leant:leaned learnt:learned localise:localize localised:localized manoeuvre:maneuver manoeuvres:maneuvers maximise:maximize maximised:maximized maximising:maximizing meagre:meager minimise:minimize minimised:minimized minimising:minimizing modernise:modernize modernised:modernized modernising:modernizing misdemeanour:misdemeanor misdemeanours:misdemeanors neighbour:neighbor neighbours:neighbors neighbourhood:neighborhood neighbourhoods:neighborhoods oestrogen:estrogen oestrogens:estrogens organisation:organization organisations:organizations penalise:penalize penalised:penalized popularise:popularize popularised:popularized popularises:popularizes popularising:popularizing practise:practice practised:practiced pressurise:pressurize pressurised:pressurized pressurises:pressurizes pressurising:pressurizing realise:realize realised:realized realising:realizing realises:realizes recognise:recognize recognised:recognized recognising:recognizing recognises:recognizes rumoured:rumored rumouring:rumoring savour:savor savours:savors savoured:savored savouring:savoring splendour:splendor splendours:splendors theatre:theater theatres:theaters titre:titer titres:titers travelled:traveled travelling:traveling
""".split()
)
#: Patterns tried in order, what they become, and what keeps a word as it is.
AMERICAN_PATTERNS = [
    ("haem(at)?o", "hem$1o", None),
    ("aemia$", "emia", None),
    ("([lL]euk)aem", "$1em", None),
    ("programme(s?)$", "program$1", None),
    ("^([a-z]{3,})our(s?)$", "$1or$2", "abatjour|beflour|bonjour|calambour|carrefour|cornflour|contour|de[tv]our|dortour|dyvour|downpour|giaour|glamour|holour|inpour|outpour|pandour|paramour|pompadour|recontour|repour|ryeflour|sompnour|tambour|troubadour|tregetour|velour"),
]
#: Days and months that are written with a capital.
TIMES = "january february april june july august september october november december monday tuesday wednesday thursday friday saturday sunday".split()


def americanise(w: Column, capital_times: bool = False) -> Column:
    """American spelling by word, else by the first pattern that is in the word; with `capital_times` days and months get capitals."""
    table = dict(AMERICAN) | ({t: t.capitalize() for t in TIMES} if capital_times else {})
    known = F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), w)
    out = F.when(known.isNotNull(), known)
    for pattern, to, keep in AMERICAN_PATTERNS:
        fits = w.rlike(pattern) & (~w.rlike(keep) if keep else F.lit(True))
        out = out.when(fits, F.regexp_replace(w, pattern, to))
    return out.otherwise(w)


def split_hyphen_pair(s: Column, category: Column) -> Column:
    """`a-b` of two Latin words becomes `a - b`, unless a person's name."""
    pair = s.rlike(r"^\p{IsLatin}+-\p{IsLatin}+$") & (category != "person")
    return F.when(pair, F.replace(s, F.lit("-"), F.lit(" - "))).otherwise(s)


#: Names of Greek letters that n-grams know.
GREEK_IN_NGRAMS = "alpha beta gamma delta epsilon zeta kappa lambda rho sigma tau upsilon omega".split()


def greekified(w: Column) -> Column:
    """Names of Greek letters as `~`."""
    return F.regexp_replace(w, "|".join(GREEK_IN_NGRAMS), "~")


def char_ngrams(w: Column, low: int = 2, high: int = 6, middle: bool = True, lower: bool = True, dehyphen: bool = False, greek: bool = False) -> Column:
    """Distinct `#sub#` of `<word>`; without `middle` only those at an end; with `greek` names of Greek letters are one character."""
    w = F.lower(w) if lower else w
    s = F.concat(F.lit("<"), greekified(w) if greek else w, F.lit(">"))
    if dehyphen:
        s = F.replace(s, F.lit("-"), F.lit(""))
    out = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.length(s)),
            lambda i: F.transform(
                F.filter(F.sequence(F.lit(low), F.lit(high)), lambda n: (i + n - 1 <= F.length(s)) & (F.lit(middle) | (i == 1) | (i + n - 1 == F.length(s)))),
                lambda n: F.concat(F.lit("#"), F.substring(s, i, n), F.lit("#")),
            ),
        )
    )
    return F.array_distinct(out)


def ngrams(items: Column, low: int, high: int) -> Column:
    """All contiguous sub-lists of length low..high, by start and then length."""
    return F.flatten(F.transform(F.sequence(F.lit(1), F.size(items)), lambda i: F.transform(F.filter(F.sequence(F.lit(low), F.lit(high)), lambda n: i + n - 1 <= F.size(items)), lambda n: F.slice(items, i, n))))


def edges_padded(items: Column, k: int, fill: str = "") -> Column:
    """First k and last k items, filled up when the list is short."""
    filler = F.array_repeat(F.lit(fill), k)
    return F.concat(F.slice(F.concat(items, filler), 1, k), F.slice(F.concat(filler, items), -k, k))


def feature_map(feats: Column) -> Column:
    """`k=v|k=v` to a map; `_` and empty give an empty map."""
    return F.when((feats == "_") | (feats == ""), F.expr("map()").cast("map<string,string>")).otherwise(F.map_filter(F.str_to_map(feats, F.lit(r"\|"), F.lit("=")), lambda k, v: v.isNotNull()))


def keep_attributes(attrs: Column, *names: str) -> Column:
    return F.map_filter(attrs, lambda k, v: k.isin(*names))


def drop_attributes(attrs: Column, *names: str) -> Column:
    return F.map_filter(attrs, lambda k, v: ~k.isin(*names))


def string_to_map(s: Column, names: dict[str, int], sep: str = "\t") -> Column:
    """Fields by ordinal, as a map of their names."""
    parts = F.split(s, sep)
    return F.map_filter(F.create_map(*(x for k, i in names.items() for x in (F.lit(k), F.get(parts, F.lit(i))))), lambda k, v: v.isNotNull())


def gap_encode(sorted_ints: Column) -> Column:
    return F.transform(sorted_ints, lambda x, i: F.when(i == 0, x).otherwise(x - F.get(sorted_ints, i - 1)))


def gap_decode(gaps: Column) -> Column:
    """Running sums of the gaps, in one pass over each array."""
    @F.pandas_udf("array<long>")
    def sums(xs: pd.Series) -> pd.Series:
        return xs.map(lambda x: None if x is None else np.cumsum(x, dtype=np.int64))

    return sums(gaps)


#: Characters whose places are one integer's bits.
_BITS = 4096


def common_subsequence(x: str, y: str) -> int:
    """Columns of the edit table as bits, y in blocks: the bits carried out of a block are kept for each character of x."""
    carry, total = bytearray(len(x)), 0
    for k in range(0, len(y), _BITS):
        block = y[k : k + _BITS]
        width, places = len(block), {}
        for i, c in enumerate(block):
            places[c] = places.get(c, 0) | 1 << i
        full = free = (1 << width) - 1
        for j, c in enumerate(x):
            at = places.get(c, 0)
            match = free & at
            if match or carry[j]:
                new = free + match + carry[j]
                carry[j] = new >> width
                free = (new | (free ^ match)) & full
        total += width - free.bit_count()
    return total


def common_substring(x: str, y: str) -> int:
    """Windows of 1, 2, 4, ... characters are numbered by their halves' numbers; any length is two of these that overlap."""
    n, m = len(x), len(y)
    names = [np.frombuffer((x + y).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)]

    def common(length: int) -> bool:
        if length > min(n, m):
            return False
        k = length.bit_length() - 1
        while len(names) <= k:
            half = 1 << len(names) - 1
            r = names[-1]
            names.append(np.unique((r[:-half] << 32) | r[half:], return_inverse=True)[1])
        r, rest = names[k], length - (1 << k)
        pairs = (r[: len(r) - rest] << 32) | r[rest:]
        return len(np.intersect1d(pairs[: n - length + 1], pairs[n : n + m - length + 1])) > 0

    high = 1
    while common(high):
        high *= 2
    low = high // 2
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if common(middle) else (low, middle)
    return low


def _of_pairs(one):
    @F.pandas_udf("int")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else one(x, y) for x, y in zip(a, b, strict=True)])

    return run


def common_subsequence_udf():
    """Length of the longest common subsequence of two strings."""
    return _of_pairs(common_subsequence)


def common_substring_udf():
    """Length of the longest common contiguous substring of two strings."""
    return _of_pairs(common_substring)


def acronym_of(phrase: Column) -> Column:
    """Initials of the phrase's words, capitals only."""
    return F.array_join(F.transform(F.split(phrase, r"\s+"), lambda w: F.upper(F.left(w, F.lit(1)))), "")


def naive_acronym(acronym: Column, phrase: Column) -> Column:
    """1 if the acronym's letters are found in order among the first letters of the phrase's words, else 0; a letter may serve several times in a row."""
    letters = F.regexp_replace(F.regexp_replace(acronym, r"[^\p{L}]", ""), r"(.)\1+", "$1")
    firsts = F.array_join(F.transform(F.filter(F.split(phrase, r"\s+"), lambda w: w.rlike(r"^\p{L}")), lambda w: F.left(w, F.lit(1))), "")
    pattern = F.concat(F.lit(".*"), F.array_join(F.filter(F.split(letters, ""), lambda c: c != ""), ".*"))
    return F.when(F.call_function("rlike", firsts, pattern), 1.0).otherwise(0.0)


def _hearst(name: str, acronym: str) -> float:
    name, acronym = name.lower(), acronym.lower()
    at = len(name) - 1
    for k in range(len(acronym) - 1, -1, -1):
        if not acronym[k].isalpha():
            continue
        while at >= 0 and (name[at] != acronym[k] or k == 0 and at > 0 and name[at - 1].isalnum()):
            at -= 1
        if at < 0:
            return 0.0
        at -= 1
    return 1.0


def hearst_acronym_udf():
    """(phrase, acronym): 1 if the acronym's letters are found from the end of the phrase back, its first letter at a word's start; else 0."""
    @F.pandas_udf("double")
    def run(phrase: pd.Series, acronym: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or a is None else _hearst(p, a) for p, a in zip(phrase, acronym, strict=True)], dtype="float64")

    return run


def acronym_similarity(acronym: Column, phrase: Column) -> Column:
    """1 if the initials spell it; else the share of its letters found in order among the phrase's letters."""
    target = F.upper(F.regexp_replace(acronym, r"[^\p{L}]", ""))
    letters = F.filter(F.split(target, ""), lambda c: c != "")
    rest = F.upper(phrase)
    left = F.aggregate(letters, F.struct(rest.alias("s"), F.lit(0).alias("n")), lambda acc, c: F.when(F.instr(acc["s"], c) > 0, F.struct(F.substring(acc["s"], F.instr(acc["s"], c) + 1, F.lit(1 << 20)).alias("s"), (acc["n"] + 1).alias("n"))).otherwise(acc))
    return F.when(target == acronym_of(phrase), F.lit(1.0)).otherwise(left["n"] / F.greatest(F.size(letters), F.lit(1)) * 0.9)


#: Irregular forms and their lemmas.
IRREGULAR = dict(
    p.split(":")
    for p in """
is:be are:be was:be were:be been:be being:be am:be has:have had:have having:have does:do did:do done:do goes:go went:go gone:go said:say made:make took:take taken:take came:come saw:see seen:see got:get gotten:get gave:give given:give knew:know known:know thought:think told:tell found:find became:become left:leave felt:feel brought:bring began:begin begun:begin kept:keep held:hold wrote:write written:write stood:stand heard:hear meant:mean met:meet ran:run paid:pay sat:sit spoke:speak spoken:speak led:lead grew:grow grown:grow lost:lose fell:fall fallen:fall sent:send built:build understood:understand drew:draw drawn:draw broke:break broken:break spent:spend rose:rise risen:rise drove:drive driven:drive bought:buy wore:wear worn:wear chose:choose chosen:choose ate:eat eaten:eat
men:man women:woman children:child people:person feet:foot teeth:tooth mice:mouse geese:goose lives:life wives:wife knives:knife leaves:leaf halves:half shelves:shelf wolves:wolf selves:self better:good best:good worse:bad worst:bad
""".split()
)


def english_stem(w: Column, tag: Column) -> Column:
    """Lemma of an English form by its tag: irregular forms by list, then endings, with doubled letters and a lost e put right."""
    s = F.lower(w)
    known = F.element_at(F.create_map(*(F.lit(x) for kv in IRREGULAR.items() for x in kv)), s)

    def shorter(x: Column, ending: str) -> Column:
        """Without ed or ing: running, run; making, make; agreed, agree; walked, walk."""
        base = F.regexp_replace(x, f"{ending}$", "")
        return (
            F.when(base.endswith("e") & F.lit(ending == "ed"), F.concat(base, F.lit("e")))
            .when(base.rlike(r"([bdfgmnprt])\1$"), F.regexp_replace(base, r"(.)$", ""))
            .when(base.rlike(r"(at|iz|[^aeiou]l|[aeiou]v|[^aeiouw]u|[aeiourln]c|[rdn]g|[aeiourn]s|ee)$") | base.rlike(r"^[^aeiou]*[aeiou][^aeiouwxy]$"), F.concat(base, F.lit("e")))
            .otherwise(base)
        )

    plural = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"([^aeiou])ies$", "$1y"), r"(s|x|z|ch|sh)es$", "$1"), r"([^su])s$", "$1")
    third = F.regexp_replace(plural, r"([^aeiou]o)e$", "$1")
    past = F.when(s.rlike("[^aeiou]ied$"), F.regexp_replace(s, "ied$", "y")).when(s.rlike("[aeiouy].*ed$"), shorter(s, "ed")).otherwise(s)
    going = F.when(s.rlike("[aeiouy].*ing$"), shorter(s, "ing")).otherwise(s)
    regular = F.when(tag.isin("NNS", "NNPS"), plural).when(tag == "VBZ", third).when(tag.isin("VBD", "VBN"), past).when(tag == "VBG", going).otherwise(s)
    return F.when(tag == "NNP", w).when(tag.rlike("^(VB|NNS|JJ|RB)") & known.isNotNull(), known).otherwise(regular)


# --- syllables ------------------------------------------------------------------------------------------------------------------


def hyphenation_patterns(lines: list[str]) -> dict[str, list[int]]:
    """TeX patterns (`.ach4`, `1b2l`) as letters and the weights between them."""
    out = {}
    for line in lines:
        letters, weights = "", [0]
        for c in line.strip():
            if c.isdigit():
                weights[-1] = int(c)
            else:
                letters += c
                weights.append(0)
        out[letters] = weights
    return out


def hyphenate(word: str, patterns: dict[str, list[int]], exceptions: dict[str, list[int]] | None = None, left: int = 2, right: int = 3) -> list[int]:
    """Places where a word may be broken, as numbers of letters before the break: odd weights among all patterns found in the word."""
    low = word.lower()
    if exceptions and low in exceptions:
        return exceptions[low]
    marked = f".{low}."
    weight = [0] * (len(marked) + 1)
    for i in range(len(marked)):
        for j in range(i + 1, len(marked) + 1):
            for k, v in enumerate(patterns.get(marked[i:j], ())):
                weight[i + k] = max(weight[i + k], v)
    return [k for k in range(left, len(low) - right + 1) if weight[k + 1] % 2]


def hyphenate_udf(patterns: list[str], exceptions: list[str] = (), left: int = 2, right: int = 3):
    """Words with soft breaks (`-`) by TeX patterns, which are a parameter; exceptions are words with their breaks."""
    ready = hyphenation_patterns(list(patterns))
    special = {e.replace("-", ""): [len(e[:i].replace("-", "")) for i, c in enumerate(e) if c == "-"] for e in exceptions}

    def broken(w):
        cuts = [0, *hyphenate(w, ready, special, left, right), len(w)]
        return "-".join(w[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))

    @F.pandas_udf("string")
    def run(words: pd.Series) -> pd.Series:
        return words.map(lambda w: None if w is None else broken(w))

    return run


# --- records --------------------------------------------------------------------------------------------------------------------


def to_columns(s: Column, names: list[str], separator: str = "\t") -> Column:
    """A delimited line as a struct of strings; fields that are missing are null."""
    parts = F.split(s, f"\\Q{separator}\\E", -1)
    return F.struct(*(F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)))


def from_columns(row: Column, names: list[str], separator: str = "\t") -> Column:
    """Fields of a struct as one delimited line; null fields are empty."""
    return F.concat_ws(separator, *(F.coalesce(row[n].cast("string"), F.lit("")) for n in names))
