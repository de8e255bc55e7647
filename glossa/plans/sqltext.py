"""Common table expressions that the queries' SQL shares."""

TOKEN = r"[\p{L}]+|[0-9]+(?:[.,][0-9]+)*|[^\s\p{L}0-9]"
#: tok(doc_id, lang, source, pos, tok)
TOK = rf"""tok AS (SELECT doc_id, lang, source, (generate_subscripts(ts, 1) - 1)::INTEGER AS pos, unnest(ts) AS tok
  FROM (SELECT doc_id, lang, source, regexp_extract_all(text, '{TOKEN}') AS ts FROM documents))"""
#: sen(doc_id, sent_id, sentence) and stok(doc_id, sent_id, pos, tok)
SEN = r"""sen AS (SELECT doc_id, (generate_subscripts(ss, 1) - 1)::INTEGER AS sent_id, unnest(ss) AS sentence FROM (
    SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?]+[)\]"'']*)(\s+|$)', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_matches(s, '\S')) AS ss FROM documents))"""
STOK = rf"""{SEN}, stok AS (SELECT doc_id, sent_id, (generate_subscripts(ts, 1) - 1)::INTEGER AS pos, unnest(ts) AS tok
  FROM (SELECT doc_id, sent_id, regexp_extract_all(sentence, '{TOKEN}') AS ts FROM sen))"""
#: Two labellings of the same tokens: capitalised words are NAME; the guess wants four letters and takes numbers as NUM.
LAB = rf"""{TOK}, lab AS (SELECT doc_id, pos, tok,
    CASE WHEN regexp_matches(tok, '^\p{{Lu}}') THEN 'NAME' WHEN regexp_matches(tok, '^[0-9]') THEN 'NUM' ELSE 'O' END AS gold,
    CASE WHEN regexp_matches(tok, '^\p{{Lu}}') AND length(tok) >= 4 THEN 'NAME' WHEN regexp_matches(tok, '^[0-9]') AND length(tok) < 4 THEN 'NUM' ELSE 'O' END AS guess FROM tok)"""


def spans(column: str, name: str) -> str:
    """Label runs of lab.column as name(doc_id, type, begin_pos, end_pos, n_tok, text)."""
    return f"""{name}_r AS (SELECT *, sum(CASE WHEN {column} <> 'O' AND {column} IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run
    FROM (SELECT doc_id, pos, tok, {column}, lag({column}) OVER (PARTITION BY doc_id ORDER BY pos) AS p FROM lab)),
  {name} AS (SELECT doc_id, min({column}) AS type, min(pos) AS begin_pos, max(pos) + 1 AS end_pos, count(*) AS n_tok, string_agg(tok, ' ' ORDER BY pos) AS text
    FROM {name}_r WHERE {column} <> 'O' GROUP BY doc_id, run)"""


def dan2(w: str) -> str:
    """The dan2 shape of a word in SQL, without the mark of known words: classes, each run once."""
    cased = rf"regexp_replace(regexp_replace(regexp_replace({w}, '\p{{Lu}}', 'X', 'g'), '[\p{{Ll}}_]', 'x', 'g'), '[0-9]', 'd', 'g')"
    runs = f"regexp_replace(list_reduce(string_split({cased}, ''), lambda a, c: CASE WHEN right(a, 1) = c THEN a ELSE a || c END), '^~', '')"
    return f"('WT-' || {runs} || CASE WHEN length({w}) <= 3 THEN ':' || length({w}) ELSE '' END)"
