"""Fragments shared by the SQL counterparts (DuckDB dialect)."""

from __future__ import annotations

from ..functions.text import DELIMITERS, ENGLISH_RULES, KEYWORD_DROP, WHITESPACE
from ..sources.tables import CODE_SOURCES


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {quoted(WHITESPACE)})"


def clean_keyword(x: str) -> str:
    return f"regexp_replace(lower({strip(x)}), {quoted(KEYWORD_DROP)}, '', 'g')"


def clean_english(x: str) -> str:
    for pattern, replacement in ENGLISH_RULES:
        x = f"regexp_replace({x}, {quoted(pattern)}, {quoted(replacement.replace(chr(92), chr(92) * 2))}, 'g')"
    return strip(x)


def tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({clean_keyword(x)}, {quoted(DELIMITERS)}), lambda t: length(t) > 0)"


def digest(seed: int | str, *keys: str) -> str:
    parts = "".join(f" || ':' || CAST({k} AS VARCHAR)" for k in keys)
    return f"md5('{seed}'{parts})"


def hash_int(d: str) -> str:
    return f"CAST(CAST('0x' || substr({d}, 1, 15) AS UBIGINT) AS BIGINT)"


def unit(d: str) -> str:
    return f"(CAST(CAST('0x' || substr({d}, 1, 8) AS UBIGINT) AS DOUBLE) / CAST(4294967296 AS DOUBLE))"


def digits(x: str) -> str:
    """A list of ids as text."""
    return f"array_to_string(list_transform({x}, lambda v: CAST(v AS VARCHAR)), ' ')"


CODE = ", ".join(quoted(s) for s in CODE_SOURCES)
CORPUS = f"CAST(CASE WHEN source IN ({CODE}) THEN 0 ELSE 1 END AS INTEGER)"

LINES = f"""
lines AS (
  SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, lang, source, n_lines, line, {CORPUS} AS corpus
  FROM (SELECT doc_id, lang, source, CAST(len(a) AS INTEGER) AS n_lines,
               unnest(a) AS line, generate_subscripts(a, 1) AS line_no
        FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS a FROM documents))
)"""

LTOK = LINES + f""",
ltok AS (SELECT doc_id, line_no, lang, source, n_lines, corpus, {tokens('line')} AS w FROM lines)"""

TOK = LTOK + """,
tok AS (
  SELECT doc_id, line_no, corpus, word, CAST(i - 1 AS INTEGER) AS pos
  FROM (SELECT doc_id, line_no, corpus, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM ltok WHERE len(w) > 0)
)"""

# Word statistics of the whole corpus.
STATS = TOK + """,
tf AS (
  SELECT doc_id, line_no, word, count(*) AS n_w, sum(count(*)) OVER (PARTITION BY doc_id, line_no) AS n_d
  FROM tok GROUP BY doc_id, line_no, word
),
stats AS (
  SELECT word, count(*) AS i_d, CAST(sum(n_w) AS BIGINT) AS total, min(n_w / CAST(n_d AS DOUBLE)) AS min_tf,
         (SELECT count(DISTINCT (doc_id, line_no)) FROM tok) AS c_d
  FROM tf GROUP BY word
),
idf AS (SELECT *, ln(c_d / CAST(i_d AS DOUBLE)) AS idf FROM stats)"""

STOPS = STATS + """,
stops AS (SELECT word FROM idf WHERE min_tf * idf < CAST(0.1 AS DOUBLE) OR total < 10)"""

EXTRACT = STOPS + """,
extracted AS (
  SELECT l.doc_id, l.line_no, l.corpus, coalesce(k.keywords, '') AS keywords, coalesce(k.cnt, 0) AS cnt
  FROM lines l LEFT JOIN (
    SELECT doc_id, line_no, string_agg(word, ',' ORDER BY pos) AS keywords, count(*) AS cnt
    FROM tok WHERE word NOT IN (SELECT word FROM stops) GROUP BY doc_id, line_no
  ) k USING (doc_id, line_no)
)"""

COUNTS = TOK + """,
counts AS (
  SELECT word AS token, count(*) AS cnt,
         min(doc_id * 1000000000000 + CAST(line_no AS BIGINT) * 1000000 + pos) AS first
  FROM tok GROUP BY word
)"""


def vocab(size: int, first_id: int = 4, source: str = "counts", name: str = "vocab") -> str:
    return f"""
{name} AS (
  SELECT token, cnt, CAST(rn + {first_id - 1} AS INTEGER) AS id
  FROM (SELECT token, cnt, row_number() OVER (ORDER BY cnt DESC, first) AS rn FROM {source}) WHERE rn <= {size}
)"""


# Ids of the 3000 most common words, and the coded lines.
VOCAB = COUNTS + "," + vocab(3000)
CODED = VOCAB + """,
coded AS (
  SELECT l.doc_id, l.line_no, l.n_lines, coalesce(c.ids, CAST([] AS INTEGER[])) AS ids
  FROM ltok l LEFT JOIN (
    SELECT doc_id, line_no, list(coalesce(v.id, 1) ORDER BY pos) AS ids
    FROM tok LEFT JOIN vocab v ON v.token = tok.word GROUP BY doc_id, line_no
  ) c USING (doc_id, line_no)
)"""


# Coded lines in batches of 64, padded with 0 to the longest of the batch.
PADDED = CODED + """,
batched AS (SELECT *, (row_number() OVER (ORDER BY doc_id, line_no) - 1) // 64 AS batch FROM coded),
padded AS (
  SELECT doc_id, line_no, batch, list_resize(ids, max(len(ids)) OVER (PARTITION BY batch), 0) AS ids FROM batched
)"""


def pair_codes(size: int = 6000) -> str:
    """User and assistant turns, each coded with its own vocabulary."""
    out = """
pairs AS (
  SELECT u.conv_id, u.turn, u.text AS src, a.text AS dst
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'
)"""
    for side in ("src", "dst"):
        out += f""",
{side}_tok AS (
  SELECT conv_id, turn, t AS token, i - 1 AS pos
  FROM (SELECT conv_id, turn, unnest(w) AS t, generate_subscripts(w, 1) AS i
        FROM (SELECT conv_id, turn, string_split(lower(replace({side}, chr(10), '')), ' ') AS w FROM pairs))
),
{side}_counts AS (
  SELECT token, count(*) AS cnt, min(conv_id * 1000000000 + turn * 1000000 + pos) AS first
  FROM {side}_tok GROUP BY token
),{vocab(size, 4, f'{side}_counts', f'{side}_vocab')},
{side}_codes AS (
  SELECT conv_id, turn, list(coalesce(v.id, 1) ORDER BY pos) AS {side}_ids
  FROM {side}_tok t LEFT JOIN {side}_vocab v USING (token) GROUP BY conv_id, turn
)"""
    return out


LABELLED = """
labelled AS (
  SELECT d.doc_id, d.lang, d.text, CAST(l.quality AS INTEGER) AS label
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id
)"""


def hash_order(table: str, seed: int, *keys: str) -> str:
    """Rank and size of a table in hash order."""
    d = digest(seed, *keys)
    return (
        f"(SELECT *, row_number() OVER (ORDER BY {d}, {', '.join(keys)}) - 1 AS r, "
        f"count(*) OVER () AS n FROM {table})"
    )
