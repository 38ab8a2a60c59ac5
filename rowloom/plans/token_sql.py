"""DuckDB SQL that cuts and names the tokens of the documents, to compare the token operators with."""

from __future__ import annotations

from rowloom.operators import keywords as K
from rowloom.plans.lexer import SYMBOLS

#: The token classes as DuckDB's matcher takes them: it has no look-ahead, so a lock takes what follows and is cut after.
_TOKEN = (
    r"""[ \t\n\r]+|//[^\n]*\n?|/\*(?s:.*?)\*/|/\*(?s:.*)|"(?:[^"~]|~(?s:.))*"|''(?:[^''~]|~(?s:.))*''|["''](?s:.*)|[0-9]+(?:\.[0-9]+)?"""
    r"""|(?i:no|share|exclusive)[ \t]+(?i:lock)[A-Za-z0-9_-]*|[A-Za-z_][A-Za-z0-9_-]*|\{&[^}]*\}?|&[A-Za-z0-9-]*|\+=|-=|\*=|/=|>=|<=|<>|::|(?s:.)"""
)
_LOCK = r"regexp_full_match(t, '(?i)(no|share|exclusive)[ \t]+lock')"
_CUT = rf"flatten([CASE WHEN regexp_matches(t, '^[A-Za-z]+[ \t]') AND NOT {_LOCK} THEN regexp_extract_all(t, '[ \t]+|[^ \t]+') ELSE [t] END FOR t IN p])"


def _rows(pairs) -> str:
    return ", ".join("({}, {})".format(*("'" + x.replace("'", "''") + "'" for x in pair)) for pair in pairs)


#: Common table expressions up to tok: id, idx, kind, t, start_, end_, line, col of every token; t is null for the Eof.
TOKENS = rf"""WITH known(word, known) AS (VALUES {_rows(K.builtin_spellings().items())}), symbol(sign, name) AS (VALUES {_rows(SYMBOLS.items())}),
d AS (SELECT row_number() OVER () AS r, doc_id AS id, coalesce(text, '') AS text FROM documents),
a AS (SELECT r, id, regexp_extract_all(text, '{_TOKEN}') AS p FROM d),
b AS (SELECT r, id, unnest({_CUT}) AS t, generate_subscripts({_CUT}, 1) AS k FROM a),
c AS (SELECT *, coalesce(sum(strlen(t)) OVER w, 0) AS start_, coalesce(sum(length(t) - length(replace(t, chr(10), ''))) OVER w, 0) + 1 AS line FROM b
  WINDOW w AS (PARTITION BY r ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT *, coalesce(max(CASE WHEN contains(t, chr(10)) THEN start_ + strlen(t) - strlen(string_split(t, chr(10))[-1]) END) OVER w, 0) AS line_at FROM c
  WINDOW w AS (PARTITION BY r ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT r, id, k, t, start_, start_ + strlen(t) AS end_, line, start_ - line_at + 1 AS col FROM e WHERE NOT regexp_full_match(t, '[ \t\n\r]+')
  UNION ALL SELECT r, id, 1000000000000, NULL, strlen(text), strlen(text), length(text) - length(replace(text, chr(10), '')) + 1, strlen(string_split(text, chr(10))[-1]) + 1 FROM d),
tok AS (SELECT id, CAST(row_number() OVER (PARTITION BY r ORDER BY k) - 1 AS INT) AS idx, t, CAST(start_ AS INT) AS start_, CAST(end_ AS INT) AS end_, CAST(line AS INT) AS line, CAST(col AS INT) AS col,
  CASE WHEN t IS NULL THEN 'Eof' WHEN starts_with(t, '//') THEN 'Comment' WHEN starts_with(t, '/*') THEN CASE WHEN ends_with(t, '*/') AND length(t) > 3 THEN 'Comment' ELSE 'Invalid' END
    WHEN t[1] IN ('"', '''') THEN CASE WHEN regexp_full_match(t, '(?s)"([^"~]|~.)*"|''([^''~]|~.)*''') THEN 'StringLiteral' ELSE 'Invalid' END
    WHEN regexp_matches(t, '^[0-9]') THEN CASE WHEN contains(t, '.') THEN 'DecimalLiteral' WHEN TRY_CAST(t AS HUGEINT) BETWEEN 2147483648 AND 9223372036854775807 THEN 'BigIntLiteral' ELSE 'IntegerLiteral' END
    WHEN {_LOCK} THEN CASE lower(t[1]) WHEN 'n' THEN 'NoLock' WHEN 's' THEN 'ShareLock' ELSE 'ExclusiveLock' END
    WHEN regexp_matches(t, '^[A-Za-z_]') THEN coalesce(known, 'Identifier') WHEN starts_with(t, '{{&') THEN coalesce(known, 'Preprop') WHEN starts_with(t, '&') THEN coalesce(known, 'Invalid') ELSE coalesce(name, 'Invalid') END AS kind
  FROM f LEFT JOIN known ON lower(t) = word LEFT JOIN symbol ON t = sign)
"""
