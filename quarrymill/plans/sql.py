"""Fragments of the DuckDB SQL that the queries are compared with."""

import html
from html.entities import html5

from quarrymill.functions.text import TOKEN

TOK = TOKEN.replace("'", "''")


def toks(text: str) -> str:
    return f"regexp_extract_all(coalesce({text}, ''), '{TOK}')"


def lower_toks(text: str) -> str:
    return f"list_transform({toks(text)}, lambda t: lower(t))"


def fnv(token: str) -> str:
    return f"list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(list_filter(string_split({token}, ''), lambda c: c <> ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"


def postings(name: str, table: str, id_col: str, text: str, dim: int, dense: bool) -> str:
    """CTEs ending in {name}(id, idx, w)."""
    tf = f"{name}_tf AS (SELECT id, token, count(*) AS tf FROM (SELECT {id_col} AS id, unnest({lower_toks(text)}) AS token FROM {table}) GROUP BY 1, 2), {name}_h AS (SELECT token, {fnv('token')} % {dim} AS idx FROM (SELECT DISTINCT token FROM {name}_tf))"
    if not dense:
        return f"{tf}, {name} AS (SELECT id, idx, CAST(sum(tf) AS BIGINT) AS w FROM {name}_tf JOIN {name}_h USING (token) GROUP BY 1, 2)"
    return f"{tf}, {name}_v AS (SELECT id, idx, sum(1 + ln(tf)) AS v FROM {name}_tf JOIN {name}_h USING (token) GROUP BY 1, 2), {name} AS (SELECT id, idx, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS w FROM {name}_v)"


def topk(name: str, source: str, k: int) -> str:
    """A CTE {name}: the first k of source(query_id, id, score)."""
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM {source}) WHERE rank <= {k})"


def _map(of: dict) -> str:
    quoted = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return f"MAP([{', '.join(map(quoted, of))}], [{', '.join(map(quoted, of.values()))}])"


# Numbers that HTML doesn't take as they are: from 128 on those of Windows, and what is no character.
_NUMBERS = {n: html.unescape(f"&#{n};") for n in [*range(160), *range(0xFDD0, 0xFDF0), *(p << 16 | x for p in range(17) for x in (0xFFFE, 0xFFFF))] if html.unescape(f"&#{n};") != chr(n)}


def html_text(text: str) -> str:
    """The text of a part of a page: without tags, and between them the character references of HTML 5, with or without a semicolon, by number or by the longest name."""
    tag, reference = """<[a-zA-Z](?:[^>"'']|"[^"]*"|''[^'']*'')*>|<[/!?][^>]*>""", r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
    pieces = f"regexp_extract_all({text}, '(?s){tag}|{reference}|[^&<]+|&|<')"
    digits = "ltrim(rtrim(regexp_replace(p, '^&#[xX]?', ''), ';'), '0')"
    number = f"CASE WHEN length({digits}) > 7 THEN 1114112 WHEN {digits} = '' THEN 0 WHEN p LIKE '&#x%' OR p LIKE '&#X%' THEN CAST('0x' || {digits} AS INTEGER) ELSE CAST({digits} AS INTEGER) END"
    by_number = f"list_transform([{number}], lambda n: coalesce(numbers[n], CASE WHEN n BETWEEN 55296 AND 57343 OR n > 1114111 THEN chr(65533) ELSE chr(n) END))[1]"
    by_name = f"coalesce(names[p[2:]], {', '.join(f'names[p[2:{k + 1}]] || p[{k + 2}:]' for k in range(max(len(x) for x in html5 if x[-1] != ';'), 1, -1))}, p)"
    said = f"CASE WHEN regexp_full_match(p, '(?s){tag}') THEN '' WHEN p LIKE '&#%' THEN {by_number} WHEN p LIKE '&_%' THEN {by_name} ELSE p END"
    return f"array_to_string(list_transform({pieces}, lambda p: {said}), '')"


# A table of one row, in whose columns html_text looks references up.
REFERENCES = f"SELECT {_map(html5)} AS names, {_map(_NUMBERS)} AS numbers"
