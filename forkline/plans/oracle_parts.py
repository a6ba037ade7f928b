"""Shared pieces of the checking SQL: tokens, divergence and prefixes of the pairs.

Written for the grammar of the pair fixture only (one table, alias T1 or x), by another
route than the library: word counts instead of character offsets.
"""

from __future__ import annotations

from forkline.plans.fixtures import SQL_PAIRS, plain

# The token pattern that right results call for, for an engine whose \w is
# ASCII only; a name goes on with any letter, mark, digit, connector or $.  Quotes are
# doubled, as the pattern stands inside a SQL literal.
TOKEN = (
    r"--[^\n]*\n?|/\*(?s:.*?)\*/|''[^'']*(?:''''[^'']*)*''|"
    r'"[^"]*(?:""[^"]*)*"|'
    r"\b\d+(?:\.\d+)?\b|"
    r"[A-Za-z_][\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}$]*(?:\.[A-Za-z_][\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}$]*)*|"
    r"<=|>=|<>|!=|==|[(),;.*=<>+\-/]"
)

SPACES = r"[\t\n\v\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def tokens(text: str) -> str:
    return (
        f"list_filter(regexp_extract_all({text}, '{TOKEN}'), "
        "lambda t: NOT starts_with(t, '--') AND NOT starts_with(t, '/*'))"
    )


def canon(token: str) -> str:
    return (
        f"CASE WHEN ({token} LIKE '''%''') OR ({token} LIKE '\"%\"') THEN {token} ELSE lower({token}) END"
    )


def normal(text: str) -> str:
    qualified = rf"regexp_replace({text}, '\b(T1|x)\.', 'orders.', 'gi')"
    bare = rf"regexp_replace({qualified}, '(from\s+orders)\s+(as\s+)?(T1|x)\b', '\1', 'gi')"
    return rf"trim(regexp_replace({bare}, '\s+', ' ', 'g'))"


def first_difference(a: str, b: str) -> str:
    """0-based index of the first differing element of two token lists, -1 if none."""
    differs = (
        f"list_transform(range(greatest(len({a}), len({b}))), "
        f"lambda i: ({canon(f'{a}[i+1]')}) IS DISTINCT FROM ({canon(f'{b}[i+1]')}))"
    )
    return f"coalesce(list_position({differs}, true), 0) - 1"


PAIRS = f"sql_pairs AS ({plain(SQL_PAIRS)})"

DIVERGED = f"""
{PAIRS},
norm AS (SELECT *, {normal('predict')} AS np, {normal('label')} AS ng FROM sql_pairs),
toks AS (SELECT *, {tokens('np')} AS pt, {tokens('ng')} AS gt FROM norm),
idx AS (SELECT *, {first_difference('pt', 'gt')} AS i,
          string_split_regex(trim(predict), '\\s+') AS w FROM toks),
div AS (SELECT *, i >= 0 AND i < len(pt) AS diverged,
          CASE WHEN i < 0 THEN 'identical' WHEN i < least(len(pt), len(gt)) THEN 'token_mismatch'
               ELSE 'length_mismatch' END AS reason,
          CASE WHEN i < 4 THEN i WHEN kind = 1 THEN i + 1 ELSE i + 2 END AS k FROM idx),
d AS (SELECT *,
        CASE WHEN diverged THEN array_to_string(w[1:k], ' ') ELSE trim(predict) END AS prefix,
        CASE WHEN diverged THEN array_to_string(w[k+1:], ' ') ELSE '' END AS suffix,
        CASE WHEN diverged THEN pt[i+1] END AS ptok, CASE WHEN diverged THEN gt[i+1] END AS gtok
      FROM div)
"""


def with_d(select: str) -> str:
    return f"WITH {DIVERGED}\n{select}"


def with_pairs(select: str) -> str:
    return f"WITH {PAIRS}\n{select}"
