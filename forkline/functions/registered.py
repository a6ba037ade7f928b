"""The text functions under names of their own in ``spark.sql``.

``register`` defines temporary SQL functions with the patterns of :mod:`forkline.functions.sqltext`.
Their bodies are plain SQL, so the optimizer sees through them and nothing leaves the JVM.  They
take columns and literals, but cannot be called inside of a lambda, where Spark allows no
SQL-defined function.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from forkline.functions import sqltext
from forkline.functions.prompts import REASONING_END
from forkline.functions.text import STRIP_CHARS, WS


def _literal(text: str) -> str:
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def _pairs(pattern: str) -> str:
    """References of ``sql`` as (table, alias), without aliases that are keywords."""
    found = [f"regexp_extract_all(sql, {_literal(pattern)}, {n})" for n in (2, 3)]
    keywords = ", ".join(map(_literal, sqltext.SQL_KEYWORDS))
    return (
        f"filter(zip_with({found[0]}, {found[1]}, (t, a) -> named_struct('name', t, 'alias', a)), "
        f"p -> upper(p.alias) NOT IN ({keywords}))"
    )


def _once(value: str, name: str, body: str) -> str:
    """``body`` over a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def definitions() -> dict[str, tuple[str, str, str]]:
    """Name to parameters, type and body, in the order in which they can be defined."""
    parts = [f"regexp_extract(sql, {_literal(sqltext._SELECT_LIST)}, {n})" for n in (1, 2, 3)]
    bare_list = f"regexp_replace({parts[1]}, {_literal(sqltext._COLUMN_ALIAS)}, '$1')"
    first_alias = "element_at(filter(refs, r -> r.name = n), 1).alias"
    last_table = "element_at(filter(refs, r -> r.alias = a), -1).name"
    target = f"concat(replace({last_table}, '$', {_literal(chr(92) + '$')}), '.')"
    alias_dot = f"concat({_literal('(?iU)' + chr(92) + 'b' + chr(92) + 'Q')}, a, {_literal(chr(92) + 'E' + chr(92) + '.')})"
    qualified = f"aggregate(array_distinct(transform(refs, r -> r.alias)), sql, (text, a) -> regexp_replace(text, {alias_dot}, {target}))"
    quoted = " OR ".join(f"(startswith({{0}}, {q}) AND endswith({{0}}, {q}))" for q in map(_literal, "'\""))
    canon = f"CASE WHEN {quoted} THEN {{0}} ELSE lower({{0}}) END"
    differs = f"zip_with(predicted, expected, (p, g) -> NOT (({canon.format('p')}) <=> ({canon.format('g')})))"
    reason = (
        "CASE WHEN i < 0 THEN 'identical' WHEN i < least(size(predicted), size(expected)) "
        "THEN 'token_mismatch' ELSE 'length_mismatch' END"
    )
    return {
        "sql_answer": (
            "text STRING",
            "STRING",
            f"CASE WHEN contains(coalesce(text, ''), {_literal(REASONING_END)}) THEN btrim(substr(text, "
            f"instr(text, {_literal(REASONING_END)}) + {len(REASONING_END)}), {_literal(STRIP_CHARS)}) ELSE coalesce(text, '') END",
        ),
        "sql_aliases": (
            "sql STRING",
            "MAP<STRING, STRING>",
            _once(
                _pairs(sqltext.PLAIN_REF).replace("(sql,", "(coalesce(sql, ''),"),
                "refs",
                _once("array_distinct(transform(refs, r -> r.name))", "names", f"map_from_arrays(names, transform(names, n -> {first_alias}))"),
            ),
        ),
        "sql_qualified": ("sql STRING", "STRING", _once(_pairs(sqltext.TABLE_REF), "refs", qualified)),
        "sql_without_list_aliases": (
            "sql STRING",
            "STRING",
            f"CASE WHEN sql RLIKE {_literal('(?iU)' + chr(92) + 'sAS' + chr(92) + 's')} AND sql RLIKE {_literal(sqltext._SELECT_LIST)} "
            f"THEN concat({parts[0]}, {bare_list}, {parts[2]}) ELSE sql END",
        ),
        "sql_normalized": (
            "sql STRING",
            "STRING",
            "trim(regexp_replace(sql_without_list_aliases(regexp_replace(sql_qualified(coalesce(sql, '')), "
            f"{_literal(sqltext._ALIAS_DEFINITION)}, '$1$2')), {_literal(f'(?U){WS}+')}, ' '))",
        ),
        "sql_token_list": (
            "sql STRING",
            "ARRAY<STRING>",
            f"filter(regexp_extract_all(sql, {_literal(sqltext.TOKEN)}, 0), t -> NOT startswith(t, '--') AND NOT startswith(t, '/*'))",
        ),
        "sql_divergence": (
            "predicted ARRAY<STRING>, expected ARRAY<STRING>",
            "STRUCT<index: INT, reason: STRING, predicted: STRING, expected: STRING>",
            _once(
                f"CAST(array_position({differs}, true) - 1 AS INT)",
                "i",
                f"named_struct('index', i, 'reason', {reason}, 'predicted', CASE WHEN i >= 0 THEN get(predicted, i) END, "
                "'expected', CASE WHEN i >= 0 THEN get(expected, i) END)",
            ),
        ),
    }


def register(spark: SparkSession) -> list[str]:
    """Define the functions in this session; their names.

    ``sql_answer`` drops reasoning, ``sql_aliases`` gives the alias map, ``sql_normalized`` the text
    without aliases, ``sql_token_list`` its tokens, and ``sql_divergence`` where two token lists part.
    """
    made = definitions()
    for name, (parameters, returns, body) in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")
    return list(made)
