"""SQL text as plain text: aliases, tokens, first divergence and raw offsets.

Everything here is a column expression.  Patterns carry ``(?U)`` so that word
characters, boundaries and white space follow Unicode, and possessive quantifiers
where the next character decides the match anyway: those loops run without
recursion, however long a literal is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from forkline.functions.text import collapse_spaces, let, text_or_empty

# Words that are never taken for a table alias (upper case).
SQL_KEYWORDS = (
    "WHERE", "ON", "USING", "GROUP", "ORDER", "HAVING", "LIMIT", "OFFSET", "FETCH",
    "UNION", "INTERSECT", "EXCEPT",
    "INNER", "LEFT", "RIGHT", "FULL", "CROSS", "OUTER", "NATURAL",
    "JOIN", "FROM", "AS",
    "AND", "OR", "NOT", "IN", "IS", "NULL", "LIKE", "BETWEEN",
    "SELECT", "DISTINCT",
)

# Words after AS that name a type, as in CAST(x AS INT).
TYPE_KEYWORDS = (
    "INT", "INTEGER", "BIGINT", "SMALLINT", "TINYINT",
    "NUMERIC", "DECIMAL", "FLOAT", "REAL", "DOUBLE",
    "CHAR", "NCHAR", "VARCHAR", "NVARCHAR", "TEXT", "STRING",
    "DATE", "TIME", "TIMESTAMP", "DATETIME",
    "BOOLEAN", "BOOL",
)

# Fixed patterns: table references, and what one token looks like. A Unicode class or boundary
# asks for property after property, so that plain letters are told apart first: a word character
# by its range, a boundary by the letter or digit that must stand behind it.
_WORD = r"[A-Za-z0-9_$[\x{80}-\x{10ffff}&&\w]]"
_REF_AHEAD = r"(?-iU:(?=[FfJj]))"
PLAIN_REF = rf"(?iU){_REF_AHEAD}\b(FROM|JOIN)\s+([a-zA-Z_][a-zA-Z0-9_]*)\s+(?:AS\s+)?([a-zA-Z_][a-zA-Z0-9_]*)\b"
IDENT = rf"[A-Za-z_]{_WORD}*"
DOTTED = rf"[A-Za-z_]{_WORD}*+(?:\.[A-Za-z_]{_WORD}*+)*+"
TABLE_REF = rf"(?iU){_REF_AHEAD}\b(FROM|JOIN)\s+({DOTTED})\s+(?:AS\s+)?({IDENT})\b"

# A replaced part that must keep its place in the raw text is fenced by two Unicode
# noncharacters, which never occur in interchanged text.
OPEN, CLOSE = "\ufdd0", "\ufdd1"
FENCED = f"{OPEN}[^{CLOSE}]*+{CLOSE}"


def _quoted(q: str) -> str:
    # A doubled quote is an escape.  Without a closing quote the literal ends at the
    # first quote of its last doubled pair, hence the second form.
    body = f"[^{q}]*+"
    return f"{q}{body}(?:{q}{q}{body})*+{q}|{q}{body}(?:{q}{q}{body}(?={q}{q}))*+{q}"


def _token_pattern(identifier: str) -> str:
    return "|".join(
        [
            r"--[^\n]*+\n?",
            r"/\*.*?\*/",
            _quoted("'"),
            _quoted('"'),
            r"(?=[0-9[\x{80}-\x{10ffff}&&\d]])\b\d+(?:\.\d+)?\b",
            identifier,
            "<=|>=|<>|!=|==",
            r"[(),;.*=<>+\-/]",
        ]
    )


TOKEN = "(?Us)" + _token_pattern(DOTTED)
# An identifier may go on behind a fenced part, as it does once that part is gone.
_FENCED_WORD = rf"(?:{_WORD}++|(?:{FENCED})++{_WORD})*+"
_FENCED_IDENT = rf"[A-Za-z_]{_FENCED_WORD}(?:(?:{FENCED})*+\.[A-Za-z_]{_FENCED_WORD})*+"
COVER = f"(?Us){FENCED}|({_token_pattern(_FENCED_IDENT)})|."


def _not_longer() -> str:
    return r"(?![\w$]*\w)"


def _any_of(values: tuple[str, ...]) -> str:
    return "(?:" + "|".join(values) + ")" + _not_longer()


# Group 1 is a reference that stays whole because its "alias" is a keyword; group 2 is
# the part to keep of any other reference and group 3 the alias part to drop.
_ALIAS_DEFINITION = (
    rf"(?iU){_REF_AHEAD}(?:(\b(?:FROM|JOIN)\s+{DOTTED}\s+(?:AS\s+(?=[A-Za-z_])|(?!AS\s+[A-Za-z_])){_any_of(SQL_KEYWORDS)})"
    rf"|(\b(?:FROM|JOIN)\s+{DOTTED})(\s+(?:AS\s+)?{IDENT}\b))"
)
# Group 1 is "AS type", kept; group 2 a column alias, dropped.
_COLUMN_ALIAS = rf"(?iU)(\s+AS\s+{_any_of(TYPE_KEYWORDS)})|(\s+AS\s+{IDENT}\b)"
_AS = r"(?iU)\sAS\s"
_SELECT_LIST = r"(?isU)\A(.*?(?-iU:(?=[Ss\u017f]))\bSELECT\b)(.*?)((?-iU:(?=[Ff]))\bFROM\b.*)\z"


def _refs(sql: Column, pattern: str, skip_keywords: bool) -> Column:
    """(table, alias) pairs in order of appearance; matches never overlap."""
    tables = F.regexp_extract_all(sql, F.lit(pattern), F.lit(2))
    aliases = F.regexp_extract_all(sql, F.lit(pattern), F.lit(3))
    pairs = F.zip_with(
        tables, aliases, lambda t, a: F.struct(t.alias("table"), a.alias("alias"))
    )
    if not skip_keywords:
        return pairs
    return F.filter(pairs, lambda p: ~F.upper(p["alias"]).isin(*SQL_KEYWORDS))


def extract_aliases(sql: Column, skip_keywords: bool = True) -> Column:
    """Map of table name to alias; the first alias of a table wins.

    Without ``skip_keywords``, ``FROM t WHERE`` gives the alias ``WHERE``.
    """

    def to_map(pairs: Column) -> Column:
        names = F.array_distinct(F.transform(pairs, lambda p: p["table"]))
        return F.map_from_arrays(
            names,
            F.transform(
                names,
                lambda n: F.element_at(F.filter(pairs, lambda p: p["table"] == n), 1)["alias"],
            ),
        )

    return let(_refs(text_or_empty(sql), PLAIN_REF, skip_keywords), to_map)


def _qualify(sql: Column) -> Column:
    """``alias.`` becomes ``table.``, one alias after another.

    An alias keeps the place of its first appearance and the table of its last.
    """

    def fold(pairs: Column) -> Column:
        names = F.array_distinct(F.transform(pairs, lambda p: p["alias"]))

        def replace(text: Column, name: Column) -> Column:
            table = F.element_at(F.filter(pairs, lambda p: p["alias"] == name), -1)["table"]
            # Only "$" is special in a replacement here: names hold no backslash.
            target = F.concat(F.replace(table, F.lit("$"), F.lit(r"\$")), F.lit("."))
            return F.regexp_replace(text, F.concat(F.lit(r"(?iU)\b\Q"), name, F.lit(r"\E\.")), target)

        return F.aggregate(names, sql, replace)

    return let(_refs(sql, TABLE_REF, True), fold)


def _without_select_aliases(sql: Column, replacement: str) -> Column:
    """Apply ``replacement`` to the column aliases between the first SELECT and its FROM."""
    def whole(part: Column) -> Column:
        bare = F.concat(
            F.regexp_extract(sql, _SELECT_LIST, 1),
            F.regexp_replace(part, _COLUMN_ALIAS, replacement),
            F.regexp_extract(sql, _SELECT_LIST, 3),
        )
        return F.when(F.rlike(part, F.lit(_AS)), bare).otherwise(sql)

    # Most texts have no AS at all or none in that part, and are taken apart no further.
    return F.when(F.rlike(sql, F.lit(_AS)), let(F.regexp_extract(sql, _SELECT_LIST, 2), whole)).otherwise(sql)


def remove_aliases(sql: Column) -> Column:
    """Qualify columns by table, drop table and column aliases, collapse white space."""

    def drop(text: Column) -> Column:
        bare = F.regexp_replace(text, _ALIAS_DEFINITION, "$1$2")
        return collapse_spaces(let(bare, lambda t: _without_select_aliases(t, "$1")))

    return drop(_qualify(text_or_empty(sql)))


def restore_aliases(sql: Column, aliases: Column) -> Column:
    """``table.col`` becomes ``alias.col``, longest table name first."""
    by_length = F.array_sort(
        F.map_entries(aliases), lambda a, b: F.length(b["key"]) - F.length(a["key"])
    )

    def replace(text: Column, entry: Column) -> Column:
        pattern = F.concat(F.lit(r"(?iU)\b\Q"), entry["key"], F.lit(r"\E\.(\w+)"))
        return F.regexp_replace(text, pattern, F.concat(entry["value"], F.lit(".$1")))

    return F.aggregate(by_length, sql, replace)


def _is_comment(token: Column) -> Column:
    return F.startswith(token, F.lit("--")) | F.startswith(token, F.lit("/*"))


def tokens(sql: Column) -> Column:
    """Tokens in order; comments and characters outside the grammar vanish."""
    found = F.regexp_extract_all(sql, F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: ~_is_comment(t))


def canon(token: Column) -> Column:
    """Quoted text as it is, everything else in lower case."""
    quoted = (F.startswith(token, F.lit("'")) & F.endswith(token, F.lit("'"))) | (
        F.startswith(token, F.lit('"')) & F.endswith(token, F.lit('"'))
    )
    return F.when(quoted, token).otherwise(F.lower(token))


def first_divergence(pred: Column, gold: Column) -> Column:
    """0-based index of the first differing token, -1 when there is none.

    ``zip_with`` fills the shorter list with nulls, so a difference in length is found
    the same way.
    """
    differs = F.zip_with(pred, gold, lambda p, g: ~canon(p).eqNullSafe(canon(g)))
    return (F.array_position(differs, True) - 1).cast("int")


def divergence_reason(index: Column, pred: Column, gold: Column) -> Column:
    return (
        F.when(index < 0, F.lit("identical"))
        .when(index < F.least(F.size(pred), F.size(gold)), F.lit("token_mismatch"))
        .otherwise(F.lit("length_mismatch"))
    )


def covering_pieces(sql: Column) -> Column:
    """(piece, token) pairs; the pieces join back to the input, a gap has token ''."""

    def pairs(text: Column) -> Column:
        pieces = F.regexp_extract_all(text, F.lit(COVER), F.lit(0))
        found = F.regexp_extract_all(text, F.lit(COVER), F.lit(1))
        return F.zip_with(pieces, found, lambda p, t: F.struct(p.alias("piece"), t.alias("token")))

    return let(sql, pairs)


def token_offset(sql: Column, index: Column) -> Column:
    """Character offset of token ``index``: a running sum of piece lengths.

    Fences add no length, and what stands between them is no token.
    """

    def step(state: Column, p: Column) -> Column:
        is_token = (p["token"] != "") & ~_is_comment(p["token"])
        width = F.length(F.translate(p["piece"], OPEN + CLOSE, ""))
        here = F.when((state["at"] < 0) & is_token & (state["seen"] == index), state["pos"])
        return F.struct(
            (state["pos"] + width).alias("pos"),
            (state["seen"] + is_token.cast("int")).alias("seen"),
            F.coalesce(here, state["at"]).alias("at"),
        )

    start = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("seen"), F.lit(-1).alias("at"))
    return F.aggregate(covering_pieces(sql), start, step, lambda s: s["at"])


def fence_dropped(sql: Column) -> Column:
    """Raw text with the parts that :func:`remove_aliases` drops put between fences.

    Qualifying columns changes no token count, so token ``i`` that lies outside the
    fences is token ``i`` of the normalised text, and its raw offset is known exactly.
    Only a text that defines an alias with a dot behind it, ``FROM t a.b``, which is no
    SQL, may be off by a token.
    """
    fenced = F.regexp_replace(sql, _ALIAS_DEFINITION, f"$1$2{OPEN}$3{CLOSE}")
    return let(fenced, lambda t: _without_select_aliases(t, f"$1{OPEN}$2{CLOSE}"))


def raw_token_offset(sql: Column, index: Column) -> Column:
    """Offset in the raw text of token ``index`` of the normalised text."""
    return token_offset(fence_dropped(sql), index)
