"""Clauses of flat SELECT texts as tables, and the first clause in which a pair differs.

Only one flat SELECT is taken apart: no nested query, no set operator.  Any other text
has a null signature.  Equal texts are equivalent whatever they hold; of other pairs with
a null signature it is unknown, so ``is_equivalent`` is null and the stage ``parse_error``.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forkline.functions.sqltext import _WORD, IDENT, SQL_KEYWORDS, _is_comment, _quoted
from forkline.functions.text import collapse_spaces, let, list_difference, sorted_distinct
from forkline.schemas import SIGNATURE_TYPE

# Fixed order of comparison.
STAGES = ("tables", "joins", "filters", "group_by", "having", "select", "order_by", "limit")

# Every token but the comments, in a text whose only white space are single spaces.
_NAME = rf"[A-Za-z_]{_WORD}*+"
_DIGIT = r"[0-9[\x{80}-\x{10ffff}&&\d]]"
_TOKENS = [
    rf"{_NAME}(?:\.{_NAME})*+(?:\.\*)?",
    rf"{_DIGIT}+(?:\.{_DIGIT}+)?(?:[eE][+-]?{_DIGIT}+)?\b",
    _quoted("'"),
    _quoted('"'),
    "`[^`]*+`",
    r"[<>!=]=|<>|\|\|",
    "[^ ]",
]
_TOKEN = "(?Us)" + "|".join([r"--[^\n]*+\n?", r"/\*.*?\*/", *_TOKENS])
_WORDS = SQL_KEYWORDS + ("BY", "CASE", "WHEN", "THEN", "ELSE", "END", "ASC", "DESC", "EXISTS")
_SECTIONS = ("SELECT", "FROM", "WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "OFFSET", "JOIN")
# Marks of the structure of a text are white space that no text holds once its spaces are collapsed;
# a text of plain letters stays one of single bytes.  They stand before a token, before one that no
# space parts from the last and before one further down, and for the parts at nesting depth 0.
_TOK, _GLUE, _DEEP, _SEC, _HEAD, _ITEM, _AND, _OR, _ON = "\x1f\x1e\x1d\x1c\t\n\v\f\r"
# Behind a table's id, where no token further down is left to be told apart.
_OWN = _DEEP
_MARK = r"[\t-\r\x1c-\x1f]"
_NEXT = f"(?={_MARK})"


def _one_of(words: tuple[str, ...], flags: str = "") -> str:
    """A pattern for the words by their first letters, so that most texts fail at once."""
    heads: dict[str, list[str]] = {}
    for word in words:
        heads.setdefault(word[0], []).append(word[1:])
    first = "[{0}{1}]" if flags else "{0}"
    opened = f"(?{flags}:" if flags else "(?:"
    return "(?:" + "|".join(first.format(h, h.lower()) + opened + "|".join(r) + ")" for h, r in heads.items()) + ")"


def _first_of(words: tuple[str, ...]) -> str:
    """A look at the first letter, which turns most tokens away before any word is tried."""
    return f"(?=[{''.join(sorted({word[0] for word in words}))}])"


def _harmless(depth: int) -> str:
    """Brackets around tokens that neither open a clause nor part one, with like ones inside."""
    parting = ("AND", "OR", "ON", "USING", "BETWEEN", "CASE", "END", "UNION", "INTERSECT", "EXCEPT", *_SECTIONS)
    token = rf"{_TOK}(?!(?:[(),]|{_first_of(parting)}{_one_of(parting)}){_TOK})[^{_TOK}]*+"
    inside = f"{token}|{_harmless(depth - 1)}" if depth else token
    return rf"{_TOK}\((?:{inside})*+{_TOK}\)(?={_TOK})"


def _clause_text(sql: Column) -> Column:
    """Tokens in one spelling, each behind a mark, and a last mark.

    Clause words and function names are in upper case.  A text takes a few passes as a whole;
    only one that may hold comments is taken apart to drop them.
    """

    def spelled(text: Column) -> Column:
        # Names that are not in upper case, each with the bracket behind it.
        found = F.regexp_extract_all(text, F.lit(rf"(?U){_TOK}(?![A-Z]++{_TOK})({_NAME}(?:{_TOK}\()?+)(?={_TOK})"), F.lit(1))

        def is_word(name: Column) -> Column:
            # No letter that becomes two makes a word.
            return F.upper(name).isin(*_WORDS) & (F.length(F.upper(name)) == F.length(name))

        def to_raise(w: Column) -> Column:
            name = F.substring_index(w, _TOK, 1)
            return (name != F.upper(name)) & (F.contains(w, F.lit(_TOK)) | is_word(name))

        names = F.transform(F.filter(F.array_distinct(found), to_raise), lambda w: F.substring_index(w, _TOK, 1))
        changed = F.array_distinct(names)

        def raised(t: Column, word: Column) -> Column:
            old, new = F.concat(F.lit(_TOK), word, F.lit(_TOK)), F.concat(F.lit(_TOK), F.upper(word), F.lit(_TOK))
            # A match takes the mark of the next token along, so of neighbours every other one is left.
            everywhere = F.replace(F.replace(t, old, new), old, new)
            calls = F.replace(t, F.concat(old, F.lit("(")), F.concat(new, F.lit("(")))
            return F.when(is_word(word), everywhere).otherwise(calls)

        return F.aggregate(changed, text, raised)

    commented = F.contains(sql, F.lit("--")) | F.contains(sql, F.lit("/*"))
    found = F.filter(F.regexp_extract_all(sql, F.lit(_TOKEN), F.lit(0)), lambda t: ~_is_comment(t))
    taken = F.array_join(F.transform(found, lambda t: F.concat(F.lit(_TOK), t)), "")
    marked = F.regexp_replace(sql, "(?Us) ?(" + "|".join(_TOKENS) + ")", f"{_TOK}$1")
    text = F.concat(F.when(commented, taken).otherwise(marked), F.lit(_TOK))
    passes = (
        lambda t: _put(t, _TOK + "!=", _TOK + "<>"),
        lambda t: _put(t, _TOK + "==", _TOK + "="),
        spelled,
    )
    return _chain(text, passes)


def _where(text: Column, part: str, body: Column) -> Column:
    """``body`` for texts that hold the part, the others as they are."""
    return F.when(F.contains(text, F.lit(part)), body).otherwise(text)


def _put(text: Column, old: str, new: str) -> Column:
    """One fixed part in place of another; looking for it costs less than replacing it."""
    return _where(text, old, F.replace(text, F.lit(old), F.lit(new)))


def _chain(value: Column, passes: Iterable[Callable[[Column], Column]]) -> Column:
    return functools.reduce(let, passes, value)


def _at_top(text: Column) -> Column:
    """Tokens inside of parentheses and CASE behind another mark; null if brackets are open.

    The text is cut before each bracket, and a fold over these few pieces keeps the depth.
    """

    def step(s: Column, piece: Column) -> Column:
        head = F.substring(piece, 2, 1)
        # Every piece but the first, a SELECT, starts with one of four tokens: ( ) CASE END.
        change = F.when(head.isin("(", "C"), 1).when(head.isin(")", "E"), -1).otherwise(0)
        return let(
            s["depth"] + change,
            lambda depth: F.struct(
                F.concat(
                    s["out"], F.when(depth == 0, piece).otherwise(F.replace(piece, F.lit(_TOK), F.lit(_DEEP)))
                ).alias("out"),
                depth.alias("depth"),
            ),
        )

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("depth"))
    cut = F.regexp_replace(text, rf"{_TOK}(?=(?:\(|\)|CASE|END){_TOK})", _SEC + _TOK)
    return F.aggregate(F.split(cut, _SEC), start, step, lambda s: F.when(s["depth"] == 0, s["out"]))


def _structured(text: Column) -> Column:
    """The text with marks for sections, items and conjuncts.

    The first AND behind a BETWEEN is no conjunction.  DISTINCT and BY go with their clause word.
    """
    between = rf"(?s)({_TOK}BETWEEN{_NEXT}.*?){_TOK}AND{_NEXT}"
    taken_along = rf"(?:(?:(?<=SELECT){_TOK}DISTINCT|(?<=GROUP|ORDER){_TOK}BY){_NEXT})?+"
    joined = rf"(?={_TOK}[NLRFICO])(?:{_TOK}NATURAL)?(?:{_TOK}(?:LEFT|RIGHT|FULL))?(?:{_TOK}(INNER|CROSS|OUTER))?{_SEC}JOIN"
    name = r"[A-Z_][A-Za-z0-9_$]*+"
    call = rf"([{_TOK}{_GLUE}](?={name}{_TOK}\()(?!{_one_of(_WORDS)}{_TOK}){name}){_TOK}"

    def words(word: str, mark: str) -> Callable[[Column], Column]:
        return lambda t: _where(t, _TOK + word, F.regexp_replace(t, f"{_TOK}{word}{_NEXT}", mark))

    def called(t: Column) -> Column:
        return _where(t, _TOK + "(", F.regexp_replace(t, call, f"$1{_GLUE}"))

    passes = (
        lambda t: _where(t, f"{_TOK}BETWEEN", F.regexp_replace(t, between, f"$1{_DEEP}AND")),
        lambda t: F.regexp_replace(t, rf"{_TOK}{_first_of(_SECTIONS)}({_one_of(_SECTIONS)}){taken_along}{_NEXT}", f"{_SEC}$1{_HEAD}"),
        words("AND", _AND),
        words("OR", _OR),
        words("ON", f"{_ON}ON"),
        words("USING", f"{_ON}USING"),
        lambda t: _where(t, f"{_SEC}JOIN", F.regexp_replace(t, joined, f"{_SEC}JOIN$1")),
        lambda t: _put(t, f"{_TOK},", _ITEM),
        lambda t: _put(t, _DEEP, _TOK),
        lambda t: F.rtrim(t, F.lit(_TOK)),
        called,
        # No token but a bracket ends in one or starts with one.
        lambda t: _put(t, "(" + _TOK, "(" + _GLUE),
        lambda t: _put(t, _TOK + ")", _GLUE + ")"),
        lambda t: _put(t, _TOK + ",", _GLUE + ","),
    )
    return _chain(text, passes)


def _flat(text: Column) -> Column:
    """One SELECT at the start and no set operator, tokens inside of brackets behind another mark.

    Null for any other text.  Brackets that hide nothing are left as they are.
    """
    start = F.startswith(text, F.lit(f"{_TOK}SELECT{_TOK}"))
    other = ("SELECT", "UNION", "INTERSECT", "EXCEPT")
    hiding = (*other, "CASE", "END")

    def later(words: tuple[str, ...], brackets: str = "") -> str:
        first = "".join(sorted({w[0] for w in words}))
        return rf"(?!\A){_TOK}(?=[{brackets}{first}])(?:{'|'.join(words)}{'|[()]' if brackets else ''}){_TOK}"

    plain = ~F.rlike(F.regexp_replace(text, _harmless(2), ""), F.lit(later(hiding, "()")))
    return F.when(start, F.when(plain, text).when(~F.rlike(text, F.lit(later(other))), _at_top(text)))


def _whole(text: Column) -> Column:
    """A part of a text; marks that do not split it are put back as words."""
    for mark, word in ((_ITEM, f"{_GLUE},"), (_AND, f"{_TOK}AND"), (_OR, f"{_TOK}OR")):
        text = F.replace(text, F.lit(mark), F.lit(word))
    return text


def _render(text: Column) -> Column:
    """One spacing: a space before each token, unless it is glued to the one before."""
    for mark, written in ((_GLUE, ""), (_ON, " "), (_TOK, " "), (_OWN, "")):
        text = F.replace(text, F.lit(mark), F.lit(written))
    return F.trim(text)


def _qualified(text: Column, names: Column) -> Column:
    """Columns by their last owner, a known one by its table id.

    A mark inside of the id keeps the next name from being found in it.
    """
    part = r"[^.\t-\r\x1c-\x1f]*+"
    cut = F.regexp_replace(text, rf"([{_TOK}{_GLUE}])(?=[A-Za-z_])(?:{part}\.)+(?={part}\.{part}(?:{_MARK}|\z))", "$1")
    short = F.when(F.rlike(text, F.lit(rf"\.{part}\.")), cut).otherwise(text)

    def by_id(text: Column, name: Column) -> Column:
        def put(text: Column, mark: str) -> Column:
            tid = F.concat(F.lit(f"{mark}T{_OWN}"), F.array_position(names, name).cast("string"), F.lit("."))
            old = F.concat(F.lit(mark), name, F.lit("."))
            return F.when(F.contains(text, old), F.replace(text, old, tid)).otherwise(text)

        both = let(put(text, _TOK), lambda t: put(t, _GLUE))
        return F.when(F.rlike(name, F.lit(r"\A[A-Za-z_]")), both).otherwise(text)

    return F.aggregate(names, short, by_id)


def _refs(text: Column) -> Column:
    """Table references in order, with the kind and condition that joined them."""

    def ref(text: Column, kind: Column, condition: Column) -> Column:
        first = F.nullif(F.substring_index(text, _TOK, 1), F.lit(""))
        name = F.substring_index(first, ".", -1)
        known = F.when(F.contains(text, F.lit(_TOK)), F.substring_index(text, _TOK, -1)).otherwise(name)
        return F.struct(
            name.alias("name"), known.alias("known"), kind.alias("kind"), condition.alias("cond")
        )

    def of_section(section: Column) -> Column:
        head = F.substring_index(section, _HEAD, 1)
        kind = F.when(head == "FROM", F.lit("FROM")).otherwise(F.substring(head, 5, 9))
        kind = F.when(kind == "", F.lit("INNER")).otherwise(kind)
        items = F.split(F.substring_index(section, _HEAD, -1), _ITEM)

        def of_item(item: Column, n: Column) -> Column:
            condition = F.when(
                F.contains(item, F.lit(_ON + "ON")), _whole(F.substring_index(item, _ON + "ON", -1))
            ).otherwise("")
            # A comma joins like an inner join without a condition.
            joined = F.when(n == 0, kind).otherwise(F.lit("INNER"))
            table = F.replace(_whole(F.substring_index(item, _ON, 1)), F.lit(_GLUE), F.lit(_TOK))
            return let(F.btrim(table, F.lit(_TOK)), lambda t: ref(t, joined, condition))

        return F.transform(items, of_item)

    tables = F.regexp_extract_all(text, F.lit(rf"{_SEC}((?:FROM|JOIN[A-Z]*){_HEAD}[^{_SEC}]*+)"), F.lit(1))
    return F.flatten(F.transform(tables, of_section))


# Clauses that are taken from a text by their words, in the order of their fields behind SELECT's.
_FIELDS = ("WHERE", "GROUP", "HAVING", "ORDER", "LIMIT")


def _aliased(fields: Column) -> Column:
    """An alias of a selected expression, in the first field, behind AS in every case."""
    # Not behind a word of a clause, but for END; behind AS there is nothing to do.
    before = rf"(?!{_one_of(tuple(w for w in _WORDS if w != 'END'))}{_TOK})(?:[\w\"'`][^\t-\r\x1c\x1e\x1f]*+|\))"
    alias = rf"(?!{_one_of(_WORDS)}(?:{_ITEM}|\z))(?:(?U:{IDENT}+)|\"[^\"\t-\r\x1c-\x1f]*+\")"

    def of(selected: Column) -> Column:
        return F.regexp_replace(
            selected, rf"([{_TOK}{_GLUE}]{before}){_TOK}({alias})(?={_ITEM}|\z)", f"$1{_TOK}AS{_TOK}$2"
        )

    return let(
        F.substring_index(fields, _SEC, 1),
        lambda selected: F.concat(of(selected), F.substring(fields, F.length(selected) + 1, F.lit(2**31 - 1))),
    )


def _fields(text: Column) -> Column:
    """Rendered bodies of SELECT and of the first clause of each other word, empty when absent.

    What parts them into items and conjuncts stays marked.
    """
    body = f"[^{_SEC}]*+"
    # Most texts hold their clauses in one order, others are searched for each.
    ordered = "".join(f"(?:{_SEC}{w}{_HEAD}({body}))?+" for w in _FIELDS)
    whole = rf"\A{_SEC}SELECT{_HEAD}({body})(?:{_SEC}(?:FROM|JOIN[A-Z]*+){_HEAD}{body})*+{ordered}(?:{_SEC}OFFSET{_HEAD}{body})?+\z"
    found = "".join(rf"(?=(?:(?:{body}{_SEC}(?!{w}{_HEAD}))*+{body}{_SEC}{w}{_HEAD}({body}))?+)" for w in _FIELDS)
    any_order = rf"(?s)\A{found}{_SEC}SELECT{_HEAD}({body}).*+"
    n = len(_FIELDS)
    first = F.regexp_replace(text, whole, _HEAD + _SEC.join(f"${i + 1}" for i in range(n + 1)))
    others = F.regexp_replace(text, any_order, _HEAD + _SEC.join(f"${i + 1}" for i in (n, *range(n))))
    passes = (
        lambda t: F.when(F.startswith(t, F.lit(_HEAD)), t).otherwise(others),
        lambda t: _put(t, _ON, _TOK),
        lambda t: _aliased(F.substring(t, 2, 2**31 - 1)),
        lambda t: F.regexp_replace(t, rf"([{_SEC}{_ITEM}{_AND}{_OR}]|\A)[{_TOK}{_GLUE}]|[{_GLUE}{_OWN}]", "$1"),
        lambda t: F.replace(t, F.lit(_TOK), F.lit(" ")),
    )
    return F.split(_chain(first, passes), _SEC)


def _words(field: Column, *marks: str) -> Column:
    """Marks that do not split a field put back as words."""
    written = {_ITEM: ", ", _AND: " AND ", _OR: " OR "}
    return functools.reduce(lambda t, mark: _put(t, mark, written[mark]), marks, field)


def _parted(field: Column, mark: str, *others: str) -> Column:
    """Parts of a field between the marks of one kind; an empty field has none."""
    held = functools.reduce(lambda a, b: a | b, [F.contains(field, F.lit(other)) for other in others])
    worded = F.transform(F.split(_words(field, *others), mark), lambda t: F.trim(t))
    return F.array_remove(F.when(held, worded).otherwise(F.split(field, mark)), "")


def _items(field: Column) -> Column:
    return _parted(field, _ITEM, _AND, _OR)


def _conjuncts(field: Column) -> Column:
    """Parts between AND, unless an OR stands beside it, which binds weaker."""
    whole = F.array(F.trim(_words(field, _ITEM, _AND, _OR)))
    return F.when(F.contains(field, F.lit(_OR)), whole).otherwise(_parted(field, _AND, _ITEM))


def signature(sql: Column) -> Column:
    """The eight clause lists of a text, null for anything but one flat SELECT."""

    def build(text: Column) -> Column:
        def with_refs(refs: Column) -> Column:
            return let(
                F.array_distinct(F.transform(refs, lambda r: r["known"])),
                lambda names: let(
                    let(_qualified(text, names), _fields), lambda fields: lists(refs, names, fields)
                ),
            )

        def lists(refs: Column, names: Column, fields: Column) -> Column:
            def join(ref: Column) -> Column:
                number = F.array_position(names, ref["known"]).cast("string")
                head = F.concat(ref["kind"], F.lit("(T"), number, F.lit(") ON "))
                return F.concat(head, _render(_qualified(ref["cond"], names)))

            def ordered(item: Column) -> Column:
                given = F.endswith(item, F.lit(" ASC")) | F.endswith(item, F.lit(" DESC")) | item.isin("ASC", "DESC")
                return F.when(given, item).otherwise(F.concat(item, F.lit(" ASC")))

            def table(name: Column, n: Column) -> Column:
                tid = F.concat(F.lit("T"), (n + 1).cast("string"))
                real = F.try_element_at(F.filter(refs, lambda r: r["known"] == name), F.lit(-1))["name"]
                return F.struct(tid.alias("tid"), F.concat(tid, F.lit(":"), real).alias("text"))

            selected, where, group, having, order, limits = (F.get(fields, F.lit(n)) for n in range(6))
            limit = F.substring_index(F.substring_index(F.rtrim(limits, F.lit(_ITEM)), _ITEM, -1), " ", 1)
            return F.struct(
                F.transform(F.array_sort(F.transform(names, table)), lambda t: t["text"]).alias("tables"),
                F.array_sort(F.transform(F.filter(refs, lambda r: r["kind"] != "FROM"), join)).alias("joins"),
                sorted_distinct(_conjuncts(where)).alias("filters"),
                sorted_distinct(_items(group)).alias("group_by"),
                sorted_distinct(_conjuncts(having)).alias("having"),
                _items(selected).alias("select"),
                F.transform(_items(order), ordered).alias("order_by"),
                let(
                    limit, lambda n: F.when(F.rlike(n, F.lit(r"\A\d+\z")), n.try_cast("bigint"))
                ).alias("limit"),
            ).cast(SIGNATURE_TYPE)

        return let(_refs(text), with_refs)

    def from_text(text: Column) -> Column:
        return F.when(text.isNotNull(), let(_structured(text), build))

    return _chain(sql, (collapse_spaces, _clause_text, _flat, from_text))


def signatures(pairs: DataFrame, wanted: Column | None = None) -> DataFrame:
    """Add ``gold_signature`` and ``pred_signature`` to ``index, label, predict``, null where
    they are not ``wanted``."""
    # One expression for both texts keeps the plan half as large; two equal texts are one.
    same = F.col("label").eqNullSafe(F.col("predict"))
    both = F.transform(F.when(same, F.array("label")).otherwise(F.array("label", "predict")), signature)
    if wanted is not None:
        both = F.when(wanted, both)
    return (
        pairs.withColumn("_both", both)
        .withColumns(
            {"gold_signature": F.get("_both", F.lit(0)), "pred_signature": F.element_at("_both", -1)}
        )
        .drop("_both")
    )


def _stage_items(sig: Column, stage: str) -> Column:
    if stage == "limit":
        return F.array_compact(F.array(sig["limit"].cast("string")))
    return sig[stage]


def _first_text(stage: Column, gold: Column, pred: Column) -> Column:
    extra = list_difference(pred, gold)
    last = F.element_at(F.when(F.size(pred) > 0, pred), -1)
    listed = F.when(F.size(extra) > 0, F.get(extra, F.lit(0))).when(
        F.size(pred) != F.size(gold), F.coalesce(last, stage)
    )
    limit = F.coalesce(F.get(pred, F.lit(0)), F.lit("None"))
    return F.when(stage == "limit", limit).otherwise(listed)


def compare_pairs(pairs: DataFrame) -> DataFrame:
    """``index, is_equivalent, first_divergence_stage, first_divergence_text, differences``.

    Both texts are in one row, so this is a narrow stage: nothing is shuffled.  Texts that
    are equal but for spaces are equivalent without being taken apart.
    """
    gold, pred = F.col("gold_signature"), F.col("pred_signature")
    same = collapse_spaces(F.col("label")) == collapse_spaces(F.col("predict"))
    broken = gold.isNull() | pred.isNull()
    no_difference = F.array().cast("array<struct<stage:string,gold:array<string>,pred:array<string>>>")
    stages = F.array(
        *[
            F.struct(
                F.lit(s).alias("stage"),
                _stage_items(gold, s).alias("gold"),
                _stage_items(pred, s).alias("pred"),
            )
            for s in STAGES
        ]
    )
    nothing = F.lit(None).cast("array<string>")
    error = F.array(
        F.struct(F.lit("parse_error").alias("stage"), nothing.alias("gold"), nothing.alias("pred"))
    )
    unequal = F.filter(stages, lambda s: s["gold"] != s["pred"])
    first = F.get("differences", F.lit(0))
    return (
        signatures(pairs, ~same)
        .select(
            "index",
            F.when(same, no_difference).when(broken, error).otherwise(unequal).alias("differences"),
        )
        .select(
            "index",
            F.when(
                F.coalesce(first["stage"], F.lit("")) != "parse_error", F.size("differences") == 0
            ).alias("is_equivalent"),
            first["stage"].alias("first_divergence_stage"),
            F.when(
                first["stage"] != "parse_error",
                _first_text(first["stage"], first["gold"], first["pred"]),
            ).alias("first_divergence_text"),
            "differences",
        )
    )


def clause_table(pairs: DataFrame) -> DataFrame:
    """Long table ``index, side, stage, pos, item``; a null signature is one row of stage
    ``parse_error`` with the text in one spacing.  Narrow: one explode per row."""

    def rows(side: str, text: str, sig: Column) -> Column:
        def of_stage(stage: str) -> Column:
            return F.transform(
                _stage_items(sig, stage),
                lambda x, n: F.struct(
                    F.lit(side).alias("side"),
                    F.lit(stage).alias("stage"),
                    n.cast("int").alias("pos"),
                    x.alias("item"),
                ),
            )

        broken = F.array(
            F.struct(
                F.lit(side).alias("side"),
                F.lit("parse_error").alias("stage"),
                F.lit(0).alias("pos"),
                collapse_spaces(F.col(text)).alias("item"),
            )
        )
        return F.when(sig.isNull(), broken).otherwise(F.concat(*[of_stage(s) for s in STAGES]))

    both = F.concat(
        rows("gold", "label", F.col("gold_signature")), rows("pred", "predict", F.col("pred_signature"))
    )
    return signatures(pairs).select("index", F.inline(both))


def stage_compare(clauses: DataFrame) -> DataFrame:
    """First unequal stage per index, from a stored clause table.

    Stages absent on both sides are equal; a stage absent on one side is an empty list
    there.  A group holds the items of one pair of texts: both sides lie in the order of the
    stages, so that the first place where they part names the stage.
    """
    order = F.array(F.lit("parse_error"), *[F.lit(s) for s in STAGES])
    rank = F.array_position(order, F.col("stage"))

    def side(name: str) -> Column:
        return F.collect_list(F.when(F.col("side") == name, F.struct(rank.alias("rank"), "stage", "pos", "item")))

    def parted(gold: Column, pred: Column) -> Column:
        """Rank and stage of the first place where the sorted sides are unequal, null when there is none."""

        def at(g: Column, p: Column) -> Column:
            equal = g["item"].eqNullSafe(p["item"]) & g["stage"].eqNullSafe(p["stage"])
            # Beyond the end of the shorter side there is no entry.
            known = [F.when(e.isNotNull(), F.struct(e["rank"].alias("rank"), e["stage"].alias("stage"))) for e in (g, p)]
            return F.when(~equal | g.isNull() | p.isNull(), F.least(*known))

        return F.get(F.filter(F.zip_with(gold, pred, at), lambda e: e.isNotNull()), F.lit(0))

    def of_stage(entries: str) -> Column:
        return F.transform(
            F.filter(entries, lambda e: e["stage"] == F.col("_d.stage")), lambda e: e["item"]
        )

    unequal = F.col("gold") != F.col("pred")
    return (
        clauses.groupBy("index")
        .agg(side("gold").alias("gold"), side("pred").alias("pred"))
        .select("index", *[F.when(unequal, F.sort_array(s)).alias(s) for s in ("gold", "pred")])
        .select("*", F.when(F.col("gold").isNotNull(), parted(F.col("gold"), F.col("pred"))).alias("_d"))
        .select(
            "index",
            F.when(
                F.coalesce(F.col("_d.stage"), F.lit("")) != "parse_error", F.col("_d").isNull()
            ).alias("is_equivalent"),
            F.col("_d.stage").alias("first_divergence_stage"),
            F.when(
                F.col("_d.stage") != "parse_error",
                _first_text(F.col("_d.stage"), of_stage("gold"), of_stage("pred")),
            ).alias("first_divergence_text"),
        )
    )


def stage_profile(compared: DataFrame) -> DataFrame:
    """Pairs by first unequal stage."""
    stage = F.coalesce("first_divergence_stage", F.lit("equivalent"))
    return compared.groupBy(stage.alias("stage")).agg(F.count("*").alias("n_pairs"))
