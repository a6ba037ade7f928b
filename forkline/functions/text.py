"""Text helpers shared by every operator, all on Spark's own functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space when a text is stripped.
STRIP_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Java's Unicode \s, and the four separators U+001C..U+001F that it leaves out.  A Unicode class
# is asked property by property for every character; here two tests turn most of them away.
_WS = (
    r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0"
    r"[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
)
WS = f"[{_WS}]"
NON_WS = f"[^{_WS}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it any number of times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def strip(text: Column) -> Column:
    """Remove leading and trailing white space."""
    return F.btrim(text, F.lit(STRIP_CHARS))


def collapse_spaces(text: Column) -> Column:
    """Every run of white space becomes one space; the ends are trimmed; null gives ''."""
    return F.trim(F.regexp_replace(text_or_empty(text), f"{WS}+", " "))


def words(text: Column) -> Column:
    """White-space separated words, in order."""
    return F.regexp_extract_all(text, F.lit(f"{NON_WS}+"), F.lit(0))


def first_word(text: Column) -> Column:
    """The first word, null when there is none."""
    return F.nullif(F.regexp_extract(text, f"{NON_WS}+", 0), F.lit(""))


def words_before(text: Column, offset: Column) -> Column:
    """How many words end at or before the character ``offset``.

    Words of the left part are counted; the last one is still open when neither
    side of the cut is white space.
    """
    whole = F.size(words(F.left(text, offset)))
    cut = text.substr(offset, F.lit(2))
    inside = (offset > 0) & F.rlike(cut, F.lit(f"^{NON_WS}{{2}}$"))
    return whole - inside.cast("int")


def common_prefix_length(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two texts of any length.

    A binary descent over the length: about log2(n) comparisons of slices, and no
    array of characters.
    """

    def descend(limit: Column) -> Column:
        top = F.floor(F.log2(F.greatest(limit, F.lit(1)))).cast("int")

        def step(done: Column, power: Column) -> Column:
            size = F.call_function("shiftleft", F.lit(1), power)
            same = a.substr(done + 1, size) == b.substr(done + 1, size)
            return F.when((done + size <= limit) & same, done + size).otherwise(done)

        return F.aggregate(F.sequence(top, F.lit(0), F.lit(-1)), F.lit(0), step)

    return let(F.least(F.length(a), F.length(b)), descend)


def first_char_divergence(a: Column, b: Column) -> Column:
    """First differing character, the shorter length if one is a prefix, -1 if equal."""
    return F.when(a == b, F.lit(-1)).otherwise(common_prefix_length(a, b))


def sorted_distinct(items: Column) -> Column:
    return F.sort_array(F.array_distinct(items))


def list_difference(items: Column, other: Column) -> Column:
    """Items that ``other`` does not hold; order and repeats are kept."""
    return F.filter(items, lambda x: ~F.array_contains(other, x))
