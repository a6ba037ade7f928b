"""Divergent words found by carried offsets, beside those that an alignment of characters gives.

The library knows the raw place of every token that normalising keeps. A plain alignment of the
raw and the normalised text knows nothing of tokens; both should point at the same raw word.
"""

from __future__ import annotations

import difflib
import random
import re
from bisect import bisect_right

from forkline.operators.diverge import diverge
from forkline.operators.normalize import normalize_pairs

TABLES = ("orders", "order_lines", "users", "u", "parts")
ALIASES = ("T1", "T2", "o", "ord", "x", "us")
COLUMNS = ("id", "name", "total", "o", "created_at")
VALUES = ("12", "1.5", "'it''s'", "'AS q'", "NULL", '"Q"')


def free_form(rng: random.Random) -> str:
    """A SELECT with joins, aliases with and without AS, odd white space, literals and comments."""
    gap = lambda: rng.choice((" ", " ", " ", "  ", "\n"))
    names = rng.sample(TABLES, rng.randrange(1, 4))
    owners, sources = [], []
    for name, alias in zip(names, rng.sample(ALIASES, len(names)), strict=True):
        form = rng.randrange(3)
        owners.append(name if form == 0 else alias)
        sources.append(name if form == 0 else f"{name}{gap()}{'AS ' if form == 1 else ''}{alias}")
    column = lambda: f"{rng.choice(owners)}.{rng.choice(COLUMNS)}"
    items = [rng.choice((column(), f"count({column()})", f"{column()} AS {rng.choice(('n', 'total', 'y'))}")) for _ in range(rng.randrange(1, 4))]
    text = f"SELECT{gap()}{f',{gap()}'.join(items)}{gap()}FROM{gap()}{sources[0]}"
    for source in sources[1:]:
        text += f"{gap()}JOIN{gap()}{source} ON {column()} = {column()}"
    for n in range(rng.randrange(3)):
        text += f"{gap()}{'AND' if n else 'WHERE'} {column()} {rng.choice(('=', '<>', '>'))}{gap()}{rng.choice(VALUES)}"
    if rng.random() < 0.3:
        text += f"{gap()}ORDER BY {column()}{rng.choice((' DESC', ''))}"
    return text + (" -- done" if rng.random() < 0.1 else "")


def aligned_word(raw: str, normal: str, at: int) -> int:
    """The raw word at which place ``at`` of the normalised text lies, by common runs of characters."""
    runs = [(b, a, n) for a, b, n in difflib.SequenceMatcher(None, raw, normal, autojunk=False).get_matching_blocks()]
    k = bisect_right(runs, (at, len(raw), 0)) - 1
    if k >= 0 and at < runs[k][0] + runs[k][2]:
        place = runs[k][1] + at - runs[k][0]
    else:  # between two runs: where the last one ends
        place = runs[k][1] + runs[k][2] if k >= 0 else 0
    return sum(1 for w in re.finditer(r"\S+", raw) if w.end() <= place)


def holds(raw: str, word: int, token: str) -> bool:
    """Whether a word of ``raw`` holds a token, or its column where a table came before it."""
    every = raw.split()
    column = token if token[0] in "'\"" or token[0].isdigit() else token.split(".")[-1]
    return word < len(every) and column.split()[0].lower() in every[word].lower()


def test_words_of_both_ways(spark):
    rng = random.Random(7)
    rows = []
    for index in range(3000):
        predict = label = free_form(rng)
        words = predict.split(" ")
        if rng.random() < 0.6:  # most pairs share a beginning
            words[rng.randrange(len(words))] = "other"
            label = " ".join(words)
        else:
            label = free_form(rng)
        rows.append((index, predict, label))
    pairs = spark.createDataFrame(rows, "index bigint, predict string, label string")
    found = diverge(normalize_pairs(pairs)).where("divergence_meta IS NOT NULL").select("predict", "normalized_predict", "divergence_meta.*").collect()
    assert len(found) > 2000
    aligned = [aligned_word(r["predict"], r["normalized_predict"], r["norm_pred_char"]) for r in found]
    same = sum(a == r["orig_pred_token_index"] for a, r in zip(aligned, found, strict=True))
    by_alignment = sum(holds(r["predict"], a, r["norm_pred_token"]) for a, r in zip(aligned, found, strict=True))
    wrong = [r for r in found if not holds(r["predict"], r["orig_pred_token_index"], r["norm_pred_token"])]
    figures = (len(found), same, by_alignment, len(wrong))
    # Every word found here holds its token. The alignment may stray to a like text elsewhere.
    assert not wrong, (figures, wrong[:5])
    assert same > 0.95 * len(found), figures
    assert by_alignment < len(found), figures
