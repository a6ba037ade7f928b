"""Token ids of whole texts by the tokenizers library, each distinct piece of text encoded once.

Both vocabularies here cut a text into words before any merge, and always cut where a space
follows something that is no white space. A text may therefore be taken apart at those places
without changing an id; the pieces repeat far more than texts do, and only pieces not seen
before go to the library.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np

#: Texts are encoded in groups of about this many characters, longer ones in several steps.
GROUP = 1 << 20
#: Pieces kept before the rarer half of them is forgotten, which bounds the memory; half as many
#: where pieces come in lower case.
CACHE = 500_000
END = 0
#: A character that no valid text holds.
NAKED = "\ud800"

#: A blank that is followed by something visible begins a token of its own or is dropped.
_SPACE = re.compile(r" (?=\S)")
#: One line break between visible characters is a token of its own or is dropped.
_BREAK = re.compile(r"(?<=\S)\n(?=\S)")

#: Fixed: bytes as both vocabularies spell them. Visible ones stand for themselves, the others
#: for the characters from 256 on, in their order.
_VISIBLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _VISIBLE)}


class _Numbers(dict):
    """Numbers of pieces in the order they were first asked for; ``fresh`` are those not encoded yet."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self)
        self.fresh.append(piece)
        return number


#: Blanks and line breaks that do not stand alone between visible characters.
_ODD = ("  ", "\n\n", " \n", "\n ")


def _plain(text: str) -> bool:
    """Whether single blanks and line breaks inside are the only white space of a text."""
    return text[:1] not in ("", " ", "\n") and text[-1] not in " \n" and text.replace("\n", "").isprintable() and not any(x in text for x in _ODD)


def _parts_at_blanks(library: "Tokenizer", drops_blanks: bool) -> bool:  # noqa: F821
    """Whether a vocabulary normalises and cuts texts in the way that taking them apart relies on."""
    state = lambda part: json.loads(part.__getstate__()) if part else {}
    model, cut, normal = library.model, state(library.pre_tokenizer), state(library.normalizer)
    if type(model).__name__ != "BPE" or model.dropout or model.continuing_subword_prefix:
        return False
    if not drops_blanks:
        whole = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
        return bool(whole) and not normal and not model.end_of_word_suffix
    steps = [(n["type"], n.get("pattern"), n.get("content")) for n in normal.get("normalizers", [])]
    cuts = cut.get("pretokenizers", [])
    return (
        steps == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
        and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
        and cuts[0]["behavior"] == "Removed"
        and cuts[0]["invert"]
        and cuts[0]["pattern"] == {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
        and not cuts[1]["use_regex"]
    )


class Encoder:
    """Vocabularies of the tokenizers library; ``drops_blanks``: white space has no ids.

    One that does not cut at blanks as described above encodes whole texts instead.
    """

    def __init__(self, path: str, drops_blanks: bool):
        from tokenizers import Tokenizer

        # A task has one core. Threads of the library's own take turns with those of other tasks,
        # and burn more time waiting for pieces than the pieces take.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model = self.library.model
        self.drops_blanks = drops_blanks
        self.whole = not _parts_at_blanks(self.library, drops_blanks)
        self.cache = CACHE // 2 if drops_blanks else CACHE
        self.blank = chr(_BYTES[0x20])
        self._clear()

    def _alone(self, piece: str) -> str:
        """The text that a piece stands for."""
        if self.drops_blanks:
            return piece
        return piece[1:] if piece.startswith(NAKED) else " " + piece

    def _clear(self) -> None:
        self.known = _Numbers()
        self.starts, self.sizes, self.hits = (np.zeros(0, np.int64) for _ in range(3))
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.ends = {p: self.library.encode(p, add_special_tokens=False).ids[0] for p in ",."}

    def _forget(self) -> None:
        """Keep the half of the cache that was asked for most often."""
        kept = np.sort(np.argpartition(-self.hits, self.cache // 2)[: self.cache // 2])
        pieces = list(self.known)
        sizes, ids = self.sizes[kept], self._gather(kept)
        hits = self.hits[kept] // 2
        self._clear()
        self.known.update(zip([pieces[n] for n in kept.tolist()], range(len(kept))))
        self._put(np.arange(len(kept)), sizes, ids)
        self.hits[: len(kept)] = hits

    def _gather(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of pieces one after another."""
        sizes = self.sizes[numbers]
        after = np.cumsum(sizes)
        total = int(after[-1]) if len(after) else 0
        return self.flat[np.repeat(self.starts[numbers] - after + sizes, sizes) + np.arange(total)]

    def _put(self, numbers: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(self.used + 2 * len(ids), np.uint32)])
        if len(self.known) > len(self.sizes):
            more = np.zeros(len(self.known) + 1024, np.int64)
            self.starts, self.sizes, self.hits = (np.concatenate([x, more]) for x in (self.starts, self.sizes, self.hits))
        self.flat[self.used : self.used + len(ids)] = ids
        self.sizes[numbers] = sizes
        self.starts[numbers] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)

    def _learn(self) -> None:
        """Encode what is new. A stop or comma behind a letter is a token of its own, so the rest is encoded without it."""
        fresh, self.known.fresh = self.known.fresh, []
        closed = [p for p in fresh if p[-1:] in self.ends and "a" <= p[-2:-1] <= "z"]
        stems = np.fromiter((self.known[p[:-1]] for p in closed), np.int64, len(closed))
        whole = [p for p in fresh if not (p[-1:] in self.ends and "a" <= p[-2:-1] <= "z")] + self.known.fresh
        self.known.fresh = []
        coded: list[list[int]] = [[]] * len(whole)
        mixed = []
        lead, cut = "" if self.drops_blanks else self.blank, self.model.tokenize
        for n, word in enumerate(whole):
            # Letters that the library's normalisation leaves alone are one word to it, which
            # may go to its merges at once; those of ASCII are spelled as they are.
            if not word.isalpha() or self.drops_blanks and word != word.lower():
                mixed.append(n)
            elif word.isascii():
                coded[n] = [t.id for t in cut(lead + word)]
            elif max(word) <= "\xff":
                coded[n] = [t.id for t in cut(lead + word.encode().decode("latin-1").translate(_BYTES))]
            else:
                mixed.append(n)
        for n, e in zip(mixed, self.library.encode_batch_fast([self._alone(whole[n]) for n in mixed], add_special_tokens=False)):
            coded[n] = e.ids
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        ids = np.fromiter(chain.from_iterable(coded), np.uint32, int(sizes.sum()))
        self._put(np.fromiter(map(self.known.__getitem__, whole), np.int64, len(whole)), sizes, ids)
        sizes = self.sizes[stems] + 1
        last = np.cumsum(sizes) - 1
        ids = np.zeros(int(sizes.sum()), np.uint32)
        inner = np.ones(len(ids), bool)
        inner[last] = False
        ids[inner] = self._gather(stems)
        ids[last] = [self.ends[p[-1]] for p in closed]
        self._put(np.fromiter(map(self.known.__getitem__, closed), np.int64, len(closed)), sizes, ids)

    def _pieces(self, text: str) -> list[str]:
        """Pieces that the library encodes alone as in the text.

        Where white space counts, a piece stands for itself with a blank before it, but for
        one with the mark NAKED, which stands for the rest of it.
        """
        if self.drops_blanks:
            if "\u03a3" not in text:  # its lower case depends on what follows
                text = text.lower()
            return text.replace("\n", " ").split(" ")
        if _plain(text):
            return f"{NAKED}{text}".replace("\n", f" {NAKED}\n {NAKED}").split(" ")
        pieces: list[str] = []
        for n, line in enumerate(_BREAK.split(text)):
            parts = _SPACE.split(line)
            parts[0] = NAKED + parts[0]
            if n:
                pieces.append(NAKED + "\n")
            pieces += parts
        return pieces

    def _segments(self, text: str) -> Iterator[str]:
        start = 0
        while len(text) - start > GROUP:
            cut = _SPACE.search(text, start + GROUP)
            if not cut:
                break
            yield text[start : cut.start()]
            start = cut.start()
        yield text[start:]

    def _ids(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some segments one after another, and how many each has."""
        if len(self.known) > self.cache:
            self._forget()
        pieces: list[str] = []
        ends = []
        for segment in segments:
            pieces += self._pieces(segment)
            ends.append(len(pieces))
        at = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        if self.known.fresh:
            self._learn()
        self.hits[: len(self.known)] += np.bincount(at, minlength=len(self.known))
        after = np.concatenate([[0], np.cumsum(self.sizes[at])])
        return self._gather(at), np.diff(after[np.concatenate([[0], np.array(ends, np.int64)])])

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text with the end id behind them, in order."""
        if self.whole:
            for text in texts:
                coded = self.library.encode_batch_fast([text or ""], add_special_tokens=False)[0]
                yield np.append(np.array(coded.ids, np.uint32), np.uint32(END))
            return
        group: list[str] = []
        parts: list[int] = []
        size = 0
        end = np.array([END], np.uint32)

        def done() -> Iterator[np.ndarray]:
            ids, sizes = self._ids(group)
            segments = np.split(ids, np.cumsum(sizes)[:-1])
            at = 0
            for n in parts:
                yield np.concatenate([*segments[at : at + n], end])
                at += n

        for text in texts:
            if size > GROUP:
                yield from done()
                group, parts, size = [], [], 0
            segments = list(self._segments(text or ""))
            group += segments
            parts.append(len(segments))
            size += len(text or "")
        if parts:
            yield from done()


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, drops_blanks: bool) -> Encoder:
    """One encoder for each vocabulary and worker."""
    key = (path, drops_blanks)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, drops_blanks)
    return _ENCODERS[key]
