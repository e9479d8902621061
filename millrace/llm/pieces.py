"""Texts cut into pieces whose byte-level pre-tokens do not depend on their surroundings.

The pre-token pattern lets a word take one space before it and never crosses other white space. So in a text whose
white space is single spaces and line ends between words, each word is a piece of its own: the first of a line as it
stands, any other with its space. Pieces repeat, so what is computed for a piece once is remembered.

``cut`` does so for a whole Arrow column of any texts, by the bytes on both sides of a place. It cuts only where a
pre-token surely ends: before the first white space behind something else, behind a single line end or tab, and between
letters, digits and other printable ASCII. Behind an apostrophe it cuts only before white space, as contractions begin
with one. Where bytes don't tell what a character is, there is no cut and the piece is longer.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
import regex

#: The pattern of byte-level pre-tokens, and the coarser one of pieces in texts with other white space.
PRE_TOKEN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
ANY_PIECE = regex.compile(r" ?\S+|\s+(?!\S)|\s+")

PIECES_REMEMBERED = 800_000  # of each kind by a worker; a full memory is emptied, results do not change

LONGEST_PIECE = 64  # longer ones rarely come back and are not remembered

#: Kinds of bytes; OTHER is not white space, UNSURE may be.
WHITE, LETTER, DIGIT, QUOTE, MARK, OTHER, UNSURE = range(7)
KIND = np.full(256, UNSURE, np.uint8)
KIND[0x21:0x7F] = MARK
KIND[[ord("'"), *b"\t\n\v\f\r "]] = [QUOTE, *[WHITE] * 6]
KIND[[byte for byte in range(128) if chr(byte).isalpha()]] = LETTER
KIND[[byte for byte in range(128) if chr(byte).isdigit()]] = DIGIT
KIND[0xC3:0xCA] = LETTER  # first bytes of U+00C0 to U+027F, all letters but two
#: White space of three bytes, and characters that some tables take for it.
WIDE_SPACES = [0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF]
#: Whether a place is cut, by the kinds before and behind it.
CUT = np.zeros((7, 7), bool)
CUT[LETTER : OTHER + 1, WHITE] = True
CUT[LETTER, [DIGIT, QUOTE, MARK]] = CUT[DIGIT, [LETTER, QUOTE, MARK]] = CUT[MARK, [LETTER, DIGIT]] = True

Line = tuple[Any, list]


def pre_tokens(piece: str, space: str = "") -> list[str]:
    return [space + piece] if piece.isalpha() else PRE_TOKEN.findall(space + piece)


def _kinds(data: np.ndarray) -> np.ndarray:
    """Kind of each byte. Of characters of several bytes the last has the kind, of letters all; the others are UNSURE."""
    kinds = KIND[data]
    first = np.flatnonzero(data >= 0xC3)
    lead = data[first]
    letters = first[lead < 0xCA]
    signs = letters[(data[letters] == 0xC3) & ((data[letters + 1] == 0x97) | (data[letters + 1] == 0xB7))]
    kinds[letters + 1] = LETTER
    kinds[signs], kinds[signs + 1] = UNSURE, OTHER
    kinds[first[(lead >= 0xCA) & (lead < 0xE0)] + 1] = OTHER
    three = first[(lead >= 0xE0) & (lead < 0xF0)]
    points = (data[three] & 15).astype(np.int32) << 12 | (data[three + 1] & 63).astype(np.int32) << 6 | data[three + 2] & 63
    kinds[three[~np.isin(points, WIDE_SPACES)] + 2] = OTHER
    kinds[first[lead >= 0xF0] + 3] = OTHER
    return kinds


def cut(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """The pieces of all texts (none is null) behind each other, as views of their bytes, and the number of pieces
    before each text and before the end."""
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    ends = bounds - bounds[0]
    kinds = _kinds(data)
    begins = np.zeros(len(data) + 1, bool)
    begins[1:-1] = CUT[kinds[:-1], kinds[1:]]
    begins[ends] = True
    alone = np.flatnonzero(begins[:-2] & (kinds[:-1] == WHITE) & (data[:-1] != ord(" ")))
    begins[alone[(kinds[alone + 1] != WHITE) & (kinds[alone + 1] < OTHER)] + 1] = True
    places = np.flatnonzero(begins).astype(np.int32)
    pieces = pa.StringArray.from_buffers(len(places) - 1, pa.py_buffer(places + bounds[0]), texts.buffers()[2] or pa.py_buffer(b""))
    return pieces, np.searchsorted(places, ends)


class RecentValues:
    """Values of at most about ``most`` pieces met of late, in two halves: what is found in the half that is full and
    set aside goes to the new one; the rest is forgotten with the next change. ``learn(pieces)`` gives other values."""

    def __init__(self, learn: Callable[[list[str]], list], most: int):
        self.learn, self.half = learn, most // 2
        self.new: dict[str, Any] = {}
        self.old: dict[str, Any] = {}

    def of(self, pieces: list[str]) -> list:
        """Value of each piece; all are different."""
        values = list(map(self.new.get, pieces))
        missing = [place for place, value in enumerate(values) if value is None]
        again = {place: value for place in missing if (value := self.old.get(pieces[place])) is not None}
        unknown = [place for place in missing if place not in again]
        again |= zip(unknown, self.learn([pieces[place] for place in unknown]))
        for place, value in again.items():
            values[place] = value
        if len(self.new) + len(again) > self.half:
            self.old, self.new = self.new, {}
        self.new.update((pieces[place], value) for place, value in again.items() if len(pieces[place]) <= LONGEST_PIECE)
        return values


class PieceMemory:
    """Values of pieces. ``learn(pieces, space)`` gives the values of new ones, each with ``space`` before it."""

    def __init__(self, learn: Callable[[list[str], str], list]):
        self.learn = learn
        self.heads: dict[str, Any] = {}
        self.tails: dict[str, Any] = {}

    def _values(self, known: dict[str, Any], pieces: list[str], space: str) -> tuple[list, list[int]]:
        """Value of each piece, and the places of pieces that are none (empty, or with white space inside)."""
        values = list(map(known.get, pieces))
        missing = [place for place, value in enumerate(values) if value is None]
        fresh = {pieces[place] for place in missing}
        odd = {piece for piece in fresh if piece.split() != [piece]}
        new = list(fresh - odd)
        learned = dict(zip(new, self.learn(new, space)))
        if len(known) + len(new) > PIECES_REMEMBERED:
            known.clear()
        known.update(learned)
        for place in missing:
            values[place] = learned.get(pieces[place])
        return values, [place for place in missing if pieces[place] in odd]

    def lines_of(self, texts: list[str]) -> list[list[Line]]:
        """For each text its lines as (value of the first piece, values of the others); between two lines stands a
        line end. A text with any other white space is one line of pieces as they stand, an empty text no line."""
        heads, tails, counts, first_head, first_tail = [], [], [], [], []
        for text in texts:
            first_head.append(len(heads))
            first_tail.append(len(tails))
            if text:
                for line in text.split("\n"):
                    parts = line.split(" ")
                    heads.append(parts[0])
                    tails += parts[1:]
                    counts.append(len(parts) - 1)
        head_values, odd_heads = self._values(self.heads, heads, "")
        tail_values, odd_tails = self._values(self.tails, tails, " ")
        odd = {bisect_right(first_head, place) - 1 for place in odd_heads}
        odd |= {bisect_right(first_tail, place) - 1 for place in odd_tails}
        found: list[list[Line]] = []
        for number, (head, tail) in enumerate(zip(first_head, first_tail)):
            lines = []
            if number in odd:
                lines.append(self._standing(texts[number]))
            else:
                stop = first_head[number + 1] if number + 1 < len(texts) else len(heads)
                for place in range(head, stop):
                    lines.append((head_values[place], tail_values[tail : tail + counts[place]]))
                    tail += counts[place]
            found.append(lines)
        return found

    def _standing(self, text: str) -> Line:
        pieces = ANY_PIECE.findall(text)
        known = {piece: self.heads.get(piece) for piece in set(pieces)}
        new = [piece for piece, value in known.items() if value is None]
        known |= dict(zip(new, self.learn(new, "")))
        values = [known[piece] for piece in pieces]
        return values[0], values[1:]
