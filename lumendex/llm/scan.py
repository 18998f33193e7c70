"""Pre-tokenisation without regular expressions.

Texts become arrays of code points, these become arrays of symbols (the class
of the code point with a little of what follows it), and the symbols drive a
small automaton. A symbol is a function from state to state. The functions that
symbols can compose to form a finite monoid, so a block of text is summed up by one
monoid element; composing elements is associative, so blocks are scanned side by
side with numpy and joined by a doubling scan. The last pass runs the
automaton in all blocks at once from known start states and marks token starts.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import cache

import numpy as np

LETTER, NUMBER, OTHER, SPACE, WHITE = range(5)

# Letters and numbers that Unicode 16 has beside those of
# Unicode 15.1, as first and last code points.
LETTERS_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65),
    (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
    (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0),
    (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED),
    (0x1E5F0, 0x1E5F0),
)
NUMBERS_16 = (
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
    (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA),
)


@cache
def class_table() -> np.ndarray:
    """The class of each code point: letter, number, the space, other white space, anything else."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        ch = chr(c)
        kind = unicodedata.category(ch)[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
        elif ch.isspace():
            out[c] = WHITE
    for ranges, kind in ((LETTERS_16, LETTER), (NUMBERS_16, NUMBER)):
        for first, last in ranges:
            out[first : last + 1] = kind
    out[0x1C:0x20] = OTHER  # separators that only Python takes for white space
    out[ord(" ")] = SPACE
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Automaton:
    """Marks token starts; ``step(state, symbol)`` gives the next state and whether a token starts here.

    Every symbol also has a twin (plus ``n_symbols``) that stands first in its text:
    it acts as from state 0 and always starts a token.
    """

    BLOCK = 128

    def __init__(self, n_states: int, n_symbols: int, step: Callable[[int, int], tuple[int, bool]]):
        self.n_symbols, self.n_states = n_symbols, n_states
        moves = [[step(q, s) for q in range(n_states)] for s in range(n_symbols)]
        moves += [[(m[0][0], True)] * n_states for m in moves]
        # [symbol * n_states + state]
        self.next = np.array([[q for q, _ in m] for m in moves], np.uint8).ravel()
        self.starts = np.array([[b for _, b in m] for m in moves], np.uint8).ravel()
        same = tuple(range(n_states))
        known, order = {same: 0}, [same]
        makers = [tuple(q for q, _ in m) for m in moves]
        for f in order:
            for g in makers:
                h = tuple(g[q] for q in f)
                if h not in known:
                    known[h] = len(order)
                    order.append(h)
        self.functions = np.array(order, np.uint8)
        # after[e, s]: element e, then symbol s; both[e, f]: element e, then element f.
        self.after = np.array([[known[tuple(g[q] for q in f)] for g in makers] for f in order], np.uint16)
        self.both = np.array([[known[tuple(g[q] for q in f)] for g in order] for f in order], np.uint16)

    def token_starts(self, symbols: np.ndarray) -> np.ndarray:
        """Positions where tokens start, for symbols of one or more texts."""
        n, size = len(symbols), self.BLOCK
        if not n:
            return np.empty(0, np.int64)
        blocks = -(-n // size)
        padded = np.zeros(blocks * size, np.uint8)
        padded[:n] = symbols
        columns = np.ascontiguousarray(padded.reshape(blocks, size).T)
        after, width = self.after.ravel(), self.after.shape[1]
        element = np.zeros(blocks, np.int32)
        for column in columns:
            element = after.take(element * np.int32(width) + column).astype(np.int32)
        reach = 1
        while reach < blocks:  # element i becomes the composition of blocks 0..i
            element[reach:] = self.both[element[:-reach], element[reach:]]
            reach *= 2
        state = np.zeros(blocks, np.int32)
        state[1:] = self.functions[element[:-1], 0]
        marks = np.empty_like(columns)
        states = np.int32(self.n_states)
        for column, mark in zip(columns, marks, strict=True):
            at = column * states + state
            self.starts.take(at, out=mark)
            state = self.next.take(at).astype(np.int32)
        return np.flatnonzero(np.ascontiguousarray(marks.T).ravel()[:n])


def contractions(points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of apostrophes, and the length (2, 3 or 0) of the English contraction that each may begin."""
    at = np.flatnonzero(points == ord("'"))
    left = ends[np.searchsorted(ends, at, "right")] - at  # characters up to the end of the text
    padded = np.concatenate([points, np.zeros(2, np.uint32)])
    one, two = padded[at + 1], padded[at + 2]
    length = np.where((left > 1) & np.isin(one, [ord(c) for c in "stmd"]), 2, 0)
    pairs = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    return at, np.where((left > 2) & pairs, 3, length)


# Symbols
S_LETTER, S_NUMBER, S_OTHER, S_JOIN, S_LONE, S_INNER, S_SHORT, S_LONG = range(8)
# States
FREE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, JOINING, IN_WHITE, ONE_MORE, TWO_MORE = range(8)


def _step_with_spaces(state: int, symbol: int) -> tuple[int, bool]:
    """Pieces keep one leading space; other white space makes pieces of its own."""
    if symbol == S_JOIN:
        return JOINING, True
    if symbol == S_LONE:
        return FREE, True
    if symbol == S_INNER:
        return IN_WHITE, state != IN_WHITE
    if symbol in (S_SHORT, S_LONG) and state not in (JOINING, IN_OTHERS):
        return (ONE_MORE if symbol == S_SHORT else TWO_MORE), True
    if symbol == S_LETTER and state in (ONE_MORE, TWO_MORE):
        return (FREE if state == ONE_MORE else ONE_MORE), False
    into = {S_LETTER: IN_LETTERS, S_NUMBER: IN_NUMBERS}.get(symbol, IN_OTHERS)
    return into, state not in (into, JOINING)


def _step_words(state: int, symbol: int) -> tuple[int, bool]:
    """Pieces hold no white space (it starts a piece that is dropped), numbers stand alone."""
    if symbol in (S_JOIN, S_LONE, S_INNER):
        return IN_WHITE, state != IN_WHITE
    if symbol in (S_SHORT, S_LONG) and state != IN_OTHERS:
        return (ONE_MORE if symbol == S_SHORT else TWO_MORE), True
    if symbol == S_LETTER and state in (ONE_MORE, TWO_MORE):
        return (FREE if state == ONE_MORE else ONE_MORE), False
    if symbol == S_NUMBER:
        return FREE, True
    into = IN_LETTERS if symbol == S_LETTER else IN_OTHERS
    return into, state != into


@cache
def with_spaces() -> Automaton:
    return Automaton(8, 8, _step_with_spaces)


@cache
def words_only() -> Automaton:
    return Automaton(8, 8, _step_words)


_SYMBOL_OF_CLASS = np.array([S_LETTER, S_NUMBER, S_OTHER, S_INNER, S_INNER], np.uint8)


def symbols_of(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Symbols of the concatenated code points of texts that end (exclusively) at ``ends``, none empty."""
    classes = class_table()[points]
    white = classes >= SPACE
    solid_next = np.zeros(len(points), bool)
    np.logical_not(white[1:], out=solid_next[:-1])
    solid_next[ends - 1] = False
    out = _SYMBOL_OF_CLASS[classes]
    last = white & solid_next
    out[last & (classes == SPACE)] = S_JOIN
    out[last & (classes == WHITE)] = S_LONE
    at, length = contractions(points, ends)
    out[at[length == 2]] = S_SHORT
    out[at[length == 3]] = S_LONG
    starts = np.concatenate([[0], ends[:-1]])
    out[starts] += 8
    return out


def pieces_starts(points: np.ndarray, ends: np.ndarray, automaton: Automaton) -> np.ndarray:
    """Token starts (code point positions) of concatenated non-empty texts."""
    return automaton.token_starts(symbols_of(points, ends))
