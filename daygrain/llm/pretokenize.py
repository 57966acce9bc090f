"""Vectorised pre-tokenisation for byte-level BPE: where the usual pattern splits a text, without a regex.

The split depends on a left-to-right automaton over codepoint classes. Each class acts on the automaton's
states as a function, and the functions that can arise from sequences of classes are few, so they are
numbered once and composed by one table lookup. Composition is associative: blocks of the text are reduced
side by side, a doubling scan over the blocks gives the state at the start of each, and a second pass over
all blocks at once marks the boundaries.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np

# fixed values: the code points with the Unicode property White_Space
WHITE_SPACE = (
    *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)

# classes of code points, refined by what follows
SPACE_BEFORE, WHITE_BEFORE, WHITE, LETTER, NUMBER, OTHER, QUOTE_1, QUOTE_2 = range(8)
CLASSES = 8
# states: nothing open, in letters, in numbers, in other characters, in white space, after a space that
# belongs to what follows, and one or two letters of a contraction to come
FREE, LETTERS, NUMBERS, OTHERS, WHITES, PREFIX, ONE_MORE, TWO_MORE = range(8)
STATES = 8
BLOCK = 128
LONG = 1 << 20


@functools.cache
def codepoint_classes() -> np.ndarray:
    """WHITE, LETTER, NUMBER or OTHER for every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)], np.uint8)
    table[list(WHITE_SPACE)] = WHITE
    return table


def _step(state: int, kind: int) -> tuple[int, bool]:
    """Next state, and whether a token starts at this character."""
    if kind == SPACE_BEFORE:
        return PREFIX, True
    if kind == WHITE_BEFORE:
        return FREE, True
    if kind == WHITE:
        return WHITES, state != WHITES
    if kind == LETTER and state in (ONE_MORE, TWO_MORE):
        return (FREE if state == ONE_MORE else ONE_MORE), False
    if kind in (QUOTE_1, QUOTE_2) and state not in (OTHERS, PREFIX):
        return (ONE_MORE if kind == QUOTE_1 else TWO_MORE), True
    run = {LETTER: LETTERS, NUMBER: NUMBERS}.get(kind, OTHERS)
    return run, state not in (run, PREFIX)


@functools.cache
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The functions on states that inputs and sequences of inputs have, numbered, and the single steps.

    Returns ``compose[f, g]`` (f, then g), ``extend[f, input]``, ``functions[f, state]``,
    ``next_state[state, input]`` and ``starts[state, input]``. Inputs ``CLASSES + k`` are the first character
    of a text, of class k: they act as from state FREE.
    """
    inputs = range(2 * CLASSES)
    steps = [[_step(s if c < CLASSES else FREE, c % CLASSES) for c in inputs] for s in range(STATES)]
    of_input = [tuple(steps[s][c][0] for s in range(STATES)) for c in inputs]
    functions = list(dict.fromkeys([tuple(range(STATES)), *of_input]))
    for f in functions:  # grows until it is closed under composition
        for g in of_input:
            composed = tuple(g[s] for s in f)
            if composed not in functions:
                functions.append(composed)
    number = {f: i for i, f in enumerate(functions)}
    compose = np.array([[number[tuple(g[s] for s in f)] for g in functions] for f in functions], np.uint8)
    extend = compose[:, [number[g] for g in of_input]]
    next_state = np.array([[step[0] for step in row] for row in steps], np.uint8)
    starts = np.array([[step[1] for step in row] for row in steps], np.uint8)
    return compose, extend, np.array(functions, np.uint8), next_state, starts


def inputs_of(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Automaton inputs of concatenated texts that end before ``ends``."""
    kinds = codepoint_classes()[codes]
    ends = np.unique(ends[ends > 0])
    follows = np.ones(len(codes), bool)  # a character that is not white space follows
    follows[:-1] = kinds[1:] != WHITE
    follows[ends - 1] = False
    white = kinds == WHITE
    out = kinds.copy()
    out[white & follows] = WHITE_BEFORE
    out[white & follows & (codes == 0x20)] = SPACE_BEFORE
    quotes = np.flatnonzero(codes == 0x27)
    if len(quotes):
        stop = ends[np.searchsorted(ends, quotes, side="right")]
        padded = np.concatenate([codes, np.zeros(2, codes.dtype)])
        one, two = padded[quotes + 1], padded[quotes + 2]
        single = (quotes + 1 < stop) & np.isin(one, [ord(c) for c in "stmd"])
        double = (quotes + 2 < stop) & (
            (np.isin(one, [ord("r"), ord("v")]) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        )
        out[quotes[single]] = QUOTE_1
        out[quotes[double]] = QUOTE_2
    firsts = np.concatenate([[0], ends[:-1]])
    out[firsts] += CLASSES
    return out


def token_starts(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Indices at which tokens start in concatenated texts."""
    n = len(codes)
    if n == 0:
        return np.zeros(0, np.int64)
    compose, extend, functions, next_state, starts = automaton()
    rows = -(-n // BLOCK)
    padded = np.zeros(rows * BLOCK, np.uint8)
    padded[:n] = inputs_of(codes, ends)
    columns = np.ascontiguousarray(padded.reshape(rows, BLOCK).T)
    # the function of every block, all blocks side by side
    flat = extend.ravel()
    whole = np.zeros(rows, np.intp)
    for column in columns:
        whole = flat.take(whole * (2 * CLASSES) + column).astype(np.intp)
    # doubling scan: the function of all blocks up to and including each
    reach = 1
    while reach < rows:
        whole[reach:] = compose[whole[:-reach].copy(), whole[reach:]]
        reach *= 2
    state = np.zeros(rows, np.intp)
    state[1:] = functions[whole[:-1], FREE]
    marks = np.empty((BLOCK, rows), np.uint8)
    flat_next, flat_starts = next_state.ravel(), starts.ravel()
    for j, column in enumerate(columns):
        at = state * (2 * CLASSES) + column
        flat_starts.take(at, out=marks[j])
        state = flat_next.take(at).astype(np.intp)
    return np.flatnonzero(np.ascontiguousarray(marks.T).ravel()[:n])


def pieces(text: str, longest: int = LONG) -> list[str]:
    """The text in pieces of about ``longest`` characters that can be split into tokens one by one.

    Cuts are made only before a single space between two other characters, where a token starts whatever
    comes before; a text without such a place stays whole.
    """
    out, begin = [], 0
    while len(text) - begin > longest:
        cut = text.find(" ", begin + longest)
        while 0 < cut < len(text) - 1 and (text[cut - 1].isspace() or text[cut + 1].isspace()):
            cut = text.find(" ", cut + 1)
        if not 0 < cut < len(text) - 1:
            break
        out.append(text[begin:cut])
        begin = cut
    out.append(text[begin:])
    return out


def split_tokens(texts: list[str]) -> list[list[str]]:
    """The tokens of every text."""
    joined = "".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64) if texts else np.zeros(0, np.int64)
    starts = token_starts(codes, ends)
    bounds = np.searchsorted(starts, ends).tolist()
    at = starts.tolist()
    words = [joined[a:b] for a, b in zip(at, [*at[1:], len(joined)])]
    out, begin = [], 0
    for end in bounds:
        out.append(words[begin:end])
        begin = end
    return out
