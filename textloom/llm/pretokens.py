r"""The byte-level pretokenizer as a small automaton.

It splits text as ``'s|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?P+|S+(?!\S)|S+`` does, with
letters L, numbers N, white space S and the rest P. It reads a symbol per
character and marks where a pretoken begins. Chunks of text run in step: a chunk
first yields the map from each state before it to the state behind it, a parallel
prefix scan composes the maps, and the chunks run again from the states found.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np

#: White space of the pattern.
_WHITE = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Symbols: letter, number, rest, an apostrophe before a contraction of one or
#: two letters, a blank or another white space right before something else, and
#: white space before more of it or the end. Plus 8 at the start of a text.
_L, _N, _P, _AP1, _AP2, _BLANK, _LAST, _WS = range(8)
#: States: next character begins anew, in letters, in numbers, in the rest,
#: behind a blank that joins what follows, in white space, one or two letters of
#: a contraction to come.
_NEW, _IN_L, _IN_N, _IN_P, _JOIN, _IN_WS, _ONE, _TWO = range(8)

CHUNK = 128


@functools.cache
def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """next[state, symbol] and begins[state, symbol]."""
    anew = {_L: _IN_L, _N: _IN_N, _P: _IN_P, _AP1: _ONE, _AP2: _TWO, _BLANK: _JOIN, _LAST: _NEW, _WS: _IN_WS}
    goes_on = {
        _IN_L: {_L: _IN_L},
        _IN_N: {_N: _IN_N},
        _IN_P: {_P: _IN_P, _AP1: _IN_P, _AP2: _IN_P},
        _JOIN: {_L: _IN_L, _N: _IN_N, _P: _IN_P, _AP1: _IN_P, _AP2: _IN_P},
        _IN_WS: {_WS: _IN_WS},
        _ONE: dict.fromkeys(range(8), _NEW),
        _TWO: dict.fromkeys(range(8), _ONE),
    }
    after, begins = np.zeros((8, 16), np.uint8), np.ones((8, 16), bool)
    for state in range(8):
        for symbol in range(8):
            after[state, symbol] = after[state, symbol + 8] = anew[symbol]
            if symbol in goes_on.get(state, {}):
                after[state, symbol] = goes_on[state][symbol]
                begins[state, symbol] = False
    return after, begins


@functools.cache
def _kinds() -> np.ndarray:
    """_L, _N, _P or _WS for every code point."""
    table = np.full(sys.maxunicode + 1, _P, np.uint8)
    first = [unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)]
    table[[c for c, k in enumerate(first) if k == "L"]] = _L
    table[[c for c, k in enumerate(first) if k == "N"]] = _N
    table[list(_WHITE)] = _WS
    return table


def symbols(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The automaton's input for code points of texts that begin at ``starts``."""
    n = len(points)
    kind = _kinds()[points]
    head = np.zeros(n + 3, bool)
    head[starts] = True
    head[n:] = True
    ahead = np.full(n + 2, -1, np.int32)
    ahead[:n] = points
    one, two = ahead[1 : n + 1].copy(), ahead[2 : n + 2].copy()
    one[head[1 : n + 1]] = -1
    two[head[1 : n + 1] | head[2 : n + 2]] = -1
    out = kind.copy()
    white = kind == _WS
    follows = np.full(n, _WS, np.uint8)
    follows[:-1] = kind[1:]
    follows[head[1 : n + 1]] = _WS
    last = white & (follows != _WS)
    out[last] = np.where(points[last] == 0x20, _BLANK, _LAST)
    for i in np.flatnonzero(points == ord("'")):
        if one[i] >= 0 and chr(one[i]) in "stmd":
            out[i] = _AP1
        elif one[i] >= 0 and two[i] >= 0 and chr(one[i]) + chr(two[i]) in ("re", "ve", "ll"):
            out[i] = _AP2
    out[head[:n]] += 8
    return out


def composed(maps: np.ndarray) -> np.ndarray:
    """Inclusive parallel prefix scan: row i becomes the map over chunks 0 to i."""
    maps = maps.copy()
    step = 1
    while step < len(maps):
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), 1)
        step *= 2
    return maps


def begins(points: np.ndarray, starts: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Whether a pretoken begins at each code point."""
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    after, new = _automaton()
    lanes = -(-n // chunk)
    tape = np.zeros(lanes * chunk, np.uint8)
    tape[:n] = symbols(points, starts)
    tape = np.ascontiguousarray(tape.reshape(lanes, chunk).T)
    flat = after.ravel()
    maps = np.repeat(np.arange(8, dtype=np.uint8)[None], lanes, 0)
    for column in tape:
        maps = flat[(maps.astype(np.intp) << 4) + column[:, None]]
    state = np.zeros(lanes, np.uint8)
    state[1:] = composed(maps)[:-1, _NEW]
    out = np.empty((chunk, lanes), bool)
    for i, column in enumerate(tape):
        at = (state.astype(np.intp) << 4) + column
        out[i] = new.ravel()[at]
        state = flat[at]
    return out.T.ravel()[:n]


def byte_begins(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether a pretoken begins at each byte of texts in UTF-8 at ``offsets``."""
    lead = (data & 0xC0) != 0x80
    places = np.flatnonzero(lead)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    starts = np.searchsorted(places, offsets[:-1])
    out = np.zeros(len(data), bool)
    out[places] = begins(points, starts[starts < len(points)])
    return out
