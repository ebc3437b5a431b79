"""Fingerprints of all windows of a file's tokens: prefix polynomials, so that a window costs two look-ups whatever its size."""

from __future__ import annotations

import numpy as np

#: Tokens are the runs between these bytes; the line break counts lines.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Odd bases of the polynomials modulo 2^64: of a token's bytes, two of a window's tokens, and one of parts of windows.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base to the powers 0 to n - 1, kept for the next file."""
    if base not in _powers or len(_powers[base]) < n:
        size = max(1024, 2 * n)
        _powers[base] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)]), dtype=np.uint64)
    return _powers[base][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _slices(values: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A fingerprint of values[start:end] for each pair of bounds; equal slices have equal ones wherever they stand."""
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * _power(base, len(values)), dtype=np.uint64)])
    inverse = _power(pow(base, -1, 1 << 64), len(values) + 1)
    return _mix((prefix[ends] - prefix[starts]) * inverse[starts])


def token_places(code: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, lines) of the tokens; lines count from 1."""
    raw = np.frombuffer(code + b"\n", np.uint8)
    edge = np.flatnonzero(np.diff(_SPACE[raw], prepend=True))
    starts, ends = edge[::2], edge[1::2]
    return starts, ends, (np.cumsum(raw == 10, dtype=np.int64)[starts] + 1)


def run_ends(lines: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Of each token the end (exclusive) of its run; of tokens on the lines of spans, which belong to no run, 0."""
    inside = np.zeros(len(lines), bool)
    for first, last in spans:
        inside[np.searchsorted(lines, first, "left") : np.searchsorted(lines, last, "right")] = True
    borders = np.append(np.flatnonzero(inside), len(lines))
    return np.where(inside, 0, borders[np.searchsorted(borders, np.arange(len(lines)), "left")])


def _marks(values: np.ndarray, width: int) -> np.ndarray:
    """Of each run of width values the place of its first smallest one."""
    return np.arange(len(values) - width + 1) + np.lib.stride_tricks.sliding_window_view(values, width).argmin(axis=1)


def _minimizers(tokens: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints of the parts of half a window that begin at each token, and of each window the place of the part with the smallest one).

    Equal windows have equal such parts at equal distances, so a window that occurs twice has a part that is chosen at
    two places. Windows that follow each other mostly choose the same place: about 4 in size tokens are chosen.
    """
    part = (size + 1) // 2
    if len(tokens) < size:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    at = np.arange(len(tokens) - part + 1)
    values = _slices(tokens, BASES[3], at, at + part)
    pieces = [_marks(values[i : i + (1 << 16) + size - part], size - part + 1) + i for i in range(0, len(tokens) - size + 1, 1 << 16)]
    return values, np.concatenate(pieces)


def minimizers(code: bytes, size: int, spans: list[tuple[int, int]] = ()) -> np.ndarray:
    """The fingerprint of each part that a window of size tokens inside a run chooses, once a place."""
    starts, ends, lines = token_places(code)
    tokens = _slices(np.frombuffer(code, np.uint8).astype(np.uint64) + np.uint64(1), BASES[0], starts, ends)
    values, chosen = _minimizers(tokens, size)
    inside = np.arange(len(chosen)) + size <= run_ends(lines, spans)[: len(chosen)]
    return values[np.unique(chosen[inside])]


def has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys' first bits are set in a bitmap of a power of two of bits."""
    place = keys >> np.uint64(64 - (8 * len(bits) - 1).bit_length())
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def windows(code: bytes, size: int, spans: list[tuple[int, int]] = (), wanted: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Of each window of size tokens inside a run: place (of its first token, from 1), line, end_line, last (place of the run's last token), prev (31 bits of the token before, from 1; 0 at the beginning of the file), a and b.

    wanted is a bitmap of minimizers: windows that chose others are left out.
    """
    starts, ends, lines = token_places(code)
    raw = np.frombuffer(code, np.uint8).astype(np.uint64) + np.uint64(1)
    tokens = _slices(raw, BASES[0], starts, ends)
    stop = run_ends(lines, spans)
    inside = np.arange(len(tokens)) + size <= stop
    if wanted is not None:
        values, chosen = _minimizers(tokens, size)
        inside[: len(chosen)] &= has(wanted, values[chosen])
    at = np.flatnonzero(inside)
    before = (np.append(np.uint64(0), _mix(tokens) >> np.uint64(33)) + np.uint64(1)).astype(np.int64)[at]
    found = {"place": at + 1, "line": lines[at], "end_line": lines[at + size - 1], "last": stop[at], "prev": np.where(at > 0, before, 0)}
    return found | {name: _slices(tokens, base, at, at + size).view(np.int64) for name, base in zip("ab", BASES[1:3])}


def kept(found: dict[str, np.ndarray], size: int, least_lines: int) -> np.ndarray:
    """Which windows of a file stretch over least_lines lines or more and, of those alike, do not overlap, taken greedily from the left."""
    out = found["end_line"] - found["line"] + 1 >= least_lines
    at = np.flatnonzero(out)
    order = at[np.lexsort((found["b"][at], found["a"][at]))]  # stable: places stay in order
    same = (found["a"][order][1:] == found["a"][order][:-1]) & (found["b"][order][1:] == found["b"][order][:-1])
    until = 0
    for i in (np.flatnonzero(same) + 1).tolist():
        here = order[i]
        if i < 2 or not same[i - 2]:  # the one before is the first of those alike
            until = found["place"][order[i - 1]] + size
        if found["place"][here] < until:
            out[here] = False
        else:
            until = found["place"][here] + size
    return out


def chains(places: np.ndarray, keys: np.ndarray, at: np.ndarray, levels: int) -> list[np.ndarray]:
    """Of each level j the fingerprints of the 2^j windows behind those at the places at, and 0 where they do not follow each other; keys are of the windows at places."""
    i = np.searchsorted(places, at)
    out = []
    for j in range(levels):
        end = i + (1 << j)
        there = np.flatnonzero(end < len(places))
        there = there[places[end[there]] == at[there] + (1 << j)]
        d = np.zeros(len(at), np.uint64)
        d[there] = np.maximum(_slices(_mix(keys.view(np.uint64)), BASES[1], i[there] + 1, end[there] + 1), np.uint64(1))
        out.append(d.view(np.int64))
    return out
