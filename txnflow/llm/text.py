"""Words and hashes of one text, as arrays. All of it runs inside tasks, on one document at a time.

A word or window is known by a 64-bit hash: sums of mixed values times powers of an odd base, taken from
running totals, so that every window of a text costs the same however long it is.
"""

from functools import cache

import numpy as np

_CHAR_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xC2B2AE3D27D4EB4F
_powers: dict[int, np.ndarray] = {}


@cache
def inverse_of(base: int) -> int:
    return pow(base, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """``base`` to 0 .. n-1 modulo 2^64; the table grows with the longest text seen."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        table = np.full(max(n, 4096), base, np.uint64)
        table[0] = 1
        _powers[base] = known = np.multiply.accumulate(table)
    return known[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sums_between(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of ``values[s:e]`` for each span; equal contents have equal hashes wherever they stand."""
    n = len(values)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(base, n), out=total[1:])
    inverse = powers(inverse_of(base), n + 1)
    return mixed((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def code_points(text: str | None) -> np.ndarray:
    """The text's code points; a missing text has none."""
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)


def lower_ascii(points: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all else as it is."""
    return np.where((points >= 65) & (points <= 90), points + np.uint32(32), points)


def is_space(points: np.ndarray) -> np.ndarray:
    """Space and the controls 9 to 13."""
    return (points == 32) | ((points >= 9) & (points <= 13))


def is_ascii_break(points: np.ndarray) -> np.ndarray:
    """Every ASCII character but digits and letters; call it on lower-cased code points."""
    return (points < 128) & ~(((points >= 48) & (points <= 57)) | ((points >= 97) & (points <= 122)))


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of True."""
    edges = np.flatnonzero(np.diff(mask, prepend=False, append=False))
    return edges[::2], edges[1::2]


def span_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the characters of each span."""
    return sums_between(mixed(points.astype(np.uint64) + np.uint64(1)), starts, ends, _CHAR_BASE)


def words(text: str | None, lower: bool = True, breaks=is_space) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of a text's words, in code points."""
    points = code_points(text)
    if lower:
        points = lower_ascii(points)
    starts, ends = runs(~breaks(points))
    return span_hashes(points, starts, ends), starts, ends


def windows(hashes: np.ndarray, size: int, base: int = _WORD_BASE) -> np.ndarray:
    """A hash of each ``size`` consecutive words, one for every start; none if there are fewer words."""
    starts = np.arange(max(0, len(hashes) - size + 1))
    return sums_between(hashes, starts, starts + size, base)


def whole(hashes: np.ndarray) -> np.ndarray:
    """One hash of all words together."""
    return sums_between(hashes, np.array([0]), np.array([len(hashes)]), _WORD_BASE)
