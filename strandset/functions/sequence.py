"""K-mers, hashes and sketches of whole batches of sequences in numpy.

All functions see the sequences of a batch as one run of base numbers (A, C, G, T are 0 to 3, anything else 4) and
give values for every place; places whose window crosses a sequence or holds another letter are masked by valid().
"""

from __future__ import annotations

import numpy as np

#: The published ntHash seeds of A, C, G and T.
SEEDS = np.array([0x3C8BFBB395C60474, 0x3193C18562A02B4C, 0x20323ED082572324, 0x295549F54BE24456, 0], np.uint64)
RC_SEEDS = np.array([*SEEDS[3::-1], 0], np.uint64)
_BASE = np.full(256, 4, np.uint8)
for _i, _c in enumerate("ACGT"):
    _BASE[ord(_c)] = _BASE[ord(_c.lower())] = _i


def bases(data: bytes) -> np.ndarray:
    return _BASE[np.frombuffer(data, np.uint8)]


def valid(base: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    """Starts of the windows of k bases that lie in one sequence and hold no other letter."""
    n = len(base) - k + 1
    if n <= 0:
        return np.empty(0, np.int64)
    odd = np.concatenate(([0], np.cumsum(base > 3)))
    owner_end = ends[np.searchsorted(ends, np.arange(n), side="right")]
    return np.flatnonzero((odd[k:] == odd[:-k]) & (np.arange(n) + k <= owner_end))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    r %= 64
    return x if r == 0 else (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def codes(base: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(code, code of the reverse complement) at every place, by joining windows of doubling length."""
    b = (base & 3).astype(np.uint64)
    fwd, rev, out_f, out_r, done, size = b, np.uint64(3) - b, None, None, 0, 1
    rest = k
    while rest:
        if rest & 1:
            if out_f is None:
                out_f, out_r = fwd, rev
            else:
                n = len(base) - done - size + 1
                out_r = out_r[:n] | (rev[done : done + n] << np.uint64(2 * done))
                out_f = (out_f[:n] << np.uint64(2 * size)) | fwd[done : done + n]
            done += size
        rest >>= 1
        if rest:
            n = len(fwd) - size
            rev = rev[:n] | (rev[size:] << np.uint64(2 * size))
            fwd = (fwd[:n] << np.uint64(2 * size)) | fwd[size:]
            size *= 2
    return out_f, out_r


def nthash(base: np.ndarray, k: int) -> np.ndarray:
    """Canonical ntHash at every place, the lesser of both strands' hashes, by joining windows of doubling length."""
    fwd, rev = SEEDS[base], RC_SEEDS[base]
    out_f, out_r, done, size, rest = None, None, 0, 1, k
    while rest:
        if rest & 1:
            if out_f is None:
                out_f, out_r = fwd, rev
            else:
                n = len(base) - done - size + 1
                out_f = _rotl(out_f[:n], size) ^ fwd[done : done + n]
                out_r = out_r[:n] ^ _rotl(rev[done : done + n], done)
            done += size
        rest >>= 1
        if rest:
            n = len(fwd) - size
            fwd = _rotl(fwd[:n], size) ^ fwd[size:]
            rev = rev[:n] ^ _rotl(rev[size:], size)
            size *= 2
    return np.minimum(out_f, out_r)


def _least(values: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(least, place) of each w neighbouring values, the leftmost of equals, by joining windows of doubling length."""
    low, at, out, out_at, done, size, rest = values, np.arange(len(values)), None, None, 0, 1, w
    join = lambda a, i, b, j: (np.minimum(a, b), np.where(a <= b, i, j))
    while rest:
        if rest & 1:
            if out is None:
                out, out_at = low, at
            else:
                n = len(values) - done - size + 1
                out, out_at = join(out[:n], out_at[:n], low[done : done + n], at[done : done + n])
            done += size
        rest >>= 1
        if rest:
            n = len(low) - size
            low, at = join(low[:n], at[:n], low[size:], at[size:])
            size *= 2
    return out, out_at


def minimizers(hashes: np.ndarray, starts: np.ndarray, owner: np.ndarray, w: int) -> np.ndarray:
    """Indexes into starts of the least hash of each w neighbouring k-mers of a sequence; the leftmost of equals, each place once."""
    if len(starts) < w:
        return np.empty(0, np.int64)
    at = _least(hashes[starts], w)[1]
    whole = (starts[w - 1 :] - starts[: len(at)] == w - 1) & (owner[w - 1 :] == owner[: len(at)])
    picked = np.zeros(len(starts), bool)
    picked[at[whole]] = True
    return np.flatnonzero(picked)


def syncmers(base: np.ndarray, starts: np.ndarray, k: int, s: int) -> np.ndarray:
    """Indexes into starts of the closed syncmers: k-mers whose least s-mer hash stands first or last."""
    small = nthash(base, s)
    span = k - s + 1
    low = _least(small, span)[0][starts]
    return np.flatnonzero((small[starts] == low) | (small[starts + span - 1] == low))
