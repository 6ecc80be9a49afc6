"""Hashes and sketches against plain loops, and how often windows are turned."""

import random

import numpy as np
import pytest

from strandset.functions import sequence as S
from strandset.operators.count import unique_counts


def plain_hash(base, k):
    turn = lambda x, r: (x << r % 64 | x >> 64 - r % 64) & (1 << 64) - 1
    seeds = [int(x) for x in S.SEEDS]
    out = []
    for i in range(len(base) - k + 1):
        fwd = rev = 0
        for j in range(k):
            b = int(base[i + j])
            fwd ^= turn(seeds[b], k - 1 - j)
            rev ^= turn(seeds[3 - b] if b < 4 else 0, j)
        out.append(min(fwd, rev))
    return out


@pytest.mark.parametrize("k", [1, 2, 3, 16, 23, 31, 64, 70])
def test_hash_is_a_plain_walk(k, monkeypatch):
    base = np.random.default_rng(k).integers(0, 5, 90).astype(np.uint8)
    turns, rotl = [], S._rotl
    monkeypatch.setattr(S, "_rotl", lambda x, r: turns.append(r) or rotl(x, r))
    assert S.nthash(base, k).tolist() == plain_hash(base, k)
    assert len(turns) <= 4 * k.bit_length()


@pytest.mark.parametrize("w", [1, 2, 7, 15])
def test_sketches_are_plain_walks(w):
    rng = random.Random(w)
    k, n = 9, 300
    base = np.array([rng.choice([0, 0, 1, 2, 3]) for _ in range(n)], np.uint8)
    base[150] = 4
    ends = np.array([3, 100, 220, n])
    starts = S.valid(base, ends, k)
    owner = np.searchsorted(ends, starts, side="right")
    h = S.nthash(base, k) % np.uint64(50)
    want = set()
    for i in range(len(starts) - w + 1):
        if starts[i + w - 1] - starts[i] == w - 1 and owner[i] == owner[i + w - 1]:
            want.add(min(range(i, i + w), key=lambda j: (h[starts[j]], j)))
    assert S.minimizers(h, starts, owner, w).tolist() == sorted(want)
    s = 1 + w % k
    small = S.nthash(base, s)
    ends_low = [i for i, a in enumerate(starts) if min(small[a : a + k - s + 1]) in (small[a], small[a + k - s])]
    assert S.syncmers(base, starts, k, s).tolist() == ends_low


@pytest.mark.parametrize("groups", [1, 20, 5000])
def test_counts_of_wide_codes(groups):
    rng = np.random.default_rng(groups)
    code, group = rng.integers(0, 40, 9000).astype(np.uint64) << np.uint64(58), rng.integers(0, groups, 9000)
    want = {}
    for x in zip(code.tolist(), group.tolist()):
        want[x] = want.get(x, 0) + 1
    a, b, n = unique_counts(code, group)
    assert dict(zip(zip(a.tolist(), b.tolist()), n.tolist())) == want and len(a) == len(want)
