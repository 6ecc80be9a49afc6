"""Paragraph removal against plain versions: lines by all pairs, passages by where they were planted, rows of odd ids."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandset.llm import substring_dedup as S

from .test_operators import ODD, near, sets_of, words
from .test_rows import documents


def similar(a, b):
    return a and b and len(a & b) >= 0.8 * len(a | b)


def test_lines_by_all_pairs(spark):
    rng = random.Random(40)
    pool = [words(rng, n) for n in (6, 7, 9, 12, 20, 30, 38)]
    docs = []
    for i in range(30):
        lines = [words(rng, rng.randrange(1, 12)) for _ in range(3)] + [near(rng, p, rng.randrange(2)) if rng.random() < 0.5 else p for p in rng.sample(pool, 3)]
        rng.shuffle(lines)
        docs.append((rng.choice([None, 1, 2, 3, 4, 5, 6]), "\n".join(lines) + "\n" * rng.randrange(2)))
    rows = docs + [(None, None), (1, ""), (2, "\n\n")]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.kept, tuple(r.component_ids)) for r in S.remove_paragraphs(documents(spark, rows)).collect())
    hashes = [r.h for r in documents(spark, rows).withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).collect()]
    places = [((i is None, i or 0, hashes[d], k), p) for d, (i, t) in enumerate(rows) for k, p in enumerate((t or "").split("\n")) if len(p.split()) >= 6]
    sets = [sets_of(p) for _, p in places]
    group = list(range(len(places)))
    for x in range(len(places)):
        for y in range(x):
            if similar(sets[x], sets[y]) and group[x] != group[y]:
                group = [group[y] if g == group[x] else g for g in group]
    first = {g: min(p for (p, _), h in zip(places, group) if h == g) for g in set(group)}
    of = {p: first[g] for (p, _), g in zip(places, group)}
    want = []
    for d, (i, t) in enumerate(rows):
        lines, kept, held = S.paragraphs(t), [], set()
        for k, line in enumerate(lines):
            at = (i is None, i or 0, hashes[d], k)
            if of.get(at, at) == at:
                kept.append(line)
            elif not of[at][0]:
                held.add(of[at][1])
        want.append((i is None, i or 0, "".join(kept), tuple(sorted(held))))
    assert got == sorted(want) and sum(len(w[2]) for w in want) < sum(len(t or "") for _, t in rows) - 500


def test_whole_passages_go(spark):
    """Inside longer lines the passage goes from its first word to its last, and nothing else."""
    rng = random.Random(41)
    planted = [words(rng, n) for n in (50, 64, 120, 300)]
    rows = [(i, f"{words(rng, 60 + rng.randrange(40))} {planted[i % 4]} {words(rng, 80)}") for i in range(40)] + [(100 + i, words(rng, 400)) for i in range(10)]
    got = {r.doc_id: r for r in S.remove_paragraphs(documents(spark, rows)).collect()}
    for i, t in rows:
        if i < 4 or i >= 100:
            assert got[i].kept == t and got[i].component_ids == []
        else:
            assert got[i].kept == t.replace(planted[i % 4] + " ", "") and got[i].component_ids[0] == i % 4 and got[i].n_spans == 1


def test_repeats_inside_a_document_and_odd_ids(spark):
    rng = random.Random(42)
    p, q = words(rng, 90), words(rng, 70)
    inside = f"{words(rng, 50)} {p} {words(rng, 50)} {p} {words(rng, 50)}"
    rows = [(5, inside), (5, f"{words(rng, 50)} {q} {words(rng, 40)}"), (None, f"{words(rng, 40)} {q} {words(rng, 60)}"), (5, words(rng, 200)), (7, "ab " * 3000), (8, words(rng, 30) + " " + " ".join(["one two three four five six"] * 40))]
    rows += [(9, words(rng, 120))] * 2
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.kept) for r in S.remove_paragraphs(documents(spark, rows)).collect())
    a, b = inside.index(p), inside.rindex(p)
    want = [(i or 0, len(t), 0, t) for i, t in rows]
    want[0] = (5, len(inside), len(p) + 1, inside[:b] + inside[b + len(p) + 1 :])
    want[2] = (0, len(rows[2][1]), len(q) + 1, rows[2][1].replace(q + " ", ""))
    # what repeats itself with a short period goes in part, but never what stands before it
    loose = [g for g in got if g[0] == 8][0]
    assert a < b and loose[3].startswith(rows[5][1][:100])
    assert [g for g in got if g[0] != 8] == sorted(w for w in want if w[0] != 8)


def test_near_passages():
    """reach() against a plain search of all passages around the stretch."""
    rng = np.random.default_rng(43)
    width = S.CORE + 2 * S.APART
    x = rng.integers(0, 1 << 32, (300, width), np.uint32)
    y = x.copy()
    for i in range(300):
        at = rng.choice(width, rng.integers(0, 5), replace=False)
        y[i, at[(at < S.APART) | (at >= S.APART + S.CORE) | (i % 10 == 0)]] ^= np.uint32(1)
    before, after = rng.integers(0, S.APART + 1, 300), rng.integers(0, S.APART + 1, 300)
    left, right = S.reach(x, y, before, after, 0.8)
    for i in range(300):
        best = -1
        for a in range(before[i] + 1):
            for b in range(after[i] + 1):
                lo, hi = S.APART - a, S.APART + S.CORE + b
                shingles = [(tuple(x[i, k : k + 5]), tuple(y[i, k : k + 5])) for k in range(lo, hi - 4)]
                common, n = sum(u == v for u, v in shingles), len(shingles)
                ends = shingles[0][0] == shingles[0][1] and shingles[-1][0] == shingles[-1][1]
                if ends and common / (2 * n - common) >= 0.8 - 1e-9 and (x[i, S.APART : S.APART + S.CORE] == y[i, S.APART : S.APART + S.CORE]).all():
                    best = max(best, a + b)
        assert (left[i] + right[i] if left[i] >= 0 else -1) == best


def test_a_changed_word_inside_a_passage(spark):
    rng = random.Random(44)
    own = words(rng, 160).split()
    changed = own[:70] + ["changed"] + own[71:]
    rows = [(1, f"{words(rng, 50)} {' '.join(own)} {words(rng, 50)}"), (2, f"{words(rng, 50)} {' '.join(changed)} {words(rng, 50)}")]
    got = {r.doc_id: r for r in S.remove_paragraphs(documents(spark, rows)).collect()}
    assert got[1].n_removed == 0 and len(got[2].kept.split()) <= 101


@pytest.mark.parametrize("empty", [True, False])
def test_stage_keeps_columns(spark, empty):
    rng = random.Random(45)
    line = words(rng, 30)
    docs = documents(spark, [(1, line), (1, line + "\n" + words(rng, 8)), (None, ODD[5]), (2, line), (3, None)]).withColumn("kept", F.lit("x"))
    out = S.stage_substring(spark, docs.limit(0) if empty else docs, "")
    assert out.columns == docs.columns
    rows = sorted((r.doc_id or 0, r.n_chars, r.kept) for r in out.collect())
    assert rows == ([] if empty else rows) and (empty or (len(rows) == 4 and {r[0] for r in rows} == {0, 1, 3}))
