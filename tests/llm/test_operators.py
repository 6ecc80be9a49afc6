"""The training-data operators against brute force, libraries, round trips and held-out accuracy, on small and odd tables."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandset.llm import ann, bpe, embedding_dedup, jaccard_join, langid, lm, packing, substring_dedup, suffix_dedup, toxicity
from strandset.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "\n\n", "a", "x" * 5000, "ab " * 4000, "é ñ ß 漢字 😀", "<|endoftext|> b", "tab\tand\x85　more  ", "Same line again and again.", "Same line again and again."]


def words(rng, n, alphabet="abcdefghij"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randrange(2, 6))) for _ in range(n))


def frame(spark, texts, langs=None):
    rows = [(i, t, langs[i] if langs else None, None, None) for i, t in enumerate(texts)]
    # columns of names that operators use inside must not matter
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in ("id", "set", "n", "score", "block", "length")})


def empty(spark):
    return frame(spark, ["x"]).limit(0)


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.tokenizer_path(name))


def test_bpe(spark):
    rng = random.Random(1)
    texts = ODD + [words(rng, 50, "abc déñ,.'12\n ") for _ in range(20)] + ["don't I'll  we've\n\n x"]
    lib = library("byte_bpe_50k.json")
    full = {r.doc_id: r for r in bpe.bpe_round_trip(frame(spark, texts)).collect()}
    short = {r.doc_id: r for r in bpe.bpe_round_trip(frame(spark, texts), digests=True).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert full[i].ids == ids and full[i].decoded == lib.decode(ids, skip_special_tokens=False) == (t or "")
        assert short[i].n_tokens == len(ids) and short[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert short[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.bpe_round_trip(empty(spark)).count() == 0


def test_packing(spark):
    rng = random.Random(2)
    texts = ODD + [words(rng, rng.randrange(1, 900)) for _ in range(60)] + [words(rng, 6000)]
    lib = library("word_bpe_49k.json")
    rows = packing.pack_pieces(packing.token_pieces(frame(spark, texts))).collect()
    of = collections.defaultdict(list)
    for r in rows:
        of[r.doc_id].append(r)
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [1]
        got = sorted(of[i], key=lambda r: r.piece)
        assert [x for r in got for x in r.ids] == ids and [r.start for r in got] == list(range(0, len(ids), 4096)) and all(r.length == 4096 for r in got[:-1])
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= math.ceil(sum(r.length for r in rows) / 4096) + 1
    assert packing.pack_pieces(packing.token_pieces(empty(spark))).count() == 0
    whole = packing.packed_sequences(packing.pack_pieces(packing.token_pieces(frame(spark, texts)))).collect()
    assert sum(len(r.ids) for r in whole) == sum(r.length for r in rows)


def test_plan_of_many(monkeypatch):
    counts = np.zeros(101, np.int64)
    counts[[3, 20, 47, 100]] = [900, 333, 501, 7]
    monkeypatch.setattr(packing, "PLAN", 200)  # so that plans are copied
    plan = packing.Plan(counts, 100)
    fill = collections.defaultdict(list)
    for n in np.flatnonzero(counts):
        s, o = plan.places(np.full(counts[n], n), np.arange(counts[n]))
        for a, b in zip(s.tolist(), o.tolist()):
            fill[a].append((b, int(n)))
    assert len(fill) == plan.sequences and sum(map(len, fill.values())) == counts.sum()
    assert all(sum(n for _, n in p) <= 100 and all(a + n == b for (a, n), (b, _) in zip(sorted(p), sorted(p)[1:])) for p in fill.values())


def test_langid(spark):
    rng = random.Random(3)
    texts = [words(rng, 60, "abcde" if i % 2 else "vwxyz") for i in range(80)] + [None, "", "12 34", "eda"]
    df = frame(spark, texts, ["aa" if i % 2 else "zz" for i in range(80)] + [None] * 4)
    profiles = langid.learn_profiles(df.where(~langid.held_out()))
    got = {r.doc_id: r for r in langid.identify(df, profiles).collect()}
    assert all(got[i].lang_pred == ("aa" if i % 2 else "zz") for i in range(80)) and got[83].lang_pred == "aa"
    assert [got[i].lang_pred for i in (80, 81, 82)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in got.values())
    none = langid.learn_profiles(empty(spark))
    assert {r.lang_pred for r in langid.identify(df, none).collect()} == {"und"} and langid.identify(empty(spark), none).count() == 0


def test_toxicity(spark):
    rng = random.Random(4)
    bad = [i % 4 == 0 for i in range(400)]
    texts = [words(rng, 40) + (" vile! " if b else " fine. ") + words(rng, 40) for b in bad] + [None, ""]
    df = frame(spark, texts)
    labels = spark.createDataFrame([(i, int(b)) for i, b in enumerate(bad)] + [(5000, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.fit(toxicity.labelled_documents(df.where(~toxicity.held_out()), labels))
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    assert sum(got[i].predicted == b for i, b in enumerate(bad)) >= 390 and len(got) == 402 and got[400].score == got[401].score
    blank = toxicity.fit(toxicity.labelled_documents(empty(spark), labels))
    assert {r.score for r in toxicity.score(df, blank).collect()} == {0.5}


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(1) for c in ("id", "v", "rep", "same", "cell")})


def noise(rng, n, d=16):
    return [[rng.gauss(0, 1) for _ in range(d)] for _ in range(n)]


BAD = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] * 16, [], [1.0, 2.0]]


def test_nearest(spark):
    rng = random.Random(6)
    own = noise(rng, 700)
    own += [own[3]] * 30
    rows = [(i, v, None) for i, v in enumerate(own)] + [(10_000 + i, v, 1) for i, v in enumerate(BAD)]
    df = vectors(spark, rows)
    got = collections.defaultdict(list)
    for r in ann.nearest(df, df.where("vec_id % 10 = 3")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    x = np.array(own, np.float32).astype(float)
    hits = 0
    for q in range(3, len(own), 10):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(len(x)), d))[:10]
        hits += len(set(want.tolist()) & {v for v, _ in got[q]})
        assert len(got[q]) == 10 and all(abs(s - d[v]) < 1e-12 for v, s in got[q]) and got[q] == sorted(got[q], key=lambda p: (p[1], p[0]))
    assert hits >= 0.9 * 10 * len(got) and len(got) == 73
    assert ann.nearest(df.where("vec_id < 4")).count() == 12 and ann.nearest(df.limit(0)).count() == 0


def test_near_vectors(spark):
    rng = random.Random(7)
    base = noise(rng, 60)
    own = base + [[x + rng.gauss(0, 0.05) for x in base[i % 20]] for i in range(60)] + [base[5]] * 20
    rows = [(i, v, None if i % 11 == 10 else i % 2) for i, v in enumerate(own)] + [(9000 + i, v, 1) for i, v in enumerate(BAD)]
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(vectors(spark, rows)).collect()}
    x = np.array(own, np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    linked = [[j for j in range(len(own)) if j != i and rows[i][2] is not None and rows[i][2] == rows[j][2] and x[i] @ x[j] >= 0.98] for i in range(len(own))]
    assert [got[i].n_links for i in range(len(own))] == list(map(len, linked)) and all(got[9000 + i].n_links == 0 and got[9000 + i].kept for i in range(len(BAD)))
    for i, js in enumerate(linked):
        assert all(got[i].component_id == got[j].component_id for j in js) and got[i].kept == (got[i].component_id == i)
    assert embedding_dedup.near_vectors(vectors(spark, rows).limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, x) for x in range(501, 540)] + [(rng.randrange(50), rng.randrange(50)) for _ in range(30)] + [(7, 7)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for a, b in edges if a != b for x in (a, b)}


def test_language_model(spark):
    rng = random.Random(9)
    texts = ODD + ["the cat sat on the mat and the dog sat on the log " * rng.randrange(1, 4) + words(rng, 3) for _ in range(60)]
    df = frame(spark, texts)
    rows = {r.doc_id: r for r in lm.language_scores(df, F.crc32(F.col("doc_id").cast("string")) % 7 != 2).collect()}
    token = lambda t: (t or "").encode().lower().split() + [b" "]
    learns = lambda i: zlib.crc32(str(i).encode()) % 7 != 2
    c = collections.Counter(w for i, t in enumerate(texts) if learns(i) for w in token(t))
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(texts):
        own, r = token(t), rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not learns(i), len(own), sum(c[w] > 0 for w in own), n)
        assert abs(r.base_score - sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own)) < 1e-6 and r.score <= 0 and math.isfinite(r.score)
    held = [r for r in rows.values() if r.held_out and r.doc_id >= len(ODD)]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm.language_scores(empty(spark), F.lit(True)).count() == 0


def test_model_sums_to_one():
    model = lm.MaxEnt(100)
    rng = np.random.default_rng(1)
    model.classes[:], model.words[:] = rng.normal(size=model.classes.shape), rng.normal(size=model.words.shape)
    assert abs((10 ** model.log10((5 << 18 | 9 << 9) | np.arange(lm.OUTCOMES))).sum() - 1) < 1e-9


def test_suffixes(spark):
    rng = random.Random(10)
    shared = words(rng, 70)
    texts = ODD + [words(rng, 80) + shared[rng.randrange(60) : rng.randrange(260, 330)] + words(rng, 30) for _ in range(25)] + [shared, shared[:200], shared[:199], "é" * 150 + shared]
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(frame(spark, texts), digests=True).collect()}
    raw = [(t or "").encode() for t in texts]
    n = collections.Counter(b[i : i + 200] for b in raw for i in range(len(b) - 199))
    for k, b in enumerate(raw):
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if n[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        assert (got[k].n_bytes, got[k].n_removed, got[k].n_spans, got[k].kept_sha256) == (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()), k
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


def test_previous_factors():
    early, late = suffix_dedup.repeated_windows([b"abcdefgh" * 2, b"xabcdefghx"], 8)
    assert [e.tolist() for e in early] == [[8], [1]] and [x.tolist() for x in late] == [[0, 8], []]


def sets_of(t):
    w = (t or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = "changed" + str(rng.randrange(99))
    return " ".join(w)


@pytest.mark.parametrize("block", [256, 8])
def test_jaccard_join(spark, block, monkeypatch):
    from strandset.llm import minhash

    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(11)
    base = [words(rng, 120) for _ in range(8)]
    texts = ODD + [near(rng, base[i % 8], rng.randrange(5)) for i in range(60)] + base[:3] * 3 + [words(rng, 50) for _ in range(20)]
    got = {r.doc_id: r for r in jaccard_join.jaccard_join(frame(spark, texts)).collect()}
    s = list(map(sets_of, texts))
    linked = [[j for j in range(len(s)) if j != i and s[i] and s[j] and len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j])] for i in range(len(s))]
    assert [got[i].n_links for i in range(len(s))] == list(map(len, linked))
    for i, js in enumerate(linked):
        assert all(got[j].class_id == got[i].class_id for j in js) and got[i].class_id <= i and (js or got[i].kept)
    assert jaccard_join.jaccard_join(empty(spark)).count() == 0


def test_paragraphs(spark):
    rng = random.Random(12)
    common = words(rng, 60)
    texts = ODD + [f"{words(rng, 40)}\n{common if i % 3 else near(rng, common, 1)}\n{words(rng, 30)}" for i in range(20)] + [common]
    got = {r.doc_id: r for r in substring_dedup.remove_paragraphs(frame(spark, texts)).collect()}
    first = len(ODD)
    for i, t in enumerate(texts):
        if i <= first:
            assert got[i].n_removed == 0 and got[i].kept == (t or "")
        elif i < len(texts) - 1:
            a, _, c = t.split("\n")
            assert got[i].kept == f"{a}\n{c}" and got[i].n_spans == 1 and got[i].component_ids == [first]
    assert got[len(texts) - 1].kept == ""
    assert substring_dedup.remove_paragraphs(empty(spark)).count() == 0


def test_passages_inside_lines(spark):
    rng = random.Random(14)
    passages = [words(rng, n) for n in (50, 55, 90)] + [words(rng, 30) + "\n" + words(rng, 25)]
    texts = ODD + [f"{words(rng, 70 + i)} {passages[i % 4]} {words(rng, 90 - i)}" for i in range(24)] + [words(rng, 200) for _ in range(5)]
    texts += [words(rng, 30) + " " + passages[2] + " " + words(rng, 50) + " " + passages[2]]
    got = {r.doc_id: r for r in substring_dedup.remove_paragraphs(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    first = len(ODD)
    for i in range(first, first + 24):
        r, own = got[i], passages[(i - first) % 4]
        if i < first + 4:
            assert r.n_removed == 0
        else:
            left = texts[i].split()
            # which stretches begin near the edge of a passage depends on the words before it, so a later document may be first
            assert r.component_ids[0] == first + (i - first) % 4 and all(c < i and (c - i) % 4 == 0 for c in r.component_ids)
            assert 0.6 * len(own) <= r.n_removed <= len(own) + 1 and r.n_spans >= 1
            assert r.kept.split()[:70] == left[:70] and r.kept.split()[-60:] == left[-60:]
    assert all(got[i].n_removed == 0 for i in range(first + 24, first + 29)) and got[first + 29].n_spans == 2


def test_paragraph_stage_keeps_rows(spark):
    rows = [(1, "one text", "xx", "s", 8), (1, "one text", "xx", "s", 8), (2, None, None, None, None), (None, "no id", "xx", None, 5)]
    docs = spark.createDataFrame(rows, DOCS)
    kept = substring_dedup.stage_substring(spark, docs, "").collect()
    assert kept and sorted(map(repr, map(tuple, kept))) == sorted(map(repr, [*rows[:2], (2, "", None, None, 0), rows[3]]))


def test_stretches_cover_passages():
    rng = np.random.default_rng(15)
    common = rng.integers(0, 1 << 62, 50).astype(np.uint64)
    for _ in range(200):
        a, b = (np.concatenate((rng.integers(0, 1 << 62, rng.integers(0, 60)).astype(np.uint64), common, rng.integers(0, 1 << 62, rng.integers(0, 60)).astype(np.uint64))) for _ in range(2))
        words_, sizes = np.concatenate((a, b)), np.array([len(a), 0, len(b)])
        with np.errstate(over="ignore"):
            at = substring_dedup.stretch_starts(words_, sizes)
        assert all(s + 40 <= len(a) or s >= len(a) and s + 40 <= len(a) + len(b) for s in at.tolist())
        kinds = [{words_[s : s + 40].tobytes() for s in at.tolist() if (s < len(a)) == first} for first in (True, False)]
        assert kinds[0] & kinds[1]
    assert len(substring_dedup.stretch_starts(np.empty(0, np.uint64), np.array([0]))) == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(13)
    toxic = [i % 5 == 0 for i in range(150)]
    texts = [words(rng, 60) + (" vile" if t else "") for t in toxic]
    texts[7] = texts[6]
    df = spark.createDataFrame([(i, t, "xx", "s", len(t)) for i, t in enumerate(texts)] + [(900, "123", None, None, 3), (901, None, None, None, None)], DOCS)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(t)) for i, t in enumerate(toxic)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    clean = {i for i, t in enumerate(toxic) if not t} - {7}
    assert clean <= kept and 7 not in kept and 900 not in kept and 901 not in kept and len(kept - clean) <= 6


def test_language_model_knows_rare_words(spark):
    rng = random.Random(16)
    nouns = [f"noun{i}" for i in range(400)]  # more words than the model once had outcomes
    after = {w: f"after{i}" for i, w in enumerate(nouns)}
    texts = [" ".join(f"{w} {after[w]}" for w in rng.choices(nouns, k=40)) for _ in range(150)]
    shuffled = [" ".join(rng.sample(t.split(), 80)) for t in texts[:20]]
    df = frame(spark, texts + shuffled)
    rows = {r.doc_id: r for r in lm.language_scores(df, (F.col("doc_id") >= 20) & (F.col("doc_id") < 150)).collect()}
    # the words are the same, so only the identity of rare neighbours can tell them apart
    assert all(rows[i].score > rows[150 + i].score + 5 and abs(rows[i].base_score - rows[150 + i].base_score) < 1e-6 for i in range(20))


def test_every_outcome_has_its_share():
    for used in (3, 129, 1200, 80_000):
        model = lm.MaxEnt(used)
        model.words[:] = np.random.default_rng(2).normal(size=model.words.shape)
        bits, own = lm.context_bits(used)
        assert abs((10 ** model.log10((5 << bits + own | 9 << bits) | np.arange(1, used))).sum() - 1) < 1e-6


def test_short_lines(spark):
    rng = random.Random(17)
    licence, boiler = words(rng, 7), words(rng, 18)
    edited = boiler + " end"  # 14 of 15 shingles are common
    texts = [f"{words(rng, 30)}\n{licence if i % 2 else boiler if i % 4 else edited}\n{words(rng, 8)}\n{words(rng, 3)}" for i in range(12)]
    got = {r.doc_id: r for r in substring_dedup.remove_paragraphs(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        a, b, c, d = t.split("\n")
        assert got[i].kept == (t if i < 2 else f"{a}\n{c}\n{d}") and got[i].component_ids == ([] if i < 2 else [i % 2])


@pytest.mark.parametrize("common", [0.0, 3.0])
def test_near_vectors_with_a_common_direction(spark, common):
    rng = np.random.default_rng(18)
    own = rng.standard_normal((400, 64))
    own[:, 0] += common * 8
    unit = own / np.linalg.norm(own, axis=1, keepdims=True)
    turn = rng.standard_normal(unit.shape)
    turn -= (turn * unit).sum(1, keepdims=True) * unit
    near_ = 0.981 * unit + math.sqrt(1 - 0.981**2) * turn / np.linalg.norm(turn, axis=1, keepdims=True)
    x = np.concatenate((unit, near_)).astype(np.float32)
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_vectors(vectors(spark, [(i, v.tolist(), 1) for i, v in enumerate(x)])).collect()}
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = ((y @ y.T) >= 0.98).sum(1) - 1
    assert want.sum() >= 800 and sum(got.values()) >= 0.995 * want.sum() and all(got[i] <= want[i] for i in got)


def test_jaccard_with_odd_ids(spark):
    rng = random.Random(19)
    a, b, c = (words(rng, 60) for _ in range(3))
    rows = [(None, a), (None, a + " more"), (1, b), (1, b), (1, c), (2, c + " more"), (1, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "xx", "s", 1) for i, t in rows], DOCS)
    joined = jaccard_join.jaccard_join(docs).collect()
    assert sorted((r.doc_id or 0, r.n_links) for r in joined) == [(0, 0), (0, 1), (0, 1), (1, 0), (1, 1), (1, 1), (1, 1), (2, 1)]
    kept = [(r.doc_id, r.text) for r in jaccard_join.stage_jaccard(spark, docs, "").collect()]
    assert len(kept) == 5 and set(kept[:]) & {(None, a), (None, a + " more")} and {(1, b), (1, c), (1, ""), (None, None)} <= set(kept)
