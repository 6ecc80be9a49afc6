"""MinHash over word shingles, banding, Bayesian pruning and exact Jaccard, without ever listing a group's pairs.

An item is a text; its set is that of its hashed shingles of WORDS words (a shorter text is one shingle, a text
without words has no set). Items of equal sets are one class, known by a hash of the set. Classes that share a band
of MinHash values are joined to the smallest class of that band, and the components of these links are candidate
clusters. A cluster is dealt out as pairs of blocks of at most BLOCK classes, so a large one becomes many tasks; one of more
than LARGE classes, which may be a chain of few links, is dealt out by the bands that its classes share. In a pair of blocks MinHash values are compared STEP at a time, and a pair is dropped once the posterior probability that its
Jaccard similarity reaches the threshold falls below TOLERANCE; the rest is verified on the sets. Out come link counts
for each class and a spanning forest of the links, both in proportion to the classes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TwoGenerationCache, slices, stored, text_slices
from .components import components

WORDS, THRESHOLD = 5, 0.8
HASHES, STEP, TOLERANCE = 128, 32, 1e-6
BLOCK = 256
#: Clusters of more sets are compared band by band.
LARGE = 8 * BLOCK
_RNG = np.random.default_rng(5)
_A = _RNG.integers(0, 1 << 31, HASHES, np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 1 << 32, HASHES, np.uint32)
_W = _RNG.integers(0, 1 << 62, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
_M = np.uint64(0x9E3779B97F4A7C15)


def tune_bands(threshold: float, miss: float, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows) with the most rows a band, so the fewest false candidates, that miss a pair at threshold at most so often."""
    for rows in range(8, 0, -1):
        bands = math.ceil(math.log(miss) / math.log(1 - threshold**rows))
        if bands * rows <= hashes:
            return bands, rows
    return hashes, 1


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """After n compared values, the fewest matches with P(J >= threshold | matches, uniform prior) >= tolerance."""
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance:  # P(Beta(m+1, n-m+1) >= t) is the chance of at most m successes in n+1 trials
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


class Shingler:
    def __init__(self, cache: int = 50_000):
        self.cache = TwoGenerationCache(cache)

    def words(self, cut: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The 64-bit hashes of all words, text after text, and each text's number of words."""
        import xxhash

        young, digest = self.cache.young, xxhash.xxh3_64_intdigest
        for w in self.cache.missing(set().union(*cut)):
            young[w] = digest(w)
        sizes = np.array(list(map(len, cut)), np.int64)
        words = np.fromiter((young[w] for ws in cut for w in ws), np.uint64, int(sizes.sum()))
        self.cache.turn()
        return words, sizes

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        """The sorted 32-bit shingle hashes of each text; words are cut at white space and compared in small letters."""
        return self.sets_of(*self.words([t.lower().split() for t in texts]))

    @staticmethod
    def sets_of(words: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        """The sorted 32-bit shingle hashes of each text, from the hashes of its words."""
        owner = np.repeat(np.arange(len(sizes)), sizes)
        out = [np.empty(0, np.uint32)] * len(sizes)
        with np.errstate(over="ignore"):
            n = len(words) - WORDS + 1
            if n > 0:
                whole = owner[:n] == owner[WORDS - 1 :]
                h = sum(words[j : j + n] * _W[j] for j in range(WORDS))[whole] * _M >> np.uint64(32)
                keys = np.unique(owner[:n][whole].astype(np.uint64) << np.uint64(32) | h)
                place = np.searchsorted(keys >> np.uint64(32), np.arange(len(sizes) + 1, dtype=np.uint64))
                low = keys.astype(np.uint32)
                out = [low[a:b] for a, b in zip(place[:-1].tolist(), place[1:].tolist())]
            starts = np.cumsum(sizes) - sizes
            for i in np.flatnonzero((sizes > 0) & (sizes < WORDS)).tolist():
                own = words[starts[i] : starts[i] + sizes[i]]
                out[i] = (((own * _W[: len(own)]).sum(keepdims=True) + np.uint64(len(own))) * _M >> np.uint64(32)).astype(np.uint32)
        return out


def signatures(sets: list[np.ndarray], hashes: int = HASHES) -> np.ndarray:
    """MinHash values, a row for each set; sets must not be empty."""
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    x, out = np.concatenate(sets), np.empty((len(sets), hashes), np.uint32)
    for i in range(hashes):
        out[:, i] = np.minimum.reduceat(x * _A[i] + _B[i], starts)
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band, different from band to band."""
    with np.errstate(over="ignore"):
        cut = signature[:, : bands * rows].reshape(-1, bands, rows).astype(np.uint64)
        key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), cut.shape[:2]).copy()
        for j in range(rows):
            key = (key ^ cut[:, :, j]) * _M
            key ^= key >> np.uint64(31)
    return key.view(np.int64)


def set_key(s: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def sketch(sets: list[np.ndarray], bands: int, rows: int) -> tuple[np.ndarray, list[int], np.ndarray]:
    """(which sets are not empty, their keys, their band keys)."""
    some = np.flatnonzero([len(s) > 0 for s in sets])
    if not len(some):
        return some, [], np.empty((0, bands), np.int64)
    sets = [sets[i] for i in some]
    return some, [set_key(s) for s in sets], band_keys(signatures(sets, bands * rows), bands, rows)


def compare_blocks(a: list[np.ndarray], b: list[np.ndarray], sa: np.ndarray, sb: np.ndarray, same: bool, threshold: float, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) of two blocks whose exact similarity reaches threshold; i < j if the blocks are the same."""
    alive = np.triu(np.ones((len(a), len(b)), bool), 1) if same else np.ones((len(a), len(b)), bool)
    size_a, size_b = np.array(list(map(len, a))), np.array(list(map(len, b)))
    alive &= np.minimum(size_a[:, None], size_b) >= threshold * np.maximum(size_a[:, None], size_b)
    i, j = np.nonzero(alive)
    matches = np.zeros(len(i), np.int64)
    for n in range(STEP, HASHES + 1, STEP):
        for x, y in slices(len(i), 1 << 16):
            matches[x:y] += (sa[i[x:y], n - STEP : n] == sb[j[x:y], n - STEP : n]).sum(1)
        keep = matches >= least[n]
        i, j, matches = i[keep], j[keep], matches[keep]
    if not len(i):
        return i, j
    if len(i) > 4 * (len(a) + len(b)):
        rows, cols = np.unique(i), np.unique(j)
        values = np.unique(np.concatenate([a[k] for k in rows]))
        both = np.zeros((len(rows), len(cols)), np.float32)
        for x, y in slices(len(values), 1 << 13):  # counts of common shingles as a product of membership matrices
            part = values[x:y]
            member = lambda sets: np.stack([np.isin(part, s, assume_unique=True) for s in sets]).astype(np.float32)
            both += member([a[k] for k in rows]) @ member([b[k] for k in cols]).T
        common = both[np.searchsorted(rows, i), np.searchsorted(cols, j)]
    else:
        common = np.array([len(np.intersect1d(a[x], b[y], assume_unique=True)) for x, y in zip(i, j)])
    good = common >= threshold * (size_a[i] + size_b[j] - common) - 1e-9
    return i[good], j[good]


def forest(i: np.ndarray, j: np.ndarray) -> list[int]:
    """Places in (i, j) of links that span what all links connect."""
    parent, out = {}, []

    def top(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for k, (x, y) in enumerate(zip(i.tolist(), j.tolist())):
        x, y = top(x), top(y)
        if x != y:
            parent[y] = x
            out.append(k)
    return out


def candidate_clusters(classes: DataFrame) -> DataFrame:
    """(set, bands) -> (set, cluster) of the sets that share a band with another one."""
    rows = classes.select("set", F.explode("bands").alias("band"))
    hubs = rows.groupBy("band").agg(F.min("set").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    hubs = stored(hubs, "hubs")  # stored, the large side of the join is a plain exchange, which can be split where it is skewed
    return components(rows.join(hubs, "band").where("set <> hub").select("set", "hub"), "set", "hub").toDF("set", "cluster")


def links_within(texts: DataFrame, clusters: DataFrame, threshold: float = THRESHOLD, classes: DataFrame | None = None, banding: tuple[int, int] | None = None) -> DataFrame:
    """Verified links: texts (set, n, cluster, text), clusters (set, cluster). Gives (set, other, links).

    Rows with other are links of a spanning forest; rows without it say that set has links linked items in one pair of blocks.
    Clusters of up to LARGE sets are compared throughout. Larger ones, chains perhaps, band by band, given classes (set, bands) and
    the (bands, rows) of banding: each pair that shares bands is compared in the first of them.
    """
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"))
    large = sizes.where(F.col("members") > LARGE)
    banded = classes is not None and large.limit(1).count() > 0
    columns = ["cluster", "set", "n", "blocks", "own", "packed"]
    whole = texts.join(sizes.where(F.col("members") <= LARGE) if banded else sizes, "cluster")
    dealt = _dealt(_packed(_blocked(whole)).withColumn("banded", F.lit(False)))
    if banded:
        entries = clusters.join(large.select("cluster"), "cluster").select("set").join(classes.select("set", "bands"), "set").select("set", F.explode("bands").alias("cluster"))
        shared = entries.groupBy("cluster").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
        entries = _blocked(entries.join(stored(shared, "shared"), "cluster"))
        once = texts.join(large.select("cluster"), "cluster").withColumns({"blocks": F.lit(1), "own": F.lit(0)})
        ready = stored(_packed(once).select("set", "n", "packed"), "packed")
        dealt = dealt.union(_dealt(entries.select("cluster", "set", "blocks", "own").join(ready, "set").select(*columns).withColumn("banded", F.lit(True))))
    least = least_matches(threshold)
    key = ["banded", "cluster", "x", "y"]
    dealt = dealt.repartition(*key).sortWithinPartitions(*key)

    def compare(batches):
        def done(cluster, x, y, by_band, rows):
            rows = list({r[5]: r for r in rows}.values())
            a, b = [r for r in rows if r[4] == x], [r for r in rows if r[4] == y]
            read = lambda rs: ([np.frombuffer(r[7], np.uint32)[HASHES:] for r in rs], np.array([np.frombuffer(r[7], np.uint32, HASHES) for r in rs]))
            if len(rows) < 2 or not a or not b:
                return
            (sets_a, sig_a), (sets_b, sig_b) = read(a), read(b)
            i, j = compare_blocks(sets_a, sets_b, sig_a, sig_b, x == y, threshold, least)
            if by_band and len(i):
                keys_a, keys_b = band_keys(sig_a, *banding), band_keys(sig_b, *banding)
                same = keys_a[i] == keys_b[j]
                first = keys_a[i, same.argmax(1)] == cluster
                i, j = i[first], j[first]
            if not len(i):
                return
            n_a, n_b = np.array([r[6] for r in a], float), np.array([r[6] for r in b], float)
            for own, n in ((a, np.bincount(i, n_b[j], len(a))), (b, np.bincount(j, n_a[i], len(b)))):
                for r, links in zip(own, n):
                    if links:
                        yield r[5], None, int(links)
            for k in forest(i, j + (0 if x == y else len(a))):
                yield a[i[k]][5], b[j[k]][5], 0

        def batch_of(found):
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(3)], names=["set", "other", "links"])

        held, found = [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[:4] != held[-1][:4]:
                    found += done(held[0][1], held[0][2], held[0][3], held[0][0], held)
                    held = []
                held.append(row)
            if len(found) > 10_000:
                yield batch_of(found)
                found = []
        if held:
            found += done(held[0][1], held[0][2], held[0][3], held[0][0], held)
        yield batch_of(found)

    return dealt.select(*key, "own", "set", "n", "packed").mapInArrow(compare, "set long, other long, links long")


def _blocked(rows: DataFrame) -> DataFrame:
    """rows (cluster, set, members...) with the number of blocks of their cluster and their own block."""
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    return rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("set", F.lit(1)), F.col("blocks")).cast("int"))


def _packed(rows: DataFrame) -> DataFrame:
    """(cluster, set, n, blocks, own, packed) of rows that have text: its MinHash values and its set; texts without words are left out."""

    def prepare(batches):
        shingler = Shingler()
        for batch in batches:
            for a, b in text_slices(batch.column(5), 512):
                sets = shingler.sets([t or "" for t in batch.column(5).slice(a, b - a).to_pylist()])
                some = [i for i, s in enumerate(sets) if len(s)]
                if some:
                    packed = [sig.tobytes() + sets[i].tobytes() for i, sig in zip(some, signatures([sets[i] for i in some]))]
                    at = pa.array([a + i for i in some])
                    yield pa.RecordBatch.from_arrays([batch.column(k).take(at) for k in range(5)] + [pa.array(packed, pa.binary())], names=["cluster", "set", "n", "blocks", "own", "packed"])

    return rows.select("cluster", "set", "n", "blocks", "own", "text").mapInArrow(prepare, "cluster long, set long, n long, blocks int, own int, packed binary")


def _dealt(ready: DataFrame) -> DataFrame:
    """Every row once for each pair (x, y) of blocks of its cluster that its own block is part of."""
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with")
    pairs = ready.select("banded", "cluster", "set", "n", "own", "packed", other)
    return pairs.select("banded", "cluster", F.least("own", "with").alias("x"), F.greatest("own", "with").alias("y"), "own", "set", "n", "packed")


def set_components(links: DataFrame) -> DataFrame:
    """(set, group) of the sets that have links."""
    return components(links.where("other is not null"), "set", "other").toDF("set", "group")
