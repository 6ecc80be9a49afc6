"""Removal of near-duplicate paragraphs: MinHash banding, exact verification, and removals by components.

Paragraphs are of two kinds, both judged on the input. Lines are compared by Jaccard similarity. Passages that begin and
end inside lines share no line: they are found by stretches of CORE words, which begin wherever the MinHash value of
a shingle is the least of APART neighbouring ones. The same passage thus begins the same stretches wherever it stands,
and every passage of CORE + APART - 1 words holds at least one; all words of a stretch are one band. A stretch with its
like elsewhere is only a candidate: both are cut out of their texts with the words around them, compared word by word, and
the passage reaches as far as the Jaccard similarity of the shingles in place stays at the threshold. Passages of
PASSAGE words or more go, but for the first. They are looked for outside the lines that go, so that no passage goes for the
sake of one that has gone.

Rows are known by id and a hash of the text, so that ids may repeat with other texts or be null.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from . import minhash
from .common import discard, slices, stored, table, text_slices

#: Paragraphs (lines) of fewer words, which have one shingle at most, are left alone: they recur by chance and as headings.
LEAST_WORDS = minhash.WORDS + 1
MISS = 1e-3
#: Every passage of PASSAGE words that recurs holds a common stretch of CORE words.
PASSAGE, CORE = 40, 25
APART = PASSAGE - CORE + 1
#: Stretches of fewer different words are no text.
DIFFERENT = 5


def paragraphs(text: str | None) -> list[str]:
    """The lines of a text, each with its line end, so that joining them gives the text."""
    parts = (text or "").split("\n")
    return [p + "\n" for p in parts[:-1]] + parts[-1:] * bool(parts[-1])


def sketches(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = minhash.THRESHOLD, least_words: int = LEAST_WORDS, stretch: int = CORE, apart: int = APART) -> DataFrame:
    """One pass over the texts, words hashed once: a row for each line of least_words words or more, with its set and bands,
    and a row for each text with a stretch, with the starts (in words) and keys of its stretches. All have id and hash of their text."""
    bands, rows = minhash.tune_bands(threshold, MISS)
    # unequal sets that reach the threshold have at least so many shingles; smaller ones are equal or apart, and need no bands
    close = threshold / (1 - threshold) - 1e-9 if threshold < 1 else float("inf")

    def run(batches):
        shingler = minhash.Shingler()
        for batch in batches:
            for x, y in text_slices(batch.column(2), 256):
                ids, hashes, owner, number, cut = batch.column(0).slice(x, y - x), batch.column(1).slice(x, y - x), [], [], []
                for i, text in enumerate(batch.column(2).slice(x, y - x).to_pylist()):
                    for k, p in enumerate((text or "").lower().split("\n")):
                        owner.append(i)
                        number.append(k)
                        cut.append(p.split())
                words, sizes = shingler.words(cut)
                owner, number = np.array(owner), np.array(number, np.int32)
                long = sizes >= least_words
                own = shingler.sets_of(words[np.repeat(long, sizes)], sizes[long])
                some = np.array([i for i, s in enumerate(own) if len(s)], np.int64)
                sets, keys = [minhash.set_key(own[i]) for i in some], [None] * len(some)
                banded = [k for k, i in enumerate(some) if len(own[i]) >= close]
                for k, key in zip(banded, minhash.sketch([own[some[k]] for k in banded], bands, rows)[2]):
                    keys[k] = key
                lines = np.flatnonzero(long)[some]
                of_text = np.bincount(owner, sizes, len(ids)).astype(np.int64)
                with np.errstate(over="ignore"):
                    at = varied(words, stretch_starts(words, of_text, stretch, apart), stretch)
                    key = np.zeros(len(at), np.uint64)
                    for j in range(stretch):
                        key = (key ^ words[at + j]) * minhash._M
                        key ^= key >> np.uint64(31)
                ends = np.cumsum(of_text)
                text = np.searchsorted(ends, at, "right")
                texts, counts = np.unique(text, return_counts=True)
                line_ends = np.cumsum(sizes)
                touched = [number[np.searchsorted(line_ends, at + k, "right")] for k in (0, stretch - 1)]  # its first and its last line
                offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, v) for v in (pa.array((at - (ends - of_text)[text]).astype(np.int32)), pa.array(key.view(np.int64)), *map(pa.array, touched))]
                n, m, rows_ = len(lines), len(texts), pa.array(np.concatenate((owner[lines], texts)).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(rows_),
                        hashes.take(rows_),
                        pa.concat_arrays([pa.array(number[lines]), pa.nulls(m, pa.int32())]),
                        pa.concat_arrays([pa.array(sets, pa.int64()), pa.nulls(m, pa.int64())]),
                        pa.concat_arrays([pa.array(keys, pa.list_(pa.int64())), pa.nulls(m, pa.list_(pa.int64()))]),
                        pa.concat_arrays([pa.nulls(n, lists[0].type), lists[0]]),
                        pa.concat_arrays([pa.nulls(n, lists[1].type), lists[1]]),
                        pa.concat_arrays([pa.nulls(n, lists[2].type), lists[2]]),
                        pa.concat_arrays([pa.nulls(n, lists[3].type), lists[3]]),
                    ],
                    names=["id", "hash", "paragraph", "set", "bands", "starts", "keys", "from", "to"],
                )

    return stored(with_key(df, id_col, text_col).mapInArrow(run, "id long, hash long, paragraph int, set long, bands array<long>, starts array<int>, keys array<long>, from array<int>, to array<int>"), "paragraphs")


def with_key(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("hash"), F.col(text_col).alias("text"))


def place(last: str):
    """Where something stands, in the order that decides which copy is the first: ids, those that are null last, then texts, then last."""
    return F.struct(F.col("id").isNull().alias("none"), "id", "hash", last)


def of_rows(docs: DataFrame, found: DataFrame, how: str = "inner") -> DataFrame:
    """docs, once more told apart by id (null too) and hash, with what was found for them."""
    return docs.join(found.withColumnsRenamed({"id": "id_", "hash": "hash_"}), docs["id"].eqNullSafe(F.col("id_")) & (docs["hash"] == F.col("hash_")), how)


def removals(df: DataFrame, sketched: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = minhash.THRESHOLD) -> DataFrame:
    """(id, hash, paragraph, component_id): the lines to remove, numbered from 0 in their document; sketched is that of df.

    Lines link if the Jaccard similarity of their five-word shingles is threshold or more; of each component the
    first line stays. component_id is the id of the document of the one that stays.
    """
    sketched = sketched.where("set is not null").select("id", "hash", "paragraph", "set", "bands")
    by_set = sketched.groupBy("set")
    classes = stored(by_set.agg(F.min(place("paragraph")).alias("rep"), F.count(F.lit(1)).alias("n"), F.min("bands").alias("bands")), "classes")
    clusters = minhash.candidate_clusters(classes.where("bands is not null"))
    wanted = classes.select("set", "rep").join(clusters, "set").groupBy(F.col("rep.id").alias("id"), F.col("rep.hash").alias("hash")).agg(F.collect_list(F.struct(F.col("rep.paragraph").alias("paragraph"), "set", "cluster")).alias("at"))

    def cut(batches):
        seen = set()  # rows of one id and text meet the same list
        for batch in batches:
            out = []
            for text, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = paragraphs(text)
                out += [(x["set"], 1, x["cluster"], own[x["paragraph"]]) for x in at if x["paragraph"] < len(own) and x["set"] not in seen]
                seen.update(x["set"] for x in at)
            columns = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=["set", "n", "cluster", "text"])

    texts = of_rows(with_key(df, id_col, text_col), wanted).select("text", "at").mapInArrow(cut, "set long, n long, cluster long, text string")
    links = stored(minhash.links_within(texts, clusters, threshold, classes.where("bands is not null"), minhash.tune_bands(threshold, MISS)), "links")
    groups = minhash.set_components(links)
    linked = classes.select("set", "rep").join(groups, "set")
    firsts = linked.groupBy("group").agg(F.min("rep").alias("first"))
    of_linked = linked.join(firsts, "group").select("set", "first")
    of_set = stored(classes.join(of_linked, "set", "left").where("n > 1 or first is not null").select("set", F.coalesce("first", "rep").alias("first")), "firsts")
    gone = sketched.select("id", "hash", "paragraph", "set").join(of_set, "set").where(place("paragraph") != F.col("first"))
    return gone.select("id", "hash", "paragraph", F.col("first.id").alias("component_id"))


def stretch_starts(words: np.ndarray, sizes: np.ndarray, stretch: int = 40, apart: int = 11) -> np.ndarray:
    """Where stretches begin in the words of all texts: at the least shingle of every run of apart possible places."""
    ends = np.cumsum(sizes)
    begins = ends - sizes
    n = len(words) - stretch + 1
    if n <= 0:
        return np.empty(0, np.int64)
    h = words[:n] * minhash._W[0]
    for j in range(1, minhash.WORDS):
        h += words[j : j + n] * minhash._W[j]
    h *= minhash._M
    h &= np.uint64(0xFFFFFFFF00000000)
    h |= np.arange(n, dtype=np.uint64)  # value and place in one number: of equal values the first place is the least
    places = sizes - stretch + 1  # possible starts of each text
    few = (places > 0) & (places <= apart)
    out = [h[at : at + m].min()[None] for at, m in zip(begins[few].tolist(), places[few].tolist())]
    if n >= apart:
        marks = np.zeros(len(words) + 1, np.int64)  # the places from which a run of apart places fits into its text
        long = places > apart
        np.add.at(marks, begins[long], 1)
        np.add.at(marks, begins[long] + places[long] - apart + 1, -1)
        width = 1
        while 2 * width <= apart:
            h = np.minimum(h[:-width], h[width:])
            width *= 2
        if width < apart:
            h = np.minimum(h[: len(h) - (apart - width)], h[apart - width :])
        out.append(h[np.cumsum(marks)[: len(h)] > 0])
    return np.unique(np.concatenate(out) & np.uint64(0xFFFFFFFF)).astype(np.int64) if out else np.empty(0, np.int64)


def varied(words: np.ndarray, at: np.ndarray, stretch: int = CORE) -> np.ndarray:
    """The starts of stretches with DIFFERENT different words or more."""
    kept = []
    for a, b in slices(len(at), 100_000):
        own = np.sort((words[at[a:b, None] + np.arange(stretch)] >> np.uint64(32)).astype(np.uint32), axis=1)
        kept.append(at[a:b][(own[:, 1:] != own[:, :-1]).sum(1) + 1 >= DIFFERENT])
    return np.concatenate(kept) if kept else at


def contexts(df: DataFrame, sketched: DataFrame, lines: DataFrame, id_col: str = "doc_id", text_col: str = "text", stretch: int = CORE, apart: int = APART) -> DataFrame:
    """(key, id, hash, start, first, before, after, words): the stretches that stand in more than one place, with apart words on
    either side (before and after of them are there), as 32-bit hashes of words. first marks the first place of a key.

    Stretches that touch one of the lines to remove are left out, as repeats and as first places.
    """
    gone = lines.groupBy("id", "hash").agg(F.collect_set("paragraph").alias("gone"))
    found = of_rows(sketched.where("keys is not null").select("id", "hash", F.arrays_zip("starts", "keys", "from", "to").alias("at")), gone, "left")
    stays = F.filter("at", lambda s: ~F.exists("gone", lambda line: line.between(s["from"], s["to"])))
    found = found.select("id", "hash", F.explode(F.when(F.col("gone").isNull(), F.col("at")).otherwise(stays)).alias("s")).select("id", "hash", F.col("s.starts").alias("start"), F.col("s.keys").alias("key"))
    firsts = found.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(place("start")).alias("first")).where("n > 1").select("key", "first")
    shared = found.join(stored(firsts, "firsts"), "key")
    wanted = stored(shared.groupBy("id", "hash").agg(F.collect_set(F.struct("start", "key", (place("start") == F.col("first")).alias("first"))).alias("at")), "wanted")
    width = stretch + 2 * apart

    def run(batches):
        shingler, seen = minhash.Shingler(), set()  # rows of one id and text meet the same list
        for batch in batches:
            for x, y in text_slices(batch.column(2), 256):
                part = batch.slice(x, y - x)
                new, names = [], list(zip(part.column(0).to_pylist(), part.column(1).to_pylist()))
                for i, name in enumerate(names):
                    if name not in seen:
                        seen.add(name)
                        new.append(i)
                part = part.take(pa.array(new, pa.int64()))
                words, sizes = shingler.words([(t or "").lower().split() for t in part.column(2).to_pylist()])
                short = np.concatenate((np.zeros(apart, np.uint32), (words >> np.uint64(32)).astype(np.uint32), np.zeros(width, np.uint32)))
                lists = part.column(3)
                at, owner = lists.flatten(), np.repeat(np.arange(len(new)), lists.value_lengths().to_numpy())
                start = at.field("start").to_numpy().astype(np.int64)
                ends = np.cumsum(sizes)
                begin = (ends - sizes)[owner] + start
                after = np.minimum(apart, ends[owner] - begin - stretch)
                some = pa.array(np.flatnonzero(after >= 0))  # all, but for a clash of hashes
                begin, after, start, owner = (v[some.to_numpy()] for v in (begin, after, start, owner))
                cut = np.ascontiguousarray(short[begin[:, None] + np.arange(width)])
                rows = pa.array(owner)
                arrays = [at.field("key").take(some), part.column(0).take(rows), part.column(1).take(rows), pa.array(start.astype(np.int32)), at.field("first").take(some)]
                arrays += [pa.array(np.minimum(apart, start).astype(np.int32)), pa.array(after.astype(np.int32)), pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * width), len(cut), [None, pa.py_buffer(cut)]).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "id", "hash", "start", "first", "before", "after", "words"])

    docs = of_rows(with_key(df, id_col, text_col), wanted).select("id", "hash", "text", "at")
    return stored(docs.mapInArrow(run, "key long, id long, hash long, start int, first boolean, before int, after int, words binary"), "contexts")


def reach(x: np.ndarray, y: np.ndarray, before: np.ndarray, after: np.ndarray, threshold: float, stretch: int = CORE, apart: int = APART) -> tuple[np.ndarray, np.ndarray]:
    """How many words before and after the stretch the passage goes on in which rows of x and y are similar; -1 where the stretches differ.

    before and after words can be compared. The passage begins and ends with equal shingles, and the Jaccard similarity
    of its shingles, each compared with that in the same place, is threshold or more; the longest such passage counts.
    """
    column = np.arange(stretch + 2 * apart)
    same = (x == y) & (column >= apart - before[:, None]) & (column < apart + stretch + after[:, None])
    core = same[:, apart : apart + stretch].all(1)
    n = len(column) - minhash.WORDS + 1
    whole = np.ones((len(x), n), bool)
    for j in range(minhash.WORDS):
        whole &= same[:, j : j + n]
    total = np.concatenate((np.zeros((len(x), 1), np.int16), np.cumsum(whole, axis=1, dtype=np.int16)), axis=1)
    best, left, right = np.full(len(x), -1), np.full(len(x), -1), np.full(len(x), -1)
    for a in range(apart + 1):
        for b in range(apart + 1):
            first, last = apart - a, apart + stretch + b - minhash.WORDS  # the passage's first and last shingle
            common, size = total[:, last + 1] - total[:, first], last + 1 - first
            good = core & whole[:, first] & whole[:, last] & (a + b > best) & (common >= threshold * (2 * size - common) - 1e-9)
            best[good], left[good], right[good] = a + b, a, b
    return left, right


def passages(found: DataFrame, threshold: float = minhash.THRESHOLD, stretch: int = CORE, apart: int = APART, least: int = PASSAGE) -> DataFrame:
    """(id, hash, a, b, component_id) of contexts(): words a to b - 1 of the document recur from the document component_id.

    Every stretch is compared with the first of its key. In one document, what a passage shares with itself is no repeat.
    """
    names = {"id": "id_", "hash": "hash_", "start": "start_", "before": "before_", "after": "after_", "words": "words_"}
    pairs = found.where("not first").drop("first").join(found.where("first").drop("first").withColumnsRenamed(names), "key")

    def run(batches):
        for batch in batches:
            column = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
            matrix = lambda c: np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(batch.num_rows, -1)
            if not batch.num_rows:
                continue
            left, right = reach(matrix("words"), matrix("words_"), np.minimum(column("before"), column("before_")), np.minimum(column("after"), column("after_")), threshold, stretch, apart)
            start = column("start").astype(np.int64)
            a, b = start - left, start + stretch + right
            shift = start - column("start_")
            own = pc.and_(pc.equal(batch.column("hash"), batch.column("hash_")), pc.fill_null(pc.equal(batch.column("id"), batch.column("id_")), True)).to_numpy(zero_copy_only=False)
            a = np.where(own, np.maximum(a, b - shift), a)
            good = pa.array((left >= 0) & (b - a >= least))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("hash"), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), batch.column("id_")], names=["id", "hash", "a", "b", "component_id"]).filter(good)

    columns = ["id", "hash", "start", "before", "after", "words"]
    return pairs.select(*columns, *names.values()).mapInArrow(run, "id long, hash long, a int, b int, component_id long")


_WORD = re.compile(r"\S+")


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch made one."""
    out = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def removed_spans(text: str, lines: list[tuple[int, int]], words: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], list[int]]:
    """The spans of characters to remove, and the documents that hold what they hold.

    lines are (line, document), words (first word, end, document). Words inside removed lines go with these; others go
    with the blanks after them, up to a line end.
    """
    spans, held, at = [], set(), 0
    if lines:
        marks = dict(lines)
        held.update(marks.values())
        for k, p in enumerate(paragraphs(text)):
            if k in marks:
                spans.append((at, at + len(p)))
            at += len(p)
    if words:
        places = [m.span() for m in _WORD.finditer(text)]
        whole = _joined(spans)
        begins = [x for x, _ in whole]
        loose = []
        for a, b, c in words:
            if a < b <= len(places):
                k = bisect.bisect_right(begins, places[a][0]) - 1
                if k < 0 or whole[k][1] < places[b - 1][1]:
                    loose.append((a, b))
                    held.add(c)
        for a, b in _joined(loose):
            last, after = places[b - 1][1], places[b][0] if b < len(places) else len(text)
            spans.append((places[a][0], last if "\n" in text[last:after] else after))
    return _joined(spans), sorted(held - {None})


def _removed(df: DataFrame, id_col: str, text_col: str, threshold: float, least_words: int, digests: bool, keep: tuple[str, ...]) -> tuple[list[str], DataFrame]:
    """remove_paragraphs() with names of its own for the columns that are carried."""
    carried = df.select(id_col, *keep).schema.fields
    sketched = sketches(df, id_col, text_col, threshold, least_words)
    lines = stored(removals(df, sketched, id_col, text_col, threshold), "lines")
    found = contexts(df, sketched, lines, id_col, text_col)
    lines = lines.select("id", "hash", F.struct("paragraph", "component_id").alias("line"), F.lit(None).cast("struct<a:int,b:int,component_id:bigint>").alias("words"))
    inner = passages(found, threshold).select("id", "hash", F.lit(None).cast("struct<paragraph:int,component_id:bigint>").alias("line"), F.struct("a", "b", "component_id").alias("words"))
    gone = stored(lines.union(inner).groupBy("id", "hash").agg(F.collect_set("line").alias("lines"), F.collect_set("words").alias("words")), "gone")
    discard(sketched)
    discard(found)
    own = [f"own{k}" for k in range(len(carried))]
    docs = df.select(*(F.col(f.name).alias(o) for f, o in zip(carried, own)), F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("hash"), F.col(text_col).alias("text"))
    last = "kept_sha256" if digests else "kept"

    def run(batches):
        for batch in batches:
            for x, y in text_slices(batch.column(len(own)), 256):
                part, rows = batch.slice(x, y - x), []
                for text, marks, words in zip(*(part.column(len(own) + k).to_pylist() for k in range(3))):
                    text = text or ""
                    spans, held = removed_spans(text, [tuple(m.values()) for m in marks or ()], [tuple(w.values()) for w in words or ()])
                    edges = [0, *(e for s in spans for e in s), len(text)]
                    kept = "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])).encode("utf-8", "surrogatepass")
                    size = len(text.encode("utf-8", "surrogatepass"))
                    rows.append((size, size - len(kept), len(spans), held, hashlib.sha256(kept).hexdigest() if digests else kept.decode("utf-8", "surrogatepass")))
                columns = list(zip(*rows)) or [(), (), (), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(own)], *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.list_(pa.int64())), pa.array(columns[4], pa.string())],
                    names=[*own, "n_bytes", "n_removed", "n_spans", "component_ids", last],
                )

    schema = StructType()
    for f, name in zip(carried, own):
        schema = schema.add(name, f.dataType, True)
    for name, of in (("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("component_ids", ArrayType(LongType())), (last, "string")):
        schema = schema.add(name, of)
    return own, of_rows(docs, gone, "left").select(*own, "text", "lines", "words").mapInArrow(run, schema)


def remove_paragraphs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = minhash.THRESHOLD, least_words: int = LEAST_WORDS, digests: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of df: id_col, the columns of keep, n_bytes, n_removed, n_spans, component_ids, and kept (the text left) or its SHA-256.

    n_removed counts bytes, n_spans the maximal removed runs, component_ids names the documents that hold what was
    removed (none, or only one without an id: an empty list). A null text is empty; a document of which all is removed keeps an
    empty text. Of copies the first stays: the one of the smallest id, a null id coming last, of one id that of the smaller hash,
    in one text the earlier one. Rows of one id and text are one document told twice: they keep and lose the same. Columns that keep
    does not name are not read. An empty table gives no rows.
    """
    own, found = _removed(df, id_col, text_col, threshold, least_words, digests, keep)
    return found.toDF(id_col, *keep, *found.columns[len(own) :])


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: a row for each row of documents; remove_paragraphs() tells what odd rows give."""
    return remove_paragraphs(table(spark, sf_dir, "documents"), digests=True)


def stage_substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated paragraphs go but for the first; documents of which nothing is left go.

    All columns stay, n_chars is that of the text left, and a null text becomes an empty one. Rows with null or repeated ids are
    documents as any other; an empty table stays empty.
    """
    keep = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    own, found = _removed(docs, "doc_id", "text", minhash.THRESHOLD, LEAST_WORDS, False, keep)
    found = found.where((F.col("n_removed") == 0) | F.col("kept").rlike(r"\S"))
    name = dict(zip(("doc_id", *keep), own)) | {"text": "kept"}
    return found.select(*(F.length("kept").cast("long").alias(c) if c == "n_chars" else F.col(name[c]).alias(c) for c in docs.columns))
