"""Exact removal of repeated byte strings with longest-previous-factor arrays over suffix order.

A string of LEAST bytes is a window. Every window has an anchor: the leftmost smallest hash among the GRAM-byte strings
inside it, so equal windows have equal anchors at the same place. Neighbouring windows of one anchor form a run, and
the text of a run (under 2 * LEAST bytes) goes by its anchor's hash to where its equals go. Anchors are a few for
each LEAST bytes, so what is shuffled is a small share of the text, and nothing of it is text.

Runs of equal text are collapsed and are repeats of each other. Runs that share an anchor but not their whole text
are cut out of their documents and sorted by suffix, in batches that keep together what shares the anchor and LEAST/2
- GRAM/2 bytes before or after it, as any common window does. In suffix order, the previous and next smaller position with a
common prefix of LEAST bytes is an earlier match (the longest previous factor is long enough), the previous and next
larger one a later match. Matches never cross documents, as runs do not.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, stored, table, text_slices

LEAST, GRAM = 200, 40
CHUNK = 1 << 20  # windows looked at together; positions in a chunk take 21 bits
BATCH_BYTES = 1 << 21
_RNG = np.random.default_rng(20)
_BYTE = _RNG.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_R = np.uint64(0xD6E8FEB86659FD93)
_RINV = np.uint64(pow(int(_R), -1, 1 << 64))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n not in _POWERS:
        _POWERS.clear()
        with np.errstate(over="ignore"):
            one = np.ones(n, np.uint64)
            up, down = one.copy(), one.copy()
            up[1:], down[1:] = _R, _RINV
            _POWERS[n] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _POWERS[n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93 ^ 0x5851F42D4C957F2D | 1)
    return h ^ (h >> np.uint64(29))


def runs(data: np.ndarray, least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(first window, windows, anchor's hash, text's hash) of the runs of a buffer, windows across documents included."""
    found, span = [], least - gram + 1
    up, down = _powers(CHUNK + least)
    with np.errstate(over="ignore"):
        for a, b in slices(len(data) - least + 1, CHUNK):
            own = data[a : b + least - 1]
            total = np.zeros(len(own) + 1, np.uint64)
            np.cumsum(_BYTE[own] * up[: len(own)], out=total[1:])
            grams = _mix((total[gram:] - total[:-gram]) * down[: len(own) - gram + 1])
            low = (grams & ~np.uint64(0x1FFFFF)) | np.arange(len(grams), dtype=np.uint64)
            width = 1
            while 2 * width <= span:
                low = np.minimum(low[:-width], low[width:])
                width *= 2
            if width < span:
                low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
            anchor = (low & np.uint64(0x1FFFFF)).astype(np.int64)
            first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
            found.append((a + first, np.diff(np.append(first, len(anchor))), a + anchor[first], grams[anchor[first]]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 4


def cut_at(first: np.ndarray, n: np.ndarray, anchor: np.ndarray, h1: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """The runs with a new one begun at each document's first window."""
    inner = ends[:-1][np.diff(ends) > 0] if len(ends) else ends
    new = np.setdiff1d(inner[inner < first[-1] + n[-1]] if len(first) else inner[:0], first)
    if not len(new):
        return first, n, anchor, h1
    of = np.searchsorted(first, new, side="right") - 1
    stop = first[-1] + n[-1]
    starts = np.concatenate((first, new))
    order = np.argsort(starts, kind="stable")
    starts = starts[order]
    return starts, np.diff(np.append(starts, stop)), np.concatenate((anchor, anchor[of]))[order], np.concatenate((h1, h1[of]))[order]


def text_hash(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A hash of each data[start:stop], from sums of powers over stretches of the buffer."""
    out = np.empty(len(start), np.uint64)
    longest = int((stop - start).max()) if len(start) else 0
    up, down = _powers(CHUNK + LEAST) if longest <= LEAST else _powers(CHUNK + longest + LEAST)
    with np.errstate(over="ignore"):
        for a, b in slices(len(data), CHUNK):
            here = np.flatnonzero((start >= a) & (start < b))
            if not len(here):
                continue
            own = data[a : b + longest]
            total = np.zeros(len(own) + 1, np.uint64)
            np.cumsum(_BYTE[own] * up[: len(own)], out=total[1:])
            s, e = start[here] - a, stop[here] - a
            out[here] = _mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


def smaller_neighbours(order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place in suffix order, the places of the previous and of the next smaller position, or -1, by pointer jumping."""
    out = []
    for step in (-1, 1):
        near = np.arange(len(order)) + step
        near[(near < 0) | (near >= len(order))] = -1
        open_ = np.flatnonzero((near >= 0) & (order[near] > order))
        while len(open_):
            near[open_] = near[near[open_]]
            open_ = open_[(near[open_] >= 0) & (order[near[open_]] > order[open_])]
        out.append(near)
    return out[0], out[1]


def suffix_order(data: np.ndarray, room: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions in order of their first depth bytes, rank of each) of the positions whose string occurs more than once.

    Ranks double in length from 8 bytes to depth; a position that is alone at some length is alone at all larger
    ones and leaves the sort. room is the number of bytes from each position to the end of its text.
    """
    at = np.flatnonzero(room >= depth)
    rank = np.full(len(data), -1, np.int64)
    where = np.flatnonzero(room >= 8)
    words = np.lib.stride_tricks.sliding_window_view(data, 8)[where].copy().view(">u8").ravel().astype(np.uint64) if len(where) else np.empty(0, np.uint64)
    values, inverse, counts = np.unique(words, return_inverse=True, return_counts=True)
    del values
    rank[where] = np.where(counts[inverse] > 1, inverse, -1)
    length = 8
    while True:
        at = at[rank[at] >= 0]
        where = where[rank[where] >= 0]
        if length == depth or not len(at):
            return (order := at[np.lexsort((at, rank[at]))]), rank[order]
        ahead = min(length, depth - length)
        where = where[room[where] >= length + ahead]
        right = rank[where + ahead]
        where, right = where[right >= 0], right[right >= 0]
        _, inverse, counts = np.unique(rank[where] << 32 | right, return_inverse=True, return_counts=True)
        rank = np.full(len(data), -1, np.int64)
        rank[where] = np.where(counts[inverse] > 1, inverse, -1)
        length += ahead


def repeated_windows(texts: list[bytes], depth: int = LEAST) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each text, the starts of windows with an earlier match in the row of texts, and of those with a later one."""
    sizes = np.array(list(map(len, texts)), np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(texts), np.uint8)
    owner = np.repeat(np.arange(len(texts)), sizes)
    out = []
    order, rank = suffix_order(data, ends[owner] - np.arange(len(data)), depth)
    for positions in (order, -order):  # a larger position is a smaller one of the reversed text
        left, right = smaller_neighbours(positions)
        match = np.zeros(len(order), bool)
        for near in (left, right):
            match |= (near >= 0) & (rank[near] == rank)
        hit = np.sort(order[match])
        cut = np.searchsorted(hit, ends)
        out.append([x - (e - n) for x, e, n in zip(np.split(hit, cut[:-1]), ends, sizes)])
    return out[0], out[1]


def spans_of(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of [start, start + length) as sorted, disjoint, non-touching spans."""
    if not len(starts):
        return starts, starts
    order = np.argsort(starts, kind="stable")
    begin, end = starts[order], np.maximum.accumulate((starts + lengths)[order])
    new = np.concatenate(([True], begin[1:] > end[:-1]))
    first = np.flatnonzero(new)
    return begin[first], end[np.append(first[1:] - 1, len(end) - 1)]


def with_key(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, hash, text). Rows are known by both id and hash of the text: what they share is alike in both, so that one stands for all."""
    return df.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("hash"), F.col(text_col).alias("text"))


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, hash, marks): stretches (start, length) of bytes whose union is every byte in a window that also starts elsewhere.

    Texts are UTF-8; a null text is empty. hash is xxhash64 of the text; rows of one id and text, which are repeats of each
    other, have one row here. Ids may repeat with other texts, or be null.
    """
    kind = dict(df.dtypes)[id_col]
    docs = with_key(df, id_col, text_col)
    names = ["h1", "h2", "doc", "start", "length", "before", "n", "id", "hash"]
    schema = f"h1 long, h2 long, doc long, start long, length int, before int, n int, id {kind}, hash long"

    def find(batches):
        number = TaskContext.get().partitionId() << 33  # rows are numbered once, and the numbers stored
        for batch in batches:
            for a, b in text_slices(batch.column(2), 1024):
                raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(2).slice(a, b - a).to_pylist()]
                numbers, number = number + np.arange(b - a), number + b - a
                data = np.frombuffer(b"".join(raw), np.uint8)
                ends = np.cumsum(np.array(list(map(len, raw)), np.int64))
                if not len(data) or max(map(len, raw)) < LEAST:
                    continue
                first, n, anchor, h1 = cut_at(*runs(data), ends)
                doc = np.searchsorted(ends, first, side="right")
                # windows that run across documents are none: a run ends where its document has no more room
                last = np.minimum(first + n, ends[doc] - LEAST + 1)
                keep = last > first
                first, last, doc, anchor, h1 = first[keep], last[keep], doc[keep], anchor[keep], h1[keep]
                h2 = text_hash(data, first, last + LEAST - 1)
                with np.errstate(over="ignore"):
                    h2 = _mix(h2 + (anchor - first).astype(np.uint64))
                order = np.lexsort((h2, h1))
                same = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
                repeats = np.zeros(len(h1), bool)
                repeats[order[1:][same]] = True
                repeats[order[:-1][same]] = True
                rep = np.ones(len(h1), bool)
                rep[order[1:][same]] = False
                begin = np.concatenate(([0], ends))[doc]
                # runs that repeat within this slice are marked here; one of them goes on for all
                out = [(h1[rep].view(np.int64), h2[rep].view(np.int64), doc[rep], (first - begin)[rep], (last - first)[rep] + LEAST - 1, (anchor - first)[rep], 1 + repeats[rep])]
                marks = np.flatnonzero(repeats)
                if len(marks):
                    s, e = spans_of(first[marks], last[marks] - first[marks] + LEAST - 1)
                    owner = np.searchsorted(ends, s, side="right")
                    for x, y, o in zip(s.tolist(), e.tolist(), owner.tolist()):
                        while x < y:  # spans of neighbouring documents may touch
                            stop = min(y, int(ends[o]))
                            out.append((None, None, np.array([o]), np.array([x - (int(ends[o - 1]) if o else 0)]), np.array([stop - x]), np.array([0]), np.array([0])))
                            x, o = stop, o + 1
                main, rest = out[0], out[1:]
                unnamed = lambda m: [pa.nulls(m, id_type), pa.nulls(m, pa.int64())]
                id_type = batch.schema.field(0).type
                yield pa.RecordBatch.from_arrays([pa.array(main[0]), pa.array(main[1]), pa.array(numbers[main[2]]), pa.array(main[3]), *(pa.array(x.astype(np.int32)) for x in main[4:]), *unnamed(len(main[0]))], names=names)
                if rest:
                    cols = [np.concatenate([r[i] for r in rest]) for i in range(2, 7)]
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(rest), pa.int64()), pa.nulls(len(rest), pa.int64()), pa.array(numbers[cols[0]]), pa.array(cols[1]), *(pa.array(x.astype(np.int32)) for x in cols[2:]), *unnamed(len(rest))], names=names)
                own = np.unique(doc)  # the name of each row that has a run
                part, none = batch.slice(a, b - a).take(pa.array(own)), pa.nulls(len(own), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, pa.array(numbers[own]), none, *[none.cast(pa.int32())] * 3, part.column(0), part.column(1)], names=names)

    found = stored(docs.mapInArrow(find, schema), "runs")
    every = found.where("h1 is not null").drop("id", "hash")
    named = found.where("n is null").select("doc", "id", "hash")
    anchors = every.groupBy("h1").agg(F.sum("n").alias("n"), (F.min("h2") != F.max("h2")).alias("mixed")).where("n > 1").drop("n")
    shared = stored(every.join(anchors, "h1"), "shared")
    texts = shared.groupBy("h1", "h2", "mixed").agg(F.sum("n").alias("n"), F.min(F.struct("doc", "start", "length", "before")).alias("rep"))
    texts = stored(texts.where("n > 1 or mixed"), "texts")
    many = texts.where("n > 1").select("h1", "h2")
    marks = found.where("h1 is null and n is not null").select("doc", "start", F.col("length").cast("long").alias("length")).union(shared.where("n = 1").join(many, ["h1", "h2"]).select("doc", "start", F.col("length").cast("long")))
    cut = texts.where("mixed").select(F.col("rep.doc").alias("doc"), F.struct("h1", "rep.start", "rep.length", "rep.before", (F.col("n") > 1).alias("many")).alias("at"))
    wanted = cut.groupBy("doc").agg(F.collect_list("at").alias("at")).join(named, "doc")  # at most a run for each byte of the document
    half = (LEAST - GRAM) // 2
    pieces = "doc long, start long, many boolean, side int, key long, text binary"

    def cut_out(batches):
        seen = set()  # rows of one id and text meet the same list
        for batch in batches:
            for row in range(batch.num_rows):
                ident = batch.column(0)[row].as_py()
                if ident in seen:
                    continue
                seen.add(ident)
                raw = (batch.column(1)[row].as_py() or "").encode("utf-8", "surrogatepass")
                data = np.frombuffer(raw, np.uint8)
                at = batch.column(2)[row].as_py()
                starts, sides, keys, own, many_ = [], [], [], [], []
                lo = np.array([x["start"] for x in at])
                anchor = lo + np.array([x["before"] for x in at])
                stop = lo + np.array([x["length"] for x in at])
                h1 = np.array([x["h1"] for x in at], np.int64).view(np.uint64)
                for side, (s, e) in enumerate(((anchor - half, anchor), (anchor + GRAM, anchor + GRAM + half))):
                    ok = np.flatnonzero((s >= lo) & (e <= stop))
                    if not len(ok):
                        continue
                    with np.errstate(over="ignore"):
                        k = _mix(text_hash(data, s[ok], e[ok]) * np.uint64(3) + h1[ok])
                    starts += lo[ok].tolist()
                    sides += [side] * len(ok)
                    keys += k.view(np.int64).tolist()
                    own += [raw[lo[i] : stop[i]] for i in ok]
                    many_ += [at[i]["many"] for i in ok]
                yield pa.RecordBatch.from_arrays([pa.array([ident] * len(starts), pa.int64()), pa.array(starts, pa.int64()), pa.array(many_, pa.bool_()), pa.array(sides, pa.int32()), pa.array(keys, pa.int64()), pa.array(own, pa.binary())], names=["doc", "start", "many", "side", "key", "text"])

    same = docs["id"].eqNullSafe(wanted["id"]) & (docs["hash"] == wanted["hash"])
    sorted_ = docs.join(wanted, same).select("doc", "text", "at").mapInArrow(cut_out, pieces).repartition("side", "key").sortWithinPartitions("side", "key")

    def compare(batches):
        held, size = [], 0

        def flush(rows):
            early, late = repeated_windows([r[5] for r in rows])
            for r, x, y in zip(rows, early, late):
                if not r[2] and len(hit := np.union1d(x, y)):
                    for s, e in zip(*spans_of(hit, np.full(len(hit), LEAST))):
                        yield r[0], r[1] + int(s), int(e - s)

        def emit(rows):
            done = list(flush(rows))
            return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], names=["doc", "start", "length"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                new = bool(held) and (row[3], row[4]) != held[-1][3:5]
                if held and (row[3] != held[-1][3] or new and size > BATCH_BYTES):
                    yield emit(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield emit(held)

    marks = marks.union(sorted_.mapInArrow(compare, "doc long, start long, length long")).groupBy("doc").agg(F.collect_list(F.struct("start", "length")).alias("marks"))
    # rows of one id and text are all marked from end to end if they can be, so that the first stands for all
    return marks.join(named.groupBy("id", "hash").agg(F.min("doc").alias("doc")), "doc").select("id", "hash", "marks")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """One row per row of df: id_col, n_bytes, n_removed, n_spans and kept (binary), or its SHA-256 with digests=True.

    Every byte in a window of LEAST bytes that also starts anywhere else is removed, first copies included. A null text is
    empty. Rows are told apart by id and text, so that ids may repeat or be null; rows of one id and text are copies of
    each other and lose what copies lose. Other columns are not read. An empty table gives no rows.
    """
    kind = dict(df.dtypes)[id_col]
    docs, marks = with_key(df, id_col, text_col), repeated_spans(df, id_col, text_col)
    last = "kept_sha256" if digests else "kept"
    schema = f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, {last} " + ("string" if digests else "binary")

    def run(batches):
        for batch in batches:
            rows = []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = (text or "").encode("utf-8", "surrogatepass")
                begin, end = spans_of(np.array([m["start"] for m in found or ()], np.int64), np.array([m["length"] for m in found or ()], np.int64))
                at, kept = 0, []
                for s, e in zip(begin.tolist(), end.tolist()):
                    kept.append(raw[at:s])
                    at = e
                kept = b"".join([*kept, raw[at:]])
                rows.append((len(raw), len(raw) - len(kept), len(begin), hashlib.sha256(kept).hexdigest() if digests else kept))
            columns = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string() if digests else pa.binary())], names=[id_col, "n_bytes", "n_removed", "n_spans", last])

    same = docs["id"].eqNullSafe(marks["id"]) & (docs["hash"] == marks["hash"])
    return docs.join(marks, same, "left").select(docs["id"], "text", "marks").mapInArrow(run, schema)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: a row for each row of documents, with what remove_repeats() says of nulls, repeated rows and empty tables."""
    return remove_repeats(table(spark, sf_dir, "documents"), digests=True)
