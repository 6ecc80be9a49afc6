"""A hashed maximum-entropy language model with class-factored softmax, beside an add-one unigram score.

Outcomes are the end and every training word, numbered by frequency (END and rarer and rarer words; OTHER is any word
that training lacks). They are the leaves of a tree of CLASSES children a node, frequent words near the root, and
p(word | context) is the product of p(child | context, node) on the way down. A node starts from the shares of the
counts below its children; to these the features of the context add: the word before, the one before that (a skip),
and both (a trigram), by their identities hashed into tables of weights that grow with the square root of the tokens.
OTHER has the Good-Turing share of words seen once.

Counts: every task numbers the words of its block of documents and writes the numbered documents and the block's word
list. Word lists, not texts, meet in the global count, and go back to their block with counts and outcomes attached.
Training: each round the tasks compute gradients and curvature over their share of the tokens, other tasks sum them by
table row and take the step, and the driver passes the new weights on to the next round. Every training token counts in as many rounds as any other: in all of them where
there are few tokens, in one where there are many. Scoring evaluates the triples of a batch in order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cleaned, discard, id_remainder, release, slices, stored, table, text_slices

CLASSES = 16
OUTCOMES = CLASSES * CLASSES  # no model has fewer places for outcomes
OTHER, END = 0, 1
END_WORD = b" "  # no word contains a blank
CLASS_BITS, WORD_BITS, MOST_BITS = 13, 14, 20  # of the smallest tables, and of the largest one
#: Levels of more nodes have their shares computed when they are asked for.
TABLE = 1 << 18
#: Rows of the lower table for each root of the number of tokens.
ROWS = 8
#: Rows of a table whose sums travel in one row of Spark, and such rows whose new weights do.
TOGETHER, STEPPED = 64, 32
ROUNDS, STEP, PRIOR, FARTHEST, LARGEST = 8, 0.4, 2.0, 0.6, 15.0
#: Where a round has more tokens than this, rounds share the tokens out.
ROUND_TOKENS = 250_000
BLOCK_TOKENS = 3_000_000
#: Children of the root by depth of the words below them; the last child holds all that remain.
GROUPS = ((8, 2), (4, 3), (2, 4), (1, 5))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8 with A-Z made small; bytes.split cuts at blanks and the controls 9 to 13."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def numbered_words(texts: pa.Array, numbers: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The words of texts (see words_of) as numbers, each text ended by 0, and the texts' sizes; numbers learns new words.

    Words are told apart by Arrow; Python sees each different word of the texts once.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.cast(pa.binary()).to_pylist()
    own = np.fromiter((numbers.setdefault(w, len(numbers)) if w else -1 for w in words), np.int64, len(words))
    if len(numbers) > 1 << 24:
        raise ValueError("more than 2^24 different words in a block")
    flat = own[coded.indices.to_numpy()]
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
    flat, owner = flat[flat >= 0], owner[flat >= 0]  # blanks at an end leave an empty word
    sizes = np.bincount(owner, minlength=len(texts)) + 1
    out = np.zeros(int(sizes.sum()), np.int64)
    out[np.arange(len(flat)) + owner] = flat
    return out, sizes


def encode_blocks(docs: DataFrame) -> DataFrame:
    """(id, held_out, text) -> for each block its documents as word numbers, and its words with training counts."""
    kind = dict(docs.dtypes)["id"]
    schema = f"block long, id {kind}, held_out boolean, n long, ids binary, word binary, place int"
    names = ["block", "id", "held_out", "n", "ids", "word", "place"]

    def run(batches):
        block, size = TaskContext.get().partitionId() << 24, 0
        numbers: dict[bytes, int] = {END_WORD: 0}
        counts = np.zeros(1, np.int64)

        def word_list():
            n, m, ws = np.append(counts, np.zeros(len(numbers) - len(counts), np.int64)), len(numbers), list(numbers)
            for a, b in slices(m, 20_000):
                none = lambda t: pa.nulls(b - a, t)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, block)), none(id_type), none(pa.bool_()), pa.array(n[a:b]), none(pa.binary()), pa.array(ws[a:b], pa.binary()), pa.array(np.arange(a, b, dtype=np.int32))], names=names)

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for a, b in text_slices(batch.column(2), 1024):
                held = batch.column(1).slice(a, b - a).to_numpy(zero_copy_only=False)
                flat, sizes = numbered_words(batch.column(2).slice(a, b - a), numbers)
                ends = np.cumsum(sizes)
                new = np.bincount(flat[np.repeat(~held.astype(bool), sizes)], minlength=len(numbers))
                new[: len(counts)] += counts
                counts = new
                low, high = (flat & 0xFFFF).astype("<u2"), (flat >> 16).astype(np.uint8)
                packed = [low[x:y].tobytes() + high[x:y].tobytes() for x, y in zip((ends - sizes).tolist(), ends.tolist())]
                none = pa.nulls(b - a, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, block)), batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary()), none, pa.nulls(b - a, pa.int32())], names=names)
                size += len(flat)
                if size > BLOCK_TOKENS:
                    yield from word_list()
                    block, size, numbers, counts = block + 1, 0, {END_WORD: 0}, np.zeros(1, np.int64)
        if id_type is not None:
            yield from word_list()
        numbers, counts = {END_WORD: 0}, None
        release()

    return docs.select("id", "held_out", "text").mapInArrow(run, schema)


def context_bits(used: int) -> tuple[int, int]:
    """Bits of an outcome and of a context word in a packed triple; context words are all distinct up to 2^21 words."""
    bits = max(9, int(used).bit_length())
    return bits, min(bits, (63 - bits) // 2)


def triples(outcomes: np.ndarray, sizes: np.ndarray, used: int) -> np.ndarray:
    """Each token's outcome with the two before it in its document, as one number; used stands for the beginning."""
    bits, own = context_bits(used)
    starts = np.cumsum(sizes) - sizes
    before = np.concatenate(([used], outcomes[:-1])) & ((1 << own) - 1)
    before[starts] = used & ((1 << own) - 1)
    skip = np.concatenate(([used], before[:-1]))
    skip[starts] = used & ((1 << own) - 1)
    return (skip << (own + bits)) | (before << bits) | outcomes


class MaxEnt:
    """used outcomes; counts and times, falling, tell the training counts of outcomes from END on (times outcomes with each)."""

    def __init__(self, used: int, counts=None, times=None, class_bits: int = CLASS_BITS, word_bits: int = WORD_BITS):
        self.used, self.counts, self.times = used, np.array([1] if counts is None else counts), np.array([used - 1] if times is None else times)
        self.class_bits, self.word_bits = class_bits, word_bits
        self.lay(np.zeros(((1 << class_bits) + (1 << word_bits), CLASSES), np.float32))

    def __getstate__(self):
        return self.__dict__ | dict.fromkeys(("_bias", "weights", "classes", "words"))  # tasks get them by broadcasts, see lay

    def lay(self, weights: np.ndarray, bias=None) -> None:
        """Takes the weights of both tables, one after the other, and what bias() returns (None: it is built from the counts)."""
        self.weights = weights.view(np.float32)  # arrays that came by a broadcast have a type object of their own, which numpy adds slowly
        self.classes, self.words, self._bias = self.weights[: 1 << self.class_bits], self.weights[1 << self.class_bits :], bias

    def groups(self):
        """(first outcome, first child of the root, outcomes a child, depth)"""
        first = child = 0
        for children, depth in GROUPS:
            yield first, child, CLASSES ** (depth - 1), depth
            first, child = first + children * CLASSES ** (depth - 1), child + children
        depth = 6
        while first + CLASSES ** (depth - 1) < self.used:
            depth += 1
        yield first, child, CLASSES ** (depth - 1), depth

    def below(self, x: np.ndarray) -> np.ndarray:
        """The training count of all outcomes before x. Outcomes of one count are a stretch, so no list of them is needed."""
        ends, totals = np.cumsum(self.times) + END, np.cumsum(self.counts * self.times)
        k = np.minimum(np.searchsorted(ends, x, "left"), len(ends) - 1)
        return np.maximum(totals[k] - self.counts[k] * (ends[k] - np.clip(x, END, self.used)), 0)

    def node_bias(self, first: np.ndarray, width: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Logs of the shares of the counts below the children of nodes that begin at outcome first and have width outcomes a child, up to stop."""
        edges = np.minimum(first[:, None] + width[:, None] * np.arange(CLASSES + 1), stop[:, None])
        return self.logs(np.diff(self.below(edges), axis=1))

    def far_bias(self, first: np.ndarray, width: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """node_bias of nodes that most often lie in a stretch of outcomes of one count, where all children have the same share."""
        ends, last = np.cumsum(self.times) + END, first + width * CLASSES
        even = (last <= stop) & (np.searchsorted(ends, first, "right") == np.searchsorted(ends, last - 1, "right")) & (first >= END)
        out = np.full((len(first), CLASSES), -np.log(CLASSES), np.float32)
        out[~even] = self.node_bias(first[~even], width[~even], stop[~even])
        return out

    @staticmethod
    def logs(mass: np.ndarray) -> np.ndarray:
        total = mass.sum(-1, keepdims=True)
        return np.where(mass > 0, np.log(np.maximum(mass, 1) / np.maximum(total, 1)), np.where(total > 0, -1e9, 0)).astype(np.float32)

    def bias(self) -> tuple[np.ndarray, np.ndarray]:
        """The table of node_bias for the root and the levels of at most TABLE nodes, and where each group's levels begin (-1: not there)."""
        if self._bias is None:
            groups = list(self.groups())
            rows, at, root = [np.zeros((1, CLASSES), np.float32)], 1, np.zeros(CLASSES)
            begins = np.full((len(groups), max(g[3] for g in groups)), -1)
            for k, (first, child, width, depth) in enumerate(groups):
                stop = groups[k + 1][0] if k + 1 < len(groups) else self.used
                stop = max(min(stop, self.used), first)
                m = -(-(stop - first) // width)
                edges = self.below(np.minimum(first + width * np.arange(m + 1), stop))
                root[child : child + m] = np.diff(edges)
                for level in range(1, depth):
                    own = width // CLASSES ** (level - 1)  # outcomes below a node
                    m = max(1, -(-(stop - first) // own))
                    if m <= TABLE:
                        begins[k, level] = at
                        edges = np.minimum(first + own // CLASSES * np.arange(m * CLASSES + 1), stop)
                        rows.append(self.logs(np.diff(self.below(edges)).reshape(m, CLASSES)))
                        at += m
            rows[0][0] = self.logs(root)
            self._bias = np.concatenate(rows), begins
        return self._bias

    def steps(self, code: np.ndarray):
        """Level by level down the tree: which codes, their rows in the table of that level, shares of the children, the right child."""
        bits, own = context_bits(self.used)
        outcome, before, skip = code & ((1 << bits) - 1), (code >> bits) & ((1 << own) - 1), code >> (bits + own)
        table, begins = self.bias()
        with np.errstate(over="ignore"):
            b, s = before.astype(np.uint64) * np.uint64(2) + np.uint64(1), skip.astype(np.uint64) * np.uint64(2) + np.uint64(2)
            features = np.stack([b * _MIX, s * _MIX, (s * _MIX ^ b) * np.uint64(0xC2B2AE3D27D4EB4F) + s])
            features = (features >> np.uint64(32)).astype(np.uint32)
        groups = list(self.groups())
        first_of = np.array([g[0] for g in groups])
        group = np.searchsorted(first_of, outcome, "right") - 1
        first, root, width, depth = (np.array(x)[group] for x in zip(*groups))
        inner = outcome - first
        for level in range(max(g[3] for g in groups)):
            at = np.flatnonzero(depth > level) if level > 1 else np.arange(len(code))
            if not len(at):
                break
            if level == 0:
                node, child, weights, size = np.zeros(len(at), np.int64), root + inner // width, self.classes, self.class_bits
            else:
                below = width[at] // CLASSES**level  # leaves below a child
                begin, place = begins[group[at], level], inner[at] // (below * CLASSES)
                child, weights, size = inner[at] // below % CLASSES, self.words, self.word_bits
                node = begin + place
                if (begin < 0).any():  # levels too long for the table; their nodes are numbered after it
                    node = np.where(begin < 0, (group[at] + 1) << 56 | level << 48 | place, node)
            if level and (begin < 0).any():
                z = np.empty((len(at), CLASSES), np.float32)
                far = begin < 0
                z[~far] = np.take(table, node[~far], axis=0)
                stop = np.minimum(np.append(first_of[1:], self.used)[group[at][far]], self.used)
                z[far] = self.far_bias(first[at][far] + place[far] * below[far] * CLASSES, below[far], stop)
            else:
                z = np.take(table, node, axis=0)
            with np.errstate(over="ignore"):
                own = (node ^ node >> 32).astype(np.uint32) * np.uint32(0x9E3779B1)
                rows = (features if len(at) == len(code) else features[:, at]) + own
                rows ^= rows >> np.uint32(15)
                rows = (rows * np.uint32(0x85EBCA77) >> np.uint32(32 - size)).astype(np.int64)
            for own in rows:
                z += np.take(weights, own, axis=0)
            yield level, at, rows, z, child

    def log10(self, code: np.ndarray) -> np.ndarray:
        out = np.zeros(len(code))
        for a, b in slices(len(code), 50_000):
            for _, at, _, z, child in self.steps(code[a:b]):
                z = z.astype(float)
                own = z[np.arange(len(at)), child]
                out[a + at] += own - np.log(np.einsum("ij->i", np.exp(z, out=z)))  # shares and bounded weights cannot overflow
        return out / np.log(10)

    def gradients(self, code: np.ndarray, n: np.ndarray, sums: list[np.ndarray] | None = None) -> list[np.ndarray]:
        """For both tables, by row and child: how often the right child was seen, and how often the model expected each child.

        The gradient of the log likelihood is seen less expected. Adds to sums if they are given.
        """
        sums = sums or [np.zeros((2, 1 << bits, CLASSES), np.float32) for bits in (self.class_bits, self.word_bits)]
        children = np.arange(CLASSES)
        for a, b in slices(len(code), 50_000):
            weight = n[a:b].astype(np.float32)
            for level, at, places, z, child in self.steps(code[a:b]):
                w, (seen, expected) = weight[at], sums[level > 0]
                z = z.view(np.float32)  # the table of shares came by a broadcast, see lay
                np.exp(z, out=z)
                z *= (w / np.einsum("ij->i", z))[:, None]
                for rows in places:
                    rows = rows * CLASSES
                    np.add.at(seen.reshape(-1), rows + child, w)
                    np.add.at(expected.reshape(-1), (rows[:, None] + children).reshape(-1), z.reshape(-1))
        return sums


def unpacked(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The outcomes of documents one after the other, and the documents' sizes."""
    packed = ids.to_pylist()
    sizes = np.array([len(p) // 4 for p in packed], np.int64)
    parts = [np.frombuffer(p, "<u2", m).astype(np.int64) | np.frombuffer(p, "<u2", m, 2 * m).astype(np.int64) << 16 for p, m in zip(packed, sizes.tolist())]
    return np.concatenate(parts) if parts else np.empty(0, np.int64), sizes


def shares_of(tokens: int, rounds: int) -> int:
    """Into how many shares the tokens are dealt, of which each round takes one."""
    return min(max(tokens // ROUND_TOKENS, 1), rounds)


def packed_sums(base: int, total: np.ndarray):
    """Sums of a table (see MaxEnt.gradients) whose rows are numbered from base on: (chunk, rows, sums) for each TOGETHER rows of which some were touched."""
    keys = np.flatnonzero(total[1].any(1))
    for a, b in slices(len(keys), 10_000):
        place, values = base + keys[a:b], np.concatenate(total[:, keys[a:b]], axis=1)
        chunks, begins = np.unique(place // TOGETHER, return_index=True)
        rows, cuts = (place % TOGETHER).astype(np.uint8), list(zip(begins.tolist(), [*begins[1:].tolist(), b - a]))
        yield pa.RecordBatch.from_arrays([pa.array(chunks), pa.array([rows[x:y].tobytes() for x, y in cuts], pa.binary()), pa.array([values[x:y].tobytes() for x, y in cuts], pa.binary())], names=["chunk", "rows", "sums"])


def new_weights(batches, weights: np.ndarray):
    """Adds what packed_sums gave, and takes the step: (places, weights), the numbers of rows of the tables and what they now hold."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, rows, values in zip(*(c.to_pylist() for c in batch.columns)):
            if chunk not in sums:
                sums[chunk] = np.zeros((TOGETHER, 2 * CLASSES))
            sums[chunk][np.frombuffer(rows, np.uint8)] += np.frombuffer(values, np.float32).reshape(-1, 2 * CLASSES)
    chunks = sorted(sums)
    for a, b in slices(len(chunks), STEPPED):
        total = np.concatenate([sums[c] for c in chunks[a:b]]).astype(np.float32)
        touched = np.flatnonzero(total[:, CLASSES:].any(1))
        place, total = (np.array(chunks[a:b])[:, None] * TOGETHER + np.arange(TOGETHER)).reshape(-1)[touched], total[touched]
        own = weights[place]
        own = np.clip(own + update(own, total[:, :CLASSES], total[:, CLASSES:]), -LARGEST, LARGEST)
        yield pa.RecordBatch.from_arrays([pa.array([place.astype(np.int32).tobytes()], pa.binary()), pa.array([own.astype(np.float32).tobytes()], pa.binary())], names=["places", "weights"])


def train(docs: DataFrame, model: MaxEnt, tokens: int, rounds: int = ROUNDS, tables=None) -> MaxEnt:
    """Distributed updates over (share, ids): gradients by task, summed and stepped by row of the tables, at most all rows' new weights to the driver.

    tables is a broadcast of model.bias(). Weights go out by a broadcast for each round, which ends with it: what the
    driver holds does not grow with the rounds.
    """
    shares = shares_of(tokens, rounds)
    spark = docs.sparkSession
    context = spark.sparkContext
    tables = tables or context.broadcast(model.bias())  # TABLE bounds it
    for k in range(rounds):
        weights = context.broadcast(model.weights)

        def run(batches, weights=weights):
            model.lay(weights.value, tables.value)
            sums = None
            for batch in batches:
                for a, b in slices(batch.num_rows, 1024):
                    flat, sizes = unpacked(batch.column(0).slice(a, b - a))
                    sums = model.gradients(*np.unique(triples(flat, sizes, model.used), return_counts=True), sums)
            for base, total in zip((0, 1 << model.class_bits), sums or ()):
                yield from packed_sums(base, total)
            release()

        def step(batches, weights=weights):
            yield from new_weights(batches, weights.value.view(np.float32))
            release()

        own = docs.where(F.col("share") == k % shares).select("ids").coalesce(context.defaultParallelism)
        with cleaned(spark):
            new = own.mapInArrow(run, "chunk long, rows binary, sums binary").repartition("chunk").mapInArrow(step, "places binary, weights binary").toArrow()
        weights.destroy()
        for places, values in zip(new["places"].to_pylist(), new["weights"].to_pylist()):
            model.weights[np.frombuffer(places, np.int32)] = np.frombuffer(values, np.float32).reshape(-1, CLASSES)
        del new, own, run, step
        release()
    return model


def update(weights: np.ndarray, seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """A damped Newton step: gradient over a bound of the curvature, the sum of p (1 - p) being at most that of the mean p."""
    total = np.maximum(expected.sum(1, keepdims=True), 1e-30)
    step = STEP * (seen - expected - PRIOR * weights) / (expected * (1 - np.minimum(expected / total, 1)) + PRIOR)
    return np.clip(step, -FARTHEST, FARTHEST).astype(np.float32)


def by_frequency(counts: DataFrame) -> DataFrame:
    """(word, outcome) for the training words but END_WORD, numbered from 2 on by falling count, then by word."""
    rows = counts.where((F.col("c") > 0) & (F.col("word") != F.lit(END_WORD))).repartitionByRange(F.desc("c"), F.col("word")).sortWithinPartitions(F.desc("c"), "word")

    def run(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(np.arange(at, at + batch.num_rows))], names=["word", "part", "at"])
            at += batch.num_rows

    ranked = stored(rows.select("word").mapInArrow(run, "word binary, part int, at long"), "ranked")
    sizes = {r["part"]: r["n"] for r in ranked.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    begins, total = [], 2
    for part in sorted(sizes):
        begins.append((part, total))
        total += sizes[part]
    offsets = counts.sparkSession.createDataFrame(begins, "part int, begin long")  # a row for each partition
    return ranked.join(F.broadcast(offsets), "part").select("word", (F.col("at") + F.col("begin")).alias("outcome"))


def language_scores(df: DataFrame, training, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score.

    training is a condition on df's columns: the rows to learn from. A null text is empty: its only token is the end.
    Without training rows no token is known and every word has the probability that the empty counts give.
    """
    kind = dict(df.dtypes)[id_col]
    docs = df.select(F.col(id_col).alias("id"), (~training).alias("held_out"), F.col(text_col).alias("text"))
    blocks = stored(encode_blocks(docs), "blocks")
    listed = blocks.where("word is not null").select("block", "word", "place", "n")
    counts = stored(listed.groupBy("word").agg(F.sum("n").alias("c")), "counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    spectrum = counts.where((F.col("c") > 0) & (F.col("word") != F.lit(END_WORD))).groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("c")).toArrow()
    ends = counts.where(F.col("word") == F.lit(END_WORD)).agg(F.coalesce(F.max("c"), F.lit(0))).first()[0]
    values, times = spectrum["c"].to_numpy(), spectrum["n"].to_numpy()
    once = int(times[values == 1].sum()) + (ends == 1)
    used = 2 + int(times.sum())
    word_bits = min(MOST_BITS, max(WORD_BITS, int(np.ceil(np.log2(ROWS * np.sqrt(n + 1))))))
    model = MaxEnt(used, np.append(max(ends, 1), values), np.append(1, times), max(CLASS_BITS, word_bits - 3), word_bits)
    # hashed, for a partition's different words are few beside the rows that ask for them, which then need no sort
    words = listed.drop("n").join(counts.join(by_frequency(counts).hint("shuffle_hash"), "word", "left").hint("shuffle_hash"), "word")
    words = words.select("block", "place", "c", F.when(F.col("word") == F.lit(END_WORD), END).otherwise(F.coalesce("outcome", F.lit(OTHER))).cast("int").alias("outcome"))
    told = blocks.where("word is null").select("block", "id", "held_out", "ids")
    all_log, other_log, seen_log = float(np.log10(n + v + 1)), float(np.log10((once + 1) / (n + once + 2))), float(np.log10((n + 1) / (n + once + 2)))

    def number(docs: pa.Table, dictionary: pa.Table) -> pa.Table:
        order = np.argsort(dictionary["place"].to_numpy())
        c, outcome = dictionary["c"].to_numpy()[order], dictionary["outcome"].to_numpy()[order].astype(np.int64)
        logs, seen = np.log10(c + 1.0), (c > 0).astype(np.int64)
        packed, out = docs["ids"].to_pylist(), []
        sizes = np.array([len(p) // 3 for p in packed], np.int64)
        for p, m in zip(packed, sizes.tolist()):
            ids = np.frombuffer(p, "<u2", m).astype(np.int32) | np.frombuffer(p, np.uint8, m, 2 * m).astype(np.int32) << 16
            own = outcome[ids]
            out.append(((own & 0xFFFF).astype("<u2").tobytes() + (own >> 16).astype("<u2").tobytes(), int(seen[ids].sum()), float(logs[ids].sum()) - m * all_log))
        ids, known, base = zip(*out) if out else ((), (), ())
        part = (docs["block"].to_numpy() * 31 + np.arange(len(packed))) % (1 << 20)  # documents in turn
        return pa.table({"id": docs["id"], "held_out": docs["held_out"], "part": pa.array(part), "ids": pa.array(ids, pa.binary()), "n_tokens": pa.array(sizes), "n_known": pa.array(known, pa.int64()), "base_score": pa.array(base, pa.float64())})

    schema = f"id {kind}, held_out boolean, part long, ids binary, n_tokens long, n_known long, base_score double"
    numbered = told.groupBy("block").cogroup(words.withColumnRenamed("block", "of").groupBy("of")).applyInArrow(number, schema)
    numbered = stored(numbered.withColumn("share", (F.col("part") % shares_of(n, ROUNDS)).cast("int")), "numbered", by="share")  # a round reads its share only
    for used_up in (blocks, counts):
        discard(used_up)
    context = df.sparkSession.sparkContext
    tables = context.broadcast(model.bias())
    train(numbered.where("not held_out").select("share", "ids"), model, n, tables=tables)
    weights = context.broadcast(model.weights)

    def score(batches):
        model.lay(weights.value, tables.value)
        for batch in batches:
            for a, b in slices(batch.num_rows, 1024):
                flat, sizes = unpacked(batch.column(6).slice(a, b - a))
                codes, logs = triples(flat, sizes, used), np.full(len(flat), other_log)
                known = np.flatnonzero(flat != OTHER)
                known = known[np.argsort(codes[known])]  # equal contexts together, which read the same rows
                logs[known] = model.log10(codes[known]) + seen_log
                own = np.add.reduceat(logs, np.cumsum(sizes) - sizes)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(6)), pa.array(own)], names=names)
        release()

    names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    shown = numbered.select("id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "ids")
    return shown.mapInArrow(score, f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(table(spark, sf_dir, "documents"), id_remainder("doc_id", 7) != 2)
