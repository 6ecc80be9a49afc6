"""Sum-of-squares packing of token documents into training sequences.

The rule: an item goes where, afterwards, the sum over gaps g of N(g)^2 is smallest, N(g) being the number of open
sequences with g free places; of equal choices the tightest gap. Only lengths matter to the rule, and there are at
most ``capacity`` of them, so the driver packs the histogram of lengths (bounded by capacity rows, whatever the
input) and executors hand the places out: the r-th piece of a length takes the r-th place of that length. Of a
histogram too large to pack one by one, the rule packs the counts divided by some number, all but one of so many copies
of that plan are used, and what is left is packed in the same way. The plan has at most PLAN places a level. Items come
in a drawn order, as the rule expects: longest first, it needs about a hundredth more sequences.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import TwoGenerationCache, slices, stored, table, text_slices, tokenizer_path

PLAN = 100_000
END_ID = 1
#: Letters that have a single small letter and are whole characters in any normal form.
LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
SMALL = re.compile("[a-zß-öø-ÿ]+").fullmatch
#: Tokenizers and which of their tokens end a word, by file; the memo of words is each task's own.
_TOKENIZERS: dict[str, tuple] = {}


class ChunkTokenizer:
    """Ids of a text by the tokenizers library, remembered for each run of letters between blanks and line ends.

    The vocabulary drops white space before anything else looks at the text, so such runs are encoded independently.
    """

    def __init__(self, path: str, cache: int = 60_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path not in _TOKENIZERS:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            ends_word = np.zeros(tokenizer.get_vocab_size(), bool)
            for token, i in tokenizer.get_vocab().items():
                ends_word[i] = token.endswith("</w>")
            _TOKENIZERS[path] = tokenizer, ends_word
        self.tokenizer, self.ends_word = _TOKENIZERS[path]
        self.cache = TwoGenerationCache(cache)

    def encode(self, texts) -> list[bytes]:
        """The ids of each text (strings or an Arrow column of them) as little-endian unsigned 32-bit integers.

        Words are made small, told apart and numbered by Arrow; Python sees each different word of the texts once.
        """
        column = pc.replace_substring(pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), ""), "\n", " ")
        # Latin letters have the same ids small, and a mark that ends a word, itself no part of a run of marks, has its own
        odd = pc.or_(pc.match_substring_regex(column, r"[^\x00-\x{FF}]"), pc.match_substring_regex(column, r"[^\s\pL\pN][.,](?:\s|$)"))
        small = pc.binary_join_element_wise(pc.utf8_lower(column), "", " ")
        for mark in ".,":
            small = pc.replace_substring(small, mark + " ", " " + mark + " ")
        lists = pc.split_pattern(pc.if_else(odd, column, small), " ")
        coded = lists.flatten().dictionary_encode()
        words, number = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        self.learn(self.cache.missing(set(words)))
        known = list(map(self.cache.young.__getitem__, words))
        self.cache.turn()
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        starts, data = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(known), "<u4")
        n = sizes[number]
        ends = np.concatenate(([0], np.cumsum(n)))
        ids = data[np.repeat(starts[number] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        cut = (4 * ends[np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy())))]).tolist()
        return [ids[x:y] for x, y in zip(cut[:-1], cut[1:])]

    def learn(self, unknown: list[str]) -> None:
        """Encodes words that the memo lacks."""
        young, stem_of, whole, plain = self.cache.young, {}, [], []
        for word in unknown:
            if SMALL(word):
                plain.append(word)
                continue
            stem = word[:-1] if word[-1:] in ".," and word[-2:-1].isalpha() else word
            if LATIN(stem) and stem.isalpha():
                stem = stem.lower()
            if stem != word:
                stem_of[word] = stem
            else:
                whole.append(word)
        for word in {*stem_of.values(), ".", ","} - young.keys() - {*whole, *plain} if stem_of else ():
            (plain if SMALL(word) else whole).append(word)
        for a, b in slices(len(plain), 2048):
            # one text of many words, cut where a token ends a word, costs less than as many texts
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(plain[a:b])], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * np.flatnonzero(self.ends_word[ids]) + 4).tolist()
            if len(ends) != b - a:
                whole += plain[a:b]
                continue
            data, begin = ids.tobytes(), 0
            for word, end in zip(plain[a:b], ends):
                young[word] = data[begin:end]
                begin = end
        for a, b in slices(len(whole), 4096):
            for word, found in zip(whole[a:b], self.tokenizer.encode_batch_fast(whole[a:b], add_special_tokens=False)):
                young[word] = np.array(found.ids, "<u4").tobytes()
        for word, stem in stem_of.items():
            young[word] = young[stem] + young[word[-1]] if word[-1] in ".," else young[stem]


def token_pieces(df: DataFrame, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "word_bpe_49k.json", folder: str | None = None, with_ids: bool = True) -> DataFrame:
    """Tokenizes whole texts, ends each with id 1, and cuts those longer than capacity into pieces.

    One row per piece: id_col, piece (from 0), start (its document's ids before it), length, ids_crc32 and, with
    with_ids, ids as array<int>. A null text is empty: one piece that holds only the end. part and place number
    the pieces of equal length within a task, for pack_pieces. Repeated rows are packed one by one.
    """
    kind = dict(df.dtypes)[id_col]
    names = ["piece", "start", "length", "ids_crc32", "part", "place"]
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, part long, place long" + ", ids array<int>" * with_ids

    def run(batches):
        coder, seen, part = ChunkTokenizer(tokenizer_path(vocabulary, folder)), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for a, b in text_slices(batch.column(1), 2048):
                columns, rows, kept = {n: [] for n in names}, [], []
                for row, ids in enumerate(coder.encode(batch.column(1).slice(a, b - a)), a):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        n = len(own) // 4
                        for name, x in zip(names, (piece, at // 4, n, zlib.crc32(own), part, int(seen[n]))):
                            columns[name].append(x)
                        seen[n] += 1
                        rows.append(row)
                        if with_ids:
                            kept.append(np.frombuffer(own, "<u4").astype(np.int32))
                arrays = [batch.column(0).take(pa.array(rows)), pa.array(columns["piece"], pa.int32()), *(pa.array(columns[n], pa.int64()) for n in names[1:])]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(kept, pa.list_(pa.int32()))] * with_ids, names=[id_col, *names] + ["ids"] * with_ids)

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def sum_of_squares(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packs counts[n] items of each length n in a drawn order. Returns (length, sequence, offset) of every place.

    The rule is made for items that come in no order: it keeps sequences open at every gap for those still to come.
    """
    lengths = np.random.default_rng(17).permutation(np.repeat(np.arange(capacity, 0, -1), counts[capacity:0:-1]))
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    n = np.zeros(capacity + 1, np.int64)
    out, offset, sequences = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, s in enumerate(lengths.tolist()):
        # change of the sum for each gap g >= s that is open: g loses one sequence, and g - s, unless full, gains one
        own = n[s:]
        change = 2 * n[: capacity + 1 - s] - 2 * own + 2
        change[0] = 1 - 2 * own[0]
        change[own == 0] = 1 << 40
        best = int(change.argmin())
        fresh = capacity - s
        if change[best] <= (2 * n[fresh] + 1 if fresh else 0):
            gap = best + s
            which = open_at[gap].pop()
            n[gap] -= 1
        else:
            gap, which, sequences = capacity, sequences, sequences + 1
        out[i], offset[i] = which, capacity - gap
        if gap > s:
            open_at[gap - s].append(which)
            n[gap - s] += 1
    return lengths, out, offset


class Plan:
    """Places for every rank of every length: levels of (first rank, copies, places), made from a histogram."""

    def __init__(self, counts: np.ndarray, capacity: int):
        self.capacity, self.levels, done, first = capacity, [], np.zeros(capacity + 1, np.int64), 0
        counts = counts.astype(np.int64).copy()
        full, counts[capacity] = int(counts[capacity]), 0
        first += full
        while counts.any():
            parts = max(1, -(-int(counts.sum()) // PLAN))
            while not (base := counts // parts).any():
                parts //= 2
            m = max(1, parts - 1)  # one part stays with the rest, which has the rare lengths and needs common ones to fill up
            length, sequence, offset = sum_of_squares(base, capacity)
            order = np.argsort(length, kind="stable")
            self.levels.append((done.copy(), base, m, np.cumsum(base) - base, sequence[order], offset[order], first, n := int(sequence.max()) + 1))
            first += n * m
            done += base * m
            counts -= base * m
        self.sequences = first

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.array(rank), np.zeros(len(rank), np.int64)
        for start, base, m, begin, which, at, first, n in self.levels:
            r = rank - start[length]
            here = (length < self.capacity) & (r >= 0) & (r < base[length] * m)
            k, r = length[here], r[here]
            slot = begin[k] + r % base[k]
            sequence[here] = first + (r // base[k]) * n + which[slot]
            offset[here] = at[slot]
        return sequence, offset


def pack_pieces(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Adds sequence_id and offset to the rows of token_pieces; pieces of a sequence lie gapless from 0.

    Pieces are written once, so that the numbers part and place hold when they are read again. An empty table
    gives an empty table.
    """
    pieces = stored(pieces, "pieces")
    some = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = some.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in some.groupBy("length").agg(F.sum("n")).collect():  # at most capacity rows
        counts[length] = n
    plan = Plan(counts, capacity)
    ranked = pieces.join(starts, ["part", "length"]).withColumn("rank", F.col("before") + F.col("place"))
    kept = [c for c in pieces.columns if c not in ("part", "place")]
    schema = pieces.select(*kept).withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema

    def run(batches):
        for batch in batches:
            data = pa.Table.from_batches([batch])
            sequence, offset = plan.places(data["length"].to_numpy(), data["rank"].to_numpy())
            arrays = [batch.column(c) for c in kept] + [pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, "sequence_id", "offset"])

    return ranked.select(*kept, "rank").mapInArrow(run, schema)


def packed_sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id, ids (of at most capacity tokens) and the documents they come from."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))  # a sequence holds capacity tokens at most
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: a row for each piece of each row of documents. Null and empty texts are one piece of length 1; rows that repeat or
    share an id are packed one by one, null ids too; extra columns are not read; an empty table gives no rows."""
    return pack_pieces(token_pieces(table(spark, sf_dir, "documents"), with_ids=False))
