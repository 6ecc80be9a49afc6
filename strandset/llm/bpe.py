"""Byte-level BPE by a segment tree over adjacent pair ranks.

Each pre-token is a row of symbols. The leaves of its segment tree hold, for every adjacent pair,
``rank * width + position`` (or infinity), so the root is the leftmost pair of lowest rank. A merge changes three
leaves, each carried to the root in log(width) steps, until the root is infinity. Rows of one width are merged
together in numpy, so that a step costs a few array operations for thousands of pre-tokens; a very long pre-token is
a row of its own and stays O(n log n).
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TwoGenerationCache, slices, table, text_slices, tokenizer_path

#: Fixed value: the pre-token pattern of the vocabulary.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = np.int64(1) << 62
MEMO = 50_000
PLAIN = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
OTHER_SPACE = re.compile(r"[^\S \n]|\x85")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary: itself if visible, else the next from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


class SegmentTreeBpe:
    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        of_letter = {c: b for b, c in enumerate(letters)}
        self.byte_ids = np.array([vocab[c] for c in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([(vocab[a] << 20) | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or ()}
        self.token_bytes = {i: bytes(of_letter[c] for c in t) for t, i in vocab.items() if all(c in of_letter for c in t)}
        self.token_bytes |= {i: t.encode() for t, i in self.special.items()}
        self.decimal = {i: str(i) for i in self.token_bytes}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pre_token = regex.compile(PRE_TOKEN).findall
        self.forget()

    def forget(self, cache: int = MEMO) -> None:
        """Begins a memo; each task has its own."""
        self.cache = TwoGenerationCache(cache)

    # -- the segment tree ---------------------------------------------------------------------------------------

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1."""
        key = (left << 20) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], -1)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, where each word's ids end)."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        levels = np.zeros(len(words), np.int64)
        big = sizes > 2
        levels[big] = np.ceil(np.log2(sizes[big] - 1)).astype(np.int64)
        parts, where = [], []
        for level in np.unique(levels):
            chosen = np.flatnonzero(levels == level)
            width = 1 << int(level)
            for a, b in slices(len(chosen), max(1, (1 << 18) // width)):
                rows = chosen[a:b]
                ids, counts = self._merge([words[i] for i in rows], sizes[rows], width)
                parts.append((ids, counts))
                where.append(rows)
        counts = np.zeros(len(words), np.int64)
        for rows, (_, n) in zip(where, parts):
            counts[rows] = n
        ends = np.cumsum(counts)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
        for rows, (ids, n) in zip(where, parts):
            inside = np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(ends[rows] - n, n) + inside] = ids
        return out, ends

    def _merge(self, words: list[bytes], sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(words)
        symbol = np.full((n, width + 2), -1, np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        inside = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        symbol[np.repeat(np.arange(n), sizes), inside] = self.byte_ids[flat]
        after = np.broadcast_to(np.arange(1, width + 3), symbol.shape).copy()
        before = np.broadcast_to(np.arange(-1, width + 1), symbol.shape).copy()
        rank = self.rank_of(symbol[:, :width], symbol[:, 1 : width + 1])
        tree = [np.where(rank >= 0, rank * width + np.arange(width), NONE)]
        while tree[-1].shape[1] > 1:
            tree.append(np.minimum(tree[-1][:, 0::2], tree[-1][:, 1::2]))
        leaf, live = tree[0], np.arange(n)
        while True:
            root = tree[-1][live, 0]
            some = root < NONE
            live, root = live[some], root[some]
            if not len(live):
                break
            at = root % width
            gone = after[live, at]
            nxt = after[live, gone]
            made = self.made[root // width]
            symbol[live, at], symbol[live, gone] = made, -1
            after[live, at] = nxt
            before[live, np.minimum(nxt, width + 1)] = at
            prior = before[live, at]
            rank = self.rank_of(made, symbol[live, np.minimum(nxt, width + 1)])
            leaf[live, at] = np.where(rank >= 0, rank * width + at, NONE)
            has = prior >= 0
            prior = np.where(has, prior, at)
            rank = self.rank_of(np.where(has, symbol[live, prior], -1), made)
            leaf[live, prior] = np.where(has, np.where(rank >= 0, rank * width + prior, NONE), leaf[live, prior])
            dead = gone < width
            leaf[live[dead], gone[dead]] = NONE
            for where in (at, prior, np.where(dead, gone, at)):
                here = where
                for k in range(1, len(tree)):
                    here = here >> 1
                    tree[k][live, here] = np.minimum(tree[k - 1][live, 2 * here], tree[k - 1][live, 2 * here + 1])
        stays = symbol >= 0
        return symbol[stays], stays.sum(1)

    # -- texts --------------------------------------------------------------------------------------------------

    def pieces(self, text: str) -> list[str]:
        """Parts of a text that are pre-tokenized alike on their own: a text is cut where a letter meets a space."""
        if self.split_special and "<" in text:
            parts = self.split_special.split(text)
            if len(parts) > 1:
                return [y for x in parts if x for y in ([x] if x in self.special else self.pieces(x))]
        if OTHER_SPACE.search(text):
            return self.pre_token(text)
        return PLAIN.findall(text)

    def learn(self, unknown: list[str]) -> None:
        """Encodes pieces that the memo lacks: piece -> (decimal ids, decoded bytes)."""
        young, stems, marked = self.cache.young, [], []
        for p in unknown:
            # a mark at the end of a word is a pre-token of its own, so that words with and without it are encoded once
            if p[-1] in ".," and p[-2:-1].isalpha():
                marked.append(p)
            else:
                stems.append(p)
        known = young.keys() | set(stems)
        stems += sorted({x for p in marked for x in (p[:-1], p[-1])} - known)
        tokens, ends, pre_token, special = [], [], self.pre_token, self.special
        for p in stems:
            if p[1:].isalpha() and (p[0] == " " or p[0].isalpha()):
                tokens.append(p)
            elif p not in special:
                tokens += pre_token(p)
            ends.append(len(tokens))
        flat, stops = self.encode_words([x.encode("utf-8", "surrogatepass") for x in tokens])
        flat, stops = flat.tolist(), [0, *stops.tolist()]
        as_text, as_bytes = self.decimal, self.token_bytes
        texts, parts = list(map(as_text.__getitem__, flat)), list(map(as_bytes.__getitem__, flat))
        begin = 0
        for p, end in zip(stems, ends):
            stop = stops[end]
            young[p] = (",".join(texts[begin:stop]), b"".join(parts[begin:stop])) if stop > begin else (as_text[special[p]], as_bytes[special[p]])
            begin = stop
        for p in marked:
            (x, y), (v, w) = young[p[:-1]], young[p[-1]]
            young[p] = (f"{x},{v}", y + w)

    def encode(self, texts: list[str]) -> list[tuple[str, bytes]]:
        """For each text its ids in decimal, joined by commas, and the bytes that the ids stand for."""
        cut = [self.pieces(t) for t in texts]
        self.learn(self.cache.missing(set().union(*cut)))
        young, out = self.cache.young, []
        for ps in cut:
            found = [young[p] for p in ps]
            out.append((",".join([x[0] for x in found]), b"".join([x[1] for x in found])))
        self.cache.turn()
        return out


_ENCODERS: dict[str, SegmentTreeBpe] = {}


def encoder(path: str) -> SegmentTreeBpe:
    if path not in _ENCODERS:
        _ENCODERS[path] = SegmentTreeBpe(path)
    return _ENCODERS[path]


def bpe_round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json", folder: str | None = None, digests: bool = False) -> DataFrame:
    """Encodes every whole text and decodes the ids again; one row per row of df.

    Returns id_col and n_tokens with ids (array<int>) and decoded (string), or with digests=True the SHA-256 of the
    decimal ids joined by commas and of the decoded UTF-8, which spares moving the ids out of the task.
    A null text is empty: no ids. Repeated rows give repeated results. Other columns of df are not read.
    """
    kind = dict(df.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")

    def run(batches):
        coder = encoder(tokenizer_path(vocabulary, folder))
        coder.forget()
        for batch in batches:
            texts = batch.column(1)
            for a, b in text_slices(texts, 1024, 1 << 21):
                done = coder.encode([t or "" for t in texts.slice(a, b - a).to_pylist()])
                n = pa.array([s.count(",") + 1 if s else 0 for s, _ in done], pa.int64())
                whole = [d.decode("utf-8", "replace") for _, d in done]
                if digests:
                    more = [pa.array([hashlib.sha256(s.encode()).hexdigest() for s, _ in done]), pa.array([hashlib.sha256(d.encode()).hexdigest() for d in whole])]
                else:
                    more = [pa.array([[int(x) for x in s.split(",")] if s else [] for s, _ in done], pa.list_(pa.int32())), pa.array(whole, pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), n, *more], names=[id_col, "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))])
        coder.forget()

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: a row for each row of documents, with digests of its ids and of what they decode to. Null and empty texts have no
    ids (digests of the empty text); repeated rows, null ids and extra columns do not matter; an empty table gives no rows."""
    return bpe_round_trip(table(spark, sf_dir, "documents"), digests=True)
