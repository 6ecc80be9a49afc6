"""K-mer codes as column expressions: two bits a base, first base highest, in a signed long that holds 64 bits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The degenerate bases and what they stand for.
DEGENERATE = {
    "A": "A", "C": "C", "G": "G", "T": "T", "U": "U",
    "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}
SIGN = -(1 << 63)


def encode(kmer: Column) -> Column:
    """The code of an ACGT string of up to 32 bases; 32 T give -1, all bits set."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, -10).cast("long")


def lowest(code: Column, k: int) -> Column:
    """The bits of the last k bases; a code of more bases loses its first ones."""
    return code if k >= 32 else code.bitwiseAND(F.lit((1 << 2 * k) - 1))


def decode(code: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(F.hex(lowest(code, k)), 16, 4), k, "0"), "0123", "ACGT")


def checked_decode(code: Column, k: int) -> Column:
    """decode that raises where the code has more than 2k bits."""
    if not 1 <= k <= 32:
        raise ValueError("k must be from 1 to 32")
    text = decode(code, k)
    if k == 32:
        return text
    over = (code < 0) | (code >= F.lit(1 << (2 * k)))
    return F.when(over, F.raise_error(F.concat(F.lit(f"code too large for k={k}: "), unsigned_text(code)))).otherwise(text)


def reverse_complement(kmer: Column) -> Column:
    return F.reverse(F.translate(kmer, "ACGT", "TGCA"))


def canonical_text(kmer: Column) -> Column:
    """The lesser of a k-mer and its reverse complement; text order is code order."""
    return F.least(kmer, reverse_complement(kmer))


def canonical(code: Column, k: int) -> Column:
    return encode(canonical_text(decode(code, k)))


def unsigned_key(code: Column) -> Column:
    """A signed number in the order of the unsigned one."""
    return code.bitwiseXOR(F.lit(SIGN))


def unsigned_text(code: Column) -> Column:
    return F.conv(F.hex(code), 16, 10)


def bits(code: Column, k: int) -> Column:
    return F.lpad(F.conv(F.hex(lowest(code, k)), 16, 2), 2 * k, "0")


def low_complexity(code: Column, k: int, threshold: int = 15, window: int = 7, same: int = 3, other: int = 1, compat: bool = True) -> Column:
    """Whether a window of bases, read from the last one, scores threshold or more.

    A base scores same if it equals the one read before it, else other. compat keeps the customary windows, which
    leave out the last one; otherwise every window counts.
    """
    window = min(window, k)
    base = lambda i: F.shiftrightunsigned(code, 2 * i).bitwiseAND(F.lit(3))
    scores = [F.lit(other)] + [F.when(base(i) == base(i - 1), F.lit(same)).otherwise(F.lit(other)) for i in range(1, k)]
    last = max(0, k - window - 1) if compat else k - window
    sums = [reduce(lambda a, b: a + b, scores[i : i + window]) for i in range(last + 1)]
    return reduce(lambda a, b: a | b, [s >= threshold for s in sums])


def _followed_by(letters: Column):
    return lambda head: F.transform(letters, lambda x: F.concat(head, x))


def expand_degenerate(kmer: Column, k: int) -> Column:
    """All k-mers that a degenerate one stands for, as an array; letters keep their case."""
    table = F.create_map(*[F.lit(x) for a, b in DEGENERATE.items() for pair in ((a, b), (a.lower(), b.lower())) for x in pair])
    out = F.array(F.lit(""))
    for i in range(k):
        letters = F.filter(F.split(table[F.substring(kmer, i + 1, 1)], ""), lambda x: x != "")
        out = F.flatten(F.transform(out, _followed_by(letters)))
    return out
