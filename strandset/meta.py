"""A k-mer set: a lazy DataFrame with a column code (and set_id, taxid where it has them) and what is known of it."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class KmerMeta:
    k: int
    canonical: bool = False
    hashed: bool = False
    scale: int = 1
    global_taxid: int | None = None
    sorted: bool = False
    description: str = ""
    #: Every hash of the set is known to be at most 2^64 / within.
    within: int = 1

    def __post_init__(self):
        if not 1 <= self.k <= 64:
            raise ValueError(f"k must be from 1 to 64, not {self.k}")
        if self.k > 32 and not self.hashed:
            raise ValueError("k-mers of more than 32 bases must be hashed")


@dataclass(frozen=True)
class KmerSet:
    df: DataFrame
    meta: KmerMeta
    ignore_taxid: bool = field(default=False)

    @property
    def has_taxid(self) -> bool:
        return "taxid" in self.df.columns and not self.ignore_taxid

    def with_df(self, df: DataFrame, **changes) -> "KmerSet":
        return KmerSet(df, replace(self.meta, **changes), self.ignore_taxid)


@dataclass(frozen=True)
class SetTable:
    """Many k-mer sets of one kind in one lazy DataFrame: set_id, code and, where they have them, taxid."""

    df: DataFrame
    meta: KmerMeta

    @property
    def has_taxid(self) -> bool:
        return "taxid" in self.df.columns

    def one(self, set_id: str) -> KmerSet:
        return KmerSet(self.df.where(self.df["set_id"] == set_id).drop("set_id"), self.meta)


def check_metas(metas: list[KmerMeta]) -> KmerMeta:
    """Raises ValueError unless sets of such metas can be combined. Returns the meta of the result."""
    if not metas:
        raise ValueError("no k-mer sets given")
    first = metas[0]
    for m in metas[1:]:
        for name in ("k", "canonical", "hashed"):
            if getattr(m, name) != getattr(first, name):
                raise ValueError(f"k-mer sets differ in {name}: {getattr(first, name)} and {getattr(m, name)}")
        if (m.scale > 1) != (first.scale > 1):
            raise ValueError("only some of the k-mer sets are scaled")
    return replace(first, scale=max(m.scale for m in metas), within=min(m.within for m in metas), sorted=False, global_taxid=None)


def check_compatible(sets: list[KmerSet], mix_taxid: bool = False) -> KmerMeta:
    """Raises ValueError, before any job, unless all sets can be combined. Returns the meta of the result."""
    if not sets:
        raise ValueError("no k-mer sets given")
    meta = check_metas([s.meta for s in sets])
    if not mix_taxid and len({s.has_taxid for s in sets}) > 1:
        raise ValueError("only some of the k-mer sets have taxids")
    return meta
