"""A taxonomy as root paths numbered in pre-order, the lowest common ancestor as an aggregate, and the rank filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandset.operators.numbering import numbered
from strandset.storage import shared_folder

#: Rank tiers from the highest to the lowest, one a line; ranks in a tier are equal. ! marks unordered ranks.
RANKS = """
!no rank
!clade
life
domain, superkingdom, realm, empire
kingdom
subkingdom
infrakingdom
parvkingdom
superphylum, superdivision
phylum, division
subphylum, subdivision
infraphylum, infradivision
microphylum, microdivision
superclass
class
subclass
infraclass
parvclass
superlegion
legion
sublegion
infralegion
supercohort
cohort
subcohort
infracohort
gigaorder
magnorder, megaorder
grandorder, capaxorder
mirorder, hyperorder
superorder
order
nanorder
hypoorder
minorder
suborder
infraorder
parvorder
gigafamily
megafamily
grandfamily
hyperfamily
superfamily
epifamily
group
family
subfamily
infrafamily
supertribe
tribe
subtribe
infratribe
genus
subgenus
section
subsection
series
subseries
superspecies, species group
species subgroup
species
subspecies, forma specialis, pathovar
pathogroup, serogroup
biotype, serotype, genotype
variety, varietas, morph, aberration
subvariety, subvarietas, submorph, subaberration
form, forma
subform, subforma
strain
isolate
"""


def default_ranks() -> dict[str, int]:
    return parse_ranks(RANKS)[0]


def parse_ranks(text: str) -> tuple[dict[str, int], set[str]]:
    """(order of each rank, unordered ranks) of a rank file: a tier a line, highest first, # for comments, ! before unordered ranks."""
    tiers, loose = [], set()
    for line in text.splitlines():
        line = line.strip().lower()
        if not line or line.startswith("#"):
            continue
        names = [x.strip() for x in line.split(",") if x.strip()]
        loose |= {x.lstrip("!").strip() for x in names if x.startswith("!")}
        if own := [x for x in names if not x.startswith("!")]:
            tiers.append(own)
    return {r: len(tiers) - i for i, tier in enumerate(tiers) for r in tier}, loose


UNORDERED = tuple(sorted(parse_ranks(RANKS)[1]))
#: Taxonomies of so many nodes at most are put in order by the driver, and their paths are broadcast.
SMALL = 50_000
#: Larger ones are broadcast as well if all their paths together are of so many nodes at most.
CELLS = 4_000_000
#: Where the numbers of nodes are joined, rows of one taxid are dealt to so many tasks.
DEALT = 32


def pre_order(nodes: list[tuple[int, int]]) -> list[tuple[int, list[int], int]]:
    """(taxid, path from the root, number in pre-order) of (taxid, parent); a node whose parent is not there is a root, a cycle an error."""
    parents = dict(nodes)
    paths: dict[int, list[int]] = {}
    for start in parents:
        chain, node = [], start
        while node not in paths:
            chain.append(node)
            up = parents[node]
            if up == node or up not in parents:
                paths[node] = [node]
                break
            if len(chain) > len(parents):
                raise ValueError(f"the taxonomy has a cycle at {start}")
            node = up
        for x in reversed(chain):
            if x not in paths:
                paths[x] = paths[parents[x]] + [x]
    return [(t, p, k) for k, (p, t) in enumerate(sorted((p, t) for t, p in paths.items()), 1)]


class Taxonomy:
    """nodes (taxid, parent, rank); merged (old_taxid, new_taxid) renames ids. Paths run from the root, which is its own parent.

    Paths are made when the taxonomy is: by the driver for up to small nodes, else by doubling them in rounds, each written as a
    checkpoint, until all reach a root. More than rounds of them, or a cycle, is an error.
    """

    def __init__(self, nodes: DataFrame, merged: DataFrame | None = None, rounds: int = 32, small: int = SMALL):
        self.nodes, self.merged = nodes.select("taxid", "parent", "rank"), merged
        spark = nodes.sparkSession
        some = self.nodes.select("taxid", F.coalesce("parent", "taxid").alias("parent")).where("taxid is not null").limit(small + 1).collect()
        self.is_small = len(some) <= small
        if self.is_small:
            rows = [(t, p, k) for t, p, k in pre_order([(r["taxid"], r["parent"]) for r in some])]
            self.paths = spark.createDataFrame(rows, "taxid long, path array<long>, tin long")
            return
        shared_folder(spark)
        have = self.nodes.select(F.col("taxid").alias("parent"), F.lit(True).alias("there"))
        rooted = self.nodes.where("taxid is not null").join(have, "parent", "left")
        now = rooted.select("taxid", F.array("taxid").alias("path"), F.when((F.col("parent") != F.col("taxid")) & F.col("there"), F.col("parent")).alias("top")).checkpoint()
        for k in range(rounds + 1):
            if not now.where("top is not null").limit(1).count():
                break
            if k == rounds:
                raise ValueError(f"the taxonomy has a cycle, or more than {1 << rounds} levels")
            up = now.select(F.col("taxid").alias("top"), F.col("path").alias("head"), F.col("top").alias("next"))
            now = now.join(up, "top", "left").select("taxid", F.concat(F.coalesce("head", F.array().cast("array<long>")), "path").alias("path"), F.col("next").alias("top")).checkpoint()
        self.paths = numbered(now.select("taxid", "path"), "path").withColumnRenamed("number", "tin")  # paths in order are the tree in pre-order
        self.is_small = (self.paths.agg(F.sum(F.size("path"))).first()[0] or 0) <= CELLS

    def _known(self) -> DataFrame:
        return F.broadcast(self.paths) if self.is_small else self.paths

    def renamed(self, df: DataFrame) -> DataFrame:
        """df with merged taxids replaced by the new ones."""
        if self.merged is None:
            return df
        new = self.merged.select(F.col("old_taxid").alias("taxid"), F.col("new_taxid"))
        return df.join(new, "taxid", "left").withColumn("taxid", F.coalesce("new_taxid", "taxid")).drop("new_taxid")

    def lca(self, df: DataFrame, keys: list[str], *aggregates: Column, zero_is_absent: bool = True) -> DataFrame:
        """groupBy(keys) with taxid = the lowest common ancestor of the group's taxids, null if none is known, and aggregates.

        The ancestor of a set is that of its first and its last node in pre-order, so the aggregate is a minimum and a maximum.
        """
        bounds = self.bounded(df, zero_is_absent).groupBy(*keys).agg(F.min("tin").alias("lo"), F.max("tin").alias("hi"), *aggregates)
        return self.resolved(bounds).select(*keys, "taxid", *[c for c in bounds.columns if c not in ("lo", "hi", *keys)])

    def bounded(self, df: DataFrame, zero_is_absent: bool = True) -> DataFrame:
        """df with tin, the number of its taxid in pre-order (null if it is unknown or, if that means none, 0)."""
        tin = self._known().select("taxid", "tin")
        rows = self.renamed(df.withColumn("taxid", F.when(F.col("taxid") != 0, F.col("taxid")) if zero_is_absent else F.col("taxid")))
        if self.is_small:
            return rows.join(tin, "taxid", "left")
        # few taxids may have most rows
        tin = tin.withColumn("__deal", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
        return rows.withColumn("__deal", (F.monotonically_increasing_id() % DEALT).cast("int")).join(tin, ["taxid", "__deal"], "left").drop("__deal")

    def resolved(self, bounds: DataFrame) -> DataFrame:
        """bounds with taxid, the lowest common ancestor of the nodes from lo to hi, in their place."""
        a, b = self._known().select(F.col("tin").alias("lo"), F.col("path").alias("x")), self._known().select(F.col("tin").alias("hi"), F.col("path").alias("y"))
        # a node stands at one place of all paths that hold it, so that equal places are the common beginning
        both = F.size(F.filter(F.zip_with("x", "y", lambda u, v: u == v), lambda same: same))
        lca = F.when(both > 0, F.element_at("x", F.greatest(both, F.lit(1)))).alias("taxid")
        keys = [c for c in bounds.columns if c not in ("lo", "hi")]
        if self.is_small:
            return bounds.join(a, "lo", "left").join(b, "hi", "left").select(*keys, lca)
        ends = bounds.select("lo", "hi").distinct().join(a, "lo").join(b, "hi").select("lo", "hi", lca)
        return bounds.join(ends, ["lo", "hi"], "left").select(*keys, "taxid")

    def ancestors(self) -> DataFrame:
        """(taxid, ancestor) with every node its own ancestor."""
        return self.paths.select("taxid", F.explode("path").alias("ancestor"))

    def list_ranks(self) -> DataFrame:
        """(rank) of all nodes, each once."""
        return self.nodes.select(F.lower("rank").alias("rank")).where("rank is not null").distinct()

    def list_order(self, ranks: dict[str, int] | None = None) -> DataFrame:
        """(rank, ord) of the nodes' ranks that have an order; a higher rank has a higher number."""
        order = self.nodes.sparkSession.createDataFrame(sorted((ranks or default_ranks()).items()), "rank string, ord int")
        return self.list_ranks().join(F.broadcast(order), "rank")

    def passing(self, lower: str | None = None, higher: str | None = None, equal: tuple[str, ...] = (), black: tuple[str, ...] = (), discard_unordered: bool = False, climb: bool = False, discard_root: bool = False, root: int = 1, ranks: dict[str, int] | None = None, unordered: tuple[str, ...] = UNORDERED, strict: bool = True) -> DataFrame:
        """The taxids that the rank filter keeps, decided once a node. A node whose rank has no order is an error, or dropped if not strict.

        equal keeps at once; lower keeps ranks below it, higher those above. Unordered ranks have order 0 unless
        discard_unordered drops them; climb then asks the nearest ancestor of an ordered rank, which may equal the cutoff.
        """
        ranks = ranks or default_ranks()
        if lower and higher:
            raise ValueError("lower and higher exclude each other")
        if climb and not (lower and discard_unordered):
            raise ValueError("climbing needs lower and discard_unordered")
        for r in (*(x for x in (lower, higher) if x), *equal):
            if r.lower() not in ranks:
                raise ValueError(f"unknown rank {r}")
        order = F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair])
        nodes = self.nodes.select("taxid", F.lower("rank").alias("rank")).withColumn("loose", F.col("rank").isin(*unordered)).withColumn("ord", F.when(F.col("loose"), F.lit(0)).otherwise(order[F.col("rank")]))
        known = F.col("ord").isNotNull() | F.raise_error(F.concat(F.lit("rank without an order: "), F.coalesce("rank", F.lit("null")))).isNotNull()
        nodes = nodes.where(known if strict else F.col("ord").isNotNull())
        if black:
            nodes = nodes.where(~F.col("rank").isin(*[b.lower() for b in black]))
        if discard_root:
            nodes = nodes.where(F.col("taxid") != root)
        own = F.col("rank").isin(*[e.lower() for e in equal]) if equal else F.lit(False)
        if lower:
            rule = own | (F.col("ord") < ranks[lower.lower()])
        elif higher:
            rule = own | (F.col("ord") > ranks[higher.lower()])
        else:
            rule = own if equal else F.lit(True)
        keep = nodes.where((~F.col("loose") | F.lit(not discard_unordered)) & rule).select("taxid")
        if climb:
            up = self.ancestors().join(nodes.where("loose").select("taxid"), "taxid").join(self.nodes.select(F.col("taxid").alias("ancestor"), order[F.lower("rank")].alias("up")), "ancestor")
            up = up.where("up is not null").join(self.paths.select(F.col("taxid").alias("ancestor"), F.size("path").alias("depth")), "ancestor")
            nearest = up.groupBy("taxid").agg(F.max_by("up", "depth").alias("up"))
            keep = keep.union(nearest.where(F.col("up") <= ranks[lower.lower()]).select("taxid"))
        return keep
