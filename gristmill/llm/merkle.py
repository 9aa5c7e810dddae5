"""A Merkle manifest of a dataset: who holds it can prove a row, and tell which rows were changed.

Every row is a leaf: the SHA-256 of its fields, each with its length. Leaves of one tree (a language, say) stand in order;
each run of FAN nodes becomes their parent until one is left, and the trees' roots, ordered by the trees' names, likewise give
the dataset's root. What is stored of a parent is its preimage, its children's hashes one after the other. So a leaf's proof
needs no search: from each ancestor's preimage it excises its own 64 characters, which leaves the siblings, and to fold
a changed leaf to the root it splices its hash over those 64 characters and hashes again.

Trees are built in tiers of FAN ** DEPTH nodes: a tier's block holds its nodes and the preimages of DEPTH levels, and its
root is a node of the next tier. A block is one group of bounded size, however large a tree is. Going down again, each block
is joined with the preimages above it, which are the same for all its leaves. Places of leaves come from a range sort.

Defined results: nulls are encoded as '-', so null and empty text differ; a null tree name is a tree of its own, before the
others; leaves of equal order stand in the order of their hash, so repeated rows are leaves each; a tree of one leaf is that
leaf; an empty table has no root and no rows; other columns are ignored; texts are hashed whole, however long.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import materialise
from gristmill.llm.ranges import null_first, ordered, with_key

#: Children of a parent, and levels of a tier.
FAN, DEPTH = 2, 8
#: Characters of a hash.
HEX = 64


class Manifest(NamedTuple):
    """tiers and top: blocks of the trees and of the tree of their roots, lowest tier first; root: None for an empty table."""

    tiers: list[DataFrame]
    top: list[DataFrame]
    root: str | None
    fan: int
    depth: int


def encoded(value: Column) -> Column:
    """'-' for null, else the text's UTF-8 byte count, ':' and the text."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(values: list[Column]) -> Column:
    """The leaf hash of a row with these fields."""
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def _div(a: Column, b) -> Column:
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b).cast("long")


def _tier(nodes: DataFrame, fan: int, depth: int) -> DataFrame:
    """tree, n (nodes of the tree here), block, members (at, hash, carry in order), levels (preimages, lowest level first) and root."""
    block = nodes.groupBy("tree", "n", _div(F.col("at"), fan**depth).alias("block")).agg(F.sort_array(F.collect_list(F.struct("at", "hash", "carry"))).alias("members"))  # fan ** depth nodes at most
    steps = F.lit(depth)
    for k in range(depth - 1, -1, -1):
        steps = F.when(F.col("n") <= fan**k, F.lit(k)).otherwise(steps)

    def preimages(nodes: Column) -> Column:
        runs = F.sequence(F.lit(0), _div(F.size(nodes) - 1, fan).cast("int"))
        return F.transform(runs, lambda j: F.array_join(F.slice(nodes, j * fan + 1, F.lit(fan)), ""))

    def climb(a: Column, _: Column) -> Column:
        pre = preimages(a["nodes"])
        return F.struct(F.transform(pre, lambda p: F.sha2(p, 256)).alias("nodes"), F.array_append(a["levels"], pre).alias("levels"))

    begin = F.struct(F.transform("members", lambda m: m["hash"]).alias("nodes"), F.array().cast("array<array<string>>").alias("levels"))
    climbed = F.aggregate(F.slice(F.sequence(F.lit(1), F.lit(depth)), F.lit(1), steps), begin, climb)
    return block.select("tree", "n", "block", "members", climbed.alias("c")).select("tree", "n", "block", "members", "c.levels", F.get("c.nodes", F.lit(0)).alias("root"))


def _grow(nodes: DataFrame, most: int, fan: int, depth: int) -> list[DataFrame]:
    """All tiers over nodes (tree, n, at, hash, carry); most: nodes of the largest tree."""
    tiers, size = [], fan**depth
    while not tiers or most > 1:
        tiers.append(materialise(_tier(nodes, fan, depth), f"tier{len(tiers)}"))
        nodes = tiers[-1].select("tree", _div(F.col("n") + (size - 1), size).alias("n"), F.col("block").alias("at"), F.col("root").alias("hash"), F.lit(None).cast("string").alias("carry"))
        most = -(-most // size)
    return tiers


def build(rows: DataFrame, fields: list[str], tree: str, order: str, carry: dict[str, Column] | None = None, fan: int = FAN, depth: int = DEPTH) -> Manifest:
    """The manifest of rows: leaves of the fields, in trees by the column `tree`, ascending by `order` (nulls first).

    carry: columns of the rows that prove() is to return beside each leaf; they are in no hash.
    """
    if fan < 2 or depth < 1:
        raise ValueError("a parent has two children or more, and a tier a level or more")
    carried = F.struct(*[c.alias(k) for k, c in (carry or {}).items()]) if carry else F.lit(None).cast("string")
    read = rows.select(null_first(tree).alias("tree"), F.col(order).alias("ord"), digest([F.col(f) for f in fields]).alias("hash"), carried.alias("carry"))
    # Written once: texts are read and hashed once, and the row number tells equal rows apart in the range sort.
    leaves = materialise(read.withColumn("row", F.monotonically_increasing_id()), "leaves")
    placed = ordered(leaves, ["tree", "ord", "hash", "row"], "placed").drop("ord", "row")
    trees = materialise(placed.groupBy("tree").agg(F.min("at").alias("first"), F.count("*").alias("n")), "trees")
    total, most = trees.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).head()
    nodes = with_key(placed, trees, "tree", "n", total).withColumn("at", F.col("at") - F.col("first")).drop("first")
    tiers = _grow(nodes, most, fan, depth)
    roots = ordered(tiers[-1].select("tree", "root"), ["tree"], "roots")
    count = trees.count()
    over = roots.select(F.lit("").alias("tree"), F.lit(count).cast("long").alias("n"), "at", F.col("root").alias("hash"), F.col("tree").alias("carry"))
    top = _grow(over, count, fan, depth)
    root = top[-1].select("root").head()  # one row: the top tier is one block
    return Manifest(tiers, top, root and root[0], fan, depth)


def _chain(m: Manifest, j: Column) -> Column:
    """pre and slot of every ancestor, lowest first, of a block's j-th member: those within the block, then those above it."""
    powers = F.array(*[F.lit(m.fan**k).cast("long") for k in range(m.depth + 1)])

    def ancestor(pres: Column, k: Column) -> Column:
        slot = F.pmod(_div(j, F.element_at(powers, k + 1)), F.lit(m.fan))
        return F.struct(F.get(pres, _div(j, F.element_at(powers, k + 2)).cast("int")).alias("pre"), slot.cast("int").alias("slot"))

    return F.concat(F.transform("levels", ancestor), F.col("above"))


def _descend(m: Manifest, tiers: list[DataFrame], above: DataFrame) -> DataFrame:
    """The lowest tier's blocks, each with `above`, its ancestors' preimages in higher tiers; above: tree, block, above and others."""
    rest = [c for c in above.columns if c not in ("tree", "block", "above")]
    for tier in tiers[:0:-1]:
        joined = tier.join(above, ["tree", "block"])
        inner = F.transform("members", lambda x, j: F.struct(x["at"].alias("block"), _chain(m, j).alias("above")))
        above = joined.select("tree", *rest, F.inline(inner))
    return tiers[0].join(above, ["tree", "block"])


def excised(pre: Column, slot: Column) -> Column:
    """The siblings that a preimage names beside the child in this slot."""
    return F.overlay(pre, F.lit(""), slot * HEX + 1, F.lit(HEX))


def spliced(pre: Column, slot: Column, child: Column) -> Column:
    """The preimage with another hash in this slot."""
    return F.overlay(pre, child, slot * HEX + 1, F.lit(HEX))


def prove(m: Manifest, forged: str | None = None) -> DataFrame:
    """What was carried, leaf, subroot, root, siblings (for each level the other hashes of its run, one after the other; empty if alone) and folded_root.

    folded_root is what a verifier gets from the proof's siblings and the leaf, or from the carried column `forged` in its
    place where that isn't null; it is the root if and only if the leaf is the one that the manifest knows.
    """
    empty = F.array().cast("array<struct<pre:string,slot:int>>")
    none = m.top[-1].select("tree", "block", empty.alias("above"))
    lowest = _descend(m, m.top, none)
    of_tree = F.transform("members", lambda x, j: F.struct(x["carry"].alias("tree"), x["hash"].alias("subroot"), _chain(m, j).alias("above")))
    above = materialise(lowest.select(F.inline(of_tree)), "above").withColumn("block", F.lit(0).cast("long"))
    blocks = _descend(m, m.tiers, above)

    def proof(x: Column, j: Column) -> Column:
        chain = _chain(m, j)
        start = F.coalesce(x["carry"][forged], x["hash"]) if forged else x["hash"]
        folded = F.aggregate(chain, start, lambda h, a: F.sha2(spliced(a["pre"], a["slot"], h), 256))
        return F.struct(x["carry"].alias("carry"), x["hash"].alias("leaf"), F.transform(chain, lambda a: excised(a["pre"], a["slot"])).alias("siblings"), folded.alias("folded_root"))

    out = blocks.select("subroot", F.inline(F.transform("members", proof)))
    return out.select("carry", "leaf", "subroot", F.lit(m.root).alias("root"), "siblings", "folded_root")
