"""A Merkle manifest of a table, by checkpoint and recompute.

The rows of every tree (one tree for each value of a column) are leaves in order. Runs of ``WAYS`` nodes hash to their parent until one
node, the subroot, is left; the subroots in order of their trees are the leaves of one more tree, whose last node is the
root. Only every ``SPAN``-th level is persisted, as blocks: one row holds the at most WAYS ** SPAN nodes of a level below one node of
the next persisted level. The levels between are never stored. Building hashes a block up to its node and drops
what lies between; proving hashes the block again, gives each of its nodes the siblings along its way up, and appends
the way from the block's node on, found the same way one persisted level higher.

A block is bounded whatever the data, so a tree of any size is spread over tasks by (tree, block).
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from risklane.llm.common import let, stage
from risklane.operators.ordered import if_small, positions, running_sums
from risklane.operators.skew import lookup

# Nodes in a run, and what stands for a null field.
WAYS = 3
NO_VALUE = "-"
# Levels from one persisted level to the next.
SPAN = 4
# The name of the one tree over the subroots.
TOP = "top"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of strings joined to one."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value as its UTF-8 byte count, a colon and its text; ``NO_VALUE`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit(NO_VALUE))


def leaf_hash(columns: Sequence[Column]) -> Column:
    return digest(*[field(column) for column in columns])


def tree_key(source: Column) -> Column:
    """A never-null name of a tree. Names sort bytewise as their values do, null first."""
    return F.coalesce(F.concat(F.lit("v"), source.cast("string")), F.lit("n"))


class Manifest(NamedTuple):
    """Blocks of the persisted levels, lowest first, of the trees and of the tree over their subroots; (tree, hash); the root."""

    trees: list[DataFrame]
    top: list[DataFrame]
    subroots: DataFrame
    root: str | None


def parents(hashes: Column) -> Column:
    """Hashes of one level from those of the level below; both start at the edge of a block."""
    runs = F.sequence(F.lit(0), F.floor((F.size(hashes) - 1) / WAYS).cast("int"))
    return F.transform(runs, lambda run: F.sha2(F.array_join(F.slice(hashes, run * WAYS + 1, F.lit(WAYS)), ""), 256))


def nodes_above(nodes: Column, levels: int) -> Column:
    """Nodes of a whole level that lies ``levels`` above one of ``nodes`` nodes."""
    return F.ceil(nodes / WAYS**levels).cast("long")


def reduced(hashes: Column, nodes: Column, level: int = 0) -> Column:
    """The hash of a block's node; a level of one node in all is the last of its tree."""
    if level == SPAN:
        return F.element_at(hashes, 1)
    up = F.when(nodes_above(nodes, level) > 1, parents(hashes)).otherwise(hashes)
    return let(up, lambda above: reduced(above, nodes, level + 1))


def blocks(nodes: DataFrame, label: str) -> DataFrame:
    """Rows (tree, at, nodes, hash, item) of one level as its persisted blocks (tree, block, nodes, run)."""
    grouped = nodes.groupBy("tree", F.floor(F.col("at") / WAYS**SPAN).cast("long").alias("block")).agg(
        F.max("nodes").alias("nodes"), F.array_sort(F.collect_list(F.struct("at", "hash", "item"))).alias("run"))
    return stage(grouped, label)


def climb(level: DataFrame) -> DataFrame:
    """The nodes of the next persisted level."""
    hashes = F.transform("run", lambda node: node["hash"])
    return level.withColumn("hash", let(hashes, lambda found: reduced(found, F.col("nodes")))).select(
        "tree", F.col("block").alias("at"), nodes_above(F.col("nodes"), SPAN).alias("nodes"), "hash",
        F.lit(None).cast("string").alias("item"))


def grow(nodes: DataFrame, most: int, label: str) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of every persisted level, and (tree, hash) of the last nodes. ``most``: leaves of the largest tree."""
    levels = [blocks(nodes, f"{label}-0")]
    while most > WAYS**SPAN:
        levels.append(blocks(climb(levels[-1]), f"{label}-{len(levels)}"))
        most = -(-most // WAYS**SPAN)
    return levels, climb(levels[-1]).select("tree", "hash")


def build(leaves: DataFrame, order: str) -> Manifest:
    """The manifest of ``leaves``: rows (tree, hash, item, and ``order`` inside the tree, null first).

    ``item`` is what a proof is handed out with. Leaves that tie in ``order`` stand by hash; equal leaves are interchangeable. An
    empty table has a manifest without blocks.
    """
    leaves = stage(leaves.select("tree", F.col(order).alias("key"), "hash", "item"), "merkle-leaves")
    sizes = stage(leaves.groupBy("tree").agg(F.count(F.lit(1)).alias("nodes")), "merkle-sizes")
    found = sizes.agg(F.max("nodes").alias("most"), F.count(F.lit(1)).alias("trees")).first()
    placed = running_sums(lookup(leaves, sizes, ["tree"]), ["tree"], ["key", "hash"], {"at": F.lit(1).cast("long")})
    trees, ends = grow(placed, found["most"] or 1, "merkle")
    ends = stage(ends, "merkle-subroots")
    ranked = positions(ends, ["tree"], "at").select(
        F.lit(TOP).alias("tree"), "at", F.lit(found["trees"]).cast("long").alias("nodes"), "hash", F.col("tree").alias("item"))
    top, root = grow(ranked, found["trees"] or 1, "merkle-top")
    last = root.first()
    return Manifest(trees, top, ends, last["hash"] if last else None)


def way_up(index: Column, levels: Sequence[Column], nodes: Column) -> Column:
    """array<struct<before, after>>: the siblings of a node of a block, for each run on its way to the block's node."""
    steps = []
    for level, hashes in enumerate(levels):
        at = F.floor(index / WAYS**level).cast("int")
        first = at - at % WAYS
        run = F.struct(F.slice(hashes, first + 1, at - first).alias("before"),
                       F.slice(hashes, at + 2, first + WAYS - 1 - at).alias("after"))
        steps.append(F.when(nodes_above(nodes, level) > 1, run))
    return F.array_compact(F.array(*steps))


def descend(level: DataFrame, above: DataFrame | None) -> DataFrame:
    """(tree, at, hash, item, proof, and the other columns of ``above``) of every node of a persisted level.

    ``above`` holds the same for the blocks' nodes; None stands for the root, which has no siblings.
    """
    joined = level.withColumn("rest", F.array().cast("array<struct<before:array<string>,after:array<string>>>"))
    if above is not None:
        further = above.select(F.col("tree"), F.col("at").alias("block"), F.col("proof").alias("rest"),
                               *[name for name in above.columns if name not in ("tree", "at", "hash", "item", "proof")])
        joined = level.join(if_small(further), ["tree", "block"])
    nodes, extra = F.col("nodes"), [name for name in joined.columns if name not in (*level.columns, "rest")]

    def ways(levels: list[Column]) -> Column:
        if len(levels) < SPAN:
            return let(parents(levels[-1]), lambda up: ways([*levels, up]))
        return F.transform("run", lambda node, index: F.struct(
            node["at"].alias("at"), node["hash"].alias("hash"), node["item"].alias("item"),
            F.concat(way_up(index, levels, nodes), F.col("rest")).alias("proof")))

    each = let(F.transform("run", lambda node: node["hash"]), lambda hashes: ways([hashes]))
    return joined.select("tree", *extra, F.explode(each).alias("node")).select("tree", "node.*", *extra)


def proofs(manifest: Manifest) -> DataFrame:
    """(tree, at, hash, item, proof, subroot, root) of every leaf.

    The proof lists the siblings of every run from the leaf through the subroot to the root.
    """
    above = None
    for level in reversed(manifest.top):
        above = descend(level, above)
    ends = above.select(F.col("item").alias("tree"), "proof").join(manifest.subroots, "tree")
    above = ends.select("tree", F.lit(0).cast("long").alias("at"), "proof", F.col("hash").alias("subroot"), F.lit(manifest.root).alias("root"))
    for level in reversed(manifest.trees[1:]):
        above = stage(descend(level, above), "merkle-ways")
    return descend(manifest.trees[0], above)


def siblings(proof: Column) -> Column:
    """All siblings of a proof as one string, from the leaf up, left to right."""
    return F.array_join(F.transform(proof, lambda run: F.concat(F.array_join(run["before"], ""), F.array_join(run["after"], ""))), "")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(proof, leaf, lambda value, run: digest(
        F.array_join(run["before"], ""), value, F.array_join(run["after"], "")))


COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def audit(df: DataFrame, text: Column | None = None) -> DataFrame:
    """One row per document: leaf, subroot, root, proof digest, and the root found again from the present ``text``.

    ``text`` is what a reader of the documents holds now (default: the manifest's own text); where it differs, the row
    is not verified. Null fields hash as ``NO_VALUE``, an empty text as a value of no bytes. Documents with a null
    source form the first tree, those with a null id stand first in theirs. Repeated rows are leaves of their own. An
    empty table gives an empty result. Columns other than ``COLUMNS`` are neither hashed nor returned.
    """
    own = leaf_hash([F.col(name) for name in COLUMNS])
    now = own if text is None else leaf_hash([*[F.col(name) for name in COLUMNS[:-1]], text])
    leaves = df.select(tree_key(F.col("source")).alias("tree"), F.col("doc_id"), own.alias("hash"), now.alias("now")).select(
        "tree", "doc_id", "hash", F.struct("doc_id", F.when(F.col("now") != F.col("hash"), F.col("now")).alias("now")).alias("item"))
    proven = proofs(build(leaves, "doc_id"))
    back = folded(F.coalesce("item.now", "hash"), F.col("proof"))
    return proven.select(
        F.col("item.doc_id").alias("doc_id"), F.col("hash").alias("leaf"), "subroot", "root",
        F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"), back.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


def without_line_ends(df: DataFrame) -> Column:
    """The text as a careless copy would hold it: every second document (by checksum of its id) lost its line ends."""
    hit = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 2 == 0, F.lit(False))
    return F.when(hit, F.replace(df["text"], F.lit("\n"), F.lit(""))).otherwise(df["text"])
