"""Boosted trees on the logistic loss: fit with regularisation and patience, score, importance, and per-row attributions.

Fitting is second-order histogram boosting. Features are cut at quantiles into at most ``BINS`` bins, and rows are staged once as blocks of
bin numbers. A level of a tree is one pass over the blocks: every task sums the gradients and curvatures of its rows per
(node, feature, bin), the sums of the tasks are added, and the driver, which sees nothing but those sums, picks the splits.
Gradients are rounded to multiples of 1 / ``GRAIN`` and summed as whole numbers, and rows are drawn by a hash of what they hold, so
the model does not depend on how the rows are dealt to tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, RDD, StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.serializers import BatchedSerializer, CPickleSerializer
from pyspark.sql import Column, DataFrame, functions as F

from risklane.functions.rules import direction
from risklane.staging import spread, stage, staging_root

# Fixed values of the training job: rounds, depth, step, shares of rows and columns, least curvature of a leaf, least gain, L1, L2,
# rounds without a better validation AUC.
ROUNDS, DEPTH, STEP, ROW_SHARE, COLUMN_SHARE, LEAF_WEIGHT = 1000, 6, 0.05, 0.8, 0.8, 10.0
LEAST_GAIN, L1, L2, PATIENCE = 1.0, 0.1, 1.0, 50

BINS = 64
GRAIN = 2.0**20
# Trees grown at once from the same gradients, each on rows and columns of its own: a pass over the rows serves them all.
ABREAST = 8
# Rows of a block, trees after which the margins of all rows are staged anew, and sums that meet in one place.
BLOCK = 65_536
REBASE = 24
FAN = 32
# Steps of the score that the validation AUC is counted on.
AUC_STEPS = 8192


def assemble(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ("TransactionID", "isFraud")) -> DataFrame:
    return VectorAssembler(inputCols=list(names), outputCol="features").transform(df).select(*keep, "features")


@dataclass
class Booster:
    """Trees as flat arrays of nodes: 46 bytes a node. The right child follows the left one; leaves have feature -1.

    ``margin`` is where every row starts, in log-odds like the values of the leaves. ``cover`` is the curvature of the training rows
    that reached a node.
    """

    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    gain: np.ndarray
    margin: float
    features: int

    @property
    def trees(self) -> int:
        return len(self.roots)

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of the rows of a matrix."""
        return self.margin + walked(self, x)

    def head(self, trees: int) -> Booster:
        end = self.roots[trees] if trees < self.trees else len(self.feature)
        return Booster(self.roots[:trees], *[getattr(self, name)[:end] for name in NODE], self.margin, self.features)


NODE = ["feature", "cut", "left", "value", "cover", "gain"]
KINDS = [np.int32, np.float64, np.int32, np.float64, np.float64, np.float64]


def empty(margin: float, features: int) -> Booster:
    return Booster(np.zeros(0, np.int64), *[np.zeros(0, kind) for kind in KINDS], margin, features)


def grown(booster: Booster, nodes: list[list]) -> Booster:
    """The booster with one more tree; ``nodes`` lists NODE fields with children numbered inside the tree."""
    at = len(booster.feature)
    columns = [np.array(column, kind) for column, kind in zip(zip(*nodes), KINDS)]
    columns[2] = np.where(columns[0] >= 0, columns[2] + at, -1).astype(np.int32)
    return Booster(np.append(booster.roots, at), *[np.concatenate([getattr(booster, name), column])
                                                   for name, column in zip(NODE, columns)], booster.margin, booster.features)


# Rows that are walked through a tree together: fewer take gathers, more take one comparison a test.
FEW, MANY = 512, 16_384


def walked(booster: Booster, x: np.ndarray) -> np.ndarray:
    """Sum over the trees, in their order, of the values that rows end in."""
    out = np.zeros(len(x))
    for first in range(0, len(x), MANY):
        part = x[first:first + MANY]
        out[first:first + MANY] = (gathered if len(part) < FEW else compared)(booster, part)
    return out


def gathered(booster: Booster, part: np.ndarray) -> np.ndarray:
    node = np.broadcast_to(booster.roots, (len(part), booster.trees)).copy()
    line = np.arange(len(part))[:, None]
    while True:
        feature = booster.feature[node]
        inner = feature >= 0
        if not inner.any():
            break
        step = booster.left[node] + (part[line, np.maximum(feature, 0)] > booster.cut[node])
        node = np.where(inner, step, node)
    return np.ascontiguousarray(booster.value[node].T).sum(axis=0)      # tree by tree, as in compared


def compared(booster: Booster, part: np.ndarray) -> np.ndarray:
    out, lines = np.zeros(len(part)), np.ascontiguousarray(part.T)
    for root, end in zip(booster.roots, np.append(booster.roots[1:], len(booster.feature))):
        feature, cut, left = (getattr(booster, name)[root:end].tolist() for name in ("feature", "cut", "left"))
        leaves = [node for node, split in enumerate(feature) if split < 0]
        rows = arrivals([(f, c, child - root) for f, c, child in zip(feature, cut, left)], lines)
        out += np.append(0.0, booster.value[root:end][leaves])[numbered(rows, leaves)]
    return out


def bin_edges(df: DataFrame, features: int, bins: int = BINS) -> list[np.ndarray]:
    """Upper edges of the bins of every feature, from one pass of mergeable quantile sketches."""
    probs = ", ".join(repr(i / bins) + "D" for i in range(1, bins))
    cut = df.select(vector_to_array("features").alias("x")).agg(*[
        F.expr(f"percentile_approx(x[{i}], array({probs}), {20 * bins})").alias(f"f{i}") for i in range(features)]).first()
    return [np.unique(np.array(found if found is not None else [], float)) for found in cut]


def blocks(train: DataFrame, val: DataFrame, edges: list[np.ndarray], block: int = BLOCK) -> DataFrame:
    """Rows as blocks (bins, label, draw, val): one row each, bins packed feature by feature."""
    rows = train.select("isFraud", "features", F.lit(0).alias("val")).unionByName(val.select("isFraud", "features", F.lit(1).alias("val")))
    rows = rows.select(vector_to_array("features").alias("x"), F.col("isFraud").cast("int").alias("y"), "val")
    rows = rows.withColumn("draw", F.xxhash64("x", "y"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0                  # Spark's batches are smaller than blocks
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= block:
                whole, full = joined(held), rows - rows % block
                for first in range(0, full, block):
                    yield packed(whole.slice(first, block))
                held, rows = [whole.slice(full)], rows - full
        if rows:
            yield packed(joined(held))

    def joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def packed(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, len(edges))
        bins = np.stack([np.searchsorted(cut, x[:, i]) for i, cut in enumerate(edges)]).astype(np.uint8)
        parts = [bins, batch.column("y").to_numpy().astype(np.uint8), batch.column("draw").to_numpy(), batch.column("val").to_numpy().astype(np.uint8)]
        return pa.RecordBatch.from_arrays([pa.array([part.tobytes()], pa.binary()) for part in parts], ["bins", "label", "draw", "val"])

    return rows.mapInArrow(pack, "bins binary, label binary, draw binary, val binary")


def mixed(values: np.ndarray, seed: int) -> np.ndarray:
    """Hashes in [0, 1) of row hashes for one round."""
    z = values.astype(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15) % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53


def sigmoid(margin: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-margin))


@dataclass
class Growing:
    """A tree being grown: nodes as lists of NODE fields (cuts are bins), those to be split next, and its rows and columns."""

    nodes: list[list]
    open: list[int]
    columns: np.ndarray
    parents: np.ndarray | None = None       # sums of the parents of the open nodes
    swapped: np.ndarray | None = None       # for each parent, whether its right child is the one counted

    def asked(self) -> list[int]:
        """Open nodes whose sums are counted: of two children only the one expected to hold fewer rows."""
        return self.open if self.parents is None else [node + int(swap) for node, swap in zip(self.open[::2], self.swapped)]

    def full(self, found: np.ndarray) -> np.ndarray:
        """Sums of all open nodes from those of the asked ones: the other child is the parent less that one."""
        if self.parents is None:
            return found
        pairs = np.stack([found, self.parents - found], axis=1)
        pairs[self.swapped] = pairs[self.swapped, ::-1]
        return pairs.reshape(-1, *found.shape[1:])

    def halve(self, sample: np.ndarray) -> None:
        """Choose the children to be counted, by where the rows of a sample (feature by feature) go. Only the work depends on it."""
        rows = arrivals(self.nodes, sample)
        self.swapped = np.array([rows[right].sum() < rows[left].sum() for left, right in zip(self.open[::2], self.open[1::2])], bool)


def arrivals(nodes: list[list], bins: np.ndarray) -> list[np.ndarray]:
    """For every node of a tree, which rows pass it. ``bins`` is feature by feature, so a test is one comparison of a line."""
    rows = [np.ones(bins.shape[1], bool)] + [None] * (len(nodes) - 1)
    for node, (feature, cut, left, *_) in enumerate(nodes):         # parents stand before their children
        if feature >= 0:
            right = bins[feature] > cut
            rows[left + 1] = rows[node] & right
            rows[left] = rows[node] ^ rows[left + 1]
    return rows


def numbered(rows: list[np.ndarray], chosen: list[int]) -> np.ndarray:
    """For every row the place in ``chosen``, from 1, of the node it is at; 0 if it is at none of them."""
    kind = np.uint8 if len(chosen) < 256 else np.uint32
    out = np.zeros(len(rows[0]), kind)
    for place, node in enumerate(chosen, 1):
        out += rows[node] * kind(place)
    return out


BLOCKS = ["bins", "label", "draw", "val"]
# Trees whose draws share a byte.
BYTE = 8
# Most blocks of a task, on average.
TASK_BLOCKS = 64

Pair = tuple[tuple[bytes, ...], tuple[bytes, ...]]


def dealt(staged: DataFrame, most: int = TASK_BLOCKS) -> DataFrame:
    """Blocks dealt evenly to as many tasks as there are cores, or a multiple of that. Files as a scan puts them together make a task more
    or less than a multiple, and every pass would wait for it. The order inside a task is fixed, whoever computes it again."""
    numbered = staged.withColumn("at", F.monotonically_increasing_id())
    part = F.shiftright("at", 33)
    counts = dict(numbered.groupBy(part.alias("part")).count().collect())
    total, cores = sum(counts.values()), staged.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(total, cores * -(-total // (cores * most))))
    before = np.cumsum([0, *(counts.get(i, 0) for i in range(max(counts, default=0)))]).tolist()
    place = F.get(F.array(*[F.lit(n) for n in before]), part.cast("int")) + F.col("at").bitwiseAND((1 << 33) - 1)
    return numbered.repartitionById(tasks, (place % tasks).cast("int")).sortWithinPartitions("at").drop("at")


def singly(rdd: RDD) -> RDD:
    """Elements serialized one by one, so that two tables of them can be zipped and a worker holds one block at a time."""
    return rdd._reserialize(BatchedSerializer(CPickleSerializer(), 1))


class Fitter:
    """The staged rows of a fit, and passes over them.

    Two tables stand side by side in the executors, block by block, as plain bytes: the rows themselves, read once, and what a round
    changes: margins, gradients and curvatures in grains, and a bit for each tree of the round that a row is drawn for. The margins of a
    round are those of the round before plus its trees, computed by the first pass of the round; every ``REBASE`` trees they are
    checkpointed, so a lost executor repeats a few trees at most.
    """

    def __init__(self, staged: DataFrame, features: int, margin: float, share: float) -> None:
        self.features, self.share, self.since, self.start = features, share, 0, margin
        spark = staged.sparkSession
        root = staging_root(spark)
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(root)
        # Kept as the bytes that workers are sent.
        self.level = StorageLevel(True, True, False, True)
        self.blocks = singly(dealt(staged.select(*BLOCKS)).rdd.map(lambda row: tuple(bytes(part) for part in row))).persist(self.level)
        self.tasks = self.blocks.getNumPartitions()
        self.state: RDD | None = None
        self.older: list[RDD] = []

    def sample(self) -> np.ndarray:
        """Bins of about a block of rows, some of every block, feature by feature."""
        features, step = self.features, max(1, self.blocks.count())

        def thin(block: tuple[bytes, ...]) -> bytes:
            return np.frombuffer(block[0], np.uint8).reshape(features, -1)[:, ::step].tobytes()

        found = self.blocks.map(thin).collect()
        return np.concatenate([np.frombuffer(packed, np.uint8).reshape(features, -1) for packed in found], axis=1)

    def add(self, trees: list[list[list]], draws: list[int]) -> None:
        """The next round: margins after these trees, whose cuts are bins, and the rows drawn for the trees to come."""
        features, start, share = self.features, self.start, self.share

        def following(pair: Pair) -> tuple[bytes, ...]:
            (bins, label, draw, val), before = pair
            label, val = np.frombuffer(label, np.uint8), np.frombuffer(val, np.uint8)
            bins = np.frombuffer(bins, np.uint8).reshape(features, len(label))
            margin = np.frombuffer(before[0], float) if before else np.full(len(label), start)
            if trees:
                ends = np.empty((len(label), len(trees)))
                for i, nodes in enumerate(trees):
                    leaves = [node for node, (feature, *_) in enumerate(nodes) if feature < 0]
                    values = np.array([0.0, *[nodes[node][3] for node in leaves]])
                    ends[:, i] = values[numbered(arrivals(nodes, bins), leaves)]
                margin = margin + ends.sum(axis=1)
            score = sigmoid(margin)
            drawn = np.zeros((-(-len(draws) // BYTE), len(label)), np.uint8)
            for i, seed in enumerate(draws):
                used = (mixed(np.frombuffer(draw, np.int64), seed) < share) & (val == 0)
                drawn[i // BYTE] |= used * np.uint8(1 << i % BYTE)
            return tuple(part.tobytes() for part in (margin, np.rint((score - label) * GRAIN).astype(np.int32),
                                                     np.rint(score * (1 - score) * GRAIN).astype(np.int32), drawn))

        pairs = self.blocks.map(lambda block: (block, ())) if self.state is None else self.blocks.zip(self.state)
        after = singly(pairs.map(following)).persist(self.level)
        self.since += len(trees)
        if self.since >= REBASE:
            after.checkpoint()
            self.since = 0
        if self.state is not None:
            self.older.append(self.state)
        self.state = after

    def _forget(self) -> None:
        for rows in self.older:
            rows.unpersist()
        self.older = []

    def sums(self, trees: list[Growing], with_val: bool) -> tuple[np.ndarray, np.ndarray]:
        """Sums (node, feature, bin, [gradient, curvature]) of the asked nodes of all trees, in grains, and validation counts
        (label, step). Of a tree's own columns only; the others are left 0.

        While all trees are at their roots, rows are counted once for every byte of draws and dealt to the trees afterwards.
        """
        features = self.features
        shape = (sum(len(tree.asked()) for tree in trees), features, BINS)
        parts = [(tree.nodes, tree.asked(), np.flatnonzero(tree.columns).tolist()) for tree in trees]
        roots = all(asked == [0] for _, asked, _ in parts)

        def task(pairs: Iterator[Pair]) -> Iterator[bytes]:
            total, counts = np.zeros((2, *shape)), np.zeros(2 * AUC_STEPS if with_val else 0)
            by_draws = np.zeros((2, -(-len(parts) // BYTE), features, 256 * BINS)) if roots else None
            for (bins, label, _, val), (margin, *grains, drawn) in pairs:
                weights = [np.frombuffer(part, np.int32).astype(float) for part in grains]
                bins = np.frombuffer(bins, np.uint8).reshape(features, len(weights[0]))
                drawn = np.frombuffer(drawn, np.uint8).reshape(-1, len(weights[0]))
                if with_val:
                    held = np.frombuffer(val, np.uint8) == 1
                    score = sigmoid(np.frombuffer(margin, float)[held])
                    steps = np.minimum((score * AUC_STEPS).astype(int), AUC_STEPS - 1)
                    label = np.frombuffer(label, np.uint8)[held].astype(int)
                    counts += np.bincount(label * AUC_STEPS + steps, minlength=2 * AUC_STEPS)
                if roots:
                    for group, byte in enumerate(drawn):
                        count_bins(by_draws[:, group], byte, 256, bins, range(features), weights)
                    continue
                first = 0
                for i, (nodes, asked, columns) in enumerate(parts):
                    place = numbered(arrivals(nodes, bins), asked) * (drawn[i // BYTE] >> i % BYTE & 1)
                    used = np.flatnonzero(place != 0)
                    if len(used):
                        count_bins(total[:, first:first + len(asked)].swapaxes(1, 2), place[used] - 1, len(asked), bins, columns, weights, used)
                    first += len(asked)
            if roots:
                for i, (*_, columns) in enumerate(parts):
                    mine = np.flatnonzero(np.arange(256) >> i % BYTE & 1)
                    total[:, i, columns] = by_draws[:, i // BYTE, columns].reshape(2, len(columns), 256, BINS)[:, :, mine].sum(axis=2)
            yield np.concatenate([total.ravel(), counts]).tobytes()

        partials, tasks = self.blocks.zip(self.state).mapPartitions(task), self.tasks
        while tasks > FAN:
            # Sums of many tasks are added in a tree, so that few reach the driver.
            tasks = -(-tasks // FAN)
            partials = partials.repartition(tasks).mapPartitions(added)
        both, size = sum(np.frombuffer(found, float) for found in partials.collect()), int(np.prod(shape))
        self._forget()              # the pass has computed this round's state, so those before it are only its lineage
        return np.moveaxis(both[:2 * size].reshape(2, *shape), 0, -1), both[2 * size:].reshape(2, -1)

    def close(self) -> None:
        self._forget()
        for rows in (self.state, self.blocks):
            if rows is not None:
                rows.unpersist()


def count_bins(total: np.ndarray, place: np.ndarray, places: int, bins: np.ndarray, columns: Sequence[int], weights: list[np.ndarray],
               used: np.ndarray | None = None) -> None:
    """Add the weights of the ``used`` rows (all if None) to ``total``: (weight, feature, place, bin). One feature at a time, so that
    what a pass touches stays in the processor's cache."""
    first = place.astype(np.intp) * BINS
    cell = np.empty_like(first)
    weights = weights if used is None else [weight[used] for weight in weights]
    for feature in columns:
        np.add(first, bins[feature] if used is None else bins[feature][used], out=cell)
        for sums, weight in zip(total, weights):
            sums[feature] += np.bincount(cell, weight, minlength=places * BINS).reshape(sums[feature].shape)


def added(partials: Iterator[bytes]) -> Iterator[bytes]:
    total = None
    for packed in partials:
        found = np.frombuffer(packed, float)
        total = found.copy() if total is None else total + found
    if total is not None:
        yield total.tobytes()


def shrunk(gradient: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(gradient) * np.maximum(np.abs(gradient) - l1, 0.0)


def best_splits(sums: np.ndarray, columns: np.ndarray, l1: float, l2: float, least_gain: float, least_weight: float) -> list[tuple | None]:
    """(gain, feature, bin, left sums, right sums) of every node, or None where no split gains enough."""
    below = np.cumsum(sums, axis=2)
    whole = below[:, :, -1:, :]
    above = whole - below

    def worth(part: np.ndarray) -> np.ndarray:
        return shrunk(part[..., 0], l1) ** 2 / (part[..., 1] + l2)

    gain = worth(below) + worth(above) - worth(whole)
    allowed = (below[..., 1] >= least_weight) & (above[..., 1] >= least_weight) & columns[None, :, None]
    gain = np.where(allowed, gain, -np.inf).reshape(len(sums), sums.shape[1] * sums.shape[2])
    found: list[tuple | None] = []
    for node, at in enumerate(gain.argmax(axis=1)):
        feature, cut = divmod(int(at), sums.shape[2])
        good = gain[node, at] >= max(least_gain, 1e-6)
        found.append((float(gain[node, at]), feature, cut, below[node, feature, cut], above[node, feature, cut]) if good else None)
    return found


def auc_of(counts: np.ndarray) -> float:
    """Area under the curve from counts per (label, score step); ties count half."""
    clean, fraud = counts
    if not clean.sum() or not fraud.sum():
        return 0.5
    return float((fraud * (np.cumsum(clean) - clean / 2)).sum() / (clean.sum() * fraud.sum()))


def fit(train: DataFrame, val: DataFrame, rounds: int = ROUNDS, seed: int = 42, patience: int = PATIENCE, depth: int = DEPTH,
        step: float = STEP, row_share: float = ROW_SHARE, column_share: float = COLUMN_SHARE, least_weight: float = LEAF_WEIGHT,
        least_gain: float = LEAST_GAIN, l1: float = L1, l2: float = L2, abreast: int = ABREAST, block: int = BLOCK) -> Booster:
    """Both inputs have ``features`` and ``isFraud``. Rows and columns are drawn for each tree.

    Every ``abreast`` trees come from the same gradients. Ends when ``patience`` trees brought no better AUC of the validation
    rows, and keeps the trees up to the best one.
    """
    features = len(train.select(vector_to_array("features").alias("x")).first()["x"])
    edges = bin_edges(train, features)
    fitter = Fitter(stage(blocks(spread(train), spread(val), edges, block), "blocks"), features, 0.0, row_share)
    sample = fitter.sample()
    rng = np.random.default_rng(seed)
    booster, best, best_auc = empty(0.0, features), 0, -1.0

    def draws() -> list[int]:
        return [seed * 1_000_003 + number for number in range(booster.trees, booster.trees + abreast)]

    fitter.add([], draws())
    more = True
    while more:
        trees = []
        for _ in range(abreast):
            columns = np.zeros(features, bool)
            columns[rng.permutation(features)[:max(1, int(column_share * features))]] = True
            trees.append(Growing([[-1, 0, -1, 0.0, 0.0, 0.0]], [0], columns))
        for level in range(depth):
            sums, counts = fitter.sums(trees, level == 0)
            if level == 0:
                auc = auc_of(counts)
                if booster.trees and auc > best_auc:
                    best, best_auc = booster.trees, auc
                more = booster.trees < rounds and (patience == 0 or booster.trees - best < patience)
                if not more:
                    break
            first = 0
            for tree in trees:
                asked = len(tree.asked())
                mine = tree.full(sums[first:first + asked])
                first += asked
                if level == 0:
                    root = mine[0, int(tree.columns.argmax())].sum(axis=0) / GRAIN
                    tree.nodes[0][3:5] = [leaf_value(root, l1, l2, step), float(root[1])]
                splits = best_splits(mine / GRAIN, tree.columns, l1, l2, least_gain, least_weight)
                tree.parents = mine[[split is not None for split in splits]]
                split_open(tree, splits, l1, l2, step)
                tree.halve(sample)
            if not any(tree.open for tree in trees):
                break
        done = [tree for tree in trees if tree.nodes[0][0] >= 0]
        more = more and bool(done)                  # without a split there is nothing left to gain
        for tree in done if more else []:
            booster = grown(booster, [[f, edges[f][c] if f >= 0 else 0.0, *rest] for f, c, *rest in tree.nodes])
        if more:
            fitter.add([tree.nodes for tree in done], draws())
    fitter.close()
    return booster.head(min(best or booster.trees, rounds))


def split_open(tree: Growing, splits: list[tuple | None], l1: float, l2: float, step: float) -> None:
    """Split the open nodes that gain by it; their children are open next."""
    following = []
    for node, split in zip(tree.open, splits):
        if split is not None:
            gain, feature, cut, *sides = split
            tree.nodes[node][:3], tree.nodes[node][5] = [feature, cut, len(tree.nodes)], gain
            for side in sides:
                following.append(len(tree.nodes))
                tree.nodes.append([-1, 0, -1, leaf_value(side, l1, l2, step), float(side[1]), 0.0])
    tree.open = following


def leaf_value(sums: np.ndarray, l1: float, l2: float, step: float) -> float:
    return float(-shrunk(sums[0], l1) / (sums[1] + l2) * step)


def shipped(model: Booster, df: DataFrame) -> Broadcast:
    """The fields of the model for the executors, which need not have its class."""
    return df.sparkSession.sparkContext.broadcast(tuple(getattr(model, field.name) for field in fields(Booster)))


def score(model: Booster, df: DataFrame, name: str = "score_raw") -> DataFrame:
    """``df`` with the probability of fraud."""
    sent = shipped(model, df)

    @F.pandas_udf("double")
    def probability(x: pd.Series) -> pd.Series:
        return pd.Series(sigmoid(Booster(*sent.value).margins(np.stack(x.to_numpy()))) if len(x) else [], dtype=float)

    return df.withColumn(name, probability(vector_to_array("features")))


def importance(model: Booster, names: Sequence[str], df: DataFrame) -> DataFrame:
    """Mean gain of a feature's splits, as a share of all features'."""
    inner = model.feature >= 0
    total = np.bincount(model.feature[inner], model.gain[inner], minlength=len(names))
    mean = total / np.maximum(np.bincount(model.feature[inner], minlength=len(names)), 1)
    values = (mean / mean.sum() if mean.sum() else mean).tolist()
    return df.sparkSession.createDataFrame(list(zip(names, values)), "feature string, importance double")


def top_features(table: DataFrame, n: int = 20) -> DataFrame:
    return table.orderBy(F.desc("importance"), "feature").limit(n)


def base_value(model: Booster) -> float:
    """The mean margin: every leaf weighed by the training rows that reached it."""
    total = model.margin
    for root in model.roots:
        end = next((r for r in model.roots if r > root), len(model.feature))
        leaves = np.flatnonzero(model.feature[root:end] < 0) + root
        total += float((model.value[leaves] * model.cover[leaves]).sum() / model.cover[root])
    return total


# Tests that are looked up together, and rows that share the tables of such look-ups.
TESTS = 8
TOGETHER = 65_536


def pieces(model: Booster, root: int) -> list[tuple[list[int], set[int]]]:
    """A tree in pieces: (tests on the way to the piece and inside it, nodes on the way and inside it). At most ``TESTS`` tests each,
    or those on the way to a single leaf."""
    def below(node: int) -> list[int]:
        if model.feature[node] < 0:
            return [node]
        left = int(model.left[node])
        return [node, *below(left), *below(left + 1)]

    found, open_nodes = [], [(int(root), [])]
    while open_nodes:
        node, path = open_nodes.pop()
        inside = below(node)
        tests = path + [n for n in inside if model.feature[n] >= 0]
        if len(tests) <= TESTS or model.feature[node] < 0:
            found.append((tests, {*path, *inside}))
        else:
            open_nodes += [(int(model.left[node]) + side, [*path, node]) for side in (0, 1)]
    return found


def contributions(model: Booster, x: np.ndarray) -> np.ndarray:
    """Shapley values (rows x features) of the margins; absent features count with the shares of training rows.

    What the leaves of a piece of a tree are worth depends on a few tests only. It is worked out once for every outcome of them, and
    rows look it up by theirs.
    """
    points, weights = np.polynomial.legendre.leggauss(max(1, (longest_path(model) + 1) // 2))
    lines, out = np.ascontiguousarray(x.T), np.zeros((model.features, len(x)))
    for root in model.roots:
        tables = []
        for tests, nodes in pieces(model, root):
            outcomes = np.arange(2 ** len(tests))
            rights = {node: (outcomes >> i & 1).astype(bool) for i, node in enumerate(tests)}
            tables.append((tests, worths(model, int(root), nodes, rights, len(outcomes), (points + 1) / 2, weights / 2)))
        for first in range(0, len(x), MANY):
            mine = slice(first, first + MANY)
            rights = {node: lines[model.feature[node], mine] > model.cut[node] for node in {n for tests, _ in tables for n in tests}}
            for tests, table in tables:
                code = np.zeros(len(x[mine]), np.uint8 if len(tests) <= 8 else np.uint32)
                for i, node in enumerate(tests):
                    code += rights[node] * code.dtype.type(1 << i)
                code = code.astype(np.intp)
                for feature, values in table.items():
                    out[feature, mine] += values[code]
    return np.ascontiguousarray(out.T)


def worths(model: Booster, root: int, nodes: set[int], rights: dict[int, np.ndarray], rows: int, t: np.ndarray, w: np.ndarray) -> dict[int, np.ndarray]:
    """What the leaves among ``nodes`` of a tree are worth by feature, for rows whose tests come out as ``rights``.

    Of a leaf, feature j is worth value * (o_j - z_j) * the integral over t in (0, 1) of the product, over the other features i of its
    path, of z_i (1 - t) + o_i t, where o is 1 if the row satisfies the feature's tests and z the share of training rows that do.
    The product is a polynomial in t, so a few Gauss points give the integral exactly. Walking a tree keeps the product at
    those points; coming back up, every edge adds what its feature is worth to all leaves below it.
    """
    out: dict[int, np.ndarray] = {}

    def walk(node: int, product: np.ndarray, edges: dict) -> np.ndarray:
        """Sum over the leaves below of value * product."""
        feature = int(model.feature[node])
        if feature < 0:
            return model.value[node] * product
        right = rights[node]
        total = np.zeros_like(product)
        for child, goes in ((int(model.left[node]), ~right), (int(model.left[node]) + 1, right)):
            if child not in nodes:
                continue
            share, inside, factor = edges.get(feature, (1.0, None, None))
            new_share = share * model.cover[child] / model.cover[node]
            new_inside = goes if inside is None else goes & inside
            new_factor = new_share * (1 - t) + new_inside[:, None] * t
            below = walk(child, product * new_factor if factor is None else product * (new_factor / factor),
                         {**edges, feature: (new_share, new_inside, new_factor)})
            worth = (new_inside - new_share)[:, None] / new_factor
            if factor is not None:
                worth = worth - (inside - share)[:, None] / factor     # what the edge above would add for these leaves
            out[feature] = out.get(feature, 0.0) + (below * worth) @ w
            total += below
        return total

    walk(root, np.ones((rows, len(t))), {})
    return out


def longest_path(model: Booster) -> int:
    """Most edges from a root to a leaf."""
    depth = np.zeros(len(model.feature), int)
    for node in np.flatnonzero(model.feature >= 0):         # parents stand before their children
        depth[model.left[node]] = depth[model.left[node] + 1] = depth[node] + 1
    return int(depth.max(initial=0))


def attribute(model: Booster, df: DataFrame, ident: str = "TransactionID") -> DataFrame:
    """(id, x, values, base): additive contributions of every feature value; base + sum = the row's log-odds."""
    sent = shipped(model, df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(part.num_rows for part in held) >= TOGETHER:
                yield from explained(held)
                held = []
        yield from explained(held)

    def explained(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not sum(batch.num_rows for batch in held):
            return
        x = np.concatenate([batch.column(1).flatten().to_numpy() for batch in held])
        rows = len(x) // sent.value[-1]
        values, first = contributions(Booster(*sent.value), x.reshape(rows, -1)), 0
        for batch in held:
            mine = values[first:first + batch.num_rows]
            first += batch.num_rows
            ends = pa.array(np.arange(0, mine.size + 1, mine.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, pa.array(mine.ravel()))], [ident, "x", "values"])

    arrays = df.select(F.col(ident).cast("long").alias(ident), vector_to_array("features").alias("x"))
    return arrays.mapInArrow(run, f"{ident} long, x array<double>, values array<double>").withColumn("base", F.lit(base_value(model)))


def named(values: Column, names: Sequence[str]) -> Column:
    """array<struct<feature, value>> of an attribution array."""
    return F.transform(F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("f"), values.alias("v")),
                       lambda z: F.struct(z["f"].alias("feature"), z["v"].alias("value")))


def top_contributions(attributions: DataFrame, names: Sequence[str], n: int = 10,
                      ident: str = "TransactionID") -> DataFrame:
    """(id, feature, feature_val, shap_value, direction): the ``n`` largest in absolute value of each row.

    Sorted inside the row, so nothing is shuffled.
    """
    zipped = F.arrays_zip(F.array(*[F.lit(name) for name in names]).alias("f"), F.col("x"), F.col("values"))
    keyed = F.transform(zipped, lambda z: F.struct(
        (-F.abs(z["values"])).alias("rank"), z["f"].alias("feature"), z["x"].alias("feature_val"),
        z["values"].alias("shap_value")))
    best = attributions.select(ident, F.explode(F.slice(F.array_sort(keyed), 1, n)).alias("c"))
    return best.select(ident, "c.feature", "c.feature_val", "c.shap_value",
                       direction(F.col("c.shap_value")).alias("direction"))


def mean_contribution(attributions: DataFrame, names: Sequence[str]) -> DataFrame:
    """Mean absolute contribution per feature, in one pass."""
    wide = attributions.agg(*[F.avg(F.abs(F.col("values")[i])).alias(n) for i, n in enumerate(names)])
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("mean_abs")) for n in names])
    return wide.select(F.explode(pairs).alias("p")).select("p.*").orderBy(F.desc("mean_abs"), "feature")
