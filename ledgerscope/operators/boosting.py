"""M4 / M5: second-order gradient-boosted trees on histograms.

Features are binned once, at approximate quantiles (exactly, where a feature
has few values), and kept as small blocks of bytes.  A level of a tree is one
job: every block adds up the gradients and hessians of the logistic loss per
(node, feature, bin), the blocks' sums are added in a tree, and the driver, which
gets ``nodes x features x bins`` numbers whatever the number of rows, takes each node's best split

    gain = GL^2 / (HL + l2) + GR^2 / (HR + l2) - G^2 / (H + l2)

among splits whose sides both weigh ``min_child_weight`` in hessian; a leaf is worth
``-G / (H + l2)`` times the learning rate.  Blocks carry the margin of all
finished trees: the first level of a tree adds the one before and keeps the blocks in memory;
every ``KEEP_EVERY`` trees they are written to the checkpoint folder, which cuts
their lineage.  A task takes many blocks and gives their sum, so a level has as many
tasks and sums as the cluster has cores (``DIRECT_SUMS`` at least), not as there are blocks.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope.session import checkpoint_dir, ship_package

#: bins of a feature, rows of a block, trees between two checkpoints of the blocks
BINS, BLOCK_ROWS, KEEP_EVERY = 256, 16_384, 10
#: blocks' sums that the driver adds up itself; more are added in the cluster first
DIRECT_SUMS = 32


@dataclass
class Tree:
    """Nodes as a heap: the children of i are 2i + 1 (value <= threshold) and
    2i + 2; a leaf has feature -1."""
    feature: np.ndarray
    bin: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n), np.zeros(n), np.zeros(n))

    def leaf_of(self, x: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """The node of each row; ``cut``: bins or thresholds, as ``x`` has."""
        flat, first = np.ravel(x), np.arange(len(x)) * x.shape[1]
        # a leaf sends its rows to itself: one step is the same for all nodes
        split, ids = self.feature >= 0, np.arange(len(self.feature))
        feature, left, step = np.maximum(self.feature, 0).astype(np.int64), np.where(split, 2 * ids + 1, ids), split.astype(np.int64)
        node = np.zeros(len(x), np.int64)
        for _ in range(int(np.log2(len(self.feature) + 1)) - 1):
            if not split.take(node).any():
                break
            right = flat.take(first + feature.take(node)) > cut.take(node)
            node = left.take(node) + right * step.take(node)
        return node


@dataclass
class BoostedTrees:
    trees: list[Tree] = field(default_factory=list)
    n_features: int = 0

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for t in self.trees:
            total += t.value[t.leaf_of(x, t.threshold)]
        return total

    def importance(self) -> np.ndarray:
        """Mean gain of a feature's splits, as shares of 1."""
        gain, n = np.zeros(self.n_features), np.zeros(self.n_features)
        for t in self.trees:
            split = t.feature >= 0
            np.add.at(gain, t.feature[split], t.gain[split])
            np.add.at(n, t.feature[split], 1)
        mean = gain / np.maximum(n, 1)
        return mean / (mean.sum() or 1.0)

    def probability(self, x: Column) -> Column:
        """Probability of class 1 for an array column of features."""
        model = self

        @F.pandas_udf("double")
        def score(values: pd.Series) -> pd.Series:
            rows = np.array(values.tolist(), dtype=float).reshape(len(values), -1)
            return pd.Series(1 / (1 + np.exp(-model.margin(rows))))
        return score(x)


def cut_points(df: DataFrame, x: str, n: int, bins: int = BINS) -> list[np.ndarray]:
    """Per feature the values at which it may be split, at most ``bins`` - 1."""
    probs = [i / bins for i in range(1, bins)]
    row = df.agg(*[F.percentile_approx(F.col(x)[i], probs, 20 * bins).alias(f"q{i}") for i in range(n)],
                 *[F.max(F.col(x)[i]).alias(f"m{i}") for i in range(n)]).first()
    cuts = [np.unique(np.array(row[f"q{i}"] or [], float)) for i in range(n)]
    return [c[c < row[f"m{i}"]] if len(c) else c for i, c in enumerate(cuts)]  # a split leaves something above it


def _blocks(cuts: list[np.ndarray]):
    """Rows (x, y, w) to blocks (bins, y, w, margin)."""
    def block(rows: list):
        x = np.array([r[0] for r in rows], float).reshape(len(rows), -1)
        bins = np.stack([np.searchsorted(c, x[:, i]) for i, c in enumerate(cuts)], axis=1).astype(np.uint8 if BINS <= 256 else np.uint16)
        return bins, np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float), np.zeros(len(rows))

    def run(rows):
        part = []
        for r in rows:
            part.append(r)
            if len(part) == BLOCK_ROWS:
                yield block(part)
                part = []
        if part:
            yield block(part)
    return run


def _advanced(tree: Tree):
    """Blocks with the margin of ``tree`` added."""
    def run(block):
        bins, y, w, margin = block
        return bins, y, w, margin + tree.value[tree.leaf_of(bins, tree.bin)]
    return run


def _sums(tree: Tree, nodes: np.ndarray):
    """Per partition the (2, nodes, features, bins) sums of gradient and hessian."""
    slot = np.full(len(tree.feature), -1)
    slot[nodes] = np.arange(len(nodes))

    def run(blocks):
        total = None
        for block in blocks:
            bins, y, w, margin = block
            p = 1 / (1 + np.exp(-margin))
            at = slot[tree.leaf_of(bins, tree.bin)]
            some = np.flatnonzero(at >= 0)
            g, h, at, bins = (w * (p - y))[some], (w * p * (1 - p))[some], at[some], bins[some]
            if total is None:
                total = np.zeros((2, bins.shape[1], len(nodes) * BINS))
            for f in range(bins.shape[1]):
                key = at * BINS + bins[:, f]
                total[0, f] += np.bincount(key, g, len(nodes) * BINS)
                total[1, f] += np.bincount(key, h, len(nodes) * BINS)
        if total is not None:
            yield total
    return run


def _best_splits(sums: np.ndarray, cuts: list[np.ndarray], l2: float, min_child_weight: float):
    """Per node: gain, feature and bin of the best split; G and H of the node."""
    g, h = sums  # features, nodes, bins
    total_g, total_h = g[0].sum(axis=1), h[0].sum(axis=1)
    left_g, left_h = g.cumsum(axis=2), h.cumsum(axis=2)
    right_g, right_h = total_g[None, :, None] - left_g, total_h[None, :, None] - left_h
    score = lambda a, b: a * a / (b + l2)
    gain = score(left_g, left_h) + score(right_g, right_h) - score(total_g, total_h)[None, :, None]
    allowed = (left_h >= min_child_weight) & (right_h >= min_child_weight)
    for f, c in enumerate(cuts):
        allowed[f, :, len(c):] = False
    gain = np.where(allowed, gain, -np.inf).transpose(1, 0, 2).reshape(len(total_g), -1)
    best = gain.argmax(axis=1)
    return gain[np.arange(len(best)), best], best // BINS, best % BINS, total_g, total_h


def fit(df: DataFrame, x: str, label: str, weight: str, n_trees: int, max_depth: int, learning_rate: float,
        l2: float = 1.0, min_child_weight: float = 1.0, min_gain: float = 1e-6) -> BoostedTrees:
    """Trees on ``df``: ``x`` an array column, ``label`` 0 or 1, ``weight``."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    ship_package(spark)
    first = df.select(F.size(x)).first()
    model = BoostedTrees(n_features=first[0] if first else 0)
    if not model.n_features:
        return model
    cuts = cut_points(df, x, model.n_features)
    rows = df.select(x, F.col(label).cast("double"), F.col(weight).cast("double"))
    tasks = min(-(-df.count() // BLOCK_ROWS), max(DIRECT_SUMS, spark.sparkContext.defaultParallelism))  # no more than blocks
    blocks = rows.rdd.coalesce(max(1, tasks)).mapPartitions(_blocks(cuts))
    blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
    before = None  # the blocks of the tree before, until those of this one are made
    for nth in range(n_trees):
        tree, nodes = Tree.empty(max_depth), np.array([0])
        for level in range(max_depth + 1):
            parts = blocks.mapPartitions(_sums(tree, nodes))
            sums = parts.treeReduce(np.add, depth=1 if blocks.getNumPartitions() <= DIRECT_SUMS else 2)
            if before is not None:
                before.unpersist()
                before = None
            sums = sums.reshape(2, model.n_features, len(nodes), BINS)
            gain, feature, cut, g, h = _best_splits(sums, cuts, l2, min_child_weight)
            tree.value[nodes] = -learning_rate * g / (h + l2)
            split = (gain > min_gain) & (level < max_depth)
            at = nodes[split]
            tree.feature[at], tree.bin[at], tree.gain[at] = feature[split], cut[split], gain[split]
            tree.threshold[at] = [cuts[f][b] for f, b in zip(feature[split], cut[split])]
            # a child's sums follow from its parent's split: the last level needs no job
            if level == max_depth - 1:
                left = sums[:, feature, np.arange(len(nodes))].cumsum(axis=2)[:, np.arange(len(nodes)), cut]
                for n, (lg, lh), tg, th in zip(nodes[split], left.T[split], g[split], h[split]):
                    tree.value[2 * n + 1] = -learning_rate * lg / (lh + l2)
                    tree.value[2 * n + 2] = -learning_rate * (tg - lg) / (th - lh + l2)
                break
            nodes = np.sort(np.concatenate((2 * at + 1, 2 * at + 2)))
            if not len(nodes):
                break
        model.trees.append(tree)
        if nth < n_trees - 1:
            before, blocks = blocks, blocks.map(_advanced(tree)).persist(StorageLevel.MEMORY_AND_DISK)
            if (nth + 1) % KEEP_EVERY == 0:
                blocks.checkpoint()
    blocks.unpersist()
    return model
