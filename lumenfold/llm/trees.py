"""Small gradient-boosted trees for bounded samples, and their form as Spark columns."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Node:
    """A split (``feature`` <= ``at`` goes left) or, with feature -1, a leaf."""

    value: float = 0.0
    feature: int = -1
    at: float = 0.0
    left: Node | None = None
    right: Node | None = None


@dataclass
class Boosted:
    bias: float = 0.0
    trees: list[Node] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for t in self.trees:
            out += tree_values(t, x)
        return out


def tree_values(t: Node, x: np.ndarray) -> np.ndarray:
    if t.feature < 0:
        return np.full(len(x), t.value)
    left = x[:, t.feature] <= t.at
    return np.where(left, tree_values(t.left, x), tree_values(t.right, x))


def cut_points(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Thresholds halfway between neighbouring values, at most ``bins`` for each feature, by quantiles."""
    out = []
    for j in range(x.shape[1]):
        v = np.unique(x[:, j])
        mid = (v[1:] + v[:-1]) / 2
        if len(mid) > bins:
            mid = np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 2)[1:-1]))
            mid = mid[mid < v[-1]]
        out.append(mid)
    return out


def grow(codes: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int, least: int, l2: float, rows: np.ndarray | None = None) -> Node:
    """A regression tree on histograms of gradients; ``codes[i, j]`` counts the cuts of feature j below row i."""
    rows = np.arange(len(codes)) if rows is None else rows
    g, h = grad[rows].sum(), hess[rows].sum()
    node = Node(value=float(-g / (h + l2)))
    if depth == 0 or len(rows) < 2 * least:
        return node
    best, base = 1e-9, g * g / (h + l2)
    for j, cut in enumerate(cuts):
        if not len(cut):
            continue
        c = codes[rows, j]
        n = np.bincount(c, minlength=len(cut) + 1).cumsum()[:-1]
        gl = np.bincount(c, grad[rows], len(cut) + 1).cumsum()[:-1]
        hl = np.bincount(c, hess[rows], len(cut) + 1).cumsum()[:-1]
        gain = gl**2 / (hl + l2) + (g - gl) ** 2 / (h - hl + l2) - base
        gain[(n < least) | (len(rows) - n < least)] = -1
        k = int(gain.argmax())
        if gain[k] > best:
            best, node.feature, node.at, where = float(gain[k]), j, float(cut[k]), k
    if node.feature >= 0:
        left = codes[rows, node.feature] <= where
        node.left = grow(codes, cuts, grad, hess, depth - 1, least, l2, rows[left])
        node.right = grow(codes, cuts, grad, hess, depth - 1, least, l2, rows[~left])
    return node


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, least: int = 10, l2: float = 1.0, bins: int = 64) -> Boosted:
    """Logistic gradient boosting. One class alone, or no rows, gives the smoothed prior and no trees."""
    p = (y.sum() + 0.5) / (len(y) + 1)
    model = Boosted(float(np.log(p / (1 - p))))
    if len(np.unique(y)) < 2:
        return model
    cuts = cut_points(x, bins)
    codes = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
    margin = np.full(len(y), model.bias)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-margin))
        t = grow(codes, cuts, q - y, q * (1 - q), depth, least, l2)
        if t.feature < 0:
            break
        scaled(t, rate)
        margin += tree_values(t, x)
        model.trees.append(t)
    return model


def scaled(t: Node, rate: float) -> None:
    t.value *= rate
    if t.feature >= 0:
        scaled(t.left, rate)
        scaled(t.right, rate)


def tree_column(t: Node, features: list[str]) -> Column:
    if t.feature < 0:
        return F.lit(t.value)
    return F.when(F.col(features[t.feature]) <= t.at, tree_column(t.left, features)).otherwise(tree_column(t.right, features))


def margin_column(model: Boosted, features: list[str]) -> Column:
    out = F.lit(model.bias)
    for t in model.trees:
        out = out + tree_column(t, features)
    return out
