"""Learners for one bounded training set, fitted inside a task.

A walk-forward has tens of blocks, each with a capped number of training rows. Every block
is one group of a Spark job; these functions fit and apply the models of a group in numpy.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 64


def medians(x: np.ndarray) -> np.ndarray:
    """Exact median of each column without its gaps; 0 for a column of gaps."""
    empty = np.isnan(x).all(0) if len(x) else np.ones(x.shape[1], bool)
    return np.where(empty, 0.0, np.nanmedian(np.where(empty, 0.0, x), axis=0) if len(x) else 0.0)


def filled(x: np.ndarray, middle: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(x), middle, x)


@dataclass
class Linear:
    """Logistic regression on standardised columns; ``c`` is the inverse strength of the L2 penalty."""

    c: float = 0.1
    rounds: int = 60
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    gradient: float = 0.0  # largest entry of the mean gradient where the fit ended

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([(x - self.mean) / self.spread, np.ones(len(x))])

    def fit(self, x: np.ndarray, y: np.ndarray, bins: Bins | None = None) -> "Linear":
        self.mean, spread = x.mean(0), x.std(0)
        self.spread = np.where(spread > 0, spread, 1.0)
        z = self._standard(x)
        penalty = np.full(z.shape[1], 1.0 / self.c)
        penalty[-1] = 0.0
        w = np.zeros(z.shape[1])
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
            slope = z.T @ (p - y) + penalty * w
            self.gradient = float(np.abs(slope).max() / len(y))
            if self.gradient < 1e-10:
                break
            curve = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty) + 1e-9 * np.eye(len(w))
            w = w - np.linalg.solve(curve, slope)
        self.weights = w
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._standard(x) @ self.weights, -35, 35)))


@dataclass
class Tree:
    """A complete binary tree by level: children of node k are 2k + 1 and 2k + 2; feature -1 ends a path."""

    feature: np.ndarray
    border: np.ndarray
    value: np.ndarray

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        row = np.arange(len(x))
        while True:
            f = self.feature[node]
            moving = f >= 0
            if not moving.any():
                return node
            step = 2 * node + 1 + (x[row, np.maximum(f, 0)] > self.border[node])
            node = np.where(moving, step, node)

    def walk(self, row: np.ndarray) -> float:
        """The same for one row, node by node."""
        k = 0
        while self.feature[k] >= 0:
            k = 2 * k + (1 if row[self.feature[k]] <= self.border[k] else 2)
        return float(self.value[k])


@dataclass
class Bins:
    """A table of bin numbers, shared by all trees of a training set: one row of bytes per column."""

    borders: list[np.ndarray]
    codes: np.ndarray

    @property
    def cuts(self) -> np.ndarray:
        return np.array([len(b) for b in self.borders])


def cut(x: np.ndarray) -> Bins:
    """Borders (by quantiles) and bin numbers of each column."""
    borders, codes = [], np.empty(x.shape[::-1], np.uint8)
    for f, column in enumerate(np.ascontiguousarray(x.T)):
        borders.append(np.unique(np.quantile(column, np.linspace(0, 1, BINS)[1:-1])) if len(column) else np.zeros(0))
        codes[f] = np.searchsorted(borders[-1], column)
    return Bins(borders, codes)


def histograms(bins: Bins, features: np.ndarray, rows: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Sums of ``g`` and ``h`` per bin of each feature over several sets of rows: (2, sets, features, BINS)."""
    here = np.concatenate(rows)
    place = np.repeat(np.arange(len(rows)) * BINS, [len(r) for r in rows])
    weights = g[here], h[here]
    cell = np.empty(len(here), np.intp)
    out = np.empty((2, len(features), len(rows) * BINS))
    every = len(here) == bins.codes.shape[1]  # sets of rows have none twice
    for i, f in enumerate(features):
        np.add(bins.codes[f] if every and len(rows) == 1 else bins.codes[f].take(here), place, out=cell)
        for k in (0, 1):
            out[k, i] = np.bincount(cell, weights[k], len(rows) * BINS)
    return out.reshape(2, len(features), len(rows), BINS).transpose(0, 2, 1, 3)


def best_cuts(sums: np.ndarray, cuts: np.ndarray, leaf, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each set in ``histograms``: the place of the best feature, its bin, and the gain (0: no cut)."""
    gs, hs = sums.cumsum(3)
    ga, ha = gs[..., -1:], hs[..., -1:]
    gr, hr = ga - gs, ha - hs
    gain = gs * leaf(gs, hs) + gr * leaf(gr, hr) - ga * leaf(ga, ha)
    gain[(hs < least) | (hr < least) | (np.arange(BINS) >= cuts[..., None])] = 0
    gain = gain.reshape(len(gain), -1)
    top = gain.argmax(1)
    return top // BINS, top % BINS, gain[np.arange(len(gain)), top]


class Growth:
    """Trees over one bin table, on sums of ``g`` and ``h``; ``leaf(G, H)`` is a node's value and its score G * value."""

    def __init__(self, bins: Bins, depth: int, leaf, least: float):
        self.bins, self.depth, self.leaf, self.least = bins, depth, leaf, least
        self.gains = np.zeros(len(bins.borders))

    def shared(self, features: np.ndarray):
        """All nodes look at the same features. Only the smaller child of a node is counted: the
        other one's sums are what is left of the node's."""
        cuts, known = self.bins.cuts[features], {}

        def find(rows: dict[int, np.ndarray], g: np.ndarray, h: np.ndarray):
            counted = [k for k in rows if k == 0 or len(rows[k]) < len(rows[k + 1 if k % 2 else k - 1]) or (len(rows[k]) == len(rows[k + 1 if k % 2 else k - 1]) and k % 2)]
            sums = histograms(self.bins, features, [rows[k] for k in counted], g, h)
            now = {k: sums[:, i] for i, k in enumerate(counted)}
            for k in counted:
                if k:
                    now[k + 1 if k % 2 else k - 1] = known[(k - 1) // 2] - now[k]
            known.clear()
            known.update(now)
            place, at, gain = best_cuts(np.stack([now[k] for k in rows], 1), cuts, self.leaf, self.least)
            return features[place], at, gain

        return find

    def drawn(self, rng: np.random.Generator, keep: int):
        """Every node looks at ``keep`` features of its own."""
        width = len(self.bins.borders)

        def find(rows: dict[int, np.ndarray], g: np.ndarray, h: np.ndarray):
            features = np.stack([np.sort(rng.permutation(width)[:keep]) for _ in rows])
            sums = np.concatenate([histograms(self.bins, own, [mine], g, h) for own, mine in zip(features, rows.values(), strict=True)], 1)
            place, at, gain = best_cuts(sums, self.bins.cuts[features], self.leaf, self.least)
            return features[np.arange(len(features)), place], at, gain

        return find

    def tree(self, find, g: np.ndarray, h: np.ndarray, within: np.ndarray | None = None) -> tuple[Tree, np.ndarray]:
        """One tree, and the node where each row ends. ``within``: the rows that count, if not all."""
        size = 2 ** (self.depth + 1) - 1
        feature, border, node = np.full(size, -1), np.zeros(size), np.zeros(len(g), np.int64)
        rows = {0: np.arange(len(g)) if within is None else within}
        for _ in range(self.depth):
            on, at, gain = find(rows, g, h)
            below = {}
            for (k, mine), f, b, won in zip(rows.items(), on, at, gain, strict=True):
                if won <= 1e-9:
                    continue
                self.gains[f] += won
                feature[k], border[k] = f, self.bins.borders[f][b]
                right = self.bins.codes[f].take(mine) > b
                below[2 * k + 1], below[2 * k + 2] = mine[~right], mine[right]
            for k, mine in below.items():
                node[mine] = k
            rows = below
            if not rows:
                break
        total_g, total_h = np.bincount(node, g, size), np.bincount(node, h, size)
        return Tree(feature, border, self.leaf(total_g, total_h)), node


@dataclass
class Boosted:
    """Gradient-boosted trees for the log loss."""

    trees: int = 150
    depth: int = 4
    rate: float = 0.05
    columns: float = 1.0  # share of the columns each tree may use
    alpha: float = 0.0  # L1 and
    shrink: float = 1.0  # L2 penalty of leaf values
    seed: int = 42
    parts: list[Tree] = field(default_factory=list)
    gains: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def _leaf(self, g, h):
        return np.sign(g) * np.maximum(np.abs(g) - self.alpha, 0) / (h + self.shrink)

    def fit(self, x: np.ndarray, y: np.ndarray, bins: Bins | None = None) -> "Boosted":
        rng = np.random.default_rng(self.seed)
        growth = Growth(bins or cut(x), self.depth, self._leaf, 1.0)
        width, self.parts = x.shape[1], []
        total = np.zeros(len(y))
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-total))
            pick = np.sort(rng.permutation(width)[: max(1, round(self.columns * width))])
            tree, node = growth.tree(growth.shared(pick), y - p, p * (1 - p))
            tree.value = tree.value * self.rate
            self.parts.append(tree)
            total += tree.value[node]
        self.gains = growth.gains
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-sum((t.value[t.leaf(x)] for t in self.parts), np.zeros(len(x)))))

    def predict_row(self, row: np.ndarray) -> float:
        return 1 / (1 + np.exp(-sum(t.walk(row) for t in self.parts)))


@dataclass
class Forest:
    """Mean of trees on bootstrap samples; every node looks at a random root of the columns."""

    trees: int = 200
    depth: int = 6
    seed: int = 42
    parts: list[Tree] = field(default_factory=list)
    gains: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def fit(self, x: np.ndarray, y: np.ndarray, bins: Bins | None = None) -> "Forest":
        rng = np.random.default_rng(self.seed)
        growth = Growth(bins or cut(x), self.depth, lambda g, w: g / np.maximum(w, 1e-9), 5.0)
        keep = max(1, round(x.shape[1] ** 0.5))
        self.parts = []
        for _ in range(self.trees):
            h = np.bincount(rng.integers(0, len(y), len(y)), minlength=len(y)).astype(float)
            self.parts.append(growth.tree(growth.drawn(rng, keep), h * y, h, np.flatnonzero(h))[0])
        self.gains = growth.gains
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sum((t.value[t.leaf(x)] for t in self.parts), np.zeros(len(x))) / max(1, len(self.parts))


KINDS = {"logistic": Linear, "boosted": Boosted, "forest": Forest}


# --- models as rows --------------------------------------------------------

MODEL = "kind string, tree int, node int, feature string, middle double, mean double, spread double, weight double, border double, value double"


def model_rows(kind: str, model, features: list[str], middle: np.ndarray) -> list[dict]:
    """A fitted model as rows of ``MODEL``: one per feature (the median that fills gaps; for the linear
    model centre, scale and weight too), the intercept (no feature, no node), one per tree node."""
    empty = dict.fromkeys(c.split()[0] for c in MODEL.split(", ")) | {"kind": kind}
    rows = [empty | {"feature": f, "middle": float(m)} for f, m in zip(features, middle, strict=True)]
    if isinstance(model, Linear):
        for row, mean, spread, weight in zip(rows, model.mean, model.spread, model.weights, strict=False):
            row |= {"mean": float(mean), "spread": float(spread), "weight": float(weight)}
        return [*rows, empty | {"weight": float(model.weights[-1])}]
    for i, tree in enumerate(model.parts):
        reached, todo = [], [0]
        while todo:
            k = todo.pop()
            reached.append(k)
            if tree.feature[k] >= 0:
                todo += [2 * k + 1, 2 * k + 2]
        for k in sorted(reached):
            f = int(tree.feature[k])
            rows.append(empty | {"tree": i, "node": k, "feature": features[f] if f >= 0 else None, "border": float(tree.border[k]), "value": float(tree.value[k])})
    return rows


def model_from_rows(rows: list[dict]):
    """(model, features, medians) from rows of ``MODEL`` in any order."""
    kind = rows[0]["kind"]
    columns = [r for r in rows if r["middle"] is not None]
    features, middle = [r["feature"] for r in columns], np.array([r["middle"] for r in columns])
    model = KINDS[kind]()
    if kind == "logistic":
        model.mean, model.spread, weights = (np.array([r[c] for r in columns]) for c in ("mean", "spread", "weight"))
        model.weights = np.append(weights, next(r["weight"] for r in rows if r["feature"] is None))
        return model, features, middle
    place = {f: i for i, f in enumerate(features)}
    nodes: dict[int, list[dict]] = {}
    for r in rows:
        if r["tree"] is not None:
            nodes.setdefault(r["tree"], []).append(r)
    for _, own in sorted(nodes.items()):
        size = max(r["node"] for r in own) + 1
        tree = Tree(np.full(size, -1), np.zeros(size), np.zeros(size))
        for r in own:
            k = r["node"]
            tree.feature[k], tree.border[k], tree.value[k] = place.get(r["feature"], -1), r["border"], r["value"]
        model.parts.append(tree)
    return model, features, middle
