"""Quality scores from histogram gradient-boosted trees over text statistics.

Training works on binned statistics of a bounded sample of labelled texts. The trees are
flattened into arrays, and a task scores all texts of a block at once: one numpy step per
level moves every text down one tree.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language_id import held_out
from .quality_rules import SYMBOLS
from .tokens import SPACE, Block, column, counts_within, grams, map_texts, owners, sums, table

TRAIN_ROWS = 20_000  # labelled texts that are fitted, about; chosen by a hash of the id
BINS = 64

_classes = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "point": b".,;:",
    "end": b".!?",
    "bang": b"!?",
    "quote": b"\"'()[]{}",
    "bar": b"|-=_~",
    "wide": range(128, 256),
}
MASKS = {}
for _name, _bytes in _classes.items():
    MASKS[_name] = np.zeros(256, bool)
    MASKS[_name][list(_bytes)] = True
STATISTICS = [
    "words", "letters_per_word", "longest_word", "distinct_words", "words_per_line", "lines", "empty_lines", "copied_lines", "copied_5grams",
    "copied_2grams", "symbols", "spaces", "ended_lines", "one_letter_words", "top_word", *(f"share_{c}" for c in _classes),
]


def statistics(texts: pa.Array) -> np.ndarray:
    """The statistics of each text, one row per text (all 0 for an empty one)."""
    block = Block(texts)
    starts, stops, first = block.words()
    size = np.maximum(np.diff(block.at), 1)
    count = np.diff(first)
    n = np.maximum(count, 1)
    length = stops - starts
    h = block.hashes(starts, stops)
    owner = owners(first)

    def spread(items: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Share of items that occur twice or more, and the count of the most frequent, by text."""
        times = counts_within(of, items)
        top = np.zeros(block.n, np.int64)
        np.maximum.at(top, of, times)
        total = np.maximum(np.bincount(of, minlength=block.n), 1)
        return np.bincount(of, times >= 2, block.n) / total, top

    times = counts_within(owner, h)
    distinct = np.bincount(owner, 1 / np.maximum(times, 1), block.n)
    top_word = np.zeros(block.n, np.int64)
    np.maximum.at(top_word, owner, times)
    longest = np.zeros(block.n, np.int64)
    np.maximum.at(longest, owner, length)
    five, at5 = grams(h, first, 5)
    two, at2 = grams(h, first, 2)
    ls, le, lf = block.lines()
    filled = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
    lines = np.maximum(np.diff(lf), 1)
    line_owner = owners(lf)
    ended = np.zeros(len(ls), bool)
    some = le > ls
    ended[some] = MASKS["end"][block.data[le[some] - 1]]
    columns = [
        np.log1p(count), sums(length, first) / n, longest, distinct / n, n / lines, np.log1p(lines), 1 - sums(filled, lf) / lines,
        spread(block.hashes(ls, le), line_owner)[0], spread(five, owner[at5])[0], spread(two, owner[at2])[0],
        block.per_text(SYMBOLS[block.data]) / n, block.per_text(SPACE[block.data]) / size, sums(ended, lf) / lines,
        sums(length == 1, first) / n, top_word / n, *(block.per_text(m[block.data]) / size for m in MASKS.values()),
    ]
    out = np.stack(columns, 1)
    out[count == 0] = 0
    return out


@dataclass(frozen=True)
class Trees:
    """Binary trees side by side: ``feature``, ``border``, ``left`` and ``right`` by node; a leaf
    points to itself. ``roots`` has the first node of each tree, ``value`` the leaf scores."""

    roots: np.ndarray
    feature: np.ndarray
    border: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    start: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total = np.full(len(x), self.start)
        row = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[row, self.feature[node]] <= self.border[node], self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, least: int = 8, shrink: float = 2.0) -> Trees:
    """Boosted trees for the log loss on binned columns; one bincount per level fills all histograms."""
    n, width = x.shape
    borders = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)[1:-1])) if n else np.zeros(0) for f in range(width)]
    binned = np.stack([np.searchsorted(b, x[:, f]) for f, b in enumerate(borders)], 1) if n else np.zeros((0, width), int)
    share = min(max(y.mean() if n else 0.5, 1e-3), 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    feature, border, left, right, value, roots = [], [], [], [], [], []
    total = np.full(n, start)
    column_at = np.arange(width) * BINS
    for _ in range(trees if 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-total))
        g, w = y - p, p * (1 - p)
        base = len(feature)
        roots.append(base)
        # node numbers inside the tree: a complete tree of the given depth, unused nodes stay leaves
        size = 2 ** (depth + 1) - 1
        feature += [0] * size
        border += [np.inf] * size
        left += range(base, base + size)
        right += range(base, base + size)
        value += [0.0] * size
        node = np.zeros(n, int)
        for level in range(depth):
            low, here = 2**level - 1, 2**level
            local = node - low
            live = local >= 0
            cell = (local[live, None] * width * BINS + column_at + binned[live]).ravel()
            sized = here * width * BINS
            gs = np.bincount(cell, np.repeat(g[live], width), sized).reshape(here, width, BINS).cumsum(2)
            ws = np.bincount(cell, np.repeat(w[live], width), sized).reshape(here, width, BINS).cumsum(2)
            cs = np.bincount(cell, minlength=sized).reshape(here, width, BINS).cumsum(2)
            ga, wa, ca = gs[..., -1:], ws[..., -1:], cs[..., -1:]
            gain = gs**2 / (ws + shrink) + (ga - gs) ** 2 / (wa - ws + shrink) - ga**2 / (wa + shrink)
            gain[(cs < least) | (ca - cs < least)] = 0
            best = gain.reshape(here, -1).argmax(1)
            for k in range(here):
                f, b = divmod(int(best[k]), BINS)
                if gain[k, f, b] > 1e-6 and b < len(borders[f]):
                    i = base + low + k
                    feature[i], border[i] = f, float(borders[f][b])
                    left[i], right[i] = base + 2 * (low + k) + 1, base + 2 * (low + k) + 2
                    mine = node == low + k
                    node[mine] = np.where(binned[mine, f] <= b, 2 * (low + k) + 1, 2 * (low + k) + 2)
        gsum, wsum = np.bincount(node, g, size), np.bincount(node, w, size)
        step = rate * gsum / (wsum + shrink)
        for i in np.unique(node):
            value[base + i] = float(step[i])
        total += step[node]
    return Trees(*(np.array(a) for a in (roots, feature, border, left, right, value)), start, depth)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, rows: int) -> DataFrame:
    """(doc_id, text, label) of about ``rows`` labelled texts that are not held out.

    Labels that repeat an id count once, by their maximum. At most about ``rows`` ids are
    sent to the tasks that read the texts, so no text is shuffled.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.where("doc_id is not null and label is not null").where(~held_out(F.col("doc_id"), folds, fold))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    total = known.count()
    if total > rows:
        known = known.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.lit(1 << 30)) < int(rows / total * (1 << 30)))
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, fold: int = 1, rows: int = TRAIN_ROWS) -> Trees:
    sample = labelled_sample(docs, labels, label, folds, fold, rows)

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = statistics(column(batch, "text"))
            flat = pa.ListArray.from_arrays(pa.array((np.arange(len(x) + 1) * x.shape[1]).astype(np.int32)), pa.array(x.ravel()))
            return table(doc_id=column(batch, "doc_id"), label=column(batch, "label"), x=flat)

        return each

    # rows that repeat a doc_id count once
    rows_ = map_texts(sample, make, "doc_id long, label int, x array<double>").groupBy("doc_id").agg(F.max(F.struct("label", "x")).alias("r"))
    found = rows_.select("doc_id", "r.*").orderBy("doc_id").collect()
    x = np.array([r["x"] for r in found], float).reshape(len(found), len(STATISTICS))
    return fit(x, np.array([r["label"] > 0 for r in found], float))


def score(docs: DataFrame, model: Trees) -> DataFrame:
    """(doc_id, score, predicted) of every row; a null or empty text has all statistics 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            p = model.score(statistics(column(batch, "text")))
            return table(doc_id=column(batch, "doc_id"), score=p, predicted=(p >= 0.5).astype(np.int32))

        return each

    return map_texts(docs.select("doc_id", "text"), make, "doc_id long, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, fold: int = 1) -> DataFrame:
    """Train on labelled texts that are not held out and score all texts.

    Returns (doc_id, held_out, score, predicted), one row per input row. ``docs`` needs doc_id
    and text, ``labels`` doc_id and the label (0 or 1); other columns are ignored, null ids and
    labels too. Without both labels in the sample every score is the share of label 1 (0.5
    without labels). An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = train(rows, labels, label, folds, fold)
    return score(rows, model).select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", "predicted")
