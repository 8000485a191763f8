"""Toxicity scores from a bidirectional gated recurrent network with attention pooling.

Every word enters as the sum of a word part and of a character part (the mean over its
character n-grams), both looked up in tables; what is not there adds nothing. Two gated recurrent passes, one from each
end, run over a window of words; attention weights pool their states into one vector, and its
score says whether the window is toxic. A text scores the highest of its overlapping windows.

Training, in numpy, sees text labels only: of a toxic text the windows that look most toxic
count as toxic, of a clean text its hardest windows and some others as clean. In the first
round n-gram counts by class tell how a window looks, then the network does.

Spark counts the words and n-grams of the training texts by class; tasks then look at every
window of every training text and hand on, as table rows, those the counts find most telling
and some others. The driver never sees a text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .language_id import held_out
from .letters import Words
from .quality_model import labelled_sample
from .tokens import column, map_texts, table

WINDOW, STRIDE = 32, 16  # words of a window, and between the starts of windows
WORD_ROWS, CHAR_ROWS = 1 << 16, 1 << 16  # most words and character n-grams that have vectors
WIDTH = 8  # units of each direction
ATTENTION = 8
INPUT = 12  # numbers of the word and the character vectors
LENGTHS = (3, 4)  # characters of an n-gram, word borders included
TRAIN_LABELS = 16_000  # labelled texts that are read, about
TRAIN_TEXTS = 2_000  # of these, fitted in each class at most: the first by a hash of the id
TRAIN_WINDOWS = 64  # windows of one text used in fitting: half the most telling of all, half spread over the others
SUPPORT, SUPPORT_SHARE = 8, 0.02  # toxic texts that must hold a word or n-gram with a vector; or this share, if less
SLICE = 1 << 14  # words whose n-grams are summed at once
STEPS = 500  # least steps of the fit: small samples are gone through more often
F32 = np.float32


def _place(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Row of each hash: its place among the known ones from 1 on, or 0."""
    if not len(known):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[at] == h, at + 1, 0)


def support(texts: pa.Array, toxic: np.ndarray) -> pa.RecordBatch:
    """How many toxic and clean texts of a block hold each word and each n-gram (kind, h, toxic, clean)."""
    words = Words(texts)
    h, sample, word = np.unique(words.whole(), return_index=True, return_inverse=True)
    parts = [words.grams(sample, n) for n in LENGTHS]
    grams, gram = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    of = np.concatenate([w for _, w in parts])
    order = np.argsort(of, kind="stable")
    gram, begin = gram[order], np.searchsorted(of[order], np.arange(len(h) + 1))
    columns: dict[str, list[np.ndarray]] = {k: [] for k in ("kind", "h", "toxic", "clean")}
    count = {(kind, flag): np.zeros(n, np.int64) for kind, n in ((0, len(h)), (1, len(grams))) for flag in (True, False)}
    for i, flag in enumerate(toxic.astype(bool).tolist()):
        mine = np.unique(word[words.first[i] : words.first[i + 1]])
        count[0, flag][mine] += 1
        size = begin[mine + 1] - begin[mine]
        at = np.repeat(begin[mine] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        count[1, flag][np.unique(gram[at])] += 1
    for kind, hashes in ((0, h), (1, grams)):
        for name, values in (("kind", np.full(len(hashes), kind, np.int32)), ("h", hashes.view(np.int64)), ("toxic", count[kind, True]), ("clean", count[kind, False])):
            columns[name].append(values)
    return table(**{k: np.concatenate(v) for k, v in columns.items()})


def enough_texts(toxic: int) -> int:
    """Toxic texts that must hold a word or n-gram: what fewer hold gets no vector, so that nothing is learned by heart."""
    return min(SUPPORT, max(2, int(SUPPORT_SHARE * toxic)))


def vocabulary(texts: list[str]) -> dict[str, np.ndarray]:
    """Sorted hashes of the words and n-grams that enough of some toxic texts hold."""
    found = support(pa.array(texts, pa.string()), np.ones(len(texts)))
    kind, h, held = (np.asarray(column(found, c)) for c in ("kind", "h", "toxic"))
    out = {}
    for k, (name, most) in enumerate((("word", WORD_ROWS), ("char", CHAR_ROWS))):
        some = np.flatnonzero((kind == k) & (held >= enough_texts(len(texts))))
        out[name] = np.sort(h[some[np.lexsort((h[some], -held[some]))][:most]].view(np.uint64))
    return out


def evidence(toxic: np.ndarray, clean: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Standardised difference between the shares of n1 toxic and n0 clean texts that hold something; 0 for row 0."""
    n0, n1 = max(1, n0), max(1, n1)
    share = (clean + toxic) / (n0 + n1)
    z = (toxic / n1 - clean / n0) / np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / n0 + 1 / n1))
    return np.concatenate([[0.0], z])


class Windows:
    """Distinct words of some texts with their table rows, and the windows over the texts.

    ``known`` has the sorted hashes of the words and n-grams with vectors; row 0 is for all others.
    """

    def __init__(self, texts: pa.Array, known: dict[str, np.ndarray]):
        words = Words(texts)
        self.first = words.first
        h, sample, self.word = np.unique(words.whole(), return_index=True, return_inverse=True)
        self.hash, self.word_row = h, _place(known["word"], h)
        parts = [words.grams(sample, n) for n in LENGTHS]
        row = _place(known["char"], np.concatenate([g for g, _ in parts]))
        of = np.concatenate([w for _, w in parts])
        order = np.argsort(of, kind="stable")
        self.char_row = row[order]
        self.char_first = np.searchsorted(of[order], np.arange(len(h) + 1))
        self.char_count = np.diff(self.char_first)
        count = np.diff(self.first)
        self.per_text = np.where(count > 0, -(-np.maximum(count - WINDOW, 0) // STRIDE) + 1, 0)
        text = np.repeat(np.arange(len(count)), self.per_text)
        k = np.arange(len(text)) - np.repeat(np.cumsum(self.per_text) - self.per_text, self.per_text)
        self.text = text
        self.start = self.first[text] + k * STRIDE
        self.size = np.minimum(self.first[text + 1] - self.start, WINDOW)

    def inputs(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct-word numbers (windows by WINDOW) and which places are filled."""
        place = np.arange(WINDOW)
        filled = place < self.size[which, None]
        at = np.where(filled, self.start[which, None] + place, 0)
        return self.word[at] if len(self.word) else at, filled

    def mean_chars(self, rows: np.ndarray) -> np.ndarray:
        """Mean over each distinct word's n-grams of some table rows (of n-grams without a row: 0)."""
        out = np.zeros((len(self.char_count), rows.shape[1]), rows.dtype)
        some = np.flatnonzero(np.diff(self.char_first))
        for i in range(0, len(some), SLICE):  # the n-grams' rows are copied for some words at a time
            part = some[i : i + SLICE]
            low, high = self.char_first[part[0]], self.char_first[part[-1] + 1]
            out[part] = np.add.reduceat(rows[self.char_row[low:high]], self.char_first[part] - low, axis=0)
        return out / np.maximum(self.char_count, 1)[:, None].astype(rows.dtype)

    def clues(self, z: dict[str, np.ndarray]) -> np.ndarray:
        """How telling each window is: the highest evidence among its words and their n-grams."""
        clue = z["word"][self.word_row]
        some = np.flatnonzero(np.diff(self.char_first))
        if len(some):
            clue[some] = np.maximum(clue[some], np.maximum.reduceat(z["char"][self.char_row], self.char_first[some]))
        if not len(self.start):
            return np.zeros(0)
        ends = np.stack([self.start, self.start + self.size], 1).ravel()
        return np.maximum.reduceat(np.append(clue[self.word], 0.0), ends)[::2]


def chosen(windows: Windows, z: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row a text: the windows to fit on, as table rows.

    ``clue`` and ``size`` of its windows, ``place`` the words of all of them one after the
    other as numbers into the text's list ``h`` (0: a word that adds nothing), and for the
    words of that list ``word_row``, ``grams`` (n-grams), ``known`` (those with a row), ``char_row``.
    """
    clue, bounds = windows.clues(z), np.concatenate([[0], np.cumsum(windows.per_text)])
    held = windows.char_row > 0
    known = np.concatenate([[0], np.cumsum(held)])
    known = known[windows.char_first[1:]] - known[windows.char_first[:-1]]
    adds = (windows.word_row > 0) | (known > 0)
    out: dict[str, list] = {k: [] for k in ("clue", "size", "place", "h", "word_row", "grams", "known", "char_row")}
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        which = np.arange(low, high)
        if len(which) > TRAIN_WINDOWS:
            order = np.argsort(-clue[which], kind="stable")
            top, rest = order[: TRAIN_WINDOWS // 2], np.sort(order[TRAIN_WINDOWS // 2 :])
            spread = rest[np.linspace(0, len(rest) - 1, TRAIN_WINDOWS - len(top)).astype(int)]
            which = low + np.sort(np.concatenate([top, spread]))
        at, filled = windows.inputs(which)
        words = at[filled]
        mine = np.unique(words[adds[words]])
        chars = [windows.char_row[a:b] for a, b in zip(windows.char_first[mine].tolist(), windows.char_first[mine + 1].tolist(), strict=True)]
        row = {
            "clue": clue[which], "size": windows.size[which].astype(np.int32),
            "place": np.where(adds[words], np.searchsorted(mine, words) + 1, 0).astype(np.int32),
            "h": windows.hash[mine].view(np.int64), "word_row": windows.word_row[mine].astype(np.int32),
            "grams": windows.char_count[mine].astype(np.int32), "known": known[mine].astype(np.int32),
            "char_row": np.concatenate([*(c[c > 0] for c in chars), np.zeros(0, np.int64)]).astype(np.int32),
        }
        for k, v in row.items():
            out[k].append(v)
    types = {"clue": pa.float64(), "h": pa.int64()}
    return table(**{k: pa.array(v, pa.list_(types.get(k, pa.int32()))) for k, v in out.items()})


CHOSEN = "clue array<double>, size array<int>, place array<int>, h array<long>, word_row array<int>, grams array<int>, known array<int>, char_row array<int>"


def _flat(rows: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column end to end, and how many each row has."""
    lists = rows[name].combine_chunks()
    sizes = np.asarray(pc.list_value_length(lists), dtype=np.int64)
    return np.asarray(lists.flatten()), sizes


class Picked(Windows):
    """The windows handed on by ``chosen``; word 0 is every word that adds nothing."""

    def __init__(self, rows: pa.Table):
        self.clue, self.per_text = _flat(rows, "clue")
        self.size = _flat(rows, "size")[0].astype(np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.text = np.repeat(np.arange(len(self.per_text)), self.per_text)
        h, words = _flat(rows, "h")
        _, sample, number = np.unique(h.view(np.uint64), return_index=True, return_inverse=True)
        place, places = _flat(rows, "place")
        at = place + np.repeat(np.cumsum(words) - words, places) - 1
        self.word = np.zeros(len(place), np.int32)
        self.word[place > 0] = number[at[place > 0]] + 1
        known, row = _flat(rows, "known")[0].astype(np.int64), _flat(rows, "char_row")[0]
        begin, size = (np.cumsum(known) - known)[sample], known[sample]
        self.char_first = np.concatenate([[0, 0], np.cumsum(size)])
        self.char_row = row[np.repeat(begin - self.char_first[1:-1], size) + np.arange(size.sum())].astype(np.int64)
        self.char_count = np.concatenate([[0], _flat(rows, "grams")[0][sample]]).astype(np.int64)
        self.word_row = np.concatenate([[0], _flat(rows, "word_row")[0][sample]]).astype(np.int64)

@dataclass
class Network:
    p: dict[str, np.ndarray]
    known: dict[str, np.ndarray]

    @staticmethod
    def fresh(known: dict[str, np.ndarray], seed: int = 11) -> Network:
        r = np.random.default_rng(seed)
        h, w = WIDTH, INPUT
        p = {k: r.normal(0, 0.05, (len(rows) + 1, w)) for k, rows in known.items()}
        for k in known:
            p[k][0] = 0
        for d in "fb":
            p |= {f"x{d}": r.normal(0, w**-0.5, (w, 3 * h)), f"u{d}": r.normal(0, h**-0.5, (h, 3 * h)), f"b{d}": np.zeros(3 * h)}
        p |= {"a": r.normal(0, (2 * h) ** -0.5, (2 * h, ATTENTION)), "v": r.normal(0, 0.5, ATTENTION), "o": r.normal(0, 0.3, 2 * h), "c": np.full(1, -1.0)}
        return Network({k: x.astype(F32) for k, x in p.items()}, known)

    def values(self, windows: Windows) -> np.ndarray:
        """The input of each distinct word to both directions."""
        e = self.p["word"][windows.word_row] + windows.mean_chars(self.p["char"])
        return (e @ np.concatenate([self.p["xf"], self.p["xb"]], 1)).astype(F32)

    def forward(self, x: np.ndarray, filled: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Logits of windows from their inputs (windows, WINDOW, 6 * WIDTH). Places that are not
        filled leave the state as it is. ``keep`` collects what the backward pass needs."""
        p, h, n = self.p, WIDTH, len(x)
        states = np.empty((n, WINDOW, 2 * h), F32)
        half = F32(0.5)
        for d, way in (("f", range(WINDOW)), ("b", range(WINDOW - 1, -1, -1))):
            side = slice(0, 3 * h) if d == "f" else slice(3 * h, 6 * h)
            u, b, s = p[f"u{d}"], p[f"b{d}"], np.zeros((n, h), F32)
            for t in way:
                g = x[:, t, side] + b
                m = s @ u
                gate = np.tanh((g[:, : 2 * h] + m[:, : 2 * h]) * half) * half + half  # reset, update
                c = np.tanh(g[:, 2 * h :] + gate[:, :h] * m[:, 2 * h :])
                mask = filled[:, t, None]
                new = np.where(mask, c + gate[:, h:] * (s - c), s)
                if keep is not None:
                    keep.append((d, t, s, m, gate, c, mask))
                s = new
                states[:, t, (0 if d == "f" else h) : (h if d == "f" else 2 * h)] = s
        act = np.tanh(states @ p["a"])
        e = np.where(filled, act @ p["v"], F32(-30))
        e = np.exp(e - e.max(1, keepdims=True))
        alpha = e / e.sum(1, keepdims=True)
        pooled = np.einsum("nt,ntk->nk", alpha, states)
        if keep is not None:
            keep.append((states, act, alpha, pooled))
        return pooled @ p["o"] + p["c"]

    def backward(self, x: np.ndarray, filled: np.ndarray, dlogit: np.ndarray, keep: list) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the weights, and of the inputs ``x``."""
        p, h = self.p, WIDTH
        states, act, alpha, pooled = keep.pop()
        grad = {k: np.zeros_like(v) for k, v in p.items() if k not in ("word", "char")}
        grad["o"], grad["c"] = pooled.T @ dlogit, dlogit.sum(keepdims=True)
        dpool = dlogit[:, None] * p["o"]
        dalpha = np.einsum("nk,ntk->nt", dpool, states)
        de = alpha * (dalpha - (alpha * dalpha).sum(1, keepdims=True)) * filled
        grad["v"] = np.einsum("nt,nta->a", de, act)
        dact = de[:, :, None] * p["v"] * (1 - act**2)
        grad["a"] = np.einsum("ntk,nta->ka", states, dact)
        dstates = alpha[:, :, None] * dpool[:, None, :] + dact @ p["a"].T
        dx = np.zeros_like(x)
        ds, last = None, None
        for d, t, s, m, gate, c, mask in reversed(keep):
            if d != last:
                ds, last = np.zeros((len(x), h), F32), d
            low = 0 if d == "f" else h
            ds = ds + dstates[:, t, low : low + h]
            r, z = gate[:, :h], gate[:, h:]
            dnew = np.where(mask, ds, 0)
            dc = dnew * (1 - z) * (1 - c**2)
            dz = dnew * (s - c) * z * (1 - z)
            dr = dc * m[:, 2 * h :] * r * (1 - r)
            dm = np.concatenate([dr, dz, dc * r], 1)
            dg = np.concatenate([dr, dz, dc], 1)
            grad[f"u{d}"] += s.T @ dm
            grad[f"b{d}"] += dg.sum(0)
            dx[:, t, (0 if d == "f" else 3 * h) : (3 * h if d == "f" else 6 * h)] = dg
            ds = np.where(mask, dnew * z, ds) + dm @ p[f"u{d}"].T
        return grad, dx

    def score(self, windows: Windows, batch: int = 1024) -> np.ndarray:
        """Probability that each text is toxic: its highest window, 0 without words."""
        value = self.values(windows)
        logit = np.empty(len(windows.start), F32)
        for i in range(0, len(logit), batch):
            which = np.arange(i, min(i + batch, len(logit)))
            at, filled = windows.inputs(which)
            logit[which] = self.forward(value[at], filled)
        out = np.zeros(len(windows.per_text))
        np.maximum.at(out, windows.text, 1 / (1 + np.exp(-logit.astype(float))))
        return out


def _rows_added(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct table rows and the sum of the values of each."""
    order = np.argsort(rows, kind="stable")
    found, first = np.unique(rows[order], return_index=True)
    return found, np.add.reduceat(values[order], first, axis=0) if len(rows) else values


def _gradients(net: Network, windows: Windows, which: np.ndarray, y: np.ndarray, word_part: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray], dict[str, tuple[np.ndarray, np.ndarray]]]:
    """Log loss of some windows, gradients of the weights, and (rows, gradients) of the tables.

    ``word_part`` (distinct words of the whole set) scales the word vectors; zeros make the
    network rely on characters.
    """
    at, filled = windows.inputs(which)
    distinct, inverse = np.unique(at, return_inverse=True)
    inverse = inverse.ravel()
    count = windows.char_first[distinct + 1] - windows.char_first[distinct]
    char_of = np.repeat(np.arange(len(distinct)), count)
    char_row = windows.char_row[np.repeat(windows.char_first[distinct] - (np.cumsum(count) - count), count) + np.arange(len(char_of))]
    scale = np.ones((len(distinct), 1), F32) if word_part is None else word_part[distinct, None]
    e = net.p["word"][windows.word_row[distinct]] * scale
    of, total = _rows_added(char_of, net.p["char"][char_row])
    count = np.maximum(windows.char_count[distinct], 1)[:, None].astype(F32)
    e[of] += total / count[of]
    weights = np.concatenate([net.p["xf"], net.p["xb"]], 1)
    x = (e @ weights)[inverse].reshape(*at.shape, -1)
    keep: list = []
    logit = net.forward(x, filled, keep)
    prob = 1 / (1 + np.exp(-logit))
    loss = float(-(y * np.log(prob + 1e-7) + (1 - y) * np.log(1 - prob + 1e-7)).mean())
    grad, dx = net.backward(x, filled, ((prob - y) / len(y)).astype(F32), keep)
    _, dvalue = _rows_added(inverse, dx.reshape(len(inverse), -1))
    dweights, de = e.T @ dvalue, dvalue @ weights.T
    grad["xf"], grad["xb"] = dweights[:, : 3 * WIDTH], dweights[:, 3 * WIDTH :]
    tables = {"word": _rows_added(windows.word_row[distinct], de * scale), "char": _rows_added(char_row, (de / count)[char_of])}
    return loss, grad, tables


class Adam:
    """Adam; of a table only the rows in use are moved."""

    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.step = p, rate, 0
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}

    def move(self, grad: dict[str, np.ndarray], tables: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        self.step += 1
        for k, (rows, g) in [*((k, (slice(None), g)) for k, g in grad.items()), *tables.items()]:
            m, s = self.moments[k]
            m[rows] += F32(0.1) * (g - m[rows])
            s[rows] += F32(0.01) * (g * g - s[rows])
            rate = self.rate * (1 - 0.99**self.step) ** 0.5 / (1 - 0.9**self.step)
            self.p[k][rows] -= F32(rate) * m[rows] / (np.sqrt(s[rows]) + F32(1e-6))


def fit(windows: Picked, y: np.ndarray, known: dict[str, np.ndarray], epochs: int = 6, batch: int = 128, rate: float = 0.01, seed: int = 11) -> Network:
    """Adam on windows chosen anew in each epoch; see the module's description. ``y`` has the label of each text."""
    net, rng = Network.fresh(known, seed), np.random.default_rng(seed)
    if not 0 < y.sum() < len(y):
        net.p["c"][:] = -8.0 if not y.sum() else 8.0  # one class only: a constant
        net.p["o"][:] = 0
        return net
    bounds = np.concatenate([[0], np.cumsum(windows.per_text)])
    pools = [(k, np.arange(a, b)) for k, a, b in zip(y, bounds[:-1], bounds[1:], strict=True) if b > a]
    # before the network knows anything, a window is as suspicious as its most telling n-gram
    logit = windows.clue.astype(F32)
    adam = Adam(net.p, rate)
    epochs = max(epochs, -(-STEPS * batch // max(1, sum(1 if k else 4 for k, _ in pools))))
    for epoch in range(epochs):
        which, target = [], []
        if epoch:
            value = net.values(windows)
            for i in range(0, len(logit), 2048):
                some = np.arange(i, min(i + 2048, len(logit)))
                at, filled = windows.inputs(some)
                logit[some] = net.forward(value[at], filled)
        for k, pool in pools:
            order = pool[np.argsort(-logit[pool], kind="stable")]
            if not k:
                take = np.unique(np.concatenate([order[:3], rng.choice(pool, 2)]))
            else:
                take = order[: max(1, int((logit[order[:3]] > 0).sum()) if epoch else 1)]
            which.append(take)
            target.append(np.full(len(take), k, F32))
        which, target = np.concatenate(which), np.concatenate(target)
        order = rng.permutation(len(which))
        adam.rate = rate * (1 - epoch / epochs)
        for i in range(0, len(order), batch):
            some = order[i : i + batch]
            part = np.append(F32(1), rng.random(len(windows.word_row) - 1) > 0.3).astype(F32)
            _, grad, tables = _gradients(net, windows, which[some], target[some], part)
            adam.move(grad, {k: (rows[rows > 0], g[rows > 0]) for k, (rows, g) in tables.items()})
    return net


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, fold: int = 0) -> Network:
    """Fit on up to TRAIN_TEXTS texts of each class among about TRAIN_LABELS labelled texts.

    The texts are used whole: counts and the choice of windows cover all their words. Of each
    text at most TRAIN_WINDOWS windows reach the driver.
    """
    sample = labelled_sample(docs, labels, label, folds, fold, TRAIN_LABELS)
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit("order"))
    ids = sample.select("doc_id", "label").groupBy("doc_id").agg(F.max("label").alias("label"))
    by_class = [[r["doc_id"] for r in ids.where((F.col("label") > 0) == bool(k)).orderBy(order, "doc_id").limit(TRAIN_TEXTS).collect()] for k in (0, 1)]
    picked = docs.sparkSession.createDataFrame([(i,) for some in by_class for i in some], "doc_id long")
    # rows that repeat a doc_id count once
    texts = sample.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.max(F.struct("label", "text")).alias("r"))
    return fit_texts(stored(texts.select("doc_id", (F.col("r.label") > 0).cast("int").alias("toxic"), "r.text"), "training-texts"))


def fit_texts(texts: DataFrame) -> Network:
    """Fit on some texts (doc_id, toxic, text); the tables of the network have a fixed size."""

    def held():
        return lambda batch: support(column(batch, "text"), np.asarray(column(batch, "toxic")))

    n1, n0 = (int(x or 0) for x in texts.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first())
    found = map_texts(texts, held, "kind int, h long, toxic long, clean long").groupBy("kind", "h").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    found = stored(found.where(F.col("toxic") >= enough_texts(n1)), "training-counts")
    known, z = {}, {}
    for k, (name, most) in enumerate((("word", WORD_ROWS), ("char", CHAR_ROWS))):
        top = found.where(F.col("kind") == k).orderBy(F.desc("toxic"), "h").limit(most).toArrow()
        h = np.asarray(top["h"].combine_chunks()).view(np.uint64)
        by = np.argsort(h)
        known[name] = h[by]
        z[name] = evidence(*(np.asarray(top[c].combine_chunks())[by] for c in ("toxic", "clean")), n1, n0)
    shared = texts.sparkSession.sparkContext.broadcast((known, z))

    def make():
        known, z = shared.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = chosen(Windows(column(batch, "text"), known), z)
            return pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "toxic"), *rows.columns], names=["doc_id", "toxic", *rows.schema.names])

        return each

    rows = map_texts(texts, make, f"doc_id long, toxic int, {CHOSEN}").orderBy("doc_id").toArrow()
    shared.destroy()
    return fit(Picked(rows), np.asarray(rows["toxic"].combine_chunks()).astype(float), known)


def score(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, score, predicted) of every row, over all overlapping windows of the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # tables of fixed size

    def make():
        net = shared.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            p = net.score(Windows(column(batch, "text"), net.known))
            return table(doc_id=column(batch, "doc_id"), score=p, predicted=(p >= 0.5).astype(np.int32))

        return each

    return map_texts(docs.select("doc_id", "text"), make, "doc_id long, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, fold: int = 0) -> DataFrame:
    """Train on labelled texts that are not held out and score all texts.

    Returns (doc_id, held_out, score, predicted), one row per input row. ``docs`` needs doc_id
    and text, ``labels`` doc_id and the label (0 or 1); other columns are ignored, null ids and
    labels too. Texts without a word score 0. With labels of one class only, or none, all
    windows score alike. An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    net = train(rows, labels, label, folds, fold)
    return score(rows, net).select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", "predicted")
