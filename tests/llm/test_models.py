"""Language ID, quality and toxicity: held-out accuracy, brute-force scores, awkward rows."""

import math
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helpers import AWKWARD, documents
from tickloom.llm import language_id, quality_model, queries, toxicity
from tickloom.llm.letters import Words

LARGER, LARGEST = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def larger(folder):
    return LARGER if os.path.isdir(LARGER) else folder


def auc(score, y):
    rank = np.argsort(np.argsort(score))
    n = y.sum()
    return (rank[y == 1].sum() - n * (n - 1) / 2) / (n * (len(y) - n))


def test_folds(spark):
    ids = list(range(40))
    rows = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", language_id.held_out(F.col("doc_id"), 5, 0).alias("h"))
    assert {r[0]: r[1] for r in rows.collect()} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in ids}


def test_language_accuracy(spark, larger):
    docs = spark.read.parquet(f"{larger}/documents.parquet").select("doc_id", "lang").collect()
    lang = {r[0]: r[1] for r in docs}
    got = queries.QUERIES["op2_language_id"](spark, larger).collect()
    assert len(got) == len(lang)
    held = [r for r in got if r["held_out"]]
    assert held and np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


def brute_language(train, text):
    """The same scores by dictionaries, for a training set below all bounds."""

    def words(t):
        return "".join(c if c.isalpha() else " " for c in t.lower()).split()

    def grams(w, n):
        w = f"\0{w}\0"
        return [w] if n == 0 else [w[k : k + n] for k in range(len(w) - n + 1)]

    langs = sorted({lang for _, lang in train})
    count = {n: defaultdict(Counter) for n in range(language_id.LONGEST + 1)}
    for t, lang in train:
        for w in words(t):
            for n, by in count.items():
                for g in grams(w, n):
                    by[g][lang] += 1
    total = {n: {x: sum(c[x] for c in by.values()) for x in langs} for n, by in count.items()}

    def value(n, g):
        by = count[n]
        v = np.array([math.log((by[g][x] + language_id.SMOOTH) / (total[n][x] + language_id.SMOOTH * (len(by) + 1))) for x in langs])
        return v - v.mean()

    size = Counter(lang for _, lang in train)
    score = np.array([math.log(size[x] / len(train)) for x in langs])
    for w in words(text):
        for n in (0, *range(language_id.LONGEST, 0, -1)):
            known = [g for g in grams(w, n) if g in count[n]]
            if known:
                score = score + np.mean([value(n, g) for g in known], axis=0)
                break
    share = np.exp(score - score.max())
    return langs[int(share.argmax())], float(share.max() / share.sum())


def test_language_equals_brute_force(spark):
    train = [("the cat and the dog", "en"), ("der hund und die katze", "de"), ("The Dogs Of War", "en"), ("ein Hund", "de"), ("le chat et le chien", "fr")]
    tests = ["the dog", "Hunde und Katzen", "chats", "zzz qqq", "un chien et the cat", "été 12 doge"]
    rows = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(train)], "doc_id long, text string, lang string")
    model = language_id.train(rows)
    got = {r[0]: (r[1], r[2]) for r in language_id.predict(documents(spark, enumerate(tests)), model).collect()}
    for i, t in enumerate(tests):
        want = brute_language(train, t)
        assert got[i][0] == want[0] and got[i][1] == pytest.approx(want[1], abs=1e-9)


def test_language_awkward_rows(spark):
    rows = documents(spark, AWKWARD, ["score", "held_out"])
    got = {r["doc_id"]: r for r in language_id.language_id(rows).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1, 2, 3))
    assert got[None]["held_out"] and got[4]["lang_pred"] == "en"
    assert language_id.language_id(documents(spark, [])).collect() == []
    unlabelled = rows.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r["lang_pred"] for r in language_id.language_id(unlabelled).collect()} == {"und"}


@pytest.mark.parametrize(("name", "label", "least"), [("op9_quality_classifier", "quality", 0.97), ("op10_toxicity", "toxic", 0.93)])
def test_held_out_ranking(spark, larger, name, label, least):
    larger = LARGEST if label == "toxic" and os.path.isdir(LARGEST) else larger  # a tenth of the labels is toxic
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{larger}/labels.parquet").collect()}
    got = queries.QUERIES[name](spark, larger).collect()
    assert len(got) == spark.read.parquet(f"{larger}/documents.parquet").count()
    held = [r for r in got if r["held_out"] and r["doc_id"] in labels]
    y = np.array([labels[r["doc_id"]] for r in held])
    assert auc(np.array([r["score"] for r in held]), y) > least
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)


def test_trees_equal_walking_them():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    trees = quality_model.fit(x, y, trees=30, depth=3)
    p = trees.score(x)

    def walk(row):
        total = trees.start
        for node in trees.roots:
            while trees.left[node] != node:
                node = trees.left[node] if row[trees.feature[node]] <= trees.border[node] else trees.right[node]
            total += trees.value[node]
        return 1 / (1 + math.exp(-total))

    assert p == pytest.approx([walk(row) for row in x])
    assert ((p > 0.5) == y).mean() > 0.97


def test_statistics_by_hand():
    x = quality_model.statistics(pa.array(["Aa bb Aa!\n\nAa bb Aa!", None, "", "x"]))
    at = {name: k for k, name in enumerate(quality_model.STATISTICS)}
    first = x[0]
    assert first[at["words"]] == pytest.approx(math.log(7)) and first[at["distinct_words"]] == pytest.approx(3 / 6)
    assert first[at["copied_lines"]] == pytest.approx(2 / 3) and first[at["empty_lines"]] == pytest.approx(1 / 3)
    assert first[at["share_upper"]] == pytest.approx(4 / 20) and first[at["top_word"]] == pytest.approx(2 / 6)
    assert not x[1].any() and not x[2].any() and x[3][at["one_letter_words"]] == 1


def gradient_error(net, windows, which, y, part):
    loss, grad, tables = toxicity._gradients(net, windows, which, y, part)
    for k, (rows, g) in tables.items():
        grad[k] = np.zeros_like(net.p[k])
        grad[k][rows] = g
    worst = 0.0
    for k, v in net.p.items():
        for i in np.argsort(-np.abs(grad[k]).ravel())[:3]:
            old, step = v.flat[i], 1e-5
            v.flat[i] = old + step
            up = toxicity._gradients(net, windows, which, y, part)[0]
            v.flat[i] = old - step
            down = toxicity._gradients(net, windows, which, y, part)[0]
            v.flat[i] = old
            worst = max(worst, abs(grad[k].flat[i] - (up - down) / 2 / step))
    return worst


def test_gradients(monkeypatch):
    monkeypatch.setattr(toxicity, "F32", np.float64)
    texts = ["the cat sat on a mat and scum was there", "one two three", "x y " * 40]
    net = toxicity.Network.fresh(toxicity.vocabulary(texts * toxicity.SUPPORT), 3)
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    windows = toxicity.Windows(pa.array(texts), net.known)
    which = np.arange(len(windows.start))
    part = (np.arange(len(windows.word_row)) % 2).astype(float)
    assert gradient_error(net, windows, which, (which % 2).astype(float), part) < 1e-6


def test_windows_cover_every_word():
    windows = toxicity.Windows(pa.array(["w " * n for n in (0, 1, 31, 32, 33, 48, 49, 200)]), {"word": np.zeros(0, np.uint64), "char": np.zeros(0, np.uint64)})
    for i, n in enumerate((0, 1, 31, 32, 33, 48, 49, 200)):
        mine = [(int(s - windows.first[i]), int(z)) for s, z, t in zip(windows.start, windows.size, windows.text, strict=True) if t == i]
        assert {w for s, z in mine for w in range(s, s + z)} == set(range(n))
        assert [s for s, _ in mine] == list(range(0, toxicity.STRIDE * len(mine), toxicity.STRIDE))


def test_scores_do_not_depend_on_the_block():
    texts = ["you are an idiot and a clown", "a kind word " * 30, "", "short"]
    net = toxicity.Network.fresh(toxicity.vocabulary(texts * toxicity.SUPPORT))
    together = net.score(toxicity.Windows(pa.array(texts), net.known))
    alone = [net.score(toxicity.Windows(pa.array([t]), net.known))[0] for t in texts]
    assert together == pytest.approx(alone, abs=1e-6) and together[2] == 0


def plain_score(net, text):
    """The score by loops over windows, words, n-grams, gates and attention weights."""
    p = {k: v.astype(float) for k, v in net.p.items()}
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    rows = {k: {int(h): i + 1 for i, h in enumerate(v)} for k, v in net.known.items()}
    words = Words(pa.array([text]))
    h, vectors = words.whole(), []
    for k in range(len(h)):
        grams = [int(g) for n in toxicity.LENGTHS for g in words.grams(np.array([k]), n)[0]]
        chars = sum((p["char"][rows["char"][g]] for g in grams if g in rows["char"]), np.zeros(toxicity.INPUT))
        vectors.append(p["word"][rows["word"].get(int(h[k]), 0)] + chars / max(1, len(grams)))
    best, n, w = 0.0, len(vectors), toxicity.WIDTH
    for begin in range(0, max(n - toxicity.WINDOW, 0) + toxicity.STRIDE, toxicity.STRIDE) if n else ():
        window = vectors[begin : begin + toxicity.WINDOW]
        sides = []
        for d, order in (("f", range(len(window))), ("b", reversed(range(len(window))))):
            s, states = np.zeros(w), {}
            for t in order:
                g, m = window[t] @ p[f"x{d}"] + p[f"b{d}"], s @ p[f"u{d}"]
                reset, update = sigmoid(g[:w] + m[:w]), sigmoid(g[w : 2 * w] + m[w : 2 * w])
                new = np.tanh(g[2 * w :] + reset * m[2 * w :])
                s = update * s + (1 - update) * new
                states[t] = s
            sides.append(states)
        both = [np.concatenate([sides[0][t], sides[1][t]]) for t in range(len(window))]
        weights = np.exp([np.tanh(x @ p["a"]) @ p["v"] for x in both])
        pooled = sum(a * x for a, x in zip(weights / weights.sum(), both, strict=True))
        best = max(best, float(sigmoid(pooled @ p["o"] + p["c"][0])))
    return best


def test_scores_equal_plain_loops():
    rng = np.random.default_rng(4)
    pool = ["you", "are", "an", "idiot", "clown", "kind", "wörd", "x", "unheard", "日本語"]
    texts = [" ".join(rng.choice(pool, n)) for n in (0, 1, 31, 32, 33, 48, 49, 130)]
    net = toxicity.Network.fresh(toxicity.vocabulary([t.replace("unheard", "") for t in texts] * toxicity.SUPPORT), 5)
    got = net.score(toxicity.Windows(pa.array(texts), net.known))
    assert got == pytest.approx([plain_score(net, t) for t in texts], abs=1e-5)


def test_chosen_windows_are_those_of_the_texts(monkeypatch):
    """Handed on as table rows, windows score as they do in their texts; of a long text the most telling ones are among them."""
    monkeypatch.setattr(toxicity, "SLICE", 7)
    rng = np.random.default_rng(6)
    pool = np.array([f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(300)])
    texts = [" ".join(rng.choice(pool, n)) for n in (0, 1, 40, 300)] + [None]
    words = list(rng.choice(pool, 4000))
    words[2017] = "scum"
    texts.append(" ".join(words))
    known = toxicity.vocabulary(["scum", "waa wbb wcc wdd"] * toxicity.SUPPORT)
    z = {k: np.concatenate([[0.0], rng.random(len(h))]) for k, h in known.items()}
    z["word"][1 + int(np.searchsorted(known["word"], Words(pa.array(["scum"])).whole()[0]))] = 9.0
    windows = toxicity.Windows(pa.array(texts, pa.string()), known)
    picked = toxicity.Picked(pa.table(toxicity.chosen(windows, z)))
    assert picked.per_text.tolist() == [0, 1, 2, 18, 0, toxicity.TRAIN_WINDOWS]
    net = toxicity.Network.fresh(known, 2)
    few = picked.text < 5
    both = [[net.forward(net.values(w)[at], filled) for at, filled in [w.inputs(np.flatnonzero(w.text < 5))]][0] for w in (windows, picked)]
    assert few.sum() == 21 and both[0] == pytest.approx(both[1], abs=1e-6)
    assert (picked.clue[picked.text == 5] == 9).sum() == 2  # the two windows that overlap the word
    every = {tuple(windows.word_row[windows.inputs(np.array([k]))[0][0]]) for k in np.flatnonzero(windows.text == 5)}
    assert {tuple(picked.word_row[picked.inputs(np.array([k]))[0][0]]) for k in np.flatnonzero(picked.text == 5)} <= every


def test_support_counts_texts():
    found = toxicity.support(pa.array(["bad bad day", "day", None, "bad"]), np.array([1, 0, 1, 1])).to_pydict()
    h = {w: int(Words(pa.array([w])).whole().view(np.int64)[0]) for w in ("bad", "day")}
    got = {x: (t, c) for k, x, t, c in zip(found["kind"], found["h"], found["toxic"], found["clean"], strict=True) if k == 0}
    assert got == {h["bad"]: (2, 0), h["day"]: (1, 1)}
    gram = int(Words(pa.array(["day"])).grams(np.array([0]), 3)[0].view(np.int64)[0])
    assert (1, 1) == next((t, c) for k, x, t, c in zip(found["kind"], found["h"], found["toxic"], found["clean"], strict=True) if k == 1 and x == gram)


def test_toxicity_learns_planted_words(spark):
    rng = np.random.default_rng(8)
    vocabulary = ["".join(rng.choice(list("abdeghilnorstu"), rng.integers(2, 8))) for _ in range(800)]
    clean = [" ".join(rng.choice(vocabulary, rng.integers(5, 200))) for _ in range(240)]
    toxic = []
    for _ in range(120):
        words = list(rng.choice(vocabulary, rng.integers(5, 200)))
        words[rng.integers(len(words))] = "zork" + rng.choice(["ing", "ed", "ful", ""])
        toxic.append(" ".join(words))
    rows = [(i, int(i >= 160), t) for i, t in enumerate(clean[:160] + toxic[:80])]
    net = toxicity.fit_texts(spark.createDataFrame(rows, "doc_id long, toxic int, text string"))
    s = net.score(toxicity.Windows(pa.array(clean[160:] + toxic[80:]), net.known))
    assert auc(s, np.array([0] * 80 + [1] * 40)) > 0.97


@pytest.mark.parametrize(("run", "label"), [(quality_model.quality, "quality"), (toxicity.toxicity, "toxic")])
def test_classifiers_awkward_rows(spark, run, label):
    rows = documents(spark, AWKWARD, ["score", "label"])
    labels = spark.createDataFrame([(1, 1), (4, 0), (5, 1), (5, 0), (None, 1), (7, None), (9, 1), (6, 0)], f"doc_id long, {label} int")
    got = run(rows, labels).collect()
    assert sorted((r["doc_id"] for r in got), key=repr) == sorted((i for i, _ in AWKWARD), key=repr)
    assert all(0 <= r["score"] <= 1 for r in got)
    nothing = spark.createDataFrame([], f"doc_id long, {label} int")
    assert len({r["score"] for r in run(documents(spark, AWKWARD[4:]), nothing).collect()}) == 1
    assert run(documents(spark, []), labels).collect() == []
