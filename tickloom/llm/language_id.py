"""Language identification by words, backing off to shorter and shorter character n-grams.

A word seen in training scores every language by the logarithm of its frequency there. A word
not seen is looked up by its longest known character n-grams: five letters, else four, and so
on; the word takes the mean score of the n-grams of the first length of which any is known. A
text scores the sum over its words, starting from the languages' shares of the training texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .letters import Words
from .tokens import blocks, column, map_texts, owners, sums, table

LONGEST = 5  # letters of the longest n-gram, word borders included
TRAIN_ROWS = 20_000  # labelled texts that are counted, about; chosen by a hash of the id
WORDS = 40_000  # most frequent words kept
GRAMS = 30_000  # most frequent n-grams kept of each length
LANGUAGES = 200  # most frequent languages kept
SMOOTH = 0.5


@dataclass(frozen=True)
class Model:
    languages: list[str]
    prior: np.ndarray  # log share of the texts
    keys: dict[int, np.ndarray]  # by length (0: whole words): sorted hashes
    scores: dict[int, np.ndarray]  # log frequency per language

    def find(self, n: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = self.keys[n]
        if not len(keys):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return at, keys[at] == h

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Log scores (texts by languages), and which texts have a letter."""
        words = Words(texts)
        distinct, sample, inverse = np.unique(words.whole(), return_index=True, return_inverse=True)
        value = np.zeros((len(distinct), len(self.languages)))
        at, known = self.find(0, distinct)
        value[known] = self.scores[0][at[known]]
        open_ = np.flatnonzero(~known)
        for n in range(LONGEST, 0, -1):
            h, word = words.grams(sample[open_], n)
            at, hit = self.find(n, h)
            count = np.bincount(word[hit], minlength=len(open_))
            got = np.flatnonzero(count)
            for k in range(len(self.languages)):
                total = np.bincount(word[hit], self.scores[n][at[hit], k], len(open_))
                value[open_[got], k] = total[got] / count[got]
            open_ = np.delete(open_, got)
        return self.prior + sums(value[inverse], words.first), np.diff(words.first) > 0


def _counts(batches):
    """(n, h, lang, count) of the words and n-grams of each block, counted before they are sent."""
    for batch in blocks(batches):
        words = Words(column(batch, "text"))
        names, code = np.unique(np.array(column(batch, "lang").to_pylist(), object).astype(str), return_inverse=True)
        of = code[owners(words.first)]
        every = np.arange(len(words.starts))
        for n in range(LONGEST + 1):
            h, word = (words.whole(), every) if n == 0 else words.grams(every, n)
            for k, name in enumerate(names):
                found, count = np.unique(h[of[word] == k], return_counts=True)
                if len(found):
                    yield table(n=np.full(len(found), n, np.int32), h=found.view(np.int64), lang=pa.array([str(name)] * len(found), pa.string()), count=count.astype(np.int64))


def train(labelled: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on (doc_id, text, lang): texts without a label or text are left out.

    Counts cover about ``rows`` labelled texts (all, if there are fewer), chosen by a hash of
    doc_id; the model keeps bounded numbers of the most frequent words, n-grams and languages.
    """
    usable = labelled.where("text is not null and lang is not null")
    total = usable.count()
    if total > rows:
        usable = usable.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) < int(rows / total * (1 << 30)))
    shares = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    languages = sorted(r["lang"] for r in shares)
    texts = {r["lang"]: r["count"] for r in shares}
    prior = np.log(np.array([texts[x] for x in languages], float) / max(1, sum(texts.values())))
    counts = usable.where(F.col("lang").isin(languages)).select("text", "lang").mapInArrow(_counts, "n int, h long, lang string, count long")
    counts = stored(counts.groupBy("n", "h", "lang").agg(F.sum("count").alias("count")), "word-counts")
    seen = counts.groupBy("n", "h").agg(F.sum("count").alias("total"), F.collect_list(F.struct("lang", "count")).alias("by"))
    keys, scores = {}, {}
    sizes = {(r["n"], r["lang"]): r["count"] for r in counts.groupBy("n", "lang").agg(F.sum("count").alias("count")).collect()}
    for n in range(LONGEST + 1):
        top = seen.where(F.col("n") == n).orderBy(F.desc("total"), "h").limit(WORDS if n == 0 else GRAMS).collect()
        h = np.array([r["h"] for r in top], np.int64).view(np.uint64)
        value = np.full((len(top), len(languages)), SMOOTH)
        for i, r in enumerate(top):
            for lang, count in r["by"]:
                value[i, languages.index(lang)] += count
        value = np.log(value / np.array([sizes.get((n, x), 0) + SMOOTH * (len(top) + 1) for x in languages]))
        order = np.argsort(h)
        # only differences between languages count; centring keeps sums small
        keys[n], scores[n] = h[order], (value - value.mean(1, keepdims=True))[order] if len(top) else value
    return Model(languages, prior, keys, scores)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every row.

    ``docs`` needs doc_id and text; other columns are ignored. ``lang_pred`` is ``und`` with
    score 0 if the text is null, has no letter, or nothing was learned; ``score`` is the
    share of the best language. Equal scores go to the first language by name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sizes above

    def make():
        model = shared.value
        names = np.array([*model.languages, "und"], object)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = column(batch, "text")
            if not model.languages:
                return table(doc_id=column(batch, "doc_id"), lang_pred=pa.array(["und"] * len(texts)), score=np.zeros(len(texts)))
            logs, some = model.score(texts)
            share = np.exp(logs - logs.max(1, keepdims=True))
            share /= share.sum(1, keepdims=True)
            best = np.where(some, share.argmax(1), len(names) - 1)
            return table(doc_id=column(batch, "doc_id"), lang_pred=pa.array(names[best].tolist(), pa.string()), score=np.where(some, share.max(1), 0.0))

        return each

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_texts(rows, make, "doc_id long, lang_pred string, score double")


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold`` modulo ``folds``; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(True))


def language_id(docs: DataFrame, folds: int = 5, fold: int = 0) -> DataFrame:
    """Train on the texts that are not held out and predict all: adds ``held_out``.

    ``docs`` needs doc_id, text and lang; the label is used in training only.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = train(rows.where(~held_out(F.col("doc_id"), folds, fold)))
    return predict(rows, model).select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "lang_pred", "score")
