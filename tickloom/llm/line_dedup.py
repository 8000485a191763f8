"""Near-duplicate lines by a deletion-neighbourhood join.

Lines are compared as sequences of words (A-Z in lower case, white space ignored; in scripts
without spaces every character counts as a word). Equal lines of any length meet. Two lines
are near when one word changed, added or removed turns one into the other and this is at most
a fifth of the longer line (a similarity of 0.8). Every line emits the hashes of itself and of
its variants with one word deleted:

* a variant of one line equal to another whole line is an added or removed word;
* variants of two lines that are equal after deleting at the same place are a changed word.

Both tests are exact for distance one, so an equal key together with the place *is* the
verified edit distance; equal variants deleted at different places (moved words) fail it.

Emitting variants of all lines would cost a row per word of the corpus. A line within
distance one shares its first or its last half with the other line, so only lines whose half
occurs in another line emit variants: an exact filter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .tokens import Block, column, map_texts, mix, owners, powers, table

EDIT_WORDS = 5  # words of the longer of two near lines: one word is then at most a fifth of it


class Lines:
    """Words and lines of a block, with hashes of word ranges in constant time."""

    def __init__(self, texts: pa.Array):
        block = Block(texts).lowered()
        starts, stops, _ = block.units()
        words = block.hashes(starts, stops)
        self.line_starts, self.line_stops, self.first = block.lines()
        self.begin = np.searchsorted(starts, self.line_starts)
        self.end = np.searchsorted(starts, self.line_stops)
        self.up, self.down = powers(len(words) + 1)
        self.words = words
        self.total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * self.up[:-1], out=self.total[1:])
        self.owner = owners(self.first)
        self.number = np.arange(len(self.owner)) - self.first[self.owner]

    def hash(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Hash of the words i..j-1."""
        return mix((self.total[j] - self.total[i]) * self.down[i])

    def hash_without(self, i: np.ndarray, j: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Hash of the words i..j-1 as if word k were not there."""
        tail = (self.total[j] - self.total[k + 1]) * self.down[1]
        return mix((self.total[k] - self.total[i] + tail) * self.down[i])


def _half(n: np.ndarray) -> np.ndarray:
    """Words of the compared halves; coarse for long lines, so that n and n + 1 mostly agree."""
    t = n // 2
    return np.where(t < 8, t, t // 4 * 4)


def _list_lines(batch: pa.RecordBatch) -> pa.RecordBatch:
    lines = Lines(column(batch, "text"))
    n = lines.end - lines.begin
    at = np.flatnonzero(n)
    a, z, n = lines.begin[at], lines.end[at], n[at]
    keys = []
    for length in (n, n - 1):  # halves of the shorter line of a pair: this one, or one with a word less
        t = _half(length)
        keys += [lines.hash(a, a + t) + t.astype(np.uint64), ~lines.hash(z - t, z) + t.astype(np.uint64)]
    keys = np.stack(keys, 1).view(np.int64)
    same = _half(n) == _half(n - 1)
    shorter, longer = n >= EDIT_WORDS - 1, (n >= EDIT_WORDS) & ~same
    use = np.stack([shorter, shorter, longer, longer], 1)
    sizes = use.sum(1)
    row = pa.array(lines.owner[at])
    return table(
        h=lines.hash(a, z).view(np.int64), n=n.astype(np.int32),
        doc_id=column(batch, "doc_id").take(row), th=column(batch, "th").take(row), line=lines.number[at].astype(np.int32),
        keys=pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(keys[use])),
    )


def _variants(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The line itself (place -1) and its variants, for the line numbers in ``wanted``. A line
    one word short of EDIT_WORDS can only be the shorter one of a pair: it has no variants."""
    lines = Lines(column(batch, "text"))
    wanted = column(batch, "wanted")
    sizes = np.asarray(pc.list_value_length(wanted).fill_null(0))
    of = np.repeat(np.arange(len(sizes)), sizes)
    at = lines.first[of] + np.asarray(wanted.flatten())
    a, z = lines.begin[at], lines.end[at]
    n = np.where(z - a >= EDIT_WORDS, z - a, 0) + 1
    rows = np.repeat(np.arange(len(at)), n)
    place = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n) - 1
    whole = place < 0
    k = np.where(whole, a[rows], a[rows] + place)
    v = np.where(whole, lines.hash(a, z)[rows], lines.hash_without(a[rows], z[rows], k))
    # deleting any word of a run of equal words gives the same variant: the places stay apart
    row = pa.array(of[rows])
    return table(
        v=v.view(np.int64), place=place.astype(np.int32),
        doc_id=column(batch, "doc_id").take(row), th=column(batch, "th").take(row), line=lines.number[at][rows].astype(np.int32),
    )


def _cut(names: list[str], text_type: pa.DataType):
    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = column(batch, "text")
        lines = Lines(texts)
        stay = lines.end == lines.begin
        kept = column(batch, "kept")
        sizes = np.asarray(pc.list_value_length(kept).fill_null(0))
        stay[lines.first[np.repeat(np.arange(len(sizes)), sizes)] + np.asarray(kept.flatten())] = True
        gone = np.diff(np.concatenate([[0], np.cumsum(~stay)])[lines.first])
        out = texts.to_pylist()
        for i in np.flatnonzero(gone).tolist():
            left = stay[lines.first[i] : lines.first[i + 1]].tolist()
            out[i] = "\n".join(part for part, yes in zip(out[i].split("\n"), left, strict=True) if yes)
        columns = [pa.array(out, text_type) if c == "text" else column(batch, c) for c in names]
        extra = [pa.array(np.diff(lines.first)), pa.array(gone)]
        return pa.RecordBatch.from_arrays(columns + extra, names=[*names, "n_lines", "n_removed"])

    return each


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.th") == F.col(f"{b}.th"))


def kept_lines(keyed: DataFrame) -> DataFrame:
    """(doc_id, th, kept): the numbers of the lines of each text that stay, lines without a word aside.

    ``keyed`` has the columns doc_id, th (hash of the text) and text. A line stays if no
    earlier line, by doc_id, th and line number, is equal or near.
    """
    slim = keyed.select("doc_id", "th", "text")
    lines = map_texts(slim, lambda: _list_lines, "h long, n int, doc_id long, th long, line int, keys array<long>")
    # equal lines meet once; of a line in a third of all texts each task sends one row
    first = stored(lines.groupBy("h", "n").agg(F.min(F.struct("doc_id", "th", "line", "keys")).alias("at")).select("h", "at.*"), "first-lines")
    keys = first.select("h", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("lines")).where("lines > 1").select("key")
    likely = keys.join(shared, "key").select("h").distinct()
    wanted = first.join(likely, "h").groupBy("doc_id", "th").agg(F.sort_array(F.collect_list("line")).alias("wanted"))
    texts = keyed.alias("d").join(wanted.alias("w").hint("shuffle_merge"), _same("d", "w")).select("d.*", "w.wanted")
    variants = map_texts(texts, lambda: _variants, "v long, place int, doc_id long, th long, line int")
    # most variants occur once: only the others carry their lines further
    met = variants.groupBy("v").agg(F.count("*").alias("lines")).where("lines > 1").select(F.col("v").alias("w"))
    seen = variants.join(met, F.col("v") == F.col("w")).select("v", "place", F.struct("doc_id", "th", "line").alias("at"))
    least = seen.groupBy("v", "place").agg(F.min("at").alias("at"))
    one_word = F.when(F.col("e.place") == F.col("s.place"), F.col("e.place") >= 0).otherwise((F.col("e.place") < 0) | (F.col("s.place") < 0))
    near = (
        least.alias("e")
        .join(seen.alias("s"), F.col("e.v") == F.col("s.v"))
        .where(one_word & (F.col("e.at") < F.col("s.at")))
        .select("s.at.*")
        .distinct()
    )
    both = first.select("doc_id", "th", "line", F.lit(False).alias("near")).unionByName(near.withColumn("near", F.lit(True)))
    listed = [F.collect_list(F.when(F.col("near") == flag, F.col("line"))).alias(name) for flag, name in ((False, "firsts"), (True, "nears"))]
    return both.groupBy("doc_id", "th").agg(*listed).select("doc_id", "th", F.array_except("firsts", "nears").alias("kept"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The rows with later copies of equal and near lines removed from ``text``.

    Adds ``n_lines`` and ``n_removed``; all columns of ``docs`` stay (it needs ``doc_id`` and
    ``text``; a column named n_lines or n_removed is replaced). The earliest of near lines, by
    doc_id (null first), then text hash, then line number, stays; a line goes when an earlier
    line is near, even if that one goes too. Lines without a word stay. Two lines of which neither
    has ``EDIT_WORDS`` words are near only if equal. Rows that repeat a doc_id and text are one document and are cut alike. A null text counts as one empty line and stays null; a
    text that loses every line becomes empty. An empty table gives an empty result.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    keyed = docs.select(*[F.col(f"`{c}`") for c in names]).withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    keyed = keyed.select(*[F.col(f"`{c}`").alias(f"c_{c}" if c not in ("doc_id", "text") else c) for c in names], F.xxhash64("text").alias("th"))
    kept = kept_lines(keyed)
    joined = keyed.alias("d").join(kept.alias("k").hint("shuffle_merge"), _same("d", "k"), "left").select("d.*", "k.kept")
    inner = [f"c_{c}" if c not in ("doc_id", "text") else c for c in names]
    schema = keyed.select(*inner).schema.add("n_lines", "long").add("n_removed", "long")
    out = map_texts(joined, lambda: _cut(inner, pa.string()), schema)
    return out.select(*[F.col(f"`{i}`").alias(c) for i, c in zip(inner, names, strict=True)], "n_lines", "n_removed")
