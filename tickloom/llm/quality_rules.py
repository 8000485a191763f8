"""Quality rules: text statistics and zstandard compression bands.

A text that compresses far better than prose repeats itself; one that hardly compresses is
noise, encoded data or encrypted. Ratios depend on the length, so each length has its own
limits, for the whole text and for its fixed chunks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import Block, column, counts_within, grams, map_texts, owners, sums, table

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Bands:
    """Allowed ratios of plain to compressed size.

    ``whole`` has (least bytes, lowest ratio, highest ratio) by rising length; a text takes
    the last row whose length it reaches. ``chunk`` has the same for one chunk. A text is
    rejected if its own ratio is outside, or if over ``bad_share`` of the bytes in its
    judged chunks are in chunks outside.
    """

    whole: tuple[tuple[int, float, float], ...] = (
        (0, 0.0, 1e9),
        (128, 0.8, 2.6),
        (256, 1.05, 2.8),
        (512, 1.2, 3.0),
        (1024, 1.3, 3.5),
        (4096, 1.4, 4.0),
        (16384, 1.5, 4.5),
    )
    chunk: tuple[tuple[int, float, float], ...] = ((0, 0.0, 1e9), (1024, 1.25, 3.5), (4096, 1.35, 4.0))
    chunk_bytes: int = 4096
    bad_share: float = 0.3
    level: int = 3


def _limits(bands: tuple[tuple[int, float, float], ...], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows = np.array(bands, float)
    row = np.searchsorted(rows[:, 0], size, "right") - 1
    return rows[row, 1], rows[row, 2]


def _outside(bands, size: np.ndarray, packed: np.ndarray) -> np.ndarray:
    low, high = _limits(bands, size)
    ratio = size / np.maximum(packed, 1)
    return (size > 0) & ((ratio < low) | (ratio > high))


def _repeated_words(hashes: np.ndarray, first: np.ndarray, window: int = 5) -> np.ndarray:
    """Words covered by windows that occur twice or more in their text."""
    h, at = grams(hashes, first, window)
    twice = at[counts_within(owners(first)[at], h) >= 2]
    delta = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(delta, twice, 1)
    np.add.at(delta, twice + window, -1)
    return sums(np.cumsum(delta[:-1]) > 0, first)


def _later_copies(block: Block, word_starts: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of the text."""
    starts, stops, first = block.lines()
    filled = np.searchsorted(word_starts, stops) > np.searchsorted(word_starts, starts)
    owner = owners(first)
    key = block.hashes(starts, stops) + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    _, earliest = np.unique(key, return_index=True)
    later = np.ones(len(key), bool)
    later[earliest] = False
    return sums(later & filled, first)


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, n_bytes long, zstd_bytes long, n_chunks long, bad_chunk_share double, kept boolean"
)


def judge(bands: Bands = Bands()):
    """The function for one block of rows; see ``quality_rules``."""
    packer = zstandard.ZstdCompressor(level=bands.level)

    def packed(view, starts, stops) -> np.ndarray:
        return np.fromiter((len(packer.compress(view[a:b])) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)), np.int64, len(starts))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        block = Block(column(batch, "text"))
        starts, stops, first = block.words()
        n_words = np.diff(first)
        chars = block.per_text(~SPACE_OR_TAIL[block.data])
        repeat = _repeated_words(block.hashes(starts, stops), first)
        base = (n_words < 10) | (100 * repeat > 20 * n_words)
        size = np.diff(block.at)
        view = memoryview(np.ascontiguousarray(block.data))
        whole = packed(view, block.at[:-1], block.at[1:])
        chunks = -(-size // bands.chunk_bytes)
        of = np.repeat(np.arange(block.n), chunks)
        begin = block.at[of] + (np.arange(len(of)) - np.repeat(np.cumsum(chunks) - chunks, chunks)) * bands.chunk_bytes
        end = np.minimum(begin + bands.chunk_bytes, block.at[of + 1])
        bad = _outside(bands.chunk, end - begin, packed(view, begin, end))
        least = next(b for b, low, high in bands.chunk if low > 0 or high < 1e9)
        judged = (end - begin) >= least
        share = np.bincount(of, bad * (end - begin), block.n) / np.maximum(np.bincount(of, judged * (end - begin), block.n), 1)
        kept = ~base & ~_outside(bands.whole, size, whole) & (share <= bands.bad_share)
        return table(
            doc_id=column(batch, "doc_id"), n_words=n_words, word_chars=chars, n_symbols=block.per_text(SYMBOLS[block.data]),
            n_dup_lines=_later_copies(block, starts), n_repeat_words=repeat, base_failed=base, n_bytes=size, zstd_bytes=whole,
            n_chunks=chunks, bad_chunk_share=share, kept=kept,
        )

    return each


SPACE_OR_TAIL = np.zeros(256, bool)
SPACE_OR_TAIL[[0x20, *range(0x09, 0x0E), *range(0x80, 0xC0)]] = True  # white space and UTF-8 continuation bytes


def quality_rules(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """Statistics and the verdict of every text, one row per input row.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. A null or empty text
    has no words and fails the base rules. Repeated rows each get their own result, an empty
    table an empty result. One pass over the texts, no shuffle.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_texts(rows, lambda: judge(bands), SCHEMA)


def keep_good(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The rows that pass, with all their columns.

    The verdict is taken in the same pass as the rows are read: nothing is joined back.
    """
    names = docs.columns

    def make():
        each = judge(bands)
        at = {n: i for i, n in enumerate(names)}

        def filtered(batch: pa.RecordBatch) -> pa.RecordBatch:
            verdict = each(pa.RecordBatch.from_arrays([batch.column(at["doc_id"]), batch.column(at["text"])], names=["doc_id", "text"]))
            return batch.filter(column(verdict, "kept"))

        return filtered

    return map_texts(docs, make, docs.schema)
