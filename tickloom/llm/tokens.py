"""Words, lines and n-grams of many texts at once, as numpy arrays over one byte buffer.

Every function works on a *block*: some whole texts of an Arrow batch, laid end to end in
UTF-8. Words are runs of bytes other than space and tab..carriage return, that is
``[^\\x20\\x09-\\x0D]+``. Hashes have 64 bits and depend on the text alone, so they can be
compared between tasks.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

BLOCK = 1 << 19  # bytes of text handled at once, some dozen arrays of 8 times that; a longer text makes its own block

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240607)
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SLOT = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finalizer of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _grown(table: np.ndarray, base: int, n: int) -> np.ndarray:
    while len(table) < n:
        step = np.uint64(pow(base, len(table), 2**64))
        table = np.concatenate([table, table * step])
    return table


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE**i`` and its inverse modulo 2**64 for i < n."""
    global _powers, _inverses
    if len(_powers) < n:
        _powers = _grown(_powers, BASE, n)
        _inverses = _grown(_inverses, pow(BASE, -1, 2**64), n)
    return _powers[:n], _inverses[:n]


class Block:
    """Whole texts laid end to end: ``data`` bytes, ``at[i]:at[i+1]`` the bytes of text i."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        body = texts.buffers()[2]
        data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
        self.at = offsets - offsets[0]
        self.data = data[offsets[0] : offsets[-1]]
        self.n = len(texts)

    def lowered(self) -> "Block":
        """The same texts with A-Z in lower case."""
        other = object.__new__(Block)
        other.at, other.n, other.data = self.at, self.n, LOWER[self.data]
        return other

    def spans(self, inside: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of true bytes that do not cross texts: starts, ends, and ``first`` where
        the runs ``first[i]:first[i+1]`` belong to text i. Runs also break before the bytes ``cuts``."""
        if not len(inside):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(self.n + 1, np.int64)
        edge = np.zeros(len(inside) + 1, bool)
        edge[self.at] = True
        if cuts is not None:
            edge[cuts] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | edge[1:-1]
        starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        return starts, stops, np.searchsorted(starts, self.at)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.spans(~SPACE[self.data])

    def units(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, but every character of a script written without spaces stands alone:
        U+0E00-0EFF, U+1000-107F, U+1780-17FF, U+3000-9FFF and U+20000-3FFFF."""
        at = np.flatnonzero((self.data >= 0xE0) & (self.data <= 0xF0))
        lead, then = self.data[at], self.data[np.minimum(at + 1, max(len(self.data) - 1, 0))]
        alone = (lead >= 0xE3) & (lead <= 0xE9)
        alone |= (lead == 0xE0) & (then >= 0xB8) & (then <= 0xBB)
        alone |= (lead == 0xE1) & np.isin(then, [0x80, 0x81, 0x9E, 0x9F])
        alone |= (lead == 0xF0) & (then >= 0xA0)
        begin = at[alone]
        end = np.minimum(begin + np.where(lead[alone] == 0xF0, 4, 3), len(self.data))
        return self.spans(~SPACE[self.data], np.concatenate([begin, end]))

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ``\\n``-split lines: starts, ends (without the break) and ``first`` as in ``spans``."""
        breaks = np.flatnonzero(self.data == 10)
        owner = np.searchsorted(self.at, breaks, "right") - 1
        counts = np.bincount(owner, minlength=self.n) + 1 if len(breaks) else np.ones(self.n, np.int64)
        first = np.concatenate([[0], np.cumsum(counts)])
        starts = np.sort(np.concatenate([self.at[:-1], breaks + 1]), kind="stable")
        stops = np.sort(np.concatenate([self.at[1:], breaks]), kind="stable")
        return starts, stops, first

    def hashes(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """A hash of the bytes of each span."""
        up, down = powers(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(BYTE_VALUE[self.data] * up[:-1], out=total[1:])
        return mix((total[stops] - total[starts]) * down[starts])

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a per-byte value for each text."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.at[1:]] - total[self.at[:-1]]


def owners(first: np.ndarray) -> np.ndarray:
    """For items ``first[i]:first[i+1]`` of text i: the text of each item."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the items of each text (empty texts: 0), for one or more columns."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.result_type(values.dtype, np.int64) if values.dtype.kind in "bui" else np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def grams(word_hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word windows inside each text, and the position of their first word."""
    size = len(word_hashes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(size, np.uint64)
    for j in range(n):
        h += word_hashes[j : j + size] * SLOT[j]
    left = np.repeat(first[1:], np.diff(first))[:size]
    at = np.flatnonzero(np.arange(size) + n <= left)
    return mix(h[at]), at


def counts_within(owner: np.ndarray, h: np.ndarray) -> np.ndarray:
    """How often each item's (owner, hash) occurs."""
    if not len(h):
        return np.zeros(0, np.int64)
    _, inverse, count = np.unique(mix(h + owner.astype(np.uint64) * SLOT[63]), return_inverse=True, return_counts=True)
    return count[inverse]


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts together hold about ``limit`` bytes (a longer text stands alone)."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(text))
        size = np.cumsum(np.maximum(np.asarray(pc.binary_length(texts).fill_null(0)), 1), dtype=np.int64)
        begin, n = 0, batch.num_rows
        while begin < n:
            base = size[begin - 1] if begin else 0
            end = max(int(np.searchsorted(size, base + limit, "right")), begin + 1)
            yield batch.slice(begin, end - begin)
            begin = end


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on after its task, beside the JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_texts(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str, limit: int = BLOCK) -> DataFrame:
    """Run a function over blocks of rows inside the tasks.

    ``make()`` is called once per task and returns the function for one block; the rows
    must have a column ``text``. Memory is bounded by the block, or by the longest text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for block in blocks(batches, limit=limit):
            out = each(block)
            if out is not None and out.num_rows:
                yield out
        del each
        give_back()

    return df.mapInArrow(run, schema)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def table(**columns) -> pa.RecordBatch:
    """A record batch of arrays or numpy arrays."""
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))
