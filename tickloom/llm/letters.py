"""Letter runs of many texts at once, with hashes of words and character n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .tokens import mix, powers

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Which code points are letters."""
    global _letters
    if _letters is None:
        _letters = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _letters


class Words:
    """The lower-case letter runs of some texts, as code points with 0 between words."""

    def __init__(self, texts: pa.Array):
        lowered = [t.lower() for t in texts.fill_null("").to_pylist()]
        sizes = np.array([len(t) + 1 for t in lowered], np.int64)
        codes = np.frombuffer(("\n" + "\n".join(lowered) + "\n\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(letters()[codes], codes, 0).astype(np.uint64)
        inside = codes != 0
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.starts, self.stops = edges[::2], edges[1::2]
        self.first = np.searchsorted(self.starts, np.concatenate([[0], np.cumsum(sizes)]))
        self.up, self.down = powers(len(codes) + 1)
        self.total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(mix(codes + np.uint64(1)) * self.up[: len(codes)], out=self.total[1:])

    def hash(self, i: np.ndarray, n) -> np.ndarray:
        return mix((self.total[i + n] - self.total[i]) * self.down[i])

    def whole(self) -> np.ndarray:
        return self.hash(self.starts - 1, self.stops - self.starts + 2)

    def grams(self, which: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-grams of the given words with one border at each end, and their word."""
        count = np.maximum(self.stops[which] - self.starts[which] + 3 - n, 0)
        word = np.repeat(np.arange(len(which)), count)
        at = self.starts[which][word] - 1 + np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
        return self.hash(at, n), word
