"""Benchmark decontamination by latent semantic retrieval.

1. Texts are cut into overlapping passages of words; words fall into hashed terms, and term
   counts over all texts give inverse frequencies.
2. A distributed randomised SVD of the TF-IDF passages of all texts, joined with the passages of
   the benchmark, gives a latent space.
3. Every passage of every text is projected and compared by cosine with all benchmark passages.
4. Pairs that come close are checked on the words themselves: the longest common subsequence
   with the surrounding text, and whether the answer is there too, so that paraphrases count
   only with the answer.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .tokens import Block, blocks, column, give_back, map_texts, owners, table

TERMS = 1 << 15  # hashed terms
STEP = 24  # words from passage to passage; a passage has two steps
SEGMENT = 64  # words of a benchmark passage; longer items make several, half a segment apart
RANK, EXTRA, POWER = 128, 16, 2  # latent dimensions, spare columns of the sketch, power rounds
BLOCK_SEGMENTS = RANK  # benchmark passages that are searched together: the space holds every one of them
COLLECTED = 1_000  # benchmark passages that the driver cuts at a time, about
PARTS = 1024  # slices of a partial matrix product
TEXT_BLOCKS = 128  # blocks of texts that share one partial product
GATHERED = 3 << 12  # steps whose products are added up by term together
CHUNK, PIECE = 384 * 144, 64  # values of the sums that are made side by side, so that they stay in the cache, and rows in each
TOGETHER = 2  # blocks of benchmark passages that are searched in one pass over the texts

CLOSE = 0.25  # cosine from which a passage is looked at
COPIED = 0.8  # share of a benchmark passage found in order: a copy
PARAPHRASED, ANSWERED = 0.5, 0.6  # ... a paraphrase, if this share of the answer is found too
ANSWER = 0.25  # an item of one sentence: its last quarter is the answer

WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


class Passages:
    """Words of a block of texts in lower case, without punctuation, with their hashed terms."""

    def __init__(self, texts: pa.Array):
        block = Block(pc.utf8_lower(texts.cast(pa.large_string()).fill_null("")))
        data = block.data
        inside = WORD_BYTE[data]
        # punctuation of two and three bytes: U+0080..00BF and U+2000..203F
        lead = np.flatnonzero((data[:-1] == 0xC2) | ((data[:-1] == 0xE2) & (data[1:] == 0x80)))
        for k in range(3):
            at = lead if k < 2 else lead[data[lead] == 0xE2]
            inside[np.minimum(at + k, len(data) - 1)] = False
        self.starts, self.stops, self.first = block.spans(inside)
        self.hash = block.hashes(self.starts, self.stops)
        self.term = (self.hash >> np.uint64(64 - TERMS.bit_length() + 1)).astype(np.int64)
        self.n = block.n


def _sorted_distinct(cell: np.ndarray) -> np.ndarray:
    cell.sort()
    return cell[np.diff(cell, prepend=-1) > 0]


def _rows(n: int, width: int) -> np.ndarray:
    """Rows without values that begin with a cache line."""
    body = np.empty(n * width * 4 + 64, np.uint8)
    at = -body.ctypes.data % 64
    return body[at : at + n * width * 4].view(np.float32).reshape(n, width)


def _sums(rows: np.ndarray, at: np.ndarray, begin: np.ndarray, size: np.ndarray, out: np.ndarray, place: np.ndarray | None = None) -> None:
    """The sum of ``rows[at[b : b + n]]`` for each begin b and size n into ``out``; with ``place``, added to these rows of it, each named once."""
    order = np.argsort(-size, kind="stable")
    begin, size, to = begin[order], size[order], order if place is None else place[order]
    chunk = max(1, CHUNK // max(1, rows.shape[1]))
    both = _rows(2 * chunk, rows.shape[1])
    for lo in range(0, len(order), chunk):
        first, here = begin[lo : lo + chunk], to[lo : lo + chunk]
        total, room = both[: len(first)], both[chunk:]
        np.take(rows, at[first], axis=0, out=total, mode="clip")
        many = np.searchsorted(-size[lo : lo + chunk], -np.arange(1, size[lo]))  # sums that go on
        for k, n in enumerate(many.tolist(), 1):
            total[:n] += np.take(rows, at[first[:n] + k], axis=0, out=room[:n], mode="clip")
        if place is not None:
            total += np.take(out, here, axis=0, out=room[: len(here)], mode="clip")
        out[here] = total


class Steps:
    """The steps of a block's texts; a passage is the sum of a step and the next one of its text.

    Step i holds ``size[i]`` distinct terms, a slice of ``term``, and is the last one of its text
    where ``alone``. A word counts once in a step.
    """

    def __init__(self, term: np.ndarray, size: np.ndarray, alone: np.ndarray):
        self.term, self.size, self.alone = term, size, alone
        self.n = len(size)
        self.step = np.repeat(np.arange(self.n), size)

    def times(self, space: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
        """The passages times ``space``."""
        part = _rows(self.n, space.shape[1]) if out is None else out
        _sums(space, self.term, np.cumsum(self.size) - self.size, self.size, part)
        then = part[1:].copy()
        then[self.alone[:-1]] = 0
        part[:-1] += then
        return part

    def norms(self, idf: np.ndarray) -> np.ndarray:
        """Squared lengths of the weighted passages."""
        square = idf.astype(float) ** 2
        own = np.bincount(self.step, square[self.term], self.n)
        bits = (self.n + 1).bit_length()
        cell = np.sort(self.term << bits | self.step)
        twice = cell[:-1][np.diff(cell) == 1]  # a term of this step and of the one that follows
        both = np.bincount(twice & ((1 << bits) - 1), square[twice >> bits], self.n)
        return own + np.where(self.alone, 0, np.append(own[1:], 0) + 2 * both)


def steps_of(words: Passages) -> tuple[Steps, np.ndarray, np.ndarray]:
    """The steps, their texts and their first words."""
    many = -(-np.diff(words.first) // STEP)
    of = np.repeat(np.arange(words.n), many)
    start = words.first[of] + (np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)) * STEP
    cell = _sorted_distinct(np.repeat(np.arange(len(of)), np.diff(np.append(start, len(words.term)))) * TERMS + words.term)
    alone = np.append(of[1:] != of[:-1], np.ones(min(len(of), 1), bool))
    return Steps(cell % TERMS, np.bincount(cell // TERMS, minlength=len(of)), alone), of, start


def all_steps(docs: DataFrame) -> DataFrame:
    """The steps of all texts, a row per block of texts, and rows with the occurrences of terms."""

    def run(batches):
        total = np.zeros(TERMS, np.int64)
        for batch in blocks(batches):
            words = Passages(column(batch, "text"))
            steps, _, _ = steps_of(words)
            total += np.bincount(words.term, minlength=TERMS)
            if steps.n:
                parts = steps.term.astype(np.uint16), steps.size.astype(np.uint8), steps.alone
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, [*(x.tobytes() for x in parts), None, None], strict=True))], schema)
        if total.any():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pylist([{"occurring": at.tolist(), "times": total[at].tolist()}], schema)
        give_back()

    schema = pa.schema([("term", pa.binary()), ("size", pa.binary()), ("alone", pa.binary()), ("occurring", pa.list_(pa.int32())), ("times", pa.list_(pa.int64()))])
    # shuffles of partial products (see _summed) go as soon as a round is over, not when the driver finds them unused
    own = docs.sparkSession.newSession()
    own.conf.set("spark.sql.shuffle.partitions", docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return stored(docs.select("text").mapInArrow(run, "term binary, size binary, alone binary, occurring array<int>, times array<long>"), "steps", own)


def term_counts(steps: DataFrame) -> np.ndarray:
    """Occurrences of every hashed term in all texts."""
    counts = np.zeros(TERMS, np.int64)
    each = steps.where("occurring is not null").select(F.explode(F.arrays_zip("occurring", "times")).alias("x"))
    found = each.groupBy("x.occurring").agg(F.sum("x.times").alias("times")).toArrow()
    counts[found["occurring"].to_numpy()] = found["times"].to_numpy()
    return counts


def inverse_frequency(counts: np.ndarray) -> np.ndarray:
    """Squared, so that a few frequent words in common do not bring passages together."""
    return (np.log((counts.sum() + 1.0) / (counts + 1.0)) ** 2).astype(np.float32)


def _weights(term: np.ndarray, row: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, term) with weight (1 + log tf) * idf."""
    cell, count = np.unique(row * TERMS + term, return_counts=True)
    return cell // TERMS, cell % TERMS, (1 + np.log(count)).astype(np.float32) * idf[cell % TERMS]


def _product(row: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, space: np.ndarray) -> np.ndarray:
    """Rows of the sparse passages (sorted by row) times ``space``."""
    out = np.zeros((n, space.shape[1]), np.float32)
    if len(row):
        first = np.flatnonzero(np.diff(row, prepend=-1))
        out[row[first]] = np.add.reduceat(space[term] * weight[:, None], first, axis=0)
    return out


def _start(width: int, seed: int) -> np.ndarray:
    """The first sketch; the tasks draw it themselves."""
    return np.random.default_rng(seed).standard_normal((TERMS, width), np.float32)


def _add_rows(total: np.ndarray, term: np.ndarray, step: np.ndarray, rows: np.ndarray) -> None:
    """Add row ``step`` of ``rows`` to row ``term`` of ``total``, for all pairs."""
    bits = len(rows).bit_length()
    cell = np.sort(term << bits | step)
    term, step = cell >> bits, cell & ((1 << bits) - 1)
    first = np.flatnonzero(np.diff(term, prepend=-1))
    count = np.diff(np.append(first, len(term)))
    few = count <= PIECE
    _sums(rows, step, first[few], count[few], total, term[first[few]])
    if few.all():
        return
    # the rows of a term with many are summed in pieces, whose sums are the next rows
    first, count = first[~few], count[~few]
    many = -(-count // PIECE)
    rank = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    found = _rows(len(rank), rows.shape[1])
    _sums(rows, step, np.repeat(first, many) + rank * PIECE, np.minimum(PIECE, np.repeat(count, many) - rank * PIECE), found)
    _add_rows(total, np.repeat(term[first], many), np.arange(len(rank)), found)


def _summed(steps: DataFrame, idf: np.ndarray, width: int, basis: np.ndarray | int, tasks: int) -> tuple[np.ndarray, int]:
    """The sum over all passages of all texts of t' (a S), a the weighted passage of length one and t the same without weights; and how many passages there are.

    S has a row for each term, times its weight already; a number is the seed of the first S.
    """
    shared = steps.sparkSession.sparkContext.broadcast((idf, basis))

    def run(batches):
        idf, s = shared.value
        if isinstance(s, int):
            s = _start(width, s)
            s *= idf[:, None]
        total, n = _rows(TERMS, width), 0
        total[:] = 0
        held: list[tuple[np.ndarray, np.ndarray]] = []
        room, full = _rows(GATHERED, width), 0

        def add_held(rows):
            term, step = map(np.concatenate, zip(*held, strict=True))
            held.clear()
            _add_rows(total, term, step, rows)

        for batch in batches:
            for parts in zip(*(column(batch, c) for c in ("term", "size", "alone")), strict=True):
                term, size, alone = (np.frombuffer(x.as_buffer(), t) for x, t in zip(parts, (np.uint16, np.uint8, bool), strict=True))
                block = Steps(term.astype(np.int64), size.astype(np.int64), alone)
                if held and full + block.n > GATHERED:
                    add_held(room[:full])
                    full = 0
                # a text of more steps than are held has its own rows
                y = block.times(s, room[full : full + block.n] if block.n <= GATHERED else None)
                y /= np.maximum(block.norms(idf), 1e-12)[:, None].astype(np.float32)
                before = y[:-1].copy()
                before[block.alone[:-1]] = 0
                y[1:] += before  # a step lies in its passage and in the one before
                held.append((block.term, block.step + full))
                n += block.n
                if block.n > GATHERED:
                    add_held(y)
                else:
                    full += block.n
        if held:
            add_held(room[:full])
        if n:
            for k in range(0, PARTS, 64):
                pieces = [total[i * TERMS // PARTS : (i + 1) * TERMS // PARTS].tobytes() for i in range(k, min(k + 64, PARTS))]
                yield table(part=np.arange(k, k + len(pieces)), n=np.full(len(pieces), n), body=pa.array(pieces, pa.binary()))
        del s, total, room
        give_back()

    def add(batches):
        found: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for k, n, body in zip(*(column(batch, c) for c in ("part", "n", "body")), strict=True):
                m, piece = found.get(k.as_py(), (0, np.float32(0)))
                found[k.as_py()] = m + n.as_py(), piece + np.frombuffer(body.as_buffer(), np.float32)
        for k, (n, piece) in found.items():
            yield table(part=np.array([k]), n=np.array([n]), body=pa.array([piece.tobytes()], pa.binary()))

    schema = "part long, n long, body binary"
    out, n = np.zeros((TERMS, width), np.float32), 0
    # a slice is added up as it comes, however many tasks there were; each task here gets about half a product
    found = steps.mapInArrow(run, schema).repartition(min(PARTS, 2 * tasks), "part").mapInArrow(add, schema).toArrow()
    for batch in found.to_batches():
        for k, m, body in zip(*(column(batch, c) for c in ("part", "n", "body")), strict=True):
            at, n = k.as_py(), m.as_py()
            out[at * TERMS // PARTS : (at + 1) * TERMS // PARTS] = np.frombuffer(body.as_buffer(), np.float32).reshape(-1, width)
    shared.destroy()  # the next round sends another one
    return out, n


def _crossed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a' b in double precision, some rows at a time."""
    return sum((a[k : k + 4096].astype(float).T @ b[k : k + 4096] for k in range(0, len(a), 4096)), np.zeros((a.shape[1], b.shape[1])))


def _orthonormal(y: np.ndarray) -> np.ndarray:
    """A basis of the columns, from their products; the second turn mends what rounding left."""
    for _ in range(2):
        value, turn = np.linalg.eigh(_crossed(y, y))
        kept = value > 1e-10 * max(value.max(initial=0), 1e-30)
        y = y @ (turn[:, kept] / np.sqrt(value[kept])).astype(np.float32)
    return y


def randomised_svd(steps: DataFrame, idf: np.ndarray, rank: int = RANK, extra: int = EXTRA, power: int = POWER, seed: int = 5) -> tuple[np.ndarray, int]:
    """Leading right singular vectors (TERMS by rank) of the passages of all texts, each times its value; and how many passages.

    ``steps`` are those of all texts. Every round takes all of their passages: it sends the sketch
    to the tasks (bounded by TERMS x (rank + extra)) and adds up their partial products slice by
    slice. The last round also gives the values, by Nystroem's formula.
    """
    steps = steps.where("term is not null").select("term", "size", "alone")
    n = steps.count()
    # each task sends a partial product of fixed size
    tasks = max(1, min(n, steps.sparkSession.sparkContext.defaultParallelism), n // TEXT_BLOCKS)
    steps = steps.coalesce(tasks)
    y, n = _summed(steps, idf, rank + extra, seed, tasks)
    basis = None
    for _ in range(power):
        y *= idf[:, None]
        if not y.any():
            break
        basis = _orthonormal(y)
        basis *= idf[:, None]
        del y
        give_back()  # the driver keeps one sketch, not the products it came from
        y, n = _summed(steps, idf, basis.shape[1], basis, tasks)
    if not y.any():
        return np.zeros((TERMS, 0), np.float32), n
    # with Q the basis and Y = C'C Q, C'C is about Y (Q'Y)^-1 Y' = F F'
    value, turn = np.linalg.eigh(_crossed(_start(rank + extra, seed) * idf[:, None] if basis is None else basis, y))
    del basis
    y *= idf[:, None]
    kept = value > 1e-10 * value.max()
    turn = turn[:, kept] / np.sqrt(value[kept])
    _, last = np.linalg.eigh(turn.T @ _crossed(y, y) @ turn)
    out = y @ (turn @ last[:, ::-1][:, :rank]).astype(np.float32)
    del y
    give_back()
    return out, n


@dataclass(frozen=True)
class Segments:
    """Benchmark passages: word hashes, the item, and the answer if it lies in the passage."""

    item: list[int]
    words: list[np.ndarray]
    answer: list[np.ndarray]


def segments(rows: list[tuple[int, str | None]]) -> Segments:
    """Cut items into passages. The answer is the last line, else the last sentence, else the last words."""
    item, words, answer = [], [], []
    for i, text in rows:
        text = (text or "").strip()
        tail = text.rsplit("\n", 1)
        if len(tail) == 1:
            tail = text.rstrip(".!?").rsplit(". ", 1)
        both = Passages(pa.array([text, tail[1] if len(tail) > 1 else ""]))
        h, last = both.hash[: both.first[1]], both.hash[both.first[1] :]
        if len(last) in (0, len(h)):
            last = h[len(h) - max(1, round(ANSWER * len(h))) :]
        start = 0
        while start < len(h):
            end = min(start + SEGMENT, len(h))
            item.append(i)
            words.append(h[start:end])
            answer.append(last if end == len(h) and len(last) <= end - start else h[:0])
            if end == len(h):
                break
            start += SEGMENT // 2
    return Segments(item, words, answer)


def parts_of(found: Segments) -> list[Segments]:
    """Blocks of at most BLOCK_SEGMENTS passages, of about one size."""
    n = len(found.words)
    size = -(-n // max(1, -(-n // BLOCK_SEGMENTS)))
    return [Segments(*(x[k : k + size] for x in (found.item, found.words, found.answer))) for k in range(0, n, size or 1)]


def places_of(a: np.ndarray) -> dict[int, int]:
    """The places of each word, as bits."""
    places: dict[int, int] = {}
    for k, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | 1 << k
    return places


def longest(places: dict[int, int], n: int, b: list[int]) -> int:
    """Length of the longest common subsequence of n words and ``b``, 64 and more places in one step."""
    full = (1 << n) - 1
    v = full
    for x in b:
        if x in places:
            u = v & places[x]
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence."""
    return longest(places_of(a), len(a), b.tolist())


def _queries(found: Segments, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The benchmark passages as rows of length one: row, term and weight."""
    row = owners(np.concatenate([[0], np.cumsum([len(w) for w in found.words])]))
    term = (np.concatenate(found.words) >> np.uint64(64 - TERMS.bit_length() + 1)).astype(np.int64)
    row, term, weight = _weights(term, row, idf)
    norm = np.sqrt(np.bincount(row, weight**2, len(found.words)))
    return row, term, (weight / np.maximum(norm, 1e-6)[row]).astype(np.float32)


def _turn(corpus: np.ndarray, n: int, idf: np.ndarray, found: Segments) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The space of a block: leading right singular vectors of the corpus' singular rows and the benchmark passages together.

    The space is ``corpus`` times the first result; the rows ``present``, the second one, add the third.
    """
    row, term, weight = _queries(found, idf)
    # the space must hold the benchmark: its rows weigh as much as all passages of the corpus
    weight = weight * np.float32((max(n, 1) / len(found.words)) ** 0.5)
    present, at = np.unique(term, return_inverse=True)
    own = np.zeros((len(present), len(found.words)), np.float32)
    own[at, row] = weight
    # singular vectors of the few rows from their products with one another
    across = corpus[present].T.astype(float) @ own
    value, turn = np.linalg.eigh(np.block([[_crossed(corpus, corpus), across], [across.T, _crossed(own, own)]]))
    value, turn = value[::-1][:RANK], turn[:, ::-1][:, :RANK]
    kept = value > 1e-10 * max(value[0], 1e-30)
    turn = (turn[:, kept] / np.sqrt(value[kept])).astype(np.float32)
    return turn[: corpus.shape[1]], present, own @ turn[corpus.shape[1] :]


def _space(corpus: np.ndarray, turn: np.ndarray, present: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The space (a row per term) from the parts that ``_turn`` returns."""
    space = corpus @ turn
    space[present] += own
    return space


class Overlap:
    """How many words of a benchmark passage may occur near a passage of a text: their terms do."""

    def __init__(self, found: Segments):
        terms = [(w >> np.uint64(64 - TERMS.bit_length() + 1)).astype(np.int64) for w in found.words]
        known, at = np.unique(np.concatenate(terms), return_inverse=True)
        times = np.zeros((len(terms), len(known)), np.uint8)
        np.add.at(times, (np.repeat(np.arange(len(terms)), [len(t) for t in terms]), at), 1)
        most = times.max(0)
        order = np.argsort(-most.astype(int), kind="stable")  # terms that a passage repeats come first
        self.n = len(known)
        self.place = np.full(TERMS, self.n)
        self.place[known[order]] = np.arange(self.n)
        self.bits = -(-self.n // 64) * 64
        # a bit for each term that a passage holds, then for each one that it holds twice, and so on
        held, columns = [], []
        for m in range(1, int(most.max()) + 1):
            wide = -(-np.count_nonzero(most >= m) // 64)
            flags = np.zeros((len(terms), wide * 64), bool)
            flags[:, : self.n] = times[:, order[: wide * 64]] >= m
            held.append(np.packbits(flags, axis=1).view(np.uint64))
            columns.append(np.arange(wide))
        self.held, self.columns = np.concatenate(held, axis=1), np.concatenate(columns)

    def spots(self, words: Passages) -> tuple[np.ndarray, np.ndarray]:
        """The words whose terms are known, and the places of these."""
        place = self.place[words.term]
        spot = np.flatnonzero(place < self.n)
        return spot, place[spot]

    def count(self, words: Passages, lo: np.ndarray, hi: np.ndarray, query: np.ndarray, spots: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """For words lo:hi and a benchmark passage each."""
        out = np.zeros(len(query), np.int64)
        spot, place = spots or self.spots(words)
        for k in range(0, len(query), 512):
            a, b, q = (x[k : k + 512] for x in (lo, hi, query))
            new = (np.diff(a, prepend=-1) != 0) | (np.diff(b, prepend=-1) != 0)
            begin, end = np.searchsorted(spot, a[new]), np.searchsorted(spot, b[new])
            size = end - begin
            here = np.zeros((len(size), self.bits), bool)
            at = np.arange(size.sum()) + np.repeat(begin - np.cumsum(size) + size, size)
            here.reshape(-1)[np.repeat(np.arange(len(size)) * self.bits, size) + place[at]] = True
            near = np.packbits(here, axis=1).view(np.uint64)[:, self.columns]
            out[k : k + 512] = np.bitwise_count(near[np.cumsum(new) - 1] & self.held[q]).sum(1)
        return out

    def at_most(self, steps: Steps, passage: np.ndarray, query: np.ndarray) -> np.ndarray:
        """As ``count`` for a passage and up to SEGMENT words around it, in whole steps (maybe of other texts too)."""
        place = self.place[steps.term]
        known = np.flatnonzero(place < self.n)
        step, place = steps.step[known], place[known]
        own = np.zeros((steps.n, self.bits // 64), np.uint64)
        for k in range(0, steps.n, 512):
            lo, hi = np.searchsorted(step, (k, k + 512))
            here = np.zeros((min(512, steps.n - k), self.bits), bool)
            here[step[lo:hi] - k, place[lo:hi]] = True
            own[k : k + 512] = np.packbits(here, axis=1).view(np.uint64)
        near, reach = own.copy(), -(-SEGMENT // STEP)
        for j in range(1, min(reach + 2, steps.n)):
            near[:-j] |= own[j:]
            if j <= reach:
                near[j:] |= own[:-j]
        out = np.zeros(len(query), np.int64)
        for k in range(0, len(query), 512):
            p, q = passage[k : k + 512], query[k : k + 512]
            out[k : k + 512] = np.bitwise_count(near[p][:, self.columns] & self.held[q]).sum(1)
        return out


def _search(docs: DataFrame, idf: np.ndarray, corpus: np.ndarray, searched: list[tuple[int, tuple, Segments]]) -> DataFrame:
    """Verified matches of all passages of all texts with the benchmark passages of some blocks (number, turn, passages)."""
    # the corpus' rows are sent once, the tasks turn them for each block
    shared = docs.sparkSession.sparkContext.broadcast((idf, corpus, searched))

    def make():
        idf, corpus, searched = shared.value
        width = np.cumsum([0, *(turn[0].shape[1] for _, turn, _ in searched)])
        spaces = _rows(TERMS, width[-1])  # side by side: the rows of a word are read once
        parts = []
        for (number, turn, found), lo, hi in zip(searched, width, width[1:], strict=False):
            space = _space(corpus, *turn)
            queries = _product(*_queries(found, idf), len(found.words), space)
            # cosines within the space: what it leaves out of either passage does not lower them
            queries = (queries / np.maximum(np.linalg.norm(queries, axis=1), 1e-6)[:, None]).astype(np.float32)
            np.multiply(space, idf[:, None], out=spaces[:, lo:hi])
            del space
            parts.append((number, slice(lo, hi), queries, found, Overlap(found), np.array([len(w) for w in found.words]), [places_of(w) for w in found.words]))

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            words = Passages(column(batch, "text"))
            steps, of, start = steps_of(words)
            best: dict[tuple[int, int, int], tuple[float, float, float, int]] = {}
            projected = steps.times(spaces) if steps.n else None
            for number, own, queries, found, overlap, size, places in parts if steps.n else ():
                both = projected[:, own]
                norm = np.maximum(np.sqrt(np.einsum("ij,ij->i", both, both)), 1e-6)
                product = both @ queries.T
                p, q = np.divmod(np.flatnonzero(product >= (CLOSE * norm)[:, None]), len(queries))
                # words that are nowhere near can not be in a common subsequence
                left = np.flatnonzero(overlap.at_most(steps, p, q) >= PARAPHRASED * size[q])
                at, query = p[left], q[left]
                begin, end = np.maximum(words.first[of[at]], start[at] - size[query]), np.minimum(words.first[of[at] + 1], start[at] + 2 * STEP + size[query])
                spots = overlap.spots(words)
                left = np.flatnonzero(overlap.count(words, begin, end, query, spots) >= PARAPHRASED * size[query])
                known, first, last = words.hash[spots[0]], np.searchsorted(spots[0], begin), np.searchsorted(spots[0], end)
                for k in left.tolist():
                    p, q, lo, hi = at[k], query[k], begin[k], end[k]
                    h, i = found.words[q], int(of[p])
                    share = longest(places[q], len(h), known[first[k] : last[k]].tolist()) / len(h)
                    if share < PARAPHRASED:
                        continue
                    near, told = words.hash[lo:hi], found.answer[q]
                    answer = common(told, near) / len(told) if len(told) else 0.0
                    if share >= COPIED or answer >= ANSWERED:
                        key = (i, found.item[q], number)
                        best[key] = max(best.get(key, (0.0, 0.0, 0.0, 0)), (share, answer, float(product[p, q] / norm[p]), int(lo - words.first[i])))
            at = pa.array([i for i, _, _ in best], pa.int64())
            values = list(best.values())
            return table(
                doc_id=column(batch, "doc_id").take(at), row=column(batch, "row").take(at), item_id=pa.array([j for _, j, _ in best], pa.int64()),
                lcs_share=pa.array([v[0] for v in values], pa.float64()), answer_share=pa.array([v[1] for v in values], pa.float64()),
                cosine=pa.array([v[2] for v in values], pa.float64()), first_word=pa.array([v[3] for v in values], pa.int64()),
                block=pa.array([b for _, _, b in best], pa.int32()),
            )

        return each

    hits = stored(map_texts(docs, make, MATCHES), "matches")
    shared.destroy()  # the next blocks send another one
    return hits


MATCHES = "doc_id long, row long, item_id long, lcs_share double, answer_share double, cosine double, first_word long, block int"


def _once(hits: DataFrame) -> DataFrame:
    """One row per text and item, with the best evidence, where an item lies in several blocks."""
    key, evidence = ["doc_id", "row", "item_id"], ["lcs_share", "answer_share", "cosine", "first_word"]
    each = hits.groupBy(*key, "block").agg(F.count("*").cast("int").alias("n"), F.max(F.struct(*evidence)).alias("best"))
    best = each.groupBy(*key).agg(F.max("n").alias("n"), F.max("best").alias("best"))
    return best.select(*key, F.explode(F.array_repeat("best", F.col("n"))).alias("best")).select(*key, "best.*")


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Texts that hold a benchmark item: a row per text and item, with the evidence.

    Returns doc_id, row (a hash of doc_id and text), item_id, lcs_share, answer_share, cosine
    and first_word (where the matching region begins). ``docs`` needs doc_id and text,
    ``benchmark`` item_id and text; other columns are ignored. Null and empty texts match
    nothing; items without words and null items are skipped; rows that repeat an item count
    as one; repeated texts each give their rows. Empty tables give an empty result. Benchmark
    passages are searched in blocks of at most BLOCK_SEGMENTS, against all passages of all texts.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    size = items.agg(F.sum(F.size(F.split("text", r"\s+")) / (SEGMENT // 2) + 1)).first()[0] or 0
    n_blocks = max(1, int(-(-size // COLLECTED)))
    steps = all_steps(docs)
    idf = inverse_frequency(term_counts(steps))
    corpus, passages = None, 0
    out, n, split = spark.createDataFrame([], MATCHES), 0, False
    for b in range(n_blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == b).orderBy("item_id", "text").collect()
        parts = parts_of(segments([(r["item_id"], r["text"]) for r in mine]))
        split |= any(x.item[-1] == y.item[0] for x, y in zip(parts, parts[1:]))
        for k in range(0, len(parts), TOGETHER):
            if corpus is None:
                corpus, passages = randomised_svd(steps, idf)
            searched = [(n + i, _turn(corpus, passages, idf, found), found) for i, found in enumerate(parts[k : k + TOGETHER])]
            n += len(searched)
            out = out.unionByName(_search(docs, idf, corpus, searched))
    return _once(out) if split else out.drop("block")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a match, with all their columns."""
    hits = stored(matches(docs, benchmark).select("row").distinct(), "contaminated")
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    names = docs.columns
    slim = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], key.alias("row"))
    left = slim.join(hits, "row", "left_anti")
    return left.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
