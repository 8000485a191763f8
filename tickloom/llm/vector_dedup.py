"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products, one kept of each group.

Vectors link when their labels are equal and their cosine reaches the threshold. The search is
exact; what keeps it apart from comparing all with all:

* equal vectors take part once, with their number;
* *balls* take up hot groups of near copies: all vectors within half the threshold angle of a
  pivot link with each other, which needs no products; only vectors in the shell around a ball
  are compared with its members;
* the others go to the nearest of a label's k-means cells, and as a guest to each other cell
  that may hold a partner. Two unit vectors that link are at most a chord apart, so a partner in
  cell j needs ``(c_i - c_j) . u <= chord * |c_i - c_j|`` for u in cell i: a plane lies between cells.

Cells and shells are compared in blocks: rows of a large one are dealt out in parts, and each
pair of parts is one matrix product in one task. A block returns a number per vector and links
along its components, never its pairs. Centroids and pivots come from a bounded sample; they only
decide where vectors are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .components import components
from .tokens import table
from .vectors import matrix, row_blocks, usable

SAMPLE = 8192  # vectors that pivots and centroids are fitted on
SAMPLE_BYTES = 1 << 26  # and their size at most
CELL = 1024  # vectors of a label for each of its cells, up to
CELLS = 1024  # cells of a label; beyond that cells grow and are compared in more parts
PART = 2048  # rows of a cell or shell that meet in one product
BALLS = 64  # hot groups that are looked for
BALL_HITS = 16  # sample members that make a group hot


def units(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; entries are scaled first, so no square overflows."""
    v = v / np.maximum(np.abs(v).max(1, keepdims=True), np.finfo(float).tiny)
    return v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), np.finfo(float).tiny)


def spherical_kmeans(u: np.ndarray, k: int, rounds: int = 10, seed: int = 13) -> np.ndarray:
    """k unit centroids of unit vectors; a cell that loses all its vectors keeps its centroid."""
    rng = np.random.default_rng(seed)
    c = u[rng.choice(len(u), k, replace=len(u) < k)]
    for _ in range(rounds):
        cell = np.concatenate([(part @ c.T).argmax(1) for part in np.array_split(u, max(1, len(u) * k >> 20))])
        total = np.zeros_like(c)
        np.add.at(total, cell, u)
        size = np.sqrt((total * total).sum(1, keepdims=True))
        c = np.where(size > 1e-9, total / np.maximum(size, 1e-9), c)
    return c


def pivots(u: np.ndarray, labels: np.ndarray, angle: float) -> list[tuple[int, np.ndarray]]:
    """(row, direction) of the hot groups of a sample: the vector with most others of its label within
    ``angle`` first, then again without those."""
    n = len(u)
    near = np.zeros((n, n), bool)
    for begin in range(0, n, 512):
        part = slice(begin, begin + 512)
        near[part] = (u[part] @ u.T >= math.cos(angle)) & (labels[part, None] == labels[None])
    hits, out = near.sum(1), []
    while len(out) < BALLS and n:
        top = int(hits.argmax())
        if hits[top] < BALL_HITS:
            break
        group = np.flatnonzero(near[top])
        out.append((top, units(u[group].mean(0, keepdims=True))[0]))
        hits = hits - near[:, group].sum(1)
        near[group], near[:, group], hits[group] = False, False, 0
    return out


@dataclass(frozen=True)
class Book:
    """What places a vector: balls (label, direction), centroids for 1, 2, 4, ... cells, and the threshold."""

    dim: int
    labels: list[str]
    directions: np.ndarray
    cells: dict[int, np.ndarray]
    cosine: float

    @property
    def angle(self) -> float:
        return math.acos(self.cosine)

    @property
    def radius(self) -> float:
        """Any two vectors of a ball link, with room for rounding."""
        return self.angle / 2 - 1e-6


LEFT, RIGHT = 0, 1  # a left row counts its partners on the right; a member on the right counts loose rows on the left


def place(book: Book, u: np.ndarray, label: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The ball of each vector (-1: loose) and the entries: row, group, side. Groups: ball b is -1 - b, cells count from 0."""
    ball = np.full(len(u), -1)
    rows, groups, sides = [], [], []

    def enter(at: np.ndarray, group: np.ndarray | int, side: int) -> None:
        rows.append(at)
        groups.append(np.broadcast_to(group, at.shape))
        sides.append(np.full(at.shape, side))

    names, code = np.unique(label.astype(str), return_inverse=True)
    same = (names[:, None] == np.array(book.labels, str)[None])[code]
    cosine = np.zeros((len(u), 0))
    if u.shape[1] == book.dim and len(book.labels):
        cosine = np.where(same, u @ book.directions.T, -2.0)
        best = cosine.argmax(1)
        ball = np.where(cosine[np.arange(len(u)), best] >= math.cos(book.radius), best, -1)
        outer = math.cos(min(math.pi, book.angle + book.radius + 2e-6))
        for b in range(len(book.labels)):
            mine = ball == b
            enter(np.flatnonzero(mine), -1 - b, RIGHT)
            enter(np.flatnonzero(~mine & (cosine[:, b] >= outer)), -1 - b, LEFT)
    loose = ball < 0
    chord = math.sqrt(2 - 2 * book.cosine) + 1e-9
    for cells in np.unique(k[loose]).tolist():
        at = np.flatnonzero(loose & (k == cells))
        if cells == 1 or u.shape[1] != book.dim:
            enter(at, 0, LEFT)
            enter(at, 0, RIGHT)
            continue
        c = book.cells[cells]
        apart = np.sqrt(np.maximum(2 - 2 * np.clip(c @ c.T, -1, 1), 0))
        for part in np.array_split(at, max(1, len(at) * cells >> 19)):
            s = u[part] @ c.T
            home = s.argmax(1)
            enter(part, home, LEFT)
            i, j = np.nonzero(s[np.arange(len(part)), home][:, None] - s <= chord * apart[home] + 1e-12)  # its own cell among them
            enter(part[i], j, RIGHT)
    if not rows:
        empty = np.zeros(0, np.int64)
        return ball, {"row": empty, "group": empty, "side": empty}
    return ball, {"row": np.concatenate(rows), "group": np.concatenate(groups), "side": np.concatenate(sides)}


def bipartite_components(i: np.ndarray, j: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least name that each left and right row reaches over the links (i, j); ``left`` and ``right`` are their names."""
    a, b = left.copy(), right.copy()
    while True:
        before = a.copy(), b.copy()
        np.minimum.at(a, i, b[j])
        np.minimum.at(b, j, a[i])
        if (a == before[0]).all() and (b == before[1]).all():
            return a, b


def block(rows: pa.Table, cosine: float) -> pa.Table:
    """Partners and links of one part of the left rows of a group with one part of its right rows."""
    side = np.asarray(rows["side"])
    sides = [rows.filter(pa.array(side == s)) for s in (LEFT, RIGHT)]
    if not all(t.num_rows for t in sides):
        return pa.table({"node": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "other": pa.array([], pa.int64())})
    (u, v) = (units(matrix(t["vector"].combine_chunks(), int(t["dim"][0].as_py()))) for t in sides)
    (left, right), (wl, wr) = ([np.asarray(t[c]) for t in sides] for c in ("node", "weight"))
    loose = ~np.asarray(sides[LEFT]["in_ball"])
    near = (u @ v.T >= cosine) & (left[:, None] != right[None])
    i, j = np.nonzero(near)
    a, b = bipartite_components(i, j, left, right)
    n_left = np.bincount(i, wr[j], len(left)).astype(np.int64)
    count = loose[i] & np.asarray(sides[RIGHT]["in_ball"])[j]
    n_right = np.bincount(j[count], wl[i[count]], len(right)).astype(np.int64)
    node, n, least = (np.concatenate(x) for x in ((left, right), (n_left, n_right), (a, b)))
    out = pa.table({"node": node, "n": n, "other": pa.array(least, mask=least == node)})
    return out.filter(pa.array((n > 0) | (least != node)))


def _book(reps: DataFrame, cosine: float, most: int) -> Book | None:
    """Pivots and centroids from a sample: the first vectors in an order by hash, of the most frequent length."""
    dim = reps.groupBy("dim").agg(F.count("*").alias("n")).agg(F.max_by("dim", F.struct("n", "dim"))).first()[0]
    if dim is None:
        return None
    rows = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))
    sample = reps.where(F.col("dim") == dim).orderBy(F.xxhash64("h1"), "h2", "label").limit(rows).select("label", F.col("vector").cast("array<double>").alias("vector")).toArrow()
    u, labels = units(matrix(sample["vector"].combine_chunks(), dim)), np.array(sample["label"].to_pylist(), object)
    found = pivots(u, np.unique(labels.astype(str), return_inverse=True)[1], math.acos(cosine) / 2 - 1e-6)
    directions = np.array([d for _, d in found]).reshape(-1, dim)
    cover = (u @ directions.T >= math.cos(math.acos(cosine) / 2)).any(1)
    spread = u[~cover] if (~cover).any() else u
    cells = {2**e: spherical_kmeans(spread, 2**e) for e in range(1, max(0, most).bit_length())}
    return Book(dim, [labels[i] for i, _ in found], directions, cells, cosine)


def _placed(reps: DataFrame, book: Book) -> DataFrame:
    """One row per entry (group not null), and one with the ball of each vector (group null)."""
    shared = reps.sparkSession.sparkContext.broadcast(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim in pc.unique(batch["dim"]).to_pylist():
                mine = batch.filter(pc.equal(batch["dim"], dim))
                for part in row_blocks(iter([mine]), dim):
                    ball, entries = place(shared.value, units(matrix(part["vector"].cast(pa.list_(pa.float64())), dim)), np.array(part["label"].to_pylist(), object), np.asarray(part["cells"]))
                    at, one = pa.array(entries["row"]), pa.array(np.arange(len(ball)))
                    for row, group, side, vector in ((at, pa.array(entries["group"]), entries["side"], part["vector"].take(at)), (one, pa.nulls(len(ball), pa.int64()), np.zeros(len(ball)), pa.nulls(len(ball), part["vector"].type))):
                        yield table(
                            label=part["label"].take(row), dim=part["dim"].take(row), group=group, side=np.asarray(side, np.int32), node=part["node"].take(row),
                            weight=part["weight"].take(row), ball=ball[np.asarray(row)], vector=vector,
                        )

    kind = reps.schema["vector"].dataType.simpleString()
    return stored(reps.select("label", "dim", "node", "weight", "cells", "vector").mapInArrow(run, f"label string, dim int, group long, side int, node long, weight long, ball long, vector {kind}"), "placed")


def _compared(entries: DataFrame, cosine: float) -> DataFrame:
    """(node, n, other): partners of vectors and links along components, from all blocks."""
    key = ["label", "dim", "group"]
    sizes = entries.groupBy(*key).agg(*[F.ceil(F.sum((F.col("side") == s).cast("long")) / PART).cast("int").alias(c) for s, c in ((LEFT, "lefts"), (RIGHT, "rights"))])
    dealt = entries.join(sizes.where("lefts > 0 and rights > 0"), key)
    is_left = F.col("side") == LEFT
    mine = F.pmod(F.xxhash64("node"), F.when(is_left, F.col("lefts")).otherwise(F.col("rights"))).cast("int")
    dealt = dealt.withColumn("mine", mine).withColumn("theirs", F.explode(F.sequence(F.lit(0), F.when(is_left, F.col("rights")).otherwise(F.col("lefts")) - 1)))
    dealt = dealt.withColumns({"l": F.when(is_left, F.col("mine")).otherwise(F.col("theirs")), "r": F.when(is_left, F.col("theirs")).otherwise(F.col("mine"))})
    rows = dealt.select(*key, "l", "r", "side", "node", "weight", (F.col("ball") >= 0).alias("in_ball"), F.col("vector").cast("array<double>").alias("vector"))

    def run(part: pa.Table) -> pa.Table:
        return block(part, cosine)

    return stored(rows.groupBy(*key, "l", "r").applyInArrow(run, "node long, n long, other long"), "compared")


def vector_dedup(df: DataFrame, cosine: float = 0.93, vector: str = "embedding", label: str = "label", key: str = "vec_id", cell: int = CELL) -> DataFrame:
    """Groups of vectors of one label that are linked by a cosine of at least ``cosine``.

    Returns vec_id, n_links (other vectors linked directly), component_id (smallest vec_id
    reachable by links, itself included) and kept (whether the row is that smallest one), one
    row per input row. Null labels, and vectors that are null, empty, zero or hold null or
    non-finite entries, link with nothing; so do vectors of different lengths. A repeated row is
    a vector of its own with the same id. Null ids take part: the component of such a row is the
    smallest id it reaches, or null; it is kept if there is none. An empty table gives an empty
    result. Other columns are ignored. ``cell`` is the number of vectors for each k-means cell.
    Vectors count as equal when 128 bits of hashes do.
    """
    if not 0 < cosine < 1:
        raise ValueError("cosine must lie between 0 and 1")
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("vector"))
    able = usable("vector") & F.col("label").isNotNull() & F.exists("vector", lambda x: x != 0)
    able = F.coalesce(able, F.lit(False))
    hashed = rows.where(able).withColumns({"h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit(13), "vector"), "dim": F.size("vector")})
    same = ["label", "h1", "h2"]
    reps = hashed.groupBy(*same).agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"), F.first("dim").alias("dim"), F.first("vector").alias("vector"))
    reps = stored(reps.withColumn("node", F.monotonically_increasing_id()), "vectors")
    of_label = reps.groupBy("label", "dim").agg(F.count("*").alias("m"))
    wanted = F.least(F.lit(CELLS), F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("m") / cell, F.lit(1.0))))).cast("int"))
    of_label = of_label.select("label", "dim", wanted.alias("cells"))
    book = _book(reps, cosine, of_label.agg(F.max("cells")).first()[0] or 1)
    alone = rows.where(~able).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if book is None:
        return alone
    placed = _placed(reps.join(of_label, ["label", "dim"]), book)
    compared = _compared(placed.where(F.col("group").isNotNull()), cosine)
    members = placed.where(F.col("group").isNull() & (F.col("ball") >= 0))
    balls = members.groupBy("ball").agg(F.sum("weight").alias("all"), F.min("node").alias("first")).collect()  # at most BALLS rows
    numbers = compared.groupBy("node").agg(F.sum("n").alias("n"))
    links = compared.where(F.col("other").isNotNull()).select(F.col("node").alias("u"), F.col("other").alias("v"))
    if balls:
        of_ball = F.create_map(*[F.lit(x) for b in balls for x in (b["ball"], b["all"])])
        first = F.create_map(*[F.lit(x) for b in balls for x in (b["ball"], b["first"])])
        numbers = numbers.unionByName(members.select("node", (of_ball[F.col("ball")] - F.col("weight")).alias("n"))).groupBy("node").agg(F.sum("n").alias("n"))
        links = links.unionByName(members.select(F.col("node").alias("u"), first[F.col("ball")].alias("v")).where("u <> v"))
    classes = stored(components(links), "classes")
    known = classes.join(reps.select("node", "least"), "node")
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    placed_in = classes.join(least, "component").select("node", "component_id")
    found = reps.select(*same, "node", "weight", "least").join(numbers, "node", "left").join(placed_in, "node", "left")
    found = found.select(*same, (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    out = hashed.select("vec_id", *same).join(found, same)
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")).unionByName(alone)


def keep_one(df: DataFrame, cosine: float = 0.93, vector: str = "embedding", label: str = "label", key: str = "vec_id") -> DataFrame:
    """The rows of ``df`` whose id is the smallest of its group, with all their columns.

    Rows are told apart by id: those that share an id (or have none) stay if one of them does.
    """
    kept = vector_dedup(df, cosine, vector, label, key).where("kept").select(F.col("vec_id").alias("_kept")).distinct()
    return df.join(kept, F.col(f"`{key}`").cast("long").eqNullSafe(F.col("_kept")), "left_semi")
