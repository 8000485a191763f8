"""Trie of conversation prefixes from sorted sequences, without a stack.

Every turn becomes a digest, every conversation a sequence of digests, and equal sequences take
part once, with their number. The sequences are sorted over the whole cluster, so the members of
a prefix stand side by side. In each range of the order a task computes the LCPs of neighbours
and a sparse table of their minima over 2**k rows; each candidate prefix then finds its member
interval by two binary searches of its own, to the left and to the right, for as long as the
minimum stays at its depth or above. Sums over members and subtrees are differences of prefix sums.

An interval that touches the end of a range may go on in the next one. These *open* nodes are the
prefixes of the first and last sequence of each range, so there are few; they meet in one
aggregate by the digest of their prefix, while all other nodes are final where they are found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .tokens import give_back, table

DIGEST = 16  # bytes of a turn's digest
RANGE = 1 << 19  # turns that a range of the sorted sequences holds on average
CHUNK = 256  # conversation ids that are joined to one piece before a node's hash reads them
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turns_of(rows: DataFrame) -> DataFrame:
    """(conv_id, turns): one row per conversation, its turns in order as (digest, chars).

    ``rows`` has conv_id, turn, role and text. Null role or text counts as empty; a null turn
    comes first; equal turns are ordered by their digest, and a repeated row is a turn of its
    own. Rows without conv_id belong to no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST)
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn", digest.alias("digest"), F.length(text).alias("chars"))
    whole = rows.where(F.col("conv_id").isNotNull()).groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("t"))
    return whole.select("conv_id", F.transform("t", lambda t: F.struct(t["digest"].alias("digest"), t["chars"].alias("chars"))).alias("turns"))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the joined pieces of each sequence, piece by piece."""
    last, running = None, None
    for batch in batches:
        done: list[tuple[bytes, str]] = []
        for seq, piece in zip(batch["seq"].to_pylist(), batch["piece"].to_pylist(), strict=True):
            if seq != last:
                if running is not None:
                    done.append((last, running.hexdigest()))
                last, running = seq, hashlib.sha256(piece.encode())
            else:
                running.update(b"," + piece.encode())
        yield table(seq=pa.array([s for s, _ in done], pa.binary()), ends=pa.array([e for _, e in done], pa.string()))
    if running is not None:
        yield table(seq=pa.array([last], pa.binary()), ends=[running.hexdigest()])


def _sequences(turns: DataFrame) -> DataFrame:
    """Distinct sequences: key (all digests), chars, least conv_id, weight (conversations) and
    ends (SHA-256 of their ids in order, comma-joined).

    The ids of one sequence are joined in pieces of at most ``CHUNK`` numbers in any task; the
    hash, which can only run over them in order, then reads pieces and holds one at a time.
    """
    each = turns.select(
        "conv_id",
        F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("key"),
        F.transform("turns", lambda t: t["chars"]).alias("chars"),
    )
    each = stored(each.withColumn("seq", F.unhex(F.sha2("key", 256))), "sequences")
    once = each.groupBy("seq").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("weight"), F.first("key").alias("key"), F.first("chars").alias("chars"))
    pieces = each.groupBy("seq", F.floor(F.col("conv_id") / CHUNK).alias("at")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    pieces = pieces.select("seq", "at", F.array_join("ids", ",").alias("piece"))
    ends = pieces.repartition("seq").sortWithinPartitions("seq", "at").select("seq", "piece").mapInArrow(_ends, "seq binary, ends string")
    return stored(once.join(ends, "seq").drop("seq"), "sequences")


def sparse_minima(values: np.ndarray) -> list[np.ndarray]:
    """Level k holds at i the least of ``values[i : i + 2**k]``."""
    levels, step = [values], 1
    while 2 * step <= len(values):
        levels.append(np.minimum(levels[-1][:-step], levels[-1][step:]))
        step *= 2
    return levels


def range_minima(levels: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least value of each range, both ends included: two windows that overlap."""
    out = np.empty(len(left), levels[0].dtype)
    level = np.log2(right - left + 1).astype(np.int64)
    for k in np.unique(level):
        at = level == k
        out[at] = np.minimum(levels[k][left[at]], levels[k][right[at] - (1 << k) + 1])
    return out


def extents(levels: list[np.ndarray], row: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last row that share the first ``depth`` symbols with ``row``.

    ``levels`` is the sparse table of the LCPs (entry i: rows i - 1 and i). Each side is a binary
    search by halving steps; no prefix looks at another one's result.
    """
    n, left, right = len(levels[0]), row.copy(), row.copy()
    for k in reversed(range(len(levels))):
        step, least = 1 << k, levels[k]
        fits = right + step < n
        right += step * (fits & (least[np.where(fits, right + 1, 0)] >= depth))
        fits = left >= step
        left -= step * (fits & (least[np.where(fits, left - step + 1, 0)] >= depth))
    return left, right


def neighbour_lcps(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Symbols that each sequence shares with the one before; -1 for the first sequence."""
    size = np.diff(first)
    lcp = np.full(len(size), -1, np.int64)
    both = np.minimum(size[1:], size[:-1])
    lcp[1:] = both
    row = np.repeat(np.arange(1, len(size)), both)
    at = np.arange(len(row)) - np.repeat(np.cumsum(both) - both, both)
    differ = (symbols[first[row - 1] + at] != symbols[first[row] + at]).any(1)
    np.minimum.at(lcp, row[differ], at[differ])
    return lcp


def _chain(symbols: np.ndarray) -> list[bytes]:
    """A digest of each prefix, the empty one first."""
    out = [bytes(DIGEST)]
    for symbol in symbols:
        out.append(hashlib.sha256(out[-1] + symbol.tobytes()).digest()[:DIGEST])
    return out


NODES = "open boolean, key binary, parent binary, on_first boolean, on_last boolean, part int, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, chars long, ends string"


def range_nodes(rows: pa.Table, part: int = 0) -> pa.RecordBatch:
    """The nodes of one range of the sorted sequences. Those that touch its ends are open: their
    counts hold what lies in this range, without other open nodes."""
    key = rows["key"].combine_chunks().cast(pa.large_binary())
    n = len(key)
    body = key.buffers()[2]
    offsets = np.frombuffer(key.buffers()[1], np.int64)[key.offset : key.offset + n + 1]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    symbols, first = data.view(np.uint64).reshape(-1, 2) if len(data) else np.zeros((0, 2), np.uint64), (offsets - offsets[0]) // DIGEST
    chars = np.asarray(pa.concat_arrays([c.flatten() for c in rows["chars"].chunks]), np.int64)
    least, weight = (np.asarray(rows[c].combine_chunks(), np.int64) for c in ("conv_id", "weight"))

    lcp = neighbour_lcps(symbols, first)
    size = np.diff(first)
    levels = sparse_minima(lcp)
    fresh = size - lcp  # prefixes that no earlier sequence of the range has
    from_ = np.concatenate([[0], np.cumsum(fresh)])
    row = np.repeat(np.arange(n), fresh)
    depth = np.arange(from_[-1]) - from_[row] + lcp[row] + 1
    left, right = extents(levels, row, depth)
    # the parent: the node before, or, for the first new prefix of a sequence, found by its own extent
    above = extents(levels, row, depth - 1)[0]
    parent = from_[above] + (depth - 1) - (lcp[above] + 1)
    parent[0] = -1  # the root

    members = np.concatenate([[0], np.cumsum(weight)])
    n_convs = members[right + 1] - members[left]
    conv_id = range_minima(sparse_minima(least), left, right)
    last_chars = np.concatenate([chars, [0]])[np.where(depth > 0, first[row] + depth - 1, len(chars))]
    on_first, on_last = left == 0, right == n - 1
    open_ = on_first | on_last
    done = np.flatnonzero(~open_)
    n_children = np.bincount(parent[done], minlength=len(row))
    end = from_[right + 1]  # a subtree is a run of nodes in this order

    def subtree(values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(np.where(open_, 0, values))])
        return total[end] - total[np.arange(len(row))]

    chains = _chain(symbols[: first[1]]), _chain(symbols[first[n - 1] :])
    keys = np.full(len(row), None, object)
    for chain, on in zip(chains, (on_first, on_last), strict=True):
        for i in np.flatnonzero(on):
            keys[i] = chain[depth[i]]
    below_open = (parent >= 0) & open_[parent]
    parents = np.where(below_open, keys[parent], None)
    at_end = depth == size[row]
    ends = rows["ends"].combine_chunks().take(pa.array(np.where(at_end, row, 0))).to_numpy(zero_copy_only=False)
    return table(
        open=open_, key=pa.array(keys, pa.binary()), parent=pa.array(parents, pa.binary()), on_first=on_first, on_last=on_last,
        part=np.full(len(row), part, np.int32), depth=depth, conv_id=conv_id, parent_conv_id=pa.array(conv_id[parent], mask=below_open | (parent < 0)),
        n_convs=n_convs, n_children=n_children, n_leaves=subtree((n_children == 0).astype(np.int64)), saved_tokens=subtree((n_convs - 1) * last_chars),
        chars=last_chars, ends=pa.array(np.where(at_end, ends, None), pa.string()),
    )


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(found) if (found := [b for b in batches if b.num_rows]) else None
    if rows is not None:
        yield range_nodes(rows, TaskContext.get().partitionId())
        give_back()


def _merged(open_: DataFrame) -> DataFrame:
    """Open nodes of all ranges, each once, with whole sums.

    What an open node adds to the nodes above it is counted along one border path that holds it:
    a running sum from the deepest prefix of that path upwards.
    """
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    edges = F.array_compact(F.array(F.when(F.col("on_first"), 2 * F.col("part")), F.when(F.col("on_last"), 2 * F.col("part") + 1)))
    open_ = open_.withColumn("edges", edges)
    whole = open_.groupBy("key").agg(
        F.min(F.array_min("edges")).alias("owner"), F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *sums, F.first("chars").alias("chars"), F.max("ends").alias("ends")
    )
    below = whole.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("below"))
    whole = stored(whole.join(below, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("below", F.lit(0))), "open")
    own = F.struct((F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    path = open_.select("key", F.explode("edges").alias("edge")).join(whole.select("key", "depth", "owner", own.alias("own")), "key")
    mine = F.col("edge") == F.col("owner")
    up = Window.partitionBy("edge").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    added = path.select("key", *[F.sum(F.when(mine, F.col(f"own.{c}")).otherwise(0)).over(up).alias(f"{c}_in") for c in ("leaf", "saved")])
    added = added.groupBy("key").agg(F.sum("leaf_in").alias("leaf_in"), F.sum("saved_in").alias("saved_in"))
    above = whole.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = whole.join(added, "key").join(above, "parent", "left")
    return out.withColumns({"n_leaves": F.col("n_leaves") + F.col("leaf_in"), "saved_tokens": F.col("saved_tokens") + F.col("saved_in")})


RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row per distinct prefix of the conversations in ``turns``, see ``turns_of``.

    Returns conv_id (smallest member), depth, parent_conv_id (that of the prefix one turn
    shorter; null at the root), n_convs (conversations that start with it), n_children,
    n_leaves (childless nodes in its subtree, itself included), saved_tokens (over its subtree,
    each node's n_convs - 1 times the code points of its last text) and ends_sha256 (of the ids
    of the conversations that end here, ascending, comma-joined; none: of the empty string).
    A conversation without turns is a member of the root only; no conversations, no rows.
    Prefixes count as equal when the 128-bit digests of their turns are. One conversation is a
    unit of work: about 30 bytes a turn.
    """
    spark = turns.sparkSession
    sequences = _sequences(turns)
    total = sequences.agg(F.sum(F.size("chars") + 1)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE))
    ordered = sequences.repartitionByRange(parts, "key").sortWithinPartitions("key")
    nodes = stored(ordered.select("key", "chars", "conv_id", "weight", "ends").mapInArrow(_ranges, NODES), "nodes")
    merged = stored(_merged(nodes.where("open")).select("key", *RESULT, "ends"), "open")
    least = merged.agg(F.min("conv_id")).first()[0]  # the root's conversation: parent of a large part of the nodes
    first = F.col("depth") == 1
    above = merged.where("depth > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("above"))
    closed = nodes.where("not open").withColumn("parent", F.when(~first, F.col("parent"))).join(above, "parent", "left")
    closed = closed.withColumn("parent_conv_id", F.when(first, F.lit(least)).otherwise(F.coalesce("parent_conv_id", "above")))
    out = closed.select(*RESULT, "ends").unionByName(merged.select(*RESULT, "ends"))
    return out.select(*RESULT, F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"))


def with_shared_heads(turns: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Conversations that begin with turns of another one: the first h turns of conversation
    c - c % every (all if fewer, none if absent), then their own after the first h, where
    h = crc32 of the decimal id, modulo ``most``. ``turns`` and the result as in ``turns_of``."""
    base = (F.col("conv_id") - F.col("conv_id") % every).alias("base")
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    heads = turns.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    both = turns.select("conv_id", "turns", base, h.alias("h")).join(heads, "base", "left")
    head = F.coalesce(F.expr("slice(head, 1, h)"), F.expr("slice(turns, 1, 0)"))
    return both.select("conv_id", F.concat(head, F.expr("slice(turns, h + 1, size(turns))")).alias("turns"))
