"""The trie of conversations against loops over all prefixes."""

import hashlib
import math
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tickloom.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string"


def sequences(rows):
    """The turns of each conversation in order."""
    each = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            r, x = role or "", text or ""
            each[c].append((t is not None, t or 0, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).hexdigest(), r, x))
    return {c: [(t[3], t[4]) for t in sorted(v)] for c, v in each.items()}


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
    return out


def trie(seqs):
    members = defaultdict(list)
    for c, turns in seqs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(int)
    for k in members:
        if k:
            children[k[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += children[k] == 0
            saved[k[:d]] += (len(m) - 1) * (len(k[-1][1]) if k else 0)
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(seqs[c]) == len(k))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    names = [*prefix_trie.RESULT, "ends_sha256"]
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def random_rows(n, seed=1, words=3, turns=7):
    rng = np.random.default_rng(seed)
    return [(int(c), int(t), "user" if t % 2 else "bot", "w" * int(rng.integers(words))) for c in rng.permutation(n) for t in range(rng.integers(0, turns))]


def test_lcps_and_extents_equal_loops():
    rng = np.random.default_rng(2)
    for _ in range(60):
        seqs = sorted({tuple(rng.integers(0, 3, rng.integers(0, 6)).tolist()) for _ in range(rng.integers(1, 40))})
        symbols = np.array([[s, 1] for q in seqs for s in q], np.uint64).reshape(-1, 2)
        first = np.concatenate([[0], np.cumsum([len(q) for q in seqs])])
        lcp = prefix_trie.neighbour_lcps(symbols, first)
        want = [-1] + [next((k for k in range(len(b)) if k >= len(a) or a[k] != b[k]), len(b)) for a, b in zip(seqs, seqs[1:], strict=False)]
        assert lcp.tolist() == want
        at = [(i, d) for i, q in enumerate(seqs) for d in range(len(q) + 1)]
        row, depth = (np.array(x) for x in zip(*at, strict=True))
        left, right = prefix_trie.extents(prefix_trie.sparse_minima(lcp), row, depth)
        for (i, d), lo, hi in zip(at, left.tolist(), right.tolist(), strict=True):
            same = [k for k, q in enumerate(seqs) if len(q) >= d and q[:d] == seqs[i][:d]]
            assert (lo, hi) == (same[0], same[-1])


def test_range_minima_equal_loops():
    rng = np.random.default_rng(3)
    v = rng.integers(0, 50, 37)
    pairs = [(a, b) for a in range(37) for b in range(a, 37)]
    left, right = (np.array(x) for x in zip(*pairs, strict=True))
    got = prefix_trie.range_minima(prefix_trie.sparse_minima(v), left, right)
    assert got.tolist() == [v[a : b + 1].min() for a, b in pairs]


def test_trie_of_the_table(spark, folder):
    rows = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    out = queries.QUERIES["op11_conversation_trie"](spark, folder)
    assert all(t == "bigint" for c, t in out.dtypes if c != "ends_sha256")
    assert found(out) == trie(rebuilt(sequences([tuple(r) for r in rows])))


@pytest.mark.parametrize("n, words, turns, parts", [(400, 2, 6, 1), (400, 2, 6, 13), (60, 1, 4, 40), (300, 40, 9, 7)])
def test_trie_equals_all_prefixes(spark, n, words, turns, parts):
    """Few and many ranges: most nodes of the last cases touch the end of a range."""
    rows = random_rows(n, n + parts, words, turns)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        turns_ = prefix_trie.turns_of(spark.createDataFrame(rows, SCHEMA))
        assert found(prefix_trie.prefix_trie(turns_)) == trie(sequences(rows))
        assert found(prefix_trie.prefix_trie(prefix_trie.with_shared_heads(turns_))) == trie(rebuilt(sequences(rows)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_trie_of_a_hot_group_and_a_long_conversation(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(900) for t in range(3)]  # 900 equal conversations: several pieces of ids
    rows += [(1000, t, "user", f"t{t}" if t < 3 else "x" * (t % 7)) for t in range(700)] + [(-5, 0, "user", "t0")]
    got = found(prefix_trie.prefix_trie(prefix_trie.turns_of(spark.createDataFrame(rows, SCHEMA))))
    assert got == trie(sequences(rows))


def test_trie_of_awkward_rows(spark):
    rows = [
        (None, 0, "user", "nobody's"),
        (1, None, "user", "first"),
        (1, 0, None, None),
        (1, 2, "user", "a tie"),
        (1, 2, "bot", "a tie"),
        (2, 0, "", ""),
        (2, 0, "", ""),  # a repeated row is a turn
        (3, 5, "user", "日本 🙂 \x00"),
        (-7, 5, "user", "日本 🙂 \x00"),
        (103, 5, "us", "er日本"),
        (104, 5, "user", "y" * 100_000),
        (200, 0, "u", ":"),
        (201, 0, "u:", ""),
    ]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], SCHEMA + ", depth int, key string")
    turns = prefix_trie.turns_of(df)
    assert found(prefix_trie.prefix_trie(turns)) == trie(sequences(rows))
    assert found(prefix_trie.prefix_trie(prefix_trie.with_shared_heads(turns))) == trie(rebuilt(sequences(rows)))


def test_trie_of_turnless_conversations(spark):
    """Conversation 301 takes its only turns from one that is absent: a member of the root alone."""
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in range(300, 400)}
    c = next(c for c, x in h.items() if x >= 1 and c != 300)
    turns = prefix_trie.turns_of(spark.createDataFrame([(c, 0, "user", "gone")], SCHEMA))
    out = found(prefix_trie.prefix_trie(prefix_trie.with_shared_heads(turns)))
    assert out == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_trie_of_nothing(spark):
    assert found(prefix_trie.prefix_trie(prefix_trie.turns_of(spark.createDataFrame([], SCHEMA)))) == []
    assert found(prefix_trie.prefix_trie(prefix_trie.turns_of(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)))) == []


def test_sql_of_the_trie(spark):
    rows = [(c, t, r, x) for c, t, r, x in random_rows(260, 5)] + [(1, None, "user", "first"), (2, 0, None, None), (-5, 1, "a", "b")]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [list(r) for r in rows])
    cur = con.execute(queries.ORACLES["op11_conversation_trie"])
    names = [d[0] for d in cur.description]
    at = [names.index(c) for c in [*prefix_trie.RESULT, "ends_sha256"]]
    assert sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=repr) == trie(rebuilt(sequences(rows)))


def test_nodes_of_one_range():
    """Interval sums of a single range, all of whose border nodes are open."""
    digest = [bytes([k] * 16) for k in range(3)]
    keys = [b"", digest[0], digest[0] + digest[1], digest[0] + digest[2], digest[1]]
    rows = pa.table({"key": pa.array(keys, pa.binary()), "chars": pa.array([[], [1], [1, 2], [1, 3], [4]], pa.list_(pa.int32())), "conv_id": [5, 4, 3, 2, 1], "weight": [1, 1, 2, 1, 3], "ends": ["a", "b", "c", "d", "e"]})
    out = {(r["conv_id"], r["depth"]): r for r in prefix_trie.range_nodes(rows).to_pylist()}
    assert {k: (r["open"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"]) for k, r in out.items()} == {
        (1, 0): (True, 8, 1, 2, 5),  # its closed child is digest 0; the open one is added later
        (2, 1): (False, 4, 2, 2, 3 + 2),
        (3, 2): (False, 2, 0, 1, 2),
        (2, 2): (False, 1, 0, 1, 0),
        (1, 1): (True, 3, 0, 0, 0),
    }
