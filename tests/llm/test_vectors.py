"""Whitening and near-duplicate vectors against numpy over all rows and all pairs."""

import datetime as dt
import math

import duckdb
import numpy as np
import pytest

from tickloom.llm import queries, vector_dedup, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


# --- eigenvectors ----------------------------------------------------------


def matrices():
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    b = rng.normal(size=(60, 40))
    return {
        "random": b.T @ b,
        "one": np.array([[4.0]]),
        "two": np.array([[2.0, 1.0], [1.0, 2.0]]),
        "identity": np.eye(40),
        "repeated": q @ np.diag([5.0] * 12 + [1.0] * 28) @ q.T,
        "diagonal": np.diag(np.arange(40.0)),
        "falling": q @ np.diag(10.0 ** -np.arange(40)) @ q.T,
        "low rank": b[:7].T @ b[:7],
        "blocks": np.kron(np.eye(20), [[2.0, 1.0], [1.0, 2.0]]),
        "huge": 1e200 * (b.T @ b),
    }


@pytest.mark.parametrize("name", list(matrices()))
def test_eigenvectors(name):
    a = matrices()[name]
    values, vectors = whitening.leading_eigenvectors(a, 32)
    want = np.sort(np.linalg.eigvalsh(a))[::-1]
    assert len(values) == min(32, int((want > 1e-12 * want[0]).sum())) or name == "falling"
    np.testing.assert_allclose(values, want[: len(values)], rtol=0, atol=1e-13 * want[0])
    assert np.abs(a @ vectors - vectors * values).max() <= 1e-13 * want[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13
    assert (vectors[np.abs(vectors).argmax(0), np.arange(len(values))] > 0).all()


def test_sturm_counts():
    rng = np.random.default_rng(4)
    d, e = rng.normal(size=12), rng.normal(size=11)
    e[5] = 0
    values = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    x = np.concatenate([values - 1e-9, values + 1e-9, rng.normal(size=20)])
    assert whitening.sturm_counts(d, e, x).tolist() == [int((values < v).sum()) for v in x]


def test_no_eigenvectors_of_zero():
    values, vectors = whitening.leading_eigenvectors(np.zeros((3, 3)), 2)
    assert values.shape == (0,) and vectors.shape == (3, 0)


# --- whitening -------------------------------------------------------------


def whitened(c, k):
    """The contract by numpy and whole numbers: n, deviations, whitened (up to sign), explained."""
    x = [[math.floor(64 * float(v)) + 1_000_000 for v in row] for row in c]
    n, sums = len(x), [sum(col) for col in zip(*x, strict=True)]
    deviation = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    d = np.array([[(n * v - s) / n for v, s in zip(row, sums, strict=True)] for row in x])
    e, u = np.linalg.eigh(d.T @ d / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return n, deviation, d @ u / np.sqrt(e), e / np.trace(d.T @ d / n)


def check_whitened(out, ids, c, k):
    n, deviation, w, explained = whitened(c, k)
    rows = sorted(out.collect(), key=lambda r: (r.vec_id, r.component))
    assert [(r.vec_id, r.component) for r in rows] == [(i, j + 1) for i in sorted(ids) for j in range(len(explained))]
    order = np.argsort(ids, kind="stable")
    got = np.array([r.whitened for r in rows]).reshape(len(ids), -1)
    signs = np.sign((got * w[order]).sum(0))
    np.testing.assert_allclose(got, signs * w[order], atol=1e-8)
    assert [int(r.deviation) for r in rows[:: len(explained)]] == [deviation[i] for i in order]
    assert {r.n for r in rows} == {n} and max(r.identity_error for r in rows) < 1e-9
    np.testing.assert_allclose([r.explained for r in rows[: len(explained)]], explained, rtol=1e-9)


def test_whitening_of_the_table(spark, folder):
    out = queries.QUERIES["op12_embedding_whitening"](spark, folder)
    assert dict(out.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    check_whitened(out, [r.vec_id for r in rows], [r.embedding for r in rows], 32)


def test_whitening_of_awkward_rows(spark):
    rng = np.random.default_rng(5)
    good = [(i, [float(v) for v in rng.normal(size=3).astype(np.float32)]) for i in range(40)]
    good[5:7] = [(90, [9.0, -4.0, 2.5]), (91, [9.0, -4.0, 2.5])]  # equal rows
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, float("nan"), 2.0]), (103, [float("inf"), 0.0, 0.0]), (104, [-float("inf"), 0.0, 0.0]), (105, []), (106, [1.0, 2.0])]
    df = spark.createDataFrame([(e, i, 7, "x", None) for i, e in good + bad], "embedding array<double>, vec_id long, n int, component string, v date")
    check_whitened(whitening.whiten(df, 32), [i for i, _ in good], [e for _, e in good], 3)


def test_whitening_is_exact_for_large_numbers(spark):
    rows = [(i, [float(v), 3.0e12 * (i % 5) + i]) for i, v in enumerate(np.linspace(-1e13, 1e13, 50))]
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 2)
    n, deviation, _, _ = whitened([e for _, e in rows], 2)
    assert max(deviation) > 2**63
    assert {(r.vec_id, int(r.deviation)) for r in out.collect()} == {(i, d) for (i, _), d in zip(rows, deviation, strict=True)}


def test_whitening_without_spread(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0])]):
        out = whitening.whiten(spark.createDataFrame(rows, schema))
        assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.count() == 0
    two = whitening.whiten(spark.createDataFrame([(1, [0.0, 0.0]), (None, [1.0, 1.0])], schema)).collect()
    assert sorted((r.vec_id is None, r.component, abs(round(r.whitened, 9))) for r in two) == [(False, 1, 1.0), (True, 1, 1.0)]


# --- near duplicates -------------------------------------------------------


def brute(rows, cosine=0.93):
    """(n_links, component, kept) of each row, in order, over all pairs."""
    unit = []
    for _, e, label in rows:
        able = label is not None and e and all(v is not None and math.isfinite(v) for v in e) and any(e)
        unit.append(np.array(e, float) / np.linalg.norm(np.array(e, float)) if able else None)
    links = [[] for _ in rows]
    for a in range(len(rows)):
        for b in range(a):
            if unit[a] is not None and unit[b] is not None and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine:
                links[a].append(b)
                links[b].append(a)
    out = [None] * len(rows)
    for a in range(len(rows)):
        if out[a] is None:
            group, todo = {a}, [a]
            while todo:
                for b in links[todo.pop()]:
                    if b not in group:
                        group.add(b)
                        todo.append(b)
            least = min((rows[b][0] for b in group if rows[b][0] is not None), default=None)
            for b in group:
                out[b] = (len(links[b]), least, rows[b][0] == least)
    return sorted(((r[0], *o) for r, o in zip(rows, out, strict=True)), key=repr)


def found(df, **options):
    return sorted((tuple(r) for r in vector_dedup.vector_dedup(df, **options).select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)


def clusters(n=600, dim=8, seed=6):
    """Vectors around centres at all distances, with copies, chains, scaled copies and a hot group."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, dim))
    rows = []
    for i in range(n):
        v = centres[rng.integers(40)] + rng.normal(size=dim) * rng.choice([0.02, 0.2, 0.35, 1.0])
        rows.append(v)
    hot = rng.normal(size=dim)
    rows += [hot + rng.normal(size=dim) * 0.03 for _ in range(n // 3)]
    rows += [hot + rng.normal(size=dim) * 0.4 for _ in range(n // 6)]
    rows += [rows[k] for k in rng.integers(0, n, n // 10)] + [7.5 * rows[k] for k in rng.integers(0, n, n // 10)]
    ids = rng.permutation(len(rows))
    return [(int(i), [float(x) for x in v.astype(np.float32)], int(rng.integers(3))) for i, v in zip(ids, rows, strict=True)]


@pytest.mark.parametrize("cell, part", [(512, 1024), (16, 1024), (32, 50)])
def test_dedup_equals_all_pairs(spark, monkeypatch, cell, part):
    monkeypatch.setattr(vector_dedup, "PART", part)
    rows = clusters()
    want = brute(rows)
    assert sum(not kept for *_, kept in want) > 100
    assert found(frame(spark, rows), cell=cell) == want


def test_dedup_of_awkward_rows(spark):
    near = [1.0, 0.2, 0.0]
    rows = [
        (1, [1.0, 0.0, 0.0], 1),
        (2, near, 1),
        (2, near, 1),  # a repeated row
        (3, near, 2),
        (4, near, None),
        (None, near, 1),
        (None, [0.0, 0.0, 9.0], 1),
        (5, None, 1),
        (6, [], 1),
        (7, [0.0, 0.0, 0.0], 1),
        (8, [float("nan"), 1.0, 0.0], 1),
        (9, [float("inf"), 1.0, 0.0], 1),
        (10, [1.0, None, 0.0], 1),
        (11, [1.0, 0.0], 1),
        (12, [2.0, 0.0], 1),
        (13, [-0.0, 1.0, 0.0], 3),
        (14, [0.0, 1.0, 0.0], 3),
        (15, [3e38, 3e38, 3e38], 4),
        (16, [1e-38, 1e-38, 1e-38], 4),
        (16, [-1.0, 0.0, 0.0], 4),
    ]
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA + ", node int, weight int, `group` string")
    assert found(df) == brute(rows)
    kept = vector_dedup.keep_one(df)
    assert kept.columns == df.columns
    ids = {i for i, _, _, k in brute(rows) if k}
    assert sorted((r.vec_id for r in kept.collect()), key=repr) == sorted((i for i, *_ in rows if i in ids), key=repr)


def test_dedup_of_nothing(spark):
    assert found(frame(spark, [])) == []
    assert found(frame(spark, [(1, None, 1), (2, [1.0], None)])) == [(1, 0, 1, True), (2, 0, 2, True)]
    with pytest.raises(ValueError):
        vector_dedup.vector_dedup(frame(spark, []), 1.5)


def test_a_hot_group_becomes_a_ball_and_makes_no_products(spark):
    """A third of the rows within a small angle: its rows enter no cell, whatever their number."""
    rng = np.random.default_rng(8)
    u = vector_dedup.units(np.concatenate([rng.normal(size=(400, 16)), rng.normal(size=16) + 0.02 * rng.normal(size=(200, 16))]))
    label = np.array(["a"] * 600, object)
    hits = vector_dedup.pivots(u, np.zeros(600, int), math.acos(0.93) / 2 - 1e-6)
    assert len(hits) == 1
    book = vector_dedup.Book(16, ["a"], np.array([hits[0][1]]), {}, 0.93)
    ball, entries = vector_dedup.place(book, u, label, np.ones(600, int))
    assert (ball[400:] == 0).all() and (ball[:400] == -1).all()
    assert not np.isin(entries["row"][entries["group"] >= 0], np.arange(400, 600)).any()


def test_every_link_meets_in_a_cell():
    rng = np.random.default_rng(9)
    base = vector_dedup.units(rng.normal(size=(300, 6)))
    u = vector_dedup.units(np.concatenate([base, base + 0.1 * rng.normal(size=base.shape)]))
    book = vector_dedup.Book(6, [], np.zeros((0, 6)), {16: vector_dedup.spherical_kmeans(u, 16)}, 0.93)
    _, entries = vector_dedup.place(book, u, np.array(["a"] * 600, object), np.full(600, 16))
    home = dict(zip(entries["row"][entries["side"] == vector_dedup.LEFT].tolist(), entries["group"][entries["side"] == vector_dedup.LEFT].tolist(), strict=True))
    right = set(zip(entries["row"][entries["side"] == vector_dedup.RIGHT].tolist(), entries["group"][entries["side"] == vector_dedup.RIGHT].tolist(), strict=True))
    i, j = np.nonzero(u @ u.T >= 0.93)
    assert len(i) > 1000 and all((b, home[a]) in right for a, b in zip(i.tolist(), j.tolist(), strict=True))
    assert len(right) < 600 * 16


def test_dedup_equals_sql(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    want = con.execute(queries.ORACLES["op13_embedding_neardup"]).fetchall()
    got = queries.QUERIES["op13_embedding_neardup"](spark, folder)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_sql_of_links(spark):
    rows = clusters(90)
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", [list(r) for r in rows])
    assert sorted(con.execute(queries.ORACLES["op13_embedding_neardup"]).fetchall(), key=repr) == brute(rows) == found(frame(spark, rows))


def test_labels_of_any_type(spark):
    df = spark.createDataFrame([(1, [1.0], dt.date(2020, 1, 1)), (2, [2.0], dt.date(2020, 1, 1)), (3, [2.0], dt.date(2021, 1, 1))], "vec_id long, embedding array<double>, label date")
    assert found(df) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
