"""Line dedup, the n-gram join, quality rules and the pipeline against brute force."""

import random

import pytest
import zstandard

import corpus_pipeline
from helpers import AWKWARD, WORD, classes, dedup_lines, documents, sha, statistics
from tickloom.llm import components, line_dedup, ngram_join, quality_rules, queries


def near_texts(seed=3, groups=12, copies=6):
    """Groups of texts that differ by more and more words, with equal ones and chains."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, i = [], 10
    for g in range(groups):
        words = rng.choices(vocabulary, k=rng.choice([3, 4, 6, 25, 60, 150]))
        for c in range(copies):
            if c:
                for _ in range(rng.randint(0, 1 + len(words) // 40)):
                    words = list(words)
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((i, (" " if g % 2 else "\n").join(w.upper() if rng.random() < 0.1 else w for w in words)))
            i += 1
    rng.shuffle(rows)
    return rows


def test_join_equals_all_pairs(spark):
    rows = near_texts()
    got = {r[0]: (r[1], r[2]) for r in ngram_join.ngram_join(documents(spark, rows)).collect()}
    assert got == classes(rows)


def test_join_on_documents(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = {r[0]: (r[1], r[2]) for r in queries.QUERIES["op5_ngram_join"](spark, folder).collect()}
    assert got == classes(rows)


def test_join_large_group_in_one_round_only(spark, monkeypatch):
    """A group beyond the window bound is salted; the classes stay exact."""
    monkeypatch.setattr(ngram_join, "GROUP", 4)
    monkeypatch.setattr(ngram_join, "NEIGHBOURS", 1)
    rows = near_texts(seed=5, groups=3, copies=25)
    got = {r[0]: (r[1], r[2]) for r in ngram_join.ngram_join(documents(spark, rows)).collect()}
    assert got == classes(rows)


def test_join_awkward_rows(spark):
    got = sorted((tuple(r) for r in ngram_join.ngram_join(documents(spark, AWKWARD, ["size", "component_id", "row"])).collect()), key=repr)
    want = classes([(i, t) for i, t in AWKWARD if i is not None])
    assert len(got) == len(AWKWARD)
    assert all((n, c) == want[i] for i, n, c in got if i is not None)
    assert ngram_join.ngram_join(documents(spark, [])).collect() == []


def test_keep_first(spark):
    rows = near_texts()
    kept = {r["doc_id"] for r in ngram_join.keep_first(documents(spark, rows, ["row"])).collect()}
    assert kept == {i for i, (_, c) in classes(rows).items() if i == c}


@pytest.mark.parametrize("shape", ["chain", "star", "pairs"])
def test_components(spark, shape):
    n = 60
    links = {"chain": [(k, k + 1) for k in range(n)], "star": [(n, k) for k in range(n)], "pairs": [(2 * k, 2 * k + 1) for k in range(n)]}[shape]
    random.Random(1).shuffle(links)
    got = {r[0]: r[1] for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {k: (0 if shape != "pairs" else k // 2 * 2) for e in links for k in e}


def test_components_of_nothing(spark):
    assert components.components(spark.createDataFrame([], "u long, v long")).collect() == []


def line_rows(seed=2):
    rng = random.Random(seed)
    base = [" ".join(rng.choices(["a", "b", "cc", "d", "Ee"], k=rng.choice([1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 20, 33]))) for _ in range(30)]
    rows = []
    for i in range(40):
        text = []
        for _ in range(rng.randint(0, 6)):
            w = rng.choice(base).split()
            kind = rng.randrange(5)
            k = rng.randrange(len(w))
            if kind == 1:
                w[k] = "zz"
            elif kind == 2:
                w.insert(k, "yy")
            elif kind == 3 and len(w) > 1:
                del w[k]
            elif kind == 4:
                w[0], w[-1] = w[-1], w[0]
            text.append("  ".join(w) if kind else " ".join(w))
        rows.append((i, "\n".join(text)))
    return rows


@pytest.mark.parametrize("seed", [2, 7])
def test_lines_equal_all_pairs(spark, seed):
    rows = line_rows(seed)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(documents(spark, rows)).collect()}
    assert got == dedup_lines(rows)


def test_lines_awkward_rows(spark):
    out = line_dedup.dedup_lines(documents(spark, AWKWARD, ["line", "th", "kept", "n_lines"]))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "line", "th", "kept", "n_lines", "n_removed"]
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert sorted(got, key=repr) == sorted([(i, "" if i == 5 else t) for i, t in AWKWARD], key=repr)  # "one" is there before
    assert line_dedup.dedup_lines(documents(spark, [])).collect() == []


def test_lines_repeated_rows_and_ids(spark):
    text = "this line has more than five words\nand here is another line of words"
    rows = [(1, text), (1, text), (2, text), (None, text)]
    got = sorted(((r["doc_id"], r["text"], r["n_removed"]) for r in line_dedup.dedup_lines(documents(spark, rows)).collect()), key=repr)
    assert got == sorted([(1, "", 2), (1, "", 2), (2, "", 2), (None, text, 0)], key=repr)


def test_short_lines_and_lines_without_spaces(spark):
    rows = [
        (1, "All rights reserved.\none two three four five six\n保留所有权利。请勿转载\none two three four"),
        (2, "all  rights reserved.\none two three FOUR five seven\n保留所有权利。请勿转载\none two three five"),
        (3, "rights reserved.\none two four five\n保留全部权利。请勿转载\nหนึ่งสองสาม\nzero one two three four"),
        (4, "第一章\n第二章\nหนึ่งสองสา\n𠀀𠀁𠀂𠀃𠀄 x\n𠀀𠀁𠀂𠀃𠀄\nx保留y\nx保 留y"),
    ]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(documents(spark, rows)).collect()}
    assert got == dedup_lines(rows)
    assert got[2] == "one two three five"
    assert got[4] == "第一章\n第二章\n𠀀𠀁𠀂𠀃𠀄 x\nx保留y"


def test_lines_on_documents(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    got = {r["doc_id"]: (r["n_lines"], r["text_sha256"]) for r in queries.QUERIES["op1_line_dedup"](spark, folder).collect()}
    want = dedup_lines(rows)
    assert got == {i: (t.count("\n") + 1, sha(want[i])) for i, t in rows}


def test_statistics(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    for r in queries.QUERIES["op3_quality_rules"](spark, folder).collect():
        want = statistics(dict(rows)[r["doc_id"]])
        assert {k: r[k] for k in want} == want
        assert r["base_failed"] == (want["n_words"] < 10 or 100 * want["n_repeat_words"] > 20 * want["n_words"])
        assert not (r["base_failed"] and r["kept"])


def verdict(text, bands):
    """The compression verdict by loops."""
    data, packer = text.encode(), zstandard.ZstdCompressor(level=bands.level)

    def bad(rules, piece):
        low, high = [(lo, hi) for least, lo, hi in rules if len(piece) >= least][-1]
        ratio = len(piece) / len(packer.compress(piece))
        return not low <= ratio <= high

    pieces = [data[k : k + bands.chunk_bytes] for k in range(0, len(data), bands.chunk_bytes)]
    judged = sum(len(p) for p in pieces if len(p) >= 1024)
    share = sum(len(p) for p in pieces if bad(bands.chunk, p)) / max(judged, 1)
    return not bad(bands.whole, data) and share <= bands.bad_share


def test_compression_bands(spark, folder):
    rows = {r[0]: r[1] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    bands = quality_rules.Bands()
    for r in queries.QUERIES["op3_quality_rules"](spark, folder).collect():
        assert r["kept"] == (not r["base_failed"] and verdict(rows[r["doc_id"]], bands))


def test_compression_rejects_repeats_and_noise(spark):
    rng = random.Random(4)
    prose = " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(900))
    repeats = " ".join(f"item {k} of the same list of things" for k in range(900))
    noise = " ".join("".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(5)) for _ in range(900))
    half = prose[:3000] + " ".join(["lorem"] * 5 + [f"row {k} row" for k in range(900)])
    got = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(documents(spark, enumerate([prose, repeats, noise, half]))).collect()}
    assert got == {0: True, 1: False, 2: False, 3: False}


def test_rules_awkward_rows(spark):
    rows = documents(spark, AWKWARD, ["kept", "n_words"])
    got = quality_rules.quality_rules(rows).collect()
    assert len(got) == len(AWKWARD)
    by = {r["doc_id"]: r for r in got}
    for i, t in AWKWARD:
        want = statistics(t)
        assert {k: by[i][k] for k in want} == want
    assert quality_rules.quality_rules(documents(spark, [])).collect() == []
    kept = quality_rules.keep_good(rows)
    assert kept.columns == rows.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted((r["doc_id"] for r in got if r["kept"]), key=repr)


def test_pipeline(spark, folder):
    """Each stage does to its input what brute force does."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, before = docs.columns, None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()]
        docs = corpus_pipeline.stored(stage(spark, docs, folder), name)
        after = {r["doc_id"]: r for r in docs.collect()}
        if k < 4:
            assert docs.columns == names
        if name == "quality_rules":
            bands = quality_rules.Bands()
            want = {i for i, t in before if not bad_base(t) and verdict(t, bands)}
            assert set(after) == want
        elif name == "line_dedup":
            want = {i: t for i, t in dedup_lines(before).items() if WORD.search(t or "")}
            assert {i: r["text"] for i, r in after.items()} == want
            assert all(r["n_chars"] == len(r["text"]) for r in after.values())
        elif name == "ngram_jaccard_join":
            assert set(after) == {i for i, (_, c) in classes(before).items() if i == c}
        elif name == "decontamination":
            items = [r[0].lower() for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("text").collect()]
            holds = {i for i, t in before if any(x in t.lower() for x in items)}
            assert holds.isdisjoint(after) and len(before) - len(after) >= len(holds)
        else:
            assert set(after) == {i for i, _ in before} and all(r["n_tokens"] == len(r["ids"]) for r in after.values())
    assert corpus_pipeline.run(spark, folder).count() == docs.count()


def bad_base(text):
    s = statistics(text)
    return s["n_words"] < 10 or 100 * s["n_repeat_words"] > 20 * s["n_words"]


def test_plan_of_dedup_has_no_nested_loops(spark):
    plan = line_dedup.dedup_lines(documents(spark, line_rows()))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_pipeline_joins_on_five_words(spark, folder):
    """The stage against all pairs: five-word shingles, 0.8; two changed words in a hundred are under 0.85 on four words."""
    words = [f"u{k}" for k in range(100)]
    rows = [*near_texts(), (1000, " ".join(words)), (1001, " ".join({30: "x", 60: "y"}.get(k, w) for k, w in enumerate(words)))]
    assert classes(rows)[1001][1] == 1001 and classes(rows, 5, 80)[1001][1] == 1000
    stage = dict(corpus_pipeline.STAGES)["ngram_jaccard_join"]
    kept = {r["doc_id"] for r in stage(spark, documents(spark, rows), folder).collect()}
    assert kept == {i for i, (_, c) in classes(rows, 5, 80).items() if i == c}
