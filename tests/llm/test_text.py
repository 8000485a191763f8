"""BPE, chat formatting, license scans and decontamination."""

import hashlib
import random
import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import AWKWARD, documents, sha
from tickloom.llm import bpe, chat, decontaminate, licenses, queries
from tickloom.llm.tokens import Block, grams

tokenizers = pytest.importorskip("tokenizers")
PATH = queries.tokenizer()


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, encoding="utf-8") as f:
        return bpe.Encoder(f.read())


def same(library, encoder, texts):
    for text, want, got in zip(texts, library.encode_batch(texts, add_special_tokens=False), encoder.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == want.ids, text
        assert encoder.decode(got).decode() == library.decode(want.ids, skip_special_tokens=False), text


def test_bpe_every_token(library, encoder):
    same(library, encoder, [t.replace("</w>", "") for t in library.get_vocab()])


def test_bpe_random_texts(library, encoder):
    rng = random.Random(1)
    pieces = [t.replace("</w>", "") for t in library.get_vocab()]
    odd = "abc'  \n\t0129.,!?-_$%éßñÅΣσςİı一三日語한국ᄀ각🙂🏽́​ 　½٣ﬁ𝐀\x00\x1c\x1f\x85"
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 6))) for _ in range(3000)]
    texts += ["".join(rng.choice("ab") for _ in range(rng.randint(1, 40))) for _ in range(500)]
    texts += ["".join(rng.choice(odd) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["<|endoftext|>a <|startoftext|><|endoftext|>", "<|endoftext|", "IT'S we'LL 's", "ΑΣ ΟΔΟΣ", "Å é 한"]
    same(library, encoder, texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=5))
def test_bpe_any_text(library, encoder, texts):
    same(library, encoder, texts)


def test_bpe_small_cache(library, encoder, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    for _ in range(2):
        same(library, encoder, ["some words here", "other words there and more of them", "<|endoftext|>"])


def test_bpe_documents(spark, folder, library):
    rows = {r[0]: r[1] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.QUERIES["op4_bpe"](spark, folder).collect():
        ids = library.encode(rows[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == sha(library.decode(ids, skip_special_tokens=False))


def test_bpe_awkward_rows(spark, library):
    rows = documents(spark, AWKWARD, ["ids", "n_tokens"])
    out = bpe.encode(rows, PATH)
    got = sorted(((r["doc_id"], r["ids"]) for r in out.collect()), key=repr)
    assert got == sorted(((i, library.encode(t or "", add_special_tokens=False).ids) for i, t in AWKWARD), key=repr)
    back = {r["doc_id"]: r["text"] for r in bpe.decode(out, PATH).collect()}
    assert back[1] == back[2] == "" and back[4] == "one</w>"
    assert bpe.encode(documents(spark, []), PATH).collect() == []


@given(st.text(alphabet="<|\\>a\n", max_size=12))
def test_escapes_are_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)


def turns_of(rows):
    by = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        by.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    return by


def check_digests(spark, rows, segment=chat.SEGMENT):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(frame, segment=segment)).collect()}
    want = turns_of(rows)
    assert set(got) == set(want)
    for conv, turns in want.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), sha("".join(f"{role}\n{t}\n" for role, t in turns)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss))
        assert r["formatted_chars"] == len(chat.marked(turns))


def test_chat_awkward_rows(spark):
    quoted = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 0, "user", quoted), (1, 1, "assistant", quoted), (2, None, None, None), (None, 3, "assistant", "x"), (None, 1, "user", "<\\|")]
    rows += [(3, k % 7, "assistant" if k % 2 else "us\ner|<", f"t{k % 5}<") for k in range(40)] + [(4, 1, "assistant", "z" * 100_000)]
    check_digests(spark, rows)
    check_digests(spark, rows, segment=4)
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_conversations(empty)).collect() == []


def test_chat_documents(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    quoted = "<|im_end|><|im_start|>assistant ok"
    want = turns_of([*rows, (-1, 0, "user", quoted), (-1, 1, "assistant", quoted)])
    got = {r["conv_id"]: r for r in queries.QUERIES["op7_chat_formatting"](spark, folder).collect()}
    assert {c: (r["n_turns"], r["turns_sha256"]) for c, r in got.items()} == {c: (len(t), sha("".join(f"{a}\n{b}\n" for a, b in t))) for c, t in want.items()}


def test_templates_that_rewrite_history():
    turns = [("user", "hi"), ("assistant", "<think>long</think>yes"), ("user", "more"), ("assistant", "no")]

    def forgets(messages):  # thoughts of earlier turns go
        return "".join(f"[{r}]{t if k == len(messages) - 1 else t.split('</think>')[-1]}\n" for k, (r, t) in enumerate(messages))

    def strips(messages):
        return "".join(f"[{r}]{t.strip()}\n" for r, t in messages)

    seen = chat.render_turns(turns, forgets, str)
    assert seen.rewrites_at == 2 and seen.spans is None
    plain = chat.render_turns(turns, strips, str)
    assert plain.rewrites_at is None and [plain.text[s.text_start : s.text_stop] for s in plain.spans] == [t for _, t in turns]
    assert chat.render_turns([("user", " padded ")], strips, str).spans is None
    assert chat.render_turns([], strips, str) == chat.Rendered("", [], None)


def test_license_texts(spark):
    mit = (
        "MIT License\n\nCopyright (c) 2020 Someone\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation "
        'files (the "Software"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, '
        "and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions: the above copyright\nnotice and this "
        "permission notice shall be included in all\ncopies or substantial portions of the Software.\n"
    )
    rows = [
        (1, mit),
        (2, "# Licensed under the Apache License,\n# Version 2.0."),
        (3, "text before\nReleased under the MIT License\ntext after"),
        (4, "// SPDX-License-Identifier: MIT\nint x;\n/* Licensed under CC BY-NC 4.0. */"),
        (5, "My own licence. All rights reserved."),
        (6, "nothing here"),
        (7, "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ]
    got = {r["doc_id"]: r for r in licenses.license_scan(documents(spark, rows)).collect()}
    assert {i: r["licenses"] for i, r in got.items()} == {1: "MIT", 2: "Apache-2.0", 3: "MIT", 4: "MIT,CC-BY-NC-4.0", 5: "LicenseRef-All-Rights-Reserved", 6: "", 7: ""}
    assert got[7]["sentence_ids"] == "bsd-source" and got[5]["n_unmatched"] == 1 and got[6]["n_unmatched"] == 0


def test_rules_keep_their_order(spark):
    bsd = [licenses.SENTENCES[k] + "." for k in ("bsd-conditions", "bsd-source", "bsd-binary", "bsd-endorse")]
    got = {r["doc_id"]: r["licenses"] for r in licenses.license_scan(documents(spark, [(3, " ".join(bsd)), (2, " ".join(bsd[:3])), (1, " ".join(reversed(bsd)))])).collect()}
    assert got == {3: "BSD-3-Clause", 2: "BSD-2-Clause", 1: ""}


def test_known_sentences_are_normal():
    import re

    for s in licenses.known_sentences():
        assert s == " ".join(re.sub(r"[^a-z0-9.+]+", " ", s).split()) and re.search(licenses.WORDS, s)
    assert {i for seq, _ in licenses.RULES for i in seq} <= set(licenses.SENTENCES)


def test_license_sql(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()] + AWKWARD
    frame = documents(spark, rows, ["ids", "found"])
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string())}))
    want = con.execute(licenses.license_sql()).fetchall()
    out = licenses.license_scan(frame)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Exchange", "Join"))
    assert licenses.license_scan(documents(spark, [])).collect() == []


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def test_common_subsequence():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = rng.integers(0, 6, rng.integers(0, 80)), rng.integers(0, 6, rng.integers(0, 150))
        assert decontaminate.common(a, b) == subsequence(a.tolist(), b.tolist())


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string").withColumn("cosine", F.lit(1))


def test_decontamination_finds_copies_and_paraphrases(spark):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(3000)]
    common = "the of and to in is it that was for".split()

    def prose(n):
        return [rng.choice(common) if rng.random() < 0.4 else rng.choice(vocabulary) for _ in range(n)]

    items = [(k, " ".join(prose(rng.randint(15, 60))).capitalize() + ". " + " ".join(prose(5)) + ".") for k in range(25)]
    items += [(99, " ".join(prose(300))), (98, None), (97, "  ")]
    rows, want = [(k, " ".join(prose(rng.choice([5, 60, 400])))) for k in range(1000, 1060)], set()
    for k, text in items[:25]:
        rows.append((k, " ".join(prose(200)) + "\n" + text.upper() + "\n" + " ".join(prose(90))))
        words = text.split()
        for j in rng.sample(range(len(words) - 5), len(words) // 4):
            words[j] = rng.choice(vocabulary)
        rows.append((100 + k, " ".join(prose(70)) + " " + " ".join(words)))
        want |= {(k, k), (100 + k, k)}
    rows.append((300, items[25][1][200:1200]))  # a part of the long item
    want.add((300, 99))
    docs = documents(spark, rows, ["row", "item_id"])
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, benchmark(spark, items)).collect()}
    assert got <= want and len(want - got) <= 2  # clean texts stay
    left = decontaminate.drop_contaminated(docs, benchmark(spark, items))
    assert left.columns == docs.columns
    assert {r["doc_id"] for r in left.collect()} == {i for i, _ in rows} - {i for i, _ in got}


def test_decontamination_recall_on_documents(spark, folder):
    """Against brute force: every document that holds most five-word runs of an item."""

    def five(texts):
        block = Block(pa.array([(t or "").lower().replace(".", " ").replace(",", " ") for t in texts]))
        starts, stops, first = block.words()
        h, at = grams(block.hashes(starts, stops), first, 5)
        bounds = np.searchsorted(at, first)
        return [set(h[bounds[k] : bounds[k + 1]].tolist()) for k in range(block.n)]

    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{folder}/benchmark.parquet").collect()
    held, own = five([d["text"] for d in docs]), five([b["text"] for b in items])
    want = {(d["doc_id"], b["item_id"]) for d, x in zip(docs, held, strict=True) for b, y in zip(items, own, strict=True) if y and len(x & y) >= 0.7 * len(y)}
    got = {(r["doc_id"], r["item_id"]) for r in queries.QUERIES["op6_decontamination"](spark, folder).collect()}
    assert want and len(want & got) >= 0.9 * len(want) and len(got - want) <= 1


def test_decontamination_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_SEGMENTS", 2)
    items = [(k, " ".join(f"w{k}x{j}" for j in range(30))) for k in range(5)]
    rows = [(k, f"before all that {t} and after") for k, t in items]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(documents(spark, rows), benchmark(spark, items)).collect()}
    assert got == {(k, k) for k in range(5)}


def test_decontamination_awkward_rows(spark):
    rows = documents(spark, AWKWARD, ["row"])
    items = benchmark(spark, [(1, "one"), (1, "one"), (None, "word word"), (2, "")])
    got = sorted(r["doc_id"] for r in decontaminate.matches(rows, items).collect())
    assert got == [4, 5, 5]
    none = benchmark(spark, [])
    assert decontaminate.matches(rows, none).collect() == [] and decontaminate.drop_contaminated(rows, none).count() == len(AWKWARD)
    assert decontaminate.matches(documents(spark, []), items).collect() == []


@pytest.mark.parametrize("n_items", [100, 430])
def test_decontamination_recall_of_paraphrases(spark, n_items):
    """Benchmarks that fill one block and several, against the rule applied to every pair."""
    rng = random.Random(n_items)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(6000)]
    common = "the of and to in is it that was for".split()

    def prose(n):
        return [rng.choice(common) if rng.random() < 0.2 else rng.choice(vocabulary) for _ in range(n)]

    items = [(k, " ".join(prose(rng.randint(15, 60))) + ". " + " ".join(prose(5)) + ".") for k in range(n_items)]
    rows = [(k, " ".join(prose(400))) for k in range(1000, 2500)]
    for k, text in items:
        words = text.split()
        for j in rng.sample(range(len(words) - 5), len(words) * 2 // 5):
            words[j] = rng.choice(vocabulary)
        rows.append((k, " ".join([*prose(rng.randint(40, 120)), *words, *prose(90)])))
    found = decontaminate.segments(items)
    assert len(decontaminate.parts_of(found)) == -(-len(found.words) // decontaminate.RANK)
    want = set()
    for i, text in rows[1500:]:
        h = decontaminate.Passages(pa.array([text])).hash
        here = set(h.tolist())
        for item, words, told in zip(found.item, found.words, found.answer, strict=True):
            if sum(x in here for x in words.tolist()) < decontaminate.PARAPHRASED * len(words):
                continue
            near = [h[max(lo - len(words), 0) : lo + 48 + len(words)] for lo in range(0, len(h), decontaminate.STEP)]
            share = [(decontaminate.common(words, x) / len(words), decontaminate.common(told, x) / max(len(told), 1)) for x in near]
            if any(s >= decontaminate.COPIED or (s >= decontaminate.PARAPHRASED and a >= decontaminate.ANSWERED) for s, a in share):
                want.add((i, item))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(documents(spark, rows), benchmark(spark, items)).collect()}
    got = {(i, item) for i, item in got if i < 1000}
    assert len(want) >= 0.9 * n_items and got <= want and len(got) >= 0.9 * len(want)


def test_decontamination_space_is_fitted_on_all_passages(spark):
    """Against a plain SVD of every passage of more texts than a sample would hold."""
    rng = random.Random(12)
    vocabulary = [f"v{k}" for k in range(150)]
    texts = [" ".join(rng.choices(vocabulary[k // 500 * 20 :], k=rng.choice([0, 3, 24, 50, 90]))) for k in range(3000)] + [None, " ", "v1 " * 200]
    docs = documents(spark, list(enumerate(texts)))
    steps = decontaminate.all_steps(docs)
    hashed = [decontaminate.Passages(pa.array([t])).term.tolist() for t in texts]
    counts = decontaminate.term_counts(steps)
    assert counts.tolist() == np.bincount([x for h in hashed for x in h], minlength=decontaminate.TERMS).tolist()
    idf = decontaminate.inverse_frequency(counts)
    rows = []
    for h in hashed:
        for k in range(0, len(h), decontaminate.STEP):
            row = np.zeros(decontaminate.TERMS, np.float32)
            for part in (h[k : k + decontaminate.STEP], h[k + decontaminate.STEP : k + 2 * decontaminate.STEP]):
                row[sorted(set(part))] += idf[sorted(set(part))]
            rows.append(row[counts > 0] / np.linalg.norm(row))
    want = np.linalg.svd(np.array(rows, float), full_matrices=False)[1]
    vectors, n = decontaminate.randomised_svd(steps, idf, rank=120, extra=16)
    assert n == len(rows) and not vectors[counts == 0].any()
    assert np.allclose(np.linalg.norm(vectors, axis=0), want[:120], rtol=0.02)
    unit = vectors[counts > 0] / np.linalg.norm(vectors, axis=0)
    assert np.allclose(unit.T @ unit, np.eye(120), atol=1e-3)
    assert np.linalg.norm(np.array(rows) @ unit) ** 2 >= 0.99 * (want[:120] ** 2).sum()


def test_decontamination_products_leave_the_disk(spark):
    """The shuffles of a round go with it; the caller's session keeps its settings."""
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup)
    steps = decontaminate.all_steps(documents(spark, [(k, " ".join(f"w{(k * j) % 97}" for j in range(120))) for k in range(40)]))
    idf = decontaminate.inverse_frequency(decontaminate.term_counts(steps))

    def shuffles():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for name in files.mkString("\n").split("\n") if "shuffle_" in name}

    there = shuffles()
    decontaminate.randomised_svd(steps, idf)
    end = time.time() + 20
    while shuffles() - there and time.time() < end:
        time.sleep(0.2)
    assert not shuffles() - there
    assert spark.conf.get(cleanup) == before
    assert steps.sparkSession.conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions")


def test_decontamination_words_near_a_passage():
    rng = np.random.default_rng(4)
    words = decontaminate.Passages(pa.array([" ".join(f"w{k}" for k in rng.integers(0, 60, n)) for n in (0, 30, 400)]))
    items = [(k, " ".join(f"w{x}" for x in rng.integers(0, 90, 40))) for k in range(5)]
    found, terms = decontaminate.segments(items), [decontaminate.Passages(pa.array([t])).term.tolist() for _, t in items]
    lo = np.sort(rng.integers(0, 400, 1500))
    hi = lo + rng.integers(1, 30, 1500)
    query = rng.integers(0, len(items), 1500)
    want = [sum(x in set(words.term[a:b].tolist()) for x in terms[q]) for a, b, q in zip(lo, hi, query, strict=True)]
    assert decontaminate.Overlap(found).count(words, lo, hi, query).tolist() == want


def test_decontamination_words_near_a_passage_at_most():
    """The bound for whole steps never lies below the count, whatever texts stand beside each other."""
    rng = np.random.default_rng(6)
    words = decontaminate.Passages(pa.array([" ".join(f"w{k}" for k in rng.integers(0, 200, n)) for n in (0, 5, 700, 1, 90, 0)]))
    steps, of, start = decontaminate.steps_of(words)
    found = decontaminate.segments([(k, " ".join(f"w{x}" for x in rng.integers(0, 260, n))) for k, n in enumerate((3, 20, 64, 150))])
    overlap = decontaminate.Overlap(found)
    passage, query = (x.ravel() for x in np.meshgrid(np.arange(steps.n), np.arange(len(found.words)), indexing="ij"))
    lo = np.maximum(words.first[of[passage]], start[passage] - decontaminate.SEGMENT)
    hi = np.minimum(words.first[of[passage] + 1], start[passage] + 2 * decontaminate.STEP + decontaminate.SEGMENT)
    most, exact = overlap.at_most(steps, passage, query), overlap.count(words, lo, hi, query)
    assert (most >= exact).all() and (most <= np.array([len(w) for w in found.words])[query]).all() and (most < most.max()).any()


def test_decontamination_products_of_steps():
    """Sums in place, of terms in one step and in most steps, of a step without room and of one block."""
    rng = np.random.default_rng(7)
    words = decontaminate.Passages(pa.array([" ".join(f"w{int(k)}" for k in rng.zipf(1.3, n) % 5000) for n in (0, 1, 3000, 25, 4000)]))
    steps, _, _ = decontaminate.steps_of(words)
    rows, total = rng.standard_normal((steps.n, 9), np.float32), rng.standard_normal((decontaminate.TERMS, 9), np.float32)
    want = total.astype(float)
    np.add.at(want, steps.term, rows[steps.step])
    decontaminate._add_rows(total, steps.term, steps.step, rows)
    assert np.abs(total - want).max() < 1e-3 and np.bincount(steps.term).max() > decontaminate.PIECE
    passages = np.zeros((steps.n, 9))
    np.add.at(passages, steps.step, want[steps.term])
    passages[:-1] += np.where(steps.alone[:-1, None], 0, passages[1:])
    room = np.zeros((steps.n + 2, 9), np.float32)
    assert np.abs(steps.times(want.astype(np.float32), room[1:-1]) - passages).max() < 1e-2 and not room[[0, -1]].any()


def test_decontamination_item_in_several_blocks(spark, monkeypatch):
    """One row per text and item; rows that repeat a text each give theirs."""
    monkeypatch.setattr(decontaminate, "BLOCK_SEGMENTS", 2)
    text = " ".join(f"v{j}" for j in range(300))
    rows = [(1, text), (1, text), (2, "nothing of it")]
    got = [(r["doc_id"], r["item_id"]) for r in decontaminate.matches(documents(spark, rows), benchmark(spark, [(7, text), (8, "other words here")])).collect()]
    assert got == [(1, 7), (1, 7)]


MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""


def test_license_texts_as_written(spark):
    """Whole licence texts with their blank lines, plain, as comments, and a word on each line."""
    wanted = {
        "MIT": (MIT, "mit-permission,mit-conditions,mit-as-is,mit-liability"),
        "Apache-2.0": (APACHE, "apache-may-not,apache-at,apache-url,apache-unless,apache-see"),
        "MPL-2.0": (MPL, "mpl-terms,mpl-obtain"),
    }
    rows, want = [], {}
    for name, (text, ids) in wanted.items():
        marked = ["\n".join(f"{mark} {line}".rstrip() for line in text.split("\n")) for mark in ("#", "//", " *")]
        narrow = "\n\n".join("\n".join(part.split()) for part in text.split("\n\n"))
        for each in (text, *marked, narrow):
            want[len(rows)] = (ids, name)
            rows.append((len(rows), each))
    got = {r["doc_id"]: (r["sentence_ids"], r["licenses"]) for r in licenses.license_scan(documents(spark, rows)).collect()}
    assert got == want
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string())}))
    assert {i: (ids, names) for i, ids, names, _ in con.execute(licenses.license_sql()).fetchall()} == want
