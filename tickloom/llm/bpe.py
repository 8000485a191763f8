"""BPE encoding and decoding by prefix-sharing trie traversal.

The state of a prefix is the last token of its encoding: taking that token off leaves the
state of a shorter prefix, so the states along a branch of a trie hold the encodings of all
prefixes on it. A token can follow a prefix exactly if it ends there and no merge would ever
cross the border to the state before it. One step per trie node encodes all words below it.

The distinct words of a block are inserted into a trie and walked depth first. Sorted words
*are* that trie in depth-first order: the characters a word shares with the word before it
are the branch that is still on the stack, with its states.

Character kinds and cases beyond Latin letters come from the ``tokenizers`` library, so that its
Unicode version decides; the encoding itself is the traversal's.

Reads vocabulary files of the ``tokenizers`` library with a BPE model and an end-of-word
suffix (NFC, white space to one space, lower case; byte-level words). Nothing is trained.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from .tokens import column, map_texts, table

LARGEST_FILE = 64 << 20  # bytes of a vocabulary file that may be sent to every executor
CACHE_WORDS = 200_000  # encoded words kept by a task; the cache starts anew when it is full
NEVER = 1 << 60


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Tokens, merges and the tables that the traversal needs."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model = data["model"]
        self.end = model["end_of_word_suffix"] or ""
        ids = model["vocab"]
        self.added = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.tokens = {i: t for t, i in [*ids.items(), *self.added.items()]}
        self.rank, self.parts = {}, {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[ids[a], ids[b]] = r
            self.parts.setdefault(ids[a + b], (ids[a], ids[b], r))
        self.merged = {pair: ids[self.tokens[pair[0]] + self.tokens[pair[1]]] for pair in self.rank}
        self._rights, self._lefts, self._fits = {}, {}, {}
        letters = set(byte_letters())
        inner, last = {}, {}
        for text, i in ids.items():
            body, table_ = (text[: -len(self.end)], last) if self.end and text.endswith(self.end) else (text, inner)
            if body and set(body) <= letters and self._alone(body, table_ is last, ids) == [i]:
                table_[body] = i
        if not self.end:
            last = inner
        # every ending of a token, with the token it is or -1: a search by growing length stops early
        self.inner, self.last = self._endings(inner), self._endings(last)

    @staticmethod
    def _endings(tokens: dict[str, int]) -> dict[str, int]:
        found = {}
        for text in tokens:
            for i in range(len(text)):
                found.setdefault(text[i:], -1)
        return found | tokens

    def _alone(self, body: str, closed: bool, ids: dict[str, int]) -> list[int]:
        """Plain merging of one token's text: a token that is not its own encoding never occurs."""
        parts = [ids[c] for c in body[:-1]] + [ids[body[-1] + (self.end if closed else "")]]
        while len(parts) > 1:
            r, k = min((self.rank.get(p, NEVER), k) for k, p in enumerate(zip(parts, parts[1:], strict=False)))
            if r == NEVER:
                break
            parts[k : k + 2] = [self.merged[parts[k], parts[k + 1]]]
        return parts

    def _edge(self, token: int, side: int, known: dict) -> list[tuple[int, int]]:
        """Pieces that stand at one edge of a token while it is merged, with the rank that ends each."""
        if token not in known:
            pieces, until = [], NEVER
            while True:
                pieces.append((token if not pieces else piece, until))
                made = self.parts.get(pieces[-1][0])
                if made is None:
                    break
                piece, until = made[side], made[2]
            known[token] = pieces
        return known[token]

    def fits(self, a: int, b: int) -> bool:
        """Whether token b can stand after token a: no merge joins their edges before both are whole."""
        pair = (a, b)
        known = self._fits.get(pair)
        if known is None:
            rank = self.rank
            known = self._fits[pair] = not any(
                # equal ranks merge from the left: inside a before the border, the border before b
                (r := rank.get((x, y))) is not None and r < x_until and r <= y_until
                for x, x_until in self._edge(a, 1, self._rights)
                for y, y_until in self._edge(b, 0, self._lefts)
            )
        return known

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Token ids of sorted distinct words, written in byte letters."""
        inner, last, fits, never = self.inner, self.last, self.fits, self._fits
        branch: list[tuple[int, int]] = [(0, 0)]  # by depth: last token of the prefix, depth before it
        out, before = [], ""
        for word in words:
            n = len(word)
            shared = min(len(before), n)
            while word[:shared] != before[:shared]:
                shared -= 1
            del branch[min(shared, n - 1, len(branch) - 1) + 1 :]
            for depth in range(len(branch), n + 1):
                endings = last if depth == n else inner
                start = depth - 1
                while True:
                    token = endings.get(word[start:depth])
                    if token is None or start < 0:
                        raise ValueError(f"no encoding of {word!r}")
                    if token >= 0:
                        if not start:
                            break
                        left = branch[start][0]
                        ok = never.get((left, token))
                        if ok or (ok is None and fits(left, token)):
                            break
                    start -= 1
                    if start < 0:
                        raise ValueError(f"no encoding of {word!r}")
                if depth < n:
                    branch.append((token, start))
            ids = [token]
            while start:
                token, start = branch[start]
                ids.append(token)
            ids.reverse()
            out.append(ids)
            before = word
        return out


#: fixed values: how the vocabulary's pre-tokenizer cuts lower-case text
CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LATIN = regex.compile(CUT.replace(r"\s", r"\p{White_Space}"))
NARROW = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)
BEYOND_LATIN = re.compile("[^\x00-\u024f]")


class _Lowered(dict):
    """Lower case of single characters as the library has it; its Unicode version decides."""

    def __missing__(self, code: int) -> str:
        self[code] = normalizers.Lowercase().normalize_str(chr(code))
        return self[code]


class _Kinds(dict):
    """An ASCII character of the same kind (letter, number, space, other) for any character."""

    cut = pre_tokenizers.Split(Regex(CUT), "removed", invert=True)

    def __missing__(self, code: int) -> str:
        if code < 128:
            self[code] = chr(code)
        else:
            pieces = [p for p, _ in self.cut.pre_tokenize_str(f"a{chr(code)}!")]
            self[code] = " " if len(pieces) == 2 and pieces[0] == "a" and pieces[1] == "!" else "a" if len(pieces[0]) == 2 else "1" if len(pieces) == 3 else "!"
        return self[code]


LOWERED, KINDS = _Lowered(), _Kinds()


class Encoder:
    """Encodes and decodes many texts; keeps the words it has seen, up to a bound."""

    def __init__(self, spec: str):
        self.vocabulary = Vocabulary(spec)
        tokens = self.vocabulary.tokens
        self.names = [tokens.get(i, "").encode() for i in range(max(tokens) + 1)]
        added = self.vocabulary.added
        self.added = {t: np.array([i], "<u4").tobytes() for t, i in added.items()}
        self.split = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.letters = byte_letters()
        self.translate = str.maketrans({b: c for b, c in enumerate(self.letters)})
        self.known: dict[str, bytes] = {}

    @staticmethod
    def words(text: str) -> list[str]:
        if text.isascii():
            return NARROW.findall(text.lower())
        if not BEYOND_LATIN.search(text):
            return LATIN.findall(text.lower())
        text = normalizers.NFC().normalize_str(text).translate(LOWERED)
        return [text[m.start() : m.end()] for m in NARROW.finditer(text.translate(KINDS))]

    def pieces(self, text: str) -> list[str]:
        """Words and added tokens of a text in order; an added token is kept as it is."""
        if self.split is None or not any(t in text for t in self.added):
            return self.words(text)
        out = []
        for k, part in enumerate(self.split.split(text)):
            out += [("", part)] if k % 2 else self.words(part)
        return out

    def _lettered(self, word: str) -> str:
        """The word's UTF-8 bytes in byte letters (for ASCII letters and digits: the word)."""
        return word.encode("utf-8").decode("latin-1").translate(self.translate)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text, as little-endian unsigned 32-bit integers."""
        cut = [self.pieces(t) for t in texts]
        known = self.known
        new = set()
        for words in cut:
            new.update(words)
        if len(known) + len(new) > CACHE_WORDS:
            known.clear()
        for word in [w for w in new if w.__class__ is tuple]:
            known[word] = self.added[word[1]]
        fresh = sorted([(w if w.isascii() and w.isalnum() else self._lettered(w), w) for w in new if w not in known])
        for (_, word), ids in zip(fresh, self.vocabulary.encode_words([w for w, _ in fresh]), strict=True):
            known[word] = pack(f"<{len(ids)}I", *ids)
        return [b"".join([known[w] for w in words]) for words in cut]

    def decode(self, ids: bytes) -> bytes:
        """The tokens of the ids with spaces between, in UTF-8: this vocabulary has no decoder of its own."""
        names = self.names
        return b" ".join([names[i] for i in np.frombuffer(ids, "<u4").tolist()])


def _shared(spark: SparkSession, path: str):
    size = os.path.getsize(path)
    if size > LARGEST_FILE:
        raise ValueError(f"{path} has {size} bytes; {LARGEST_FILE} may be sent to the executors")
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _texts(batch: pa.RecordBatch) -> list[str]:
    return column(batch, "text").fill_null("").to_pylist()


def encode(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """Token ids of every text, and digests of the ids and of the text they decode to.

    Returns (doc_id, n_tokens, ids_sha256, decoded_sha256) and, on request, ``ids`` as an
    array. ``docs`` needs doc_id and text; other columns are ignored. A null text counts as
    empty and has no tokens. Repeated rows each give a row, an empty table gives none. Added
    tokens written in a text become their ids, as in the library. ``path`` is a vocabulary
    file on the driver; it is sent to the executors (its size is checked).
    """
    shared = _shared(docs.sparkSession, path)

    def make():
        encoder = Encoder(shared.value)  # of one task: a worker that lives on does not keep it

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = encoder.encode(_texts(batch))
            counts = np.array([len(x) // 4 for x in ids], np.int64)
            columns = {
                "doc_id": column(batch, "doc_id"), "n_tokens": counts,
                "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(encoder.decode(x)).hexdigest() for x in ids], pa.string()),
            }
            if with_ids:
                flat = np.frombuffer(b"".join(ids), "<i4")
                columns["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(flat))
            return table(**columns)

        return each

    return map_texts(_rows(docs), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def decode(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of the rows of ``encode``: the decoded tokens; null ids give an empty text."""
    shared = _shared(rows.sparkSession, path)

    def run(batches):
        encoder = Encoder(shared.value)
        for batch in batches:
            texts = [encoder.decode(np.array(x or [], "<u4").tobytes()).decode() for x in column(batch, "ids").to_pylist()]
            yield table(doc_id=column(batch, "doc_id"), text=pa.array(texts, pa.string()))

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
