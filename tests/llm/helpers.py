"""Brute-force versions of the text operators, and awkward rows."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def documents(spark, rows, extra=()):
    """(doc_id, text, lang, source, n_chars) from (doc_id, text), plus columns of other names."""
    full = [(i, t, "en", "s", len(t or ""), *([1] * len(extra))) for i, t in rows]
    names = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", {c} long" for c in extra)
    return spark.createDataFrame(full, names)


AWKWARD = [
    (None, "a text without an id but with some words in it"),
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, "one"),
    (5, "one"),
    (5, "one"),
    (6, "x" * 70_000),
    (7, "word " * 30_000),
    (8, "ünïcödé wörds — “quoted” ١٢٣ 日本語 🙂 are words too, are they not?"),
    (9, "a\x00b\x85c d \\ ' \" <|im_end|> | end"),
]


def sets(rows, n=4):
    out = {}
    for i, t in rows:
        w = WORD.findall(lower(t))
        out[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    return out


def classes(rows, n=4, percent=85):
    """(size, smallest linked id) of each id, over all pairs."""
    s = sets(rows, n)
    root = {i: i for i in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(s)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(s[a] & s[b])
            if s[a] and s[b] and 100 * both >= percent * (len(s[a]) + len(s[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s[i]), find(i)) for i in ids}


def statistics(text):
    """word_chars, n_words, n_symbols, n_dup_lines, n_repeat_words by loops."""
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    count, covered = {}, set()
    for k in range(len(words) - 4):
        count.setdefault(tuple(words[k : k + 5]), []).append(k)
    for at in count.values():
        if len(at) > 1:
            covered.update(p + j for p in at for j in range(5))
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": dup,
        "n_repeat_words": len(covered),
    }


def word_distance(a, b):
    """Edit distance in words."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


ALONE = "\u0e00-\u0eff\u1000-\u107f\u1780-\u17ff\u3000-\u9fff\U00020000-\U0003ffff"
UNIT = re.compile(rf"[{ALONE}]|[^\x20\x09-\x0D{ALONE}]+")


def dedup_lines(rows):
    """Texts without later copies, by comparing every line with every earlier one: equal, or one
    word (in scripts without spaces: character) apart and as similar as four words of five."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    earlier, out = [], {}
    for k in order:
        i, text = rows[k]
        if text is None:
            out[i] = None
            continue
        kept = []
        for line in text.split("\n"):
            w = UNIT.findall(lower(line))
            if not w:
                kept.append(line)
                continue
            near = any(w == e or (max(len(w), len(e)) >= 5 and abs(len(w) - len(e)) <= 1 and word_distance(w, e) <= 1) for e in earlier)
            earlier.append(w)
            if not near:
                kept.append(line)
        out[i] = "\n".join(kept)
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
