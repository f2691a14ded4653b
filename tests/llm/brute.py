"""Plain versions of the operators, and awkward documents to hold them against."""

from __future__ import annotations

import random
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id int, key string, digest string"


def words(text, lower=False):
    return WORD.findall((text or "").translate(LOWER) if lower else text or "")


def awkward_documents(seed=7, size=60):
    """Copies, near copies, shared passages, nulls, blanks, one very long text; columns that clash with inner names."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeioubcdé") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, texts = prose(30), []
    for _ in range(size):
        base = prose(rng.randint(1, 90))
        texts.append(base)
        if rng.random() < 0.3:
            texts.append(base)
        if rng.random() < 0.3:
            w = base.split(" ")
            w[rng.randrange(len(w))] = "Changed"
            texts.append(" ".join(w).upper() if rng.random() < 0.3 else "\n".join(w))
        if rng.random() < 0.2:
            texts.append(prose(5) + "\t" + passage + "\n" + prose(5))
    texts += [None, "", " \n\t", "one", "ONE", prose(20_000), passage, "x" * 5000]
    rng.shuffle(texts)
    rows = [(i * 3 + 1, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", "é", None]), len(t or ""), 1, "k", "d") for i, t in enumerate(texts)]
    return rows + [rows[5], rows[9], (None, "nobody's words", None, None, 1, 1, "k", "d")]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5, "n_chars")


def shingles(text, n=5):
    w = words(text, lower=True)
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def components(rows, percent=85):
    sets = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def without_repeats(rows, n=13):
    first, out = {}, {}
    for i, text in sorted((r[0], r[1]) for r in rows if r[0] is not None):
        w = words(text)
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if first.setdefault(tuple(w[k : k + n]), i) < i:
                gone[k : k + n] = [True] * n
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


def base_quality(text):
    w = words(text)
    grams, covered = Counter(zip(w, w[1:], w[2:], strict=False)), set()
    for k in range(len(w) - 2):
        if grams[tuple(w[k : k + 3])] > 1:
            covered |= {k, k + 1, k + 2}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)
