"""Small tables with every awkward row, and plain versions of the operators."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, s int, data string, n_tokens long, score double, keys string, node long, rank int"


def texts() -> list[tuple]:
    rnd = random.Random(5)
    words = ["the", "of", "Der", "und", "état", "größe", "a", "is", "x9", "naïve,", "end.", "日本語", "#tag", "€5", "zz"]
    words += ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9))) for _ in range(300)]

    def prose(n: int) -> str:
        return " ".join(rnd.choice(words) for _ in range(n))

    base, passage = prose(200), prose(70)
    near = base.split(" ")
    near[50] = "changed"
    rows = [
        (7, base), (3, base), (12, " ".join(near)), (5, prose(120) + "\n" + passage + "\n" + prose(30)),
        (2, prose(40) + " " + passage), (9, passage), (1, None), (4, ""), (6, "   \n\t "), (8, "one"), (10, "One"),
        (11, "a b c d"), (13, "A b  c\td"), (14, prose(6000)), (15, "  lead and  double   spaces "), (16, "tail "),
        (17, "<|endoftext|> and <s> and ▁ mark"), (18, "x" * 5000), (19, "ab" * 40), (20, "ab" * 60),
        (21, "\n".join(["same line here"] * 6)), (22, "spam " * 80), (None, base), (None, prose(20)), (3, base), (3, prose(90)),
        (23, base.upper()), (24, "é" * 60), (25, "z" + "é" * 60), (26, prose(4)), (27, "\x1c   odd blanks \u0085"),
    ]
    return [(i, t) for i, t in rows]


def frame(spark, rows=None):
    """The table with columns that clash with names inside the operators."""
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, "en", "src", -1, 1, "d", 2, 0.5, "k", 3, 4) for i, t in rows], SCHEMA).repartition(3)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def smaller(a, b) -> bool:
    """Whether id a counts as smaller than id b; a null is the largest."""
    return a is not None and (b is None or a < b)


def removed(sequences: list[tuple], length: int) -> list[tuple]:
    """Per row: id, sequence, flags of what lies in a window that a smaller id also has."""
    ids = defaultdict(list)
    for i, seq in sequences:
        for k in {tuple(seq[j:j + length]) for j in range(len(seq) - length + 1)}:
            ids[k].append(i)
    out = []
    for i, seq in sequences:
        gone = [False] * len(seq)
        for j in range(len(seq) - length + 1):
            if any(smaller(o, i) for o in ids[tuple(seq[j:j + length])]):
                gone[j:j + length] = [True] * length
        out.append((i, seq, gone))
    return out


def dedup_bytes(rows, length=50) -> Counter:
    out = Counter()
    for i, seq, gone in removed([(i, (t or "").encode()) for i, t in rows], length):
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(seq, gone) if not g)
        out[i, len(seq), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def dedup_words(rows, length=50) -> Counter:
    out = Counter()
    for i, seq, gone in removed([(i, words_of(t)) for i, t in rows], length):
        kept = b" ".join(w for w, g in zip(seq, gone) if not g)
        out[i, len(seq), sum(gone), hashlib.sha256(kept).hexdigest()] += 1
    return out


def shingles(text: str | None, size: int = 5) -> frozenset:
    words = (text or "").encode().translate(LOWER).split()
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k:k + size]) for k in range(len(words) - size + 1))


def groups(rows) -> Counter:
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if either and 100 * both >= 75 * either:
                parent[find(a)] = find(b)
    ids = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        ids[find(k)].append(i)
    least = {k: min((i for i in own if i is not None), default=None) for k, own in ids.items()}
    return Counter((i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows))
