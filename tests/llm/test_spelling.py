"""Spelling variants against a plain version over deletion neighbourhoods, and the index against plain edits."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from tests.llm import cases
from varve.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def vocabulary(rows) -> dict:
    count = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            count[run[:h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run] += 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


def near(a: str, b: str) -> bool:
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plain(rows) -> Counter:
    words = vocabulary(rows)
    by_length = defaultdict(list)
    for w in words:
        by_length[len(w)].append(w)
    form, count = {}, {}
    for w, n in words.items():
        own = [v for size in (len(w) - 1, len(w), len(w) + 1) for v in by_length[size] if near(w, v)]
        count[w] = len(own)
        best = min(own, key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 10 * n:
            form[w] = best

    def last(w):
        while w in form:
            w = form[w]
        return w

    return Counter((w, form.get(w), last(w), n, count[w], words.get(form.get(w))) for w, n in words.items())


COLUMNS = "word form root n n_near form_n".split()


def variants(docs) -> Counter:
    return Counter(tuple(r) for r in spelling.variants(docs).select(*COLUMNS).collect())


def written(rnd, letters: str, roots: int) -> list[tuple]:
    """Rows with words, their misspellings and misspellings of those, ten times rarer each."""
    words = []
    for _ in range(roots):
        base = "".join(rnd.choice(letters) for _ in range(rnd.randint(6, 11)))
        words += [base] * 250
        for _ in range(3):
            one = edited(rnd, base, letters)
            words += [one] * 24
            words += [edited(rnd, one, letters)] * 2
    rnd.shuffle(words)
    return [(k, " ".join(words[k::40])) for k in range(40)]


def edited(rnd, word: str, letters: str) -> str:
    at, kind = rnd.randrange(len(word)), rnd.randrange(3)
    return word[:at] + ("" if kind == 0 else rnd.choice(letters)) + word[at + (kind < 2):]


def test_variants(spark):
    rnd = random.Random(2)
    rows = cases.texts() + written(rnd, "abcéÿÀ", 12) + [(None, "Straßenbahn " * 3), (50, "STRASSENBAHN÷×x, naïveté" * 2), (51, "Àaaaaaaaa aaaaaaaaa " * 5)]
    docs = cases.frame(spark, rows)
    assert variants(docs) == plain(rows)
    assert spelling.variants(cases.frame(spark, [])).count() == 0
    assert spelling.variants(cases.frame(spark, [(1, None), (2, ""), (3, "short words only")])).count() == 0


def test_variants_behind_a_crowded_edge(spark, monkeypatch):
    """Most words share their first or last letters, and an index holds few: they are split, and no pair is lost."""
    monkeypatch.setattr(spelling, "SHARD", 20)
    monkeypatch.setattr(spelling, "AT_ONCE", 7)
    rnd = random.Random(4)
    rows = [(i, " ".join(("inter" + w if k % 2 else w + "ation") for k, w in enumerate(t.split()))) for i, t in written(rnd, "abcd", 10)]
    assert variants(cases.frame(spark, rows)) == plain(rows)


def test_index_finds_what_edits_find():
    """One side of the search: the first ``exact`` letters stand, and one error lies in the rest."""
    rnd = random.Random(8)
    words = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randint(2, 8))) for _ in range(200)} | {"a" * k for k in range(2, 9)})
    code = lambda w: np.array([ord(c) - 96 for c in w])
    index = spelling.Index(np.concatenate([part for w in words for part in ([0], code(w)[::-1])] + [[0]]))
    padded = np.zeros((len(words), 8), np.int64)
    for k, w in enumerate(words):
        padded[k, :len(w)] = code(w)
    lengths = np.array([len(w) for w in words])
    for exact in (lengths // 2, np.zeros_like(lengths), lengths):
        query, word = spelling.one_error(index, padded, lengths, exact)
        want = {(a, b) for a, w in enumerate(words) for b, v in enumerate(words) if near(w, v) and any(
            v == w[:k] + x + w[k + cut:] for k in range(exact[a], len(w) + 1) for cut in (0, 1) for x in ("", "a", "b"))}
        assert set(zip(query.tolist(), word.tolist())) == want


def test_crc_and_parts(monkeypatch):
    rnd = random.Random(1)
    data = np.frombuffer(bytes(rnd.randrange(256) for _ in range(3000)), np.uint8)
    starts = np.array([rnd.randrange(2800) for _ in range(300)])
    ends = starts + np.array([rnd.choice([0, 1, 7, 63, 64, 65, 200]) for _ in range(300)])
    begun = [zlib.crc32(str(k).encode()) for k in range(300)]
    found = spelling.crc32_of(data, starts, ends, np.array(begun, np.uint32))
    assert found.tolist() == [zlib.crc32(data[a:b], c) for a, b, c in zip(starts, ends, begun)]
    from varve.llm.common import Slice
    text = " ".join("wort" + "abcdé"[k % 5] * (k % 9) for k in range(500)).encode()
    part = Slice([5], np.array([0, len(text)]), np.frombuffer(text, np.uint8))
    total = lambda found: Counter({w: 0 for w in found[0]}) + sum((Counter({w: int(n)}) for w, n in zip(*found)), Counter())
    whole = total(spelling._counted(part))
    monkeypatch.setattr(spelling, "SLICE_BYTES", 50)
    assert total(spelling._counted(part)) == whole
