"""The filter audit against a plain version that applies the filters in every order."""

from __future__ import annotations

import itertools
from collections import Counter

from tests.llm import cases
from varve.llm import filter_audit

COLUMNS = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def failed(rows) -> list[set]:
    out = []
    for i, t, _ in rows:
        text, words = t or "", cases.words_of(t)
        own = {letter for letter, fails in {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), "D": any(c in "#$%&*|" for c in text),
            "E": any((u or "") == text and cases.smaller(j, i) for j, u, _ in rows),
        }.items() if fails}
        out.append(own)
    return out


def plain(rows, labels) -> Counter:
    """rows: (id, text, source); labels: (id, quality, toxic)."""
    fails, out = failed(rows), []
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    for part in {s or "" for _, _, s in rows}:
        own = [(i, f) for (i, _, s), f in zip(rows, fails) if (s or "") == part]
        table, share = [], Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [i for i, f in left if letter in f]
                left = [(i, f) for i, f in left if letter not in f]
                every = sum(letter in f for _, f in own)
                table.append([part, order, step, len(left), len(gone), every - len(gone), sum(f == {letter} for _, f in own),
                              sum(i in good for i in gone), sum(i in toxic for i in gone)])
                share[letter] += len(gone)
        out += [(*row, share[row[1][row[2] - 1]]) for row in table]
    return Counter(out)


def test_audit(spark):
    sources = ["a", None, "b", "", "a"]
    rows = [(i, t, sources[k % 5]) for k, (i, t) in enumerate(cases.texts())]
    rows += [(30, "w" + " w" * 400, "a"), (31, " ".join(f"Word{k}" for k in range(300)), "hot"), (31, " ".join(f"Word{k}" for k in range(300)), "hot"),
             (32, " ".join(f"Word{k}" for k in range(300)), "hot"), (33, " ".join(f"plain{k}" for k in range(200)), None)]
    labels = [(i, k % 2, k % 3 == 0) for k, (i, _, _) in enumerate(rows)] + [(33, 1, 0), (33, 0, 1), (None, 1, 1), (999, 1, 1), (3, None, None)]
    docs = spark.createDataFrame(
        [(i, t, s, 5, "x", 9) for i, t, s in rows], "doc_id long, text string, source string, failed int, part string, mask int").repartition(3)
    marks = spark.createDataFrame([(i, None if q is None else int(q), None if x is None else int(x)) for i, q, x in labels], "doc_id long, quality int, toxic int")
    found = filter_audit.audit(docs, marks)
    assert Counter(tuple(r) for r in found.select(*COLUMNS).collect()) == plain(rows, labels)
    assert filter_audit.audit(docs.limit(0), marks).count() == 0
    bare = filter_audit.audit(docs, marks.limit(0))
    assert bare.where("good_lost + toxic_lost > 0").count() == 0 and bare.count() == found.count()
    assert spark.conf.get("spark.sql.cteRecursionRowLimit", None) in (None, "1000000")


def test_long_text_in_parts(spark, monkeypatch):
    """A text counted in parts has the same facts, whatever the size of a part."""
    rows = [(i, t) for i, t in cases.texts() if t]
    docs = cases.frame(spark, rows)
    whole = {tuple(r) for r in filter_audit.facts(docs).select("doc_id", "text_key", "failed").collect()}
    monkeypatch.setattr(filter_audit, "LONG", 64)
    from varve.llm import common
    monkeypatch.setattr(common.slices, "__defaults__", (64, "doc_id", "data"))
    monkeypatch.setattr(common.chunked_word_hashes, "__defaults__", (64,))
    assert {tuple(r) for r in filter_audit.facts(docs).select("doc_id", "text_key", "failed").collect()} == whole
