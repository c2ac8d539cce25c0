"""The bounded table of chunks."""

from varve.llm.chunk_cache import ChunkCache


def test_generations():
    asked = []
    cache = ChunkCache(lambda new: asked.append(sorted(new)) or {c: c.upper() for c in new}, entries=4)
    assert cache.known({"a", "b", "c"}) == {"a": "A", "b": "B", "c": "C"}
    table = cache.known({"a", "d"})
    assert table["a"] == "A" and table["d"] == "D" and asked[-1] == ["d"]
    table = cache.known({"a", "e"})  # full: a moves on, the others stay behind
    assert table == {"a": "A", "e": "E"} and asked[-1] == ["e"]
    assert cache.holds("b") and not cache.holds("z")
    assert cache.known({"b"})["b"] == "B" and len(asked) == 3
    table = cache.known({str(k) for k in range(9)})  # more than a generation: all are held at once
    assert len(table) == 9 and cache.known(set()) is table
    assert cache.known({"c"})["c"] == "C" and asked[-1] == ["c"]
