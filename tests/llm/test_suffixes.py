"""Buckets of suffixes that many texts fill: what they hold in memory, and how they are split."""

import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import cases
from varve.llm import sliced, suffixes
from varve.llm.common import Slice

LINE = "The same line of a footer stands under every text here, word by word.\n"


def bag(frame):
    return cases.Counter(tuple(row) for row in frame.collect())


def hot(count: int) -> list[tuple]:
    """Texts around a line that all share, some of them twice or without an id."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdef") for _ in range(6))
    rows = [(k, " ".join(word() for _ in range(12)) + "\n" + LINE + " ".join(word() for _ in range(rnd.randint(0, 9)))) for k in range(count)]
    return [*rows, rows[3], (count, rows[4][1]), (None, rows[5][1]), (None, LINE), (2, LINE * 3), (count + 1, None), (count + 2, "short")]


@pytest.mark.parametrize("over", [0, 40, 300])
def test_split_buckets(spark, monkeypatch, over):
    monkeypatch.setattr(suffixes, "OVER", over)
    rows = hot(60) + cases.texts()
    found = suffixes.dedup(cases.frame(spark, rows), keep=False)
    assert bag(found) == cases.dedup_bytes(rows)


def slice_with(texts: list[str]) -> Slice:
    data = [t.encode() for t in texts]
    return Slice(np.arange(len(data)), np.cumsum([0, *map(len, data)]), np.frombuffer(b"".join(data), np.uint8))


def test_weights_count_every_suffix():
    texts = [t for _, t in hot(20) if t] * 2
    own = suffixes.Suffixes(slice_with(texts), suffixes.LENGTH)
    weights = own.weights(7)
    assert weights.sum() == sum(max(0, len(t.encode()) - 49) for t in texts)
    _, _, at, group = own.samples()
    key, place = own.merged(np.ones(len(at), bool), at)
    assert (np.bincount(sliced.bucket_of(key, 7), minlength=7) == weights).all()  # each holds a sampled tuple


def test_weights_by_steps(monkeypatch):
    own = suffixes.Suffixes(slice_with([t for _, t in hot(30) if t]), suffixes.LENGTH)
    whole = own.weights(5)
    monkeypatch.setattr(suffixes, "STRETCH", 17)
    assert (own.weights(5) == whole).all()


def bucket(rows: int, size: int) -> pa.Table:
    """A bucket with one run of text of each slice; the first 100 bytes of every run are the same."""
    rnd = np.random.default_rng(1)
    texts = [rnd.integers(0, 256, size, np.uint8) for _ in range(rows)]
    for k, text in enumerate(texts):
        text[:100], text[100] = texts[0][:100], k
    return pa.table({
        "b": pa.array([0] * rows, pa.int32()), "s": pa.array(range(rows), pa.int32()),
        "text": [zlib.compress(t.tobytes(), 1) for t in texts],
        "counts": [np.array([size - 49], "<u4").tobytes() for _ in texts],
        "ids": [sliced.pack_ids(np.array([k])) for k in range(rows)],
        "stage": pa.array([2] * rows, pa.int32()),
    })


def test_memory_of_a_bucket():
    table = bucket(16, 1 << 19)
    suffixes._smaller(bucket(1, 1 << 20), suffixes.LENGTH)  # powers of a step
    tracemalloc.start()
    try:
        found = suffixes._smaller(table, suffixes.LENGTH)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    for k, bits in enumerate(found.column("bits").to_pylist()):
        flags = np.unpackbits(np.frombuffer(bits, np.uint8))
        assert flags[:51].all() == (k > 0) and flags.sum() == (51 if k else 0)
    assert most < 25 * 16 * (1 << 19)


def test_runs_and_hashes_in_one_bucket():
    table = bucket(3, 400)
    text = zlib.decompress(table.column("text")[0].as_py())
    own = suffixes.Suffixes(Slice(np.array([7]), np.array([0, 400]), np.frombuffer(text, np.uint8)), suffixes.LENGTH)
    hashes = own.hashes(np.arange(60), np.arange(60) + 50)
    single = pa.table({
        "b": pa.array([0], pa.int32()), "s": pa.array([9], pa.int32()), "text": [hashes.astype("<u8").tobytes()],
        "counts": [np.ones(60, "<u4").tobytes()], "ids": [sliced.pack_ids(np.full(60, 7))], "stage": pa.array([3], pa.int32()),
    })
    found = suffixes._smaller(pa.concat_tables([table.slice(0, 1), single, table.slice(1)]), suffixes.LENGTH)
    assert found.column("stage").to_pylist() == [2, 3, 2, 2] and found.column("s").to_pylist() == [0, 9, 1, 2]
    counts = [int(np.unpackbits(np.frombuffer(bits, np.uint8)).sum()) for bits in found.column("bits").to_pylist()]
    assert counts == [0, 60, 51, 51]
