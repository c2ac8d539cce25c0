"""Token counts: whole texts encoded in balanced batches, only lengths returned."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from varve.llm.common import id_and_bytes, slices

BATCH_BYTES = 1 << 20
SEGMENT_BYTES = 1 << 16

#: No piece of the vocabulary holds a marker after another character, so a text may be cut before
#: a space that follows neither a space nor a marker. The cut space is the next segment's prefix.
CUT = re.compile(r"(?<=[^ ▁]) (?=.)", re.DOTALL)


def safe_segments(text: str, size: int = SEGMENT_BYTES) -> Iterator[str]:
    """Cut a text at safe spaces, the first such after each ``size`` characters."""
    begin = 0
    while len(text) - begin > size:
        cut = CUT.search(text, begin + size)
        if cut is None:
            break
        yield text[begin:cut.start()]
        begin = cut.end()
    yield text[begin:] if begin else text


def token_counts(
    docs: DataFrame, model_file: str, limit: int = 4096, doc_id: str = "doc_id", text: str = "text",
    batch_bytes: int = BATCH_BYTES, segment_bytes: int = SEGMENT_BYTES,
) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit).

    Tokens are those of the sentencepiece model without begin or end. A null text counts as
    empty (0 tokens), a null id stays null, repeated rows are counted each, an empty table gives
    no rows, and other columns are not read. Texts longer than ``segment_bytes`` are cut where no
    piece can cross and their counts summed; a text without such a place is encoded whole.
    Segments are sent to the library in groups of about ``batch_bytes``.
    """

    def count(batches):
        import sentencepiece

        encoder = sentencepiece.SentencePieceProcessor(model_file=model_file)
        for batch in batches:
            for piece in slices(batch, batch_bytes):
                segments, owner = [], []
                for k in range(len(piece)):
                    for segment in safe_segments(piece.text(k).decode("utf-8", "replace"), segment_bytes):
                        segments.append(segment)
                        owner.append(k)
                totals = [0] * len(piece)
                begin = size = 0
                for end, segment in enumerate(segments, 1):
                    size += len(segment)
                    if size >= batch_bytes or end == len(segments):
                        group = encoder.encode(segments[begin:end], num_threads=1)
                        for k, ids in zip(owner[begin:end], group):
                            totals[k] += len(ids)
                        begin, size = end, 0
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(piece.ids, pa.int64()),
                    "n_bytes": pa.array(piece.lengths, pa.int64()),
                    "n_tokens": pa.array(totals, pa.int64()),
                    "over_limit": pa.array([n > limit for n in totals], pa.bool_()),
                })

    return id_and_bytes(docs, doc_id, text).mapInArrow(
        count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )
