"""SentencePiece ids of whole texts through a table of distinct chunks, and back to text."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from varve.llm.chunk_cache import ENTRIES, ChunkCache
from varve.llm.common import id_and_bytes, slices

#: Pieces never hold a marker after another character, so a chunk ends before a space that
#: follows neither a space nor a marker.
BORDER = re.compile(r"(?<=[^ ▁]) ")


def chunks(text: str) -> list[str]:
    """Chunks of a text; the space before each but the first is the prefix the encoder adds."""
    if "  " in text or "▁" in text or text[:1] == " ":
        parts = BORDER.split(text)
    else:
        parts = text.split(" ")
    if len(parts) > 1 and not parts[-1]:  # a last space is a chunk's own
        parts[-2:] = [parts[-2] + " "]
    return parts


#: Chunks of printable ASCII, but for angle brackets and bars, and of Latin letters.
PLAIN = re.compile(r"[!-;=?-{}~\u00A1-\u024F]+")


class ChunkTable:
    """Ids as text of each distinct chunk, and its decoded text where that is another than the chunk.

    Each distinct chunk is segmented once while the cache knows it. Plain chunks decode to themselves if every character of
    theirs does, for pieces are joined as they are; that is asked of the model once. The others are decoded."""

    def __init__(self, model_file: str, entries: int):
        import sentencepiece

        self.codec = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.names = [str(i) for i in range(self.codec.get_piece_size())]
        self.cache = ChunkCache(self.learn, entries)
        self.odd: dict[str, str] = {}
        single = [c for c in map(chr, range(33, 0x250)) if PLAIN.fullmatch(c)]
        self.faithful = self.codec.decode(self.codec.encode(single, num_threads=1), num_threads=1) == single

    def learn(self, new: list[str]):
        found = self.codec.encode(new, num_threads=1)
        rest = [k for k, chunk in enumerate(new) if not (self.faithful and PLAIN.fullmatch(chunk))]
        for k, plain in zip(rest, self.codec.decode([found[k] for k in rest], num_threads=1) if rest else ()):
            if plain != new[k]:
                self.odd[new[k]] = plain
        names = self.names
        return zip(new, [",".join([names[i] for i in ids]) for ids in found])

    def known(self, wanted: set[str]) -> dict[str, str]:
        table = self.cache.known(wanted)
        if len(self.odd) > self.cache.entries:
            self.odd = {chunk: plain for chunk, plain in self.odd.items() if self.cache.holds(chunk)}
        return table

    def decoded(self, text: str, parts: list[str]) -> str:
        """The text that the chunks decode to; the text itself where they decode to themselves."""
        odd = self.odd
        return text if odd.keys().isdisjoint(parts) else " ".join([odd.get(part, part) for part in parts])


def encode_decode(
    docs: DataFrame, model_file: str, doc_id: str = "doc_id", text: str = "text",
    entries: int = ENTRIES, keep: bool = True,
) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``keep`` ids and decoded.

    The ids are those of the whole text, without begin or end. A null text counts as empty (no
    ids), a null id stays null, repeated rows are encoded each, an empty table gives no rows, and
    other columns are not read. A text without spaces is one chunk.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if keep:
        schema += ", ids array<int>, decoded string"

    def run(batches):
        table = ChunkTable(model_file, entries)
        for batch in batches:
            for piece in slices(batch):
                texts = [piece.text(k).decode("utf-8", "replace") for k in range(len(piece))]
                parts = [chunks(text) for text in texts]
                shown_of = table.known(set().union(*parts)).__getitem__
                counts, digests, backs, ids, plains = [], [], [], [], []
                for text, part in zip(texts, parts):
                    shown = ",".join(map(shown_of, part)) if text else ""
                    plain = table.decoded(text, part)
                    counts.append(shown.count(",") + 1 if shown else 0)
                    digests.append(hashlib.sha256(shown.encode()).hexdigest())
                    backs.append(hashlib.sha256(plain.encode()).hexdigest())
                    if keep:
                        ids.append([int(i) for i in shown.split(",")] if shown else [])
                        plains.append(plain)
                columns = {
                    "doc_id": pa.array(piece.ids, pa.int64()), "n_tokens": pa.array(counts, pa.int64()),
                    "ids_sha256": pa.array(digests, pa.string()), "decoded_sha256": pa.array(backs, pa.string()),
                }
                if keep:
                    columns["ids"] = pa.array(ids, pa.list_(pa.int32()))
                    columns["decoded"] = pa.array(plains, pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    return id_and_bytes(docs, doc_id, text).mapInArrow(run, schema)
