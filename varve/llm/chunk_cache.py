"""A bounded table of what is known of distinct chunks, shared by the operators that encode each chunk once."""

from __future__ import annotations

from collections.abc import Callable, Iterable

#: Chunks of a generation, some 250 bytes each.
ENTRIES = 400_000


class ChunkCache:
    """What ``learn`` returns for chunks, kept in two generations of about ``entries`` chunks.

    A full generation becomes the older one, and what is asked for again moves on to the new one. So a task
    forgets rare chunks and never the frequent ones, and its memory has a bound."""

    def __init__(self, learn: Callable[[list[str]], dict | Iterable[tuple[str, object]]], entries: int = ENTRIES):
        self.learn, self.entries = learn, entries
        self.now: dict[str, object] = {}
        self.before: dict[str, object] = {}

    def known(self, wanted: set[str]) -> dict[str, object]:
        """A table that holds all of ``wanted``."""
        missing = wanted.difference(self.now)  # by look-up; a view of the keys would be walked as a whole
        if missing and len(self.now) + len(missing) > self.entries:
            self.before, self.now = self.now, {}
            missing = set(wanted)
        if self.before:
            older = missing.intersection(self.before)
            self.now.update((chunk, self.before[chunk]) for chunk in older)
            missing -= older
        if missing:
            self.now.update(self.learn(list(missing)))
        return self.now

    def holds(self, chunk: str) -> bool:
        return chunk in self.now or chunk in self.before
