"""Which lines of a Python file hold statements. Small helpers for per-file pandas UDFs.

One pass over the tokens: they are gathered into statements, and a statement of nothing but
plain strings documents the module, class or function that it opens.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from tokenize import (
    COMMENT, DEDENT, ENCODING, ENDMARKER, INDENT, NEWLINE, NL, STRING, TokenError, TokenInfo, generate_tokens,
)

_BYTES = re.compile("[rR]?[bB]")
_DOCUMENT = re.compile(r"\(*s+\)*")


def _span(tokens: list[TokenInfo]) -> set[int]:
    return set(range(tokens[0].start[0], tokens[-1].end[0] + 1)) if tokens else set()


@dataclass
class _Statement:
    opens: bool  # first of a module, or of the body of a class or function
    tokens: list[TokenInfo] = field(default_factory=list)

    def lines(self) -> set[int]:
        return {n for t in self.tokens for n in range(t.start[0], t.end[0] + 1)}

    def names_scope(self) -> bool:
        words = [t.string for t in self.tokens[:2]]
        return words[0] in ("class", "def") or words == ["async", "def"]

    def _until(self, start: int, mark: str) -> int:
        """Place of the first such mark outside brackets, or the number of tokens."""
        depth = 0
        for place, token in enumerate(self.tokens[start:], start):
            if token.string == mark and not depth:
                return place
            depth += (token.string in ("(", "[", "{")) - (token.string in (")", "]", "}"))
        return len(self.tokens)

    def document(self) -> set[int]:
        """Lines of the docstring that starts here, or behind the colon of a one-line body."""
        if self.opens:
            start = 0
        elif self.names_scope():
            start = self._until(0, ":") + 1
        else:
            return set()
        first = self.tokens[start:self._until(start, ";")]
        shape = "".join(
            "s" if t.type == STRING and not _BYTES.match(t.string) else t.string if t.string in ("(", ")") else "x"
            for t in first
        )
        return _span(first) if _DOCUMENT.fullmatch(shape) else set()


def _statements(source: str) -> Iterator[_Statement]:
    current, last = _Statement(opens=True), None
    for token in generate_tokens(io.StringIO(source).readline):
        if token.type == INDENT:
            current.opens = last is not None and last.names_scope()
        elif token.type == NEWLINE and current.tokens:
            yield current
            current, last = _Statement(opens=False), current
        elif token.type not in (COMMENT, DEDENT, ENCODING, ENDMARKER, NEWLINE, NL):
            current.tokens.append(token)
    if current.tokens:
        yield current


def docstring_lines(source: str) -> set[int]:
    """Line numbers of docstrings; none if the text is no Python."""
    try:
        return set().union(*(s.document() for s in _statements(source)))
    except (TokenError, SyntaxError):
        return set()


def code_line_count(source: str) -> int | None:
    """Lines of statements that are no docstrings. None if the text is no Python."""
    try:
        code, documents = set(), set()
        for statement in _statements(source):
            code |= statement.lines()
            documents |= statement.document()
        return len(code - documents)
    except (TokenError, SyntaxError):
        return None
