"""Long texts in pieces."""

from __future__ import annotations

from collections.abc import Iterator

#: Characters that are taken at once, about; word lists of longer texts would not fit a worker.
PIECE = 1 << 22


def pieces(text: str, separator: str) -> Iterator[str]:
    """The text in pieces that end with a separator, of ``PIECE`` characters or as many more as it
    takes: what lies between two separators is never cut."""
    at = 0
    while len(text) - at > PIECE:
        k = text.rfind(separator, at, at + PIECE)
        if k <= at:
            k = text.find(separator, at + PIECE)
            if k < 0:
                break
        yield text[at : k + len(separator)]
        at = k + len(separator)
    yield text[at:] if at else text
