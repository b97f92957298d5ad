"""Positions of links: offsets to lines and columns (both from 1, columns in characters)."""

from __future__ import annotations

from bisect import bisect_right
from typing import NamedTuple


class Link(NamedTuple):
    """A raw link: its text, where it stands and the character offset at which it starts."""

    text: str
    element: str | None
    attribute: str | None
    offset: int


class Lines:
    """Line starts of one document."""

    def __init__(self, content: str):
        self.starts = [0]
        at = content.find("\n")
        while at >= 0:
            self.starts.append(at + 1)
            at = content.find("\n", at + 1)

    def at(self, offset: int) -> tuple[int, int]:
        line = bisect_right(self.starts, offset)
        return line, offset - self.starts[line - 1] + 1
