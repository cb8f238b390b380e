"""Encoding texts chunk by chunk with a bounded cache.

A chunk is a run between single spaces together with the space before it, or what stands between a
line's start and its first space. The tokenizers' split pattern never joins characters across such a
space or a line end unless white space stands beside it, so ids of the chunks and line ends, put
together, are the ids of the text; texts with other white space there are encoded as a whole.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable

#: Longer chunks aren't kept.
LONGEST = 64
#: Bytes that the chunks kept take, about: the text, its ids, and the objects that hold them.
MOST_BYTES, EACH = 200 << 20, 220
#: Marks that end a piece of letters and, alone behind letters, are a piece.
MARKS = ".,;:!?"


class _Uneven(Exception):
    """White space beside a space or a line end: there the split depends on what comes after it."""


class _Cache(dict):
    """Packed ids by text, in two halves; the older half is forgotten when the newer is full."""

    def __init__(self, of: Callable[[str], bytes], size: int):
        self.of, self.size, self.old = of, size // 2, {}

    def __missing__(self, text: str) -> bytes:
        got = self.old.get(text)
        if got is None:
            got = self.of(text)
            if len(text) > LONGEST:
                return got
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[text] = got
        return got


class ChunkEncoder:
    """``encode(text)`` gives packed little-endian ids; ``split`` cuts a text into pieces, ``ids`` encodes one.

    A word with the space before it is kept as a chunk only, whatever stands around it elsewhere;
    marks and numbers in chunks are kept as pieces too.
    """

    def __init__(self, split: Callable[[str], list[str]], ids: Callable[[str], list[int]], most: int = MOST_BYTES // EACH):
        self.split, self.ids = split, ids
        self.pieces = _Cache(self._piece, most // 8)
        self.first, self.rest = _Cache(self._whole, most // 16), _Cache(self._after_space, most - most // 8 - most // 16)

    def _piece(self, piece: str) -> bytes:
        return array("I", self.ids(piece)).tobytes()

    def _get(self, piece: str) -> bytes:
        return self.rest[piece[1:]] if piece[0] == " " and piece[1:].isalpha() else self.pieces[piece]

    def _whole(self, text: str) -> bytes:
        return b"".join(map(self._get, self.split(text)))

    def _after_space(self, chunk: str) -> bytes:
        if chunk.isalpha():  # a space and letters are one piece
            return self._piece(" " + chunk)
        if not chunk or chunk[0].isspace():
            raise _Uneven
        if chunk[-1] in MARKS and chunk[:-1].isalpha():  # letters, and one mark alone
            return self.rest[chunk[:-1]] + self.pieces[chunk[-1]]
        return self._whole(" " + chunk)

    def _line(self, line: str) -> bytes:
        if not line:
            return b""
        if line[0].isspace() or line[-1].isspace():
            raise _Uneven
        first, *rest = line.split(" ")
        # uneven chunks are never kept, so each of them comes to _after_space
        return self.first[first] + b"".join(map(self.rest.__getitem__, rest))

    def encode(self, text: str) -> bytes:
        # of two line ends before a letter each is a piece; more, or two at the end, are joined
        if "\n\n\n" in text or text.endswith("\n\n"):
            return self._whole(text)
        try:
            return self.pieces["\n"].join(map(self._line, text.split("\n")))
        except _Uneven:
            return self._whole(text)
