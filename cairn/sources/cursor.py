"""A bounds-checked reader of binary structures."""

from __future__ import annotations

import struct

from cairn.result import FormatError


class Cursor:
    """Reads numbers and runs from bytes; a read beyond the end is a format error."""

    def __init__(self, data: bytes, at: int = 0, big: bool = True):
        self.data, self.at, self.order = data, at, ">" if big else "<"

    def take(self, n: int) -> bytes:
        if n < 0 or self.at < 0 or self.at + n > len(self.data):
            raise FormatError("read past the end", at=self.at, wanted=n, size=len(self.data))
        self.at += n
        return self.data[self.at - n : self.at]

    def read(self, kinds: str):
        """One value or a tuple, by ``struct`` letters."""
        got = struct.unpack(self.order + kinds, self.take(struct.calcsize(self.order + kinds)))
        return got[0] if len(got) == 1 else got

    def go(self, at: int) -> Cursor:
        self.at = at
        return self

    def text(self, at: int, most: int = 4096) -> str:
        """A NUL-terminated string at a position; empty if the position is outside."""
        if not 0 <= at < len(self.data):
            return ""
        end = self.data.find(b"\0", at, at + most)
        return self.data[at : end if end >= 0 else min(len(self.data), at + most)].decode("utf-8", "replace")
