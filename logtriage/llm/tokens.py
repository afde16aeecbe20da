"""Token ids of whole texts with a given tokenizer file of lower-casing, white-space dropping word BPE.

Such a tokenizer never joins characters across white space, nor a letter with the punctuation after it, so the ids of
a text are the ids of its pieces in order. Pieces recur, texts do not: a worker keeps the ids of pieces it has met.
"""

from __future__ import annotations

import array
import functools
import re
import unicodedata

from tokenizers import Tokenizer

#: Pieces one generation of a worker's store holds (two generations are kept), and the longest piece that is kept.
#: A bound of about 150 MB a worker; it changes speed only.
KEPT_PIECES = 350_000
KEPT_LENGTH = 48

#: A letter, then punctuation to the end; pieces with what else tokenizers split on (apostrophes) are left alone.
_TAIL = re.compile(rb"([^']*[a-z])([^A-Za-z0-9'\x80-\xff]+)\Z")
_LETTERS = re.compile(rb"[a-z]+\Z")


def _shown_bytes() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shown = {b: chr(b) for b in plain}
    shown |= {b: chr(0x100 + k) for k, b in enumerate(b for b in range(0x100) if b not in shown)}
    return [shown[b] for b in range(0x100)]


_SHOWN = _shown_bytes()


class _Pieces(dict):
    """UTF-8 piece to its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, tokenizer: Tokenizer) -> None:
        super().__init__()
        self.whole, self.model, self.older = tokenizer, tokenizer.model, {}

    def __missing__(self, piece: bytes) -> bytes:
        found = self.older.get(piece)
        if found is None:
            found = self.encoded(piece)
        if len(piece) <= KEPT_LENGTH:
            if len(self) >= KEPT_PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = found
        return found

    def encoded(self, piece: bytes) -> bytes:
        if _LETTERS.match(piece):
            ids = [x.id for x in self.model.tokenize(piece.decode())]
        elif b"<|" not in piece and (tail := _TAIL.match(piece)):
            return self[tail[1]] + self[tail[2]]
        else:
            text = piece.decode("utf-8", "replace")
            latin = text.isalpha() and max(text) < "ɐ"
            if latin and text == text.lower() and unicodedata.is_normalized("NFC", text):
                ids = [x.id for x in self.model.tokenize("".join(map(_SHOWN.__getitem__, piece)))]
            else:
                ids = self.whole.encode(text, add_special_tokens=False).ids
        return array.array("I", ids).tobytes()


@functools.lru_cache(maxsize=2)
def _pieces(path: str) -> _Pieces:
    return _Pieces(Tokenizer.from_file(path))


def encode(path: str, text: bytes, end_id: int) -> bytes:
    """Ids of a UTF-8 text followed by ``end_id``, as little-endian unsigned 32-bit integers."""
    if b"<|" not in text:  # names of special tokens are written in lower case and count as such only when so written
        text = text.lower()
    return b"".join(map(_pieces(path).__getitem__, text.split())) + end_id.to_bytes(4, "little")
