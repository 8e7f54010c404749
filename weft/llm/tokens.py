"""Token ids by the tokenizers library, with a bounded memory of the words already encoded.

Both vocabularies used here cut a text before every space that a character other than white space
follows, whatever stands around it; so a text's ids are those of its pieces between such spaces. The
library encodes each new piece once and the pieces' ids are put together again.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from itertools import islice

_CUT = re.compile(r" (?=\S)")
#: Atoms end before one another in either vocabulary: letters that are one character before and after
#: lower-casing and normalising, digits, ASCII punctuation but the apostrophe, and a line end within a piece.
_LETTERS = "[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u0148\u014A-\u017F]+"
_PUNCTUATION = r"[!-&(-/:-@\[-`{-~]+"
_LINE_END = r"(?<=\S)\n(?=\S)"
_ATOMS = re.compile(f"{_LETTERS}|[0-9]+|{_PUNCTUATION}|{_LINE_END}")
_ATOMS_ONE_DIGIT = re.compile(f"{_LETTERS}|[0-9]|{_PUNCTUATION}|{_LINE_END}")
#: Byte-level vocabularies write a byte that isn't a visible Latin-1 character as one from U+0100 on.
_VISIBLE = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255))}
#: Pieces of a generation that a Python worker remembers (two take about 100 MB), and bits that mark what was seen.
MEMORY = 300_000
SEEN_BITS = 1 << 24
LONG_PIECE = 200


class _Uncut(Exception):
    """A space before white space or the text's end doesn't cut."""


class _Pieces(dict):
    """Pieces after a space and their ids, kept from the second time on that they are encoded.

    Most pieces occur once; a bitmap of hashes tells which have been seen. When it is full, it becomes
    the old generation, from which what still occurs is taken over.
    """

    def __init__(self, encoder: PieceEncoder):
        self.encoder = encoder
        self.old: dict[str, bytes] = {}
        self.seen = bytearray(SEEN_BITS // 8)

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is not None:
            self[piece] = ids
            return ids
        e = self.encoder
        if not piece or piece[0].isspace():
            raise _Uncut
        if len(piece) > LONG_PIECE:
            return e.raw(" " + piece)
        parts = e.atoms(piece)
        if sum(map(len, parts)) < len(piece) or "<|" in piece:
            ids = e.raw(" " + piece)
        elif len(parts) == 1:
            low = piece.lower() if e.lower else piece
            ids = e.word(e.mark, piece) if low == piece else self[low]
        elif e.lower:
            ids = b"".join([self[p] for p in parts if p != "\n"])
        else:
            ids = self[parts[0]] + b"".join([e.outer[p] for p in parts[1:]])
        h = hash(piece) & (SEEN_BITS - 1)
        if self.seen[h >> 3] >> (h & 7) & 1:
            self[piece] = ids
        else:
            self.seen[h >> 3] |= 1 << (h & 7)
        return ids


class _Heads(dict):
    """Pieces that begin a text, and atoms within a piece."""

    def __init__(self, encoder: PieceEncoder):
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        e = self.encoder
        ids = e.word("", piece.lower() if e.lower else piece) if e.atoms(piece) == [piece] else e.raw(piece)
        if len(piece) <= LONG_PIECE:
            self[piece] = ids
        return ids


class PieceEncoder:
    """encode(texts) gives each text's ids as little-endian 32-bit bytes, equal to the library's own."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        form = json.loads(self.tokenizer.to_str())
        self.lower = "Lowercase" in json.dumps(form.get("normalizer"))
        self.mark = "" if self.lower else "\u0120"
        self.inner, self.outer = _Pieces(self), _Heads(self)
        # an atom is one piece for the model itself, as these probes confirm; if not, the library gets whole pieces
        self.atoms = (_ATOMS_ONE_DIGIT if self.lower else _ATOMS).findall
        probes = ("the", "Zebra", "naïve", "ÀÉñß", "oftionnten", "STRASSE", "2024", "7", "...", "--", "(x)", "a1b22,c", "x_y", "##", "a\nB", "a.\nb")
        if not all(self.inner[w] == self.raw(" " + w) and self.outer[w] == self.raw(w) for w in probes):
            self.atoms = lambda piece: []
        self.inner.clear()
        self.outer.clear()

    def raw(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, mark: str, atom: str) -> bytes:
        if not atom.isascii():
            atom = atom.encode().decode("latin-1").translate(_VISIBLE)
        return array("I", [t.id for t in self.model.tokenize(mark + atom)]).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.inner) > MEMORY:
            self.inner.old = dict(self.inner)
            self.inner.clear()
        if len(self.outer) > MEMORY // 4:
            self.outer.clear()
        out, ids_of = [], self.inner.__getitem__
        for t in texts:
            pieces = t.split(" ")
            head = self.outer[pieces[0]]
            try:
                out.append(head + b"".join(map(ids_of, islice(pieces, 1, None))))
            except _Uncut:
                pieces = _CUT.split(t)
                out.append(self.outer[pieces[0]] + b"".join(map(ids_of, pieces[1:])))
        return out


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder for this vocabulary, kept from task to task."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def text_groups(texts: list[str | None], size: int = 1 << 20):
    """(first row, texts) in groups of about size characters; null counts as empty."""
    group, at, n = [], 0, 0
    for i, t in enumerate(texts):
        group.append(t or "")
        n += len(t or "")
        if n >= size:
            yield at, group
            group, at, n = [], i + 1, 0
    if group:
        yield at, group
