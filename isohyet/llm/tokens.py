"""Token ids by the ``tokenizers`` library, remembered by piece of text.

Neither tokenizer used here joins characters across certain boundaries: a space
that follows a non-space starts a new piece, and so do a newline between
non-spaces and plain punctuation after a Latin letter or digit
(without the one whose lower case ends in a mark).  A text's ids are
therefore the ids of its pieces in order.  All ids come from the library; a task
only avoids asking again for a piece that it has met.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np

from .shingles import WordHashes

_CUT = re.compile(r"(?<=\S)(?= \S)|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)|(?<=[A-Za-z0-9À-ÖØ-öø-įı-ɏ])(?=[,.!?;:|*$%&#])")
_BEFORE = frozenset(c for c in map(chr, range(48, 592)) if re.match("[A-Za-z0-9À-ÖØ-öø-įı-ɏ]", c))
_AFTER = frozenset(",.!?;:|*$%&#")
_RUN = re.compile(r"\s ")
#: Byte-level alphabet of the vocabularies: printable bytes stand for themselves,
#: the others for the characters from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = dict(zip(_SHOWN, _SHOWN, strict=True)) | {
    b: 256 + i for i, b in enumerate(x for x in range(256) if x not in _SHOWN)
}


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class _Atoms(dict):
    """piece -> its ids as little-endian unsigned 16-bit bytes; ``limit`` pieces are kept."""

    def __init__(self, owner: Ids, limit: int):
        super().__init__()
        self.owner, self.limit = owner, limit

    def __missing__(self, piece: str) -> bytes:
        value = self.owner.atom(piece)
        if len(self) < self.limit:
            self[piece] = value
        return value


class _Chunks(_Atoms):
    """What stands between two spaces -> its ids; put together from atoms."""

    def __missing__(self, chunk: str) -> bytes:
        atoms, space = self.owner.atoms, "" if self.owner.lossy else " "
        if chunk.isalpha():
            value = atoms[space + chunk]
        elif chunk[-1:] in _AFTER and chunk[-2:-1] in _BEFORE and chunk[:-1].isalpha():
            value = atoms[space + chunk[:-1]] + atoms[chunk[-1]]
        else:
            value = b"".join(map(atoms.__getitem__, _CUT.split(space + chunk)))
        if len(self) < self.limit:
            self[chunk] = value
        return value


class Ids:
    """Encodes whole texts.  lossy: the tokenizer lower-cases and drops white space.

    A special string inside a text is its one id, as in a plain call of the library,
    and cuts the text.  Ids are unsigned 16-bit, so the vocabulary must be smaller than
    65,536.
    """

    def __init__(self, path: str, lossy: bool, atoms: int = 400_000, chunks: int = 200_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = {t.content: np.array([i], "<u2").tobytes() for i, t in added.items()}
        self.cut_special = re.compile(f"({'|'.join(map(re.escape, sorted(self.special, key=len, reverse=True)))})")
        if self.tokenizer.get_vocab_size() > 65_536:
            raise ValueError(f"{path}: more than 65,536 ids")
        self.model, self.lossy = self.tokenizer.model, lossy
        self.atoms, self.chunks = _Atoms(self, atoms), _Chunks(self, chunks)

    def atom(self, piece: str) -> bytes:
        """Ids of a piece; one run of letters goes straight to the vocabulary's merges."""
        word = piece[1:] if piece[:1] == " " else piece
        plain = word.isalpha()
        if plain and self.lossy:
            plain = "Σ" not in word and unicodedata.is_normalized("NFC", word)
            piece = word.lower() if plain else piece
            plain = plain and piece.isalpha()
        if plain:
            shown = piece.encode().decode("latin-1").translate(_ALPHABET)
            ids = [t.id for t in self.model.tokenize(shown)]
        else:
            ids = self.tokenizer.encode(word if self.lossy else piece, add_special_tokens=False).ids
        return np.array(ids, "<u2").tobytes()

    def encode(self, text: str | None) -> bytes:
        """All ids of the text, each as two little-endian bytes."""
        if text and any(x in text for x in self.special):
            return b"".join(self.special.get(x) or self.ordinary(x) for x in self.cut_special.split(text))
        return self.ordinary(text)

    def ordinary(self, text: str | None) -> bytes:
        """The same for a text without special strings."""
        if not text:
            return b""
        if self.lossy:
            return b"".join(map(self.chunks.__getitem__, text.split(" ")))
        if _RUN.search(text):
            return b"".join(map(self.atoms.__getitem__, _CUT.split(text)))
        first, *rest = text.split(" ")
        return b"".join([*map(self.atoms.__getitem__, _CUT.split(first)), *map(self.chunks.__getitem__, rest)])


_MADE: dict[tuple[str, bool], Ids] = {}


def ids_for(path: str, lossy: bool) -> Ids:
    """One encoder for each Python worker, kept between its tasks."""
    WordHashes.forget()
    if (path, lossy) not in _MADE:
        _MADE[path, lossy] = Ids(path, lossy)
    return _MADE[path, lossy]
