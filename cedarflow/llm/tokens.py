"""Token ids by the public ``tokenizers`` library, a word at a time.

A text is cut where one white-space character stands between two characters
that are none.  No pre-token reaches across such a place, so the ids of a text
are the ids of its pieces, one after another, and pieces that came before are
taken from a bounded dictionary.  Texts in which white-space characters follow
each other are cut only where that holds.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

#: Pieces in one of the two dictionaries of a worker; when it is full, it
#: becomes the older one, from which pieces in use come back.
MOST_PIECES = 600_000
#: New pieces are encoded so many at a time, parted by a separator.
TOGETHER = 256
#: Longer pieces are encoded but not kept.
LONGEST_KEPT = 64
CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: White space other than blank and line end, and NUL, which marks cuts.
OTHERS = [chr(i) for i in range(0x10000) if (chr(i).isspace() or i == 0) and chr(i) not in " \n"]
ASCII_OTHERS = [c for c in OTHERS if c < "\x80"]
PAIRS = ("  ", "\n\n", " \n", "\n ")


def simple(text: str) -> bool:
    """White space is single blanks and line ends between other characters."""
    if text[0] in " \n" or text[-1] in " \n":
        return False
    for c in ASCII_OTHERS if text.isascii() else OTHERS:
        if c in text:
            return False
    return not any(p in text for p in PAIRS)


def plain(piece: str) -> bool:
    """Fit to be encoded together with others: no white space but a blank before
    it, and no string that may be a special token or the separator."""
    return piece.isprintable() and piece.rfind(" ") < 1 and "<|" not in piece and piece not in ("", " ")


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # whether white space makes tokens; if not, blanks need not be told from line ends
        self.spaced = self._each(["a b"]) != self._each(["a\nb"])
        self.between = "\n" if self.spaced else " \x01 "
        found = self._each([self.between])[0]
        self.mark = int.from_bytes(found, "little") if len(found) == 4 else None

    def _each(self, pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces without white space but for a blank before them."""
        texts = [self.between.join(pieces[i : i + TOGETHER]) for i in range(0, len(pieces), TOGETHER)]
        out: list[bytes] = []
        for k, e in enumerate(self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids, part = np.array(e.ids, "<u4"), pieces[k * TOGETHER : (k + 1) * TOGETHER]
            ends = np.flatnonzero(ids == self.mark).tolist()
            if len(ends) != len(part) - 1:
                out += self._each(part)
                continue
            raw, start = ids.tobytes(), 0
            for end in [*ends, len(ids)]:
                out.append(raw[4 * start : 4 * end])
                start = end + 1
        return out

    def pieces(self, text: str) -> list[str]:
        if not simple(text):
            return CUT.split(text)
        if not self.spaced:
            return text.replace("\n", " ").split(" ")
        return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers; null: none."""
        cut = [self.pieces(t) if t else [] for t in texts]
        if len(self.kept) > MOST_PIECES:
            self.kept, self.older = {}, self.kept
        kept, older = self.kept, self.older
        new = set().union(*cut).difference(kept)
        extra: dict[str, bytes] = {}
        together, odd = [], []
        for piece in new:
            if piece in older:
                kept[piece] = older[piece]
            else:
                (together if self.mark is not None and plain(piece) else odd).append(piece)
        for part, ids_of in ((together, self._ids), (odd, self._each)):
            for piece, ids in zip(part, ids_of(part), strict=True):
                (kept if len(piece) <= LONGEST_KEPT else extra)[piece] = ids
        if extra:
            return [b"".join([extra[p] if p in extra else kept[p] for p in c]) for c in cut]
        get = kept.__getitem__
        return [b"".join(map(get, c)) for c in cut]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker and file."""
    return Encoder(path)


def public_path(name: str) -> str:
    """Where the public tokenizer file ``name`` lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
