"""Byte-pair encoding by prefix dynamic programming.

For every prefix of a byte string exactly one token can end its encoding. Storing that last token for
each prefix gives the encoding of any prefix by walking back, so bytes can be appended exactly, and
an edit needs new work only from the edit on. Whether a token may follow another is decided from the merge
table alone: the pair is valid iff encoding its joined bytes gives the pair back.

Text is first split by the public pattern of the vocabulary; no token crosses such a split.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np

#: Default place of the public vocabularies; always a parameter of the operators.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: White space of the split pattern (fixed values: Unicode White_Space).
_SPACE = [(0x9, 0xD), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
#: Entries a memo may hold before it starts anew; results never depend on it.
MEMO = 1 << 20


def _ranges(kind: str, top: int) -> str:
    """The characters up to ``top`` whose general category begins with ``kind``, as a regex class."""
    out, start = [], None
    for c in range(top + 2):
        inside = c <= top and unicodedata.category(chr(c))[0] == kind
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


@lru_cache(maxsize=4)
def splitter(top: int) -> re.Pattern:
    """The split pattern for texts whose characters are all <= ``top``; smaller classes match faster."""
    letter, number = _ranges("L", top), _ranges("N", top)
    space = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in _SPACE if a <= top)
    # alternatives that begin with different characters may be tried in any order: the frequent ones first
    return re.compile(f" ?[{letter}]+| ?[{number}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


def split(text: str) -> list[str]:
    """The pieces of ``text`` that are encoded on their own; joined they are ``text``."""
    if text.isascii():
        return splitter(0x7F).findall(text)
    top = ord(max(text))
    return splitter(0xFF if top <= 0xFF else 0xFFFF if top <= 0xFFFF else 0x10FFFF).findall(text)


def _byte_chars() -> dict[str, int]:
    """The public byte-to-character table of byte-level vocabularies, by its rule: printable bytes stand for themselves."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class PrefixBPE:
    """A vocabulary in the format of the tokenizers library, with merge ids in merge order."""

    def __init__(self, vocabulary: str = VOCABULARY) -> None:
        with open(vocabulary, encoding="utf-8") as f:
            model = json.load(f)["model"]
        chars = _byte_chars()
        raw = model["vocab"]
        self.ids = {bytes(chars[c] for c in t): i for t, i in raw.items() if all(c in chars for c in t)}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for m in model["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            pair, whole = (raw[a], raw[b]), raw[a + b]
            self.parts[whole] = pair
            self.merged[pair] = whole
        self.longest = max(map(len, self.ids))
        self.pairs: dict[tuple[int, int], bool] = {}
        self.memo = _Memo(self)
        self.table = Table(self)

    def follows(self, a: int, b: int) -> bool:
        """Whether the bytes of ``a`` and ``b`` together are encoded as just these two tokens.

        Both tokens are taken apart in the reverse order of their merges; the pair is broken if at any
        time the tokens at the seam would have merged earlier than the seam's sides were made.
        """
        found = self.pairs.get((a, b))
        if found is None:
            found = self._follows(a, b)
            if len(self.pairs) >= MEMO:
                self.pairs.clear()
            self.pairs[a, b] = found
        return found

    def _follows(self, a: int, b: int) -> bool:
        before, parts, merged = 1 << 60, self.parts, self.merged
        while True:
            if merged.get((a, b), 1 << 60) < before:
                return False
            pa, pb = parts.get(a), parts.get(b)
            if pa is None and pb is None:
                return True
            # undo whichever of the two was merged last; at equal ids the left one was merged first
            if pb is None or (pa is not None and a > b):
                before, a = a, pa[1]
            else:
                before, b = b + 1, pb[0]

    def prefixes(self, data: bytes, last: list[int] | None = None) -> list[int]:
        """``last[i]`` is the token that ends the encoding of ``data[:i+1]``.

        A given ``last`` holds for the first bytes of ``data`` and is extended in place.
        """
        last = [] if last is None else last
        ids, longest, follows = self.ids, self.longest, self.follows
        for end in range(len(last) + 1, len(data) + 1):
            for start in range(max(0, end - longest), end):
                token = ids.get(data[start:end])
                if token is not None and (start == 0 or follows(last[start - 1], token)):
                    last.append(token)
                    break
            else:
                raise ValueError("a byte has no token")
        return last

    def walk(self, data: bytes, last: list[int], end: int | None = None) -> tuple[int, ...]:
        """The encoding of ``data[:end]`` from its stored last tokens."""
        end = len(data) if end is None else end
        out, size = [], self.size
        while end:
            out.append(last[end - 1])
            end -= size(last[end - 1])
        return tuple(reversed(out))

    @lru_cache(maxsize=None)  # noqa: B019  one entry per token at most
    def size(self, token: int) -> int:
        """Bytes of a token."""
        a = self.parts.get(token)
        return 1 if a is None else self.size(a[0]) + self.size(a[1])

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8", "replace")
        whole = self.ids.get(data)
        if whole is not None and (whole not in self.parts or self.prefixes(data)[-1] == whole):
            return (whole,)
        return self.walk(data, self.prefixes(data))

    def encode(self, text: str) -> list[int]:
        """The ids of ``text`` without special tokens; strings that look like such are ordinary text."""
        memo = self.memo
        return [i for piece in split(text) for i in memo[piece]]

    def counts(self, pieces: list[str]) -> list[int]:
        """Tokens of each of the ``pieces`` of a split text."""
        return list(map(len, map(self.memo.__getitem__, pieces)))


class Table(dict):
    """Pieces seen before and the rows of their encodings in one flat array, to encode many at once."""

    def __init__(self, bpe: PrefixBPE) -> None:
        self.bpe = bpe
        self.renew()

    def renew(self) -> None:
        """Forget everything once there is more than a bound; called between batches only."""
        self.clear()
        self.flat, self.starts, self.sizes = array("i"), array("q"), array("q")

    def __missing__(self, piece: str) -> int:
        found = self.bpe.encode_piece(piece)
        self[piece] = row = len(self.starts)
        self.starts.append(len(self.flat))
        self.sizes.append(len(found))
        self.flat.extend(found)
        return row

    def rows(self, pieces: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces))

    def counts(self, rows: np.ndarray) -> np.ndarray:
        """Tokens of each piece."""
        return np.array(self.sizes, np.int64)[rows]

    def ids(self, rows: np.ndarray) -> np.ndarray:
        """The ids of the pieces, one after the other."""
        if not len(rows):
            return np.array([], np.int32)
        sizes = np.array(self.sizes, np.int64)[rows]
        shift = np.array(self.starts, np.int64)[rows] - np.cumsum(sizes) + sizes
        return np.array(self.flat, np.int32)[np.repeat(shift, sizes) + np.arange(sizes.sum())]


class _Memo(dict):
    """Encodings of pieces seen before. Long pieces are not kept."""

    def __init__(self, bpe: PrefixBPE) -> None:
        self.bpe = bpe

    def __missing__(self, piece: str) -> tuple[int, ...]:
        found = self.bpe.encode_piece(piece)
        if len(piece) <= 64:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = found
        return found


class Encoding:
    """A text with the last tokens of all prefixes of its pieces, for exact appends and edits.

    ``append`` and ``replace`` give the same ids as encoding the whole new text; pieces before the change
    keep their stored prefixes, and the piece in which it falls is continued from its last unchanged byte.
    """

    def __init__(self, bpe: PrefixBPE, text: str = "") -> None:
        self.bpe, self.text, self.pieces, self.last = bpe, "", [], []
        self.computed = 0
        self.append(text)

    def append(self, text: str) -> Encoding:
        return self.replace(len(self.text), len(self.text), text)

    def replace(self, start: int, end: int, text: str) -> Encoding:
        """Put ``text`` in the place of ``self.text[start:end]``."""
        keep, at = 0, 0
        # a split looks one character past white space, so the piece before the change may change too
        while keep < len(self.pieces) and at + len(self.pieces[keep]) < start:
            at += len(self.pieces[keep])
            keep += 1
        while keep and self.pieces[keep - 1].isspace():
            keep -= 1
            at -= len(self.pieces[keep])
        new = self.text[:start] + text + self.text[end:]
        tail: dict[int, int] = {}
        place = len(self.text)
        for k in range(len(self.pieces) - 1, keep - 1, -1):
            place -= len(self.pieces[k])
            if place < end:
                break
            tail[len(self.text) - place] = k
        pieces, last, pattern = self.pieces[:keep], self.last[:keep], splitter(0x10FFFF)
        first = True
        while at < len(new):
            k = tail.get(len(new) - at)
            if k is not None:  # from here on the old pieces hold again
                pieces += self.pieces[k:]
                last += self.last[k:]
                break
            piece = pattern.match(new, at).group()
            data, stored = piece.encode("utf-8", "replace"), None
            if first and keep < len(self.pieces):
                old = self.pieces[keep].encode("utf-8", "replace")
                same = next((i for i, (x, y) in enumerate(zip(old, data)) if x != y), min(len(old), len(data)))
                stored = self.last[keep][:same]
            self.computed += len(data) - len(stored or ())
            last.append(self.bpe.prefixes(data, stored))
            pieces.append(piece)
            at += len(piece)
            first = False
        self.text, self.pieces, self.last = new, pieces, last
        return self

    @property
    def ids(self) -> list[int]:
        return [i for p, last in zip(self.pieces, self.last) for i in self.bpe.walk(p.encode("utf-8", "replace"), last)]


@lru_cache(maxsize=2)
def load(vocabulary: str = VOCABULARY) -> PrefixBPE:
    """The vocabulary, once per Python worker."""
    return PrefixBPE(vocabulary)
