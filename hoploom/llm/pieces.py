"""Pre-tokenisation with a bounded cache of encoded pieces, shared by the tokenising operators."""

from __future__ import annotations

from collections.abc import Callable

import re

import numpy as np
import regex

#: What the public byte-level pattern is on texts of ASCII characters alone; the standard library runs it twice as fast.
ASCII_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"""


class PieceEncoder:
    """Texts to ids, piece by piece.

    ``encode_new`` takes a list of distinct pieces and gives their ids as
    little-endian unsigned 32-bit bytes. A worker keeps at most ``max_cached``
    pieces; beyond that the cache starts anew, which changes time, not results.
    ``ascii_pattern`` must cut texts of ASCII characters as ``pattern`` does.
    """

    def __init__(self, pattern: str, encode_new: Callable[[list[str]], list[bytes]], max_cached: int = 400_000, max_piece: int = 64, ascii_pattern: str | None = None):
        self._find = regex.compile(pattern).findall
        self._find_ascii = re.compile(ascii_pattern).findall if ascii_pattern else self._find
        self._encode_new = encode_new
        self._cache: dict[str, bytes] = {}
        self._max_cached, self._max_piece = max_cached, max_piece

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self._find_ascii(text) if text.isascii() else self._find(text) for text in texts]
        if len(self._cache) > self._max_cached:
            self._cache = {}
        cache = self._cache
        new: set[str] = set()
        for pieces in split:
            new.update(pieces)
        fresh = [piece for piece in new if piece not in cache]
        local = {}
        for piece, ids in zip(fresh, self._encode_new(fresh) if fresh else [], strict=True):
            # Very long pieces hardly come back; they are used and dropped.
            (cache if len(piece) <= self._max_piece else local)[piece] = ids
        if local:
            return [b"".join([cache[p] if p in cache else local[p] for p in pieces]) for pieces in split]
        return [b"".join(map(cache.__getitem__, pieces)) for pieces in split]


LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4


class PieceCutter:
    """Cuts texts as the public byte-level pattern does, all texts of a slice side by side.

    A piece begins where the kind of character changes, except after a blank, which belongs to what follows;
    of white space before something else the last character is apart; an apostrophe that begins a piece takes
    the letters of a contraction. ``kinds_of`` gives the kinds of the characters of a string; every character
    is asked for once.
    """

    def __init__(self, kinds_of: Callable[[str], np.ndarray]):
        self._kinds_of = kinds_of
        self._kind = np.zeros(0x110000, dtype=np.uint8)

    def cut(self, texts: list[str]):
        """The pieces of all texts one after another, as an Arrow array, and the places in it where texts begin and end."""
        import pyarrow as pa

        text = "".join(texts)
        points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
        ends = np.cumsum([len(x) for x in texts], dtype=np.int64)
        places = np.flatnonzero(self._begins(points, np.unique(ends[ends > 0])))
        offsets = np.append(places, len(points))
        if not text.isascii():
            width = (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000) + 1
            offsets = np.append(0, np.cumsum(width, dtype=np.int64))[offsets]
        pieces = pa.LargeStringArray.from_buffers(len(places), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(text.encode()))
        return pieces, np.searchsorted(places, np.append(0, ends))

    def _begins(self, points: np.ndarray, ends: np.ndarray) -> np.ndarray:
        kind = self._kind[points]
        if not kind.all():
            new = np.unique(points[kind == 0])
            self._kind[new] = self._kinds_of(new.tobytes().decode("utf-32-le"))
            kind = self._kind[points]
        starts = np.append(0, ends)[:-1]
        first = np.ones(len(points), dtype=bool)
        first[1:] = kind[1:] != kind[:-1]
        first[starts] = True
        blank_before = np.zeros(len(points), dtype=bool)
        blank_before[1:] = points[:-1] == ord(" ")
        blank_before[starts] = False
        space = kind == SPACE
        last = np.zeros(len(points), dtype=bool)
        last[:-1] = ~space[1:]
        last[ends - 1] = False
        begins = np.where(space, first | last, first & ~blank_before)
        at = np.flatnonzero(begins & (points == ord("'")))
        left = ends[np.searchsorted(ends, at, side="right")] - at
        one, two = (np.where(left > k, points[np.minimum(at + k, len(points) - 1)], 0) for k in (1, 2))
        size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 2, 0)
        for a, b in ("re", "ve", "ll"):
            size[(one == ord(a)) & (two == ord(b))] = 3
        at, left, size = at[size > 0], left[size > 0], size[size > 0]
        begins[at + 1] = False
        begins[(at + size)[size < left]] = True
        return begins


class SliceEncoder:
    """Texts to ids, each distinct piece of a slice of texts once.

    ``encode_new`` is as for ``PieceEncoder``. A worker keeps the pieces met lately: when half of ``max_cached``
    are new since the last time, those that did not come back since are dropped, which changes time, not results.
    """

    def __init__(self, cutter: PieceCutter, encode_new: Callable[[list[str]], list[bytes]], max_cached: int = 600_000, max_piece: int = 64):
        self._cutter, self._encode_new = cutter, encode_new
        self._recent: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._max_recent, self._max_piece = max_cached // 2, max_piece

    def encode(self, texts: list[str]) -> list[bytes]:
        pieces, cuts = self._cutter.cut(texts)
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self._recent) > self._max_recent:
            self._recent, self._older = {}, self._recent
        recent, older = self._recent, self._older
        found = list(map(recent.get, distinct))
        missing = [k for k, ids in enumerate(found) if ids is None]
        fresh = []
        for k in missing:
            if (ids := older.get(distinct[k])) is None:
                fresh.append(k)
            else:
                found[k] = recent[distinct[k]] = ids
        for k, ids in zip(fresh, self._encode_new([distinct[k] for k in fresh]) if fresh else [], strict=True):
            found[k] = ids
            # Very long pieces hardly come back.
            if len(distinct[k]) <= self._max_piece:
                recent[distinct[k]] = ids
        ids_of = np.empty(len(found), dtype=object)
        ids_of[:] = found
        ids_in_order = ids_of[coded.indices.to_numpy()].tolist()
        return [b"".join(ids_in_order[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
