"""Byte-level BPE encoding and decoding by length-bucketed padded numpy matrices.

Pieces of similar byte length form one matrix of ids. In every round each row
merges its leftmost pair of minimum rank: ranks of adjacent pairs come from a
hash table of pairs, a merge replaces the left id, closes the gap by
compaction and looks up only the two pairs it changed. Rows without a mergeable
pair leave the matrix.

A piece of ``LONG`` bytes or more is a row of its own, and one round takes all
the merges of the minimum rank that the rounds one by one would take in
succession: from the left, up to the first that makes a pair of a lower rank.
There are then at most about as many rounds as ranks that occur, however long
the piece is.

Defined results: null and empty texts have no ids; any other text, however
long, is encoded whole; equal texts have equal ids; extra columns are ignored
by the query.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_slices, table
from .pieces import ASCII_PATTERN, PieceEncoder

_NONE = np.int32(2**31 - 1)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.int64(-1)
LONG = 2048


class PairTable:
    """Open-addressing hash table from (left id, right id) to the merged id."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(left)) * 3))))
        self._shift, self._mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self._keys = np.full(1 << bits, _EMPTY, dtype=np.int64)
        self._values = np.full(1 << bits, _NONE, dtype=np.int32)
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slots, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            # Of the keys that want one free slot the last written wins; the others probe on.
            free = self._keys[slots[todo]] == _EMPTY
            self._keys[slots[todo[free]]] = keys[todo[free]]
            placed = self._keys[slots[todo]] == keys[todo]
            self._values[slots[todo[placed]]] = merged[todo[placed]]
            todo = todo[~placed]
            slots[todo] = (slots[todo] + 1) & self._mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MULTIPLIER) >> self._shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, which are the ranks; the largest int32 where a pair does not merge or is padding."""
        shape = left.shape
        keys = (left.astype(np.int64).ravel() << 32) | right.astype(np.int64).ravel()
        out = np.full(len(keys), _NONE, dtype=np.int32)
        todo = np.flatnonzero(keys >= 0)
        todo = todo[(keys[todo] & 0xFFFFFFFF) != 0xFFFFFFFF]
        slots = self._slot(keys[todo])
        while len(todo):
            found = self._keys[slots]
            hit = found == keys[todo]
            out[todo[hit]] = self._values[slots[hit]]
            go_on = ~hit & (found != _EMPTY)
            todo, slots = todo[go_on], (slots[go_on] + 1) & self._mask
        return out.reshape(shape)


def _without(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The values but those at sorted places; few places are cut out by slices."""
    if len(places) > 16:
        return np.delete(values, places)
    edges = [-1, *places.tolist(), len(values)]
    return np.concatenate([values[a + 1 : b] for a, b in zip(edges, edges[1:], strict=False)])


class BytePairVocabulary:
    """A rank file: token bytes by id, and the pairs whose concatenation is a token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens: dict[int, bytes] = {i: t for t, i in ranks.items()}
        self._bytes = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        self._pairs = PairTable(np.array(left, dtype=np.int64), np.array(right, dtype=np.int64), np.array(merged, dtype=np.int32))

    @classmethod
    def from_file(cls, path: str) -> BytePairVocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())})

    def encode_pieces(self, pieces: list[str], cells: int = 1 << 20) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit bytes; a matrix has about ``cells`` cells at most."""
        out: list[bytes] = [b""] * len(pieces)
        buckets: dict[int, list[tuple[int, bytes]]] = {}
        for k, piece in enumerate(pieces):
            raw = piece.encode()
            if (rank := self.ranks.get(raw)) is not None:
                out[k] = rank.to_bytes(4, "little")
            elif len(raw) >= LONG:
                out[k] = self._merge_long(self._bytes[np.frombuffer(raw, dtype=np.uint8)]).astype("<u4").tobytes()
            else:
                n = len(raw)
                # Exact lengths up to 16 bytes, then steps of an eighth.
                width = n if n <= 16 else -(-n // (step := 1 << (n.bit_length() - 4))) * step
                buckets.setdefault(width, []).append((k, raw))
        for width, rows in buckets.items():
            per = max(1, cells // max(1, width))
            for start in range(0, len(rows), per):
                part = rows[start : start + per]
                flat = np.frombuffer(b"".join(raw.ljust(width, b"\0") for _, raw in part), dtype=np.uint8).reshape(len(part), width)
                ids = self._bytes[flat]
                lengths = np.array([len(raw) for _, raw in part])
                ids[np.arange(width) >= lengths[:, None]] = -1
                for (k, _), merged in zip(part, self._merge(ids), strict=True):
                    out[k] = merged
        return out

    def _merge(self, ids: np.ndarray) -> list[bytes]:
        n, width = ids.shape
        done = np.full((n, width), -1, dtype=np.int32)
        rows = np.arange(n)
        ranks = self._pairs.ranks(ids[:, :-1], ids[:, 1:]) if width > 1 else np.full((n, 0), _NONE, dtype=np.int32)
        while ranks.shape[1]:
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(ranks)), at]
            live = best != _NONE
            if not live.all():
                done[rows[~live], : ids.shape[1]] = ids[~live]
                ids, ranks, rows, at, best = ids[live], ranks[live], rows[live], at[live], best[live]
            if not len(rows):
                break
            r = np.arange(len(rows))
            ids[r, at] = best
            if len(rows) == 1:  # one long row: plain slices
                a = int(at[0])
                ids = np.concatenate([ids[:, : a + 1], ids[:, a + 2 :]], axis=1)
                ranks = np.concatenate([ranks[:, :a], ranks[:, a + 1 :]], axis=1)
            else:
                columns = np.arange(ids.shape[1] - 1)
                ids = np.take_along_axis(ids, columns + (columns > at[:, None]), axis=1)
                columns = columns[:-1]
                ranks = np.take_along_axis(ranks, columns + (columns >= at[:, None]), axis=1)
            if not ranks.shape[1]:
                break
            before = np.flatnonzero(at > 0)
            ranks[before, at[before] - 1] = self._pairs.ranks(ids[before, at[before] - 1], ids[before, at[before]])
            after = np.flatnonzero(at < ranks.shape[1])
            ranks[after, at[after]] = self._pairs.ranks(ids[after, at[after]], ids[after, at[after] + 1])
        if len(rows):
            done[rows, : ids.shape[1]] = ids
        counts = (done >= 0).sum(axis=1)
        flat = done[done >= 0].astype("<u4").tobytes()
        ends = np.cumsum(counts) * 4
        return [flat[e - 4 * c : e] for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]

    def _merge_long(self, ids: np.ndarray) -> np.ndarray:
        ranks = self._pairs.ranks(ids[:-1], ids[1:])
        while len(ranks):
            best = ranks.min()
            if best == _NONE:
                break
            at = np.flatnonzero(ranks == best)
            if len(at) > 1:
                at = self._in_succession(ids, at, best)
            ids[at] = best
            ids, ranks = _without(ids, at + 1), _without(ranks, at)
            # Every merge before has moved a place to the left by one.
            at = at - np.arange(len(at))
            changed = np.unique(np.concatenate([at - 1, at]))
            changed = changed[(changed >= 0) & (changed < len(ranks))]
            ranks[changed] = self._pairs.ranks(ids[changed], ids[changed + 1])
        return ids

    def _in_succession(self, ids: np.ndarray, at: np.ndarray, best: np.int32) -> np.ndarray:
        """Of the places of the minimum rank those that are merged one after another before any pair of a lower rank arises."""
        # Places in a row overlap: of each run the first, the third and so on.
        k = np.arange(len(at))
        begins = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) > 1, k, 0))
        at = at[(k - begins) % 2 == 0]
        # The neighbours when a place's turn comes: on its left what was merged just before, on its right what was there.
        left = np.where(np.diff(at, prepend=-3) == 2, best, ids[np.maximum(at - 1, 0)])
        right = ids[np.minimum(at + 2, len(ids) - 1)]
        merged = np.full(len(at), best, dtype=ids.dtype)
        lower = ((at > 0) & (self._pairs.ranks(left, merged) < best)) | ((at + 2 < len(ids)) & (self._pairs.ranks(merged, right) < best))
        return at[: int(lower.argmax()) + 1] if lower.any() else at

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=2)
def _codec(path: str, pattern: str) -> tuple[BytePairVocabulary, PieceEncoder]:
    vocabulary = BytePairVocabulary.from_file(path)
    import public_tokenizers

    return vocabulary, PieceEncoder(pattern, vocabulary.encode_pieces, ascii_pattern=ASCII_PATTERN if pattern == public_tokenizers.PATTERN else None)


def encode_texts(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, ``ids`` (little-endian unsigned 32-bit, binary). One pass, no shuffle."""

    def run(batches):
        import pyarrow as pa

        _, encoder = _codec(path, pattern)
        for part in arrow_slices(batches, 1000):
            ids = encoder.encode([x or "" for x in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], names=[id_col, "ids"])

    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {dict(df.dtypes)[id_col]}, ids binary")


def digest_ids(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """Decodes the ids again; per row the number of ids and the digests of the ids and of the decoded bytes."""

    def run(batches):
        import pyarrow as pa

        vocabulary, _ = _codec(path, pattern)
        for part in arrow_slices(batches, 1000):
            ids = part.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(vocabulary.decode(x)).hexdigest() for x in ids]),
                ],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return encoded.select(id_col, "ids").mapInArrow(run, f"{id_col} {dict(encoded.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text and their decoding, as digests."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return digest_ids(encode_texts(table(spark, sf_dir, "documents"), path, pattern), path, pattern)
