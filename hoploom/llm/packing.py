"""Sum-of-squares online packing of token sequences into fixed windows.

A document is cut into full windows and one remainder. Full windows are
sequences of their own. A remainder goes, in order of arrival, to the fill
level that minimises the sum of squared counts of partially filled windows;
the counts live in a level array, and a level's windows in a stack.

Every Spark partition packs its own documents with its own level array, so the
work is spread as the input is, nothing is shuffled, and a lost task is redone
with the same result. What this costs is at most a few partially filled windows
per partition.

Ids are the tokenizer's. With the public byte-level pattern the texts of a
slice are cut side by side by arrays, and only distinct pieces that the worker
has not met lately go to the tokenizer's merges.

Defined results: a null text counts as empty and yields its end id alone; equal
documents are packed one by one; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import zlib
from functools import lru_cache
from itertools import accumulate

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_slices, table
from .pieces import LETTER, NUMBER, OTHER, SPACE, PieceCutter, SliceEncoder

#: Sequence ids are the partition's number times this, plus a count.
SEQUENCES_PER_PARTITION = 1 << 40
_NO_WINDOW = np.int64(1 << 60)


class SumOfSquaresPacker:
    """Places items of size 1..capacity-1; gives (window, offset) of each."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self._room = np.zeros(capacity + 1, dtype=np.int64)  # open windows by free room
        self.counts = self._room[::-1]  # the same by fill level
        # Minus the windows of a free room; where there are none, more than any choice costs.
        self._loss = np.full(capacity + 1, _NO_WINDOW)
        self._open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.windows = 0

    def new_window(self) -> int:
        self.windows += 1
        return self.windows - 1

    def _add(self, room: int, n: int) -> None:
        self._room[room] += n
        self._loss[room] = -self._room[room] if self._room[room] else _NO_WINDOW

    def place(self, size: int) -> tuple[int, int]:
        room, top = self._room, self.capacity
        # The change of the sum of squares if the item goes to level h < top - size, halved and less 1:
        # N(h + size) - N(h). A new window changes it by 2 N(size) + 1, filling one up by 1 - 2 N(h).
        change = room[1 : top - size] + self._loss[1 + size : top]
        best, level = 2 * int(room[top - size]) + 1, 0
        # On a tie the fuller level, which has less room, is taken.
        if len(change):
            at = int(change.argmin())
            if (least := 2 * int(change[at]) + 2) <= best:
                best, level = least, top - size - 1 - at
        if room[size] and 1 - 2 * int(room[size]) <= best:
            level = top - size
        if level:
            window = self._open[level].pop()
            self._add(top - level, -1)
        else:
            window = self.new_window()
        if level + size < top:
            self._open[level + size].append(window)
            self._add(top - level - size, 1)
        return window, level


def _kinds_of(chars: str) -> np.ndarray:
    """Kinds of characters as the tokenizer's patterns know them; its Unicode tables are its own."""
    from tokenizers import Regex, pre_tokenizers

    out = np.full(len(chars), OTHER, dtype=np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        found = np.ones(len(chars), dtype=bool)
        for _, (start, end) in pre_tokenizers.Split(Regex(pattern), "removed").pre_tokenize_str(chars):
            found[start:end] = False
        out[found] = kind
    return out


def _byte_characters() -> np.ndarray:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is printable, else one from 256 on."""
    out = np.arange(256, dtype="<u4")
    hidden = np.array([*range(33), *range(127, 161), 173])
    out[hidden] = 256 + np.arange(len(hidden))
    return out


@lru_cache(maxsize=2)
def _tokenizer(path: str, pattern: str):
    """Texts to ids by the tokenizer; a byte-level one is asked only once for every distinct piece."""
    import json
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    parts = json.loads(tokenizer.to_str())
    before = parts["pre_tokenizer"] or {}
    byte_level = before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and parts["normalizer"] is None
    if not byte_level or pattern != public_tokenizers.PATTERN:
        return lambda texts: [np.array(x.ids, dtype="<u4").tobytes() for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    merges, characters = Tokenizer(tokenizer.model), _byte_characters()
    vocabulary = merges.get_vocab()
    width = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
    width[list(vocabulary.values())] = [len(token) for token in vocabulary]

    def encode_new(pieces: list[str]) -> list[bytes]:
        # Pieces go to the merges as words, a character a byte; the ids' widths tell where a word ends.
        raw = [piece.encode() for piece in pieces]
        text = characters[np.frombuffer(b"".join(raw), dtype=np.uint8)].tobytes().decode("utf-32-le")
        ends = list(accumulate(map(len, raw)))
        words = [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        # A few thousand words a call: what the tokenizer keeps beside the ids takes many times their room.
        parts = [words[k : k + 4000] for k in range(0, len(words), 4000)]
        ids = np.concatenate([np.array(merges.encode_batch_fast([p], is_pretokenized=True, add_special_tokens=False)[0].ids, dtype="<u4") for p in parts])
        read = np.cumsum(width[ids])
        if not np.isin(ends, read).all():
            raise ValueError("the tokenizer's ids do not give back the text")
        flat, cuts = ids.tobytes(), (4 * np.searchsorted(read, ends, side="right")).tolist()
        return [flat[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]

    encoder = SliceEncoder(PieceCutter(_kinds_of), encode_new)
    specials = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def encode(texts: list[str]) -> list[bytes]:
        special = [any(s in text for s in specials) for text in texts]  # cut at special strings before pieces are made
        out = encoder.encode(["" if is_special else text for text, is_special in zip(texts, special, strict=True)])
        for k in np.flatnonzero(special).tolist():
            out[k] = np.array(tokenizer.encode(texts[k], add_special_tokens=False).ids, dtype="<u4").tobytes()
        return out

    return encode


def pack_documents(docs: DataFrame, path: str, pattern: str, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece: which ids of which document lie where in which sequence."""

    def run(batches):
        import pyarrow as pa

        encode = _tokenizer(path, pattern)
        packer = SumOfSquaresPacker(capacity)
        first = TaskContext.get().partitionId() * SEQUENCES_PER_PARTITION
        end = np.uint32(end_id).astype("<u4").tobytes()
        for part in arrow_slices(batches, 1000):
            rows: list[list] = [[] for _ in range(8)]
            texts = [x or "" for x in part.column(1).to_pylist()]
            for doc_id, ids in zip(part.column(0).to_pylist(), encode(texts), strict=True):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    length = min(capacity, total - start)
                    window, offset = (packer.new_window(), 0) if length == capacity else packer.place(length)
                    piece = ids[4 * start : 4 * (start + length)]
                    for column, value in zip(rows, (doc_id, start, length, zlib.crc32(piece), total, first + window, offset, piece), strict=True):
                        column.append(value)
            kinds = [part.schema.field(0).type, *[pa.int64()] * 6, pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(rows, kinds, strict=True)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pack_with_public_vocabulary(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN).drop("ids")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 2048 tokens."""
    return pack_with_public_vocabulary(table(spark, sf_dir, "documents"))
