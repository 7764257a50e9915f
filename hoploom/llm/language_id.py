"""Language identification by cross-parsing entropy.

For every language a suffix automaton holds all substrings of its training
text. A text is parsed into the longest phrases that occur in that text; with c
phrases over n characters and a training text of m characters the entropy
estimate is c log2(m) / n bits a character, and the language with the least
wins.

Every letter of the training texts has a code of its own. The automaton's rows
are sparse, so they are laid over each other in one array: a state's row begins
at its offset, each entry names the state that it belongs to, and one step is
one lookup however large the alphabet is. Where no transition leads on, a new
phrase begins with the character. Texts are parsed in windows of ``window``
characters side by side; a window's start begins a phrase in every language
alike.

Training is bounded in rows and characters a language, not in the number of
languages: of each, at most ``train_docs`` distinct texts, chosen by hash, are
learned, each of them whole, as long as they have at most ``train_chars``
characters together. Texts of more than that come last and by length, so a
language that has no other learns one of them, whole: the shortest text of its
sample. An automaton takes about 600 bytes a character while it is built and 50
afterwards. Scoring reads whole texts, however long.

Defined results: texts that are null or hold no letter are ``und`` with score
0; so is every text if nothing can be learned; ties go to the first language by
name; repeated texts score alike; very long texts are parsed whole; extra columns
are kept, and a column that has the name of a result keeps it: the result then
gets the next free name with an underscore. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import arrow_slices, free_name, held_out, table

UNKNOWN = "und"
_TOP = 0x110000


@dataclass(frozen=True)
class LanguageModel:
    """Training text per language, normalised; small enough to go with the tasks."""

    texts: tuple[tuple[str, str], ...]
    window: int = 512


def normalise(text: str) -> str:
    """Lower case, everything but letters a single blank."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def build_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Suffix automaton of ``codes``: by state, code -> state."""
    edges: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        state = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in edges[p]:
            edges[p][c] = state
            p = link[p]
        if p != -1:
            q = edges[p][c]
            if length[p] + 1 == length[q]:
                link[state] = q
            else:
                copy = len(edges)
                edges.append(dict(edges[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and edges[p].get(c) == q:
                    edges[p][c] = copy
                    p = link[p]
                link[q] = link[state] = copy
        last = state
    return edges


def lay_rows(rows: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, entries): the entry of state s and code c is entries[offsets[s] + c] = s << 32 | target; other entries are of another state or -1."""
    order = sorted((s for s, row in enumerate(rows) if row), key=lambda s: -len(rows[s]))
    size = 1 << max(4, (2 * sum(map(len, rows))).bit_length())
    while True:
        taken, offsets, at = bytearray(size + width), np.zeros(len(rows), dtype=np.int64), 0
        for s in order:
            for _ in range(10_000):
                at = (at + 0x9E3779B1) % size
                for c in rows[s]:
                    if taken[at + c]:
                        break
                else:
                    break
            else:
                break
            offsets[s] = at
            for c in rows[s]:
                taken[at + c] = 1
        else:
            break
        size *= 2
    entries = np.full(size + width, -1, dtype=np.int64)
    lengths = [len(row) for row in rows]
    state = np.repeat(np.arange(len(rows)), lengths)
    code = np.fromiter((c for row in rows for c in row), dtype=np.int64, count=len(state))
    target = np.fromiter((t for row in rows for t in row.values()), dtype=np.int64, count=len(state))
    entries[offsets[state] + code] = state << 32 | target
    return offsets, entries


class CrossParser:
    """Counts phrases of many texts against all languages of a model."""

    def __init__(self, model: LanguageModel):
        self.window = model.window
        self.languages = [name for name, _ in model.texts]
        letters = sorted({c for _, text in model.texts for c in set(text)} - {" "})
        # 0: blank, 1..: letters of the training texts, the last code: letters that no training text has.
        self.width = len(letters) + 2
        self.code_of = np.zeros(_TOP, dtype=np.int32)
        self.code_of[_is_letter()] = self.width - 1
        for k, c in enumerate(letters):
            self.code_of[ord(c)] = k + 1
        self.tables, self.bits = [], []
        for _, text in model.texts:
            rows = build_automaton(self.code_of[_points(text)].tolist())
            # One more state, from which every character begins a phrase; characters the text lacks lead there.
            dead = len(rows)
            begin = np.full(self.width, dead, dtype=np.int64)
            begin[list(rows[0])] = list(rows[0].values())
            self.tables.append((dead, begin, *lay_rows([*rows, {}], self.width)))
            self.bits.append(np.log2(max(2, len(text))))

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a character by text and language, and each text's number of characters as parsed (0: no letter)."""
        points = [_points(t.lower()) for t in texts]
        owner = np.repeat(np.arange(len(texts)), [len(p) for p in points])
        codes = self.code_of[np.concatenate(points)] if points else np.zeros(0, dtype=np.int32)
        keep = codes > 0
        keep[1:] |= (codes[:-1] > 0) & (owner[1:] == owner[:-1])
        codes, owner = codes[keep], owner[keep]
        letters = np.bincount(owner[codes > 0], minlength=len(texts))
        sizes = np.bincount(owner, minlength=len(texts))
        phrases = np.zeros((len(texts), len(self.tables)))
        if len(codes):
            position = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            starts = np.flatnonzero(position % self.window == 0)
            lengths = np.diff(np.append(starts, len(codes)))
            order = np.argsort(-lengths, kind="stable")
            starts, lengths = starts[order], lengths[order]
            active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
            for k, (dead, begin, offsets, entries) in enumerate(self.tables):
                state = np.full(len(starts), dead, dtype=np.int64)
                count = np.zeros(len(starts), dtype=np.int64)
                for t in range(int(lengths[0])):
                    n = int(active[t])
                    code, at = codes[starts[:n] + t], state[:n]
                    found = entries[offsets[at] + code]
                    new = found >> 32 != at
                    count[:n] += new
                    state[:n] = np.where(new, begin[code], found & 0xFFFFFFFF)
                phrases[:, k] = np.bincount(owner[starts], weights=count, minlength=len(texts))
        used = np.where(letters > 0, sizes, 0)
        return phrases * np.array(self.bits) / np.maximum(1, sizes)[:, None], used

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text; the score is the share of 2^(-bits) over at most 100 characters."""
        if not self.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        entropy, used = self.entropies([t or "" for t in texts])
        best = entropy.argmin(axis=1)
        gap = (entropy - entropy.min(axis=1, keepdims=True)) * np.minimum(used, 100)[:, None]
        score = 1 / np.exp2(-gap).sum(axis=1)
        return [(self.languages[b], float(s)) if n else (UNKNOWN, 0.0) for b, s, n in zip(best.tolist(), score.tolist(), used.tolist(), strict=True)]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(k).isalpha() for k in range(_TOP)), dtype=bool, count=_TOP)


@lru_cache(maxsize=1)
def _parser(model: LanguageModel) -> CrossParser:
    return CrossParser(model)


def fit_language_model(docs: DataFrame, train_docs: int = 24, train_chars: int = 500_000) -> LanguageModel:
    """Learns from (doc_id, text, lang), without the held-out fold.

    The texts are ranked by their hashes and lengths alone; at most ``train_docs``
    hashes a language are sent to the tasks, and no text is cut to fit ``train_chars``.
    """
    usable = docs.where(F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN) & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    hashed = usable.select("lang", F.xxhash64("text").alias("h"), "doc_id", "text", F.length("text").alias("size"))
    # A filter by hash leaves about three times the wanted texts, so that the ranking never sees a whole language.
    counts = hashed.groupBy("lang").agg(F.approx_count_distinct("h").alias("_n"))
    chance = F.pmod(F.xxhash64(F.lit(5), "h"), F.lit(1 << 30)) / float(1 << 30)
    few = hashed.select("lang", "h", "doc_id", "size").join(F.broadcast(counts), "lang").where(chance * F.col("_n") < 3 * train_docs).groupBy("lang", "h").agg(F.min("doc_id").alias("doc_id"), F.min("size").alias("size"))
    order = W.partitionBy("lang").orderBy(F.when(F.col("size") > train_chars, F.col("size")).otherwise(0), "h")
    ranked = few.withColumn("_rank", F.row_number().over(order)).withColumn("_sum", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)))
    ids = ranked.where((F.col("_rank") == 1) | (F.col("_rank") <= train_docs) & (F.col("_sum") <= train_chars)).select("lang", "h", "doc_id")
    sample = hashed.join(F.broadcast(ids), ["lang", "h", "doc_id"], "left_semi").select("lang", "h", "text")
    texts: dict[str, dict[str, None]] = {}
    for row in sorted(sample.collect(), key=lambda r: (r.lang, r.h, r.text)):
        if text := normalise(row.text):
            texts.setdefault(row.lang, {})[text] = None
    return LanguageModel(tuple(sorted((name, " ".join(parts)) for name, parts in texts.items())))


def identify(docs: DataFrame, model: LanguageModel, pred: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """All columns of ``docs`` with the language and its score, named ``pred`` and ``score`` or as ``free_name`` says. One pass, no shuffle."""
    pred, score = free_name(docs, pred), free_name(docs, score)

    def run(batches):
        import pyarrow as pa

        parser = _parser(model)
        for part in arrow_slices(batches, 1000):
            found = parser.predict(part.column("text").to_pylist())
            yield part.append_column(pred, pa.array([x[0] for x in found], pa.string())).append_column(score, pa.array([x[1] for x in found], pa.float64()))

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), f"`{pred}` string", f"`{score}` double"])
    return docs.mapInArrow(run, schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every whole text."""
    docs = table(spark, sf_dir, "documents")
    model = fit_language_model(docs.select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "text", held_out().alias("held_out")), model).select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))
