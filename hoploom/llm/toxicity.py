"""Toxicity by multiple-instance learning.

A document is a bag of sentences; its label holds for the bag alone. A
sentence's probability is logistic in its words, their prefixes and the
logarithm of the number of sentences beside it; the bag's is the noisy-or of all
its sentences, 1 - prod(1 - p) = 1 - exp(-sum softplus(z)). The weights are
fitted to document labels by full-batch Adam on that likelihood, so the
sentences that explain a label are found on the way; ``locate`` returns them,
and ``with_sentences`` those of every document that is predicted toxic.
Scoring uses the same function as training: the weight of the length is learned
with the others, so that length alone does not make a text toxic.

Training is bounded: ``per_class`` documents of each label, chosen by hash, each
whole; the held-out fold is never used. Scoring reads whole texts.

Defined results: null and empty texts have no sentences and score 0; very long
texts are scored whole, in bounded memory beside the text itself; without labels
of both kinds every score is 0; repeated documents score alike; contradicting
labels of one document count as toxic; extra columns are kept, and a column that
has the name of the score keeps it: the score then gets the next free name with
an underscore. An empty table gives no rows. Sentences are given by offsets into
the text as it is, in order; a document below the threshold has none, and one
that reaches it by many weak sentences has its most probable one (of equals the
first).
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_slices, free_name, held_out, sample_by_hash, table

#: Sentences end at these marks, at line breaks, and after SENTENCE_WORDS words.
_TOKENS = re.compile(r"\w+|[.!?\n]+").findall
_SPANS = re.compile(r"\w+|[.!?\n]+").finditer
SENTENCE_WORDS = 64
PREFIXES = (3, 4, 5)
#: Documents at or above this score are predicted toxic.
THRESHOLD = 0.3


def features_of(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in PREFIXES if len(word) >= k)]


def _is_break(token: str) -> bool:
    return token[0] in ".!?\n"


def _segment(breaks: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Sentence number of each token; ``owner`` is the token's document."""
    n = len(breaks)
    at = np.arange(n)
    first = np.ones(n, dtype=bool)
    first[1:] = breaks[:-1] | (owner[1:] != owner[:-1])
    since = at - np.maximum.accumulate(np.where(first, at, 0))
    return np.cumsum(first | (since % SENTENCE_WORDS == 0)) - 1


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


@dataclass
class ToxicityModel:
    """A bias, the weights of features and of the length; words' weights are cached as they come up."""

    bias: float = -np.inf
    weights: dict[str, float] = field(default_factory=dict)
    length_weight: float = 0.0
    _words: dict[str, float] = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self):
        return {"bias": self.bias, "weights": self.weights, "length_weight": self.length_weight, "_words": {}}

    def _weight(self, token: str) -> float:
        value = np.inf if _is_break(token) else sum(self.weights.get(f, 0.0) for f in features_of(token))
        self._words[token] = value
        return value

    def _scores(self, tokens: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """z of each sentence, its document, and the sentence of each token."""
        if len(self._words) > 200_000:
            self._words.clear()
        words, weigh = self._words, self._weight
        values = np.array([words[t] if t in words else weigh(t) for found in tokens for t in found], dtype=np.float64)
        owner = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
        if not len(values):
            return np.zeros(0), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        breaks = np.isinf(values)
        sentence = _segment(breaks, owner)
        bag = owner[np.flatnonzero(np.diff(sentence, prepend=-1))]
        z = np.bincount(sentence, weights=np.where(breaks, 0.0, values)) + self.bias + self.length_weight * np.log(np.bincount(bag))[bag]
        return z, bag, sentence

    def score(self, texts: list[str | None]) -> list[float]:
        """Noisy-or of each text's sentences."""
        if not np.isfinite(self.bias):
            return [0.0] * len(texts)
        z, owner, _ = self._scores([_TOKENS((t or "").lower()) for t in texts])
        return (-np.expm1(-np.bincount(owner, weights=_softplus(z), minlength=len(texts)))).tolist()

    def locate(self, text: str | None, threshold: float = 0.5) -> list[tuple[int, int, float]]:
        """(start, end, probability) of the sentences at or above ``threshold``; offsets into the text, in code points."""
        return [hit for hit in self._sentences(text) if hit[2] >= threshold]

    def offending(self, text: str | None, threshold: float) -> list[tuple[int, int, float]]:
        """As ``locate``; if no sentence reaches the threshold alone, the most probable one."""
        every = self._sentences(text)
        return [hit for hit in every if hit[2] >= threshold] or sorted(every, key=lambda hit: -hit[2])[:1]

    def _sentences(self, text: str | None) -> list[tuple[int, int, float]]:
        if not text or not np.isfinite(self.bias):
            return []
        lowered = text.lower()
        spans = list(_SPANS(lowered))
        if not spans:
            return []
        z, _, sentence = self._scores([[m.group() for m in spans]])
        first = np.flatnonzero(np.diff(sentence, prepend=-1))
        last = np.append(first[1:], len(spans)) - 1
        # Some letters become longer when lowered; their offsets are taken back to the text.
        at = None if len(lowered) == len(text) else [k for k, c in enumerate(text) for _ in c.lower()] + [len(text)]
        out = []
        for a, b, p in zip(first.tolist(), last.tolist(), (1 / (1 + np.exp(-z))).tolist(), strict=True):
            start, end = spans[a].start(), spans[b].end()
            out.append((start, end, p) if at is None else (at[start], at[end - 1] + 1, p))
        return out


def _association(with_toxic: np.ndarray, with_clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """G statistic of feature presence against the label."""
    n = n_toxic + n_clean
    out = np.zeros(len(with_toxic))
    for seen, of_label in ((with_toxic, n_toxic), (with_clean, n_clean)):
        for cell, share in ((seen, with_toxic + with_clean), (of_label - seen, n - with_toxic - with_clean)):
            expected = share * of_label / n
            out += 2 * np.where(cell > 0, cell * np.log(np.maximum(cell, 1e-9) / np.maximum(expected, 1e-9)), 0.0)
    return out


def fit_bags(texts: list[str], labels: list[int], min_docs: int = 3, min_g: float = 10.0, steps: int = 300, rate: float = 0.1, decay: float = 1e-4, prune: float = 1e-2) -> ToxicityModel:
    """Fits a model to documents and their labels.

    Features in fewer than ``min_docs`` documents are left out, and so are those
    whose presence is associated with the label by a G statistic below ``min_g``.
    """
    labels_ = np.array(labels, dtype=bool)
    if labels_.all() or not labels_.any():
        return ToxicityModel()
    vocabulary: dict[str, int] = {}
    # Only one text's tokens are held as strings at a time.
    coded = [np.array([vocabulary.setdefault(t, len(vocabulary)) for t in _TOKENS(text.lower())], dtype=np.int32) for text in texts]
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(c) for c in coded])
    flat = np.concatenate(coded)
    del coded
    words = list(vocabulary)
    breaks = np.array([_is_break(w) for w in words])
    sentence = _segment(breaks[flat], owner).astype(np.int32)
    bag = owner[np.flatnonzero(np.diff(sentence, prepend=-1))]
    real = ~breaks[flat]
    flat, sentence, token_owner = flat[real], sentence[real], owner[real]
    names: dict[str, int] = {}
    per_word = [array("i", [names.setdefault(f, len(names)) for f in features_of(w)] if not breaks[k] else []) for k, w in enumerate(words)]
    word_of = np.repeat(np.arange(len(words), dtype=np.int32), [len(x) for x in per_word])
    feature_of = np.frombuffer(b"".join(x.tobytes() for x in per_word), dtype=np.int32)
    del per_word
    by_word = np.argsort(word_of, kind="stable")
    starts = np.searchsorted(word_of[by_word], np.arange(len(words) + 1))
    with_toxic, with_clean = np.zeros(len(names), dtype=np.int64), np.zeros(len(names), dtype=np.int64)
    doc_starts = np.searchsorted(token_owner, np.arange(len(texts) + 1))
    for d in range(len(texts)):  # one document's features at a time
        own = np.unique(flat[doc_starts[d] : doc_starts[d + 1]])
        repeats = starts[own + 1] - starts[own]
        at = np.repeat(starts[own] - np.cumsum(repeats) + repeats, repeats) + np.arange(repeats.sum())
        (with_toxic if labels_[d] else with_clean)[np.unique(feature_of[by_word[at]])] += 1
    g = _association(with_toxic, with_clean, int(labels_.sum()), int((~labels_).sum()))
    kept = (with_toxic + with_clean >= min_docs) & (g >= min_g)
    used = kept[feature_of]
    word_of, feature_of = word_of[used], feature_of[used]
    # Tokens without a kept feature weigh nothing; their sentences stay.
    weighty = np.zeros(len(words), dtype=bool)
    weighty[word_of] = True
    real = weighty[flat]
    flat, sentence = flat[real], sentence[real]
    n_sentences, n_docs = len(bag), len(texts)
    w, bias, length_weight = np.zeros(len(names)), -4.0, 0.0
    lengths = np.log(np.maximum(1, np.bincount(bag, minlength=n_docs)))[bag]
    m, v = np.zeros(len(names) + 2), np.zeros(len(names) + 2)
    for step in range(1, steps + 1):
        word_weight = np.bincount(word_of, weights=w[feature_of], minlength=len(words))
        z = bias + length_weight * lengths + np.bincount(sentence, weights=word_weight[flat], minlength=n_sentences)
        total = np.bincount(bag, weights=_softplus(z), minlength=n_docs)
        # d loss / d total: 1 for clean bags, -1 / (e^total - 1) for toxic ones.
        outer = np.where(labels_, -1 / np.expm1(np.clip(total, 1e-6, 50)), 1.0) / n_docs
        inner = outer[bag] / (1 + np.exp(-np.clip(z, -50, 50)))
        by_word = np.bincount(flat, weights=inner[sentence], minlength=len(words))
        gradient = np.append(np.bincount(feature_of, weights=by_word[word_of], minlength=len(names)) + decay * w, [inner.sum(), inner @ lengths])
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        change = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias, length_weight = w - change[:-2], bias - change[-2], length_weight - change[-1]
    return ToxicityModel(float(bias), {f: float(w[k]) for f, k in names.items() if kept[k] and abs(w[k]) >= prune}, float(length_weight))


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 1500) -> ToxicityModel:
    """Learns from (doc_id, text) and (doc_id, toxic), without the held-out fold."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    with_text = docs.where("text <> ''").select("doc_id")
    ids = sample_by_hash(known.join(with_text, "doc_id", "left_semi"), "toxic", per_class)
    sample = docs.where("text <> ''").select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    rows = sorted(sample.select("doc_id", "text", "toxic").collect())
    return fit_bags([r.text for r in rows], [r.toxic for r in rows])


def score_documents(docs: DataFrame, model: ToxicityModel, name: str = "toxic_score") -> DataFrame:
    """All columns of ``docs`` and the score, named ``name`` or, where that is taken, as ``free_name`` says. One pass, no shuffle."""
    shared, name = docs.sparkSession.sparkContext.broadcast(model), free_name(docs, name)

    def run(batches):
        import pyarrow as pa

        for part in arrow_slices(batches, 1000):
            yield part.append_column(name, pa.array(shared.value.score(part.column("text").to_pylist()), pa.float64()))

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), f"`{name}` double"])
    return docs.mapInArrow(run, schema)


def with_sentences(scored: DataFrame, model: ToxicityModel, threshold: float, score: str = "toxic_score", name: str = "sentences") -> DataFrame:
    """All columns of scored documents and the offending sentences of those at or above ``threshold``: an array of start, end and probability. One pass, no shuffle."""
    shared, name = scored.sparkSession.sparkContext.broadcast(model), free_name(scored, name)

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))
        for part in arrow_slices(batches, 1000):
            scores, texts = part.column(score).to_pylist(), part.column("text")
            found = [shared.value.offending(texts[k].as_py(), threshold) if s is not None and s >= threshold else [] for k, s in enumerate(scores)]
            yield part.append_column(name, pa.array([[dict(zip(("start", "end", "probability"), hit, strict=True)) for hit in hits] for hits in found], kind))

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in scored.schema.fields), f"`{name}` array<struct<start: bigint, end: bigint, probability: double>>"])
    return scored.mapInArrow(run, schema)


def locate_sentences(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """One row per offending sentence of the documents that are predicted toxic: doc_id, start, end, probability."""
    found = with_sentences(score_documents(docs.select("doc_id", "text"), model), model, threshold)
    return found.select("doc_id", F.explode("sentences").alias("s")).select("doc_id", "s.*")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every whole text, and of the toxic ones the offending sentences."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    found = with_sentences(score_documents(docs.withColumn("held_out", held_out()), model), model, THRESHOLD)
    predicted = (F.col("toxic_score") >= THRESHOLD).cast("int").alias("predicted")
    return found.select("doc_id", "held_out", F.col("toxic_score").alias("score"), predicted, F.size("sentences").alias("n_sentences"), "sentences")
