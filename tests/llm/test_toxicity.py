import math
import random

from hoploom.llm import toxicity as t


def corpus(n, rng):
    words = [a + b for a in ("ba", "lo", "mi", "ter", "un") for b in ("na", "ri", "tas", "vo")]
    texts, labels = [], []
    for k in range(n):
        sentences = [" ".join(rng.choices(words, k=rng.randint(3, 12))) for _ in range(rng.randint(2, 20))]
        if k % 3 == 0:
            at = rng.randrange(len(sentences))
            sentences[at] += f" {rng.choice(['vilething', 'viler'])} {rng.choice(words)}"
        texts.append(". ".join(sentences) + ".")
        labels.append(int(k % 3 == 0))
    return texts, labels


def test_learns_bags_and_locates_sentences():
    rng = random.Random(2)
    model = t.fit_bags(*corpus(300, rng))
    texts, labels = corpus(200, rng)
    scores = model.score(texts)
    assert sum((s >= t.THRESHOLD) == bool(y) for s, y in zip(scores, labels, strict=True)) >= 196
    text = next(x for x, y in zip(texts, labels, strict=True) if y)
    hits = model.locate(text)
    assert hits and all("vile" in text[a:b] for a, b, _ in hits)


def test_noisy_or_by_hand():
    model = t.ToxicityModel(bias=-2.0, weights={"bad": 3.0, "wor*": 1.0})
    sentences = [[0.0, 3.0], [1.0 + 3.0], [0.0] * 64, [3.0]]
    text = "ok bad. word bad! " + "x " * 64 + "bad"
    keep = math.prod(1 - 1 / (1 + math.exp(2.0 - sum(s))) for s in sentences)
    assert abs(model.score([text])[0] - (1 - keep)) < 1e-9


def test_noisy_or_of_random_bags():
    """Every sentence counts, those of small probabilities too, with the length's weight."""
    rng = random.Random(8)
    weights = {f"w{k}x": rng.uniform(-1, 2) for k in range(30)}
    for bias, length_weight in ((-3.1, 0.0), (-2.0, -0.7), (-5.0, 0.2)):
        model = t.ToxicityModel(bias=bias, weights=weights, length_weight=length_weight)
        bags = [[[rng.choice(list(weights)) for _ in range(rng.randint(1, 5))] for _ in range(n)] for n in (1, 2, 7, 200)]
        bags.append([["none"]] * 200)  # all below 0.05
        for bag, score in zip(bags, model.score([". ".join(" ".join(s) for s in bag) for bag in bags]), strict=True):
            z = [bias + length_weight * math.log(len(bag)) + sum(weights.get(w, 0) for w in s) for s in bag]
            assert abs(score - (1 - math.prod(1 - 1 / (1 + math.exp(-x)) for x in z))) < 1e-9
    assert t.ToxicityModel(bias=-3.1).score(["word. " * 200])[0] > 0.999


def test_long_clean_documents_stay_clean():
    rng = random.Random(5)
    texts, labels = corpus(300, rng)
    model = t.fit_bags(texts + [" ".join(rng.choices(texts, k=40)).replace("vilething", "bana").replace("viler", "bana") for _ in range(20)], labels + [0] * 20)
    long_clean = [" ".join(rng.choices(texts, k=60)).replace("vilething", "bana").replace("viler", "bana") for _ in range(10)]
    assert max(model.score(long_clean)) < t.THRESHOLD <= min(model.score([x + " you vilething bana." for x in long_clean]))


def test_offsets_are_those_of_the_text():
    """Also where lowering makes a letter longer, and for sentences by hand."""
    model = t.ToxicityModel(bias=-2.0, weights={"bad": 5.0})
    for text in ("ok. this is bad. fine", "\u0130\u0130\u0130\u0130 ok. this is bad. fine", "\u0130. bad\u0130 Bad! \u0130", "BAD", "x " * 70 + "bad"):
        hits = model.locate(text)
        assert len(hits) == 1 and "bad" in text[hits[0][0] : hits[0][1]].lower(), text
        assert all(0 <= a < b <= len(text) for a, b, _ in model.locate(text, 0.0))
    assert model.locate("\u0130\u0130\u0130\u0130 ok. this is bad. fine")[0][:2] == (9, 21)
    assert [text for a, b, _ in model.locate("ok. this is bad. fine", 0.0) for text in ["ok. this is bad. fine"[a:b]]] == ["ok.", "this is bad.", "fine"]


def test_many_weak_sentences_give_the_most_probable():
    model = t.ToxicityModel(bias=-2.5, weights={"odd": 0.5})
    text = "one. two. odd one. four. " * 2
    assert model.score([text])[0] >= t.THRESHOLD and not model.locate(text, t.THRESHOLD)
    (start, end, p), = model.offending(text, t.THRESHOLD)
    assert text[start:end] == "odd one." and start == 10 and abs(p - 1 / (1 + math.exp(2.0))) < 1e-9
    assert model.offending("", 0.3) == model.offending(None, 0.3) == model.offending("?", 2.0)[1:] == []


def test_query_edges(spark):
    rng = random.Random(4)
    texts, labels = corpus(240, rng)
    rows = [(i, x, 0.5) for i, x in enumerate(texts)] + [(900, None, 0.0), (901, "", 0.0), (902, "clean word " * 60000, 0.0), (903, "lona. viler. " + "miri " * 20000, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic_score double")
    marks = spark.createDataFrame([*enumerate(labels), (0, 1), (1, None), (None, 1)], "doc_id long, toxic int")
    model = t.fit_toxicity(docs, marks)
    scored = t.score_documents(docs, model).collect()
    assert all(r.toxic_score in (0.5, 0.0) for r in scored)  # the given column is kept
    got = {r.doc_id: r.toxic_score_ for r in scored}
    assert got[900] == got[901] == 0.0 and got[902] < 0.3 and got[903] > 0.5
    hits = t.locate_sentences(docs, model).collect()
    toxic = {i for i, score in got.items() if score >= t.THRESHOLD}
    assert {r.doc_id for r in hits} == toxic >= {903}
    whole = dict((r[0], r[1]) for r in rows)
    assert all("vile" in whole[r.doc_id][r.start : r.end] for r in hits if r.probability >= t.THRESHOLD)
    assert [(r.start, r.end) for r in hits if r.doc_id == 903] == [(6, 12)]
    nothing = t.fit_toxicity(docs, marks.limit(0))
    assert {r.toxic_score_ for r in t.score_documents(docs, nothing).collect()} == {0.0}
    assert t.score_documents(docs.limit(0), model).count() == 0
