import random
import re

import numpy as np

from hoploom.llm import text_join as j


def shingles(text, size=5):
    words = re.findall(r"\w+", (text or "").lower())
    if not words:
        return frozenset([text.strip()]) if text and text.strip() else frozenset()
    return frozenset(" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1)))


def brute(rows, threshold=0.8):
    sets = {i: shingles(t) for i, t in rows}
    links = {i: set() for i in sets}
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and len(x & y) >= threshold * len(x | y) - 1e-9:
                links[a].add(b)
                links[b].add(a)
    out = {}
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            for k in links[todo.pop()] - seen:
                seen.add(k)
                todo.append(k)
        out[i] = (min(seen), len(links[i]), min([i] + [k for k in links[i] if sets[k] == sets[i]]))
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(14):
        base = rng.choices(words, k=rng.randint(30, 200))
        for _ in range(rng.randint(1, 7)):
            near = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
                near[rng.randrange(len(near))] = rng.choice(words)
            texts.append(" ".join(near))
    texts += [None, "", "  ", "short text", "Short, text!", "three words here", "!!!", "!!!", "???", "word " * 30000, "word " * 20000, "a b c d e", "a b c d e f"]
    return list(enumerate(texts))


def test_against_brute_force(spark):
    rows = corpus(1)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int").repartition(3)
    want = brute(rows)
    assert len({c for c, _, _ in want.values()}) < len(rows)
    for options in ({}, {"block": 2}, {"recall": 0.9999999}, {"recall": 0.9999999, "block": 2}):
        got = j.similar_texts(df, **options).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.class_id, r.n_links, r.text_class) == want[r.doc_id], (options, r)
            assert r.kept == (r.doc_id == r.class_id)
    assert j.similar_texts(df.limit(0)).count() == 0


def test_repeated_rows_are_copies(spark):
    rows = [(1, "one two three four five six"), (1, "one two three four five six"), (2, "one two three four five six seven"), (3, "nothing alike in here at all"), (None, "one two three four five six")]
    got = {r.doc_id: r for r in j.similar_texts(spark.createDataFrame(rows, "doc_id long, text string"), threshold=0.6).collect()}
    assert (got[1].n_links, got[1].class_id) == (2, 1) and (got[2].n_links, got[2].class_id) == (2, 1)
    assert got[3].n_links == 0 and got[None].n_links == 0 and not got[None].kept


def test_shingles_and_bands():
    texts = ["a b c d e f g", "a b c d e", "", "a b c d e f g", "x y"]
    h, ends = j.shingle_sets(texts)
    starts = [0, *ends[:-1]]
    sets = [set(h[a:b].tolist()) for a, b in zip(starts, ends, strict=True)]
    assert [len(s) for s in sets] == [3, 1, 0, 3, 1] and sets[0] == sets[3] and sets[1] < sets[0]
    bands, rows = j.choose_bands(0.8, 0.999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999
    rng = np.random.default_rng(0)
    hits = 0
    for _ in range(300):
        both, a, b = rng.integers(0, 2**63, 160, dtype=np.uint64), rng.integers(0, 2**63, 20, dtype=np.uint64), rng.integers(0, 2**63, 20, dtype=np.uint64)
        x, y = np.unique(np.concatenate([both, a])), np.unique(np.concatenate([both, b]))
        keys = j.band_hashes(np.concatenate([x, y]), np.array([len(x), len(x) + len(y)]), bands, rows)
        hits += (keys[0] == keys[1]).any()
    assert hits >= 296


def test_intersections():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 50, n)) for n in (5, 1, 30, 40, 17)]
    left, right = np.array([0, 2]), np.array([1, 3, 4])
    for cells in (1, 1 << 20):
        got = j.intersections(sets, left, right, cells)
        assert got.tolist() == [[len(np.intersect1d(sets[a], sets[b])) for b in right] for a in left]


def test_every_size_of_bucket_counts_alike(spark):
    """One large group of near copies and small ones: each pair counts once, in the first band it shares."""
    rng = random.Random(6)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(150):
        near = list(base)
        for _ in range(rng.choice([0, 1, 1, 2])):
            near[rng.randrange(len(near))] = f"v{rng.randrange(40)}"
        rows.append((k, " ".join(near)))
    rows += [(200 + 2 * k + c, " ".join(f"x{k}y{m}" for m in range(40 + c))) for k in range(10) for c in range(2)]
    df, want = spark.createDataFrame(rows, "doc_id long, text string").repartition(4), brute(rows)
    for block in (512, 16):
        assert all((r.class_id, r.n_links, r.text_class) == want[r.doc_id] for r in j.similar_texts(df, recall=0.9999999, block=block).collect())


def test_row_keys(spark):
    rows = [(1, "a", "x"), (1, "a", "y"), (2, "b", "x"), (2, "c", "x"), (None, "d", "x"), (3, None, "x"), (3, "e", "x")]
    got, key = j.row_keys(spark.createDataFrame(rows, "doc_id long, text string, row_key string"))
    assert key == "row_key_" and len(got.columns) == 4
    keys = {(r.doc_id, r.text, r.row_key): r[key] for r in got.collect()}
    assert keys[1, "a", "x"] == keys[1, "a", "y"] == 1 and keys[None, "d", "x"] is None
    assert len({keys[2, "b", "x"], keys[2, "c", "x"], keys[3, None, "x"], keys[3, "e", "x"], 1}) == 5
    once, key = j.row_keys(spark.createDataFrame(rows[:3], "doc_id long, text string, row_key string"))
    assert sorted(r[key] for r in once.collect()) == [1, 1, 2]


def test_ids_of_several_texts_are_judged_text_by_text(spark):
    from hoploom.llm.text_join import similar_documents

    long, other = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    near = long.replace("a39", "z")
    rows = [(1, long), (1, other), (1, other), (2, near), (3, other), (4, "alone and short text of six"), (None, long), (5, None)]
    got = sorted((str(r.doc_id), r.class_id, r.n_links, r.kept) for r in similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    # Text "long" of id 1 comes after id 2, and "other" of id 1 after id 3: the class ids are those of the others.
    assert got == sorted([("1", 2, 1, False), ("1", 3, 2, False), ("1", 3, 2, False), ("2", 2, 1, True), ("3", 3, 2, True), ("4", 4, 0, True), ("None", None, 0, False), ("5", 5, 0, True)])
    unique = spark.createDataFrame([(1, long), (2, near)], "doc_id long, text string")
    assert sorted(tuple(r) for r in similar_documents(unique).collect()) == [(1, 1, 1, 1, True), (2, 1, 1, 2, False)]
