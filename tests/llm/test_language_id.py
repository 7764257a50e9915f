import zlib

import numpy as np

from hoploom.llm import language_id as li

TRAIN = {"aa": "the cat sat on the mat and the dog ran to the cat", "bb": "el gato se sento en la mesa y el perro corrio al gato", "cc": "der hund lief über die straße und die katze schlief"}


def phrases(text, train, window):
    """Longest-match phrases by trying substrings, in windows as parsed."""
    clean = li.normalise(text)
    chars, out = [], []
    for c in (x if x.isalpha() else " " for x in text.lower()):
        if c != " " or chars and chars[-1] != " ":
            chars.append(c)
    text, count = "".join(chars), 0
    for start in range(0, len(text), window):
        part, k = text[start : start + window], 0
        while k < len(part):
            n = 1
            while k + n < len(part) + 0 and part[k : k + n + 1] in train:
                n += 1
            count, k = count + 1, k + n
    return count, len(text), clean, out


def test_entropy_against_brute_force():
    for window in (7, 512):
        model = li.LanguageModel(tuple(TRAIN.items()), window=window)
        parser = li.CrossParser(model)
        texts = ["the dog and the cat", "  El PERRO!! corrio", "zzz qqq", "über 12 die", "x", "", "... 1", "the cat " * 300, "漢字 the"]
        entropy, used = parser.entropies(texts)
        for i, text in enumerate(texts):
            for k, train in enumerate(TRAIN.values()):
                count, n, _, _ = phrases(text, train, window)
                if used[i]:
                    assert used[i] == n
                    assert np.isclose(entropy[i, k], count * np.log2(len(train)) / n), (text, k)
    assert [x[0] for x in parser.predict(["the dog", None, "", "12 !", "el perro en la mesa", "die straße"])] == ["aa", "und", "und", "und", "bb", "cc"]


def test_query_shape(spark):
    rows = [(i, text, lang, "s") for i, (lang, text) in enumerate(list(TRAIN.items()) * 8)] + [(100, None, "aa", "s"), (101, "", None, "s"), (102, "der hund " * 30000, None, None), (103, "the cat", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    model = li.fit_language_model(df)
    assert [name for name, _ in model.texts] == ["aa", "bb", "cc"]
    fold = [r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert fold and {r.doc_id for r in df.where(li.held_out()).collect()} == set(fold)
    got = {r.doc_id: r for r in li.identify(df, model).collect()}
    assert [got[i].lang_pred_ for i in (0, 1, 2, 100, 101, 102, 103)] == ["aa", "bb", "cc", "und", "und", "cc", "aa"]
    assert got[100].lang_pred == "s" and got[103].lang_pred is None  # the given column is kept
    assert li.identify(df.limit(0), model).count() == 0
    nothing = li.fit_language_model(df.limit(0))
    assert {r.lang_pred_ for r in li.identify(df, nothing).collect()} == {"und"}


def test_languages_of_a_large_script(spark):
    """Two languages of 800 words each from one script's 900 letters, none of them frequent, and a third of few letters."""
    rng = np.random.default_rng(3)
    script = [chr(0x4E00 + k) for k in range(900)]
    words = {lang: ["".join(rng.choice(letters, 2)) for _ in range(800)] for lang, letters in (("xa", script), ("xb", script), ("xc", list("abcdefgh")))}

    def prose(lang, n):
        return "".join(rng.choice(words[lang], n))

    model = li.LanguageModel(tuple((lang, prose(lang, 3000)) for lang in words))
    texts = [(lang, prose(lang, 30)) for lang in words for _ in range(30)]
    assert [x[0] for x in li.CrossParser(model).predict([t for _, t in texts])] == [lang for lang, _ in texts]
    parser = li.CrossParser(model)
    for text in (texts[0][1], "ж" * 9):  # the second in letters that no language has: every one is a phrase
        entropy, _ = parser.entropies([text])
        assert np.allclose(entropy[0], [phrases(text, train, 512)[0] * np.log2(6000) / len(text) for _, train in model.texts])


def test_sample_is_of_whole_distinct_texts_and_of_all_languages(spark):
    copies = [(k, "copied text " * 400, "aa") for k in range(200)]
    others = [(1000 + k, f"{chr(97 + k % 26)}{chr(97 + k // 26)}word " * 400, "aa") for k in range(40)]
    many = [(2000 + 8 * k + j, f"l{k}", f"l{k:03d}") for k in range(260) for j in range(8)]
    df = spark.createDataFrame([*copies, *others, *many], "doc_id long, text string, lang string")
    texts = dict(li.fit_language_model(df, train_docs=50).texts)
    kept = [t for k, t, _ in others if zlib.crc32(str(k).encode()) % 4 != 2]
    assert len(texts["aa"]) == len(" ".join([*(t.strip() for t in kept), copies[0][1].strip()]))  # each whole, copies once
    assert all(t.strip() in texts["aa"] for t in kept) and texts["aa"].count("copied") == 400
    assert len(texts) == 261
    few = dict(li.fit_language_model(df, train_docs=5).texts)
    assert sum(t.strip() in few["aa"] for t in [*kept, copies[0][1]]) == 5


def test_sample_is_bounded_in_characters(spark):
    """Texts are taken whole while they fit; a language of longer texts learns its shortest, whole."""
    ids = [k for k in range(100) if zlib.crc32(str(k).encode()) % 4 != 2]
    short = [(ids[k], f"{chr(97 + k)}word " * 20, "aa") for k in range(12)]
    long = [(ids[20 + k], f"{chr(97 + k)}text " * n, "bb") for k, n in enumerate((900, 300, 500))]
    both = [(ids[30], "tail " * 400, "cc"), (ids[31], "head " * 10, "cc")]
    df = spark.createDataFrame([*short, *long, *both], "doc_id long, text string, lang string")
    texts = dict(li.fit_language_model(df, train_chars=600).texts)
    assert len(texts["aa"].split()) == 20 * 5 and sum(t.strip() in texts["aa"] for _, t, _ in short) == 5
    assert texts["bb"] == long[1][1].strip()
    assert texts["cc"] == both[1][1].strip()
    whole = dict(li.fit_language_model(df).texts)
    assert all(t.strip() in whole[lang] for _, t, lang in [*short, *long, *both])
