import random

import numpy as np
import public_tokenizers as P
import pytest

from hoploom.llm.toxicity import THRESHOLD, fit_toxicity

from .test_text_join import brute

pipeline = pytest.importorskip("corpus_pipeline")


def corpus():
    rng = random.Random(9)
    words = [f"{a}{b}{c}" for a in ("ba", "lo", "mi", "ter") for b in ("na", "ri", "tas") for c in ("", "le", "so")]
    rows, marks = [], []
    for k in range(220):
        text = ". ".join(" ".join(rng.choices(words, k=12)) for _ in range(6)) + "."
        if k % 5 == 0:
            text += " you vilething " + rng.choice(words)
        rows.append((k, text, "aa"))
        marks.append((k, int(k % 5 == 0)))
    near = rows[1][1].replace("bana", "lori", 1)
    rows += [(300, rows[1][1], "aa"), (301, near, "aa"), (302, rows[1][1], "aa"), (303, "... 12 !", None), (304, None, None), (305, "", "aa"), (306, "short one", "aa"), (307, "ba " * 30000, "aa"), (None, "without id", "aa")]
    return rows, marks


def test_stages_against_brute_force(spark, tmp_path):
    rows, marks = corpus()
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, y) for i, y in marks], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    out = docs
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, out, str(tmp_path))
        assert out.columns == docs.columns
        kept[name] = sorted((r.doc_id is not None, r.doc_id or 0) for r in out.collect())
    with_letters = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    assert kept["language"] == sorted((i is not None, i or 0) for i, *_ in with_letters)
    model = fit_toxicity(docs.select("doc_id", "text"), labels)
    clean = [r for r in with_letters if model.score([r[1]])[0] < THRESHOLD]
    assert sum(i in {k for k, y in marks if y} for i, *_ in clean) == 0 and len(clean) > 150
    assert kept["toxicity"] == sorted((i is not None, i or 0) for i, *_ in clean)
    classes = brute([(i, t) for i, t, _ in clean if i is not None])
    first = sorted(i for i, (c, _, _) in classes.items() if i == c)
    assert kept["near_duplicates"] == sorted([(True, i) for i in first] + [(False, 0)])
    from tokenizers import Tokenizer

    real, text_of, total = Tokenizer.from_file(P.path("byte_bpe_50k.json")), {i: t for i, t, _ in rows}, {}
    pieces = pipeline.run(spark, str(tmp_path), f"{tmp_path}/run").collect()
    for r in pieces:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert set(total) == {*first, None}
    assert all(n == len(real.encode(text_of[i], add_special_tokens=False).ids) + 1 for i, n in total.items())
    fill = {}
    for r in pieces:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(np.array_equal(np.cumsum([0, *[n for _, n in sorted(x)]])[:-1], [o for o, _ in sorted(x)]) for x in fill.values())
    assert {p.name for p in (tmp_path / "run").iterdir()} == {"3-packing"}
    again = pipeline.run(spark, "/nowhere", f"{tmp_path}/run")  # complete: nothing is run again
    assert again.count() == len(pieces)


def test_columns_and_rows_are_kept(spark, tmp_path):
    rows, marks = corpus()
    rng = random.Random(3)
    words = [f"q{k}" for k in range(300)]
    first, second = (" ".join(rng.choices(words, k=60)) for _ in range(2))
    rows = rows[:220] + [(500, first, "aa"), (500, second, "aa"), (500, first, "aa"), (501, second, "aa"), (502, None, "aa"), (502, "", "aa")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, toxic_score string, row_key long"
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or ""), "ORIGINAL", f"o{i}", 7) for i, t, lang in rows], schema)
    spark.createDataFrame([(i, 1, y) for i, y in marks], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema == docs.schema
        got = out.collect()
        assert {(r.lang_pred, r.row_key) for r in got} == {("ORIGINAL", 7)} and all(r.toxic_score == f"o{r.doc_id}" for r in got)
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    # Two texts of one id: the first one stays once, the second one is a copy of 501.
    assert sorted((r.doc_id, r.text) for r in got if (r.doc_id or 0) >= 500 and r.text) == sorted([(500, first), (501, second)])
    assert sum(r.doc_id == 502 for r in got) == 2
    assert pipeline.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0
