import math
import random
import re
import string

from pyspark.sql import functions as F

from hoploom.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_force(text, templates, phrases, threshold):
    """Every block of every class against every template, by sets."""
    words = WORD.findall((text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))
    places = sorted((at, label) for p, label in phrases.items() for at in range(len(words)) if words[at : at + len(p.split())] == p.split())
    blocks = set()
    for k, (template, label) in enumerate(templates.items()):
        own = set(template.split())
        length = 1
        while length < len(template.split()):
            length *= 2
        for at in range(max(1, math.ceil(len(words) / length) - 1)):
            block = words[at * length : at * length + 2 * length]
            if len(own & set(block)) >= round(threshold * len(own), 9):
                blocks.add((label, k, at * length, at * length + len(block) - 1, len(own & set(block)) / len(own)))
    return len(words), places, sorted(blocks)


def answers(df, **how):
    rows = licenses.scan_licenses(df, **how).collect()
    return sorted((str(r.doc_id), r.n_words, [tuple(p) for p in r.places], sorted(tuple(b) for b in r.blocks)) for r in rows)


def test_equals_brute_force(spark):
    rng = random.Random(3)
    words = "the of a permission granted license mit apache version 2 cc by nc under é x y z".split()
    templates = {"permission granted the license mit": "mit", "apache version 2 license of the x y": "apache", "cc by": "cc", "the": "the", "of the the": "of"}
    phrases = {"cc by nc": "nc", "the of the": "overlap", "under": "one"}
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(120)]
    # A passage at every offset, whole and with words missing.
    texts += [" ".join(["z"] * k + templates_words[:cut]) for k in range(0, 40, 3) for templates_words in ("apache version 2 license of the x y".split(),) for cut in (8, 7, 6)]
    for threshold in (0.5, 0.75, 0.9, 1.0):
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
        want = sorted((str(k), *brute_force(t, templates, phrases, threshold)) for k, t in enumerate(texts))
        assert answers(df, templates=templates, phrases=phrases, threshold=threshold) == want


def test_edges(spark):
    notice = "Licensed under the Apache License, Version 2.0."
    texts = [
        (1, None), (2, ""), (3, " ,;\n"), (4, notice), (4, notice), (4, notice), (None, notice), (5, "CC BY-NC cc by nc, cc.by.nc"),
        (6, "MİT under the MİT license, under the MIT license wor\u212a"), (7, "ÉTÉ " * 50_000 + "released under\nthe MIT\tLicense" + " été" * 50_000), (8, "\x00under\x7fthe\x1fmit@license`"),
        (9, "this work is licensed under the gnu general public license, version 3"), (10, "this work is under the gnu general licensed public license, version 3"),
    ]
    df = spark.createDataFrame(texts, "doc_id long, text string").select("*", *[F.lit(0).alias(c) for c in ("words", "held", "found", "h1", "n_words", "places", "hits", "length")])
    got = answers(df)
    assert got == sorted((str(k), *brute_force(t, licenses.TEMPLATES, licenses.PHRASES, 0.9)) for k, t in texts)
    by_id = {k: (n, places, {b[0] for b in blocks}) for k, n, places, blocks in got}
    assert by_id["5"][1] == [(0, "cc-by-nc"), (3, "cc-by-nc"), (6, "cc-by-nc")] and by_id["7"][2] == {"mit"}
    assert by_id["6"][1] == [(5, "mit")] and by_id["9"][2] == by_id["10"][2] == {"gpl-3"}
    assert len([k for k, *_ in got if k == "4"]) == 3
    kelvin = spark.createDataFrame([(1, "OK O\u212a ok \u00c9ok")], "doc_id long, text string")
    assert answers(kelvin, phrases={"ok": "k"}, templates={"ok": "k"}) == [("1", 4, [(0, "k"), (2, "k")], [("k", 0, 0, 1, 1.0), ("k", 0, 1, 2, 1.0), ("k", 0, 2, 3, 1.0)])]
    assert answers(df.limit(0)) == [] and licenses.scan_licenses(df, templates={}, phrases={}).count() == len(texts)


def test_plan_is_native(spark):
    df = spark.createDataFrame([(1, "released under the mit license")], "doc_id long, text string")
    plan = licenses.scan_licenses(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "BroadcastHashJoin" in plan
