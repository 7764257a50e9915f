import math

import pytest
from pyspark.sql import functions as F

from hoploom.functions import scores as sc
from hoploom.functions import text as tx
from hoploom.functions import vector as vx
from hoploom.functions.lexical import jaro_winkler, jaro_winkler_of


def one(spark, values, f, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, x {kind}")
    return [r.y for r in df.select("k", f(F.col("x")).alias("y")).orderBy("k").collect()]


def test_numbering_and_lines(spark):
    got = one(spark, ["1. x", "10. x", "11. x", "1) x", "1.5 million", "\t2.\ty ", "plain"], tx.strip_numbering)
    assert got == ["x", "x", "11. x", "1) x", "5 million", "2.\ty", "plain"]
    assert one(spark, ["1. 123456789\n\n  2. 1234567890\n \t\nabcdefghij", None], lambda c: tx.numbered_lines(c, 10)) == [["1234567890", "abcdefghij"], []]


def test_parse_answer(spark):
    assert one(spark, ["no mark", "t Answer: a b ", "Answer:x Answer: y", "Answer:"], tx.parse_answer) == ["no mark", "a b", "x", ""]


def test_normalize_and_contain(spark):
    values = [None, "", "  ", "The", "!!!", "A the cat!", "Théa the-an", "ANOTHER  one\t the"]
    assert one(spark, values, tx.normalize_answer) == ["", "", "", "", "", "cat", "théa thean", "another one"]
    rows = [("it is Paris.", "paris", 1), ("x", "The", 1), (None, "x", 0), ("x", None, 0), ("x", " ", 0), ("Rome", "Paris", 0)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, p string, g string, want int")
    assert all(r.got == r.want for r in df.select("want", tx.contain_accuracy(F.col("p"), F.col("g")).alias("got")).collect())
    assert one(spark, [" Correct\n", "incorrect", None], tx.judge_accuracy) == [1.0, 0.0, 0.0]


def test_counts_and_prefixes(spark):
    rows = [("aaaa", "aa"), ("a.b a.b", "a.b"), ("axb", "a.b"), ("x", ""), ("x", None), ("Aa", "a")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, t string, e string")
    assert [r.n for r in df.orderBy("k").select(tx.substring_count(F.col("t"), F.col("e")).alias("n")).collect()] == [2, 2, 0, 0, 0, 1]
    assert one(spark, ["12:x", " 3:y", "x:1", "", "a"], tx.passage_index) == [12, 3, None, None, None]
    assert one(spark, ["12:x:y", "none", "a\nb:c"], tx.drop_index_prefix) == ["x:y", "none", "c"]
    assert one(spark, ["hi"], lambda c: tx.content_key(c, "p-")) == ["p-49f68a5c8493ec2c0bf489821c21fc3b"]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    rows = df.select(vx.dot("a", "b").alias("d"), vx.cosine(F.col("a"), F.col("b")).alias("c"), vx.cosine_each(F.col("a"), F.col("b")).alias("e"), vx.dot(vx.scaled(F.col("a")), vx.scaled(F.col("b"))).alias("s"), vx.l2_normalize(F.col("a")).alias("u")).collect()
    assert rows[0].d == 3.0 and abs(rows[0].c - 0.6) < 1e-7 and abs(rows[0].e - rows[0].s) < 1e-12
    assert rows[0].u == [0.6, 0.8] and rows[1].u == [0.0, 0.0] and rows[1].c == 0.0


def test_scores(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), ("c", 5.0), ("c", 5.0)], "k string, x double")
    got = sorted((r.k, r.y) for r in sc.with_minmax(df, ["k"], "x", "y").collect())
    assert got == [("a", 0.0), ("a", 1.0), ("b", 1.0), ("c", 1.0), ("c", 1.0)]
    assert one(spark, [float("nan"), -1.0, 2.0], sc.clamp_reset, "double") == [0.0, 0.0, 2.0]
    assert one(spark, [0.4, 0.5, 0.75, 1.0], lambda c: sc.adaptive_clusters(c, 0.5, 5, 20), "double") == [5, 5, 12, 20]
    row = df.limit(1).select(sc.entity_bonus(F.lit(2.0), F.lit(3), F.lit(0)).alias("a"), sc.passage_score(F.lit(0.5), F.lit(1.0), 1.5, 0.05).alias("b")).first()
    assert math.isclose(row.a, 2 * math.log(4)) and math.isclose(row.b, (0.75 + math.log(2)) * 0.05)


@pytest.mark.parametrize("a,b,want", [("martha", "marhta", 0.961111), ("dixon", "dicksonx", 0.813333), ("abc", "xyz", 0.0), ("", "", 0.0), ("same", "same", 1.0), ("2000", "2002", 0.883333)])
def test_jaro_winkler(a, b, want):
    assert abs(jaro_winkler_of(a, b) - want) < 1e-6


def test_jaro_winkler_column_matches_sql(spark):
    import duckdb

    pairs = [("lionel messi", "leo messi"), ("abcdef", "fedcba"), ("new york", "york"), ("a", "b"), ("inter miami", "inter miami cf")]
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(jaro_winkler("a", "b")).collect()]
    assert all(abs(x - duckdb.execute("SELECT jaro_winkler_similarity(?, ?)", list(p)).fetchone()[0]) < 1e-9 for x, p in zip(got, pairs, strict=True))


def test_jaro_winkler_of_many_lengths_matches_sql(spark):
    """Pairs of 0 to 3,000 characters in one batch, nulls and repeated pairs among them."""
    import random

    import duckdb

    rng = random.Random(4)
    names = ["".join(rng.choices("abcde ", k=rng.choice([0, 1, 2, 3, 6, 12, 40]))) for _ in range(300)] + ["ab" * 1500, "a", "x" * 900]
    pairs = [(a, rng.choice([rng.choice(names), a[: len(a) // 2] + "c" + a[len(a) // 2 :]])) for a in names] * 2 + [(None, "a"), ("a", None), (None, None), ("a", "ab" * 1500)]
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").coalesce(1).select(jaro_winkler("a", "b")).collect()]
    for x, p in zip(got, pairs, strict=True):
        want = None if None in p else duckdb.execute("SELECT jaro_winkler_similarity(?, ?)", list(p)).fetchone()[0]
        assert x is want is None or abs(x - want) < 1e-9, p
    assert abs(jaro_winkler_of("éà漢字", "éà字漢") - jaro_winkler_of("abcd", "abdc")) < 1e-12


def test_word_vectors_count_the_corpus_once(spark):
    """The texts are read for the counts, for the vocabulary and for the training; the counts were made twice."""
    from pyspark.sql import functions as F

    from hoploom.sources.word_vectors import WordVectors

    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(text):
        read.add(1)
        return text

    texts = spark.createDataFrame([(k, "alpha beta gamma delta") for k in range(40)], "id long, text string")
    model = WordVectors.fit(texts.select(told("text").alias("text")), dim=4, partitions=1)
    assert sorted(model.at) == ["alpha", "beta", "delta", "gamma"] and read.value <= 3 * 40
