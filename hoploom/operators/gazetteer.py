"""Entity mentions by a list of names: a join of token n-grams, and the leftmost longest of those that overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokens_of(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits, in order."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", -1), lambda t: t != "")


def gazetteer_mentions(texts: DataFrame, names: DataFrame, max_tokens: int = 8) -> DataFrame:
    """(id, start, n_tokens, name): where names stand in texts, without overlap.

    ``texts`` has id and text, ``names`` name; both are compared by their tokens, joined by
    single spaces, and names of more than ``max_tokens`` tokens or of none are left out by
    definition. From left to right, the longest name that begins at a place is taken, and what it
    covers is passed over. N-grams are made of the lengths that names have, once for
    each text, and met with the names in an equi-join in which nothing but (id, start, n-gram) is
    shuffled; a text's matches, no more than its tokens, meet in one row.
    """
    sized = names.select(tokens_of(F.col("name")).alias("t")).select(F.array_join("t", " ").alias("name"), F.size("t").alias("n")).where(F.col("n").between(1, max_tokens)).distinct()
    lengths = sorted(r.n for r in sized.select("n").distinct().collect())  # at most ``max_tokens`` numbers
    if not lengths:
        return texts.select("id", F.lit(0).alias("start"), F.lit(0).alias("n_tokens"), F.lit("").alias("name")).where("false")

    def grams(n: int) -> Column:
        starts = F.when(F.size("t") >= n, F.sequence(F.lit(0), F.size("t") - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda p: F.struct(p.alias("start"), F.lit(n).alias("n"), F.array_join(F.slice("t", p + 1, F.lit(n)), " ").alias("name")))

    words = texts.select("id", tokens_of(F.col("text")).alias("t"))
    # An outer explode: a plain one would make the n-grams twice, to leave out empty arrays first.
    each = words.select("id", F.explode_outer(F.concat(*[grams(n) for n in lengths])).alias("g")).where("g IS NOT NULL").select("id", "g.*")
    met = each.join(sized.select("name"), "name", "left_semi")
    longest = met.groupBy("id", "start").agg(F.max(F.struct("n", "name")).alias("m")).select("id", F.struct("start", "m.n", "m.name").alias("m"))
    kind = "array<struct<start:int,n:int,name:string>>"

    def take(state: Column, m: Column) -> Column:
        free = m["start"] >= state["end"]
        return F.struct(F.when(free, m["start"] + m["n"]).otherwise(state["end"]).alias("end"), F.when(free, F.concat(state["taken"], F.array(m))).otherwise(state["taken"]).alias("taken"))

    zero = F.struct(F.lit(0).alias("end"), F.array().cast(kind).alias("taken"))
    chosen = longest.groupBy("id").agg(F.array_sort(F.collect_list("m")).alias("ms")).select("id", F.aggregate("ms", zero, take)["taken"].alias("taken"))
    return chosen.select("id", F.explode("taken").alias("m")).select("id", "m.start", F.col("m.n").alias("n_tokens"), "m.name")
