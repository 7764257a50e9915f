"""URL filter: fixed host/path rules first, mined association rules for the rest.

Mining: every labelled URL is a transaction of its tokens (host labels, path
segments with digits masked, query keys) plus an item for its label. Spark's
FP-growth finds the frequent combinations; rules whose consequent is the block
label are kept if their support, confidence and lift suffice and no more
general rule is as confident. The lift sets the confidence in proportion to the
share of blocked rows: a rule has to be ``min_lift`` times as sure as a guess, and
``min_z`` standard errors surer, so that labels that do not depend on the URL
give no rules however few they are. Whole transactions are mined, less what cannot
change a rule: tokens with too few blocked rows to be in one, tokens of every
row, and all but one of the tokens that always occur together; the rules of
that one are repeated for the others.

Matching: the kept rules are an inverted index (token -> rule). URLs are first
reduced to distinct token sets, so a host with a third of all URLs is matched
once per pattern, not once per row; a set matches a rule if it holds all of the
rule's tokens.

Defined results: of rules that fit, the longest fixed one and the most confident
mined one count, of equally confident ones the last by tokens; fixed rules of one
length that both fit are the same rule; very long URLs are matched whole; extra
columns are ignored; null URLs and URLs without ``://`` have an empty host and
path, no tokens, and are allowed; repeated URLs are judged alike; repeated
labels of one page count once, the worst wins; null labels are left out; an
empty table gives no rows; without labels nothing is mined and the fixed rules
alone decide.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK_ITEM = "label=block"

#: The production rule list: (rule, verdict).
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty where there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _query_keys(url: Column) -> Column:
    query = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), F.lit(""))
    return F.transform(F.split(query, "&"), lambda p: F.concat(F.lit("key:"), F.substring_index(p, "=", 1)))


def tokens_of(url: Column) -> Column:
    """Sorted distinct tokens of a URL; digits are masked, empty parts dropped."""
    hosts = F.transform(F.split(host_of(url), r"\."), lambda p: F.concat(F.lit("host:"), p))
    parts = F.transform(F.split(path_of(url), "/"), lambda p: F.concat(F.lit("path:"), F.regexp_replace(p, r"\d+", "#")))
    found = F.array_distinct(F.flatten(F.array(hosts, parts, _query_keys(url))))
    return F.array_sort(F.filter(found, lambda t: ~t.endswith(":")))


def fixed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the last one asked is the longest
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _needless(itemsets: DataFrame, rules: DataFrame) -> DataFrame:
    """tokens of the rules that have a more general one at least as confident.

    ``itemsets`` has every subset of a rule; the best confidence below a set is handed
    on from each size to the next, so a set of k tokens is asked for k subsets only.
    """
    longest = rules.agg(F.max(F.size("tokens"))).first()[0] or 0
    sets = itemsets.join(rules.select("tokens", "confidence"), "tokens", "left").where(F.size("tokens") <= longest).checkpoint()
    below = sets.where(F.size("tokens") == 1).select("tokens", "confidence", F.lit(None).cast("double").alias("general"))
    levels = [below]
    for size in range(2, longest + 1):
        best = below.select(F.col("tokens").alias("sub"), F.greatest("confidence", "general").alias("best"))
        subsets = sets.where(F.size("tokens") == size).select("tokens", "confidence", F.explode(F.transform("tokens", lambda t: F.array_remove("tokens", t))).alias("sub"))
        below = subsets.join(best, "sub").groupBy("tokens").agg(F.first("confidence").alias("confidence"), F.max("best").alias("general")).checkpoint()
        levels.append(below)
    return reduce(DataFrame.unionByName, levels).where(F.col("general") >= F.col("confidence")).select("tokens")


def mine_rules(labelled: DataFrame, min_support: float = 0.002, min_rows: int = 3, min_confidence: float = 0.3, min_lift: float = 1.5, min_z: float = 4.0) -> DataFrame:
    """Rules (rule_id, tokens, confidence, support) from rows (tokens, bad).

    A rule needs ``min_support`` of all labelled rows as blocked ones, and ``min_rows`` of them at least.
    """
    from pyspark.ml.fpm import FPGrowth

    spark = labelled.sparkSession
    empty = spark.createDataFrame([], "rule_id long, tokens array<string>, confidence double, support double")
    rows = labelled.where(F.col("bad").isNotNull() & (F.size("tokens") > 0)).select("tokens", "bad")
    n = rows.count()
    if n < min_rows:
        return empty
    ensure_checkpoint_dir(spark)
    support = max(min_support, min_rows / n)
    # A token's rows are told by the token sets that hold it: tokens of the same sets always occur together.
    patterns = rows.groupBy("tokens").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("hits"))
    together = (
        patterns.select("n", "hits", F.xxhash64("tokens").alias("a"), F.xxhash64(F.lit(7), "tokens").alias("b"), F.explode("tokens").alias("token"))
        .groupBy("token")
        .agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
        .where(F.col("hits") >= math.ceil(support * n))
        .where((F.col("n") < n) | F.lit(min_lift <= 1))
        .groupBy("n", "hits", "a", "b")
        .agg(F.array_sort(F.collect_list("token")).alias("members"))
        .select(F.element_at("members", 1).alias("token"), "members")
    ).checkpoint()
    reduced = patterns.select("tokens", F.explode("tokens").alias("token")).join(together.select("token"), "token").groupBy("tokens").agg(F.collect_list("token").alias("kept"))
    kept = F.coalesce("kept", F.array().cast("array<string>"))
    # The transactions are made again from the token sets and their numbers, so that no join has the rows of a common set in one task.
    thousands = patterns.join(reduced, "tokens", "left").select(kept.alias("kept"), "n", "hits", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / 1000))).alias("part")).repartition("kept", "part")
    number = F.explode(F.sequence(F.col("part") * 1000, F.least(F.col("part") * 1000 + 999, F.col("n") - 1))).alias("number")
    items = thousands.select("kept", "hits", number).select(F.when(F.col("number") < F.col("hits"), F.array_append("kept", F.lit(BLOCK_ITEM))).otherwise(F.col("kept")).alias("items"))
    share = rows.where("bad").count() / n
    error = F.sqrt(F.lit(share * (1 - share)) / (F.col("support") * n / F.col("confidence")))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(items)
    rules = model.associationRules.where((F.element_at("consequent", 1) == BLOCK_ITEM) & (F.col("lift") >= min_lift) & (F.col("confidence") >= share + min_z * error)).select(
        F.array_sort("antecedent").alias("tokens"), "confidence", "support"
    ).checkpoint()
    if rules.isEmpty():
        return empty
    itemsets = model.freqItemsets.where(F.array_contains("items", BLOCK_ITEM) & (F.size("items") > 1)).select(F.array_sort(F.array_remove("items", BLOCK_ITEM)).alias("tokens"))
    kept_rules = rules.join(_needless(itemsets, rules), "tokens", "left_anti")
    # Every choice of one token for each that stands for several.
    lists = kept_rules.select("tokens", "confidence", "support", F.explode("tokens").alias("token")).join(together, "token").groupBy("tokens", "confidence", "support").agg(F.collect_list("members").alias("lists"))
    choices = F.aggregate(
        "lists",
        F.array(F.array().cast("array<string>")),
        lambda acc, members: F.flatten(F.transform(acc, lambda s: F.transform(members, lambda t: F.array_append(s, t)))),
    )
    found = lists.select(F.explode(choices).alias("tokens"), "confidence", "support").withColumn("tokens", F.array_sort("tokens"))
    return found.select(F.xxhash64("tokens").alias("rule_id"), "tokens", "confidence", "support")


def match_rules(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Of distinct ``tokens`` arrays, those that hold all tokens of a rule, with the best rule's confidence and tokens."""
    index = rules.select("rule_id", F.size("tokens").alias("needed"), "confidence", F.col("tokens").alias("rule_tokens"), F.explode("tokens").alias("token"))
    hits = token_sets.select(F.col("tokens"), F.explode("tokens").alias("token")).join(index, "token")
    return (
        hits.groupBy("tokens", "rule_id")
        .agg(F.count(F.lit(1)).alias("found"), F.first("needed").alias("needed"), F.first("confidence").alias("confidence"), F.first("rule_tokens").alias("rule_tokens"))
        .where(F.col("found") == F.col("needed"))
        .groupBy("tokens")
        .agg(F.max(F.struct("confidence", "rule_tokens")).alias("best"))
        .select("tokens", F.col("best.confidence").alias("confidence"), F.col("best.rule_tokens").alias("mined_rule"))
    )


def judge_urls(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = RULES, **mining) -> DataFrame:
    """Verdict per page; ``labels`` has page_id and bad (boolean)."""
    ensure_checkpoint_dir(pages.sparkSession)
    judged = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), tokens_of(F.col("url")).alias("tokens")).withColumn(
        "fixed", fixed_rule(F.col("host"), F.col("path"), rules)
    )
    worst = labels.where(F.col("page_id").isNotNull()).groupBy("page_id").agg(F.max("bad").alias("bad"))
    mined = mine_rules(judged.select("page_id", "tokens").join(worst, "page_id").select("tokens", "bad"), **mining).checkpoint()
    # Written first: the join back then has two shuffles of its own, and Spark splits a token set that many rows have.
    matched = match_rules(judged.where(F.col("fixed").isNull()).select("tokens").distinct(), mined).checkpoint()
    return judged.join(matched, "tokens", "left").select(
        "page_id",
        "host",
        "path",
        F.col("fixed.rule").alias("rule"),
        F.coalesce(F.col("fixed.verdict"), F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        F.array_join(F.when(F.col("fixed").isNull(), F.col("mined_rule")), " ").alias("mined_rule"),
        F.when(F.col("fixed").isNull(), F.col("confidence")).alias("confidence"),
    )


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's URL; pages of low quality or marked toxic are what the rules are mined for."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return judge_urls(table(spark, sf_dir, "pages"), labels)
