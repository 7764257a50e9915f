"""String functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What answer normalisation deletes (ASCII punctuation) and blanks (English articles).
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ARTICLES = ("a", "an", "the")


def content_key(text: Column, prefix: str) -> Column:
    """Prefix and the md5 of the UTF-8 text."""
    return F.concat(F.lit(prefix), F.md5(text))


def strip_space(text: Column) -> Column:
    """Strips white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def strip_numbering(line: Column) -> Column:
    """Drops one leading "1." to "10."."""
    return strip_space(F.regexp_replace(line, r"^(?:10|[1-9])\.", ""))


def substring_count(text: Column, needle: Column) -> Column:
    """Non-overlapping occurrences; an empty or null needle occurs 0 times."""
    n = F.octet_length(needle)  # bytes, which need no count of characters
    return F.when(n > 0, ((F.octet_length(text) - F.octet_length(F.replace(text, needle, F.lit("")))) / n).cast("long")).otherwise(F.lit(0).cast("long"))


def normalize_answer(text: Column) -> Column:
    """Lower case without punctuation, articles and surplus white space; null gives ''."""
    bare = F.translate(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, "")
    no_articles = F.regexp_replace(bare, rf"(?U)\b({'|'.join(ARTICLES)})\b", " ")
    return strip_space(F.regexp_replace(no_articles, r"(?U)\s+", " "))


def contain_accuracy(predicted: Column, gold: Column) -> Column:
    """1 if the normalised gold answer is part of the normalised prediction; 0 if either is null or blank."""
    blank = (strip_space(F.coalesce(predicted, F.lit(""))) == "") | (strip_space(F.coalesce(gold, F.lit(""))) == "")
    return F.when(blank, 0).otherwise(F.contains(normalize_answer(predicted), normalize_answer(gold)).cast("int"))


def judge_accuracy(reply: Column) -> Column:
    """1.0 if a judge's stripped, lower-cased reply is "correct"."""
    return F.when(strip_space(F.lower(F.coalesce(reply, F.lit("")))) == "correct", 1.0).otherwise(0.0)


def parse_answer(reply: Column) -> Column:
    """Text between the first and the second "Answer:", or the whole reply."""
    parts = F.split(reply, "Answer:", -1)
    return F.when(F.size(parts) > 1, strip_space(F.element_at(parts, 2))).otherwise(reply)


def passage_index(text: Column) -> Column:
    """The number before the first colon, or null."""
    found = F.regexp_extract(text, r"(?U)^\s*([0-9]+):", 1)
    return F.when(found != "", found.cast("long"))


def drop_index_prefix(text: Column) -> Column:
    """What follows the first colon; texts without one stay."""
    return F.regexp_replace(text, r"(?s)^[^:]*:", "")


def numbered_lines(reply: Column, min_chars: int) -> Column:
    """Array of a reply's lines without blanks and numbering that have ``min_chars`` characters at least."""
    lines = F.transform(F.split(F.coalesce(reply, F.lit("")), "\n", -1), strip_space)
    bare = F.transform(F.filter(lines, lambda x: x != ""), strip_numbering)
    return F.filter(bare, lambda x: F.length(x) >= min_chars)


def answer_context(sentences: Column) -> Column:
    """Evidence as a list, a line each."""
    return F.array_join(F.transform(sentences, lambda s: F.concat(F.lit("- "), s)), "\n")


def sentences_of(text: Column) -> Column:
    """Distinct non-empty sentences, cut after marks with white space and at line breaks."""
    return F.array_distinct(F.filter(F.split(text, r"[.!?]+\s+|\n", -1), lambda s: s != ""))


def capitalised_words(text: Column) -> Column:
    """Distinct words of four letters or more that start with a capital: the stand-in for a recogniser."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?<![A-Za-z])[A-Z][a-z]{3,}+(?![A-Za-z])"), 0))


def capitalised_runs(text: Column) -> Column:
    """Every capital with all the small letters behind it, three or more, also within other words."""
    return F.regexp_extract_all(text, F.lit("[A-Z][a-z]{3,}+"), 0)
