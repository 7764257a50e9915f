import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from hoploom.llm import prefix_trie as pt
from hoploom.llm.running import running_totals

KIND = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    """{conversation: its turns}, built from the definition."""
    own: dict[int, list] = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(conv, []).append((turn is not None, turn or 0, role, digest, text))
    own = {c: [(t[2], t[4]) for t in sorted(turns)] for c, turns in own.items()}
    return {c: own.get(c - c % 5, [])[: zlib.crc32(str(c).encode()) % 9] + turns[zlib.crc32(str(c).encode()) % 9 :] for c, turns in own.items()}


def brute_force(rows):
    convs = rebuilt(rows)
    members: dict[tuple, list[int]] = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, own in members.items():
        below = [p for p in members if p[: len(path)] == path]
        leaves = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in members) for p in below)
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(path))
        children = sum(len(q) == len(path) + 1 for q in below)
        out.append((min(own), len(path), min(members[path[:-1]]) if path else None, len(own), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0]))


def answers(df):
    found = pt.prefix_trie(*pt.share_heads(pt.ordered_turns(df))).collect()
    ordered = sorted(found, key=lambda r: r.position)
    assert [r.position for r in ordered] == list(range(1, len(found) + 1))
    for a, b in itertools.combinations(ordered[:60], 2):  # intervals are nested or apart
        assert b.position > a.last_position or b.last_position <= a.last_position
    return sorted((tuple(r)[:8] for r in found), key=lambda r: (r[1], r[0]))


@pytest.mark.parametrize("partitions", [1, 5])
def test_equals_brute_force(spark, partitions):
    rng = random.Random(7)
    rows = []
    for c in range(0, 80):
        if c % 5 == 0 and rng.random() < 0.2:
            continue  # conversations that lend a head may be absent
        turns = list(range(rng.choice([1, 2, 5, 8, 12, 30])))
        rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(["", "a", "é", "b"])) for t in turns]
    rows += [(c, t, "user", "same") for c in range(200, 260) for t in range(3)]  # a large group of copies
    rng.shuffle(rows)
    assert answers(spark.createDataFrame(rows, KIND).repartition(partitions)) == brute_force(rows)


def test_edges(spark):
    rows = [(0, None, None, None), (0, None, "", ""), (0, 1, "user", None), (0, 1, "assistant", "é" * 100_000), (1, 0, None, "x"), (1, 0, None, "y"), (None, 0, "user", "lost")]
    rows += [(7, t, "user", f"t{t}") for t in range(150)] + [(5, t, "user", f"t{t}") for t in range(150)]  # longer than the first names
    rows += [(11, 0, "a", "b:c"), (12, 0, "ab", ":c"), (13, 5, "q", "rep"), (13, 5, "q", "rep"), (13, 5, "q", "rep")]
    df = spark.createDataFrame(rows, KIND).select("*", *[F.lit(1).alias(c) for c in ("pos", "depth", "node", "rank", "digest", "bytes", "_part")])
    assert answers(df) == brute_force(rows)
    assert answers(df.limit(0)) == []
    turnless = [(c, 0, "user", "short") for c in range(1, 40) if c % 5 and zlib.crc32(str(c).encode()) % 9]
    assert answers(spark.createDataFrame(turnless, KIND)) == brute_force(turnless) and len(brute_force(turnless)) == 1


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_running_totals(spark, partitions):
    rows = [("a" if k < 70 else None if k < 90 else f"s{k}", k, k % 5) for k in range(120)]  # one segment spans partitions
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame(rows, "s string, k long, v long").repartition(4)
        got = running_totals(df, ["s", "k"], {"total": F.col("v"), "n": F.lit(1).cast("long")}, segment=["s"], number="nth").collect()
        whole = {r.k: r.total for r in running_totals(df, ["k"], {"total": F.col("v")}).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want, nth = {}, {}
    for s, k, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        nth.setdefault(s, len(nth))
        total, n = want.get(s, [(0, 0)])[-1] if s in want else (0, 0)
        want.setdefault(s, []).append((total + v, n + 1))
    assert sorted((str(r.s), r.total, r.n, r.nth) for r in got) == sorted((str(s), t, n, nth[s]) for s, own in want.items() for t, n in own)
    assert whole == {k: sum(r[2] for r in rows[: k + 1]) for k in range(120)}
