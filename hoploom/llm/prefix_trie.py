"""A trie of conversation prefixes, encoded by preorder intervals.

Conversations are ranked lexicographically as sequences of turns: names of up to
``pack`` neighbouring turns are joined and ranked, then names of these, until a
conversation has one name; each round has a ``pack``-th of the rows, and equal
sequences share a rank. A turn of a ranked sequence opens a node unless the
sequence before it has the same turns up to there, so the node of a prefix is a
run of neighbouring ranks: from the first that opens it to its last.

Sorted by the rank that opens them and by depth, nodes stand in preorder; the last
node of the last rank is where a node's subtree ends. Leaves and savings of a
subtree are differences of running totals over that order.

No conversation, prefix or node is gathered in one task: ranks, nodes and totals
come from range-sorted tables whose partitions hand on their totals, and a group's
counts are combined before they are shuffled. Only the digest of the ids that end
at a node is of one sequence of rows; it streams over them.

Defined results: a null role or text is empty; null turns come first; turns of one
number are ordered by role and then by the digest of role and text; rows repeated
in full are turns of their own; rows with a null conversation id belong to no
conversation; long texts enter by their digest and their number of bytes; an empty
table has no nodes, a table of turnless conversations the root alone; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import table
from .running import running_totals

#: Fixed values of the rebuilding: conversations share the head of the one at this step, of a length below this.
STEP, HEADS = 5, 9
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def ordered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, bytes) of every turn; ``pos`` counts from 1 in the order of turns."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    clean = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    placed = running_totals(clean, ["conv_id", "turn", "role", "digest"], {"pos": F.lit(1).cast("long")}, segment=["conv_id"])
    return placed.select("conv_id", "pos", "digest", "bytes")


def share_heads(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every conversation with the head of another: (steps, conversations).

    Conversation c begins with the first h turns of conversation c - c % 5 and goes on
    with its own after its first h; h = crc32(c) % 9. ``steps`` has conv_id, depth (from
    1), digest, bytes; ``conversations`` conv_id and size.
    """
    own = placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    own = cut_lineage(own.withColumn("h", F.crc32(F.col("conv_id").cast("string")) % HEADS).withColumn("base", F.col("conv_id") - F.col("conv_id") % STEP))
    lent = own.select(F.col("conv_id").alias("base"), F.col("own").alias("lent"))
    convs = own.join(lent, "base", "left").select("conv_id", "h", "base", F.least("h", F.coalesce("lent", F.lit(0))).alias("head"), "own")
    # At most eight turns of each conversation go to at most five.
    heads = placed.where(F.col("pos") < HEADS).select(F.col("conv_id").alias("base"), "pos", "digest", "bytes")
    borrowed = convs.join(heads, "base").where("pos <= h").select("conv_id", F.col("pos").alias("depth"), "digest", "bytes")
    rest = placed.join(convs.select("conv_id", "h", "head"), "conv_id").where("pos > h").select("conv_id", (F.col("head") + F.col("pos") - F.col("h")).alias("depth"), "digest", "bytes")
    return cut_lineage(borrowed.unionByName(rest)), convs.select("conv_id", (F.col("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("size"))


def sequence_ranks(steps: DataFrame, pack: int = 8) -> DataFrame:
    """(conv_id, rank): the lexicographic rank of each conversation's sequence of digests, from 1; equal sequences have the same."""
    longest = steps.agg(F.max("depth")).first()[0]
    names = steps.select("conv_id", (F.col("depth") - 1).alias("at"), F.col("digest").alias("name"))
    if longest is None:
        return names.select("conv_id", F.col("at").alias("rank"))
    while True:
        # Names have one width, so joined names are ordered as the lists of them are; a row joins at most ``pack``.
        parts = F.array_sort(F.collect_list(F.struct(F.col("at") % pack, "name")))
        joined = names.groupBy("conv_id", F.floor(F.col("at") / pack).alias("at")).agg(F.array_join(F.transform(parts, lambda p: p["name"]), "").alias("name"))
        ranked = running_totals(joined, ["name", "conv_id", "at"], {}, segment=["name"], number="rank")
        longest = -(-longest // pack)
        if longest == 1:
            return ranked.select("conv_id", (F.col("rank") + 1).alias("rank"))
        names = ranked.select("conv_id", "at", F.lpad(F.hex("rank"), 16, "0").alias("name"))


def _ends(ranked: DataFrame) -> DataFrame:
    """(rank, ends_sha256): of the ids of each rank's conversations, ascending, as decimals between commas."""

    def run(batches):
        import pyarrow as pa

        rank, digest = None, None
        for batch in batches:
            done: list[tuple[int, str]] = []
            ids = batch.column("conv_id").cast(pa.string()).to_pylist()
            for r, name in zip(batch.column("rank").to_pylist(), ids, strict=True):
                if r != rank:
                    if digest is not None:
                        done.append((rank, digest.hexdigest()))
                    rank, digest = r, hashlib.sha256(name.encode())
                else:
                    digest.update(b"," + name.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done])], names=["rank", "ends_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([rank], pa.int64()), pa.array([digest.hexdigest()])], names=["rank", "ends_sha256"])

    return ranked.select("rank", "conv_id").repartition("rank").sortWithinPartitions("rank", "conv_id").mapInArrow(run, "rank long, ends_sha256 string")


def prefix_trie(steps: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node of the trie of ``steps`` (conv_id, depth, digest, bytes) of ``convs`` (conv_id, size).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256, and the encoding: ``position`` and ``last_position``, the
    preorder numbers of the node and of the last node of its subtree, from 1.
    """
    ranked = cut_lineage(convs.join(sequence_ranks(steps), "conv_id", "left").select("conv_id", "size", F.coalesce("rank", F.lit(0)).alias("rank")))
    sequences = cut_lineage(ranked.groupBy("rank").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"), F.max("size").alias("size")))
    first = sequences.agg(F.min("rank")).first()[0]
    roots = sequences.select("rank", F.lit(0).cast("long").alias("depth"), F.lit("").alias("digest"), F.lit(0).cast("long").alias("bytes"), "n", "conv_id", "size")
    # The turns of each distinct sequence, once.
    told = cut_lineage(steps.join(sequences, "conv_id").select(roots.columns))
    before = told.select((F.col("rank") + 1).alias("rank"), "depth", F.col("digest").alias("before"))
    other = told.select("rank", "depth", "digest").join(before, ["rank", "depth"], "left").where(F.col("before").isNull() | (F.col("before") != F.col("digest")))
    opened = other.groupBy("rank").agg(F.min("depth").alias("opens"))
    members = told.join(opened, "rank").withColumn("opening", (F.col("depth") >= F.col("opens")).cast("long")).drop("opens", "digest")
    members = members.unionByName(roots.drop("digest").withColumn("opening", (F.col("rank") == F.lit(first)).cast("long")))
    # Members of one node stand together when sorted by depth and rank.
    numbered = running_totals(members.withColumn("node", F.col("opening")), ["depth", "rank"], {"node": F.col("opening")})
    nodes = numbered.groupBy("node").agg(
        F.min("depth").alias("depth"),
        F.min("rank").alias("rank"),
        F.max("rank").alias("last_rank"),
        F.sum("n").alias("n_convs"),
        F.min("conv_id").alias("conv_id"),
        F.max("bytes").alias("bytes"),
        F.max(F.when(F.col("size") == F.col("depth"), F.col("rank"))).alias("ending"),
    )
    above = numbered.select("rank", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    tree = cut_lineage(nodes.join(above, ["rank", "depth"], "left"))
    children = tree.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = tree.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    whole = tree.join(children, "node", "left").join(parents, "parent", "left").join(_ends(ranked).withColumnRenamed("rank", "ending"), "ending", "left")
    whole = whole.withColumn("n_children", F.coalesce("n_children", F.lit(0))).withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("saving", (F.col("n_convs") - 1) * F.col("bytes"))
    preorder = running_totals(whole, ["rank", "depth"], {"position": F.lit(1).cast("long"), "leaves": F.col("leaf"), "saved": F.col("saving")})
    last = preorder.groupBy(F.col("rank").alias("last_rank")).agg(F.max("position").alias("last_position"), F.max("leaves").alias("last_leaves"), F.max("saved").alias("last_saved"))
    return preorder.join(last, "last_rank").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        (F.col("last_leaves") - F.col("leaves") + F.col("leaf")).alias("n_leaves"),
        (F.col("last_saved") - F.col("saved") + F.col("saving")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"),
        "position",
        "last_position",
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of all conversations, each rebuilt with the head that it shares."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return prefix_trie(*share_heads(ordered_turns(turns)))


#: The same from prefixes as strings of digests.
OP13_SQL = r"""
WITH turns AS (
  SELECT conv_id, octet_length(encode(coalesce(text, ''))) AS bytes, coalesce(role, '') AS role,
    md5(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, turn
  FROM conversations WHERE conv_id IS NOT NULL
), placed AS (
  SELECT conv_id, bytes, digest, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, digest) AS pos FROM turns
), own AS (
  SELECT conv_id, count(*) AS own, conv_id - conv_id % 5 AS base,
    xor(4294967295::BIGINT, list_reduce(
      list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
      lambda a, e: xor(xor(a, e) >> 1, 3988292384::BIGINT * (xor(a, e) & 1)))) % 9 AS h
  FROM placed GROUP BY conv_id
), convs AS (SELECT o.conv_id, o.h, o.base, o.own, least(o.h, coalesce(b.own, 0)) AS head FROM own o LEFT JOIN own b ON b.conv_id = o.base),
steps AS (
  SELECT c.conv_id, p.pos AS depth, p.digest, p.bytes FROM convs c JOIN placed p ON p.conv_id = c.base AND p.pos <= c.h
  UNION ALL SELECT c.conv_id, c.head + p.pos - c.h, p.digest, p.bytes FROM convs c JOIN placed p ON p.conv_id = c.conv_id AND p.pos > c.h
  UNION ALL SELECT conv_id, 0, '', 0 FROM convs
), paths AS MATERIALIZED (SELECT conv_id, depth, bytes, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM steps),
sizes AS (SELECT conv_id, max(depth) AS size FROM paths GROUP BY conv_id),
nodes AS MATERIALIZED (
  SELECT path, p.depth, min(p.conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes,
    sha256(coalesce(string_agg(CASE WHEN s.size = p.depth THEN CAST(p.conv_id AS VARCHAR) END, ',' ORDER BY p.conv_id), '')) AS ends_sha256
  FROM paths p JOIN sizes s ON s.conv_id = p.conv_id GROUP BY path, p.depth
), children AS (SELECT left(path, length(path) - 32) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
whole AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.path = n.path),
subtree AS (
  SELECT p.path, sum(CASE WHEN b.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((b.n_convs - 1) * b.bytes) AS saved, count(*) AS size
  FROM whole b JOIN paths p ON p.conv_id = b.conv_id AND p.depth <= b.depth GROUP BY p.path
)
SELECT w.conv_id, CAST(w.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, w.n_convs, w.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
  CAST(s.saved AS BIGINT) AS saved_tokens, w.ends_sha256, w.position, w.position + s.size - 1 AS last_position
FROM (SELECT *, row_number() OVER (ORDER BY path) AS position FROM whole) w JOIN subtree s ON s.path = w.path
LEFT JOIN nodes u ON w.depth > 0 AND u.path = left(w.path, length(w.path) - 32)
"""
