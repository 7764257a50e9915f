"""N-gram Jaccard join by MinHash banding.

Texts are sets of five-word shingles. Bands and rows a band follow from the
wanted recall at the threshold. Texts with equal sets are one text with a
weight. Texts that share a band hash are candidates, and every such pair is
verified on the full sets in the first band that it shares, whatever the size
of its bucket. Buckets are dealt into pairs of blocks, so none is held by one
task, and links are counted without listing them.

Two passes keep the sets from being sent to every band: the first sends the
band hashes alone and leaves only the texts that have a pair whose first shared
band is the bucket's; the second fetches these texts and compares their sets.

Defined results: null, empty and blank texts link with nothing; a text of less
than five words is one shingle, a text without words is its own one; very long
texts are compared whole; repeated rows are copies, which are linked; extra
columns are ignored; an empty table gives no rows. Ids are taken as unique:
``row_keys`` gives rows with one id and other texts ids of their own.
"""

from __future__ import annotations

import hashlib
import math
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_slices, ensure_checkpoint_dir, free_name, group_tables, list_arrays, table
from .graph import connected_components, deal_blocks, local_roots

_WORDS = re.compile(r"\w+").findall
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SALT = np.uint64(0xD6E8FEB86659FD93)


def choose_bands(threshold: float = 0.8, recall: float = 0.999, low: float = 0.3, chance: float = 0.05) -> tuple[int, int]:
    """(bands, rows): the fewest hashes that find pairs at the threshold with ``recall`` and pairs at ``low`` with ``chance`` at most."""
    best = None
    for rows in range(1, 40):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if 1 - (1 - low**rows) ** bands <= chance and (best is None or bands * rows < best[0] * best[1]):
            best = bands, rows
    if best is None:
        raise ValueError("no banding reaches this recall")
    return best


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class _WordHashes(dict):
    """64-bit hashes of words, kept as they come up."""

    def __missing__(self, word: str) -> int:
        value = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        if len(self) > 200_000:
            self.clear()
        self[word] = value
        return value


@lru_cache(maxsize=1)
def _word_hashes() -> _WordHashes:
    return _WordHashes()


def shingle_sets(texts: list[str | None], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): all texts' distinct shingle hashes, sorted within a text, and where each text's end."""
    known = _word_hashes()
    found = []
    for text in texts:
        words = _WORDS((text or "").lower())
        found.append(words or ([text.strip()] if text and text.strip() else []))
    counts = np.array([len(w) for w in found], dtype=np.int64)
    flat = np.array([known[w] for words in found for w in words], dtype=np.uint64)
    owner = np.repeat(np.arange(len(texts)), counts)
    position = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
    power, h = np.uint64(1), np.zeros(len(flat), dtype=np.uint64)
    for k in range(size):  # positions past a text's end add nothing
        part = np.zeros(len(flat), dtype=np.uint64)
        part[: max(0, len(flat) - k)] = flat[k:] * power
        part[position + k >= counts[owner]] = 0
        h += part
        power = np.uint64((int(power) * int(_ODD)) & (2**64 - 1))
    whole = position + size <= counts[owner]
    short = (counts[owner] < size) & (position == 0)
    h = _mix(h + np.minimum(counts[owner], size).astype(np.uint64) * _SALT)
    use = whole | short
    h, owner = h[use], owner[use]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    first = np.ones(len(h), dtype=bool)
    first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[first], np.cumsum(np.bincount(owner[first], minlength=len(texts)))


def band_hashes(h: np.ndarray, ends: np.ndarray, bands: int, rows: int, seed: int = 29) -> np.ndarray:
    """(texts, bands) band hashes; rows of texts without shingles are meaningless."""
    rng = np.random.default_rng(seed)
    factors = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    masks = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    full = ends > starts
    out = np.zeros((len(ends), bands), dtype=np.uint64)
    if full.any():
        for b in range(bands):
            key = np.full(int(full.sum()), ((b + 1) * int(_ODD)) & (2**64 - 1), dtype=np.uint64)
            for r in range(b * rows, (b + 1) * rows):
                least = np.minimum.reduceat((h ^ masks[r]) * factors[r], starts[full])
                key = _mix(key * _ODD + least)
            out[full, b] = key
    return out.view(np.int64)


def _signatures(bands: int, rows: int, size: int):
    def run(batches):
        import pyarrow as pa

        for part in arrow_slices(batches, 1000):
            h, ends = shingle_sets(part.column(1).to_pylist(), size)
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            n = ends - starts
            # Sums of the hashes and of their mixed forms, wrapping: the key of equal sets.
            sums = np.concatenate([[np.uint64(0)], np.cumsum(h, dtype=np.uint64)])
            mixed = np.concatenate([[np.uint64(0)], np.cumsum(_mix(h ^ _SALT), dtype=np.uint64)])
            keys = band_hashes(h, ends, bands, rows)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(n.astype(np.int32)),
                    pa.array((sums[ends] - sums[starts]).view(np.int64)),
                    pa.array((mixed[ends] - mixed[starts]).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * bands), pa.array(keys.ravel())),
                ],
                names=["doc_id", "n", "k1", "k2", "bands"],
            )

    return run


def _fetch_sets(size: int):
    def run(batches):
        import pyarrow as pa

        for part in arrow_slices(batches, 500):
            h, ends = shingle_sets(part.column("text").to_pylist(), size)
            sets = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(h.view(np.int64)))
            yield part.drop_columns(["text"]).append_column("shingles", sets)

    return run


def _first_shared(bands: np.ndarray, i: np.ndarray, j: np.ndarray, band: int, chunk: int = 1 << 18) -> np.ndarray:
    """Of pairs (i, j) that share ``band``, those that share no band before it."""
    out = np.ones(len(i), dtype=bool)
    for s in range(0, len(i), chunk):
        for b in range(band):
            out[s : s + chunk] &= bands[i[s : s + chunk], b] != bands[j[s : s + chunk], b]
    return out


def _block_pairs(mine: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """The two sides of a pair of blocks; the same one twice if lo = hi."""
    left = np.flatnonzero(mine == lo)
    return left, left if lo == hi else np.flatnonzero(mine == hi)


def _needed(batches):
    """Places (band, grp, lo, hi) and the texts there that have a pair whose first shared band is the place's."""
    import pyarrow as pa

    for whole, starts in group_tables(batches, ["band", "grp", "lo", "hi"]):
        band_of, lo_of, hi_of, mine = (whole.column(c).to_numpy() for c in ("band", "lo", "hi", "mine"))
        bands = list_arrays(whole.column("bands"))[0].reshape(whole.num_rows, -1)
        keep = np.zeros(whole.num_rows, dtype=bool)
        for a, z in zip(starts[:-1], starts[1:], strict=True):
            if z - a < 2:
                continue
            left, right = _block_pairs(mine[a:z], lo_of[a], hi_of[a])
            new = np.ones((len(left), len(right)), dtype=bool)
            for b in range(band_of[a]):
                new &= bands[a + left, b][:, None] != bands[a + right, b][None, :]
            if lo_of[a] == hi_of[a]:
                np.fill_diagonal(new, False)
            keep[a + left[new.any(axis=1)]] = True
            keep[a + right[new.any(axis=0)]] = True
        if keep.any():
            yield from whole.filter(pa.array(keep)).select(["rep", "band", "grp", "lo", "hi", "mine"]).combine_chunks().to_batches()


def intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, cells: int = 1 << 21) -> np.ndarray:
    """Sizes of the intersections of ``sets[left]`` with ``sets[right]``, by products of 0/1 matrices of a bounded size."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.ones(len(flat), dtype=bool)
    new[1:] = flat[1:] != flat[:-1]
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    owner, column = owner[shared], column[shared]
    if len(column):
        column = np.cumsum(np.concatenate([[True], column[1:] != column[:-1]])) - 1
    out = np.zeros((len(left), len(right)))
    per = max(64, cells // max(1, len(sets)))
    total = int(column[-1]) + 1 if len(column) else 0
    cuts = np.searchsorted(column, np.arange(0, total + per, per))
    for k in range(len(cuts) - 1):
        a, b = cuts[k], cuts[k + 1]
        if a == b:
            continue
        m = np.zeros((len(sets), min(per, total - k * per)), dtype=np.float32)
        m[owner[a:b], column[a:b] - k * per] = 1
        out += m[left] @ m[right].T
    return out


def _verify(threshold: float):
    def run(batches):
        import pyarrow as pa

        for whole, starts in group_tables(batches, ["band", "grp", "lo", "hi"]):
            band_of, lo_of, hi_of, mine, copies, reps = (whole.column(c).to_numpy() for c in ("band", "lo", "hi", "mine", "copies", "rep"))
            bands = list_arrays(whole.column("bands"))[0].reshape(whole.num_rows, -1)
            shingles, ends = list_arrays(whole.column("shingles"))
            found: list[list[np.ndarray]] = [[], [], []]
            for a, z in zip(starts[:-1], starts[1:], strict=True):
                # Rows repeated in full come back from the table more than once; one will do.
                own = a + np.flatnonzero(np.append(True, reps[a + 1 : z] != reps[a : z - 1]))
                if len(own) < 2:
                    continue
                left, right = _block_pairs(mine[own], lo_of[a], hi_of[a])
                if not len(left) or not len(right):
                    continue
                sets = [shingles[ends[k] : ends[k + 1]] for k in own.tolist()]
                sizes = np.array([len(s) for s in sets])
                both = intersections(sets, left, right)
                i, j = np.nonzero(both >= threshold * (sizes[left][:, None] + sizes[right][None, :] - both) - 1e-9)
                i, j = left[i], right[j]
                if lo_of[a] == hi_of[a]:
                    i, j = i[i < j], j[i < j]
                first = _first_shared(bands[own], i, j, int(band_of[a]))
                i, j = i[first], j[first]
                if not len(i):
                    continue
                n, weight = len(own), copies[own]
                links = np.bincount(i, weights=weight[j], minlength=n) + np.bincount(j, weights=weight[i], minlength=n)
                told = np.union1d(i, j)
                for column, values in zip(found, (reps[own[told]], links[told].astype(np.int64), reps[own[local_roots(n, i, j)[told]]]), strict=True):
                    column.append(values)
            if found[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in found], names=["rep", "links", "root"])

    return run


def similar_texts(docs: DataFrame, threshold: float = 0.8, size: int = 5, recall: float = 0.999, block: int = 512) -> DataFrame:
    """doc_id, class_id, n_links, text_class, kept for every row of (doc_id, text).

    A class is what links connect; its id is its least doc_id. ``text_class`` is the
    least doc_id with the same shingles, ``n_links`` the number of other documents
    at or above the threshold.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    bands, rows = choose_bands(threshold, recall)
    source = docs.select("doc_id", "text")
    signed = source.mapInArrow(_signatures(bands, rows, size), "doc_id long, n int, k1 long, k2 long, bands array<long>").checkpoint()
    keyed = signed.where("n > 0 AND doc_id IS NOT NULL")
    texts = keyed.groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands")).checkpoint()

    spots = texts.select("rep", F.posexplode("bands").alias("band", "grp"))
    crowded = spots.groupBy("band", "grp").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    dealt = deal_blocks(spots.join(crowded, ["band", "grp"]), "rep", "n", block).join(texts.select("rep", "bands"), "rep")
    place = ["band", "grp", "lo", "hi"]
    needed = dealt.repartition(*place).sortWithinPartitions(*place).mapInArrow(_needed, "rep long, band int, grp long, lo int, hi int, mine int").checkpoint()

    # Each needed text is fetched once, and its set goes to its places: the blocks of the bands that are the first of a pair.
    targets = needed.groupBy("rep").agg(F.collect_list(F.struct(*place, "mine")).alias("targets"))
    wanted = targets.join(texts.select("rep", "copies", "bands"), "rep").join(source.withColumnRenamed("doc_id", "rep"), "rep")
    kind = "array<struct<band:int,grp:bigint,lo:int,hi:int,mine:int>>"
    sets = wanted.select("rep", "copies", "bands", "targets", "text").mapInArrow(_fetch_sets(size), f"rep long, copies long, bands array<long>, targets {kind}, shingles array<long>")
    placed = sets.select("rep", "copies", "bands", "shingles", F.explode("targets").alias("t")).select("rep", "copies", "bands", "shingles", "t.*")
    found = placed.repartition(*place).sortWithinPartitions(*place, "rep").mapInArrow(_verify(threshold), "rep long, links long, root long")
    found = found.groupBy("rep", "root").agg(F.sum("links").alias("links")).checkpoint()

    classes = connected_components(found.select(F.col("root").alias("src"), F.col("rep").alias("dst"))).withColumnRenamed("node", "rep")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    member = keyed.select("doc_id", "n", "k1", "k2").join(texts.select("n", "k1", "k2", "rep", "copies"), ["n", "k1", "k2"]).join(links, "rep", "left").join(classes, "rep", "left")
    linked = member.select("doc_id", F.coalesce("component", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("rep").alias("text_class"))
    alone = signed.where("n = 0 OR doc_id IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("text_class"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)))


def row_keys(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key column, and its name: the doc_id, or for ids of several texts a number of id and text above all ids.

    Rows have one key only if id and text are the same. Null ids stay null.
    """
    key = free_name(docs, "row_key")
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("h"))
    shared = texts.groupBy("doc_id").agg(F.min("h").alias("a"), F.max("h").alias("z")).where("a <> z").select("doc_id", F.lit(True).alias(f"{key}_shared"))
    if shared.isEmpty():
        return docs.withColumn(key, F.col("doc_id")), key
    own = F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 61) - 1)).bitwiseOR(F.lit(1 << 62))
    return docs.join(shared, "doc_id", "left").withColumn(key, F.when(F.col(f"{key}_shared"), own).otherwise(F.col("doc_id"))).select(*docs.columns, key), key


def similar_documents(docs: DataFrame, **how) -> DataFrame:
    """As ``similar_texts``, for documents whose ids may belong to several texts: each text is judged for itself.

    In the result keys are ids again; texts of one id that are in different classes can so have one class id,
    and ``kept`` tells each of them apart.
    """
    keyed, key = row_keys(docs.select("doc_id", "text"))
    found = similar_texts(keyed.select(F.col(key).alias("doc_id"), "text"), **how)
    shared = keyed.where(F.col(key) != F.col("doc_id")).select(F.col(key).alias("key"), "doc_id").distinct()
    if shared.isEmpty():
        return found
    shared = shared.withColumnRenamed("doc_id", "real").checkpoint()
    for name in ("doc_id", "class_id", "text_class"):
        found = found.join(shared.withColumnRenamed("key", name), name, "left").withColumn(name, F.coalesce("real", name)).drop("real")
    return found.select("doc_id", "class_id", "n_links", "text_class", "kept")


def op10_text_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document at a Jaccard similarity of 0.8 on five-word shingles."""
    return similar_documents(table(spark, sf_dir, "documents"))
