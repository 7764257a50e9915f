import random
import time

import numpy as np
import public_tokenizers as P

from hoploom.llm import packing, pieces


def brute(sizes, capacity):
    """Sum-of-squares packing by trying every level; the fuller level wins a tie, a new window last."""
    counts, total = [0] * (capacity + 1), 0
    for s in sizes:
        best = None
        for h in [x for x in range(capacity - s, 0, -1) if counts[x]] + [0]:
            c = list(counts)
            if h:
                c[h] -= 1
            if h + s < capacity:
                c[h + s] += 1
            value = sum(v * v for v in c[:capacity])
            if best is None or value < best[0]:
                best = (value, c, h)
        counts = best[1]
        total += best[2] == 0
    return total, counts


def test_places_as_brute_force():
    rng = random.Random(3)
    for capacity in (2, 7, 40):
        sizes = [rng.randint(1, capacity - 1) for _ in range(300)]
        packer = packing.SumOfSquaresPacker(capacity)
        places = [packer.place(s) for s in sizes]
        total, counts = brute(sizes, capacity)
        assert packer.windows == total
        assert packer.counts.tolist()[:capacity] == counts[:capacity]
        fill = {}
        for (window, offset), s in zip(places, sizes, strict=True):
            assert fill.get(window, 0) == offset
            fill[window] = offset + s
        assert max(fill.values()) <= capacity


def test_every_id_once(spark):
    rng = random.Random(1)
    texts = [None, "", "word " * 9000, *[" ".join(rng.choices(["alpha", "be", "gamma", "δelta"], k=rng.randint(1, 900))) for _ in range(60)], "same", "same"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, length string").repartition(3)
    path = P.path("byte_bpe_50k.json")
    rows = packing.pack_documents(df, path, P.PATTERN, capacity=512).collect()
    from tokenizers import Tokenizer

    real, sequences, docs = Tokenizer.from_file(path), {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(texts):
        got = b"".join(r.ids for r in sorted(docs[i], key=lambda r: r.start))
        assert np.frombuffer(got, "<u4").tolist() == [*real.encode(t or "", add_special_tokens=False).ids, 1]
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 512
    assert packing.pack_documents(df.limit(0), path, P.PATTERN).count() == 0


def plain(texts):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode_batch_fast(texts, add_special_tokens=False)
    return [np.array(x.ids, dtype="<u4").tobytes() for x in found]


def test_ids_as_the_tokenizer_gives_them():
    encode = packing._tokenizer(P.path("byte_bpe_50k.json"), P.PATTERN)
    # Characters that are letters or numbers in newer Unicode tables than the tokenizer's.
    new = [f"a{c}b 1{c}{c} {c}'s" for c in "՘࢏౜₏꟎\U000323b0\U00011de0"]
    assert encode(new) == plain(new)
    rng = random.Random(5)
    parts = [*"''strevldmS  \n\t1.-\0", " ", "　", "\x1c", "\x85", "٣", "½", "é", "ß", "字", "😀", "́", "﻿", "'ll", "'re", "'ve", "<|endoftext|>"]
    odd = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(4000)]
    assert encode(odd) == plain(odd)
    assert encode([]) == [] and encode(["", ""]) == [b"", b""]


def test_pieces_that_come_back_are_not_encoded_again():
    asked = []

    def encode_new(found):
        asked.extend(found)
        return [x.encode() for x in found]

    encoder = pieces.SliceEncoder(pieces.PieceCutter(packing._kinds_of), encode_new, max_cached=20, max_piece=8)
    for k in range(30):
        assert encoder.encode([f"often {'z' * 9}", "", f"x{chr(97 + k % 26)}y, often{k}"]) == [f"often {'z' * 9}".encode(), b"", f"x{chr(97 + k % 26)}y, often{k}".encode()]
        assert len(encoder._recent) + len(encoder._older) <= 40
    assert asked.count("often") == 1 and asked.count(" " + "z" * 9) == 30


def test_known_words_take_a_small_part_of_the_tokenizers_time():
    rng = random.Random(2)
    words = ["".join(rng.choices("aeinrstlédü", k=rng.randint(2, 12))) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=400)) for _ in range(400)]
    encode = packing._tokenizer(P.path("byte_bpe_50k.json"), P.PATTERN)

    def seconds(work):
        start = time.process_time()
        work(texts)
        return time.process_time() - start

    assert encode(texts) == plain(texts)
    ours, theirs = min(seconds(encode) for _ in range(3)), min(seconds(plain) for _ in range(2))
    assert ours < 0.12 * theirs, (ours, theirs)


def test_other_tokenizers_cut_texts_themselves(tmp_path):
    from tokenizers import Tokenizer, pre_tokenizers

    other = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    other.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
    other.save(str(tmp_path / "other.json"))
    texts = ["hello world", "", "it's\n x"]
    expected = [np.array(x.ids, dtype="<u4").tobytes() for x in other.encode_batch_fast(texts, add_special_tokens=False)]
    assert packing._tokenizer(str(tmp_path / "other.json"), P.PATTERN)(texts) == expected
