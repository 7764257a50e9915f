import hashlib

import public_tokenizers as P
import pytest

from hoploom.llm import bpe, packing

TEXTS = ["", "hello world", "it's  a   test\n\n x", "Éauouon.\nEnpaeux 123 ½ ², 漢字かな 🙂🙂", "a" * 3000, "\x1c\x1d odd", "xyzzy" * 500, "<|endoftext|> in text", "   ", "don't 'll'''s"]


def test_encode_matches_the_library():
    tiktoken = pytest.importorskip("tiktoken")
    vocabulary, encoder = bpe._codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    real = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    import numpy as np

    for text, ids in zip(TEXTS, encoder.encode(TEXTS), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == real.encode_ordinary(text), text[:20]
        assert vocabulary.decode(ids) == text.encode()


def test_long_pieces_match_the_library(monkeypatch):
    """Runs of letters, repeats and bytes that are no text; also ranks that fall when tokens grow, against merges one by one."""
    import random

    import numpy as np

    tiktoken = pytest.importorskip("tiktoken")
    vocabulary, _ = bpe._codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    real = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    rng = random.Random(6)
    pieces = ["".join(rng.choices(letters, k=n)) for letters, n in (("abcdefghijklmnopqrstuvwxyz", 20_000), ("ab", 9000), ("a", 5001), ("éß漢", 4000), ("etaoin", 30_000))]
    for piece, ids in zip(pieces, vocabulary.encode_pieces(pieces), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == real.encode_ordinary(piece)
    # Random ranks: longer tokens may come before their parts.
    monkeypatch.setattr(bpe, "LONG", 3)
    for _ in range(60):
        tokens = {bytes(rng.choices(b"abc", k=rng.randint(2, 5))) for _ in range(40)}
        ranks = [bytes([b]) for b in range(256)] + sorted(tokens, key=lambda _: rng.random())
        own = bpe.BytePairVocabulary({t: k for k, t in enumerate(ranks)})
        for text in ("".join(rng.choices("abc", k=rng.randint(3, 60))) for _ in range(20)):
            ids = [own.ranks[bytes([b])] for b in text.encode()]
            while True:
                pairs = [(own.ranks.get(own.tokens[a] + own.tokens[b], 1 << 30), k) for k, (a, b) in enumerate(zip(ids, ids[1:]))]
                if not pairs or min(pairs)[0] == 1 << 30:
                    break
                rank, k = min(pairs)
                ids[k : k + 2] = [rank]
            if text.encode() not in own.ranks:
                assert np.frombuffer(own.encode_pieces([text])[0], "<u4").tolist() == ids, text


def test_query_columns(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*TEXTS, None])], "doc_id long, text string, ids int")
    path = P.path("byte_bpe_50k.tiktoken")
    rows = {r.doc_id: r for r in bpe.digest_ids(bpe.encode_texts(df, path, P.PATTERN), path, P.PATTERN).collect()}
    assert len(rows) == len(TEXTS) + 1
    for i, t in enumerate([*TEXTS, ""]):
        assert rows[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert rows[len(TEXTS)].n_tokens == 0
    assert bpe.encode_texts(df.limit(0), path, P.PATTERN).count() == 0


def test_pieces_tokenize_as_whole_texts():
    from tokenizers import Tokenizer
    import numpy as np

    real = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    encode = packing._tokenizer(P.path("byte_bpe_50k.json"), P.PATTERN)
    for text, ids in zip(TEXTS, encode(TEXTS), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == real.encode(text, add_special_tokens=False).ids, text[:20]


def test_ascii_pattern_cuts_alike():
    import random
    import re

    import regex

    from hoploom.llm.pieces import ASCII_PATTERN

    rng, a, b = random.Random(5), re.compile(ASCII_PATTERN).findall, regex.compile(P.PATTERN).findall
    for _ in range(3000):
        text = "".join(chr(rng.choice([rng.randrange(128), 32, 39, rng.choice(b"abdelmrstv \t\n\r_0")])) for _ in range(rng.randrange(30)))
        assert a(text) == b(text), repr(text)
