import hashlib
import zlib

from pyspark.sql import functions as F

from hoploom.llm import interleaved as m


def test_sequence_order_and_captions():
    html = "<p>one</p><figure><img src='sha256:aa' alt='x'><figcaption>Cap &amp; tion</figcaption></figure>two <img src=sha256:bb alt=alt> three<script>no</script><img alt=none>"
    got = [(e["pos"], e["kind"], e["text"], e["digest"], e["caption"]) for e in m.parse_sequence(html)]
    assert got == [(0, "text", "one", None, None), (1, "media", None, "aa", "Cap & tion"), (2, "text", "two", None, None), (3, "media", None, "bb", "alt"), (4, "text", "three", None, None)]
    assert m.parse_sequence(None) == []


def test_payload_round_trip(spark):
    texts = [None, "", "a", "x" * 192, "x" * 193, "é<&>\n" * 1000, "a", "z" * 100000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    stored = df.withColumn("media", m.stored_form(m.padded(F.col("text")), F.coalesce(F.octet_length("text"), F.lit(0)))).withColumn("digest", F.sha2("media", 256))
    media = m.media_features(stored.groupBy("digest").agg(F.first("media").alias("media")))
    pages = stored.select("doc_id", F.concat(F.lit("<img src='sha256:"), "digest", F.lit("'>")).alias("html")).union(spark.createDataFrame([(99, "<img src=sha256:gone>")], "doc_id long, html string"))
    got = {r.doc_id: r for r in m.resolve(m.sequences(pages, "doc_id"), media.withColumn("pos", F.lit(0)), "doc_id").collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        want = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-16:]))
        assert got[i].media_sha256 == got[i].digest
    assert got[2].feature == got[6].feature and got[99].feature is None
    assert m.resolve(m.sequences(pages.limit(0), "doc_id"), media, "doc_id").count() == 0


def test_query_of_whole_documents(spark, tmp_path):
    """Payloads, positions, captions and the text around the figures, through the query itself."""
    texts = [None, "", "one line", "a\nb\nc\nd", "a <b> & c\n\n  d\u00a0e \nf", "x" * 5000 + "\n" + "y z " * 3000, "a\nb\nc\nd", "é" * 100 + "\r\nnext"]
    spark.createDataFrame([(i, t, None if i == 3 else f"s<{i}>") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in m.op3_media(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        want = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        assert (got[i].n_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(raw), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-16:]))
        lines = [" ".join(x.split()) for x in (t or "").split("\n")]
        half = int(len(lines) / 2 + 0.5)
        assert got[i].position == sum(map(bool, lines[:half])) and got[i].n_elements == sum(map(bool, lines)) + 1
        assert got[i].spans_sha256 == hashlib.sha256("\n".join(filter(None, lines)).encode()).hexdigest()
        assert got[i].caption == (None if i == 3 else f"s<{i}>")
    assert got[3].position == 2 and got[3].feature == got[6].feature
