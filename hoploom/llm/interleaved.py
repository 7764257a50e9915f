"""Media columns: documents as ordered sequences of text and media.

A page is parsed into elements (position, kind, text, digest, caption) in page
order. A media reference names its payload by the digest of the stored bytes;
payloads live once each in a media table and are resolved by a join on the
digest. Captions come from the figure's caption, else from the alternative
text, and stay with their element. The spans of text between the references are
told by the digest of what they hold together.

A payload is stored as a binary PPM image of 64 pixels a row (192 bytes), whose
comment line holds the unpadded length; what is read back is parsed from these
bytes alone.

Defined results: null and empty pages have no elements; very long pages are parsed
whole; a reference that is repeated is one element each time; an empty table gives
no rows; references that no payload
resolves keep null columns; equal payloads are stored once; null and empty
texts are a payload of 192 blanks; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_slices, table

ROW_BYTES = 192
ELEMENTS = "array<struct<pos:int,kind:string,text:string,digest:string,caption:string>>"
_BREAKS = frozenset("p div article section h1 h2 h3 h4 h5 h6 li ul ol blockquote figure figcaption br table tr td body html main".split())


class _Sequence(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.elements: list[dict] = []
        self._text: list[str] = []
        self._figure: list[dict] | None = None
        self._caption: list[str] | None = None
        self._skip = 0

    def _flush(self) -> None:
        if text := " ".join("".join(self._text).split()):
            self.elements.append({"kind": "text", "text": text, "digest": None, "caption": None})
        self._text = []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self._skip += 1
        elif tag == "figcaption":
            self._caption = []
        elif tag in ("img", "video", "audio", "source"):
            given = dict(attrs)
            if src := given.get("src"):
                self._flush()
                found = {"kind": "media", "text": None, "digest": src.removeprefix("sha256:"), "caption": given.get("alt") or None}
                self.elements.append(found)
                if self._figure is not None:
                    self._figure.append(found)
        elif tag in _BREAKS:
            self._flush()
            if tag == "figure":
                self._figure = []

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self._skip = max(0, self._skip - 1)
        elif tag == "figcaption" and self._caption is not None:
            caption = " ".join("".join(self._caption).split())
            for found in self._figure or []:
                found["caption"] = caption or found["caption"]
            self._caption = None
        elif tag in _BREAKS:
            self._flush()
            if tag == "figure":
                self._figure = None

    def handle_data(self, data):
        if not self._skip:
            (self._text if self._caption is None else self._caption).append(data)


def parse_sequence(html: str | None) -> list[dict]:
    """The page's elements in order."""
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    parser._flush()
    return [{"pos": k} | e for k, e in enumerate(parser.elements)]


def sequences(pages: DataFrame, id_col: str, html_col: str = "html") -> DataFrame:
    """id, ``elements`` in page order."""

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))
        for part in arrow_slices(batches, 500):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(parse_sequence, part.column(1).to_pylist()), kind)], names=[id_col, "elements"])

    return pages.select(id_col, html_col).mapInArrow(run, f"{id_col} {dict(pages.dtypes)[id_col]}, elements {ELEMENTS}")


def spans_digest(elements: Column) -> Column:
    """SHA-256 of an element list's texts in order, one a line."""
    return F.sha2(F.array_join(F.transform(F.filter(elements, lambda e: e["kind"] == "text"), lambda e: e["text"]), "\n"), 256)


def resolve(found: DataFrame, media: DataFrame, id_col: str) -> DataFrame:
    """One row per element with the media table's columns beside it.

    Other columns of ``found`` stay. Only references are joined; the join is by digest
    and left to Spark, which splits a digest that a large part of all references names.
    """
    others = [c for c in found.columns if c not in (id_col, "elements")]
    elements = found.select(id_col, *others, F.explode("elements").alias("e")).select(id_col, *others, "e.*")
    taken = media.select([F.col(c) for c in media.columns if c == "digest" or c not in {id_col, *others, "pos", "kind", "text", "caption"}])
    return elements.where("kind = 'media'").join(taken, "digest", "left")


def stored_form(payload: Column, n_bytes: Column) -> Column:
    """A payload of a multiple of 192 bytes as a binary PPM image."""
    header = F.concat(F.lit("P6\n# bytes "), n_bytes.cast("string"), F.lit(f"\n{ROW_BYTES // 3} "), (F.octet_length(payload) / ROW_BYTES).cast("long").cast("string"), F.lit("\n255\n"))
    return F.concat(F.encode(header, "UTF-8"), payload)


def padded(text: Column) -> Column:
    """UTF-8 bytes with blanks up to a positive multiple of 192."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    n = F.octet_length(raw)
    want = F.greatest(F.ceil(n / ROW_BYTES), F.lit(1)) * ROW_BYTES
    return F.concat(raw, F.encode(F.repeat(F.lit(" "), (want - n).cast("int")), "UTF-8"))


_HEADER = re.compile(rb"P6\n# bytes (\d+)\n(\d+) (\d+)\n255\n")


def read_stored(media: bytes) -> tuple[int, np.ndarray]:
    """The unpadded length and the samples (rows, pixels, channels) of a stored payload."""
    head = _HEADER.match(media)
    if head is None:
        raise ValueError("not a stored payload")
    n, width, height = map(int, head.groups())
    return n, np.frombuffer(media, dtype=np.uint8, offset=head.end()).reshape(height, width, 3)


def feature_of(samples: np.ndarray) -> str:
    """Channel means and deviations to three digits, and a 64-bit average hash of column brightness, in hexadecimal."""
    flat = samples.reshape(-1, 3)
    sums, squares, n = flat.sum(axis=0, dtype=np.int64), (flat.astype(np.int32) ** 2).sum(axis=0, dtype=np.int64), len(flat)
    columns = samples.sum(axis=(0, 2), dtype=np.int64)
    bits = (columns * len(columns) > columns.sum()).astype(np.uint8)
    deviations = [(max(0, q * n - s * s)) ** 0.5 / n for s, q in zip(sums.tolist(), squares.tolist(), strict=True)]
    return ",".join([f"{s / n:.3f}" for s in sums.tolist()] + [f"{d:.3f}" for d in deviations]) + "," + np.packbits(bits).tobytes().hex()


def media_features(media: DataFrame) -> DataFrame:
    """Reads stored payloads (digest, media) back; digests and features of what they hold."""

    def run(batches):
        import pyarrow as pa

        for part in arrow_slices(batches, 200):
            rows = []
            for digest, stored in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                n, samples = read_stored(stored)
                payload = samples.tobytes()
                rows.append((digest, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature_of(samples)))
            names = ["digest", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)))

    return media.select("digest", "media").mapInArrow(
        run, "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )


def _as_markup(text: Column) -> Column:
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def _paragraphs(lines: Column) -> Column:
    """Lines of markup as paragraphs; no lines, nothing."""
    return F.array_join(F.transform(lines, lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))), "")


def as_page(text: Column, digest: Column, caption: Column) -> Column:
    """A text's lines as paragraphs, with the figure of the digest after half of them."""
    lines = F.split(_as_markup(text), "\n", -1)
    half = F.floor(F.size(lines) / 2 + 0.5).cast("int")
    figure = F.concat(F.lit('<figure><img src="sha256:'), digest, F.lit('"><figcaption>'), _as_markup(caption), F.lit("</figcaption></figure>"))
    return F.concat(F.lit("<article>"), _paragraphs(F.slice(lines, F.lit(1), half)), figure, _paragraphs(F.slice(lines, half + 1, F.size(lines) - half)), F.lit("</article>"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a page with a figure between its lines that names its payload; payloads stored once, read back and resolved by digest.

    ``position`` is the figure's place among the ``n_elements`` of its page, ``spans_sha256`` the digest of the text around it.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "source")
    docs = docs.withColumn("media", stored_form(padded(F.col("text")), F.octet_length("text"))).withColumn("digest", F.sha2("media", 256))
    media = media_features(docs.groupBy("digest").agg(F.first("media").alias("media")))
    pages = docs.select("doc_id", as_page(F.col("text"), F.col("digest"), F.coalesce("source", F.lit(""))).alias("html"))
    found = sequences(pages, "doc_id").withColumn("n_elements", F.size("elements")).withColumn("spans_sha256", spans_digest(F.col("elements")))
    return resolve(found, media, "doc_id").select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", F.col("pos").alias("position"), "caption", "n_elements", "spans_sha256"
    )
