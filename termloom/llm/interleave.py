"""Interleaved document sequences: text and media in their order.

``parse`` turns HTML into an ordered sequence of text and media-reference structs, captions at
their media.  ``store`` keeps payloads losslessly as 8-bit grey-scale images, named by the
SHA-256 of the payload; ``describe`` reads stored images back and computes their features; and
``resolve`` joins references to what is known of each payload by digest, positions and captions
as they were.  Payloads are not shuffled: they are described where they are stored, and the join
moves descriptions.  Copies have one description, taken before the shuffle; Spark may split the
rows of a hot digest in the join.

Edge cases: null HTML gives an empty sequence; a medium without a source is dropped; a reference
that the store lacks keeps its place with null description; a null text is an empty one, stored
as 64 zero bytes; repeated rows are rows of their own; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from html.parser import HTMLParser
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import materialise

UNIT = 64
#: Bytes of payload in a batch that goes back to Spark, about.
BATCH = 8 << 20
MEDIA = {"img", "video", "audio", "source", "embed"}
HIDDEN = {"script", "style", "template", "noscript"}
BLOCKS = {"p", "div", "br", "hr", "li", "ul", "ol", "table", "tr", "td", "th", "article", "section", "header", "footer", "nav", "aside", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "title", "figure", "figcaption", "main", "body", "dt", "dd"}

ITEM = T.StructType().add("pos", "integer").add("kind", "string").add("text", "string").add("ref", "string").add("caption", "string")


class _Sequence(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.hidden, self.figures, self.captions = 0, [], []

    def _break(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if not text:
            return
        if self.captions and self.figures:
            self.captions[-1].append(text)
        else:
            self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden += 1
        if tag in BLOCKS:
            self._break()
        if tag == "figure":
            self.figures.append(len(self.items))
        elif tag == "figcaption":
            self.captions.append([])
        elif tag in MEDIA and not self.hidden and (have := dict(attrs)).get("src"):
            self._break()
            self.items.append({"kind": "media", "text": None, "ref": have["src"], "caption": have.get("alt") or None})

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        if tag in BLOCKS:
            self._break()
        if tag == "figcaption" and self.captions:
            caption = " ".join(self.captions.pop())
            if caption and self.figures:
                for item in self.items[self.figures[-1] :]:
                    if item["kind"] == "media":
                        item["caption"] = caption
                if not any(x["kind"] == "media" for x in self.items[self.figures[-1] :]):
                    self.items.append({"kind": "caption", "text": caption, "ref": None, "caption": None})
        elif tag == "figure" and self.figures:
            first = self.figures.pop()
            early = [x for x in self.items[first:] if x["kind"] == "caption"]
            for item in self.items[first:]:  # a caption before its medium
                if item["kind"] == "media" and early and not item["caption"]:
                    item["caption"] = early[0]["text"]
            if early and any(x["kind"] == "media" for x in self.items[first:]):
                self.items[first:] = [x for x in self.items[first:] if x["kind"] != "caption"]

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)


def sequence(html: str | None) -> list[dict]:
    """Ordered items of one page."""
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    parser._break()
    for tag, still in (("figcaption", parser.captions), ("figure", parser.figures)):  # left open
        while still:
            parser.handle_endtag(tag)
    return [{"pos": i, **x, "kind": "text" if x["kind"] == "caption" else x["kind"]} for i, x in enumerate(parser.items)]


def parse(pages: DataFrame, html: str = "html") -> DataFrame:
    """Replace the column ``html`` by ``items``, the ordered sequence."""
    rest = [c for c in pages.columns if c not in (html, "items")]
    schema = T.StructType([pages.schema[c] for c in rest]).add("items", T.ArrayType(ITEM))
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))

    def run(batches):
        for batch in batches:
            items = pa.array([sequence(x) for x in batch.column(len(rest)).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(rest))), items], names=[*rest, "items"])

    return pages.select(*rest, html).mapInArrow(run, schema)


def encode(payload: bytes) -> bytes:
    """A grey-scale image of UNIT samples a row, one byte a sample."""
    return b"P5\n%d %d\n255\n" % (UNIT, len(payload) // UNIT) + payload


def decode(media: bytes) -> np.ndarray:
    kind, shape, depth, rest = media.split(b"\n", 3)
    width, height = map(int, shape.split())
    if kind != b"P5" or depth != b"255" or len(rest) != width * height:
        raise ValueError("not an image of this store")
    return np.frombuffer(rest, np.uint8).reshape(height, width)


def padded(text: bytes) -> bytes:
    """Zero bytes up to a positive multiple of UNIT."""
    return text + bytes(-len(text) % UNIT) if text else bytes(UNIT)


def feature(samples: np.ndarray) -> str:
    """Mean, deviation, eight-bin histogram and mean step between neighbours."""
    flat = samples.ravel()
    counts = np.bincount(flat, minlength=256)
    n, values = len(flat), np.arange(256)
    mean = float(counts @ values) / n
    deviation = max(0.0, float(counts @ values**2) / n - mean * mean) ** 0.5
    step = float(np.abs(np.diff(flat.astype(np.int16))).sum(dtype=np.int64)) / n
    return f"{mean:.4f} {deviation:.4f} {step:.4f} " + ",".join(str(int(x)) for x in counts.reshape(8, 32).sum(axis=1))


def _emit(rows: Iterator[tuple[int, tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, out = 0, []
    for size, row in rows:
        out.append(row)
        held += size
        if held > BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
            held, out = 0, []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)


STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("html", pa.string()), ("digest", pa.string()), ("media", pa.binary())])


def store(docs: DataFrame) -> DataFrame:
    """Store every text as an image and write a page that shows it: (doc_id, n_bytes, html, digest, media).

    A task stores a payload once; ``media`` is null where it has already done so.
    """

    def rows(batches):
        seen = set()
        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = value.as_buffer().to_pybytes() if value.is_valid else b""
                payload = padded(text)
                name = hashlib.sha256(payload).hexdigest()
                media = None if name in seen else encode(payload)
                if len(seen) < 1_000_000:
                    seen.add(name)
                page = f'<article><p>Document {doc}</p><figure><img src="sha256:{name}"><figcaption>{len(text)} bytes</figcaption></figure></article>'
                yield len(media or b""), (doc, len(text), page, name, media)

    select = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return materialise(select.mapInArrow(lambda b: _emit(rows(b), STORED), "doc_id long, n_bytes long, html string, digest string, media binary"), "media")


DESCRIBED = pa.schema([("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def describe(stored: DataFrame) -> DataFrame:
    """Read the stored images back: a row of facts and features per digest."""

    def rows(batches):
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                media = value.as_buffer().to_pybytes()
                samples = decode(media)
                payload = samples.tobytes()
                sha = hashlib.sha256(payload).hexdigest()
                if sha != name:
                    raise ValueError(f"stored payload {name} was damaged")
                yield 0, (name, len(payload), sha, crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples))

    schema = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    found = stored.where("media is not null").select("digest", "media").mapInArrow(lambda b: _emit(rows(b), DESCRIBED), schema)
    rest = [c for c in found.columns if c != "digest"]
    # copies are equal; written, so that the join that follows may split a hot digest
    return materialise(found.groupBy("digest").agg(F.min(F.struct(*rest)).alias("d")).select("digest", "d.*"), "described")


def resolve(parsed: DataFrame, known: DataFrame) -> DataFrame:
    """A row per item of each sequence, media with what ``known`` has of their digest."""
    items = parsed.select(*[c for c in parsed.columns if c != "items"], F.explode("items").alias("item")).select("*", "item.*").drop("item")
    items = items.withColumn("digest", F.regexp_extract("ref", "^sha256:([0-9a-f]{64})$", 1))
    return items.join(known, "digest", "left")
