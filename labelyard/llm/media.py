"""Media columns: interleaved document sequences with stored payloads.

A document is a page of text and media references. Parsing gives an ordered array of structs, a
text or a reference with its caption in each; references are digests of stored media, joined to
what the media hold. Payloads are stored as 8-bit greyscale PNG images, 192 samples to a row.
"""

from __future__ import annotations

import hashlib
import html as markup
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.hot import join_split
from .common import batches, cut

WIDTH = 192
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SCHEME = "media:sha256/"
ITEMS = "array<struct<pos:int,kind:string,text:string,ref:string,caption:string>>"


def pad(data: bytes) -> bytes:
    """Spaces up to a positive multiple of WIDTH."""
    return data.ljust(max(1, -(-len(data) // WIDTH)) * WIDTH)


def png(payload: bytes) -> bytes:
    """A greyscale image of the payload's bytes."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


def samples(image: bytes) -> np.ndarray:
    """The samples of an image that ``png`` has made, as rows; checks every chunk."""
    if not image.startswith(SIGNATURE):
        raise ValueError("not a PNG image")
    at, data, size = len(SIGNATURE), b"", (0, 0)
    while at < len(image):
        (n,) = struct.unpack_from(">I", image, at)
        kind, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", image, at + 8 + n)[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            size = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            data += body
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(size[1], size[0] + 1)
    if rows[:, 0].any():
        raise ValueError("row filters aren't used here")
    return rows[:, 1:]


def feature(rows: np.ndarray) -> str:
    """Size, mean, contrast between neighbours and the shares of eight brightness classes."""
    flat = rows.ravel()
    hist = np.bincount(flat >> 5, minlength=8)
    steps = np.abs(np.diff(flat.astype(np.int16))).sum()
    return f"{rows.shape[1]}x{rows.shape[0]} mean={flat.sum() / flat.size:.4f} step={steps / max(1, flat.size - 1):.4f} hist={','.join(str(int(x)) for x in hist)}"


class _Page(HTMLParser):
    """Text runs and images in order; a figure's caption belongs to its last image."""

    BLOCKS = {"p", "div", "figure", "figcaption", "article", "section", "li", "br", "h1", "h2", "h3", "tr", "td", "title"}
    HIDDEN = {"script", "style"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.hidden = 0
        self.caption: list[str] | None = None

    def end_text(self) -> None:
        if said := " ".join("".join(self.text).split()):
            self.items.append({"kind": "text", "text": said, "ref": None, "caption": None})
        self.text = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in self.BLOCKS or tag == "img":
            self.end_text()
        if tag in self.HIDDEN:
            self.hidden += 1
        elif tag == "img":
            given = dict(attrs)
            if ref := given.get("src"):
                self.items.append({"kind": "media", "text": None, "ref": ref.removeprefix(SCHEME), "caption": given.get("alt") or None})
        elif tag == "figcaption":
            self.caption = []

    def handle_endtag(self, tag: str) -> None:
        if tag in self.HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            said = " ".join("".join(self.caption).split())
            last = next((x for x in reversed(self.items) if x["kind"] == "media"), None)
            if last and said:
                last["caption"] = said
            self.caption = None
        elif tag in self.BLOCKS:
            self.end_text()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            (self.text if self.caption is None else self.caption).append(data)


def parse(page: str) -> list[dict]:
    """Ordered items of a page: pos, kind (text or media), text, ref and caption."""
    reader = _Page()
    reader.feed(page)
    reader.close()
    reader.end_text()
    return [{"pos": i, **x} for i, x in enumerate(reader.items)]


def page(text: str, digest: str, caption: str) -> str:
    """The whole text as paragraphs, one a line, with a figure between the two halves of them."""
    parts = [f"<p>{markup.escape(line)}</p>" for line in text.split("\n")]
    figure = f'<figure><img src="{SCHEME}{digest}"><figcaption>{caption}</figcaption></figure>'
    return "<article>" + "".join([*parts[: len(parts) // 2], figure, *parts[len(parts) // 2 :]]) + "</article>"


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, html, digest, media): each text (null: empty) as a stored image, and a
    page of the text that refers to it by digest."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches(it):
            images = [png(pad(t)) for t in texts]
            digest = [hashlib.sha256(m).hexdigest() for m in images]
            pages = [page(t.decode(), d, f"{len(t)} bytes") for d, t in zip(digest, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(pages, pa.string()), pa.array(digest, pa.string()), pa.array(images, pa.binary())], names=["doc_id", "n_bytes", "html", "digest", "media"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, html string, digest string, media binary")


def parsed(pages: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns and ``items`` of rows with ``html``; a null page has no items."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))
        for batch in it:
            items = [parse(p or "") for p in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(items, kind)], names=[*keep, "items"])

    rows = pages.select(*keep, "html")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "html")
    return rows.mapInArrow(run, f"{kinds}, items {ITEMS}")


def described(media: DataFrame) -> DataFrame:
    """One row for each digest of (digest, media): what the stored bytes hold when read back."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, images in batches(it, "media"):
            rows = [samples(m) for m in images]
            payload = [r.tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(p) for p in payload], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in payload]), pa.array([zlib.crc32(p[-16:]) for p in payload], pa.int64()),
                 pa.array([len(m) for m in images], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in images]), pa.array([feature(r) for r in rows])],
                names=["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    return media.select("digest", "media").mapInArrow(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").dropDuplicates(["digest"])


def resolved(items: DataFrame, media: DataFrame) -> DataFrame:
    """``items`` (key first, then pos, kind, text, ref, caption...) with the columns of ``media``
    (digest, ...), joined by digest; a digest that many pages refer to is split. Texts and
    references without stored media keep nulls there; pos and caption stay."""
    texts = items.filter("kind <> 'media'")
    found = join_split(items.filter("kind = 'media'"), media.withColumnRenamed("digest", "ref"), "ref", by=items.columns[0], how="left")
    return found.unionByName(texts, allowMissingColumns=True)


def exploded(pages: DataFrame) -> DataFrame:
    """A row for each item of ``parsed`` pages, beside the pages' other columns."""
    rest = [c for c in pages.columns if c != "items"]
    return pages.select(*rest, F.explode("items").alias("x")).select(*rest, "x.*")


def sequences(items: DataFrame, key: str) -> DataFrame:
    """(key, items): the items of each page in order again."""
    rest = [c for c in items.columns if c != key]
    return items.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", *[c for c in rest if c != "pos"]))).alias("items"))


def columns(docs: DataFrame) -> DataFrame:
    """A row of media columns for each row of ``docs``, with the media item's place and caption in
    its page's sequence, and the sequence's items and characters of text. Equal texts have equal
    values."""
    stored = store(docs)
    media = cut(described(stored.select("digest", "media")))
    pages = parsed(stored, "doc_id", "n_bytes")
    chars = F.aggregate("items", F.lit(0).cast("long"), lambda n, x: n + F.coalesce(F.length(x["text"]), F.lit(0)))
    items = exploded(pages.select("doc_id", "n_bytes", F.size("items").alias("n_items"), chars.alias("text_chars"), "items"))
    # texts stay where they were parsed; only the references move
    found = resolved(cut(items.filter("kind = 'media'")), media)
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos", "caption", "n_items", "text_chars")
