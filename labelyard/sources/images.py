"""What image files say of themselves: size, orientation, and what is wrong, as columns."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADERS = "path string, filename string, length long, format string, width int, height int, orientation int, upright_width int, upright_height int, error string"
PNG, JPEG = b"\x89PNG\r\n\x1a\n", b"\xff\xd8"
#: JPEG markers of frames, which have the size, and markers without a length.
FRAMES = {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}
ALONE = {0x01, *range(0xD0, 0xD8)}
#: The TIFF tag of the orientation.
ORIENTATION = 0x0112


class Broken(Exception):
    """A file that can't be used; its text is the kind of error."""


def exif_orientation(data: bytes) -> int:
    """The orientation (1 to 8) in a TIFF block; 1 where it has none."""
    end = {b"II": "<", b"MM": ">"}.get(data[:2])
    if end is None or len(data) < 8:
        raise Broken("bad_exif")
    try:
        (at,) = struct.unpack_from(end + "I", data, 4)
        (n,) = struct.unpack_from(end + "H", data, at)
        for i in range(n):
            tag, kind, _, value = struct.unpack_from(end + "HHIH", data, at + 2 + 12 * i)
            if tag == ORIENTATION and kind == 3:
                return value if 1 <= value <= 8 else 1
    except struct.error:
        raise Broken("bad_exif") from None
    return 1


def _png(data: bytes) -> tuple[int, int, int]:
    at, size, orientation = len(PNG), None, 1
    while at < len(data):
        if at + 12 > len(data):
            raise Broken("truncated")
        length, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + length]
        if at + 12 + length > len(data):
            raise Broken("truncated")
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + length)[0]:
            raise Broken("bad_checksum")
        if size is None and (kind != b"IHDR" or length != 13):
            raise Broken("no_size")
        if kind == b"IHDR":
            size = struct.unpack_from(">II", body)
        elif kind == b"eXIf":
            orientation = exif_orientation(body)
        elif kind == b"IEND":
            return *size, orientation
        at += 12 + length
    raise Broken("truncated")


def _jpeg(data: bytes) -> tuple[int, int, int]:
    at, size, orientation = 2, None, 1
    while at < len(data):
        if data[at] != 0xFF:
            raise Broken("bad_marker")
        while at < len(data) and data[at] == 0xFF:
            at += 1
        if at >= len(data):
            break
        marker = data[at]
        at += 1
        if marker in ALONE:
            continue
        if marker == 0xD9:
            raise Broken("no_size") if size is None else Broken("no_pixels")
        if at + 2 > len(data):
            break
        (length,) = struct.unpack_from(">H", data, at)
        body = data[at + 2 : at + length]
        if at + length > len(data):
            break
        if marker in FRAMES:
            if length < 8:
                raise Broken("no_size")
            height, width = struct.unpack_from(">HH", body, 1)
            size = width, height
        elif marker == 0xE1 and body[:6] == b"Exif\0\0":
            orientation = exif_orientation(body[6:])
        elif marker == 0xDA:
            if size is None:
                raise Broken("no_size")
            if data.rfind(b"\xff\xd9", at + length) < 0:
                break
            return *size, orientation
        at += length
    raise Broken("truncated")


def header(data: bytes | None) -> tuple[str | None, int | None, int | None, int | None, str | None]:
    """(format, width, height, orientation, error) of a file's bytes. Kinds of error: empty,
    unknown_format, truncated, bad_checksum, bad_marker, no_size, no_pixels, bad_exif."""
    if not data:
        return None, None, None, None, "empty"
    kind = "png" if data.startswith(PNG) else "jpeg" if data.startswith(JPEG) else None
    if kind is None:
        return None, None, None, None, "unknown_format"
    try:
        width, height, orientation = (_png if kind == "png" else _jpeg)(data)
    except Broken as e:
        return kind, None, None, None, str(e)
    if not width or not height:
        return kind, None, None, None, "no_size"
    return kind, width, height, orientation, None


def headers(files: DataFrame) -> DataFrame:
    """One row for each of ``files`` (path, filename, length, content; as ``readers.scan_files`` has
    them with content): its format, size as stored and as seen upright, EXIF orientation, and the
    kind of error if it can't be used. No file fails the job. Contents stay in their tasks; they come
    from Spark's reader, so any store will do; it leaves out files without a byte."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = [header(b) for b in batch.column(3).to_pylist()]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            turned = [o is not None and o >= 5 for o in cols[3]]
            upright = [[a if not t else b for a, b, t in zip(x, y, turned, strict=True)] for x, y in ((cols[1], cols[2]), (cols[2], cols[1]))]
            out = [pa.array(cols[0], pa.string()), *[pa.array(c, pa.int32()) for c in (*cols[1:4], *upright)], pa.array(cols[4], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *out], names=[c.split()[0] for c in HEADERS.split(", ")])

    return files.select("path", "filename", F.col("length").cast("long"), "content").mapInArrow(run, HEADERS)


def decode_errors(found: DataFrame) -> DataFrame:
    """(path, review_reason): `decode_error:<kind>` of files that can't be used."""
    return found.filter("error is not null").select("path", F.concat(F.lit("decode_error:"), "error").alias("review_reason"))
