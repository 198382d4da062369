"""Layer archives to entries: a row per tar entry, with the content of small text files only.

Distinct layers are decoded once each, on the executors, from a stream: memory holds one file. A limit or a bad archive gives a
row of kind `error` after the entries that were read, never a failing task.
"""

from __future__ import annotations

import gzip
import io
import posixpath
import tarfile
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..operators import metadata
from .config import Settings

PRINTABLE = 0.85
_KINDS = {tarfile.REGTYPE: "regular", tarfile.AREGTYPE: "regular", tarfile.LNKTYPE: "hardlink", tarfile.SYMTYPE: "symlink"}


class Limit(Exception):
    """A layer is larger than a limit allows."""


class _Counted(io.RawIOBase):
    """A stream that stops with Limit beyond its number of bytes (0: none)."""

    def __init__(self, inner, most: int) -> None:
        self.inner, self.most, self.seen = inner, most, 0

    def readable(self) -> bool:
        return True

    def read(self, n: int = -1) -> bytes:
        got = self.inner.read(n)
        self.seen += len(got)
        if self.most and self.seen > self.most:
            raise Limit("layer bytes")
        return got


def clean_path(name: str) -> str:
    """Without leading or trailing slashes and dot segments; '' for the root."""
    out = posixpath.normpath("/" + name.strip()).strip("/")
    return "" if out == "." else out


def printable_ratio(data: bytes) -> float:
    """Share of printable characters (bytes where it is no UTF-8); line ends and tabs are printable."""
    if not data:
        return 1.0
    try:
        chars = data.decode("utf-8")
        return sum(c in "\n\r\t" or c.isprintable() for c in chars) / len(chars)
    except UnicodeDecodeError:
        return sum(b in (9, 10, 13) or 32 <= b < 127 for b in data) / len(data)


def content_class(path: str, data: bytes) -> str:
    """text, or why a file isn't read as text."""
    if not data:
        return "text"
    low = printable_ratio(data) < PRINTABLE
    base = posixpath.basename(path)
    if data.startswith(b"\x7fELF") or ((base.endswith(".so") or ".so." in base) and (b"\0" in data or low)):
        return "binary_shared_object"
    return "binary_nul" if b"\0" in data else "binary_low_printable" if low else "text"


def text_class(text: Column) -> Column:
    """content_class of strings (valid UTF-8, no library name), as a column."""
    n = F.char_length(text)
    good = F.char_length(F.regexp_replace(text, r"[^\n\r\t\p{L}\p{M}\p{N}\p{P}\p{S} ]", ""))
    return F.when(n == 0, "text").when(text.startswith("\x7fELF"), "binary_shared_object").when(F.instr(text, "\x00") > 0, "binary_nul").when(good < PRINTABLE * n, "binary_low_printable").otherwise("text")


def _plain(kind: str, source: BinaryIO):
    if kind == "gzip":
        return gzip.GzipFile(fileobj=source)
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().stream_reader(source, read_across_frames=True)
    if kind == "none":
        return source
    raise ValueError(f"{kind} layer")


def entries(data: bytes | BinaryIO, compression: str, limits: Settings = Settings()) -> Iterator[dict]:
    """The entries of one archive, bytes or a stream, in order; the last is of kind error if it could not be read to its end."""
    n = 0
    row = lambda **x: {"entry_idx": n, "path": "", "kind": "", "linkname": "", "size": 0, "content_class": "", "scannable": False, "content": None} | x
    try:
        with tarfile.open(fileobj=_Counted(_plain(compression, io.BytesIO(data) if isinstance(data, bytes) else data), limits.max_layer_bytes), mode="r|", bufsize=65536) as tar:
            for m in tar:
                if limits.max_layer_entries and n >= limits.max_layer_entries:
                    raise Limit("layer entries")
                path, kind = clean_path(m.name), _KINDS.get(m.type, "other")
                if path:
                    got = row(path=path, kind=kind, linkname=clean_path(m.linkname) if kind == "hardlink" else m.linkname, size=m.size)
                    if kind == "regular":
                        body = tar.extractfile(m).read(limits.max_file_bytes + 1)
                        if len(body) > limits.max_file_bytes:
                            got["content_class"] = "oversize"
                        else:
                            got["content_class"] = content_class(path, body)
                            got["scannable"] = got["content_class"] == "text"
                            got["content"] = body if got["scannable"] else None
                    yield got
                n += 1
    except Limit as e:
        yield row(kind="error", path=f"limit: {e}")
    except Exception as e:  # noqa: BLE001  any broken archive is a row
        yield row(kind="error", path=f"unreadable: {e}"[:300])


def failure(why: str) -> dict:
    """The row of a layer that could not be opened."""
    return {"entry_idx": 0, "path": f"unreadable: {why}"[:300], "kind": "error", "linkname": "", "size": 0, "content_class": "", "scannable": False, "content": None}


_ENTRIES = pa.schema([("layer_digest", pa.string()), ("entry_idx", pa.int32()), ("path", pa.string()), ("kind", pa.string()), ("linkname", pa.string()), ("size", pa.int64()), ("content_class", pa.string()), ("scannable", pa.bool_()), ("content", pa.binary())])


def batches_of(digest: str, found: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    """Entries of one layer in batches of some megabytes."""
    part, size = [], 0
    for e in found:
        part.append(e | {"layer_digest": digest})
        size += len(e["content"] or b"") + 100
        if size > 4 << 20:
            yield pa.RecordBatch.from_pylist(part, schema=_ENTRIES)
            part, size = [], 0
    if part:
        yield pa.RecordBatch.from_pylist(part, schema=_ENTRIES)


def decode(layers: DataFrame, limits: Settings = Settings()) -> DataFrame:
    """layer_digest, media_type and blob (binary), a row per distinct layer, to schema.LAYER_ENTRIES. Blobs are not shuffled here."""
    one = layers.select("layer_digest", metadata.compression(metadata.media_type(F.col("media_type"))).alias("c"), "blob")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield from batches_of(b["layer_digest"][i].as_py(), entries(b["blob"][i].as_py() or b"", b["c"][i].as_py(), limits))

    return one.mapInArrow(run, schema.LAYER_ENTRIES)
