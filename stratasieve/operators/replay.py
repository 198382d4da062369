"""Layer replay: which entries of an image are final and which a later layer deleted.

A path's live entry ends at the next event on the path (a put, or a whiteout of the path) or at the next opaque whiteout
of a directory above it. A hardlink copies what is live at its target at that moment, a symlink there as an empty file; without a live target it is no event.
The events of a manifest are folded in tar order, one manifest after the other, so chains of links of any length take one pass and the events are computed once.
An opaque whiteout touches no path: its time is added to its directory, and an entry that ends looks up the first such time after its own by bisection, so a
manifest costs a sort and a few steps for each event and directory above it. A manifest's entries are bounded by the limits on layers; a task holds the live ones of one manifest.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPAQUE = ".wh..wh..opq"
PREFIX = ".wh."


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def events(manifest_layers: DataFrame, layer_entries: DataFrame) -> DataFrame:
    """manifest_digest, seq, layer_idx, layer_digest, entry_idx, path and op (put, whiteout, opaque), kind, linkname. No content."""
    e = layer_entries.where("kind in ('regular', 'hardlink', 'symlink')").select("layer_digest", "entry_idx", "path", "kind", "linkname")
    x = manifest_layers.select("manifest_digest", "layer_idx", "layer_digest").join(e, "layer_digest")
    base = basename(F.col("path"))
    op = F.when(base == OPAQUE, "opaque").when(base.startswith(PREFIX), "whiteout").otherwise("put")
    x = x.withColumn("op", op).withColumn("seq", F.col("layer_idx").cast("long") * (1 << 32) + F.col("entry_idx"))
    target = F.when(F.col("op") == "opaque", dirname(F.col("path"))).when(F.col("op") == "whiteout", F.concat(F.when(dirname(F.col("path")) != "", F.concat(dirname(F.col("path")), F.lit("/"))).otherwise(""), F.expr("substring(substring_index(path, '/', -1), 5)"))).otherwise(F.col("path"))
    return x.withColumn("path", target)


_FOLDED = ["manifest_digest", "seq", "path", "op", "kind", "linkname", "layer_digest", "entry_idx"]
_REPLAYED = pa.schema([(c, pa.int32() if c in ("entry_idx", "src_entry") else pa.string()) for c in ("manifest_digest", "path", "kind", "layer_digest", "entry_idx", "src_layer", "src_entry", "state", "deleted_by")])
#: rows of a batch that the fold gives on
_ROWS = 1 << 16


class _Image:
    """The live entries of one manifest and the times at which its directories were swept."""

    def __init__(self) -> None:
        self.live: dict = {}  # path: seq, kind, layer, entry, layer and entry of the content
        self.times: dict[str, list[int]] = {}
        self.above: dict[str, tuple[list[int], ...]] = {}
        self.layers: dict[int, str] = {}

    def swept(self, path: str | None) -> tuple[list[int], ...]:
        """The times of all directories above path; later ones are added to the same lists."""
        if path is None:
            return ()
        where = path.rpartition("/")[0]
        if where not in self.above:
            names = {"", where, *(where[:k] for k, x in enumerate(where) if x == "/")}
            self.above[where] = tuple(self.times.setdefault(x, []) for x in names)
        return self.above[where]

    def end(self, path: str | None, seq: int, before: int | None) -> int | None:
        """When the entry put at seq ended: at the first sweep after it, at the latest at `before`."""
        for t in self.swept(path):
            if t and t[-1] > seq:
                at = t[bisect_right(t, seq)]
                before = at if before is None or at < before else before
        return before


def _values(a: pa.Array) -> list:
    """to_pylist() by way of NumPy, which makes all strings at once."""
    return a.to_pylist() if pa.types.is_integer(a.type) and a.null_count else a.to_numpy(zero_copy_only=False).tolist()


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every regular file and live hardlink, from the events of whole manifests in order."""
    now, image, out = object(), _Image(), []

    def ended(m: str | None, path: str | None, x: tuple, before: int | None) -> None:
        seq, kind, layer, entry, src, src_entry = x
        if kind != "symlink":
            at = image.end(path, seq, before)
            out.append((m, path, kind, layer, entry, src, src_entry, "final", "") if at is None else (m, path, kind, layer, entry, src, src_entry, "deleted", image.layers[at >> 32] or ""))

    def given(least: int) -> Iterator[pa.RecordBatch]:
        while len(out) > least:
            rows = out[-_ROWS:]
            del out[-_ROWS:]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _REPLAYED.types)], schema=_REPLAYED)

    for b in batches:
        for m, seq, path, op, kind, link, layer, entry in zip(*(_values(b[c]) for c in _FOLDED)):
            if m != now:
                for p, x in image.live.items():
                    ended(now, p, x, None)
                now, image = m, _Image()
                yield from given(_ROWS)
            image.layers[seq >> 32] = layer
            if op == "opaque":
                image.times.setdefault(path, []).append(seq)
                continue
            src = layer, entry
            if op == "put" and kind == "hardlink":
                target = image.live.get(link)
                if target is None or image.end(link, target[0], None) is not None:
                    continue
                src = target[4:]
            old = image.live.pop(path, None)
            if old is not None:
                ended(m, path, old, seq)
            if op == "put":
                image.live[path] = (seq, kind, layer, entry, *src)
        yield from given(_ROWS)
    for p, x in image.live.items():
        ended(now, p, x, None)
    yield from given(0)


def replay(manifest_layers: DataFrame, layer_entries: DataFrame) -> DataFrame:
    """manifest_digest, path, kind, layer_digest, entry_idx, src_layer, src_entry, state (final or deleted) and deleted_by of every file that an image has or had. Overwritten symlinks are dropped, others too."""
    ev = events(manifest_layers, layer_entries).withColumns({"entry_idx": F.col("entry_idx").cast("int"), "seq": F.coalesce("seq", F.lit(-1))}).select(*_FOLDED)
    types = ", ".join(f"{f.name} {'int' if f.type == pa.int32() else 'string'}" for f in _REPLAYED)
    return ev.repartition("manifest_digest").sortWithinPartitions("manifest_digest", "seq").mapInArrow(_fold, types)


def content_rows(replayed: DataFrame, layer_entries: DataFrame, platforms: DataFrame | None = None) -> DataFrame:
    """Content rows of scannable, non-empty files; the layer that deleted a file is not passed on."""
    c = layer_entries.where("scannable and length(content) > 0").select(F.col("layer_digest").alias("src_layer"), F.col("entry_idx").alias("src_entry"), "content")
    rows = replayed.join(c, ["src_layer", "src_entry"])
    final = F.col("state") == "final"
    rows = rows.select("manifest_digest", F.when(final, "file_final").otherwise("file_deleted_layer").alias("source_type"), F.col("path").alias("file_path"), "layer_digest", F.lit("").alias("key"), final.alias("present_in_final_image"), "content")
    return rows.join(platforms.select("manifest_digest", "platform"), "manifest_digest", "left") if platforms is not None else rows.withColumn("platform", F.lit(""))
