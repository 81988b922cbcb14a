"""Image files: TIFF without compression or with Deflate, MetaIO, and a PPM sink.

Files are read with Spark's ``binaryFile`` source, so any store that Spark
reads will do. One file is decoded by one task, into tiles that then spread.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# TIFF tag numbers and the sizes of its field types.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, ROWS, STRIP_BYTES = 256, 257, 258, 259, 273, 277, 278, 279
X_RES, Y_RES, RES_UNIT, TILE_W, TILE_H, TILES, TILE_BYTES, DESCRIPTION, SUBFILE = 282, 283, 296, 322, 323, 324, 325, 270, 254
TYPE_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 16: 8}
TYPE_CODES = {1: "B", 3: "H", 4: "I", 16: "Q"}


def image_format(content: bytes, path: str = "") -> str | None:
    """By the first bytes, or the ending for MetaIO headers."""
    if content[:4] in (b"II*\0", b"MM\0*"):
        return "tiff"
    if path.lower().endswith((".mhd", ".mha")):
        return "metaio"
    return "ppm" if content[:2] == b"P6" else None


def tiff_directories(content: bytes) -> list[dict[int, object]]:
    """The tags of each image in a classic TIFF."""
    order = "<" if content[:2] == b"II" else ">"
    (at,) = struct.unpack_from(order + "I", content, 4)
    out = []
    while at:
        (n,) = struct.unpack_from(order + "H", content, at)
        tags: dict[int, object] = {}
        for i in range(n):
            entry = at + 2 + 12 * i
            tag, kind, count = struct.unpack_from(order + "HHI", content, entry)
            size = TYPE_SIZES.get(kind, 1) * count
            where = entry + 8 if size <= 4 else struct.unpack_from(order + "I", content, entry + 8)[0]
            if kind == 2:
                tags[tag] = content[where : where + count].rstrip(b"\0").decode("latin-1")
            elif kind == 5:
                a, b = struct.unpack_from(order + "II", content, where)
                tags[tag] = a / b if b else 0.0
            elif kind in TYPE_CODES:
                tags[tag] = list(struct.unpack_from(f"{order}{count}{TYPE_CODES[kind]}", content, where))
        out.append(tags)
        (at,) = struct.unpack_from(order + "I", content, at + 2 + 12 * n)
    return out


def _inflate(data: bytes, compression: int) -> bytes:
    if compression == 1:
        return data
    if compression in (8, 32946):
        return zlib.decompress(data)
    raise NotImplementedError(f"TIFF compression {compression} is not supported (none and Deflate are)")


def tiff_tiles(content: bytes, tags: dict) -> Iterator[tuple[int, int, np.ndarray]]:
    """(ty, tx, array height x width x samples) of one image; strips are tiles of full width."""
    one = lambda tag, default=None: tags[tag][0] if tag in tags else default
    width, height, samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    kind = np.dtype({8: "u1", 16: ("<" if content[:2] == b"II" else ">") + "u2"}[one(BITS, 8)])
    tiled = TILES in tags
    tw, th = (one(TILE_W), one(TILE_H)) if tiled else (width, one(ROWS, height))
    across = -(-width // tw)
    offsets, sizes = (tags[TILES], tags[TILE_BYTES]) if tiled else (tags[STRIPS], tags[STRIP_BYTES])
    for k, (at, n) in enumerate(zip(offsets, sizes, strict=True)):
        ty, tx = divmod(k, across)
        raw = _inflate(content[at : at + n], one(COMPRESSION, 1))
        rows = th if tiled else min(th, height - ty * th)
        tile = np.frombuffer(raw, dtype=kind, count=rows * tw * samples).reshape(rows, tw, samples)
        yield ty, tx, tile[: height - ty * th, : width - tx * tw]


PIXELS = "path string, level int, y int, x int, c int, v double"


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    """All pixels of all TIFF files under ``path``; levels are ordered by size, largest first."""
    files = spark.read.format("binaryFile").load(path)

    def decode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if image_format(content, name) != "tiff":
                    raise ValueError(f"{name} is not a TIFF file")
                found = sorted(tiff_directories(content), key=lambda t: (-t[WIDTH][0], -t[HEIGHT][0]))
                for level, tags in enumerate(found):
                    th = tags[TILE_H][0] if TILES in tags else tags.get(ROWS, tags[HEIGHT])[0]
                    tw = tags[TILE_W][0] if TILES in tags else tags[WIDTH][0]
                    for ty, tx, tile in tiff_tiles(content, tags):
                        h, w, s = tile.shape
                        y, x, c = np.indices((h, w, s)).reshape(3, -1)
                        n = h * w * s
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([name] * n), pa.array(np.full(n, level, np.int32)), pa.array((y + ty * th).astype(np.int32)), pa.array((x + tx * tw).astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(tile.reshape(-1).astype(np.float64))],
                            names=["path", "level", "y", "x", "c", "v"],
                        )

    return files.select("path", "content").mapInArrow(decode, PIXELS)


METADATA = "path string, level int, width int, height int, channels int, bits int, tile_width int, tile_height int, spacing_x double, spacing_y double, description string, downsample double"


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row for each image of each TIFF file; spacing is in micrometres where the unit is known."""
    files = spark.read.format("binaryFile").load(path)

    def decode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = sorted(tiff_directories(content), key=lambda t: (-t[WIDTH][0], -t[HEIGHT][0]))
                w0, h0 = found[0][WIDTH][0], found[0][HEIGHT][0]
                for level, t in enumerate(found):
                    w, h = t[WIDTH][0], t[HEIGHT][0]
                    scale = {2: 25400.0, 3: 10000.0}.get(t.get(RES_UNIT, [1])[0])
                    space = [(scale / t[r] if scale else t[r]) if t.get(r) else 1.0 for r in (X_RES, Y_RES)]
                    rows.append((name, level, w, h, t.get(SAMPLES, [1])[0], t.get(BITS, [8])[0], t.get(TILE_W, [w])[0], t.get(TILE_H, [t.get(ROWS, [h])[0]])[0], *space, t.get(DESCRIPTION, ""), (w0 / w + h0 / h) / 2))
            cols = list(zip(*rows, strict=True))
            kinds = [pa.string(), *[pa.int32()] * 7, pa.float64(), pa.float64(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in METADATA.split(", ")])

    return files.select("path", "content").mapInArrow(decode, METADATA)


def metaio_header(text: str) -> dict[str, str]:
    """The ``Key = Value`` lines of a MetaIO header."""
    return {k.strip(): v.strip() for k, _, v in (line.partition("=") for line in text.splitlines()) if v}


def to_ppm(pixels: DataFrame) -> DataFrame:
    """(image_id, content): binary PPM of r, g, b from 0 to 255; a row is gathered before its image is."""
    shape = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    byte = lambda c: F.substring(F.unhex(F.lpad(F.hex(F.rint(F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(255.0))).cast("long")), 2, "0")), 1, 1)
    rows = pixels.groupBy("image_id", "y").agg(F.array_sort(F.collect_list(F.struct("x", F.concat(*[byte(c) for c in "rgb"]).alias("p")))).alias("r"))
    join = lambda a: F.aggregate(F.transform(a, lambda p: p["p"]), F.lit(b""), lambda s, p: F.concat(s, p))
    lines = rows.select("image_id", "y", join(F.col("r")).alias("p")).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("y", "p"))).alias("r"))
    head = F.encode(F.format_string("P6\n%d %d\n255\n", "w", "h"), "US-ASCII")
    return lines.join(shape, "image_id").select("image_id", F.concat(head, join(F.col("r"))).alias("content"))
