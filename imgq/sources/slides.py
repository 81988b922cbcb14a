"""Slides by byte ranges: a table of the tiles of TIFF and BigTIFF files, and the tiles that are asked for.

``tile_index`` reads the directories of each file and no pixels: a row for each
tile or strip with its offset and length. It is an ordinary table, so the tiles
of a level, a window or a list of regions are found by filters and joins, and
``fetch`` opens only their byte ranges, spread over tasks by the number of bytes.

Files are listed by Spark. Ranges are read through Arrow's file systems (local
and shared folders, HDFS, S3, GCS): a store that only Spark opens needs
``images.read_pixels``. Compression: none, Deflate, LZW, with or without
horizontal differences; JPEG and JPEG 2000 raise ``NotImplementedError``, as no
decoder is installed, when a tile is fetched; their index can be read all the same.

Edge cases: a file that isn't a TIFF raises ValueError. Tiles of length 0 are
missing and come back as 0. Tiles at the border are cut to the image. A slide
without associated images has none in the index.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .images import BITS, COMPRESSION, DESCRIPTION, HEIGHT, ROWS, SAMPLES, STRIP_BYTES, STRIPS, SUBFILE, TILE_BYTES, TILE_H, TILE_W, TILES, TYPE_CODES, TYPE_SIZES, WIDTH

# More TIFF tags, and the starts of texts that vendors write.
PREDICTOR, SOFTWARE = 317, 305
APERIO, PHILIPS = "Aperio ", "Philips"
#: Bytes that one task of ``fetch`` reads, about.
TASK_BYTES = 32 << 20
INDEX = (
    "path string, ifd int, width int, height int, channels int, bits int, little boolean, compression int, predictor int, tiled boolean, tile_height int, tile_width int, "
    "description string, software string, subfile int, ty int, tx int, offset long, length long"
)


class _Ranges:
    """A file of which only ranges are read."""

    def __init__(self, path: str):
        from pyarrow import fs

        at = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path
        where, name = fs.FileSystem.from_uri(at)
        self._file = where.open_input_file(name)

    def read(self, offset: int, n: int) -> bytes:
        return self._file.read_at(n, offset)

    def __enter__(self) -> _Ranges:
        return self

    def __exit__(self, *_: object) -> None:
        self._file.close()


def directories(read, limit: int = 1 << 16) -> Iterator[dict[int, object]]:
    """The tags of each image, by ``read(offset, n)``; 0 of the dict is whether numbers are little-endian."""
    start = read(0, 16)
    if start[:4] not in (b"II*\0", b"MM\0*", b"II+\0", b"MM\0+"):
        raise ValueError("not a TIFF file")
    order, big = "<" if start[:2] == b"II" else ">", b"+" in start[:4]
    number, entry_size, inline = ("Q", 20, 8) if big else ("I", 12, 4)
    (at,) = struct.unpack_from(order + number, start, 8 if big else 4)
    head = 8 if big else 2
    for _ in range(limit):
        if not at:
            return
        (n,) = struct.unpack(order + ("Q" if big else "H"), read(at, head))
        block = read(at + head, n * entry_size + inline)
        tags: dict[int, object] = {0: order == "<"}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HH" + number, block, i * entry_size)
            size, held = TYPE_SIZES.get(kind, 1) * count, i * entry_size + 4 + inline
            data = block[held : held + size] if size <= inline else read(struct.unpack_from(order + number, block, held)[0], size)
            if kind == 2:
                tags[tag] = data.rstrip(b"\0").decode("latin-1")
            elif kind in TYPE_CODES:
                tags[tag] = list(struct.unpack(f"{order}{count}{TYPE_CODES[kind]}", data))
        yield tags
        (at,) = struct.unpack_from(order + number, block, n * entry_size)


def tile_index(spark: SparkSession, path: str) -> DataFrame:
    """A row for each tile of each image of the TIFF files under ``path``; the columns of ``INDEX``, role and level.

    Roles follow the vendor: levels are the tiled images, or all where none is
    tiled, level 0 the largest (null for others). Of Aperio slides the second
    image, if it is not tiled, is the thumbnail, and others are label or macro by
    their subfile type; of Philips slides they are by their description.
    """
    # The content column is not asked for, so Spark lists the files and opens none.
    files = spark.read.format("binaryFile").load(path).select("path")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in INDEX.split(", ")]
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with _Ranges(name) as file:
                    for ifd, t in enumerate(directories(file.read)):
                        one = lambda tag, default, t=t: t[tag][0] if tag in t else default
                        tiled, width, height = TILES in t, one(WIDTH, 0), one(HEIGHT, 0)
                        th, tw = (one(TILE_H, 0), one(TILE_W, 0)) if tiled else (min(one(ROWS, height), height), width)
                        offsets, sizes = (t[TILES], t[TILE_BYTES]) if tiled else (t[STRIPS], t[STRIP_BYTES])
                        n, across = len(offsets), -(-width // tw)
                        same = [name, ifd, width, height, one(SAMPLES, 1), one(BITS, 8), t[0], one(COMPRESSION, 1), one(PREDICTOR, 1), tiled, th, tw, t.get(DESCRIPTION, ""), t.get(SOFTWARE, ""), one(SUBFILE, 0)]
                        kinds = [pa.string(), *[pa.int32()] * 5, pa.bool_(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32()]
                        k = np.arange(n, dtype=np.int32)
                        arrays = [pa.repeat(pa.scalar(v, kind), n) for v, kind in zip(same, kinds, strict=True)] + [pa.array(k // across), pa.array(k % across), pa.array(offsets, pa.int64()), pa.array(sizes, pa.int64())]
                        yield pa.RecordBatch.from_arrays(arrays, names=names)

    found = files.mapInArrow(decode, INDEX)
    images = found.groupBy("path", "ifd").agg(*[F.first(c).alias(c) for c in ("width", "height", "tiled", "description", "software", "subfile")])
    per_file = Window.partitionBy("path")  # a row for each image of one file
    first = F.first("description").over(per_file.orderBy("ifd"))
    text = F.lower("description")
    other = (
        F.when(first.startswith(APERIO), F.when(F.col("ifd") == 1, "thumbnail").when(F.col("subfile") == 1, "label").when(F.col("subfile") == 9, "macro").otherwise("other"))
        .when(F.first("software").over(per_file.orderBy("ifd")).startswith(PHILIPS), F.when(text.startswith("macro"), "macro").when(text.startswith("label"), "label").otherwise("other"))
        .otherwise("other")
    )
    images = images.withColumn("role", F.when(F.col("tiled") | ~F.max("tiled").over(per_file), "level").otherwise(other))
    order = Window.partitionBy("path", "role").orderBy(F.desc("width"), F.desc("height"), "ifd")
    images = images.select("path", "ifd", "role", F.when(F.col("role") == "level", F.row_number().over(order) - 1).alias("level"))
    return found.join(images, ["path", "ifd"])


def vendor(description: Column, software: Column) -> Column:
    """aperio, philips or generic, by the texts of a slide's first image."""
    return F.when(description.startswith(APERIO), "aperio").when(software.startswith(PHILIPS), "philips").otherwise("generic")


def aperio_metadata(description: Column) -> Column:
    """A map of what an Aperio description says after its first bar: ``AppMag = 20|MPP = 0.5``."""
    parts = F.filter(F.slice(F.split(description, r"\|"), 2, 1 << 30), lambda p: F.contains(p, F.lit("=")))
    pair = lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("k"), F.trim(F.regexp_replace(p, "^[^=]*=", "")).alias("v"))
    pairs = F.transform(parts, pair)
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))  # of a key that comes twice the first counts
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), 1)["v"]))


def philips_metadata(description: Column) -> Column:
    """A map of the plain attributes in a Philips description (XML): name to text, the first of each name."""
    one = F.regexp_extract_all(description, F.lit(r'<Attribute [^>]*?Name="[^"]+"[^>]*>[^<]*<'), F.lit(0))
    pairs = F.transform(one, lambda p: F.struct(F.regexp_extract(p, r'Name="([^"]+)"', 1).alias("k"), F.trim(F.regexp_replace(F.regexp_extract(p, ">([^<]*)<", 1), "&quot;", '"')).alias("v")))
    pairs = F.filter(pairs, lambda p: p["v"] != "")
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), 1)["v"]))


def unpack_lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, high bits first, widened one code early."""
    out, table, width, held, bits, last = bytearray(), [], 9, 0, 0, None
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, None
            continue
        if last is None:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
        out += entry
        last = entry
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return bytes(out)


def unpack(data: bytes, compression: int) -> bytes:
    if compression == 1:
        return data
    if compression == 5:
        return unpack_lzw(data)
    if compression in (8, 32946):
        return zlib.decompress(data)
    raise NotImplementedError(f"TIFF compression {compression} is not supported (none, LZW and Deflate are)")


def _tile(raw: bytes, row: dict) -> np.ndarray:
    """Rows x columns x channels of a tile, cut to the image."""
    kind = np.dtype({8: "u1", 16: "u2", 32: "u4"}[row["bits"]]).newbyteorder("<" if row["little"] else ">")
    rows, columns = min(row["tile_height"], row["height"] - row["ty"] * row["tile_height"]), min(row["tile_width"], row["width"] - row["tx"] * row["tile_width"])
    if not row["length"]:
        return np.zeros((rows, columns, row["channels"]), kind)
    held = row["tile_height"] if row["tiled"] else rows
    tile = np.frombuffer(unpack(raw, row["compression"]), kind, held * row["tile_width"] * row["channels"]).reshape(held, row["tile_width"], row["channels"])
    if row["predictor"] == 2:
        tile = np.cumsum(tile, axis=1, dtype=kind.newbyteorder("="))
    return tile[:rows, :columns]


_NEEDED = ["path", "ifd", "role", "level", "width", "height", "channels", "bits", "little", "compression", "predictor", "tiled", "tile_height", "tile_width", "ty", "tx", "offset", "length"]
PIXELS = "path string, role string, level int, y int, x int, c int, v double"


def fetch(index: DataFrame) -> DataFrame:
    """The pixels (path, role, level, y, x, c, v) of the tiles in ``index``, a part of ``tile_index``.

    Tiles are dealt by file and stretches of ``TASK_BYTES`` of it, in the order of their offsets.
    """
    tiles = index.select(*_NEEDED, F.floor(F.col("offset") / TASK_BYTES).alias("stretch"))
    tiles = tiles.repartition("path", "stretch").sortWithinPartitions("path", "offset").drop("stretch")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        try:
            for batch in batches:
                for row in batch.to_pylist():
                    if row["path"] != name:
                        if file is not None:
                            file.__exit__()
                        name, file = row["path"], _Ranges(row["path"])
                    tile = _tile(file.read(row["offset"], row["length"]) if row["length"] else b"", row)
                    y, x, c = np.indices(tile.shape, dtype=np.int32).reshape(3, -1)
                    n = tile.size
                    arrays = [pa.repeat(pa.scalar(v, k), n) for v, k in ((name, pa.string()), (row["role"], pa.string()), (row["level"], pa.int32()))]
                    arrays += [pa.array(y + np.int32(row["ty"] * row["tile_height"])), pa.array(x + np.int32(row["tx"] * row["tile_width"])), pa.array(c), pa.array(tile.reshape(-1).astype(np.float64))]
                    yield pa.RecordBatch.from_arrays(arrays, names=["path", "role", "level", "y", "x", "c", "v"])
        finally:
            if file is not None:
                file.__exit__()

    return tiles.mapInArrow(decode, PIXELS)


def levels(index: DataFrame) -> DataFrame:
    """``(path, level, width, height, tile_height, tile_width, downsample)``: a row for each level."""
    one = index.where("role = 'level'").groupBy("path", "level").agg(*[F.first(c).alias(c) for c in ("width", "height", "tile_height", "tile_width")])
    top = F.first("width").over(Window.partitionBy("path").orderBy("level")), F.first("height").over(Window.partitionBy("path").orderBy("level"))
    return one.withColumn("downsample", (top[0] / F.col("width") + top[1] / F.col("height")) / 2)


def tiles_of_regions(index: DataFrame, regions: DataFrame) -> DataFrame:
    """The tiles that meet any of ``regions`` (region, path, level, y, x, height, width), each once.

    Corners are in places of level 0, sizes in places of the level; a null corner
    is (0, 0) and a null size reaches to the end of the level.
    """
    asked = placed(index, regions)
    span = lambda a, n, side: F.explode(F.sequence(F.floor(F.greatest(F.col(a), F.lit(0)) / F.col(side)).cast("int"), F.floor((F.least(F.col(a) + F.col(n), F.col("_h" if side == "tile_height" else "_w")) - 1) / F.col(side)).cast("int")))
    asked = asked.where("_y < _h AND _x < _w AND _y + rows > 0 AND _x + columns > 0")
    need = asked.select("path", "level", "tile_height", "tile_width", "_x", "columns", "_w", span("_y", "rows", "tile_height").alias("ty")).select("path", "level", "ty", span("_x", "columns", "tile_width").alias("tx"))
    return index.where("role = 'level'").join(need.distinct(), ["path", "level", "ty", "tx"], "left_semi").select(index.columns)


def placed(index: DataFrame, regions: DataFrame) -> DataFrame:
    """``regions`` with their corner (_y, _x) and size (rows, columns) in places of their level."""
    r = regions.join(levels(index).select("path", "level", F.col("width").alias("_w"), F.col("height").alias("_h"), "tile_height", "tile_width", "downsample"), ["path", "level"])
    corner = lambda c: F.floor(F.coalesce(F.col(c), F.lit(0)) / F.col("downsample")).cast("int")
    r = r.withColumn("_y", corner("y")).withColumn("_x", corner("x"))
    return r.withColumn("rows", F.coalesce(F.col("height"), F.col("_h") - F.col("_y"))).withColumn("columns", F.coalesce(F.col("width"), F.col("_w") - F.col("_x")))


def read_regions(index: DataFrame, regions: DataFrame) -> DataFrame:
    """``(region, y, x, c, v)`` from each region's corner; places outside of the slide are left out.

    Only the byte ranges of tiles that a region meets are read, once for all regions.
    """
    side = F.col("tile_height"), F.col("tile_width")
    cells = levels(index).select("path", "level", *[s.alias(f"_{c}") for s, c in zip(side, "ij", strict=True)])
    pixels = fetch(tiles_of_regions(index, regions)).join(cells, ["path", "level"])
    pixels = pixels.select("path", "level", F.col("y").alias("py"), F.col("x").alias("px"), "c", "v", F.floor(F.col("y") / F.col("_i")).cast("int").alias("ty"), F.floor(F.col("x") / F.col("_j")).cast("int").alias("tx"))
    r = placed(index, regions).where("_y < _h AND _x < _w AND _y + rows > 0 AND _x + columns > 0")
    reach = lambda a, n, s: F.explode(F.sequence(F.floor(F.greatest(F.col(a), F.lit(0)) / s).cast("int"), F.floor((F.col(a) + F.col(n) - 1) / s).cast("int")))
    r = r.select("region", "path", "level", "_y", "_x", "rows", "columns", "tile_width", reach("_y", "rows", side[0]).alias("ty")).select("*", reach("_x", "columns", side[1]).alias("tx"))
    met = r.join(pixels, ["path", "level", "ty", "tx"]).where("py >= _y AND px >= _x AND py < _y + rows AND px < _x + columns")
    return met.select("region", (F.col("py") - F.col("_y")).alias("y"), (F.col("px") - F.col("_x")).alias("x"), "c", "v")


def associated_image(index: DataFrame, name: str) -> DataFrame:
    """The pixels of the images called ``name`` (label, macro, thumbnail) of all slides."""
    return fetch(index.where(F.col("role") == name))
