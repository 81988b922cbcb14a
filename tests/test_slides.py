"""Slides by byte ranges: files written here, in all layouts that are read."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from imgq.sources import slides


def pack_lzw(data):
    out, held, bits, width = bytearray(), 0, 0, 9
    table = {bytes([k]): k for k in range(256)}
    codes, w, free = [(256, 9)], b"", 258
    for b in data:
        if w + bytes([b]) in table:
            w += bytes([b])
            continue
        codes.append((table[w], width))
        table[w + bytes([b])] = free
        free += 1
        if free + 1 > 1 << width and width < 12:
            width += 1
        if free >= 4094:
            codes.append((256, width))
            table, free, width = {bytes([k]): k for k in range(256)}, 258, 9
        w = bytes([b])
    if w:
        codes.append((table[w], width))
        free += 1
        if free + 1 > 1 << width and width < 12:
            width += 1
    codes.append((257, width))
    for code, n in codes:
        held, bits = (held << n) | code, bits + n
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


PACK = {1: bytes, 5: pack_lzw, 8: zlib.compress}


def write_tiff(path, images, big=False, order="<"):
    """``images``: dicts of array, tile (or None for strips of 5 rows), compression, predictor and text tags."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + ("HHHQ" if big else "HI"), *((43, 8, 0, 0) if big else (42, 0))))
    link = 8 if big else 4
    spots = []
    for image in images:
        a, tile, how = image["array"], image.get("tile"), image.get("compression", 1)
        h, w, c = a.shape
        th, tw = tile or (5, w)
        offsets, sizes = [], []
        spot = []
        for y in range(0, h, th):
            for x in range(0, w, tw):
                block = a[y : y + th, x : x + tw]
                if tile:
                    block = np.pad(block, [(0, th - block.shape[0]), (0, tw - block.shape[1]), (0, 0)])
                if image.get("predictor") == 2:
                    block = np.concatenate([block[:, :1], np.diff(block.astype(np.int64), axis=1).astype(a.dtype)], axis=1)
                data = PACK[how](block.astype(a.dtype.newbyteorder(order)).tobytes())
                offsets.append(len(out))
                sizes.append(len(data))
                spot.append((y // th, x // tw, len(out), len(data)))
                out += data
        spots.append(spot)
        tags = {256: w, 257: h, 258: [a.itemsize * 8] * c, 259: how, 277: c, 254: image.get("subfile", 0), 317: image.get("predictor", 1)}
        tags |= {322: tw, 323: th, 324: offsets, 325: sizes} if tile else {273: offsets, 278: th, 279: sizes}
        tags |= {k: image[n] for k, n in ((270, "description"), (305, "software")) if n in image}
        entries = b""
        for tag, v in sorted(tags.items()):
            kind, data = (2, v.encode() + b"\0") if isinstance(v, str) else (16, struct.pack(f"{order}{len(v)}Q", *v)) if big and tag in (324, 325) else (4, struct.pack(f"{order}{len(v)}I", *v)) if isinstance(v, list) else (4, struct.pack(order + "I", v))
            n = len(data) // {2: 1, 4: 4, 16: 8}[kind]
            if len(data) > (8 if big else 4):
                at = len(out)
                out += data
                data = struct.pack(order + ("Q" if big else "I"), at)
            entries += struct.pack(order + ("HHQ" if big else "HHI"), tag, kind, n) + data.ljust(8 if big else 4, b"\0")
        struct.pack_into(order + ("Q" if big else "I"), out, link, len(out))
        out += struct.pack(order + ("Q" if big else "H"), len(tags)) + entries
        link = len(out)
        out += struct.pack(order + ("Q" if big else "I"), 0)
    path.write_bytes(out)
    return spots


rng = np.random.default_rng(8)


def picture(h, w, c=3, kind=np.uint8):
    return (np.arange(h)[:, None, None] * 3 + np.arange(w)[None, :, None] * 5 + np.arange(c) * 40 + rng.integers(0, 4, (h, w, c))).astype(kind)


def array_of(rows, shape):
    out = np.full(shape, -1.0)
    for r in rows:
        assert out[r["y"], r["x"], r["c"]] == -1  # each place once
        out[r["y"], r["x"], r["c"]] = r["v"]
    return out


@pytest.mark.parametrize(("big", "order", "how", "predictor", "tile", "kind"), [(False, "<", 5, 2, (16, 16), np.uint8), (True, "<", 8, 1, (16, 32), np.uint16), (True, ">", 5, 1, None, np.uint16), (False, ">", 1, 2, (16, 16), np.uint16), (False, "<", 8, 2, None, np.uint8)])
def test_all_layouts(spark, tmp_path, big, order, how, predictor, tile, kind):
    a = picture(37, 45, 3, kind)
    write_tiff(tmp_path / "a.tif", [{"array": a, "tile": tile, "compression": how, "predictor": predictor}], big, order)
    got = slides.fetch(slides.tile_index(spark, str(tmp_path)))
    assert (array_of(got.collect(), a.shape) == a).all()


@pytest.mark.parametrize("n", [0, 1, 500, 60_000])
def test_lzw_both_ways(n):
    for data in (rng.integers(0, 256, n).astype(np.uint8).tobytes(), (rng.integers(0, 3, n)).astype(np.uint8).tobytes(), b"a" * n):
        assert slides.unpack_lzw(pack_lzw(data)) == data


@pytest.fixture(scope="module")
def slide(tmp_path_factory):
    path = tmp_path_factory.mktemp("slides")
    top = picture(70, 90)
    half = top[::2, ::2]
    text = "Aperio Image Library v11.2.1 \r\n90x70 [0,0 90x70] (16x16) LZW|AppMag = 20|MPP = 0.4990|Title = a = b"
    spots = write_tiff(
        path / "s.svs",
        [{"array": half, "tile": (16, 16), "compression": 5, "description": text, "software": "x"}, {"array": picture(9, 12), "description": text}, {"array": top, "tile": (16, 16), "compression": 5}, {"array": picture(6, 7, 1), "subfile": 1}, {"array": picture(8, 5, 1), "subfile": 9, "compression": 8}],
        big=True,
    )
    return path, top, half, spots


def test_levels_roles_and_metadata(spark, slide):
    path, _, _, _ = slide
    index = slides.tile_index(spark, str(path))
    roles = {r["ifd"]: (r["role"], r["level"]) for r in index.select("ifd", "role", "level").distinct().collect()}
    assert roles == {0: ("level", 1), 1: ("thumbnail", None), 2: ("level", 0), 3: ("label", None), 4: ("macro", None)}
    assert [(r["level"], r["width"], r["height"], r["downsample"]) for r in slides.levels(index).orderBy("level").collect()] == [(0, 90, 70, 1.0), (1, 45, 35, 2.0)]
    first = index.where("ifd = 0").select(slides.vendor(F.col("description"), F.col("software")).alias("vendor"), slides.aperio_metadata(F.col("description")).alias("m")).first()
    assert first["vendor"] == "aperio" and first["m"] == {"AppMag": "20", "MPP": "0.4990", "Title": "a = b"}
    assert slides.associated_image(index, "macro").count() == 8 * 5
    assert index.where("role = 'level'").count() == 5 * 6 + 3 * 3


def test_philips_roles_and_metadata(spark, tmp_path):
    xml = '<?xml version="1.0"?><DataObject ObjectType="DPUfsImport"><Attribute Name="DICOM_MANUFACTURER" Group="0x0008">PHILIPS</Attribute><Attribute Name="DICOM_PIXEL_SPACING">&quot;0.00025&quot; &quot;0.00025&quot;</Attribute><Attribute Name="DICOM_PIXEL_SPACING">&quot;1&quot;</Attribute></DataObject>'
    write_tiff(tmp_path / "p.tiff", [{"array": picture(20, 20), "tile": (16, 16), "software": "Philips DP v1.0", "description": xml}, {"array": picture(5, 5), "description": "Label"}, {"array": picture(5, 6), "description": "Macro -offset=(0,0)"}])
    index = slides.tile_index(spark, str(tmp_path))
    assert {r["ifd"]: r["role"] for r in index.collect()} == {0: "level", 1: "label", 2: "macro"}
    m = index.where("ifd = 0").select(slides.philips_metadata(F.col("description")).alias("m"), slides.vendor(F.col("description"), F.col("software")).alias("vendor")).first()
    assert m["vendor"] == "philips" and m["m"] == {"DICOM_MANUFACTURER": "PHILIPS", "DICOM_PIXEL_SPACING": '"0.00025" "0.00025"'}


def test_regions_open_only_their_tiles(spark, slide, tmp_path):
    path, top, half, spots = slide
    asked = [("in", 0, 20, 30, 10, 9), ("edge", 0, 60, 80, 20, 20), ("corner", 0, -4, -6, 10, 10), ("half", 1, 20, 40, 5, 6), ("out", 0, 300, 5, 4, 4), ("all", 1, None, None, None, None)]
    name = slides.tile_index(spark, str(path)).first()["path"]
    schema = "region string, level int, y int, x int, height int, width int"
    regions = spark.createDataFrame(asked, schema).withColumn("path", F.lit(name))
    index = slides.tile_index(spark, str(path))
    got = {}
    for r in slides.read_regions(index, regions).collect():
        got.setdefault(r["region"], {})[r["y"], r["x"], r["c"]] = r["v"]
    for region, level, y, x, h, w in asked:
        image = (top, half)[level]
        y, x, h, w = (y or 0) >> level, (x or 0) >> level, h or image.shape[0], w or image.shape[1]
        want = {(i - y, j - x, c): image[i, j, c] for i in range(max(y, 0), min(y + h, image.shape[0])) for j in range(max(x, 0), min(x + w, image.shape[1])) for c in range(3)}
        assert got.get(region, {}) == want, region
    # All other tiles are spoilt: what is read can't have touched them.
    few = regions.where("region IN ('in', 'half')")
    need = {(r["ifd"], r["ty"], r["tx"]) for r in slides.tiles_of_regions(index, few).collect()}
    assert need == {(2, 1, 1), (2, 1, 2)} | {(0, 0, 1)}
    data = bytearray((path / "s.svs").read_bytes())
    for ifd, spot in enumerate(spots):
        for ty, tx, at, n in spot:
            if (ifd, ty, tx) not in need:
                data[at : at + n] = b"\xff" * n
    (tmp_path / "s.svs").write_bytes(data)
    spoilt = slides.tile_index(spark, str(tmp_path))
    moved = few.withColumn("path", F.lit(spoilt.first()["path"]))
    again = {}
    for r in slides.read_regions(spoilt, moved).collect():
        again.setdefault(r["region"], {})[r["y"], r["x"], r["c"]] = r["v"]
    assert again == {k: got[k] for k in ("in", "half")}


def test_what_cannot_be_read(spark, tmp_path):
    (tmp_path / "no").mkdir()
    (tmp_path / "no" / "x.tif").write_bytes(b"something else entirely")
    with pytest.raises(Exception, match="not a TIFF"):
        slides.tile_index(spark, str(tmp_path / "no")).count()
    with pytest.raises(NotImplementedError, match="compression 7"):
        slides.unpack(b"", 7)
