"""TIFF blocks: codecs, layouts, pushed boxes."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from isoline.sources import tiff
from isoline.sources.rasters import read_raster

RNG = np.random.default_rng(6)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 127, 128, 129, 300, 5000, 200_000])
def test_codecs(n):
    for data in (RNG.integers(0, 256, n, dtype=np.uint8).tobytes(), b"\7" * n, RNG.integers(0, 2, n, dtype=np.uint8).tobytes(), (b"abcabcabd" * n)[:n]):
        assert tiff.unpack_lzw(tiff.pack_lzw(data)) == data
        assert tiff.unpack_bits(tiff.pack_bits(data)) == data


def test_known_codes():
    """The packed forms that the format's description gives: PackBits of a run among bytes, LZW of a short string (9-bit codes, clear first, end last)."""
    assert tiff.unpack_bits(bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    codes = [256, 7, 258, 8, 8, 258, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    data = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff.unpack_lzw(data) == bytes([7, 7, 7, 8, 8, 7, 7, 6])
    assert tiff.pack_lzw(bytes([7, 7, 7, 8, 8, 7, 7, 6])) == data


@pytest.mark.parametrize("kind", ["u1", "u2", "i2", "i4", "f4", "f8"])
def test_encode_decode(kind):
    a = RNG.normal(0, 50, (2, 45, 70)).astype(kind)
    for compression in tiff.PACK:
        for predictor in (1, 3) if kind[0] == "f" else (1, 2):
            assert (tiff.decode(tiff.encode(a, compression, 32, predictor)) == a).all()


def plain(order, big, strips, apart, bands):
    """A hand-made file in strips."""
    n, h, w = bands.shape
    kind = bands.dtype.newbyteorder(order)
    planes = [bands[k : k + 1] for k in range(n)] if apart else [bands]
    blocks = [np.moveaxis(p[:, y : y + strips], 0, 2).astype(kind).tobytes() for p in planes for y in range(0, h, strips)]
    at = 16 + np.cumsum([0, *map(len, blocks)])
    fields = [(256, 3, (w,)), (257, 3, (h,)), (258, 3, (8 * kind.itemsize,) * n), (259, 3, (1,)), (262, 3, (1,)), (273, 4, tuple(at[:-1].tolist())), (277, 3, (n,)), (278, 3, (strips,)), (279, 4, tuple(map(len, blocks))), (284, 3, (2 if apart else 1,)), (339, 3, (1,) * n)]
    word, place, many = ("Q", 8, "Q") if big else ("I", 4, "H")
    far, tail, head = int(at[-1]) + struct.calcsize(many) + len(fields) * (12 + 8 * big) + place, b"", struct.pack(order + many, len(fields))
    for tag, t, v in fields:
        data = struct.pack(f"{order}{len(v)}{tiff.TYPES[t]}", *v)
        head += struct.pack(f"{order}HH{word}", tag, t, len(v)) + (data.ljust(place, b"\0") if len(data) <= place else struct.pack(order + word, far + len(tail)))
        tail += data if len(data) > place else b""
    mark = (b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, int(at[-1])) if big else struct.pack(order + "HI", 42, int(at[-1])).ljust(14, b"\0"))
    return mark + b"".join(blocks) + head + b"\0" * place + tail


@pytest.mark.parametrize("order,big,apart", [("<", False, False), (">", False, True), ("<", True, True), (">", True, False)])
def test_strips(order, big, apart):
    a = RNG.integers(0, 60_000, (3, 11, 7)).astype("u2")
    assert (tiff.decode(plain(order, big, 4, apart, a)) == a).all()


def test_source(spark, tmp_path):
    a = np.arange(2 * 100 * 130, dtype="i4").reshape(2, 100, 130)
    (tmp_path / "one.tif").write_bytes(tiff.encode(a, "deflate", 16))
    (tmp_path / "two.tiff").write_bytes(plain(">", False, 9, True, a.astype("u2")))
    (tmp_path / "note.txt").write_text("no raster")
    tiff.register(spark)
    read = lambda bytes_: spark.read.format("isoline_tiff").option("range_bytes", bytes_).load(f"file://{tmp_path}")
    for bytes_ in (500, 1 << 25):
        rows = read(bytes_).where("band = 2 and x >= 30 and x < 50 and y > 70").collect()
        assert len(rows) == 2 * 20 * 29
        assert all(r.value == (a[1, r.y, r.x] if r.raster_id == "one" else a[1, r.y, r.x] & 0xFFFF) for r in rows)
    assert read(500).rdd.getNumPartitions() > 50
    assert read(500).count() == 2 * a.size
    whole = {(r.raster_id, r.band): r.n for r in read_raster(spark, f"{tmp_path}/*.tif*").groupBy("raster_id", "band").agg(F.count("*").alias("n")).collect()}
    assert whole == {(k, b): 13_000 for k in ("one", "two") for b in (1, 2)}


def test_blocks_outside_are_not_read(spark, tmp_path):
    """Damaged blocks do no harm to a box that does not touch them."""
    a = RNG.normal(size=(1, 64, 64))
    data = bytearray(tiff.encode(a, "deflate", 16))
    form = tiff.layout(lambda at, n: bytes(data[at : at + n]), len(data))
    for k, (at, n) in enumerate(zip(form.offsets, form.sizes)):
        if form.place(k)[1:] != (16, 32):
            data[at : at + n] = b"\xff" * n
    (tmp_path / "a.tif").write_bytes(bytes(data))
    tiff.register(spark)
    df = spark.read.format("isoline_tiff").load(f"file://{tmp_path}")
    got = df.where("x between 17 and 30 and y between 33 and 40").collect()
    assert len(got) == 14 * 8 and all(r.value == a[0, r.y, r.x] for r in got)
    with pytest.raises(Exception, match="decompress"):
        df.where("x between 10 and 30").count()


def test_write_regions(spark, tmp_path):
    cells = spark.createDataFrame([("r", x, y, float(x * y) if x != 3 else None) for x in range(-5, 40) for y in range(30) if (x + y) % 7], "raster_id string, x int, y int, value double")
    files = tiff.write_tiff(cells, f"file://{tmp_path}/out", region=16, tile=16, compression="lzw", kind="f4").collect()
    assert len(files) == 8 and sum(f.cells for f in files) == cells.count()
    got = tiff.placed_cells(spark, f"file://{tmp_path}/out")
    assert sorted((r.x, r.y, r.value) for r in got.collect()) == sorted((r.x, r.y, r.value) for r in cells.where("value is not null").collect())
    assert tiff.write_tiff(cells.where("x > 99"), f"file://{tmp_path}/none").count() == 0
    (tmp_path / "bad.tif").write_bytes(b"no tiff at all, surely")
    with pytest.raises(Exception, match="not a TIFF"):
        spark.read.format("isoline_tiff").load(f"file://{tmp_path}/bad.tif").count()
