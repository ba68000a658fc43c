"""Images read from files: sizes from headers, admission, quarantine, scores."""

import struct
import zlib

from loomwell.operators import vision
from loomwell.sources import images


def png(width, height, kind=2, sample=b"\xc8\x64\x64"):
    """A PNG of one colour: ``kind`` 0 is grey, 2 is RGB, 6 is RGB with alpha."""
    part = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    rows = (b"\0" + sample * width) * height
    return images.PNG + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def jpeg_head(width, height, segments=()):
    body = b"".join(b"\xff" + bytes([kind]) + struct.pack(">H", len(data) + 2) + data for kind, data in segments)
    return b"\xff\xd8" + body + b"\xff\xff\xc0" + struct.pack(">HBHH", 11, 8, height, width) + bytes(6)


def test_sizes_of_headers():
    assert images.size_of(png(7, 9)) == ("png", 9, 7)
    assert images.size_of(png(7, 9)[:20]) == ("png", None, None)
    # A frame of a thumbnail inside another segment is not the picture's; segments may be many and long.
    thumbnail = (0xE1, jpeg_head(3, 4))
    assert images.size_of(jpeg_head(700, 500, [thumbnail, *[(0xE2, bytes(65000))] * 3, (0xC4, bytes(30))])) == ("jpeg", 500, 700)
    assert images.size_of(jpeg_head(700, 500)[:6]) == ("jpeg", None, None) and images.size_of(b"\xff\xd8\xff\xda" + bytes(20)) == ("jpeg", None, None)
    assert images.size_of(b"GIF89a" + struct.pack("<HH", 5, 6)) == ("gif", 6, 5) and images.size_of(b"GIF8") == ("gif", None, None)
    assert images.size_of(b"BM" + bytes(16) + struct.pack("<ii", 5, -6)) == ("bmp", 6, 5)
    assert images.size_of(None) == images.size_of(b"") == images.size_of(b"text") == (None, None, None)


def test_a_folder_of_images(spark, tmp_path):
    """Each file has one row, with the first rule it fails; the admitted ones are scored."""
    folder = tmp_path / "in"
    (folder / "deep er").mkdir(parents=True)
    whole = png(120, 110)
    content = {
        "good.png": whole, "deep er/UPPER.PNG": whole, "grey.png": png(100, 100, 0, b"\x80"), "alpha.png": png(100, 100, 6, b"\xc8\x64\x64\x00"),
        "small.png": png(99, 300), "broken.png": b"no image", "empty.jpg": b"", "cut.png": whole[: len(whole) // 2], "picture.gif": b"GIF89a" + struct.pack("<HH", 500, 600),
        "large.png": whole + bytes(3000), "notes.txt": b"words",
    }
    for name, data in content.items():
        (folder / name).write_bytes(data)
    gone = spark.createDataFrame([("file:/nowhere/gone.png",)], "path string")
    seen = images.inspect(spark, str(folder), requested=gone, max_bytes=3000)
    got = {r["path"].split("/")[-1]: r for r in seen.collect()}
    low = vision.UNREADABLE
    assert {n: r["reason"] for n, r in got.items()} == {
        "good.png": None, "UPPER.PNG": None, "grey.png": None, "alpha.png": None, "small.png": low, "broken.png": low, "cut.png": low,
        "picture.gif": "Format JPG/PNG only.", "large.png": "File size >5MB.", "notes.txt": low, "gone.png": "File not found.",
    }
    assert (got["good.png"]["height"], got["good.png"]["width"], got["good.png"]["length"]) == (110, 120, len(whole))
    assert [got[n]["mean_r"] for n in ("good.png", "UPPER.PNG", "alpha.png", "grey.png")] == [200, 200, 200, 128] and got["grey.png"]["mean_b"] == 128
    assert got["good.png"]["overall_score"] is not None and all(r["overall_score"] is None for r in got.values() if r["reason"])
    kept, aside = images.quarantine(seen)
    assert kept.count() == 4 and aside.count() == 7 and aside.columns == ["path", "length", "reason"]


def test_large_files_are_listed_only(spark, tmp_path):
    """The reader would fail on the large file's content; it is never asked for. Decoding prunes it, too."""
    (tmp_path / "large.png").write_bytes(png(120, 110) + bytes(5000))
    (tmp_path / "good.png").write_bytes(png(120, 110))
    before = spark.conf.get("spark.sql.sources.binaryFile.maxLength")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "3000")
    try:
        got = {r["path"].split("/")[-1]: r["height"] for r in images.read_sizes(spark, str(tmp_path), max_bytes=3000).collect()}
    finally:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", before)
    assert got == {"large.png": None, "good.png": 110}
    decoded = images._decoded(spark, str(tmp_path), "*", 3000)
    assert len(decoded.collect()) == 1
    leaves = decoded._jdf.queryExecution().executedPlan().collectLeaves()
    assert leaves.head().metrics().apply("numFiles").value() == 1


def test_no_files(spark, tmp_path):
    (tmp_path / "notes.txt").write_text("x")
    assert images.inspect(spark, str(tmp_path), "*.png").count() == 0
