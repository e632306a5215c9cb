"""Sizes and pages of made pictures, broken and looping ones too."""

import struct

import pytest
from pyspark.sql import functions as F

from quire.functions import pictures


def tiff(*pages, order="<", loop=False):
    """Directories of fields (tag, type, count, value); a value of more than four bytes is given as bytes behind everything."""
    out, at = struct.pack(f"{order}2sHI", b"II" if order == "<" else b"MM", 42, 8), 8
    for k, fields in enumerate(pages):
        extra_at, extra, body = at + 2 + 12 * len(fields) + 4, b"", b""
        for tag, kind, count, value in fields:
            if isinstance(value, bytes):
                body += struct.pack(f"{order}HHII", tag, kind, count, extra_at + len(extra))
                extra += value
            else:
                body += struct.pack(f"{order}HHI", tag, kind, count) + (struct.pack(f"{order}HH", value, 0) if kind == 3 else struct.pack(f"{order}I", value))
        following = extra_at + len(extra) if k + 1 < len(pages) else 8 if loop else 0
        out += struct.pack(f"{order}H", len(fields)) + body + struct.pack(f"{order}I", following) + extra
        at = len(out)
    return out


def jpeg(*segments, width=30, height=20):
    body = b"".join(struct.pack(">BBH", 0xFF, m, len(b) + 2) + b for m, b in segments)
    return b"\xff\xd8" + body + struct.pack(">BBHBHH", 0xFF, 0xC0, 17, 8, height, width) + bytes(10)


def exif(turn, order):
    mark = b"II" if order == "<" else b"MM"
    return b"Exif\0\0" + struct.pack(f"{order}2sHIHHHIHH", mark, 42, 8, 1, 0x112, 3, 1, turn, 0)


SIZE = [(256, 3, 1, 600), (257, 4, 1, 300)]
DPI = [*SIZE, (282, 5, 1, struct.pack(">II", 300, 1)), (283, 5, 1, struct.pack(">II", 600, 2)), (296, 3, 1, 2)]
CASES = [
    (b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480), (640, 480)),
    (jpeg(), (30, 20)),
    (jpeg((0xE1, exif(6, "<"))), (20, 30)),
    (jpeg((0xE1, exif(8, ">")), (0xE1, b"http:xmp"), *[(0xE2, bytes(70)) for _ in range(200)]), (20, 30)),
    (jpeg()[:8], None),
    (b"\xff\xd8\xff\xd9", None),
    (b"GIF89a" + struct.pack("<HH", 7, 9), (7, 9)),
    (b"RIFF\0\0\0\0WEBPVP8 " + bytes(10) + struct.pack("<HH", 100 | 0x4000, 50), (100, 50)),
    (b"RIFF\0\0\0\0WEBPVP8L" + bytes(5) + struct.pack("<I", 99 | 49 << 14), (100, 50)),
    (b"BM" + bytes(12) + struct.pack("<IHH", 12, 5, 6) + bytes(8), (5, 6)),
    (struct.pack("<HHH", 0, 1, 2) + bytes([16, 16]) + bytes(14) + bytes([0, 64]) + bytes(14), (256, 64)),
    (struct.pack("<HHH", 0, 1, 9) + bytes(10), None),
    (tiff(SIZE), (600, 300)),
    (tiff(DPI, order=">"), (192, 96)),
    (tiff(SIZE, SIZE), None),
    (struct.pack("<II4i4iI", 1, 88, 0, 0, 9, 9, 0, 0, 2540, 1270, 0x464D4520) + bytes(44), (96, 48)),
    (struct.pack("<IIII", 0, 0, 0, 0), None),
    (struct.pack("<IHhhhhH", 0x9AC6CDD7, 0, -720, 0, 720, 1440, 1440) + bytes(24), (96, 96)),
    (b"", None),
    (None, None),
]


def test_sizes(spark):
    rows = spark.createDataFrame([(k, None if c is None else bytearray(c)) for k, (c, _) in enumerate(CASES)], "k int, c binary").select("k", pictures.picture_size(F.col("c")).alias("s")).orderBy("k").collect()
    assert [(r.k, r.s and tuple(r.s)) for r in rows] == [(k, want) for k, (_, want) in enumerate(CASES)]


@pytest.mark.parametrize(
    ("content", "want"),
    [
        (tiff(SIZE, [(254, 4, 1, 1), *SIZE], [(256, 3, 1, 5)], DPI, order=">"), [(0, 600, 300, None), (3, 600, 300, 300.0)]),
        (tiff(*[SIZE] * 60), [(k, 600, 300, None) for k in range(60)]),
        (tiff(SIZE, SIZE, loop=True), None),
        (tiff(SIZE)[:-3], None),
        (b"II*\0\xff\xff\0\0", None),
        (b"no picture", None),
    ],
)
def test_tiff_pages(spark, content, want):
    (row,) = spark.createDataFrame([(bytearray(content),)], "c binary").select(pictures.tiff_pages(F.col("c")).alias("p")).collect()
    assert (row.p and [(p["index"], p.width, p.height, p.dpi_x) for p in row.p]) == want


def test_chains_of_every_length(spark):
    """A fold ends after 24, 120, 504 and 2,040 steps and the next goes on where it ended; the fill bytes of a JPEG are steps as well."""
    lengths = [0, 1, 22, 23, 24, 25, 119, 120, 121, 503, 504, 505, 2_040, 2_041, 3_000]
    made = [(n, bytearray(jpeg((0xE1, exif(6, "<")), *[(0xE2, b"")] * n, width=n + 1))) for n in lengths]
    made += [(-n, bytearray(b"\xff\xd8" + b"\xff" * n + jpeg(width=n + 1)[2:])) for n in lengths[1:]]
    rows = spark.createDataFrame(made, "n int, c binary").select("n", pictures.picture_size(F.col("c")).alias("s")).collect()
    assert {r.n: tuple(r.s) for r in rows} == {n: (20, n + 1) if n >= 0 else (1 - n, 20) for n, _ in made}
    pages = spark.createDataFrame([(n, bytearray(tiff(*[SIZE] * n, loop=loop))) for n in (24, 25, 121) for loop in (False, True)], "n int, c binary").select("n", F.coalesce(F.size(pictures.tiff_pages(F.col("c"))), F.lit(-1)).alias("p")).collect()
    assert sorted((r.n, r.p) for r in pages) == [(24, -1), (24, 24), (25, -1), (25, 25), (121, -1), (121, 121)]
