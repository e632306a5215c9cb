"""Sizes and pages of pictures from their headers, as expressions over the binary column: no picture leaves the JVM or is decoded.

Chains inside a file (the segments of a JPEG, the directories of a TIFF) are followed by folds over a number of steps: a few
first, and each time more for the files that need them, up to as many as the file could hold. A chain that comes back to a place it
has been at, or leaves the file, gives null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sides that are believed in pixels of 96 to the inch, frame headers of a JPEG, the sizes of TIFF values by type, and where its fields are.
MOST_SIDE = 20_000
FRAMES = [k for k in range(0xC0, 0xD0) if k not in (0xC4, 0xC8, 0xCC)]
TYPE_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
SUBFILE, WIDTH, HEIGHT, X_RESOLUTION, Y_RESOLUTION, UNIT = 254, 256, 257, 282, 283, 296
#: Steps of the first fold, and how many times as many each further one has.
FEW_STEPS, MORE_STEPS = 24, 4


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use of a value that is worked out once, however often it stands in the expression."""
    return F.transform(F.array(value), use)[0]


def uint(data: Column, at: Column | int, n: int, big: bool | Column = True) -> Column:
    """An unsigned integer of n bytes at a place from 0, the first or (not big) the last byte being the highest; null past the end."""
    at = at if isinstance(at, Column) else F.lit(at)
    part = F.regexp_extract(F.hex(F.substring(data, (at + 1).cast("int"), F.lit(n))), f"^([0-9A-F]{{{2 * n}}})$", 1)
    up, down = ("".join(f"${k}" for k in order) for order in (range(1, n + 1), range(n, 0, -1)))
    turned = F.lit(up if big else down) if isinstance(big, bool) else F.when(big, up).otherwise(down)
    text = part if big is True or n == 1 else F.regexp_replace(part, F.lit("(..)" * n), turned)
    return F.conv(F.nullif(text, F.lit("")), 16, 10).cast("long")


def signed(data: Column, at: int, n: int) -> Column:
    return let(uint(data, at, n, False), lambda v: F.when(v >= 2 ** (8 * n - 1), v - 2 ** (8 * n)).otherwise(v))


def _begins(data: Column, text: bytes, at: int = 0) -> Column:
    return F.hex(F.substring(data, at + 1, len(text))) == text.hex().upper()


def _size(width: Column, height: Column) -> Column:
    return F.when((width >= 1) & (height >= 1), F.struct(width.cast("long").alias("width"), height.cast("long").alias("height")))


def _shown(width: Column, height: Column) -> Column:
    """A size in pixels of 96 to the inch, if it is one that a page could have."""
    w, h = F.floor(width + 0.5), F.floor(height + 0.5)
    return F.when((w <= MOST_SIDE) & (h <= MOST_SIDE), _size(w, h))


def _followed(start: Column, step: Callable[[Column], Column], most: Column) -> Column:
    """start after step by step until `done`: few steps first, then each time more, FEW_STEPS and `most` in all."""
    # The number of steps before each fold; the last is above the length that any value has.
    befores = [0]
    while befores[-1] < 2**31:
        befores.append(FEW_STEPS + befores[-1] * MORE_STEPS)
    folds = F.array(*[F.struct(F.lit(a).cast("long").alias("before"), F.lit(b).cast("long").alias("after")) for a, b in zip(befores, befores[1:], strict=False)])
    all_steps = F.greatest(most.cast("long"), F.lit(1)) + FEW_STEPS

    def fold(state: Column, n: Column, all_: Column) -> Column:
        steps = F.sequence(n["before"] + 1, F.least(n["after"], all_))
        return F.when(state["done"] | (n["before"] >= all_), state).otherwise(F.aggregate(steps, state, lambda s, _: F.when(s["done"], s).otherwise(step(s))))

    return let(all_steps, lambda all_: F.aggregate(folds, start, lambda state, n: fold(state, n, all_)))


def _orientation(data: Column, at: Column, end: Column) -> Column:
    """The Exif orientation in a segment's body from `at` to `end`; null without one."""
    base = at + 6
    big = F.hex(F.substring(data, (base + 1).cast("int"), F.lit(2))) == "4D4D"
    exif = F.hex(F.substring(data, (at + 1).cast("int"), F.lit(6))) == "457869660000"

    def found(first: Column) -> Column:
        count = F.least(uint(data, first, 2, big), F.floor((end - first - 2) / 12)).cast("int")
        places = let(count, lambda n: F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: first + 2 + i * 12)))
        return uint(data, F.try_element_at(F.filter(places, lambda e: uint(data, e, 2, big) == 0x0112), F.lit(1)) + 8, 2, big)

    return F.when(exif & (end - at >= 14), let(base + uint(data, base + 4, 4, big), found))


def jpeg_size(data: Column) -> Column:
    """The size in a JPEG's frame header, turned as its Exif orientation says."""
    none = F.lit(None).cast("long")
    pack = lambda at, turned, w, h, done: F.struct(at.cast("long").alias("at"), turned.alias("turned"), w.alias("w"), h.alias("h"), done.alias("done"))

    def step(s: Column) -> Column:
        return let(F.struct(uint(data, s["at"], 1).alias("mark"), uint(data, s["at"] + 1, 1).alias("marker"), uint(data, s["at"] + 2, 2).alias("size")), lambda m: after(s, m))

    def after(s: Column, m: Column) -> Column:
        at, marker, size = s["at"], m["marker"], m["size"]
        stop, end = pack(at, s["turned"], none, none, F.lit(True)), at + 2 + size
        turn = F.when(marker == 0xE1, F.coalesce(_orientation(data, at + 4, end).between(5, 8), s["turned"])).otherwise(s["turned"])
        frame = pack(at, s["turned"], uint(data, at + 7, 2), uint(data, at + 5, 2), F.lit(True))
        return (
            F.when(F.coalesce((m["mark"] != 0xFF) | size.isNull(), F.lit(True)), stop).when(marker == 0xFF, pack(at + 1, s["turned"], none, none, F.lit(False)))
            .when(marker.between(0xD0, 0xD7) | (marker == 1), pack(at + 2, s["turned"], none, none, F.lit(False))).when((size < 2) | (end > F.length(data)), stop)
            .when(marker.isin(*FRAMES), F.when(size >= 7, frame).otherwise(stop)).when(marker.isin(0xD9, 0xDA), stop).otherwise(pack(end, turn, none, none, F.lit(False)))
        )

    found = _followed(pack(F.lit(2), F.lit(False), none, none, F.lit(False)), step, F.length(data))
    return let(found, lambda f: F.when(f["turned"], _size(f["h"], f["w"])).otherwise(_size(f["w"], f["h"])))


def tiff_pages(data: Column) -> Column:
    """The pages of a TIFF in order, (index, width, height, dpi_x, dpi_y): its directories with a size, but for reduced copies; null if it is none or its chain is broken."""
    big = _begins(data, b"MM")
    order = lambda at, n: uint(data, at, n, big)
    pack = lambda at, seen, done, bad: F.struct(at.cast("long").alias("at"), seen.alias("seen"), done.alias("done"), bad.alias("bad"))

    def step(s: Column) -> Column:
        return let(order(s["at"] + 2 + order(s["at"], 2) * 12, 4), lambda after: next_of(s, after))

    def next_of(s: Column, after: Column) -> Column:
        bad = F.array_contains(s["seen"], s["at"]) | after.isNull()
        return F.when(s["at"] == 0, pack(s["at"], s["seen"], F.lit(True), F.lit(False))).when(bad, pack(s["at"], s["seen"], F.lit(True), F.lit(True))).otherwise(pack(after, F.array_append(s["seen"], s["at"]), F.lit(False), F.lit(False)))

    sizes = F.create_map(*[F.lit(x).cast("long") for pair in TYPE_SIZES.items() for x in pair])
    tags = (SUBFILE, WIDTH, HEIGHT, X_RESOLUTION, Y_RESOLUTION, UNIT)

    def entry(e: Column) -> Column:
        """An entry's tag, its type, how many values it has, and where the first stands."""
        return let(F.struct(order(e, 2).alias("tag"), order(e + 2, 2).alias("type"), order(e + 4, 4).alias("count")), lambda h: F.struct(h["tag"].alias("tag"), h["type"].alias("type"), h["count"].alias("count"), F.when(h["count"] * F.try_element_at(sizes, h["type"]) <= 4, e + 8).otherwise(order(e + 8, 4)).alias("at")))

    def number(e: Column) -> Column:
        return F.when(e["count"] > 0, F.when(e["type"] == 3, order(e["at"], 2)).when(e["type"] == 4, order(e["at"], 4)))

    def ratio(e: Column) -> Column:
        return F.when(e["type"] == 5, order(e["at"], 4) / F.nullif(order(e["at"] + 4, 4), F.lit(0)))

    def page(ifd: Column, index: Column) -> Column:
        places = let(order(ifd, 2).cast("int"), lambda n: F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: ifd + 2 + i * 12)))
        entries = F.filter(F.transform(places, entry), lambda e: e["tag"].isin(*tags))

        def read(entries: Column) -> Column:
            first = lambda tag: F.try_element_at(F.filter(entries, lambda e: e["tag"] == tag), F.lit(1))
            return F.struct(number(first(SUBFILE)).alias("subfile"), number(first(WIDTH)).alias("width"), number(first(HEIGHT)).alias("height"), ratio(first(X_RESOLUTION)).alias("x"), ratio(first(Y_RESOLUTION)).alias("y"), F.coalesce(number(first(UNIT)), F.lit(2)).alias("unit"))

        def shown(v: Column) -> Column:
            inch = F.when(v["unit"] == 2, 1.0).when(v["unit"] == 3, 2.54)
            dpi = (v["x"] * inch).between(10, 10000) & (v["y"] * inch).between(10, 10000)
            fits = (F.coalesce(v["subfile"], F.lit(0)) % 2 == 0) & (v["width"] > 0) & (v["height"] > 0)
            return F.when(fits, F.struct(index.alias("index"), v["width"].alias("width"), v["height"].alias("height"), F.when(dpi, v["x"] * inch).alias("dpi_x"), F.when(dpi, v["y"] * inch).alias("dpi_y")))

        return let(let(entries, read), shown)

    tiff = (big | _begins(data, b"II")) & (order(F.lit(2), 2) == 42)
    chain = _followed(pack(order(F.lit(4), 4), F.array().cast("array<bigint>"), F.lit(False), F.lit(False)), step, F.length(data) / 6 + 2)
    return F.when(tiff, let(chain, lambda c: F.when(~c["bad"], F.array_compact(F.transform(c["seen"], page)))))


def tiff_size(data: Column) -> Column:
    """The size that a TIFF of one page is shown at: its pixels at its resolution."""
    one = let(tiff_pages(data), lambda pages: F.when((F.size(pages) == 1) & (pages[0]["index"] == 0), pages[0]))
    return let(one, lambda p: F.when(p["dpi_x"].isNotNull(), _shown(p["width"] * 96 / p["dpi_x"], p["height"] * 96 / p["dpi_y"])).otherwise(_shown(p["width"], p["height"])))


def metafile_size(data: Column) -> Column:
    """The size of an EMF by its frame, else its bounds, and of a WMF by its placeable header."""
    box = lambda at, n: (signed(data, at + 2 * n, n) - signed(data, at, n), signed(data, at + 3 * n, n) - signed(data, at + n, n))
    (fw, fh), (bw, bh), (w, h) = box(24, 4), box(8, 4), box(6, 2)
    emf = (uint(data, 0, 4, False) == 1) & (uint(data, 40, 4, False) == 0x464D4520) & (F.length(data) >= 88)
    wmf = (uint(data, 0, 4, False) == 0x9AC6CDD7) & (F.length(data) >= 40)
    inch = uint(data, 14, 2, False)
    return F.when(emf, F.when((fw > 0) & (fh > 0), _shown(fw / 2540 * 96, fh / 2540 * 96)).otherwise(_shown(bw + 1, bh + 1))).when(wmf & (inch > 0), _shown(F.abs(w) / inch * 96, F.abs(h) / inch * 96))


def icon_size(data: Column) -> Column:
    """The size of an icon's largest picture; a side of 0 is 256."""
    count = F.least(uint(data, 4, 2, False), F.floor((F.length(data) - 6) / 16))
    side = lambda at: F.when(uint(data, at, 1) == 0, 256).otherwise(uint(data, at, 1))
    sizes = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)).cast("int")), lambda k: F.struct((side(6 + k * 16) * side(7 + k * 16)).alias("area"), (-k).alias("first"), side(6 + k * 16).alias("w"), side(7 + k * 16).alias("h")))
    return let(F.array_max(sizes), lambda best: F.when(count > 0, _size(best["w"], best["h"])))


def picture_size(data: Column) -> Column:
    """(width, height) of a PNG, JPEG, GIF, WebP, BMP, icon, AVIF, TIFF, EMF or WMF; null where the header does not say."""
    le = lambda at, n: uint(data, at, n, False)
    vp8, lossless, extended = (_begins(data, k, 12) for k in (b"VP8 ", b"VP8L", b"VP8X"))
    webp = F.when(vp8, _size(le(26, 2) % 16384, le(28, 2) % 16384)).when(lossless, _size(le(21, 4) % 16384 + 1, F.floor(le(21, 4) / 16384) % 16384 + 1)).when(extended, _size(le(24, 3) + 1, le(27, 3) + 1))
    extent = F.instr(F.hex(F.substring(data, 1, 65536)), "69737065")  # ispe, which may also begin between two bytes
    at = F.when(extent % 2 == 1, F.floor(extent / 2))
    return (
        F.when(_begins(data, b"\x89PNG") & _begins(data, b"IHDR", 12), _size(uint(data, 16, 4), uint(data, 20, 4))).when(_begins(data, b"\xff\xd8\xff"), jpeg_size(data))
        .when(_begins(data, b"GIF87a") | _begins(data, b"GIF89a"), _size(le(6, 2), le(8, 2))).when(_begins(data, b"RIFF") & _begins(data, b"WEBP", 8), webp)
        .when(_begins(data, b"BM"), F.when(le(14, 4) == 12, _size(le(18, 2), le(20, 2))).otherwise(_size(F.abs(signed(data, 18, 4)), F.abs(signed(data, 22, 4)))))
        .when(uint(data, 0, 4) == 0x100, icon_size(data)).when(_begins(data, b"ftyp", 4), _size(uint(data, at + 8, 4), uint(data, at + 12, 4)))
        .when(_begins(data, b"II") | _begins(data, b"MM"), tiff_size(data)).otherwise(metafile_size(data))
    )
